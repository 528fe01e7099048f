"""The pN_ queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lekhya.llm import canonical, containers, defects, groups, mixing, overlaps, pieces, spans, truncation


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": truncation.p1_found,
        "p1_truncation_report": truncation.p1_truncation_report,
        "p2_found": overlaps.p2_found,
        "p2_overlap_report": overlaps.p2_overlap_report,
        "p3_found": defects.p3_found,
        "p3_defect_report": defects.p3_defect_report,
        "p4_found": canonical.p4_found,
        "p4_canonical": canonical.p4_canonical,
        "p5_found": groups.p5_found,
        "p5_splits": groups.p5_splits,
        "p5_incremental": groups.p5_incremental,
        "p5_split_report": groups.p5_split_report,
        "p6_found": pieces.p6_found,
        "p6_pieces": pieces.p6_pieces,
        "p7_containers": containers.p7_containers,
        "p7_fill_report": containers.p7_fill_report,
        "p8_mix": mixing.p8_mix,
        "p8_share_report": mixing.p8_share_report,
        "p9_found": spans.p9_found,
        "p9_shared": spans.p9_shared,
    }


# White space as the operators count it.
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

SQL = {
    "p6_found": f"""
SELECT search_id, CASE WHEN list_max(list_transform(regexp_split_to_array(text, '{WS}+'), lambda x: length(x))) > max_size THEN 'hard' WHEN list_max(list_transform(regexp_split_to_array(text, '[।?!\n]'), lambda x: length(x))) > max_size THEN 'space' ELSE 'sentence' END AS cut_kind
FROM search_results, (SELECT max_size FROM size_limits WHERE item_kind = 'search_result_text') WHERE length(text) > max_size""",
    "p5_found": f"""
WITH RECURSIVE ids AS (SELECT DISTINCT id FROM eval_items WHERE id IS NOT NULL),
labels AS (SELECT question_id AS id, metadata.source AS source, unnest(regexp_extract_all(lower(translate(dafa, '०१२३४५६७८९', '0123456789')), '[0-9]+[क-हa-z]?')) AS number FROM search_results WHERE rank = 1 AND metadata.source IS NOT NULL),
ties AS (SELECT DISTINCT id, 'd ' || lower(regexp_replace(drafter, '^{WS}+|{WS}+$', '', 'g')) AS key FROM eval_items WHERE regexp_replace(drafter, '^{WS}+|{WS}+$', '', 'g') <> ''
  UNION SELECT id, 's ' || source || ' ' || regexp_replace(number, '^0+([0-9])', '\1') FROM labels WHERE id IN (SELECT id FROM ids)),
links AS (SELECT DISTINCT t.id AS a, m.id AS b FROM ties t JOIN (SELECT key, min(id) AS id FROM ties GROUP BY key) m USING (key)),
comp(id, g) USING KEY (id) AS (SELECT id, id FROM ids UNION SELECT n.id, min(c.g) FROM comp c JOIN (SELECT a AS x, b AS id FROM links UNION SELECT b, a FROM links) n ON n.x = c.id JOIN recurring.comp r ON r.id = n.id WHERE c.g < r.g GROUP BY n.id)
SELECT id AS question_id, g AS group_id FROM comp WHERE g IN (SELECT g FROM comp GROUP BY g HAVING count(*) > 1)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
