"""Cleaning, labels, sentences and chunk records."""

from __future__ import annotations

from pyspark.sql import functions as F

from lekhya.functions import text as tx
from lekhya.operators.registry import query
from lekhya.plans.carry import looked_back

WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def dig(x: str) -> str:
    return f"translate({x}, '०१२३४५६७८९', '0123456789')"


def spaced(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '{WS}+', ' ', 'g'))"


def number(x: str) -> str:
    return f"coalesce(nullif(regexp_extract(lower({dig(x)}), '[0-9]+[क-हa-z]?', 0), ''), trim({x}))"


def terms(x: str) -> str:
    return f"list_filter(string_split({dig(spaced(f'coalesce({x}, chr(32))'))}, ' '), lambda w: w <> '')"


CLEAN = "regexp_replace(translate(text, chr(8205) || chr(8204), ''), '\n{3,}', chr(10) || chr(10), 'g')"


@query(f"SELECT search_id, {CLEAN} AS clean_text, length({CLEAN}) AS n_chars, CAST(length(text) - length({CLEAN}) AS BIGINT) AS n_removed FROM search_results")
def clean_text(t):
    clean = tx.cleaned(F.col("text"))
    return t("search_results").select("search_id", clean.alias("clean_text"), F.length(clean).cast("long").alias("n_chars"), (F.length("text") - F.length(clean)).cast("long").alias("n_removed"))


@query(f"SELECT result_id, {dig(spaced('question'))} AS question FROM correctness_results")
def normalised_questions(t):
    return t("correctness_results").select("result_id", tx.ascii_digits(tx.spaced(F.col("question"))).alias("question"))


@query(f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS pos, sentence FROM (
  SELECT doc_id, i, regexp_replace(parts[i], '^{WS}+|{WS}+$', '', 'g') AS sentence FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
      SELECT doc_id, regexp_split_to_array(regexp_replace(text, '।{WS}+', '।' || chr(10), 'g'), '\r?\n+') AS parts FROM documents)))
WHERE sentence <> ''""")
def sentence_split(t):
    return t("documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


_TAIL = "CASE WHEN length(prev) > 150 THEN right(prev, 150) ELSE prev END"


def _last(mark: str) -> str:
    return f"CASE WHEN contains(tail, {mark}) THEN length(tail) - length(string_split(tail, {mark})[-1]) - 1 ELSE -1 END"


@query(f"""
SELECT chunk_id, tail AS raw_tail, CASE WHEN cut IS NULL THEN tail ELSE regexp_replace(tail[cut + 2:], '^{WS}+|{WS}+$', '', 'g') END AS overlap FROM (
  SELECT chunk_id, tail, CASE WHEN d > 0 THEN d WHEN n > 0 THEN n WHEN s > 0 THEN s END AS cut FROM (
    SELECT chunk_id, tail, {_last("'।'")} AS d, {_last("chr(10)")} AS n, {_last("' '")} AS s FROM (
      SELECT chunk_id, {_TAIL} AS tail FROM (SELECT chunk_id, lag(text) OVER (PARTITION BY source ORDER BY chunk_id) AS prev FROM chunks) WHERE prev IS NOT NULL)))""")
def overlap_tail(t):
    """Overlap of each chunk with the chunk before it in its source."""
    before = looked_back(t("chunks").select("chunk_id", "source", "text"), "source", "chunk_id", previous={"prev": "text"})
    raw = F.when(F.length("prev") > 150, F.right(F.col("prev"), F.lit(150))).otherwise(F.col("prev"))
    return before.filter("prev is not null").select("chunk_id", raw.alias("raw_tail"), tx.overlap_tail(F.col("prev")).alias("overlap"))


@query(r"""
SELECT doc_id, CAST(len(labels) AS BIGINT) AS n_labels, coalesce(nullif(array_to_string(labels, ', '), ''), 'Unknown') AS label FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_extract(x, '^([०-९0-9]+[क-हA-Za-z]?)([.)]|[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+[^०-९0-9\s])', 1)), lambda x: x <> '') AS found,
    list_filter(found, lambda x, i: list_position(found, x) = i) AS labels FROM documents)""")
def section_labels(t):
    labels = tx.section_labels(F.col("text"))
    return t("documents").select("doc_id", F.size(labels).cast("long").alias("n_labels"), F.when(F.size(labels) > 0, F.array_join(labels, ", ")).otherwise("Unknown").alias("label"))


@query(r"""
SELECT doc_id, nullif(regexp_extract(text, '(?m)^भाग[–\-]?\s*([०-९0-9]+)', 1), '') AS part_header, nullif(regexp_extract(text, '(?m)^परिच्छेद[–\-]?\s*([०-९0-9]+)', 1), '') AS chapter_header FROM documents""")
def header_numbers(t):
    found = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    return t("documents").select("doc_id", found(tx.PART_HEADER).alias("part_header"), found(tx.CHAPTER_HEADER).alias("chapter_header"))


@query("""
SELECT chunk_id, last_value(bhag IGNORE NULLS) OVER w AS bhag, last_value(parichhed IGNORE NULLS) OVER w AS parichhed FROM chunks
WINDOW w AS (PARTITION BY source ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def header_carry_forward(t):
    return looked_back(t("chunks").select("chunk_id", "source", "bhag", "parichhed"), "source", "chunk_id", known={"bhag": "bhag", "parichhed": "parichhed"}).select("chunk_id", "bhag", "parichhed")


@query("""
SELECT chunk_id, coalesce(nullif(array_to_string(dafa_list, ', '), ''), 'Unknown') AS dafa, CAST(coalesce(len(dafa_list), 0) AS BIGINT) AS n_labels, coalesce(len(dafa_list), 0) > 1 AS is_merged, CAST(length(text) AS BIGINT) AS char_count FROM chunks""")
def chunk_records(t):
    n = F.coalesce(F.size("dafa_list"), F.lit(0))
    label = F.coalesce(F.nullif(F.array_join("dafa_list", ", "), F.lit("")), F.lit("Unknown"))
    return t("chunks").select("chunk_id", label.alias("dafa"), F.greatest(n, F.lit(0)).cast("long").alias("n_labels"), (n > 1).alias("is_merged"), F.length("text").cast("long").alias("char_count"))


@query("SELECT chunk_id AS old_id, CAST(row_number() OVER (ORDER BY source, chunk_id) AS BIGINT) AS chunk_id FROM chunks")
def global_renumber(t):
    from lekhya.plans.positions import ordered

    return ordered(t("chunks").select(F.col("chunk_id").alias("old_id"), "source"), ["source", "old_id"]).select("old_id", (F.col("position") + 1).alias("chunk_id"))


@query("""
SELECT source, count(*) AS n_chunks, round_even(avg(length(text)), 2) AS avg_chars, CAST(min(length(text)) AS BIGINT) AS min_chars, CAST(max(length(text)) AS BIGINT) AS max_chars, count(*) FILTER (WHERE is_merged) AS n_merged,
  round_even(100.0 * count(*) FILTER (WHERE is_merged) / count(*), 2) AS merged_share FROM chunks GROUP BY source""")
def chunk_stats(t):
    n = F.length("text")
    return t("chunks").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.bround(F.avg(n), 2).alias("avg_chars"), F.min(n).cast("long").alias("min_chars"), F.max(n).cast("long").alias("max_chars"), F.count_if("is_merged").alias("n_merged"), F.bround(100.0 * F.count_if("is_merged") / F.count(F.lit(1)), 2).alias("merged_share")
    )


@query(f"SELECT search_id, dafa AS label, {number('dafa')} AS number FROM search_results")
def section_numbers(t):
    return t("search_results").select("search_id", F.col("dafa").alias("label"), tx.section_number(F.col("dafa")).alias("number"))


@query(f"""
SELECT chunk_id, array_to_string(list_sort(list_distinct(list_transform(CASE WHEN len(dafa_list) > 0 THEN dafa_list ELSE [dafa] END, lambda x: {number('x')}))), '|') AS numbers FROM chunks""")
def chunk_section_sets(t):
    labels = F.when(F.size("dafa_list") > 0, F.col("dafa_list")).otherwise(F.array("dafa"))
    return t("chunks").select("chunk_id", F.array_join(F.array_sort(F.array_distinct(F.transform(labels, tx.section_number))), "|").alias("numbers"))


_GATE = r"regexp_full_match(text, '[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]*[०-९0-9]+[क-हA-Za-z]?[.)]?[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]*')"


@query(f"""
SELECT source, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS n_empty, count(*) FILTER (WHERE {_GATE}) AS n_bare_number, count(*) FILTER (WHERE length(trim(text)) < 100) AS n_under_100,
  NOT (bool_or(text IS NULL OR trim(text) = '') OR coalesce(bool_or({_GATE}), false) OR coalesce(bool_or(length(trim(text)) < 100), false)) AS passes FROM chunks GROUP BY source""")
def chunk_gate(t):
    empty, bare, short = F.col("text").isNull() | (F.trim("text") == ""), F.col("text").rlike(r"(?U)\A\s*[०-९\d]+(?:[क-हA-Za-z])?[.)]?\s*\z"), F.length(F.trim("text")) < 100
    return t("chunks").groupBy("source").agg(F.count_if(empty).alias("n_empty"), F.count_if(bare).alias("n_bare_number"), F.count_if(short).alias("n_under_100")).withColumn("passes", F.expr("n_empty + n_bare_number + n_under_100 = 0"))
