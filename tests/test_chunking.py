import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lekhya.operators import chunking as c

TEXT = st.text(alphabet="कख ।\nab१.;", max_size=400)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(5, 60))
def test_packed_pieces_fit_and_keep_the_letters(text, size):
    pieces = c.packed(text, size)
    assert all(0 < len(p) <= size and p.strip() for p in pieces)
    drop = lambda s: re.sub(r"[\s।]", "", s)
    assert drop("".join(pieces)) == drop(text)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_units_and_groups_keep_the_letters(text):
    units = c.units(text, 40)
    assert all(0 < len(u) <= 41 for u in units)
    drop = lambda s: re.sub(r"\s", "", s)
    assert drop("".join(units)) == drop(text)
    groups = c.coalesced(c.grouped(units, 40), 10, 40)
    assert drop("".join(groups)) == drop(text)


def plainly_packed(text, size, separators=c.SEPARATORS):
    """The rule as it is told: parts joined one by one."""
    if len(text) <= size:
        return [text] if text.strip() else []
    if not separators:
        return [x for i in range(0, len(text), size) if (x := text[i : i + size]).strip()]
    out, now = [], ""
    for part in text.split(separators[0]):
        both = now + separators[0] + part if now else part
        if len(both) <= size:
            now = both
        else:
            out.append(now)
            pieces = plainly_packed(part, size, separators[1:]) if len(part) > size else [part]
            out, now = out + pieces[:-1], pieces[-1] if pieces else ""
    return [p for p in [*out, now] if p.strip()]


def plainly_coalesced(groups, smallest, size):
    out, pending = [], None
    for g in groups:
        if pending is not None and len(pending) + 1 + len(g) <= size:
            g = pending + " " + g
        elif pending is not None:
            out.append(pending)
        pending = None
        if len(g) >= smallest:
            out.append(g)
        elif out and len(out[-1]) + 1 + len(g) <= size:
            out[-1] = out[-1] + " " + g
        else:
            pending = g
    return out + ([] if pending is None else [pending])


def plainly_cut(text, size):
    out = []
    for sentence in re.split(r"(?<=।)\s+|\r?\n+", text):
        rest = sentence.strip()
        while len(rest) > size:
            at = max(i for i in range(-1, size + 1) if i < 0 or rest[i] in "।;, ")
            at = at + 1 if at >= size // 2 else size
            out, rest = [*out, rest[:at].strip()], rest[at:].strip()
        out.append(rest)
    return [u for u in out if u]


@settings(max_examples=600, deadline=None)
@given(TEXT, st.integers(2, 60))
def test_packing_and_cutting_equal_the_plain_rules(text, size):
    assert c.packed(text, size) == plainly_packed(text, size)
    assert c.units(text, size) == plainly_cut(text, size)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=30), max_size=12), st.integers(1, 20), st.integers(20, 60))
def test_coalescing_equals_the_plain_rule(groups, smallest, size):
    assert c.coalesced(groups, smallest, size) == plainly_coalesced(groups, smallest, size)


def test_packed_without_finer_separator():
    assert c.packed("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert c.packed("  ") == []


def test_packed_keeps_last_inner_piece_open():
    assert c.packed("aaaa bbbb cccc\ndd", 10) == ["aaaa bbbb", "cccc\ndd"]


def test_tail_and_overlap():
    assert c.tail("abc।") == ""
    assert c.overlapped(["क। ख", "ग"], "\n") == ["क। ख", "ख\nग"]


def test_tiny_group_before_large_neighbour():
    assert c.coalesced(["ab", "x" * 40], 10, 41) == ["ab", "x" * 40]
    assert c.coalesced(["ab", "x" * 20], 10, 41) == ["ab " + "x" * 20]


def test_sections_and_hybrid():
    text = "भाग १\n१. पहिलो\nथप\n२क. दोस्रो\nदफा ३. तेस्रो"
    assert c.sections(text) == ["भाग १", "१. पहिलो\nथप", "२क. दोस्रो", "दफा ३. तेस्रो"]
    assert all(len(p) <= c.LARGEST for p in c.hybrid("१. " + "क ख। " * 900))


def test_chunked_edges(spark):
    rows = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, "१. क। ख", "z"), (3, "१. क। ख", "z")], "doc_id long, text string, pos string")
    for strategy in c.STRATEGIES:
        got = c.chunked(rows, "doc_id", "text", strategy).collect()
        assert {r.doc_id for r in got} == {3} and len(got) == 2
        assert c.chunked(rows.limit(0), "doc_id", "text", strategy).count() == 0
    with pytest.raises(ValueError):
        c.chunked(rows, "doc_id", "text", "other")
    assert {r.label for r in c.chunked(rows, "doc_id", "text", "section").collect()} == {"१"}
