"""Column functions on Devanagari and mixed text. Nulls give null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits of both scripts, joiners, header patterns.
DEVANAGARI_DIGITS, ASCII_DIGITS = "०१२३४५६७८९", "0123456789"
JOINERS = "‍‌"
SECTION_LABEL = r"(?mU)^([०-९\d]+(?:[क-हA-Za-z])?)(?:[.)]|\s+(?=[^\d\s]))\s*"
SECTION_HEADER = r"(?mU)^(?:दफा\s*)?[०-९\d]+(?:[क-हA-Za-z])?[.)]"
PART_HEADER = r"(?mU)^भाग[–\-]?\s*([०-९\d]+)"
CHAPTER_HEADER = r"(?mU)^परिच्छेद[–\-]?\s*([०-९\d]+)"
SECTION_NUMBER = r"[0-9]+(?:[क-हa-z])?"


def ascii_digits(c: Column) -> Column:
    return F.translate(c, DEVANAGARI_DIGITS, ASCII_DIGITS)


def cleaned(c: Column) -> Column:
    """Without joiners, runs of three or more line breaks made two."""
    return F.regexp_replace(F.translate(c, JOINERS, ""), r"\n{3,}", "\n\n")


def spaced(c: Column) -> Column:
    """Lower case, every run of white space one space, none outside."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def terms(c: Column) -> Column:
    """Lower-case words with ASCII digits, as an array; empty for null and blank texts."""
    return F.filter(F.split(ascii_digits(spaced(F.coalesce(c, F.lit("")))), " "), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Trimmed sentences: parts between danda and blanks or between line breaks; empty parts dropped."""
    parts = F.split(c, r"(?U)(?<=।)\s+|\r?\n+")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def section_labels(c: Column) -> Column:
    """Labels that begin a line, distinct in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(SECTION_LABEL), 1))


def section_number(c: Column) -> Column:
    """First number of a label with the letter behind it, in ASCII digits; a label without number is itself, trimmed."""
    found = F.regexp_extract(F.lower(ascii_digits(c)), SECTION_NUMBER, 0)
    return F.when(found != "", found).otherwise(F.trim(c))


def last_place(c: Column, mark: str) -> Column:
    """0-based place of the last ``mark``, -1 without one."""
    at = F.instr(F.reverse(c), mark)
    return F.when(at > 0, F.length(c) - at).otherwise(F.lit(-1))


def overlap_tail(previous: Column, size: int = 150) -> Column:
    """The part of the last ``size`` characters behind their last danda, else line break, else space; empty behind a final danda."""
    tail = F.when(F.length(previous) > size, F.right(previous, F.lit(size))).otherwise(previous)
    cut = F.when(last_place(tail, "।") > 0, last_place(tail, "।")).when(last_place(tail, "\n") > 0, last_place(tail, "\n")).when(last_place(tail, " ") > 0, last_place(tail, " "))
    rest = F.regexp_replace(F.substring(tail, cut + 2, F.lit(size)), r"(?U)^\s+|\s+$", "")
    return F.when(cut.isNull(), tail).otherwise(rest)


def rounded(c: Column, digits: int = 4) -> Column:
    """Half-even rounding, as averages of the evaluation are rounded."""
    return F.bround(c, digits)
