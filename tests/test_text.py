from pyspark.sql import functions as F

from lekhya.functions import text as tx


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_clean_and_space(spark):
    assert one(spark, "क‍ख‌\n\n\n\n\nग", tx.cleaned) == "कख\n\nग"
    assert one(spark, "  A b \n C ", tx.spaced) == "a b c"
    assert one(spark, None, tx.cleaned) is None
    assert one(spark, "१२abc०", tx.ascii_digits) == "12abc0"


def test_section_labels_need_unicode_classes(spark):
    text = "१२. a\n१२क. b\n५ ६ x\n7) y\n३ क\n१२. again"
    assert one(spark, text, tx.section_labels) == ["१२", "१२क", "7", "३"]
    assert one(spark, "", tx.section_labels) == []


def test_section_number(spark):
    assert one(spark, "दफा १२क, १३", tx.section_number) == "12क"
    assert one(spark, " Unknown ", tx.section_number) == "Unknown"


def test_overlap_tail(spark):
    assert one(spark, "पहिलो वाक्य।", tx.overlap_tail) == ""
    assert one(spark, "पहिलो। दोस्रो भाग", tx.overlap_tail) == "दोस्रो भाग"
    assert one(spark, "no" * 100, tx.overlap_tail) == ("no" * 100)[-150:]
    assert one(spark, None, tx.overlap_tail) is None


def test_sentences(spark):
    assert one(spark, "क।  ख।\n\nग\r\nघ", tx.sentences) == ["क।", "ख।", "ग", "घ"]
    assert one(spark, " \n ", tx.sentences) == []


def test_half_even_rounding(spark):
    assert spark.sql("select 1").select(tx.rounded(F.lit(0.50625))).first()[0] == 0.5062
