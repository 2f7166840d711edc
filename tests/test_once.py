"""F5, F7, F8, F9, F11: readers work out each value once, and a line costs its length."""

import time

import pytest
from pyspark.sql import functions as F

from docfields.functions import match as MT
from docfields.functions import mrz as M
from docfields.functions import text as T
from docfields.functions.geometry import number_boxes


def expression(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nz_reads_its_argument_once_inside_lambdas(spark):
    """`nullif` in a lambda was evaluated twice, nested ones four times."""
    lines = spark.range(1).select(F.array(F.col("id").cast("string")).alias("lines"))
    plan = expression(lines.select(F.transform("lines", lambda x: T.nz(F.reverse(T.nz(F.upper(x))))).alias("v")))
    assert plan.count("upper(") == 1 and plan.count("reverse(") == 1
    assert [r.v for r in spark.createDataFrame([("",), ("a",), (None,)], "c string").select(T.nz(F.col("c")).alias("v")).collect()] == [None, "a", None]


# rows of a card: dates of a line, dates and loose dates and names of the whole text
@pytest.mark.parametrize("reader, times", [(lambda x: M.td1_strip(F.array(x)), 4), (T.georgian_only, 1)])
def test_patterns_are_matched_once_per_line(spark, reader, times):
    lines = spark.range(1).select(F.array(F.col("id").cast("string")).alias("lines"))
    plan = expression(lines.select(F.transform("lines", reader).alias("v")))
    assert plan.count("regexp_extract(") == times


def test_a_long_line_without_georgian_costs_its_length(value):
    start = time.perf_counter()
    assert value(T.georgian_only(F.repeat(F.lit("LATIN "), 50_000))) is None
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize("text, side", [
    ("a/ბ გ/დ", "ბ გ"), ("ქუთაისი / KUTAISI", "ქუთაისი"), ("KUTAISI/x ქუთაისი", "ქუთაისი"), ("//", None), ("", None), ("a\nგორი", "გორი"), ("ა1ბბ/გგგ", "ბბ"),
])
def test_georgian_side(value, text, side):
    assert value(T.georgian_only(F.lit(text))) == side


def test_every_misreading_has_a_mark(value):
    for pairs in (M.PREFIX_REPAIRS, M.LINE_REPAIRS, M.BLOB_REPAIRS, M.FIELD_REPAIRS, M.PASSPORT_REPAIRS):
        for old, new in pairs:
            assert any(mark in old for mark in M.REPAIR_MARKS)
            assert value(M.repair(F.lit(f"x{old}y"), pairs)) == value(T.replace_all(F.lit(f"x{old}y"), pairs))
    assert value(M.repair(F.lit(None).cast("string"), M.LINE_REPAIRS)) is None


@pytest.mark.parametrize("geo, hint, fixed", [
    ("მურუსიძე", "MURUSIDZE", "მურუსიძე"), ("მურუსიძ", "MURUSIDZE", "მურუსიძე"), ("ლევან", "LEVANI", "ლევანი"), (None, "NINO", None), ("ნინო", None, "ნინო"),
])
def test_names_that_read_as_their_hint_stay(value, geo, hint, fixed):
    text = lambda v: F.lit(v).cast("string")
    assert value(MT.fix_person_name(text(geo), text(hint), F.lit(False))) == fixed


def test_names_are_exchanged_for_the_other_hints(value):
    better = lambda *v: value(MT.swapped_fits_better(*[F.lit(x).cast("string") for x in v]))
    assert better("მურუსიძე", "ბექა", "BEKA", "MURUSIDZE") is True
    assert better("ბექა", "მურუსიძე", "BEKA", "MURUSIDZE") is False
    assert better("ნინო", "ნინო", "NINO", "NINO") is False


def test_short_words_are_no_number_boxes(spark):
    box = "struct<text:string,x1:double,y1:double,x2:double,y2:double,cx:double,cy:double>"
    row = lambda text, x: (text, x, 0.0, x + 10, 20.0, x + 5, 10.0)
    words = spark.createDataFrame([([row("12345678", 0.0), row("O12345678", 100.0), row(None, 200.0), row("1234-56789", 300.0)],)], f"words array<{box}>")
    got = words.select(number_boxes(F.col("words"))["digits"].alias("d")).head().d
    assert got == ["012345678", "123456789"]


def test_a_name_is_repaired_once(spark):
    """The repaired name was worked out for the test of its last letter and again for the name."""
    names = spark.range(1).select(F.array(F.col("id").cast("string")).alias("names"))
    plan = expression(names.select(F.transform("names", lambda x: MT.restore_final_i(F.reverse(x), x)).alias("v")))
    assert plan.count("reverse(") == 1
