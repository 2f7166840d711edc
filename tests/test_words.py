"""Word tables give what the arrays of one capture give; a page with most of the words spreads over ranges."""

import random

import pytest
from pyspark.sql import functions as F

from docfields.functions import geometry as G
from docfields.functions.text import first
from docfields.operators import words as OW

WORD = "struct<text:string,x1:double,y1:double,x2:double,y2:double,cx:double,cy:double>"


@pytest.fixture(scope="module")
def pages(spark):
    """submission_id, words (array): pages of random boxes with digits, titles and dates, one with most of the words, two with very few."""
    rng = random.Random(4)
    texts = ["PERSONAL", "პირადი", "issue", "გაცემის", "12.03.2019", "01.01", "2020", "x", "სახლი", "0123456789", "01234567890", "123456789", "OI2345678", "99"]
    rows = []
    for page, n in ((1, 900), (2, 40), (3, 60), (4, 1), (5, 25), (6, 80), (7, 30)):
        words = []
        for _ in range(n):
            x, y, h = rng.randrange(0, 900), rng.randrange(0, 30 * max(1, n // 8)), rng.choice([8, 10, 20, 44])
            words.append((rng.choice(texts), float(x), float(y), float(x + 60), float(y + h), x + 30.0, y + h / 2))
        rows.append((page, "back", words))
    return spark.createDataFrame(rows, f"submission_id long, side string, words array<{WORD}>").cache()


@pytest.fixture(scope="module")
def table(pages):
    return pages.select("submission_id", "side", F.posexplode("words").alias("word_id", "w")).select("submission_id", "side", "word_id", "w.*").repartition(5).cache()


@pytest.fixture(params=[4, 31])
def ranges(request, spark):
    """Few and very many ranges, so that rows run on through several of them."""
    keys = {"spark.sql.shuffle.partitions": str(request.param), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("gap", [16.0, 1.0, 1e9])
def test_rows(pages, table, ranges, gap):
    want = pages.select("submission_id", F.posexplode(F.transform(G.words_to_rows(F.col("words"), F.lit(16.0), F.lit(gap)), G.row_text)).alias("row_no", "text"))
    got = OW.row_texts(OW.words_to_rows(table, F.lit(16.0), F.lit(gap)))
    order = lambda df: sorted(tuple(r) for r in df.select("submission_id", "row_no", "text").collect())
    assert order(got) == order(want)


def test_number_boxes_and_personal_id(pages, table, ranges):
    want = {r.submission_id: r.d for r in pages.select("submission_id", G.number_boxes(F.col("words"))["digits"].alias("d")).collect()}
    boxes = OW.number_boxes(table).groupBy("submission_id").agg(F.array_sort(F.collect_list(F.struct("box_no", "digits")))["digits"].alias("d"))
    got = {r.submission_id: r.d for r in boxes.collect()}
    assert got == {k: d for k, d in want.items() if d} and any(len(x) >= 18 for x in want[1])
    want = {r.submission_id: r.p for r in pages.select("submission_id", G.layout_personal_id(F.col("words")).alias("p")).collect()}
    got = {r.submission_id: r.personal_id for r in OW.layout_personal_id(table).collect()}
    assert got == {k: p for k, p in want.items() if p}


def test_same_row(pages, table):
    anchors = table.filter("word_id % 3 = 0")
    third = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x["i"] % 3 == 0)
    asked = pages.select("submission_id", "words", F.explode(third).alias("a"))
    want = asked.select("submission_id", "a.i", G.same_row_text(F.col("words"), F.col("a.w"), 0.7, 12.0).alias("row"))
    got = OW.same_row_texts(anchors, table, 0.7, 12.0)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.select("submission_id", "word_id", "row").collect())) == sorted(map(tuple, want.collect()))


def test_issue_date(pages, table, ranges):
    want = {r.submission_id: r.d for r in pages.select("submission_id", first(G.card_issue_dates(F.col("words"))).alias("d")).collect()}
    got = {r.submission_id: r.issue_date for r in OW.card_issue_date(table).collect()}
    assert got == {k: d for k, d in want.items() if d} and len(got) >= 3


def test_passport_issue_date(spark, ranges):
    """Titles in whole and in part, damaged, beside other words, below the birth place, or none; dates as numbers and in words."""
    rng = random.Random(6)
    titles = ["გაცემის", "თარიღი", "DATE OF ISSUE", "issl", "late", "author", "დაბადების", "ადგილი", "PLACE OF BIRTH", "x", "სახლი"]
    dates = ["12.03.2019", "12 MAR 2019", "01 JAN 2020", "5.5.2021", "30", "2018"]
    rows = []
    for page in range(60):
        words = []
        for _ in range(rng.choice([2, 8, 20, 60])):
            x, y, h = rng.randrange(0, 800), rng.randrange(0, 500), rng.choice([10, 16, 30])
            words.append((rng.choice(titles if rng.random() < 0.35 else dates), float(x), float(y), float(x + 60), float(y + h), x + 30.0, y + h / 2))
        rows.append((page, "page", words))
    pages = spark.createDataFrame(rows, f"submission_id long, side string, words array<{WORD}>")
    table = pages.select("submission_id", "side", F.posexplode("words").alias("word_id", "w")).select("submission_id", "side", "word_id", "w.*").repartition(4)
    want = {r.submission_id: r.d for r in pages.select("submission_id", first(G.passport_issue_dates(F.col("words"))).alias("d")).collect()}
    got = {r.submission_id: r.issue_date for r in OW.passport_issue_date(table).collect()}
    assert got == {k: d for k, d in want.items() if d} and len(got) > 20


def test_no_words(table):
    none = table.limit(0)
    assert OW.words_to_rows(none, F.lit(16.0), F.lit(16.0)).count() == 0
    assert OW.same_row_texts(none, table, 0.7, 12.0).count() == 0
    assert OW.layout_personal_id(none).count() == 0 and OW.card_issue_date(none).count() == 0


def test_rows_run_on_through_small_blocks(pages, table, monkeypatch):
    """A window holds a block of a range, so that memory doesn't follow the size of ranges; rows, boxes and dates run on from block to block."""
    monkeypatch.setattr(OW, "BLOCK", 2)
    order = lambda df: sorted(map(tuple, df.collect()))
    whole = F.transform(G.words_to_rows(F.col("words"), F.lit(16.0), F.lit(16.0)), G.row_text)
    rows = OW.row_texts(OW.words_to_rows(table, F.lit(16.0), F.lit(16.0))).select("submission_id", "row_no", "text")
    assert order(rows) == order(pages.select("submission_id", F.posexplode(whole)))
    ids = {r.submission_id: r.p for r in pages.select("submission_id", G.layout_personal_id(F.col("words")).alias("p")).collect() if r.p}
    assert {r.submission_id: r.personal_id for r in OW.layout_personal_id(table).collect()} == ids and ids
