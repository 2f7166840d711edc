"""Documents are built where the session spreads them, and once."""

import pytest
from pyspark.sql import functions as F

from docfields.operators.captures import flatten_annotation
from docfields.queries import QUERIES
from docfields.queries.layout import _word_table
from docfields.sources import samples


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("customers")
    rows = spark.range(40).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey"))
    rows.coalesce(1).write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_do_not_build_documents_before_they_are_spread(spark, customers):
    """F1 to F3, F12: the filter that Spark adds for an explode was pushed below the exchange, into the one task of the scan."""
    plan = optimized(QUERIES["td1_strip"](spark, customers))
    assert "Repartition" in plan
    below = plan[plan.index("Repartition") :]
    assert "Filter" not in below and "transform(" not in below


def test_words_are_taken_apart_without_a_second_reading(spark, customers):
    words = flatten_annotation(samples.captures_of(samples.truth(spark, customers), "id", "back", samples.back_text()))
    assert "Filter" not in optimized(words)


def test_word_tables_are_stored_once(spark, customers):
    stored = _word_table(spark, customers, samples.back_text())
    assert stored.inputFiles() and "transform(" not in optimized(stored)


def test_word_ids_follow_the_array_and_missing_words_give_no_row(spark, customers):
    t = samples.truth(spark, customers)
    words = flatten_annotation(samples.captures_of(t, "id", "back", F.col("row1")))
    assert words.schema["word_id"].dataType.simpleString() == "int"
    rows = {(r.submission_id, r.word_id): r.text for r in words.collect()}
    truth = {r.k: r.row1 for r in t.select("k", "row1").collect()}
    assert rows == {(k, 0): v for k, v in truth.items() if k % 3}


def test_left_out_coordinates_are_zero_and_whole_boxes_stay(spark):
    from docfields.functions.geometry import whole_vertices

    corners = "array<struct<x:int,y:int>>"
    rows = spark.createDataFrame([(1, [(1, 2), (3, 4)]), (2, [(None, 2), (3, None)]), (3, []), (4, None), (5, [None, (1, 2)])], f"i int, v {corners}")
    got = {r.i: r.w and [tuple(p) for p in r.w] if r.w is not None else None for r in rows.select("i", whole_vertices(F.col("v")).alias("w")).collect()}
    assert got == {1: [(1, 2), (3, 4)], 2: [(0, 2), (3, 0)], 3: [], 4: None, 5: [(0, 0), (1, 2)]}
