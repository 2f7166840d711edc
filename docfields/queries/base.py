"""Shared pieces of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.functions.lines import study_lines, to_lines
from docfields.operators.captures import read_words
from docfields.sources import samples

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where there is one, the SQL that gives the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def expect(columns: str, table: str = "customer", where: str = "", extra: str = "") -> str:
    """SQL over the printed and encoded truth of the sample documents."""
    tail = f" WHERE {where}" if where else ""
    return f"WITH t AS ({samples.truth_sql(table)}){extra} SELECT {columns} FROM t{tail}"


def fields(spark: SparkSession, sf_dir: str, table: str = "customer", **columns: Column) -> DataFrame:
    """k plus computed columns over the truth rows."""
    t = samples.truth(spark, sf_dir, table)
    return t.select("k", *[c.alias(n) for n, c in columns.items()])


def documents(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    """TRUTH columns plus `text` and studied `lines` of one document per customer."""
    t = samples.truth(spark, sf_dir).withColumn("text", text)
    return t.withColumn("lines", study_lines(to_lines(F.col("text"))))


def annotated(spark: SparkSession, sf_dir: str, text: Column, side: str = "back") -> DataFrame:
    """submission_id, rotation and upright words of one photographed document per customer."""
    captures = samples.captures_of(samples.truth(spark, sf_dir), "id", side, text)
    return read_words(captures)


def joined(*parts) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def line_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all card fronts and backs as a table."""
    t = samples.truth(spark, sf_dir)
    sides = [("front", samples.front_text()), ("back", samples.back_text())]
    return t.select(
        F.col("k").alias("submission_id"),
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("side"), x.alias("text")) for s, x in sides])
        ).alias("d"),
    ).select("submission_id", "d.side", F.posexplode(to_lines(F.col("d.text"))).alias("line_no", "text"))


# How many lines the sample sides have.
SURNAME_CUT = (
    "CASE WHEN k % 13 = 0 AND NOT (has_zone AND k % 9 = 0 AND surname <> 'GELASHVILI') "
    "THEN 1 ELSE 0 END"
)
N_FRONT = f"19 + {SURNAME_CUT}"
N_BACK = "6 + CASE WHEN k % 5 = 1 THEN 0 ELSE 1 END + CASE WHEN has_zone THEN 3 ELSE 0 END"
