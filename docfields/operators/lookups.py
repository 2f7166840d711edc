"""Dictionary lookups: exact ones as joins, the others as narrow columns over the value lists.

Every dictionary has a size fixed by the value lists (88 rows at most), never by the
data, so it is always safe to broadcast; `dimension` checks that. `dictionaries` serves tables of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.functions import values as V
from docfields.functions.match import PLACE_BY_KEY, known_place, near_place

MAX_ROWS = 1000


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A dictionary as a relation, to be broadcast if it is small; a larger one is joined by key."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= MAX_ROWS else table


def places(spark: SparkSession) -> DataFrame:
    return dimension(spark, list(PLACE_BY_KEY.items()), "lat_key string, geo string")


def given_names(spark: SparkSession) -> DataFrame:
    return dimension(spark, list(V.GIVEN_NAMES.items()), "lat_key string, geo string")


def transliteration(spark: SparkSession) -> DataFrame:
    return dimension(spark, list(V.LETTER_TO_LATIN.items()), "letter string, lat string")


def letter_twins(spark: SparkSession) -> DataFrame:
    """Latin forms that several letters share."""
    groups = transliteration(spark).groupBy("lat").agg(
        F.sort_array(F.collect_list("letter")).alias("letters")
    )
    return groups.filter(F.size("letters") > 1)


def lookup_exact(df: DataFrame, key: str, dim: DataFrame) -> DataFrame:
    """Official spelling of a Latin key, NULL when unknown (broadcast hash join)."""
    return df.join(dim.withColumnRenamed("lat_key", key), key, "left")


def known_values(df: DataFrame, column: str, dim: DataFrame) -> DataFrame:
    """Rows whose value is exactly an official spelling (semi-join)."""
    return df.join(dim.select(F.col("geo").alias(column)).distinct(), column, "left_semi")


def lookup_whole_word(df: DataFrame, text: str) -> DataFrame:
    """Longest official place standing as its own word in a text. Narrow: the value lists are
    part of the expression, so a text that is frequent among the rows is no hot key."""
    return df.withColumn("place", known_place(F.col(text)))


def lookup_fuzzy(df: DataFrame, column: str) -> DataFrame:
    """Official place of five letters or more at most one edit away from a value. Narrow as well."""
    return df.withColumn("place", near_place(F.col(column)))
