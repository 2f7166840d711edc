"""Captures: reading one photo, taking it apart into rows, pairing the two sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions.geometry import page_rotation, tree_words, word_boxes
from docfields.functions.lines import to_lines
from docfields.functions.text import nz, strip
from docfields.sources.schemas import CORRUPT

KEYS = ["submission_id", "side"]


def read_words(captures: DataFrame) -> DataFrame:
    """Add `rotation` and `words` (upright boxes). An empty text has neither."""
    empty = F.coalesce(strip(F.col("full_text")), F.lit("")) == ""
    tree = captures.withColumn("tree", F.when(~empty, tree_words(F.col("pages"))))
    turned = tree.withColumn("rotation", page_rotation(F.col("tree")))
    return turned.withColumn(
        "words", word_boxes(F.col("tree"), F.col("rotation"))
    ).drop("tree")


def flatten_annotation(captures: DataFrame) -> DataFrame:
    """One row per non-empty word. Narrow: a capture is taken apart where it lies."""
    # exploding a column adds a filter on its size, which would read all words a second time; exploding an expression does not
    numbered = F.transform("words", lambda w, i: F.struct(i.alias("word_id"), w.alias("w")))
    return read_words(captures).select(*KEYS, F.inline(numbered)).select(*KEYS, "word_id", "w.*")


def split_lines(captures: DataFrame) -> DataFrame:
    """One row per trimmed, non-empty line. Narrow."""
    return captures.select(
        *KEYS, F.posexplode(to_lines(F.col("full_text"))).alias("line_no", "text")
    )


def latest(side: str, *columns: str) -> Column:
    """captured_at, full_text and `columns` of the newest capture of a side, as an aggregate with partial
    results. Order and payload are one struct, so each text crosses the exchange once."""
    return F.max(F.when(F.col("side") == side, F.struct("captured_at", "full_text", *columns)))


def pair_sides(captures: DataFrame) -> DataFrame:
    """Front and back of a submission side by side, with flags for missing ones.

    A retaken side replaces the older take. The pairing is one aggregation, not a join:
    every map task first shrinks its captures to two per submission, so a submission
    that holds a large share of all captures never gathers in one task.
    """
    text = lambda side: latest(side)["full_text"]
    return (
        captures.groupBy("submission_id")
        .agg(text("front").alias("front_text"), text("back").alias("back_text"))
        .withColumn("has_front", F.col("front_text").isNotNull())
        .withColumn("has_back", F.col("back_text").isNotNull())
    )


def combine_sides(pairs: DataFrame) -> DataFrame:
    """Front text, then back text, as one."""
    front, back = (nz(strip(F.col(c))) for c in ("front_text", "back_text"))
    return pairs.withColumn("combined_text", F.concat_ws("\n", front, back))


def split_dead_letters(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable captures, error rows). A capture without key, of an unknown kind or side, with a
    side that does not fit its kind, or without text is an error row with a reason; the batch goes
    on without it. Every capture is in exactly one of the two."""
    known = lambda c, *values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    fits = ((F.col("kind") == "passport") & (F.col("side") == "page")) | (
        (F.col("kind") == "id") & (F.col("side") != "page")
    )
    reason = (
        F.when(F.col("submission_id").isNull(), "no submission id")
        .when(~known("kind", "id", "passport"), "unknown kind")
        .when(~known("side", "front", "back", "page"), "unknown side")
        .when(~fits, "side does not fit kind")
        .when(F.col("full_text").isNull(), "no text")
    )
    flagged = captures.withColumn("error", reason)
    good = flagged.filter(F.col("error").isNull()).drop("error", CORRUPT)
    broken = F.col(CORRUPT) if CORRUPT in captures.columns else F.lit(None).cast("string")
    bad = flagged.filter(F.col("error").isNotNull()).select(
        "submission_id", "kind", "side", "captured_at", "error", F.lit(False).alias("is_valid"),
        broken.alias("raw"),
    )
    return good, bad
