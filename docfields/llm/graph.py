"""Connected components of links between ids, without a hub in one task or anything but counts on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import stored


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """id, component (smallest reachable id) of every id in `links` (a, b).

    Every round hooks heads onto their smallest neighbouring head and follows hooks to their ends. Links whose ends share a head are
    dropped, so the work shrinks. Minima are partial sums, so a hub with a
    third of all links is summed up where its links lie.
    """
    edges = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)
    head = stored(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("head", F.col("id")), label)
    while True:
        # links between heads
        heads = (
            edges.join(head.select(F.col("id").alias("a"), F.col("head").alias("ha")), "a")
            .join(head.select(F.col("id").alias("b"), F.col("head").alias("hb")), "b")
            .filter("ha <> hb").select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b")).distinct()
        )
        edges = stored(heads, label)
        if edges.isEmpty():
            return head.select("id", F.col("head").alias("component"))
        # each head hooks onto its smallest neighbour; hooks run downhill, so following them ends
        hook = edges.groupBy(F.col("b").alias("h")).agg(F.min("a").alias("to"))
        while True:  # until every hook ends at a head that has none itself; each pass halves the way
            nxt = hook.select(F.col("h").alias("to"), F.col("to").alias("far"))
            hook = stored(hook.join(nxt, "to", "left").select("h", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")), label)
            if hook.filter("moved").isEmpty():
                break
            hook = hook.drop("moved")
        head = stored(
            head.join(hook, F.col("head") == F.col("h"), "left").select("id", F.coalesce("to", "head").alias("head")), label
        )
