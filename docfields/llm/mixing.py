"""Mixing sources to target weights by weighted sampling without replacement (exponential keys).

Every source gets a token target: a share of the budget by weight, at most `most` times its size, the excess reshared
by weight (water filling). A target of e times the size and a rest is met by e complete epochs of the source, then by
a fractional pass: documents in the order of their exponential key -ln(u) / quality, taken while the running
sum of sizes stays within the rest. u comes from a hash of doc_id and seed, so reruns agree.

The running sum needs no task that holds a source: keys fall into cells that are equal slices of the unit interval, sizes are
summed by (source, cell), the cell in which the rest runs out is found on these sums, and only the documents of
that one cell are sorted. The number of cells grows with the documents, so a cell stays small. Only ids, sizes
and keys move, no text.

Sources are ordered by code point, null last, as one source of its own. Null or empty texts have size 0 and are taken
once per complete epoch with 0 words. Rows with equal doc_id are rows of their own; ties of the key go to the smaller doc_id,
then the smaller size. Quality null, zero or below counts as the least quality. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfields.llm.common import stored, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST, SEED = 1.5, 2.0, "mix"
#: Documents of a source in one cell of the key, about.
CELL_ROWS = 20_000


def word_count(col: str) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null: 0."""
    return F.coalesce(F.expr(rf"regexp_count({col}, '[^\\x20\\x09-\\x0D]+')"), F.lit(0)).cast("long")


def text_quality(col: str) -> Column:
    """Document quality in (0, 1]: the share of words that end like words of prose, by length of text without marks."""
    plain = F.length(F.regexp_replace(F.col(col), r"[^\p{L}\s.,]", ""))
    return F.coalesce(F.greatest(plain / F.nullif(F.length(col), F.lit(0)), F.lit(0.05)), F.lit(0.05))


def uniform(doc_id: str, seed: str) -> Column:
    """A number in (0, 1) from the first 52 bits of a digest of seed and id."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target of each source. One row per source goes in: the windows see sums, not documents."""
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    cap = F.col("source_size") * most
    listed = sizes.withColumn("rank", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    )
    # sources that reach their cap first stand first; the level is the one at which the rest takes what they leave
    by_need = Window.orderBy(cap / F.col("weight"), "rank")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_need.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (
        listed.withColumn("budget", F.sum("source_size").over(everything) * share)
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("open", cap >= F.col("level") * F.col("weight"))
        .withColumn("level", F.first(F.when(F.col("open"), F.col("level")), True).over(by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    return level.select("source", "source_size", F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap)).alias("target"))


def mix(docs: DataFrame, quality: Column | None = None, weights=WEIGHTS, share=SHARE, most=MOST, seed=SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (how often the mix takes the document)."""
    sized = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"),
            (quality if quality is not None else text_quality("text")).cast("double").alias("quality"),
        ).withColumn("u", uniform("doc_id", seed))
        .withColumn("key", -F.log("u") / F.greatest(F.coalesce("quality", F.lit(0.0)), F.lit(1e-6))),
        "mix",
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = targets(per_source.select("source", "source_size"), weights, share, most)
    goal = (
        goal.join(per_source.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("cells", F.greatest(F.lit(1), F.ceil(F.col("n") / CELL_ROWS)))
    )
    goal = stored(goal.withColumnRenamed("source", "of"), "mix-goal")
    # exp(-key) falls as the key grows; its slices are cells of roughly even content, first cell = smallest keys
    placed = sized.join(goal, F.col("source").eqNullSafe(F.col("of"))).withColumn(
        "cell", F.least(F.floor((1 - F.exp(-F.col("key"))) * F.col("cells")), F.col("cells") - 1)
    )
    sums = placed.groupBy("of", "cell", "rest").agg(F.sum("size").alias("in_cell"))
    so_far = Window.partitionBy("of").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        sums.withColumn("before", F.coalesce(F.sum("in_cell").over(so_far), F.lit(0)))
        .filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("in_cell") > F.col("rest")))
        .groupBy("of").agg(F.max(F.struct("cell", "before")).alias("edge"))
        .select(F.col("of").alias("edge_of"), F.col("edge.cell").alias("edge_cell"), F.col("edge.before").alias("before"))
    )
    known = placed.join(edge, F.col("of").eqNullSafe(F.col("edge_of")), "left")
    cols = ["doc_id", "source", "size", "source_size", "target", "epochs"]
    # without an edge the rest holds the whole source (only where it has no words)
    whole = known.filter(F.col("edge_cell").isNull() | (F.col("cell") != F.col("edge_cell"))).select(
        *cols, F.coalesce(F.col("cell") < F.col("edge_cell"), F.lit(False)).cast("long").alias("more")
    )
    upto = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    split = known.filter(F.col("cell") == F.col("edge_cell")).withColumn(
        "start", F.col("before") + F.coalesce(F.sum("size").over(upto), F.lit(0))
    )
    # the document at the border is taken when that leaves the sum nearer to the target
    split = split.select(*cols, (F.col("start") + F.col("size") / 2.0 <= F.col("rest")).cast("long").alias("more"))
    return whole.unionByName(split).withColumn("copies", F.col("epochs") + F.col("more")).drop("more", "epochs")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, with the columns of `docs`. Rows that share id, source and size count
    as one choice: each is repeated as the first of them."""
    picked = (
        mix(docs, **how).filter("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies"))
        .withColumnsRenamed({"doc_id": "__id", "source": "__source", "size": "__size"})
    )
    same = (
        F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & F.col("source").cast("string").eqNullSafe(F.col("__source"))
        & (word_count("text") == F.col("__size"))
    )
    return docs.join(picked, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


#: The same mix in DuckDB.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (CAST('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u,
    coalesce(greatest(length(regexp_replace(text, '[^\p{L}\s.,]', '', 'g')) / nullif(length(text), 0)::DOUBLE, 0.05), 0.05) AS quality
  FROM documents),
keyed AS (SELECT *, -ln(u) / greatest(coalesce(quality, 0.0), 1e-6) AS key FROM sized),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS rank FROM per),
weighed AS (SELECT *, [5.0, 2.0, 1.0][(rank - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
level AS (SELECT level FROM levels WHERE cap >= level * weight ORDER BY cap / weight, rank LIMIT 1),
goals AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM level) * weight, cap))::DOUBLE AS target FROM levels),
goal AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM goals),
ordered AS (
  SELECT k.doc_id, k.size, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM keyed k JOIN goal g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN size > 0 AND start + size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ordered
"""
