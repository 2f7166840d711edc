"""Structured Streaming jobs over arriving captures."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docfields.operators.captures import split_dead_letters
from docfields.plans.records import capture_check, card_records, passport_records
from docfields.plans.report import facts, measures, with_rates
from docfields.sources.tables import shared_folder


def _timed(captures: DataFrame) -> DataFrame:
    """Watermarks need a zoned timestamp; the capture time is read in the session zone."""
    return captures.withColumn("captured_at", F.col("captured_at").cast("timestamp"))


def capture_gate(captures: DataFrame) -> DataFrame:
    """Zone check of every arriving photo; stateless, so it scales like a batch."""
    return capture_check(captures)


def pair_sides(captures: DataFrame, wait: str = "10 minutes", columns: tuple[str, ...] = ()) -> DataFrame:
    """Front and back of a submission taken less than `wait` apart, or either one alone.

    Of the takes of a side in a window of `wait` the newest counts, which keeps a burst of retakes from meeting another burst take
    by take. What is left is joined by a full outer join with a time bound, so a take stays in the state until the watermark has
    passed its window and the bound, however many takes follow it. Every take that counts comes out at least once;
    `newest_pairs` of the output is what the batch pairing gives. `columns` of the captures travel with their take
    (front_x, back_x). State lies in RocksDB if the query is started by the functions of this module.
    """
    takes = captures.withColumn("taken", F.col("captured_at").cast("timestamp_ntz"))
    takes = _timed(takes).withWatermark("captured_at", wait)

    def side(name: str) -> DataFrame:
        newest = takes.filter(F.col("side") == name).groupBy(F.window("captured_at", wait), "submission_id").agg(
            F.max(F.struct("taken", "full_text", *columns)).alias("take")
        )
        return newest.select(
            F.col("submission_id").alias(f"{name}_id"),
            F.window_time("window").alias(f"{name}_time"),
            F.col("take.taken").alias(f"{name}_at"),
            F.col("take.full_text").alias(f"{name}_text"),
            *[F.col(f"take.{c}").alias(f"{name}_{c}") for c in columns],
        )

    same = F.expr(
        f"front_id = back_id AND back_time BETWEEN front_time - INTERVAL {wait} - INTERVAL {wait} AND front_time + INTERVAL {wait} + INTERVAL {wait} "
        f"AND back_at > front_at - INTERVAL {wait} AND back_at < front_at + INTERVAL {wait}"
    )
    paired = side("front").join(side("back"), same, "full").drop("front_time", "back_time")
    return paired.withColumns({f"{name}_at": F.col(f"{name}_at").cast("timestamp") for name in ("front", "back")})


def newest_pairs(pairs: DataFrame) -> DataFrame:
    """The newest take of each side per submission, from all that `pair_sides` gave: one row per submission, as in the batch pairing."""
    names = [c.removeprefix("front_") for c in pairs.columns if c.startswith("front_") and c not in ("front_id", "front_at", "front_text")]

    def newest(side: str) -> Column:
        take = F.struct(f"{side}_at", f"{side}_text", f"{side}_id", *[f"{side}_{c}" for c in names])
        return F.max(F.when(F.col(f"{side}_id").isNotNull(), take)).alias(side)

    sides = pairs.groupBy(F.coalesce("front_id", "back_id").alias("submission_id")).agg(newest("front"), newest("back"))
    return sides.select(*[F.col(f"{side}.{side}_{c}") for side in ("front", "back") for c in ("id", "at", "text", *names)])


def hourly_rates(captures: DataFrame, late: str = "1 hour") -> DataFrame:
    """Captures and captures with a zone per hour and side, each hour once, when the watermark has passed it. Rows that arrive
    later are left out; `late_rows` counts them."""
    checked = capture_check(_timed(captures)).withWatermark("captured_at", late)
    return checked.groupBy(F.window("captured_at", "1 hour").alias("hour"), "side").agg(
        F.count(F.lit(1)).alias("captures"), F.count_if("has_mrz").alias("with_zone")
    )


def hourly_report(records: DataFrame, late: str = "1 hour") -> DataFrame:
    """All measures of the quality report per hour and kind of finished records, each hour once, when the watermark has passed it and
    its state is dropped. Records that arrive later are left out; `late_rows` counts them."""
    timed = facts(_timed(records)).withWatermark("captured_at", late)
    return with_rates(timed.groupBy(F.window("captured_at", "1 hour").alias("hour"), "kind").agg(*measures()))


def arrivals(rows: DataFrame, *keys: str) -> DataFrame:
    """All rows that have arrived, on time or not, per hour and `keys`, and the newest of them: to be run in update mode. Its state is
    one row per hour and key."""
    at = F.col("captured_at").cast("timestamp")
    return rows.groupBy(F.date_trunc("hour", at).alias("hour"), *keys).agg(F.count(F.lit(1)).alias("arrived"), F.max(at).alias("newest"))


def late_rows(arrived: DataFrame, report: DataFrame, count: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """hour, keys, arrived, on_time, late of the closed hours, from the tables of `arrivals` and of an hourly report with the same `late`.

    An hour is closed once the watermark, `late` before the newest row, has passed its end; what then isn't in the report came behind the
    watermark.
    """
    reported = report.select(F.col("hour.start").alias("hour"), *keys, F.col(count).alias("on_time"))
    newest = arrived.agg(F.max("newest").alias("seen"))  # one row
    closed = arrived.join(F.broadcast(newest), F.expr(f"hour + INTERVAL 1 HOUR <= seen - INTERVAL {late}"))
    on_time = F.coalesce("on_time", F.lit(0).cast("long"))
    both = closed.join(reported, ["hour", *keys], "left")
    return both.select("hour", *keys, "arrived", on_time.alias("on_time"), (F.col("arrived") - on_time).alias("late"))


def first_submissions(captures: DataFrame, within: str = "1 hour") -> DataFrame:
    """Each submission and side once, however often the request is repeated."""
    return _timed(captures).withWatermark("captured_at", within).dropDuplicatesWithinWatermark(
        ["submission_id", "side"]
    )


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries that are started inside keep their state in RocksDB: on disk, with changes alone written to the checkpoint."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over what has arrived, into the table `out`; started again it goes on where it ended.

    In append mode rows are added. In update mode each batch's changed rows are written under its number, and a batch that is run again
    replaces its own; `newest_rows` reads the last state. In complete mode every batch replaces the table.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    elif mode == "update":
        writer = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch_id={n}"))
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    with rocksdb_state(stream.sparkSession):
        return writer.start()


def newest_rows(table: DataFrame, *keys: str) -> DataFrame:
    """The last state of each key in a table that was written in update mode."""
    payload = [c for c in table.columns if c not in (*keys, "batch_id")]
    newest = table.groupBy(*keys).agg(F.max_by(F.struct(*payload), "batch_id").alias("r"))
    return newest.select(*keys, "r.*")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what has arrived and read its output back as a table.

    Output and progress live in the shared folder, so a lost executor or driver resumes.
    In complete mode every batch replaces the table.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    start(stream, f"{base}/out", f"{base}/progress", mode).awaitTermination()
    schema = stream.schema.add("batch_id", "long") if mode == "update" else stream.schema
    return spark.read.schema(schema).parquet(f"{base}/out")


class Upsert:
    """The running queries of `upsert_records`, by name: id, passport, dead_letters."""

    def __init__(self, queries: dict[str, StreamingQuery]) -> None:
        self.queries = queries

    def awaitTermination(self) -> None:
        for query in self.queries.values():
            query.awaitTermination()


def upsert_records(stream: DataFrame, path: str, checkpoint: str, kinds: tuple[str, ...] = ("id", "passport")) -> Upsert:
    """Checked records of arriving captures, per micro-batch.

    The record job itself runs on the stream: photos are read where they arrive, and the pairing is a streaming aggregation whose state
    is the newest take of each side (its text and what was found by word boxes; of a passport the newest record). A batch looks
    up and writes the submissions it touches and reads nothing else, however long the history is, and sides may arrive
    any time apart. A batch that is run again replaces its own output. Readers take the newest record per submission with
    `newest_records`; `compact_records` merges the batches. Each of `kinds` is a query of its own. Unusable captures go to `dead_letters`.
    """
    good, bad = split_dead_letters(stream.withColumn("captured_at", F.col("captured_at").cast("timestamp_ntz")))
    build = {"id": card_records, "passport": passport_records}
    jobs = {kind: start(build[kind](good), f"{path}/records/{kind}", f"{checkpoint}/{kind}", "update") for kind in kinds}
    return Upsert(jobs | {"dead_letters": start(bad, f"{path}/dead_letters", f"{checkpoint}/dead_letters")})


def newest_records(spark, path: str, kind: str = "id") -> DataFrame:
    """Newest record per submission of an upserted table."""
    return newest_rows(spark.read.parquet(f"{path}/records/{kind}"), "submission_id")


def compact_records(spark, path: str, target: str, kind: str = "id") -> None:
    """The newest records as one table of their own, to be put in the place of the batches so far."""
    newest_records(spark, path, kind).write.mode("overwrite").parquet(target)
