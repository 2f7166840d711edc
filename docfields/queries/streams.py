"""Streaming jobs over the event table: each event is an arriving photo."""

import uuid

from pyspark.sql import functions as F

from docfields.functions.geometry import PAGES
from docfields.plans.records import card_findings, records_of_pairs
from docfields.queries.base import query
from docfields.sources.tables import shared_folder
from docfields.streaming import jobs

C = F.col

# even events are fronts, odd ones backs of the same submission
_EVENTS = (
    "SELECT event_id // 2 AS submission_id, CASE WHEN event_id % 2 = 0 THEN 'front' ELSE 'back' END AS side, "
    "ts, event_id FROM events"
)


def arriving(spark, sf_dir):
    """Events as a stream of captures."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return _captures(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def _captures(events):
    eid = C("event_id")
    card = F.concat(F.lpad((eid % 100).cast("string"), 2, "0"), F.lit("AB12345"))
    row1 = F.concat(F.lit("IDGEO"), card, F.lit("701234567890<<<<"))
    return events.select(
        F.floor(eid / 2).alias("submission_id"),
        F.lit("id").alias("kind"),
        F.when(eid % 2 == 0, "front").otherwise("back").alias("side"),
        C("ts").cast("timestamp_ntz").alias("captured_at"),
        F.when(eid % 2 == 0, "IDENTITY CARD").otherwise(row1).alias("full_text"),
    )


@query(
    "capture_gate_stream",
    f"SELECT submission_id, side, side = 'back' AS has_mrz, false AS has_td3, CASE WHEN side = 'back' THEN 'IDGEO' || "
    "lpad(cast(event_id % 100 AS string), 2, '0') || 'AB12345701234567890<<<<' ELSE '' END AS mrz_strip "
    f"FROM ({_EVENTS}) AS e",
)
def capture_gate_stream(spark, sf_dir):
    checked = jobs.capture_gate(arriving(spark, sf_dir))
    return jobs.run_to_table(checked.select("submission_id", "side", "has_mrz", "has_td3", "mrz_strip"))


@query(
    "pair_sides_stream",
    f"WITH e AS ({_EVENTS}), f AS (SELECT * FROM e WHERE side = 'front'), b AS (SELECT * FROM e WHERE side = 'back') "
    "SELECT f.submission_id AS front_id, b.submission_id AS back_id FROM f FULL JOIN b ON f.submission_id = b.submission_id "
    "AND abs(epoch_us(b.ts) - epoch_us(f.ts)) < 600000000",
)
def pair_sides_stream(spark, sf_dir):
    """Pairs, single fronts and single backs. A last capture long after the others lets every session end."""
    events = arriving(spark, sf_dir)
    closing = F.array(F.lit(False), F.when(C("submission_id") == 0, F.lit(True)))
    closed = events.withColumn("closing", F.explode(F.array_compact(closing)))
    closed = closed.withColumns(
        {
            "submission_id": F.when(C("closing"), -1).otherwise(C("submission_id")),
            "captured_at": C("captured_at") + F.when(C("closing"), F.expr("INTERVAL '36500' DAY")).otherwise(F.expr("INTERVAL '0' DAY")),
        }
    )
    paired = jobs.run_to_table(jobs.pair_sides(closed.drop("closing")))
    return paired.select("front_id", "back_id").filter("coalesce(front_id, back_id) >= 0")


def in_steps(spark, frames, run):
    """`run(folder, base)` after each frame has arrived in the folder, as a job that is started again and again."""
    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    for frame in frames:
        frame.write.mode("append").parquet(f"{base}/in")
        run(f"{base}/in", base)
    return base


def _closing(rows, **columns):
    """One row far in the future, of a submission of its own, that lets all before it end."""
    one = rows.sparkSession.range(1).select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
    return one


@query(
    "capture_rates_stream",
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, side, count(*) AS arrived, count(*) FILTER (WHERE submission_id % 10 <> 9) AS captures, "
    "count(*) FILTER (WHERE side = 'back' AND submission_id % 10 <> 9) AS with_zone, count(*) FILTER (WHERE submission_id % 10 = 9) AS late "
    f"FROM ({_EVENTS}) AS e GROUP BY 1, 2",
)
def capture_rates_stream(spark, sf_dir):
    """Hours are reported once; a tenth of the captures arrives after that and is counted as late."""
    captures = _captures(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts"))
    last = _closing(captures, submission_id=F.lit(-1), side=F.lit("front"), captured_at=F.lit("2200-01-01 00:00:00"), full_text=F.lit(""))
    is_late = C("submission_id") % 10 == 9

    def run(folder, base):
        stream = spark.readStream.schema(captures.schema).parquet(folder)
        jobs.start(jobs.hourly_rates(stream), f"{base}/report", f"{base}/report-progress").awaitTermination()
        jobs.start(jobs.arrivals(stream, "side"), f"{base}/arrived", f"{base}/arrived-progress", "update").awaitTermination()

    base = in_steps(spark, [captures.filter(~is_late), last, captures.filter(is_late)], run)
    report = spark.read.parquet(f"{base}/report")
    # hours of which nothing came in time are in no report, but their late rows are counted
    arrived = jobs.newest_rows(spark.read.parquet(f"{base}/arrived"), "hour", "side")
    late = jobs.late_rows(arrived, report, "captures", "side")
    both = late.join(report.withColumn("hour", C("hour.start")), ["hour", "side"], "left")
    none = F.lit(0).cast("long")
    return both.select(
        F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "side", "arrived", C("on_time").alias("captures"),
        F.coalesce("with_zone", none).alias("with_zone"), "late",
    )


@query(
    "quality_report_stream",
    f"WITH e AS ({_EVENTS}), f AS (SELECT * FROM e WHERE side = 'front'), b AS (SELECT * FROM e WHERE side = 'back'), "
    "r AS (SELECT coalesce(f.submission_id, b.submission_id) % 10 = 9 AS is_late, b.ts IS NOT NULL AS has_back, "
    "strftime(date_trunc('hour', greatest(coalesce(f.ts, b.ts), coalesce(b.ts, f.ts))), '%Y-%m-%d %H') AS hour "
    "FROM f FULL JOIN b ON f.submission_id = b.submission_id AND abs(epoch_us(b.ts) - epoch_us(f.ts)) < 600000000), "
    "h AS (SELECT hour, 'id' AS kind, count(*) AS arrived, count(*) FILTER (WHERE NOT is_late) AS records, count(*) FILTER (WHERE is_late) AS late, "
    "count(*) FILTER (WHERE NOT is_late AND NOT has_back) AS weak_zone, count(*) FILTER (WHERE NOT is_late AND has_back) AS is_valid "
    "FROM r GROUP BY hour) SELECT hour, kind, arrived, late, records, records AS no_issue_date, weak_zone, 0::BIGINT AS unread_zone, is_valid, weak_zone AS mismatches, "
    "CASE WHEN records > 0 THEN is_valid / records END AS valid_share FROM h",
)
def quality_report_stream(spark, sf_dir):
    """Captures are paired on one stream, the pairs become records on a second one, which is reported by hour; a tenth
    of the pairs arrives after its hour was reported."""
    captures = _captures(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts"))
    last = _closing(captures, submission_id=F.lit(-1), kind=F.lit("id"), side=F.lit("front"), captured_at=F.lit("2200-01-01 00:00:00"), full_text=F.lit(""))
    photos = captures.unionByName(last)
    for column, kind in (("page_w", "int"), ("page_h", "int"), ("pages", PAGES)):
        photos = photos.withColumn(column, F.lit(None).cast(kind))
    folder = in_steps(spark, [photos], lambda *_: None) + "/in"
    findings = card_findings(spark.readStream.schema(photos.schema).parquet(folder))
    pairs = jobs.run_to_table(jobs.pair_sides(findings, columns=("rotation", "layout_id", "box_dates"))).filter("coalesce(front_id, back_id) >= 0")
    last = _closing(pairs, front_id=F.lit(-1), front_at=F.lit("2200-01-01 00:00:00"), front_text=F.lit(""))
    is_late = F.coalesce("front_id", "back_id") % 10 == 9

    def run(folder, base):
        records = records_of_pairs(spark.readStream.schema(pairs.schema).parquet(folder))
        jobs.start(jobs.hourly_report(records), f"{base}/report", f"{base}/report-progress").awaitTermination()
        # arrivals need no record, only its time and kind
        times = spark.readStream.schema(pairs.schema).parquet(folder).select(F.greatest("front_at", "back_at").alias("captured_at"), F.lit("id").alias("kind"))
        jobs.start(jobs.arrivals(times, "kind"), f"{base}/arrived", f"{base}/arrived-progress", "update").awaitTermination()

    base = in_steps(spark, [pairs.filter(~is_late), last, pairs.filter(is_late)], run)
    report = spark.read.parquet(f"{base}/report")
    arrived = jobs.newest_rows(spark.read.parquet(f"{base}/arrived"), "hour", "kind")
    late = jobs.late_rows(arrived, report, "records", "kind")
    both = late.join(report.withColumn("hour", C("hour.start")), ["hour", "kind"], "left")
    counts = ["no_issue_date", "weak_zone", "unread_zone", "is_valid", "mismatches"]
    return both.select(
        F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "kind", "arrived", "late", C("on_time").alias("records"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], "valid_share",
    )


@query(
    "records_upsert",
    "SELECT submission_id, max(CASE WHEN side = 'back' THEN lpad(cast(event_id % 100 AS string), 2, '0') || 'AB12345' ELSE '' END) AS card_number, "
    "max(CASE WHEN side = 'back' THEN '01234567890' ELSE '' END) AS personal_id, 'GEO' AS citizenship, bool_or(side = 'back') AS is_valid "
    f"FROM ({_EVENTS}) AS e GROUP BY submission_id",
)
def records_upsert(spark, sf_dir):
    """Arriving captures, each twice, become checked records; fronts and backs arrive in runs of their own."""
    captures = arriving(spark, sf_dir)
    for column, kind in (("page_w", "int"), ("page_h", "int"), ("pages", PAGES)):
        captures = captures.withColumn(column, F.lit(None).cast(kind))
    once = jobs.run_to_table(jobs.first_submissions(captures.unionByName(captures)))

    def run(folder, base):
        jobs.upsert_records(spark.readStream.schema(once.schema).parquet(folder), f"{base}/out", f"{base}/progress", ("id",)).awaitTermination()

    base = in_steps(spark, [once.filter("side = 'front'"), once.filter("side = 'back'")], run)
    return jobs.newest_records(spark, f"{base}/out").select("submission_id", "card_number", "personal_id", "citizenship", "is_valid")
