"""Whole jobs: skew, order, missing sides, sources, streams, registered queries."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from docfields.functions.geometry import PAGES
from docfields.operators import captures as OC
from docfields.operators import tables as OT
from docfields.plans.records import card_records, passport_records
from docfields.queries import ORACLES, QUERIES
from docfields.sources import samples
from docfields.sources.schemas import CAPTURES
from docfields.sources.tables import _committed, commit_results, compact_results, read_captures, read_results
from docfields.streaming import jobs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([plain(v) for v in r] for r in df.select(*columns).collect()), key=repr)
    assert got
    if name in ORACLES:
        res = duck.execute(ORACLES[name])
        order = [[d[0] for d in res.description].index(c) for c in columns]
        want = sorted(([plain(r[i]) for i in order] for r in res.fetchall()), key=repr)
        assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def same_rows(a, b):
    key = lambda df: sorted(repr(r) for r in df.collect())
    return key(a) == key(b)


def test_hot_submission(spark):
    """One submission with a third of all captures; the newest take of each side counts."""
    base = samples.card_captures(spark, SF).filter("submission_id BETWEEN 1 AND 20")
    retakes = spark.range(400).select(
        F.lit(7).cast("bigint").alias("submission_id"),
        F.lit("id").alias("kind"),
        F.when(F.col("id") % 2 == 0, "front").otherwise("back").alias("side"),
        F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int), 0)").alias("captured_at"),
        F.concat(F.lit("blurred "), F.col("id").cast("string")).alias("full_text"),
    )
    hot = base.unionByName(retakes, allowMissingColumns=True).repartition(7)
    assert same_rows(
        OC.pair_sides(hot).orderBy("submission_id"), OC.pair_sides(base).orderBy("submission_id")
    )


def test_hot_document_in_tables(spark):
    """A document with most of the lines: neighbours are found by unique keys."""
    lines = spark.range(3000).select(
        F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("submission_id"),
        F.lit("front").alias("side"),
        F.when(F.col("id") < 2000, F.col("id")).otherwise(0).cast("int").alias("line_no"),
        F.when(F.col("id") % 500 == 0, "SEX").otherwise(F.concat(F.lit("v"), F.col("id").cast("string"))).alias("text"),
    )
    best = OT.titled_values(lines, ["gender"]).collect()
    assert [(r.submission_id, r.value) for r in best] == [(0, "v1")]
    anchors = lines.filter("text = 'SEX' AND submission_id = 0").select("submission_id", "side", "line_no")
    windows = {r.line_no: r.window for r in OT.window_text(anchors, lines, 1, 2).collect()}
    assert windows == {n: f"v{n + 1}\nv{n + 2}" for n in (0, 500, 1000, 1500)}


def test_stop_far_below_its_title(spark):
    """Titles, values and stops at random in documents of very different length, one with most of the lines: a scan ends at the next
    stop, however many blocks away."""
    import random

    rng = random.Random(5)
    texts = {(d, n): rng.choices(["title", "stop", f"v{n}", "x"], (2, 1, 2, 400))[0] for d, size in ((0, 6000), (1, 40), (2, 1), (3, 900)) for n in range(size)}
    texts |= {(4, 0): "title", (4, 500): "stop v", (4, 501): "v9", (5, 3): "title", (5, 4_000_000): "v7", (6, 1): "v1", (6, 2): "title"}
    lines = spark.createDataFrame([(d, "front", n, t) for (d, n), t in texts.items()], "submission_id long, side string, line_no int, text string")
    want = {}
    for (d, n), t in texts.items():
        if t == "title":
            after = sorted((m, u) for (e, m), u in texts.items() if e == d and m > n and u[0] in "vs")
            if after and after[0][1][0] == "v":
                want[d, n] = after[0][1]
    value = F.when(F.col("near").rlike("v"), F.col("near"))
    titles = lines.filter("text = 'title'")
    for block in (1024, 7):
        got = OT.first_before_stop(titles, lines, value, "^stop", block)
        assert {(r.submission_id, r.line_no): r.value for r in got.collect()} == want
    assert len(want) > 10 and (4, 0) not in want and want[5, 3] == "v7"


@pytest.fixture(scope="module")
def card_job(spark):
    """One card job over: submissions 0-11 in random order and partitions, 104 = the back of
    4 alone, 900 without any text."""
    base = samples.card_captures(spark, SF)
    some = base.filter("submission_id < 12").orderBy(F.rand(7)).repartition(5)
    back = base.filter("submission_id = 4 AND side = 'back'").withColumn("submission_id", F.lit(104).cast("bigint"))
    blank = spark.createDataFrame(
        [(900, "id", "front", None, "  ", None, None, None), (900, "id", "back", None, None, None, None, None)], CAPTURES
    )
    return card_records(some.unionByName(back).unionByName(blank))


@pytest.fixture(scope="module")
def cards(card_job):
    return {r.submission_id: r for r in card_job.collect()}


def test_order_and_partitions_do_not_matter(spark, cards):
    for t in samples.truth(spark, SF).filter("k < 12").collect():
        r = cards[t.k]
        got = (r.first_name, r.birth_place, r.issue_date, r.personal_id, r.card_number, r.is_valid)
        assert got == (t.given_geo, t.place, t.issue_date, t.personal_id, t.card_number, t.has_zone)


def test_missing_side(spark, cards):
    record, truth = cards[104], samples.truth(spark, SF).filter("k = 4").head()
    assert (record.personal_id, record.birth_date) == (truth.personal_id, truth.birth_date)
    assert record.first_name == truth.given_geo  # recovered from the dictionary


def test_empty_text(cards):
    assert cards[900].citizenship == "GEO" and cards[900].personal_id == "" and not cards[900].is_valid


def test_filter_on_finished_records(card_job, cards):
    invalid = card_job.filter("NOT is_valid").select("submission_id")
    plan = invalid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("is_valid") < plan.index("Generate")  # the filter stays above
    assert {k for k, r in cards.items() if not r.is_valid} == {0, 900}


def test_word_boxes_never_cross_the_pairing_exchange(card_job):
    plan = card_job._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    exchanges = [l for l in plan.splitlines() if "hashpartitioning(submission_id" in l]
    assert len(exchanges) == 1


def test_unfilled_citizenship_mode(spark):
    page = samples.passport_captures(spark, SF).filter("submission_id = 4")
    printed = passport_records(page, as_printed=True).head()
    assert printed.verification.mismatches == ["citizenship"]


def test_broken_json_becomes_a_dead_letter(spark, tmp_path):
    path = tmp_path / "captures"
    os.makedirs(path)
    (path / "a.json").write_text(
        '{"submission_id": 1, "kind": "id", "side": "back", "full_text": "x", "pages": [{"width": 5, "height": 6, "blocks": []}]}\n'
        '{"submission_id": oops\n'
    )
    good, bad = OC.split_dead_letters(read_captures(spark, str(path), "json"))
    assert [r.submission_id for r in good.collect()] == [1]
    assert [r.error for r in bad.collect()] == ["no submission id"]


def test_results_are_committed_once(spark, tmp_path):
    """A job run twice, one killed before its commit, two attempts at once, an empty job, a merged table: each record once."""
    path = str(tmp_path / "results")
    rows = lambda a, b: spark.range(a, b).select("id", F.when(F.col("id") % 2 == 0, "id").otherwise("passport").alias("kind"), F.struct(F.col("id").alias("n")).alias("nested"))
    ids = lambda: sorted(r.id for r in read_results(spark, path).collect())
    with pytest.raises(ValueError):
        read_results(spark, path)
    first = commit_results(rows(0, 10), path, "monday")
    assert commit_results(rows(0, 10), path, "monday") == first and ids() == list(range(10))
    rows(90, 99).write.partitionBy("kind").parquet(f"{path}/staged/attempt=killed")
    commit_results(rows(10, 20), path, "tuesday")
    commit_results(rows(0, 0), path, "nothing")
    assert ids() == list(range(20)) and read_results(spark, path).columns == ["id", "kind", "nested"]
    # a second attempt that did not see the first one's commit
    rows(10, 20).write.partitionBy("kind").parquet(f"{path}/staged/attempt=late")
    late = spark.createDataFrame([("tuesday", "late", [], "{}")], "job string, attempt string, replaces array<string>, columns string")
    late.withColumn("committed_at", F.current_timestamp()).write.mode("append").parquet(f"{path}/manifest")
    assert ids() == list(range(20))
    compact_results(spark, path, "week 1")
    assert ids() == list(range(20)) and len([r for r in _committed(spark, path)]) == 1
    commit_results(rows(20, 25), path, "wednesday")
    assert ids() == list(range(25))


def test_narrow_check_has_no_exchange(spark):
    from docfields.plans.records import capture_check

    captures = spark.read.schema(CAPTURES).parquet(_stored(spark))
    plan = capture_check(captures)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "pages" not in plan.split("ReadSchema")[1]


def _stored(spark):
    from docfields.queries.tables import _stored as store

    return store(spark, samples.card_captures(spark, SF).limit(5), "plan")


def test_front_without_back_leaves_the_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "submission_id bigint, kind string, side string, captured_at timestamp_ntz, full_text string"
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    first = [(1, "id", "front", at(0), "f1"), (1, "id", "back", at(4), "b1"), (2, "id", "front", at(5), "f2")]
    late = [(9, "id", "front", at(600), "f9"), (9, "id", "back", at(601), "b9")]
    frame = lambda rows: spark.createDataFrame(rows, schema.replace("timestamp_ntz", "string")).withColumn(
        "captured_at", F.col("captured_at").cast("timestamp_ntz")
    )
    frame(first).coalesce(1).write.mode("append").parquet(src)
    frame(late).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = jobs.run_to_table(jobs.pair_sides(stream)).collect()
    rows = {(r.front_id, r.back_id) for r in out}
    assert (1, 1) in rows and (2, None) in rows


def test_stream_equals_batch(spark):
    from docfields.plans.records import capture_check

    path = _stored(spark)
    columns = ["submission_id", "side", "has_mrz", "has_td3", "mrz_strip"]
    stream = jobs.capture_gate(spark.readStream.schema(CAPTURES).parquet(path)).select(*columns)
    batch = capture_check(spark.read.schema(CAPTURES).parquet(path)).select(*columns)
    assert same_rows(jobs.run_to_table(stream), batch)


def test_records_of_a_stream_equal_the_batch(spark, tmp_path):
    """Sides of a submission in different batches, a retake, an unusable capture: the same records as from all captures at once."""
    from docfields.plans.records import RECORD_FIELDS

    captures = samples.card_captures(spark, SF).filter("submission_id < 6")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ("side = 'front'", "side = 'back' AND submission_id % 2 = 0", "side = 'back' AND submission_id % 2 = 1"):
        captures.filter(part).coalesce(1).write.mode("append").parquet(src)
    odd = captures.filter("submission_id = 1 AND side = 'front'").withColumn("kind", F.lit("visa"))
    odd.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(CAPTURES).option("maxFilesPerTrigger", 2).parquet(src)
    jobs.upsert_records(stream, out, str(tmp_path / "progress")).awaitTermination()
    fields = ["submission_id", *RECORD_FIELDS, "is_valid", "verification.mismatches"]
    newest = jobs.newest_records(spark, out)
    assert same_rows(newest.select(*fields).orderBy("submission_id"), card_records(captures).select(*fields).orderBy("submission_id"))
    assert [r.error for r in spark.read.parquet(f"{out}/dead_letters").collect()] == ["unknown kind"]
    jobs.compact_records(spark, out, str(tmp_path / "compact"))
    assert spark.read.parquet(str(tmp_path / "compact")).count() == newest.count()


def test_record_of_sides_a_week_apart(spark, tmp_path):
    """The back arrives a week after the front, and a retake of it another month later: the record stays whole."""
    from docfields.plans.records import RECORD_FIELDS

    captures = samples.card_captures(spark, SF).filter("submission_id < 4")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    late = lambda days: F.col("captured_at") + F.expr(f"INTERVAL {days} DAYS")
    parts = [captures.filter("side = 'front'")]
    parts += [captures.filter("side = 'back'").withColumn("captured_at", late(days)) for days in (7, 40)]
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(CAPTURES).parquet(src)
        jobs.upsert_records(stream, out, str(tmp_path / "progress"), ("id",)).awaitTermination()
    fields = ["submission_id", *RECORD_FIELDS, "is_valid", "verification.mismatches"]
    want = card_records(spark.read.schema(CAPTURES).parquet(src))
    assert same_rows(jobs.newest_records(spark, out).select(*fields).orderBy("submission_id"), want.select(*fields).orderBy("submission_id"))


def test_batch_reads_only_what_arrives(spark, tmp_path):
    """A history of 60 submissions; then one of them is retaken: one row is read and one submission looked up and written."""
    shots = lambda ids, day: spark.createDataFrame(
        [(i, "id", side, f"2024-01-{day:02d} 00:00:00", f"{side} {i} {day}") for i in ids for side in ("front", "back")],
        "submission_id long, kind string, side string, captured_at string, full_text string",
    ).withColumn("captured_at", F.col("captured_at").cast("timestamp_ntz"))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    whole = lambda df: df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("page_w", "int"), ("page_h", "int"), ("pages", PAGES))])

    def run(captures):
        whole(captures).write.mode("append").parquet(src)
        job = jobs.upsert_records(spark.readStream.schema(CAPTURES).parquet(src), out, str(tmp_path / "progress"), ("id",))
        job.awaitTermination()
        return [p for p in job.queries["id"].recentProgress if p["numInputRows"]]

    run(shots(range(60), 1))
    (batch,) = run(shots([7], 20).filter("side = 'front'"))
    state = batch["stateOperators"][0]
    assert (batch["numInputRows"], state["numRowsUpdated"], state["numRowsTotal"]) == (1, 1, 60)
    files = os.listdir(f"{out}/records/id")
    assert spark.read.parquet(f"{out}/records/id/{max(files)}").count() == 1 and not os.path.exists(f"{out}/captures")
    newest = {r.submission_id: r for r in jobs.newest_records(spark, out).collect()}
    assert len(newest) == 60 and str(newest[7].captured_at).startswith("2024-01-20")


def test_chain_of_retakes_leaves_the_state(spark, tmp_path):
    """10,000 takes of one submission, nine minutes apart: none waits for the chain to end; the newest pair is that of the batch pairing."""
    chain = spark.range(10_000).select(
        F.lit(1).cast("long").alias("submission_id"), F.when(F.col("id") % 2 == 0, "front").otherwise("back").alias("side"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(9 * id as int))").alias("captured_at"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("full_text"), "id",
    )
    burst = spark.range(600).select(
        F.lit(2).cast("long").alias("submission_id"), F.when(F.col("id") % 2 == 0, "front").otherwise("back").alias("side"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("captured_at"),
        F.concat(F.lit("b"), F.col("id").cast("string")).alias("full_text"), F.lit(0).cast("long").alias("id"),
    )
    src = str(tmp_path / "in")
    takes = chain.unionByName(burst)
    for part in range(3):
        takes.filter(F.floor(F.col("id") / 3334) == part).drop("id").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(takes.drop("id").schema).option("maxFilesPerTrigger", 1).parquet(src)
    query = jobs.start(jobs.pair_sides(stream), str(tmp_path / "out"), str(tmp_path / "progress"))
    query.awaitTermination()
    held = {o["operatorName"]: o["numRowsTotal"] for o in query.recentProgress[-1]["stateOperators"]}
    assert sum(held.values()) < 20
    pairs = spark.read.parquet(str(tmp_path / "out"))
    # the burst is one take a side; each take of the chain meets its two neighbours at most
    assert pairs.filter("coalesce(front_id, back_id) = 2").count() == 1 and 9_900 < pairs.count() < 20_000
    # once a later capture closes the chain, the newest takes are those of the batch pairing
    late = [(9, "front", "2030-01-01 00:00:00", "x"), (9, "back", "2031-01-01 00:00:00", "y")]
    closing = spark.createDataFrame(late, "submission_id long, side string, captured_at string, full_text string")
    closing.withColumn("captured_at", F.col("captured_at").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(src)
    jobs.start(jobs.pair_sides(stream), str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    got = jobs.newest_pairs(spark.read.parquet(str(tmp_path / "out"))).filter("coalesce(front_id, back_id) < 9")
    want = OC.pair_sides(takes).select("submission_id", "front_text", "back_text")
    assert same_rows(got.select(F.col("front_id").alias("submission_id"), "front_text", "back_text").orderBy("submission_id"), want.orderBy("submission_id"))


def test_hours_leave_the_state(spark, tmp_path):
    """Each hour is written once and forgotten; what comes behind the watermark is counted by hour: on time and late are all that arrived."""
    src = str(tmp_path / "in")
    shots = spark.range(400).select(
        "id", F.lit("back").alias("side"), F.lit("id").alias("kind"), F.col("id").alias("submission_id"), F.lit("IDGE0AB").alias("full_text"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(id / 10 as int))").alias("captured_at"),
    )
    parts = [shots.filter("id < 100"), shots.filter("id >= 100"), shots.filter("id % 50 = 0")]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(shots.schema).parquet(src)
        report = jobs.start(jobs.hourly_rates(stream), str(tmp_path / "report"), str(tmp_path / "p1"))
        report.awaitTermination()
        jobs.start(jobs.arrivals(stream, "side"), str(tmp_path / "arrived"), str(tmp_path / "p2"), "update").awaitTermination()
    # 40 hours have arrived; those within the watermark's delay of the newest row are still open
    assert report.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 2
    arrived = jobs.newest_rows(spark.read.parquet(str(tmp_path / "arrived")), "hour", "side")
    late = jobs.late_rows(arrived, spark.read.parquet(str(tmp_path / "report")), "captures", "side").collect()
    assert len(late) == 38 and sum(r.late for r in late) == 8 and all(r.on_time + r.late == r.arrived for r in late)


def test_photo_without_tree_has_a_portrait(spark):
    from docfields.operators.regions import portrait_regions

    rows = [(1, "id", "front", None, "x", 1200, 1600, None), (2, "id", "front", None, "x", 30, 1600, None), (3, "passport", "page", None, "x", 0, None, None)]
    faces = spark.createDataFrame([(1, 0, 100, 400, 300, 650)], "submission_id bigint, face_id int, x0 int, y0 int, x1 int, y1 int")
    got = portrait_regions(spark.createDataFrame(rows, CAPTURES), faces).collect()
    assert [r.submission_id for r in got] == [1]
    assert got[0].x0 <= 100 and got[0].x1 >= 300


def test_shared_folder_is_never_local_on_a_cluster():
    from types import SimpleNamespace

    from docfields.sources.tables import shared_folder

    conf = SimpleNamespace(get=lambda *a: None, set=lambda *a: None)
    session = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
    assert shared_folder(session("local[4]"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_folder(session(master))
