"""Lookups against dictionary tables: equal to the column forms, no nested loops, hot keys dealt out."""

import random

import pytest
from pyspark.sql import functions as F

from docfields.functions import values as V
from docfields.functions.match import known_place
from docfields.functions.text import citizenship_code
from docfields.operators import dictionaries as OD
from docfields.operators import lookups


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame([(p,) for p in V.PLACES], "entry string")


def spoiled(rng):
    """Official places with up to two edits, and other values."""
    letters = "აბგდევიმნრ"
    for place in V.PLACES:
        for _ in range(4):
            w = list(place)
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(w) + 1)
                rng.choice([lambda: w.insert(i, rng.choice(letters)), lambda: w.pop(min(i, len(w) - 1)), lambda: w.__setitem__(min(i, len(w) - 1), rng.choice(letters))])()
            yield "".join(w)
    yield from ("", None, "ა", "x" * 3000, "თბილის", "თბილისი", "თბილისი")


def test_near_equals_the_column_form(spark, places):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(spoiled(random.Random(1)))], "id int, value string")
    want = {r.id: r.place for r in lookups.lookup_fuzzy(rows, "value").collect()}
    got = {r.id: r.near for r in OD.lookup_near(rows, "value", places).collect()}
    assert got == want and sum(v is not None for v in got.values()) > 100


def test_near_without_entries(spark, places):
    rows = spark.createDataFrame([(1, "თბილისი")], "id int, value string")
    assert OD.lookup_near(rows, "value", places.limit(0)).head().near is None


def test_phrases_equal_the_column_form(spark, places):
    rng = random.Random(2)
    parts = [*V.PLACES, "ამერიკის", "შეერთებული", "შტატები", "სახლი", "x", "12"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "  ", "-", "", ", ", "\n"]) for _ in range(rng.randint(0, 5))) for _ in range(400)]
    texts += [None, "", "ამერიკის შეერთებული შტატები", "ამერიკის  შეერთებული შტატები", "ამერიკის შეერთებული შტატებიც თბილისი", "თბილისი " * 20_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = {r.id: r.place for r in rows.select("id", known_place(F.col("text")).alias("place")).collect()}
    got = {r.id: r.phrase for r in OD.lookup_phrases(rows, "id", "text", places).collect()}
    assert got == want and sum(v is not None for v in got.values()) > 100


def test_contained_equals_the_column_form(spark):
    aliases = spark.createDataFrame([(i, a, c) for i, (a, c) in enumerate(V.CITIZENSHIP_ALIASES)], "ord int, alias string, code string")
    rng = random.Random(3)
    case = [str.lower, str.upper, str.title, lambda s: s]
    texts = [rng.choice(["", "x ", "of"]) + "".join(rng.choice(case)(a) + rng.choice(["", " ", "y"]) for a, _ in rng.sample(V.CITIZENSHIP_ALIASES, rng.randint(1, 3))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = {r.id: r.code for r in rows.select("id", citizenship_code(F.col("text")).alias("code")).collect()}
    got = {r.id: r.code for r in OD.lookup_contained(rows, "id", "text", aliases, "alias", "code", "ord").collect()}
    assert got == want
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, "nothing of it")], "id int, text string")
    assert {r.code for r in OD.lookup_contained(odd, "id", "text", aliases, "alias", "code", "ord").collect()} == {None}
    assert OD.lookup_contained(odd, "id", "text", aliases.limit(0), "alias", "code", "ord").filter("code IS NOT NULL").count() == 0


def test_large_dictionaries_need_no_nested_loop(spark):
    """100,000 entries and more: every lookup is an equi-join."""
    entries = spark.range(200_000).select(F.concat(F.lit("w"), F.conv(F.col("id").cast("string"), 10, 26)).alias("entry"), F.col("id").alias("rank"))
    entries = entries.withColumn("entry", F.translate("entry", "0123456789", "QRSTUVXYZW"))
    texts = spark.range(50).select("id", F.concat_ws(" ", F.lit("the"), F.translate(F.concat(F.lit("w"), F.conv((F.col("id") * 3999).cast("string"), 10, 26)), "0123456789", "QRSTUVXYZW"), F.lit("end")).alias("text"))
    phrases = OD.lookup_phrases(texts, "id", "text", entries, letters="A-Za-z")
    contained = OD.lookup_contained(texts, "id", "text", entries, "entry", "rank", "rank")
    near = OD.lookup_near(texts.withColumn("value", F.split("text", " ")[1]), "value", entries)
    for df in (phrases, contained, near):
        assert "NestedLoop" not in plan_of(df) and "Cartesian" not in plan_of(df)
    assert {r.phrase == r.text.split(" ")[1] for r in phrases.collect()} == {True}
    assert all(r.near is not None for r in near.collect() if len(r.value) >= 5)


def test_hot_key_is_dealt_out(spark):
    """A third of the rows carries one key; both ways of joining agree, and no task holds the key alone."""
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id"))).alias("key"))
    names = spark.range(20_000).select(F.col("id").alias("key"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    small, large = OD.lookup(rows, "key", names), OD.lookup(rows, "key", names, most=100)
    order = lambda df: sorted(map(repr, df.select("id", "key", "name").collect()))
    assert order(small) == order(large)
    assert OD.heavy_keys(rows, "key", 4) == [5]
    assert "BroadcastHashJoin" in plan_of(small) and "__salt" in plan_of(large)
    spread = large.filter("key = 5").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 1 and max(r["count"] for r in spread) < 5000
    want = {r.id for r in OD.known(rows, "key", names).collect()}
    assert {r.id for r in OD.known(rows, "key", names, most=100).collect()} == want


@pytest.mark.parametrize("most", [0, 100])
def test_contained_sends_only_listed_pieces_of_a_small_dictionary(spark, monkeypatch, most):
    """Results are those of a plain search whether the dictionary is small or not; of a long text only pieces that an alias is listed under are joined."""
    monkeypatch.setattr(OD, "BROADCAST_ROWS", most)
    checked, taken = OD.checked, []
    monkeypatch.setattr(OD, "checked", lambda d: checked(d, most))
    whole = OD._pieces
    monkeypatch.setattr(OD, "_pieces", lambda *a: taken.append(whole(*a)) or taken[-1])
    rng = random.Random(12)
    named = ["a", "Zz", "e\U0001d4b3", "სახლი", "STRASSE", "q w", "\x00b", "needle", None, ""]
    aliases = spark.createDataFrame([(9 - i, a, None if a == "Zz" else f"v{i}") for i, a in enumerate(named)], "r int, alias string, v string")
    texts = ["".join(rng.choice("bcdfghij \U0001d4b3ლხ\x00") for _ in range(rng.randint(0, 900))) + rng.choice(["", *filter(None, named)]) for _ in range(60)]
    rows = spark.createDataFrame([*enumerate(texts), (98, None), (99, "Straße x zZ")], "id int, text string")
    got = {r.id: r.v for r in OD.lookup_contained(rows, "id", "text", aliases, "alias", "v", "r").collect()}
    for i, t in [*enumerate(texts), (98, ""), (99, "Straße x zZ")]:
        found = [(9 - n, None if a == "Zz" else f"v{n}") for n, a in enumerate(named) if a and (a.lower() in t.lower() or a.upper() in t.upper())]
        assert got[i] == (min(found)[1] if found else None)
    assert len(got) == 62 and (taken[0].count() < 400) == (most > 0)
