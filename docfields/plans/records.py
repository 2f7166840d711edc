"""Whole-document jobs: card records, passport records, capture check.

Extraction inside one photo is narrow. The only exchange is the pairing of card sides,
and what crosses it is the text plus a few finished values; the word boxes, by far the
largest part of the input, are read where they lie and never shuffled.
"""

from __future__ import annotations

from functools import cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions import fields as D
from docfields.functions import mrz as M
from docfields.functions import values as V
from docfields.functions.dates import find_dates, typed_date
from docfields.functions.geometry import (
    card_issue_dates, layout_personal_id, passport_issue_dates,
)
from docfields.functions.lines import (
    label_array, study_lines, texts, to_lines, value_after_label,
)
from docfields.functions.match import fix_both_names, repair_place
from docfields.functions.text import (
    citizenship_code, clean_place_latin, first, first_lazy, fix_card_number, georgian_only,
    is_name_junk, is_place_junk, let, nz, split_pair, strip,
)
from docfields.operators.captures import latest, read_words
from docfields.operators.regions import portrait_regions
from docfields.operators.verify import ENTRY, card_verification, passport_verification, printed_against_zone

RECORD_FIELDS = [
    "first_name", "first_name_lat", "last_name", "last_name_lat", "birth_date", "birth_place",
    "birth_place_lat", "citizenship", "gender", "personal_id", "expiry_date", "card_number",
    "issue_date", "mrz_strip",
]
MRZ_FIELDS = [
    "personal_id", "card_number", "birth_date", "expiry_date", "gender", "first_name",
    "last_name", "citizenship",
]


class Steps:
    """The projections of a job, recorded once and applied to any input.

    Building some thousand expressions costs seconds in the driver, whatever the input. They only name columns, so
    later jobs and micro-batches of the same process use the recorded ones again.
    """

    def __init__(self) -> None:
        self.taken: list[tuple[str, tuple]] = []

    def _take(self, method: str, *args) -> Steps:
        self.taken.append((method, args))
        return self

    def withColumn(self, *args) -> Steps:
        return self._take("withColumn", *args)

    def withColumns(self, *args) -> Steps:
        return self._take("withColumns", *args)

    def select(self, *args) -> Steps:
        return self._take("select", *args)

    def apply(self, df: DataFrame) -> DataFrame:
        for method, args in self.taken:
            df = getattr(df, method)(*args)
        return df


def _col(name: str) -> Column:
    return F.col(name)


def _mrz(name: str) -> Column:
    return F.col("mrz")[name]


def _shape(df: Steps, kind: str, check: Column, rotations: list[str], prefix: Column) -> Steps:
    """Final columns: '' for what was not found, zone fields and check nested.

    The record leaves through `inline`, which filters on its columns do not pass. Without
    that stop a filter such as `is_valid` would be pushed through every step above and
    each step's expressions would be copied into the next one's.
    """
    checked = df.withColumn("verification", check)
    blank = lambda c: F.coalesce(c, F.lit(""))
    turns = [F.coalesce(F.col(c), F.lit(0)).alias(c.removesuffix("_rotation")) for c in rotations]
    record = F.struct(
        F.lit(kind).alias("kind"),
        "captured_at",
        *[blank(F.col(c)).alias(c) for c in RECORD_FIELDS],
        "citizenship_source",
        "visual_vs_mrz",
        F.struct(*[blank(_mrz(c)).alias(c) for c in MRZ_FIELDS]).alias("mrz_fields"),
        "verification",
        (F.col("verification.status") == "Checked").alias("is_valid"),
        F.struct(*turns).alias("orientation"),
        # calendar twins of the printed dates, NULL for days that don't exist
        F.struct(*[typed_date(F.col(c)).alias(c) for c in ("birth_date", "expiry_date", "issue_date")]).alias("dates"),
        # whether the photo shows how a zone begins, read or not
        prefix.alias("prefix_seen"),
    )
    return checked.select("submission_id", F.inline(F.array(record)))


def _place_columns(df: Steps, lines: str, junk) -> Steps:
    """birth_place and birth_place_lat from `raw_place` and the lines of a side."""
    usable = df.withColumn(
        "place_geo", let(georgian_only(F.col("raw_place")), lambda g: F.when(~junk(g), g))
    )
    latin = usable.withColumn(
        "place_lat", D.bound(D.birth_place_latin, F.col(lines), F.col("place_geo"))
    )
    pair = latin.withColumn(
        "place",
        let(
            F.struct(F.col("place_geo").alias("g"), F.col("place_lat").alias("l")),
            lambda v: split_pair(repair_place(v["g"], v["l"]), v["l"]),
        ),
    )
    return pair.withColumns(
        {
            "birth_place": F.col("place.geo"),
            "birth_place_lat": clean_place_latin(F.col("place.geo"), F.col("place.lat")),
        }
    )


# ---------------------------------------------------------------- cards
def card_findings(captures: DataFrame) -> DataFrame:
    """What the pairing needs of each card photo: its text, rotation and what was found by word boxes. Narrow."""
    cards = captures.filter((F.col("kind") == "id") & F.col("side").isin("front", "back"))
    return read_words(cards).select(
        "submission_id",
        "side",
        "captured_at",
        "full_text",
        "rotation",
        F.when(F.col("side") == "front", layout_personal_id(F.col("words"))).alias("layout_id"),
        F.when(F.col("side") == "back", card_issue_dates(F.col("words"))).alias("box_dates"),
    )


def card_sides(captures: DataFrame) -> DataFrame:
    """One row per card submission: newest text, rotation and box findings of each side."""
    sides = card_findings(captures).groupBy("submission_id").agg(
        latest("front", "rotation", "layout_id").alias("front"),
        latest("back", "rotation", "box_dates").alias("back"),
        F.max("captured_at").alias("captured_at"),
    )
    return _side_texts(sides)


def _side_texts(sides: DataFrame) -> DataFrame:
    text = lambda side: F.coalesce(strip(F.col(f"{side}.full_text")), F.lit(""))
    return sides.select(
        "submission_id",
        "captured_at",
        text("front").alias("front_text"),
        text("back").alias("back_text"),
        F.concat_ws("\n", nz(text("front")), nz(text("back"))).alias("all_text"),
        F.col("front.rotation").alias("front_rotation"),
        F.col("back.rotation").alias("back_rotation"),
        F.col("front.layout_id").alias("layout_id"),
        F.col("back.box_dates").alias("box_dates"),
    )


def _visual(field: str) -> Column:
    return F.get(F.col("visual"), F.lit(D.VISUAL_FIELDS.index(field)))


def _with_names(df: Steps, names: Column) -> Steps:
    """first_name, last_name and their Latin forms from struct(first, last)."""
    paired = df.withColumn("chosen", names).withColumn(
        "pairs",
        F.transform(
            F.array(
                F.struct(F.col("chosen.first").alias("g"), _mrz("first_name").alias("l")),
                F.struct(F.col("chosen.last").alias("g"), _mrz("last_name").alias("l")),
            ),
            lambda v: split_pair(v["g"], v["l"]),
        ),
    )
    return paired.withColumns(
        {
            f"{name}_name{suffix}": F.get(F.col("pairs"), F.lit(i))[part]
            for i, name in enumerate(("first", "last"))
            for suffix, part in (("", "geo"), ("_lat", "lat"))
        }
    )


def card_records(captures: DataFrame, compare_printed: bool = False) -> DataFrame:
    """One checked record per card submission.

    `compare_printed` also searches the printed values that the zone has given already and reports in
    `visual_vs_mrz` whether they agree; without it that column is NULL and the search is spared.
    """
    return _card_steps(SparkContext._gateway, compare_printed).apply(card_sides(captures))


def records_of_pairs(pairs: DataFrame) -> DataFrame:
    """One checked record per row of `streaming.jobs.pair_sides` over card findings. Narrow, so it runs on a stream as it stands."""
    sides = pairs.select(
        F.coalesce("front_id", "back_id").alias("submission_id"),
        F.greatest("front_at", "back_at").alias("captured_at"),
        F.struct(F.col("front_text").alias("full_text"), F.col("front_rotation").alias("rotation"), F.col("front_layout_id").alias("layout_id")).alias("front"),
        F.struct(F.col("back_text").alias("full_text"), F.col("back_rotation").alias("rotation"), F.col("back_box_dates").alias("box_dates")).alias("back"),
    )
    return _card_steps(SparkContext._gateway, False).apply(_side_texts(sides))


@cache
def _card_steps(_, compare_printed: bool) -> Steps:
    """From both sides of a card to its record; built once for a gateway to the JVM."""
    front, back, both = F.col("front_lines"), F.col("back_lines"), F.col("all_lines")
    front_text, back_text, all_text = F.col("front_text"), F.col("back_text"), F.col("all_text")

    counted = Steps().withColumns(
        {"front_raw": to_lines(front_text), "back_raw": to_lines(back_text)}
    )
    sized = counted.withColumns(
        {
            "all_lines": study_lines(F.concat("front_raw", "back_raw")),
            "n_front": F.size("front_raw"),
        }
    )
    lined = sized.withColumns(
        {
            "front_lines": F.slice(both, F.lit(1), F.col("n_front")),
            "back_lines": F.slice(both, F.col("n_front") + 1, F.size(both)),
        }
    )
    # numbers of the zone come from the back only, never mixed with front text
    zone = lined.withColumns(
        {
            "ids": M.td1_ids(F.col("back_raw")),
            "zone": M.td1_zone(F.array(F.col("back_raw"), F.concat("front_raw", "back_raw"))),
        }
    ).withColumn(
        "mrz",
        F.struct(
            F.col("ids.personal_id").alias("personal_id"),
            nz(fix_card_number(F.col("ids.card_number"))).alias("card_number"),
            *[
                F.col(f"zone.{c}").alias(c)
                for c in ("birth_date", "expiry_date", "gender", "first_name", "last_name", "citizenship")
            ],
        ),
    )
    hints = (_mrz("first_name"), _mrz("last_name"))
    searched = zone.withColumn(
        "visual",
        D.visual_values(
            both,
            {} if compare_printed else {c: _mrz(c) for c in ("birth_date", "expiry_date", "gender", "citizenship")},
        ),
    )
    read = {
        "birth_date": D.visual_date(_visual("birth_date")),
        "expiry_date": D.visual_date(_visual("expiry_date")),
        "gender": _visual("gender"),
        "citizenship": _visual("citizenship"),
    }
    report = printed_against_zone(read.get, _mrz)
    searched = searched.withColumn(
        "visual_vs_mrz", report if compare_printed else F.lit(None).cast(f"array<{ENTRY}>")
    )
    number_sides = F.array(
        F.struct(front.alias("lines"), front_text.alias("text")),
        F.struct(back.alias("lines"), back_text.alias("text")),
    )
    printed = searched.withColumns(
        {
            "birth_date": F.coalesce(
                _mrz("birth_date"), D.visual_birth_date(_visual("birth_date"), all_text)
            ),
            "expiry_date": F.coalesce(
                _mrz("expiry_date"), D.visual_expiry_date(_visual("expiry_date"), all_text)
            ),
            "gender": F.coalesce(_mrz("gender"), D.visual_gender(_visual("gender"), all_text)),
            "citizenship": F.coalesce(
                citizenship_code(F.coalesce(_mrz("citizenship"), _visual("citizenship"))),
                F.lit("GEO"),
            ),
            # a country that was read can be told from one that was filled in
            "citizenship_source": F.when(_mrz("citizenship").isNotNull(), "zone")
            .when(_visual("citizenship").isNotNull(), "printed")
            .otherwise("default"),
            "card_number": nz(
                fix_card_number(
                    F.coalesce(
                        F.when(F.length(_mrz("card_number")) == 9, _mrz("card_number")),
                        first_lazy(
                            number_sides, lambda s: D.card_number_near_label(s["lines"], s["text"])
                        ),
                    )
                )
            ),
            "personal_id": F.coalesce(
                _mrz("personal_id"),
                F.col("layout_id"),
                D.personal_id_near_label(front, front_text),
            ),
            # the front alone first; both sides only for a name it leaves open
            "names": F.aggregate(
                F.array(front, both),
                F.lit(None).cast("struct<first:string,last:string>"),
                lambda acc, lines: F.when(
                    acc["first"].isNotNull() & acc["last"].isNotNull(), acc
                ).otherwise(
                    let(
                        D.card_names(lines, *hints),
                        lambda n: F.struct(
                            F.coalesce(acc["first"], n["first"]).alias("first"),
                            F.coalesce(acc["last"], n["last"]).alias("last"),
                        ),
                    )
                ),
            ),
            "raw_place": F.coalesce(
                D.birth_place(back),
                let(_visual("birth_place"), lambda g: F.when(~is_place_junk(g), g)),
            ),
        }
    )
    named = _with_names(
        printed, fix_both_names(F.col("names.first"), F.col("names.last"), *hints)
    )
    placed = _place_columns(named, "back_lines", is_place_junk)
    dated = placed.withColumn(
        "used", D.known_dates(F.col("birth_date"), F.col("expiry_date"))
    ).withColumn(
        "issue_date",
        F.coalesce(
            D.bound(D.card_issue_date, back, back_text, F.col("box_dates"), F.col("used")),
            first(find_dates(D.visual_date(_visual("issue_date")))),
        ),
    )
    final = dated.withColumn(
        "mrz_strip",
        F.array_join(M.rewrite_strip(F.col("zone.rows"), F.col("card_number")), "\n"),
    )
    return _shape(final, "id", card_verification(_col, _mrz), ["front_rotation", "back_rotation"], F.upper(back_text).rlike("IDGE|TRGE"))


# ---------------------------------------------------------------- passports
def passport_records(captures: DataFrame, as_printed: bool = False) -> DataFrame:
    """One checked record per passport submission; its newest page counts.

    A passport is a single photo, so each page is read completely where it lies and only
    finished records are exchanged.

    `as_printed` compares the citizenship as the printed record leaves it (not filled).
    """
    pages = captures.filter((F.col("kind") == "passport") & (F.col("side") == "page"))
    return _newest(_passport_steps(SparkContext._gateway, as_printed).apply(read_words(pages)))


@cache
def _passport_steps(_, as_printed: bool) -> Steps:
    """From a page with its words to its record; built once for a gateway to the JVM."""
    lines, text = F.col("lines"), F.col("text")
    lined = Steps().select(
        "submission_id",
        "captured_at",
        F.coalesce(strip(F.col("full_text")), F.lit("")).alias("text"),
        F.col("rotation").alias("passport_rotation"),
        "words",
        study_lines(to_lines(F.col("full_text"))).alias("lines"),
    )
    rows = lined.withColumn("zone_rows", M.td3_strip(texts(lines)))
    zone = rows.withColumn("zone", M.td3_fields(texts(lines), F.col("zone_rows"))).withColumn(
        "mrz",
        F.struct(
            F.lit(None).cast("string").alias("personal_id"),
            nz(M.fix_passport_number(F.col("zone.card_number"))).alias("card_number"),
            *[
                F.col(f"zone.{c}").alias(c)
                for c in ("birth_date", "expiry_date", "gender", "first_name", "last_name", "citizenship")
            ],
        ),
    )
    hints = (_mrz("first_name"), _mrz("last_name"))
    searched = zone.withColumn(
        "visual",
        D.visual_values(
            lines,
            {
                **{c: _mrz(c) for c in ("birth_date", "expiry_date", "gender")},
                "citizenship": F.lit("GEO"),
                "issue_date": F.lit(""),
            },
        ),
    )
    searched = searched.withColumn("visual_vs_mrz", F.lit(None).cast(f"array<{ENTRY}>"))
    titled_number = value_after_label(lines, label_array(V.PASSPORT_NUMBER_LABELS))
    printed = searched.withColumns(
        {
            "birth_date": F.coalesce(
                _mrz("birth_date"), D.visual_birth_date(_visual("birth_date"), text)
            ),
            "expiry_date": F.coalesce(
                _mrz("expiry_date"), D.visual_expiry_date(_visual("expiry_date"), text)
            ),
            "gender": F.coalesce(_mrz("gender"), D.visual_gender(_visual("gender"), text)),
            "citizenship": F.lit("GEO"),
            "citizenship_source": F.lit("default"),
            "card_number": nz(
                M.fix_passport_number(
                    F.coalesce(
                        F.when(F.length(_mrz("card_number")) >= 8, _mrz("card_number")),
                        titled_number,
                        D.card_number_near_label(lines, text),
                    )
                )
            ),
            "personal_id": F.coalesce(
                layout_personal_id(F.col("words")), D.personal_id_near_label(lines, text)
            ),
            "names": D.passport_names(lines, *hints),
            "raw_place": F.coalesce(
                let(D.birth_place(lines), lambda g: F.when(~is_name_junk(g), g)),
                _visual("birth_place"),
            ),
        }
    )
    split = _with_names(printed, F.col("names"))
    named = split.withColumn(
        "fixed",
        let(
            F.transform(
                F.array("first_name", "last_name"), lambda g: F.when(~is_name_junk(g), g)
            ),
            lambda a: fix_both_names(F.get(a, F.lit(0)), F.get(a, F.lit(1)), *hints),
        ),
    ).withColumns(
        {
            # a dropped field title is not replaced by the dictionary name
            "first_name": F.when(~is_name_junk(F.col("first_name")), F.col("fixed.first")),
            "last_name": F.col("fixed.last"),
            "first_name_lat": F.coalesce(F.col("first_name_lat"), hints[0]),
            "last_name_lat": F.coalesce(F.col("last_name_lat"), hints[1]),
        }
    )
    placed = _place_columns(named, "lines", lambda g: is_place_junk(g) | is_name_junk(g))
    dated = placed.withColumn(
        "used", D.known_dates(F.col("birth_date"), F.col("expiry_date"))
    ).withColumns(
        {
            "issue_date": D.passport_issue_date(
                lines, text, passport_issue_dates(F.col("words")), F.col("used")
            ),
            "mrz_strip": F.array_join(F.col("zone_rows"), "\n"),
        }
    )
    return _shape(
        dated, "passport", passport_verification(_col, _mrz, as_printed), ["passport_rotation"], F.lit(False)
    )


def _newest(records: DataFrame) -> DataFrame:
    """One record per submission: that of the newest capture. Map tasks keep one record
    per submission before the exchange, so retakes of one submission do not pile up."""
    # a map cannot be ordered, so captures of the same instant are told apart by text
    order = F.struct("captured_at", "mrz_strip", "card_number", "personal_id", "issue_date")
    columns = [c for c in records.columns if c != "submission_id"]
    kept = records.groupBy("submission_id").agg(F.max_by(F.struct(*columns), order).alias("r"))
    return kept.select("submission_id", "r.*")


def with_portraits(records: DataFrame, captures: DataFrame, faces: DataFrame) -> DataFrame:
    """Records with the box of the printed photo as `portrait`, NULL where there is none."""
    boxes = portrait_regions(captures, faces).select(
        "submission_id", "kind", F.struct("x0", "y0", "x1", "y1").alias("portrait")
    )
    return records.join(boxes, ["submission_id", "kind"], "left")


# ---------------------------------------------------------------- capture check
def capture_check(captures: DataFrame) -> DataFrame:
    """Which zone a photo shows. Narrow, so it runs on a stream as it stands."""
    lined = captures.withColumn("lines", to_lines(F.col("full_text")))
    rows = lined.withColumns(
        {
            "card_rows": M.td1_strip(F.col("lines")),
            "card_ids": M.td1_ids(F.col("lines")),
            "passport_rows": M.td3_strip(F.col("lines")),
        }
    )
    td3 = M.usable_td3(F.col("passport_rows"))
    joined = lambda c: F.coalesce(F.array_join(c, "\n"), F.lit(""))
    return rows.select(
        "submission_id",
        "kind",
        "side",
        "captured_at",
        (F.col("card_rows").isNotNull() | F.col("card_ids").isNotNull()).alias("has_mrz"),
        td3.alias("has_td3"),
        joined(F.col("card_rows")).alias("mrz_strip"),
        F.when(td3, joined(F.col("passport_rows"))).otherwise("").alias("passport_mrz_strip"),
    )
