"""Field-by-field comparison of a record with its machine-readable zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions import values as V
from docfields.functions.text import (
    citizenship_code, compare_key, format_bilingual, gender_letter, latin_side, let, nz,
)

ENTRY = "struct<field:string,ok:boolean,expected:string,actual:string>"


def _entry(field: str, present: Column, ok: Column, expected: Column, actual: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.when(
        present,
        F.struct(
            F.lit(field).alias("field"),
            F.coalesce(ok, F.lit(False)).alias("ok"),
            blank(expected).alias("expected"),
            blank(actual).alias("actual"),
        ),
    )


def check_entries(data, mrz, kind: str, as_printed: bool = False) -> Column:
    """Array of struct(field, ok, expected, actual), in report order.

    data / mrz: name -> Column. A field is compared only when the zone has it.
    kind: "id" or "passport". The citizenship of a passport record is always GEO; with
    `as_printed` it is compared as not filled in, so it never passes.
    """

    def date(field: str) -> Column:
        same = compare_key(data(field)) == compare_key(mrz(field))
        return _entry(field, mrz(field).isNotNull(), same, mrz(field), data(field))

    def name(field: str) -> Column:
        both = format_bilingual(data(field), data(field + "_lat"))

        def compare(v: Column) -> Column:
            e = F.replace(mrz(field), F.lit(" "), F.lit(""))
            a = F.replace(v["latin"], F.lit(" "), F.lit(""))
            fits = (a == e) | e.startswith(a) | a.startswith(e)
            has_latin = nz(a).isNotNull()
            return F.coalesce(
                _entry(field, has_latin, fits, mrz(field), v["latin"]),
                _entry(field, v["both"].isNotNull(), F.lit(True), mrz(field), v["both"]),
            )

        pair = let(both, lambda b: F.struct(b.alias("both"), latin_side(b).alias("latin")))
        return F.when(mrz(field).isNotNull(), let(pair, compare))

    entries = []
    if kind == "id":
        digits = F.regexp_replace(data("personal_id"), "[^0-9]", "")
        entries.append(
            _entry(
                "personal_id", mrz("personal_id").isNotNull(), digits == mrz("personal_id"),
                mrz("personal_id"), digits,
            )
        )
    number = F.regexp_replace(F.upper(data("card_number")), "[^A-Z0-9]", "")
    entries.append(
        _entry(
            "card_number", mrz("card_number").isNotNull(), number == mrz("card_number"),
            mrz("card_number"), number,
        )
    )
    entries += [date("birth_date"), date("expiry_date")]
    entries.append(
        _entry(
            "gender", mrz("gender").isNotNull(),
            gender_letter(data("gender")) == gender_letter(mrz("gender")),
            mrz("gender"), data("gender"),
        )
    )
    entries += [name("first_name"), name("last_name")]
    if kind == "id":
        expected = F.left(F.regexp_replace(F.upper(mrz("citizenship")), "[^A-Z]", ""), F.lit(3))
        entries.append(
            _entry(
                "citizenship", mrz("citizenship").isNotNull(),
                citizenship_code(data("citizenship")) == expected, expected, data("citizenship"),
            )
        )
    else:
        actual = F.lit(None).cast("string") if as_printed else data("citizenship")
        entries.append(
            _entry(
                "citizenship", mrz("citizenship").isNotNull(),
                actual.rlike("(?i)GEO|საქართველო"), F.lit("GEO"), actual,
            )
        )
    return F.array_compact(F.array(*entries))


def printed_against_zone(printed, mrz) -> Column:
    """Array of struct(field, ok, expected, actual): what is printed on a card against its zone, for fields read in both.

    printed / mrz: name -> Column. The record itself takes the zone's value where there is one, so only values read
    before that tell whether the card agrees with itself.
    """

    def entry(field: str, same: Column) -> Column:
        return _entry(field, printed(field).isNotNull() & mrz(field).isNotNull(), same, mrz(field), printed(field))

    code = lambda c: F.left(F.regexp_replace(F.upper(c), "[^A-Z]", ""), F.lit(3))
    return F.array_compact(
        F.array(
            entry("birth_date", compare_key(printed("birth_date")) == compare_key(mrz("birth_date"))),
            entry("expiry_date", compare_key(printed("expiry_date")) == compare_key(mrz("expiry_date"))),
            entry("gender", gender_letter(printed("gender")) == gender_letter(mrz("gender"))),
            entry("citizenship", citizenship_code(printed("citizenship")) == code(mrz("citizenship"))),
        )
    )


def verification(entries: Column, has_core: Column, failed_message: str) -> Column:
    """struct(status, mismatches, checks, message) from the check entries."""
    failed = F.transform(F.filter(entries, lambda e: ~e["ok"]), lambda e: e["field"])
    checks = F.map_from_entries(
        F.transform(
            entries,
            lambda e: F.struct(
                e["field"].alias("key"),
                F.struct(e["ok"], e["expected"], e["actual"]).alias("value"),
            ),
        )
    )
    checked = let(
        failed,
        lambda m: F.struct(
            F.when(F.size(m) == 0, "Checked").otherwise("Error").alias("status"),
            m.alias("mismatches"),
            checks.alias("checks"),
            F.lit(None).cast("string").alias("message"),
        ),
    )
    no_checks = "map<string,struct<ok:boolean,expected:string,actual:string>>"
    unread = F.struct(
        F.lit("Error").alias("status"),
        F.array(F.lit("mrz")).alias("mismatches"),
        F.create_map().cast(no_checks).alias("checks"),
        F.lit(failed_message).alias("message"),
    )
    return F.when(has_core, checked).otherwise(unread)


def card_verification(data, mrz) -> Column:
    core = mrz("personal_id").isNotNull() & mrz("card_number").isNotNull()
    return let(
        check_entries(data, mrz, "id"), lambda e: verification(e, core, V.CARD_CHECK_FAILED)
    )


def passport_verification(data, mrz, as_printed: bool = False) -> Column:
    core = mrz("card_number").isNotNull() & mrz("birth_date").isNotNull()
    return let(
        check_entries(data, mrz, "passport", as_printed),
        lambda e: verification(e, core, V.PASSPORT_CHECK_FAILED),
    )


def compare_fields(records: DataFrame) -> DataFrame:
    """Checks in long form: one row per submission and compared field. Narrow."""
    return records.select(
        "submission_id", "kind", F.explode("verification.checks").alias("field", "c")
    ).select("submission_id", "kind", "field", "c.ok", "c.expected", "c.actual")
