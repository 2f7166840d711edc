"""Field readers on whole documents, complete records, checks and reports."""

from pyspark.sql import functions as F

from docfields.functions import fields as D
from docfields.functions import text as T
from docfields.operators.verify import card_verification, compare_fields as long_checks, passport_verification
from docfields.plans import records as PR
from docfields.plans import report as RP
from docfields.queries.base import documents, expect, query
from docfields.sources import samples

C = F.col


def _none():
    return F.array().cast("array<string>")


# ---------------------------------------------------------------- single fields
@query("ids_near_labels", expect("k, personal_id, card_number, 1 AS from_text"))
def ids_near_labels(spark, sf_dir):
    d = documents(spark, sf_dir, samples.front_text())
    return d.select(
        "k",
        D.personal_id_near_label(C("lines"), C("text")).alias("personal_id"),
        D.card_number_near_label(C("lines"), C("text")).alias("card_number"),
        F.size(T.find_personal_ids(C("text"))).alias("from_text"),
    )


# without a Georgian place the raw reading takes the next title, which the record job then drops as junk
@query("visual_fields", expect("k, birth_date, expiry_date, gender, nationality AS citizenship, "
    "CASE k % 5 WHEN 1 THEN 'გაცემის თარიღი' WHEN 2 THEN left(place, length(place) - 1) ELSE place END AS birth_place, issue_date"))
def visual_fields(spark, sf_dir):
    text = F.concat_ws("\n", samples.front_text(), samples.back_text())
    d = documents(spark, sf_dir, text)
    v = d.withColumn("v", D.visual_values(C("lines"), {}))
    get = lambda name: F.get(C("v"), F.lit(D.VISUAL_FIELDS.index(name)))
    return v.select(
        "k",
        D.visual_birth_date(get("birth_date"), C("text")).alias("birth_date"),
        D.visual_expiry_date(get("expiry_date"), C("text")).alias("expiry_date"),
        D.visual_gender(get("gender"), C("text")).alias("gender"),
        T.citizenship_code(get("citizenship")).alias("citizenship"),
        get("birth_place").alias("birth_place"),
        D.visual_date(get("issue_date")).alias("issue_date"),
    )


@query("issue_date_card", expect("k, issue_date AS titled, issue_date AS unlabelled, issue_date AS glued"))
def issue_date_card(spark, sf_dir):
    d = documents(spark, sf_dir, samples.back_text())
    used = F.array("birth_date", "expiry_date")
    bare = F.array(C("lines")[0])
    glued = F.concat(F.lit("DATE OF ISSUE: "), F.translate("issue_date", ".", ""))
    empty = F.slice(C("lines"), F.lit(1), F.lit(0))
    return d.select(
        "k",
        D.card_issue_date(C("lines"), C("text"), _none(), used).alias("titled"),
        D.card_issue_date(bare, F.concat_ws(" ", "birth_date", "issue_date"), _none(), used).alias("unlabelled"),
        D.card_issue_date(empty, glued, _none(), used).alias("glued"),
    )


@query("issue_date_passport", expect("k, issue_date"))
def issue_date_passport(spark, sf_dir):
    d = documents(spark, sf_dir, samples.page_text())
    used = F.array("birth_date", "expiry_date")
    return d.select("k", D.passport_issue_date(C("lines"), C("text"), _none(), used).alias("issue_date"))


_CUT_PLACE = "CASE WHEN k % 5 = 2 THEN left(place, length(place) - 1) ELSE place END AS birth_place"


@query("birth_place", expect(f"k, {_CUT_PLACE}"))
def birth_place(spark, sf_dir):
    d = documents(spark, sf_dir, samples.back_text())
    return d.select("k", D.birth_place(C("lines")).alias("birth_place"))


@query("birth_place_latin", expect("k, place_lat AS official, place_lat AS beside"))
def birth_place_latin(spark, sf_dir):
    d = documents(spark, sf_dir, samples.back_text())
    return d.select(
        "k",
        D.birth_place_latin(C("lines"), C("place")).alias("official"),
        D.birth_place_latin(C("lines"), F.lit("აბგდ")).alias("beside"),
    )


@query(
    "names_card",
    expect(
        "k, given_geo AS first_name, CASE WHEN has_zone THEN zone_surname_geo ELSE surname_geo END AS last_name"
    ),
)
def names_card(spark, sf_dir):
    d = documents(spark, sf_dir, samples.front_text())
    hint = lambda c: F.when(C("has_zone"), C(c))
    names = D.card_names(C("lines"), hint("given"), hint("zone_surname"))
    return d.select("k", names.alias("n")).select(
        "k", C("n.first").alias("first_name"), C("n.last").alias("last_name")
    )


@query("names_passport", expect("k, given_geo AS first_name, surname_geo AS last_name"))
def names_passport(spark, sf_dir):
    d = documents(spark, sf_dir, samples.page_text())
    hint = lambda c: F.when(C("has_zone"), C(c))
    names = D.passport_names(C("lines"), hint("given"), hint("surname"))
    return d.select("k", names.alias("n")).select(
        "k", C("n.first").alias("first_name"), C("n.last").alias("last_name")
    )


@query("names_after_marks", expect("k, given_geo AS first_name, CASE WHEN k % 2 = 0 THEN zone_surname_geo END AS last_name"))
def names_after_marks(spark, sf_dir):
    """Rules and Latin headings above the names are no names; a surname that isn't printed stays open."""
    text = F.concat_ws(
        "\n", F.lit("---"), F.lit("IDENTITY CARD"),
        F.when(C("k") % 2 == 0, F.concat_ws("\n", F.lit("გვარი / LAST NAME"), C("zone_surname_geo"))),
        F.lit("სახელი / FIRST NAME"), C("given_geo"),
    )
    d = documents(spark, sf_dir, text)
    names = D.card_names(C("lines"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return d.select("k", names.alias("n")).select("k", C("n.first").alias("first_name"), C("n.last").alias("last_name"))


# ---------------------------------------------------------------- records
_TITLE = "upper(left({0}, 1)) || lower(substr({0}, 2))"
_LATIN_FIRST = f"CASE WHEN has_zone THEN {_TITLE.format('given')} ELSE given_own_lat END AS first_name_lat"
_COMMON = (
    "k AS submission_id, given_geo AS first_name, " + _LATIN_FIRST + ", {last} AS last_name, {last_lat} AS last_name_lat, "
    "birth_date, place AS birth_place, place_lat AS birth_place_lat, {nation} AS citizenship, gender, personal_id, "
    "expiry_date, card_number, issue_date, CASE WHEN has_zone THEN {strip} ELSE '' END AS mrz_strip, "
    "strftime(strptime(birth_date, '%d.%m.%Y'), '%Y-%m-%d') AS birth_on, strftime(strptime(issue_date, '%d.%m.%Y'), '%Y-%m-%d') AS issue_on, "
    "{source} AS citizenship_source, has_zone AS is_valid, CASE WHEN has_zone THEN '' ELSE 'mrz' END AS mismatches"
)
_RECORD = [
    "submission_id", *PR.RECORD_FIELDS, "is_valid",
]


def _flat(records):
    typed = [F.date_format(f"dates.{c}_date", "yyyy-MM-dd").alias(f"{c}_on") for c in ("birth", "issue")]
    return records.select(*_RECORD, *typed, "citizenship_source", F.array_join("verification.mismatches", ",").alias("mismatches"))


@query(
    "card_record",
    expect(
        _COMMON.format(
            last="CASE WHEN has_zone THEN zone_surname_geo ELSE surname_geo END",
            last_lat=f"CASE WHEN has_zone THEN {_TITLE.format('zone_surname')} ELSE {_TITLE.format('surname')} END",
            nation="nationality", source="CASE WHEN has_zone THEN 'zone' ELSE 'printed' END",
            strip="row1 || chr(10) || row2 || chr(10) || rpad(zone_surname || '<<' || given, 30, '<')",
        )
    ),
)
def card_record(spark, sf_dir):
    return _flat(PR.card_records(samples.card_captures(spark, sf_dir)))


@query(
    "visual_vs_mrz",
    f"WITH t AS ({samples.TRUTH}) "
    + " UNION ALL ".join(
        f"SELECT k AS submission_id, '{f}' AS field, {ok} AS ok, {e} AS expected, {a} AS actual FROM t WHERE has_zone"
        for f, ok, e, a in (
            ("birth_date", "k % 3 <> 0", "birth_date", "CASE WHEN k % 3 = 0 THEN '01.01.1950' ELSE birth_date END"),
            ("expiry_date", "true", "expiry_date", "expiry_date"),
            ("gender", "true", "gender", "gender"),
            ("citizenship", "true", "nationality", "nationality"),
        )
    ),
)
def visual_vs_mrz(spark, sf_dir):
    """Every third front shows another birth date than the zone on the back."""
    captures = samples.card_captures(spark, sf_dir)
    other = F.regexp_replace("full_text", "(?<=BIRTH\n)[0-9.]{10}", "01.01.1950")
    spoiled = captures.withColumn("full_text", F.when(C("submission_id") % 3 == 0, other).otherwise(C("full_text")))
    checks = PR.card_records(spoiled, compare_printed=True).select("submission_id", F.explode("visual_vs_mrz").alias("c"))
    return checks.select("submission_id", "c.field", "c.ok", "c.expected", "c.actual")


@query(
    "passport_record",
    expect(
        _COMMON.format(
            last="surname_geo", last_lat=_TITLE.format("surname"), nation="'GEO'", source="'default'",
            strip="page_row1 || chr(10) || page_row2",
        )
    ),
)
def passport_record(spark, sf_dir):
    return _flat(PR.passport_records(samples.passport_captures(spark, sf_dir)))


def checked_records(spark, sf_dir):
    """Records whose printed values disagree with the zone in known ways."""
    k = C("k")
    zone = F.struct(
        F.when(C("has_zone"), C("personal_id")).alias("personal_id"), "card_number", "birth_date",
        "expiry_date", "gender", C("given").alias("first_name"), C("surname").alias("last_name"),
        C("nationality").alias("citizenship"),
    )
    printed = samples.truth(spark, sf_dir).withColumns(
        {
            "mrz": zone,
            "submission_id": k,
            "birth_date": F.when(k % 3 == 0, "01.01.1900").otherwise(C("birth_date")),
            "gender": F.when(k % 7 == 0, F.lit(None)).otherwise(C("gender")),
            "first_name": C("given_geo"),
            "first_name_lat": F.when(k % 5 == 0, "Zaza").otherwise(F.initcap("given")),
            "last_name": C("surname_geo"),
            "last_name_lat": F.initcap("surname"),
            "citizenship": C("nationality"),
            "captured_at": F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(k % 3 as int))"),
        }
    )
    check = card_verification(F.col, lambda c: C("mrz")[c])
    return printed.select(
        "submission_id", F.lit("id").alias("kind"), "captured_at",
        F.when(k % 4 == 0, "").otherwise(C("issue_date")).alias("issue_date"),
        C("mrz").alias("mrz_fields"), check.alias("verification"), (k % 3 != 1).alias("prefix_seen"),
    ).withColumn("is_valid", C("verification.status") == "Checked")


def checked_passports(spark, sf_dir):
    """Passport records that disagree with their zone like the cards of `checked_records`; the zone of the unreadable
    ones lacks the birth date, and every 6th page is filled in as another country's."""
    k = C("k")
    printed = samples.truth(spark, sf_dir).withColumns(
        {
            "mrz": F.struct(
                F.lit(None).cast("string").alias("personal_id"), "card_number",
                F.when(C("has_zone"), C("birth_date")).alias("birth_date"), "expiry_date", "gender",
                C("given").alias("first_name"), C("surname").alias("last_name"), F.lit("GEO").alias("citizenship"),
            ),
            "submission_id": k,
            "birth_date": F.when(k % 3 == 0, "01.01.1900").otherwise(C("birth_date")),
            "gender": F.when(k % 7 == 0, F.lit(None)).otherwise(C("gender")),
            "first_name": C("given_geo"),
            "first_name_lat": F.when(k % 5 == 0, "Zaza").otherwise(F.initcap("given")),
            "last_name": C("surname_geo"),
            "last_name_lat": F.initcap("surname"),
            "citizenship": F.when(k % 6 == 0, "UKR").otherwise(F.lit("GEO")),
            "captured_at": F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(k % 3 as int))"),
        }
    )
    check = passport_verification(F.col, lambda c: C("mrz")[c])
    return printed.select(
        "submission_id", F.lit("passport").alias("kind"), "captured_at",
        F.when(k % 4 == 0, "").otherwise(C("issue_date")).alias("issue_date"),
        C("mrz").alias("mrz_fields"), check.alias("verification"), F.lit(False).alias("prefix_seen"),
    ).withColumn("is_valid", C("verification.status") == "Checked")


_MISS = (
    "concat_ws(',', CASE WHEN k % 3 = 0 THEN 'birth_date' END, CASE WHEN k % 7 = 0 THEN 'gender' END, "
    "CASE WHEN k % 5 = 0 THEN 'first_name' END)"
)


@query(
    "verification",
    expect(
        f"k AS submission_id, CASE WHEN has_zone AND {_MISS} = '' THEN 'Checked' ELSE 'Error' END AS status, "
        f"CASE WHEN has_zone THEN {_MISS} ELSE 'mrz' END AS mismatches, "
        "CASE WHEN has_zone THEN 8 ELSE 0 END AS n_checks"
    ),
)
def verification(spark, sf_dir):
    return checked_records(spark, sf_dir).select(
        "submission_id", "verification.status",
        F.array_join("verification.mismatches", ",").alias("mismatches"),
        F.size("verification.checks").alias("n_checks"),
    )


_PAGE_MISS = (
    "concat_ws(',', CASE WHEN k % 3 = 0 THEN 'birth_date' END, CASE WHEN k % 7 = 0 THEN 'gender' END, "
    "CASE WHEN k % 5 = 0 THEN 'first_name' END, CASE WHEN k % 6 = 0 THEN 'citizenship' END)"
)


@query(
    "passport_verification",
    expect(
        f"k AS submission_id, CASE WHEN has_zone AND {_PAGE_MISS} = '' THEN 'Checked' ELSE 'Error' END AS status, "
        f"CASE WHEN has_zone THEN {_PAGE_MISS} ELSE 'mrz' END AS mismatches, "
        "CASE WHEN has_zone THEN 7 ELSE 0 END AS n_checks"
    ),
)
def passport_verification_query(spark, sf_dir):
    return checked_passports(spark, sf_dir).select(
        "submission_id", "verification.status",
        F.array_join("verification.mismatches", ",").alias("mismatches"),
        F.size("verification.checks").alias("n_checks"),
    )


_BAD_BIRTH = "CASE WHEN k % 3 = 0 THEN '01.01.1900' ELSE birth_date END"
_CHECKS = [
    ("personal_id", "true", "personal_id", "personal_id"),
    ("card_number", "true", "card_number", "card_number"),
    ("birth_date", "k % 3 <> 0", "birth_date", _BAD_BIRTH),
    ("expiry_date", "true", "expiry_date", "expiry_date"),
    ("gender", "k % 7 <> 0", "gender", "CASE WHEN k % 7 = 0 THEN '' ELSE gender END"),
    ("first_name", "k % 5 <> 0", "given", "CASE WHEN k % 5 = 0 THEN 'ZAZA' ELSE given END"),
    ("last_name", "true", "surname", "surname"),
    ("citizenship", "true", "nationality", "nationality"),
]


@query(
    "compare_fields",
    f"WITH t AS ({samples.TRUTH}) "
    + " UNION ALL ".join(
        f"SELECT k AS submission_id, '{f}' AS field, {ok} AS ok, {e} AS expected, {a} AS actual FROM t WHERE has_zone"
        for f, ok, e, a in _CHECKS
    ),
)
def compare_fields(spark, sf_dir):
    return long_checks(checked_records(spark, sf_dir)).select(
        "submission_id", "field", "ok", "expected", "actual"
    )


@query(
    "quality_report",
    f"WITH t AS ({samples.TRUTH}), r AS (SELECT 'id' AS kind, '2024-01-0' || cast(1 + k % 3 AS string) AS day, "
    f"k % 4 = 0 AS no_issue, NOT has_zone AS weak, NOT has_zone AND k % 3 <> 1 AS unread, has_zone AND {_MISS} = '' AS valid, "
    "CASE WHEN NOT has_zone THEN 1 ELSE (CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END "
    "+ CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END) END AS miss FROM t UNION ALL "
    f"SELECT 'passport', '2024-01-0' || cast(1 + k % 3 AS string), k % 4 = 0, NOT has_zone, false, has_zone AND {_PAGE_MISS} = '', "
    "CASE WHEN NOT has_zone THEN 1 ELSE (CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END "
    "+ CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END) END FROM t) "
    "SELECT kind, day, count(*) AS records, count(*) FILTER (WHERE no_issue) AS no_issue_date, "
    "count(*) FILTER (WHERE weak) AS weak_zone, count(*) FILTER (WHERE unread) AS unread_zone, count(*) FILTER (WHERE valid) AS is_valid, "
    "cast(sum(miss) AS bigint) AS mismatches, avg(no_issue::int) AS no_issue_share, avg(weak::int) AS weak_zone_share, "
    "avg(unread::int) AS unread_zone_share, avg(valid::int) AS valid_share FROM r GROUP BY ROLLUP (kind, day)",
)
def quality_report(spark, sf_dir):
    report = RP.quality_report(checked_records(spark, sf_dir).unionByName(checked_passports(spark, sf_dir)))
    return report.withColumn("day", C("day").cast("string"))


@query(
    "mismatch_report",
    f"WITH t AS ({samples.TRUTH}), m AS (SELECT 'mrz' AS field FROM t WHERE NOT has_zone UNION ALL "
    "SELECT 'birth_date' FROM t WHERE has_zone AND k % 3 = 0 UNION ALL SELECT 'gender' FROM t WHERE has_zone AND "
    "k % 7 = 0 UNION ALL SELECT 'first_name' FROM t WHERE has_zone AND k % 5 = 0) "
    "SELECT 'id' AS kind, field, count(*) AS records FROM m GROUP BY field",
)
def mismatch_report(spark, sf_dir):
    return RP.mismatch_report(checked_records(spark, sf_dir))
