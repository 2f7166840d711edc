"""Sources, pairing and operators over line and candidate tables."""


from pyspark.sql import functions as F

from docfields.functions.dates import find_dates
from docfields.functions.mrz import td1_dates_names
from docfields.functions.lines import label_array, study_lines, to_lines, with_continuation
from docfields.functions.text import first
from docfields.operators import captures as OC
from docfields.operators import tables as OT
from docfields.queries.base import (
    N_BACK, N_FRONT, expect, fields, joined, line_table, query,
)
from docfields.sources import samples
from docfields.sources.tables import read_captures as read
from docfields.sources.tables import commit_results, read_results, shared_folder

C = F.col


def _stored(spark, df, name):
    """Write a table to the shared folder under a fresh name and return its path."""
    import uuid

    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


# ---------------------------------------------------------------- sources
_CAPTURE_COUNTS = (
    f"WITH t AS ({samples.TRUTH}) SELECT 'id' AS kind, 'front' AS side, count(*) AS n, "
    "count(*) FILTER (WHERE k % 3 <> 0) AS annotated FROM t UNION ALL "
    "SELECT 'id', 'back', count(*) + count(*) FILTER (WHERE k % 4 = 1), "
    "count(*) FILTER (WHERE k % 3 <> 0) + count(*) FILTER (WHERE k % 3 <> 0 AND k % 4 = 1) FROM t"
)


@query("read_captures", _CAPTURE_COUNTS)
def read_captures(spark, sf_dir):
    path = _stored(spark, samples.card_captures(spark, sf_dir), "captures")
    return read(spark, path).groupBy("kind", "side").agg(
        F.count(F.lit(1)).alias("n"), F.count("pages").alias("annotated")
    )


@query(
    "to_lines",
    "SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS int) AS line_no, line FROM ("
    "SELECT doc_id, generate_subscripts(p, 1) AS i, trim(unnest(p), ' ' || chr(9) || chr(13)) AS line FROM ("
    "SELECT doc_id, string_split(text, chr(10)) AS p FROM documents) AS a) AS b WHERE line <> ''",
)
def to_lines_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.posexplode(to_lines(C("text"))).alias("line_no", "line"))


@query(
    "write_results",
    expect("k AS submission_id, 'id' AS kind, card_number, CASE WHEN has_zone THEN 8 ELSE 0 END AS n_checks, CASE WHEN has_zone THEN personal_id END AS expected")
    + " UNION ALL SELECT k, 'passport', card_number, CASE WHEN has_zone THEN 7 ELSE 0 END, NULL FROM t",
)
def write_results(spark, sf_dir):
    """Records of both kinds, each kind a job that is run twice, written with their nested fields and read back: each record once."""
    import uuid

    from docfields.queries.records import checked_passports, checked_records

    path = f"{shared_folder(spark)}/tables/results-{uuid.uuid4().hex}"
    for job, records in (("cards", checked_records), ("passports", checked_passports), ("cards", checked_records)):
        commit_results(records(spark, sf_dir), path, job)
    return read_results(spark, path).select(
        "submission_id", "kind", "mrz_fields.card_number", F.size("verification.checks").alias("n_checks"),
        F.try_element_at("verification.checks", F.lit("personal_id"))["expected"].alias("expected"),
    )


@query(
    "dead_letter",
    expect(
        "CASE WHEN k % 19 = 0 THEN NULL ELSE k END AS submission_id, CASE WHEN k % 19 = 0 THEN 'no submission id' "
        "WHEN k % 17 = 0 THEN 'unknown kind' WHEN k % 23 = 0 THEN 'unknown side' WHEN k % 13 = 0 THEN 'side does not fit kind' "
        "WHEN k % 29 = 0 THEN 'no text' ELSE 'usable' END AS error, "
        "NOT (k % 19 = 0 OR k % 17 = 0 OR k % 23 = 0 OR k % 13 = 0 OR k % 29 = 0) AS usable",
    ),
)
def dead_letter(spark, sf_dir):
    t = samples.truth(spark, sf_dir)
    captures = samples.captures_of(t, "id", "front", C("row1"))
    k = C("submission_id")
    spoiled = captures.select(
        F.when(k % 19 != 0, k).alias("submission_id"),
        F.when((k % 17 == 0) & (k % 2 == 0), "visa").when(k % 17 != 0, C("kind")).alias("kind"),
        F.when(k % 23 == 0, "left").when(k % 13 == 0, "page").otherwise(C("side")).alias("side"),
        "captured_at", F.when((k % 29 != 0), C("full_text")).alias("full_text"),
    )
    # usable and unusable captures together are all captures
    good, bad = OC.split_dead_letters(spoiled)
    named = good.select("submission_id", F.lit("usable").alias("error"), F.lit(True).alias("usable"))
    return named.unionByName(bad.select("submission_id", "error", C("is_valid").alias("usable")))


# ---------------------------------------------------------------- pairing
@query(
    "join_sides",
    expect("k AS submission_id, k % 10 <> 3 AS has_front, k % 10 <> 4 AS has_back, "
           "CASE WHEN k % 10 <> 4 THEN false END AS useless_back",
           # without any side there is no submission
           where="k % 10 <> 7"),
)
def join_sides(spark, sf_dir):
    k = C("submission_id")
    captures = samples.card_captures(spark, sf_dir).filter(
        ~((k % 10 == 3) & (C("side") == "front")) & ~((k % 10 == 4) & (C("side") == "back")) & (k % 10 != 7)
    )
    return OC.pair_sides(captures).select(
        "submission_id", "has_front", "has_back", (C("back_text") == "IDENTITY CARD").alias("useless_back")
    )


@query(
    "combine_sides",
    expect(f"k AS submission_id, cast({N_FRONT} + {N_BACK} AS int) AS n_lines, 'პირადობის მოწმობა / IDENTITY CARD' AS first_line"),
)
def combine_sides(spark, sf_dir):
    both = OC.combine_sides(OC.pair_sides(samples.card_captures(spark, sf_dir)))
    lines = both.select("submission_id", to_lines(C("combined_text")).alias("lines"))
    return lines.select("submission_id", F.size("lines").alias("n_lines"), C("lines")[0].alias("first_line"))


@query(
    "sides_union",
    expect("k AS submission_id, birth_date, gender, surname AS last_name", where="surname <> 'GELASHVILI'")
    + " UNION ALL " + "SELECT k, birth_date, gender, zone_surname FROM t WHERE surname = 'GELASHVILI'",
)
def sides_union(spark, sf_dir):
    """Raw lines and rebuilt strip rows are candidates alike: each document has the date row in one of them only,
    the name row in the other."""
    dates_printed = C("k") % 2 == 0
    lines = to_lines(joined("IDENTITY CARD", F.when(dates_printed, C("row2")).otherwise(C("row3"))))
    strip = F.array(C("row1"), F.when(dates_printed, C("row3")).otherwise(C("row2")))
    found = fields(spark, sf_dir, z=td1_dates_names(lines, strip))
    return found.select(C("k").alias("submission_id"), "z.birth_date", "z.gender", "z.last_name")


# ---------------------------------------------------------------- neighbours
def _titles(lines, pattern):
    return lines.filter(C("text").rlike(pattern)).select("submission_id", "side", "line_no")


_DAMAGED = "has_zone AND k % 9 = 0 AND surname <> 'GELASHVILI'"
_CUT_END = "CASE WHEN k % 13 = 0 AND NOT (has_zone AND k % 9 = 0 AND surname <> 'GELASHVILI') THEN 1 ELSE 0 END"


@query(
    "lookahead_lines",
    expect(f"k AS submission_id, 9 + {_CUT_END} AS line_no, gender || chr(10) || 'პირადი № / PERSONAL No' AS window"),
)
def lookahead_lines(spark, sf_dir):
    lines = line_table(spark, sf_dir)
    return OT.window_text(_titles(lines, "^სქესი"), lines, 1, 2).select("submission_id", "line_no", "window")


@query(
    "context_window",
    expect("k AS submission_id, 3 + CASE WHEN k % 5 = 1 THEN 0 ELSE 1 END AS line_no"),
)
def context_window(spark, sf_dir):
    lines = line_table(spark, sf_dir)
    dated = lines.filter(C("text").rlike("^[0-9]{2}[.][0-9]{2}[.][0-9]{4}$"))
    near = OT.context_lines(dated, lines, "(?i)issue|გაცემ", 3)
    return near.select("submission_id", "line_no")


@query("scan_until_stop", expect("k AS submission_id, issue_date AS value"))
def scan_until_stop(spark, sf_dir):
    lines = line_table(spark, sf_dir)
    found = OT.first_before_stop(
        _titles(lines, "^გაცემის|PLACE OF BIRTH"), lines, first(find_dates(C("near"))), "AUTHORITY|DATE OF ISSUE"
    )
    return found.select("submission_id", "value")


@query(
    "scan_after_place",
    # a front has no place title, so its first date counts
    expect("k AS submission_id, 'back' AS side, issue_date AS value") + " UNION ALL SELECT k, 'front', birth_date FROM t",
)
def scan_after_place(spark, sf_dir):
    lines = line_table(spark, sf_dir)
    found = OT.first_after(
        lines, "დაბადების ადგილი|place of birth|place ofbirth", "მოქმედების|expiry|idge|<", first(find_dates(C("text")))
    )
    return found.select("submission_id", "side", "value")


@query("merge_continuation", expect("k, surname_geo AS whole, surname_geo AS alone"))
def merge_continuation(spark, sf_dir):
    cut = F.expr("left(surname_geo, length(surname_geo) - 1)")
    split = joined("გვარი / LAST NAME", cut, F.right("surname_geo", F.lit(1)), C("surname"))
    clean = joined("გვარი / LAST NAME", C("surname_geo"), C("surname"))
    labels = label_array(["გვარი", "last name"])
    merged = lambda text, name: with_continuation(study_lines(to_lines(text)), name, labels)
    return fields(spark, sf_dir, whole=merged(split, cut), alone=merged(clean, C("surname_geo")))


@query(
    "value_after_label",
    f"WITH t AS ({samples.TRUTH}) "
    + " UNION ALL ".join(
        f"SELECT k AS submission_id, '{f}' AS field, {c} AS value FROM t"
        for f, c in (
            ("personal_id", "personal_id"), ("birth_date", "birth_date"), ("expiry_date", "expiry_date"),
            ("gender", "gender"), ("citizenship", "nationality"), ("card_number", "card_number"), ("issue_date", "issue_date"),
            ("first_name", "CASE WHEN k % 11 = 0 AND has_zone AND given NOT IN ('LEVAN', 'TAMAR') THEN left(given_geo, length(given_geo) - 1) ELSE given_geo END"),
            ("last_name", f"CASE WHEN {_DAMAGED} THEN 'ხ' || substr(surname_geo, 2) WHEN k % 13 = 0 THEN left(surname_geo, length(surname_geo) - 1) ELSE surname_geo END"),
            ("birth_place", "CASE k % 5 WHEN 1 THEN upper(place_lat) WHEN 2 THEN left(place, length(place) - 1) ELSE place END"),
        )
    ),
)
def value_after_label(spark, sf_dir):
    return OT.titled_values(line_table(spark, sf_dir))


_TITLED = {"front": ["personal_id", "birth_date", "expiry_date", "gender", "citizenship", "card_number", "first_name", "last_name"],
           "back": ["birth_place", "issue_date"]}


@query(
    "has_label_nearby",
    f"WITH t AS ({samples.TRUTH}) "
    + " UNION ALL ".join(f"SELECT k AS submission_id, '{s}' AS side, '{f}' AS field FROM t" for s, fs in _TITLED.items() for f in fs),
)
def has_label_nearby(spark, sf_dir):
    lines = line_table(spark, sf_dir)
    documents = lines.select("submission_id", "side").distinct()
    found = OT.documents_with_labels(documents, lines, [f for fs in _TITLED.values() for f in fs])
    return found.select("submission_id", "side", "field")


@query(
    "label_hits",
    expect("k AS submission_id, 'front' AS side, cast(8 AS bigint) AS title_lines, cast(3 AS int) AS most")
    + " UNION ALL SELECT k, 'back', 2, 3 FROM t",
)
def label_hits(spark, sf_dir):
    counted = OT.count_labels(line_table(spark, sf_dir))
    return counted.groupBy("submission_id", "side").agg(
        F.count_if(C("hits") > 0).alias("title_lines"), F.max("hits").alias("most")
    )


# ---------------------------------------------------------------- candidates
def _finder(spark, sf_dir, field, tier, pos, value):
    t = samples.truth(spark, sf_dir)
    return t.select(
        C("k").alias("submission_id"), F.lit(field).alias("field"), F.lit(tier).alias("tier"),
        F.lit(pos).alias("pos"), value.alias("value"),
    ).filter("value IS NOT NULL")


def _candidates(spark, sf_dir):
    strict = _finder(spark, sf_dir, "number", 0, 5, F.when(C("k") % 2 == 0, C("card_number")))
    soft = _finder(spark, sf_dir, "number", 1, 2, C("personal_id"))
    again = _finder(spark, sf_dir, "number", 1, 1, C("card_number"))
    return OT.candidate_union(strict, soft, again)


@query(
    "candidate_union",
    expect("k AS submission_id, CASE WHEN k % 2 = 0 THEN 3 ELSE 2 END AS n, "
           "CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END AS best_tier"),
)
def candidate_union(spark, sf_dir):
    return _candidates(spark, sf_dir).groupBy("submission_id").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.min("tier").alias("best_tier")
    )


@query("rank_candidates", expect("k AS submission_id, 'number' AS field, card_number AS value"))
def rank_candidates(spark, sf_dir):
    return OT.best_candidates(_candidates(spark, sf_dir))


@query(
    "distinct_in_order",
    f"WITH t AS ({samples.TRUTH}) SELECT k AS submission_id, card_number AS value, CASE WHEN k % 2 = 0 THEN 0 "
    "ELSE 1 END AS tier, CASE WHEN k % 2 = 0 THEN 5 ELSE 1 END AS pos FROM t "
    "UNION ALL SELECT k, personal_id, 1, 2 FROM t",
)
def distinct_in_order(spark, sf_dir):
    return OT.distinct_in_order(_candidates(spark, sf_dir)).select("submission_id", "value", "tier", "pos")


@query("first_by_tier", expect("k, CASE WHEN k % 3 = 0 THEN surname WHEN k % 3 = 1 THEN given ELSE place_lat END AS value"))
def first_by_tier(spark, sf_dir):
    k = C("k")
    finders = [
        _finder(spark, sf_dir, "place", 2, 0, C("place_lat")),
        _finder(spark, sf_dir, "place", 1, 7, F.when(k % 3 <= 1, C("given"))),
        _finder(spark, sf_dir, "place", 0, 9, F.when(k % 3 == 0, C("surname"))),
    ]
    best = OT.best_candidates(OT.candidate_union(*finders))
    return best.select(C("submission_id").alias("k"), "value")


@query("not_already_used", expect("k AS submission_id, given_geo AS value"))
def not_already_used(spark, sf_dir):
    names = OT.candidate_union(
        _finder(spark, sf_dir, "first_name", 0, 0, C("surname_geo")),
        _finder(spark, sf_dir, "first_name", 0, 1, C("given_geo")),
    )
    used = _finder(spark, sf_dir, "last_name", 0, 0, C("surname_geo"))
    return OT.best_candidates(OT.exclude_used(names, used)).select("submission_id", "value")


@query("except_dates", expect("k AS submission_id, issue_date AS value"))
def except_dates(spark, sf_dir):
    dates = OT.candidate_union(
        _finder(spark, sf_dir, "issue_date", 0, 0, C("birth_date")),
        _finder(spark, sf_dir, "issue_date", 0, 1, C("issue_date")),
    )
    used = OT.candidate_union(
        _finder(spark, sf_dir, "birth_date", 0, 0, C("birth_date")),
        _finder(spark, sf_dir, "expiry_date", 0, 0, C("expiry_date")),
    )
    return OT.exclude_used(dates, used).select("submission_id", "value")


@query(
    "dedupe_lines",
    "SELECT doc_id AS submission_id, lang AS side, line AS text, cast(min(n) AS int) AS line_no FROM ("
    "SELECT doc_id, lang, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM ("
    "SELECT doc_id, lang, generate_subscripts(p, 1) AS i, trim(unnest(p), ' ' || chr(9) || chr(13)) AS line FROM ("
    "SELECT doc_id, lang, string_split(text, chr(10)) AS p FROM documents) AS a) AS b WHERE line <> '') AS c "
    "GROUP BY doc_id, lang, line",
)
def dedupe_lines(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select(
        C("doc_id").alias("submission_id"), C("lang").alias("side"),
        F.posexplode(to_lines(C("text"))).alias("line_no", "text"),
    )
    return OT.dedupe_lines(lines)


@query(
    "drop_mrz_lines",
    expect("k, cast(CASE WHEN has_zone THEN 2 ELSE 0 END AS bigint) AS dropped"),
)
def drop_mrz_lines(spark, sf_dir):
    from docfields.functions.patterns import PASSPORT_MRZ_LINE

    t = samples.truth(spark, sf_dir).withColumn("text", samples.page_text())
    lines = t.select("k", F.explode(to_lines(C("text"))).alias("line"))
    return lines.groupBy("k").agg(F.count_if(C("line").rlike(PASSPORT_MRZ_LINE)).alias("dropped"))
