"""Numbers, dates, scripts and repairs, each over all sample rows or all documents."""

from pyspark.sql import functions as F

from docfields.functions import dates as D
from docfields.functions import match as X
from docfields.functions import text as T
from docfields.operators import lookups
from docfields.queries.base import expect, fields, query
from docfields.sources import samples

C = F.col


def _spoiled_card():
    return F.concat(
        F.translate(F.left("card_number", F.lit(2)), "01", "OI"),
        F.substring("card_number", 3, 2),
        F.translate(F.substring("card_number", 5, 5), "018", "OIB"),
    )


def _other(first: str):
    return F.concat(F.lit(first), F.substring("personal_id", 2, 10))


# ---------------------------------------------------------------- numbers
@query("ocr_digits", expect("k, personal_id"))
def ocr_digits(spark, sf_dir):
    return fields(spark, sf_dir, personal_id=T.ocr_digits(F.translate("personal_id", "01258", "OlzSB")))


@query("fix_card_number", expect("k, card_number, left(card_number, 5) AS short"))
def fix_card_number(spark, sf_dir):
    prefixed = F.when(C("k") % 2 == 0, F.concat("prefix", _spoiled_card())).otherwise(_spoiled_card())
    return fields(
        spark, sf_dir, card_number=T.fix_card_number(prefixed),
        short=T.fix_card_number(F.concat(F.left("card_number", F.lit(5)), F.lit(" -"))),
    )


@query("normalize_card_number", expect("k, card_number"))
def normalize_card_number(spark, sf_dir):
    return fields(
        spark, sf_dir,
        card_number=T.normalize_card_number(F.concat(F.lit("xx-"), _spoiled_card(), F.lit(" /7"))),
    )


@query(
    "find_card_numbers",
    expect(
        "k, card_number || ',' || lpad(cast((k + 1) % 100 AS string), 2, '0') || substr(card_number, 3, 7) "
        "AS numbers"
    ),
)
def find_card_numbers(spark, sf_dir):
    second = F.concat(
        F.lpad(((C("k") + 1) % 100).cast("string"), 2, "0"), F.substring("card_number", 3, 7)
    )
    text = F.concat(F.lit("№:"), "card_number", F.lit("; IDGEO"), second, F.lit("7"), "personal_id")
    return fields(spark, sf_dir, numbers=F.array_join(T.find_card_numbers(text), ","))


@query(
    "find_personal_ids",
    expect(
        "k, personal_id || ',2' || substr(personal_id, 2, 10) || ',3' || substr(personal_id, 2, 10) AS ids"
    ),
)
def find_personal_ids(spark, sf_dir):
    spaced = F.concat(F.left(_other("2"), F.lit(3)), F.lit(" "), F.substring(_other("2"), 4, 8))
    misread = F.concat(F.lit("3"), F.translate(F.substring("personal_id", 2, 10), "01", "OI"))
    text = F.concat_ws("; ", F.concat(F.lit("a "), "personal_id"), F.concat(F.lit("b "), spaced), misread)
    return fields(spark, sf_dir, ids=F.array_join(T.find_personal_ids(text), ","))


@query("prefer_01", expect("k, personal_id, '7' || substr(personal_id, 2, 10) AS no_choice"))
def prefer_01(spark, sf_dir):
    return fields(
        spark, sf_dir,
        personal_id=T.pick_personal_id(F.array(_other("7"), C("personal_id"), _other("1"))),
        no_choice=T.pick_personal_id(F.array(_other("7"), _other("8"))),
    )


# RE2 has no look-around: separators are doubled so that a match may consume both borders
@query(
    "long_numbers_in_documents",
    "SELECT doc_id, coalesce(hits[1], '') AS first_number, len(hits) AS n FROM (SELECT doc_id, "
    "regexp_extract_all(regexp_replace(' ' || text || ' ', '([^0-9])', '\\1\\1', 'g'), "
    "'[^0-9]([0-9]{10})[^0-9]', 1) AS hits FROM documents) AS d",
)
def long_numbers_in_documents(spark, sf_dir):
    """The border rule of the number finders over all document texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hits = T.extract_all(C("text"), "(?<![0-9])([0-9]{10})(?![0-9])", 1)
    return docs.select(
        "doc_id",
        F.coalesce(T.first(hits), F.lit("")).alias("first_number"),
        F.size(hits).cast("long").alias("n"),
    )


# ---------------------------------------------------------------- dates
@query("soft_date", expect("k, birth_date"))
def soft_date(spark, sf_dir):
    return fields(spark, sf_dir, birth_date=T.soft_date(F.translate("birth_date", "01258", "OlZSB")))


@query(
    "display_date",
    expect(
        "k, CASE WHEN k % 40 BETWEEN 1 AND 31 AND k % 15 BETWEEN 1 AND 12 AND 1890 + k % 230 BETWEEN 1900 AND 2100 "
        "THEN lpad(cast(k % 40 AS string), 2, '0') || '.' || lpad(cast(k % 15 AS string), 2, '0') || '.' || "
        "cast(1890 + k % 230 AS string) END AS shown, issue_date AS typed_day"
    ),
)
def display_date(spark, sf_dir):
    s = lambda c: c.cast("string")
    k = C("k")
    return fields(
        spark, sf_dir,
        shown=D.display_date(s(k % 40), s(k % 15), s(k % 230 + 1890)),
        typed_day=F.date_format(D.typed_date(C("issue_date")), "dd.MM.yyyy"),
    )


@query(
    "find_dates",
    expect(
        "k, CASE WHEN birth_date = expiry_date THEN birth_date ELSE birth_date || ',' || expiry_date END AS dates"
    ),
)
def find_dates(spark, sf_dir):
    text = F.concat(
        F.lit("born "), F.translate("birth_date", ".", "/"), F.lit(" ends "), F.translate("expiry_date", "0", "O")
    )
    return fields(spark, sf_dir, dates=F.array_join(D.find_dates(text), ","))


@query("mrz_date", expect("k, birth_date, expiry_date, birth_date AS card_birth_date"))
def mrz_date(spark, sf_dir):
    return fields(
        spark, sf_dir,
        birth_date=D.mrz_date(F.translate("birth_mrz", "01", "OI"), birth=True),
        expiry_date=D.mrz_date(F.translate("expiry_mrz", "25", "ZS"), birth=False),
        card_birth_date=D.card_mrz_date(C("birth_mrz"), birth=True),
    )


@query("verbal_month_date", expect("k, issue_date"))
def verbal_month_date(spark, sf_dir):
    form = (
        F.when(C("k") % 5 == 0, F.regexp_replace("issue_verbal", "^(..) ", "$1"))
        .when(C("k") % 5 == 1, F.regexp_replace("issue_verbal", " / ", " "))
        .when(C("k") % 5 == 2, F.regexp_replace("issue_verbal", " / [A-Z]+", ""))
        .when(C("k") % 5 == 3, F.regexp_replace("issue_verbal", "[^ ]+ / ", ""))
        .otherwise(C("issue_verbal"))
    )
    return fields(spark, sf_dir, issue_date=D.verbal_date(F.concat(F.lit("x "), form, F.lit(" y"))))


@query("passport_dates", expect("k, issue_date || ',' || birth_date AS dates"))
def passport_dates(spark, sf_dir):
    text = F.concat("issue_verbal", F.lit("; "), "birth_date")
    return fields(spark, sf_dir, dates=F.array_join(D.passport_dates(text), ","))


@query(
    "exclude_known_dates",
    expect("k, issue_date, CASE WHEN birth_date = expiry_date THEN 1 ELSE 2 END AS n_known"),
)
def exclude_known_dates(spark, sf_dir):
    found = F.array("birth_date", "expiry_date", "issue_date")
    known = F.array_compact(
        F.array(D.known_date(F.translate("birth_date", ".", "-")), D.known_date(C("expiry_date")))
    )
    return fields(
        spark, sf_dir,
        issue_date=T.first(F.array_except(found, known)),
        n_known=F.size(F.array_distinct(known)),
    )


# ---------------------------------------------------------------- scripts
@query("clean_value", expect("k, surname || ' ' || given AS value"))
def clean_value(spark, sf_dir):
    raw = F.concat(F.lit(" : - "), "surname", F.lit(" \t "), "given", F.lit(" /|"))
    return fields(spark, sf_dir, value=T.clean_value(raw))


@query(
    "georgian_only",
    expect(
        "k, surname_geo || ' ' || given_geo AS side, CASE WHEN length(given_geo) > length(surname_geo) "
        "THEN given_geo ELSE surname_geo END AS longest, cast(NULL AS string) AS none"
    ),
)
def georgian_only(spark, sf_dir):
    return fields(
        spark, sf_dir,
        side=T.georgian_only(F.concat("surname", F.lit(" / "), "surname_geo", F.lit(" "), "given_geo")),
        longest=T.longest_run(F.concat("surname_geo", F.lit(" 12 "), "given_geo")),
        none=T.georgian_only(C("surname")),
    )


@query(
    "transliterate",
    expect("k, given_own_lat, place_lat, upper(place_lat) AS place_key, upper(given_own_lat) AS given_key"),
)
def transliterate(spark, sf_dir):
    return fields(
        spark, sf_dir,
        given_own_lat=T.transliterate(C("given_geo")),
        place_lat=T.transliterate(F.concat(F.lit("12"), "place")),
        place_key=T.latin_key_of(C("place")),
        given_key=T.latin_key(F.concat("given_own_lat", F.lit(" 1"))),
    )


_TITLE = "upper(left({0}, 1)) || lower(substr({0}, 2))"


@query(
    "bilingual",
    expect(
        f"k, given_geo || ' / ' || {_TITLE.format('given')} AS both, given_geo || ' / ' || given_own_lat AS filled, "
        f"given AS latin, given_geo AS geo_part, {_TITLE.format('given')} || '-' || {_TITLE.format('surname')} AS titled"
    ),
)
def bilingual(spark, sf_dir):
    both = T.format_bilingual(C("given_geo"), C("given"))
    none = F.lit(None).cast("string")
    return fields(
        spark, sf_dir,
        both=both,
        filled=T.format_bilingual(F.concat("given_geo", F.lit(" / 12")), none),
        latin=T.latin_side(both),
        geo_part=T.split_pair(C("given_geo"), C("given"))["geo"],
        titled=T.title_latin(F.concat("given", F.lit("-"), F.lower("surname"))),
    )


@query("gender", expect("k, sex, gender AS parsed, gender AS shown"))
def gender(spark, sf_dir):
    return fields(
        spark, sf_dir,
        sex=T.gender_letter(C("gender")),
        parsed=T.parse_gender(F.concat(F.lit("No 12 "), "sex", F.lit(", x"))),
        shown=T.gender_display(C("sex")),
    )


_NATIONS = "Georgian,UKRAINE,Belarussia,Turkiye,SPAIN,აშშ,გერმანია,AB"
_CODES = "GEO,UKR,RUS,TUR,SPA,USA,DEU,AB"


@query(
    "lookup_alias_contains",
    expect(f"k, split_part('{_CODES}', ',', cast(1 + k % 8 AS int)) AS code"),
)
def lookup_alias_contains(spark, sf_dir):
    name = F.split_part(F.lit(_NATIONS), F.lit(","), (C("k") % 8 + 1).cast("int"))
    return fields(spark, sf_dir, code=T.citizenship_code(F.concat(F.lit(" "), name)))


@query("edit_distance", expect("k, levenshtein(surname, given) AS distance"))
def edit_distance(spark, sf_dir):
    return fields(spark, sf_dir, distance=F.levenshtein("surname", "given").cast("long"))


@query(
    "letter_twins",
    expect(
        "k, length(surname_geo) - length(regexp_replace(surname_geo, '[თტქკფპჩჭცწ]', '', 'g')) AS twins"
    ),
)
def letter_twins(spark, sf_dir):
    letters = fields(spark, sf_dir, letter=F.explode(F.split("surname_geo", "")))
    shared = lookups.letter_twins(spark).select(F.explode("letters").alias("letter"), F.lit(1).alias("one"))
    return letters.join(F.broadcast(shared), "letter", "left").groupBy("k").agg(F.count("one").alias("twins"))


# ---------------------------------------------------------------- matching and repair
@query(
    "geo_match_score",
    expect(
        "k, CASE WHEN given IN ('LEVAN', 'TAMAR') THEN 1.5e0 ELSE 2e0 END AS own, "
        "CASE WHEN surname = 'LOMIDZE' THEN 4e0 / 9 WHEN given = 'LUKA' THEN 0e0 ELSE 0e0 END AS other"
    ),
)
def geo_match_score(spark, sf_dir):
    hint = F.when(C("surname") == "LOMIDZE", "LOMITADZE").otherwise("XX")
    return fields(
        spark, sf_dir,
        own=X.match_score(C("given_geo"), C("given")),
        other=X.match_score(C("surname_geo"), hint),
    )


@query("best_for_latin", expect("k, surname_geo AS best, cast(NULL AS string) AS without"))
def best_for_latin(spark, sf_dir):
    candidates = F.array("place", "surname_geo", F.lit("სტუდენტი"))
    nobody = F.lit(None).cast("string")
    return fields(
        spark, sf_dir,
        best=X.best_for_latin(candidates, C("surname"), nobody),
        without=X.best_for_latin(F.array("surname_geo"), C("surname"), C("surname_geo")),
    )


@query("repair_to_latin", expect("k, surname_geo AS repaired, given_geo AS far"))
def repair_to_latin(spark, sf_dir):
    wrong = F.concat(F.lit("ხ"), F.substring("surname_geo", 2, 50))
    return fields(
        spark, sf_dir,
        repaired=X.repair_to_latin(wrong, C("surname")),
        far=X.repair_to_latin(C("given_geo"), F.concat("surname", F.lit("ZZZ"))),
    )


@query(
    "closest_repair",
    expect("k, surname_geo AS repaired"),
)
def closest_repair(spark, sf_dir):
    """The nearest of several spellings with the same Latin form wins."""
    doubled = F.concat("surname_geo", F.right("surname_geo", F.lit(1)))
    return fields(spark, sf_dir, repaired=X.repair_to_latin(doubled, C("surname")))


@query(
    "fix_person_name",
    expect(
        "k, CASE WHEN given IN ('LEVAN', 'TAMAR') THEN left(given_geo, length(given_geo) - 1) ELSE given_geo END "
        "AS first_name, given_geo AS recovered, surname_geo AS last_name"
    ),
)
def fix_person_name(spark, sf_dir):
    cut = F.expr("left(given_geo, length(given_geo) - 1)")
    wrong = F.concat(F.lit("ხ"), F.substring("surname_geo", 2, 50))
    none = F.lit(None).cast("string")
    return fields(
        spark, sf_dir,
        first_name=X.fix_person_name(cut, C("given"), F.lit(True)),
        recovered=X.fix_person_name(none, C("given"), F.lit(True)),
        last_name=X.fix_person_name(wrong, C("surname"), F.lit(False)),
    )


@query(
    "restore_final_i",
    expect(
        "k, CASE WHEN given IN ('GIORGI', 'IRAKLI') THEN given_geo "
        "ELSE left(given_geo, length(given_geo) - 1) END AS name"
    ),
)
def restore_final_i(spark, sf_dir):
    cut = F.expr("left(given_geo, length(given_geo) - 1)")
    return fields(spark, sf_dir, name=X.restore_final_i(cut, C("given")))


@query(
    "repair_place",
    expect(
        "k, place AS near_latin, place AS from_latin, CASE WHEN length(place) >= 5 THEN place "
        "ELSE left(place, length(place) - 1) END AS snapped, place AS official"
    ),
)
def repair_place(spark, sf_dir):
    cut = F.expr("left(place, length(place) - 1)")
    none = F.lit(None).cast("string")
    return fields(
        spark, sf_dir,
        near_latin=X.repair_place(cut, C("place_lat")),
        from_latin=X.repair_place(none, F.upper("place_lat")),
        snapped=X.repair_place(cut, none),
        official=X.repair_place(C("place"), F.lit("ONI")),
    )


@query(
    "latin_place_candidate",
    expect("k, place_lat AS plain, place_lat AS two_script, cast(NULL AS string) AS title, place_lat AS cleaned"),
)
def latin_place_candidate(spark, sf_dir):
    return fields(
        spark, sf_dir,
        plain=T.latin_place(F.upper("place_lat")),
        two_script=T.latin_place(F.concat("place", F.lit(" / "), F.upper("place_lat"))),
        title=T.latin_place(F.concat(F.lit("PLACE OF BIRTH "), "place_lat")),
        cleaned=T.clean_place_latin(C("place"), F.lit("The")),
    )


@query("known_city", expect("k, place", where="k % 3 = 0"))
def known_city(spark, sf_dir):
    value = F.when(C("k") % 3 == 0, C("place")).otherwise(F.concat("place", F.lit("ა")))
    return lookups.known_values(fields(spark, sf_dir, place=value), "place", lookups.places(spark)).select("k", "place")


@query(
    "lookup_exact",
    expect(
        "k, CASE WHEN k % 10 = 0 THEN NULL ELSE place END AS place, given_geo AS given"
    ),
)
def lookup_exact(spark, sf_dir):
    key = F.when(C("k") % 10 == 0, "NOWHERE").otherwise(T.latin_key(C("place_lat")))
    keyed = fields(spark, sf_dir, place_key=key, given_key=C("given"))
    placed = lookups.lookup_exact(keyed, "place_key", lookups.places(spark)).withColumnRenamed("geo", "place")
    named = lookups.lookup_exact(placed, "given_key", lookups.given_names(spark))
    return named.select("k", "place", F.col("geo").alias("given"))


@query(
    "lookup_whole_word",
    expect("k, CASE WHEN k % 4 = 0 THEN NULL ELSE place END AS place"),
)
def lookup_whole_word(spark, sf_dir):
    inside = F.concat(F.lit("ა"), "place", F.lit(" რეგიონი ივანიშვილი"))
    text = F.when(C("k") % 4 == 0, inside).otherwise(F.concat(F.lit("ქ. "), "place", F.lit(", ონი")))
    return lookups.lookup_whole_word(fields(spark, sf_dir, text=text), "text").select("k", "place")


@query(
    "lookup_fuzzy",
    expect("k, CASE WHEN length(place) >= 5 THEN place END AS place"),
)
def lookup_fuzzy(spark, sf_dir):
    cut = fields(spark, sf_dir, value=F.expr("left(place, length(place) - 1)"))
    return lookups.lookup_fuzzy(cut, "value").select("k", "place")


@query(
    "longest_first",
    expect("k, CASE WHEN length(place) > 4 THEN place ELSE 'რუსთავი' END AS longest"),
)
def longest_first(spark, sf_dir):
    text = F.concat("place", F.when(F.length("place") <= 4, " რუსთავი").otherwise(" ონი"), F.lit(" ვანი"))
    return fields(spark, sf_dir, longest=X.known_place(text))


# ---------------------------------------------------------------- line predicates
_LINES = (
    "SELECT doc_id, trim(l, ' ' || chr(9) || chr(13)) AS line FROM "
    "(SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) AS s"
)
_LABELS = "|".join(T.ALL_LABELS).replace(".", "\\.")
_TITLE_START = (
    "(?i)^(?:სახელი|გვარი|სქესი|მოქალაქეობა|პირადი|დაბადების|მოქმედების|ბარათის|first|last|name|sex|"
    "citizenship|nationality|personal|date|birth|place|expiry|valid|card|identity|georgia|საქართველო|"
    "signature|authority|issue|document)"
)


@query(
    "is_label_only",
    f"SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(line, '{_TITLE_START}') OR "
    "(length(line) < 45 AND NOT regexp_matches(line, '[0-9]{6}|[ა-ჿ]{3}') AND "
    f"regexp_matches(lower(line), '{_LABELS}') AND NOT regexp_matches(line, '[:：]\\s*\\S') AND "
    "len(regexp_split_to_array(line, '[\\s/]+')) <= 4)) AS titles "
    f"FROM ({_LINES}) AS x WHERE line <> '' GROUP BY doc_id",
)
def is_label_only(spark, sf_dir):
    from docfields.functions.lines import to_lines

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select("doc_id", F.explode(to_lines(C("text"))).alias("line"))
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(T.is_label_only(C("line"))).alias("titles")
    )


@query(
    "dims",
    "WITH t AS (" + samples.TRUTH + ") SELECT place AS geo, upper(place_lat) AS lat_key, count(*) AS documents "
    "FROM t GROUP BY 1, 2",
)
def dims(spark, sf_dir):
    """How many documents name each dictionary entry."""
    named = fields(spark, sf_dir, lat_key=T.latin_key_of(C("place")))
    hits = named.join(lookups.places(spark), "lat_key")
    return hits.groupBy("geo", "lat_key").agg(F.count(F.lit(1)).alias("documents"))


@query(
    "longest_run",
    expect("k, CASE WHEN length(place) > length(given_geo) THEN place ELSE given_geo END AS run"),
)
def longest_run(spark, sf_dir):
    return fields(spark, sf_dir, run=T.longest_run(F.concat("given_geo", F.lit("; 1 "), "place")))


@query(
    "junk_values",
    expect(
        "k, false AS place_ok, true AS place_title, true AS place_latin, true AS place_short, "
        "false AS name_ok, true AS name_title"
    ),
)
def junk_values(spark, sf_dir):
    return fields(
        spark, sf_dir,
        place_ok=T.is_place_junk(C("place")),
        place_title=T.is_place_junk(F.concat("place", F.lit(" გაცემის თარიღი"))),
        place_latin=T.is_place_junk(C("place_lat")),
        place_short=T.is_place_junk(F.left("place", F.lit(2))),
        name_ok=T.is_name_junk(C("surname_geo")),
        name_title=T.is_name_junk(F.concat("surname", F.lit(" / ქვეყნის კოდი"))),
    )
