"""Machine-readable zone: rows, fields, checks."""

from pyspark.sql import functions as F

from docfields.functions import mrz as M
from docfields.functions.lines import to_lines
from docfields.plans.records import capture_check
from docfields.queries.base import expect, fields, joined, query
from docfields.sources import samples



def _back_rows():
    return joined(samples.damaged_prefix(F.col("row1")), F.col("row2"), F.col("row3"))


@query(
    "td1_share_by_prefix",
    "SELECT prefix, count(*) AS captures, count(*) AS with_both_numbers, 1.0 AS valid_share "
    f"FROM ({samples.truth_sql('orders')}) AS t GROUP BY prefix",
)
def td1_share_by_prefix(spark, sf_dir):
    """Captures -> lines -> row 1 -> valid share per prefix, over all orders."""
    t = samples.truth(spark, sf_dir, "orders").withColumn("full_text", _back_rows())
    lines = t.select("k", F.explode(to_lines(F.col("full_text"))).alias("text"))
    # through `inline` row 1 is read once a line, also under the filter
    rows = lines.select(F.inline(F.array(M.td1_document(F.col("text"))))).filter("prefix IS NOT NULL")
    valid = F.col("card_number").isNotNull() & F.col("personal_id").isNotNull()
    return rows.groupBy("prefix").agg(
        F.count(F.lit(1)).alias("captures"),
        F.count_if(valid).alias("with_both_numbers"),
        F.avg(valid.cast("double")).alias("valid_share"),
    )


@query("td1_line1", expect("k, prefix, card_number, personal_id", "orders"))
def td1_line1(spark, sf_dir):
    t = samples.truth(spark, sf_dir, "orders")
    return t.select("k", M.td1_document(samples.damaged_prefix(F.col("row1"))).alias("d")).select(
        "k", "d.prefix", "d.card_number", "d.personal_id"
    )


@query("td1_ids", expect("k, card_number, personal_id"))
def td1_ids(spark, sf_dir):
    # row 1 in one piece, broken over two lines, or among other lines
    k, row = F.col("k"), samples.damaged_prefix(F.col("row1"))
    broken = joined(F.left(row, F.lit(13)), F.substring(row, 14, 30))
    text = F.when(k % 3 == 0, broken).when(k % 3 == 1, joined("IDENTITY CARD", row, "<<<")).otherwise(row)
    return fields(spark, sf_dir, d=M.td1_ids(to_lines(text))).select(
        "k", "d.card_number", "d.personal_id"
    )


_ROW3 = "rpad(zone_surname || '<<' || given, 30, '<')"


@query(
    "td1_strip",
    f"WITH t AS ({samples.TRUTH}) SELECT k, 0 AS row_no, row1 AS text FROM t UNION ALL "
    f"SELECT k, 1, row2 FROM t UNION ALL SELECT k, 2, {_ROW3} FROM t",
)
def td1_strip(spark, sf_dir):
    rows = fields(spark, sf_dir, rows=M.td1_strip(to_lines(_back_rows())))
    return rows.select("k", F.posexplode("rows").alias("row_no", "text"))


_TD1 = "k, birth_date, expiry_date, gender, nationality, zone_surname AS last_name, given AS first_name"


@query("td1_fields", expect(_TD1))
def td1_fields(spark, sf_dir):
    zone = fields(spark, sf_dir, z=M.td1_zone(F.array(to_lines(_back_rows()))))
    return zone.select(
        "k", "z.birth_date", "z.expiry_date", "z.gender", F.col("z.citizenship").alias("nationality"),
        "z.last_name", "z.first_name",
    )


@query(
    "zone_from_both_sides",
    # nationality is only ever taken from the back
    expect(_TD1.replace("nationality", "CASE WHEN k % 2 = 1 THEN nationality END AS nationality")),
)
def zone_from_both_sides(spark, sf_dir):
    # half of the backs miss the date row, which then stands on the front
    k, late = F.col("k"), F.col("k") % 2 == 0
    row1 = samples.damaged_prefix(F.col("row1"))
    back = joined(row1, F.when(~late, F.col("row2")), F.col("row3"))
    front = joined("IDENTITY CARD", F.when(late, F.col("row2")))
    zone = fields(
        spark, sf_dir, z=M.td1_zone(F.array(to_lines(back), F.concat(to_lines(front), to_lines(back)))),
    )
    return zone.select(
        "k", "z.birth_date", "z.expiry_date", "z.gender",
        F.col("z.citizenship").alias("nationality"),
        "z.last_name", "z.first_name",
    )


@query(
    "rewrite_strip",
    expect("k, prefix || '99ZZ99999' || substr(row1, 15, 16) AS row1, row2"),
)
def rewrite_strip(spark, sf_dir):
    rows = M.rewrite_strip(M.td1_strip(to_lines(_back_rows())), F.lit("99ZZ99999"))
    return fields(spark, sf_dir, r=rows).select(
        "k", F.col("r")[0].alias("row1"), F.col("r")[1].alias("row2")
    )


def _page_lines():
    return to_lines(samples.page_text())


@query(
    "td3_strip",
    expect("k, CASE WHEN has_zone THEN page_row1 END AS row1, CASE WHEN has_zone THEN page_row2 END AS row2"),
)
def td3_strip(spark, sf_dir):
    t = samples.truth(spark, sf_dir)
    return t.select("k", M.td3_strip(_page_lines()).alias("r")).select(
        "k", F.col("r")[0].alias("row1"), F.col("r")[1].alias("row2")
    )


_TD3 = (
    "k, CASE WHEN has_zone THEN card_number END AS card_number, "
    "CASE WHEN has_zone THEN birth_date END AS birth_date, "
    "CASE WHEN has_zone THEN expiry_date END AS expiry_date, "
    "CASE WHEN has_zone THEN gender END AS gender, "
    "CASE WHEN has_zone THEN 'GEO' END AS citizenship, "
    "CASE WHEN has_zone THEN surname END AS last_name, CASE WHEN has_zone THEN given END AS first_name"
)


def _td3_rows(df):
    studied = df.withColumn("rows", M.td3_strip(F.col("lines")))
    return studied.select("k", M.td3_fields(F.col("lines"), F.col("rows")).alias("z")).select("k", "z.*")


@query("td3_fields", expect(_TD3))
def td3_fields(spark, sf_dir):
    return _td3_rows(fields(spark, sf_dir, lines=_page_lines()))


@query(
    "td3_data_row_only",
    expect("k, card_number, birth_date, expiry_date, gender, cast(NULL AS string) AS last_name"),
)
def td3_data_row_only(spark, sf_dir):
    """Without the name row the fields come from the pattern over all text."""
    only = fields(spark, sf_dir, lines=to_lines(joined("PASSPORT", F.col("page_row2"))))
    return _td3_rows(only).select(
        "k", "card_number", "birth_date", "expiry_date", "gender", "last_name"
    )


@query(
    "mrz_like",
    expect(
        "k, true AS prefix_row, k % 2 = 0 AS filler_row_strict, true AS filler_row_loose, "
        "false AS prose"
    ),
)
def mrz_like(spark, sf_dir):
    filler = F.when(F.col("k") % 2 == 0, F.col("row2")).otherwise(F.col("row3"))
    return fields(
        spark, sf_dir,
        prefix_row=M.mrz_like(M.normalize_mrz(samples.damaged_prefix(F.col("row1"))), strict=True),
        filler_row_strict=M.mrz_like(filler, strict=True),
        filler_row_loose=M.mrz_like(filler, strict=False),
        prose=M.mrz_like(M.normalize_mrz(F.col("place_lat")), strict=False),
    )


@query(
    "normalize_mrz_line",
    expect("k, row3 AS line, rpad(surname, 12, '<') AS padded, left(row1, 12) AS cut"),
)
def normalize_mrz_line(spark, sf_dir):
    spoiled = F.concat(F.lit(" "), F.lower(F.regexp_replace("row3", "<<", "«‹")), F.lit(" ._-/,"))
    return fields(
        spark, sf_dir,
        line=M.normalize_mrz(spoiled),
        padded=M.fix_row(F.concat("surname", F.lit(" .")), 12),
        cut=M.fix_row(F.col("row1"), 12),
    )


@query(
    "locate_td1",
    # a number that starts with 0 supplies the lost O
    expect(
        "k, 4 AS pos, CASE WHEN k % 2 = 0 OR left(card_number, 1) = '0' THEN prefix "
        "ELSE left(prefix, 4) END AS prefix"
    ),
)
def locate_td1(spark, sf_dir):
    lost_o = F.concat(F.lit("<<<"), F.left("prefix", F.lit(4)), "card_number", F.lit("7"), "personal_id")
    whole = F.concat(F.lit("<<<"), samples.damaged_prefix(F.col("row1")))
    return fields(spark, sf_dir, a=M.locate_td1(F.when(F.col("k") % 2 == 0, whole).otherwise(lost_o))).select(
        "k", "a.pos", "a.prefix"
    )


@query("fix_passport_number", expect("k, card_number, '1234' || substr(card_number, 5, 4) || '0' AS other"))
def fix_passport_number(spark, sf_dir):
    spoiled = F.concat(F.translate(F.left("card_number", F.lit(2)), "01", "OI"), F.substring("card_number", 3, 7))
    other = F.concat(F.lit("12 34"), F.substring("card_number", 5, 4), F.lit("O77"))
    return fields(
        spark, sf_dir,
        card_number=M.fix_passport_number(F.concat(spoiled, F.lit("<<7"))),
        other=M.fix_passport_number(other),
    )


@query(
    "capture_check",
    f"WITH t AS ({samples.TRUTH}) SELECT k AS submission_id, 'front' AS side, false AS has_mrz, "
    "false AS has_td3, '' AS mrz_strip FROM t UNION ALL "
    # a card's name row alone also passes for a passport name row
    "SELECT k, 'back', has_zone, has_zone, CASE WHEN has_zone THEN row1 || chr(10) || row2 || chr(10) || "
    f"{_ROW3} ELSE '' END FROM t UNION ALL "
    "SELECT k, 'back', false, false, '' FROM t WHERE k % 4 = 1",
)
def capture_check_query(spark, sf_dir):
    checked = capture_check(samples.card_captures(spark, sf_dir))
    return checked.select("submission_id", "side", "has_mrz", "has_td3", "mrz_strip")


@query(
    "passport_check",
    expect(
        "k AS submission_id, has_zone AS has_td3, CASE WHEN has_zone THEN page_row1 || chr(10) || page_row2 "
        "ELSE '' END AS passport_mrz_strip"
    ),
)
def passport_check(spark, sf_dir):
    checked = capture_check(samples.passport_captures(spark, sf_dir))
    return checked.select("submission_id", "has_td3", "passport_mrz_strip")


@query("keep_fields", expect("k, birth_date, expiry_date, gender"))
def keep_fields(spark, sf_dir):
    """The zone fields that the printed fields start from."""
    zone = fields(spark, sf_dir, z=M.td1_zone(F.array(to_lines(_back_rows()))))
    return zone.select("k", *[F.col(f"z.{c}") for c in ("birth_date", "expiry_date", "gender")])


@query(
    "capture_gate",
    expect("k AS submission_id, has_zone AS card_zone, has_zone AS passport_zone"),
)
def capture_gate(spark, sf_dir):
    t = samples.truth(spark, sf_dir)
    backs = capture_check(samples.captures_of(t, "id", "back", samples.back_text()))
    pages = capture_check(samples.captures_of(t, "passport", "page", samples.page_text()))
    both = backs.select("submission_id", F.col("has_mrz").alias("card_zone"), F.lit(None).cast("boolean").alias("passport_zone"))
    both = both.unionByName(
        pages.select("submission_id", F.lit(None).cast("boolean").alias("card_zone"), F.col("has_td3").alias("passport_zone"))
    )
    return both.groupBy("submission_id").agg(
        F.bool_or("card_zone").alias("card_zone"), F.bool_or("passport_zone").alias("passport_zone")
    )
