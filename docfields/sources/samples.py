"""Sample submissions computed from the `customer` table.

One customer gives one card submission (front and back) and one passport page. TRUTH
is plain SQL that any engine with the usual string functions runs unchanged, so a
checker can state the expected fields without reading the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.functions.text import let

# What is printed and encoded for customer k. Only shared SQL functions are used.
TRUTH = """
SELECT k, n, personal_id, card_number, birth_mrz, birth_date, expiry_mrz, expiry_date, sex,
       CASE WHEN sex = 'M' THEN 'მმ / M' ELSE 'მდ / F' END AS gender,
       nationality, given, given_geo, given_own_lat, surname, surname_geo,
       -- a card's name row that starts with GE loses it: it reads as part of a prefix
       CASE WHEN surname = 'GELASHVILI' THEN 'LASHVILI' ELSE surname END AS zone_surname,
       CASE WHEN surname = 'GELASHVILI' THEN 'ლაშვილი' ELSE surname_geo END AS zone_surname_geo,
       place, place_lat, issue_date, issue_verbal, prefix, has_zone,
       prefix || card_number || cast(k % 10 AS string) || personal_id || '<<<<' AS row1,
       rpad(birth_mrz || cast(k % 10 AS string) || sex || expiry_mrz || cast(k % 10 AS string)
            || nationality, 30, '<') AS row2,
       rpad(surname || '<<' || given, 30, '<') AS row3,
       rpad('P<GEO' || surname || '<<' || given, 44, '<') AS page_row1,
       rpad(card_number || cast(k % 10 AS string) || 'GEO' || birth_mrz || cast(k % 10 AS string)
            || sex || expiry_mrz || cast(k % 10 AS string), 44, '<') AS page_row2
FROM (
  SELECT c_custkey AS k, c_nationkey AS n,
    cast(c_custkey % 2 AS string)
      || lpad(cast((c_custkey * 7919 + 13) % 10000000000 AS string), 10, '0') AS personal_id,
    lpad(cast(c_custkey % 100 AS string), 2, '0') || chr(cast(65 + c_custkey % 26 AS int))
      || chr(cast(65 + (c_custkey * 7) % 26 AS int))
      || lpad(cast((c_custkey * 31) % 100000 AS string), 5, '0') AS card_number,
    lpad(cast((c_custkey * 13) % 100 AS string), 2, '0')
      || lpad(cast(1 + c_custkey % 12 AS string), 2, '0')
      || lpad(cast(1 + c_custkey % 28 AS string), 2, '0') AS birth_mrz,
    lpad(cast(1 + c_custkey % 28 AS string), 2, '0') || '.'
      || lpad(cast(1 + c_custkey % 12 AS string), 2, '0') || '.'
      || CASE WHEN (c_custkey * 13) % 100 > 30 THEN '19' ELSE '20' END
      || lpad(cast((c_custkey * 13) % 100 AS string), 2, '0') AS birth_date,
    cast(25 + c_custkey % 10 AS string) || lpad(cast(1 + c_custkey % 12 AS string), 2, '0')
      || lpad(cast(1 + c_custkey % 28 AS string), 2, '0') AS expiry_mrz,
    lpad(cast(1 + c_custkey % 28 AS string), 2, '0') || '.'
      || lpad(cast(1 + c_custkey % 12 AS string), 2, '0') || '.20'
      || cast(25 + c_custkey % 10 AS string) AS expiry_date,
    CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
    split_part('GEO,UKR,BLR,ARM,TUR', ',', cast(1 + c_nationkey % 5 AS int)) AS nationality,
    split_part('GIORGI,NINO,BEKA,LEVAN,TAMAR,LUKA,ANA,IRAKLI', ',',
               cast(1 + c_custkey % 8 AS int)) AS given,
    split_part('გიორგი,ნინო,ბექა,ლევანი,თამარი,ლუკა,ანა,ირაკლი', ',',
               cast(1 + c_custkey % 8 AS int)) AS given_geo,
    split_part('Giorgi,Nino,Beka,Levani,Tamari,Luka,Ana,Irakli', ',',
               cast(1 + c_custkey % 8 AS int)) AS given_own_lat,
    split_part('MURUSIDZE,KAPANADZE,GELASHVILI,LOMIDZE,BERIDZE', ',',
               cast(1 + c_custkey % 5 AS int)) AS surname,
    split_part('მურუსიძე,კაპანაძე,გელაშვილი,ლომიძე,ბერიძე', ',',
               cast(1 + c_custkey % 5 AS int)) AS surname_geo,
    split_part('თბილისი,ბათუმი,ქუთაისი,რუსთავი,გორი,ამბროლაური,ზუგდიდი,ოზურგეთი', ',',
               cast(1 + c_nationkey % 8 AS int)) AS place,
    split_part('Tbilisi,Batumi,Kutaisi,Rustavi,Gori,Ambrolauri,Zugdidi,Ozurgeti', ',',
               cast(1 + c_nationkey % 8 AS int)) AS place_lat,
    lpad(cast(1 + (c_custkey + 1) % 28 AS string), 2, '0') || '.'
      || lpad(cast(1 + (c_custkey * 5) % 12 AS string), 2, '0') || '.'
      || cast(2015 + c_custkey % 10 AS string) AS issue_date,
    lpad(cast(1 + (c_custkey + 1) % 28 AS string), 2, '0') || ' '
      || split_part('იან / JAN,თებ / FEB,მარ / MAR,აპრ / APR,მაი / MAY,ივნ / JUN,'
                    || 'ივლ / JUL,აგვ / AUG,სექ / SEP,ოქტ / OCT,ნოე / NOV,დეკ / DEC', ',',
                    cast(1 + (c_custkey * 5) % 12 AS int))
      || ' ' || cast(2015 + c_custkey % 10 AS string) AS issue_verbal,
    CASE WHEN c_custkey % 5 = 0 THEN 'TRGEO' ELSE 'IDGEO' END AS prefix,
    c_custkey % 17 <> 0 AS has_zone
  FROM customer
) AS printed
"""


def truth_sql(table: str = "customer") -> str:
    """TRUTH over customers or, for a larger set, over orders."""
    if table == "customer":
        return TRUTH
    return (
        TRUTH.replace("c_custkey", "o_orderkey").replace("c_nationkey", "o_custkey")
        .replace("FROM customer", "FROM orders")
    )


def truth(spark: SparkSession, sf_dir: str, table: str = "customer") -> DataFrame:
    keys = {"customer": ["c_custkey", "c_nationkey"], "orders": ["o_orderkey", "o_custkey"]}[table]
    # two numbers a row grow into whole documents, so they are spread over the session's shuffle partitions first
    seed = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*keys)
    seed = seed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a filter on a document is pushed below an exchange, where it would build all documents in the few tasks of the scan, but not
    # below a generator that gives its columns
    seed = seed.select(F.inline(F.array(F.struct(*keys))))
    return spark.sql(truth_sql(table).replace(f"FROM {table}", "FROM {seed}"), seed=seed)


def _lines(*parts) -> Column:
    """Newline-joined text; NULL parts are left out."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _noise(when: Column, damaged: Column, clean: Column) -> Column:
    return F.when(when & F.col("has_zone"), damaged).otherwise(clean)


def damaged_prefix(row: Column) -> Column:
    """The usual misreadings of a row-1 prefix."""
    k = F.col("k")
    pairs = lambda c, a, b: F.replace(F.replace(c, *map(F.lit, a)), *map(F.lit, b))
    return (
        F.when(k % 7 == 0, pairs(row, ("IDGEO", "1DGEO"), ("TRGEO", "T0GEO")))
        .when(k % 7 == 1, pairs(row, ("IDGEO", "IDGE0"), ("TRGEO", "TRGE0")))
        .otherwise(row)
    )


def front_text() -> Column:
    """Card front. Every 9th surname has a wrong first letter, every 13th a cut-off end,
    every 11th given name lacks its last letter."""
    k, geo = F.col("k"), F.col("surname_geo")
    cut = F.concat(F.expr("left(surname_geo, length(surname_geo) - 1)"), F.lit("\n"), F.right(geo, F.lit(1)))
    damaged = F.col("has_zone") & (k % 9 == 0) & (F.col("surname") != "GELASHVILI")
    surname = F.when(damaged, F.concat(F.lit("ხ"), F.substring(geo, 2, 50))).when(
        k % 13 == 0, cut
    ).otherwise(geo)
    no_own_i = ~F.col("given").isin("LEVAN", "TAMAR")
    given = _noise((k % 11 == 0) & no_own_i, F.expr("left(given_geo, length(given_geo) - 1)"), F.col("given_geo"))
    return _lines(
        "პირადობის მოწმობა / IDENTITY CARD",
        "გვარი / LAST NAME", surname, F.col("surname"),
        "სახელი / FIRST NAME", given, F.col("given"),
        "მოქალაქეობა / CITIZENSHIP", F.col("nationality"),
        "სქესი / SEX", F.col("gender"),
        "პირადი № / PERSONAL No", F.col("personal_id"),
        "დაბადების თარიღი / DATE OF BIRTH", F.col("birth_date"),
        "მოქმედების ვადა / DATE OF EXPIRY", F.col("expiry_date"),
        "ბარათის № / CARD No", F.col("card_number"),
    )


def back_text() -> Column:
    """Card back. The Georgian place is missing or damaged for some, the zone for every 17th."""
    k, zone = F.col("k"), F.col("has_zone")
    place = F.when(k % 5 == 1, None).when(
        k % 5 == 2, F.expr("left(place, length(place) - 1)")
    ).otherwise(F.col("place"))
    return _lines(
        "დაბადების ადგილი / PLACE OF BIRTH", place, F.upper("place_lat"),
        "გაცემის თარიღი / DATE OF ISSUE", F.col("issue_date"),
        "გამცემი ორგანო / AUTHORITY", "იუსტიციის სამინისტრო / MINISTRY OF JUSTICE",
        F.when(zone, damaged_prefix(F.col("row1"))),
        F.when(zone, F.col("row2")), F.when(zone, F.col("row3")),
    )


def page_text() -> Column:
    """Passport page; `P<GEO` is misread for some, the zone missing for every 17th."""
    k, zone, row1 = F.col("k"), F.col("has_zone"), F.col("page_row1")
    tail = F.substring(row1, 6, 39)
    damaged = (
        F.when(k % 7 == 0, F.concat(F.lit("POGEO"), tail))
        .when(k % 7 == 1, F.concat(F.lit("P<GE0"), tail))
        .when(k % 7 == 2, F.concat(F.lit("PGEO"), tail))
        .otherwise(row1)
    )
    return _lines(
        "საქართველო / GEORGIA", "პასპორტი / PASSPORT",
        "გვარი / SURNAME", F.col("surname_geo"), F.col("surname"),
        "სახელი / GIVEN NAME", F.col("given_geo"), F.col("given"),
        "დაბადების თარიღი / DATE OF BIRTH", F.col("birth_date"),
        "სქესი / SEX", F.col("gender"),
        "პირადი № / PERSONAL No", F.col("personal_id"),
        "დაბადების ადგილი / PLACE OF BIRTH",
        F.concat_ws(" / ", F.col("place"), F.upper("place_lat")),
        "გაცემის თარიღი / DATE OF ISSUE", F.col("issue_verbal"),
        "მოქმედების ვადა / DATE OF EXPIRY", F.col("expiry_date"),
        "პასპორტის № / PASSPORT No", F.col("card_number"),
        F.when(zone, damaged), F.when(zone, F.col("page_row2")),
    )


# Upright page size of the word grid.
PAGE_W, PAGE_H = 1200, 1600


def annotation(text: Column, turn: Column) -> Column:
    """OCR tree of a text on a grid (40 px a line, 12 px a character), photographed
    with the page turned by 0, 90, 180 or 270 degrees."""

    def vertex(x: Column, y: Column) -> Column:
        return F.struct(
            F.when(turn == 90, PAGE_H - y).when(turn == 180, PAGE_W - x).when(turn == 270, y)
            .otherwise(x).cast("int").alias("x"),
            F.when(turn == 90, x).when(turn == 180, PAGE_H - y).when(turn == 270, PAGE_W - x)
            .otherwise(y).cast("int").alias("y"),
        )

    def word(w: Column, left: Column, y: Column) -> Column:
        # the ends are bound: each of the four vertices would measure the words before again
        vertices = let(
            left,
            lambda x: let(
                x + F.length(w) * 12,
                lambda right: F.array(vertex(x, y), vertex(right, y), vertex(right, y + 30), vertex(x, y + 30)),
            ),
        )
        return F.struct(
            vertices.alias("vertices"),
            F.transform(F.split(w, ""), lambda s: F.struct(s.alias("text"))).alias("symbols"),
        )

    def line(l: Column, i: Column) -> Column:
        left = lambda words, j: 50 + 12 * F.length(F.concat_ws(" ", F.slice(words, F.lit(1), j), F.lit("")))
        # split once, not for every word
        boxes = lambda words: F.transform(
            words, lambda w, j: word(w, F.when(j == 0, F.lit(50)).otherwise(left(words, j)), 60 + i * 40)
        )
        return F.struct(let(F.split(l, " "), boxes).alias("words"))

    sideways = turn.isin(90, 270)
    paragraphs = F.transform(F.split(text, "\n"), line)
    return F.array(
        F.struct(
            F.when(sideways, PAGE_H).otherwise(PAGE_W).cast("int").alias("width"),
            F.when(sideways, PAGE_W).otherwise(PAGE_H).cast("int").alias("height"),
            F.array(F.struct(paragraphs.alias("paragraphs"))).alias("blocks"),
        )
    )


def captures_of(
    t: DataFrame, kind: str, side: str, text: Column, minute: int = 0, turned: bool = True
) -> DataFrame:
    """One capture per row of TRUTH; every third has no annotation, the others are turned
    by (k % 4) quarter turns unless `turned` is off."""
    turn = F.col("k") % 4 * 90 if turned else F.lit(0)
    taken = F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, k + {minute}, 0)")
    return t.withColumn("full_text", text).select(
        F.col("k").alias("submission_id"),
        F.lit(kind).alias("kind"),
        F.lit(side).alias("side"),
        taken.alias("captured_at"),
        "full_text",
        F.when(turn.isin(90, 270), PAGE_H).otherwise(PAGE_W).cast("int").alias("page_w"),
        F.when(turn.isin(90, 270), PAGE_W).otherwise(PAGE_H).cast("int").alias("page_h"),
        F.when(F.col("k") % 3 != 0, annotation(F.col("full_text"), turn)).alias("pages"),
    )


def card_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front and back of every customer; every 4th back also has an older, useless take."""
    t = truth(spark, sf_dir)
    retaken = t.filter("k % 4 = 1")
    return (
        captures_of(t, "id", "front", front_text(), 0)
        .unionByName(captures_of(t, "id", "back", back_text(), 5))
        .unionByName(captures_of(retaken, "id", "back", F.lit("IDENTITY CARD"), 1))
    )


def passport_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures_of(truth(spark, sf_dir), "passport", "page", page_text(), 0)
