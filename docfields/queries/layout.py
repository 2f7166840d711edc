"""Word boxes: annotation trees, rows, values by position, portrait regions."""

from pyspark.sql import functions as F

from docfields.functions import geometry as G
from docfields.functions import regions as R
from docfields.functions import text as T
from docfields.operators import regions as OR
from docfields.operators import words as OW
from docfields.operators.captures import flatten_annotation as flatten
from docfields.queries.base import N_BACK, N_FRONT, annotated, expect, joined, query
from docfields.sources import samples
from docfields.sources.tables import stored

C = F.col
HAS_BOXES = "k % 3 <> 0"


def _zone_doc():
    return joined(C("row1"), C("row2"), C("row3"))


def _small_doc():
    return joined(
        F.concat_ws(" ", "surname", "given"), F.concat_ws(" ", "place_lat", "issue_date"), C("personal_id")
    )


_WORD = (
    "{no} AS word_id, {row} AS text, 50e0 AS x1, 60e0 + 40 * {no} AS y1, 410e0 AS x2, 90e0 + 40 * {no} AS y2, "
    "230e0 AS cx, 75e0 + 40 * {no} AS cy"
)


@query(
    "flatten_annotation",
    f"WITH t AS ({samples.TRUTH}) "
    + " UNION ALL ".join(
        f"SELECT k AS submission_id, 'back' AS side, {_WORD.format(no=i, row=f'row{i + 1}')} FROM t WHERE {HAS_BOXES}"
        for i in range(3)
    ),
)
def flatten_annotation(spark, sf_dir):
    t = samples.truth(spark, sf_dir)
    return flatten(samples.captures_of(t, "id", "back", _zone_doc()))


@query(
    "page_rotation",
    expect(f"k AS submission_id, CASE WHEN {HAS_BOXES} THEN (k % 4) * 90 ELSE 0 END AS rotation"),
)
def page_rotation(spark, sf_dir):
    return annotated(spark, sf_dir, samples.back_text()).select("submission_id", "rotation")


@query(
    "page_extent",
    expect(f"k AS submission_id, CASE WHEN {HAS_BOXES} THEN 60e0 END AS top, CASE WHEN {HAS_BOXES} THEN 50e0 + 40 * ({N_BACK}) END AS bottom"),
)
def page_extent(spark, sf_dir):
    words = C("words")
    return annotated(spark, sf_dir, samples.back_text()).select(
        "submission_id", F.array_min(words["y1"]).alias("top"), F.array_max(words["y2"]).alias("bottom")
    )


_SMALL_ROWS = ["surname || ' ' || given", "place_lat || ' ' || issue_date", "personal_id"]


@query(
    "words_to_rows",
    f"WITH t AS ({samples.TRUTH}) "
    + " UNION ALL ".join(
        f"SELECT k AS submission_id, {i} AS row_no, {row} AS text FROM t WHERE {HAS_BOXES}"
        for i, row in enumerate(_SMALL_ROWS)
    ),
)
def words_to_rows(spark, sf_dir):
    rows = G.words_to_rows(C("words"), F.lit(16.0), F.lit(16.0))
    docs = annotated(spark, sf_dir, _small_doc())
    return docs.select("submission_id", F.posexplode(F.transform(rows, G.row_text)).alias("row_no", "text"))


@query(
    "same_row_words",
    expect(f"k AS submission_id, CASE WHEN {HAS_BOXES} THEN place_lat || ' ' || issue_date END AS row"),
)
def same_row_words(spark, sf_dir):
    docs = annotated(spark, sf_dir, _small_doc())
    third = C("words")[2]
    return docs.select("submission_id", G.same_row_text(C("words"), third, 0.7, 12.0).alias("row"))


@query(
    "extreme_anchor",
    expect(
        f"k AS submission_id, CASE WHEN {HAS_BOXES} THEN surname END AS top, CASE WHEN {HAS_BOXES} THEN personal_id END AS bottom"
    ),
)
def extreme_anchor(spark, sf_dir):
    docs = annotated(spark, sf_dir, _small_doc())
    by_y = lambda w: w["cy"]
    return docs.select(
        "submission_id",
        T.argmin(C("words"), by_y)["text"].alias("top"),
        T.argmax(C("words"), by_y)["text"].alias("bottom"),
    )


@query("visual_zone", expect(f"k AS submission_id, CASE WHEN {HAS_BOXES} THEN 4 END AS kept"))
def visual_zone(spark, sf_dir):
    docs = annotated(spark, sf_dir, _small_doc())
    return docs.select("submission_id", F.size(G.above_mrz(C("words"))).alias("kept"))


@query(
    "merge_digit_runs",
    expect(
        f"k AS submission_id, CASE WHEN {HAS_BOXES} THEN left(personal_id, 9) || right(personal_id, 9) END AS glued, "
        f"CASE WHEN {HAS_BOXES} THEN '9' || left(personal_id, 8) END AS apart",
    ),
)
def merge_digit_runs(spark, sf_dir):
    pid = C("personal_id")
    text = F.concat_ws(
        " ", F.left(pid, F.lit(9)), F.right(pid, F.lit(9)), F.concat(F.lit("9"), F.left(pid, F.lit(8)))
    )
    boxes = G.number_boxes(C("words"))["digits"]
    docs = annotated(spark, sf_dir, text).withColumn("d", boxes)
    return docs.select("submission_id", C("d")[0].alias("glued"), C("d")[1].alias("apart"))


@query(
    "value_under_label_box",
    expect(f"k AS submission_id, CASE WHEN {HAS_BOXES} THEN personal_id END AS personal_id"),
)
def value_under_label_box(spark, sf_dir):
    docs = annotated(spark, sf_dir, samples.front_text(), "front")
    return docs.select("submission_id", G.layout_personal_id(C("words")).alias("personal_id"))


@query(
    "issue_date_near_label",
    expect(f"k AS submission_id, CASE WHEN {HAS_BOXES} THEN issue_date END AS issue_date"),
)
def issue_date_near_label(spark, sf_dir):
    docs = annotated(spark, sf_dir, samples.back_text())
    return docs.select("submission_id", T.first(G.card_issue_dates(C("words"))).alias("issue_date"))


@query(
    "passport_issue_near_anchor",
    expect(f"k AS submission_id, CASE WHEN {HAS_BOXES} AND has_zone THEN issue_date END AS issue_date"),
)
def passport_issue_near_anchor(spark, sf_dir):
    # without the zone at the bottom the date line itself falls into the band left out
    docs = annotated(spark, sf_dir, samples.page_text())
    return docs.select("submission_id", T.first(G.passport_issue_dates(C("words"))).alias("issue_date"))


@query(
    "rotate_box",
    expect(
        "k AS submission_id, CASE k % 4 WHEN 0 THEN 10e0 WHEN 1 THEN 20e0 WHEN 2 THEN 900e0 - k % 50 ELSE 1940e0 END AS x1, "
        "CASE k % 4 WHEN 0 THEN 20e0 WHEN 1 THEN 900e0 - k % 50 WHEN 2 THEN 1940e0 ELSE 10e0 END AS y1, "
        "CASE k % 4 WHEN 0 THEN 100e0 + k % 50 WHEN 1 THEN 60e0 WHEN 2 THEN 990e0 ELSE 1980e0 END AS x2, "
        "CASE k % 4 WHEN 0 THEN 60e0 WHEN 1 THEN 990e0 WHEN 2 THEN 1980e0 ELSE 100e0 + k % 50 END AS y2"
    ),
)
def rotate_box(spark, sf_dir):
    t = samples.truth(spark, sf_dir).select(C("k").alias("submission_id"))
    k = C("submission_id")
    sides = {"x1": F.lit(10.0), "y1": F.lit(20.0), "x2": 100.0 + k % 50, "y2": F.lit(60.0)}
    raw = F.struct(
        F.lit("w").alias("text"), *[c.cast("double").alias(n) for n, c in sides.items()],
        F.lit(1000.0).alias("page_w"), F.lit(2000.0).alias("page_h"),
    )
    turned = t.withColumn("b", T.let(raw, lambda b: G.turn_box(b, k % 4 * 90)))
    return turned.select("submission_id", "b.x1", "b.y1", "b.x2", "b.y2")


# ---------------------------------------------------------------- portrait regions
def _fronts(spark, sf_dir):
    t = samples.truth(spark, sf_dir)
    return samples.captures_of(t, "id", "front", samples.front_text())


def _faces(spark, sf_dir):
    """No face for every 4th document, else up to three boxes."""
    t = samples.truth(spark, sf_dir).filter("k % 4 <> 0").select(C("k").alias("submission_id"))
    k = C("submission_id")
    rows = t.withColumn("face_id", F.explode(F.sequence(F.lit(0), (k % 3).cast("int"))))
    x0, y0 = 100 + C("face_id") * 300, 300 + (k % 7) * 10
    size = 90 + (k * 7 + C("face_id") * 13) % 60
    return rows.select(
        "submission_id", "face_id",
        *[c.cast("int").alias(n) for n, c in (("x0", x0), ("y0", y0), ("x1", x0 + size), ("y1", y0 + size))],
    )


_FACES = (
    ", f AS (SELECT k AS submission_id, cast(i AS int) AS face_id, 100 + i * 300 AS x0, 300 + (k % 7) * 10 AS y0, "
    "90 + (k * 7 + i * 13) % 60 AS size FROM t, (SELECT unnest([0, 1, 2]) AS i) AS ids WHERE k % 4 <> 0 AND i <= k % 3)"
)


@query(
    "largest_face",
    f"WITH t AS ({samples.TRUTH}){_FACES}, r AS (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY "
    "(x0 + x0 + size) / 2e0 < 1000 * 0.55 DESC, size * size DESC, face_id) AS rn FROM f) "
    "SELECT k AS submission_id, x0, y0, x0 + size AS x1, y0 + size AS y1 FROM t LEFT JOIN r ON k = submission_id AND rn = 1",
)
def largest_face(spark, sf_dir):
    faces = _faces(spark, sf_dir)
    pages = samples.truth(spark, sf_dir).select(C("k").alias("submission_id"), F.lit(1000).alias("w"))
    best = OR.largest_face(pages, faces)
    return best.select("submission_id", *[C(f"face.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])


# the card-number title is the last but one line of a front, the header line the first
_BOTTOM = f"CASE WHEN {HAS_BOXES} THEN cast(60 + 40 * ({N_FRONT} - 2) - 16 AS int) END AS bottom"


@query(
    "plate_limits",
    expect(f"k AS submission_id, 208 AS top, {_BOTTOM}"),
)
def plate_limits(spark, sf_dir):
    t = samples.truth(spark, sf_dir)
    limits = OR.plate_limits(samples.captures_of(t, "id", "front", samples.front_text(), turned=False))
    return limits.select("submission_id", "top", "bottom")


@query(
    "clamp_box",
    expect(
        "k, greatest(0, least(k % 300 - 50, 199)) AS x0, greatest(0, least(k % 90 - 10, 99)) AS y0, "
        "greatest(greatest(0, least(k % 300 - 50, 199)) + 1, least(k % 300 + 30, 200)) AS x1, "
        "greatest(greatest(0, least(k % 90 - 10, 99)) + 1, least(k % 90 + 40, 100)) AS y1"
    ),
)
def clamp_box(spark, sf_dir):
    k = C("k")
    t = samples.truth(spark, sf_dir).select("k")
    raw = R.box(k % 300 - 50, k % 90 - 10, k % 300 + 30, k % 90 + 40)
    clamped = t.withColumn("b", T.let(raw, lambda b: R.clamp_box(b, F.lit(200), F.lit(100))))
    return clamped.select("k", *[C(f"b.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])


# a 3:4 box of 60 x 80 around a centre that may lie near an edge of a 400 x 300 image
_FIT = (
    "round_even(k % 400 - 30e0, 0) AS fx, round_even(k % 300 - 40e0, 0) AS fy"
)


@query(
    "fit_aspect",
    f"WITH t AS ({samples.TRUTH}), p AS (SELECT k, {_FIT} FROM t), "
    "q AS (SELECT k, greatest(fx, 0) AS ax, greatest(fy, 0) AS ay, fx + 60 - least(fx, 0) AS bx, "
    "fy + 80 - least(fy, 0) AS by_ FROM p) "
    "SELECT k, cast(greatest(0, least(ax - greatest(bx - 400, 0), 399)) AS bigint) AS x0, "
    "cast(greatest(0, least(ay - greatest(by_ - 300, 0), 299)) AS bigint) AS y0, "
    "cast(least(bx, 400) AS bigint) AS x1, cast(least(by_, 300) AS bigint) AS y1 FROM q",
)
def fit_aspect(spark, sf_dir):
    k = C("k")
    t = samples.truth(spark, sf_dir).select("k")
    fitted = R.fit_aspect(
        k % 400 + 0.0, k % 300 + 0.0, F.lit(60.0), F.lit(200.0), F.lit(400), F.lit(300)
    )
    return t.withColumn("b", fitted).select(
        "k", *[C(f"b.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")]
    )


# Face, page and limits as functions of k, then the same arithmetic step by step.
_FACE = (
    ", g AS (SELECT k, 200 + k % 300 AS x0, 250 + k % 200 AS y0, 320 + k % 300 + k % 60 AS x1, "
    "400 + k % 200 + k % 50 AS y1, 1000 + k % 200 AS w, 1400 AS h, CASE WHEN k % 3 <> 0 THEN 180 END AS top, "
    "CASE WHEN k % 4 <> 0 THEN 700 + k % 100 END AS bottom FROM t)"
)
# keeps a box (bx0, by0, bx1, by1) around cx between top and bottom of a w x h page
_LIMITED = (
    ", l1 AS (SELECT *, greatest(by0, coalesce(top, by0)) AS ty FROM boxed), "
    "l2 AS (SELECT *, CASE WHEN bottom > ty + 40 THEN least(by1, bottom) ELSE by1 END AS ey FROM l1), "
    "l3 AS (SELECT *, CASE WHEN ey - ty < 20 THEN bx0 ELSE round_even(cx - (ey - ty) * 0.75e0 / 2, 0) END AS lx FROM l2), "
    "l4 AS (SELECT *, CASE WHEN ey - ty < 20 THEN bx1 ELSE round_even(lx + (ey - ty) * 0.75e0, 0) END AS rx FROM l3), "
    "l5 AS (SELECT *, greatest(0, least(lx, w - 1)) AS ox, greatest(0, least(ty, h - 1)) AS oy FROM l4) "
    "SELECT k, cast(ox AS bigint) AS x0, cast(oy AS bigint) AS y0, cast(greatest(ox + 1, least(rx, w)) AS bigint) AS x1, "
    "cast(greatest(oy + 1, least(ey, h)) AS bigint) AS y1 FROM l5"
)


def _boxes(df):
    return df.select("k", *[C(f"b.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])


def _page_limits(spark, sf_dir):
    k = C("k")
    return samples.truth(spark, sf_dir).select("k").withColumns(
        {
            "w": (1000 + k % 200).cast("int"),
            "h": F.lit(1400),
            "top": F.when(k % 3 != 0, 180),
            "bottom": F.when(k % 4 != 0, (700 + k % 100).cast("int")),
        }
    )


_EXPAND = (
    ", s AS (SELECT *, (x0 + x1) / 2e0 AS cx, y0 + (y1 - y0) * 0.48e0 AS cy, "
    "greatest(greatest((x1 - x0) * 1.55e0, w * 0.22e0) / 0.75e0, (y1 - y0) * 2.2e0) AS ph, "
    "greatest(trunc(y0 - (y1 - y0) * 0.28e0), coalesce(top, -100000)) AS min_top FROM g), "
    "f1 AS (SELECT *, least(ph * 0.75e0, w) AS tw, least(ph, h) AS th FROM s), "
    "f2 AS (SELECT * EXCLUDE (tw, th), CASE WHEN tw / greatest(th, 1) > 0.75e0 THEN th * 0.75e0 ELSE tw END AS tw, "
    "CASE WHEN tw / greatest(th, 1) > 0.75e0 THEN th ELSE tw / 0.75e0 END AS th FROM f1), "
    "f3 AS (SELECT *, round_even(cx - tw / 2, 0) AS fx, round_even(cy - th / 2, 0) AS fy FROM f2), "
    "f4 AS (SELECT *, round_even(fx + tw, 0) AS gx, round_even(fy + th, 0) AS gy FROM f3), "
    "f5 AS (SELECT *, greatest(fx, 0) AS ax, greatest(fy, 0) AS ay, gx - least(fx, 0) AS ex, gy - least(fy, 0) AS ez FROM f4), "
    "f6 AS (SELECT *, ax - greatest(ex - w, 0) AS hx, ay - greatest(ez - h, 0) AS hy, least(ex, w) AS ix, least(ez, h) AS iy FROM f5), "
    "f7 AS (SELECT *, greatest(0, least(hx, w - 1)) AS bx0, greatest(0, least(hy, h - 1)) AS cy0 FROM f6), "
    "faced AS (SELECT k, w, h, top, bottom, cx, bx0, greatest(cy0, min_top) AS by0, greatest(bx0 + 1, least(ix, w)) AS bx1, "
    "greatest(cy0 + 1, least(iy, h)) AS by1 FROM f7)"
)
_FALLBACK = (
    ", r AS (SELECT k, w, h, top, bottom, pass, CASE WHEN pass THEN trunc(w * 0.05e0) ELSE trunc(w * 0.045e0) END AS bx0, "
    "CASE WHEN pass THEN w * 0.28e0 ELSE w * 0.30e0 END AS pw, "
    "CASE WHEN pass THEN trunc(h * 0.18e0) ELSE coalesce(top, trunc(h * 0.16e0)) END AS by0, "
    "CASE WHEN pass THEN trunc(h * 0.68e0) ELSE coalesce(bottom, trunc(h * 0.72e0)) END AS y1 FROM p), "
    "r2 AS (SELECT *, (y1 - by0) * 0.75e0 AS narrow, trunc(by0 + pw / 0.75e0) AS stop FROM r), "
    "r3 AS (SELECT *, CASE WHEN narrow < pw THEN y1 WHEN stop > bottom THEN bottom ELSE stop END AS by1, "
    "CASE WHEN narrow < pw THEN narrow WHEN stop > bottom THEN (bottom - by0) * 0.75e0 ELSE pw END AS qw FROM r2), "
    "unfaced AS (SELECT k, w, h, top, bottom, bx0, by0, trunc(bx0 + qw) AS bx1, by1, (bx0 + trunc(bx0 + qw)) / 2e0 AS cx FROM r3)"
)


@query(
    "expand_face",
    f"WITH t AS ({samples.TRUTH}){_FACE}{_EXPAND}, boxed AS (SELECT * FROM faced){_LIMITED}",
)
def expand_face(spark, sf_dir):
    k = C("k")
    face = R.box(200 + k % 300, 250 + k % 200, 320 + k % 300 + k % 60, 400 + k % 200 + k % 50)
    pages = _page_limits(spark, sf_dir)
    return _boxes(pages.withColumn("b", R.expand_face(face, C("w"), C("h"), C("top"), C("bottom"))))


@query(
    "fallback_region",
    f"WITH t AS ({samples.TRUTH}){_FACE}, p AS (SELECT *, k % 2 = 1 AS pass FROM g){_FALLBACK}, "
    f"boxed AS (SELECT * FROM unfaced){_LIMITED}",
)
def fallback_region(spark, sf_dir):
    pages = _page_limits(spark, sf_dir)
    kind = F.when(C("k") % 2 == 1, "passport").otherwise("id")
    return _boxes(pages.withColumn("b", R.fallback_region(kind, C("w"), C("h"), C("top"), C("bottom"))))


@query(
    "vertical_limits",
    f"WITH t AS ({samples.TRUTH}){_FACE}, boxed AS (SELECT k, w, h, top, bottom, x0 AS bx0, y0 - 150 AS by0, x1 AS bx1, "
    f"y1 + 300 AS by1, (x0 + x1) / 2e0 AS cx FROM g){_LIMITED}",
)
def vertical_limits(spark, sf_dir):
    k = C("k")
    plate = R.box(200 + k % 300, 100 + k % 200, 320 + k % 300 + k % 60, 700 + k % 200 + k % 50)
    pages = _page_limits(spark, sf_dir).withColumn("plate", plate)
    centre = (C("plate.x0") + C("plate.x1")) / 2
    kept = R.vertical_limits(C("plate"), centre, C("w"), C("h"), C("top"), C("bottom"))
    return _boxes(pages.withColumn("b", kept))


# whole job on upright fronts: 1200 x 1600 pages, title and card-number label as printed
_PAGE = f"1200 AS w, 1600 AS h, 208 AS top, {_BOTTOM}"


_PORTRAITS = (
    f"WITH t AS ({samples.TRUTH}){_FACES}, best AS (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY "
    "(x0 + x0 + size) / 2e0 < 1200 * 0.55 DESC, size * size DESC, face_id) AS rn FROM f), "
    f"pages AS (SELECT k, {_PAGE} FROM t), "
    "g AS (SELECT pages.*, x0, y0, x0 + size AS x1, y0 + size AS y1 FROM pages JOIN best ON k = submission_id AND rn = 1), "
    "p AS (SELECT *, false AS pass FROM pages WHERE k NOT IN (SELECT k FROM g))"
    f"{_EXPAND}{_FALLBACK}, boxed AS (SELECT k, w, h, top, bottom, cx, bx0, by0, bx1, by1 FROM faced UNION ALL "
    f"SELECT k, w, h, top, bottom, cx, bx0, by0, bx1, by1 FROM unfaced){_LIMITED}"
)


@query("record_portrait", _PORTRAITS)
def record_portrait(spark, sf_dir):
    """The box as part of the record."""
    from docfields.plans.records import with_portraits
    from docfields.queries.records import checked_records

    t = samples.truth(spark, sf_dir)
    fronts = samples.captures_of(t, "id", "front", samples.front_text(), turned=False)
    whole = with_portraits(checked_records(spark, sf_dir), fronts, _faces(spark, sf_dir))
    return whole.select(C("submission_id").alias("k"), *[C(f"portrait.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("portrait_regions", _PORTRAITS)
def portrait_regions(spark, sf_dir):
    t = samples.truth(spark, sf_dir)
    fronts = samples.captures_of(t, "id", "front", samples.front_text(), turned=False)
    regions = OR.portrait_regions(fronts, _faces(spark, sf_dir))
    return regions.select(
        C("submission_id").alias("k"), *[C(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")]
    )


@query("row_text", expect(f"k AS submission_id, CASE WHEN {HAS_BOXES} THEN surname || ' ' || given END AS row"))
def row_text(spark, sf_dir):
    docs = annotated(spark, sf_dir, _small_doc())
    rows = G.words_to_rows(C("words"), F.lit(16.0), F.lit(16.0))
    return docs.select("submission_id", G.row_text(T.first(rows)).alias("row"))


# ---------------------------------------------------------------- the same over word tables
def _word_table(spark, sf_dir, text, side="back"):
    """Operators over word tables read them several times, so the captures are taken apart once."""
    return stored(flatten(samples.captures_of(samples.truth(spark, sf_dir), "id", side, text)), "words")


@query(
    "words_to_rows_table",
    f"WITH t AS ({samples.TRUTH}) "
    + " UNION ALL ".join(f"SELECT k AS submission_id, {i} AS row_no, {row} AS text FROM t WHERE {HAS_BOXES}" for i, row in enumerate(_SMALL_ROWS)),
)
def words_to_rows_table(spark, sf_dir):
    rows = OW.words_to_rows(_word_table(spark, sf_dir, _small_doc()), F.lit(16.0), F.lit(16.0))
    return OW.row_texts(rows).select("submission_id", "row_no", "text")


@query(
    "merge_digit_runs_table",
    expect("k AS submission_id, left(personal_id, 9) || right(personal_id, 9) AS glued, '9' || left(personal_id, 8) AS apart", where=HAS_BOXES),
)
def merge_digit_runs_table(spark, sf_dir):
    pid = C("personal_id")
    text = F.concat_ws(" ", F.left(pid, F.lit(9)), F.right(pid, F.lit(9)), F.concat(F.lit("9"), F.left(pid, F.lit(8))))
    boxes = OW.number_boxes(_word_table(spark, sf_dir, text)).groupBy("submission_id").agg(F.array_sort(F.collect_list(F.struct("box_no", "digits")))["digits"].alias("d"))
    return boxes.select("submission_id", C("d")[0].alias("glued"), C("d")[1].alias("apart"))


@query("same_row_words_table", expect("k AS submission_id, place_lat || ' ' || issue_date AS row", where=HAS_BOXES))
def same_row_words_table(spark, sf_dir):
    words = _word_table(spark, sf_dir, _small_doc())
    return OW.same_row_texts(words.filter("word_id = 2"), words, 0.7, 12.0).select("submission_id", "row")


@query("value_under_label_table", expect("k AS submission_id, personal_id", where=HAS_BOXES))
def value_under_label_table(spark, sf_dir):
    return OW.layout_personal_id(_word_table(spark, sf_dir, samples.front_text(), "front")).select("submission_id", "personal_id")


@query("issue_date_near_label_table", expect("k AS submission_id, issue_date", where=HAS_BOXES))
def issue_date_near_label_table(spark, sf_dir):
    return OW.card_issue_date(_word_table(spark, sf_dir, samples.back_text())).select("submission_id", "issue_date")


@query("passport_issue_near_anchor_table", expect("k AS submission_id, issue_date", where=f"{HAS_BOXES} AND has_zone"))
def passport_issue_near_anchor_table(spark, sf_dir):
    words = _word_table(spark, sf_dir, samples.page_text(), "page")
    return OW.passport_issue_date(words).select("submission_id", "issue_date")
