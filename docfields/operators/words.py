"""Operators over word tables (one row per word box).

For pages that are too large to be an array in a row, or whose words already are a table. The order of words is made by ranges, so a page of a
million words spreads over tasks; what a word needs of the words before its block of a range is carried over from the ends of the blocks, one row each.
Neighbours in space meet in an equi-join of grid cells; a choice per page is an aggregate with partial results.
Each function gives what its twin over arrays in `functions.geometry` gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.functions import patterns as P
from docfields.functions.dates import find_dates, passport_dates
from docfields.functions.geometry import is_issue_title, row_readings
from docfields.functions.text import extract, ocr_digits
from docfields.sources.tables import stored

DOC = ["submission_id", "side"]
#: Blocks of a range have 2 to the power of so many rows: a window holds a block, and up to 4,096 rows it holds without a sorter of its own.
BLOCK = 12


# ---------------------------------------------------------------- runs of neighbours in an order
def islands(rows: DataFrame, order: list[str], seen: list[str], begins: Callable[[Column], Column]) -> DataFrame:
    """`rows` with `island` (number within the document) and `place` (within the island), both from 0, in the order of the unique
    columns `order`. An island begins with a document, or where `begins`, told the columns `seen` of the row before, says so.

    Rows are sorted by ranges, and ranges cut into blocks. Within a block, counts run on; the last row of each block and its counts are carried to the next one.
    """
    names = rows.columns
    ranges = rows.repartitionByRange(*DOC, *order).sortWithinPartitions(*DOC, *order)
    at = F.col("__at")
    placed = stored(ranges.withColumn("__at", F.monotonically_increasing_id()), "sorted").withColumns(
        {"__part": F.shiftright(at, BLOCK), "__i": at.bitwiseAND(2**BLOCK - 1)}
    )
    in_order, run = Window.partitionBy("__part").orderBy("__at"), Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    ranks = Window.orderBy("__part")  # over one row per block
    row = F.struct(*DOC, *seen)
    ends = placed.groupBy("__part").agg(F.max_by(row, "__at").alias("end")).select("__part", F.lag("end").over(ranks).alias("__end"))
    before = placed.join(F.broadcast(ends), "__part").withColumn("__before", F.coalesce(F.lag(row).over(in_order), F.col("__end")))
    fresh = F.col("__before").isNull() | ~(F.col(DOC[0]).eqNullSafe(F.col("__before")[DOC[0]]) & F.col(DOC[1]).eqNullSafe(F.col("__before")[DOC[1]]))
    marked = before.withColumn("__fresh", fresh).withColumn("__starts", F.col("__fresh") | F.coalesce(begins(F.col("__before")), F.lit(False)))
    counted = (
        marked.withColumn("__n", F.sum(F.col("__starts").cast("long")).over(run))
        .withColumn("__base", F.last(F.when(F.col("__fresh"), F.col("__n") - 1), True).over(run))
        .withColumn("__from", F.last(F.when(F.col("__starts"), F.col("__i")), True).over(run))
    )
    # counts at the end of each block, running on through blocks without a start of their own
    last = counted.groupBy("__part").agg(
        F.max("__n").alias("n"), F.max("__i").alias("i"), F.max_by("__base", "__at").alias("base"), F.max_by("__from", "__at").alias("from")
    )

    def carried(own: Column, whole: Column, group: str) -> Column:
        """Sum of `whole` since the block that has a count of its `own`."""
        upto = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
        return F.sum(F.coalesce(own, whole)).over(upto)

    groups = last.withColumns({f"g_{c}": F.sum(F.col(c).isNotNull().cast("int")).over(ranks) for c in ("base", "from")})
    sums = groups.withColumns(
        {
            "islands": carried(F.col("n") - 1 - F.col("base"), F.col("n"), "g_base"),
            "places": carried(F.col("i") - F.col("from"), F.col("i") + 1, "g_from"),
        }
    ).select("__part", F.lag("islands").over(ranks).alias("__islands"), F.lag("places").over(ranks).alias("__places"))
    return counted.join(F.broadcast(sums), "__part").select(
        *names,
        F.coalesce(F.col("__n") - 1 - F.col("__base"), F.col("__islands") + F.col("__n")).alias("island"),
        F.coalesce(F.col("__i") - F.col("__from"), F.col("__places") + F.col("__i") + 1).alias("place"),
    )


def _in_place(text: str = "text") -> Column:
    """Texts of an island in its order, as an aggregate."""
    return F.array_join(F.array_sort(F.collect_list(F.struct("place", text)))[text], " ")


def words_to_rows(words: DataFrame, bucket: Column, gap: Column) -> DataFrame:
    """Words with `row_no` and `place`: ordered by (rounded line bucket, x); a row ends where the vertical step exceeds `gap`.
    `bucket` and `gap` are expressions over the words."""
    lined = words.withColumns({"line": F.rint(F.col("cy") / bucket), "gap": gap})
    rows = islands(lined, ["line", "cx", "word_id"], ["cy"], lambda before: F.abs(F.col("cy") - before["cy"]) > F.col("gap"))
    return rows.withColumnRenamed("island", "row_no").drop("line", "gap")


def row_texts(rows: DataFrame) -> DataFrame:
    """submission_id, side, row_no, text, cx and cy (of the first word) of each row of `words_to_rows`."""
    return rows.groupBy(*DOC, "row_no").agg(_in_place().alias("text"), F.min_by("cx", "place").alias("cx"), F.min_by("cy", "place").alias("cy"))


# ---------------------------------------------------------------- digit fragments
def number_boxes(words: DataFrame) -> DataFrame:
    """submission_id, side, box_no, digits, cx, cy: digit fragments of nine or more, a neighbour on the row glued to a fragment of less than 11.

    Two fragments have 18 digits, so no third one joins them: of each run of fragments that could be glued, the first and second, the
    third and fourth, and so on, are one box.
    """
    plain = F.regexp_replace("text", "[^0-9]", "")
    numbers = words.select(*DOC, "word_id", "x1", "x2", "cx", "cy", (F.col("y2") - F.col("y1")).alias("h"), F.when(F.length(plain) >= 9, plain).otherwise(ocr_digits(F.col("text"))).alias("digits"))

    def apart(b: Column) -> Column:
        joins = (F.abs(b["cy"] - F.col("cy")) < F.greatest(F.lit(12.0), b["h"] * 0.6)) & (F.col("x1") - b["x2"] < 40) & (F.length(b["digits"]) < 11)
        return ~joins

    runs = islands(numbers.filter(F.length("digits") >= 9), ["cy", "cx", "word_id"], ["cy", "h", "x2", "digits"], apart)
    box = F.struct("digits", "x1", "x2", "cx", "cy")
    pairs = runs.groupBy(*DOC, "island", F.floor(F.col("place") / 2).alias("pair")).agg(
        F.max(F.when(F.col("place") % 2 == 0, box)).alias("a"), F.max(F.when(F.col("place") % 2 == 1, box)).alias("b")
    )
    return pairs.select(
        *DOC, F.struct("island", "pair").alias("box_no"), F.concat(F.col("a.digits"), F.coalesce(F.col("b.digits"), F.lit(""))).alias("digits"),
        F.coalesce((F.col("a.x1") + F.col("b.x2")) / 2, F.col("a.cx")).alias("cx"), F.col("a.cy").alias("cy"),
    )


def layout_personal_id(words: DataFrame) -> DataFrame:
    """submission_id, side, personal_id: eleven digits under the right-most personal-number title of a page, else the right-most ones."""
    titles = words.filter(F.col("text").rlike(P.PERSONAL_TITLE_WORD)).groupBy(*DOC).agg(
        F.max_by(F.struct("cx", "cy"), F.struct(F.col("cx"), -F.col("word_id"))).alias("title")
    )
    boxes = number_boxes(words).filter(F.length("digits") >= 11).join(titles, DOC, "left")
    first = F.struct((-F.col("box_no.island")).alias("i"), (-F.col("box_no.pair")).alias("p"))
    dx, dy = F.abs(F.col("cx") - F.col("title.cx")), F.col("cy") - F.col("title.cy")
    score = -dx * 2 - F.abs(dy) * 0.3 + F.col("cx") * 0.01
    digits = F.coalesce(extract(F.col("digits"), "([01][0-9]{10})", 1), F.left(F.col("digits"), F.lit(11)))
    best = boxes.withColumn("id", digits).groupBy(*DOC).agg(
        F.max_by("id", F.when(dy >= -20, F.struct(score.alias("k"), first.alias("f")))).alias("near"),
        F.max_by("id", F.struct(F.col("cx").alias("k"), first.alias("f"))).alias("right"),
    )
    return best.select(*DOC, F.coalesce("near", "right").alias("personal_id"))


# ---------------------------------------------------------------- neighbours in space
def same_row_texts(anchors: DataFrame, words: DataFrame, reach: float, least: float) -> DataFrame:
    """submission_id, side, word_id, row: texts of all words whose centre is within `reach` heights of an anchor word, in word order.

    Each anchor asks in the cells of a grid whose height is the power of two above its reach, two of them at most; words lie in one
    cell of each grid that is in use.
    """
    radius = F.greatest(F.lit(least), F.col("y2") - F.col("y1")) * reach
    asked = anchors.select(*DOC, "word_id", F.col("cy").alias("at"), radius.alias("radius")).withColumn("grid", F.ceil(F.log2(F.col("radius") * 2)).cast("int"))
    cell = lambda y: F.floor(y / F.pow(F.lit(2.0), F.col("grid")))
    asked = asked.withColumn("cell", F.explode(F.sequence(cell(F.col("at") - F.col("radius")), cell(F.col("at") + F.col("radius")))))
    grids = F.array(*[F.lit(r.grid) for r in asked.select("grid").distinct().collect()]).cast("array<int>")  # exponents of two
    lying = words.select(*DOC, F.col("word_id").alias("near_id"), "text", "cy", F.explode(grids).alias("grid")).withColumn("cell", cell(F.col("cy")))
    near = asked.join(lying, [*DOC, "grid", "cell"]).filter(F.abs(F.col("cy") - F.col("at")) < F.col("radius"))
    return near.groupBy(*DOC, "word_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("near_id", "text")))["text"], " ").alias("row"))


def card_issue_date(words: DataFrame) -> DataFrame:
    """submission_id, side, issue_date: the date nearest to the top-most issue title of a card back, read from a word or from a row."""
    title = words.filter(is_issue_title(F.col("text"))).groupBy(*DOC).agg(
        F.min_by(F.struct("cx", "cy", F.greatest(F.lit(14.0), F.col("y2") - F.col("y1")).alias("h")), F.struct("cy", "word_id")).alias("a")
    )
    dy, height = F.col("cy") - F.col("a.cy"), F.col("a.h")
    around = words.join(title, DOC)
    dated = lambda df, dates, dist, order: df.select(*DOC, dist.alias("dist"), order.alias("order"), F.posexplode(dates).alias("i", "date"))
    near = around.filter((dy >= -height * 0.4) & (dy <= height * 8))
    far = F.abs(dy) + 0.25 * F.abs(F.col("cx") - F.col("a.cx"))
    single = dated(near, find_dates(F.col("text")), far, F.struct(F.lit(0).alias("kind"), F.col("word_id").cast("long").alias("n")))
    band = around.filter((dy >= -height * 0.3) & (dy <= height * 5)).drop("a").join(title, DOC)
    rows = row_texts(words_to_rows(band, F.greatest(F.lit(8.0), height * 0.55), height * 0.55)).join(title, DOC)
    readings = F.flatten(F.transform(row_readings(F.col("text")), find_dates))
    whole = dated(rows, readings, F.abs(dy), F.struct(F.lit(1).alias("kind"), F.col("row_no").cast("long").alias("n")))
    best = single.unionByName(whole).groupBy(*DOC).agg(F.min_by("date", F.struct("dist", "order", "i")).alias("issue_date"))
    return best


def above_mrz(words: DataFrame) -> DataFrame:
    """Words above the machine-readable band (the lowest 22 % of a page); all words of pages that have none there."""
    limits = words.groupBy(*DOC).agg(F.min("y1").alias("top"), F.max("y2").alias("bottom"))
    upper = words.join(limits, DOC).filter(F.col("cy") < F.col("top") + (F.col("bottom") - F.col("top")) * 0.78).select(*words.columns)
    return upper.unionByName(words.join(upper.select(*DOC).distinct(), DOC, "left_anti").select(*words.columns))


def passport_issue_date(words: DataFrame) -> DataFrame:
    """submission_id, side, issue_date: by position on a passport page, near the lowest issue title, else near an issue title under the
    birth place, else under the birth place itself."""
    visual = stored(above_mrz(words), "visual")
    text, low = F.col("text"), F.lower("text")
    georgian, damaged = text.rlike("გაცემ|თარიღ"), low.rlike("issue|issl|issuc|lssue|late")
    named = text.rlike(P.PASSPORT_ISSUE_TITLE)

    def with_row(may: Column, reach: float) -> DataFrame:
        """Words that may be titles, with the texts beside them."""
        found = visual.filter(may)
        return found.join(same_row_texts(found, visual, reach, 12.0), [*DOC, "word_id"])

    row, low_row = F.col("row"), F.lower("row")
    is_issue = F.when(georgian, row.contains("გაცემ") | row.rlike(P.PASSPORT_ISSUE_TITLE)).otherwise(
        ~low.contains("author") & (named | (damaged & low_row.rlike("issue|issl|გაცემ")))
    )
    is_place = text.contains("ადგილ") | (low.contains("place") & low.contains("birth")) | (
        text.contains("დაბადების") & (row.contains("ადგილ") | low_row.contains("place") | ~(row.contains("თარიღ") | low_row.contains("date")))
    )
    box = F.struct("cx", "cy", F.greatest(F.lit(12.0), F.col("y2") - F.col("y1")).alias("h"))
    lowest = F.max_by(box, F.struct(F.col("cy"), -F.col("word_id"))).alias("a")
    topmost = F.min_by(box, F.struct("cy", "word_id")).alias("a")
    issue = with_row(georgian | named | damaged, 0.7).filter(is_issue).groupBy(*DOC).agg(lowest)
    place = with_row(text.contains("ადგილ") | low.contains("place") | text.contains("დაბადების"), 0.8).filter(is_place).groupBy(*DOC).agg(topmost)
    below = visual.filter(text.contains("გაცემ") | low.rlike("issue|issl")).join(place.withColumnRenamed("a", "p"), DOC)
    under = below.filter(F.col("cy") > F.col("p.cy") + F.col("p.h") * 0.3).groupBy(*DOC).agg(topmost)
    tiers = [
        anchors.select(*DOC, "a", F.lit(tier).alias("tier"), F.lit(tier > 0).alias("below_only"), F.lit(rows).alias("rows"))
        for tier, (anchors, rows) in enumerate(((issue, 6), (under, 4), (place, 10)))
    ]
    # each search of a page is a page of its own until its dates are found
    searches = stored(tiers[0].unionByName(tiers[1]).unionByName(tiers[2]), "searches")
    of = F.concat(F.col("side"), F.lit("#"), F.col("tier").cast("string"))
    dy, dx, height = F.col("cy") - F.col("a.cy"), F.col("cx") - F.col("a.cx"), F.col("a.h")
    band = visual.join(searches, DOC).filter((dy >= -height * 0.45) & (dy <= height * F.col("rows"))).withColumn("side", of)
    lined = row_texts(words_to_rows(band, F.greatest(F.lit(6.0), height * 0.5), height * 0.55))
    rows = lined.join(searches.withColumn("side", of), DOC)
    same = F.abs(dy) < height * 0.55
    dist = (
        F.abs(dy) + 0.12 * F.abs(dx) + F.when(same & (dx >= -20), -25.0).otherwise(0.0)
        + F.when(same & F.col("below_only"), 15.0).otherwise(0.0) + F.col("row_no") * 2
    )
    dates = F.flatten(F.transform(row_readings(F.col("text")), passport_dates))
    found = rows.select("submission_id", F.substring_index("side", "#", 1).alias("side"), "tier", "row_no", dist.alias("dist"), F.posexplode(dates).alias("i", "date"))
    return found.groupBy(*DOC).agg(F.min_by("date", F.struct("tier", "dist", "row_no", "i")).alias("issue_date"))
