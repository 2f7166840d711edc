"""Word boxes of one capture: rotation, rows and values found by position.

A word is struct(text, x1, y1, x2, y2, cx, cy); the words of a capture are one array
in reading order. Ties always go to the earlier word.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfields.functions import patterns as P
from docfields.functions.dates import find_dates, passport_dates
from docfields.functions.text import (
    argmax, argmin, extract, first, let, ocr_digits, soft_date, strip,
)

VERTICES = "array<struct<x:int,y:int>>"
WORD_TREE = f"struct<vertices:{VERTICES},symbols:array<struct<text:string>>>"
PAGES = (
    "array<struct<width:int,height:int,blocks:array<struct<paragraphs:array<struct<"
    f"words:array<{WORD_TREE}>>>>>>>"
)
DATED = "array<struct<dist:double,date:string>>"
NUMBER_BOX = "array<struct<digits:string,x1:double,x2:double,cx:double,cy:double,h:double>>"


def _or(*tests: Column) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


# ---------------------------------------------------------------- annotation tree
def whole_vertices(vertices: Column) -> Column:
    """JSON annotations leave out coordinates that are 0; they come back as NULL."""
    left_out = F.exists(vertices, lambda v: v["x"].isNull() | v["y"].isNull())
    zero = F.lit(0)
    return F.when(~left_out, vertices).otherwise(
        F.transform(
            vertices,
            lambda v: F.struct(F.coalesce(v["x"], zero).alias("x"), F.coalesce(v["y"], zero).alias("y")),
        )
    )


def tree_words(pages: Column) -> Column:
    """Page > block > paragraph > word tree as one array of words with the page size."""
    per_page = F.transform(
        pages,
        lambda page: F.transform(
            F.flatten(
                F.transform(
                    page["blocks"],
                    lambda b: F.flatten(b["paragraphs"]["words"]),
                )
            ),
            lambda w: F.struct(
                strip(F.array_join(w["symbols"]["text"], "")).alias("text"),
                whole_vertices(w["vertices"]).alias("vertices"),
                F.coalesce(page["width"], F.lit(0)).alias("page_w"),
                F.coalesce(page["height"], F.lit(0)).alias("page_h"),
            ),
        ),
    )
    return F.flatten(per_page)


def page_rotation(words: Column) -> Column:
    """Turn (0/90/180/270) that brings the text upright: baseline lengths vote, and the
    winner needs 60 % of all votes."""

    def vote(acc: Column, w: Column) -> Column:
        v = w["vertices"]
        step = lambda n: F.get(v, F.lit(1))[n] - F.get(v, F.lit(0))[n]

        def ballot(d: Column) -> Column:
            dx, dy = d["x"], d["y"]
            length = F.sqrt((dx * dx + dy * dy).cast("double"))
            turn = F.when(
                F.abs(dx) >= F.abs(dy), F.when(dx > 0, 0).otherwise(180)
            ).otherwise(F.when(dy > 0, 90).otherwise(270))
            return F.struct(
                F.when((F.size(v) >= 2) & (length >= 1), length).otherwise(0.0).alias("n"),
                turn.alias("turn"),
            )

        # bound step by step: a lambda evaluates an expression wherever it stands
        baseline = F.struct(step("x").alias("x"), step("y").alias("y"))
        return let(
            let(baseline, ballot),
            lambda b: F.struct(
                *[
                    (acc[f"r{t}"] + F.when(b["turn"] == t, b["n"]).otherwise(0.0)).alias(f"r{t}")
                    for t in (0, 90, 180, 270)
                ]
            ),
        )

    none = F.struct(*[F.lit(0.0).alias(f"r{t}") for t in (0, 90, 180, 270)])

    def decide(v: Column) -> Column:
        total = v["r0"] + v["r90"] + v["r180"] + v["r270"]
        won = lambda t: v[f"r{t}"] / F.nullif(total, F.lit(0.0)) >= 0.6
        return F.when(won(90), 90).when(won(180), 180).when(won(270), 270).otherwise(0)

    return F.coalesce(F.aggregate(words, none, vote, decide), F.lit(0))


def word_boxes(tree: Column, rotation: Column) -> Column:
    """Boxes of the non-empty words, turned into the upright frame."""

    def box(w: Column) -> Column:
        xs, ys = w["vertices"]["x"], w["vertices"]["y"]
        return F.struct(
            w["text"].alias("text"),
            *[
                f(c).cast("double").alias(n)
                for n, f, c in (
                    ("x1", F.array_min, xs), ("y1", F.array_min, ys),
                    ("x2", F.array_max, xs), ("y2", F.array_max, ys),
                )
            ],
            w["page_w"].alias("page_w"),
            w["page_h"].alias("page_h"),
        )

    # bound once: the optimizer may put the expression behind a column into the lambda
    return let(
        rotation,
        lambda turn: F.transform(
            F.filter(tree, lambda w: w["text"] != ""),
            lambda w: let(box(w), lambda b: with_centre(turn_box(b, turn))),
        ),
    )


def turn_box(b: Column, rotation: Column) -> Column:
    """Box in the frame the upright photo would have; never left of or above its edge."""

    def flip(size: str, side: str) -> Column:
        return F.greatest(F.lit(0.0), b[size] - b[side])

    def sides(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        named = zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2))
        return F.struct(b["text"].alias("text"), *[c.alias(n) for n, c in named])

    w, h = "page_w", "page_h"
    return (
        F.when(rotation == 0, sides(b["x1"], b["y1"], b["x2"], b["y2"]))
        .when(rotation == 90, sides(b["y1"], flip(w, "x2"), b["y2"], flip(w, "x1")))
        .when(rotation == 180, sides(flip(w, "x2"), flip(h, "y2"), flip(w, "x1"), flip(h, "y1")))
        .otherwise(sides(flip(h, "y2"), b["x1"], flip(h, "y1"), b["x2"]))
    )


def with_centre(box: Column) -> Column:
    return let(
        box,
        lambda b: F.struct(
            *[b[n].alias(n) for n in ("text", "x1", "y1", "x2", "y2")],
            ((b["x1"] + b["x2"]) / 2).alias("cx"),
            ((b["y1"] + b["y2"]) / 2).alias("cy"),
        ),
    )


# ---------------------------------------------------------------- rows of words
def words_to_rows(words: Column, bucket: Column, gap: Column) -> Column:
    """Array of rows: words ordered by (rounded line bucket, x); a row ends where the
    vertical step to the previous word exceeds `gap`."""

    def split(ordered: Column) -> Column:
        def starts_row(i: Column) -> Column:
            step = F.abs(F.get(ordered, i)["w"]["cy"] - F.get(ordered, i - 1)["w"]["cy"])
            return (i == 0) | (step > gap)

        indexes = F.filter(F.transform(ordered, lambda _, i: i), starts_row)
        return let(
            indexes,
            lambda s: F.transform(
                s,
                lambda start, j: F.slice(
                    ordered, start + 1, F.coalesce(F.get(s, j + 1), F.size(ordered)) - start
                )["w"],
            ),
        )

    keyed = F.transform(
        words,
        lambda w, i: F.struct(
            F.rint(w["cy"] / bucket).alias("line"), w["cx"].alias("cx"), i.alias("i"), w.alias("w")
        ),
    )
    return let(F.array_sort(keyed), split)


def row_text(row: Column) -> Column:
    return F.array_join(row["text"], " ")


def row_readings(text: Column) -> Column:
    """A row as read, with look-alike letters softened, and softened without blanks."""
    return let(
        text,
        lambda t: F.array_distinct(
            F.array(t, soft_date(t), F.regexp_replace(soft_date(t), f"[{P.WS}]+", ""))
        ),
    )


def same_row_text(words: Column, word: Column, reach: float, least: float) -> Column:
    """Texts of all words whose centre is within `reach` heights of a word."""
    height = F.greatest(F.lit(least), word["y2"] - word["y1"])
    return row_text(
        F.filter(words, lambda x: F.abs(x["cy"] - word["cy"]) < height * reach)
    )


# ---------------------------------------------------------------- personal number
def number_boxes(words: Column) -> Column:
    """Digit fragments of nine or more, neighbours on a row glued up to 11 digits."""

    def as_number(w: Column) -> Column:
        return let(
            F.regexp_replace(w["text"], "[^0-9]", ""),
            lambda d: F.struct(
                F.when(F.length(d) >= 9, d).otherwise(ocr_digits(w["text"])).alias("digits"),
                *[w[n].alias(n) for n in ("x1", "x2", "cx", "cy")],
                (w["y2"] - w["y1"]).alias("h"),
            ),
        )

    def glue(acc: Column, w: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joins = (
            (F.size(acc) > 0)
            & (F.abs(last["cy"] - w["cy"]) < F.greatest(F.lit(12.0), last["h"] * 0.6))
            & (w["x1"] - last["x2"] < 40)
            & (F.length(last["digits"]) < 11)
        )
        merged = F.struct(
            F.concat(last["digits"], w["digits"]).alias("digits"),
            last["x1"].alias("x1"),
            w["x2"].alias("x2"),
            ((last["x1"] + w["x2"]) / 2).alias("cx"),
            last["cy"].alias("cy"),
            last["h"].alias("h"),
        )
        return F.when(
            joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(merged))
        ).otherwise(F.concat(acc, F.array(w)))

    # no reading of a word has more characters than the word
    long_words = F.filter(words, lambda w: F.length(w["text"]) >= 9)
    numbers = F.filter(F.transform(long_words, as_number), lambda n: F.length(n["digits"]) >= 9)
    ordered = F.array_sort(
        F.transform(
            numbers,
            lambda n, i: F.struct(n["cy"].alias("cy"), n["cx"].alias("cx"), i.alias("i"), n.alias("n")),
        )
    )["n"]
    return F.aggregate(ordered, F.array().cast(NUMBER_BOX), glue)


def layout_personal_id(words: Column) -> Column:
    """Eleven digits under the right-most personal-number title, else the right-most."""

    def pid(box: Column) -> Column:
        return F.coalesce(
            extract(box["digits"], "([01][0-9]{10})", 1), F.left(box["digits"], F.lit(11))
        )

    def pick(v: Column) -> Column:
        boxes, title = v["boxes"], v["title"]
        below = F.filter(boxes, lambda b: b["cy"] - title["cy"] >= -20)
        nearest = argmax(
            below,
            lambda b: -F.abs(b["cx"] - title["cx"]) * 2
            - F.abs(b["cy"] - title["cy"]) * 0.3
            + b["cx"] * 0.01,
        )
        return pid(F.coalesce(F.when(title.isNotNull(), nearest), argmax(boxes, lambda b: b["cx"])))

    titles = F.filter(words, lambda w: w["text"].rlike(P.PERSONAL_TITLE_WORD))
    full = F.filter(number_boxes(words), lambda b: F.length(b["digits"]) >= 11)
    return let(
        F.struct(full.alias("boxes"), argmax(titles, lambda w: w["cx"]).alias("title")), pick
    )


# ---------------------------------------------------------------- issue dates
def _by_distance(hits: Column) -> Column:
    """Dates ordered by distance, earlier finds first among equals."""
    return F.array_sort(
        F.transform(
            hits, lambda h, i: F.struct(h["dist"].alias("dist"), i.alias("i"), h["date"].alias("date"))
        )
    )["date"]


def is_issue_title(text: Column) -> Column:
    """Whether a word belongs to the issue title of a card, misread or not."""
    low = F.lower(text)
    return _or(
        text.contains("გაცემ"), low.contains("issue"), low.contains("issl"), low.contains("issuc"), low.isin("iss", "isu"),
    )


def card_issue_dates(words: Column) -> Column:
    """Dates near the top-most issue title of a card back, nearest first."""

    def hits(a: Column) -> Column:
        height = a["h"]
        near = F.filter(
            words,
            lambda w: (w["cy"] >= a["cy"] - height * 0.4) & (w["cy"] <= a["cy"] + height * 8),
        )
        single = F.flatten(
            F.transform(
                near,
                lambda w: F.transform(
                    find_dates(w["text"]),
                    lambda d: F.struct(
                        (F.abs(w["cy"] - a["cy"]) + 0.25 * F.abs(w["cx"] - a["cx"])).alias("dist"),
                        d.alias("date"),
                    ),
                ),
            )
        )
        band = F.filter(
            words,
            lambda w: (w["cy"] >= a["cy"] - height * 0.3) & (w["cy"] <= a["cy"] + height * 5),
        )
        rows = words_to_rows(band, F.greatest(F.lit(8.0), height * 0.55), height * 0.55)

        def row_hits(row: Column) -> Column:
            dist = F.abs(first(row)["cy"] - a["cy"])
            dates = F.flatten(F.transform(row_readings(row_text(row)), find_dates))
            return F.transform(dates, lambda d: F.struct(dist.alias("dist"), d.alias("date")))

        return _by_distance(
            F.concat(single.cast(DATED), F.flatten(F.transform(rows, row_hits)).cast(DATED))
        )

    anchor = argmin(F.filter(words, lambda w: is_issue_title(w["text"])), lambda w: w["cy"])
    return let(
        let(
            anchor,
            lambda w: F.when(
                w.isNotNull(),
                F.struct(
                    w["cx"].alias("cx"), w["cy"].alias("cy"),
                    F.greatest(F.lit(14.0), w["y2"] - w["y1"]).alias("h"),
                ),
            ),
        ),
        lambda a: F.when(a.isNotNull(), hits(a)),
    )


def above_mrz(words: Column) -> Column:
    """Words above the machine-readable band (the lowest 22 %); all when none is."""
    top, bottom = F.array_min(words["y1"]), F.array_max(words["y2"])
    upper = let(
        top + (bottom - top) * 0.78, lambda cut: F.filter(words, lambda w: w["cy"] < cut)
    )
    return let(upper, lambda u: F.when(F.size(u) > 0, u).otherwise(words))


def passport_issue_dates(words: Column) -> Column:
    """Dates by box position on a passport page: near the lowest issue title, near an
    issue title under the birth place, then under the birth place itself."""

    def height(w: Column) -> Column:
        return F.greatest(F.lit(12.0), w["y2"] - w["y1"])

    def near(visual: Column, search: Column) -> Column:
        a, max_rows, below_only = search["anchor"], search["rows"], search["below_only"]
        rh = height(a)
        band = F.filter(
            visual,
            lambda w: (w["cy"] >= a["cy"] - rh * 0.45) & (w["cy"] <= a["cy"] + rh * max_rows),
        )
        rows = words_to_rows(band, F.greatest(F.lit(6.0), rh * 0.5), rh * 0.55)

        def row_hits(row: Column, index: Column) -> Column:
            head = first(row)
            same = F.abs(head["cy"] - a["cy"]) < rh * 0.55
            bonus = F.when(same & (head["cx"] >= a["cx"] - 20), -25.0).otherwise(0.0)
            malus = F.when(same & below_only, 15.0).otherwise(0.0)
            dist = (
                F.abs(head["cy"] - a["cy"])
                + 0.12 * F.abs(head["cx"] - a["cx"])
                + bonus
                + malus
                + index * 2
            )
            dates = F.flatten(F.transform(row_readings(row_text(row)), passport_dates))
            return F.transform(dates, lambda d: F.struct(dist.alias("dist"), d.alias("date")))

        return _by_distance(F.flatten(F.transform(rows, row_hits)).cast(DATED))

    def is_issue_title(visual: Column, w: Column) -> Column:
        text, low = w["text"], F.lower(w["text"])
        row = lambda: same_row_text(visual, w, 0.7, 12.0)
        georgian = text.rlike("გაცემ|თარიღ")
        named = text.rlike(P.PASSPORT_ISSUE_TITLE)
        damaged = low.rlike("issue|issl|issuc|lssue|late") & F.lower(row()).rlike("issue|issl|გაცემ")
        return F.when(
            georgian, let(row(), lambda t: t.contains("გაცემ") | t.rlike(P.PASSPORT_ISSUE_TITLE))
        ).otherwise(~low.contains("author") & (named | damaged))

    def is_place_title(visual: Column, w: Column) -> Column:
        text, low = w["text"], F.lower(w["text"])
        by_row = let(
            same_row_text(visual, w, 0.8, 12.0),
            lambda t: t.contains("ადგილ")
            | F.lower(t).contains("place")
            | ~(t.contains("თარიღ") | F.lower(t).contains("date")),
        )
        return (
            text.contains("ადგილ")
            | (low.contains("place") & low.contains("birth"))
            | (text.contains("დაბადების") & by_row)
        )

    def tiers(visual: Column) -> Column:
        issue = argmax(F.filter(visual, lambda w: is_issue_title(visual, w)), lambda w: w["cy"])
        place = argmin(F.filter(visual, lambda w: is_place_title(visual, w)), lambda w: w["cy"])

        def under(p: Column) -> Column:
            below = F.filter(
                visual,
                lambda w: (w["cy"] > p["cy"] + height(p) * 0.3)
                & (w["text"].contains("გაცემ") | F.lower(w["text"]).rlike("issue|issl")),
            )
            return argmin(below, lambda w: w["cy"])

        def search(anchor: Column, below_only: bool, rows: int) -> Column:
            return F.struct(
                anchor.alias("anchor"), F.lit(below_only).alias("below_only"), F.lit(rows).alias("rows")
            )

        searches = let(
            place,
            lambda p: F.array(
                search(issue, False, 6), search(under(p), True, 4), search(p, True, 10)
            ),
        )
        usable = F.filter(searches, lambda x: x["anchor"].isNotNull())
        return F.flatten(F.transform(usable, lambda x: near(visual, x)))

    return let(above_mrz(words), tiers)
