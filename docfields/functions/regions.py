"""Portrait plate geometry (Column -> Column). A box is struct(x0, y0, x1, y1) of ints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfields.functions import patterns as P
from docfields.functions.text import let

ASPECT = 0.75  # width / height of a printed photo


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    sides = zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1))
    return F.struct(*[c.cast("int").alias(n) for n, c in sides])


def _whole(c: Column) -> Column:
    """Round half to even."""
    return F.rint(c).cast("int")


def clamp_box(b: Column, w: Column, h: Column) -> Column:
    x0 = F.greatest(F.lit(0), F.least(b["x0"], w - 1))
    y0 = F.greatest(F.lit(0), F.least(b["y0"], h - 1))
    return box(
        x0, y0, F.greatest(x0 + 1, F.least(b["x1"], w)), F.greatest(y0 + 1, F.least(b["y1"], h))
    )


def fit_aspect(cx: Column, cy: Column, width: Column, height: Column, w: Column, h: Column) -> Column:
    """3:4 box around a centre, moved inside the image."""

    def sized(v: Column) -> Column:
        wide = v["tw"] / F.greatest(v["th"], F.lit(1.0)) > ASPECT
        return F.struct(
            F.when(wide, v["th"] * ASPECT).otherwise(v["tw"]).alias("tw"),
            F.when(wide, v["th"]).otherwise(v["tw"] / ASPECT).alias("th"),
        )

    def placed(v: Column) -> Column:
        return let(
            F.struct(_whole(cx - v["tw"] / 2).alias("x0"), _whole(cy - v["th"] / 2).alias("y0")),
            lambda p: box(p["x0"], p["y0"], _whole(p["x0"] + v["tw"]), _whole(p["y0"] + v["th"])),
        )

    def inside(b: Column) -> Column:
        # push right/down when it starts outside, then back left/up when it ends outside
        x0, y0 = F.greatest(b["x0"], F.lit(0)), F.greatest(b["y0"], F.lit(0))
        x1, y1 = b["x1"] - F.least(b["x0"], F.lit(0)), b["y1"] - F.least(b["y0"], F.lit(0))
        return box(
            x0 - F.greatest(x1 - w, F.lit(0)), y0 - F.greatest(y1 - h, F.lit(0)),
            F.least(x1, w), F.least(y1, h),
        )

    wanted = F.struct(
        F.least(width, w.cast("double")).alias("tw"), F.least(height, h.cast("double")).alias("th")
    )
    return let(
        let(let(let(wanted, sized), placed), inside), lambda b: clamp_box(b, w, h)
    )


def vertical_limits(b: Column, cx: Column, w: Column, h: Column, top: Column, bottom: Column) -> Column:
    """Keep a box between title and card-number label, width refitted to 3:4."""

    def fit(v: Column) -> Column:
        height = v["y1"] - v["y0"]
        left = _whole(cx - height * ASPECT / 2)
        refit = box(left, v["y0"], _whole(left + height * ASPECT), v["y1"])
        return clamp_box(F.when(height < 20, v).otherwise(refit), w, h)

    y0 = F.greatest(b["y0"], F.coalesce(top, b["y0"]))
    limited = let(
        y0,
        lambda t: box(
            b["x0"], t, b["x1"], F.when(bottom > t + 40, F.least(b["y1"], bottom)).otherwise(b["y1"])
        ),
    )
    return let(limited, fit)


def expand_face(face: Column, w: Column, h: Column, top: Column, bottom: Column) -> Column:
    """Face box -> photo plate with head and upper shoulders."""

    def sizes(f: Column) -> Column:
        fw = F.greatest(F.lit(1), f["x1"] - f["x0"])
        fh = F.greatest(F.lit(1), f["y1"] - f["y0"])
        plate_h = F.greatest(F.greatest(fw * 1.55, w * 0.22) / ASPECT, fh * 2.2)
        return F.struct(
            ((f["x0"] + f["x1"]) / 2).alias("cx"),
            (f["y0"] + fh * 0.48).alias("cy"),
            plate_h.alias("plate_h"),
            F.greatest((f["y0"] - fh * 0.28).cast("int"), F.coalesce(top, F.lit(-(2**31)))).alias("min_top"),
        )

    def plate(s: Column) -> Column:
        fitted = fit_aspect(s["cx"], s["cy"], s["plate_h"] * ASPECT, s["plate_h"], w, h)
        lowered = let(
            fitted, lambda b: box(b["x0"], F.greatest(b["y0"], s["min_top"]), b["x1"], b["y1"])
        )
        return let(lowered, lambda b: vertical_limits(b, s["cx"], w, h, top, bottom))

    return let(let(face, sizes), plate)


def fallback_region(kind: Column, w: Column, h: Column, top: Column, bottom: Column) -> Column:
    """Plate at its usual place when no face is known."""
    passport = kind == "passport"
    bottom_set = F.nullif(bottom, F.lit(0))
    x0 = F.when(passport, (w * 0.05).cast("int")).otherwise((w * 0.045).cast("int"))
    plate_w = F.when(passport, w * 0.28).otherwise(w * 0.30)
    y0 = F.when(passport, (h * 0.18).cast("int")).otherwise(
        F.coalesce(top, (h * 0.16).cast("int"))
    )
    y1 = F.when(passport, (h * 0.68).cast("int")).otherwise(
        F.coalesce(bottom_set, (h * 0.72).cast("int"))
    )

    def sized(v: Column) -> Column:
        narrow = (v["y1"] - v["y0"]) * ASPECT
        cut = let(
            (v["y0"] + v["plate_w"] / ASPECT).cast("int"),
            lambda end: F.when(
                end > bottom_set,
                F.struct(bottom_set.alias("y1"), ((bottom_set - v["y0"]) * ASPECT).alias("pw")),
            ).otherwise(F.struct(end.alias("y1"), v["plate_w"].alias("pw"))),
        )
        fitted = F.when(
            narrow < v["plate_w"], F.struct(v["y1"].alias("y1"), narrow.alias("pw"))
        ).otherwise(cut)
        return let(
            fitted,
            lambda f: clamp_box(
                box(v["x0"], v["y0"], (v["x0"] + f["pw"]).cast("int"), f["y1"]), w, h
            ),
        )

    start = F.struct(
        x0.alias("x0"), y0.alias("y0"), y1.alias("y1"), plate_w.alias("plate_w")
    )
    return let(
        let(start, sized),
        lambda b: vertical_limits(b, (b["x0"] + b["x1"]) / 2, w, h, top, bottom),
    )


# ---------------------------------------------------------------- limits from the text
def _extent(word: Column) -> Column:
    """Box of a word as photographed (not turned upright)."""
    xs, ys = word["vertices"]["x"], word["vertices"]["y"]
    return F.struct(
        ((F.array_min(xs) + F.array_max(xs)) / 2).alias("cx"),
        F.array_min(ys).alias("y0"),
        F.array_max(ys).alias("y1"),
    )


def bottom_limit(tree: Column, text: Column, w: Column, h: Column) -> Column:
    """Just above the card-number title in the left part; NULL without one."""

    def tops(pattern: str) -> Column:
        return F.filter(
            F.transform(F.filter(tree, lambda x: x["text"].rlike(pattern)), _extent),
            lambda e: e["cx"] <= w * 0.55,
        )["y0"]

    named = F.lower(text).rlike("ბარათ|card")
    lowest = F.coalesce(
        F.array_min(tops(P.CARD_NUMBER_TITLE_WORD)), F.when(named, F.array_min(tops("(?iu)card|ბარათ|№")))
    )
    return let(
        lowest, lambda y: F.when(y.isNotNull(), F.greatest(F.lit(0), y - (h * 0.01).cast("int")))
    )


def header_limit(tree: Column, h: Column) -> Column:
    """Just below the title strip at the top; NULL without one."""
    titles = F.filter(
        F.transform(F.filter(tree, lambda x: x["text"].rlike(P.CARD_HEADER_WORD)), _extent),
        lambda e: e["y0"] <= h * 0.28,
    )
    low = F.array_max(titles["y1"])
    return F.when(low.isNotNull(), F.least(h - 1, low + (h * 0.012).cast("int")))
