"""Portrait regions: where the printed photo of a document is. Boxes only, no pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.functions import regions as R
from docfields.functions.geometry import tree_words


def plate_limits(captures: DataFrame) -> DataFrame:
    """Page size and the limits that title and card-number label set. Narrow. The size is the photo's own
    (`page_w`, `page_h`), else that of the annotation tree."""
    page = F.get(F.col("pages"), F.lit(0))
    w, h = F.col("w"), F.col("h")

    def size(own: str, annotated: Column) -> Column:
        return F.coalesce(F.nullif(F.col(own), F.lit(0)), annotated) if own in captures.columns else annotated

    sized = captures.select(
        "submission_id", "kind", "captured_at", "full_text",
        tree_words(F.col("pages")).alias("tree"),
        size("page_w", page["width"]).alias("w"),
        size("page_h", page["height"]).alias("h"),
    )
    is_card = F.col("kind") == "id"
    floor = (h * 0.13).cast("int")
    return sized.select(
        "submission_id", "kind", "captured_at", "w", "h",
        F.when(is_card, F.greatest(floor, F.coalesce(R.header_limit(F.col("tree"), h), floor))).alias("top"),
        F.when(is_card, R.bottom_limit(F.col("tree"), F.col("full_text"), w, h)).alias("bottom"),
    )


def largest_face(pages: DataFrame, faces: DataFrame) -> DataFrame:
    """Pages with their largest face, faces in the left 55 % first; NULL without a face."""
    area = F.greatest(F.lit(0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0), F.col("y1") - F.col("y0"))
    in_left = (F.col("x0") + F.col("x1")) / 2 < F.col("w") * 0.55
    # faces lead the join so that one document with very many of them can be split
    best = (
        faces.join(pages.select("submission_id", "w"), "submission_id")
        .groupBy("submission_id")
        .agg(
            F.max_by(
                F.struct("x0", "y0", "x1", "y1"), F.struct(in_left, area, -F.col("face_id"))
            ).alias("face")
        )
    )
    return pages.join(best, "submission_id", "left")


def portrait_regions(captures: DataFrame, faces: DataFrame) -> DataFrame:
    """One box per document: the newest front or passport page. Cards use the face when
    there is one; small pages and boxes give none."""
    fronts = captures.filter(
        ((F.col("kind") == "id") & (F.col("side") == "front")) | (F.col("kind") == "passport")
    )
    limits = plate_limits(fronts)
    columns = ["w", "h", "top", "bottom"]
    newest = (
        limits.groupBy("submission_id", "kind")
        .agg(F.max_by(F.struct(*columns), F.struct("captured_at", *columns)).alias("p"))
        .select("submission_id", "kind", "p.*")
        .filter((F.col("w") >= 40) & (F.col("h") >= 40))
    )
    w, h, top, bottom = (F.col(c) for c in columns)
    faced = F.when(
        (F.col("kind") == "id") & F.col("face").isNotNull(),
        R.expand_face(F.col("face"), w, h, top, bottom),
    )
    region = F.coalesce(faced, R.fallback_region(F.col("kind"), w, h, top, bottom))
    boxes = largest_face(newest, faces).select("submission_id", "kind", region.alias("b"))
    big = (F.col("b.x1") - F.col("b.x0") >= 20) & (F.col("b.y1") - F.col("b.y0") >= 20)
    return boxes.filter(big).select("submission_id", "kind", "b.*")
