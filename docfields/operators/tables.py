"""Operators over line and candidate tables (one row per line / candidate).

For callers whose OCR output is already a table of lines. Nothing here sorts or gathers
a whole document in one task: neighbours are fetched by joining on (document, line
number), whose keys are unique, and choices are `min_by` aggregations that shrink in the
map tasks. A document with very many lines therefore spreads like any other data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfields.functions import patterns as P
from docfields.functions import values as V
from docfields.functions.text import (
    clean_value, is_label_only, label_hits, let,
)

DOC = ["submission_id", "side"]
CANDIDATE = ["submission_id", "field", "tier", "pos", "value"]
#: Line numbers that a window sees at once.
BLOCK = 1024


# ---------------------------------------------------------------- neighbours
def neighbours(anchors: DataFrame, lines: DataFrame, start: int, stop: int) -> DataFrame:
    """Anchor lines with the lines `start`..`stop` steps away: anchor columns, step, near.

    An equi-join on exploded targets, not a range join.
    """
    targets = anchors.withColumn(
        "step", F.explode(F.sequence(F.lit(start), F.lit(stop)))
    ).withColumn("target", F.col("line_no") + F.col("step"))
    near = lines.select(*DOC, F.col("line_no").alias("target"), F.col("text").alias("near"))
    return targets.join(near, DOC + ["target"]).drop("target")


def window_text(anchors: DataFrame, lines: DataFrame, start: int, stop: int) -> DataFrame:
    """Anchor lines with the text of the lines around them, in line order, as `window`."""
    near = neighbours(anchors, lines, start, stop)
    parts = near.groupBy(*DOC, "line_no").agg(
        F.array_sort(F.collect_list(F.struct("step", "near"))).alias("parts")
    )
    return parts.select(*DOC, "line_no", F.array_join(F.col("parts.near"), "\n").alias("window"))


def context_lines(anchors: DataFrame, lines: DataFrame, pattern: str, before: int) -> DataFrame:
    """Anchor lines for which the line or one of the `before` lines above matches."""
    hits = neighbours(anchors, lines, -before, 0).filter(F.col("near").rlike(pattern))
    return hits.select(anchors.columns).distinct()


def next_event(anchors: DataFrame, events: DataFrame, block: int = BLOCK) -> DataFrame:
    """Anchor lines (document, line_no) with `event`: that of the first later line of the document in `events` (document, line_no, event);
    NULL when none follows.

    Documents are cut into blocks of `block` line numbers. A running value within each block, from its end, finds events of the same
    block; the first event of the blocks behind it is found on one row per block and carried in by an equi-join. No window sees
    more than a block, or the blocks, of a document.
    """
    at = lambda df, event: df.select(*DOC, "line_no", event.alias("event"), F.floor(F.col("line_no") / block).alias("block"))
    kind = events.schema["event"].dataType
    asked = at(anchors, F.lit(None).cast(kind)).distinct().withColumn("asks", F.lit(True))
    rows = asked.unionByName(at(events, F.col("event")).withColumn("asks", F.lit(False)))
    later = Window.partitionBy(*DOC, "block").orderBy(F.col("line_no").desc()).rangeBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("own", F.last("event", True).over(later)).filter("asks")
    edges = rows.groupBy(*DOC, "block").agg(F.min_by("event", F.when(F.col("event").isNotNull(), F.col("line_no"))).alias("first"))
    behind = Window.partitionBy(*DOC).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(*DOC, "block", F.last("first", True).over(behind).alias("carried"))
    return within.join(carried, [*DOC, "block"]).select(*DOC, "line_no", F.coalesce("own", "carried").alias("event"))


def first_before_stop(anchors: DataFrame, lines: DataFrame, value: Column, stop: str, block: int = BLOCK) -> DataFrame:
    """First value below each anchor line, however far, unless a stop line comes earlier.

    `value` is an expression over `near`, NULL where a line has none. A stop line's own value does not count.
    """
    near = lines.select(*DOC, "line_no", F.col("text").alias("near"))
    stopped = F.coalesce(F.col("near").rlike(stop), F.lit(False))
    seen = near.select(*DOC, "line_no", stopped.alias("stopped"), F.when(~stopped, value).alias("value"))
    events = seen.filter("stopped OR value IS NOT NULL").select(*DOC, "line_no", F.struct("value").alias("event"))
    found = next_event(anchors, events, block)
    return found.select(*DOC, "line_no", F.col("event.value").alias("value")).filter("value IS NOT NULL")


def first_after(lines: DataFrame, anchor: str, skip: str, value: Column) -> DataFrame:
    """First value per document below its first anchor line (below the top when it has
    none); lines matching `skip` do not count. `value` is an expression over `text`."""
    place = lines.groupBy(*DOC).agg(
        F.min(F.when(F.lower("text").rlike(anchor), F.col("line_no"))).alias("anchor_no")
    )
    valued = lines.withColumn("value", value).filter(
        F.col("value").isNotNull() & ~F.lower("text").rlike(skip)
    )
    below = valued.join(place, DOC).filter(F.col("line_no") > F.coalesce(F.col("anchor_no"), F.lit(-1)))
    return below.groupBy(*DOC).agg(F.min_by("value", "line_no").alias("value"))


# ---------------------------------------------------------------- titled values
def labelled_lines(lines: DataFrame, fields=None) -> DataFrame:
    """Lines that carry a field title: one row per line and title, with field and ord."""
    wanted = {f: V.FIELD_LABELS[f] for f in fields or V.FIELD_LABELS}
    titles = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.lit(i).alias("ord"), F.lit(l.lower()).alias("label"))
            for f, ls in wanted.items()
            for i, l in enumerate(ls)
        ]
    )
    hits = let(
        F.lower("text"), lambda low: F.filter(titles, lambda t: low.contains(t["label"]))
    )
    return lines.withColumn("t", F.explode(hits)).select(*lines.columns, "t.*")


def _title_pos(turn: Column, step: Column) -> Column:
    """Order of attempts: line, then title by title; the lines below follow the first title."""
    return F.struct(F.col("line_no"), turn.alias("turn"), step.alias("step")).alias("pos")


def titled_values(lines: DataFrame, fields=None) -> DataFrame:
    """One value per document and field: the first that follows a title of the field, on
    its own line or up to five lines below."""
    def usable(value: Column, least: int) -> Column:
        """The value as zero or one rows; exploding evaluates it once, a filter would not."""
        kept = let(value, lambda v: F.when((F.length(v) >= least) & ~is_label_only(v), v))
        return F.explode(F.array_compact(F.array(kept))).alias("value")

    anchors = labelled_lines(lines, fields)
    rest = F.substring(
        F.col("text"),
        F.position(F.col("label"), F.lower("text")) + F.length("label"),
        F.length("text"),
    )
    own = clean_value(
        F.get(F.split(clean_value(F.regexp_extract(rest, P.AFTER_TITLE, 1)), P.NEXT_TITLE), F.lit(0))
    )
    same = anchors.select("submission_id", "field", "ord", "line_no", usable(own, 2)).select(
        "submission_id", "field", F.lit(0).alias("tier"),
        _title_pos(F.col("ord") * 2, F.lit(0)), "value",
    )
    first_title = anchors.groupBy(*DOC, "line_no", "field").agg(F.min("ord").alias("ord"))
    values = lines.select(*DOC, "line_no", usable(clean_value(F.col("text")), 1)).select(
        *DOC, "line_no", F.col("value").alias("text")
    )
    below = neighbours(first_title, values, 1, 5).select(
        "submission_id", "field", F.lit(0).alias("tier"),
        _title_pos(F.col("ord") * 2 + 1, F.col("step")), F.col("near").alias("value"),
    )
    return best_candidates(candidate_union(same, below))


def documents_with_label(documents: DataFrame, lines: DataFrame, field: str) -> DataFrame:
    """Documents in which any title of the field occurs (semi-join)."""
    hits = labelled_lines(lines, [field]).select(*DOC).distinct()
    return documents.join(hits, DOC, "left_semi")


def documents_with_labels(documents: DataFrame, lines: DataFrame, fields=None) -> DataFrame:
    """Documents with each `field` a title of which occurs in them: one row per document and field, all from one pass over the lines."""
    hits = labelled_lines(lines, fields).select(*DOC, "field").distinct()
    return documents.join(hits, DOC)


# ---------------------------------------------------------------- candidates
def candidate_union(*parts: DataFrame) -> DataFrame:
    """Candidates of several finders as one table (submission_id, field, tier, pos, value)."""
    return reduce(DataFrame.unionByName, [p.select(CANDIDATE) for p in parts])


def best_candidates(candidates: DataFrame) -> DataFrame:
    """One value per document and field: lowest tier, then earliest position."""
    order = F.struct("tier", "pos", "value")
    return candidates.groupBy("submission_id", "field").agg(
        F.min_by("value", order).alias("value")
    )


def distinct_in_order(candidates: DataFrame) -> DataFrame:
    """Candidates without repeats; the earliest position of each value stays."""
    return candidates.groupBy("submission_id", "field", "value").agg(
        F.min(F.struct("tier", "pos")).alias("at")
    ).select("submission_id", "field", "at.tier", "at.pos", "value")


def exclude_used(candidates: DataFrame, used: DataFrame) -> DataFrame:
    """Candidates that no other field of the document uses (anti-join)."""
    keys = [c for c in ("submission_id", "value") if c in used.columns]
    return candidates.join(used.select(*keys).distinct(), keys, "left_anti")


def dedupe_lines(lines: DataFrame) -> DataFrame:
    """Distinct lines per document at their first position."""
    return lines.groupBy(*DOC, "text").agg(F.min("line_no").alias("line_no"))


def count_labels(lines: DataFrame) -> DataFrame:
    """Titles per line."""
    return lines.withColumn("hits", label_hits(F.col("text")))
