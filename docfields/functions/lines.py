"""Readers over the ordered lines of one capture.

`study_lines` turns the plain lines into an array of structs once; every reader then
works on that array, so each line is classified a single time however many fields
look at it. The order of the array is the reading order of the page.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfields.functions import patterns as P
from docfields.functions.text import (
    clean_value, first_match, first_value, georgian_only, is_label_only, let, nz,
    strings, strip,
)

_BREAK = r"\R|[\x1c-\x1e]"


def to_lines(text: Column) -> Column:
    """Trimmed, non-empty lines of a text."""
    return F.filter(F.transform(F.split(text, _BREAK), strip), lambda x: x != "")


def study_lines(lines: Column) -> Column:
    """struct(text, low, val, title, title_raw, geo, geo_raw) for every line.

    `val` is the cleaned line, `title*` tells that it is only a field title and `geo*`
    is its Georgian side; `_raw` belongs to the line as it stands.
    """

    def study(v: Column) -> Column:
        same = v["val"] == v["text"]
        return let(
            F.struct(
                is_label_only(v["val"]).alias("title"), georgian_only(v["val"]).alias("geo")
            ),
            lambda s: F.struct(
                v["text"].alias("text"),
                F.lower(v["text"]).alias("low"),
                nz(v["val"]).alias("val"),
                s["title"].alias("title"),
                F.when(same, s["title"]).otherwise(is_label_only(v["text"])).alias("title_raw"),
                s["geo"].alias("geo"),
                F.when(same, s["geo"]).otherwise(georgian_only(v["text"])).alias("geo_raw"),
            ),
        )

    return F.transform(
        lines,
        lambda x: let(F.struct(x.alias("text"), clean_value(x).alias("val")), study),
    )


def texts(lines: Column) -> Column:
    return lines["text"]


def ahead(lines: Column, i: Column, n: int) -> Column:
    """The n lines after line i (0-based)."""
    return F.slice(lines, i + 2, F.lit(n))


def around(lines: Column, i: Column, n: int) -> Column:
    """Line i and the lines after it, n in all."""
    return F.slice(lines, i + 1, F.lit(n))


def until(lines: Column, stop) -> Column:
    """The lines before the first one for which `stop` holds."""
    marks = F.filter(F.transform(lines, lambda x, i: F.when(stop(x), i)), lambda i: i.isNotNull())
    return F.slice(lines, F.lit(1), F.coalesce(F.get(marks, F.lit(0)), F.size(lines)))


def has_label(line: Column, labels: Column) -> Column:
    return F.exists(labels, lambda label: line["low"].contains(label))


def label_array(labels) -> Column:
    return strings([label.lower() for label in labels])


def value_after_label(lines: Column, labels: Column, georgian: Column | bool = False) -> Column:
    """First value that follows a field title, on the same line or within five lines.

    Lines are tried in order and, on one line, titles in the order given. With
    `georgian` only a Georgian value counts.
    """
    georgian = F.lit(georgian) if isinstance(georgian, bool) else georgian

    def same_line(x: Column, label: Column) -> Column:
        rest = F.substring(
            x["text"], F.position(label, x["low"]) + F.length(label), F.length(x["text"])
        )
        value = clean_value(
            F.get(F.split(clean_value(F.regexp_extract(rest, P.AFTER_TITLE, 1)), P.NEXT_TITLE), F.lit(0))
        )
        return let(
            value,
            lambda v: F.when(georgian, georgian_only(v)).when(
                (F.length(v) > 1) & ~is_label_only(v), v
            ),
        )

    def next_lines(i: Column) -> Column:
        values = F.transform(
            F.filter(ahead(lines, i, 5), lambda y: ~y["title"]),
            lambda y: F.when(georgian, y["geo"]).otherwise(y["val"]),
        )
        return first_match(values, lambda v: v.isNotNull())

    def at(x: Column, i: Column) -> Column:
        hits = F.filter(labels, lambda label: x["low"].contains(label))

        def read(h: Column) -> Column:
            return let(
                F.transform(h, lambda label: same_line(x, label)),
                lambda same: F.coalesce(
                    F.get(same, F.lit(0)), next_lines(i), first_match(same, lambda v: v.isNotNull())
                ),
            )

        return let(hits, lambda h: F.when(F.size(h) > 0, read(h)))

    return first_value(lines, at)


def values_after_labels(lines: Column, searches) -> Column:
    """Values of several titled fields, one array entry per (labels, georgian, wanted).

    A search that is not wanted costs nothing and gives NULL.
    """
    specs = F.array(
        *[
            F.struct(
                label_array(labels).alias("labels"),
                F.lit(georgian).alias("georgian"),
                wanted.alias("wanted"),
            )
            for labels, georgian, wanted in searches
        ]
    )
    return F.transform(
        specs, lambda s: F.when(s["wanted"], value_after_label(lines, s["labels"], s["georgian"]))
    )


def continuation(lines: Column, i: Column) -> Column:
    """Up to two short Georgian fragments right after line i, glued; '' when none."""

    def fragment(step: int) -> Column:
        text = F.get(lines, i + step)["text"]
        return F.when(text.rlike(P.GEO_FRAGMENT), text)

    return F.coalesce(
        F.concat(fragment(1), F.coalesce(fragment(2), F.lit(""))), F.lit("")
    )


def name_candidates(lines: Column, skip) -> Column:
    """Distinct Georgian name lines in order, cut-off endings glued on."""

    def candidate(x: Column, i: Column) -> Column:
        usable = x["text"].rlike(P.GEO_NAME_LINE) & ~x["title_raw"] & ~x["text"].rlike("[0-9]")
        glued = F.concat(x["text"], continuation(lines, i))
        return F.when(usable, let(glued, lambda g: F.coalesce(georgian_only(g), g)))

    found = F.filter(
        F.transform(lines, candidate),
        lambda w: (F.length(w) >= 2) & ~w.isin(*skip),
    )
    return F.array_distinct(found)


def with_continuation(lines: Column, name: Column, labels: Column) -> Column:
    """A labelled name plus the fragments that follow it under its first title line."""
    index = F.transform(lines, lambda x, i: F.when(has_label(x, labels), i))
    start = first_match(index, lambda i: i.isNotNull())

    def extended(v: Column) -> Column:
        hit = first_value(
            ahead(lines, v["start"], 4),
            lambda y, j: F.when(
                y["geo_raw"].isNotNull() & y["text"].contains(v["name"]), v["start"] + 1 + j
            ),
        )
        return F.concat(
            v["name"],
            let(hit, lambda at: F.when(at.isNotNull(), continuation(lines, at)).otherwise("")),
        )

    return let(
        F.struct(name.alias("name"), start.alias("start")),
        lambda v: F.when(v["start"].isNotNull(), extended(v)).otherwise(v["name"]),
    )


def spoken_words(lines: Column, junk) -> Column:
    """Georgian words of two letters or more of all lines, junk lines and words left out."""
    def spoken(x: Column) -> Column:
        said = F.filter(F.split(x["geo_raw"], f"[{P.WS}]+"), lambda w: (F.length(w) >= 2) & ~junk(w))
        return F.when(x["geo_raw"].isNotNull() & ~junk(x["geo_raw"]), said)

    kept = F.filter(F.transform(lines, spoken), lambda ws: ws.isNotNull())
    return F.array_distinct(F.flatten(kept))
