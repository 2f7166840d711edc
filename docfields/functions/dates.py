"""Date readers (Column -> Column). Dates stay `DD.MM.YYYY` strings, as printed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfields.functions import patterns as P
from docfields.functions import values as V
from docfields.functions.text import (
    extract, extract_all, first, first_value, let, lookup, ocr_digits, soft_date, strip,
)


def display_date(day: Column, month: Column, year: Column) -> Column:
    """`DD.MM.YYYY` when each part is in range; the calendar is not consulted."""
    d, m, y = (c.try_cast("int") for c in (day, month, year))
    return F.when(
        d.between(1, 31) & m.between(1, 12) & y.between(1900, 2100),
        F.format_string("%02d.%02d.%d", d, m, y),
    )


def typed_date(c: Column) -> Column:
    """Calendar twin of a display date; NULL for impossible days."""
    return F.to_date(F.try_to_timestamp(c, F.lit("dd.MM.yyyy")))


def _parse(match: Column) -> Column:
    return let(
        F.split(match, P.DATE_SEPARATORS),
        lambda p: display_date(F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2))),
    )


def find_dates(c: Column) -> Column:
    """Distinct numeric dates in order of finding: as read, then with letters softened;
    each time two-digit parts before one-digit parts."""

    def scan(src: Column) -> Column:
        return F.concat(extract_all(src, P.DATE_STRICT), extract_all(src, P.DATE_LOOSE))

    def read(v: Column) -> Column:
        readings = F.array_distinct(F.array(v["raw"], v["soft"]))
        hits = F.flatten(F.transform(readings, scan))
        return F.array_distinct(F.array_compact(F.transform(hits, _parse)))

    return let(
        F.struct(c.alias("raw"), soft_date(c).alias("soft")),
        lambda v: F.when(v["soft"].rlike("[0-9]{4}"), read(v)).otherwise(
            F.array().cast("array<string>")
        ),
    )


def known_date(c: Column) -> Column:
    """A date already read for another field, in display form."""
    return _parse(extract(c, P.DATE_KNOWN))


def month_number(token: Column) -> Column:
    """Month of a name in either script, by its first three letters."""
    months = {**V.GEO_MONTHS, **V.LATIN_MONTHS}
    key = F.left(token, F.lit(3))
    # Georgian has no case here, and its upper form is another alphabet
    return F.coalesce(lookup(months, key), lookup(months, F.upper(key))).cast("int")


def _verbal(c: Column) -> Column:
    """One reading of a day, month name and year; NULL when absent or out of range.

    Both scripts with and without a slash, Georgian only, Latin only; the first of these
    forms that names a month decides, also when its day is impossible.
    """

    def read(p: Column) -> Column:
        # day, month name (twice when in both scripts), year
        month = first_value(F.slice(p, F.lit(2), F.lit(2)), month_number)
        return let(
            month,
            lambda m: F.when(
                m.isNotNull(),
                F.struct(
                    display_date(first(p), m.cast("string"), F.element_at(p, -1)).alias("date")
                ),
            ),
        )

    collapsed = strip(F.regexp_replace(c, f"[{P.WS}]+", " "))
    spaced = F.regexp_replace(collapsed, f"(?<=[0-9])(?=[{P.GEO}A-Za-z])", " ")
    forms = (P.VERBAL_BOTH_SLASH, P.VERBAL_BOTH, P.VERBAL_GEO, P.VERBAL_LATIN)
    hits = let(spaced, lambda t: F.array(*[extract(t, form) for form in forms]))
    return first_value(hits, lambda hit: read(F.split(hit, rf"[{P.WS}./\-]+")))["date"]


def verbal_dates(c: Column) -> Column:
    """Month-name dates of a text: as read, then with look-alike letters as digits.

    The softened reading comes second because it spoils Latin month names.
    """
    empty = F.array().cast("array<string>")
    return let(
        F.struct(c.alias("raw"), soft_date(c).alias("soft")),
        lambda v: F.when(
            v["soft"].rlike("[0-9]{4}"),
            F.array_compact(F.transform(F.array(v["raw"], v["soft"]), _verbal)),
        ).otherwise(empty),
    )


def verbal_date(c: Column) -> Column:
    """Month-name date in either or both scripts -> `DD.MM.YYYY`."""
    return first(verbal_dates(c))


def passport_dates(c: Column) -> Column:
    """Month-name dates first, numeric dates after them."""
    return F.array_distinct(F.concat(verbal_dates(c), find_dates(c)))


def mrz_date(c: Column, birth: bool) -> Column:
    """YYMMDD of a two-row strip, look-alikes mapped, month and day range-checked."""

    def read(d: Column) -> Column:
        yy, mm, dd = (F.substring(d, i, 2) for i in (1, 3, 5))
        in_range = mm.cast("int").between(1, 12) & dd.cast("int").between(1, 31)
        return F.when((F.length(d) >= 6) & in_range, F.concat_ws(".", dd, mm, _year(yy, birth)))

    return let(ocr_digits(c), read)


def card_mrz_date(c: Column, birth: bool) -> Column:
    """YYMMDD of a three-row strip, taken as it stands."""

    def read(d: Column) -> Column:
        yy, mm, dd = (F.substring(d, i, 2) for i in (1, 3, 5))
        return F.when(d.isNotNull(), F.concat_ws(".", dd, mm, _year(yy, birth)))

    return let(c, read)


def _year(yy: Column, birth: bool) -> Column:
    if not birth:
        return F.concat(F.lit("20"), yy)
    return F.concat(F.when(yy.try_cast("int") > 30, "19").otherwise("20"), yy)
