"""One reader per document field (Column -> Column), over studied lines.

Every reader is a chain of ordered attempts in `coalesce`: the dear ones are evaluated
only for the captures the cheap ones leave open.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfields.functions import patterns as P
from docfields.functions import values as V
from docfields.functions.dates import (
    display_date, find_dates, known_date, verbal_date,
)
from docfields.functions.lines import (
    ahead, around, has_label, label_array, name_candidates, spoken_words, texts, until,
    value_after_label, values_after_labels, with_continuation,
)
from docfields.functions.match import (
    best_for_latin, fix_both_names, fix_person_name, known_place, known_place_by_latin,
    match_score, swapped_fits_better,
)
from docfields.functions.text import (
    extract, extract_all, find_card_numbers, find_personal_ids, first, first_lazy, first_match,
    first_value, gender_display, is_name_junk, is_place_junk, latin_key_of, latin_place, let,
    normalize_card_number, nz, parse_gender, pick_personal_id, soft_date, transliterate,
)


# ---------------------------------------------------------------- numbers
def _near_label(lines: Column, labels: Column, read) -> Column:
    """What `read` finds in a title line and the three lines after it."""
    return first_value(
        lines,
        lambda x, i: F.when(
            has_label(x, labels), read(F.array_join(texts(around(lines, i, 4)), " "))
        ),
    )


def personal_id_near_label(lines: Column, text: Column) -> Column:
    """Personal number: value after its title, then title plus three lines, then any."""
    labels = label_array(V.FIELD_LABELS["personal_id"])
    read = lambda c: pick_personal_id(find_personal_ids(c))
    return F.coalesce(
        read(value_after_label(lines, labels)), _near_label(lines, labels, read), read(text)
    )


def card_number_near_label(lines: Column, text: Column) -> Column:
    """Document number: value after its title, then title plus three lines, then any."""
    labels = label_array(V.FIELD_LABELS["card_number"])
    read = lambda c: first(find_card_numbers(c))
    shaped = lambda c: let(c, lambda v: F.when(v.rlike(P.CARD_SHAPE), v))
    labelled = let(
        value_after_label(lines, labels),
        lambda v: F.coalesce(read(v), shaped(normalize_card_number(v))),
    )
    return F.coalesce(labelled, _near_label(lines, labels, read), read(text))


# ---------------------------------------------------------------- printed fields
# Each takes the value found after the field title (NULL when there is none).
def visual_date(titled: Column) -> Column:
    return let(
        titled,
        lambda v: F.coalesce(F.replace(extract(v, P.DATE_PRINTED), F.lit("/"), F.lit(".")), v),
    )


def visual_birth_date(titled: Column, text: Column) -> Column:
    """Without a titled value: the first date printed anywhere."""
    return F.coalesce(visual_date(titled), first(extract_all(text, P.DATE_PRINTED_WORD)))


def visual_expiry_date(titled: Column, text: Column) -> Column:
    """Without a titled value: the last date printed, when there are two or more."""
    last = let(
        extract_all(text, P.DATE_PRINTED_WORD),
        lambda d: F.when(F.size(d) >= 2, F.element_at(d, -1)),
    )
    return F.coalesce(visual_date(titled), last)


def visual_gender(titled: Column, text: Column) -> Column:
    """Without a titled value: a sex named anywhere."""
    return gender_display(
        F.coalesce(parse_gender(titled), nz(titled), parse_gender(text))
    )


VISUAL_FIELDS = ["birth_date", "expiry_date", "gender", "citizenship", "birth_place", "issue_date"]


def visual_values(lines: Column, known: dict[str, Column]) -> Column:
    """Values after the titles of VISUAL_FIELDS, in that order. A field that is known
    already is not searched."""
    return values_after_labels(
        lines,
        [
            (
                V.FIELD_LABELS[field],
                field == "birth_place",
                known[field].isNull() if field in known else F.lit(True),
            )
            for field in VISUAL_FIELDS
        ],
    )


# ---------------------------------------------------------------- issue date
def known_dates(*dates: Column) -> Column:
    """Dates that other fields already use, in display form."""
    return F.array_compact(F.array(*[known_date(d) for d in dates]))


def _unused(dates: Column, used: Column) -> Column:
    return first_match(dates, lambda d: ~F.array_contains(used, d))


def card_issue_date(lines: Column, text: Column, by_box: Column, used: Column) -> Column:
    """Issue date of a card back that is no other date of the card.

    By word box, title plus nine lines, pattern over the whole text, first date after
    the birth place, any date.
    """

    def from_blob(src: Column) -> Column:
        def date(raw: Column) -> Column:
            split = let(
                F.split(raw, P.DATE_SEPARATORS),
                lambda p: display_date(F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2))),
            )
            solid = display_date(F.substring(raw, 1, 2), F.substring(raw, 3, 2), F.substring(raw, 5, 4))
            return F.when(raw.rlike("^[0-9]{8}$"), solid).otherwise(split)

        return let(
            let(extract(src, P.CARD_ISSUE_BLOB, 1), date),
            lambda d: F.when(~F.array_contains(used, d), d),
        )

    titled = first_value(
        lines,
        lambda x, i: F.when(
            x["text"].rlike(P.CARD_ISSUE_TITLE),
            _unused(find_dates(F.array_join(texts(around(lines, i, 10)), "\n")), used),
        ),
    )
    place_at = first_value(
        lines, lambda x, i: F.when(x["low"].rlike("დაბადების ადგილი|place of birth|place ofbirth"), i)
    )
    after_place = let(
        F.coalesce(place_at, F.lit(-1)),
        lambda at: first_value(
            F.slice(lines, at + 2, F.size(lines)),
            lambda x: F.when(
                ~x["low"].rlike("მოქმედების|expiry|idge|<"), _unused(find_dates(x["text"]), used)
            ),
        ),
    )
    return F.coalesce(
        _unused(by_box, used),
        titled,
        first_lazy(F.array(text, soft_date(text)), from_blob),
        after_place,
        _unused(find_dates(text), used),
    )


def passport_issue_date(lines: Column, text: Column, by_box: Column, used: Column) -> Column:
    """Issue date of a passport page.

    Under the issue title that follows the birth place, under any issue title, a
    month-name date near issue words, any month-name date, by word box, whole text.
    Dates under a title are trusted even when another field shows the same one.
    """

    def dated(candidates: Column) -> Column:
        """First month-name date of the texts, else their first numeric date."""
        return let(
            candidates,
            lambda c: F.coalesce(
                first_value(c, verbal_date), first(F.flatten(F.transform(c, find_dates)))
            ),
        )

    def under_title(ls: Column, at: Column) -> Column:
        def value(k: Column) -> Column:
            line = F.get(ls, k)["text"]
            glued = F.array_join(texts(around(ls, k, 3)), " ")
            return dated(F.when(k == at, F.array(line)).otherwise(F.array(line, glued)))

        numbered = F.transform(
            ahead(ls, at, 5),
            lambda y, j: F.struct(y["text"].alias("text"), (at + 1 + j).alias("k")),
        )
        open_lines = until(
            numbered,
            lambda y: y["text"].rlike(P.PASSPORT_PLACE_TITLE) | y["text"].rlike(P.PASSPORT_ISSUE_STOP),
        )
        another_title = lambda y: y["text"].rlike(P.PASSPORT_ISSUE_TITLE) & ~y["text"].rlike("[0-9]")
        # the lines below first, the title line itself last
        tries = F.concat(
            F.transform(F.filter(open_lines, lambda y: ~another_title(y)), lambda y: y["k"]), F.array(at)
        )
        return first_value(tries, value)

    def read(ls: Column) -> Column:
        title_at = F.filter(
            F.transform(ls, lambda x, i: F.when(x["text"].rlike(P.PASSPORT_ISSUE_TITLE), i)),
            lambda i: i.isNotNull(),
        )
        places = F.filter(
            F.transform(ls, lambda x, i: F.when(x["text"].rlike(P.PASSPORT_PLACE_TITLE), i)),
            lambda i: i.isNotNull(),
        )

        def in_order(found: Column) -> Column:
            after_place = F.transform(places, lambda i: first_match(found, lambda j: (j > i) & (j < i + 12)))
            return F.array_distinct(F.array_compact(F.concat(after_place, found)))

        titles = let(title_at, in_order)
        verbal = F.transform(ls, lambda x: verbal_date(x["text"]))
        near_words = let(
            verbal,
            lambda ds: first_value(
                ds,
                lambda d, i: F.when(
                    d.isNotNull()
                    & F.array_join(
                        texts(F.slice(ls, F.greatest(i - 2, F.lit(1)), F.least(i + 1, F.lit(4)))), " "
                    ).rlike(P.PASSPORT_ISSUE_CONTEXT),
                    d,
                ),
            ),
        )
        return F.coalesce(
            first_value(titles, lambda i: under_title(ls, i)),
            near_words,
            first_match(verbal, lambda d: d.isNotNull()),
            _unused(by_box, used),
            verbal_date(text),
        )

    return let(F.filter(lines, lambda x: ~x["text"].rlike(P.PASSPORT_MRZ_LINE)), read)


# ---------------------------------------------------------------- birth place
def birth_place(lines: Column) -> Column:
    """Georgian birth place: after its title, official place near a damaged title, any
    official place, first clean Georgian line, official place of a Latin line."""
    clean = lambda geo: let(geo, lambda g: F.when(g.isNotNull() & ~is_place_junk(g), g))
    from_latin = lambda x: known_place_by_latin(latin_place(x["text"]))

    def near_title(x: Column, i: Column) -> Column:
        def read(window: Column) -> Column:
            values = until(
                F.filter(
                    F.slice(window, F.lit(2), F.lit(5)), lambda y: ~y["title_raw"]
                ),
                lambda y: y["text"].rlike(P.PLACE_STOP_GEO),
            )
            return F.coalesce(
                known_place(F.array_join(texts(window), " ")),
                first_value(values, lambda y: clean(y["geo_raw"])),
                first_value(window, from_latin),
            )

        return F.when(x["text"].rlike(P.PLACE_TITLE), let(around(lines, i, 6), read))

    def content(x: Column) -> Column:
        skip = (
            (F.length(x["text"]) < 2)
            | x["text"].contains("<")
            | x["text"].rlike("(?i)IDGE|TRGE")
            | x["text"].rlike(P.BACK_HEADER)
            | x["title_raw"]
            | x["text"].rlike(rf"^[0-9{P.WS}./\-]+$")
            | x["text"].rlike(P.PLACE_LINE_STOP)
        )
        return F.when(x["geo_raw"].isNotNull() & ~skip, clean(x["geo_raw"]))

    return F.coalesce(
        clean(value_after_label(lines, label_array(V.BACK_PLACE_LABELS), georgian=True)),
        first_value(lines, near_title),
        known_place(F.array_join(texts(lines), "\n")),
        first_value(lines, content),
        first_value(lines, from_latin),
    )


def birth_place_latin(lines: Column, place: Column) -> Column:
    """Latin birth place: official spelling, else the Latin value near the title or
    beside the Georgian one."""
    official = F.when(
        known_place_by_latin(latin_key_of(place)).isNotNull(), nz(transliterate(place))
    )

    def near(x: Column, i: Column) -> Column:
        window = F.filter(
            F.transform(
                around(lines, i, 6),
                lambda y, j: F.struct(y["text"].alias("text"), ((j > 0) & y["title_raw"]).alias("skip")),
            ),
            lambda y: ~y["skip"],
        )
        titled = F.when(
            x["text"].rlike(P.PLACE_TITLE),
            first_value(
                until(window, lambda y: y["text"].rlike(P.PLACE_STOP_LATIN)),
                lambda y: latin_place(y["text"]),
            ),
        )
        beside = F.when(
            x["geo_raw"] == place,
            first_value(around(lines, i, 3), lambda y: latin_place(y["text"])),
        )
        return F.coalesce(titled, beside)

    return F.coalesce(official, first_value(lines, near))


def bound(reader, *columns: Column) -> Column:
    """`reader(*columns)` with every column evaluated once per row.

    Readers use their arguments inside lambdas. The optimizer may replace a column there
    by the expression behind it, which would then run for every line.
    """
    packed = F.struct(*[c.alias(f"a{i}") for i, c in enumerate(columns)])
    return let(packed, lambda v: reader(*[v[f"a{i}"] for i in range(len(columns))]))


# ---------------------------------------------------------------- names
def _swap(v: Column, first_hint: Column, last_hint: Column) -> Column:
    """struct(first, last), exchanged when the other way round fits the hints better."""
    better = swapped_fits_better(v["first"], v["last"], first_hint, last_hint)
    all_known = (
        first_hint.isNotNull() & last_hint.isNotNull() & v["first"].isNotNull() & v["last"].isNotNull()
    )
    exchanged = F.struct(v["last"].alias("first"), v["first"].alias("last"))
    return F.when(all_known & better, exchanged).otherwise(v)


def _roles(first_labels, last_labels, first_hint: Column, last_hint: Column) -> Column:
    """The surname is searched first: the given name must differ from it."""
    return F.array(
        F.struct(label_array(last_labels).alias("labels"), last_hint.alias("hint")),
        F.struct(label_array(first_labels).alias("labels"), first_hint.alias("hint")),
    )


_FOUND = "array<struct<sure:string,name:string>>"


def _by_role(roles: Column, search) -> Column:
    """struct(first, last) from a search run per role. `search(role, before)` gives
    struct(sure, name); `before` is the surname's result while the given name is searched."""
    found = F.aggregate(
        roles,
        F.array().cast(_FOUND),
        lambda acc, r: F.concat(acc, F.array(search(r, F.get(acc, F.lit(0))))),
    )
    return let(
        found,
        lambda a: F.struct(
            F.get(a, F.lit(1))["name"].alias("first"), F.get(a, F.lit(0))["name"].alias("last")
        ),
    )


def card_names(lines: Column, first_hint: Column, last_hint: Column) -> Column:
    """struct(first, last): Georgian names of a card, repaired against the Latin hints.

    Value after the title, replaced by a better candidate line when it does not fit the
    hint; without both, the next candidate line.
    """

    def search(candidates: Column):
        def run(r: Column, before: Column) -> Column:
            labelled = let(
                value_after_label(lines, r["labels"], georgian=True),
                lambda v: F.when(v.isNotNull(), with_continuation(lines, v, r["labels"])),
            )

            def choose(v: Column) -> Column:
                doubtful = r["hint"].isNotNull() & (match_score(v, r["hint"]) < 0.7)
                better = best_for_latin(candidates, r["hint"], before["sure"])
                return F.coalesce(F.when(doubtful, better), v)

            return let(
                let(labelled, choose),
                lambda sure: F.struct(
                    sure.alias("sure"),
                    F.coalesce(
                        sure, first_match(candidates, lambda w: ~w.eqNullSafe(before["name"]))
                    ).alias("name"),
                ),
            )

        return run

    roles = _roles(
        V.FIELD_LABELS["first_name"], V.FIELD_LABELS["last_name"], first_hint, last_hint
    )
    chosen = let(
        name_candidates(lines, V.NOT_A_NAME), lambda c: _by_role(roles, search(c))
    )
    # a line without a Georgian letter (a rule, a stray mark) is no name and leaves the field open
    written = lambda c: F.when(c.rlike(P.HAS_GEO), c)
    return let(
        let(chosen, lambda v: _swap(v, first_hint, last_hint)),
        lambda v: let(
            fix_both_names(v["first"], v["last"], first_hint, last_hint),
            lambda n: F.struct(written(n["first"]).alias("first"), written(n["last"]).alias("last")),
        ),
    )


def passport_names(lines: Column, first_hint: Column, last_hint: Column) -> Column:
    """struct(first, last): Georgian names of a passport page; field titles never count.

    Best candidate for the hint, else the value after the title when it fits.
    """

    def search(candidates: Column):
        def run(r: Column, before: Column) -> Column:
            def titled() -> Column:
                return let(
                    value_after_label(lines, r["labels"], georgian=True),
                    lambda v: F.when(
                        ~is_name_junk(v)
                        & (r["hint"].isNull() | (match_score(v, r["hint"]) >= 0.35)),
                        v,
                    ),
                )

            # scores are shares of small whole numbers, so "0.4 or more" has room below
            best = best_for_latin(candidates, r["hint"], before["sure"], least=0.3999999)
            is_first = before.isNotNull()
            named = let(
                best,
                lambda b: F.struct(
                    b.isNotNull().alias("sure"), F.coalesce(b, titled()).alias("name")
                ),
            )
            fixed = lambda v: F.struct(
                v["sure"].alias("sure"),
                F.when(
                    v["name"].isNotNull(), fix_person_name(v["name"], r["hint"], is_first)
                ).alias("name"),
            )
            return let(
                let(named, fixed),
                lambda v: F.struct(
                    F.when(v["sure"], v["name"]).alias("sure"), v["name"].alias("name")
                ),
            )

        return run

    candidates = F.array_distinct(
        F.concat(
            F.filter(name_candidates(lines, V.NOT_A_NAME), lambda x: ~is_name_junk(x)),
            spoken_words(lines, is_name_junk),
        )
    )
    roles = _roles(V.PASSPORT_FIRST_LABELS, V.PASSPORT_LAST_LABELS, first_hint, last_hint)
    return let(
        let(candidates, lambda c: _by_role(roles, search(c))),
        lambda v: _swap(v, first_hint, last_hint),
    )
