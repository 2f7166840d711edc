"""String clean-up, number finders and script conversion (Column -> Column).

Convention of the whole package: a missing value is NULL, never ''.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfields.functions import patterns as P
from docfields.functions import values as V

# Characters that count as blank in any script.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)


# ---------------------------------------------------------------- generic helpers
def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times inside `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def first_match(items: Column, test: Callable[[Column], Column]) -> Column:
    return first(F.filter(items, test))


def first_value(items: Column, value: Callable[..., Column]) -> Column:
    """First non-NULL `value(item[, index])` over an array."""
    return first_match(F.transform(items, value), lambda x: x.isNotNull())


def first_lazy(items: Column, value: Callable[[Column], Column], type_name: str = "string") -> Column:
    """Like `first_value`, but items after the first hit are not evaluated."""
    return F.aggregate(
        items, F.lit(None).cast(type_name), lambda found, x: F.coalesce(found, value(x))
    )


def argmax(items: Column, key: Callable[[Column], Column]) -> Column:
    """Item with the greatest key; the earliest one among equals."""
    ranked = F.transform(items, lambda x, i: F.struct(key(x).alias("k"), (-i).alias("i"), x.alias("x")))
    return F.array_max(ranked)["x"]


def argmin(items: Column, key: Callable[[Column], Column]) -> Column:
    """Item with the smallest key; the earliest one among equals."""
    ranked = F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.array_min(ranked)["x"]


def nz(c: Column) -> Column:
    """'' -> NULL."""
    # inside a lambda `nullif` evaluates its argument twice, and four times where another one stands in it
    return let(c, lambda v: F.when(v != "", v))


def strings(items) -> Column:
    """Array literal. Split from one string, so building it costs a single call."""
    return F.split(F.lit("\n".join(items)), "\n")


def literal_map(table: dict) -> Column:
    """String map literal, built like `strings`."""
    text = "\n".join(f"{k}\t{v}" for k, v in table.items())
    return F.str_to_map(F.lit(text), F.lit("\n"), F.lit("\t"))


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(literal_map(table), key)


def replace_all(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def extract_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def extract(c: Column, pattern: str, group: int = 0) -> Column:
    """Like regexp_extract, but NULL when there is no match (or an empty one)."""
    return nz(F.regexp_extract(c, pattern, group))


def clean_value(c: Column) -> Column:
    """Trim separators left and right, collapse blanks."""
    return strip(F.regexp_replace(F.btrim(c, F.lit(" :：-|/")), f"[{P.WS}]+", " "))


# ---------------------------------------------------------------- digits and numbers
def ocr_digits(c: Column) -> Column:
    """Digits of a number-like token, look-alike letters read as digits."""
    return F.regexp_replace(F.translate(c, "OoQDIlL|ZzSsBGg", "000011112255866"), "[^0-9]", "")


def soft_date(c: Column) -> Column:
    """Look-alike letters as digits, everything else kept."""
    return F.translate(c, "OoQDIl|ZzSsBb", "0000111225588")


def alnum_upper(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def drop_td1_prefix(c: Column) -> Column:
    return F.regexp_replace(c, "^(?:IDGEO|TRGEO|IDGE|TRGE)", "")


def _as_digits(c: Column) -> Column:
    return F.translate(c, "OQDILZSBG", "000112586")


def _shape_card(c: Column) -> Column:
    """Nine characters -> two digits, two letters, five digits where look-alikes allow."""
    return F.concat(
        _as_digits(F.substring(c, 1, 2)),
        F.translate(F.substring(c, 3, 2), "012586", "OIZSBG"),
        _as_digits(F.substring(c, 5, 5)),
    )


def fix_card_number(c: Column) -> Column:
    """Document number in its fixed shape; shorter input comes back cleaned only."""
    return let(
        drop_td1_prefix(alnum_upper(c)),
        lambda s: F.when(F.length(s) >= 9, _shape_card(F.left(s, F.lit(9)))).otherwise(s),
    )


# A nine-character window that takes the card shape once look-alikes are mapped.
_CARD_WINDOW = "(?!IDGE)([0-9OQDILZSBG]{2}[A-Z012568]{2}[0-9OQDILZSBG]{5})"


def normalize_card_number(c: Column) -> Column:
    """First window with the card shape, else the fixed prefix of the text."""
    return let(
        drop_td1_prefix(alnum_upper(c)),
        lambda s: F.coalesce(_shape_card(extract(s, _CARD_WINDOW, 1)), fix_card_number(s)),
    )


def find_card_numbers(c: Column) -> Column:
    """Distinct document numbers in order: strict shape, misread shape, after a prefix."""

    def found(compact: Column) -> Column:
        strict = extract_all(compact, P.CARD_STRICT, 1)
        soft = F.transform(extract_all(compact, P.CARD_SOFT, 1), normalize_card_number)
        prefixed = F.transform(extract_all(compact, P.CARD_AFTER_PREFIX, 1), normalize_card_number)
        shaped = F.filter(F.concat(soft, prefixed), lambda x: x.rlike(P.CARD_SHAPE))
        return F.array_distinct(F.concat(strict, shaped))

    return let(F.regexp_replace(F.upper(c), rf"[{P.WS}\-_/]", ""), found)


def find_personal_ids(c: Column) -> Column:
    """Distinct 11-digit numbers in order: plain, with separators, misread tokens."""

    def found(text: Column) -> Column:
        spaced = F.transform(
            extract_all(text, P.PERSONAL_SPACED), lambda x: F.regexp_replace(x, "[^0-9]", "")
        )
        tokens = F.transform(extract_all(text, P.PERSONAL_TOKEN), ocr_digits)
        full = F.filter(tokens, lambda x: F.length(x) >= 11)
        return F.array_distinct(
            F.concat(
                extract_all(text, P.PERSONAL_EXACT, 1),
                spaced,
                F.transform(full, lambda x: F.left(x, F.lit(11))),
            )
        )

    return let(c, found)


def pick_personal_id(ids: Column) -> Column:
    """First number that starts with 0 or 1, else the first one."""
    return let(ids, lambda a: F.coalesce(first_match(a, lambda x: x.rlike("^[01]")), first(a)))


# ---------------------------------------------------------------- scripts
def longest_run(c: Column) -> Column:
    """Longest run of Georgian words; the first of equals."""
    return nz(
        F.aggregate(
            extract_all(c, P.GEO_RUN),
            F.lit(""),
            lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best),
        )
    )


def georgian_only(c: Column) -> Column:
    """Georgian side of a value; NULL when it has none."""
    return longest_run(extract(c, P.GEO_SIDE))


def title_latin(c: Column) -> Column:
    """Capitalise every word, also after a hyphen."""
    # initcap knows blanks only, so a hyphen is followed by one for a moment
    apart = F.replace(strip(c), F.lit("-"), F.lit("\x01 "))
    return F.replace(F.initcap(apart), F.lit("\x01 "), F.lit("-"))


_ONE_TO_ONE = {k: v for k, v in V.LETTER_TO_LATIN.items() if len(v) == 1}
_ONE_TO_TWO = {k: v for k, v in V.LETTER_TO_LATIN.items() if len(v) == 2}
_LETTERS = "".join(V.LETTER_TO_LATIN)


def _spell(c: Column) -> Column:
    return replace_all(
        F.translate(c, "".join(_ONE_TO_ONE), "".join(_ONE_TO_ONE.values())), _ONE_TO_TWO.items()
    )


def transliterate(c: Column) -> Column:
    """Georgian -> Latin, title case; blank, hyphen and apostrophe stay, the rest drops."""
    return title_latin(_spell(F.regexp_replace(F.lower(c), f"[^{_LETTERS} '\\-]", "")))


def latin_key(c: Column) -> Column:
    """Comparison key: upper case, letters A-Z only; NULL when nothing is left."""
    return nz(F.regexp_replace(F.upper(c), "[^A-Z]", ""))


def latin_key_of(c: Column) -> Column:
    """Comparison key of the Latin spelling of a Georgian text."""
    return nz(F.upper(_spell(F.regexp_replace(F.lower(c), f"[^{_LETTERS}]", ""))))


def compare_key(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), rf"[{P.WS}./\-]", "")


# ---------------------------------------------------------------- two-script values
def latin_side(c: Column) -> Column:
    """Latin side of a two-script value, upper case; NULL when there is none."""

    def pick(v: Column) -> Column:
        parts = F.transform(F.split(v, "/"), strip)
        side = first_match(F.reverse(parts), lambda p: p.rlike(P.LATIN_ONLY))
        return F.upper(F.coalesce(F.when(v.contains("/"), side), F.when(v.rlike(P.LATIN_ONLY), v)))

    return let(c, pick)


def format_bilingual(geo: Column, latin: Column) -> Column:
    """`georgian / Latin`; a missing Latin side is transliterated."""

    def join(g: Column, l: Column) -> Column:
        lat = F.coalesce(title_latin(l), F.when(g.rlike(P.HAS_GEO), nz(transliterate(g))))
        return nz(F.concat_ws(" / ", g, lat))

    def sides(v: Column) -> Column:
        # v.g Georgian (or two-script) text, v.l Latin text, both NULL when blank
        left = strip(F.split_part(v["g"], F.lit("/"), F.lit(1)))
        right = strip(F.regexp_extract(v["g"], r"^[^/]*/(.*)$", 1))
        two = v["g"].contains("/")
        return F.struct(
            F.when(two, let(left, lambda g: F.coalesce(georgian_only(g), g))).otherwise(v["g"]).alias("g"),
            F.when(two, let(right, lambda l: F.when(l.rlike(P.LATIN_ONLY), l).otherwise(v["l"]))).otherwise(v["l"]).alias("l"),
        )

    both = F.struct(nz(strip(geo)).alias("g"), nz(strip(latin)).alias("l"))
    return let(
        let(both, sides),
        lambda v: let(nz(F.coalesce(georgian_only(v["g"]), v["g"])), lambda g: join(g, v["l"])),
    )


def split_pair(geo: Column, latin: Column) -> Column:
    """struct(geo, lat) of a two-script value."""

    def split(v: Column) -> Column:
        lone_geo = v.rlike(P.HAS_GEO)
        g = F.when(v.contains("/"), strip(F.split_part(v, F.lit("/"), F.lit(1)))).when(
            lone_geo, F.coalesce(georgian_only(v), v)
        )
        l = F.when(
            v.contains("/"), title_latin(strip(F.regexp_extract(v, r"^[^/]*/(.*)$", 1)))
        ).otherwise(F.when(lone_geo, transliterate(v)).otherwise(title_latin(v)))
        return F.struct(nz(g).alias("geo"), nz(l).alias("lat"))

    return let(format_bilingual(geo, latin), split)


# ---------------------------------------------------------------- gender, citizenship
def gender_letter(c: Column) -> Column:
    return F.when(c.rlike("მდ|[Ff]"), "F").when(c.rlike("მმ|მამრ|[Mm]"), "M")


def gender_display(c: Column) -> Column:
    """Display form when a sex can be told, else the value itself."""
    return let(
        c,
        lambda v: let(
            gender_letter(v),
            lambda g: F.when(g == "M", V.MALE).when(g == "F", V.FEMALE).otherwise(nz(strip(v))),
        ),
    )


def parse_gender(c: Column) -> Column:
    """Sex named anywhere in a text, as a word."""
    return F.when(c.rlike(P.FEMALE_WORD), V.FEMALE).when(c.rlike(P.MALE_WORD), V.MALE)


def citizenship_code(c: Column) -> Column:
    """Three-letter code of a citizenship text: first alias contained, else its letters."""
    names = [name for name, _ in V.CITIZENSHIP_ALIASES]
    aliases = F.arrays_zip(
        strings([n.lower() for n in names]).alias("low"),
        strings([n.upper() for n in names]).alias("up"),
        strings([code for _, code in V.CITIZENSHIP_ALIASES]).alias("code"),
    )

    def code(raw: Column) -> Column:
        cased = F.struct(F.lower(raw).alias("low"), F.upper(raw).alias("up"))
        alias = let(
            cased,
            lambda r: first_match(
                aliases, lambda a: r["low"].contains(a["low"]) | r["up"].contains(a["up"])
            )["code"],
        )
        code_of = lambda letters: F.when(F.length(letters) >= 3, F.left(letters, F.lit(3)))
        return F.coalesce(alias, let(F.regexp_replace(F.upper(raw), "[^A-Z]", ""), code_of), raw)

    return let(nz(strip(c)), lambda raw: F.when(raw.isNotNull(), code(raw)))


# ---------------------------------------------------------------- line predicates
ALL_LABELS = [label for labels in V.FIELD_LABELS.values() for label in labels]
_ANY_LABEL = "|".join(rf"\Q{label}\E" for label in ALL_LABELS)


def label_hits(c: Column) -> Column:
    """How many field titles occur in a line."""
    return let(
        F.lower(c),
        lambda low: F.size(F.filter(strings(ALL_LABELS), lambda label: low.contains(label))),
    )


def is_label_only(c: Column) -> Column:
    """The line is only a field title (a blank line counts as one)."""
    return let(
        strip(c),
        lambda t: (t == "")
        | t.rlike(P.TITLE_START)
        | (
            (F.length(t) < 45)
            & ~t.rlike(f"[0-9]{{6}}|[{P.GEO}]{{3}}")
            & F.lower(t).rlike(_ANY_LABEL)
            & ~t.rlike(rf"[:：][{P.WS}]*[^{P.WS}]")
            & (F.size(F.split(t, f"[{P.WS}/]+")) <= 4)
        ),
    )


def is_place_junk(c: Column) -> Column:
    """Not usable as a Georgian place name."""

    def junk(raw: Column) -> Column:
        compact = F.regexp_replace(raw, rf"[{P.WS}\-']+", "")
        geo = georgian_only(raw)
        return (
            compact.rlike(P.PLACE_JUNK_LATIN)
            | compact.rlike(P.LATIN_TITLE_WORD)
            | let(geo, lambda g: g.isNull() | (F.length(g) < 3) | g.rlike(P.PLACE_JUNK))
        )

    return let(
        nz(strip(c)), lambda raw: F.when(raw.isNull(), F.lit(True)).otherwise(junk(raw))
    )


def is_name_junk(c: Column) -> Column:
    """Not usable as a person name on a passport page."""
    return let(
        c,
        lambda v: let(
            georgian_only(v),
            lambda g: g.isNull()
            | (F.length(g) < 2)
            | g.rlike(P.PASSPORT_NAME_JUNK)
            | ((g != v) & v.rlike(P.PASSPORT_NAME_JUNK)),
        ),
    )


def latin_place(c: Column) -> Column:
    """Latin place value of a plain or two-script line; NULL for titles."""

    def pick(t: Column) -> Column:
        right = strip(F.regexp_extract(t, r"^[^/]*/(.*)$", 1))
        value = F.when(t.contains("/"), right).otherwise(t)
        return let(
            value,
            lambda v: F.when(v.rlike(P.LATIN_ONLY) & (F.length(v) >= 3), title_latin(v)),
        )

    return let(
        nz(strip(c)), lambda t: F.when(~t.rlike(P.NOT_A_LATIN_PLACE), pick(t))
    )


def clean_place_latin(geo: Column, latin: Column) -> Column:
    """A leaked title word (or nothing) is replaced by the official Latin spelling."""
    compact = F.regexp_replace(latin, rf"[{P.WS}\-']+", "")
    official = nz(transliterate(geo))
    return F.when(latin.isNull() | compact.rlike(P.LATIN_TITLE_WORD), official).otherwise(
        strip(latin)
    )
