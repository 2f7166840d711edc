"""Two-script matching and repair (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfields.functions import patterns as P
from docfields.functions import values as V
from docfields.functions.text import (
    argmin, extract_all, first, georgian_only, is_place_junk, latin_key, latin_key_of, let,
    literal_map, lookup, nz, strings, strip,
)

WORD_EDGE = (f"(?<![{P.GEO}])", f"(?![{P.GEO}])")
_INITIALS = "".join(latin[0].upper() for latin in V.LETTER_TO_LATIN.values())
_PLACE_PHRASES = [p for p in V.PLACES if " " in p]
_PLACE_WORDS = [p for p in V.PLACES if " " not in p]


def _upper_key(geo: str) -> str:
    return "".join(V.LETTER_TO_LATIN.get(ch, "") for ch in geo).upper()


# Latin key -> official spelling (transliterations first, printed aliases on top).
PLACE_BY_KEY = {**{_upper_key(p): p for p in V.PLACES}, **V.PLACE_ALIASES}


# ---------------------------------------------------------------- dictionary lookups
def known_place_by_latin(c: Column) -> Column:
    return lookup(PLACE_BY_KEY, latin_key(c))


def is_known_place(c: Column) -> Column:
    return F.array_contains(strings(V.PLACES), c)


def _longest(places: Column) -> Column:
    """Longest name; alphabetical among equals, so the answer never depends on order."""
    return F.array_min(
        F.transform(places, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))
    )["p"]


def known_place(c: Column) -> Column:
    """Longest official place standing as its own word in a text."""

    def find(text: Column) -> Column:
        phrases = F.filter(
            strings(_PLACE_PHRASES), lambda p: text.contains(p)
        )
        whole = F.filter(
            phrases, lambda p: F.regexp_like(text, F.concat(F.lit(WORD_EDGE[0]), p, F.lit(WORD_EDGE[1])))
        )
        words = F.array_intersect(extract_all(text, f"[{P.GEO}]+"), strings(_PLACE_WORDS))
        return F.coalesce(_longest(whole), _longest(words))

    return let(c, lambda t: F.when(t.rlike(P.HAS_GEO), find(t)))


def near_place(c: Column) -> Column:
    """Official place of five letters or more at most one edit away."""
    long_names = strings([p for p in V.PLACES if len(p) >= 5])
    return let(c, lambda g: _longest(F.filter(long_names, lambda p: F.levenshtein(g, p, 1) >= 0)))


# ---------------------------------------------------------------- scores
def swapped_fits_better(first: Column, last: Column, first_hint: Column, last_hint: Column) -> Column:
    """Whether two names score more than 0.3 higher against each other's hints than against their own."""

    def better(k: Column) -> Column:
        # nothing scores higher than two names that both read as their hints
        own = F.coalesce((k["f"] == k["fh"]) & (k["l"] == k["lh"]), F.lit(False))
        return ~own & (
            _key_score(k["f"], k["lh"]) + _key_score(k["l"], k["fh"])
            > _key_score(k["f"], k["fh"]) + _key_score(k["l"], k["lh"]) + 0.3
        )

    return let(
        F.struct(
            latin_key_of(first).alias("f"), latin_key_of(last).alias("l"),
            latin_key(first_hint).alias("fh"), latin_key(last_hint).alias("lh"),
        ),
        better,
    )


def _key_score(a: Column, b: Column) -> Column:
    shared = F.size(
        F.filter(
            F.sequence(F.lit(1), F.least(F.length(a), F.length(b))),
            lambda i: F.left(a, i) == F.left(b, i),
        )
    )
    return (
        F.when(a.isNull() | b.isNull(), 0.0)
        .when(a == b, 2.0)
        .when(a.startswith(b) | b.startswith(a), 1.5)
        .when(F.left(a, F.lit(1)) != F.left(b, F.lit(1)), 0.0)
        .otherwise(shared / F.greatest(F.length(a), F.length(b)))
    )


def match_score(geo: Column, hint: Column) -> Column:
    """2 same spelling, 1.5 one is a prefix of the other, else shared prefix share."""
    return let(
        F.struct(latin_key_of(geo).alias("a"), latin_key(hint).alias("b")),
        lambda v: _key_score(v["a"], v["b"]),
    )


def best_for_latin(candidates: Column, hint: Column, used: Column, least: float = 0.35) -> Column:
    """Candidate closest to the Latin hint, other than `used`; it must score above `least`."""

    def may_score(x: Column, key: Column) -> Column:
        # without the same first letter the score is 0; a sign outside the alphabet is left
        # to the full comparison
        initial = F.translate(F.left(x, F.lit(1)), "".join(V.LETTER_TO_LATIN), _INITIALS)
        return (initial == F.left(key, F.lit(1))) | ~initial.rlike("[A-Z]")

    def best(key: Column) -> Column:
        scored = F.transform(
            F.filter(candidates, lambda x: may_score(x, key) & ~x.eqNullSafe(used)),
            lambda x: F.struct(
                let(latin_key_of(x), lambda own: _key_score(own, key)).alias("score"), x.alias("x")
            ),
        )
        good = F.filter(scored, lambda s: s["score"] > least)
        return F.when(key.isNotNull(), argmin(good, lambda s: -s["score"])["x"])

    return let(latin_key(hint), best)


# ---------------------------------------------------------------- repairs
_BY_LATIN: dict[str, str] = {}
for _letter, _latin in V.LETTER_TO_LATIN.items():
    _BY_LATIN[_latin.upper()] = _BY_LATIN.get(_latin.upper(), "") + _letter


def spellings(hint: Column, geo: Column) -> Column:
    """All Georgian spellings of a Latin key within two edits of `geo`.

    Built left to right. A partial spelling is dropped once it is more than two edits
    from every prefix of `geo` it could stand for, which no full spelling within two
    edits ever is; so the list stays small and nothing valid is lost. Blanks, hyphens
    and apostrophes of `geo` are kept in place, since the key ignores them.
    """
    units = literal_map(_BY_LATIN)
    empty = F.array().cast("array<string>")

    def marks(c: Column) -> Column:
        return F.regexp_replace(c, f"[{P.GEO}]", "")

    def near(p: Column) -> Column:
        n = F.length(p)
        ends = F.sequence(F.greatest(n - 2, F.lit(0)), n + 2)
        return F.exists(ends, lambda e: F.levenshtein(p, F.left(geo, e), 2) >= 0)

    def extend(partials: Column, unit: Column) -> Column:
        letters = F.filter(
            F.split(F.coalesce(F.try_element_at(units, unit), F.lit("")), ""), lambda x: x != ""
        )
        return F.flatten(
            F.transform(partials, lambda p: F.transform(letters, lambda x: F.concat(p, x)))
        )

    def with_mark(partials: Column) -> Column:
        def next_mark(p: Column) -> Column:
            mark = F.substring(marks(geo), F.length(marks(p)) + 1, F.lit(1))
            return F.concat(p, mark)

        return F.when(
            marks(geo) == "", partials
        ).otherwise(F.array_distinct(F.concat(partials, F.transform(partials, next_mark))))

    def step(acc: Column, i: Column) -> Column:
        grown = F.concat(
            extend(acc["one"], F.substring(hint, i, F.lit(1))),
            extend(acc["two"], F.substring(hint, i - 1, F.lit(2))),
        )
        kept = F.filter(with_mark(F.array_distinct(grown)), near)
        return F.struct(acc["one"].alias("two"), kept.alias("one"))

    start = F.struct(empty.alias("two"), F.array(F.lit("")).alias("one"))
    return F.filter(
        F.aggregate(F.sequence(F.lit(1), F.length(hint)), start, step)["one"],
        lambda s: (F.levenshtein(s, geo, 2) >= 0) & (marks(s) == marks(geo)),
    )


def repair_to_latin(geo: Column, latin: Column) -> Column:
    """Nearest spelling whose Latin form equals the hint; `geo` itself when none is near."""

    def repair(v: Column) -> Column:
        found = let(v["key"], lambda key: let(v["geo"], lambda g: nearest(spellings(key, g), g)))
        close = F.levenshtein(v["own"], v["key"], 2) >= 0
        return F.when(
            v["key"].isNotNull() & (v["own"].isNull() | (v["own"] != v["key"])) & close,
            F.coalesce(found, v["geo"]),
        ).otherwise(v["geo"])

    def nearest(options: Column, g: Column) -> Column:
        return F.array_min(
            F.transform(
                options, lambda s: F.struct(F.levenshtein(s, g).alias("n"), s.alias("s"))
            )
        )["s"]

    cleaned = nz(strip(F.coalesce(georgian_only(geo), geo)))
    return let(
        let(
            F.struct(cleaned.alias("geo"), latin_key(latin).alias("key")),
            lambda v: F.struct(
                v["geo"].alias("geo"),
                v["key"].alias("key"),
                F.coalesce(latin_key_of(v["geo"]), F.lit("")).alias("own"),
            ),
        ),
        repair,
    )


def restore_final_i(geo: Column, hint: Column) -> Column:
    """Put back a lost last letter when the Latin hint ends in I."""

    def restored(g: Column) -> Column:
        lost = ~F.endswith(g, F.lit("ი")) & strip(hint).rlike("[iI]$")
        return F.when(lost, F.concat(g, F.lit("ი"))).otherwise(g)

    return let(geo, restored)


def fix_person_name(geo: Column, hint: Column, is_first: Column) -> Column:
    """Georgian name repaired against the Latin one of the machine-readable zone.

    Only first names have a dictionary.
    """

    def fix(v: Column) -> Column:
        g, known, key, own = v["geo"], v["known"], v["key"], v["own"]
        trust_known = known.isNotNull() & (
            g.isNull() | (F.levenshtein(g, known, 2) >= 0) | (match_score(g, key) < 0.75)
        )
        repaired = let(
            repair_to_latin(g, key), lambda r: F.when(latin_key_of(r) == key, r).otherwise(g)
        )
        return (
            F.when(key.isNull(), g)
            # a name that reads as its hint is its own repair
            .when(own == key, restore_final_i(g, v["hint"]))
            .when(trust_known, known)
            .when(g.isNotNull(), restore_final_i(repaired, v["hint"]))
        )

    cleaned = F.struct(nz(strip(F.coalesce(georgian_only(geo), geo))).alias("geo"), hint.alias("hint"), latin_key(hint).alias("key"))
    return let(
        let(
            cleaned,
            lambda v: F.struct(
                *[v[c].alias(c) for c in ("geo", "hint", "key")],
                F.when(v["key"].isNotNull(), latin_key_of(v["geo"])).alias("own"),
                F.when(is_first, lookup(V.GIVEN_NAMES, v["key"])).alias("known"),
            ),
        ),
        fix,
    )


def fix_both_names(first: Column, last: Column, first_hint: Column, last_hint: Column) -> Column:
    """struct(first, last) with both names repaired."""
    sides = F.array(
        F.struct(first.alias("g"), first_hint.alias("h"), F.lit(True).alias("f")),
        F.struct(last.alias("g"), last_hint.alias("h"), F.lit(False).alias("f")),
    )
    return let(
        F.transform(sides, lambda v: fix_person_name(v["g"], v["h"], v["f"])),
        lambda a: F.struct(
            F.get(a, F.lit(0)).alias("first"), F.get(a, F.lit(1)).alias("last")
        ),
    )


def repair_place(geo: Column, latin: Column) -> Column:
    """Georgian birth place repaired by the plain-text Latin one, which is weaker:
    an official Georgian name is never replaced."""

    def fix(v: Column) -> Column:
        g, known = v["geo"], v["known"]
        near_known = (F.levenshtein(g, known, 2) >= 0) | (F.length(g) <= 3)
        return (
            F.when(g.isNull(), known)
            .when(latin_key_of(g) == v["key"], g)
            .when(
                known.isNotNull(),
                F.when(is_known_place(g), g).when(near_known, known).otherwise(g),
            )
            .otherwise(F.coalesce(near_place(g), g))
        )

    usable = let(georgian_only(geo), lambda g: F.when(~is_place_junk(g), g))
    return let(
        F.struct(
            usable.alias("geo"),
            latin_key(latin).alias("key"),
            known_place_by_latin(latin).alias("known"),
        ),
        fix,
    )
