"""Machine-readable zone readers over the line array of one capture.

Three-row cards (30 characters a row) and two-row passports (44 characters a row).
Each reader is one expression over `ARRAY<STRING>`: it needs no shuffle, and its
fallbacks sit in `coalesce`, so they run only for captures the first try missed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfields.functions import patterns as P
from docfields.functions import values as V
from docfields.functions.dates import card_mrz_date, mrz_date
from docfields.functions.text import (
    extract, first_lazy, first_value, fix_card_number, let, nz, ocr_digits, replace_all, strip,
)

# Usual misreadings of the row-1 prefix, same length as the true prefix.
PREFIX_REPAIRS = (
    ("I0GEO", "IDGEO"), ("1DGEO", "IDGEO"), ("ID6EO", "IDGEO"), ("IDGE0", "IDGEO"),
    ("TRGE0", "TRGEO"), ("T0GEO", "TRGEO"), ("1RGEO", "TRGEO"),
)
LINE_REPAIRS = (
    ("IDGE0", "IDGEO"), ("I0GEO", "IDGEO"), ("1DGEO", "IDGEO"),
    ("TRGE0", "TRGEO"), ("T0GEO", "TRGEO"),
)
BLOB_REPAIRS = PREFIX_REPAIRS + (("I0GE", "IDGE"), ("1DGE", "IDGE"))
FIELD_REPAIRS = (("IDGE0", "IDGEO"), ("I0GEO", "IDGEO"), ("TRGE0", "TRGEO"))
PASSPORT_REPAIRS = (("P0GEO", "P<GEO"), ("POGEO", "P<GEO"), ("P<GE0", "P<GEO"), ("P<GFO", "P<GEO"))

#: Every misreading above holds one of these.
REPAIR_MARKS = ("GE", "6EO", "GFO")

_TWO_FILLERS = "<.*<"


def normalize_mrz(c: Column) -> Column:
    """Upper case, no blanks or punctuation, every arrow-like sign a filler."""
    return F.translate(F.upper(c), "«‹> .,-_/", "<<<")


def repair(c: Column, pairs) -> Column:
    """The usual misreadings put right; text without any mark of them is not searched for each."""

    def repaired(v: Column) -> Column:
        marked = v.contains(REPAIR_MARKS[0])
        for mark in REPAIR_MARKS[1:]:
            marked = marked | v.contains(mark)
        return F.when(marked, replace_all(v, pairs)).otherwise(v)

    return let(c, repaired)


def fix_row(c: Column, width: int) -> Column:
    """Allowed characters only, cut or filled to the row width."""
    return F.rpad(F.regexp_replace(F.upper(c), "[^A-Z0-9<]", ""), width, "<")


def _blob(lines: Column) -> Column:
    return normalize_mrz(F.array_join(lines, " "))


# ---------------------------------------------------------------- three-row cards
def locate_td1(c: Column) -> Column:
    """struct(pos, prefix) of the row-1 start in a normalised line, NULL when absent.

    The full prefixes win over the four-letter ones, which count only when another
    letter or digit follows.
    """
    s = repair(c, PREFIX_REPAIRS)

    def at(text: Column, prefix: str) -> Column:
        pos = F.instr(text, F.lit(prefix))
        found = pos > 0
        if len(prefix) == 4:
            found = found & F.substring(text, pos + 4, F.lit(1)).rlike(r"^[\p{L}\p{Nd}]")
        return F.when(found, F.struct(pos.alias("pos"), F.lit(prefix).alias("prefix")))

    return let(s, lambda t: F.coalesce(*[at(t, p) for p in ("IDGEO", "TRGEO", "IDGE", "TRGE")]))


def td1_document(line: Column) -> Column:
    """Row 1 of a card: prefix, 9 for the document, 1 skipped, 11 for the person.

    struct(prefix, card_number, personal_id); NULL without a usable row.
    """

    def personal(rest: Column) -> Column:
        tail = F.substring(rest, F.lit(11), F.length(rest))
        digits = let(
            ocr_digits(F.left(tail, F.lit(11))), lambda d: F.when(F.length(d) == 11, d)
        )
        longer = let(
            ocr_digits(tail), lambda d: F.when(F.length(d) >= 11, F.left(d, F.lit(11)))
        )
        return F.when(F.length(tail) >= 11, F.coalesce(digits, longer))

    def fields(v: Column) -> Column:
        return F.when(
            F.length(v["rest"]) >= 20,
            F.struct(
                v["prefix"].alias("prefix"),
                fix_card_number(F.left(v["rest"], F.lit(9))).alias("card_number"),
                personal(v["rest"]).alias("personal_id"),
            ),
        )

    def read(s: Column) -> Column:
        return let(
            locate_td1(s),
            lambda a: F.when(
                a.isNotNull(),
                let(
                    F.struct(
                        a["prefix"].alias("prefix"),
                        F.replace(
                            F.substring(s, a["pos"] + F.length(a["prefix"]), F.length(s)), F.lit("<"), F.lit("")
                        ).alias("rest"),
                    ),
                    fields,
                ),
            ),
        )

    return let(repair(normalize_mrz(line), PREFIX_REPAIRS), read)


def mrz_like(c: Column, strict: bool) -> Column:
    """A normalised line that may belong to the zone."""
    prefixed = c.contains("IDGE") | c.contains("TRGE")
    if strict:
        return prefixed | (c.rlike(_TWO_FILLERS) & c.rlike("[0-9]{6}"))
    return prefixed | c.rlike(_TWO_FILLERS) | c.rlike(P.TD1_LOOSE_DATE)


def td1_ids(lines: Column) -> Column:
    """Both card numbers: whole text, then line by line, then zone fragments joined."""

    def both(d: Column) -> Column:
        return d["card_number"].isNotNull() & d["personal_id"].isNotNull()

    def keep(doc: Column) -> Column:
        return let(doc, lambda d: F.when(both(d), d))

    fragments = F.filter(F.transform(lines, normalize_mrz), lambda x: mrz_like(x, strict=True))
    sources = F.concat(F.array(_blob(lines)), lines, F.array(F.array_join(fragments, "")))
    return first_lazy(
        sources,
        lambda x: keep(td1_document(x)),
        "struct<prefix:string,card_number:string,personal_id:string>",
    )


def td1_strip(lines: Column) -> Column:
    """The rows that could be found, each 30 characters; NULL when there is none."""

    def cut(text: Column) -> Column:
        start = locate_td1(text)
        chunk = lambda a: F.regexp_replace(
            F.substring(text, a["pos"], F.length(text)), "^(ID|TR)GE(?!O)", "$1GEO"
        )
        return let(start, lambda a: F.when(a.isNotNull(), fix_row(chunk(a), 30)))

    def date_row(src: Column) -> Column:
        def row(hit: Column) -> Column:
            nation = F.substring(hit, 16, 3)
            whole = F.concat(
                F.left(hit, F.lit(15)),
                F.when(nation == "GFO", "GEO").otherwise(nation),
                F.substring(hit, F.lit(19), F.length(hit)),
            )
            return F.when(hit.isNotNull(), fix_row(whole, 30))

        return let(extract(src, P.TD1_DATES), row)

    def name_row(src: Column) -> Column:
        usable = src.contains("<<") & ~src.rlike("IDGE|TRGE|[0-9]{6}[MF<]")
        name = _drop_name_prefix(F.regexp_replace(src, "[^A-Z<]", ""))
        return F.when(usable, let(name, lambda n: F.when(n.rlike(P.TD1_NAMES), fix_row(n, 30))))

    def rows(v: Column) -> Column:
        loose_dates = F.replace(extract(v["blob"], P.TD1_DATES_LOOSE), F.lit("GE0"), F.lit("GEO"))
        found = F.array_compact(
            F.array(
                F.coalesce(first_value(v["lines"], cut), cut(v["blob"])),
                F.coalesce(
                    first_value(v["lines"], date_row), date_row(v["blob"]), fix_row(loose_dates, 30)
                ),
                F.coalesce(
                    first_value(v["lines"], name_row),
                    fix_row(extract(v["blob"], P.TD1_NAMES_BLOB), 30),
                ),
            )
        )
        return let(found, lambda f: F.when(F.size(f) > 0, f))

    sources = F.struct(
        F.transform(lines, lambda x: repair(normalize_mrz(x), LINE_REPAIRS)).alias("lines"),
        repair(_blob(lines), BLOB_REPAIRS).alias("blob"),
    )
    return let(sources, rows)


def _drop_name_prefix(c: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(c, "^[IT]R?GE[OA]?", ""), "^I?D?GE[OA]?", ""
    )


def sex_display(letter: Column) -> Column:
    return let(letter, lambda l: F.when(l == "M", V.MALE).when(l == "F", V.FEMALE))


def td1_dates_names(lines: Column, strip_rows: Column) -> Column:
    """Dates, sex, nationality and Latin names from the lines and the rebuilt rows."""

    def dates(line: Column) -> Column:
        hit = lambda g: extract(line, P.TD1_DATES_FIELDS, g)
        nation = F.replace(hit(6), F.lit("0"), F.lit("O"))
        code = F.when(nation == "GFO", "GEO").otherwise(nation)
        return F.when(
            line.rlike(P.TD1_DATES_FIELDS),
            F.struct(
                card_mrz_date(hit(1), birth=True).alias("birth_date"),
                card_mrz_date(hit(4), birth=False).alias("expiry_date"),
                sex_display(hit(3)).alias("gender"),
                F.when(code.rlike("^[A-Z]{3}$"), code).alias("citizenship"),
            ),
        )

    def names(line: Column) -> Column:
        usable = line.contains("<<") & ~line.rlike("[0-9]{6}|IDGE|TRGE")
        parts = F.split(F.regexp_replace(_drop_name_prefix(line), "[0-9]", ""), "<<")
        side = lambda p, i: nz(strip(F.translate(F.get(p, F.lit(i)), "<", " ")))
        return F.when(
            usable,
            let(
                parts,
                lambda p: F.when(
                    (F.size(p) >= 2) & F.get(p, F.lit(0)).rlike("[A-Z]{2,}"),
                    F.struct(side(p, 0).alias("last_name"), side(p, 1).alias("first_name")),
                ),
            ),
        )

    def read(candidates: Column) -> Column:
        return let(
            F.struct(
                first_value(candidates, dates).alias("d"), first_value(candidates, names).alias("n")
            ),
            lambda v: F.struct(
                v["d"]["birth_date"].alias("birth_date"),
                v["d"]["expiry_date"].alias("expiry_date"),
                v["d"]["gender"].alias("gender"),
                v["d"]["citizenship"].alias("citizenship"),
                v["n"]["last_name"].alias("last_name"),
                v["n"]["first_name"].alias("first_name"),
            ),
        )

    empty = F.array().cast("array<string>")
    cleaned = F.transform(
        F.concat(lines, F.coalesce(strip_rows, empty)),
        lambda x: repair(normalize_mrz(x), FIELD_REPAIRS),
    )
    return let(F.filter(cleaned, lambda x: mrz_like(x, strict=False)), read)


ZONE = (
    "struct<rows:array<string>,birth_date:string,expiry_date:string,gender:string,"
    "citizenship:string,last_name:string,first_name:string,seen:boolean>"
)


def td1_zone(sources: Column) -> Column:
    """Strip rows, dates, sex, nationality and names over ordered line arrays.

    The first source decides the rows and the nationality. Later ones are read only
    while birth date or sex are open, and fill what is missing.
    """

    def read(lines: Column) -> Column:
        return let(
            F.struct(lines.alias("lines"), td1_strip(lines).alias("rows")),
            lambda v: let(
                td1_dates_names(v["lines"], v["rows"]),
                lambda z: F.struct(v["rows"].alias("rows"), z.alias("z")),
            ),
        )

    def add(acc: Column, lines: Column) -> Column:
        own = lambda c, z: F.when(acc["seen"], acc[c]).otherwise(z).alias(c)
        either = lambda c, z: F.coalesce(acc[c], z[c]).alias(c)
        more = let(
            read(lines),
            lambda v: F.struct(
                own("rows", v["rows"]),
                either("birth_date", v["z"]),
                either("expiry_date", v["z"]),
                either("gender", v["z"]),
                own("citizenship", v["z"]["citizenship"]),
                either("last_name", v["z"]),
                either("first_name", v["z"]),
                F.lit(True).alias("seen"),
            ),
        )
        return F.when(acc["birth_date"].isNotNull() & acc["gender"].isNotNull(), acc).otherwise(more)

    return F.aggregate(sources, F.lit(None).cast(ZONE), add)


def rewrite_strip(rows: Column, card_number: Column) -> Column:
    """Row 1 with the final document number in place of the one read."""

    def patched(row: Column) -> Column:
        prefix = F.left(row, F.lit(5))
        tail = lambda skip: F.substring(row, F.lit(skip + 10), F.length(row))
        full = F.left(F.concat(prefix, card_number, tail(5)), F.lit(30))
        short = F.left(
            F.concat(F.left(row, F.lit(2)), F.lit("GEO"), card_number, tail(4)), F.lit(30)
        )
        return (
            F.when(nz(card_number).isNull(), row)
            .when(prefix.isin("IDGEO", "TRGEO"), full)
            .when(F.left(row, F.lit(4)).isin("IDGE", "TRGE"), short)
            .otherwise(row)
        )

    return F.transform(rows, lambda row, i: F.when(i == 0, patched(row)).otherwise(row))


# ---------------------------------------------------------------- two-row passports
def fix_passport_number(c: Column) -> Column:
    """Nine characters in the card shape where possible, else O read as 0 after two digits."""

    def fix(s: Column) -> Column:
        shaped = let(fix_card_number(s), lambda x: F.when(x.rlike(P.CARD_SHAPE), x))
        plain = F.when(s.rlike("^[0-9]{2}"), F.replace(s, F.lit("O"), F.lit("0"))).otherwise(s)
        return F.coalesce(F.when(F.length(s) == 9, shaped), plain)

    return let(F.left(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), F.lit(9)), fix)


def td3_strip(lines: Column) -> Column:
    """The rows that could be found, each 44 characters; NULL when there is none.

    When only the data row is found it is the single row returned.
    """

    def name_row(line: Column) -> Column:
        repaired = repair(line, PASSPORT_REPAIRS)
        c = F.regexp_replace(F.regexp_replace(repaired, "^PGEO", "P<GEO"), "^P[O0]<", "P<<")
        return let(c, lambda x: F.when(x.startswith("P<"), fix_row(x, 44)))

    def rebuilt(line: Column) -> Column:
        usable = (
            line.contains("<<")
            & (F.length(line) >= 20)
            & line.rlike("^[A-Z0-9<]+$")
            & ~line.rlike(P.TD3_DATA)
        )
        rest = F.coalesce(extract(line, P.TD3_NAME_ISSUER, 1), extract(line, P.TD3_NAME_BARE, 1))
        return F.when(usable, fix_row(F.concat(F.lit("P<GEO"), rest), 44))

    def data_row(src: Column) -> Column:
        return fix_row(extract(src, P.TD3_DATA + ".*$"), 44)

    def apart(src: Column) -> Column:
        name_like = src.startswith("P<") | F.left(src, F.lit(20)).contains("<<")
        return F.when(~name_like, data_row(src))

    def split_glued(v: Column) -> Column:
        # both rows run together without a readable data row: cut by width
        start = F.position(F.left(v["row1"], F.lit(12)), v["blob"])
        chunk = F.regexp_replace(
            F.substring(v["blob"], start, F.length(v["blob"])), "[^A-Z0-9<]", ""
        )
        return F.when(
            start > 0,
            let(
                chunk,
                lambda c: F.when(
                    F.length(c) >= 88,
                    F.array(F.left(c, F.lit(44)), F.substring(c, F.lit(45), F.lit(44))),
                ),
            ),
        )

    def rows(v: Column) -> Column:
        row1 = F.coalesce(
            first_value(v["lines"], name_row),
            fix_row(extract(v["repaired"], P.TD3_NAME_BLOB, 1), 44),
            first_value(v["lines"], rebuilt),
        )
        return let(
            F.struct(
                row1.alias("row1"), v["lines"].alias("lines"), v["repaired"].alias("blob")
            ),
            with_data,
        )

    def with_data(v: Column) -> Column:
        row2 = F.coalesce(
            first_value(v["lines"], apart),
            apart(v["blob"]),
            F.when(
                v["row1"].isNotNull(),
                F.coalesce(first_value(v["lines"], data_row), data_row(v["blob"])),
            ),
        )
        return let(
            row2,
            lambda r: let(
                F.coalesce(
                    F.when(v["row1"].isNotNull() & r.isNull(), split_glued(v)),
                    F.array_compact(F.array(v["row1"], r)),
                ),
                lambda a: F.when(F.size(a) > 0, a),
            ),
        )

    sources = F.struct(
        F.transform(lines, normalize_mrz).alias("lines"),
        repair(_blob(lines), PASSPORT_REPAIRS).alias("repaired"),
    )
    return let(sources, rows)


def usable_td3(rows: Column) -> Column:
    """Two rows, the name row, or the data row."""
    row1 = F.get(rows, F.lit(0))
    return F.coalesce(
        (F.size(rows) == 2) | row1.startswith("P<") | row1.rlike(P.TD3_DATA), F.lit(False)
    )


def td3_fields(lines: Column, rows: Column) -> Column:
    """Fields at fixed offsets; what they leave open comes from a pattern over all text."""
    row1, row2 = F.get(rows, F.lit(0)), F.get(rows, F.lit(1))

    def names(rest: Column) -> Column:
        part = F.substring(rest, F.lit(4), F.length(rest))
        last = F.regexp_replace(F.split_part(part, F.lit("<<"), F.lit(1)), "[^A-Z]", "")
        given = F.regexp_extract(part, "^.*?<<(.*)$", 1)
        first = strip(F.regexp_replace(F.translate(given, "<", " "), "[^A-Z ]", ""))
        two = part.contains("<<")
        return F.struct(F.when(two, nz(last)).alias("last"), F.when(two, nz(first)).alias("first"))

    def nation(code: Column) -> Column:
        return F.when(F.replace(code, F.lit("0"), F.lit("O")).isin("GEO", "GFO"), "GEO")

    rest = F.when(
        row1.startswith("P"),
        F.when(row1.startswith("P<"), F.substring(row1, 3, 44)).otherwise(F.substring(row1, 2, 44)),
    )

    def offsets(v: Column) -> Column:
        r = v["row2"]
        return F.struct(
            nz(fix_passport_number(F.left(r, F.lit(9)))).alias("card_number"),
            mrz_date(F.substring(r, 14, 6), birth=True).alias("birth_date"),
            mrz_date(F.substring(r, 22, 6), birth=False).alias("expiry_date"),
            sex_display(F.substring(r, 21, 1)).alias("gender"),
            F.coalesce(nation(F.substring(r, 11, 3)), nation(F.left(v["rest"], F.lit(3)))).alias(
                "citizenship"
            ),
            let(v["rest"], names).alias("names"),
        )

    def from_pattern(blob: Column) -> Column:
        hit = lambda g: extract(blob, P.TD3_DATA, g)
        return F.when(
            blob.rlike(P.TD3_DATA),
            F.struct(
                nz(fix_passport_number(hit(1))).alias("card_number"),
                mrz_date(hit(3), birth=True).alias("birth_date"),
                sex_display(hit(4)).alias("gender"),
                mrz_date(hit(5), birth=False).alias("expiry_date"),
            ),
        )

    def names_from_pattern(blob: Column) -> Column:
        hit = lambda g: extract(blob, P.TD3_NAMES, g)
        return F.when(
            blob.rlike(P.TD3_NAMES),
            F.struct(hit(1).alias("last"), nz(strip(F.translate(hit(2), "<", " "))).alias("first")),
        )

    def fill(v: Column) -> Column:
        o = v["o"]
        open_fields = o["card_number"].isNull() | o["birth_date"].isNull() | o["expiry_date"].isNull()
        missing = F.struct(
            F.when(open_fields, from_pattern(v["blob"])).alias("p"),
            F.when(o["names"]["last"].isNull(), names_from_pattern(v["blob"])).alias("n"),
        )
        return let(
            missing,
            lambda m: F.struct(
                F.coalesce(o["card_number"], m["p"]["card_number"]).alias("card_number"),
                F.coalesce(o["birth_date"], m["p"]["birth_date"]).alias("birth_date"),
                F.coalesce(o["expiry_date"], m["p"]["expiry_date"]).alias("expiry_date"),
                F.coalesce(o["gender"], m["p"]["gender"]).alias("gender"),
                F.when(m["p"].isNotNull(), "GEO").otherwise(o["citizenship"]).alias("citizenship"),
                F.coalesce(o["names"]["last"], m["n"]["last"]).alias("last_name"),
                F.when(m["n"].isNotNull(), m["n"]["first"]).otherwise(o["names"]["first"]).alias("first_name"),
            ),
        )

    return let(
        F.struct(
            let(F.struct(rest.alias("rest"), row2.alias("row2")), offsets).alias("o"),
            _blob(lines).alias("blob"),
        ),
        fill,
    )
