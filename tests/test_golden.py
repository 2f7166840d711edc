"""Known input and output of single readers."""

import pytest
from pyspark.sql import functions as F

from docfields.functions import dates as D
from docfields.functions import fields as FD
from docfields.functions import match as X
from docfields.functions import mrz as M
from docfields.functions import text as T
from docfields.functions.lines import study_lines, to_lines, value_after_label, label_array

L = F.lit
NONE = lambda: F.lit(None).cast("string")


def lines(*rows):
    return F.array(*[L(r) for r in rows])


@pytest.mark.parametrize(
    "row, prefix, card, person",
    [
        ("IDGEO22IB34231204501015786<<<<", "IDGEO", "22IB34231", "04501015786"),
        ("TRGE025RT25836101991053297<<<<", "TRGEO", "25RT25836", "01991053297"),
        ("1DGEO22IB34231204501015786<<<<", "IDGEO", "22IB34231", "04501015786"),
        ("xx « ID6EO 22IB34231 2 04501O15786", "IDGEO", "22IB34231", "04501015786"),
    ],
)
def test_row_1_of_a_card(value, row, prefix, card, person):
    got = value(M.td1_document(L(row)))
    assert got == {"prefix": prefix, "card_number": card, "personal_id": person}


def test_row_1_too_short(value):
    assert value(M.td1_document(L("IDGEO22IB3423120450101"))) is None
    got = value(M.td1_document(L("IDGEO22IB34231204501015<<<<7896")))
    assert got["card_number"] == "22IB34231"


PASSPORT = ("P<GEOMURUSIDZE<<DAVIT<<<<<<<<<<<<<<<<<<<<<<<", "18AB123456GEO0601120M270313201234567890<<<94")


def test_passport_rows(value):
    arr = lines(*PASSPORT)
    assert value(M.td3_strip(arr)) == [PASSPORT[0].ljust(44, "<")[:44], PASSPORT[1]]
    assert value(M.td3_fields(arr, M.td3_strip(arr))) == {
        "card_number": "18AB12345", "birth_date": "12.01.2006", "expiry_date": "13.03.2027",
        "gender": "მმ / M", "citizenship": "GEO", "last_name": "MURUSIDZE", "first_name": "DAVIT",
    }


def test_glued_passport_rows(value):
    glued = PASSPORT[0].ljust(44, "<")[:44] + PASSPORT[1]
    assert value(M.td3_strip(lines(glued))) == [PASSPORT[0].ljust(44, "<")[:44], PASSPORT[1]]


def test_nationality_is_not_the_issuer(value):
    rows = lines("IDGEO22IB34231204501015786<<<<", "0601120M2703130BLR<<<<<<<<<<<<", "MURUSIDZE<<DAVIT<<<<")
    zone = value(M.td1_zone(F.array(rows)))
    assert (zone["citizenship"], zone["birth_date"], zone["last_name"]) == ("BLR", "12.01.2006", "MURUSIDZE")


@pytest.mark.parametrize(
    "text, want",
    [
        ("18 ივლ / JUL 2023", "18.07.2023"), ("06 სექ / SEP 2018", "06.09.2018"), ("18 ივლ 2023", "18.07.2023"),
        ("18 JUL 2023", "18.07.2023"), ("06სექ / SEP 2018", "06.09.2018"), ("18/JUL/2023", "18.07.2023"),
        ("18 JUI 2O23", None), ("18 ივლ 2O23", "18.07.2023"), ("40 ივლ 2023", None), ("no date", None),
    ],
)
def test_month_name_dates(value, text, want):
    assert value(D.verbal_date(L(text))) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("O1OO1O12345", ["01001012345"]),
        ("no 010-01 0123 45 and 12345678901", ["12345678901", "01001012345"]),
        ("123456789012", ["12345678901"]),
        ("nothing", []),
    ],
)
def test_personal_numbers(value, text, want):
    assert value(T.find_personal_ids(L(text))) == want


def test_card_numbers(value):
    assert value(T.fix_card_number(L("20IF22661"))) == "20IF22661"
    assert value(T.find_card_numbers(L("№: O0IB1234S."))) == ["00IB12345"]
    # blanks vanish before the search, so a number glued to its neighbours is missed
    assert value(T.find_card_numbers(L("no 00IB12345"))) == []


@pytest.mark.parametrize(
    "geo, latin, first, want",
    [
        ("გემა", "BEKA", True, "ბექა"), ("მურუსიძვ", "MURUSIDZE", False, "მურუსიძე"),
        ("კაკაბერ", "KAKHABER", False, "კაკჰაბერ"), ("ანა მარგა", "ANA MARIA", False, "ანა მარია"),
        (None, "NINO", True, "ნინო"), (None, "NINO", False, None), ("ნინო", None, True, "ნინო"),
    ],
)
def test_person_names(value, geo, latin, first, want):
    col = lambda x: L(x) if x else NONE()
    assert value(X.fix_person_name(col(geo), col(latin), L(first))) == want


@pytest.mark.parametrize(
    "geo, latin, want",
    [("თბილის", None, "თბილისი"), ("აბვ", "Khobi", "ხობი"), ("გორი", "ONI", "გორი"), (None, "TBILISI", "თბილისი")],
)
def test_places(value, geo, latin, want):
    col = lambda x: L(x) if x else NONE()
    assert value(X.repair_place(col(geo), col(latin))) == want


def test_place_must_be_a_whole_word(value):
    assert value(X.known_place(L("რეგიონი ივანიშვილი"))) is None
    assert value(X.known_place(L("ონი, ამერიკის შეერთებული შტატები"))) == "ამერიკის შეერთებული შტატები"


def test_card_back(value):
    back = study_lines(
        lines("დაბადების ადგილი / PLACE OF BIRTH", "ამბროლაური", "AMBROLAURI", "გაცემის თარიღი / DATE OF ISSUE", "03.06.2025")
    )
    none = F.array().cast("array<string>")
    assert value(FD.birth_place(back)) == "ამბროლაური"
    assert value(FD.birth_place_latin(back, L("ამბროლაური"))) == "Ambrolauri"
    assert value(FD.card_issue_date(back, L(""), none, none)) == "03.06.2025"
    assert value(FD.card_issue_date(back, L(""), none, F.array(L("03.06.2025")))) is None


def test_passport_block(value):
    page = study_lines(lines("PLACE OF BIRTH", "გარდაბანი", "DATE OF ISSUE", "18 ივლ / JUL 2023", "AUTHORITY"))
    none = F.array().cast("array<string>")
    assert value(FD.birth_place(page)) == "გარდაბანი"
    assert value(FD.passport_issue_date(page, L(""), none, F.array(L("18.07.2023")))) == "18.07.2023"


def test_title_on_the_line_of_its_value(value):
    ls = study_lines(lines("Sex: Female", "x"))
    assert value(value_after_label(ls, label_array(["sex"]))) == "Female"
    # the optional second script swallows a plain value; the next line is used
    ls = study_lines(lines("სქესი / SEX", "მმ / M"))
    assert value(value_after_label(ls, label_array(["სქესი", "sex"]))) == "მმ / M"


def test_line_breaks(value):
    assert value(to_lines(L(" a \r\n\n b\x0bc  \xa0d\xa0"))) == ["a", "b", "c", "d"]


@pytest.mark.parametrize("text, want", [("BELARUSSIA", "RUS"), ("SPAIN", "SPA"), ("აშშ", "USA"), ("აბ", "აბ"), (" ", None)])
def test_citizenship(value, text, want):
    assert value(T.citizenship_code(L(text))) == want


def test_long_hint_stays_small(value):
    """Twenty letters with two spellings each: a million spellings, few near the name."""
    found = value(F.size(X.spellings(L("K" * 20), L("კ" * 20))))
    assert found == 1 + 20 + 190


def test_coordinates_left_out_are_zero(value):
    from docfields.functions.geometry import VERTICES, whole_vertices

    raw = F.from_json(L('[{"y": 3}, {"x": 5}]'), VERTICES)
    got = value(whole_vertices(raw))
    assert [(v.x, v.y) for v in got] == [(0, 3), (5, 0)]


def test_very_long_georgian_line(value):
    assert value(F.length(T.georgian_only(F.repeat(L("აბგ "), 50000)))) == 4 * 50000 - 1
