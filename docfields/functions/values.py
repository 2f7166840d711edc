"""Word lists, lookup tables and field titles of the documents.

Everything in this module is data that results depend on; it is stated in plain
text and in natural order. Each table has a fixed size (the largest has 88 rows),
so turning one into a broadcast relation or a literal is always bounded.
"""

# Field titles printed on the documents, both scripts, most specific use first.
FIELD_LABELS = {
    "first_name": ["სახელი", "first name", "given name", "given names"],
    "last_name": ["გვარი", "last name", "surname", "family name"],
    "birth_date": ["დაბადების თარიღი", "date of birth", "birth date"],
    "birth_place": ["დაბადების ადგილი", "place of birth"],
    "citizenship": ["მოქალაქეობა", "citizenship", "nationality", "მოქალ."],
    "gender": ["სქესი", "sex", "gender"],
    "personal_id": [
        "პირადი ნომერი", "პირადი no", "პირადი №", "პირადი #", "პირადი ნომ",
        "personal no", "personal №", "personal number", "personal n", "პ/ნ", "პ.ნ",
    ],
    "expiry_date": ["მოქმედების ვადა", "date of expiry", "expiry", "valid until"],
    "issue_date": [
        "გაცემის თარიღი", "გაცემის თარ", "date of issue", "date ofissue", "issue date",
    ],
    "card_number": [
        "ბარათის ნომერი", "ბარათის №", "ბარათის #", "card no", "card number",
        "document no", "doc no", "ბარათის ნომ",
    ],
}

# Titles used by single extractors only.
BACK_PLACE_LABELS = ["დაბადების ადგილი", "place of birth", "place ofbirth"]
PASSPORT_NUMBER_LABELS = [
    "პასპორტის ნომერი", "პასპორტის №", "პასპორტის #",
    "passport no", "passport number", "passport №", "pasport no",
]
PASSPORT_LAST_LABELS = ["გვარი", "surname", "family name"]
PASSPORT_FIRST_LABELS = ["სახელი", "given name", "given names", "first name"]

# National transliteration, one entry per letter in alphabet order.
LETTER_TO_LATIN = {
    "ა": "a", "ბ": "b", "გ": "g", "დ": "d", "ე": "e", "ვ": "v", "ზ": "z",
    "თ": "t", "ი": "i", "კ": "k", "ლ": "l", "მ": "m", "ნ": "n", "ო": "o",
    "პ": "p", "ჟ": "zh", "რ": "r", "ს": "s", "ტ": "t", "უ": "u", "ფ": "p",
    "ქ": "k", "ღ": "gh", "ყ": "q", "შ": "sh", "ჩ": "ch", "ც": "ts", "ძ": "dz",
    "წ": "ts", "ჭ": "ch", "ხ": "kh", "ჯ": "j", "ჰ": "h",
}

# Official birth-place spellings: towns, then countries.
PLACES = (
    "თბილისი", "ბათუმი", "ქუთაისი", "რუსთავი", "ზუგდიდი", "გორი", "ფოთი",
    "თელავი", "ახალციხე", "ამბროლაური", "ოზურგეთი", "სენაკი", "ზესტაფონი",
    "მარნეული", "გარდაბანი", "საგარეჯო", "ბოლნისი", "კასპი", "ცხინვალი",
    "სოხუმი", "გაგრა", "ოჩამჩირე", "გალი", "გუდაუთა", "მცხეთა", "დუშეთი",
    "ბორჯომი", "ახალქალაქი", "ნინოწმინდა", "ლანჩხუთი", "ჭიათურა", "ტყიბული",
    "საჩხერე", "ხაშური", "ქარელი", "ხონი", "ხობი", "წყალტუბო", "ვანი", "სამტრედია",
    "აბაშა", "მარტვილი", "ჩხოროწყუ", "წალენჯიხა", "მესტია", "ონი", "ცაგერი",
    "ლენტეხი", "ყვარელი", "ლაგოდეხი", "დედოფლისწყარო", "სიღნაღი", "გურჯაანი",
    "თეთრიწყარო", "წალკა", "დმანისი", "ქედა", "შუახევი", "ხულო", "ჩოხატაური",
    "ქობულეთი", "ხელვაჩაური", "ასპინძა", "ადიგენი",
    "ბელარუსი", "უკრაინა", "რუსეთი", "თურქეთი", "სომხეთი", "აზერბაიჯანი",
    "ყაზახეთი", "ისრაელი", "გერმანია", "ამერიკის შეერთებული შტატები",
)

# Other Latin spellings of places, as printed on cards.
PLACE_ALIASES = {
    "BELARUS": "ბელარუსი", "BELARUSSIA": "ბელარუსი", "UKRAINE": "უკრაინა",
    "RUSSIA": "რუსეთი", "TURKEY": "თურქეთი", "TURKIYE": "თურქეთი",
    "ARMENIA": "სომხეთი", "AZERBAIJAN": "აზერბაიჯანი", "KAZAKHSTAN": "ყაზახეთი",
    "ISRAEL": "ისრაელი", "GERMANY": "გერმანია",
    "USA": "ამერიკის შეერთებული შტატები",
    "UNITEDSTATES": "ამერიკის შეერთებული შტატები",
    "UNITEDSTATESOFAMERICA": "ამერიკის შეერთებული შტატები",
}

# Common given names: Latin as in the machine-readable zone, official spelling.
GIVEN_NAMES = {
    "BEKA": "ბექა", "BEKAN": "ბექანი", "GIORGI": "გიორგი", "GIVI": "გივი",
    "GIA": "გია", "GELA": "გელა", "GOCHA": "გოჩა", "NINO": "ნინო", "NIKA": "ნიკა",
    "NIKOLOZ": "ნიკოლოზი", "DAVIT": "დავითი", "DAVID": "დავითი", "DATO": "დათო",
    "LEVAN": "ლევანი", "LUKA": "ლუკა", "LASHA": "ლაშა", "IRAKLI": "ირაკლი",
    "TAMAR": "თამარი", "ANA": "ანა", "ANUKI": "ანუკი", "MARIAM": "მარიამი",
    "SALOME": "სალომე", "SOPIO": "სოფიო", "SOPO": "სოფო", "KETEVAN": "ქეთევანი",
    "KETI": "ქეთი", "EKATERINE": "ეკატერინე", "ALEXANDRE": "ალექსანდრე",
    "ALEKSANDRE": "ალექსანდრე", "ZURAB": "ზურაბი", "VAZHA": "ვაჟა", "OTAR": "ოთარი",
    "SHOTA": "შოთა", "TEIMURAZ": "თეიმურაზი", "KAKHA": "კახა", "KAKHABER": "კახაბერი",
    "MERAB": "მერაბი", "MAMUKA": "მამუკა", "ZVIAD": "ზვიადი", "PAATA": "პაატა",
    "REVAZ": "რევაზი", "SANDRO": "სანდრო", "SABA": "საბა", "TORNIKE": "თორნიკე",
    "TSOTNE": "ცოტნე", "ELENE": "ელენე", "NATIA": "ნათია", "MAIA": "მაია",
    "MAKA": "მაკა", "OLEGI": "ოლეგი", "OLEG": "ოლეგი",
}

# Citizenship spellings; the first one contained in a value decides its code.
CITIZENSHIP_ALIASES = (
    ("საქართველო", "GEO"), ("GEORGIA", "GEO"), ("GEORGIAN", "GEO"),
    ("უკრაინა", "UKR"), ("UKRAINE", "UKR"), ("UKRAINIAN", "UKR"),
    ("რუსეთი", "RUS"), ("RUSSIA", "RUS"), ("RUSSIAN", "RUS"),
    ("თურქეთი", "TUR"), ("TURKEY", "TUR"), ("TURKIYE", "TUR"), ("TÜRKIYE", "TUR"),
    ("TURKISH", "TUR"), ("ბელარუსი", "BLR"), ("BELARUS", "BLR"), ("BELARUSIAN", "BLR"),
    ("სომხეთი", "ARM"), ("ARMENIA", "ARM"), ("აზერბაიჯანი", "AZE"), ("AZERBAIJAN", "AZE"),
    ("ყაზახეთი", "KAZ"), ("KAZAKHSTAN", "KAZ"), ("ისრაელი", "ISR"), ("ISRAEL", "ISR"),
    ("გერმანია", "DEU"), ("GERMANY", "DEU"), ("GERMAN", "DEU"),
    ("აშშ", "USA"), ("USA", "USA"), ("UNITEDSTATES", "USA"), ("AMERICA", "USA"),
)

# First three letters of a month name. Longer spellings start with one of these.
GEO_MONTHS = {
    "იან": 1, "თებ": 2, "მარ": 3, "აპრ": 4, "მაი": 5, "ივნ": 6,
    "ივლ": 7, "აგვ": 8, "სექ": 9, "ოქტ": 10, "ნოე": 11, "დეკ": 12,
}
LATIN_MONTHS = {
    "JAN": 1, "FEB": 2, "MAR": 3, "APR": 4, "MAY": 5, "JUN": 6,
    "JUL": 7, "AUG": 8, "SEP": 9, "OCT": 10, "NOV": 11, "DEC": 12,
    # usual misreadings
    "JUI": 7, "JU1": 7, "JVL": 7, "AU6": 8, "0CT": 10, "N0V": 11,
}

# Georgian words on a card front that are never a person name.
NOT_A_NAME = (
    "თბილისი", "ბათუმი", "ქუთაისი", "რუსთავი", "ზუგდიდი", "გორი",
    "თელავი", "ამბროლაური", "საქართველო", "სტუდენტი",
)

# Display form of the two sexes, and the messages of a failed check.
MALE = "მმ / M"
FEMALE = "მდ / F"
CARD_CHECK_FAILED = "MRZ ვერ ამოიკითხა"
PASSPORT_CHECK_FAILED = "პასპორტის MRZ ვერ ამოიკითხა"
