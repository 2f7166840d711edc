"""The regular expressions, in Java syntax.

`(?iu)` folds case for all scripts; `(?U)` makes `\\w`, `\\b` and `\\s` Unicode-aware.
"""

GEO = r"ა-ჿ"
# Whitespace in any script, for use inside a character class.
WS = r"\s\x1c-\x1f\x85\p{Z}"

HAS_GEO = f"[{GEO}]"
# first side between slashes with a Georgian letter; it is tried where a side begins only, so a long line costs its length
GEO_SIDE = f"(?<![^/])[^/{GEO}]*+[{GEO}][^/]*+"
# possessive: same runs, but without recursion, so a line may be of any length
GEO_RUN = rf"[{GEO}]++(?:[{WS}\-'][{GEO}]++)*+"
GEO_FRAGMENT = f"^[{GEO}]{{1,2}}$"
GEO_NAME_LINE = rf"^[{GEO}{WS}\-']{{2,}}$"
LATIN_ONLY = rf"^[A-Za-z{WS}\-']+$"
CARD_SHAPE = r"^[0-9]{2}[A-Z]{2}[0-9]{5}$"

# A line starting with one of these words is a field title, not a value.
TITLE_START = (
    "(?iu)^(?:სახელი|გვარი|სქესი|მოქალაქეობა|პირადი|დაბადების|მოქმედების|ბარათის|"
    "first|last|name|sex|citizenship|nationality|personal|date|birth|"
    "place|expiry|valid|card|identity|georgia|საქართველო|"
    "signature|authority|issue|document)"
)
NEXT_TITLE = (
    rf"(?i)[{WS}]*/[{WS}]*(?:First|Last|Date|Place|Sex|Citizenship|Personal|Card)"
)
# What follows a title on its own line: optional "/ other script", optional colon, value.
AFTER_TITLE = rf"^[{WS}]*(?:/[^:：\n]*)?[:：]?[{WS}]*(.+)$"

# Numbers
CARD_STRICT = r"(?<![A-Z0-9])([0-9]{2}[A-Z]{2}[0-9]{5})(?![A-Z0-9])"
CARD_SOFT = r"(?<![A-Z0-9])([0-9OILZSBG]{2}[A-Z]{2}[0-9OILZSBG]{5})(?![A-Z0-9])"
CARD_AFTER_PREFIX = r"(?:IDGEO|TRGEO|IDGE|TRGE)([A-Z0-9]{9})"
PERSONAL_EXACT = r"(?<![0-9])([0-9]{11})(?![0-9])"
PERSONAL_SPACED = rf"(?<![0-9])(?:[0-9][{WS}.\-]*){{10}}[0-9](?![0-9])"
PERSONAL_TOKEN = r"[0-9OILZSBGOilzsbg|.\-]{11,16}"

# Dates
DATE_STRICT = rf"(?<![0-9])([0-9]{{2}})[./\-,{WS}]+([0-9]{{2}})[./\-,{WS}]+([0-9]{{4}})(?![0-9])"
DATE_LOOSE = rf"(?<![0-9])([0-9]{{1,2}})[./\-,{WS}]+([0-9]{{1,2}})[./\-,{WS}]+([0-9]{{4}})(?![0-9])"
DATE_SEPARATORS = rf"[./\-,{WS}]+"
DATE_KNOWN = r"[0-9]{1,2}[./\-][0-9]{1,2}[./\-][0-9]{4}"
DATE_PRINTED = r"[0-9]{2}[\./][0-9]{2}[\./][0-9]{4}"
DATE_PRINTED_WORD = r"(?U)\b[0-9]{2}[\./][0-9]{2}[\./][0-9]{4}\b"
VERBAL_BOTH_SLASH = (
    rf"(?<![0-9])([0-9]{{1,2}})[{WS}]+([{GEO}]{{2,12}})[{WS}]*/[{WS}]*([A-Za-z]{{3,9}})[{WS}]+([0-9]{{4}})(?![0-9])"
)
VERBAL_BOTH = (
    rf"(?<![0-9])([0-9]{{1,2}})[{WS}]+([{GEO}]{{2,12}})[{WS}]+([A-Za-z]{{3,9}})[{WS}]+([0-9]{{4}})(?![0-9])"
)
VERBAL_GEO = rf"(?<![0-9])([0-9]{{1,2}})[{WS}]+([{GEO}]{{2,12}})[{WS}]+([0-9]{{4}})(?![0-9])"
VERBAL_LATIN = (
    rf"(?<![0-9])([0-9]{{1,2}})[{WS}]*[./\-{WS}]+[{WS}]*([A-Za-z]{{3,9}})[{WS}]*[./\-{WS}]+[{WS}]*([0-9]{{4}})(?![0-9])"
)

# Gender words
FEMALE_WORD = r"(?iU)მდედრ|\bმდ\b|მდ\s*/\s*F|\bFEMALE\b|\bF\b"
MALE_WORD = r"(?iU)მამრ|\bმმ\b|მ\s*/\s*M|\bMALE\b|\bM\b"

# Machine-readable zone
TD1_DATES = r"([0-9]{6})([0-9])([MF<])([0-9]{6})([0-9])([A-Z]{3})([A-Z0-9<]{0,12})"
TD1_DATES_LOOSE = r"([0-9]{6}[0-9]?[MF<][0-9]{6}[0-9]?[A-Z]{3}[A-Z0-9<]*)"
TD1_DATES_FIELDS = r"([0-9]{6})([0-9])?([MF<])([0-9]{6})([0-9])?([A-Z0-9]{3})?"
TD1_LOOSE_DATE = r"[0-9]{6}[MF<0-9][0-9]{6}"
TD1_NAMES = r"[A-Z]{2,}<<[A-Z]{2,}"
TD1_NAMES_BLOB = r"([A-Z]{2,}<<[A-Z]{2,}[<A-Z]*)"
MRZ_DIGIT = "[0-9ODQILZSBG]"
TD3_DATA = (
    f"([A-Z0-9]{{9}}){MRZ_DIGIT}(GE[O0])({MRZ_DIGIT}{{6}}){MRZ_DIGIT}([MF<])({MRZ_DIGIT}{{6}})"
)
TD3_NAME_BLOB = r"(P<[A-Z0-9]{3}[A-Z0-9<]+)"
TD3_NAME_ISSUER = r"^[A-Z0-9<]{0,3}GE[O0]([A-Z<]{4,})$"
TD3_NAME_BARE = r"^[A-Z0-9<]{0,6}?([A-Z]{2,}<<[A-Z<]+)$"
TD3_NAMES = r"P<[A-Z0-9]{3}([A-Z]+)<<([A-Z<]+)"

# Birth place
PLACE_TITLE = (
    r"(?iU)დაბადებ\w*\s*ადგილ|ადგილ\w*\s*დაბადებ|"
    r"p[l1i]?[a-z]{0,2}ce\s*[o0]?f?\s*b[il1]?rth|"
    r"b[il1]?rth\s*p[l1i]?[a-z]{0,2}ce"
)
NOT_A_LATIN_PLACE = (
    r"(?iU)ministry|justice|authority|issu|georgia|georgian|identity|card|signature|"
    r"place\s*of\s*birth|date|expiry|personal|sex|citizenship|nationality|"
    r"surname|name|passport|type|document"
)
LATIN_TITLE_WORD = (
    r"(?i)^(?:the|of|and|for|type|doc|document|birth|date|sex|name|surname|"
    r"georgia|georgian|citizenship|nationality|passport|"
    r"p[l1i]?[a-z]{0,2}ce)$"
)
PLACE_JUNK = (
    "დაბადებ|ადგილ|გაცემ|თარიღ|ორგანო|იუსტიც|სამინისტრ|მოწმობ|"
    "საქართველ|მოქალაქ|პირად|სქეს|სახელ|გვარ|ვადა|ნომერ|ხელმოწერ|"
    "ტიპ|დოკუმენტ"
)
PLACE_JUNK_LATIN = (
    r"(?i)^(?:georgia|georgian|citizenship|nationality|passport|identity|"
    r"sex|type|document|birth|place|name|surname|the|of)$"
)
BACK_HEADER = (
    "(?iu)საქართველო|georgia|identity|card|პირადობ|მოწმობ|signature|authority|"
    "მინისტრ|ministry|justice|მოქალაქ|citizenship|idge|personal|პირადი"
)
PLACE_STOP_LATIN = r"(?iU)გაცემის|date\s*of\s*issue|authority|ორგანო"
PLACE_STOP_GEO = "(?iu)გაცემის|date of issue|თარიღი|authority|ორგანო"
PLACE_LINE_STOP = "(?iu)გაცემის|issue|authority|ორგანო|იუსტიც"

# Issue date
CARD_ISSUE_TITLE = (
    r"(?iU)გაცემის\s*თარ|გაცემ|date\s*[o0]f\s*iss|date\s*of\s*[il1]ss|dateof\s*iss|"
    r"date\s*of\s*lss|date.{0,6}iss|iss\s*ue\b|\bissue\b|\bissl[ue]\b"
)
CARD_ISSUE_BLOB = (
    r"(?isU)(?:გაცემ[^0-9]{0,80}|date\s*[o0]?f?\s*[il1]?ss[^0-9]{0,80}|dateofiss[^0-9]{0,40}|"
    r"i[0-9]{0,2}ue[^0-9]{0,50}|issue[^0-9]{0,50})"
    r"([0-9]{1,2}[\./\-,\s]+[0-9]{1,2}[\./\-,\s]+[0-9]{4}|[0-9]{8})"
)
PASSPORT_ISSUE_TITLE = (
    r"(?iU)გაცემის\s*თარ|გაცემ|date\s*[o0]f\s*iss|late\s*[o0]f\s*iss|dato\s*[o0]f\s*iss|"
    r"ati\s*se|dateofiss|lateofiss|date\s*of\s*issue|late\s*of\s*issue|"
    r"\bissue\b|\bissl|\blssue"
)
PASSPORT_PLACE_TITLE = r"(?iU)დაბადების\s*ადგილ|place\s*of\s*birth"
PASSPORT_ISSUE_STOP = (
    "(?iu)authority|ორგანო|ირგანო|signature|ხელმოწერ|expiry|მოქმედების|"
    "ministry|სამინისტრ|personal|პირადი"
)
PASSPORT_ISSUE_CONTEXT = r"(?iU)გაცემ|issue|ati\s*se|თარიღ|late\s*of"
PASSPORT_MRZ_LINE = r"(?iU)P<[A-Z]|<{3,}|\bIDGEO\b"

# Passport field titles that are never a person name
PASSPORT_NAME_JUNK = (
    "(?iu)ქვეყნ|კოდი|მოქალაქ|საქართველ|პასპორტ|გაცემ|დაბადებ|"
    "სახელი|გვარი|თარიღ|ადგილ|ნომერ|სქესი|ხელმოწერ|"
    "authority|georgia|passport|surname|given|name|code|national|"
    "date|issue|birth|sex|expiry|valid|personal"
)

# Titles that bound the printed photo
CARD_NUMBER_TITLE_WORD = r"(?iU)ბარათ|card\s*n|card\s*№|card\s*#|cardno"
CARD_HEADER_WORD = r"(?iU)პირადობ|მოწმობ|identity|identit|id\s*card|საქართველ"
PERSONAL_TITLE_WORD = "(?iu)პირადი|personal"
