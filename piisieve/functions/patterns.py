"""Character classes and the seven detector patterns, in the JVM's regex dialect.

The detectors are defined on Unicode text: a word character is any letter, any number or `_`, a digit
is any decimal digit, and whitespace includes U+001C to U+001F. The JVM's `\\w`, `\\d` and `\\s` mean
ASCII, so the classes are written out, and a word boundary is written as lookarounds, which mean the
same on every JDK.

Two patterns carry a group: the hit is group 1, and what the whole match has in front of it is a
stretch that cannot start a hit. That stretch is passed over once rather than tried again from each
of its characters, which keeps long unpunctuated or dotted text linear.
"""

from string import ascii_letters, digits

# ASCII characters are written out in classes: the JVM looks them up in one table then, where each range, each category and
# each other character is a test of its own.
WORD = rf"{ascii_letters}{digits}_\p{{L}}\p{{N}}"
DIGIT = r"\p{Nd}"
SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
BOUNDARY = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"

# ---- Fixed values: what each detector looks for ------------------------------------------------------

# Letters that a case-insensitive A-Z takes, with the four non-ASCII letters that fold into it.
ANY_CASE_LETTER = f"{ascii_letters}İıſK"

# Characters allowed before the @ of an e-mail address, and in its domain.
EMAIL_LOCAL = rf"{ANY_CASE_LETTER}{digits}._%+-"
EMAIL_DOMAIN = rf"{ANY_CASE_LETTER}{digits}.-"

# One optional separator inside phone numbers.
PHONE_SEPARATOR = rf"[-. –—{SPACE}]?"
# Landlines: area codes without the leading 0, then the lengths of the two digit groups.
PHONE_LANDLINES = [
    ("[24]", 4, 4),
    ("3|49|[5-8]", 3, 4),
    ("37|89|82", 3, 3),
    ("836", 2, 3),
]

# An address may start with any one of these characters (they act as a set, not as names) ...
ADDRESS_FIRST = "台北市新基隆宜蘭縣竹桃園苗栗中彰化南投雲林嘉義高雄屏東花蓮澎湖金門連江臺|"
# ... has one of these after at least one more character, and then a number followed by 號.
ADDRESS_ROAD = "路街鄉鎮市區"
ADDRESS_TAIL = rf"(?:{DIGIT}{{1,3}}樓)?(?:之{DIGIT}{{1,3}})?(?:{DIGIT}{{1,3}}室)?"

# ---- Patterns ---------------------------------------------------------------------------------------

# Group 1 is the address. A run of local-part characters is entered at its start (or where the last
# match ended, where the lookbehind lets it) if an @ follows it at all, cut to its first word boundary once, and must then
# reach the @ in one go.
EMAIL = (
    rf"(?<![{EMAIL_LOCAL}](?!\G))(?=[{EMAIL_LOCAL}]++@)(?>[{EMAIL_LOCAL}]*?{BOUNDARY})"
    rf"([{EMAIL_LOCAL}]++@[{EMAIL_DOMAIN}]+\.[{ANY_CASE_LETTER}]{{2,}}{BOUNDARY})"
)

# The leading lookahead only spares the lookbehind on characters that cannot start a number, as in the patterns below.
# The thirteen digits that each card has are written out, which the JVM runs faster than a counted loop.
CARD = rf"(?={DIGIT})(?<![{WORD}])" + rf"{DIGIT}[ -]?" * 13 + rf"(?:{DIGIT}[ -]?){{0,3}}{BOUNDARY}"

NATIONAL_ID = rf"(?=[A-Z][12])(?<![{WORD}])[A-Z][12]{DIGIT}{{8}}(?![{WORD}])"

HEALTH_INSURANCE = rf"(?<!{DIGIT}){DIGIT}{{12}}(?!{DIGIT})"

PASSPORT = rf"(?<!{DIGIT}){DIGIT}{{9}}(?!{DIGIT})"


def _landline(area: str, first: int, second: int) -> str:
    sep = PHONE_SEPARATOR
    prefix = rf"(?:\+886{sep}(?:{area})|[(（]0(?:{area})[)）]|0(?:{area}))"
    return rf"{prefix}{sep}{DIGIT}{{{first}}}{sep}{DIGIT}{{{second}}}"


def _phone() -> str:
    sep, d = PHONE_SEPARATOR, DIGIT
    mobile = rf"(?:\+886{sep}9{d}{{2}}|09{d}{{2}}){sep}{d}{{3}}{sep}{d}{{3}}"
    toll_free = rf"080[09]{sep}(?:{d}{{3}}{sep}{d}{{3}}|{d}{{3}}{sep}{d}{{4}})"
    kinds = "|".join([mobile, *(_landline(*line) for line in PHONE_LANDLINES), toll_free])
    return rf"(?=[+(（0])(?<![{WORD}])(?:{kinds})(?![={WORD}])"


PHONE = _phone()

# Group 1 is the address. Within a run of word characters only the first possible start can succeed:
# a later one has fewer roads and numbers to its right. So a run is entered at its start if it has a
# number with 號 at all (or where the last match ended), its first possible start is taken, the first
# road after it, and then the first number with 號. The lookbehind turns down all other places at once; | is no word character.
ADDRESS = (
    rf"(?<![{WORD}](?!\G|\|))(?:(?=[{WORD}]*?{DIGIT}號)|\G|(?=\|))"
    rf"[{WORD}&&[^{ADDRESS_FIRST}]]*+"
    rf"([{ADDRESS_FIRST}][{WORD}][{WORD}&&[^{ADDRESS_ROAD}]]*+[{ADDRESS_ROAD}]"
    rf"[{WORD}]*?{DIGIT}號{ADDRESS_TAIL})"
)

# ---- Guards: necessary conditions that cost one cheap pass -------------------------------------------

# Every number the detectors look for has nine digits or more, with at most two other characters
# between neighbours (a closing bracket and a separator, in phone numbers).
NUMBER_GUARD = rf"{DIGIT}(?:[^{DIGIT}]{{0,2}}+{DIGIT}){{8}}"
NATIONAL_ID_GUARD = rf"[A-Z][12]{DIGIT}{{8}}"
HEALTH_INSURANCE_GUARD = rf"{DIGIT}{{12}}"
PASSPORT_GUARD = rf"{DIGIT}{{9}}"
ADDRESS_GUARD = rf"{DIGIT}號"
