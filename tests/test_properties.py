"""Random text: the column expressions against plain Python written from the definitions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from piisieve.functions.arrays import SUM_BLOCK, exclusive_sums
from piisieve.functions.matches import LONG_TEXT, find_matches
from piisieve.functions.validators import ascii_digits, luhn_valid, national_id_valid
from piisieve.operators.builtin import BUILTIN
from piisieve import scan

# The patterns as Python reads them. Python's \w, \d, \s and \b are Unicode-aware already.
SEP = r"[-. –—\s]?"
LANDLINE = "|".join(
    rf"(?:\+886{SEP}(?:{a})|[\(（]0(?:{a})[\)）]|0(?:{a})){SEP}\d{{{n}}}{SEP}\d{{{m}}}"
    for a, n, m in [("[24]", 4, 4), ("3|49|[5-8]", 3, 4), ("37|89|82", 3, 3), ("836", 2, 3)]
)
FIRST = "台北市新基隆宜蘭縣竹桃園苗栗中彰化南投雲林嘉義高雄屏東花蓮澎湖金門連江臺|"
PYTHON_PATTERNS = {
    "EMAIL": re.compile(r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", re.IGNORECASE),
    "CREDIT_CARD": re.compile(r"\b(?:(?:\d[ -]?){13,16})\b"),
    "TAIWAN_ID_CARD": re.compile(r"\b[A-Z][12]\d{8}\b"),
    "NHI_NUMBER": re.compile(r"(?<!\d)\d{12}(?!\d)"),
    "PASSPORT_NUMBER": re.compile(r"(?<!\d)\d{9}(?!\d)"),
    "PHONE_NUMBER": re.compile(
        rf"(?<![\d\w])(?:(?:\+886{SEP}9\d{{2}}|09\d{{2}}){SEP}\d{{3}}{SEP}\d{{3}}|{LANDLINE}"
        rf"|080[09]{SEP}(?:\d{{3}}{SEP}\d{{3}}|\d{{3}}{SEP}\d{{4}}))(?![=\d\w])"
    ),
    "ADDRESS": re.compile(
        rf"[{FIRST}]\w+?[路街鄉鎮市區]\w*?\d{{1,5}}號(?:\d{{1,3}}樓)?(?:之\d{{1,3}})?(?:\d{{1,3}}室)?"
    ),
}
# Pieces that random text is made of, per detector: enough structure to hit and to nearly hit.
PIECES = {
    "EMAIL": ["a@b", ".com", ".org", "x.", "a", "B", "9", ".", "..", "@", "_", "%", "-", "路", "é", " ", "com", ".co", "ſ", "K", "İ", ",", "１", "😀"],
    "CREDIT_CARD": ["4111 1111", "41111111-1111",  "4111", "1", "22", "333", " ", "-", "  ", "x", "路", "１", "4111111111111111", ".", "_"],
    "TAIWAN_ID_CARD": ["A123456789", "Z2１2345678", "A", "A1", "B2", "23456789", "123456789", "１", "2", " ", "_", "路", "-", "é"],
    "NHI_NUMBER": ["123456789012", "123456", "1", "23", " ", "x", "路", "１２", "健保卡", "訂單號"],
    "PASSPORT_NUMBER": ["123", "1", "456", " ", "x", "１", "護照", "訂單"],
    "PHONE_NUMBER": [
        "0912", "345678", "(02)2345", "0836-12", "+886 2", "037-12", "0800 123",
        "+886", "0", "9", "09", "02", "3", "836", "0836", "37", "49", "0800", "(02)", "（04）", "(037)", "12", "345",
        "6789", "1234", " ", "-", ".", "—", "\n", "　", "\x1c", "=", "x", "電話", "１２", ")", "(", "89", "82",
    ],
    "ADDRESS": ["台", "北", "市", "|", "路", "街", "區", "我", "號", "1", "12", "123456", "1號", "２號", "樓", "之", "室", " ", "，", "A", "_"],
}


def random_texts(pieces, n, seed, longest=24):
    rng = random.Random(seed)
    return ["".join(rng.choices(pieces, k=rng.randint(1, longest))) for _ in range(n)]


@pytest.mark.parametrize("detector", BUILTIN, ids=lambda d: d.pii_type)
def test_pattern_agrees_with_python(spark, detector):
    texts = random_texts(PIECES[detector.pii_type], 6000, 11)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    rows = df.select("i", find_matches(F.col("text"), detector.pattern, detector.group).alias("m"))
    # The guards may only leave out texts without a match.
    guarded = df.select("i", F.size(detector.candidates(F.col("text"))).alias("n"))
    counts = {r.i: r.n for r in guarded.collect()}
    pattern = PYTHON_PATTERNS[detector.pii_type]
    hits = 0
    for r in rows.collect():
        expected = [(m.group(), m.start()) for m in pattern.finditer(texts[r.i])]
        assert [(m.value, m.start) for m in r.m] == expected, repr(texts[r.i])
        assert max(counts[r.i] or 0, 0) == len(expected), repr(texts[r.i])
        hits += len(expected)
    assert hits > 100


def python_luhn(text):
    digits = [int(c) for c in text if c.isdecimal()]
    if not 13 <= len(digits) <= 19:
        return False
    return sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


# The number that stands for each first letter.
LETTER_CODES = {
    "A": 10, "B": 11, "C": 12, "D": 13, "E": 14, "F": 15, "G": 16, "H": 17, "I": 34,
    "J": 18, "K": 19, "L": 20, "M": 21, "N": 22, "O": 35, "P": 23, "Q": 24, "R": 25,
    "S": 26, "T": 27, "U": 28, "V": 29, "W": 32, "X": 30, "Y": 31, "Z": 33,
}


def python_national_id(text):
    text = text.strip().upper()
    if not re.fullmatch(r"[A-Z][12]\d{8}", text):
        return False
    code = LETTER_CODES[text[0]]
    total = code // 10 + code % 10 * 9 + int(text[9])
    return (total + sum(int(text[i]) * (9 - i) for i in range(1, 9))) % 10 == 0


def test_checksums_agree_with_python(spark):
    rng = random.Random(5)
    digits = "0123456789０１２٣"
    cards = ["".join(rng.choices(digits + " -", k=rng.randint(10, 24))) for _ in range(4000)]
    ids = [
        rng.choice(["", " ", "　"])
        + rng.choice("ABCIOWXYZabcé1")
        + rng.choice("123")
        + "".join(rng.choices(digits, k=rng.choice([7, 8, 8, 8, 8, 9])))
        + rng.choice(["", "\n", "\x1c"])
        for _ in range(4000)
    ]
    df = spark.createDataFrame(list(zip(cards, ids)), "card string, id string")
    rows = df.select(
        "card", "id", luhn_valid(F.col("card")).alias("c"), national_id_valid(F.col("id")).alias("n")
    ).collect()
    assert sum(r.c for r in rows) > 100 and sum(r.n for r in rows) > 100
    for r in rows:
        assert r.c == python_luhn(r.card), r.card
        assert r.n == python_national_id(r.id), r.id


def test_checksums_of_null_are_false(spark):
    df = spark.createDataFrame([(None,)], "v string")
    row = df.select(luhn_valid(F.col("v")).alias("a"), national_id_valid(F.col("v")).alias("b")).first()
    assert (row.a, row.b) == (False, False)


def test_digits_of_every_script_have_their_value(spark):
    row = spark.range(1).select(ascii_digits(F.lit("7٣१２𝟗x")).alias("d")).first()
    assert row.d == "73129x"


@pytest.mark.parametrize("n", [0, 1, 5, SUM_BLOCK, SUM_BLOCK + 1, 3 * SUM_BLOCK, 70000])
def test_exclusive_sums(spark, n):
    df = spark.range(1).select(
        F.slice(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda x: (x % 7).cast("int")), 1, n).alias("a")
    )
    sums = df.select(exclusive_sums(F.col("a")).alias("s")).first().s
    expected, total = [], 0
    for i in range(n):
        expected.append(total)
        total += i % 7
    assert sums == expected


def test_long_text_dense_with_hits(spark):
    """A text far beyond LONG_TEXT with thousands of hits, so block sums and block slices are used."""
    unit = "文😀 mail{0}@example.com, 4111 1111 1111 1111 電話:0912-345-678 中山區{0}號。"
    text = "".join(unit.format(i) for i in range(5000))
    assert len(text) > 4 * LONG_TEXT
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = scan(df, keep=["doc_id"]).collect()
    assert len(rows) == 20000
    for r in rows:
        begin, end = r.start_pos, r.start_pos + len(r.matched_value)
        window = 100 if r.pii_type == "ADDRESS" else 10
        assert text[begin:end] == r.matched_value
        assert r.context == text[max(0, begin - window) : end + window]


def test_hostile_runs_stay_linear(spark):
    """Long runs without a hit, on which backtracking from every start would not end in time."""
    n = 200_000
    texts = [
        "a." * n + "@",
        "a" * n + "@" + "b." * n + "1",
        "台" * n + "1號",
        "台路" * n + "號1",
        "台" * n + "路" + "我" * n + " 1號",
        "1-" * n,
        "1" * n,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(8)
    assert scan(df, keep=["doc_id"]).count() == 0
