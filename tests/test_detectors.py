"""Hand-derived cases for each detector: text, and the (value, start) pairs it must give."""

import re

import pytest
from pyspark.sql import functions as F

from piisieve import RuleDetector, scan
from piisieve.functions import matches
from piisieve.functions.matches import find_matches
from piisieve.functions.validators import luhn_valid, national_id_valid
from piisieve.operators.builtin import EMAIL
from piisieve.sources.tables import spread

CASES = {
    "RegexEmailScanner": [
        ("mail a.b+c@x-y.example.com.", [("a.b+c@x-y.example.com", 5)]),
        ("信箱abc@x.com", []),
        ("信箱：ABC@X.COM。", [("ABC@X.COM", 3)]),
        ("信箱ab.cd@x.com", [(".cd@x.com", 4)]),
        ("a@b.com路", []),
        ("a@b.co.uk路", [("a@b.co", 0)]),
        ("a@b.c", []),
        ("😀 a@b.com", [("a@b.com", 2)]),
        ("a@b.com-x@y.com", [("a@b.com", 0), ("-x@y.com", 7)]),
        ("a@b.com,c@d.org", [("a@b.com", 0), ("c@d.org", 8)]),
        ("é.x@b.com", [(".x@b.com", 1)]),
        ("..x@b.com", [("x@b.com", 2)]),
        ("a@b@c.com", [("b@c.com", 2)]),
    ],
    "RegexCreditCardScanner": [
        ("4111 1111 1111 1111 foo", [("4111 1111 1111 1111 ", 0)]),
        ("4111 1111 1111 1111 222", [("4111 1111 1111 1111 ", 0)]),
        ("卡4111111111111111", []),
        ("卡 4111-1111-1111-1111.", [("4111-1111-1111-1111", 2)]),
        ("41111111111111112", []),
        ("411111111111", []),
        ("4111111111111112", []),
        ("４１１１１１１１１１１１１１１１", [("４１１１１１１１１１１１１１１１", 0)]),
    ],
    "RegexTaiwanIdScanner": [
        ("A123456789", [("A123456789", 0)]),
        ("ID:A123456789,", [("A123456789", 3)]),
        ("身分證A123456789", []),
        ("身分證 A123456789。", [("A123456789", 4)]),
        ("a123456789", []),
        ("A323456789", []),
        ("A123456788", []),
        ("A1２３４５６７８９", [("A1２３４５６７８９", 0)]),
    ],
    "RegexHealthInsuranceScanner": [
        ("健保卡000012345678", [("000012345678", 3)]),
        ("0000123456789", []),
        ("x000012345678x", [("000012345678", 1)]),
    ],
    "RegexPassportScanner": [
        ("護照123456789號", [("123456789", 2)]),
        ("1234567890", []),
        ("A123456789", [("123456789", 1)]),
    ],
    "RegexPhoneScanner": [
        ("電話0912345678", []),
        ("電話:0912-345-678", [("0912-345-678", 3)]),
        ("TEL +886 2 2345 6789", [("+886 2 2345 6789", 4)]),
        ("TEL （02）2345-6789", [("（02）2345-6789", 4)]),
        ("電話(02)2345-6789", []),
        ("0912345678=", []),
        ("08212345678", []),
        ("0800-123-456", [("0800-123-456", 0)]),
        ("0800123456", [("0800123456", 0)]),
        ("08001234567", [("08001234567", 0)]),
        ("0836-12345", [("0836-12345", 0)]),
        ("(037)123-456", [("(037)123-456", 0)]),
        ("037-123456", [("037-123456", 0)]),
        ("049-1234567", [("049-1234567", 0)]),
        ("+886-912-345-678", [("+886-912-345-678", 0)]),
        ("0912\n345\n678", [("0912\n345\n678", 0)]),
        ("0912—345–678 0922333444", [("0912—345–678", 0), ("0922333444", 13)]),
    ],
    "RegexAddressScanner": [
        ("中山區12號", [("中山區12號", 0)]),
        ("中華民國台北市中正區1號", [("中華民國台北市中正區1號", 0)]),
        ("台北市 中正路12號", [("中正路12號", 4)]),
        ("台北市中正路12-1號", []),
        ("台北市中正路123456號", [("台北市中正路123456號", 0)]),
        ("新竹市光復路二段101巷5號2樓之3", [("新竹市光復路二段101巷5號2樓之3", 0)]),
        ("在我家台北市中正路1號3樓之2，", [("台北市中正路1號3樓之2", 3)]),
        ("|我的路1號", [("|我的路1號", 0)]),
        ("台北市中正路1號台北市中山路2號", [("台北市中正路1號", 0), ("台北市中山路2號", 8)]),
        ("台北市中正路號", []),
        ("台市1號", []),
    ],
}
ROWS = [(name, i, text) for name, cases in CASES.items() for i, (text, _) in enumerate(cases)]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(ROWS, "name string, i int, text string")
    rows = scan(df, keep=["name", "i", "text"]).collect()
    by_case = {}
    for r in rows:
        by_case.setdefault((r.name, r.i, r.scanner_source), []).append(r)
    return by_case


@pytest.mark.parametrize("name,i,text", ROWS)
def test_golden_string(found, name, i, text):
    rows = sorted(found.get((name, i, name), []), key=lambda r: r.start_pos)
    assert [(r.matched_value, r.start_pos) for r in rows] == CASES[name][i][1]
    window = 100 if name == "RegexAddressScanner" else 10
    for r in rows:
        begin, end = r.start_pos, r.start_pos + len(r.matched_value)
        assert text[begin:end] == r.matched_value
        assert r.context == text[max(0, begin - window) : end + window]
        expected = None if name == "RegexEmailScanner" else f"附近 (char ~{begin})"
        assert r.location == expected


@pytest.mark.parametrize(
    "name,score,validation,pii_type",
    [
        ("RegexEmailScanner", 0.7, "NOT_APPLICABLE", "EMAIL"),
        ("RegexCreditCardScanner", 1.0, "VALID", "CREDIT_CARD"),
        ("RegexTaiwanIdScanner", 1.0, "VALID", "TAIWAN_ID_CARD"),
        ("RegexAddressScanner", 0.85, "NOT_APPLICABLE", "ADDRESS"),
    ],
)
def test_fixed_scores(found, name, score, validation, pii_type):
    rows = [r for key, group in found.items() if key[2] == name for r in group]
    assert rows
    assert {(r.confidence_score, r.validation_status, r.pii_type) for r in rows} == {
        (score, validation, pii_type)
    }


@pytest.mark.parametrize(
    "text,source,score",
    [
        ("健保卡 000012345678", "RegexHealthInsuranceScanner", 0.6),
        ("NHI No 000012345678", "RegexHealthInsuranceScanner", 0.6),
        ("nhi no 000012345678", "RegexHealthInsuranceScanner", 0.5),
        ("訂單號 000012345678", "RegexHealthInsuranceScanner", 0.4),
        ("健保卡訂單號 000012345678", "RegexHealthInsuranceScanner", 0.6),
        ("健保卡一二三四五六七八九十000012345678", "RegexHealthInsuranceScanner", 0.5),
        ("000012345678一二三四五六七健保卡", "RegexHealthInsuranceScanner", 0.6),
        ("PASSPORT 123456789", "RegexPassportScanner", 0.6),
        ("passport 123456789", "RegexPassportScanner", 0.5),
        ("發票 123456789", "RegexPassportScanner", 0.4),
        ("發票 123456789 外交部", "RegexPassportScanner", 0.6),
        ("cell: 0912345678", "RegexPhoneScanner", 0.6),
        ("訂單 0912345678", "RegexPhoneScanner", 0.4),
        ("訂單 TeL 0912345678", "RegexPhoneScanner", 0.6),
        ("x 0912345678", "RegexPhoneScanner", 0.5),
    ],
)
def test_keyword_scores(spark, text, source, score):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = scan(df, keep=["doc_id"], detectors=[source]).collect()
    assert [r.confidence_score for r in rows] == [score]


def test_one_value_found_by_two_detectors_gives_two_rows(spark):
    df = spark.createDataFrame([(1, "A123456789")], "doc_id int, text string")
    types = sorted(r.pii_type for r in scan(df, keep=["doc_id"]).collect())
    assert types == ["PASSPORT_NUMBER", "TAIWAN_ID_CARD"]


def test_null_and_empty_text_have_no_findings(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    assert scan(df, keep=["doc_id"]).count() == 0


@pytest.mark.parametrize(
    "pattern",
    [r"([a-z]+)\d", r"x?([a-z])[a-z]*\d", r"(?i)A(b|c)?d", r"[(a]([b-d]+)(?:\d|\))", r"(a)a", r"\(?(?<w>b+)c", r"a(b(c)?)d"],
)
def test_first_group_anywhere(spark, pattern):
    texts = ["x12 y ab3", "aa aaa (bc) abd ad ABD acd", "bbc (bbc abcd1 abbd", "", "abd " * 12]
    readable = pattern.replace("(?<w>", "(?P<w>")
    expected = [[(m[1], m.start(1)) for m in re.finditer(readable, t) if m[1]] for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", find_matches(F.col("t"), pattern, 1).alias("m")).orderBy("i").collect()
    assert [[tuple(hit) for hit in r.m] for r in rows] == expected


@pytest.mark.parametrize(
    "pattern,group", [(r"\d*", 0), (r"(a)|b", 1), (r"(?:(a)b)c", 1), (r"(a)+b", 1), (r"(a)b\1", 1), ("a", 1), ("(a)b", 2), (r"a(?i)(b)c", 1)]
)
def test_patterns_that_are_refused(pattern, group):
    with pytest.raises(ValueError):
        RuleDetector(name="R", pii_type="R", pattern=pattern, group=group)


DENSE_LINE = "ID:A123456789, a@b.com 卡 4111-1111-1111-1111. 健保卡000012345678 電話:0912-345-678 護照123456789號 x "


def test_dense_text_is_not_copied_per_hit(spark):
    """Checksums are applied before hits become rows: no filter above the unfolding, which is generated code."""
    from piisieve.operators.scan import scan

    reps = 3000
    df = spark.createDataFrame([(1, "f", DENSE_LINE * reps)], "doc_id long, file_path string, text string")
    found = scan(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    first = max(i for i, line in enumerate(lines) if "Generate" in line)  # the first unfolding, one row a detector
    assert first > 0 and all("*(" in line for line in lines[:first]), plan
    counts = {r.pii_type: r["count"] for r in found.groupBy("pii_type").count().collect()}
    # The passport pattern also takes the nine digits of the national ID; the line holds no address.
    assert counts == {"EMAIL": reps, "CREDIT_CARD": reps, "TAIWAN_ID_CARD": reps, "NHI_NUMBER": reps,
                      "PASSPORT_NUMBER": 2 * reps, "PHONE_NUMBER": reps}, counts


def test_rows_that_crowd_in_one_split_are_spread(spark, tmp_path):
    """A row group goes whole to one split of its file: enough splits do not mean that the rows are dealt out."""
    path = str(tmp_path / "one_row_group")
    spark.range(300_000).coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        cores = spark.sparkContext.defaultParallelism
        for options in ({}, {"rows_per_task": 5_000}):
            source = spark.read.parquet(path)
            assert source.rdd.getNumPartitions() >= cores
            dealt = spread(source, spark, **options)
            counts = [r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            assert sum(counts) == 300_000 and len(counts) >= cores
            assert max(counts) <= 1.1 * options.get("rows_per_task", 300_000 / cores), options
            assert dealt.distinct().count() == 300_000
        assert spread(spark.read.parquet(path).limit(0), spark, rows_per_task=10).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_checksums_bind_their_text_once(spark):
    """Each digit of the sum used to repeat the patterns and the translation of the text."""
    for valid in (national_id_valid, luhn_valid):
        plan = spark.range(1).select(valid(F.col("id").cast("string")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("translate(") == 1, valid


def test_ids_in_lower_case_as_upper_maps_them(spark):
    texts = ["a123456789", " A123456789　", "ı123456786", "ſ123456785", "ß123456789", "A１２３４５６７８９", "a12345678", "1123456789", None, "K123456789"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.v for r in df.select(national_id_valid(F.col("t")).alias("v")).collect()]
    plain = df.select(national_id_valid(F.upper("t")).alias("v")).collect()
    assert got == [r.v for r in plain] and got[:2] == [True, True] and got[5] and not any(got[6:])


def test_groups_are_placed_without_running_their_pattern_again(spark):
    """Groups are found at once and searched; equal ones and those inside others are placed by the matches around them."""
    detectors = ["RegexEmailScanner", "RegexAddressScanner"]
    texts = ["信箱u.1@example.com a@b.org 地址：台北市中正區重慶南路1號", "a@b.org;xa@b.org;a@b.org 中山路1號，中山路1號", "-a@b.org+a@b.org", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = scan(df, keep=["doc_id"], detectors=detectors)
    assert sorted((r.doc_id, r.start_pos, r.matched_value) for r in got.collect()) == [
        (0, 3, ".1@example.com"), (0, 18, "a@b.org"), (0, 29, "台北市中正區重慶南路1號"),
        (1, 0, "a@b.org"), (1, 8, "xa@b.org"), (1, 17, "a@b.org"), (1, 25, "中山路1號"), (1, 31, "中山路1號"),
        (2, 1, "a@b.org"), (2, 8, "+a@b.org"),
    ]
    for row in got.where("doc_id is not null").collect():
        assert texts[row.doc_id][row.start_pos :].startswith(row.matched_value)
    found = df.select(EMAIL.candidates(F.col("text")).alias("c")).collect()
    assert found[0].c == [".1@example.com", "a@b.org"]  # the groups themselves, not the matches around them


def test_one_or_two_matches_are_placed_by_plain_columns(spark):
    """Lambdas are interpreted, per text and detector; a search that stops at an equal string which is no match is not taken."""
    texts = ["護照 000651749 a", "健保卡 000000651749 護照 000651749 H261200331", "123456789 123456789", "1 2 3 4", "none", None]
    expected = [[3], [20, 31], [0, 10], None, None, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    text, found, first, second = (F.col(c) for c in ("text", "found", "first", "second"))
    pattern = r"(?<!\d)\d(?:\d{8})?(?!\d)"
    df = df.withColumn("found", matches.whole_matches(text, pattern))
    places = matches.first_places(text, found)
    unique = df.select("i", "text", "found", places[0].alias("first"), places[1].alias("second")).select(
        "i", "text", "found", matches.unique_offsets(text, found, first, second).alias("unique")
    )
    assert "lambda" not in unique._jdf.queryExecution().optimizedPlan().toString()
    rows = unique.select("unique", matches.split_offsets(text, pattern, found).alias("split")).orderBy("i").collect()
    assert [r.split for r in rows] == expected
    assert [r.unique for r in rows] == [[3], None, None, None, None, None]
    passports = scan(df.withColumnRenamed("i", "doc_id"), keep=["doc_id"], detectors=["RegexPassportScanner"]).collect()
    assert sorted((r.doc_id, r.start_pos) for r in passports) == [(0, 3), (1, 20), (1, 31), (2, 0), (2, 10)]
