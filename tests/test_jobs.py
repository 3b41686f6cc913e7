"""Registry, Python detectors, reports, whole jobs and plans."""

import pytest
from pyspark.sql import functions as F

from piisieve import (
    PythonDetector, Registry, RuleDetector, default_registry, findings_of, scan, scan_documents,
    scan_files, scan_new_files, write_report,
)
from piisieve.functions.scoring import mask_value, risk_tier
from piisieve.plans.report import default_report_name, report_is_due
from piisieve.schema import FINDING_SCHEMA, status_label, validation_label


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.txt").write_text("mail a@b.com and 4111 1111 1111 1111")
    (root / "b.html").write_text("<i>電話:0912-345-678</i>")
    (root / "c.bin").write_bytes(b"\x00\x01")
    (root / ".hidden").write_text("c@d.org")
    return str(root)


def test_registry_selection(caplog):
    registry = default_registry()
    assert [d.pii_type for d in registry.select(["regexEMAILscanner", "nope", "RegexEmailScanner"])] == ["EMAIL"]
    assert "nope" in caplog.text
    assert len(registry.select()) == len(registry.select([])) == 7
    assert registry.select(["nope"]) == []


def test_registry_ignores_second_and_broken(caplog):
    first = RuleDetector(name="One", pii_type="A", pattern="a")
    registry = Registry([first])
    registry.add(RuleDetector(name="ONE", pii_type="B", pattern="b"))
    registry.add_built(lambda: RuleDetector(name="Two", pii_type="", pattern="b"))
    registry.add_built(lambda: RuleDetector(name="Three", pii_type="C", pattern="c", score=2.0))
    assert registry.all() == [first]


def test_unselected_detectors_are_not_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a@b.com 4111111111111111")], "doc_id int, text string")
    out = scan(df, keep=["doc_id"], detectors=["RegexEmailScanner"])
    assert [r.pii_type for r in out.collect()] == ["EMAIL"]
    assert "luhn" not in out._jdf.queryExecution().executedPlan().toString().lower()
    assert scan(df, keep=["doc_id"], detectors=["nope"]).count() == 0
    assert scan(df, keep=["doc_id"], detectors=[]).count() == 2


def test_own_rule_detector(spark):
    detector = RuleDetector(
        name="Plate", pii_type="PLATE", pattern=r"[A-Z]{3}-\d{4}", score=0.5, positive=["car"], window=6
    )
    df = spark.createDataFrame([(1, "my car ABC-1234, ABC-9999")], "doc_id int, text string")
    rows = scan(df, keep=["doc_id"], detectors=[detector]).collect()
    assert [(r.matched_value, r.confidence_score, r.start_pos, r.context) for r in rows] == [
        ("ABC-1234", 0.6, 7, "y car ABC-1234, ABC-"),
        ("ABC-9999", 0.5, 17, "1234, ABC-9999"),
    ]


def test_python_detector_is_isolated(spark):
    def find(text):
        if "boom" in text:
            raise RuntimeError("boom")
        score = 7 if "wild" in text else 0.5
        return [{"matched_value": "key", "confidence_score": score, "start_pos": text.index("key")}] if "key" in text else []

    detector = PythonDetector(name="Key", pii_type="KEY", scan=find)
    texts = ["a key here", "boom key a@b.com", "wild key", "none", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = scan(df, keep=["doc_id"], detectors=[detector, "RegexEmailScanner"]).collect()
    assert sorted((r.doc_id, r.pii_type, r.matched_value, r.context) for r in rows) == [
        (0, "KEY", "key", "a key here"),
        (1, "EMAIL", "a@b.com", "boom key a@b.com"),
    ]


def test_scan_runs_each_pattern_once_and_never_shuffles(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = scan(df, keep=["doc_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 7 + 1 + 2  # patterns, blocks, groups of two patterns
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_condition_on_findings_runs_nothing_twice(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    documents = df.select(F.col("doc_id").cast("string"), F.lit("p").alias("file_path"), "text")
    out = scan_documents(documents).where(F.size("findings") > 0).select("doc_id", "findings")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 7 + 1 + 2
    assert out.count() == scan(df, keep=["doc_id"]).select("doc_id").distinct().count()


def test_scan_of_a_folder(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    outcome = scan_files(spark, folder, out)
    assert (outcome.findings, outcome.failed_files) == (4, 0)
    report = spark.read.parquet(outcome.report)
    assert report.columns == ["個資類型", "符合內容", "信賴分數", "檔案路徑", "掃描來源", "上下文", "risk_tier"]
    assert sorted(r["符合內容"] for r in report.collect()) == ["0912-345-678", "4111 1111 1111 1111", "a@b.com", "c@d.org"]
    statuses = {r.file_path.rsplit("/", 1)[1]: r.status for r in spark.read.parquet(outcome.documents).collect()}
    assert statuses == {"a.txt": "COMPLETED", "b.html": "COMPLETED", "c.bin": "SKIPPED", ".hidden": "COMPLETED"}
    with pytest.raises(Exception, match="already exists"):
        scan_files(spark, folder, out)
    again = scan_files(spark, folder, out, detectors=["RegexEmailScanner"], overwrite=True)
    assert again.findings == 2


def test_scan_with_unknown_detectors_stops(spark, folder, tmp_path):
    assert scan_files(spark, folder, str(tmp_path / "o"), detectors=["nope"]) is None
    assert not (tmp_path / "o").exists()


def test_nothing_found_writes_an_empty_report(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("nothing")
    outcome = scan_files(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    report = spark.read.parquet(outcome.report)
    assert report.count() == 0 and report.columns[0] == "個資類型"


@pytest.mark.parametrize("findings,failed,due", [(0, 0, True), (0, 1, False), (1, 1, True), (3, 0, True)])
def test_report_gate(findings, failed, due):
    assert report_is_due(findings, failed) is due


def test_default_name():
    from datetime import datetime

    assert default_report_name(datetime(2024, 1, 2, 3, 4, 5)) == "scan_report_20240102_030405"


def test_findings_schema(spark):
    documents = spark.createDataFrame([("1", "p", "a@b.com")], "doc_id string, file_path string, text string")
    out = findings_of(scan_documents(documents))
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in FINDING_SCHEMA]


@pytest.mark.parametrize("file_format", ["parquet", "csv", "json"])
def test_report_formats(spark, tmp_path, file_format):
    documents = spark.createDataFrame([("1", "p", 'say "a@b.com"\n, c@d.org')], "doc_id string, file_path string, text string")
    findings = findings_of(scan_documents(documents))
    path = str(tmp_path / file_format)
    write_report(findings, path, file_format, partition_by=["risk_tier"])
    reader = spark.read.option("header", "true").option("escape", '"')
    if file_format == "csv":
        reader = reader.option("multiLine", "true")
    rows = reader.format(file_format).load(path).collect()
    assert sorted(r["符合內容"] for r in rows) == ["a@b.com", "c@d.org"]
    assert {r["risk_tier"] for r in rows} == {"medium"}


def test_tiers_and_masks(spark):
    tiers = [(0.0, "very_low"), (0.49, "very_low"), (0.5, "low"), (0.59, "low"), (0.6, "medium"), (0.79, "medium"), (0.8, "none"), (1.0, "none")]
    for row in spark.createDataFrame(tiers, "s double, t string").select("t", risk_tier(F.col("s")).alias("r")).collect():
        assert row.t == row.r
    masks = [("abc", "***"), ("", "***"), ("abcd", "a...d"), ("A123456789", "A1...89"), ("文字文字文字文字", "文字...文字")]
    for row in spark.createDataFrame(masks, "v string, m string").select("m", mask_value(F.col("v")).alias("r")).collect():
        assert row.m == row.r


def test_labels(spark):
    row = spark.range(1).select(status_label(F.lit("SKIPPED")).alias("s"), validation_label(F.lit("VALID")).alias("v")).first()
    assert (row.s, row.v) == ("已跳過", "驗證通過")


def test_new_files_are_scanned_once(spark, folder, tmp_path):
    """Hidden and empty files have rows, as in the batch scan; a restart reads nothing twice."""
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    scan_new_files(spark, folder, out, checkpoint).awaitTermination()
    assert findings_of(spark.read.parquet(out)).count() == 4  # with c@d.org of .hidden
    assert spark.read.parquet(out).count() == 4
    with open(folder + "/new.txt", "w") as file:
        file.write("new@x.org")
    open(folder + "/.empty", "w").close()
    scan_new_files(spark, folder, out, checkpoint).awaitTermination()
    assert findings_of(spark.read.parquet(out)).count() == 5
    assert sorted(r.file_path.rsplit("/", 1)[-1] for r in spark.read.parquet(out).collect()) == [
        ".empty", ".hidden", "a.txt", "b.html", "c.bin", "new.txt"
    ]
    scan_new_files(spark, folder, out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == 6
