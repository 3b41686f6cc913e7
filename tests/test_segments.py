"""Texts scanned in segments give the rows of the whole-text scan, on every cut size."""

import random

from piisieve.operators.scan import scan
from piisieve.operators.segments import cut_points, scan_segments
from pyspark.sql import functions as F

PIECES = [
    "ID:A123456789,", "a@b.com", "x.y@mail.example.org", "卡 4111-1111-1111-1111.", "健保卡000012345678",
    "電話:0912-345-678", "TEL +886 2 2345 6789", "護照123456789號", "台北市中正區重慶南路一段122號3樓", "0912 345\n678",
    "word", "文字", "12345", "\n", " ", "  ", "\t\n", "   ", "-", "ID", "電話", "身分證",
]


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_segments_equal_whole_scan(spark):
    rng = random.Random(11)
    texts = [(i, "".join(rng.choice(PIECES) + rng.choice(["", " ", "  ", "\n\n"]) for _ in range(rng.randint(0, 120))))
             for i in range(40)]
    texts += [(40, None), (41, ""), (42, "  "), (43, "a@b.com" * 50)]
    df = spark.createDataFrame(texts, "doc_id long, text string").cache()
    whole = _rows(scan(df, keep=["doc_id"]))
    assert whole
    for size in (1, 2, 3, 5, 8, 13, 40, 101, 400, 5000):
        assert _rows(scan_segments(df, keep=["doc_id"], size=size, partitions=3)) == whole, size


def test_cut_points(spark):
    df = spark.createDataFrame([("ab  cd  ef",), ("",), ("abcdef",)], "t string")
    got = [r.c for r in df.select(cut_points(F.col("t"), 3).alias("c")).collect()]
    assert got == [[0, 7, 10], [0], [0, 6]]  # the pair at 2-3 starts before the second block


def test_segmented_query_equals_whole_query(spark):
    from catalog.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    assert _rows(QUERIES["scan_documents_in_segments"](spark, sf)) == _rows(QUERIES["scan_all_documents"](spark, sf))


def test_chosen_detectors_and_unknown_names(spark):
    import pytest

    text = "ID:A123456789,  a@b.com  電話:0912-345-678  " * 40
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    names = ["RegexEmailScanner", "RegexPhoneScanner"]
    from piisieve.operators.builtin import BUILTIN

    chosen = [d for d in BUILTIN if d.name in names]
    assert len(chosen) == 2
    assert _rows(scan_segments(df, keep=["doc_id"], detectors=names, size=50)) == _rows(scan(df, keep=["doc_id"], detectors=chosen))
    with pytest.raises(ValueError):
        scan_segments(df, keep=["doc_id"], detectors=["NoSuchScanner"])
