"""The name detector: chunks, joined entities, de-duplication, scores."""

import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from piisieve import NameDetector, default_registry, scan
from piisieve.functions.matches import LONG_TEXT
from piisieve.operators.names import chunk_text, clean_entities, locate_entities, merge_touching

ENTITY = "struct<entity_group:string,word:string,start:int,end:int,score:double>"


def gazetteer():
    """Predictor that knows a few names; each character is its own entity, as word pieces are."""
    names = {"王小明": "PERSON", "陳大文": "PERSON", "台北": "GPE"}

    def predict(chunks):
        results = []
        for chunk in chunks:
            entities = []
            for name, group in names.items():
                at = chunk.find(name)
                while at >= 0:
                    for i, c in enumerate(name):
                        word = c if i == 0 else "##" + c
                        entities.append(
                            {"entity_group": group, "word": word, "start": at + i, "end": at + i + 1, "score": 0.9 + i / 100}
                        )
                    at = chunk.find(name, at + 1)
            results.append(sorted(entities, key=lambda e: e["start"]))
        return results

    return predict


def names(spark, texts, factory=gazetteer):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = scan(df, keep=["doc_id"], detectors=[NameDetector(predictor_factory=factory)]).collect()
    return sorted(rows, key=lambda r: (r.doc_id, r.start_pos))


@pytest.mark.parametrize("n", [0, 1, 499, 500, 501, 900, 901, 920, 950, 951, 5000])
def test_chunks(spark, n):
    text = "".join("文a😀"[i % 3] for i in range(n))
    chunks = spark.createDataFrame([(text,)], "t string").select(chunk_text(F.col("t")).alias("c")).first().c
    if n <= 500:
        assert chunks == [text]
    else:
        assert chunks == [text[i : i + 500] for i in range(0, n, 450)]


def test_names_in_text(spark):
    text = "我" * 60 + "王小明在台北" + "他" * 60
    (row,) = names(spark, [text, "  \n\x1c", "no one"])
    assert (row.matched_value, row.start_pos, row.confidence_score) == ("王小明", 60, 0.92)
    assert row.context == text[10:113]
    assert (row.pii_type, row.scanner_source, row.location) == ("PERSON_NAME", "NlpNameScanner", "附近 (char ~60)")


def test_overlap_is_reported_once(spark):
    """A name inside two chunks is one finding; one cut by a chunk's end also leaves its cut part."""
    text = "我" * 460 + "王小明" + "我" * 35 + "陳大文" + "我" * 400
    found = [(r.matched_value, r.start_pos) for r in names(spark, [text])]
    assert found == [("王小明", 460), ("陳大文", 498)]


def test_names_in_a_long_text(spark):
    """Beyond LONG_TEXT contexts are cut from blocks; every name is found once, at chunk edges too."""
    text = "".join("我😀" * (150 + i % 7) + "王小明" for i in range(300))
    assert len(text) > LONG_TEXT
    found = names(spark, [text])
    assert [r.start_pos for r in found if r.matched_value == "王小明"] == [m.start() for m in re.finditer("王小明", text)]
    for r in found:
        assert r.context == text[max(0, r.start_pos - 50) : r.start_pos + len(r.matched_value) + 50]


def test_failing_predictor_gives_no_names_for_that_text_only(spark):
    def factory():
        inner = gazetteer()

        def predict(chunks):
            if "壞" in chunks[0]:
                raise RuntimeError("model failed")
            return inner(chunks)

        return predict

    found = names(spark, ["壞王小明", "王小明"], factory)
    assert [(r.doc_id, r.matched_value) for r in found] == [(1, "王小明")]


@pytest.mark.parametrize("score", [1.5, -0.1, float("nan")])
def test_score_outside_range_voids_the_document(spark, score):
    def factory():
        return lambda chunks: [
            [
                {"entity_group": "PERSON", "word": "ok", "start": 0, "end": 2, "score": 0.5},
                {"entity_group": "PERSON", "word": "bad", "start": 5, "end": 8, "score": score},
            ]
            for _ in chunks
        ]

    assert names(spark, ["some text"], factory) == []


def test_score_is_rounded_on_its_binary_value(spark):
    def factory():
        return lambda chunks: [
            [{"entity_group": "PERSON", "word": "a", "start": 0, "end": 1, "score": 0.12345}] for _ in chunks
        ]

    assert names(spark, ["a text"], factory)[0].confidence_score == round(0.12345, 4)


def entities(spark, chunks):
    return spark.createDataFrame([(chunks,)], f"chunks array<array<{ENTITY}>>")


def test_merge_touching(spark):
    chunk = [
        ("PERSON", "王", 0, 1, 0.9),
        ("PERSON", "", 7, 7, 0.1),
        ("PERSON", "##小 明", 1, 3, 0.8),
        ("ORG", "社", 3, 4, 0.5),
        ("ORG", "團", 5, 6, 0.6),
    ]
    row = entities(spark, [chunk]).select(merge_touching(clean_entities(F.get("chunks", 0))).alias("m")).first()
    assert [tuple(e) for e in row.m] == [
        ("PERSON", "王小明", 0, 3, 0.9),
        ("ORG", "社", 3, 4, 0.5),
        ("ORG", "團", 5, 6, 0.6),
    ]


def test_first_chunk_wins(spark):
    chunks = [
        [("PERSON", "王", 460, 461, 0.7), ("ORG", "x", 2, 3, 0.9)],
        [("PERSON", "王", 10, 11, 0.9), ("PERSON", "李", 10, 12, 0.8)],
    ]
    row = entities(spark, chunks).select(locate_entities(F.col("chunks")).alias("e")).first()
    assert sorted((e.start, e.word, e.score) for e in row.e) == [(460, "李", 0.8), (460, "王", 0.7)]


def test_detector_is_only_registered_with_a_predictor():
    assert "NlpNameScanner" not in [d.name for d in default_registry().all()]
    assert "NlpNameScanner" in [d.name for d in default_registry(gazetteer).all()]
    with pytest.raises(TypeError):
        NameDetector()


def test_predictor_is_loaded_once_per_worker(spark, tmp_path):
    log = str(tmp_path / "loads")

    def factory():
        with open(log, "a") as file:
            file.write(f"{os.getpid()}\n")
        return lambda chunks: [[] for _ in chunks]

    df = spark.range(64).selectExpr("id AS doc_id", "'text' AS text").repartition(32)
    detector = NameDetector(predictor_factory=factory)
    for _ in range(2):
        scan(df, keep=["doc_id"], detectors=[detector]).collect()
    loads = Path(log).read_text().split()
    assert len(loads) == len(set(loads)) <= 16
