"""A quality classifier by compression: which dictionary, of good or of bad text, compresses a text better?"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from piisieve.llm.common import fold

# Bounds of the fit: labelled texts per class, one half for the dictionary and one for the calibration, and what a
# dictionary takes of one text at most. Scoring and calibration read whole texts.
TEXTS_PER_CLASS = 2400
SAMPLE_BYTES = 32 << 10
DICTIONARY_BYTES = 110 << 10
# A text is compressed in pieces of so many bytes, so that the dictionary matters all along a long text.
PIECE_BYTES = 1024
LEVEL = 3
HELD_OUT_MODULUS, HELD_OUT_REST = 4, 2
THRESHOLD = 0.7


def _dictionary(samples: list[bytes]):
    import zstandard

    pieces = [s[i : i + PIECE_BYTES] for s in samples for i in range(0, len(s), PIECE_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes(), zstandard.DICT_TYPE_FULLDICT
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(pieces)[-DICTIONARY_BYTES:], zstandard.DICT_TYPE_RAWCONTENT


class _Measure:
    """The features of a text: normalised difference of its compressed sizes, and its size under the good dictionary per byte."""

    def __init__(self, good, bad):
        import zstandard

        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_dict_id=0)
        self.good, self.bad = (
            zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(data, dict_type=kind), compression_params=params
            ).compress
            for data, kind in (good, bad)
        )

    def __call__(self, text: str | None) -> tuple[float, float]:
        data = (text or "").encode()
        if not data:
            return 0.0, 0.0
        good = bad = 0
        for at in range(0, len(data), PIECE_BYTES):
            piece = data[at : at + PIECE_BYTES]
            good += len(self.good(piece))
            bad += len(self.bad(piece))
        return (bad - good) / (bad + good), good / len(data)


@dataclass(frozen=True)
class CompressionClassifier:
    """`good`, `bad`: dictionaries with their kind, or None if a class had no texts; then `share` is the score of all texts.

    The score is a logistic function of the two features with `weights`, the last one being the constant.
    """

    good: tuple[bytes, int] | None
    bad: tuple[bytes, int] | None
    weights: tuple[float, ...]
    share: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(features), self.share)
        at = features @ np.array(self.weights[:-1]) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(at, -500, 500)))


def _logistic(features: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Weighted logistic regression by Newton's method, with a slight pull to zero."""
    mean, spread = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.c_[(features - mean) / spread, np.ones(len(features))]
    beta, pull = np.zeros(x.shape[1]), 1e-3 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (label - p)) - pull @ beta
        beta = beta + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + pull, slope)
    inner = beta[:-1] / spread
    return (*map(float, inner), float(beta[-1] - inner @ mean))


def _measured(features: _Measure, texts: pa.Array) -> np.ndarray:
    """The features of each text; one text at a time leaves the Arrow batch, so no batch stands in memory a second time."""
    return np.array([features(t.as_py()) for t in texts]).reshape(-1, 2)


def _features(docs: DataFrame, good, bad) -> DataFrame:
    """docs (id, text) and further columns; text is replaced by the two features."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Measure(good, bad)
        for batch in batches:
            values = _measured(features, batch.column("text"))
            names = [n for n in batch.schema.names if n != "text"]
            columns = [batch.column(n) for n in names] + [pa.array(values[:, 0]), pa.array(values[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, [*names, "difference", "rate"])

    return docs.mapInArrow(measure, _without_text(docs, "difference", "rate"))


def _without_text(docs: DataFrame, *added: str) -> T.StructType:
    return T.StructType([f for f in docs.schema if f.name != "text"] + [T.StructField(n, T.DoubleType()) for n in added])


def fit_compression_classifier(docs: DataFrame, labels: DataFrame, *, texts_per_class: int = TEXTS_PER_CLASS) -> CompressionClassifier:
    """Fit on `docs` (doc_id, text) with `labels` (doc_id, label 0 or 1; rows with a null in either are passed over).

    At most `texts_per_class` labelled ids of each class are drawn, those lowest by a hash of the id. Every other one's
    text goes into the class's dictionary; the rest calibrate the score, weighted to the classes' true shares.
    """
    labels = labels.select("doc_id", F.col("label").cast("int").alias("label")).where("label in (0, 1)").dropna()
    counts = {r.label: r.n for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 1.0
    drawn = []
    for label in (0, 1):
        chosen = labels.where(F.col("label") == label).select("doc_id").distinct()
        rows = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(texts_per_class).collect()
        drawn += [(r.doc_id, label, at % 2) for at, r in enumerate(rows)]
    spark = docs.sparkSession
    kind = labels.schema["doc_id"].dataType.simpleString()
    chosen = spark.createDataFrame(drawn, f"doc_id {kind}, label int, half int")  # 2 x texts_per_class rows at most
    docs = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    samples: dict[int, list[bytes]] = {0: [], 1: []}
    cut = F.substring("text", 1, SAMPLE_BYTES)
    for row in docs.where("half = 0").select("label", cut.alias("text")).orderBy("label", F.xxhash64("doc_id")).collect():
        if row.text:
            samples[row.label].append(row.text.encode()[:SAMPLE_BYTES])
    if not samples[0] or not samples[1]:
        return CompressionClassifier(None, None, (), share)
    good, bad = _dictionary(samples[1]), _dictionary(samples[0])
    rows = _features(docs.where("half = 1").select("label", "text"), good, bad).collect()
    label = np.array([r.label for r in rows], float)
    if not 0 < label.sum() < len(label):
        return CompressionClassifier(None, None, (), share)
    mean = label.mean()
    weight = np.where(label == 1, share / mean, (1 - share) / (1 - mean))
    features = np.array([(r.difference, r.rate) for r in rows])
    return CompressionClassifier(good, bad, _logistic(features, label, weight), share)


def compression_scores(docs: DataFrame, model: CompressionClassifier) -> DataFrame:
    """The columns of `docs` without `text`, and `score`: from 0 to 1, higher for what looks more like the texts labelled 1.

    Whole texts are scored, row by row. An empty or null text compresses to nothing under either dictionary and scores
    what the calibration gives for that; without texts of both classes every score is the share of label 1, or 1 without any label.
    Very long texts are compressed whole; repeated rows are scored as often as they stand; an empty table gives an empty result.
    """
    if not model.weights:
        return docs.drop("text").withColumn("score", F.lit(model.share))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Measure(model.good, model.bad)
        for batch in batches:
            values = _measured(features, batch.column("text"))
            names = [n for n in batch.schema.names if n != "text"]
            columns = [*map(batch.column, names), pa.array(model.scores(values))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "score"])

    return docs.mapInArrow(score, _without_text(docs, "score"))


def compression_score(text: Column, model: CompressionClassifier) -> Column:
    """The score of `compression_scores` as a column: only the text goes to Python and only a number comes back."""
    if not model.weights:
        return F.lit(model.share)

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features = _Measure(model.good, model.bad)
        for texts in batches:
            yield pa.array(model.scores(_measured(features, texts)))

    return score(text)


def keep_good(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df`, with all their columns, that a classifier fitted on them and `labels` scores at THRESHOLD or more.

    The rows themselves stay in the JVM: sent along, each text would stand in an executor's memory several times more.
    """
    model = fit_compression_classifier(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)
    return df.where(compression_score(F.col(text_col), model) >= THRESHOLD)


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality labels that may be learnt from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learnt = fold(F.col("doc_id"), HELD_OUT_MODULUS) != HELD_OUT_REST
    return labels.where(learnt).select("doc_id", F.col("quality").alias("label"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scores = compression_scores(docs, fit_compression_classifier(docs, training_labels(spark, sf_dir)))
    return scores.select(
        "doc_id",
        # Nothing is learnt from a null id, so it counts as held out.
        F.coalesce(fold(F.col("doc_id"), HELD_OUT_MODULUS) == HELD_OUT_REST, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
