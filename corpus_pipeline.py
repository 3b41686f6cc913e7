"""A training corpus from `documents`: reject, deduplicate and pack, one operator per stage.

Each stage takes (spark, docs, sf_dir) and returns rows that are written as Parquet and read as the next one's docs. All but the
last return the columns of `documents`.
"""

from pyspark.sql import DataFrame, SparkSession

from piisieve.llm.common import written
from piisieve.llm.packing import pack
from piisieve.llm.quality_classifier import keep_good, training_labels
from piisieve.llm.quality_rules import passes_rules
from piisieve.llm.simhash import one_per_group
from piisieve.llm.substrings import without_repeats


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on the learnable labels of `docs`, does not reject."""
    return keep_good(docs, training_labels(spark, sf_dir))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the cascade of rules; null and empty texts do not."""
    return docs.where(passes_rules(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates by SimHash, as in `op2_simhash`."""
    return one_per_group(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 words or more that stand in one with a smaller id."""
    return without_repeats(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, placed in sequences of 2048."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]
# SQL can express neither compression, nor fingerprints and their components, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
