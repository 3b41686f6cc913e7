"""Token counts per text from the pieces of its distinct pre-tokens."""

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piisieve.llm.common import sliced, worker_state
from piisieve.llm.pretokens import CACHED_PRETOKENS, Pretokenizer

TOKEN_LIMIT = 512


def _count_slice(texts: list[str], pretokenizer: Pretokenizer, pieces: dict[str, int]) -> list[int]:
    """Frequencies per text, joined to the pieces of each distinct pre-token, and summed."""
    frequencies, specials = [], []
    for text in texts:
        counts: Counter[str] = Counter()
        special = 0
        for part in pretokenizer.pretokens(text):
            if isinstance(part, int):
                special += 1
            else:
                counts.update(part)
        frequencies.append(counts)
        specials.append(special)
    distinct = set().union(*frequencies)
    if len(pieces) + len(distinct) > CACHED_PRETOKENS:
        pieces.clear()
    for token, ids in pretokenizer.encode_pretokens(distinct.difference(pieces)):
        pieces[token] = len(ids)
    return [
        special + sum(n * pieces[token] for token, n in counts.items())
        for counts, special in zip(frequencies, specials, strict=True)
    ]


def token_counts(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_bytes, n_tokens): the tokens that the `tokenizers` file `vocabulary` gives each text.

    The pre-tokens of a text are counted, each distinct pre-token's pieces are counted once for the texts
    handled together (and kept for later ones of the same worker), and frequency times pieces is summed.
    No ids are made per text, nothing is shuffled, and a row costs no more than its own text. A null or
    empty text has no tokens; repeated rows give repeated results; other columns are not read. Very long texts are
    counted whole; an empty table gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pretokenizer = worker_state(f"pretokenizer {vocabulary}", lambda: Pretokenizer(vocabulary))
        pieces = worker_state(f"pieces {vocabulary}", dict)
        for batch in batches:
            counts = [n for part in sliced(batch.column(1).to_pylist()) for n in _count_slice(part, pretokenizer, pieces)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    source = df.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
    )
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
