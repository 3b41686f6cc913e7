"""Byte-level BPE: encoding by a priority queue of merge ranks, decoding by concatenation."""

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piisieve.llm.common import worker_state
from piisieve.llm.pretokens import Pretokenizer

# Encoded pre-tokens that a worker keeps; beyond this many it starts anew.
CACHED_PRETOKENS = 250_000
# Longer pre-tokens are rare and are encoded anew each time.
CACHED_LENGTH = 64
# Batches are handled in runs of rows of about so many bytes, so that memory follows the longest row.
SLICE_BYTES = 1 << 20
_POSITION_BITS = 40


def _printable_bytes() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class Merges:
    """The vocabulary of a byte-level tokenizer file as byte ids and ranked merges."""

    def __init__(self, pretokenizer: Pretokenizer):
        vocab = pretokenizer.model["vocab"]
        names = _printable_bytes()
        self.byte_ids = [vocab[name] for name in names]
        self.ranks: dict[tuple[int, int], int] = {}
        self.left, self.right, self.merged = [], [], []
        for rank, pair in enumerate(pretokenizer.model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a], vocab[b]] = rank
            self.left.append(vocab[a])
            self.right.append(vocab[b])
            self.merged.append(vocab[a + b])

    def encode(self, piece: bytes) -> list[int]:
        """Merge the lowest-ranked pair, the leftmost of equal ranks, until no pair is left.

        The symbols form a doubly linked list. The queue holds a pair as rank and position of its left symbol;
        an entry whose pair no longer stands there is stale and skipped.
        """
        ids = [self.byte_ids[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        ranks, left, right, merged = self.ranks, self.left, self.right, self.merged
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            rank = ranks.get((ids[i], ids[i + 1]))
            if rank is not None:
                queue.append(rank << _POSITION_BITS | i)
        heapify(queue)
        position = (1 << _POSITION_BITS) - 1
        while queue:
            entry = heappop(queue)
            rank, i = entry >> _POSITION_BITS, entry & position
            j = after[i]
            if j == n or ids[i] != left[rank] or ids[j] != right[rank]:
                continue
            symbol = ids[i] = merged[rank]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get((symbol, ids[k]))
                if rank is not None:
                    heappush(queue, rank << _POSITION_BITS | i)
            h = before[i]
            if h >= 0:
                rank = ranks.get((ids[h], symbol))
                if rank is not None:
                    heappush(queue, rank << _POSITION_BITS | h)
        return [i for i in ids if i >= 0]


def _strings(vocabulary: str) -> dict[int, bytes]:
    """The bytes of each id."""

    def build():
        with open(vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        bytes_of = {name: bytes([b]) for b, name in enumerate(_printable_bytes())}
        strings = {i: b"".join(bytes_of[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        return strings | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}

    return worker_state(f"strings {vocabulary}", build)


class _Encoded(dict):
    """Ids of pre-tokens as little-endian unsigned 32-bit integers, encoded when first asked for."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, token: str) -> bytes:
        ids = np.array(self.merges.encode(token.encode()), "<u4").tobytes()
        if len(token) <= CACHED_LENGTH:
            if len(self) >= CACHED_PRETOKENS:
                self.clear()
            self[token] = ids
        return ids


def _tools(vocabulary: str) -> tuple[Pretokenizer, Merges, _Encoded]:
    def build():
        pretokenizer = Pretokenizer(vocabulary)
        merges = Merges(pretokenizer)
        pretokenizer.model = None  # the parsed file is large
        return pretokenizer, merges, _Encoded(merges)

    return worker_state(f"merges {vocabulary}", build)


def _encode_text(text: str, pretokenizer: Pretokenizer, encoded: _Encoded) -> bytes:
    parts: list[bytes] = []
    for part in pretokenizer.pretokens(text):
        if isinstance(part, int):
            parts.append(part.to_bytes(4, "little"))
        else:
            parts.extend(map(encoded.__getitem__, part))
    return b"".join(parts)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows in order, in runs with about SLICE_BYTES in their second column; a longer row stands alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def bpe_encode(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, ids): the ids of each whole text as little-endian unsigned 32-bit integers in a binary.

    Special tokens that stand in a text get their ids; none are added. A null or empty text has no ids.
    Each row is encoded by itself, nothing is shuffled. Repeated rows give repeated results; other columns
    are not read. Very long texts are encoded whole; an empty table gives an empty result.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pretokenizer, _, encoded = _tools(vocabulary)
        for batch in _slices(batches):
            ids = [_encode_text(text or "", pretokenizer, encoded) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(encode, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def bpe_decode(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id_col, ids_col, decoded): the vocabulary's strings of the ids, concatenated; special tokens included.

    Bytes that are no UTF-8 are replaced as Unicode recommends. Null ids decode to an empty text.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        string = _strings(vocabulary).__getitem__
        for batch in _slices(batches):
            texts = [
                b"".join(map(string, np.frombuffer(ids or b"", "<u4").tolist())).decode("utf-8", "replace")
                for ids in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "ids", "decoded"]
            )

    source = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = source.schema["id"].dataType.simpleString()
    decoded = source.mapInArrow(decode, f"id {kind}, ids binary, decoded string")
    return decoded.withColumnsRenamed({"id": id_col, "ids": ids_col})


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_decode(bpe_encode(docs, path), path).select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
