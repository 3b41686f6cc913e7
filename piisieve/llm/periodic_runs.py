"""Periodic runs of words by maximal-pair enumeration over an LCP-interval tree.

A run is a stretch of consecutive words with smallest period q, at least max(6, 4q) words long, that no neighbouring
word extends with period q. With the period's first copy taken off, a run of length L is a repeat of L - q >= 3q words
that occurs at the distances q: the pair of positions (s, s + q) is a *maximal pair* (equal for exactly L - q words, with
different words, or the text's edge, on both sides). The other way round, every maximal pair (i, i + d) of length
l >= 3d, l + d >= 6 is a stretch of period d that cannot be extended; its smallest period divides d and spans the same
words. So runs are found without extending anything:

1. The words are coded as integers, and a suffix array is built by prefix doubling (numpy sorts); the rank arrays of
   the rounds give the LCP of neighbouring suffixes by binary lifting.
2. The LCP intervals are closed bottom-up with a stack. A node of depth l >= 5 keeps its leaves' positions in a sorted
   list; merging a child into it pairs each position of the smaller side with its nearest positions on the larger side.
   A pair of different left words (the class of a leaf is its left word) at distance d with l >= 3d and l + d >= 6 is a
   maximal pair of the node: a run (i, l + d, d). Only nearest positions are needed: no position of the node lies
   between s and s + q, else the run would have a smaller period. Nodes shallower than 5 words emit nothing, so they
   keep no lists, and words that only stand in shallow nodes are never visited.
3. Per (start, length) the smallest period stays.

Each document is its own unit of work: a Python task gets one text at a time, and its cost is about n log n in the
document's words. Spark parallelises over documents; one very long document stays in one task, bounded by its own size.

Defined results: a null text has no words (n = 0) and no runs; a null doc_id is taken as not planted (no change to
the words). Empty and very long texts are whole; repeated rows give repeated results; ties of the longest run go to the
smallest start, then the smallest period. Extra input columns are not carried. An empty table gives an empty result.
"""

import bisect
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piisieve.llm.common import words

# Fixed values of the contract: shortest run, smallest exponent.
MIN_LENGTH, MIN_EXPONENT = 6, 4
# A maximal pair of a run has at least this many equal words: l >= 3d and l + d >= 6 give l >= 5.
MIN_DEPTH = 5

SCHEMA = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def planted(doc_id: int | None, tokens: list) -> list:
    """The contract's change of a document's words: from word a on, the words a .. a + p - 1 repeat."""
    n = len(tokens)
    if doc_id is None or n == 0:
        return tokens
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return tokens
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return tokens[:a] + [tokens[a + (i - a) % p] for i in range(a, n)]


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix array of positive integer codes by prefix doubling, with the rank array of each prefix length."""
    n = len(codes)
    rank = codes.astype(np.int64)
    levels = []
    k = 1
    while True:
        levels.append((k, rank))
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] if k < n else second[:0]
        order = np.argsort(rank * (n + 1) + second)
        ranked, seconds = rank[order], second[order]
        changed = np.ones(n, bool)
        changed[1:] = (ranked[1:] != ranked[:-1]) | (seconds[1:] != seconds[:-1])
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(changed)
        if new.max() == n or k >= n:
            return order, levels + [(2 * k, new)]
        rank, k = new, 2 * k


def neighbour_lcp(order: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """lcp[i] = number of equal leading words of the suffixes order[i - 1] and order[i]; lcp[0] = 0."""
    n = len(order)
    left, right = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    for k, rank in reversed(levels):
        a, b = left + common, right + common
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[inside] = rank[a[inside]] == rank[b[inside]]
        common += k * same
    return np.concatenate([[0], common])


def find_runs(tokens: list) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a word sequence, sorted by start, then period."""
    n = len(tokens)
    if n < MIN_LENGTH:
        return []
    code: dict[bytes, int] = {}
    codes = np.fromiter((code.setdefault(t, len(code) + 1) for t in tokens), np.int64, n)
    order, levels = suffix_array(codes)
    lcp = neighbour_lcp(order, levels)
    deep = np.where(lcp >= MIN_DEPTH, lcp, 0)
    # Only leaves next to a deep boundary can belong to a deep node.
    after = np.concatenate([deep[1:], [0]])
    visit = np.flatnonzero((deep > 0) | (after > 0))
    left_word = np.concatenate([[0], codes[:-1]])  # 0: the text's edge, unlike any word
    found: dict[tuple[int, int], int] = {}

    def merge(depth: int, members: list[int], child: list[int]) -> list[int]:
        small, large = (child, members) if len(child) <= len(members) else (members, child)
        limit = depth // 3
        for x in small:
            at = bisect.bisect_left(large, x)
            for y in large[max(at - 1, 0) : at + 1]:
                i, j = (x, y) if x < y else (y, x)
                d = j - i
                if d <= limit and depth + d >= MIN_LENGTH and left_word[i] != left_word[j]:
                    key = (i, depth + d)
                    if d < found.get(key, n + 1):
                        found[key] = d
        if len(small) < 16:
            for x in small:
                bisect.insort(large, x)
        else:
            large.extend(small)
            large.sort()
        return large

    stack: list[list] = [[0, []]]
    for i in visit:
        child = [int(order[i])]
        h = int(after[i])
        while stack[-1][0] > h:
            depth, members = stack.pop()
            child = merge(depth, members, child)
        if stack[-1][0] < h:
            stack.append([h, []])
        if stack[-1][0] > 0:
            stack[-1][1] = merge(stack[-1][0], stack[-1][1], child)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def describe(doc_id: int | None, text: str | None) -> tuple:
    """The result row of one document."""
    tokens = planted(doc_id, words(text))
    runs = find_runs(tokens)
    n = len(tokens)
    dropped = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        dropped[s + q] += 1
        dropped[s + length] -= 1
    keep = np.cumsum(dropped[:n]) == 0
    kept = b" ".join(t for t, k in zip(tokens, keep) if k)
    listing = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, n, len(runs), *top, hashlib.sha256(listing).hexdigest(), hashlib.sha256(kept).hexdigest())


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its runs' count, longest run, digest of all runs and of the text without repeats."""
    fields = [c.split(" ") for c in SCHEMA.split(", ")]
    schema = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in fields])

    def run(batches):
        for batch in batches:
            rows = [describe(d, t) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)] if rows else
                                             [pa.array([], f.type) for f in schema], schema=schema)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, SCHEMA)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return periodic_runs(docs)
