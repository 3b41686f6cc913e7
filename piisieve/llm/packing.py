"""Packing token sequences as a cutting-stock problem, solved by column generation over a histogram of lengths."""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from piisieve.llm.common import sliced, worker_state, written
from piisieve.llm.pretokens import CACHED_PRETOKENS, Pretokenizer

SEQUENCE_TOKENS = 2048
END_ID = 1
# Lengths are counted in classes of so many tokens, rounded up. The linear program has a row per class, so its size
# does not grow with the documents; what rounding wastes is less than this per piece.
CLASS_TOKENS = 8
# The linear program is solved to within this share of its optimum.
GAP = 1e-3
_TOLERANCE = 1e-7


# ---- The cutting-stock problem --------------------------------------------------------------------


def _best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the pattern of greatest value that fits."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fitting = np.searchsorted(sizes, room, side="right")
        best[room] = best[room - 1]
        if fitting:
            gained = best[room - sizes[:fitting]] + values[:fitting]
            at = int(np.argmax(gained))
            if gained[at] > best[room] + 1e-12:
                best[room], taken[room] = gained[at], at
    pattern, room = np.zeros(len(sizes), int), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            pattern[taken[room]] += 1
            room -= sizes[taken[room]]
    return float(best[capacity]), pattern


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By elimination with plain array operations.

    The library's own inversion starts threads, which can wait for ever in a driver that has started other processes.
    """
    m = len(matrix)
    rows = np.hstack([matrix.astype(float), np.eye(m)])
    for at in range(m):
        best = at + int(np.argmax(np.abs(rows[at:, at])))
        rows[[at, best]] = rows[[best, at]]
        rows[at] /= rows[at, at]
        factor = rows[:, at].copy()
        factor[at] = 0
        rows -= factor[:, None] * rows[at]
    return rows[:, m:]


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", matrix, vector)


def relaxed_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one per row) and how often to use each, in fractions: fewest sequences that hold the demand.

    A revised simplex starts from patterns of one size each. The knapsack prices columns with the duals; if the best pattern is
    worth w sequences, the solution is at most w times the optimum, and it is good enough within GAP. Demand is
    raised a little at random against steps that change nothing. If the simplex is stopped at the limit of steps,
    its solution still holds the demand.
    """
    m = len(sizes)
    demand = demand * (1 + 1e-6 * np.random.default_rng(0).random(m))
    basis = np.diag(capacity // sizes).astype(float)
    cost = np.ones(m)
    inverse = np.diag(1 / np.diag(basis))
    for step in range(1, 10 * m + 1):
        duals = _times(inverse.T, cost)
        low = int(np.argmin(duals))
        if duals[low] < -_TOLERANCE:  # leave room in a pattern rather than fill it
            column, price = -np.eye(m)[low], 0.0
        else:
            worth, pattern = _best_pattern(np.maximum(duals, 0), sizes, capacity)
            if worth <= 1 + GAP:
                break
            column, price = pattern.astype(float), 1.0
        amounts, change = _times(inverse, demand), _times(inverse, column)
        usable = change > _TOLERANCE
        if not usable.any():
            break
        ratios = np.where(usable, np.maximum(amounts, 0) / np.where(usable, change, 1), np.inf)
        leaving = int(np.argmin(ratios))
        basis[:, leaving], cost[leaving] = column, price
        if step % 100 == 0:
            inverse = _inverse(basis)
        else:
            pivot = inverse[leaving] / change[leaving]
            inverse = inverse - change[:, None] * pivot
            inverse[leaving] = pivot
    amounts = np.maximum(_times(_inverse(basis), demand), 0)
    real = cost > 0
    return basis.T[real].astype(int), amounts[real]


def packing_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(repetitions, {size: pieces}) that together hold at least the histogram's pieces of each size.

    The relaxed solution is rounded down; the few pieces left over are packed largest first.
    """
    sizes = np.array(sorted(s for s, n in histogram.items() if n > 0), int)
    if not len(sizes):
        return []
    demand = np.array([histogram[s] for s in sizes.tolist()], float)
    patterns, amounts = relaxed_patterns(sizes, demand, capacity)
    whole = np.floor(amounts + 1e-6).astype(int)
    plan = [
        (int(n), {int(s): int(k) for s, k in zip(sizes, p, strict=True) if k})
        for p, n in zip(patterns, whole, strict=True)
        if n > 0
    ]
    left = np.maximum(demand.astype(int) - whole @ patterns, 0)
    while left.any():
        room, pattern = capacity, np.zeros_like(left)
        for at in range(len(sizes) - 1, -1, -1):
            pattern[at] = min(left[at], room // sizes[at])
            room -= pattern[at] * sizes[at]
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        plan.append((times, {int(s): int(k) for s, k in zip(sizes, pattern, strict=True) if k}))
        left = left - times * pattern
    return plan


# ---- Tokens and pieces ----------------------------------------------------------------------------


def token_pieces(
    df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = SEQUENCE_TOKENS
) -> DataFrame:
    """Rows (id_col, start, length, ids_crc32, doc_tokens): each document's ids and the end id, cut every `limit` ids.

    The ids are those of the `tokenizers` file, made from each distinct pre-token once per group of texts. A null or empty text
    is one piece of the end id alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pretokenizer = worker_state(f"pretokenizer {vocabulary}", lambda: Pretokenizer(vocabulary))
        encoded = worker_state(f"ids {vocabulary}", dict)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            at, rows = 0, []
            for texts in sliced(t.as_py() for t in batch.column(1)):
                split = [list(pretokenizer.pretokens(t)) for t in texts]
                distinct = set().union(*(part for parts in split for part in parts if isinstance(part, list)))
                if len(encoded) + len(distinct) > CACHED_PRETOKENS:
                    encoded.clear()
                for token, ids in pretokenizer.encode_pretokens(distinct.difference(encoded)):
                    encoded[token] = np.array(ids, "<u4").tobytes()
                for parts in split:
                    ids = b"".join(
                        b"".join(map(encoded.__getitem__, part)) if isinstance(part, list) else part.to_bytes(4, "little")
                        for part in parts
                    )
                    ids += end
                    for first in range(0, len(ids), 4 * limit):
                        piece = ids[first : first + 4 * limit]
                        rows.append((at, first // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4))
                    at += 1
            found = np.array(rows, np.int64).reshape(-1, 5)
            ids = batch.column(0).take(pa.array(found[:, 0]))
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(found[:, c]) for c in range(1, 5))], ["id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    return source.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def assign_sequences(
    pieces: DataFrame, *, id_col: str = "doc_id", limit: int = SEQUENCE_TOKENS, class_tokens: int = CLASS_TOKENS
) -> DataFrame:
    """`pieces` (with id_col, start, length up to `limit`) with sequence_id and offset.

    The histogram of length classes, of at most limit / class_tokens rows, goes to the driver, which returns patterns. The
    pieces of a class are ranked, and ranks are dealt to the slots that the patterns have for the class. A class may hold any
    number of pieces: it is ranked in shards by a hash, whose sizes are summed up. Equal pieces may change places.
    """
    spark = pieces.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("class", F.ceil(F.col("length") / class_tokens).cast("int"))
    histogram = {r["class"]: r["n"] for r in pieces.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, sequence, ranked = [], 0, dict.fromkeys(histogram, 0)
    for times, pattern in packing_plan(histogram, limit // class_tokens):
        for size, per_sequence in pattern.items():
            slots.append((size, ranked[size], ranked[size] + times * per_sequence, sequence, per_sequence))
            ranked[size] += times * per_sequence
        sequence += times
    # Patterns number a few hundred, whatever the documents, and hold few classes each.
    slots = F.broadcast(
        spark.createDataFrame(slots, "class int, first long, behind long, sequence long, per_sequence long")
    )
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64(id_col, "start"), F.lit(shards)).cast("int"))
    sizes = pieces.groupBy("class", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("class").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("class", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("class", "shard").orderBy(F.desc("length"), id_col, "start")
    numbered = pieces.withColumn("number", F.row_number().over(within) - 1).join(sizes, ["class", "shard"])
    numbered = numbered.withColumn("rank", F.col("base") + F.col("number"))
    placed = numbered.join(slots, "class").where("rank >= first and rank < behind")
    placed = placed.withColumn("sequence_id", F.expr("sequence + (rank - first) div per_sequence"))
    earlier = (
        Window.partitionBy("sequence_id").orderBy(F.desc("length"), id_col, "start").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
    return placed.drop("class", "shard", "number", "base", "rank", "first", "behind", "sequence", "per_sequence")


def pack(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset), one per piece.

    A document longer than a sequence is cut into whole sequences and a rest; no other is cut. Repeated rows are
    documents of their own; an empty table gives no rows; other columns are not read.
    """
    return assign_sequences(written(token_pieces(df, vocabulary, id_col=id_col, text_col=text_col)), id_col=id_col)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
