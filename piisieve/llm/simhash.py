"""SimHash near-duplicates: fingerprints compared exactly, tile by tile.

Distinct fingerprints are laid out by the population counts of their four 16-bit quarters and cut into tiles. Two
fingerprints with at most `RADIUS` differing bits differ by at most as much in these counts, so tile pairs whose
counts differ more are never formed; all others are compared whole by exclusive-or and bit counts.
"""

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from piisieve.llm.common import written
from piisieve.llm.components import connected_components

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
QUARTERS, QUARTER_BITS = 4, 16
TILE = 2048
# A fingerprint with more than one of so many rows is joined apart from the others.
HEAVY_SHARE = 1000
_BITS_AT_ONCE = 1 << 16


def shingle_hashes(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the word shingles in order; of all words if there are fewer than a shingle, none if there are none."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    tokens = (text or "").encode().lower().split()
    n = len(tokens)
    joined = b" ".join(tokens)
    if n <= shingle_words:
        return np.array([digest(joined, SEED)] if n else [], "<u8")
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = n - shingle_words + 1
    spans = zip(starts[:last].tolist(), ends[shingle_words - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), "<u8", last)


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; 0 if there are none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BITS_AT_ONCE):
        part = np.ascontiguousarray(hashes[at : at + _BITS_AT_ONCE], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: str | None) -> int:
    """64-bit fingerprint of the word shingles; of all words if there are fewer than a shingle, 0 if there are none."""
    return majority_bits(shingle_hashes(text))


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, fingerprint), the fingerprint as a signed 64-bit integer. Null texts count as empty."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(t) for t in batch.column(1).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["id", "fingerprint"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(hashed, f"id {kind}, fingerprint long").withColumnRenamed("id", id_col)


def compare_tiles(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (left, right) that connect what the links between two tiles connect.

    With fewer links than fingerprints these are the links; else each fingerprint's edge to the first one of its group, since
    a group of near copies has links in the square of its size.
    """
    rows, columns = [], []
    step = max(1, (1 << 22) // max(1, len(b)))
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        if same:
            later = j > i + at
            i, j = i[later], j[later]
        rows.append(i + at)
        columns.append(j)
    i, j = np.concatenate(rows), np.concatenate(columns)
    if len(i) <= len(a) + len(b):
        return a[i], b[j]
    nodes = a if same else np.concatenate((a, b))
    j = j if same else j + len(a)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    hung = label != np.arange(len(nodes))
    return nodes[hung], nodes[label[hung]]


def _counts(fingerprint: Column) -> list[Column]:
    mask = F.lit((1 << QUARTER_BITS) - 1).cast("long")
    return [
        F.bit_count(F.shiftrightunsigned(fingerprint, QUARTER_BITS * q).bitwiseAND(mask)).cast("int")
        for q in range(QUARTERS)
    ]


def near_links(distinct: DataFrame, *, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between the distinct `fingerprint`s that connect all with at most `radius` differing bits.

    A cell holds the fingerprints of equal population counts and is cut into tiles of about `tile` by a hash. There are at most
    17^4 cells, a bound that holds for any input, so the table of cells is broadcast.
    """
    base = QUARTER_BITS + 1
    cell = sum((c * base**q for q, c in enumerate(_counts(F.col("fingerprint")))), F.lit(0))
    placed = distinct.select("fingerprint", cell.alias("cell"))
    cells = written(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts")))
    placed = placed.join(F.broadcast(cells), "cell")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int"))
    tiles = placed.groupBy("cell", "part").agg(F.collect_list("fingerprint").alias("prints"))

    reach = range(-radius, radius + 1)
    steps = [s for s in product(reach, repeat=QUARTERS) if sum(map(abs, s)) <= radius and s >= (0,) * QUARTERS]
    step = F.explode(F.array(*[F.array(*map(F.lit, s)) for s in steps])).alias("step")
    moved = cells.select("cell", "parts", step)
    for q in range(QUARTERS):
        count = F.floor(F.col("cell") / base**q).cast("int") % base + F.get("step", q)
        moved = moved.where(count.between(0, QUARTER_BITS))
    shift = sum((F.get("step", q) * base**q for q in range(QUARTERS)), F.lit(0))
    moved = moved.select("cell", "parts", (F.col("cell") + shift).alias("cell_b"))
    others = cells.select(F.col("cell").alias("cell_b"), F.col("parts").alias("parts_b"))
    pairs = moved.join(F.broadcast(others), "cell_b")
    pairs = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = pairs.withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)))
    same = (F.col("cell") == F.col("cell_b")) & (F.col("part") == F.col("part_b"))
    pairs = pairs.where((F.col("cell") != F.col("cell_b")) | (F.col("part") <= F.col("part_b")))
    pairs = pairs.select("cell", "part", "cell_b", "part_b", same.alias("same"))
    met = pairs.join(tiles, ["cell", "part"]).withColumnRenamed("prints", "prints_a")
    tiles_b = tiles.select(F.col("cell").alias("cell_b"), F.col("part").alias("part_b"), F.col("prints").alias("prints_b"))
    met = met.join(tiles_b, ["cell_b", "part_b"]).select("same", "prints_a", "prints_b")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for at in range(batch.num_rows):
                a, b = (batch.column(c)[at].values.to_numpy().view(np.uint64) for c in (1, 2))
                found.append(compare_tiles(a, b, batch.column(0)[at].as_py(), radius))
            left, right = (np.concatenate([np.empty(0, np.uint64), *x]).view(np.int64) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], ["a", "b"])

    return met.mapInArrow(compared, "a long, b long")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Rows (id_col, fingerprint, component_id), one for each row: the smallest id that a chain of links reaches.

    Texts whose fingerprints differ in at most `radius` bits are linked. Null and empty texts have the fingerprint
    zero and are linked like any other. Null ids are never the smallest; a component of null ids alone has none. Repeated rows give repeated results; other
    columns are not read. Equal fingerprints are grouped before anything is compared, so copies cost nothing.
    Very long texts are fingerprinted whole; an empty table gives an empty result.
    """
    prints = written(fingerprints(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), id_col="id"))
    distinct = written(
        prints.groupBy("fingerprint").agg(F.min("id").alias("lowest"), F.count(F.lit(1)).alias("n"))
    )
    nodes = connected_components(near_links(distinct, radius=radius))
    joined = distinct.join(nodes, F.col("fingerprint") == F.col("node"), "left")
    joined = written(
        joined.select("fingerprint", "lowest", "n", F.coalesce("component", "fingerprint").alias("component"))
    )
    lowest = joined.groupBy("component").agg(F.min("lowest").alias("component_id"))
    classes = joined.join(lowest, "component").select("fingerprint", "n", "component_id")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") > total / HEAVY_SHARE  # fewer than HEAVY_SHARE fingerprints, whatever the input
    few = F.broadcast(classes.where(heavy).select("fingerprint", F.col("component_id").alias("heavy_id"), F.lit(True).alias("heavy")))
    marked = prints.join(few, "fingerprint", "left")
    light = marked.where("heavy is null").drop("heavy", "heavy_id").join(classes.where(~heavy).drop("n"), "fingerprint")
    dense = marked.where("heavy").select("fingerprint", "id", F.col("heavy_id").alias("component_id"))
    return light.unionByName(dense).select(F.col("id").alias(id_col), "fingerprint", "component_id")


def one_per_group(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df`, with all their columns, that stand for their group of `near_duplicates`: the smallest id and, under it, the lowest hash.

    Each text counts, also where several have one id; of rows with one id and one text one stays. Null texts and texts without words
    are one group. Rows without an id link nothing and stay as they are.
    """
    key = F.struct(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("hash")).alias("id")
    rows = df.select(key, F.struct("*").alias("row"))
    texts = df.select(key, F.col(text_col).alias("text")).where("id.doc is not null")
    keepers = near_duplicates(texts, id_col="id").where("id = component_id").select("id").distinct()
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.lit(0)))
    kept = rows.join(keepers, "id", "left_semi").withColumn("copy", first).where("copy = 1").select("row.*")
    return kept.unionByName(rows.where("id.doc is null").select("row.*"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))
