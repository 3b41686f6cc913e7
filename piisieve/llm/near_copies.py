"""Near copies by word shingles: SimHash finds the pairs tile by tile, their shingles decide.

Three differing bits of 64 find few of the texts that share four fifths of their shingles; those differ in about ten. So here a
text has 128 bits, taken from its set of shingles, and pairs within `RADIUS` of them are checked exactly. At that radius hardly
any two population counts differ by more, so tile pairs are skipped by the sizes of the sets, which differ by a quarter at most.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from piisieve.llm.common import written
from piisieve.llm.components import connected_components
from piisieve.llm.simhash import majority_bits, shingle_hashes

SHINGLE_WORDS = 5
# Similarity of two sets of shingles from which texts are near copies: shared ones in all, as a fraction of integers.
SHARED, OF = 4, 5
# Differing bits: of the 128 and of the first 64. At a similarity of 0.8 the means are 19 and 10, the deviations 4.0 and 2.9.
RADIUS, FIRST_RADIUS = 34, 21
# Pairs with so few differing bits are near copies but for about one in a hundred of those just below the similarity.
SURE_BITS = 10
TILE = 32768
# Of chains that are compared once more; most are far smaller.
CHAIN_TILE = 4096
# A little over 5/4, so that sets with a similarity of 0.8 are at most one class apart.
SIZE_BASE = 1.26
_PAIRS_AT_ONCE = 1 << 17
# Of each text so many of its nearest pairs are checked in the first round, and so many times more in each further one.
FIRST_CHECKS = 4


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the shingles."""
    return np.unique(shingle_hashes(text, SHINGLE_WORDS))


def sketch(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed integers."""
    mixed = (shingles ^ (shingles >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return tuple(int(np.uint64(majority_bits(h)).astype(np.int64)) for h in (shingles, mixed ^ (mixed >> np.uint64(32))))


def _sketches(rows: DataFrame) -> DataFrame:
    """rows (id, text) with `digest` and `size` of the set and its 128 bits instead of the text."""
    import xxhash

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at in range(batch.num_rows):
                shingles = shingle_set(batch.column(1)[at].as_py())
                found.append((xxhash.xxh128_digest(shingles.tobytes()), len(shingles), *sketch(shingles)))
            digest, size, first, second = zip(*found, strict=True) if found else ((), (), (), ())
            columns = [pa.array(digest, pa.binary()), *(pa.array(c, pa.int64()) for c in (size, first, second))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "digest", "size", "first", "second"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(measure, f"id {kind}, digest binary, size long, first long, second long")


def _within_radius(a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs (row of a, row of b, differing bits) that may be near copies, block by block.

    `a`, `b`: columns size, first and second 64 bits, as unsigned integers.
    """
    step = max(1, _PAIRS_AT_ONCE // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, 1, None] ^ b[None, :, 1]) <= FIRST_RADIUS)
        i = i + at
        if same:
            i, j = i[j > i], j[j > i]
        d = np.bitwise_count(a[i, 1] ^ b[j, 1]).astype(np.int64) + np.bitwise_count(a[i, 2] ^ b[j, 2])
        low, high = np.minimum(a[i, 0], b[j, 0]), np.maximum(a[i, 0], b[j, 0])
        fits = (d <= RADIUS) & (low * OF >= high * SHARED)
        yield i[fits], j[fits], d[fits]


def near_in_tiles(a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of `_within_radius`, but of those inside a chain of pairs with at most `SURE_BITS` only a spanning tree.

    A group of near copies has pairs in the square of its size. The tree is not checked here: `checked_components` does that, and
    seeks the pairs left out where a pair of the tree fails.
    """
    shift = 0 if same else len(a)
    label = np.arange(shift + len(b))
    for i, j, d in _within_radius(a, b, same):
        apart = label[i] != label[j + shift]
        i, j, d = i[apart], j[apart], d[apart]
        kept = d > SURE_BITS
        if not kept.all():
            for e in np.nonzero(~kept)[0].tolist():
                x, y = i[e], j[e] + shift
                while label[x] != x:
                    x = label[x]
                while label[y] != y:
                    y = label[y]
                if x != y:
                    label[max(x, y)] = min(x, y)
                    kept[e] = True
            while not np.array_equal(label, label[label]):
                label = label[label]
            kept &= (d <= SURE_BITS) | (label[i] != label[j + shift])
        yield i[kept], j[kept], d[kept]


def _bits_of(items: pa.StructArray) -> np.ndarray:
    return np.stack([items.field(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in ("size", "first", "second")], 1)


def _pair_batch(a: pa.StructArray, b: pa.StructArray, i: np.ndarray, j: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    ids = a.field("id").take(pa.array(i)), b.field("id").take(pa.array(j))
    return pa.RecordBatch.from_arrays([*ids, pa.array(bits)], ["a", "b", "bits"])


def candidate_pairs(nodes: DataFrame, *, tile: int = TILE) -> DataFrame:
    """Pairs (a, b, bits) of the ids of `nodes` (id, size, first, second) that may be near copies.

    A cell holds the sets of one class of sizes and is cut into tiles by a hash; a size is below 2^63, so there are at most 190 cells.
    """
    cell = F.floor(F.log(SIZE_BASE, F.col("size"))).cast("int")
    placed = nodes.select(cell.alias("cell"), F.struct("id", "size", "first", "second").alias("item"))
    cells = written(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts")))
    placed = placed.join(F.broadcast(cells), "cell")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("item.id"), F.col("parts")).cast("int"))
    tiles = written(placed.groupBy("cell", "part").agg(F.collect_list("item").alias("items")))

    others = cells.select(F.col("cell").alias("cell_b"), F.col("parts").alias("parts_b"))
    beside = cells.withColumn("cell_b", F.explode(F.array("cell", F.col("cell") + 1)))
    pairs = beside.join(F.broadcast(others), "cell_b")
    pairs = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = pairs.withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)))
    pairs = pairs.where((F.col("cell") != F.col("cell_b")) | (F.col("part") <= F.col("part_b")))
    same = (F.col("cell") == F.col("cell_b")) & (F.col("part") == F.col("part_b"))
    pairs = pairs.select("cell", "part", "cell_b", "part_b", same.alias("same"))
    met = pairs.join(tiles.withColumnRenamed("items", "items_a"), ["cell", "part"])
    tiles_b = tiles.select(F.col("cell").alias("cell_b"), F.col("part").alias("part_b"), F.col("items").alias("items_b"))
    met = met.join(tiles_b, ["cell_b", "part_b"])
    # A pair of tiles is a second of work and little data, so the number of tasks is set and not left to sizes.
    tasks = min(10000, max(1, 2 * pairs.count()))
    met = met.repartition(tasks, "cell", "part", "cell_b", "part_b").select("same", "items_a", "items_b")
    kind = nodes.schema["id"].dataType.simpleString()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                a, b = (batch.column(c)[at].values for c in (1, 2))
                for i, j, bits in near_in_tiles(_bits_of(a), _bits_of(b), batch.column(0)[at].as_py()):
                    if len(i):
                        yield _pair_batch(a, b, i, j, bits)

    return met.mapInArrow(compared, f"a {kind}, b {kind}, bits long")


def pairs_in_chains(nodes: DataFrame, *, tile: int = CHAIN_TILE) -> DataFrame:
    """Pairs (a, b, bits) of `nodes` (id, size, first, second, chain, group) of one chain and two groups that may be near copies."""
    item = F.struct("id", "size", "first", "second", "group").alias("item")
    parts = nodes.groupBy("chain").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts"))
    placed = nodes.select("chain", item).join(parts, "chain")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("item.id"), F.col("parts")).cast("int"))
    tiles = written(placed.groupBy("chain", "part").agg(F.first("parts").alias("parts"), F.collect_list("item").alias("items")))
    pairs = tiles.select("chain", "part", F.explode(F.sequence("part", F.col("parts") - 1)).alias("part_b"))
    met = pairs.join(tiles.select("chain", "part", F.col("items").alias("items_a")), ["chain", "part"])
    met = met.join(tiles.select("chain", F.col("part").alias("part_b"), F.col("items").alias("items_b")), ["chain", "part_b"])
    met = met.select((F.col("part") == F.col("part_b")).alias("same"), "items_a", "items_b")
    group = nodes.schema["group"].dataType.simpleString()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                a, b = (batch.column(c)[at].values for c in (1, 2))
                numbers: dict[str, int] = {}  # ids may be structs, which Arrow does not compare
                of_a, of_b = (np.array([numbers.setdefault(repr(g), len(numbers)) for g in t.field("group").to_pylist()]) for t in (a, b))
                for i, j, bits in _within_radius(_bits_of(a), _bits_of(b), batch.column(0)[at].as_py()):
                    apart = of_a[i] != of_b[j]
                    if apart.any():
                        yield _pair_batch(a, b, i[apart], j[apart], bits[apart])

    return met.mapInArrow(compared, f"a {group}, b {group}, bits long")


def _sets(rows: DataFrame) -> DataFrame:
    """rows (id, text) to (id, shingles)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(batch.column(1)[at].as_py()).astype(np.int64) for at in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"id {kind}, shingles array<long>")


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as near copies."""
    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("in_a")), "a")
    met = met.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("in_b")), "b")
    shared = F.size(F.array_intersect("in_a", "in_b"))
    near = shared * OF >= (F.size("in_a") + F.size("in_b") - shared) * SHARED
    return met.where(near).select("a", "b")


def _apart(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """The pairs (a, b, bits) that the components do not join."""
    ends = components.select(F.col("node").alias("a"), F.col("component").alias("of_a"))
    ends_b = components.select(F.col("node").alias("b"), F.col("component").alias("of_b"))
    met = pairs.join(ends, "a", "left").join(ends_b, "b", "left")
    return met.where("of_a is null or of_b is null or of_a <> of_b").select("a", "b", "bits")


def _left_out(tree: DataFrame, components: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b, bits) inside the chains of `tree` that its checked components leave in two groups or more."""
    chains = connected_components(tree).withColumnRenamed("component", "chain")
    grouped = chains.join(components, "node", "left")
    grouped = written(grouped.select(F.col("node").alias("id"), "chain", F.coalesce("component", "node").alias("group")))
    broken = grouped.groupBy("chain").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high")
    return pairs_in_chains(nodes.join(grouped.join(broken.select("chain"), "chain", "left_semi"), "id"))


def checked_components(pairs: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (node, component) of the pairs (a, b, bits) whose sets are as similar as near copies.

    The pairs of at most `SURE_BITS` come first, since others were left out on their account; what was left out of a chain that
    they do not join is sought among `nodes` (id, size, first, second). Then each round checks the nearest pairs of each text and
    drops those that its links already join, so that a large group costs a few checks for each of its texts; rounds go on until
    every pair has been checked or joined.
    """
    tree = written(pairs.where(F.col("bits") <= SURE_BITS).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = written(_near(tree, sets))
    components = written(connected_components(links))
    left = pairs.where(F.col("bits") > SURE_BITS).unionByName(_left_out(tree, components, nodes))
    left = left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "bits").distinct()
    left = written(_apart(left.join(tree, ["a", "b"], "left_anti"), components))
    checks = FIRST_CHECKS
    while not left.isEmpty():
        both = left.select(F.col("a").alias("u"), F.col("b").alias("v"), "bits").unionByName(
            left.select(F.col("b").alias("u"), F.col("a").alias("v"), "bits")
        )
        nearest = F.row_number().over(Window.partitionBy("u").orderBy("bits", "v"))
        chosen = both.withColumn("nearest", nearest).where(F.col("nearest") <= checks)
        chosen = written(chosen.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
        links = written(links.unionByName(_near(chosen, sets)))
        components = written(connected_components(links))
        left = written(_apart(left.join(chosen, ["a", "b"], "left_anti"), components))
        checks *= FIRST_CHECKS
    return components


def one_per_group(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df`, with all their columns, that stand for their group of near copies: the smallest id and, under it, the lowest hash.

    Two texts are near copies if at least 0.8 of the five-word shingles that stand in either stand in both; letters A to Z count as
    lower case, and a text of fewer words is one shingle. Groups are chains of near copies. Texts without words are copies of each other.
    Pairs are sought by 128 bits; at a similarity of exactly 0.8 about one pair in a thousand differs in more bits than are
    looked at, at 0.85 none in a million. Each text counts, also where several have one id; of rows with one id and one text one
    stays. Rows without an id stay as they are.
    """
    key = F.struct(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("hash")).alias("id")
    rows = df.select(key, F.struct("*").alias("row"))
    texts = df.select(key, F.col(text_col).alias("text")).where("id.doc is not null")
    one = F.min(F.struct("id", "size", "first", "second")).alias("of")
    nodes = written(_sketches(texts).groupBy("digest").agg(one).select("of.*"))
    pairs = written(candidate_pairs(nodes.where("size > 0")))
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = _sets(texts.join(nodes.join(ends, "id").select("id"), "id", "left_semi"))
    sets = written(sets.groupBy("id").agg(F.first("shingles").alias("shingles")))
    components = checked_components(pairs, sets, nodes)
    later = components.where("node <> component").select(F.col("node").alias("id"))
    keepers = nodes.join(later, "id", "left_anti").select("id")
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.lit(0)))
    kept = rows.join(keepers, "id", "left_semi").withColumn("copy", first).where("copy = 1").select("row.*")
    return kept.unionByName(rows.where("id.doc is null").select("row.*"))
