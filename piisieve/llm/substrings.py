"""Substring dedup: passages of `MIN_WORDS` words or more that repeat across documents, by prefix-partitioned suffix trees.

A suffix is written as letters, each the 64-bit name of a run of `LETTER_WORDS` words; a tree of suffixes down to as many
letters as make `MIN_WORDS` words has a deep node for each repeated passage, and following nodes make up the maximal repeats.

1. Each run of NAME_WORDS words is named too, and of each window of MIN_WORDS words the smallest name in it is taken. Equal
   windows have equal smallest names, so only windows whose smallest name stands in two documents can repeat. That
   leaves few names to shuffle, and few texts and suffixes after them.
2. Suffixes are dealt out by prefixes of variable length: a prefix is one letter longer where more suffixes begin alike
   than fit a group. Suffixes that are equal in all letters need no longer prefix, as each task sends only one document's.
3. Each group is sorted, which is its subtree in depth-first order, and read as a stream. A deep node is a run of suffixes
   that agree in all letters.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piisieve.llm.common import words, written
from piisieve.llm.quality_rules import n_words, spaced

MIN_WORDS = 50
LETTER_WORDS = 25
NAME_WORDS = 10
# Suffixes that a group of the tree should not exceed.
GROUP_ROWS = 1 << 20
# Prefixes are counted by this many cells of their hash, a bound for what is broadcast.
PREFIX_CELLS = 1 << 16
_NO_ID = (1 << 63) - 1


def _word_hashes(tokens: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def run_names(tokens: list[bytes], length: int) -> np.ndarray:
    """The name of the run of `length` words that starts at each word."""
    hashes = _word_hashes(tokens)
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    names = np.zeros(n, np.uint64)
    for at in range(length):
        names = names * np.uint64(0x9E3779B97F4A7C15) + hashes[at : at + n]
        names ^= names >> np.uint64(29)
    names *= np.uint64(0xBF58476D1CE4E5B9)
    return names ^ (names >> np.uint64(32))


def smallest_names(names: np.ndarray, width: int) -> np.ndarray:
    """The smallest of `width` names from each position on."""
    least, covered = names, 1
    while 2 * covered <= width:
        least = np.minimum(least[: len(least) - covered], least[covered:])
        covered *= 2
    rest = width - covered
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


class _Shape:
    def __init__(self, min_words: int, letter_words: int):
        if min_words % letter_words:
            raise ValueError("a passage must be a whole number of letters")
        self.min_words, self.letter_words = min_words, letter_words
        self.letters = min_words // letter_words
        self.columns = [f"l{i}" for i in range(self.letters)]
        self.name_words = min(NAME_WORDS, min_words)

    def windows(self, tokens: list[bytes]) -> np.ndarray:
        """Each window's smallest name; nothing for a text shorter than a window."""
        if len(tokens) < self.min_words:
            return np.empty(0, np.int64)
        names = run_names(tokens, self.name_words)
        return smallest_names(names, self.min_words - self.name_words + 1).view(np.int64)

    def suffixes(self, tokens: list[bytes], starts: np.ndarray) -> np.ndarray:
        """A row of letters for each start."""
        letters = run_names(tokens, self.letter_words).view(np.int64)
        return letters[starts[:, None] + self.letter_words * np.arange(self.letters)]


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key stands for a row's id and text, so that equal rows share it; sid is the id, the highest one for a null."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return docs.select(
        F.xxhash64("id", F.isnull("id"), "text").alias("key"), F.coalesce("id", F.lit(_NO_ID)).alias("sid"), "id", "text"
    )


def _shared_texts(docs: DataFrame, shape: _Shape) -> DataFrame:
    """Rows (key, sid, text, starts): texts with windows that may repeat in another document, and where these start."""

    def names_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shape.windows(words(t))) for t in batch.column(2).to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            names = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(names)],
                ["key", "sid", "name"],
            )

    named = docs.select("key", "sid", "text").mapInArrow(names_of, "key long, sid long, name long")
    named = written(named)
    repeated = named.groupBy("name").agg(F.min("sid").alias("a"), F.max("sid").alias("b")).where("a < b").select("name")
    # A name may stand in a third of all documents; Spark splits such a partition of the left side.
    marks = named.join(repeated, "name", "left_semi").groupBy("key").agg(F.collect_set("name").alias("names"))

    def starts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = []
            for at, text in enumerate(batch.column(2).to_pylist()):
                least = shape.windows(words(text))
                wanted = batch.column(3)[at].values.to_numpy(zero_copy_only=False)
                starts.append(np.flatnonzero(np.isin(least, wanted)).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in range(3)] + [pa.array(starts, pa.binary())], ["key", "sid", "text", "starts"]
            )

    met = docs.select("key", "sid", "text").join(marks, "key").select("key", "sid", "text", "names")
    return written(met.mapInArrow(starts_of, "key long, sid long, text string, starts binary"))


def _runs(keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (key, start, count) of consecutive starts."""
    order = np.lexsort((starts, keys))
    keys, starts = keys[order], starts[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    return keys[first], starts[first], np.diff(np.append(first, len(keys)))


def _suffixes(shared: DataFrame, shape: _Shape) -> DataFrame:
    """Rows (l0.., sid, key, start, count): the suffixes that enter the tree, with count 0, and runs of `count` windows
    that repeat a smaller document of the same batch, which need no tree; their letters are 0."""

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, rows, at = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                starts = np.frombuffer(batch.column(3)[i].as_py(), "<i4").astype(np.int64)
                letters.append(shape.suffixes(words(text), starts))
                rows.append(np.full(len(starts), i))
                at.append(starts)
            if not letters:
                continue
            letter, row, start = np.concatenate(letters), np.concatenate(rows), np.concatenate(at)
            key, sid = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in (0, 1))
            order = np.lexsort((start, sid, *letter.T[::-1]))
            letter, key, sid, start = letter[order], key[order], sid[order], start[order]
            new = np.ones(len(key), bool)
            new[1:] = (letter[1:] != letter[:-1]).any(axis=1)
            known = sid > sid[new][np.cumsum(new) - 1]
            runs = _runs(key[known], start[known])
            none = np.zeros(len(runs[0]), np.int64)
            columns = [np.concatenate((letter[~known, c], none)) for c in range(shape.letters)]
            columns.append(np.concatenate((sid[~known], none)))
            zeros = np.zeros(len(columns[0]) - len(none), np.int64)
            columns += [np.concatenate(pair) for pair in zip((key[~known], start[~known], zeros), runs, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.astype(np.int64)) for c in columns], [*shape.columns, "sid", "key", "start", "count"]
            )

    names = ", ".join(f"{c} long" for c in [*shape.columns, "sid", "key", "start", "count"])
    return shared.mapInArrow(suffixes, names)


def _prefix_depths(suffixes: DataFrame, shape: _Shape, group_rows: int) -> tuple[list[DataFrame], int]:
    """For each prefix length the cells whose suffixes need one letter more, as long as there are any; and the number of suffixes.

    Prefixes are counted by PREFIX_CELLS cells of their hash. No prefix has more suffixes than its cell, and a cell that is
    too full for many small prefixes only makes these longer than they need be.
    """
    entering, total, crowded = suffixes.where("count = 0"), None, []
    for depth in range(1, shape.letters):
        cell = F.pmod(F.xxhash64(*shape.columns[:depth]), F.lit(PREFIX_CELLS)).alias(f"cell{depth}")
        for d, cells in enumerate(crowded, 1):
            own = F.pmod(F.xxhash64(*shape.columns[:d]), F.lit(PREFIX_CELLS))
            entering = entering.withColumn(f"cell{d}", own).join(F.broadcast(cells), f"cell{d}", "left_semi")
        counts = entering.groupBy(cell).agg(F.count(F.lit(1)).alias("n"))
        counts = written(counts)  # PREFIX_CELLS rows at most
        total = (counts.agg(F.sum("n")).first()[0] or 0) if total is None else total
        cells = counts.where(F.col("n") > group_rows).select(f"cell{depth}")
        if cells.isEmpty():
            break
        crowded.append(cells)
    return crowded, total or 0


def _repeats_in_trees(suffixes: DataFrame, shape: _Shape, group_rows: int) -> DataFrame:
    """Rows (key, start, count): windows that also start in a document with a smaller id."""
    crowded, total = _prefix_depths(suffixes, shape, group_rows)
    partitions = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(partitions, -(-total // group_rows))
    dealt = suffixes.withColumn("depth", F.lit(1))
    for depth, cells in enumerate(crowded, 1):
        dealt = dealt.withColumn(f"cell{depth}", F.pmod(F.xxhash64(*shape.columns[:depth]), F.lit(PREFIX_CELLS)))
        dealt = dealt.join(F.broadcast(cells.withColumn("crowded", F.lit(True))), f"cell{depth}", "left")
        deeper = F.when((F.col("depth") == depth) & F.col("crowded"), depth + 1).otherwise(F.col("depth"))
        dealt = dealt.withColumn("depth", deeper).drop("crowded", f"cell{depth}")
    ways = [F.when(F.col("depth") == d, F.xxhash64(*shape.columns[:d])) for d in range(1, shape.letters + 1)]
    # Runs that need no tree go along, spread evenly.
    prefix = F.when(F.col("count") > 0, F.xxhash64("key", "start")).otherwise(F.coalesce(*ways))

    def deep_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lowest = None, 0  # the letters of the suffix before, and the smallest id of its node
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in range(batch.num_columns)]
            ready = columns[-1] > 0
            known = [c[ready] for c in columns[shape.letters + 1 :]]
            letter = np.stack(columns[: shape.letters], axis=1)[~ready]
            sid, key, start = (c[~ready] for c in columns[shape.letters : shape.letters + 3])
            if len(sid):
                differs = np.ones((len(sid), shape.letters), bool)
                differs[1:] = letter[1:] != letter[:-1]
                if last is not None:
                    differs[0] = letter[0] != last
                # How many letters a suffix shares with the one before: the depth of the node where they part.
                shared = np.where(differs.any(axis=1), differs.argmax(axis=1), shape.letters)
                new = shared < shape.letters
                node = np.cumsum(new)  # 0: still the node of the batch before
                low = np.concatenate(([lowest], sid[new]))[node]
                last, lowest = letter[-1], int(low[-1])
                repeats = sid > low
                runs = _runs(key[repeats], start[repeats])
                known = [np.concatenate(pair) for pair in zip(known, runs, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in known], ["key", "start", "count"])

    order = [*shape.columns, "sid", "key", "start"]
    dealt = dealt.withColumn("prefix", prefix).repartition(groups, "prefix").select(*order, "count")
    return dealt.sortWithinPartitions(*order).mapInArrow(deep_nodes, "key long, start long, count long")


def cut_words(text: str, covered: np.ndarray) -> str:
    """The text without the covered words and the white space behind each of them; all other characters stay."""
    data = text.encode()
    space = np.isin(np.frombuffer(data, np.uint8), [32, 9, 10, 11, 12, 13])
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    edge = np.append(starts, len(data))
    drop = np.zeros(len(data) + 1, np.int32)
    np.add.at(drop, edge[:-1][covered], 1)
    np.add.at(drop, edge[1:][covered], -1)
    return np.frombuffer(data, np.uint8)[np.cumsum(drop[:-1]) == 0].tobytes().decode()


def changed_texts(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    letter_words: int = LETTER_WORDS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Rows (key, n_removed, kept): texts that lose words, under the `row_key` of their rows.

    A word goes if a window of `min_words` words that covers it also starts in a document with a smaller id, judged on the
    texts as given. Null texts have no words. A null id counts as higher than all others. Ids are integers, or strings of
    digits (they are cast to long); another string raises Spark's CAST_INVALID_INPUT. Rows with equal id and text share a key; rows of one
    id are one document and do not repeat each other.
    """
    shape = _Shape(min_words, letter_words)
    shared = _shared_texts(_keyed(df, id_col, text_col), shape)
    repeats = _repeats_in_trees(_suffixes(shared, shape), shape, group_rows)
    spans = repeats.groupBy("key").agg(F.collect_list(F.struct("start", "count")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                runs = batch.column(2)[at].values
                start, count = (runs.field(c).to_numpy() for c in (0, 1))
                edges = np.zeros(len(words(text)) + 1, np.int64)
                np.add.at(edges, start, 1)
                np.add.at(edges, start + count - 1 + min_words, -1)
                covered = np.cumsum(edges)[:-1] > 0
                removed.append(int(covered.sum()))
                kept.append(cut_words(text, covered))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["key", "n_removed", "kept"]
            )

    texts = shared.select("key", "text").join(spans, "key")
    changed = texts.mapInArrow(cut, "key long, n_removed long, kept string")
    return written(changed).dropDuplicates(["key"])


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """The key of `changed_texts` as a column of `df`."""
    identity = F.col(id_col).cast("long")
    return F.xxhash64(identity, F.isnull(identity), F.col(text_col))


def without_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows of `df`, with all their columns, without the words that `changed_texts` takes out.

    Texts that lose nothing stay as they are, to the character; `length_col`, if given, becomes the length of a changed text.
    """
    changed = changed_texts(df, id_col=id_col, text_col=text_col).select("key", "kept")
    joined = df.select(row_key(df, id_col, text_col).alias("key"), F.struct("*").alias("row")).join(changed, "key", "left")

    def column(name: str):
        old = F.col("row")[name]
        if name == text_col:
            return F.coalesce("kept", old).alias(name)
        if name == length_col:
            return F.when(F.col("kept").isNotNull(), F.length("kept")).otherwise(old).cast(df.schema[name].dataType).alias(name)
        return old.alias(name)

    return joined.select(*map(column, df.columns))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    changed = changed_texts(docs).select("key", "n_removed", F.sha2(F.encode(spaced(F.col("kept")), "UTF-8"), 256).alias("cut_sha256"))
    whole = docs.select(
        row_key(docs).alias("key"),
        "doc_id",
        n_words(F.col("text")).alias("n_words"),
        F.sha2(F.encode(spaced(F.col("text")), "UTF-8"), 256).alias("whole_sha256"),
    )
    return whole.join(changed, "key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"),
    )
