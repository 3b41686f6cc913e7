"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

The probability of a word behind another is a mixture of maximum-likelihood estimates, with one set of weights for each bucket of
how often the word before was seen. Part of the learnt documents is held out of the counts, and the weights are those that
expectation-maximisation finds for it; the final estimates use all learnt documents.

Documents are handled in blocks. A block sends each of its distinct n-grams once, as a 64-bit hash in the bucket that
owns it, with its counts; the owner adds up all blocks and answers with the totals in the order of the request. So a
frequent n-gram costs a row per block and not one per use, and every text is scored where its block is.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piisieve.llm.common import fold, written

HELD_OUT_MODULUS, HELD_OUT_REST = 7, 2
# Of the learnt documents, those with this rest are held out of the counts to learn the weights.
DEVELOPMENT_REST = 3
BLOCK_TOKENS = 2_500_000
# N-grams that a bucket should own; a text has about one for six characters.
BUCKET_CHARS = 12_000_000
EM_ROUNDS = 60
# The weights are learnt on estimates rounded to this many steps per doubling.
STEPS = 8
# Stand for the end of a text and what is before its first word; no word holds a space.
_END, _START = b" end", b" start"

_Counts = tuple[np.ndarray, np.ndarray]


# ---- Compact arrays -------------------------------------------------------------------------------


def _packed(numbers: np.ndarray) -> bytes:
    """Compressed by byte position, so that high bytes, which are mostly equal, take no room."""
    import zstandard

    wide = np.ascontiguousarray(numbers)
    planes = wide.view(np.uint8).reshape(len(wide), wide.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).reshape(-1)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each ordered pair."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


# ---- Blocks ---------------------------------------------------------------------------------------


class _Block:
    """Tokens of some documents as codes into `hashes`, the n-grams among them, and who is learnt from.

    `role` is 0 for documents that are only scored, 1 for counted ones and 2 for held-out ones that weights are learnt on.
    """

    def __init__(self, ids: list, role: np.ndarray, lengths: np.ndarray, codes: np.ndarray, hashes: np.ndarray):
        self.ids, self.role, self.lengths, self.codes, self.hashes = ids, role, lengths, codes, hashes
        start, known = len(hashes) - 1, np.uint64(len(hashes))
        firsts = np.cumsum(lengths) - lengths
        before = np.empty_like(codes)
        before[1:] = codes[:-1]
        before[firsts] = start
        pair = before.astype(np.uint64) * known + codes.astype(np.uint64)
        # One more pair for each document: the start itself, whose count is that of documents.
        self.pairs, self.pair_of = np.unique(
            np.concatenate((pair, np.full(len(lengths), start, np.uint64) * (known + np.uint64(1)))), return_inverse=True
        )
        self.pair_of = self.pair_of.astype(np.int32)
        self.before, self.word = (self.pairs // known).astype(np.int32), (self.pairs % known).astype(np.int32)
        self.token_role = np.concatenate((np.repeat(role, lengths), role))

    @classmethod
    def of_texts(cls, ids: list, role: np.ndarray, texts: list[pa.Array]) -> "_Block":
        import xxhash

        split = pc.ascii_split_whitespace(pc.ascii_lower(pa.chunked_array(texts).cast(pa.large_string()).combine_chunks()))
        if isinstance(split, pa.ChunkedArray):
            split = pa.concat_arrays(split.chunks)
        flat = split.flatten()
        full = pc.greater(pc.binary_length(flat), 0)
        owner = np.repeat(np.arange(len(ids)), np.diff(split.offsets.to_numpy()))[full.to_numpy(zero_copy_only=False)]
        coded = flat.filter(full).dictionary_encode()
        names = [w.encode() for w in coded.dictionary.to_pylist()] + [_END, _START]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
        per_doc = np.bincount(owner, minlength=len(ids))
        ends = np.cumsum(per_doc + 1) - 1
        codes = np.empty(len(owner) + len(ids), np.int64)
        inner = np.ones(len(codes), bool)
        inner[ends] = False
        codes[ends] = len(names) - 2
        codes[inner] = coded.indices.to_numpy()
        return cls(ids, role, per_doc + 1, codes, hashes)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words and of the pairs."""
        return self.hashes, _mixed(self.hashes[self.before], self.hashes[self.word])

    def counts(self) -> tuple[_Counts, _Counts]:
        """Counted and held-out uses of the words and of the pairs."""
        tokens = len(self.codes)

        def per(codes: np.ndarray, role: np.ndarray, size: int) -> _Counts:
            counted, dev = (np.bincount(codes[role == r], minlength=size).astype(np.int64) for r in (1, 2))
            return counted, dev

        return (
            per(self.codes, self.token_role[:tokens], len(self.hashes)),
            per(self.pair_of, self.token_role, len(self.pairs)),
        )

    def packed(self) -> list[bytes]:
        return [
            _packed(self.role.astype(np.int8)), _packed(self.lengths.astype(np.int64)),
            _packed(self.codes.astype(np.int32)), _packed(self.hashes),
        ]

    @classmethod
    def unpacked(cls, ids: list, role: bytes, lengths: bytes, codes: bytes, hashes: bytes) -> "_Block":
        return cls(
            ids, _unpacked(role, np.int8), _unpacked(lengths, np.int64),
            _unpacked(codes, np.int32).astype(np.int64), _unpacked(hashes, np.uint64),
        )


def _blocks(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[_Block]:
    """Blocks of about `block_tokens`, or of one longer document, from batches (id, role, text)."""
    ids, roles, texts, size = [], [], [], 0

    def block() -> _Block:
        return _Block.of_texts(ids, np.concatenate(roles), texts)

    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False) // 6 + 1)
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + block_tokens - size, side="right")))
            part = batch.slice(at, end - at)
            ids += part.column(0).to_pylist()
            roles.append(part.column(1).to_numpy(zero_copy_only=False))
            texts.append(pc.fill_null(part.column(2), ""))
            size += int(sizes[end - 1] - done)
            at = end
            if size >= block_tokens:
                yield block()
                ids, roles, texts, size = [], [], [], 0
    if ids:
        yield block()


# ---- Totals of the n-grams ------------------------------------------------------------------------


def _routes(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the keys, and the bounds between the buckets in it; a bucket owns a range of hashes."""
    order = np.argsort(keys)
    bounds = [(b << 64) // buckets for b in range(1, buckets)]
    inner = np.searchsorted(keys[order], np.array(bounds, np.uint64))
    return order, np.concatenate(([0], inner, [len(keys)]))


def _requests(block: _Block, buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes, bytes, bytes]]:
    parts = []
    for keys, (counted, dev) in zip(block.keys(), block.counts(), strict=True):
        order, bounds = _routes(keys, buckets)
        parts.append((keys[order], counted[order], dev[order], bounds))
    for bucket in range(buckets):
        row: list[bytes] = []
        for keys, counted, dev, bounds in parts:
            at = slice(bounds[bucket], bounds[bucket + 1])
            own = keys[at]
            row += [_packed(np.diff(own, prepend=np.uint64(0))), _packed(counted[at]), _packed(dev[at])]
        yield (bucket, *row)


def _totals(table: pa.Table) -> list[tuple[int, bytes, bytes, int, int, int]]:
    """Answers of a bucket to its blocks, and a row of block -1 with its numbers of words, tokens and counted tokens."""
    blocks = table.column("block").to_pylist()
    answers: list[list[bytes]] = [[] for _ in blocks]
    special = np.array([_hash(_START)], np.uint64)
    stats = (0, 0, 0)
    for order in ("word", "pair"):
        parts = [np.cumsum(_unpacked(d, np.uint64), dtype=np.uint64) for d in table.column(f"{order}_keys").to_pylist()]
        counted, dev = (
            np.concatenate([_unpacked(d, np.int64) for d in table.column(f"{order}_{c}").to_pylist()])
            for c in ("counted", "dev")
        )
        keys, owner = np.unique(np.concatenate(parts), return_inverse=True)
        sums = np.zeros((2, len(keys)), np.int64)
        np.add.at(sums[0], owner, counted)
        np.add.at(sums[1], owner, dev)
        whole = sums[0] + sums[1]
        if order == "word":
            real = ~np.isin(keys, special)
            stats = (int((whole[real] > 0).sum()), int(whole[real].sum()), int(sums[0][real].sum()))
        at = 0
        for answer, part in zip(answers, parts, strict=True):
            own = owner[at : at + len(part)]
            answer.append(_packed(np.concatenate((whole[own], sums[0][own]))))
            at += len(part)
    rows = [(block, table.column("bucket")[0].as_py(), *answer, 0, 0, 0) for block, answer in zip(blocks, answers, strict=True)]
    return [*rows, (-1, table.column("bucket")[0].as_py(), b"", b"", *stats)]


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def _answered(keys: np.ndarray, answers: list[bytes], buckets: int) -> _Counts:
    """Whole and counted totals of the keys, from the answers of all buckets in order."""
    order, bounds = _routes(keys, buckets)
    whole, counted = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    for bucket, data in enumerate(answers):
        both = _unpacked(data, np.int64)
        own = order[bounds[bucket] : bounds[bucket + 1]]
        if len(both) != 2 * len(own):
            raise RuntimeError("a block came out different when it was read again")
        whole[own], counted[own] = both[: len(own)], both[len(own) :]
    return whole, counted


# ---- The mixture ----------------------------------------------------------------------------------


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else one bucket for each power of two."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 0)


def _step(value: np.ndarray) -> np.ndarray:
    """The logarithm in steps, from 1 on; 0 for a zero."""
    return np.where(value > 0, np.rint(STEPS * np.log2(np.maximum(value, 1e-300))).astype(np.int64) + 600, 0)


def _histogram(pair: np.ndarray, before: np.ndarray, word: np.ndarray, dev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Held-out uses by (bucket, bigram estimate, unigram count), both in steps: at most 64 x 600 x 600 cells."""
    used = dev > 0
    pair, before, word, dev = pair[used], before[used], word[used], dev[used]
    estimate = np.where(before > 0, pair / np.maximum(before, 1), 0)
    cell = (context_bucket(before) * 2048 + _step(estimate)) * 2048 + _step(word.astype(float))
    cells, at = np.unique(cell, return_inverse=True)
    return cells, np.bincount(at, weights=dev, minlength=len(cells))


def learn_weights(cells: np.ndarray, uses: np.ndarray, tokens: int, types: int) -> np.ndarray:
    """A row of weights (bigram, unigram, uniform) per bucket, by expectation-maximisation on the held-out uses.

    A bucket starts from equal weights and one imagined use of each estimate, so that none becomes zero.
    """
    bucket, estimate, word = cells // 2048**2, cells // 2048 % 2048, cells % 2048

    def value(step: np.ndarray) -> np.ndarray:
        return np.where(step > 0, 2.0 ** ((step - 600) / STEPS), 0.0)

    parts = np.stack([value(estimate), value(word) / max(tokens, 1), np.full(len(cells), 1 / (types + 1))])
    weights = np.full((65, 3), 1 / 3)
    for _ in range(EM_ROUNDS):
        mixed = weights[bucket].T * parts
        shares = mixed / mixed.sum(axis=0) * uses
        sums = np.stack([np.bincount(bucket, weights=s, minlength=65) for s in shares], axis=1) + 1
        weights = sums / sums.sum(axis=1, keepdims=True)
    weights[0] = [0.0, *(weights[0, 1:] / weights[0, 1:].sum())]  # no bigram estimate behind an unseen word
    return weights


# ---- The operator ---------------------------------------------------------------------------------

_BLOCK = "block long, ids binary, role binary, lengths binary, codes binary, hashes binary"


def deleted_interpolation(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of `df`.

    Tokens are the words, with A-Z in lower case, and an end. Learnt from are rows whose crc32(id) mod 7 is not 2; a null id is
    held out. `score` is the log10 probability of the text under the mixture, `base_score` under unigrams with one added
    to each count. The probabilities of the V learnt tokens and of one for all others sum to 1. A null or empty text is an end alone.
    Repeated rows count and are scored as often as they stand. With nothing to learn from, every token has probability 1.

    `df` must give the same rows in the same order when it is read again, as a file does; a block that differs raises an error.
    Ids are integers, or strings of digits, since they are cast to long; another string raises Spark's CAST_INVALID_INPUT.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rest = fold(F.col("id"), HELD_OUT_MODULUS)
    role = F.when(rest == DEVELOPMENT_REST, 2).when(rest != HELD_OUT_REST, 1).otherwise(0)
    docs = docs.select("id", role.cast("tinyint").alias("role"), "text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Block]]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for at, block in enumerate(_blocks(batches, block_tokens)):
            yield base + at, block

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "word_keys", "word_counted", "word_dev", "pair_keys", "pair_counted", "pair_dev"]
        for number, block in numbered(batches):
            rows = list(_requests(block, buckets))
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(rows)), *columns], ["block", *names])

    def totals(table: pa.Table) -> pa.Table:
        names = ["block", "bucket", "words", "pairs", "types", "tokens", "counted"]
        return pa.table(dict(zip(names, map(pa.array, zip(*_totals(table), strict=True)), strict=True)))

    def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in numbered(batches):
            ids = pa.array(block.ids, pa.int64())
            sink = pa.BufferOutputStream()
            batch = pa.RecordBatch.from_arrays([ids], ["id"])
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(batch)
            row = [number, sink.getvalue().to_pybytes(), *block.packed()]
            kinds = [pa.int64(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in zip(row, kinds, strict=True)],
                ["block", "ids", "role", "lengths", "codes", "hashes"],
            )

    def joined(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["ids", "role", "lengths", "codes", "words", "pairs", "cells", "uses", "types", "tokens", "counted"]
        kinds = [pa.binary()] * 8 + [pa.int64()] * 3
        rows = []
        if blocks.num_rows:
            row = blocks.to_pylist()[0]
            answers = answers.sort_by("bucket")
            block = _Block.unpacked([], *(row[c] for c in ("role", "lengths", "codes", "hashes")))
            word_keys, pair_keys = block.keys()
            words = _answered(word_keys, answers.column("words").to_pylist(), buckets)
            pairs = _answered(pair_keys, answers.column("pairs").to_pylist(), buckets)
            start = len(block.hashes) - 1
            starts = np.flatnonzero((block.before == start) & (block.word == start))
            for kind in (0, 1):
                words[kind][start] = pairs[kind][starts].sum()
            _, (_, dev) = block.counts()
            dev[starts] = 0
            cells, uses = _histogram(pairs[1], words[1][block.before], words[1][block.word], dev)
            rows.append(
                [row["ids"], row["role"], row["lengths"], row["codes"], _packed(np.concatenate(words)),
                 _packed(np.concatenate(pairs)), _packed(cells), _packed(uses), 0, 0, 0]
            )
        else:
            sums = [sum(answers.column(c).to_pylist()) for c in ("types", "tokens", "counted")]
            rows.append([b""] * 8 + sums)
        return pa.table({n: pa.array([r[i] for r in rows], kinds[i]) for i, n in enumerate(names)})

    asked = docs.mapInArrow(
        requests,
        "block long, bucket long, word_keys binary, word_counted binary, word_dev binary, pair_keys binary, "
        "pair_counted binary, pair_dev binary",
    )
    answered = asked.groupBy("bucket").applyInArrow(
        totals, "block long, bucket long, words binary, pairs binary, types long, tokens long, counted long"
    )
    blocks = docs.mapInArrow(whole_blocks, _BLOCK)
    known = written(
        blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
            joined,
            "ids binary, role binary, lengths binary, codes binary, words binary, pairs binary, cells binary, uses binary, "
            "types long, tokens long, counted long",
        )
    )
    types, tokens, counted = (int(x or 0) for x in known.agg(F.sum("types"), F.sum("tokens"), F.sum("counted")).first())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells, uses in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                columns = [pa.array(_unpacked(cells, np.int64)), pa.array(_unpacked(uses, np.float64))]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "n"])

    scored = known.where(F.octet_length("ids") > 0)
    histogram = scored.select("cells", "uses").mapInArrow(spread, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = histogram.orderBy("cell").collect()  # bounded by the number of cells
    weights = learn_weights(
        np.array([r["cell"] for r in rows], np.int64), np.array([r["n"] for r in rows], float), counted, types
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # one block at a time, as each is large
                row = batch.slice(at, 1).to_pylist()[0]
                ids = pa.ipc.open_stream(row["ids"]).read_all().column("id").combine_chunks()
                codes = _unpacked(row["codes"], np.int32).astype(np.int64)
                words, pairs = (_unpacked(row[c], np.int64) for c in ("words", "pairs"))
                words, pairs = words[: len(words) // 2], pairs[: len(pairs) // 2]
                row["codes"] = row["words"] = row["pairs"] = None
                block = _Block(
                    ids, _unpacked(row["role"], np.int8), _unpacked(row["lengths"], np.int64), codes,
                    np.zeros(len(words), np.uint64),
                )
                before, word = words[block.before], words[block.word]
                mix = weights[context_bucket(before)]
                likely = mix[:, 0] * pairs / np.maximum(before, 1) + mix[:, 1] * word / max(tokens, 1) + mix[:, 2] / (types + 1)
                of_token = block.pair_of[: len(codes)]
                del mix, before, word, pairs
                firsts = np.cumsum(block.lengths) - block.lengths
                known_word = words[codes]
                base = np.log10((known_word + 1) / (tokens + types + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids if isinstance(ids, pa.Array) else ids.combine_chunks(),
                        pa.array(block.lengths),
                        pa.array(np.add.reduceat((known_word > 0).astype(np.int64), firsts)),
                        pa.array(np.add.reduceat(base, firsts)),
                        pa.array(np.add.reduceat(np.log10(likely)[of_token], firsts)),
                    ],
                    ["id", "n_tokens", "n_known", "base_score", "score"],
                )

    wanted = scored.select("ids", "role", "lengths", "codes", "words", "pairs")
    scores = wanted.mapInArrow(score, "id long, n_tokens long, n_known long, base_score double, score double")
    held_out = F.coalesce(fold(F.col("id"), HELD_OUT_MODULUS) == HELD_OUT_REST, F.lit(True))
    return scores.select(
        F.col("id").alias(id_col), held_out.alias("held_out"), "n_tokens", "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interpolation(spark.read.parquet(f"{sf_dir}/documents.parquet"))
