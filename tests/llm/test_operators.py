"""Each operator against a plain version, on the smallest tables and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from piisieve.llm import bpe, fingerprints, lm_scoring, near_copies, packing, quality_rules, simhash, substrings, url_filters
from piisieve.llm import quality_classifier as classifier
from piisieve.llm.components import connected_components
from piisieve.llm.pretokens import Pretokenizer
from piisieve.llm.queries import QUERIES
from piisieve.llm.token_counts import token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").encode().lower().decode()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# ---- LM scoring -----------------------------------------------------------------------------------


def plain_base(rows):
    tokens = [(d, [w.encode() for w in words(lower(t))] + [b" "]) for d, t in rows]
    rest = {d: 2 if d is None else zlib.crc32(str(d).encode()) % 7 for d, _ in rows}
    counts = Counter(w for d, ws in tokens if rest[d] != 2 for w in ws)
    total, types = sum(counts.values()), len(counts)
    return Counter(
        (d, rest[d] == 2, len(ws), sum(counts[w] > 0 for w in ws), total,
         round(sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in ws), 4))
        for d, ws in tokens
    )


def lm_rows(df):
    return df.withColumn("base", F.round("base_score", 4))


LM = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base")


def test_lm_base_and_gain(spark, sf_dir, sf_texts):
    scored = lm_rows(QUERIES["op1_lm_scoring"](spark, sf_dir)).cache()
    assert rows_of(scored, *LM) == plain_base(list(sf_texts.items()))
    held = scored.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


@pytest.mark.parametrize("block_tokens", [50, 10**6])
def test_lm_odd_rows(odd, odd_rows, block_tokens):
    scored = lm_rows(lm_scoring.deleted_interpolation(odd, block_tokens=block_tokens))
    assert rows_of(scored, *LM) == plain_base(odd_rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in scored.collect())


def test_lm_of_nothing(empty):
    assert lm_scoring.deleted_interpolation(empty).count() == 0


def test_lm_weights_find_the_mixture():
    rng = np.random.default_rng(1)
    cells = (3 * 2048 + lm_scoring._step(np.array([0.5, 0.01]))) * 2048 + lm_scoring._step(np.array([10.0, 1000.0]))
    weights = lm_scoring.learn_weights(cells, rng.permutation([9000.0, 1000.0]) * 0 + [9000, 1000], 100_000, 500)
    assert weights.sum(axis=1) == pytest.approx(1)
    assert weights[3, 0] > 0.5 and weights[0, 0] == 0


# ---- SimHash --------------------------------------------------------------------------------------


def plain_simhash(text):
    ws = words(lower(text))
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [(d, plain_simhash(t)) for d, t in rows]
    group = list(range(len(rows)))
    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = defaultdict(lambda: None)
    for g, (d, _) in zip(group, prints, strict=True):
        if d is not None and (low[g] is None or d < low[g]):
            low[g] = d
    return Counter((d, f"{p:016x}", low[g]) for g, (d, p) in zip(group, prints, strict=True))


def test_simhash_query(spark, sf_dir, sf_texts):
    found = QUERIES["op2_simhash"](spark, sf_dir)
    assert rows_of(found, "doc_id", "fingerprint", "component_id") == plain_components(list(sf_texts.items()))


def test_simhash_odd_rows(odd, odd_rows, empty):
    found = simhash.near_duplicates(odd).withColumn("hex", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))
    assert rows_of(found, "doc_id", "hex", "component_id") == plain_components(odd_rows)
    assert simhash.near_duplicates(empty).count() == 0


def test_one_document_of_each_simhash_group_stays(spark):
    """The pipeline's stage keeps what the fingerprints' components keep; each text of an id counts, and all its copies are one."""
    template = [f"t{i}" for i in range(400)]
    rows = [(10 + i, " ".join([*template, f"end{i}"])) for i in range(60)]  # near copies: links in the square of the group
    rows += [(100 + i, " ".join(template)) for i in range(40)]  # exact copies
    rows += [(5, "one text here"), (5, "quite another text"), (5, "one text here"), (7, None), (8, " "), (None, "one text here"), (None, None)]
    rows += [(300 + i, " ".join(f"v{i}x{k}" for k in range(40))) for i in range(20)]
    rows += [(400 + i, " ".join([*template[:50], f"v{i}", *template[51:100]])) for i in range(20)]  # mostly over three bits apart
    keyed = sorted({(d, t or "") for d, t in rows if d is not None})
    low = plain_components([((d, t), t) for d, t in keyed])
    expected = Counter(key for key, _, least in low if key == least)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = corpus_pipeline.simhash_near_dedup(spark, df, "")
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert Counter((d, t or "") for d, t in got if d is not None) == expected
    assert sum(d is None for d, _ in got) == 2
    assert 25 < len(expected) < 60 and {d for d, _ in expected} != set(plain_near_copies([(d, t) for d, t in rows if d is not None]))


@pytest.mark.parametrize("tile", [2, 64])
def test_tiles_connect_what_links_connect(spark, tile):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 20)
    prints = {int(b) for b in base}
    for b in base[:5]:  # large groups of near copies, and chains
        for _ in range(40):
            b = b ^ (1 << int(rng.integers(0, 63)))
            prints.add(int(b))
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    got = {r.node: r.component for r in connected_components(simhash.near_links(df, tile=tile)).collect()}
    order = sorted(prints)
    group = {p: p for p in order}
    for i, a in enumerate(order):
        for b in order[:i]:
            if (a ^ b).bit_count() <= 3 and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {p: new if g == old else g for p, g in group.items()}
    assert {p: got.get(p, p) for p in order} == group


def test_one_document_of_each_group_stays(odd):
    kept = near_copies.one_per_group(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2
    assert sorted(i for i in ids if i is not None) == [0, 3, 4, 5, 6, 8, 11, 12, 13, 14, 15]


def plain_near_copies(rows):
    """The smallest id of each chain of texts that share 0.8 of their shingles of five words."""
    sets = {}
    for d, t in rows:
        ws = words(lower(t))
        sets[d] = frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()
    group = {d: d for d in sets}

    def top(d):
        while group[d] != d:
            d = group[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                group[max(top(a), top(b))] = min(top(a), top(b))
    return sorted(d for d in sets if top(d) == d)


def test_near_copies_are_those_of_the_shingles(spark, sf_texts):
    draw = random.Random(7)
    rows = [(d, t) for d, t in sorted(sf_texts.items()) if t]
    long_ones = [t for _, t in rows if len(t.split()) > 60]
    for _ in range(150):  # from one changed word in a text to one in twelve, which is on both sides of 0.8; copies of copies too
        ws = draw.choice(long_ones).split()
        for at in draw.sample(range(len(ws)), max(1, len(ws) // draw.choice([12, 25, 40, 50, 60, 100, 1000]))):
            ws[at] = f"changed{draw.random()}"
        text = " ".join(ws)
        rows.append((100_000 + len(rows), text))
        long_ones.append(text)
    rows += [(200_000 + i, f"{long_ones[0]} end{i}") for i in range(60)]  # one large group
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = plain_near_copies(rows)
    assert len(expected) < len(rows) - 100
    assert sorted(r.doc_id for r in near_copies.one_per_group(df).collect()) == expected


def test_failed_links_of_a_chain_hide_no_near_copy(spark):
    """One template, and variants that share 0.85 with it and 0.72 with each other: chains of near bits mostly fail the check."""
    draw = random.Random(11)
    template = [f"t{i}" for i in range(304)]  # 300 shingles
    rows = []
    for n in range(800):
        ws = list(template)
        for at in draw.sample(range(10, 290, 5), 5):  # each takes five shingles of its own, so that 275 of 325 are shared
            ws[at] = f"v{n}x{at}"
        rows.append((n, " ".join(ws)))
    rows.append((-1, " ".join(template)))
    rows.append((1000, " ".join(f"other{i}" for i in range(304))))
    expected = plain_near_copies(rows)
    assert expected == [-1, 1000]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in near_copies.one_per_group(df).collect()) == expected


def test_each_text_of_an_id_counts(spark):
    """Two unlike texts with one id both stay, and what is near to either of them goes."""
    one, two = (" ".join(f"{c}{i}" for i in range(100)) for c in "xy")
    rows = [(1, one), (1, two), (1, two), (2, f"{one} end"), (3, f"{two} end"), (4, "something else"), (None, one)]
    kept = near_copies.one_per_group(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(kept, "doc_id", "text") == Counter([(1, one), (1, two), (4, "something else"), (None, one)])


def test_tiles_do_not_change_pairs_in_chains(spark):
    draw = np.random.default_rng(5)
    rows = [(n, 100 + n % 30, int(1 << (n % 50)), int(draw.integers(0, 1 << 40)) & 0x1111, n % 3, n % 7) for n in range(120)]
    nodes = spark.createDataFrame(rows, "id long, size long, first long, second long, chain long, group long")
    expected = {
        (a[0], b[0], (a[2] ^ b[2]).bit_count() + (a[3] ^ b[3]).bit_count()) for a in rows for b in rows
        if a[0] < b[0] and a[4] == b[4] and a[5] != b[5] and 5 * min(a[1], b[1]) >= 4 * max(a[1], b[1])
    }
    for tile in (7, 1000):
        found = [(min(r.a, r.b), max(r.a, r.b), r.bits) for r in near_copies.pairs_in_chains(nodes, tile=tile).collect()]
        assert len(found) == len(set(found)) and set(found) == expected


def test_tiles_do_not_change_candidates(spark, sf_texts):
    draw = np.random.default_rng(3)
    first = draw.integers(0, 1 << 63, 40)
    rows = [(i, 100 + i % 30, int(first[i % 40] ^ (1 << (i % 50))), int(first[i % 40])) for i in range(400)]
    nodes = spark.createDataFrame(rows, "id long, size long, first long, second long")
    expected = {
        (a[0], b[0]) for a in rows for b in rows
        if a[0] < b[0] and a[0] % 40 == b[0] % 40 and 5 * min(a[1], b[1]) >= 4 * max(a[1], b[1])
    }

    def components(pairs):
        group = {r[0]: {r[0]} for r in rows}
        for a, b in pairs:
            if group[a] is not group[b]:
                group[a] |= group[b]
                for n in group[b]:
                    group[n] = group[a]
        return {frozenset(g) for g in group.values()}

    for tile in (40, 1000):
        found = [(r.a, r.b) for r in near_copies.candidate_pairs(nodes, tile=tile).collect()]
        assert {(min(p), max(p)) for p in found} <= expected
        assert components(found) == components(expected)


# ---- Substrings -----------------------------------------------------------------------------------


def plain_repeats(rows, size=50):
    lowest = {}
    number = {None: math.inf}
    for d, t in rows:
        ws = words(t)
        for i in range(len(ws) - size + 1):
            key = tuple(ws[i : i + size])
            lowest[key] = min(lowest.get(key, math.inf), number.get(d, d))
    found = Counter()
    for d, t in rows:
        ws, gone = words(t), set()
        for i in range(len(ws) - size + 1):
            if lowest[tuple(ws[i : i + size])] < number.get(d, d):
                gone.update(range(i, i + size))
        found[d, len(ws), len(gone), sha(" ".join(w for i, w in enumerate(ws) if i not in gone))] += 1
    return found


def test_substrings_query(spark, sf_dir, sf_texts):
    found = QUERIES["op3_substrings"](spark, sf_dir)
    assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") == plain_repeats(list(sf_texts.items()))


@pytest.mark.parametrize("letter_words, group_rows", [(25, 1 << 20), (10, 5)])
def test_substrings_odd_rows(odd, odd_rows, letter_words, group_rows):
    changed = substrings.changed_texts(odd, letter_words=letter_words, group_rows=group_rows)
    joined = odd.select(substrings.row_key(odd).alias("key"), "doc_id", "text").join(changed, "key", "left")
    got = Counter()
    for r in joined.collect():
        kept = r.text if r.kept is None else r.kept
        got[r.doc_id, len(words(r.text)), r.n_removed or 0, sha(" ".join(words(kept)))] += 1
    assert got == plain_repeats(odd_rows)


def test_texts_without_repeats_stay(odd, empty):
    kept = substrings.without_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    by_id = {r.doc_id: r.text for r in kept.collect()}
    assert by_id[8].startswith("common0") and by_id[9] == "before it behind it\nand a line" and by_id[1] == ""
    assert substrings.without_repeats(empty).count() == 0


# ---- Tokenizers -----------------------------------------------------------------------------------


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_pretokens_encode_as_the_library(path, odd_rows):
    library, own = Tokenizer.from_file(path), Pretokenizer(path)
    rng = np.random.default_rng(3)
    pool = list("abcXYZ  \n\t\x0b\x1c\x85\xa0'sltre019²ÉßİΣςā!?#€—’…中文　😀\u0301") + ["<|endoftext|>"]
    texts = [t or "" for _, t in odd_rows] + ["".join(rng.choice(pool, n)) for n in rng.integers(0, 50, 500)]
    for text in texts:
        ids = []
        for part in own.pretokens(text):
            ids += [part] if isinstance(part, int) else [i for _, x in own.encode_pretokens(part) for i in x]
        assert ids == library.encode(text, add_special_tokens=False).ids


def plain_ids(text, path, _made={}):  # noqa: B006
    if path not in _made:
        _made[path] = Tokenizer.from_file(path)
    return _made[path].encode(text or "", add_special_tokens=False).ids


def test_bpe_round_trip(odd, odd_rows, empty):
    encoded = bpe.bpe_encode(odd, BYTE_BPE)
    decoded = bpe.bpe_decode(encoded, BYTE_BPE)
    want = Counter((d, np.array(plain_ids(t, BYTE_BPE), "<u4").tobytes(), t or "") for d, t in odd_rows)
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in decoded.collect()) == want
    assert bpe.bpe_decode(bpe.bpe_encode(empty, BYTE_BPE), BYTE_BPE).count() == 0


def test_bpe_query(spark, sf_dir, sf_texts):
    want = Counter()
    for d, t in sf_texts.items():
        ids = plain_ids(t, BYTE_BPE)
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(t or "")] += 1
    found = QUERIES["op4_bpe"](spark, sf_dir)
    assert rows_of(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_token_counts(spark, sf_dir, sf_texts, odd, odd_rows, empty):
    want = Counter((d, len((t or "").encode()), len(plain_ids(t, BYTE_BPE))) for d, t in odd_rows)
    assert rows_of(token_counts(odd, BYTE_BPE), "doc_id", "n_bytes", "n_tokens") == want
    assert token_counts(empty, BYTE_BPE).count() == 0
    found = QUERIES["op8_token_counts"](spark, sf_dir)
    want = Counter((d, len(plain_ids(t, BYTE_BPE)), len(plain_ids(t, BYTE_BPE)) > 512) for d, t in sf_texts.items())
    assert rows_of(found, "doc_id", "n_tokens", "over_limit") == want


def check_packed(rows, texts):
    """Padding as a share, after checking that each id lies in one piece and sequences have no gaps."""
    ids = {d: [*plain_ids(t, WORD_BPE), 1] for d, t in texts}
    copies = Counter(d for d, _ in texts)
    held, sequences = Counter(), defaultdict(list)
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32
        held[r.doc_id, r.start] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    total = sum(len(ids[d]) for d, _ in texts)
    assert sum(held.values()) == total and {d for d, _ in held} == set(copies)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return 1 - total / (2048 * len(sequences))


def test_packing(spark, sf_dir, sf_texts, odd, odd_rows, empty):
    assert check_packed(QUERIES["op7_packing"](spark, sf_dir).collect(), list(sf_texts.items())) < 0.02
    texts = [(d, t) for d, t in odd_rows if d is not None]
    check_packed(packing.pack(odd.where("doc_id is not null"), WORD_BPE).collect(), texts)
    assert packing.pack(odd, WORD_BPE).where("doc_id is null").count() == 2
    assert packing.pack(empty, WORD_BPE).count() == 0


def test_packing_plan_holds_all_and_is_near_the_bound():
    rng = np.random.default_rng(4)
    for n in (1, 7, 300, 5000):
        histogram = dict(Counter(rng.integers(1, 65, n).tolist()))
        plan = packing.packing_plan(histogram, 64)
        held = Counter()
        for times, pattern in plan:
            assert times > 0 and sum(s * k for s, k in pattern.items()) <= 64
            held.update({s: times * k for s, k in pattern.items()})
        assert all(held[s] >= n_ for s, n_ in histogram.items())
        least = math.ceil(sum(s * k for s, k in histogram.items()) / 64)
        assert sum(t for t, _ in plan) <= max(1.05 * least, least + 2)


# ---- Quality --------------------------------------------------------------------------------------


def plain_rules(text):
    text = text or ""
    ws = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 5)}
    failed = len(ws) < 10 or 100 * len(covered) > 20 * len(ws)
    return (
        len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed
    )


def test_rules_count_words_and_not_white_space(spark):
    """Symbols and shouting per word, capitals per character of a word, however wide the padding."""
    wide, long_word = " " * 60, "abcdefghijkl"
    texts = {
        "symbols": [wide.join(["ab", "cd", "#"] * 5), " ".join([long_word, long_word, f"{long_word}#"] * 5)],
        "shouting": [wide.join(["ab", "cd", "no!!"] * 5), " ".join([long_word, long_word, f"{long_word}!!"] * 5)],
        "capitals": [wide.join(["ABc", "DEf", "GHi"] * 5)],
    }
    # One symbol in six words, which is too few per word, though the words are short.
    fine = {"symbols": "a b c d e f# " * 3, "shouting": "a b c d e f!! " * 3, "capitals": "Ab Cd Ef " * 5}
    rejects = {rule.name: rule.rejects(F.col("text")) for rule in quality_rules.METHOD_RULES}
    for name, bad in texts.items():
        df = spark.createDataFrame([*((t, True) for t in bad), (fine[name], False)], "text string, bad boolean")
        assert [r.text for r in df.where(rejects[name] != F.col("bad")).collect()] == [], name


RULES = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_rules(spark, sf_dir, sf_texts, odd, odd_rows, empty):
    found = QUERIES["op5_quality_rules"](spark, sf_dir).cache()
    assert rows_of(found, *RULES) == Counter((d, *plain_rules(t)) for d, t in sf_texts.items())
    assert found.where("kept and base_failed").count() == 0
    assert rows_of(quality_rules.quality_rules(odd), *RULES) == Counter((d, *plain_rules(t)) for d, t in odd_rows)
    assert quality_rules.quality_rules(empty).count() == 0
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_order_of_rules_does_not_change_the_verdict(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = [*quality_rules.BASE_RULES, *quality_rules.METHOD_RULES]
    ordered = quality_rules.ordered(docs, rules)
    assert sorted(r.name for r in ordered) == sorted(r.name for r in rules)
    one, other = (quality_rules.cascade(x, F.col("text")) for x in (ordered, ordered[::-1]))
    assert docs.where(one != other).count() == 0
    good = docs.join(spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1"), "doc_id")
    assert good.where(quality_rules.n_words(F.col("text")) >= 10).where(~one).count() == 0


def test_quality_classifier_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    found = QUERIES["op6_quality_classifier"](spark, sf_dir).where("held_out")
    rows = found.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").select("quality", "predicted", "score").collect()
    good, bad = ([r.predicted for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) > 0.98 * len(good) and sum(bad) < 0.15 * len(bad)
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_classifier_odd_rows(spark, odd, empty):
    docs = odd.select("doc_id", "text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(17)] + [(None, 1), (3, None)], "doc_id long, label int")
    model = classifier.fit_compression_classifier(docs, labels)
    scores = classifier.compression_scores(docs, model).collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    nothing = classifier.fit_compression_classifier(docs, labels.limit(0))
    assert {r.score for r in classifier.compression_scores(docs, nothing).collect()} == {1.0}
    assert classifier.keep_good(odd, labels.limit(0)).columns == odd.columns
    assert classifier.compression_scores(empty.select("doc_id", "text"), model).count() == 0


def test_quality_classifier_sends_no_rows_to_python(spark):
    """Only the text crosses to Python, once, and comes back as a number; the rows kept are those of `compression_scores`."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(17)], "doc_id long, label int")
    rows = [(i, f"{'ab' if i % 2 else 'xy'} {i} " * 40, i * i) for i in range(17)] + [(None, "ab 1", 5), (3, None, None), (3, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more int")
    model = classifier.fit_compression_classifier(docs.select("doc_id", "text"), labels)
    assert model.weights
    kept = classifier.keep_good(docs, labels)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython [") == 1
    scores = classifier.compression_scores(docs, model).where(F.col("score") >= classifier.THRESHOLD)
    assert kept.columns == docs.columns and kept.count() > 0
    assert sorted(map(str, kept.drop("text").collect())) == sorted(map(str, scores.drop("score").collect()))


# ---- Fingerprints ---------------------------------------------------------------------------------


def plain_edited(rows):
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    found = Counter()
    for (d, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        found[d, len(t), sha(t[: len(t) - half] + after[:half])] += 1
    return found


def test_fingerprints(spark, sf_dir, sf_texts):
    found = QUERIES["op9_fingerprints"](spark, sf_dir).cache()
    assert rows_of(found, "doc_id", "n_chars", "edited_sha256") == plain_edited(list(sf_texts.items()))
    by_text = defaultdict(set)
    for r in found.collect():
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        by_text[sf_texts[r.doc_id]].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    means = found.agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert means[0] > 0.35 and means[1] < 0.1
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_fingerprints_of_odd_rows(odd, odd_rows, empty):
    found = fingerprints.document_fingerprints(odd).select(
        "doc_id", F.length("text").alias("n"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited")
    )
    assert rows_of(found, "doc_id", "n", "edited") == plain_edited(odd_rows)
    assert fingerprints.document_fingerprints(empty).count() == 0
    assert fingerprints.document_fingerprints(odd.where("doc_id = 3")).first().edited == "OnO"  # followed by itself


def test_fingerprints_add_and_remove(spark):
    of = lambda t: fingerprints.fingerprint(F.lit(t))
    row = spark.range(1).select(
        (of("a\nb\nc") == of("c\na\nb")).alias("order"),
        (fingerprints.combine(of("a\nb"), of("c")) == of("a\nb\nc")).alias("added"),
        (fingerprints.combine(of("a\nb\nb"), of("b"), remove=True) == of("a\nb")).alias("removed"),
        (of("a\nb\nb") == of("a\nb")).alias("counted"),
        fingerprints.likeness(of("a\nb"), of("b\na")).alias("same"),
    ).first()
    assert (row.order, row.added, row.removed, row.counted, row.same) == (True, True, True, False, 1.0)


# ---- URLs -----------------------------------------------------------------------------------------


def test_url_filters(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = Counter(db.execute(url_filters.OP10_SQL).fetchall())
    assert rows_of(QUERIES["op10_url_filters"](spark, sf_dir), "page_id", "host", "path", "rule", "verdict") == want


def test_url_filters_odd_rows(spark):
    urls = [
        None, "", "no scheme/en/", "http://", "HTTP://A.Example.NET/en/x?q=/de/", "http://net", "http://net/", "x://my.net?a",
        "http://example.com/de/", "http://notexample.com/de/", "http://a.b.c.example.com/de/#x", "http://example.org/fr/", "a://b://c.net/",
        "http://example.com/DE/", "http://" + "a." * 5000 + "net/" + "x" * 50000, "http://example.net/en", "http://ÄB.net/",
    ]
    rows = list(enumerate(urls)) + [(4, urls[4]), (4, urls[4]), (None, None)]
    pages = spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, rule string")
    rules = spark.createDataFrame([*url_filters.RULES, (None, "/", "block")], "host string, path string, verdict string")

    def plain(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [
            (len(h + p), h + p, v)
            for h, p, v in url_filters.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    want = Counter((i, *plain(u)) for i, u in rows)
    assert rows_of(url_filters.judge_urls(pages, rules), "page_id", "host", "path", "rule", "verdict") == want
    assert url_filters.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filters.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
