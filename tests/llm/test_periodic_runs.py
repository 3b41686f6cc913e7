"""op12: runs against a plain search of every period, the planted change, and the query's digests."""

import hashlib
import random
import zlib

from piisieve.llm import periodic_runs as pr
from piisieve.llm.queries import QUERIES


def plain_runs(t):
    """Every maximal stretch of period q, length >= max(6, 4q), whose smallest period is q."""
    n, out = len(t), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if t[i] != t[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and t[j] == t[j + q]:
                j += 1
            s, length = i, j + q - i
            smallest = min(p for p in range(1, q + 1) if all(t[k] == t[k + p] for k in range(s, s + length - p)))
            if length >= max(6, 4 * q) and smallest == q:
                out.add((s, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_plain_search():
    rng = random.Random(7)
    for _ in range(1500):
        n, letters = rng.randint(0, 70), rng.randint(1, 4)
        t = [bytes([97 + rng.randrange(letters)]) for _ in range(n)]
        if n > 10 and rng.random() < 0.4:
            s, p = rng.randrange(n), rng.randint(1, 5)
            t = t[:s] + [t[s + (i - s) % p] for i in range(s, n)]
        assert pr.find_runs(t) == plain_runs(t), t


def test_planted_change():
    doc_id = next(d for d in range(1000) if zlib.crc32(str(d).encode()) % 10 == 0)
    tokens = [str(i).encode() for i in range(40)]
    g = zlib.crc32(str(doc_id).encode()) // 10
    a = g % 40
    p = 1 + (40 - a) // (3 + g % 8)
    changed = pr.planted(doc_id, tokens)
    assert changed[:a] == tokens[:a] and all(changed[i] == tokens[a + (i - a) % p] for i in range(a, 40))
    other = next(d for d in range(1000) if zlib.crc32(str(d).encode()) % 10)
    assert pr.planted(other, tokens) == tokens
    assert pr.planted(None, tokens) == tokens and pr.planted(doc_id, []) == []


def test_query_digests(spark, odd, empty):
    rows = {r.doc_id: r for r in pr.periodic_runs(odd).collect() if r.doc_id is not None}
    text = "a a a a a a a a a a a a"
    row = rows[11]
    assert (row.n_words, row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (12, 1, 0, 12, 1, 12000)
    assert row.runs_sha256 == hashlib.sha256(b"0,12,1\n").hexdigest()
    assert row.collapsed_sha256 == hashlib.sha256(b"a").hexdigest() and text
    for d in (0, 1, 2):
        assert rows[d].n_words == 0 and rows[d].n_runs == 0 and rows[d].start is None
        assert rows[d].runs_sha256 == rows[d].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[15][1:] == rows[16][1:] or zlib.crc32(b"15") % 10 == 0 or zlib.crc32(b"16") % 10 == 0
    assert pr.periodic_runs(empty).count() == 0
    assert len(pr.periodic_runs(odd).collect()) == odd.count()


def test_query_against_plain_version(spark, sf_dir, sf_texts):
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    assert set(got) == set(sf_texts)
    for doc_id, text in sf_texts.items():
        tokens = pr.planted(doc_id, (text or "").encode().split())
        runs = plain_runs(tokens) if len(tokens) < 400 else pr.find_runs(tokens)
        row = got[doc_id]
        assert row.n_runs == len(runs) and row.n_words == len(tokens)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
