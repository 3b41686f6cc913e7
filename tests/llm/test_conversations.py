"""op13: the programme against all edit scripts of short conversations; the query against a plain pass in Python."""

import hashlib
import itertools
import random
import re
import zlib

from piisieve.llm import conversations as cv
from piisieve.llm.queries import QUERIES

GRAMMAR = re.compile(r"(s?(ua)+)?")


def plain_repair(symbols):
    """Least cost and ASCII-least audit over every script with at most two insertions in each gap."""
    best = None
    gaps = ["", "a", "u", "aa", "au", "ua", "uu"]
    n = len(symbols)
    for acts in itertools.product(["D", "K", "Ra", "Ru"], repeat=n):
        if any(a != "D" and k == cv.MUST_DELETE for a, (_, k) in zip(acts, symbols)):
            continue
        for ins in itertools.product(gaps, repeat=n + 1):
            cost, audit, spelled = 0, "", ""
            for k in range(n + 1):
                cost += cv.INSERT * len(ins[k])
                audit += "I" * len(ins[k])
                spelled += ins[k]
                if k == n:
                    break
                a, (initial, kind) = acts[k], symbols[k]
                audit += a[0]
                if a == "D":
                    cost += cv.DELETE
                    continue
                cost += (cv.REROLE if a[0] == "R" else 0) + (cv.TRUNCATED if kind == cv.CUT else 0)
                spelled += a[1] if a[0] == "R" else initial
            if GRAMMAR.fullmatch(spelled) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def test_programme_equals_all_scripts():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randint(0, 3)
        symbols = [(rng.choice("suax"), rng.choice([cv.OK, cv.OK, cv.MUST_DELETE, cv.CUT])) for _ in range(n)]
        cost, audit, edits = cv.repair(symbols)
        assert (cost, audit) == plain_repair(symbols), symbols
        assert len(edits) == n + 1


def test_long_runs_use_powers():
    symbols = [("a", cv.OK)] * 1001 + [("u", cv.CUT)] * 3
    cost, audit, _ = cv.repair(symbols)
    assert cost == cv.repair([("a", cv.OK)] * 1001)[0] + 3 * cv.DELETE or cost < 1000
    assert len(audit) >= len(symbols)


def plain_query(rows):
    """The contract's result from a list of (conv_id, turn, role, text)."""
    out, convs = {}, {}
    for c, t, r, x in rows:
        convs.setdefault(c, [])
        r, x = r if r is not None else " ", x if x is not None else " "
        key = f"{c if c is not None else ' '}:{t if t is not None else ' '}"
        hit = zlib.crc32(key.encode()) % 20
        if hit == 0:
            continue
        r = "user" if hit == 4 else r
        x = "" if hit == 1 else re.sub(r"[.!?]", "", x) if hit == 2 else x
        convs[c] += [(t, r, x)] * (2 if hit == 3 else 1)
    for c, items in convs.items():
        items.sort(key=lambda i: (i[0] is not None, i[0] or 0, i[1], i[2]))
        seen, faults = set(), []
        for t, r, x in items:
            blank = re.search(r"[^\x20\x09-\x0D]", x) is None
            stripped = x.rstrip(" \t\n\x0b\x0c\r")
            faults.append(1 if blank else 2 if (r, x) in seen else 3 if stripped[-1:] not in (".", "!", "?") else 0)
            seen.add((r, x))
        initials = [r[:1] for _, r, _ in items]
        symbols = [(i, cv.MUST_DELETE if f in (1, 2) else cv.CUT if f == 3 else cv.OK) for i, f in zip(initials, faults)]
        cost, audit, edits = cv.repair(symbols)
        lines = []
        for (ins, act, new), item in zip(edits, [*items, None]):
            lines += [f"{cv.ROLE[i]}:" for i in ins]
            if act in ("K", "R"):
                lines.append(f"{item[1] if act == 'K' else cv.ROLE[new]}:{item[2]}")
        turns = [t for t, _, _ in items if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[c] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit,
                  hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_query_against_plain_pass(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    rng = random.Random(5)
    extra = [(None, 1, "user", "Hi."), (None, None, None, None), (10**6, None, "user", "a"), (10**6, 3, "user", "a")]
    extra += [(10**6 + 1, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["Ok.", "", "  ", "cut", None]))
              for t in range(30)]
    frame = spark.createDataFrame(rows + extra, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in cv.conversation_repairs(frame).collect()}
    want = plain_query(rows + extra)
    assert got == want
    assert set(r.conv_id for r in QUERIES["op13_conversation_repair"](spark, sf_dir).collect()) == set(r[0] for r in rows)


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, audit int, cost string")
    assert cv.conversation_repairs(empty).count() == 0
    gone = next(t for t in range(100) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    one = spark.createDataFrame([(7, gone, "user", "Hi.", 1, "x")], "conv_id long, turn long, role string, text string, audit int, cost string")
    row = cv.conversation_repairs(one).collect()[0]
    assert tuple(row) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
