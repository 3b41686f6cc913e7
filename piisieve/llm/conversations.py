"""Conversation structure repair by a run-length dynamic programme over min-plus transitions.

A conversation's rows, in order, must spell role initials of the form `(s?(ua)+)?`. Each row may be kept (0), given
the role user or assistant (1) or deleted (2); blank and duplicate rows must be deleted; an empty user or assistant row
may be inserted anywhere (5); a truncated row that is not deleted costs 5 more. The automaton has four states (start,
after system, after user, after assistant); the cost of a row of a given symbol (role initial, fault) is a 4 x 4 min-plus
matrix, with any insertions before the row folded in.

1. Spark damages the rows, finds each row's faults with column expressions (duplicates by a window over
   (conversation, role, text), which spreads one conversation over many tasks) and numbers the rows of a conversation.
2. A Python task receives the rows of a conversation in order, as small symbols only (no texts). Equal consecutive
   symbols are collapsed into runs; the cost-to-go vector is carried backwards over each run by the cached binary
   powers of the run's matrix (M^1, M^2, M^4, ... are built once per symbol). The choices are then unrolled forwards:
   at each step the ASCII-least edit letter that still leads to the least cost is taken, over the set of states that
   spell the same letters so far. Out come the edits of each row and the conversation's counts, cost and audit.
3. The edits are joined back to the texts; a task hashes each conversation's repaired `role:text` lines in order,
   feeding SHA-256 batch by batch, so no conversation is ever held whole.

Defined results: null conv_id is a conversation of its own (joined null-safe); null turn sorts first, null role or text is one space.
Rows of equal turn are ordered by role, then text (repeated rows are equal anyway). A conversation whose rows are all
dropped has zero counts, empty audit and the hash of the empty string. Extra input columns are not carried. An empty
table gives an empty result.
"""

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from piisieve.llm.common import SPACE, written

INF = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (START, ASSISTANT)
# Fixed values of the contract: costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# The automaton of `(s?(ua)+)?` on role initials.
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLE = {"u": "user", "a": "assistant"}
OK, MUST_DELETE, CUT = 0, 1, 2


def _options(state: int, initial: str, kind: int) -> list[tuple[str, int, int, str | None]]:
    """The row edits from a state: (letter, cost, next state, initial of the new role or None for the row's own)."""
    out = [("D", DELETE, state, "")]
    if kind != MUST_DELETE:
        extra = TRUNCATED if kind == CUT else 0
        if (state, initial) in STEP:
            out.append(("K", KEEP + extra, STEP[state, initial], None))
        for new in "au":
            if (state, new) in STEP:
                out.append(("R", REROLE + extra, STEP[state, new], new))
    return out


def _inserts(state: int) -> list[tuple[int, str]]:
    return [(STEP[state, new], new) for new in "au" if (state, new) in STEP]


def _closure() -> np.ndarray:
    """Least cost of reaching each state from each state by insertions alone."""
    c = np.full((4, 4), INF, np.int64)
    np.fill_diagonal(c, 0)
    for _ in range(4):
        for x in range(4):
            for y, _ in _inserts(x):
                for z in range(4):
                    c[x, z] = min(c[x, z], INSERT + c[y, z])
    return c


CLOSURE = _closure()
END = np.array([min(CLOSURE[x, y] for y in ACCEPTING) for x in range(4)], np.int64)


def _matrix(initial: str, kind: int) -> np.ndarray:
    """M[x, y]: least cost from x before the row (insertions first) to y after it."""
    row = np.full((4, 4), INF, np.int64)
    for x in range(4):
        for _, cost, y, _ in _options(x, initial, kind):
            row[x, y] = min(row[x, y], cost)
    return (CLOSURE[:, :, None] + row[None, :, :]).min(axis=1)


def _times(m, v: list[int]) -> list[int]:
    """The min-plus product of a 4 x 4 matrix and a vector."""
    return [min(min(m[x][y] + v[y] for y in range(4)), INF) for x in range(4)]


def _square(p):
    return tuple(tuple(min(min(p[x][k] + p[k][y] for k in range(4)), INF) for y in range(4)) for x in range(4))


class Powers:
    """M, M^2, M^4, ... of each symbol's matrix under the min-plus product, built when first needed."""

    def __init__(self):
        self.cache: dict[tuple[str, int], list] = {}

    def apply(self, symbol: tuple[str, int], count: int, v: list[int]) -> list[int]:
        """M^count (x) v."""
        powers = self.cache.get(symbol)
        if powers is None:
            powers = self.cache[symbol] = [tuple(tuple(int(c) for c in row) for row in _matrix(*symbol))]
        bit = 0
        while count:
            if bit == len(powers):
                powers.append(_square(powers[-1]))
            if count & 1:
                v = _times(powers[bit], v)
            count >>= 1
            bit += 1
        return v


POWERS = Powers()


@functools.cache
def _moves(state: int, initial: str, kind: int) -> tuple[tuple[str, int, int, str | None], ...]:
    return tuple(_options(state, initial, kind))


@functools.cache
def _step_matrix(initial: str, kind: int) -> tuple[tuple[int, ...], ...]:
    return tuple(tuple(int(c) for c in row) for row in _matrix(initial, kind))


INSERTS = [tuple(_inserts(x)) for x in range(4)]
# A run up to this long has its rows' cost-to-go vectors stepped back one by one; a longer one takes them from the powers.
STEPPED_RUN = 4096


def repair(symbols: list[tuple[str, int]]) -> tuple[int, str, list[tuple[str, str, str | None]]]:
    """Least cost, audit, and per row (inserted initials before it, its letter, new initial); one more entry for the end."""
    n = len(symbols)
    runs: list[tuple[tuple[str, int], int]] = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1] = (s, runs[-1][1] + 1)
        else:
            runs.append((s, 1))
    after = [[int(c) for c in END]]  # cost-to-go after each run, from the last run backwards
    for symbol, count in reversed(runs):
        after.append(POWERS.apply(symbol, count, after[-1]))
    after.reverse()  # after[k]: before run k; after[len(runs)]: at the end
    best = int(after[0][START])
    ends = after

    def vectors(run: int) -> list[list[int]]:
        """Cost-to-go before each row of a run and after its last, stepped back from the run's end."""
        symbol, count = runs[run]
        if count > STEPPED_RUN:
            return [POWERS.apply(symbol, count - j, after[run + 1]) for j in range(count + 1)]
        if count == 1:
            return [after[run], after[run + 1]]
        m = _step_matrix(*symbol)
        out = [after[run + 1]]
        for _ in range(count):
            out.append(_times(m, out[-1]))
        out.reverse()
        return out

    states = {START: 0}
    back: list[dict[int, tuple[int, str, str | None]]] = []
    audit: list[str] = []
    for run, (symbol, count) in enumerate(runs):
        togo = vectors(run)
        for j in range(count):
            here, there = togo[j], togo[j + 1]
            while True:
                moves = []
                for x, g in states.items():
                    for y, new in INSERTS[x]:
                        if g + INSERT + here[y] == best:
                            moves.append(("I", y, g + INSERT, x, new))
                    for letter, cost, y, new in _moves(x, *symbol):
                        if g + cost + there[y] == best:
                            moves.append((letter, y, g + cost, x, new))
                letter = min(m[0] for m in moves)
                chosen: dict[int, tuple[int, str, str | None]] = {}
                costs: dict[int, int] = {}
                for m in sorted(moves, key=lambda m: (m[2], m[3], m[4] or "")) if len(moves) > 1 else moves:
                    if m[0] == letter and m[1] not in chosen:
                        chosen[m[1]], costs[m[1]] = (m[3], letter, m[4]), m[2]
                back.append(chosen)
                states = costs
                audit.append(letter)
                if letter != "I":
                    break
    end = [int(c) for c in END]
    while not any(x in ACCEPTING and g == best for x, g in states.items()):
        moves = [(y, g + INSERT, x, new) for x, g in states.items() for y, new in INSERTS[x] if g + INSERT + end[y] == best]
        chosen, costs = {}, {}
        for y, g, x, new in sorted(moves, key=lambda m: (m[1], m[2], m[3])):
            if y not in chosen:
                chosen[y], costs[y] = (x, "I", new), g
        back.append(chosen)
        states = costs
        audit.append("I")
    state = min(x for x, g in states.items() if x in ACCEPTING and g == best)
    steps = []
    for chosen in reversed(back):
        x, letter, new = chosen[state]
        steps.append((letter, new))
        state = x
    steps.reverse()
    edits: list[tuple[str, str, str | None]] = []
    inserted = ""
    for letter, new in steps:
        if letter == "I":
            inserted += new
        else:
            edits.append((inserted, letter, new))
            inserted = ""
    edits.append((inserted, "", None))
    assert len(edits) == n + 1
    return best, "".join(audit), edits


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage of rows, with each row's faults and its number in its conversation."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = F.crc32(F.encode(key, "UTF-8")) % 20
    rows = rows.withColumn("hit", hit).where(F.col("hit") != 0).select(
        "conv_id",
        "turn",
        F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
    seen = Window.partitionBy("conv_id", "role", "text").orderBy(*order)
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    duplicate = F.row_number().over(seen) > 1
    truncated = ~F.regexp_extract("text", f"([^{SPACE}])[{SPACE}]*$", 1).isin(".", "!", "?")
    return rows.select(
        "*",
        F.when(blank, 1).when(duplicate, 2).when(truncated, 3).otherwise(0).alias("fault"),
        F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).alias("ord"),
    )


def conversation_repairs(conversations: DataFrame) -> DataFrame:
    """Per original conversation: gaps, fault counts, illegal pairs, cost, audit and the repaired text's SHA-256."""
    rows = written(damaged(conversations))
    symbols = rows.select("conv_id", "ord", F.substring("role", 1, 1).alias("initial"), "fault")
    fields = [("conv_id", pa.int64()), ("ord", pa.int64()), ("inserts", pa.string()), ("action", pa.string()), ("new", pa.string())]
    summary = [("conv_id", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
               ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]
    out = pa.schema([*fields, ("summary", pa.struct(summary[1:]))])

    def finish(conv, initials, faults):
        kinds = [MUST_DELETE if f in (1, 2) else CUT if f == 3 else OK for f in faults]
        cost, audit, edits = repair(list(zip(initials, kinds)))
        pairs = [a + b for a, b in zip(initials, initials[1:])]
        stats = {
            "blank": faults.count(1), "duplicate": faults.count(2), "truncated": faults.count(3),
            "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
        }
        rows = [(conv, k + 1, ins, act, new, None) for k, (ins, act, new) in enumerate(edits)]
        rows[-1] = (*rows[-1][:5], stats)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), out)], schema=out)

    def run(batches):
        conv, initials, faults, started = None, [], [], False
        for batch in batches:
            for c, i, f in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if started and c != conv:
                    yield finish(conv, initials, faults)
                    initials, faults = [], []
                conv, started = c, True
                initials.append(i)
                faults.append(f)
        if started:
            yield finish(conv, initials, faults)

    out_ddl = ("conv_id long, ord long, inserts string, action string, new string, summary struct<blank:long, "
               "duplicate:long, truncated:long, illegal:long, cost:long, audit:string>")  # fmt: skip
    edits = written(symbols.repartition("conv_id").sortWithinPartitions("conv_id", "ord").mapInArrow(run, out_ddl))

    texts = rows.select(F.col("conv_id").alias("_conv"), F.col("ord").alias("_ord"), "role", "text")
    lines = edits.join(texts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("ord") == F.col("_ord")), "left").select(
        "conv_id",
        "ord",
        F.concat(
            F.concat_ws("", F.transform(F.split("inserts", ""), lambda r: F.when(r != "", F.concat(F.when(r == "u", "user").otherwise("assistant"), F.lit(":\n"))))),
            F.when(F.col("action").isin("K", "R"), F.concat(
                F.when(F.col("action") == "K", F.col("role")).when(F.col("new") == "u", "user").otherwise("assistant"), F.lit(":"), F.col("text"), F.lit("\n")
            )).otherwise(F.lit("")),
        ).alias("piece"),
    )

    def digest(batches):
        conv, h, started, more = None, hashlib.sha256(), False, False
        out_rows: list[tuple] = []
        for batch in batches:
            for c, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if started and c != conv:
                    out_rows.append((conv, h))
                    h, more = hashlib.sha256(), False
                conv, started = c, True
                if piece:  # lines end in a newline; the last one's is held back, as lines are joined by newlines
                    h.update((("\n" if more else "") + piece[:-1]).encode())
                    more = True
            if len(out_rows) > 1000:
                yield _digests(out_rows)
                out_rows = []
        if started:
            out_rows.append((conv, h))
        yield _digests(out_rows)

    hashed = lines.repartition("conv_id").sortWithinPartitions("conv_id", "ord").mapInArrow(digest, "conv_id long, repaired_sha256 string")
    stats = edits.where(F.col("summary").isNotNull()).select("conv_id", "summary.*")
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    gaps = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps")
    )
    zero = F.lit(0).cast("long")
    result = turns
    for part in (gaps, stats, hashed):
        part = part.withColumnRenamed("conv_id", "_conv")
        result = result.join(part, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return result.select(
        "conv_id",
        F.coalesce("gaps", zero).alias("gaps"),
        *(F.coalesce(c, zero).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    """Finished conversations as rows; a repaired text is its lines joined by newlines, so the last newline goes."""
    return pa.RecordBatch.from_arrays(
        [pa.array([c for c, _ in rows], pa.int64()), pa.array([_hex(h) for _, h in rows], pa.string())],
        names=["conv_id", "repaired_sha256"],
    )


def _hex(h) -> str:
    return h.hexdigest()


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return conversation_repairs(conversations)
