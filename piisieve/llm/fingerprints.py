"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

A paragraph is hashed to a wide vector, and a text's fingerprint is the sum of its paragraphs' vectors, each lane modulo
a power of two. So the order of paragraphs does not matter, and paragraphs can be added to or taken from a fingerprint
without the rest of the text. The vector has few wide lanes, which tell unequal texts apart, and many narrow ones, of
which a paragraph raises one; their correlation tells how much two texts share.

All of it is column expressions.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from piisieve.functions.arrays import let

WIDE_LANES, WIDE_BITS = 4, 60
NARROW_LANES, NARROW_BITS = 128, 16
# Lines, cut also behind the end of a sentence, so that a text of one line has more than one paragraph.
PARAGRAPH_BREAK = r"\n|(?<=[.!?]) "
BUCKETS_PER_PARTITION = 8


def _mask(bits: int) -> Column:
    return F.lit((1 << bits) - 1).cast("long")


def fingerprint(text: Column) -> Column:
    """struct<wide: array<bigint>, narrow: array<bigint>> of a text; all zero for a null or empty one."""

    def wide(paragraphs: Column, lane: int) -> Column:
        mask = _mask(WIDE_BITS)
        return F.aggregate(
            paragraphs,
            F.lit(0).cast("long"),
            lambda total, p: (total + F.xxhash64(p, F.lit(lane)).bitwiseAND(mask)).bitwiseAND(mask),
        )

    def narrow(paragraphs: Column) -> Column:
        # One character per paragraph names its lane, so that a lane is counted by one native string operation.
        lanes = F.transform(paragraphs, lambda p: F.char(F.pmod(F.xxhash64(p), F.lit(NARROW_LANES)) + 1))
        return let(
            F.array_join(lanes, ""),
            lambda s: F.transform(
                F.sequence(F.lit(1), F.lit(NARROW_LANES)),
                lambda lane: (F.length(s) - F.length(F.replace(s, F.char(lane.cast("long")), F.lit(""))))
                .cast("long")
                .bitwiseAND(_mask(NARROW_BITS)),
            ),
        )

    paragraphs = F.filter(F.split(F.coalesce(text, F.lit("")), PARAGRAPH_BREAK, -1), lambda p: p != "")
    return let(
        paragraphs,
        lambda ps: F.struct(
            F.array(*[wide(ps, lane) for lane in range(WIDE_LANES)]).alias("wide"), narrow(ps).alias("narrow")
        ),
    )


def combine(a: Column, b: Column, *, remove: bool = False) -> Column:
    """The fingerprint of the paragraphs of both, or of those of `a` without those of `b`."""

    def lanes(name: str, bits: int) -> Column:
        mask = _mask(bits)
        return F.zip_with(
            a[name], b[name], lambda x, y: ((x - y + mask + 1) if remove else (x + y)).bitwiseAND(mask)
        ).alias(name)

    return F.struct(lanes("wide", WIDE_BITS), lanes("narrow", NARROW_BITS))


def fingerprint_text(value: Column) -> Column:
    """The lanes in hexadecimal digits."""

    def digits(name: str, bits: int) -> Column:
        width = bits // 4
        return F.array_join(F.transform(value[name], lambda x: F.lpad(F.lower(F.hex(x)), width, "0")), "")

    return F.concat(digits("wide", WIDE_BITS), digits("narrow", NARROW_BITS))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints; else the correlation of the narrow lanes, which estimates the share of common
    paragraphs, and 0 where it is negative or undefined."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0).cast("long"), lambda s, v: s + v).cast("double")

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v).cast("double")

    def correlation(x: Column, y: Column) -> Column:
        def ratio(t: Column) -> Column:
            varied = (NARROW_LANES * t["xx"] - t["x"] * t["x"]) * (NARROW_LANES * t["yy"] - t["y"] * t["y"])
            shared = NARROW_LANES * t["xy"] - t["x"] * t["y"]
            return F.when(varied > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), shared / F.sqrt(varied)))).otherwise(0.0)

        sums = F.struct(
            dot(x, x).alias("xx"), dot(y, y).alias("yy"), dot(x, y).alias("xy"), total(x).alias("x"), total(y).alias("y")
        )
        return let(sums, ratio)

    return F.when(a == b, 1.0).otherwise(correlation(a["narrow"], b["narrow"]))


def _sql_value(value: int | str) -> str:
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bucket(value: Column, starts: list, kind: str) -> Column:
    """How many of the ascending `starts` are not above the value, by binary search; 0 for null.

    Integer and string bounds go into the plan as one SQL array, which the optimizer folds into a single literal, not
    one call into the JVM each.
    """
    if not starts:
        return F.lit(0)
    if all(isinstance(s, int) and not isinstance(s, bool) for s in starts) or all(isinstance(s, str) for s in starts):
        bounds = F.expr(f"CAST(array({', '.join(map(_sql_value, starts))}) AS array<{kind}>)")
    else:
        bounds = F.array(*map(F.lit, starts))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(starts).bit_length()))])

    def step(at: Column, width: Column) -> Column:
        return F.when((at + width <= len(starts)) & (F.get(bounds, at + width - 1) <= value), at + width).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def with_next(df: DataFrame, *, id_col: str, columns: list[str], derive) -> DataFrame:
    """Each row with `next`, a struct of the `columns` of the row with the next higher id; after the last, the first.

    Rows are dealt by ranges of the id, whose bounds come from the ids alone and number a few per shuffle partition, so
    texts are shuffled once and no task orders more than some ranges. The first row of each range is also sent to the range before.
    Rows of equal ids follow each other in the order of `columns`; a null id comes first. `derive` adds columns
    before the next row is looked up.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = df.select(id_col).where(F.col(id_col).isNotNull())
    ranged = ids.repartitionByRange(BUCKETS_PER_PARTITION * partitions, id_col)
    bounds = ranged.groupBy(F.spark_partition_id().alias("range")).agg(F.min(id_col).alias("first")).collect()
    starts = sorted(r["first"] for r in bounds)
    null_first = df.where(F.col(id_col).isNull()).limit(1).count() > 0
    kind = df.schema[id_col].dataType
    rows = df.withColumn("range", _bucket(F.col(id_col), starts[0 if null_first else 1 :], kind.simpleString()))
    rows = rows.withColumn("copied", F.lit(0))
    ranges = len(starts) + null_first
    # The first rows, by range: as many as there are ranges, and rows with the same id.
    firsts = ([None] if null_first else []) + starts
    sent = spark.createDataFrame(
        [(first, (at - 1) % ranges) for at, first in enumerate(firsts)],
        f"first {kind.simpleString()}, sent_to int",
    )
    heads = df.join(F.broadcast(sent), F.col(id_col).eqNullSafe(F.col("first")))
    heads = heads.withColumn("range", F.col("sent_to")).withColumn("copied", F.lit(1)).drop("first", "sent_to")
    dealt = derive(rows.unionByName(heads).repartition(partitions, "range"))
    order = Window.partitionBy("range").orderBy("copied", F.asc_nulls_first(id_col), *map(F.asc_nulls_first, df.columns))
    return dealt.withColumn("next", F.lead(F.struct(*columns)).over(order)).where("copied = 0").drop("range", "copied")


def document_fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, text, print, next_print, edited, edited_print): fingerprints of each text, of the next document's,
    and of the text whose second half is replaced by the start of the next document's.

    The last floor(n/2) code points go, and as many first ones of the next text come, or all it has. Null texts
    count as empty; repeated rows are documents of their own; other columns are not read. Very long texts are
    fingerprinted whole; an empty table gives an empty result.
    """
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    paired = with_next(
        docs, id_col="id", columns=["text", "print"], derive=lambda d: d.withColumn("print", fingerprint(F.col("text")))
    )
    length = F.length("text")
    half = F.floor(length / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), length - half), F.substring(F.col("next.text"), F.lit(1), half))
    paired = paired.select("id", "text", "print", F.col("next.print").alias("next_print"), edited.alias("edited"))
    return paired.withColumn("edited_print", fingerprint(F.col("edited"))).withColumnRenamed("id", id_col)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = document_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return prints.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("print")).alias("fingerprint"),
        fingerprint_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
