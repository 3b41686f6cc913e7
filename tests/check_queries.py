"""Run registered queries beside their SQL and compare names, types and rows.

    python tests/check_queries.py SF_DIR [QUERY ...]
"""

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import oracle_sql, queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def connect(sf_dir: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def compare(spark, db, sf_dir: str, name: str) -> tuple[int, list[str]]:
    """Number of rows and what differs."""
    problems = []
    df = queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    sql = oracle_sql().get(name)
    if sql is None:
        return len(rows), problems
    db.execute(sql)
    described = {d[0]: str(d[1]) for d in db.description}
    expected_rows = db.fetchall()
    if sorted(described) != columns:
        return len(rows), [f"columns {columns} but SQL has {sorted(described)}"]
    for column, kind in df.dtypes:
        if TYPES[kind] != described[column]:
            problems.append(f"{column} is {kind} but {described[column]} in SQL")
    order = [list(described).index(c) for c in columns]
    expected = Counter(tuple(r[i] for i in order) for r in expected_rows)
    got = Counter(rows)
    if got != expected:
        problems.append(
            f"{len(rows)} rows, SQL {len(expected_rows)}; only Spark: {list((got - expected).items())[:2]}; "
            f"only SQL: {list((expected - got).items())[:2]}"
        )
    return len(rows), problems


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    db = connect(sf_dir)
    bad = 0
    for name in names:
        begun = time.time()
        try:
            count, problems = compare(spark, db, sf_dir, name)
        except Exception as error:
            count, problems = -1, [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        checked = "" if name in oracle_sql() else " (no SQL)"
        print(f"{'BAD' if problems else 'ok '} {name}{checked}: {count} rows, {time.time() - begun:.1f} s", flush=True)
        for problem in problems:
            print("    ", problem, flush=True)
    print(f"{len(names)} queries, {bad} bad")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
