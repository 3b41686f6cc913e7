"""Text tables as scan input."""

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tasks per core that make up for documents of uneven size.
TASKS_PER_CORE = 4
# A task may read so many times its even share of a core's rows before the table counts as crowded.
CROWDED = 2


def spread(df: DataFrame, spark: SparkSession, *, rows_per_task: int | None = None) -> DataFrame:
    """Spread a table over the cluster if its rows come in fewer tasks than there are cores, or crowd in a few of them.

    Matching is CPU-bound, so a table in one file must not be scanned by one task. Splits of a file say little about that: a row
    group goes whole to one split, and the others are empty. So the rows of each split are counted, without a column, which reads
    footers only. A table that comes evenly in enough tasks is returned as it is and is not shuffled. With `rows_per_task`, for
    narrow tables from which texts are made, no task gets many more rows than that. Meant for a plain file scan.
    """
    cores = spark.sparkContext.defaultParallelism
    least = cores * TASKS_PER_CORE
    if rows_per_task is None and df.rdd.getNumPartitions() < cores:
        return df.repartition(least)
    per_split = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
    rows, fullest = per_split.agg(F.sum("n"), F.max("n")).first()
    if not rows:
        return df
    if rows_per_task is not None:
        return df.repartition(max(least, ceil(rows / rows_per_task)))
    return df.repartition(least) if fullest * cores > CROWDED * rows else df
