"""A report as a table of files that a rerun leaves the same: partitions are replaced whole, and a manifest says what each holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def partition_marks(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """``(partition columns, n_rows, checksum)``: the rows of each partition and a sum over their hashes that no order changes.

    One aggregate with a map-side part; each row is hashed with all its columns in the order of their names."""
    cols = sorted(df.columns)
    # a sum of 32-bit parts cannot overflow a long before 2**31 rows of a partition and, unlike xor, counts repeated rows
    h = F.xxhash64(*[F.col(c) for c in cols])
    return df.groupBy(*partition_by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("checksum"))


def write_report(df: DataFrame, path: str, partition_by: Sequence[str]) -> DataFrame:
    """Write ``df`` below ``path/data``, replacing exactly the partitions it holds, and their rows of ``path/manifest``; returns the manifest.

    Partitions that ``df`` does not hold stay.  Running it again with the same rows gives the same content: nothing is appended, and files of a failed
    attempt are replaced.  An empty text in a partition column is read back as NULL.  The manifest is taken from the files, after they are written."""
    spark, by = df.sparkSession, list(partition_by)
    # few files a partition, and adaptive execution splits a partition that holds much of the report
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{path}/data")
    marks = partition_marks(spark.read.schema(df.schema).parquet(f"{path}/data"), by)
    marks.write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.schema(marks.schema).parquet(f"{path}/manifest")


def read_report(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of a report written with ``write_report``."""
    return spark.read.schema(schema).parquet(f"{path}/data")


def damaged_partitions(spark: SparkSession, path: str, schema, partition_by: Sequence[str]) -> DataFrame:
    """Partitions whose files do not hold what the manifest says: changed, missing, or unknown to it.  Empty when all is well."""
    by = list(partition_by)
    now = partition_marks(read_report(spark, path, schema), by)
    then = spark.read.schema(now.schema).parquet(f"{path}/manifest")
    same = [now[c].eqNullSafe(then[c]) for c in by]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    both = now.join(then, cond, "full")
    differs = ~(now["n_rows"].eqNullSafe(then["n_rows"]) & now["checksum"].eqNullSafe(then["checksum"]))
    return both.where(differs).select(*[F.coalesce(now[c], then[c]).alias(c) for c in by], now["n_rows"].alias("rows_found"), then["n_rows"].alias("rows_expected"))
