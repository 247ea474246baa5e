"""Order tables stored together: by month of the header's approval, bucketed by header.

Headers, lines, shipments and distributions each get two stored keys, ``store_header`` (the header a row belongs to) and
``approval_month`` (``YYYYMM`` of that header's approval; 0 if it has none or the header is unknown).  One write pays for the
shuffles, and the inner chain header - line - shipment - distribution then runs without any: all four scans declare the
same buckets, which hold the joins' keys together in a session with ``CO_LOCATED`` set (without it the rows are the same, but
the joins shuffle).  A date range is a range of months too, which the equality of months carries from the headers to the other
three scans, so a one-month report opens one month of each.

Rows of an unknown header are kept: their stored key is a negative hash of their own id, so they are dealt over all buckets.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supplyscope.functions.oracle import day_range, parse_report_date
from supplyscope.sources.tables import LazyTables

KEYS = ["store_header", "approval_month"]
TABLES = ["po_headers_all", "po_lines_all", "po_line_locations_all", "po_distributions_all"]

#: Lets tables bucketed by the header alone meet in joins that name the header and more; a session setting, so it is left to the caller.
CO_LOCATED = ("spark.sql.requireAllClusterKeysForCoPartition", "false")

#: A layout whose largest bucket holds more than this many times the mean is read as plain files, whose joins adaptive execution can split.
MOST_SKEW = 4.0

#: Rows of the largest table (distributions) in one bucket.  A bucket is sorted in one task when it is stored and when it is joined.
BUCKET_ROWS = 2_000_000


def buckets_for(t: Mapping[str, DataFrame], least: int = 4) -> int:
    """A number of buckets that grows with the distributions, so that a bucket does not (one count, of Parquet's metadata alone)."""
    return max(least, -(-t["po_distributions_all"].count() // BUCKET_ROWS))


def _month(c: str) -> Column:
    return F.coalesce(F.year(c) * 100 + F.month(c), F.lit(0))


def _keyed(rows: DataFrame, keys: DataFrame, on: str, own_id: str) -> DataFrame:
    """``rows`` with the stored keys of the row of ``keys`` that ``on`` names, or with a key of their own."""
    lost = -F.abs(F.xxhash64(own_id) % (1 << 62)) - 1
    return (rows.join(keys, on, "left")
            .withColumns({"store_header": F.coalesce("store_header", lost), "approval_month": F.coalesce("approval_month", F.lit(0))}))


def _first_keys(rows: DataFrame, key: str) -> DataFrame:
    """One pair of stored keys per ``key``: with repeated ids the smallest, so that no row is doubled."""
    pair = F.min(F.struct(*KEYS)).alias("k")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(pair).select(key, "k.*")


def store_orders(t: Mapping[str, DataFrame], path: str, prefix: str, buckets: int) -> None:
    """Write the four tables below ``path`` and register them as ``{prefix}{table}``, replacing earlier ones.

    ``buckets``: so many that one bucket of one month of distributions fits a task.  The keys travel down the chain: lines
    take them from headers, shipments from lines, distributions from shipments; an id that repeats gives its smallest
    keys, so the tables hold exactly the rows of ``t`` (a chain over repeated header ids with several months is not
    supported).  ``{prefix}bucket_sizes`` holds the rows of each bucket."""
    headers = t["po_headers_all"]
    headers = headers.withColumns({"store_header": F.coalesce("po_header_id", F.lit(-1)).cast("long"), "approval_month": _month("approved_date")})
    spark = headers.sparkSession
    _write(headers, path, prefix, "po_headers_all", buckets)
    parent, key = spark.table(f"{prefix}po_headers_all"), "po_header_id"
    for name, own_id in (("po_lines_all", "po_line_id"), ("po_line_locations_all", "line_location_id"), ("po_distributions_all", "line_location_id")):
        _write(_keyed(t[name], _first_keys(parent, key), key, own_id), path, prefix, name, buckets)
        parent, key = spark.table(f"{prefix}{name}"), own_id
    sizes = None
    for name in TABLES:
        one = spark.table(f"{prefix}{name}").groupBy(F.pmod(F.hash("store_header"), F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"))
        one = one.select(F.lit(name).alias("table_name"), "bucket", "n_rows")
        sizes = one if sizes is None else sizes.unionByName(one)
    sizes.write.mode("overwrite").option("path", f"{path}/bucket_sizes").saveAsTable(f"{prefix}bucket_sizes")


def _write(df: DataFrame, path: str, prefix: str, name: str, buckets: int) -> None:
    (df.repartition(buckets, "store_header").write.mode("overwrite").format("parquet").option("path", f"{path}/{name}")
     .partitionBy("approval_month").bucketBy(buckets, "store_header").sortBy("store_header").saveAsTable(f"{prefix}{name}"))


def largest_bucket(spark: SparkSession, prefix: str) -> float:
    """The largest bucket over the mean, the worst of the four tables (one row comes to the driver); 0 for empty tables."""
    by_table = spark.table(f"{prefix}bucket_sizes").groupBy("table_name").agg((F.max("n_rows") / F.avg("n_rows")).alias("skew"))
    return by_table.agg(F.coalesce(F.max("skew"), F.lit(0.0)).alias("skew")).first().skew


def stored_orders(spark: SparkSession, path: str, prefix: str) -> LazyTables:
    """The tables of ``store_orders`` with their stored keys.

    Bucketed scans, one task a bucket, unless one bucket is too large (``MOST_SKEW``, measured when stored): then plain scans of the
    same files, pruned by month alike, whose joins shuffle and whose hot keys adaptive execution splits."""
    if largest_bucket(spark, prefix) > MOST_SKEW:
        return LazyTables({n: (lambda n=n: spark.read.schema(spark.table(f"{prefix}{n}").schema).parquet(f"{path}/{n}")) for n in TABLES})
    return LazyTables({n: (lambda n=n: spark.table(f"{prefix}{n}")) for n in TABLES})


def month_range(start, end) -> Column:
    """``approval_month`` within the months of a ``day_range``, as constants that prune partitions."""
    lo, hi = parse_report_date(start), parse_report_date(end)
    return F.col("approval_month").between(lo.year * 100 + lo.month, hi.year * 100 + hi.month)


def approved_chain(s: Mapping[str, DataFrame], start, end) -> DataFrame:
    """Distributions of the shipments of approved STANDARD orders whose approval is in the range (inclusive days), over a stored layout.

    The joins hold the stored keys besides the id, so equal buckets meet in one task and no row moves."""
    c = F.col
    headers = s["po_headers_all"].where(month_range(start, end) & day_range("approved_date", start, end)
                                        & (c("authorization_status") == "APPROVED") & (c("type_lookup_code") == "STANDARD"))
    headers = headers.select(*KEYS, "po_header_id", c("segment1").alias("nr_doc_compra"), "approved_date")
    lines = s["po_lines_all"].select(*KEYS, "po_header_id", "po_line_id", "line_num")
    shipments = s["po_line_locations_all"].select(*KEYS, "po_line_id", "line_location_id", "shipment_num")
    dists = s["po_distributions_all"].select(*KEYS, "line_location_id", "code_combination_id", "project_id")
    return (headers.join(lines, [*KEYS, "po_header_id"]).join(shipments, [*KEYS, "po_line_id"])
            .join(dists, [*KEYS, "line_location_id"]).drop(*KEYS))
