"""Helpers shared by the training-data operators: tables, the shared folder, Arrow map, crc32."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def for_workers(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query whose Python workers also search this checkout for modules (on a cluster: --py-files or an installed package)."""

    @wraps(query)
    def run(spark: SparkSession, *args, **options) -> DataFrame:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        paths = spark.sparkContext.environment.get("PYTHONPATH", "")
        if root not in paths.split(":"):
            spark.sparkContext.environment["PYTHONPATH"] = f"{paths}:{root}" if paths else root
        return query(spark, *args, **options)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a session in local mode may lack the setting (tests); it then gets a scratch folder.
    On a cluster an unset folder is an error, since a machine-local one would not be shared.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not (sc.master or "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="llm-shared-")
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir().rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark)}/llm-{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    ``narrow`` is for tables much smaller than what they are computed from: their rows are dealt anew to a sixteenth of the shuffle partitions.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, what)
    if narrow:
        df = df.repartition(max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote, once a newer one replaces it."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/llm-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def map_arrow(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch | pa.Table]]) -> DataFrame:
    """``mapInArrow`` of a function from one batch to batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for out in fn(batch):
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def text_of(col: str = "text") -> Column:
    """The whole text, null read as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def unsigned_hex(col: Column) -> Column:
    """16 lowercase hex digits of a long taken as unsigned."""
    return F.lpad(F.lower(F.hex(col)), 16, "0")
