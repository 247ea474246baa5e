"""Where the report inputs come from.

The reports take a ``Mapping[str, DataFrame]`` keyed by source table name
(``po_headers_all``, ``rcv_transactions`` …).  These mappings build each
DataFrame lazily on first access; reading a table only declares a scan, and
Catalyst prunes it to the columns and rows a report actually uses.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession


class LazyTables(Mapping):
    """A read-only name → DataFrame mapping whose values are built on demand."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders = dict(builders)
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            try:
                builder = self._builders[name]
            except KeyError:
                raise KeyError(f"no source table {name!r}; known: {sorted(self._builders)}") from None
            self._built[name] = builder()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def parquet_tables(spark: SparkSession, root: str, names: list[str] | None = None) -> LazyTables:
    """Tables stored as ``{root}/{name}`` or ``{root}/{name}.parquet`` (file or directory)."""

    def path_of(name: str) -> str:
        for candidate in (os.path.join(root, name), os.path.join(root, name + ".parquet")):
            if os.path.exists(candidate) or "://" in root:
                return candidate
        return os.path.join(root, name)

    if names is None:
        names = sorted({e.removesuffix(".parquet") for e in os.listdir(root)}) if "://" not in root else []
    return LazyTables({n: (lambda n=n: spark.read.parquet(path_of(n))) for n in names})


def catalog_tables(spark: SparkSession, database: str, names: list[str]) -> LazyTables:
    """Tables registered in the session catalog (Hive / Unity / Glue …) under ``database``."""
    return LazyTables({n: (lambda n=n: spark.table(f"{database}.{n}")) for n in names})
