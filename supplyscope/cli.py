"""Run a report over stored source tables and write it as parquet.

    python -m supplyscope.cli po --tables /data/erp --start 01/04/2025 --end 30/04/2025 \\
        --as-of 2025-05-01 --out /data/reports/po_2025_04
    python -m supplyscope.cli ri --tables /data/erp --ri 12345 --org ORG1 --out /data/reports/ri_12345

``--tables`` is a folder with one parquet folder per source table (or use
``--database`` for catalog tables).  Output is written with ``overwrite``, so a
re-run after a failure replaces it.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession

from supplyscope.plans.orders import po_without_requisition_report, with_display_labels
from supplyscope.plans.receiving import receiving_diagnosis
from supplyscope.sources.schemas import SPECS
from supplyscope.sources.tables import catalog_tables, parquet_tables


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="supplyscope")
    p.add_argument("report", choices=["po", "ri"])
    src = p.add_mutually_exclusive_group(required=True)
    src.add_argument("--tables", help="folder with one parquet folder per source table")
    src.add_argument("--database", help="catalog database holding the source tables")
    p.add_argument("--out", required=True)
    p.add_argument("--start", help="DD/MM/YYYY (po)")
    p.add_argument("--end", help="DD/MM/YYYY (po)")
    p.add_argument("--as-of", help="YYYY-MM-DD, default today (po)")
    p.add_argument("--ri", type=int, nargs="*", help="operation ids (ri)")
    p.add_argument("--org", help="organisation code (ri)")
    p.add_argument("--language", default="PTB")
    p.add_argument("--labels", action="store_true", help="display labels instead of column names (po)")
    p.add_argument("--strict", action="store_true", help="fail if a scalar lookup key repeats (po)")
    p.add_argument("--decimal-comma", action="store_true", help="read text lead times as pt-BR numbers (po)")
    a = p.parse_args(argv)

    spark = SparkSession.builder.appName(f"supplyscope-{a.report}").getOrCreate()
    names = sorted(SPECS)
    t = parquet_tables(spark, a.tables, names) if a.tables else catalog_tables(spark, a.database, names)
    if a.report == "po":
        if not (a.start and a.end):
            p.error("po needs --start and --end")
        as_of = dt.date.fromisoformat(a.as_of) if a.as_of else dt.date.today()
        df = po_without_requisition_report(t, a.start, a.end, as_of, a.language, strict=a.strict,
                                           decimal_comma=a.decimal_comma)
        if a.labels:
            df = with_display_labels(df)
    else:
        df = receiving_diagnosis(t, ri=a.ri or None, org=a.org, language=a.language)
    df.write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
