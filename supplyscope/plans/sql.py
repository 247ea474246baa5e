"""SQL access to the reports: temp views over the report DataFrames, so the
reports can be queried with ``spark.sql`` and named parameters, the way the
source reports take bind variables.

    register_report_views(spark, tables, "01/04/2025", "30/04/2025", as_of=dt.date(2025, 5, 1))
    spark.sql("SELECT * FROM receiving_diagnosis WHERE ri = :ri", args={"ri": 12345})

A filter on ``ri`` / ``org`` in SQL is pushed by Catalyst to the operation and
invoice scans; for a report on a few operations the function form
``receiving_diagnosis(tables, ri=...)`` additionally scopes the line, shipment and
delivery tables before any join.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from supplyscope.plans.orders import po_without_requisition_report
from supplyscope.plans.receiving import receiving_diagnosis


def register_report_views(spark: SparkSession, tables: Mapping[str, DataFrame], start, end, as_of,
                          language: str = "PTB", prefix: str = "") -> list[str]:
    """Create ``{prefix}po_without_requisition`` and ``{prefix}receiving_diagnosis``
    temp views; returns their names."""
    views = {
        f"{prefix}po_without_requisition": po_without_requisition_report(tables, start, end, as_of, language),
        f"{prefix}receiving_diagnosis": receiving_diagnosis(tables, language=language, sort=False),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
