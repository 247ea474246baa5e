"""Benchmark the headline queries and print ONE JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
    BENCH_RUNS (default 3, median reported; one warm-up run first).

The role tables (the reports' source tables, derived from the test tables) are
first written once as parquet into the session's checkpoint folder — the shape a
deployment has, where those tables are stored — and that one-off cost is
reported as ``roles_materialize_sec``.  Each query is then executed end to end
with the ``noop`` sink (every row is produced, nothing is collected to the
driver).  ``value`` is the sum of the medians of the headline queries;
``receipt_milestones_separate`` (the source's literal three aggregates), a
one-month PO report and a five-operation receiving report are reported for
comparison only.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from supplyscope.functions.oracle import to_char  # noqa: E402
from supplyscope.operators.rules import document_type  # noqa: E402
from supplyscope.operators.milestones import receipt_milestones, receipt_milestones_separate  # noqa: E402
from supplyscope.plans.orders import approved_shipments, po_without_requisition_report  # noqa: E402
from supplyscope.plans.receiving import receiving_diagnosis  # noqa: E402
from supplyscope.plans.registry import AS_OF, END, START  # noqa: E402
from supplyscope.session import ensure_checkpoint_dir, local_session  # noqa: E402
from supplyscope.sources.roles import materialize_roles, stored_roles  # noqa: E402


def _slice(t):
    from pyspark.sql import functions as F
    x = approved_shipments(t, START, END, "STANDARD")
    pv = t["po_vendors"].select("vendor_id", F.col("vendor_name").alias("razao_social_fornecedor"))
    return x.join(pv, "vendor_id", "left").select(
        "po_header_id", "nr_doc_compra", "line_location_id", "line_num",
        document_type(F.col("type_lookup_code"), F.col("contract_num")).alias("tipo_documento"),
        "razao_social_fornecedor", to_char("approved_date").alias("dt_aprovacao_oc_header"))


HEADLINE = {
    "po_without_requisition": _slice,
    "po_report_union": lambda t: po_without_requisition_report(t, START, END, AS_OF),
    "receiving_report": lambda t: receiving_diagnosis(t),
    "receipt_milestones": lambda t: receipt_milestones(t["rcv_transactions"], t["rcv_shipment_headers"]),
}
# reported for comparison, not part of ``value``: the source's literal three-pass
# milestones, and the reports' typical use (one month; a handful of operations)
COMPARE = {
    "receipt_milestones_separate": lambda t: receipt_milestones_separate(t["rcv_transactions"],
                                                                         t["rcv_shipment_headers"]),
    "po_report_one_month": lambda t: po_without_requisition_report(t, "01/03/1997", "31/03/1997", AS_OF),
    "receiving_five_operations": lambda t: receiving_diagnosis(t, ri=[1, 2, 3, 4, 5]),
}


def run_once(build, tables) -> float:
    t0 = time.perf_counter()
    build(tables).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, shuffle_partitions=max(8, cpus * 2), app="supplyscope-bench")
    scratch = ensure_checkpoint_dir(spark).rstrip("/") + f"/bench-roles-{os.getpid()}"
    t0 = time.perf_counter()
    materialize_roles(spark, sf_dir, scratch)
    materialize = round(time.perf_counter() - t0, 3)
    # time the reports in a fresh session, as a job reading stored tables would run
    spark.stop()
    spark = local_session(cpus, shuffle_partitions=max(8, cpus * 2), app="supplyscope-bench")
    tables = stored_roles(spark, scratch)
    times: dict[str, float] = {}
    for name, build in {**HEADLINE, **COMPARE}.items():
        run_once(build, tables)  # warm-up: JIT, file listing, metadata
        times[name] = round(statistics.median(run_once(build, tables) for _ in range(runs)), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "sum of median wall time of headline queries (warm)",
        "value": round(sum(times[n] for n in HEADLINE), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "runs": runs,
        "roles_materialize_sec": materialize,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
