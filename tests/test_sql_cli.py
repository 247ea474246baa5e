"""SQL views with named parameters, and the command line runner."""

import datetime as dt
import tempfile

from supplyscope.plans.receiving import receiving_diagnosis
from supplyscope.plans.sql import register_report_views
from supplyscope.sources.roles import ALIASES, materialize_roles
from tests.conftest import SF0001
from tests.test_reports import AS_OF, po_tables


def test_views_with_named_parameters(spark, ebs):
    t = po_tables(ebs)
    names = register_report_views(spark, t, "01/01/1997", "31/12/1997", AS_OF, prefix="t_")
    assert names == ["t_po_without_requisition", "t_receiving_diagnosis"]
    got = spark.sql("SELECT nr_doc_compra, tipo_documento FROM t_po_without_requisition WHERE nr_doc_compra = :doc",
                    args={"doc": "PO2"}).collect()
    assert [tuple(r) for r in got] == [("PO2", "BLANKET")]


def test_cli_writes_reports(spark):
    out = tempfile.mkdtemp(prefix="cli-")
    roles = materialize_roles(spark, SF0001, out + "/tables")
    # a deployment stores every source table; the role copy shares two of them
    for alias in ALIASES:
        roles[alias].write.parquet(f"{out}/tables/{alias}")
    from supplyscope import cli
    cli.main(["ri", "--tables", out + "/tables", "--ri", "1", "2", "--out", out + "/ri"])
    want = receiving_diagnosis(roles, ri=[1, 2]).count()
    assert spark.read.parquet(out + "/ri").count() == want > 0
    cli.main(["po", "--tables", out + "/tables", "--start", "01/01/1995", "--end", "31/12/2001",
              "--as-of", dt.date(1996, 6, 1).isoformat(), "--labels", "--strict", "--out", out + "/po"])
    assert "PRAZO DE ENTREGA" in spark.read.parquet(out + "/po").columns
