"""Plan shape of both reports over parquet-backed tables (sf0.001 role views):
no cartesian / nested-loop joins, no Python evaluation, no window operator (a
hot key must never be gathered into one task), predicates pushed to the scans."""

import datetime as dt

import pytest

from supplyscope.plans.orders import po_without_requisition_report
from supplyscope.plans.receiving import receiving_diagnosis
from supplyscope.sources.roles import role_tables
from tests.conftest import SF0001

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "Window ", "WindowGroupLimit", "CollectLimit"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return role_tables(spark, SF0001)


@pytest.mark.parametrize("report", ["po", "ri"])
def test_no_forbidden_operators(tables, report):
    df = (po_without_requisition_report(tables, "01/01/1996", "31/12/1996", dt.date(1996, 6, 1)) if report == "po"
          else receiving_diagnosis(tables))
    plan = plan_of(df)
    for op in FORBIDDEN:
        assert op not in plan, f"{op} in {report} plan"


def test_header_filters_reach_the_scan(spark, tables):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = po_without_requisition_report(tables, "01/01/1996", "31/12/1996", dt.date(1996, 6, 1))
    scans = [line for line in plan_of(df).splitlines() if "FileScan parquet" in line and "o_orderpriority" in line]
    assert scans, "orders scan missing"
    assert any("PushedFilters: [" in s and "o_orderstatus" in s and "o_orderdate" in s for s in scans)


def test_receiving_filters_reach_the_operation_scan(spark, tables):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = receiving_diagnosis(tables, ri=[5, 6], sort=False)
    scans = [line for line in plan_of(df).splitlines() if "FileScan parquet" in line and "o_orderkey" in line]
    assert any("In(o_orderkey" in s or "o_orderkey,5" in s or "EqualTo(o_orderkey" in s for s in scans), scans


def test_order_report_derives_its_shipments_once(spark, tables):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = po_without_requisition_report(tables, "01/01/1996", "31/12/1996", dt.date(1996, 6, 1))
    requisitions = [line for line in plan_of(df).splitlines() if "FileScan parquet" in line and "l_discount" in line]
    assert not requisitions, "the anti join runs again for each relation scoped to the shipments"


@pytest.mark.parametrize("table", ["po_lines_all", "po_line_locations_all"])
def test_shipment_tasks_follow_the_rows(spark, monkeypatch, table):
    monkeypatch.setattr("supplyscope.sources.roles.LINES_A_TASK", 100, raising=False)
    t = role_tables(spark, SF0001)
    parts = -(-t["lineitem"].count() // 100)
    plan = plan_of(t[table].select("po_line_id"))
    assert f", {parts}), REPARTITION_BY_NUM" in plan and plan.count("Exchange") == 1
