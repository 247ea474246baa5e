"""The sorted receiving report deals its sides to ranges of operations: same rows, same order, wide rows not moved by a sort."""

import datetime as dt
import glob
import os

import pytest

from supplyscope.operators import lookups
from supplyscope.operators.lookups import hot_keys, left_join_hot
from supplyscope.plans import receiving
from supplyscope.plans.receiving import receiving_diagnosis
from supplyscope.session import CLEANED, stored
from supplyscope.sources.roles import role_tables
from tests.conftest import SF0001

T0 = dt.datetime(2025, 1, 2)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def in_order(df) -> bool:
    keys = [(r.ri is None, r.ri or 0, r.invoice_line_id is None, r.invoice_line_id or 0) for r in df.collect()]
    return keys == sorted(keys)


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_the_report_in_ranges_equals_the_sorted_join(spark, monkeypatch, broadcast):
    t = role_tables(spark, SF0001)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        want = receiving_diagnosis(t, skew_safe=False)
        monkeypatch.setattr(receiving, "RANGE_ROWS", 300)
        got = receiving_diagnosis(t)
        assert rows(got) == rows(want) and in_order(got) and in_order(want)
        plan = plan_of(got)
        # each side is dealt once, by its range; behind that nothing is moved, and no range sort moves the joined rows
        assert plan.count("Exchange shufflepartitionidpassthrough") == 6 and "rangepartitioning" not in plan
        assert got.rdd.getNumPartitions() > 10
        org = t["mtl_parameters"].first()["organization_code"]
        one = receiving_diagnosis(t, org=org)
        assert rows(one) == rows(want.where(want.org == org)) and in_order(one)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_large_operation_is_left_to_the_range_sort(spark, monkeypatch):
    t = role_tables(spark, SF0001)
    monkeypatch.setattr(receiving, "RANGE_ROWS", 300)
    monkeypatch.setattr(receiving, "HOT_RANGES", 0.01)
    df = receiving_diagnosis(t)
    assert "rangepartitioning" in df._jdf.queryExecution().executedPlan().toString() and in_order(df)


def test_missing_links_repeated_keys_and_null_ids(ebs, monkeypatch):
    """Operations without an id, invoice or line, an invoice id of two operations, repeated e-invoices, two deliveries."""
    ops = [{"operation_id": i, "organization_id": (i or 0) % 2, "status": "APPROVED", "receive_date": T0} for i in [None, *range(1, 200)]]
    inv = [{"invoice_id": i, "operation_id": i, "organization_id": i % 2, "invoice_type_id": 1, "eletronic_invoice_key": f"K{i % 50}"} for i in range(1, 150)]
    inv += [{"invoice_id": 5, "operation_id": 7, "organization_id": 1}, {"invoice_id": None, "operation_id": 8, "organization_id": 0}, {"invoice_id": 9, "operation_id": None, "organization_id": 1},
            {"invoice_id": 11, "operation_id": 11, "organization_id": 1, "eletronic_invoice_key": "K11"}]
    t = ebs(cll_f189_entry_operations=ops, cll_f189_invoices=inv,
            cll_f189_invoice_lines=[{"invoice_line_id": None if i % 41 == 0 else i, "invoice_id": i % 160, "item_id": i % 9, "line_location_id": None if i % 6 == 0 else i % 70} for i in range(500)],
            po_line_locations_all=[{"line_location_id": i, "po_header_id": i % 3 or None} for i in range(60)],
            po_headers_all=[{"po_header_id": 1, "segment1": "PO1"}],
            rcv_transactions=[{"transaction_id": i, "po_line_location_id": i % 30, "transaction_type": "DELIVER" if i % 3 else "RECEIVE"} for i in range(90)],
            nfee_header_xml=[{"chave": f"K{i}", "status": s} for i in range(0, 40, 2) for s in "ab"], cll_f189_holds=[{"invoice_id": i % 20} for i in range(30)],
            mtl_system_items=[{"inventory_item_id": i, "organization_id": 1, "receiving_routing_id": 1} for i in range(5)])
    want = receiving_diagnosis(t, skew_safe=False)
    monkeypatch.setattr(receiving, "RANGE_ROWS", 40)
    got = receiving_diagnosis(t)
    assert "shufflepartitionidpassthrough" in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == rows(want) and in_order(got)


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(lookups, "HOT_ROWS", 20)
    left = spark.createDataFrame([(i, None if i % 4 == 0 else i % 6) for i in range(60)], "id long, k long")
    right = spark.createDataFrame([(1 if i % 2 else i % 40, i) for i in range(80)] + [(None, -1)], "k long, v long")
    hot = hot_keys(right, "k")
    assert hot == [1] and hot_keys(right.where("k <> 1"), "k") == []
    for keys in (hot, []):
        got = left_join_hot(left, right, "k", keys)
        assert rows(got.select("id", "k", "v")) == rows(left.join(right, "k", "left").select("id", "k", "v"))
    assert plan_of(left_join_hot(left, right, "k", hot)).count("Inner") == 1


def test_shuffle_files_of_a_stored_table_are_removed(spark):
    def files():
        local = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
        return {f for d in local for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True) if os.path.isfile(f)}

    before, setting = files(), spark.conf.get(CLEANED)
    df = stored(spark.range(5000).repartition(3, "id"), "numbers")
    assert df.count() == 5000 and not {f for f in files() - before if os.path.getsize(f) > 5000} and spark.conf.get(CLEANED) == setting
