"""Order tables stored by approval month and bucketed by header: rows, plan without exchanges, pruning, hot keys."""

import datetime as dt
import re
import uuid

import pytest
from pyspark.sql import functions as F

from supplyscope.sources import layout
from supplyscope.sources import layout
from supplyscope.sources.layout import CO_LOCATED, TABLES, approved_chain, largest_bucket, store_orders, stored_orders
from supplyscope.sources.roles import role_tables
from tests.conftest import SF0001

COLS = ["po_header_id", "nr_doc_compra", "approved_date", "po_line_id", "line_num", "line_location_id", "shipment_num", "code_combination_id",
        "project_id"]


def plain_chain(t, start, end):
    h = t["po_headers_all"].where(f"authorization_status = 'APPROVED' AND type_lookup_code = 'STANDARD' AND "
                                  f"date(approved_date) BETWEEN '{start}' AND '{end}'").selectExpr("po_header_id", "segment1 nr_doc_compra", "approved_date")
    li = t["po_lines_all"].select("po_header_id", "po_line_id", "line_num")
    sh = t["po_line_locations_all"].select("po_line_id", "line_location_id", "shipment_num")
    return h.join(li, "po_header_id").join(sh, "po_line_id").join(t["po_distributions_all"], "line_location_id").select(*COLS)


def rows(df):
    return sorted(map(tuple, df.select(*COLS).collect()), key=str)


def store(spark, t, tmp_path, buckets=2):
    prefix = f"layout_{uuid.uuid4().hex[:8]}_"
    store_orders(t, f"{tmp_path}/layout", prefix, buckets)
    return f"{tmp_path}/layout", prefix


@pytest.fixture
def shuffled(spark):
    """Joins as on large tables: none small enough to be broadcast."""
    settings = dict([("spark.sql.autoBroadcastJoinThreshold", "-1"), CO_LOCATED])
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_chain_without_exchange_and_one_month_read(shuffled, tmp_path):
    spark, t = shuffled, role_tables(shuffled, SF0001)
    path, prefix = store(spark, t, tmp_path)
    s = stored_orders(spark, path, prefix)
    for name in TABLES:
        assert s[name].count() == t[name].count()
    full = approved_chain(s, "01/01/1990", "31/12/2030")
    want = rows(plain_chain(t, "1990-01-01", "2030-12-31"))
    assert rows(full) == want and len(want) > 100
    assert "Exchange" not in full._jdf.queryExecution().executedPlan().toString()

    month = want[len(want) // 2][2]
    first = dt.date(month.year, month.month, 1)
    last = (first.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)
    one = approved_chain(s, first, last)
    assert rows(one) == rows(plain_chain(t, first, last)) != []
    opened = re.findall(r"InMemoryFileIndex\((\d+) paths", one._jdf.queryExecution().executedPlan().toString())
    assert len(opened) >= 4 and set(opened) == {"1"}, opened


def test_rows_without_parent_null_keys_and_empty_tables(shuffled, ebs, tmp_path):
    spark = shuffled
    day = dt.datetime(2024, 5, 31, 23, 59, 59)
    t = ebs(po_headers_all=[dict(po_header_id=1, segment1="1", type_lookup_code="STANDARD", authorization_status="APPROVED", approved_date=day),
                            dict(po_header_id=2, segment1="2", type_lookup_code="STANDARD", authorization_status="APPROVED", approved_date=None),
                            dict(po_header_id=None, segment1="3", type_lookup_code="STANDARD", authorization_status="APPROVED", approved_date=day)],
            po_lines_all=[dict(po_line_id=10, po_header_id=1, line_num=1), dict(po_line_id=20, po_header_id=2, line_num=1),
                          dict(po_line_id=30, po_header_id=None, line_num=1), dict(po_line_id=40, po_header_id=9, line_num=1)],
            po_line_locations_all=[dict(line_location_id=100, po_line_id=10, shipment_num=1), dict(line_location_id=200, po_line_id=None, shipment_num=1),
                                   dict(line_location_id=None, po_line_id=10, shipment_num=2)],
            po_distributions_all=[dict(line_location_id=100, code_combination_id=5, project_id=None)] * 2 + [dict(line_location_id=None, code_combination_id=6)])
    path, prefix = store(spark, t, tmp_path)
    s = stored_orders(spark, path, prefix)
    assert [s[n].count() for n in TABLES] == [3, 4, 3, 3]
    assert [r[5] for r in rows(approved_chain(s, "01/05/2024", "31/05/2024"))] == [100, 100]
    assert rows(approved_chain(s, "01/06/2024", "30/06/2024")) == []

    path, prefix = store(spark, ebs(), f"{tmp_path}/empty")
    assert largest_bucket(spark, prefix) == 0.0
    assert rows(approved_chain(stored_orders(spark, path, prefix), "01/05/2024", "31/05/2024")) == []


def test_a_hot_header_is_read_without_buckets(shuffled, tmp_path, monkeypatch):
    spark = shuffled
    monkeypatch.setattr(layout, "MOST_SKEW", 1.5)
    from pyspark.sql import functions as F

    t = dict(role_tables(spark, SF0001))
    # a third of all distributions belong to one shipment
    extra = spark.range(3000).select(F.lit(10).cast("long").alias("line_location_id"), F.lit(1).cast("long").alias("code_combination_id"), "id")
    d = t["po_distributions_all"]
    t["po_distributions_all"] = d.unionByName(extra.select("line_location_id", "code_combination_id", F.col("id").alias("project_id")))
    path, prefix = store(spark, t, tmp_path, buckets=4)
    assert largest_bucket(spark, prefix) > 1.5
    chain = approved_chain(stored_orders(spark, path, prefix), "01/01/1990", "31/12/2030")
    plan = chain._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not re.search(r"Bucketed: true", plan)
    assert rows(chain) == rows(plain_chain(t, "1990-01-01", "2030-12-31"))


def test_buckets_grow_with_the_rows(spark, monkeypatch):
    t = {"po_distributions_all": spark.range(1000)}
    assert layout.buckets_for(t) == 4
    monkeypatch.setattr(layout, "BUCKET_ROWS", 100)
    assert layout.buckets_for(t) == 10
