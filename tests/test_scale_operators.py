"""Operators whose point is what they do not do: pair hot keys, gather NULL keys, append on a rerun, read twice."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from supplyscope.functions.oracle import digits_to_number, safe_number
from supplyscope.operators.contracts import CATALOG_KEYS, contract_parts, max_contract_lead_time
from supplyscope.operators.lookups import left_join_split, spread_nulls
from supplyscope.operators.milestones import approval_conflicts
from supplyscope.operators.rejects import number_rejects, observe_rejects
from supplyscope.plans.receiving import receiving_diagnosis
from supplyscope.sources.roles import role_tables
from supplyscope.sources.sink import damaged_partitions, partition_marks, read_report, write_report
from tests.conftest import SF0001


# ---- maximum contract lead time ----------------------------------------------------------------------------------

LINES = "po_header_id long, vendor_product_num string, cancel_flag string"
CATALOG = "supplier_part_auxid string, supplier string, supplier_part_num string, min_lead_time double, max_lead_time double"
NEEDED = "po_header_id long, supplier_part_auxid string, supplier string"


def plain_maximum(needed, lines, catalog):
    parts = {}
    for h, p, cancelled in lines:
        if p is not None and (cancelled or "N") == "N":
            parts.setdefault(h, set()).add(p)
    out = {}
    for h, a, s in needed:
        leads = [m for ca, cs, p, _, m in catalog if a is not None and s is not None and (ca, cs) == (a, s) and p in parts.get(h, ())]
        if leads:
            out[h, a] = max([*([out[h, a]] if (h, a) in out else []), *leads])
    return out


def maximum(spark, needed, lines, catalog):
    frames = spark.createDataFrame(needed, NEEDED), spark.createDataFrame(lines, LINES), spark.createDataFrame(catalog, CATALOG)
    return {(r.po_header_id, r.supplier_part_auxid): r.max_contract_lead_time for r in max_contract_lead_time(*frames).collect()}, frames


def test_maximum_lead_time_from_either_side(spark):
    catalog = [("A", "v", f"p{i}", 1.0, float(i)) for i in range(9)] + [("B", "v", "p3", 1.0, 50.0), ("B", "w", "p3", 1.0, 99.0), ("C", "v", None, 1.0, 5.0), (None, "v", "p1", 1.0, 7.0)]
    lines = [(1, "p2", None), (1, "p2", "N"), (1, "p8", "Y"), (2, "p3", None), *[(3, f"p{i}", None) for i in range(5)], (4, None, None), (5, "p1", None), (6, "zz", None)]
    needed = [(1, "A", "v"), (2, "A", "v"), (2, "B", "v"), (3, "B", "v"), (3, "A", "v"), (4, "A", "v"), (5, "C", "v"), (5, None, "v"), (6, "A", "v"), (7, "A", "v"), (1, "B", None)]
    got, _ = maximum(spark, needed, lines, catalog)
    assert got == plain_maximum(needed, lines, catalog)
    assert got[3, "B"] == 50.0 and got[1, "A"] == 2.0 and (6, "A") not in got


def test_one_contract_of_many_headers_and_catalogue_rows_stays_linear(spark):
    """2,000 headers of two parts and 2,000 catalogue rows: 4,000 rows between the joins, not 4,000,000; likewise from the other side."""
    catalog = [("A", "v", f"p{i}", 1.0, float(i)) for i in range(2000)] + [("B", "v", "p5", 1.0, 5.0)]
    lines = [(h, f"p{(h * 7 + k) % 2000}", None) for h in range(2000) for k in range(2)] + [(9000, f"p{i}", None) for i in range(2000)]
    needed = [(h, "A", "v") for h in range(2000)] + [(9000, "B", "v")]
    got, frames = maximum(spark, needed, lines, catalog)
    by_part, by_contract = contract_parts(*frames)
    assert by_part.count() == 4000 and by_contract.count() == 1
    assert got[9000, "B"] == 5.0 and len(got) == 2001
    assert all(got[h, "A"] == max(float((h * 7 + k) % 2000) for k in range(2)) for h in range(2000))


def test_empty_catalogue(spark):
    assert maximum(spark, [(1, "A", "v")], [(1, "p", None)], [])[0] == {}
    assert set(CATALOG_KEYS) <= {c.split()[0] for c in CATALOG.split(", ")}


# ---- joins on keys that are often NULL ---------------------------------------------------------------------------

@pytest.mark.parametrize("how", ["left", "left_anti"])
def test_spread_nulls_equals_the_plain_join(spark, how):
    left = spark.createDataFrame([(i, None if i % 3 == 0 else i % 7, None if i % 5 == 0 else "x") for i in range(200)] + [(5, 5, "x"), (5, 5, "x")], "id long, k long, m string")
    right = spark.createDataFrame([(i, "x" if i != 4 else None, f"r{i}") for i in (1, 2, 2, 4, 9)] + [(None, "x", "never"), (None, None, "never")], "k long, m string, v string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    got = spread_nulls(left, right, ["k", "m"], how)
    want = left.join(right, ["k", "m"], how)
    assert got.columns == want.columns and rows(got) == rows(want)


def test_rows_without_a_key_are_dealt_to_all_tasks(spark):
    """A third of the rows have no key: no task of the join reads more than twice the median."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false"), ("spark.sql.shuffle.partitions", "8")):
            spark.conf.set(k, v)
        left = spark.range(12000).select("id", F.when(F.col("id") % 3 != 0, F.col("id")).alias("k"))
        right = spark.range(0, 12000, 2).select(F.col("id").alias("k"), F.lit("v").alias("v"))
        sizes = lambda df: sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
        plain, spread = sizes(left.join(right, ["k"], "left")), sizes(spread_nulls(left, right, ["k"]))
        assert plain[-1] > 3 * plain[len(plain) // 2]
        assert len(spread) == 8 and spread[-1] <= 2 * spread[4]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_split_join_keeps_rows_without_a_key(spark):
    left = spark.createDataFrame([(1, 1), (2, None), (3, None), (4, 9)], "id long, k long")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k long, v string")
    got = sorted(((r.id, r.v) for r in left_join_split(left, right, ["k"]).collect()), key=str)
    assert got == [(1, "a"), (1, "b"), (2, None), (3, None), (4, None)]


def test_split_join_moves_keys_alone_a_second_time(spark, tmp_path):
    """The anti join that finds unmatched keys reads no other column of the left side."""
    spark.range(100).select("id", (F.col("id") % 9).alias("k"), F.lit("w").alias("wide")).write.parquet(str(tmp_path / "l"))
    left = spark.read.parquet(str(tmp_path / "l"))
    right = spark.range(50).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    got = left_join_split(left, right, ["k"], left_keys=left)
    want = left.join(right, ["k"], "left")
    assert sorted(map(tuple, got.select("id", "k", "wide", "v").collect()), key=str) == sorted(map(tuple, want.select("id", "k", "wide", "v").collect()), key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan parquet" in x and "wide" in x for x in plan.split("Initial Plan")[0].splitlines()) <= 2  # matched rows, rows without a key


def test_receiving_report_moves_lines_narrow(spark):
    """Items and shipments are joined before the invoice's columns, and the derived texts are worked out behind the sort."""
    t = role_tables(spark, SF0001)
    old = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "500")
    try:
        plan = receiving_diagnosis(t)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", old)
    sort = next(i for i, x in enumerate(plan) if "Sort [" in x)
    assert any("sugestao_acao" in x for x in plan[:sort]) and not any("sugestao_acao" in x for x in plan[sort:])
    assert not any("p_partkey" in x and "Join" in x for x in plan)  # no join with a table whose columns are not read


# ---- rejects and conflicts ---------------------------------------------------------------------------------------

def test_number_rejects(spark):
    lines = spark.createDataFrame([(1, "30"), (2, "30d"), (3, None), (4, " "), (5, "1.234,5"), (6, "-2e1"), (7, "NaN")], "po_line_id long, attribute3 string")
    heads = spark.createDataFrame([(1, "0012"), (2, "A12"), (3, None), (4, "-5"), (5, "9" * 30)], "shipment_header_id long, receipt_num string")
    rows = lambda df: sorted((r.column_name, r.row_id, r.raw_text) for r in df.collect())
    assert rows(number_rejects(lines, heads)) == [("attribute3", 2, "30d"), ("attribute3", 5, "1.234,5"), ("attribute3", 7, "NaN"), ("receipt_num", 2, "A12"), ("receipt_num", 4, "-5")]
    assert ("attribute3", 5, "1.234,5") not in rows(number_rejects(lines, heads, decimal_comma=True))


def test_rejects_are_counted_in_the_pass_that_writes(spark, tmp_path):
    lines = spark.createDataFrame([(1, "30"), (2, "30d"), (3, None)], "po_line_id long, attribute3 string")
    df, seen = observe_rejects(lines, "attribute3", safe_number("attribute3", "decimal(18,4)"))
    df.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"n_rows": 3, "n_texts": 2, "n_rejects": 1}
    none, seen = observe_rejects(lines.where("po_line_id > 9"), "attribute3", digits_to_number("attribute3"))
    none.collect()
    assert seen.get == {"n_rows": 0, "n_texts": 0, "n_rejects": 0}


def test_conflicts_of_the_last_approval(spark):
    history = spark.createDataFrame([
        (1, "PO", "APPROVE", 5, 10), (1, "PO", "APPROVE", 5, 11), (2, "PO", "APPROVE", 5, 10), (2, "PA", "APPROVE", 2, 12), (3, "PO", "APPROVE", 1, 10), (3, "PO", "APPROVE", 2, 11),
        (4, "PO", "APPROVE", 2, 10), (4, "PO", "APPROVE", 2, 10), (5, "PO", "SUBMIT", 2, 10), (5, "PO", "SUBMIT", 2, 11)],
        "object_id long, object_type_code string, action_code string, sequence_num long, employee_id long")
    assert {(r.object_id, r.n_employees) for r in approval_conflicts(history).collect()} == {(1, 2), (2, 2)}


# ---- sink --------------------------------------------------------------------------------------------------------

REPORT = "kind string, id long, day date"


def test_a_rerun_leaves_the_same_content(spark, tmp_path):
    rows = [("a", i, dt.date(2025, 1, i % 28 + 1)) for i in range(50)] + [("b", 7, None), ("b", 7, None), (None, 1, None)]
    df, path = spark.createDataFrame(rows, REPORT), str(tmp_path / "report")
    first = sorted(map(tuple, write_report(df, path, ["kind"]).collect()), key=str)
    again = sorted(map(tuple, write_report(df.repartition(3), path, ["kind"]).collect()), key=str)
    assert first == again and {r[0]: r[1] for r in first} == {"a": 50, "b": 2, None: 1}
    back = read_report(spark, path, df.schema).select("kind", "id", "day")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert damaged_partitions(spark, path, df.schema, ["kind"]).collect() == []


def test_only_the_partitions_of_a_run_are_replaced(spark, tmp_path):
    path = str(tmp_path / "report")
    write_report(spark.createDataFrame([("a", 1, None), ("b", 2, None)], REPORT), path, ["kind"])
    df = spark.createDataFrame([("b", 3, None), ("b", 4, None)], REPORT)
    write_report(df, path, ["kind"])
    assert sorted((r.kind, r.id) for r in read_report(spark, path, df.schema).collect()) == [("a", 1), ("b", 3), ("b", 4)]
    # rows that come into a partition behind the manifest's back are found
    spark.createDataFrame([(9, None)], "id long, day date").write.mode("append").parquet(f"{path}/data/kind=a")
    bad = damaged_partitions(spark, path, df.schema, ["kind"]).collect()
    assert [(r.kind, r.rows_found, r.rows_expected) for r in bad] == [("a", 2, 1)]


def test_checksum_ignores_order_and_counts_repeats(spark):
    one = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("a", 2, None)], REPORT)
    two = spark.createDataFrame([("a", 2, None), ("a", 1, None), ("a", 1, None)], REPORT)
    mark = lambda df: df.transform(partition_marks, ["kind"]).first()["checksum"]
    assert mark(one) == mark(one.orderBy(F.desc("id"))) != mark(two)


# ---- receiving report of a table of operations -------------------------------------------------------------------

def test_operations_as_a_table_equal_a_list(spark):
    t = role_tables(spark, SF0001)
    ids = [1, 2, 3, 5, 32, 33]
    frame = spark.createDataFrame([(i,) for i in [*ids, 5, None]], "operation long")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    for org in (None, "ORG7"):
        assert rows(receiving_diagnosis(t, ri=frame, org=org)) == rows(receiving_diagnosis(t, ri=ids, org=org))
