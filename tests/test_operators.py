"""Operators on small EBS-shaped fixtures (FIXTURES.md §C)."""

import datetime as dt
from decimal import Decimal as D

from supplyscope.operators.contracts import catalog_lead_times, contract_lead_time, max_contract_lead_time
from supplyscope.operators.links import valid_receipts, with_requisition, without_requisition
from supplyscope.operators.lookups import first_row, require_unique
from supplyscope.operators.milestones import (approver_columns, has_category_line, hold_counts, last_action,
                                              receipt_milestones, receipt_milestones_separate)
from supplyscope.sources.schemas import frame

AS_OF = dt.date(1996, 6, 1)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_valid_receipts_reversal_invoice_number_and_parent(spark):
    df = spark.createDataFrame([
        (1, None, None, None, None),     # no receipt: kept
        (2, 10, 5, None, None),          # valid invoice: kept
        (3, 11, 5, None, "Y"),           # reversed operation: row removed
        (4, 12, 0, None, None),          # invoice number 0: removed
        (5, 13, 7, "Y", None),           # parent invoice type: removed
        (6, 14, 7, "N", None),           # non-parent: kept
    ], "loc long, ri_invoice_id long, ri_invoice_num long, parent_flag string, reversion_flag string")
    assert rows(valid_receipts(df), "loc") == [(1,), (2,), (6,)]


def test_anti_and_semi_partition_the_input(spark):
    ship = spark.createDataFrame([(i,) for i in range(10)], "line_location_id long")
    req = spark.createDataFrame([(2,), (2,), (5,), (None,), (42,)], "line_location_id long")
    anti = rows(without_requisition(ship, req), "line_location_id")
    semi = rows(with_requisition(ship, req), "line_location_id")
    assert semi == [(2,), (5,)]
    assert sorted(anti + semi) == [(i,) for i in range(10)]


def test_hold_counts_zero_one_two(spark):
    inv = spark.createDataFrame([(1,), (2,), (3,)], "invoice_id long")
    holds = frame(spark, "cll_f189_holds", [{"invoice_id": 2}, {"invoice_id": 3}, {"invoice_id": 3}])
    from pyspark.sql import functions as F
    got = inv.join(hold_counts(holds), "invoice_id", "left").select(
        "invoice_id", F.coalesce("hold_count", F.lit(0)).alias("n"))
    assert rows(got, "invoice_id", "n") == [(1, 0), (2, 1), (3, 2)]


def test_last_approver_inactive_gives_null_and_dash(spark):
    hist = frame(spark, "po_action_history", [
        {"object_id": 1, "object_type_code": "PO", "action_code": "APPROVE", "sequence_num": 1, "employee_id": 7},
        {"object_id": 1, "object_type_code": "PO", "action_code": "APPROVE", "sequence_num": 2, "employee_id": 8},
        {"object_id": 1, "object_type_code": "PO", "action_code": "SUBMIT", "sequence_num": 3, "employee_id": 7},
        {"object_id": 2, "object_type_code": "PA", "action_code": "APPROVE", "sequence_num": 1, "employee_id": 7},
        {"object_id": 3, "object_type_code": "RELEASE", "action_code": "APPROVE", "sequence_num": 9,
         "employee_id": 7},
    ])
    people = frame(spark, "per_all_people_f", [
        {"person_id": 7, "effective_start_date": dt.date(1990, 1, 1), "effective_end_date": dt.date(2000, 1, 1),
         "last_name": "Silva", "attribute7": "A", "attribute8": None},
        # person 8 left before as_of: no fall-back to the earlier approver 7
        {"person_id": 8, "effective_start_date": dt.date(1990, 1, 1), "effective_end_date": dt.date(1995, 1, 1),
         "last_name": "Souza", "attribute7": "B", "attribute8": "C"},
    ])
    last = last_action(hist, "APPROVE", ["PA", "PO"])
    assert rows(last, "object_id", "sequence_num", "employee_id") == [(1, 2, 8), (2, 1, 7)]
    ap = approver_columns(last, people, AS_OF)
    assert rows(ap, "object_id", "aprovador", "aprovador_detalhe") == [(1, None, "-"), (2, "Silva", "A-Silva")]


def test_has_category_line_ignores_cancelled_and_other_codes(spark):
    lines = frame(spark, "po_lines_all", [
        {"po_line_id": 1, "po_header_id": 1, "category_id": 10, "cancel_flag": None},
        {"po_line_id": 2, "po_header_id": 2, "category_id": 10, "cancel_flag": "Y"},
        {"po_line_id": 3, "po_header_id": 3, "category_id": 11, "cancel_flag": "N"},
        {"po_line_id": 4, "po_header_id": 4, "category_id": 12, "cancel_flag": None},
        {"po_line_id": 5, "po_header_id": 4, "category_id": 13, "cancel_flag": None},
    ])
    cats = frame(spark, "mtl_categories", [{"category_id": 10, "segment1": "SE"}, {"category_id": 11, "segment1": "SM"},
                                           {"category_id": 12, "segment1": "SV"}, {"category_id": 13, "segment1": None}])
    assert rows(has_category_line(lines, cats), "po_header_id") == [(1,), (3,)]


def test_category_exclusion_drops_null(spark):
    cats = frame(spark, "mtl_categories", [{"category_id": i, "segment1": s}
                                           for i, s in enumerate([None, "SE", "SV", "SM", "X"])])
    from pyspark.sql import functions as F
    assert rows(cats.where(~F.col("segment1").isin("SE", "SV")), "segment1") == [("SM",), ("X",)]


def _catalog(spark):
    b = frame(spark, "icx_cat_items_b", [
        {"rt_item_id": 1, "supplier_part_auxid": "C1", "supplier": "V", "supplier_part_num": "P1"},
        {"rt_item_id": 2, "supplier_part_auxid": "C1", "supplier": "V", "supplier_part_num": "P1"},
        {"rt_item_id": 3, "supplier_part_auxid": "C1", "supplier": "V", "supplier_part_num": "P2"},
        {"rt_item_id": 4, "supplier_part_auxid": "C1", "supplier": "V", "supplier_part_num": "P3"},  # no price
    ])
    tlp = frame(spark, "icx_cat_items_tlp", [
        {"rt_item_id": 1, "language": "PTB", "lead_time": D("10")},
        {"rt_item_id": 2, "language": "PTB", "lead_time": D("4")},
        {"rt_item_id": 2, "language": "US", "lead_time": D("1")},
        {"rt_item_id": 3, "language": "PTB", "lead_time": D("30")},
        {"rt_item_id": 4, "language": "PTB", "lead_time": D("99")},
    ])
    prices = frame(spark, "icx_cat_item_prices", [{"rt_item_id": 1}, {"rt_item_id": 1}, {"rt_item_id": 2},
                                                  {"rt_item_id": 3}])
    return catalog_lead_times(b, tlp, prices)


def test_contract_lead_time_no_fallback(spark):
    cat = _catalog(spark)
    rows_df = spark.createDataFrame([(1, "C1", "V", "P1"), (2, "C1", "V", "P9"), (3, None, "V", "P1")],
                                    "k long, contrato_pai_segment1 string, razao_social_fornecedor string, "
                                    "part_number string")
    got = contract_lead_time(rows_df, cat)
    assert rows(got, "k", "catalog_lead_time") == [(1, D("4")), (2, None), (3, None)]


def test_max_contract_lead_time_over_live_parts_of_the_header(spark):
    cat = _catalog(spark)
    lines = frame(spark, "po_lines_all", [
        {"po_line_id": 1, "po_header_id": 1, "vendor_product_num": "P1"},
        {"po_line_id": 2, "po_header_id": 1, "vendor_product_num": "P2", "cancel_flag": "Y"},
        {"po_line_id": 3, "po_header_id": 2, "vendor_product_num": "P2"},
        {"po_line_id": 4, "po_header_id": 2, "vendor_product_num": "P3"},
        {"po_line_id": 5, "po_header_id": 2, "vendor_product_num": None},
    ])
    needed = spark.createDataFrame([(1, "C1", "V"), (2, "C1", "V"), (2, "C2", "V"), (3, "C1", "W")],
                                   "po_header_id long, supplier_part_auxid string, supplier string")
    got = max_contract_lead_time(needed, lines, cat)
    assert rows(got, "po_header_id", "supplier_part_auxid", "max_contract_lead_time") == [
        (1, "C1", D("10")), (2, "C1", D("30"))]


def test_receipt_milestones_one_pass_equals_three(spark):
    t0 = dt.datetime(1997, 1, 1)
    trx = frame(spark, "rcv_transactions", [
        {"transaction_id": 1, "shipment_header_id": 1, "po_line_location_id": 10, "po_line_id": 10,
         "transaction_type": "RECEIVE", "transaction_date": t0, "quantity": D("5")},
        {"transaction_id": 2, "shipment_header_id": 1, "po_line_location_id": 10, "po_line_id": 10,
         "transaction_type": "RECEIVE", "transaction_date": t0 + dt.timedelta(days=1), "quantity": D("5")},
        {"transaction_id": 3, "shipment_header_id": 1, "po_line_location_id": 10, "po_line_id": 10,
         "transaction_type": "DELIVER", "transaction_date": t0 + dt.timedelta(days=2), "quantity": D("3")},
        {"transaction_id": 4, "shipment_header_id": 2, "po_line_location_id": 10, "po_line_id": 10,
         "transaction_type": "DELIVER", "transaction_date": t0 + dt.timedelta(days=3), "quantity": D("4")},
        {"transaction_id": 5, "shipment_header_id": 3, "po_line_location_id": 10, "po_line_id": 10,
         "transaction_type": "DELIVER", "transaction_date": t0, "quantity": D("1")},
        {"transaction_id": 6, "shipment_header_id": 4, "po_line_location_id": 11, "po_line_id": 11,
         "transaction_type": "RETURN", "transaction_date": t0, "quantity": D("1")},
    ])
    # headers 1 and 2 carry the same receipt number ('007' and ' 7 '); 3 is not numeric
    rsh = frame(spark, "rcv_shipment_headers", [{"shipment_header_id": 1, "receipt_num": "007"},
                                                {"shipment_header_id": 2, "receipt_num": " 7 "},
                                                {"shipment_header_id": 3, "receipt_num": "R7"},
                                                {"shipment_header_id": 4, "receipt_num": "8"}])
    cols = ("line_location_id", "po_line_id", "receipt_number", "first_receive_date", "last_deliver_date",
            "deliver_quantity")
    one = rows(receipt_milestones(trx, rsh), *cols)
    assert one == [(10, 10, 7, t0, t0 + dt.timedelta(days=3), D("7"))]
    assert rows(receipt_milestones_separate(trx, rsh), *cols) == one


def test_first_row_is_deterministic_and_unique(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (2, "z", 1)], "k long, v string, w long")
    assert rows(first_row(df, ["k"], ["v", "w"]), "k", "v", "w") == [(1, "a", 9), (2, "z", 1)]
    assert rows(require_unique(df, ["k"]), "k", "n_rows") == [(1, 2)]
    assert require_unique(first_row(df, ["k"], ["v"]), ["k"]).count() == 0


def test_approval_conflicts_reports_what_the_source_would_reject(spark):
    from supplyscope.operators.milestones import approval_conflicts
    hist = frame(spark, "po_action_history", [
        # object 1: PA and PO approvals by different people -> ambiguous
        {"object_id": 1, "object_type_code": "PA", "action_code": "APPROVE", "sequence_num": 3, "employee_id": 7},
        {"object_id": 1, "object_type_code": "PO", "action_code": "APPROVE", "sequence_num": 5, "employee_id": 8},
        # object 2: two rows at the top sequence, different people -> ambiguous
        {"object_id": 2, "object_type_code": "PO", "action_code": "APPROVE", "sequence_num": 4, "employee_id": 7},
        {"object_id": 2, "object_type_code": "PO", "action_code": "APPROVE", "sequence_num": 4, "employee_id": 9},
        # object 3: an older approval by someone else does not count
        {"object_id": 3, "object_type_code": "PO", "action_code": "APPROVE", "sequence_num": 1, "employee_id": 7},
        {"object_id": 3, "object_type_code": "PO", "action_code": "APPROVE", "sequence_num": 2, "employee_id": 9},
        # object 4: same person on both types -> one employee, not ambiguous
        {"object_id": 4, "object_type_code": "PA", "action_code": "APPROVE", "sequence_num": 1, "employee_id": 7},
        {"object_id": 4, "object_type_code": "PO", "action_code": "APPROVE", "sequence_num": 2, "employee_id": 7},
    ])
    assert rows(approval_conflicts(hist), "object_id", "n_employees") == [(1, 2), (2, 2)]
    # the choice made instead: newest sequence, then type, then employee
    assert rows(last_action(hist), "object_id", "employee_id") == [(1, 8), (2, 7), (3, 9), (4, 7)]


def test_last_action_ignores_rows_without_a_sequence(spark):
    history = spark.createDataFrame([(1, "PO", "APPROVE", 3, 7), (1, "PO", "APPROVE", None, 9), (2, "PO", "APPROVE", None, 8)],
                                    "object_id long, object_type_code string, action_code string, sequence_num long, employee_id long")
    assert rows(last_action(history), "object_id", "sequence_num", "employee_id") == [(1, 3, 7)]
