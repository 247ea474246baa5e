"""Pre-aggregated replacements for the reports' correlated subqueries.

Each function groups once on the correlation keys; the report then left-joins the
result.  All of them are plain aggregates with a map-side partial step, so a hot
key (one shipment with a third of all transactions) is reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyscope.functions.oracle import digits_to_number, ends_after, oracle_concat, valid_on


def receipt_milestones(transactions: DataFrame, shipment_headers: DataFrame) -> DataFrame:
    """First RECEIVE date, last DELIVER date and DELIVER quantity per
    ``(line_location_id, po_line_id, receipt_number)``.

    The source runs three correlated subqueries over the same transaction x
    receipt-header join.  Here it is one pass: transactions are first reduced per
    ``(location, line, shipment header)`` (before any shuffle on the receipt), then
    joined to the header's receipt number (all-digits guard, non-numeric receipts
    never match) and reduced again.  Measures are NULL where no row qualifies.
    """
    ttype = F.col("transaction_type")
    per_header = (
        transactions.where(ttype.isin("RECEIVE", "DELIVER"))
        .groupBy(F.col("po_line_location_id").alias("line_location_id"), "po_line_id", "shipment_header_id")
        .agg(F.min(F.when(ttype == "RECEIVE", F.col("transaction_date"))).alias("first_receive_date"),
             F.max(F.when(ttype == "DELIVER", F.col("transaction_date"))).alias("last_deliver_date"),
             F.sum(F.when(ttype == "DELIVER", F.col("quantity"))).alias("deliver_quantity"))
    )
    receipts = (shipment_headers
                .select("shipment_header_id", digits_to_number("receipt_num").alias("receipt_number"))
                .where(F.col("receipt_number").isNotNull()))
    return (per_header.join(receipts, "shipment_header_id", "inner")
            .groupBy("line_location_id", "po_line_id", "receipt_number")
            .agg(F.min("first_receive_date").alias("first_receive_date"),
                 F.max("last_deliver_date").alias("last_deliver_date"),
                 F.sum("deliver_quantity").alias("deliver_quantity")))


def receipt_milestones_separate(transactions: DataFrame, shipment_headers: DataFrame) -> DataFrame:
    """The same three measures as three independent aggregates joined back
    together — the literal shape of the source, kept to measure what the single
    pass saves and to check both agree."""
    receipts = (shipment_headers
                .select("shipment_header_id", digits_to_number("receipt_num").alias("receipt_number"))
                .where(F.col("receipt_number").isNotNull()))
    keyed = transactions.join(receipts, "shipment_header_id", "inner").withColumnRenamed(
        "po_line_location_id", "line_location_id")
    keys = ["line_location_id", "po_line_id", "receipt_number"]

    def one(ttype: str, agg) -> DataFrame:
        return keyed.where(F.col("transaction_type") == ttype).groupBy(*keys).agg(agg)

    first = one("RECEIVE", F.min("transaction_date").alias("first_receive_date"))
    last = one("DELIVER", F.max("transaction_date").alias("last_deliver_date"))
    qty = one("DELIVER", F.sum("quantity").alias("deliver_quantity"))
    return first.join(last, keys, "full").join(qty, keys, "full")


def invoiced_quantity(invoice_lines: DataFrame) -> DataFrame:
    """``SUM(quantity)`` per ``(invoice_id, line_location_id)`` (NULL where no line)."""
    return (invoice_lines.groupBy("invoice_id", "line_location_id")
            .agg(F.sum("quantity").alias("invoiced_quantity")))


def hold_counts(holds: DataFrame) -> DataFrame:
    """Holds per invoice.  Join with ``left`` and ``coalesce(hold_count, 0)``: the
    source's ``COUNT(1)`` subquery gives 0, not NULL, for invoices without holds."""
    return holds.groupBy("invoice_id").agg(F.count(F.lit(1)).alias("hold_count"))


def last_action(history: DataFrame, action: str = "APPROVE",
                object_types: Sequence[str] = ("PA", "PO")) -> DataFrame:
    """The latest ``action`` row per object among ``object_types``.

    The source takes the row whose sequence is the maximum per (action, type,
    object) and expects one employee; when types or rows tie it errors or picks an
    arbitrary row.  Here the order is total: newest sequence, then type, then
    employee id — one ``min(struct)`` aggregate per object, no window.  A row without
    a sequence is never the latest (``= MAX(...)`` does not match NULL).
    Returns ``(object_id, sequence_num, object_type_code, employee_id)``.
    """
    rows = history.where((F.col("action_code") == action) & F.col("object_type_code").isin(*object_types)
                         & F.col("sequence_num").isNotNull())
    best = rows.groupBy("object_id").agg(
        F.min(F.struct((-F.col("sequence_num")).alias("neg_seq"), "object_type_code", "employee_id")).alias("_b"))
    return best.select("object_id", (-F.col("_b.neg_seq")).alias("sequence_num"),
                       F.col("_b.object_type_code").alias("object_type_code"),
                       F.col("_b.employee_id").alias("employee_id"))


def person_attributes(people: DataFrame, as_of) -> DataFrame:
    """``(person_id, buyer_name, active_name, active_label)`` in one pass.

    ``buyer_name``: a last name among rows valid on ``as_of`` (closed interval);
    ``active_name`` / ``active_label``: among rows with ``end > as_of``, the last
    name and ``attribute7 || attribute8 || '-' || last_name``.  One aggregate with
    conditional minimums replaces one filtered aggregate per use.
    """
    closed = valid_on("effective_start_date", "effective_end_date", as_of)
    active = ends_after("effective_end_date", as_of)
    label = oracle_concat("attribute7", "attribute8", F.lit("-"), "last_name")
    return people.where(closed | active).groupBy("person_id").agg(
        F.min(F.when(closed, F.col("last_name"))).alias("buyer_name"),
        F.min(F.when(active, F.col("last_name"))).alias("active_name"),
        F.min(F.when(active, label)).alias("active_label"))


def approvers_from(last: DataFrame, persons: DataFrame) -> DataFrame:
    """``approver_columns`` over a ``person_attributes`` frame."""
    j = last.select("object_id", "employee_id").join(persons, F.col("employee_id") == persons.person_id, "left")
    return j.select("object_id", F.col("active_name").alias("aprovador"),
                    F.coalesce(F.col("active_label"), F.lit("-")).alias("aprovador_detalhe"))


def approver_columns(last: DataFrame, people: DataFrame, as_of) -> DataFrame:
    """``(object_id, aprovador, aprovador_detalhe)`` from the last approval.

    ``aprovador``: the approver's last name only if a person row is still active
    (``end > as_of``), otherwise NULL — no fall-back to an earlier approver.
    ``aprovador_detalhe``: ``attribute7 || attribute8 || '-' || last_name`` over the
    outer join history → active people, so ``'-'`` when the person is not active.
    Objects without approval history get no row (both NULL after the left join).
    """
    return approvers_from(last, person_attributes(people, as_of))


def has_category_line(lines: DataFrame, categories: DataFrame, codes: Sequence[str] = ("SE", "SM")) -> DataFrame:
    """``(po_header_id, rc_tem_linha_servico='Sim')`` for headers with at least one
    non-cancelled line whose category code is in ``codes``; left-join and default
    to ``'Não'``."""
    live = lines.where(F.coalesce(F.col("cancel_flag"), F.lit("N")) == "N").select("po_header_id", "category_id")
    cats = categories.where(F.col("segment1").isin(*codes)).select("category_id")
    return (live.join(cats, "category_id", "left_semi").select("po_header_id").distinct()
            .withColumn("rc_tem_linha_servico", F.lit("Sim")))


def approval_conflicts(history: DataFrame, action: str = "APPROVE",
                       object_types: Sequence[str] = ("PA", "PO")) -> DataFrame:
    """Objects whose latest ``action`` is ambiguous: the rows at the maximum
    sequence of each type name more than one employee (two types, or two rows at
    one sequence).  The source raises ORA-01427 there; ``last_action`` picks by its
    total order.  This is the uniqueness report for that choice.
    Returns ``(object_id, n_employees)``.
    """
    rows = history.where((F.col("action_code") == action) & F.col("object_type_code").isin(*object_types))
    top = rows.groupBy("object_id", "object_type_code").agg(F.max("sequence_num").alias("sequence_num"))
    at_top = rows.join(top, ["object_id", "object_type_code", "sequence_num"], "left_semi")
    return (at_top.groupBy("object_id").agg(F.countDistinct("employee_id").alias("n_employees"))
            .where(F.col("n_employees") > 1))
