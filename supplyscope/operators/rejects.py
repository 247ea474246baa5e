"""Malformed numbers: the source raises on them, the plans read them as NULL, and these functions say which."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from supplyscope.functions.oracle import digits_to_number, safe_number


def is_reject(text: Column, parsed: Column) -> Column:
    """A text that is there, not blank, and no number."""
    return text.isNotNull() & (F.trim(text) != "") & parsed.isNull()


def reject_rows(df: DataFrame, source: str, key: str, text: str, parsed: Column) -> DataFrame:
    """``(source, column_name, row_id, raw_text)`` of the rows whose ``text`` is a reject."""
    return df.where(is_reject(F.col(text), parsed)).select(
        F.lit(source).alias("source"), F.lit(text).alias("column_name"), F.col(key).alias("row_id"), F.col(text).alias("raw_text"))


def number_rejects(lines: DataFrame, shipment_headers: DataFrame, decimal_comma: bool = False) -> DataFrame:
    """The reject table of the purchase-order report: lead times of lines (``attribute3``) and receipt numbers that are not numbers.

    Two filters over narrow scans: no shuffle, no extra job for the report."""
    return reject_rows(lines, "po_lines_all", "po_line_id", "attribute3", safe_number("attribute3", "decimal(18,4)", decimal_comma)).unionByName(
        reject_rows(shipment_headers, "rcv_shipment_headers", "shipment_header_id", "receipt_num", digits_to_number("receipt_num")))


def observe_rejects(df: DataFrame, text: str, parsed: Column, name: str | None = None) -> tuple[DataFrame, Observation]:
    """``df`` unchanged, and an observation that holds ``n_rows``, ``n_texts`` and ``n_rejects`` once an action has run over it.

    The counts come from the action's own pass (``DataFrame.observe``), so a report can be written and its rejects be known without reading anything twice."""
    seen = Observation(name) if name else Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count(text).alias("n_texts"),
                      F.coalesce(F.sum(is_reject(F.col(text), parsed).cast("long")), F.lit(0)).alias("n_rejects")), seen
