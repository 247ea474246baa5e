"""Link checks between purchasing and receiving rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_requisition(shipments: DataFrame, requisition_lines: DataFrame,
                        key: str = "line_location_id") -> DataFrame:
    """Shipments that no requisition line points at (``NOT EXISTS`` → left anti join).

    The requisition side is reduced to distinct keys first; the partial aggregate
    runs before the shuffle, so a location referenced by millions of requisition
    lines sends one row per map task instead of all of them.
    """
    keys = requisition_lines.select(key).where(F.col(key).isNotNull()).distinct()
    return shipments.join(keys, key, "left_anti")


def with_requisition(shipments: DataFrame, requisition_lines: DataFrame,
                     key: str = "line_location_id") -> DataFrame:
    """The complement of ``without_requisition`` (``EXISTS`` → left semi join)."""
    keys = requisition_lines.select(key).where(F.col(key).isNotNull()).distinct()
    return shipments.join(keys, key, "left_semi")


def valid_receipts(df: DataFrame, *, invoice_id: str = "ri_invoice_id", invoice_num: str = "ri_invoice_num",
                   parent_flag: str = "parent_flag", reversion_flag: str = "reversion_flag") -> DataFrame:
    """Keep a row when its receiving operation is not reversed and it has either
    no invoice, or an invoice with a positive number whose type is not a parent.

    Applied *after* the outer joins (a WHERE on outer-joined columns): a reversed
    receipt removes the row; it does not just blank the receipt columns.
    """
    no_invoice = F.col(invoice_id).isNull()
    good_invoice = (F.col(invoice_id).isNotNull() & (F.col(invoice_num) > 0)
                    & (F.coalesce(F.col(parent_flag), F.lit("N")) == "N"))
    return df.where(F.col(reversion_flag).isNull() & (no_invoice | good_invoice))
