"""Spark-native procurement and receiving diagnostics.

Two reports, built from DataFrame operators:

* ``plans.orders.po_without_requisition_report`` — purchase-order shipments with no
  requisition link, with lead times, approvers, receipt milestones and accounts.
* ``plans.receiving.receiving_diagnosis`` — one row per receiving-operation invoice
  line with link flags, a diagnosis and a recommended action.
"""

__version__ = "0.1.0"

from supplyscope.plans.orders import po_without_requisition, po_without_requisition_report, with_display_labels  # noqa: E402,F401
from supplyscope.plans.receiving import receiving_diagnosis, receiving_lines, scope_to_operations  # noqa: E402,F401
from supplyscope.sources.tables import catalog_tables, parquet_tables  # noqa: E402,F401
