"""Source-table schemas of the two reports (types inferred from use; the source
ships no DDL).  Used to validate inputs and to build in-memory fixtures.

Type codes: L long, D decimal(18,4), M decimal(18,2), S string, T timestamp, d date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TYPES = {"L": T.LongType(), "D": T.DecimalType(18, 4), "M": T.DecimalType(18, 2), "S": T.StringType(),
          "T": T.TimestampType(), "d": T.DateType()}

_TAX = " ".join(f"{p}_{k}:M" for p in ("ir", "inss", "iss") for k in ("base", "tax", "amount"))

SPECS: dict[str, str] = {
    # receiving diagnosis
    "cll_f189_entry_operations": "operation_id:L organization_id:L status:S receive_date:T gl_date:T "
                                 "reversion_flag:S",
    "cll_f189_invoices": "invoice_id:L operation_id:L organization_id:L invoice_num:L series:S invoice_date:T "
                         "creation_date:T invoice_amount:M invoice_type_id:L entity_id:L " + _TAX +
                         " eletronic_invoice_key:S",
    "cll_f189_invoice_lines": "invoice_line_id:L invoice_id:L quantity:D item_id:L line_location_id:L "
                              "operation_fiscal_type:S awt_group_id:L cfo_id:L utilization_id:L",
    "cll_f189_invoice_types": "invoice_type_id:L organization_id:L invoice_type_code:S description:S "
                              "requisition_type:S parent_flag:S",
    "cll_f189_fiscal_operations": "cfo_id:L cfo_code:S",
    "cll_f189_item_utilizations": "utilization_id:L utilization_code:S",
    "cll_f189_fiscal_entities_all": "entity_id:L vendor_site_id:L",
    "mtl_parameters": "organization_id:L organization_code:S",
    "mtl_system_items": "inventory_item_id:L organization_id:L segment1:S item_type:S receiving_routing_id:L",
    "nfee_header_xml": "chave:S status:S",
    "cll_f189_holds": "invoice_id:L",
    "ap_awt_groups": "group_id:L name:S",
    # purchase orders without requisition
    "po_headers_all": "po_header_id:L segment1:S type_lookup_code:S authorization_status:S approved_date:T "
                      "creation_date:T org_id:L agent_id:L vendor_id:L vendor_site_id:L fob_lookup_code:S "
                      "currency_code:S",
    "po_lines_all": "po_line_id:L po_header_id:L line_num:L item_id:L item_description:S unit_meas_lookup_code:S "
                    "category_id:L contract_id:L contract_num:S vendor_product_num:S unit_price:D attribute3:S "
                    "cancel_flag:S",
    "po_line_locations_all": "line_location_id:L po_line_id:L po_header_id:L po_release_id:L shipment_num:L "
                             "ship_to_organization_id:L receiving_routing_id:L quantity:D quantity_received:D "
                             "qty_rcv_tolerance:D promised_date:T need_by_date:T",
    "po_distributions_all": "line_location_id:L code_combination_id:L project_id:L",
    "po_releases_all": "po_release_id:L po_header_id:L release_num:L approved_date:T",
    "po_requisition_lines_all": "line_location_id:L",
    "gl_code_combinations": "code_combination_id:L segment1:S segment2:S segment3:S segment4:S",
    "pa_projects_all": "project_id:L segment1:S",
    "mtl_categories": "category_id:L segment1:S segment2:S segment3:S segment4:S segment5:S",
    "po_vendors": "vendor_id:L vendor_name:S",
    "po_vendor_sites_all": "vendor_site_id:L vendor_id:L global_attribute9:S global_attribute10:S "
                           "global_attribute11:S global_attribute12:S city:S address_line4:S",
    "rec_invoice_lines": "invoice_id:L line_location_id:L quantity:D",
    "rec_invoices": "invoice_id:L organization_id:L operation_id:L invoice_type_id:L invoice_num:L creation_date:T",
    "rec_entry_operations": "organization_id:L operation_id:L status:S reversion_flag:S",
    "rec_invoice_types": "invoice_type_id:L organization_id:L parent_flag:S",
    "rcv_shipment_headers": "shipment_header_id:L receipt_num:S",
    "rcv_transactions": "transaction_id:L shipment_header_id:L po_line_location_id:L po_line_id:L "
                        "transaction_type:S transaction_date:T quantity:D",
    "po_action_history": "object_id:L object_type_code:S action_code:S sequence_num:L employee_id:L",
    "per_all_people_f": "person_id:L effective_start_date:d effective_end_date:d last_name:S attribute7:S "
                        "attribute8:S",
    "icx_cat_items_b": "rt_item_id:L supplier_part_auxid:S supplier:S supplier_part_num:S",
    "icx_cat_items_tlp": "rt_item_id:L language:S lead_time:D",
    "icx_cat_item_prices": "rt_item_id:L",
    "mtl_system_items_b": "inventory_item_id:L organization_id:L segment1:S item_type:S receiving_routing_id:L",
    "fnd_lookup_values": "lookup_type:S lookup_code:S language:S meaning:S",
    "hr_operating_units": "organization_id:L name:S",
    "org_organization_definitions": "organization_id:L organization_code:S",
}


def schema(table: str) -> T.StructType:
    fields = []
    for item in SPECS[table].split():
        name, code = item.split(":")
        fields.append(T.StructField(name, _TYPES[code], True))
    return T.StructType(fields)


def missing_columns(df: DataFrame, table: str) -> list[str]:
    """Columns the reports read from ``table`` that ``df`` lacks."""
    have = set(df.columns)
    return [f.name for f in schema(table).fields if f.name not in have]


def frame(spark: SparkSession, table: str, rows: list[dict] | None = None) -> DataFrame:
    """A DataFrame of ``table``'s schema from dict rows (absent keys are NULL)."""
    sch = schema(table)
    data = [tuple(r.get(f.name) for f in sch.fields) for r in (rows or [])]
    return spark.createDataFrame(data, sch)
