"""The queries registered with the driver: each runs one operator (or a whole
report) over the role views of a test-data directory.  Oracle SQL for each is in
``oracle_sql.py`` under the same name."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplyscope.functions.oracle import (code_number, day_range, digits_to_number, oracle_concat, strip_controls, substr_from,
                                          to_char)
from supplyscope.operators.contracts import catalog_lead_times, contract_lead_time, delivery_lead_time, max_contract_lead_time
from supplyscope.operators.links import valid_receipts, with_requisition, without_requisition
from supplyscope.operators.lookups import (effective_rows, first_row, lookup_values, person_names, require_unique)
from supplyscope.operators.milestones import (approval_conflicts, approver_columns, has_category_line, hold_counts, invoiced_quantity,
                                              last_action, receipt_milestones, receipt_milestones_separate)
from supplyscope.operators.rejects import number_rejects
from supplyscope.operators.rules import (diagnosis_status, document_type, link_flags, recommended_action, tax_id)
from supplyscope.plans.orders import (approved_shipments, po_without_requisition, po_without_requisition_report)
from supplyscope.plans.receiving import receiving_diagnosis, receiving_lines
from supplyscope.session import ensure_checkpoint_dir
from supplyscope.sources.layout import approved_chain, buckets_for, store_orders, stored_orders
from supplyscope.sources.roles import role_tables
from supplyscope.sources.sink import read_report, write_report

# Report parameters used by the registered queries: the whole date range of the
# test data, so every query covers its full tables.
START, END = "01/01/1990", "31/12/2030"
AS_OF = dt.date(1996, 6, 1)
DISPLAY_START, DISPLAY_END = "01/01/1996", "31/12/1997"

Query = Callable[[SparkSession, str], DataFrame]
c = F.col


def _t(spark: SparkSession, sf_dir: str):
    return role_tables(spark, sf_dir)


def q_po_without_requisition(spark, sf_dir):
    t = _t(spark, sf_dir)
    x = approved_shipments(t, START, END, "STANDARD")
    pv = t["po_vendors"].select(c("vendor_id"), c("vendor_name").alias("razao_social_fornecedor"))
    x = x.join(pv, "vendor_id", "left")
    return x.select("po_header_id", "nr_doc_compra", "line_location_id", c("line_num").alias("nr_linha"),
                    document_type(c("type_lookup_code"), c("contract_num")).alias("tipo_documento"),
                    "razao_social_fornecedor", to_char("approved_date").alias("dt_aprovacao_oc_header"))


def q_po_standard_branch(spark, sf_dir):
    return po_without_requisition(_t(spark, sf_dir), START, END, AS_OF, "STANDARD")


def q_po_release_branch(spark, sf_dir):
    return po_without_requisition(_t(spark, sf_dir), START, END, AS_OF, "RELEASE")


def q_po_report_union(spark, sf_dir):
    return po_without_requisition_report(_t(spark, sf_dir), START, END, AS_OF)


BASE_KEYS = ["ri", "invoice_id", "invoice_line_id", "transaction_id"]


def q_receiving_base(spark, sf_dir):
    b = receiving_lines(_t(spark, sf_dir))
    return b.select(*BASE_KEYS, "line_location_id", "po_header_id", "inventory_item_id", "status_nfee",
                    F.coalesce(c("hold_count"), F.lit(0)).alias("hold_count"), "vendor_name", "org")


def q_receiving_flags(spark, sf_dir):
    b = link_flags(receiving_lines(_t(spark, sf_dir)).withColumn("hold_count", F.coalesce(c("hold_count"), F.lit(0))))
    return b.select(*BASE_KEYS, "flag_recebimento", "flag_oc", "flag_item_ativo", "flag_precisa_oc", "flag_hold")


def q_receiving_status(spark, sf_dir):
    return diagnosis_status(receiving_lines(_t(spark, sf_dir))).select(*BASE_KEYS, "status_analitico")


def q_receiving_action(spark, sf_dir):
    b = receiving_lines(_t(spark, sf_dir)).withColumn("hold_count", F.coalesce(c("hold_count"), F.lit(0)))
    return recommended_action(b).select(*BASE_KEYS, "sugestao_acao")


# the receiving report's raw date columns, shown in the display format for the
# registered query (the library function returns them as timestamps)
RI_DATES = ["receive_date", "gl_date", "invoice_date", "data_criacao_oc"]


def q_receiving_report(spark, sf_dir):
    df = receiving_diagnosis(_t(spark, sf_dir))
    return df.select(*[to_char(c(n)).alias(n) if n in RI_DATES else c(n) for n in df.columns])


# The report as it is usually run: some operations of one organisation, and one organisation alone.
SCOPED_RI, SCOPED_ORG = (1, 2, 3, 4, 5, 6, 7, 32, 33, 34, 35, 36), "ORG7"


def q_receiving_scoped(spark, sf_dir):
    df = receiving_diagnosis(_t(spark, sf_dir), ri=SCOPED_RI)
    return df.select(*[to_char(c(n)).alias(n) if n in RI_DATES else c(n) for n in df.columns])


def q_receiving_by_org(spark, sf_dir):
    df = receiving_diagnosis(_t(spark, sf_dir), org=SCOPED_ORG)
    return df.select(*[to_char(c(n)).alias(n) if n in RI_DATES else c(n) for n in df.columns])


def q_receiving_ri_and_org(spark, sf_dir):
    """The operations that have an invoice on hold, of one organisation: ids as a table and the organisation together."""
    t = _t(spark, sf_dir)
    held = t["cll_f189_invoices"].join(t["cll_f189_holds"].select("invoice_id").distinct(), "invoice_id", "left_semi").select("operation_id")
    df = receiving_diagnosis(t, ri=held, org=SCOPED_ORG)
    return df.select(*[to_char(c(n)).alias(n) if n in RI_DATES else c(n) for n in df.columns])


def q_number_rejects(spark, sf_dir):
    t = _t(spark, sf_dir)
    return number_rejects(t["po_lines_all"], t["rcv_shipment_headers"])


CONFLICT_SPAN = 500  # actions that share one sequence number in the query below


def q_approval_conflicts(spark, sf_dir):
    """Ambiguous last approvals of a history whose sequence numbers repeat (each stands for ``CONFLICT_SPAN`` actions)."""
    history = _t(spark, sf_dir)["po_action_history"]
    coarse = history.withColumn("sequence_num", F.floor(c("sequence_num") / CONFLICT_SPAN).cast("long"))
    return approval_conflicts(coarse, "APPROVE", ["PA", "PO", "RELEASE"])


def q_report_sink(spark, sf_dir):
    """Shipments without requisition written twice by document type, read back from the files."""
    df = q_po_without_requisition(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/report-{uuid.uuid4().hex}"
    for _ in range(2):
        write_report(df, path, ["tipo_documento"])
    return read_report(spark, path, df.schema)


def q_stored_inner_chain(spark, sf_dir):
    """Header - line - shipment - distribution of approved STANDARD orders, over tables stored by month and header."""
    path, prefix = f"{ensure_checkpoint_dir(spark).rstrip('/')}/layout-{uuid.uuid4().hex}", "supplyscope_layout_"
    t = _t(spark, sf_dir)
    store_orders(t, path, prefix, buckets=buckets_for(t))
    x = approved_chain(stored_orders(spark, path, prefix), DISPLAY_START, DISPLAY_END)
    return x.withColumn("approved_date", to_char("approved_date"))


def q_hold_count(spark, sf_dir):
    t = _t(spark, sf_dir)
    inv = t["cll_f189_invoices"].select("invoice_id")
    return (inv.join(hold_counts(t["cll_f189_holds"]), "invoice_id", "left")
            .select("invoice_id", F.coalesce(c("hold_count"), F.lit(0)).alias("hold_count")))


def q_receipt_milestones(spark, sf_dir):
    t = _t(spark, sf_dir)
    m = receipt_milestones(t["rcv_transactions"], t["rcv_shipment_headers"])
    return m.select("line_location_id", "po_line_id", "receipt_number",
                    to_char("first_receive_date").alias("dt_chegada_material"),
                    to_char("last_deliver_date").alias("dt_baixa_ar"),
                    c("deliver_quantity").alias("qt_recebida_ar"))


def q_receipt_milestones_separate(spark, sf_dir):
    t = _t(spark, sf_dir)
    m = receipt_milestones_separate(t["rcv_transactions"], t["rcv_shipment_headers"])
    return m.select("line_location_id", "po_line_id", "receipt_number",
                    to_char("first_receive_date").alias("dt_chegada_material"),
                    to_char("last_deliver_date").alias("dt_baixa_ar"),
                    c("deliver_quantity").alias("qt_recebida_ar"))


def q_invoiced_qty(spark, sf_dir):
    t = _t(spark, sf_dir)
    pairs = t["cll_f189_invoice_lines"].select("invoice_id", "line_location_id").distinct()
    return pairs.join(invoiced_quantity(t["rec_invoice_lines"]), ["invoice_id", "line_location_id"], "left")


def q_last_approver(spark, sf_dir):
    t = _t(spark, sf_dir)
    last = last_action(t["po_action_history"], "APPROVE", ["PA", "PO", "RELEASE"])
    names = person_names(t["per_all_people_f"], AS_OF, "end_only")
    return (last.join(names, last.employee_id == names.person_id, "left")
            .select("object_id", "sequence_num", "object_type_code", "employee_id",
                    c("last_name").alias("aprovador")))


def q_approver_label(spark, sf_dir):
    t = _t(spark, sf_dir)
    ap = approver_columns(last_action(t["po_action_history"], "APPROVE", ["PA", "PO"]), t["per_all_people_f"], AS_OF)
    h = t["po_headers_all"].select("po_header_id")
    return (h.join(ap.withColumnRenamed("object_id", "po_header_id"), "po_header_id", "left")
            .select("po_header_id", "aprovador", "aprovador_detalhe"))


def q_buyer_effective(spark, sf_dir):
    t = _t(spark, sf_dir)
    names = person_names(t["per_all_people_f"], AS_OF, "closed")
    h = t["po_headers_all"].select("po_header_id", "agent_id")
    return (h.join(names, h.agent_id == names.person_id, "left")
            .select("po_header_id", "agent_id", c("last_name").alias("nome_comprador")))


def q_person_end_only(spark, sf_dir):
    t = _t(spark, sf_dir)
    return effective_rows(t["per_all_people_f"], AS_OF, "end_only").select(
        "person_id", "last_name", F.date_format("effective_start_date", "dd/MM/yyyy").alias("effective_start_date"),
        F.date_format("effective_end_date", "dd/MM/yyyy").alias("effective_end_date"))


def q_has_service_line(spark, sf_dir):
    t = _t(spark, sf_dir)
    h = t["po_headers_all"].select("po_header_id")
    return (h.join(has_category_line(t["po_lines_all"], t["mtl_categories"]), "po_header_id", "left")
            .select("po_header_id", F.coalesce(c("rc_tem_linha_servico"), F.lit("Não")).alias("rc_tem_linha_servico")))


def _standard_lines(t):
    h = t["po_headers_all"].where(c("type_lookup_code") == "STANDARD").select("po_header_id", "vendor_id")
    lines = t["po_lines_all"].join(h, "po_header_id", "inner")
    pv = t["po_vendors"].select("vendor_id", c("vendor_name").alias("razao_social_fornecedor"))
    contracts = t["po_headers_all"].select(c("po_header_id").alias("contract_id"),
                                           c("segment1").alias("contrato_pai_segment1"))
    return (lines.join(pv, "vendor_id", "left")
            .join(first_row(contracts, ["contract_id"], ["contrato_pai_segment1"]), "contract_id", "left"))


def q_contract_lead_time(spark, sf_dir):
    t = _t(spark, sf_dir)
    cat = catalog_lead_times(t["icx_cat_items_b"], t["icx_cat_items_tlp"], t["icx_cat_item_prices"])
    x = contract_lead_time(_standard_lines(t).withColumn("part_number", c("vendor_product_num")), cat)
    lead = delivery_lead_time(F.lit(True), c("contract_id"), c("catalog_lead_time"), c("attribute3"))
    return x.select("po_line_id", lead.alias("prazo_de_entrega"))


def q_max_contract_lead_time(spark, sf_dir):
    t = _t(spark, sf_dir)
    cat = catalog_lead_times(t["icx_cat_items_b"], t["icx_cat_items_tlp"], t["icx_cat_item_prices"])
    keys = (_standard_lines(t).where(c("contract_id").isNotNull())
            .select("po_header_id", "contract_id", "contrato_pai_segment1").distinct())
    needed = (_standard_lines(t).where(c("contract_id").isNotNull())
              .select("po_header_id", c("contrato_pai_segment1").alias("supplier_part_auxid"),
                      c("razao_social_fornecedor").alias("supplier")).distinct())
    m = max_contract_lead_time(needed, t["po_lines_all"], cat).withColumnRenamed(
        "supplier_part_auxid", "contrato_pai_segment1")
    return (keys.join(m, ["po_header_id", "contrato_pai_segment1"], "left")
            .select("po_header_id", "contract_id", c("max_contract_lead_time").alias("prazo_maximo_de_entrega")))


def q_valid_receipts(spark, sf_dir):
    t = _t(spark, sf_dir)
    s = t["po_line_locations_all"].select("line_location_id")
    ril = t["rec_invoice_lines"].select("line_location_id", c("invoice_id").alias("ril_invoice_id")).distinct()
    ri = t["rec_invoices"].select(c("invoice_id").alias("ri_invoice_id"), c("organization_id").alias("ri_org"),
                                  c("operation_id").alias("nr_ar"), c("invoice_type_id").alias("ri_type"),
                                  c("invoice_num").alias("ri_invoice_num"))
    reo = t["rec_entry_operations"].select(c("organization_id").alias("reo_org"),
                                           c("operation_id").alias("reo_operation_id"), "reversion_flag")
    rit = t["rec_invoice_types"].select(c("invoice_type_id").alias("rit_type"), c("organization_id").alias("rit_org"),
                                        "parent_flag")
    x = (s.join(ril, "line_location_id", "left")
         .join(ri, c("ril_invoice_id") == c("ri_invoice_id"), "left")
         .join(reo, (c("ri_org") == c("reo_org")) & (c("nr_ar") == c("reo_operation_id")), "left")
         .join(rit, (c("ri_type") == c("rit_type")) & (c("ri_org") == c("rit_org")), "left"))
    return valid_receipts(x).select("line_location_id", "ri_invoice_id", "nr_ar")


def q_routing_meaning(spark, sf_dir):
    t = _t(spark, sf_dir)
    b = receiving_lines(t)
    rrh = lookup_values(t["fnd_lookup_values"], "RCV_ROUTING_HEADERS").select(
        c("lookup_code").alias("rrh_code"), c("meaning").alias("roteiro_po"))
    rrh_item = lookup_values(t["fnd_lookup_values"], "RCV_ROUTING_HEADERS").select(
        c("lookup_code").alias("rrh_item_code"), c("meaning").alias("roteiro_item"))
    b = (b.join(rrh, c("roteiro_po_id") == code_number(c("rrh_code")), "left")
          .join(rrh_item, c("roteiro_item_id") == code_number(c("rrh_item_code")), "left"))
    return b.select(*BASE_KEYS, "roteiro_po", "roteiro_item")


def q_item_type_meaning(spark, sf_dir):
    t = _t(spark, sf_dir)
    keys = ["item_id", "ship_to_organization_id"]
    rows = (t["po_line_locations_all"].select("po_line_id", "ship_to_organization_id")
            .join(t["po_lines_all"].select("po_line_id", "item_id"), "po_line_id", "inner"))
    msi = t["mtl_system_items_b"].select(c("inventory_item_id").alias("item_id"),
                                         c("organization_id").alias("ship_to_organization_id"),
                                         c("item_type").alias("lookup_code"))
    types = msi.join(lookup_values(t["fnd_lookup_values"], "ITEM_TYPE"), "lookup_code", "inner")
    return (rows.join(first_row(types, keys, ["meaning"]), keys, "left")
            .select("po_line_id", c("meaning").alias("tipo_item_usuario")))


def q_company_name(spark, sf_dir):
    t = _t(spark, sf_dir)
    hou = first_row(t["hr_operating_units"].select(c("organization_id").alias("org_id"), "name"), ["org_id"], ["name"])
    return (t["po_headers_all"].select("po_header_id", "org_id").join(hou, "org_id", "left")
            .select("po_header_id", substr_from(c("name"), 4).alias("empresa")))


def q_parent_contract(spark, sf_dir):
    t = _t(spark, sf_dir)
    contracts = first_row(t["po_headers_all"].select(c("po_header_id").alias("contract_id"),
                                                     c("segment1").alias("nr_contrato_pai")),
                          ["contract_id"], ["nr_contrato_pai"])
    return (t["po_lines_all"].select("po_line_id", "contract_id")
            .join(contracts, "contract_id", "left"))


def q_lookup_uniqueness(spark, sf_dir):
    t = _t(spark, sf_dir)
    return require_unique(t["cll_f189_invoice_lines"], ["invoice_line_id"])


def q_clean_description(spark, sf_dir):
    t = _t(spark, sf_dir)
    ctl = "\r\n\t"

    def noisy(col):
        # the test texts have line feeds but no tab or CR: add both at every ". "
        return F.replace(col, F.lit(". "), F.lit("." + ctl))

    docs = t["documents"].select(F.lit("documents").alias("source"), c("doc_id").alias("item_id"),
                                 F.lit(0).cast("long").alias("turn"), noisy(c("text")).alias("raw"))
    conv = t["conversations"].select(F.lit("conversations").alias("source"), c("conv_id").alias("item_id"),
                                     c("turn"), noisy(c("text")).alias("raw"))
    both = docs.unionByName(conv)
    return both.select("source", "item_id", "turn", F.length("raw").alias("raw_chars"),
                       strip_controls(c("raw")).alias("clean_text"))


def q_category_path(spark, sf_dir):
    t = _t(spark, sf_dir)
    m = t["mtl_categories"]
    return m.select("category_id",
                    oracle_concat("segment1", F.lit("."), "segment2", F.lit("."), "segment3", F.lit("."),
                                  "segment4", F.lit("."), "segment5").alias("cd_categoria_compras_linha"),
                    oracle_concat("segment4", "segment5").alias("tail_segments"))


def q_tax_id_mask(spark, sf_dir):
    t = _t(spark, sf_dir)
    s = t["po_vendor_sites_all"]
    return s.select("vendor_site_id", "global_attribute9",
                    tax_id(c("global_attribute9"), c("global_attribute10"), c("global_attribute11"),
                           c("global_attribute12")).alias("cnpj_fornecedor"))


def q_digits_guard(spark, sf_dir):
    t = _t(spark, sf_dir)
    return t["rcv_shipment_headers"].select("shipment_header_id", "receipt_num",
                                            digits_to_number("receipt_num").alias("receipt_number"))


def q_document_type(spark, sf_dir):
    t = _t(spark, sf_dir)
    h = t["po_headers_all"].select("po_header_id", "type_lookup_code")
    return (t["po_lines_all"].select("po_line_id", "po_header_id", "contract_num").join(h, "po_header_id", "inner")
            .select("po_line_id", document_type(c("type_lookup_code"), c("contract_num")).alias("tipo_documento")))


def q_date_display(spark, sf_dir):
    t = _t(spark, sf_dir)
    h = t["po_headers_all"].where(day_range("approved_date", DISPLAY_START, DISPLAY_END))
    return h.select("po_header_id", to_char("approved_date").alias("dt_aprovacao_oc_header"))


def q_category_exclusion(spark, sf_dir):
    t = _t(spark, sf_dir)
    return t["mtl_categories"].where(~c("segment1").isin("SE", "SV")).select("category_id", "segment1")


def q_nulls_last_sort(spark, sf_dir):
    """First and last invoice line of each operation in ``ORDER BY … NULLS LAST``
    order, as aggregates (no global sort, no window): first = smallest non-NULL
    line, last = NULL whenever the operation has a NULL line."""
    b = receiving_lines(_t(spark, sf_dir))
    g = b.groupBy("ri").agg(F.min("invoice_line_id").alias("first_line"),
                            F.max("invoice_line_id").alias("max_line"),
                            F.count(F.lit(1)).alias("n_rows"), F.count("invoice_line_id").alias("n_lines"))
    return g.select("ri", "first_line",
                    F.when(c("n_rows") == c("n_lines"), c("max_line")).alias("last_line"), "n_rows")


def q_with_requisition(spark, sf_dir):
    t = _t(spark, sf_dir)
    s = t["po_line_locations_all"].select("line_location_id", "po_line_id")
    return with_requisition(s, t["po_requisition_lines_all"])


def q_shipments_without_requisition(spark, sf_dir):
    t = _t(spark, sf_dir)
    s = t["po_line_locations_all"].select("line_location_id", "po_line_id")
    return without_requisition(s, t["po_requisition_lines_all"])


QUERIES: dict[str, Query] = {
    "po_without_requisition": q_po_without_requisition,
    "po_standard_branch": q_po_standard_branch,
    "po_release_branch": q_po_release_branch,
    "po_report_union": q_po_report_union,
    "receiving_base": q_receiving_base,
    "receiving_flags": q_receiving_flags,
    "receiving_status": q_receiving_status,
    "receiving_action": q_receiving_action,
    "receiving_report": q_receiving_report,
    "receiving_scoped": q_receiving_scoped,
    "receiving_by_org": q_receiving_by_org,
    "receiving_ri_and_org": q_receiving_ri_and_org,
    "number_rejects": q_number_rejects,
    "approval_conflicts": q_approval_conflicts,
    "stored_inner_chain": q_stored_inner_chain,
    "report_sink": q_report_sink,
    "hold_count": q_hold_count,
    "receipt_milestones": q_receipt_milestones,
    "receipt_milestones_separate": q_receipt_milestones_separate,
    "invoiced_qty": q_invoiced_qty,
    "last_approver": q_last_approver,
    "approver_label": q_approver_label,
    "buyer_effective": q_buyer_effective,
    "person_end_only": q_person_end_only,
    "has_service_line": q_has_service_line,
    "contract_lead_time": q_contract_lead_time,
    "max_contract_lead_time": q_max_contract_lead_time,
    "valid_receipts": q_valid_receipts,
    "routing_meaning": q_routing_meaning,
    "item_type_meaning": q_item_type_meaning,
    "company_name": q_company_name,
    "parent_contract": q_parent_contract,
    "lookup_uniqueness": q_lookup_uniqueness,
    "clean_description": q_clean_description,
    "category_path": q_category_path,
    "tax_id_mask": q_tax_id_mask,
    "digits_guard": q_digits_guard,
    "document_type": q_document_type,
    "date_display": q_date_display,
    "category_exclusion": q_category_exclusion,
    "nulls_last_sort": q_nulls_last_sort,
    "with_requisition": q_with_requisition,
    "shipments_without_requisition": q_shipments_without_requisition,
}
