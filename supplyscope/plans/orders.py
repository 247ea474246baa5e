"""Purchase-order shipments without a requisition link (62-column report).

One parametrised plan serves both document families:

* ``kind="STANDARD"``: STANDARD orders, approval date of the header in range;
* ``kind="RELEASE"``: BLANKET / PLANNED orders through their releases, approval
  date of the release in range, approvals recorded on the release;
* ``kind="ALL"`` (``po_without_requisition_report``): both in one pass — the
  source's two branches and their ``UNION ALL``, disjoint by document type.

Plan shape: first what decides which shipments are reported, then the rest for those alone.

1. lines of the in-range headers ⟕ categories, stored once;
2. shipments: anti join to requisition lines → lines, header types, in-range
   releases; stored once, with the rows the report is about;
3. headers of those shipments: vendor, site, operating unit, buyer, service-line
   flag, last approver;
4. receipt side, on narrow rows: distributions and the invoice-line bridge (one
   shuffle on the shipment key), stored once → accounts, project → invoice ⟕
   operation ⟕ type → receipt filter → receipt milestones;
5. shipment side: parent contract, catalogue lead times, header, item, destination
   organisation, routing;
6. both sides meet on the shipment key → projection → DISTINCT.

What is stored lies in the shared checkpoint folder and is read by several of the
later steps, which would each derive it again.  Every former scalar subquery is a
pre-aggregate on its own keys, scoped to the headers / lines / shipments reported.
Small code tables are left to adaptive execution, which broadcasts them only after
measuring their size at run time; everything else shuffles on its key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyscope.functions.oracle import (blank, code_number, day_range, oracle_concat, safe_number, strip_controls,
                                          substr_from, to_char, typed_null)
from supplyscope.operators.contracts import (catalog_lead_times, contract_lead_time, delivery_lead_time,
                                             max_contract_lead_time)
from supplyscope.operators.links import valid_receipts, without_requisition
from supplyscope.operators.lookups import assert_empty, assert_unique, first_row, lookup_values, spread_nulls
from supplyscope.operators.milestones import (approval_conflicts, approvers_from, has_category_line,
                                              invoiced_quantity, last_action, person_attributes,
                                              receipt_milestones)
from supplyscope.operators.rules import document_type, tax_id
from supplyscope.session import stored

# Output columns in report order, with the report's display labels.
COLUMNS: list[tuple[str, str]] = [
    ("dt_aprovacao_rc_header", "DT_APROVACAO_RC (HEADER)"),
    ("empresa", "EMPRESA"),
    ("nr_rc", "NR_RC"),
    ("status_rc", "STATUS_RC"),
    ("nr_linha_rc", "NR_LINHA_RC"),
    ("status_fechamento_rc_linha", "STATUS FECHAMENTO RC (LINHA)"),
    ("status_cancelamento_rc_linha", "STATUS CANCELAMENTO RC (LINHA)"),
    ("cd_item_req_linha", "CD_ITEM_REQ (LINHA)"),
    ("descricao_item", "DESCRICAO_ITEM"),
    ("tipo_item_usuario", "TIPO_ITEM_USUARIO"),
    ("unidade_medida", "UNIDADE_MEDIDA"),
    ("cd_categoria_compras_linha", "CD_CATEGORIA_COMPRAS (LINHA)"),
    ("valor_rc_header", "VALOR_RC (HEADER)"),
    ("valor_rc_linha", "VALOR_RC (LINHA)"),
    ("caracteristica_req_linha", "CARACTERISTICA_REQ (LINHA)"),
    ("flag_urgencia_linha", "FLAG_URGENCIA (LINHA)"),
    ("origem", "ORIGEM"),
    ("destino", "DESTINO"),
    ("qt_requisitada_linha", "QT_REQUISITADA (LINHA)"),
    ("cd_organizacao_destino_linha", "CD_ORGANIZACAO_DESTINO (LINHA)"),
    ("dt_necessidade_linha", "DT_NECESSIDADE (LINHA)"),
    ("dt_aprovacao_oc_header", "DT_APROVACAO_OC (HEADER)"),
    ("nr_doc_compra", "NR_DOC_COMPRA"),
    ("status_doc_compra", "STATUS_DOC_COMPRA"),
    ("prazo_de_entrega", "PRAZO DE ENTREGA"),
    ("nr_entrega", "NR_ENTREGA"),
    ("nr_linha", "NR_LINHA"),
    ("nr_liberacao", "NR_LIBERACAO"),
    ("tipo_documento", "TIPO_DOCUMENTO"),
    ("razao_social_fornecedor", "RAZAO_SOCIAL_FORNECEDOR"),
    ("cnpj_fornecedor", "CNPJ_FORNECEDOR"),
    ("municipio_fornecedor", "MUNICIPIO_FORNECEDOR"),
    ("uf_fornecedor", "UF_FORNECEDOR"),
    ("incoterm", "INCOTERM"),
    ("nome_comprador", "NOME_COMPRADOR"),
    ("part_number", "PART_NUMBER"),
    ("qt_entregue_fornecedor_linha", "QT_ENTREGUE_FORNECEDOR (LINHA)"),
    ("preco_unitario_linha_oc", "PRECO_UNITARIO (LINHA_OC)"),
    ("cd_moeda", "CD_MOEDA"),
    ("tolerancia", "TOLERANCIA"),
    ("data_promessa_oc", "DATA PROMESSA OC"),
    ("data_necessidade_oc", "DATA NECESSIDADE OC"),
    ("dt_chegada_material", "DT_CHEGADA_MATERIAL"),
    ("dt_cad_nf_linha", "DT_CAD_NF (LINHA)"),
    ("nr_nf", "NR_NF"),
    ("dt_baixa_ar", "DT_BAIXA_AR"),
    ("nr_ar", "NR_AR"),
    ("qt_recebida_ar_linha", "QT_RECEBIDA_AR (LINHA)"),
    ("nr_contrato_pai", "NR_CONTRATO_PAI"),
    ("roteiro_de_recebimento", "ROTEIRO_DE_RECEBIMENTO"),
    ("status_ri", "STATUS_RI"),
    ("solicitante", "SOLICITANTE"),
    ("rc_tem_linha_servico", "RC_TEM_LINHA_SERVICO"),
    ("preparador", "PREPARADOR"),
    ("aprovador", "APROVADOR"),
    ("prazo_maximo_de_entrega", "PRAZO MAXIMO DE ENTREGA"),
    ("codigo_empresa", "CODIGO_EMPRESA"),
    ("unidade_controle", "UNIDADE_CONTROLE"),
    ("conta_contabil", "CONTA_CONTABIL"),
    ("centro_de_custo", "CENTRO_DE_CUSTO"),
    ("numero_projeto", "NUMERO_PROJETO"),
    ("aprovador_detalhe", "APROVADOR"),
]
OUTPUT = [c for c, _ in COLUMNS]

# Filters of the report.
STANDARD_TYPES = ["STANDARD"]
RELEASE_TYPES = ["BLANKET", "PLANNED"]
EXCLUDED_CATEGORIES = ["SE", "SV"]
SERVICE_CATEGORIES = ["SE", "SM"]
STANDARD_APPROVER_TYPES = ["PA", "PO"]
RELEASE_APPROVER_TYPES = ["RELEASE"]


def _rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.select(*[F.col(k).alias(v) for k, v in mapping.items()])


KINDS = {"STANDARD": (True, False), "RELEASE": (False, True), "ALL": (True, True)}


def _headers(t: Mapping[str, DataFrame], start, end, kind: str) -> DataFrame:
    """Approved headers of the chosen families; STANDARD ones in the approval range
    (releases are filtered by their own approval date).  ``is_release`` tells the
    two families apart for the rest of the plan."""
    c = F.col
    std, rel = KINDS[kind]
    fam = []
    if std:
        fam.append(c("type_lookup_code").isin(*STANDARD_TYPES) & day_range("approved_date", start, end))
    if rel:
        fam.append(c("type_lookup_code").isin(*RELEASE_TYPES))
    cond = fam[0] if len(fam) == 1 else (fam[0] | fam[1])
    h = t["po_headers_all"].where(c("authorization_status").isin("APPROVED") & cond)
    return _rename(h, {"po_header_id": "po_header_id", "segment1": "nr_doc_compra",
                       "type_lookup_code": "type_lookup_code", "authorization_status": "status_doc_compra",
                       "approved_date": "approved_date", "org_id": "org_id", "agent_id": "agent_id",
                       "vendor_id": "vendor_id", "vendor_site_id": "vendor_site_id",
                       "fob_lookup_code": "incoterm", "currency_code": "cd_moeda"}).withColumn(
        "is_release", c("type_lookup_code").isin(*RELEASE_TYPES))


def _releases(t: Mapping[str, DataFrame], start, end) -> DataFrame:
    rel = t["po_releases_all"].where(day_range("approved_date", start, end))
    return _rename(rel, {"po_release_id": "rel_id", "release_num": "nr_liberacao",
                         "approved_date": "release_approved_date"})


LINE_COLUMNS = ["po_line_id", "po_header_id", "line_num", "item_id", "item_description", "unit_meas_lookup_code",
                "category_id", "contract_id", "contract_num", "vendor_product_num", "unit_price", "attribute3"]


def approved_shipments(t: Mapping[str, DataFrame], start, end, kind: str = "STANDARD",
                       headers: DataFrame | None = None, releases: DataFrame | None = None,
                       lines: DataFrame | None = None) -> DataFrame:
    """Approved shipments of the chosen document families in the approval range,
    joined to their line and header (and, for BLANKET / PLANNED, to a release
    approved in the range), with no requisition link.  (The minimum slice of the
    report, and the driving relation of the full plan.)

    ``headers`` / ``releases`` / ``lines``: those relations where the caller has them
    scoped or extended already.  The anti join runs first, on the bare shipments, so
    only shipments without a requisition meet the wider line and header rows."""
    c = F.col
    std, rel = KINDS[kind]
    h = headers if headers is not None else _headers(t, start, end, kind)
    lines = lines if lines is not None else t["po_lines_all"].select(*LINE_COLUMNS)
    loc_cols = ["line_location_id", "po_line_id", "shipment_num", "ship_to_organization_id", "receiving_routing_id",
                "qty_rcv_tolerance", "promised_date", "need_by_date"]
    locs = t["po_line_locations_all"].select(*loc_cols, *(["po_release_id"] if rel else []))
    locs = without_requisition(locs, t["po_requisition_lines_all"])
    x = lines.join(h, "po_header_id", "inner").join(locs, "po_line_id", "inner")
    if not rel:
        return x.withColumn("nr_liberacao", typed_null("long")).withColumn(
            "release_approved_date", typed_null("timestamp_ntz"))
    r = (releases if releases is not None else _releases(t, start, end)).withColumn("rel_hit", F.lit(True))
    # inner join for the release family only: a left join whose key is NULL for the
    # other family, then drop release-family rows without an in-range release
    x = x.withColumn("rel_id", F.when(c("is_release"), c("po_release_id")))
    x = spread_nulls(x, r, ["rel_id"], spread=["line_location_id"])
    return x.where(~c("is_release") | c("rel_hit").isNotNull())


def po_without_requisition(t: Mapping[str, DataFrame], start, end, as_of, kind: str = "STANDARD",
                           language: str = "PTB", strict: bool = False, decimal_comma: bool = False) -> DataFrame:
    """The report (62 columns, DISTINCT rows) for ``kind`` = ``STANDARD``,
    ``RELEASE`` (BLANKET / PLANNED through releases) or ``ALL`` (both, one pass).

    ``start`` / ``end``: ``DD/MM/YYYY`` text or dates, inclusive whole days.
    ``as_of``: the instant the source took from ``SYSDATE`` (buyer and approver
    validity); explicit so results are reproducible.
    ``strict``: first check that every scalar lookup is unique (raises otherwise),
    which the source database enforced at run time.
    ``decimal_comma``: read the lines' text lead times (``attribute3``) with a
    decimal comma, as a pt-BR database session does.

    Both families read the same lines and shipments, so ``ALL`` evaluates them in
    one pass with an ``is_release`` discriminator instead of two plans and a
    union; their rows are disjoint by document type, so one DISTINCT is exact.
    The relations that several steps share are stored when this is called (see the
    module's text): lines, shipments, catalogue, receipt side.
    """
    std_on, rel_on = KINDS[kind]
    c = F.col

    hou_src = _rename(t["hr_operating_units"], {"organization_id": "org_id", "name": "hou_name"})
    msi_src = _rename(t["mtl_system_items_b"], {"inventory_item_id": "item_id",
                                                "organization_id": "ship_to_organization_id",
                                                "segment1": "cd_item_req_linha", "item_type": "msi_item_type"})
    ood_src = _rename(t["org_organization_definitions"], {"organization_id": "ship_to_organization_id",
                                                          "organization_code": "cd_organizacao_destino_linha"})
    contract_src = _rename(t["po_headers_all"], {"po_header_id": "contract_id", "segment1": "contrato_pai_segment1"})
    if strict:
        assert_unique(hou_src, ["org_id"], "operating unit")
        assert_unique(msi_src, ["item_id", "ship_to_organization_id"], "item")
        assert_unique(ood_src, ["ship_to_organization_id"], "organisation")
        assert_unique(contract_src, ["contract_id"], "contract header")
        assert_unique(lookup_values(t["fnd_lookup_values"], "ITEM_TYPE", language), ["lookup_code"],
                      "item type lookup")
        for types in ([STANDARD_APPROVER_TYPES] if std_on else []) + ([RELEASE_APPROVER_TYPES] if rel_on else []):
            assert_empty(approval_conflicts(t["po_action_history"], "APPROVE", types),
                         f"ambiguous last {'/'.join(types)} approval")

    # ---- lines of the headers in range: the shipments, the service-line flag and the maximum lead time read them
    heads = _headers(t, start, end, kind)
    cats = t["mtl_categories"].where(~c("segment1").isin(*EXCLUDED_CATEGORIES))
    cats = _rename(cats, {"category_id": "category_id", **{f"segment{i}": f"mc_segment{i}" for i in range(1, 6)}})
    scoped_lines = (t["po_lines_all"].select(*LINE_COLUMNS, "cancel_flag")
                    .join(heads.select("po_header_id"), "po_header_id", "left_semi"))
    scoped_lines = stored(scoped_lines.join(cats.withColumn("reported", F.lit(True)), "category_id", "left"), "po-lines")

    # ---- shipments without requisition, of approved documents and other than excluded categories
    # one pass over the people table serves the buyer and both approver lookups
    persons = person_attributes(t["per_all_people_f"], as_of)
    history = t["po_action_history"]
    rel = None
    if rel_on:
        rel = _releases(t, start, end)
        hist_r = history.join(rel.select(c("rel_id").alias("object_id")), "object_id", "left_semi")
        ap_r = _rename(approvers_from(last_action(hist_r, "APPROVE", RELEASE_APPROVER_TYPES), persons),
                       {"object_id": "rel_id", "aprovador": "r_aprovador", "aprovador_detalhe": "r_detalhe"})
        rel = rel.join(ap_r, "rel_id", "left")
    shipments = stored(approved_shipments(t, start, end, kind, releases=rel,
                                          headers=heads.select("po_header_id", "type_lookup_code", "is_release"),
                                          lines=scoped_lines.where("reported").drop("cancel_flag", "reported", "category_id")),
                       "po-shipments")

    # ---- header grain: vendor, site, operating unit, buyer, service-line flag, approver of the reported headers
    reported = shipments.select("po_header_id").distinct()
    h = heads.drop("type_lookup_code", "is_release").join(reported, "po_header_id", "left_semi")
    h = h.join(has_category_line(scoped_lines, t["mtl_categories"], SERVICE_CATEGORIES), "po_header_id", "left")
    if std_on:
        # header approvals belong to the STANDARD family only
        own = shipments.where(~c("is_release")).select(c("po_header_id").alias("object_id")).distinct()
        last = last_action(history.join(own, "object_id", "left_semi"), "APPROVE", STANDARD_APPROVER_TYPES)
        ap_h = _rename(approvers_from(last, persons),
                       {"object_id": "po_header_id", "aprovador": "h_aprovador", "aprovador_detalhe": "h_detalhe"})
        h = h.join(ap_h, "po_header_id", "left")
    pvsa = _rename(t["po_vendor_sites_all"], {
        "vendor_id": "pvsa_vendor_id", "vendor_site_id": "pvsa_site_id", "global_attribute9": "ga9",
        "global_attribute10": "ga10", "global_attribute11": "ga11", "global_attribute12": "ga12",
        "city": "municipio_fornecedor", "address_line4": "uf_fornecedor"})
    h = h.join(pvsa, (c("vendor_id") == c("pvsa_vendor_id")) & (c("vendor_site_id") == c("pvsa_site_id")), "left")
    pv = _rename(t["po_vendors"], {"vendor_id": "pv_vendor_id", "vendor_name": "razao_social_fornecedor"})
    h = h.join(pv, c("vendor_id") == c("pv_vendor_id"), "left")
    h = h.join(first_row(hou_src, ["org_id"], ["hou_name"]), "org_id", "left")
    buyers = persons.select(F.col("person_id").alias("agent_id"), F.col("buyer_name").alias("nome_comprador"))
    h = h.join(buyers, "agent_id", "left").drop("pvsa_vendor_id", "pvsa_site_id", "pv_vendor_id", "vendor_id",
                                                "vendor_site_id", "org_id", "agent_id")

    # ---- receipt side: distributions and the invoice-line bridge on one shuffle by the shipment key.  Identical
    # distributions would collapse under the final DISTINCT anyway, so they collapse here.  The invoiced quantity is
    # the sum over the bridge's (shipment, invoice) groups, so one aggregate gives both
    scope = shipments.select("line_location_id", "po_line_id").distinct()
    dist = t["po_distributions_all"].select("line_location_id", "code_combination_id", "project_id")
    ril = _rename(invoiced_quantity(t["rec_invoice_lines"].join(scope, "line_location_id", "left_semi")), {
        "line_location_id": "line_location_id", "invoice_id": "ril_invoice_id", "invoiced_quantity": "ril_quantity"})
    y = stored(scope.join(dist, "line_location_id", "inner").distinct().join(ril, "line_location_id", "left"), "po-receipts")
    invoice_ids = y.select(c("ril_invoice_id").alias("ri_invoice_id")).where(c("ri_invoice_id").isNotNull()).distinct()
    gcc = _rename(t["gl_code_combinations"], {"code_combination_id": "code_combination_id",
                                              "segment1": "codigo_empresa", "segment2": "unidade_controle",
                                              "segment3": "conta_contabil", "segment4": "centro_de_custo"})
    y = y.join(gcc, "code_combination_id", "inner")
    ppa = _rename(t["pa_projects_all"], {"project_id": "project_id", "segment1": "numero_projeto"})
    y = spread_nulls(y, ppa, ["project_id"], spread=["line_location_id"])

    # invoice grain: invoice ⟕ operation ⟕ invoice type, then one join
    ri = _rename(t["rec_invoices"], {"invoice_id": "ri_invoice_id", "organization_id": "ri_org",
                                     "operation_id": "nr_ar", "invoice_type_id": "ri_type",
                                     "invoice_num": "ri_invoice_num", "creation_date": "ri_creation_date"})
    reo = _rename(t["rec_entry_operations"], {"organization_id": "reo_org", "operation_id": "reo_operation_id",
                                              "status": "status_ri", "reversion_flag": "reversion_flag"})
    rit = _rename(t["rec_invoice_types"], {"invoice_type_id": "rit_type", "organization_id": "rit_org",
                                           "parent_flag": "parent_flag"})
    inv = (ri.join(invoice_ids, "ri_invoice_id", "left_semi")
             .join(reo, (c("ri_org") == c("reo_org")) & (c("nr_ar") == c("reo_operation_id")), "left")
             .join(rit, (c("ri_type") == c("rit_type")) & (c("ri_org") == c("rit_org")), "left")
             .drop("reo_org", "reo_operation_id", "rit_type", "rit_org", "ri_org", "ri_type"))
    inv = inv.withColumn("ril_invoice_id", c("ri_invoice_id"))
    y = spread_nulls(y, inv, ["ril_invoice_id"], spread=["line_location_id", "code_combination_id"])
    y = valid_receipts(y).withColumn(
        "qt_entregue_fornecedor_linha", F.when(c("ri_invoice_id").isNotNull(), c("ril_quantity")))

    trx = t["rcv_transactions"].join(scope.select(c("line_location_id").alias("po_line_location_id")),
                                     "po_line_location_id", "left_semi")
    ms = _rename(receipt_milestones(trx, t["rcv_shipment_headers"]), {
        "line_location_id": "line_location_id", "po_line_id": "po_line_id", "receipt_number": "nr_ar",
        "first_receive_date": "first_receive_date", "last_deliver_date": "last_deliver_date",
        "deliver_quantity": "qt_recebida_ar_linha"})
    y = y.join(ms, ["line_location_id", "po_line_id", "nr_ar"], "left")

    # ---- shipment side: header, parent contract, catalogue lead times, item, destination organisation, routing
    on_contract = (c("type_lookup_code") == "STANDARD") & c("contract_id").isNotNull()
    # lookups scoped to what the reported shipments reference (contracts, items), so a
    # narrow report does not aggregate whole header, item and catalogue tables
    contract_ids = shipments.select("contract_id").where(c("contract_id").isNotNull()).distinct()
    contracts = first_row(contract_src.join(contract_ids, "contract_id", "left_semi"),
                          ["contract_id"], ["contrato_pai_segment1"])
    x = spread_nulls(shipments, contracts, ["contract_id"], spread=["po_line_id"])
    if std_on:
        x = x.join(h.select("po_header_id", "razao_social_fornecedor"), "po_header_id", "inner")
        contract_nos = contracts.select(c("contrato_pai_segment1").alias("supplier_part_auxid")).distinct()
        catalog = stored(catalog_lead_times(
            t["icx_cat_items_b"].join(contract_nos, "supplier_part_auxid", "left_semi"),
            t["icx_cat_items_tlp"], t["icx_cat_item_prices"], language), "po-catalog")
        x = contract_lead_time(x.withColumn("part_number", c("vendor_product_num")), catalog)
        needed = (x.where(on_contract)
                  .select("po_header_id", c("contrato_pai_segment1").alias("supplier_part_auxid"),
                          c("razao_social_fornecedor").alias("supplier"))
                  .distinct())
        maxes = _rename(max_contract_lead_time(needed, scoped_lines.join(reported, "po_header_id", "left_semi"), catalog), {
            "po_header_id": "po_header_id", "supplier_part_auxid": "contrato_pai_segment1",
            "max_contract_lead_time": "max_contract_lead_time"})
        x = x.join(maxes, ["po_header_id", "contrato_pai_segment1"], "left").drop("razao_social_fornecedor")
    x = x.join(h, "po_header_id", "inner")

    keys_item = ["item_id", "ship_to_organization_id"]
    item_ids = shipments.select("item_id").where(c("item_id").isNotNull()).distinct()
    msi_scoped = msi_src.join(item_ids, "item_id", "left_semi")
    item_types = _rename(lookup_values(t["fnd_lookup_values"], "ITEM_TYPE", language),
                         {"lookup_code": "msi_item_type", "meaning": "tipo_item_usuario"})
    # item code and item-type text share the (item, organisation) key: one aggregate
    items = (msi_scoped.select(*keys_item, "cd_item_req_linha", "msi_item_type")
             .join(item_types, "msi_item_type", "left")
             .groupBy(*keys_item)
             .agg(F.min("cd_item_req_linha").alias("cd_item_req_linha"),
                  F.min("tipo_item_usuario").alias("tipo_item_usuario")))
    rrh = _rename(lookup_values(t["fnd_lookup_values"], "RCV_ROUTING_HEADERS", language),
                  {"lookup_code": "rrh_code", "meaning": "roteiro_de_recebimento"})
    x = x.join(items, keys_item, "left")
    x = x.join(first_row(ood_src, ["ship_to_organization_id"], ["cd_organizacao_destino_linha"]),
               "ship_to_organization_id", "left")
    x = x.join(rrh, c("receiving_routing_id") == code_number(c("rrh_code")), "left")

    x = y.join(x, ["line_location_id", "po_line_id"], "inner")

    is_rel = c("is_release")
    if std_on:
        lead = delivery_lead_time(c("type_lookup_code") == "STANDARD", c("contract_id"), c("catalog_lead_time"),
                                  c("attribute3"), decimal_comma)
        max_lead = F.when(on_contract, c("max_contract_lead_time"))
    else:
        # the STANDARD arms cannot hold for BLANKET / PLANNED: no catalogue joins
        lead = safe_number(c("attribute3"), "double", decimal_comma)
        max_lead = typed_null("double")
    doc_type = document_type(c("type_lookup_code"), c("contract_num"))
    approved = F.when(is_rel, c("release_approved_date")).otherwise(c("approved_date"))
    release_num = F.when(is_rel, c("nr_liberacao"))
    if std_on and rel_on:
        aprovador = F.when(is_rel, c("r_aprovador")).otherwise(c("h_aprovador"))
        detalhe = F.when(is_rel, c("r_detalhe")).otherwise(c("h_detalhe"))
    elif std_on:
        aprovador, detalhe = c("h_aprovador"), c("h_detalhe")
    else:
        aprovador, detalhe = c("r_aprovador"), c("r_detalhe")

    out = {
        "dt_aprovacao_rc_header": blank(),
        "empresa": substr_from(c("hou_name"), 4),
        "nr_rc": blank(), "status_rc": blank(), "nr_linha_rc": blank(),
        "status_fechamento_rc_linha": blank(), "status_cancelamento_rc_linha": blank(),
        "cd_item_req_linha": c("cd_item_req_linha"),
        "descricao_item": strip_controls(c("item_description")),
        "tipo_item_usuario": c("tipo_item_usuario"),
        "unidade_medida": c("unit_meas_lookup_code"),
        "cd_categoria_compras_linha": oracle_concat("mc_segment1", F.lit("."), "mc_segment2", F.lit("."),
                                                    "mc_segment3", F.lit("."), "mc_segment4", F.lit("."),
                                                    "mc_segment5"),
        "valor_rc_header": blank(), "valor_rc_linha": blank(), "caracteristica_req_linha": blank(),
        "flag_urgencia_linha": blank(), "origem": blank(), "destino": blank(), "qt_requisitada_linha": blank(),
        "cd_organizacao_destino_linha": c("cd_organizacao_destino_linha"),
        "dt_necessidade_linha": blank(),
        "dt_aprovacao_oc_header": to_char(approved),
        "nr_doc_compra": c("nr_doc_compra"),
        "status_doc_compra": c("status_doc_compra"),
        "prazo_de_entrega": lead,
        "nr_entrega": c("shipment_num"),
        "nr_linha": c("line_num"),
        "nr_liberacao": release_num,
        "tipo_documento": doc_type,
        "razao_social_fornecedor": c("razao_social_fornecedor"),
        "cnpj_fornecedor": tax_id(c("ga9"), c("ga10"), c("ga11"), c("ga12")),
        "municipio_fornecedor": c("municipio_fornecedor"),
        "uf_fornecedor": c("uf_fornecedor"),
        "incoterm": c("incoterm"),
        "nome_comprador": c("nome_comprador"),
        "part_number": c("vendor_product_num"),
        "qt_entregue_fornecedor_linha": c("qt_entregue_fornecedor_linha"),
        "preco_unitario_linha_oc": c("unit_price"),
        "cd_moeda": c("cd_moeda"),
        "tolerancia": c("qty_rcv_tolerance"),
        "data_promessa_oc": to_char(c("promised_date")),
        "data_necessidade_oc": to_char(c("need_by_date")),
        "dt_chegada_material": to_char(c("first_receive_date")),
        "dt_cad_nf_linha": to_char(c("ri_creation_date")),
        "nr_nf": c("ri_invoice_num").cast("string"),
        "dt_baixa_ar": to_char(c("last_deliver_date")),
        "nr_ar": c("nr_ar"),
        "qt_recebida_ar_linha": c("qt_recebida_ar_linha"),
        "nr_contrato_pai": c("contrato_pai_segment1"),
        "roteiro_de_recebimento": c("roteiro_de_recebimento"),
        "status_ri": c("status_ri"),
        "solicitante": blank(),
        "rc_tem_linha_servico": F.coalesce(c("rc_tem_linha_servico"), F.lit("Não")),
        "preparador": blank(),
        "aprovador": aprovador,
        "prazo_maximo_de_entrega": max_lead,
        "codigo_empresa": c("codigo_empresa"),
        "unidade_controle": c("unidade_controle"),
        "conta_contabil": c("conta_contabil"),
        "centro_de_custo": c("centro_de_custo"),
        "numero_projeto": c("numero_projeto"),
        "aprovador_detalhe": detalhe,
    }
    assert list(out) == OUTPUT
    return x.select(*[v.alias(k) for k, v in out.items()]).distinct()


def po_without_requisition_report(t: Mapping[str, DataFrame], start, end, as_of, language: str = "PTB",
                                  strict: bool = False, decimal_comma: bool = False) -> DataFrame:
    """Both families (the source's two branches and their ``UNION ALL``), in one pass."""
    return po_without_requisition(t, start, end, as_of, "ALL", language, strict, decimal_comma)


def with_display_labels(df: DataFrame) -> DataFrame:
    """Rename to the report's display labels.  Two source columns share the label
    ``APROVADOR``; the second keeps a suffix so the result can still be written."""
    seen: dict[str, int] = {}
    names = []
    for col, label in COLUMNS:
        n = seen.get(label, 0)
        seen[label] = n + 1
        names.append(label if n == 0 else f"{label}_{n + 1}")
    return df.select(*[F.col(cn).alias(lb) for cn, lb in zip(OUTPUT, names)])
