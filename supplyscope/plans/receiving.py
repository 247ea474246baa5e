"""Receiving diagnosis (44-column report): one row per receiving operation x
invoice x invoice line x DELIVER transaction x e-invoice row.

The source is a chain of left joins from the receiving operation.  Left joins
whose condition only references one relation are associative, so the chain is
grouped by grain before the wide joins:

* invoice grain:   invoice ⟕ type ⟕ fiscal entity ⟕ site ⟕ vendor ⟕ e-invoice
* shipment grain:  shipment ⟕ DELIVER transactions ⟕ header
* line grain:      lines of the invoices that an operation reaches ⟕ item ⟕ (shipment grain)
* operation ⟕ (invoice grain) on (operation, organisation) ⟕ hold count ⟕ (line grain)
  on (invoice, organisation) ⟕ CFOP ⟕ utilisation

The line-grain joins run on narrow rows: the invoice's columns join last, on the key that
groups the lines of an invoice, and are not moved again but by the report's sort.

A hot key on the right of a left outer join (many invoices of one operation,
lines of one invoice, deliveries of one shipment) cannot be split by adaptive
execution, so those joins go through ``left_join_split`` or, where the hot keys are counted, ``left_join_hot``.

The sorted whole report joins operations, invoices and lines inside ranges of operations instead (``_sorted_lines``).

"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyscope.functions.oracle import code_number
from supplyscope.operators.lookups import hot_keys, left_join_hot, left_join_split, lookup_values, spread_nulls, with_missing
from supplyscope.operators.milestones import hold_counts
from supplyscope.operators.rules import diagnosis_status, link_flags, recommended_action
from supplyscope.session import stored

# Output columns in report order.
OUTPUT = [
    "ri", "status_ri", "receive_date", "gl_date",
    "invoice_num", "series", "invoice_date", "invoice_amount",
    "invoice_line_id", "qtd_nf", "qtd_solicitada_po", "qtd_recebida_po",
    "numero_oc", "tipo_oc", "data_criacao_oc",
    "invoice_type_code", "desc_tipo_nf", "requisition_type",
    "cfo_code", "nop", "utilization_code", "vendor_name", "org",
    "roteiro_po", "roteiro_item",
    "awt_group_id", "grupo_retencao",
    "ir_base", "ir_tax", "ir_amount", "inss_base", "inss_tax", "inss_amount", "iss_base", "iss_tax", "iss_amount",
    "flag_recebimento", "flag_oc", "flag_item_ativo", "flag_precisa_oc", "flag_hold",
    "status_nfee", "status_analitico", "sugestao_acao",
]
TAX_COLUMNS = ["ir_base", "ir_tax", "ir_amount", "inss_base", "inss_tax", "inss_amount",
               "iss_base", "iss_tax", "iss_amount"]
OP_KEYS = ["ri", "reo_org"]

RANGE_ROWS = 250_000  # rows of the sorted report that one task joins and sorts
HOT_RANGES = 16       # ranges that one operation may fill before the report is sorted behind the joins
SAMPLED = 2_500       # one row in so many is looked at for the ranges (100,000 rows at least, a million at most)
SEED = 42
#: With this session setting rows dealt by their range alone would be moved again by each join's other keys.
ALL_KEYS = "spark.sql.requireAllClusterKeysForDistribution"


def _rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.select(*[F.col(k).alias(v) for k, v in mapping.items()])


def _operations(t: Mapping[str, DataFrame]) -> DataFrame:
    return _rename(t["cll_f189_entry_operations"], {"operation_id": "ri", "organization_id": "reo_org",
                                                    "status": "status_ri", "receive_date": "receive_date",
                                                    "gl_date": "gl_date"})


def _organisations(t: Mapping[str, DataFrame]) -> DataFrame:
    return _rename(t["mtl_parameters"], {"organization_id": "reo_org", "organization_code": "org"})


def _invoices(t: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The invoices' keys, and the invoices with their vendor; each lookup is joined on its own, so its
    stored size decides whether it is broadcast."""
    c = F.col
    inv = _rename(t["cll_f189_invoices"], {
        "invoice_id": "invoice_id", "operation_id": "ri", "organization_id": "reo_org",
        "invoice_num": "invoice_num", "series": "series", "invoice_date": "invoice_date",
        "invoice_amount": "invoice_amount", "invoice_type_id": "invoice_type_id", "entity_id": "entity_id",
        **{k: k for k in TAX_COLUMNS}, "eletronic_invoice_key": "eletronic_invoice_key"})
    inv_keys = inv.select("invoice_id", *OP_KEYS)
    rfea = _rename(t["cll_f189_fiscal_entities_all"], {"entity_id": "rfea_entity", "vendor_site_id": "rfea_site"})
    pvsa = _rename(t["po_vendor_sites_all"], {"vendor_site_id": "pvsa_site", "vendor_id": "pvsa_vendor"})
    pv = _rename(t["po_vendors"], {"vendor_id": "pv_vendor", "vendor_name": "vendor_name"})
    inv = (inv.join(rfea, c("entity_id") == c("rfea_entity"), "left").join(pvsa, c("rfea_site") == c("pvsa_site"), "left")
           .join(pv, c("pvsa_vendor") == c("pv_vendor"), "left")
           .drop("entity_id", "rfea_entity", "rfea_site", "pvsa_site", "pvsa_vendor", "pv_vendor"))
    return inv_keys, inv


def _typed(t: Mapping[str, DataFrame], inv: DataFrame) -> DataFrame:
    """Invoices with the columns of their type, a code table (some per organisation), whatever it is derived from."""
    rit = _rename(t["cll_f189_invoice_types"], {"invoice_type_id": "invoice_type_id", "organization_id": "reo_org",
                                                "invoice_type_code": "invoice_type_code",
                                                "description": "desc_tipo_nf", "requisition_type": "requisition_type"})
    return inv.join(F.broadcast(rit), ["invoice_type_id", "reo_org"], "left").drop("invoice_type_id")


def _e_invoices(t: Mapping[str, DataFrame]) -> DataFrame:
    return _rename(t["nfee_header_xml"], {"chave": "eletronic_invoice_key", "status": "status_nfee"})


def _invoice_lines(t: Mapping[str, DataFrame]) -> DataFrame:
    return _rename(t["cll_f189_invoice_lines"], {
        "invoice_line_id": "invoice_line_id", "invoice_id": "invoice_id", "quantity": "qtd_nf", "item_id": "item_id",
        "line_location_id": "line_location_id", "operation_fiscal_type": "nop", "awt_group_id": "awt_group_id",
        "cfo_id": "cfo_id", "utilization_id": "utilization_id"})


def _order_headers(t: Mapping[str, DataFrame]) -> DataFrame:
    return _rename(t["po_headers_all"], {"po_header_id": "po_header_id", "segment1": "numero_oc",
                                         "type_lookup_code": "tipo_oc", "creation_date": "data_criacao_oc"})


def _line_grain(t: Mapping[str, DataFrame], reached: DataFrame, skew_safe: bool = True, narrow: bool = False) -> DataFrame:
    """Lines of the ``reached`` invoices (``invoice_id``, ``reo_org`` and what else it holds) with item, shipment and order header.

    ``narrow``: without the order headers, and true for the item's id, of which the report only asks whether it is set."""
    c = F.col
    # organisation of the invoice, then the item in it, while the rows are narrow
    lines = _invoice_lines(t).join(reached, "invoice_id", "inner")
    msi = _rename(t["mtl_system_items"], {"inventory_item_id": "item_id", "organization_id": "reo_org",
                                          "receiving_routing_id": "roteiro_item_id"})
    msi = msi.withColumn("inventory_item_id", F.lit(True) if narrow else c("item_id"))
    lines = lines.join(msi, ["item_id", "reo_org"], "left").drop("item_id")

    # shipment grain: shipment ⟕ DELIVER transactions ⟕ header.  A shipment's deliveries are what can fan out, here and
    # behind the lines' join; a shipment's id is its table's key, the header has one row per key
    pll = _rename(t["po_line_locations_all"], {"line_location_id": "line_location_id", "po_header_id": "po_header_id",
                                               "quantity": "qtd_solicitada_po",
                                               "quantity_received": "qtd_recebida_po",
                                               "receiving_routing_id": "roteiro_po_id"})
    rt = (t["rcv_transactions"].where(c("transaction_type") == "DELIVER")
          .select(c("po_line_location_id").alias("line_location_id"), "transaction_id"))
    hot = hot_keys(rt, "line_location_id") if skew_safe else []
    ship = left_join_hot(pll, rt, "line_location_id", hot)
    if not narrow:
        ship = spread_nulls(ship, _order_headers(t), ["po_header_id"], spread=["line_location_id"])
    return left_join_hot(lines, ship, "line_location_id", hot)


def _codes(t: Mapping[str, DataFrame], base: DataFrame, small=lambda df: df) -> DataFrame:
    """``base`` with the texts of its codes of operation and utilisation."""
    rfo = _rename(t["cll_f189_fiscal_operations"], {"cfo_id": "cfo_id", "cfo_code": "cfo_code"})
    riu = _rename(t["cll_f189_item_utilizations"], {"utilization_id": "utilization_id",
                                                   "utilization_code": "utilization_code"})
    return base.join(small(rfo), "cfo_id", "left").join(small(riu), "utilization_id", "left")


def _reached(inv_keys: DataFrame, reo: DataFrame, *columns: str) -> DataFrame:
    """The invoices that an operation reaches, with its organisation: only their lines can appear."""
    return (inv_keys.where(F.col("invoice_id").isNotNull()).join(reo.select(*OP_KEYS).distinct(), OP_KEYS, "left_semi")
            .select(*columns).distinct())


def receiving_lines(t: Mapping[str, DataFrame], skew_safe: bool = True) -> DataFrame:
    """The base relation (the source's CTE) with the columns the report uses.

    ``skew_safe``: write the fan-out left joins so that adaptive
    execution can split a hot invoice / shipment on either side (turn off only for data known to be even).
    """
    c = F.col
    reo = _operations(t)
    ops = reo.join(_organisations(t), "reo_org", "left")
    inv_keys, inv = _invoices(t)
    inv = spread_nulls(_typed(t, inv), _e_invoices(t), ["eletronic_invoice_key"], spread=["invoice_id", "ri"])
    # many invoices may share one operation
    heads = left_join_split(ops, inv, OP_KEYS, right_keys=inv_keys, left_keys=reo) if skew_safe else ops.join(inv, OP_KEYS, "left")
    reached = _reached(inv_keys, reo, "invoice_id", "reo_org")
    lines = _line_grain(t, reached, skew_safe)

    # operation ⟕ invoice ⟕ lines: the wide invoice columns meet the lines last.  Holds are counted for the
    # reached invoices, so they join on the key that the lines join on (0, not NULL, also without an invoice)
    line_keys = ["invoice_id", "reo_org"]
    holds = reached.join(hold_counts(t["cll_f189_holds"]), "invoice_id", "left")
    known = heads.where(c("invoice_id").isNotNull()).join(holds, line_keys, "left")
    if skew_safe:
        without = reached.join(_invoice_lines(t).select("invoice_id").distinct(), "invoice_id", "left_anti")
        base = known.join(with_missing(lines, without, line_keys), line_keys, "inner")
    else:
        base = known.join(lines, line_keys, "left")
    empty = heads.where(c("invoice_id").isNull())
    base = base.unionByName(empty, allowMissingColumns=True).withColumn("hold_count", F.coalesce(c("hold_count"), F.lit(0)))
    return _codes(t, base)  # code tables of the line, after the last exchange


def _ranges(lines: DataFrame, ops: DataFrame) -> list | None:
    """Operation ids at which a new range of the report begins, each range about ``RANGE_ROWS`` rows; ``None`` if one
    operation would fill ``HOT_RANGES`` of them.

    They come from a sample of the operations and of the ``lines`` with their deliveries, as those of a range sort do; no row
    of the report depends on it."""
    rows = lines.count() + ops.count()
    share = min(1.0, min(max(rows // SAMPLED, 100_000), 1_000_000) / max(rows, 1))
    sampled = lines.select("ri").unionByName(ops.select("ri")).sample(share, SEED).where(F.col("ri").isNotNull())
    full = max(RANGE_ROWS * share, 20)
    starts, held = [], 0
    for ri, n in sampled.groupBy("ri").agg(F.count(F.lit(1)).alias("n")).orderBy("ri").collect():
        if n >= HOT_RANGES * full:
            return None
        if held >= full:
            starts.append(ri)
            held = 0
        held += n
    return starts


def _range_of(key, starts: list):
    """Number of ``starts`` (in order) that are not above ``key``, by halving; NULL keys come last."""
    halves = [1 << i for i in reversed(range(len(starts).bit_length()))]
    found = F.aggregate(F.lit(halves), F.lit(0), lambda n, half: F.when(F.get(F.lit(starts), n + half - 1) <= key, n + half).otherwise(n))
    return F.when(key.isNull(), F.lit(len(starts))).otherwise(found)


def _sorted_lines(t: Mapping[str, DataFrame]) -> DataFrame | None:
    """``receiving_lines`` with its rows dealt to partitions by ranges of operations, in order; ``None`` if all fit one range or
    one operation is too large for it (a range sort can split that one).

    A range sort behind the joins moves every wide row once more than the joins do.  Here each side of the last joins - operations,
    invoices, e-invoices, holds, lines, order headers of a range's lines - is dealt to the ranges while it is narrow, and they meet
    there.  The lines are stored before, so that what was shuffled for them is gone when the sides are dealt."""
    c = F.col
    ops = _operations(t)
    inv_keys, inv = _invoices(t)
    reached = stored(_reached(inv_keys, ops, "invoice_id", *OP_KEYS), "reached")
    lines = stored(_line_grain(t, reached, narrow=True).drop("line_location_id"), "lines")
    starts = _ranges(lines, ops)
    if not starts or ops.sparkSession.conf.get(ALL_KEYS, "false") == "true":
        return None

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("part", _range_of(c("ri"), starts))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartitionById(len(starts) + 1, c("part"))

    at = ["part", *OP_KEYS]
    of_parts = placed(lines.select("ri", "po_header_id").where(c("po_header_id").isNotNull())).select("part", "po_header_id").distinct()
    lines = dealt(placed(lines)).join(dealt(of_parts.join(_order_headers(t), "po_header_id")), ["part", "po_header_id"], "left")
    e_keys = inv.select("ri", "eletronic_invoice_key").where(c("ri").isNotNull() & c("eletronic_invoice_key").isNotNull()).distinct()
    e_invoices = placed(e_keys.join(_e_invoices(t), "eletronic_invoice_key"))
    holds = placed(reached.join(stored(hold_counts(t["cll_f189_holds"]), "holds"), "invoice_id"))
    base = (dealt(placed(ops)).join(dealt(placed(inv)), at, "left")
            .join(dealt(e_invoices), ["part", "ri", "eletronic_invoice_key"], "left")
            .join(dealt(holds), [*at, "invoice_id"], "left").join(lines, [*at, "invoice_id"], "left"))
    base = _typed(t, base).join(F.broadcast(_organisations(t)), "reo_org", "left")
    return _codes(t, base.withColumn("hold_count", F.coalesce(c("hold_count"), F.lit(0))), F.broadcast)


def scope_to_operations(t: Mapping[str, DataFrame], operations: DataFrame) -> dict[str, DataFrame]:
    """The tables restricted to what ``operations`` (rows of
    ``cll_f189_entry_operations``) can reach: their invoices and e-invoices, those
    invoices' lines and holds, the shipments, order headers, deliveries and items
    of those lines.

    Each step is a semi join whose scoping side is derived from the operations.  Their
    keys, invoices and lines are stored in the shared folder as they are reached, so each next
    step knows their size: that of a handful of operations is broadcast and the large
    tables are filtered while scanned, instead of being shuffled whole.
    """
    c = F.col
    out = dict(t)
    out["cll_f189_entry_operations"] = operations
    op_keys = stored(operations.select("operation_id", "organization_id").distinct(), "operations")
    inv = stored(t["cll_f189_invoices"].join(op_keys, ["operation_id", "organization_id"], "left_semi"), "invoices")
    out["cll_f189_invoices"] = inv
    inv_ids = inv.select("invoice_id").distinct()
    lines = stored(t["cll_f189_invoice_lines"].join(inv_ids, "invoice_id", "left_semi"), "lines")
    out["cll_f189_invoice_lines"] = lines
    out["cll_f189_holds"] = t["cll_f189_holds"].join(inv_ids, "invoice_id", "left_semi")
    keys = inv.select(c("eletronic_invoice_key").alias("chave")).where(c("chave").isNotNull()).distinct()
    out["nfee_header_xml"] = t["nfee_header_xml"].join(keys, "chave", "left_semi")
    locs = lines.select("line_location_id").where(c("line_location_id").isNotNull()).distinct()
    pll = t["po_line_locations_all"].join(locs, "line_location_id", "left_semi")
    out["po_line_locations_all"] = pll
    heads = pll.select("po_header_id").where(c("po_header_id").isNotNull()).distinct()
    out["po_headers_all"] = t["po_headers_all"].join(heads, "po_header_id", "left_semi")
    out["rcv_transactions"] = t["rcv_transactions"].join(
        locs.withColumnRenamed("line_location_id", "po_line_location_id"), "po_line_location_id", "left_semi")
    items = lines.select(c("item_id").alias("inventory_item_id")).where(c("inventory_item_id").isNotNull()).distinct()
    out["mtl_system_items"] = t["mtl_system_items"].join(items, "inventory_item_id", "left_semi")
    return out


def receiving_diagnosis(t: Mapping[str, DataFrame], ri=None, org: str | None = None, language: str = "PTB",
                        sort: bool = True, skew_safe: bool = True) -> DataFrame:
    """The 44-column diagnosis.

    ``ri``: one operation id, a list, or a DataFrame whose first column holds them
    (``None`` = all); ``org``: organisation code (``None`` = all).  With ``ri``, every table is first restricted to what
    those operations reach (``scope_to_operations``), so a report on one
    operation does not join the whole invoice-line and shipment tables.
    ``sort``: order by operation and invoice line, NULLs last.
    """
    c = F.col
    table = ri if isinstance(ri, DataFrame) else None
    ids = None if ri is None or table is not None else [int(i) for i in ([ri] if isinstance(ri, (int, str)) else ri)]
    if ri is not None or org is not None:
        ops = t["cll_f189_entry_operations"]
        if ids is not None:
            ops = ops.where(c("operation_id").isin(*ids))
        elif table is not None:
            wanted = table.select(c(table.columns[0]).cast("long").alias("operation_id"))
            ops = ops.join(wanted.where(c("operation_id").isNotNull()).distinct(), "operation_id", "left_semi")
        if org is not None:
            orgs = t["mtl_parameters"].where(c("organization_code") == org).select("organization_id")
            ops = ops.join(orgs, "organization_id", "left_semi")
        # explicit operation ids are few: cut every table to what they reach.  An
        # organisation alone may hold a large share of the operations, where the
        # chain of semi joins would cost more than it saves: filter only the driver.
        t = scope_to_operations(t, ops) if ri is not None else {**dict(t), "cll_f189_entry_operations": ops}
    # a report of given operations is small; a whole one is sorted by dealing its sides to ranges of operations
    ranged = _sorted_lines(t) if sort and skew_safe and ri is None else None
    b = receiving_lines(t, skew_safe) if ranged is None else ranged
    small = (lambda df: df) if ranged is None else F.broadcast
    if ids is not None:
        b = b.where(c("ri").isin(*ids))
    if org is not None:
        b = b.where(c("org") == org)
    rrh = _rename(lookup_values(t["fnd_lookup_values"], "RCV_ROUTING_HEADERS", language),
                  {"lookup_code": "rrh_code", "meaning": "roteiro_po"})
    rrh_item = _rename(lookup_values(t["fnd_lookup_values"], "RCV_ROUTING_HEADERS", language),
                       {"lookup_code": "rrh_item_code", "meaning": "roteiro_item"})
    awt = _rename(t["ap_awt_groups"], {"group_id": "awt_group", "name": "grupo_retencao"})
    b = (b.join(small(rrh), c("roteiro_po_id") == code_number(c("rrh_code")), "left")
          .join(small(rrh_item), c("roteiro_item_id") == code_number(c("rrh_item_code")), "left")
          .join(small(awt), c("awt_group_id") == c("awt_group"), "left"))
    if sort:
        # the source orders by operation and invoice line; the delivery transaction
        # only breaks ties the source leaves open, so range partitioning can split
        # a line that fans out over many deliveries
        order = [c("ri").asc_nulls_last(), c("invoice_line_id").asc_nulls_last(), c("transaction_id").asc_nulls_last()]
        b = b.orderBy(*order) if ranged is None else b.sortWithinPartitions(*order)
    # the derived texts are worked out behind the sort, so they are not moved by it
    return recommended_action(diagnosis_status(link_flags(b))).select(*OUTPUT)
