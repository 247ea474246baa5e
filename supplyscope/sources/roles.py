"""Source tables in the reports' shape, derived from the driver's test tables.

The test data is a TPC-H-like star schema plus an ``events`` table; the reports
read ERP purchasing / receiving tables.  Each role below maps one report table onto
the test tables with plain DataFrame expressions (filters, projections, a few
joins and group-bys), so the size of every role grows with the scale factor.
The identical mapping is written as DuckDB SQL in ``roles_sql.py``; keep the two
in step.

The few modulo rules below (e.g. an invoice whose ids match nothing for every 7th
order, a NULL purchase order on every 11th shipment, a reversed operation on every
17th) create the missing links and NULL paths the reports exist to diagnose; the test
tables have none.  They break a row's key (``_broken``, or another organisation) or blank
a column and keep the row, so every query reads, joins and aggregates all rows.

Mapping (all keys are derived, nothing is sampled):

* purchase order header = order; lines and shipments = lineitem grouped by
  ``(l_orderkey, l_linenumber)`` (the pair is not unique in the data); every
  lineitem row is a distribution
* requisition link = lineitem with ``l_discount >= 0.04``
* receiving transactions = lineitem with ``l_linestatus = 'F'``; receipt headers = orders
* receiving operations / invoices = orders; invoice lines = lineitem; holds = error events
* action history = events (``purchase`` → APPROVE) and three actions of every order: submitted, approved or
  rejected, and approved once more (every 23rd approved order, which then has two last approvers) or forwarded
* people = suppliers, effective dated
* vendors, sites, accounts = suppliers; items, categories, projects = parts
* lookups, operating units, organisations = nation / region
* contract catalogue = lineitem x part x supplier
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplyscope.operators.lookups import first_row
from supplyscope.sources.tables import LazyTables, parquet_tables

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Fixed values of the mapping (shared with roles_sql.py).
N_ORGS = 25          # organisations = nations
N_VENDORS = 100      # vendor of an order = o_orderkey % 100
N_AGENTS = 100       # buyer of an order = o_custkey % 100
PEOPLE_EPOCH = _dt.date(1995, 1, 1)
LINES_A_TASK = 500_000  # lineitem rows that one task groups into shipments


def _c(name: str):
    return F.col(name)


def _key(order: str = "l_orderkey", line: str = "l_linenumber"):
    """line / shipment / location id of a lineitem: order * 10 + line number."""
    return _c(order) * 10 + _c(line)


def _broken(key, broken):
    """``key``, or where ``broken`` an id that no other table holds: the row stays, its link does not."""
    return F.when(broken, -key - 1).otherwise(key)


def _plus_seconds(ts: str, secs):
    return _c(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)


def _plus_days(ts: str, days: int):
    return _c(ts) + F.make_dt_interval(F.lit(days))


def role_tables(spark: SparkSession, sf_dir: str) -> LazyTables:
    base = parquet_tables(spark, sf_dir, BASE_TABLES)
    b: dict = {}

    # ---------------------------------------------------------------- purchasing
    def po_headers_all() -> DataFrame:
        o = base["orders"]
        return o.select(
            _c("o_orderkey").alias("po_header_id"),
            _c("o_orderkey").cast("string").alias("segment1"),
            F.when(_c("o_orderpriority").isin("1-URGENT", "2-HIGH"), "STANDARD")
             .when(_c("o_orderpriority") == "3-MEDIUM", "BLANKET")
             .when(_c("o_orderpriority") == "4-NOT SPECIFIED", "PLANNED")
             .otherwise("CONTRACT").alias("type_lookup_code"),
            F.when(_c("o_orderstatus") == "F", "APPROVED")
             .when(_c("o_orderstatus") == "O", "IN PROCESS")
             .otherwise("REQUIRES REAPPROVAL").alias("authorization_status"),
            _plus_seconds("o_orderdate", _c("o_orderkey") % 86400).alias("approved_date"),
            _c("o_orderdate").alias("creation_date"),
            (_c("o_custkey") % N_ORGS).alias("org_id"),
            (_c("o_custkey") % N_AGENTS).alias("agent_id"),
            (_c("o_orderkey") % N_VENDORS).alias("vendor_id"),
            (_c("o_orderkey") % N_VENDORS).alias("vendor_site_id"),
            F.when(_c("o_custkey") % 2 == 0, "CIF").otherwise("FOB").alias("fob_lookup_code"),
            F.lit("BRL").alias("currency_code"),
        )

    def _parts(*cols: str) -> DataFrame:
        # one row per key, stated as an aggregate: the optimiser then drops the left join for readers of no part column
        return first_row(base["part"], ["p_partkey"], cols)

    parts: list[int] = []

    def _shipment_parts() -> int:
        # follows the rows (a count from the files' footers), so that no task's aggregate grows with the table
        if not parts:
            parts.append(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-base["lineitem"].count() // LINES_A_TASK)))
        return parts[0]

    def _shipment_base(dealt) -> DataFrame:
        # dealt by a key of the group that the readers join on: the aggregate and that join need no further exchange,
        # and no map task holds a table of its rows' keys, which hardly repeat.  The number is given, so that adaptive
        # execution does not merge parts that are small as stored bytes and large as keys of an aggregate
        li = base["lineitem"].repartition(_shipment_parts(), dealt).withColumn("id", _key())
        g = li.groupBy("id", "l_orderkey", "l_linenumber").agg(
            F.min("l_partkey").alias("item_id"),
            F.min("l_suppkey").alias("supp"),
            F.sum("l_quantity").alias("quantity"),
            F.sum(F.when(_c("l_linestatus") == "F", _c("l_quantity")).otherwise(F.lit(0.0))).alias("quantity_received"),
            F.min("l_extendedprice").alias("unit_price"),
            F.min("l_shipdate").alias("promised_date"),
            F.max("l_shipdate").alias("need_by_date"),
        )
        p = _parts("p_name", "p_brand", "p_size")
        return g.join(p, g.item_id == p.p_partkey, "left")

    def po_lines_all() -> DataFrame:
        s = _shipment_base(_c("l_orderkey"))
        return s.select(
            _c("id").alias("po_line_id"),
            _c("l_orderkey").alias("po_header_id"),
            _c("l_linenumber").cast("long").alias("line_num"),
            _c("item_id"),
            _c("item_id").alias("category_id"),
            F.when(_c("p_size") % 10 == 0, F.translate("p_name", " ", "\t")).otherwise(_c("p_name")).alias("item_description"),
            F.lit("UN").alias("unit_meas_lookup_code"),
            F.when(_c("p_size") % 2 == 0, _c("l_orderkey") - 1).alias("contract_id"),
            F.when(_c("p_size") % 4 != 0, (_c("l_orderkey") - 1).cast("string")).alias("contract_num"),
            _c("p_brand").alias("vendor_product_num"),
            _c("unit_price"),
            F.when(_c("p_brand") == "Brand#1", F.lit("abc")).otherwise(_c("p_size").cast("string")).alias("attribute3"),
            F.when(_c("l_linenumber") == 7, F.lit("Y")).when(_c("l_linenumber") == 6, F.lit("N")).alias("cancel_flag"),
        )

    def po_line_locations_all() -> DataFrame:
        s = _shipment_base(_key())
        return s.select(
            _c("id").alias("line_location_id"),
            _c("id").alias("po_line_id"),
            F.when(_c("l_orderkey") % 11 != 0, _c("l_orderkey")).alias("po_header_id"),
            _c("l_orderkey").alias("po_release_id"),
            F.lit(1).cast("long").alias("shipment_num"),
            (_c("supp") % N_ORGS).alias("ship_to_organization_id"),
            (_c("l_linenumber") % 4).cast("long").alias("receiving_routing_id"),
            _c("quantity"),
            _c("quantity_received"),
            _c("l_linenumber").cast("double").alias("qty_rcv_tolerance"),
            _c("promised_date"),
            _c("need_by_date"),
        )

    def po_distributions_all() -> DataFrame:
        return base["lineitem"].select(
            _key().alias("line_location_id"),
            (_c("l_suppkey") % 20).alias("code_combination_id"),
            _c("l_partkey").alias("project_id"),
        )

    def gl_code_combinations() -> DataFrame:
        s = base["supplier"]
        return s.select(
            _c("s_suppkey").alias("code_combination_id"),
            F.concat(F.lit("C"), _c("s_nationkey").cast("string")).alias("segment1"),
            F.concat(F.lit("U"), (_c("s_suppkey") % 7).cast("string")).alias("segment2"),
            F.concat(F.lit("4"), _c("s_suppkey").cast("string")).alias("segment3"),
            F.when(_c("s_suppkey") % 3 != 0, F.concat(F.lit("CC"), (_c("s_suppkey") % 9).cast("string"))).alias("segment4"),
        )

    def pa_projects_all() -> DataFrame:
        p = base["part"]
        return p.select(
            _broken(_c("p_partkey"), _c("p_size") % 3 != 0).alias("project_id"),
            F.concat(F.lit("PRJ"), _c("p_partkey").cast("string")).alias("segment1"),
        )

    def mtl_categories() -> DataFrame:
        p = base["part"]
        return p.select(
            _c("p_partkey").alias("category_id"),
            F.when(_c("p_type") == "PROMO", "SE").when(_c("p_type") == "ECONOMY", "SV")
             .when(_c("p_type") == "SMALL", "SM").when(_c("p_type") == "LARGE", F.lit(None))
             .otherwise(_c("p_type")).alias("segment1"),
            _c("p_brand").alias("segment2"),
            F.when(_c("p_size") % 5 != 0, _c("p_size").cast("string")).alias("segment3"),
            F.lit(None).cast("string").alias("segment4"),
            F.when(_c("p_size") > 25, F.lit("BIG")).alias("segment5"),
        )

    def po_requisition_lines_all() -> DataFrame:
        return base["lineitem"].where(_c("l_discount") >= 0.04).select(_key().alias("line_location_id"))

    def po_releases_all() -> DataFrame:
        o = base["orders"]
        return o.where(_c("o_orderpriority").isin("3-MEDIUM", "4-NOT SPECIFIED")).select(
            _c("o_orderkey").alias("po_release_id"),
            _c("o_orderkey").alias("po_header_id"),
            (_c("o_custkey") % 7).alias("release_num"),
            _plus_days("o_orderdate", 1).alias("approved_date"),
        )

    def po_vendors() -> DataFrame:
        return base["supplier"].select(_c("s_suppkey").alias("vendor_id"), _c("s_name").alias("vendor_name"))

    def po_vendor_sites_all() -> DataFrame:
        s = base["supplier"]
        k = _c("s_suppkey")
        return s.select(
            k.alias("vendor_site_id"),
            k.alias("vendor_id"),
            F.when(k % 8 == 5, F.lit("zz")).when(k % 8 == 6, F.lit("02")).otherwise((k % 4).cast("string")).alias("global_attribute9"),
            F.concat(F.lit("000"), k.cast("string")).alias("global_attribute10"),
            F.when(k % 3 != 0, F.lit("0001")).alias("global_attribute11"),
            _c("s_nationkey").cast("string").alias("global_attribute12"),
            F.concat(F.lit("CITY_"), _c("s_nationkey").cast("string")).alias("city"),
            F.concat(F.lit("UF"), (_c("s_nationkey") % 9).cast("string")).alias("address_line4"),
        )

    def mtl_system_items_b() -> DataFrame:
        li = base["lineitem"].where(_c("l_tax") >= 0.02)
        keys = li.select(_c("l_partkey").alias("inventory_item_id"),
                         (_c("l_suppkey") % N_ORGS).alias("organization_id")).distinct()
        p = _parts("p_type")
        return keys.join(p, keys.inventory_item_id == p.p_partkey, "left").select(
            "inventory_item_id", "organization_id",
            F.concat(F.lit("IT"), _c("inventory_item_id").cast("string")).alias("segment1"),
            _c("p_type").alias("item_type"),
            (_c("inventory_item_id") % 4).alias("receiving_routing_id"),
        )

    def fnd_lookup_values() -> DataFrame:
        r = base["region"]
        ptb = r.select(F.lit("RCV_ROUTING_HEADERS").alias("lookup_type"),
                       (_c("r_regionkey") + 1).cast("string").alias("lookup_code"),
                       F.lit("PTB").alias("language"), _c("r_name").alias("meaning"))
        us = r.select(F.lit("RCV_ROUTING_HEADERS").alias("lookup_type"),
                      (_c("r_regionkey") + 1).cast("string").alias("lookup_code"),
                      F.lit("US").alias("language"), F.lower("r_name").alias("meaning"))
        types = base["part"].select(_c("p_type").alias("lookup_code")).distinct()
        it_ptb = types.select(F.lit("ITEM_TYPE").alias("lookup_type"), "lookup_code",
                              F.lit("PTB").alias("language"), F.lower("lookup_code").alias("meaning"))
        it_us = types.select(F.lit("ITEM_TYPE").alias("lookup_type"), "lookup_code",
                             F.lit("US").alias("language"), _c("lookup_code").alias("meaning"))
        return ptb.unionByName(us).unionByName(it_ptb).unionByName(it_us)

    def hr_operating_units() -> DataFrame:
        n = base["nation"]
        return n.select(_c("n_nationkey").cast("long").alias("organization_id"),
                        F.when(_c("n_nationkey") == 24, F.lit("XY")).otherwise(_c("n_name")).alias("name"))

    def org_organization_definitions() -> DataFrame:
        n = base["nation"]
        return n.select(_c("n_nationkey").cast("long").alias("organization_id"),
                        F.concat(F.lit("ORG"), _c("n_nationkey").cast("string")).alias("organization_code"))

    def _catalog_base() -> DataFrame:
        li = base["lineitem"].where(_c("l_linestatus") == "O").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_tax")
        p = base["part"].select("p_partkey", "p_brand", "p_size")
        s = base["supplier"].select("s_suppkey", "s_name")
        j = li.join(p, li.l_partkey == p.p_partkey, "inner")
        j = j.join(s, (j.l_orderkey % N_VENDORS) == s.s_suppkey, "inner")
        return j

    def icx_cat_items_b() -> DataFrame:
        return _catalog_base().select(
            _key().alias("rt_item_id"),
            (_c("l_orderkey") - 1).cast("string").alias("supplier_part_auxid"),
            _c("s_name").alias("supplier"),
            _c("p_brand").alias("supplier_part_num"),
        )

    def icx_cat_items_tlp() -> DataFrame:
        c = _catalog_base()
        ptb = c.select(_key().alias("rt_item_id"), F.lit("PTB").alias("language"),
                       _c("p_size").cast("double").alias("lead_time"))
        us = c.select(_key().alias("rt_item_id"), F.lit("US").alias("language"),
                      (_c("p_size") + 100).cast("double").alias("lead_time"))
        return ptb.unionByName(us)

    def icx_cat_item_prices() -> DataFrame:
        return _catalog_base().where(_c("l_tax") >= 0.02).select(_key().alias("rt_item_id"))

    def per_all_people_f() -> DataFrame:
        s = base["supplier"]
        k = _c("s_suppkey")
        return s.select(
            _broken(k, k % 10 == 0).alias("person_id"),
            F.date_add(F.lit(PEOPLE_EPOCH), (k * 20).cast("int")).alias("effective_start_date"),
            F.date_add(F.lit(PEOPLE_EPOCH), (k * 40 + 400).cast("int")).alias("effective_end_date"),
            _c("s_name").alias("last_name"),
            F.when(k % 4 != 0, F.concat(F.lit("A"), _c("s_nationkey").cast("string"))).alias("attribute7"),
            F.when(k % 5 != 0, F.lit("B")).alias("attribute8"),
        )

    def po_action_history() -> DataFrame:
        e, o = base["events"], base["orders"]
        kind = (F.when(_c("o_orderpriority").isin("1-URGENT", "2-HIGH"), "PO")
                .when(_c("o_orderpriority").isin("3-MEDIUM", "4-NOT SPECIFIED"), "RELEASE").otherwise("PA"))
        done = _c("o_orderstatus") == "F"
        twice = done & (_c("o_orderkey") % 23 == 0)

        def step(object_type, action, sequence: int, shift: int) -> DataFrame:
            return o.select(_c("o_orderkey").alias("object_id"), object_type.alias("object_type_code"),
                            action.alias("action_code"), F.lit(sequence).cast("long").alias("sequence_num"),
                            ((_c("o_custkey") + shift) % N_AGENTS).alias("employee_id"))

        of_events = e.select(
            _c("user_id").alias("object_id"),
            F.when(_c("user_id") % 3 == 0, "RELEASE").when(_c("user_id") % 3 == 1, "PO").otherwise("PA").alias("object_type_code"),
            F.when(_c("event_type") == "purchase", "APPROVE").otherwise(F.upper("event_type")).alias("action_code"),
            _c("event_id").alias("sequence_num"),
            F.get_json_object("props", "$.k").try_cast("long").alias("employee_id"),
        )
        return (of_events.unionByName(step(kind, F.lit("SUBMIT"), 1, 0))
                .unionByName(step(kind, F.when(done, "APPROVE").otherwise("REJECT"), 2, 7))
                .unionByName(step(F.lit("PA"), F.when(twice, "APPROVE").otherwise("FORWARD"), 2, 8)))

    # ----------------------------------------------------------------- receiving
    def _operations() -> DataFrame:
        o = base["orders"]
        return o.select(
            _c("o_orderkey").alias("operation_id"),
            (_c("o_custkey") % N_ORGS).alias("organization_id"),
            F.when(_c("o_orderstatus") == "F", "COMPLETE").when(_c("o_orderstatus") == "O", "APPROVED")
             .otherwise("IN PROCESS").alias("status"),
            _c("o_orderdate").alias("receive_date"),
            _plus_days("o_orderdate", 1).alias("gl_date"),
            F.when(_c("o_orderkey") % 17 == 0, F.lit("Y")).alias("reversion_flag"),
        )

    def rec_entry_operations() -> DataFrame:
        other = F.when(_c("operation_id") % 13 == 0, _c("organization_id") + N_ORGS).otherwise(_c("organization_id"))
        return _operations().withColumn("organization_id", other)

    def _invoices() -> DataFrame:
        o = base["orders"]
        price = _c("o_totalprice")
        key = _broken(_c("o_orderkey"), _c("o_orderkey") % 7 == 0)
        return o.select(
            key.alias("invoice_id"),
            key.alias("operation_id"),
            (_c("o_custkey") % N_ORGS).alias("organization_id"),
            (_c("o_orderkey") % 5).alias("invoice_type_id"),
            (_c("o_orderkey") % 1000).alias("invoice_num"),
            (_c("o_orderkey") % 3).cast("string").alias("series"),
            _c("o_orderdate").alias("invoice_date"),
            _plus_days("o_orderdate", 3).alias("creation_date"),
            price.alias("invoice_amount"),
            (_c("o_orderkey") % N_VENDORS).alias("entity_id"),
            price.alias("ir_base"), F.lit(1.5).alias("ir_tax"), (price * 0.015).alias("ir_amount"),
            price.alias("inss_base"), F.lit(11.0).alias("inss_tax"), (price * 0.11).alias("inss_amount"),
            price.alias("iss_base"), F.lit(5.0).alias("iss_tax"), (price * 0.05).alias("iss_amount"),
            F.concat(F.lit("NFE"), _c("o_orderkey").cast("string")).alias("eletronic_invoice_key"),
        )

    def _invoice_types() -> DataFrame:
        o = base["orders"]
        keys = o.select((_c("o_orderkey") % 5).alias("invoice_type_id"),
                        (_c("o_custkey") % N_ORGS).alias("organization_id")).distinct()
        tid = _c("invoice_type_id")
        return keys.select(
            "invoice_type_id", "organization_id",
            F.when(tid == 4, F.lit("Y")).when(tid != 3, F.lit("N")).alias("parent_flag"),
            F.concat(F.lit("T"), tid.cast("string")).alias("invoice_type_code"),
            F.concat(F.lit("TIPO "), tid.cast("string")).alias("description"),
            F.when(tid <= 2, F.lit("PO")).when(tid == 3, F.lit("NA")).alias("requisition_type"),
        )

    def rec_invoice_lines() -> DataFrame:
        return base["lineitem"].where(_c("l_returnflag") != "R").select(
            _c("l_orderkey").alias("invoice_id"), _key().alias("line_location_id"), _c("l_quantity").alias("quantity"))

    def cll_f189_invoice_lines() -> DataFrame:
        li = base["lineitem"]
        return li.select(
            _key().alias("invoice_line_id"),
            _c("l_orderkey").alias("invoice_id"),
            _c("l_quantity").alias("quantity"),
            _c("l_partkey").alias("item_id"),
            F.when(_c("l_linenumber") != 7, _key()).alias("line_location_id"),
            F.concat("l_returnflag", "l_linestatus").alias("operation_fiscal_type"),
            (_c("l_suppkey") % 30).alias("awt_group_id"),
            _c("l_linenumber").cast("long").alias("cfo_id"),
            (_c("l_partkey") % 6).alias("utilization_id"),
        )

    def rcv_shipment_headers() -> DataFrame:
        o = base["orders"]
        k = _c("o_orderkey")
        ks = k.cast("string")
        return o.select(
            k.alias("shipment_header_id"),
            F.when(k % 10 == 3, F.concat(F.lit(" "), ks, F.lit(" ")))
             .when(k % 10 == 7, F.concat(F.lit("R"), ks))
             .when(k % 10 == 9, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("000"), ks)).alias("receipt_num"),
        )

    def rcv_transactions() -> DataFrame:
        li = base["lineitem"].where(_c("l_linestatus") == "F")
        return li.select(
            _key().alias("transaction_id"),
            _key().alias("po_line_location_id"),
            _key().alias("po_line_id"),
            _c("l_orderkey").alias("shipment_header_id"),
            F.when(_c("l_returnflag") == "A", "RECEIVE").when(_c("l_returnflag") == "N", "DELIVER")
             .otherwise("RETURN").alias("transaction_type"),
            _plus_seconds("l_shipdate", _c("l_partkey") % 86400).alias("transaction_date"),
            _c("l_quantity").alias("quantity"),
        )

    def cll_f189_fiscal_operations() -> DataFrame:
        n = base["nation"]
        return n.select(_c("n_nationkey").cast("long").alias("cfo_id"),
                        F.concat(F.lit("1."), _c("n_nationkey").cast("string")).alias("cfo_code"))

    def cll_f189_item_utilizations() -> DataFrame:
        r = base["region"]
        return r.select(_c("r_regionkey").cast("long").alias("utilization_id"), _c("r_name").alias("utilization_code"))

    def cll_f189_fiscal_entities_all() -> DataFrame:
        s = base["supplier"]
        return s.select(_broken(_c("s_suppkey"), _c("s_suppkey") % 9 == 0).alias("entity_id"), _c("s_suppkey").alias("vendor_site_id"))

    def mtl_parameters() -> DataFrame:
        return org_organization_definitions()

    def nfee_header_xml() -> DataFrame:
        o = base["orders"]
        series = F.when(_c("o_orderkey") % 5 == 0, "NFX").otherwise("NFE")
        return o.select(F.concat(series, _c("o_orderkey").cast("string")).alias("chave"),
                        F.when(_c("o_orderstatus") == "F", "AUTORIZADA").otherwise("PENDENTE").alias("status"))

    def cll_f189_holds() -> DataFrame:
        return base["events"].where(_c("event_type") == "error").select(_c("user_id").alias("invoice_id"))

    def ap_awt_groups() -> DataFrame:
        n = base["nation"]
        return n.select(_c("n_nationkey").cast("long").alias("group_id"),
                        F.concat(F.lit("AWT "), _c("n_name")).alias("name"))

    b.update({
        "po_headers_all": po_headers_all,
        "po_lines_all": po_lines_all,
        "po_line_locations_all": po_line_locations_all,
        "po_distributions_all": po_distributions_all,
        "gl_code_combinations": gl_code_combinations,
        "pa_projects_all": pa_projects_all,
        "mtl_categories": mtl_categories,
        "po_requisition_lines_all": po_requisition_lines_all,
        "po_releases_all": po_releases_all,
        "po_vendors": po_vendors,
        "po_vendor_sites_all": po_vendor_sites_all,
        "mtl_system_items_b": mtl_system_items_b,
        "mtl_system_items": mtl_system_items_b,
        "fnd_lookup_values": fnd_lookup_values,
        "hr_operating_units": hr_operating_units,
        "org_organization_definitions": org_organization_definitions,
        "icx_cat_items_b": icx_cat_items_b,
        "icx_cat_items_tlp": icx_cat_items_tlp,
        "icx_cat_item_prices": icx_cat_item_prices,
        "per_all_people_f": per_all_people_f,
        "po_action_history": po_action_history,
        "rec_entry_operations": rec_entry_operations,
        "rec_invoices": _invoices,
        "rec_invoice_types": _invoice_types,
        "rec_invoice_lines": rec_invoice_lines,
        "rcv_shipment_headers": rcv_shipment_headers,
        "rcv_transactions": rcv_transactions,
        "cll_f189_entry_operations": _operations,
        "cll_f189_invoices": _invoices,
        "cll_f189_invoice_lines": cll_f189_invoice_lines,
        "cll_f189_invoice_types": _invoice_types,
        "cll_f189_fiscal_operations": cll_f189_fiscal_operations,
        "cll_f189_item_utilizations": cll_f189_item_utilizations,
        "cll_f189_fiscal_entities_all": cll_f189_fiscal_entities_all,
        "mtl_parameters": mtl_parameters,
        "nfee_header_xml": nfee_header_xml,
        "cll_f189_holds": cll_f189_holds,
        "ap_awt_groups": ap_awt_groups,
    })
    # the raw test tables stay reachable too (documents / conversations queries)
    for name in BASE_TABLES:
        b[name] = (lambda n=name: base[n])
    return LazyTables(b)


REPORT_ROLES = [
    "po_headers_all", "po_lines_all", "po_line_locations_all", "po_distributions_all", "gl_code_combinations",
    "pa_projects_all", "mtl_categories", "po_requisition_lines_all", "po_releases_all", "po_vendors",
    "po_vendor_sites_all", "mtl_system_items_b", "fnd_lookup_values", "hr_operating_units",
    "org_organization_definitions", "icx_cat_items_b", "icx_cat_items_tlp", "icx_cat_item_prices",
    "per_all_people_f", "po_action_history", "rec_entry_operations", "rec_invoices", "rec_invoice_types",
    "rec_invoice_lines", "rcv_shipment_headers", "rcv_transactions", "cll_f189_entry_operations",
    "cll_f189_invoices", "cll_f189_invoice_lines", "cll_f189_invoice_types", "cll_f189_fiscal_operations",
    "cll_f189_item_utilizations", "cll_f189_fiscal_entities_all", "nfee_header_xml", "cll_f189_holds",
    "ap_awt_groups",
]
ALIASES = {"mtl_system_items": "mtl_system_items_b", "mtl_parameters": "org_organization_definitions"}


def materialize_roles(spark: SparkSession, sf_dir: str, out_dir: str) -> LazyTables:
    """Write every role table as parquet under ``out_dir`` and return a mapping
    that reads them back — the shape a deployment has (the source tables stored
    once), so report timings exclude the synthetic derivation."""
    t = role_tables(spark, sf_dir)
    for name in REPORT_ROLES:
        t[name].write.mode("overwrite").parquet(f"{out_dir}/{name}")
    return stored_roles(spark, out_dir)


def stored_roles(spark: SparkSession, out_dir: str) -> LazyTables:
    """The role tables written by ``materialize_roles``."""
    stored = parquet_tables(spark, out_dir, REPORT_ROLES)
    builders = {n: (lambda n=n: stored[n]) for n in REPORT_ROLES}
    builders.update({a: (lambda a=a: stored[ALIASES[a]]) for a in ALIASES})
    return LazyTables(builders)
