"""The role mapping of ``roles.py`` written as DuckDB SQL CTEs (oracle side).

``with_roles(body, [names])`` prefixes a query with the CTEs it needs.  The base
test tables (orders, lineitem, …) are views registered by the caller.
"""

from __future__ import annotations

_KEY = "(l_orderkey * 10 + l_linenumber)"

ROLE_SQL: dict[str, str] = {
    "po_headers_all": """
        SELECT o_orderkey AS po_header_id,
               CAST(o_orderkey AS VARCHAR) AS segment1,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'STANDARD'
                    WHEN o_orderpriority = '3-MEDIUM' THEN 'BLANKET'
                    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'PLANNED'
                    ELSE 'CONTRACT' END AS type_lookup_code,
               CASE WHEN o_orderstatus = 'F' THEN 'APPROVED'
                    WHEN o_orderstatus = 'O' THEN 'IN PROCESS'
                    ELSE 'REQUIRES REAPPROVAL' END AS authorization_status,
               o_orderdate + to_seconds(o_orderkey % 86400) AS approved_date,
               o_orderdate AS creation_date,
               o_custkey % 25 AS org_id,
               o_custkey % 100 AS agent_id,
               o_orderkey % 100 AS vendor_id,
               o_orderkey % 100 AS vendor_site_id,
               CASE WHEN o_custkey % 2 = 0 THEN 'CIF' ELSE 'FOB' END AS fob_lookup_code,
               'BRL' AS currency_code
        FROM orders""",
    "r_shipment_base": """
        SELECT g.*, p.p_name, p.p_brand, p.p_size
        FROM (SELECT l_orderkey, l_linenumber,
                     min(l_partkey) AS item_id, min(l_suppkey) AS supp,
                     sum(l_quantity) AS quantity,
                     sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE CAST(0 AS DOUBLE) END) AS quantity_received,
                     min(l_extendedprice) AS unit_price,
                     min(l_shipdate) AS promised_date, max(l_shipdate) AS need_by_date
              FROM lineitem GROUP BY l_orderkey, l_linenumber) g
        LEFT JOIN part p ON g.item_id = p.p_partkey""",
    "po_lines_all": f"""
        SELECT {_KEY} AS po_line_id,
               l_orderkey AS po_header_id,
               CAST(l_linenumber AS BIGINT) AS line_num,
               item_id,
               item_id AS category_id,
               CASE WHEN p_size % 10 = 0 THEN translate(p_name, ' ', chr(9)) ELSE p_name END AS item_description,
               'UN' AS unit_meas_lookup_code,
               CASE WHEN p_size % 2 = 0 THEN l_orderkey - 1 END AS contract_id,
               CASE WHEN p_size % 4 <> 0 THEN CAST(l_orderkey - 1 AS VARCHAR) END AS contract_num,
               p_brand AS vendor_product_num,
               unit_price,
               CASE WHEN p_brand = 'Brand#1' THEN 'abc' ELSE CAST(p_size AS VARCHAR) END AS attribute3,
               CASE WHEN l_linenumber = 7 THEN 'Y' WHEN l_linenumber = 6 THEN 'N' END AS cancel_flag
        FROM r_shipment_base""",
    "po_line_locations_all": f"""
        SELECT {_KEY} AS line_location_id,
               {_KEY} AS po_line_id,
               CASE WHEN l_orderkey % 11 <> 0 THEN l_orderkey END AS po_header_id,
               l_orderkey AS po_release_id,
               CAST(1 AS BIGINT) AS shipment_num,
               supp % 25 AS ship_to_organization_id,
               CAST(l_linenumber % 4 AS BIGINT) AS receiving_routing_id,
               quantity, quantity_received,
               CAST(l_linenumber AS DOUBLE) AS qty_rcv_tolerance,
               promised_date, need_by_date
        FROM r_shipment_base""",
    "po_distributions_all": f"""
        SELECT {_KEY} AS line_location_id, l_suppkey % 20 AS code_combination_id, l_partkey AS project_id
        FROM lineitem""",
    "gl_code_combinations": """
        SELECT s_suppkey AS code_combination_id,
               'C' || CAST(s_nationkey AS VARCHAR) AS segment1,
               'U' || CAST(s_suppkey % 7 AS VARCHAR) AS segment2,
               '4' || CAST(s_suppkey AS VARCHAR) AS segment3,
               CASE WHEN s_suppkey % 3 <> 0 THEN 'CC' || CAST(s_suppkey % 9 AS VARCHAR) END AS segment4
        FROM supplier""",
    "pa_projects_all": """
        SELECT CASE WHEN p_size % 3 = 0 THEN p_partkey ELSE -p_partkey - 1 END AS project_id,
               'PRJ' || CAST(p_partkey AS VARCHAR) AS segment1
        FROM part""",
    "mtl_categories": """
        SELECT p_partkey AS category_id,
               CASE WHEN p_type = 'PROMO' THEN 'SE' WHEN p_type = 'ECONOMY' THEN 'SV'
                    WHEN p_type = 'SMALL' THEN 'SM' WHEN p_type = 'LARGE' THEN NULL
                    ELSE p_type END AS segment1,
               p_brand AS segment2,
               CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS VARCHAR) END AS segment3,
               CAST(NULL AS VARCHAR) AS segment4,
               CASE WHEN p_size > 25 THEN 'BIG' END AS segment5
        FROM part""",
    "po_requisition_lines_all": f"""
        SELECT {_KEY} AS line_location_id FROM lineitem WHERE l_discount >= 0.04""",
    "po_releases_all": """
        SELECT o_orderkey AS po_release_id, o_orderkey AS po_header_id,
               o_custkey % 7 AS release_num, o_orderdate + INTERVAL 1 DAY AS approved_date
        FROM orders WHERE o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED')""",
    "po_vendors": """
        SELECT s_suppkey AS vendor_id, s_name AS vendor_name FROM supplier""",
    "po_vendor_sites_all": """
        SELECT s_suppkey AS vendor_site_id, s_suppkey AS vendor_id,
               CASE WHEN s_suppkey % 8 = 5 THEN 'zz' WHEN s_suppkey % 8 = 6 THEN '02'
                    ELSE CAST(s_suppkey % 4 AS VARCHAR) END AS global_attribute9,
               '000' || CAST(s_suppkey AS VARCHAR) AS global_attribute10,
               CASE WHEN s_suppkey % 3 <> 0 THEN '0001' END AS global_attribute11,
               CAST(s_nationkey AS VARCHAR) AS global_attribute12,
               'CITY_' || CAST(s_nationkey AS VARCHAR) AS city,
               'UF' || CAST(s_nationkey % 9 AS VARCHAR) AS address_line4
        FROM supplier""",
    "mtl_system_items_b": """
        SELECT k.inventory_item_id, k.organization_id,
               'IT' || CAST(k.inventory_item_id AS VARCHAR) AS segment1,
               p.p_type AS item_type,
               k.inventory_item_id % 4 AS receiving_routing_id
        FROM (SELECT DISTINCT l_partkey AS inventory_item_id, l_suppkey % 25 AS organization_id
              FROM lineitem WHERE l_tax >= 0.02) k
        LEFT JOIN part p ON k.inventory_item_id = p.p_partkey""",
    "mtl_system_items": "SELECT * FROM mtl_system_items_b",
    "fnd_lookup_values": """
        SELECT 'RCV_ROUTING_HEADERS' AS lookup_type, CAST(r_regionkey + 1 AS VARCHAR) AS lookup_code,
               'PTB' AS language, r_name AS meaning FROM region
        UNION ALL
        SELECT 'RCV_ROUTING_HEADERS', CAST(r_regionkey + 1 AS VARCHAR), 'US', lower(r_name) FROM region
        UNION ALL
        SELECT 'ITEM_TYPE', lookup_code, 'PTB', lower(lookup_code)
        FROM (SELECT DISTINCT p_type AS lookup_code FROM part) t
        UNION ALL
        SELECT 'ITEM_TYPE', lookup_code, 'US', lookup_code
        FROM (SELECT DISTINCT p_type AS lookup_code FROM part) t""",
    "hr_operating_units": """
        SELECT CAST(n_nationkey AS BIGINT) AS organization_id,
               CASE WHEN n_nationkey = 24 THEN 'XY' ELSE n_name END AS name
        FROM nation""",
    "org_organization_definitions": """
        SELECT CAST(n_nationkey AS BIGINT) AS organization_id,
               'ORG' || CAST(n_nationkey AS VARCHAR) AS organization_code
        FROM nation""",
    "r_catalog_base": """
        SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_tax, p.p_brand, p.p_size, s.s_name
        FROM lineitem l
        JOIN part p ON l.l_partkey = p.p_partkey
        JOIN supplier s ON l.l_orderkey % 100 = s.s_suppkey
        WHERE l.l_linestatus = 'O'""",
    "icx_cat_items_b": f"""
        SELECT {_KEY} AS rt_item_id, CAST(l_orderkey - 1 AS VARCHAR) AS supplier_part_auxid,
               s_name AS supplier, p_brand AS supplier_part_num
        FROM r_catalog_base""",
    "icx_cat_items_tlp": f"""
        SELECT {_KEY} AS rt_item_id, 'PTB' AS language, CAST(p_size AS DOUBLE) AS lead_time FROM r_catalog_base
        UNION ALL
        SELECT {_KEY}, 'US', CAST(p_size + 100 AS DOUBLE) FROM r_catalog_base""",
    "icx_cat_item_prices": f"""
        SELECT {_KEY} AS rt_item_id FROM r_catalog_base WHERE l_tax >= 0.02""",
    "per_all_people_f": """
        SELECT CASE WHEN s_suppkey % 10 = 0 THEN -s_suppkey - 1 ELSE s_suppkey END AS person_id,
               DATE '1995-01-01' + CAST(s_suppkey * 20 AS INTEGER) AS effective_start_date,
               DATE '1995-01-01' + CAST(s_suppkey * 40 + 400 AS INTEGER) AS effective_end_date,
               s_name AS last_name,
               CASE WHEN s_suppkey % 4 <> 0 THEN 'A' || CAST(s_nationkey AS VARCHAR) END AS attribute7,
               CASE WHEN s_suppkey % 5 <> 0 THEN 'B' END AS attribute8
        FROM supplier""",
    "po_action_history": """
        SELECT user_id AS object_id,
               CASE WHEN user_id % 3 = 0 THEN 'RELEASE' WHEN user_id % 3 = 1 THEN 'PO' ELSE 'PA' END AS object_type_code,
               CASE WHEN event_type = 'purchase' THEN 'APPROVE' ELSE upper(event_type) END AS action_code,
               event_id AS sequence_num,
               TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS employee_id
        FROM events
        UNION ALL
        SELECT o_orderkey, object_type, unnest(['SUBMIT', CASE WHEN o_orderstatus = 'F' THEN 'APPROVE' ELSE 'REJECT' END]),
               unnest([CAST(1 AS BIGINT), 2]), unnest([o_custkey % 100, (o_custkey + 7) % 100])
        FROM (SELECT *, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'PO'
                             WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'RELEASE'
                             ELSE 'PA' END AS object_type FROM orders) o
        UNION ALL
        SELECT o_orderkey, 'PA', CASE WHEN o_orderstatus = 'F' AND o_orderkey % 23 = 0 THEN 'APPROVE' ELSE 'FORWARD' END,
               2, (o_custkey + 8) % 100
        FROM orders""",
    "r_operations": """
        SELECT o_orderkey AS operation_id, o_custkey % 25 AS organization_id,
               CASE WHEN o_orderstatus = 'F' THEN 'COMPLETE' WHEN o_orderstatus = 'O' THEN 'APPROVED'
                    ELSE 'IN PROCESS' END AS status,
               o_orderdate AS receive_date, o_orderdate + INTERVAL 1 DAY AS gl_date,
               CASE WHEN o_orderkey % 17 = 0 THEN 'Y' END AS reversion_flag
        FROM orders""",
    "rec_entry_operations": """
        SELECT * REPLACE (organization_id + CASE WHEN operation_id % 13 = 0 THEN 25 ELSE 0 END AS organization_id)
        FROM r_operations""",
    "cll_f189_entry_operations": "SELECT * FROM r_operations",
    "r_invoices": """
        SELECT CASE WHEN o_orderkey % 7 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS invoice_id,
               invoice_id AS operation_id, o_custkey % 25 AS organization_id,
               o_orderkey % 5 AS invoice_type_id, o_orderkey % 1000 AS invoice_num,
               CAST(o_orderkey % 3 AS VARCHAR) AS series, o_orderdate AS invoice_date,
               o_orderdate + INTERVAL 3 DAY AS creation_date, o_totalprice AS invoice_amount,
               o_orderkey % 100 AS entity_id,
               o_totalprice AS ir_base, CAST(1.5 AS DOUBLE) AS ir_tax, o_totalprice * CAST(0.015 AS DOUBLE) AS ir_amount,
               o_totalprice AS inss_base, CAST(11.0 AS DOUBLE) AS inss_tax, o_totalprice * CAST(0.11 AS DOUBLE) AS inss_amount,
               o_totalprice AS iss_base, CAST(5.0 AS DOUBLE) AS iss_tax, o_totalprice * CAST(0.05 AS DOUBLE) AS iss_amount,
               'NFE' || CAST(o_orderkey AS VARCHAR) AS eletronic_invoice_key
        FROM orders""",
    "rec_invoices": "SELECT * FROM r_invoices",
    "cll_f189_invoices": "SELECT * FROM r_invoices",
    "r_invoice_types": """
        SELECT invoice_type_id, organization_id,
               CASE WHEN invoice_type_id = 4 THEN 'Y' WHEN invoice_type_id <> 3 THEN 'N' END AS parent_flag,
               'T' || CAST(invoice_type_id AS VARCHAR) AS invoice_type_code,
               'TIPO ' || CAST(invoice_type_id AS VARCHAR) AS description,
               CASE WHEN invoice_type_id <= 2 THEN 'PO' WHEN invoice_type_id = 3 THEN 'NA' END AS requisition_type
        FROM (SELECT DISTINCT o_orderkey % 5 AS invoice_type_id, o_custkey % 25 AS organization_id FROM orders) k""",
    "rec_invoice_types": "SELECT * FROM r_invoice_types",
    "cll_f189_invoice_types": "SELECT * FROM r_invoice_types",
    "rec_invoice_lines": f"""
        SELECT l_orderkey AS invoice_id, {_KEY} AS line_location_id, l_quantity AS quantity
        FROM lineitem WHERE l_returnflag <> 'R'""",
    "cll_f189_invoice_lines": f"""
        SELECT {_KEY} AS invoice_line_id, l_orderkey AS invoice_id, l_quantity AS quantity,
               l_partkey AS item_id,
               CASE WHEN l_linenumber <> 7 THEN {_KEY} END AS line_location_id,
               l_returnflag || l_linestatus AS operation_fiscal_type,
               l_suppkey % 30 AS awt_group_id,
               CAST(l_linenumber AS BIGINT) AS cfo_id,
               l_partkey % 6 AS utilization_id
        FROM lineitem""",
    "rcv_shipment_headers": """
        SELECT o_orderkey AS shipment_header_id,
               CASE WHEN o_orderkey % 10 = 3 THEN ' ' || CAST(o_orderkey AS VARCHAR) || ' '
                    WHEN o_orderkey % 10 = 7 THEN 'R' || CAST(o_orderkey AS VARCHAR)
                    WHEN o_orderkey % 10 = 9 THEN CAST(NULL AS VARCHAR)
                    ELSE '000' || CAST(o_orderkey AS VARCHAR) END AS receipt_num
        FROM orders""",
    "rcv_transactions": f"""
        SELECT {_KEY} AS transaction_id, {_KEY} AS po_line_location_id, {_KEY} AS po_line_id,
               l_orderkey AS shipment_header_id,
               CASE WHEN l_returnflag = 'A' THEN 'RECEIVE' WHEN l_returnflag = 'N' THEN 'DELIVER'
                    ELSE 'RETURN' END AS transaction_type,
               l_shipdate + to_seconds(l_partkey % 86400) AS transaction_date,
               l_quantity AS quantity
        FROM lineitem WHERE l_linestatus = 'F'""",
    "cll_f189_fiscal_operations": """
        SELECT CAST(n_nationkey AS BIGINT) AS cfo_id, '1.' || CAST(n_nationkey AS VARCHAR) AS cfo_code FROM nation""",
    "cll_f189_item_utilizations": """
        SELECT CAST(r_regionkey AS BIGINT) AS utilization_id, r_name AS utilization_code FROM region""",
    "cll_f189_fiscal_entities_all": """
        SELECT CASE WHEN s_suppkey % 9 = 0 THEN -s_suppkey - 1 ELSE s_suppkey END AS entity_id,
               s_suppkey AS vendor_site_id FROM supplier""",
    "mtl_parameters": "SELECT * FROM org_organization_definitions",
    "nfee_header_xml": """
        SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'NFX' ELSE 'NFE' END || CAST(o_orderkey AS VARCHAR) AS chave,
               CASE WHEN o_orderstatus = 'F' THEN 'AUTORIZADA' ELSE 'PENDENTE' END AS status
        FROM orders""",
    "cll_f189_holds": "SELECT user_id AS invoice_id FROM events WHERE event_type = 'error'",
    "ap_awt_groups": """
        SELECT CAST(n_nationkey AS BIGINT) AS group_id, 'AWT ' || n_name AS name FROM nation""",
}

ROLE_DEPS: dict[str, list[str]] = {
    "po_lines_all": ["r_shipment_base"],
    "po_line_locations_all": ["r_shipment_base"],
    "mtl_system_items": ["mtl_system_items_b"],
    "icx_cat_items_b": ["r_catalog_base"],
    "icx_cat_items_tlp": ["r_catalog_base"],
    "icx_cat_item_prices": ["r_catalog_base"],
    "rec_entry_operations": ["r_operations"],
    "cll_f189_entry_operations": ["r_operations"],
    "rec_invoices": ["r_invoices"],
    "cll_f189_invoices": ["r_invoices"],
    "rec_invoice_types": ["r_invoice_types"],
    "cll_f189_invoice_types": ["r_invoice_types"],
    "mtl_parameters": ["org_organization_definitions"],
}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        for d in ROLE_DEPS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_roles(body: str, names: list[str], extra_ctes: list[tuple[str, str]] | None = None) -> str:
    """``WITH <roles…>, <extra…> <body>``."""
    parts = [f"{n} AS ({ROLE_SQL[n]})" for n in _closure(names)]
    parts += [f"{n} AS ({q})" for n, q in (extra_ctes or [])]
    return "WITH " + ",\n".join(parts) + "\n" + body
