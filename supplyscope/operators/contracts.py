"""Contract lead times from the purchasing catalogue.

Catalogue rows are ``items_b`` (contract number = ``supplier_part_auxid``,
``supplier`` name, ``supplier_part_num``) with a price row (existence only) and a
translated row carrying ``lead_time`` in one language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyscope.functions.oracle import safe_number

CATALOG_KEYS = ["supplier_part_auxid", "supplier", "supplier_part_num"]


def catalog_lead_times(items_b: DataFrame, items_tlp: DataFrame, item_prices: DataFrame,
                       language: str = "PTB") -> DataFrame:
    """``(supplier_part_auxid, supplier, supplier_part_num, min_lead_time, max_lead_time)``.

    The price table only bridges (it contributes no column), so it is a semi join
    and cannot multiply rows.  Reduced per catalogue key before any report join.
    """
    priced = items_b.join(item_prices.select("rt_item_id").distinct(), "rt_item_id", "left_semi")
    tlp = items_tlp.where(F.col("language") == language).select("rt_item_id", "lead_time")
    return (priced.join(tlp, "rt_item_id", "inner")
            .groupBy(*CATALOG_KEYS)
            .agg(F.min("lead_time").alias("min_lead_time"), F.max("lead_time").alias("max_lead_time")))


def contract_lead_time(rows: DataFrame, catalog: DataFrame, *, contract_number: str = "contrato_pai_segment1",
                       vendor_name: str = "razao_social_fornecedor", part_number: str = "part_number") -> DataFrame:
    """Adds ``catalog_lead_time``: the catalogue lead time for the row's contract
    number, vendor name and part number (the smallest when several match; NULL
    when none — callers must not fall back to another source)."""
    cat = catalog.select(F.col("supplier_part_auxid").alias(contract_number), F.col("supplier").alias(vendor_name),
                         F.col("supplier_part_num").alias(part_number), F.col("min_lead_time").alias("catalog_lead_time"))
    return rows.join(cat, [contract_number, vendor_name, part_number], "left")


def delivery_lead_time(is_standard: Column, contract_id: Column, catalog_lead: Column, attribute3: Column,
                       decimal_comma: bool = False) -> Column:
    """``PRAZO DE ENTREGA``: catalogue lead time for a STANDARD line on a contract,
    else the line's own numeric ``attribute3`` (malformed text → NULL)."""
    return F.when(is_standard & contract_id.isNotNull(), catalog_lead).otherwise(
        safe_number(attribute3, "double", decimal_comma))


def contract_parts(needed: DataFrame, lines: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The catalogue rows that each needed ``(header, contract, vendor)`` is tested on, in two frames:
    ``(by_part, by_contract)`` of ``(po_header_id, supplier_part_auxid, supplier, supplier_part_num)``.

    The maximum lead time asks for the triangles of three relations: header-contract
    (``needed``), header-part (the live lines) and contract-part (the catalogue).  A
    triple is closed from its smaller side: with the parts of its header, or with the
    catalogue rows of its contract, whichever are fewer.  ``by_part`` holds the first
    kind (still to be looked up in the catalogue), ``by_contract`` the second (still to
    be looked up in the lines).  So the rows between the joins are at most the sum of
    the smaller degrees: a contract of thousands of headers and thousands of catalogue
    rows costs the headers' own parts, not their product.
    """
    c = F.col
    contract, part = ["supplier_part_auxid", "supplier"], "supplier_part_num"
    parts = live_parts(lines)
    of_header = parts.groupBy("po_header_id").agg(F.count(F.lit(1)).alias("n_parts"))
    of_contract = catalog.groupBy(*contract).agg(F.count(F.lit(1)).alias("n_catalog"))
    # a header without parts or a contract without rows closes no triangle: inner joins
    triples = needed.join(of_header, "po_header_id", "inner").join(of_contract, contract, "inner")
    from_header, from_contract = c("n_parts") <= c("n_catalog"), c("n_parts") > c("n_catalog")
    keys = ["po_header_id", *contract]
    by_part = triples.where(from_header).select(*keys).join(parts, "po_header_id", "inner").select(*keys, part)
    by_contract = triples.where(from_contract).select(*keys).join(catalog.select(*contract, part), contract, "inner").select(*keys, part)
    return by_part, by_contract


def live_parts(lines: DataFrame) -> DataFrame:
    """Distinct ``(po_header_id, supplier_part_num)`` of the lines that are not cancelled and name a part."""
    live = F.col("vendor_product_num").isNotNull() & (F.coalesce(F.col("cancel_flag"), F.lit("N")) == "N")
    return lines.where(live).select("po_header_id", F.col("vendor_product_num").alias("supplier_part_num")).distinct()


def max_contract_lead_time(needed: DataFrame, lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(po_header_id, supplier_part_auxid, max_contract_lead_time)``.

    The maximum catalogue lead time of a contract, for the header's vendor, over
    the part numbers of every live line of the header (non-NULL, not cancelled).

    ``needed``: distinct ``(po_header_id, supplier_part_auxid, supplier)`` — the
    header, the contract number its line points at and the header's vendor name.
    ``catalog``: one row per ``CATALOG_KEYS``, as ``catalog_lead_times`` gives.
    Plan: a degree-aware triangle join (``contract_parts``); its first frame is
    looked up in the catalogue, its second kept where the header has the part.
    """
    by_part, by_contract = contract_parts(needed, lines, catalog)
    leads = catalog.select(*CATALOG_KEYS, "max_lead_time")
    keys = ["po_header_id", "supplier_part_num"]
    found = by_part.unionByName(by_contract.join(live_parts(lines), keys, "left_semi"))
    return (found.join(leads, CATALOG_KEYS, "inner")
            .groupBy("po_header_id", "supplier_part_auxid")
            .agg(F.max("max_lead_time").alias("max_contract_lead_time")))
