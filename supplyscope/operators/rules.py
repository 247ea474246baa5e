"""Row rules of the reports: document type, tax-id mask, link flags and the two
priority ladders.  Each is a single ``when`` chain, evaluated in codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyscope.functions.oracle import decode_number, oracle_concat, yes_no

# The report's output texts.
SIM, NAO = "SIM", "NÃO"
STATUS_NO_LINE = "SEM LINHA DE NOTA"
STATUS_NO_TRANSACTION = "SEM TRANSAÇÃO"
STATUS_NO_PO = "SEM OC"
STATUS_SHORT_RECEIPT = "QTD RECEBIDA MENOR QUE NF"
OK = "OK"
ACTION_RUN_CONCURRENT = "Executar concurrent para gerar transação"
ACTION_CHECK_XML = "Verificar parsing do XML"
ACTION_CHECK_PO_LINK = "Verificar se houve quebra de vínculo com OC"
ACTION_HOLD = "Remover ou tratar HOLD"
NEEDS_PO, NO_PO = "REQUER OC", "SEM OC"


def document_type(type_code: Column, contract_num: Column) -> Column:
    """``STANDARD (CONTRACT)`` / ``STANDARD (SPOT)`` by contract number, else the raw type."""
    std = type_code == "STANDARD"
    return (F.when(std & contract_num.isNotNull(), F.lit("STANDARD (CONTRACT)"))
             .when(std & contract_num.isNull(), F.lit("STANDARD (SPOT)"))
             .otherwise(type_code))


def tax_id(kind: Column, a10: Column, a11: Column, a12: Column) -> Column:
    """Vendor tax id by person type: 2 → ``a10/a11-a12``, 1 → ``a10-a12``,
    3 → ``a10a11a12``; any other type (or text that is not a number) → NULL."""
    return decode_number(kind, {
        2: oracle_concat(a10, F.lit("/"), a11, F.lit("-"), a12),
        1: oracle_concat(a10, F.lit("-"), a12),
        3: oracle_concat(a10, a11, a12),
    })


def link_flags(df: DataFrame) -> DataFrame:
    """The five SIM/NÃO-style flags of the receiving diagnosis."""
    return df.withColumns({
        "flag_recebimento": yes_no(F.col("transaction_id").isNull(), NAO, SIM),
        "flag_oc": yes_no(F.col("po_header_id").isNull(), NAO, SIM),
        "flag_item_ativo": yes_no(F.col("inventory_item_id").isNull(), NAO, SIM),
        "flag_precisa_oc": yes_no(F.col("requisition_type") == "PO", NEEDS_PO, NO_PO),
        "flag_hold": yes_no(F.col("hold_count") > 0, SIM, NAO),
    })


def diagnosis_status(df: DataFrame) -> DataFrame:
    """``status_analitico``: the first that holds of no invoice line, no delivery
    transaction, no PO on a PO-type invoice, received < invoiced; else OK.
    A NULL quantity makes the comparison unknown and falls through to OK."""
    c = F.col
    return df.withColumn("status_analitico",
                         F.when(c("invoice_line_id").isNull(), STATUS_NO_LINE)
                          .when(c("transaction_id").isNull(), STATUS_NO_TRANSACTION)
                          .when(c("po_header_id").isNull() & (c("requisition_type") == "PO"), STATUS_NO_PO)
                          .when(c("qtd_recebida_po") < c("qtd_nf"), STATUS_SHORT_RECEIPT)
                          .otherwise(OK))


def recommended_action(df: DataFrame) -> DataFrame:
    """``sugestao_acao``: a different priority order from the status ladder — the
    missing-transaction action wins over the missing-line one when the operation
    is APPROVED."""
    c = F.col
    return df.withColumn("sugestao_acao",
                         F.when(c("transaction_id").isNull() & (c("status_ri") == "APPROVED"), ACTION_RUN_CONCURRENT)
                          .when(c("invoice_line_id").isNull(), ACTION_CHECK_XML)
                          .when(c("po_header_id").isNull() & (c("requisition_type") == "PO"), ACTION_CHECK_PO_LINK)
                          .when(c("hold_count") > 0, ACTION_HOLD)
                          .otherwise(OK))
