"""Links from documents to cession and ledger records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as v
from ..functions import columns as c
from .keys import spread_left_join, spread_right_join

LINKED = tuple(name for name in v.DOCUMENT_COLUMNS if name != v.SIGNED)
CESSION_ON = (
    ("dhdr_folio", "rdoc_folio"), ("dhdr_rut_emisor", "rdoc_rut_emisor_e"),
    ("dhdr_dv_emisor", "rdoc_dv_emisor"),
)
LEDGER_ON = (
    ("dhdr_folio", "det_folio_doc_ref"), ("dhdr_rut_emisor", "dcv_rut_emisor_e"),
    ("dhdr_rut_recep", "det_rut_doc_e"),
)


def cession_link(documents: DataFrame, cession_documents: DataFrame) -> DataFrame:
    """Each document with every cession document of it, and whether there is one."""
    joined = spread_right_join(documents.select(*LINKED), cession_documents, CESSION_ON)
    return joined.withColumn("cedido", c.match_flag(F.col("rdoc_folio")))


def times_ceded(documents: DataFrame, cession_documents: DataFrame) -> DataFrame:
    """How often each document was ceded.

    Both sides are counted before they meet: equal documents times matching cessions, without ever
    building the pairs.
    """
    copies = documents.select(*LINKED).groupBy(*LINKED).agg(F.count("*").alias("_copies"))
    ceded = cession_documents.groupBy(*(right for _, right in CESSION_ON)).agg(
        F.count("*").alias("_times")
    )
    times = F.col("_copies") * F.coalesce(F.col("_times"), F.lit(0))
    joined = spread_left_join(copies, ceded, CESSION_ON, counted=documents)
    return joined.select(*LINKED, times.alias("veces_cedido"))


def cession_detail(linked: DataFrame, cessions: DataFrame) -> DataFrame:
    """Folio, issuer and receiver once per cession of each linked document."""
    right = cessions.select(F.col("rdoc_codigo").alias("_codigo"))
    joined = spread_right_join(linked, right, [("rdoc_codigo", "_codigo")])
    return joined.select("dhdr_folio", "dhdr_rut_emisor", "dhdr_rut_recep")


def ledger_match(documents: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each document with every ledger line about it, and whether there is one."""
    keys = [right for _, right in LEDGER_ON]
    lines = ledger.select(*keys, *v.LEDGER_COLUMNS)
    joined = spread_right_join(documents.select(*LINKED), lines, LEDGER_ON)
    matched = c.match_flag(F.col("det_folio_doc_ref")).alias("cruce_rcv")
    return joined.select(*LINKED, *v.LEDGER_COLUMNS, matched)
