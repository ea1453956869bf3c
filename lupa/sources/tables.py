"""Inputs: catalog tables and Parquet hand-offs. Outputs: Parquet overwrite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from .. import vocab as v

# Where each input lives in the catalog.
CATALOG = {
    "taxpayers": ("DW.DW_TRN_CONTRIBUYENTES_E", schemas.TAXPAYER),
    "attribute_history": ("DW.DW_TRN_RIAC_ATRIBUTO_CONTRIB_E", schemas.ATTRIBUTE_HISTORY),
    "attributes": ("DW.DW_DIM_ATRIBUTO_CONTRIB", schemas.ATTRIBUTE),
    "alerts": ("DW.DW_TRN_ALERTAS_E", schemas.ALERT),
    "business": ("DW.DW_TRN_NEGOCIOS_E", schemas.BUSINESS),
    "units": ("DW.DW_DIM_UNIDAD_OPERATIVA", schemas.UNIT),
    "behaviour": ("DW.DW_HEC_CONT_COMPORTAMIENTO_E", schemas.BEHAVIOUR),
    "activity_links": ("DW.DW_TRN_ACTIVIDAD_ECONOMICA_E", schemas.ACTIVITY_LINK),
    "activities": ("DW.DW_DIM_ACTIVIDAD_ECONOMICA_E", schemas.ACTIVITY),
    "documents": ("DWBGDATA.HEADER_DTE_CONSOLIDADA_ENC_SAS_ANALITICA", schemas.DOCUMENT),
    "cession_documents": ("hivenom.csn_doctos_final", schemas.CESSION_DOCUMENT),
    "cessions": ("hivenom.csn_cesion_final", schemas.CESSION),
    "ledger": ("DWBGDATA.DCV_GENERIC_DET_CONSOLIDADO_SAS", schemas.LEDGER),
}
WHOLE = ("cession_documents",)


def table(
    spark: SparkSession, name: str, identifier: str | None = None, extra: Sequence[str] = ()
) -> DataFrame:
    """Read one input by its short name, with the expected columns and types.

    Cession documents keep all their other columns too, which the links pass on.
    """
    default, schema = CATALOG[name]
    found = spark.table(identifier or default)
    if name in WHOLE:
        expected = {field.name.lower() for field in schema.fields}
        extra = [*extra, *(f"`{c}`" for c in found.columns if c.lower() not in expected and c not in extra)]
    return schemas.conform(found, schema, extra)


def parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if schema is None else schemas.conform(df, schema)


def invoices(
    documents: DataFrame, doc_type: int = v.INVOICE, extra: Sequence[str] = ()
) -> DataFrame:
    """The ten invoice columns, for one document type; both reach the Parquet scan."""
    return documents.where(F.col("dtdc_codigo") == doc_type).select(*v.DOCUMENT_COLUMNS, *extra)


def behaviour(table: DataFrame) -> DataFrame:
    """The yearly behaviour columns that the profile keeps."""
    unit = F.col("UNOP_UNIDAD_GRAN_CONT").alias(v.BEHAVIOUR_UNIT)
    return table.select(
        v.RUT, v.DV, "COCO_AGNO_COMERCIAL",
        *(unit if name == v.BEHAVIOUR_UNIT else F.col(name) for name in v.BEHAVIOUR_COLUMNS),
    )


def overwrite(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace the Parquet data at ``path``.

    With ``partition_by`` rows are gathered by partition value first, so that a partition does not
    get one small file from every task; adaptive execution splits the large partitions again.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
