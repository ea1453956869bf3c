"""Expected columns and types of the warehouse tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType,
)

from . import vocab as v

TYPES = {
    "string": StringType(), "int": IntegerType(), "bigint": LongType(), "double": DoubleType(),
    "date": DateType(), "timestamp_ntz": TimestampNTZType(),
}


def _table(**columns: str) -> StructType:
    return StructType([StructField(name, TYPES[kind]) for name, kind in columns.items()])


TAXPAYER = _table(CONT_RUT="string", CONT_DV="string")

ATTRIBUTE_HISTORY = _table(
    CONT_RUT="string", TATR_CODIGO="string", ATRC_FECHA_INICIO="date", ATRC_FECHA_TERMINO="date",
    ATRC_VIGENTE="int",
)

ATTRIBUTE = _table(TATR_CODIGO="string", TATR_VIGENTE="int", TATR_DESCRIPCION="string")

ALERT = _table(
    CONT_RUT="string", CONT_DV="string", ALER_COD_TIPO_ALERTA_VO="string",
    ALER_DESC_TIPO_ALERTA_VO="string", UNOP_UNIDAD_ACTIV="string", ALER_FECHA_ACTIV_VO="date",
    ALER_FECHA_DESACTIV_VO="date",
)

BUSINESS = _table(
    CONT_RUT="string", CONT_DV="string", NEGO_FECHA_VIGENCIA="date", UNOP_UNIDAD="string",
    UNOP_UNIDAD_GRAN_CONT="string", NEGO_IND_EXPORTADOR_VO="string", NEGO_IND_PRIMERA_EXP_VO="string",
    NEGO_IND_VERIFICACION_VO="string", NEGO_NRO_FACTURAS_6MESES_VO="int",
)

UNIT = _table(UNOP_UNIDAD="string", UNOP_COD_REGIONAL="int")

BEHAVIOUR = _table(
    CONT_RUT="string", CONT_DV="string", COCO_AGNO_COMERCIAL="int", COCO_FECHA_CARGA_DW="date",
    COCO_IMP_VENTAS_IVA="double", COCO_IMP_VENTAS_TRANSPORTE="double",
    **{mark: "string" for mark in v.BEHAVIOUR_MARKS},
    COCO_MTO_DEV_SOLICITADA_F22="double", COCO_MTO_VENTAS="double", TICO_SUB_TPO_CONTR="string",
    TRRE_COD_TMO_RTA="string", TRVE_COD_TMO_VTA="string", UNOP_UNIDAD_GRAN_CONT="string",
    COMU_COD_COMUNA_PRINCIPAL="string", ACEC_COD_ACTECO_PRINCIPAL="string",
    PERI_AGNO_TRIBUTARIO_RENTA="int",
)

ACTIVITY_LINK = _table(
    CONT_RUT="string", CONT_DV="string", ACTECO_COD_ACTECO="string", ACTECO_VIGENCIA="string",
)

ACTIVITY = _table(
    ACEC_COD_ACTECO="string", ACEC_DES_ACTECO="string", ACEC_DES_RUBRO="string",
    ACEC_DES_SUBRUBRO="string",
)

DOCUMENT = _table(
    dhdr_folio="bigint", dtdc_codigo="int", dhdr_fch_emis="date", dhdr_rut_emisor="string",
    dhdr_dv_emisor="string", dhdr_rut_recep="string", dhdr_dv_recep="string",
    dhdr_mnt_total="double", dhdr_iva="double", dhdr_tmst_firma="timestamp_ntz",
)

CESSION_DOCUMENT = _table(
    rdoc_folio="bigint", rdoc_rut_emisor_e="string", rdoc_dv_emisor="string", rdoc_codigo="bigint",
)

CESSION = _table(rdoc_codigo="bigint")

LEDGER = _table(
    det_folio_doc_ref="bigint", dcv_rut_emisor_e="string", det_rut_doc_e="string",
    det_emisor_nota="string", det_fch_doc="date", det_fec_creacion="date", tipo_transaccion="string",
)


def conform(df: DataFrame, schema: StructType, extra: Sequence[str] = ()) -> DataFrame:
    """Select the columns of ``schema`` in order, cast to its types; missing columns are an error.

    ``extra`` names further columns to keep as they are, such as partition columns.

    A column that already has the right type is passed through bare, so filters on it still reach
    the scan.
    """
    present = {field.name.lower(): field for field in df.schema.fields}
    missing = [field.name for field in schema.fields if field.name.lower() not in present]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    columns = []
    for field in schema.fields:
        have = present[field.name.lower()]
        column = F.col(f"`{have.name}`")
        if have.dataType != field.dataType:
            column = column.cast(field.dataType)
        columns.append(column.alias(field.name))
    return df.select(*columns, *extra)
