"""The warehouse tables, derived from the test tables.

One SQL text per table runs in Spark and in DuckDB; only the hour arithmetic differs. Suppliers
(issuers), customers (receivers) and event users share one space of taxpayer ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lupa import schemas
from lupa import vocab as v
from lupa.session import stage
from lupa.sources.tables import CATALOG

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
)

HOURS = {
    "spark": "make_interval(0, 0, 0, 0, CAST(l_partkey % 24 AS INT), 0, 0)",
    "duckdb": "to_hours(CAST(l_partkey % 24 AS INT))",
}


def _rut(key: str) -> str:
    return f"CAST({key} AS STRING)"


def _dv(key: str) -> str:
    return f"CASE WHEN {key} % 11 = 10 THEN 'K' ELSE CAST({key} % 11 AS STRING) END"


def _code() -> str:
    return (
        "CASE event_type WHEN 'click' THEN 'SGGC' WHEN 'error' THEN 'SGME' "
        "WHEN 'purchase' THEN 'SGPM' WHEN 'signup' THEN 'SGMI' ELSE 'SGPE' END"
    )


# the kept codes, then one that is not on the list
_ALERTS = (
    "4110", "4111", "4112", "4113", "52", "5201", "5203", "53", "5301", "2250", "1019", "4001",
    "4002", "4004", "4005", "4006", "4007", "2046",
)
_ALERT = "CASE event_id % 18 " + " ".join(
    f"WHEN {i} THEN '{code}'" for i, code in enumerate(_ALERTS)
) + " END"

_MARKS = ", ".join(
    f"CASE WHEN o_orderkey % {i + 2} = 0 THEN 'S' ELSE 'N' END AS {mark}"
    for i, mark in enumerate(v.BEHAVIOUR_MARKS)
)

_LARGE_UNIT = (
    "CASE o_orderkey % 3 WHEN 1 THEN '-9999' "
    "WHEN 2 THEN CAST(17000 + o_orderkey % 2000 AS STRING) END"
)

TABLES = {
    "taxpayers": f"""
        SELECT DISTINCT {_rut("k")} AS CONT_RUT, {_dv("k")} AS CONT_DV
        FROM (SELECT c_custkey AS k FROM {{customer}} UNION ALL SELECT s_suppkey FROM {{supplier}}
              UNION ALL SELECT user_id FROM {{events}}) AS ids""",
    "attribute_history": f"""
        SELECT {_rut("user_id")} AS CONT_RUT, {_code()} AS TATR_CODIGO,
               CAST(ts AS DATE) AS ATRC_FECHA_INICIO,
               CASE WHEN event_id % 5 = 0 THEN CAST(ts AS DATE) END AS ATRC_FECHA_TERMINO,
               CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS ATRC_VIGENTE
        FROM {{events}}""",
    "attributes": f"""
        SELECT DISTINCT {_code()} AS TATR_CODIGO, 1 AS TATR_VIGENTE,
               'Atributo ' || {_code()} AS TATR_DESCRIPCION
        FROM {{events}}""",
    "alerts": f"""
        SELECT {_rut("user_id")} AS CONT_RUT, {_dv("user_id")} AS CONT_DV,
               {_ALERT} AS ALER_COD_TIPO_ALERTA_VO,
               'ALERTA ' || ({_ALERT}) AS ALER_DESC_TIPO_ALERTA_VO,
               CAST(user_id % 25 * 1000 AS STRING) AS UNOP_UNIDAD_ACTIV,
               CAST(ts AS DATE) AS ALER_FECHA_ACTIV_VO,
               CASE WHEN value >= 5 THEN CAST(ts AS DATE) END AS ALER_FECHA_DESACTIV_VO
        FROM {{events}}""",
    "business": f"""
        SELECT {_rut("o_custkey")} AS CONT_RUT, {_dv("o_custkey")} AS CONT_DV,
               CAST(date_trunc('year', o_orderdate) AS DATE) AS NEGO_FECHA_VIGENCIA,
               CAST(c_nationkey * 1000 AS STRING) AS UNOP_UNIDAD,
               {_LARGE_UNIT} AS UNOP_UNIDAD_GRAN_CONT,
               CASE WHEN c_acctbal > 5000 THEN 'S' ELSE 'N' END AS NEGO_IND_EXPORTADOR_VO,
               CASE WHEN c_acctbal > 8000 THEN 'S' ELSE 'N' END AS NEGO_IND_PRIMERA_EXP_VO,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN 'S' ELSE 'N' END AS NEGO_IND_VERIFICACION_VO,
               CAST(o_custkey % 50 AS INT) AS NEGO_NRO_FACTURAS_6MESES_VO
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    "units": """
        SELECT CAST(n_nationkey * 1000 AS STRING) AS UNOP_UNIDAD, n_regionkey AS UNOP_COD_REGIONAL
        FROM {nation}""",
    "behaviour": f"""
        SELECT {_rut("o_custkey")} AS CONT_RUT, {_dv("o_custkey")} AS CONT_DV,
               CAST(year(o_orderdate) AS INT) AS COCO_AGNO_COMERCIAL,
               CAST(o_orderdate AS DATE) AS COCO_FECHA_CARGA_DW,
               floor(o_totalprice * 19 + 0.5) / 100 AS COCO_IMP_VENTAS_IVA,
               CAST(o_orderkey % 1000 AS DOUBLE) AS COCO_IMP_VENTAS_TRANSPORTE, {_MARKS},
               CAST(o_orderkey % 777 AS DOUBLE) AS COCO_MTO_DEV_SOLICITADA_F22,
               o_totalprice AS COCO_MTO_VENTAS, o_orderstatus AS TICO_SUB_TPO_CONTR,
               substring(o_orderpriority, 1, 1) AS TRRE_COD_TMO_RTA,
               CAST(o_orderkey % 13 AS STRING) AS TRVE_COD_TMO_VTA,
               {_LARGE_UNIT} AS UNOP_UNIDAD_GRAN_CONT,
               CAST(o_orderkey % 346 AS STRING) AS COMU_COD_COMUNA_PRINCIPAL,
               CAST(main AS STRING) AS ACEC_COD_ACTECO_PRINCIPAL,
               CASE WHEN o_custkey % 4 = 0 THEN 202200 ELSE 202300 END AS PERI_AGNO_TRIBUTARIO_RENTA
        FROM {{orders}}
        LEFT JOIN (SELECT o_custkey AS owner, max(l_partkey) AS main
                   FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
                   GROUP BY o_custkey) AS principal ON o_custkey = owner""",
    "activity_links": f"""
        SELECT DISTINCT {_rut("o_custkey")} AS CONT_RUT, {_dv("o_custkey")} AS CONT_DV,
               CAST(l_partkey AS STRING) AS ACTECO_COD_ACTECO,
               CASE WHEN l_returnflag = 'N' THEN 'S' ELSE 'N' END AS ACTECO_VIGENCIA
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    "activities": """
        SELECT CAST(p_partkey AS STRING) AS ACEC_COD_ACTECO, p_name AS ACEC_DES_ACTECO,
               p_brand AS ACEC_DES_RUBRO, p_type AS ACEC_DES_SUBRUBRO
        FROM {part}""",
    "documents": f"""
        SELECT l_orderkey AS dhdr_folio, CASE WHEN l_linenumber <= 5 THEN 33 ELSE 61 END AS dtdc_codigo,
               CAST(o_orderdate AS DATE) AS dhdr_fch_emis,
               {_rut("l_suppkey")} AS dhdr_rut_emisor, {_dv("l_suppkey")} AS dhdr_dv_emisor,
               {_rut("o_custkey")} AS dhdr_rut_recep, {_dv("o_custkey")} AS dhdr_dv_recep,
               l_extendedprice AS dhdr_mnt_total,
               floor(l_extendedprice * 19 + 0.5) / 100 AS dhdr_iva,
               l_shipdate + {{hours}} AS dhdr_tmst_firma
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    "cession_documents": f"""
        SELECT l_orderkey AS rdoc_folio, {_rut("l_suppkey")} AS rdoc_rut_emisor_e,
               {_dv("l_suppkey")} AS rdoc_dv_emisor, l_orderkey * 10 + l_linenumber AS rdoc_codigo
        FROM {{lineitem}} WHERE l_returnflag = 'R'""",
    "cessions": """
        SELECT l_orderkey * 10 + l_linenumber AS rdoc_codigo FROM {lineitem}
        WHERE l_returnflag = 'R' AND l_quantity > 20
        UNION ALL
        SELECT l_orderkey * 10 + l_linenumber AS rdoc_codigo FROM {lineitem}
        WHERE l_returnflag = 'R' AND l_quantity > 40""",
    "ledger": f"""
        SELECT l_orderkey AS det_folio_doc_ref, {_rut("l_suppkey")} AS dcv_rut_emisor_e,
               {_rut("o_custkey")} AS det_rut_doc_e,
               CASE WHEN l_tax > 0.04 THEN 'S' ELSE 'N' END AS det_emisor_nota,
               CAST(l_shipdate AS DATE) AS det_fch_doc, CAST(o_orderdate AS DATE) AS det_fec_creacion,
               o_orderstatus AS tipo_transaccion
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey WHERE l_linestatus = 'F'""",
    "predictions": """
        SELECT event_id AS uuid, ts AS predicted_at, value AS prediction,
               CASE WHEN value >= 8 THEN -1 ELSE 1 END AS label,
               CASE WHEN value + event_id % 5 >= 10 THEN -1 ELSE 1 END AS predicted,
               CAST(user_id % 8 AS INT) AS leaf
        FROM {events}""",
    "truth": """
        SELECT event_id AS uuid, value + event_id % 10 AS actual_result
        FROM {events} WHERE event_id % 4 <> 3""",
}


def _read(spark: SparkSession, path: str) -> DataFrame:
    """One test table. The largest can be a single file with a single row group, which only one task
    could read and process; then it is dealt out first."""
    df = spark.read.parquet(path)
    return dealt(df) if path.endswith("/lineitem.parquet") else df


def dealt(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew unless its files already give every core a share; rows are counted by the scan, no column is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    sizes = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    return df if sizes["rows"] and sizes["most"] * cores <= UNEVEN * sizes["rows"] else df.repartition(cores)


# Rows of the largest scan task, in even shares of a core, from which a table is dealt out.
UNEVEN = 3

# Tables that take a join to derive. They are written as Parquet once per session and directory,
# so that queries scan them the way they would scan a warehouse table. The join of lines and orders is
# written once for all tables that select from it.
STORED = ("sold", "business", "behaviour")
SOLD = "{lineitem} JOIN {orders} ON l_orderkey = o_orderkey"
SOLD_COLUMNS = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus",
    "l_shipdate", "o_custkey", "o_orderdate", "o_orderstatus",
)
_written: dict[tuple, object] = {}


def handed_over(source: Source, name: str, build: Callable[[], object]):
    """The result of ``build``, made once per session and directory of test tables."""
    key = (source.spark.sparkContext.applicationId, source.directory, name)
    if key not in _written:
        _written[key] = build()
    return _written[key]


def made(source: Source, name: str) -> bool:
    """Whether the session has handed over a result of this name before."""
    return (source.spark.sparkContext.applicationId, source.directory, name) in _written


class Source(dict):
    """Warehouse tables by short name, derived from one directory of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.directory = spark, sf_dir
        self.base = handed_over(self, "base", lambda: {name: _read(spark, f"{sf_dir}/{name}.parquet") for name in BASE})

    def __missing__(self, name: str) -> DataFrame:
        if name in STORED:
            self[name] = handed_over(self, name, lambda: stage(self.derive(name), name, "zstd"))
        else:
            self[name] = self.derive(name)
        return self[name]

    def derive(self, name: str) -> DataFrame:
        if name == "sold":
            lines, orders = self.base["lineitem"], self.base["orders"]
            return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(*SOLD_COLUMNS)
        text = TABLES[name].replace(SOLD, "{sold}")
        used = {t: df for t, df in self.base.items() if "{" + t + "}" in text}
        if "{sold}" in text:
            used["sold"] = self["sold"]
        df = self.spark.sql(text.replace("{hours}", HOURS["spark"]), **used)
        return schemas.conform(df, CATALOG[name][1]) if name in CATALOG else df


def duckdb_sql(name: str) -> str:
    return TABLES[name].format(hours=HOURS["duckdb"], **{t: t for t in BASE})
