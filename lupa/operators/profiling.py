"""Amount profiling: alert types, counts, ranked means and sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as v
from ..functions import columns as c

ISSUER_SEGMENT = f"{v.ISSUER}{v.SEGMENT}"
ISSUER_SUBSECTOR = f"{v.ISSUER}{v.SUBSECTOR}"
RECEIVER_SUBSECTOR = f"{v.RECEIVER}{v.SUBSECTOR}"


def with_alert_flags(documents: DataFrame) -> DataFrame:
    """Whether the issuer, the receiver, or both have any alert."""
    issuer = c.any_positive(v.alert_columns(v.ISSUER))
    receiver = c.any_positive(v.alert_columns(v.RECEIVER))
    return documents.withColumns(
        {"alertas_emisor": issuer, "alertas_receptor": receiver, "alertas_combinadas": issuer & receiver}
    )


def with_alert_type(flagged: DataFrame) -> DataFrame:
    """One of four labels from the alert flags."""
    label = c.alert_type(F.col("alertas_emisor"), F.col("alertas_receptor"))
    return flagged.withColumn("tipo_alerta", label)


def counts(df: DataFrame, *keys: str, drop_null: bool = False) -> DataFrame:
    """Rows per combination of the keys, most frequent first."""
    kept = _without_null(df, keys) if drop_null else df
    rows = kept.groupBy(*keys).agg(F.count("*").alias("count"))
    return rows.orderBy(F.desc("count"), *keys)


def combined_alerts(flagged: DataFrame) -> DataFrame:
    """Documents whose parties both have alerts, per issuer segment and part of the day."""
    keys = [ISSUER_SEGMENT, "bloque_horario"]
    total = F.sum(F.col("alertas_combinadas").cast("long")).alias("alertas_combinadas")
    return _without_null(flagged, keys).groupBy(*keys).agg(total).orderBy(
        F.desc("alertas_combinadas"), *keys
    )


def at_dawn(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("bloque_horario") == v.DAWN)


def at_weekend(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("es_fin_de_semana") == 1)


def top(df: DataFrame, key: str, measure: Column, n: int) -> DataFrame:
    """The ``n`` keys with the largest aggregate; equal values are ordered by key."""
    ranked = _without_null(df, [key]).groupBy(key).agg(measure.alias("measure"))
    return ranked.orderBy(F.desc_nulls_last("measure"), key).limit(n)


def top_mean(df: DataFrame, key: str, value: str = v.AMOUNT, n: int = 10) -> DataFrame:
    return top(df, key, F.avg(F.col(value).cast("double")), n)


def top_sum(df: DataFrame, key: str, value: str = v.AMOUNT, n: int = 10) -> DataFrame:
    return top(df, key, F.sum(F.col(value).cast("double")), n)


def keep_top(df: DataFrame, best: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the ``top`` keys; that list has at most ``n`` rows."""
    return df.join(F.broadcast(best.select(key)), key, "left_semi")


def top_by(
    df: DataFrame, group: Sequence[str], key: Sequence[str], value: str = v.AMOUNT, n: int = 5
) -> DataFrame:
    """Per group, the ``n`` keys with the largest total, with row count and total."""
    totals = _without_null(df, [*group, *key]).groupBy(*group, *key).agg(
        F.count("*").alias("count"), F.sum(F.col(value).cast("double")).alias("total_monto")
    )
    window = Window.partitionBy(*group).orderBy(F.desc_nulls_last("total_monto"), *key)
    return totals.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def _without_null(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df
