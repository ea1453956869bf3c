"""Documents above the 90th percentile of their issuer segment, and what they have in common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as v
from ..functions import columns as c
from .profiling import ISSUER_SEGMENT, ISSUER_SUBSECTOR, top_by
from .quantiles import quantiles, values_of

HAS_ALERT = "con_alerta"


def _known_segments(documents: DataFrame) -> DataFrame:
    return documents.where(F.col(ISSUER_SEGMENT).isin(*v.SEGMENT_RANK))


def segment_p90(documents: DataFrame, value: str = v.AMOUNT) -> DataFrame:
    """90th percentile of the amount per issuer segment and the number of rows strictly above it.

    Only the five known segments have a limit, which bounds the broadcast.
    """
    values = values_of(_known_segments(documents), value, [ISSUER_SEGMENT])
    limit = quantiles(_known_segments(documents), value, {"percentil_90": 0.9}, [ISSUER_SEGMENT]).drop("rows")
    return (
        values.join(F.broadcast(limit), ISSUER_SEGMENT)
        .groupBy(ISSUER_SEGMENT, "percentil_90")
        .agg(F.count_if(F.col("v") > F.col("percentil_90")).alias("n_outliers"))
    )


def above_p90(documents: DataFrame, value: str = v.AMOUNT, accuracy: int | None = None) -> DataFrame:
    """Documents strictly above their segment's 90th percentile, marked by issuer alert.

    There is one limit per known segment, five in all, which bounds the broadcast.
    """
    known = _known_segments(documents)
    limit = quantiles(known, value, {"percentil_90": 0.9}, [ISSUER_SEGMENT], accuracy)
    return (
        known.join(F.broadcast(limit.drop("rows")), ISSUER_SEGMENT)
        .where(F.col(value).cast("double") > F.col("percentil_90"))
        .withColumn(HAS_ALERT, c.any_positive(v.alert_columns(v.ISSUER)))
    )


def by_subsector(outliers: DataFrame, n: int = 5) -> DataFrame:
    """Per segment and issuer alert, the issuer subsectors with the largest totals."""
    return top_by(outliers, [ISSUER_SEGMENT, HAS_ALERT], [ISSUER_SUBSECTOR], n=n)


def by_time(outliers: DataFrame, n: int = 5) -> DataFrame:
    """Per segment and issuer alert, the parts of the day and weekend flags with the largest totals."""
    return top_by(outliers, [ISSUER_SEGMENT, HAS_ALERT], ["bloque_horario", "es_fin_de_semana"], n=n)
