"""Recent documents, party statistics and time features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as v
from ..functions import columns as c
from .keys import spread_left_join


def recent(
    documents: DataFrame, months: int | None = None, days: int | None = None, date: str = v.EMITTED,
    month_partition: str | None = None,
) -> DataFrame:
    """Documents dated within the last months or days before the newest one, bound included.

    The bound is a scalar subquery, so the plan stays lazy and the comparison reaches the scan.
    When the table is partitioned by month of ``date`` as ``yyyy-MM`` text, name that column: the
    newest date is then looked up in the last month only, and older months are not read.
    """
    if (months is None) == (days is None):
        raise ValueError("give either months or days")
    newest = F.max(date)
    bound = F.add_months(newest, -months) if months is not None else F.date_sub(newest, days)
    if month_partition is None:
        return documents.where(F.col(date) >= documents.agg(bound).scalar())
    month = F.col(month_partition)
    last = documents.where(month == documents.agg(F.max(month)).scalar())
    first_month = last.agg(F.date_format(bound, "yyyy-MM")).scalar()
    return documents.where((month >= first_month) & (F.col(date) >= last.agg(bound).scalar()))


def party_statistics(documents: DataFrame, role: str) -> DataFrame:
    """Mean and sample deviation of amount and VAT per issuer or receiver."""
    rut, _ = v.ROLE_KEY[role]
    suffix = v.ROLE_SUFFIX[role]
    measures = [
        fn(name).alias(f"{label}_{name}_{suffix}")
        for name in (v.AMOUNT, v.VAT)
        for label, fn in (("avg", F.avg), ("stddev", F.stddev_samp))
    ]
    return documents.groupBy(rut).agg(*measures)


def with_party_statistics(documents: DataFrame) -> DataFrame:
    """Documents with the statistics of both parties, matched on the taxpayer id alone."""
    result = documents
    for role in (v.ISSUER, v.RECEIVER):
        rut, _ = v.ROLE_KEY[role]
        stats = party_statistics(documents, role).withColumnRenamed(rut, "_party")
        joined = spread_left_join(result, stats, [(rut, "_party")], counted=documents)
        result = joined.drop("_party")
    return result


def with_time_features(documents: DataFrame, signed: str = v.SIGNED) -> DataFrame:
    return documents.withColumns(c.time_features(F.col(signed)))


def featured(documents: DataFrame) -> DataFrame:
    """Statistics of both parties and time features in one go."""
    return with_time_features(with_party_statistics(documents))
