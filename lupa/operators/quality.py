"""Counts that tell whether data is complete and keys are unique."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as v


def uniqueness(df: DataFrame, key: str, relative_error: float | None = None) -> DataFrame:
    """Row count and distinct-key count; the latter by sketch when an error is allowed."""
    distinct = F.countDistinct(key) if relative_error is None else F.approx_count_distinct(key, relative_error)
    return df.agg(F.count(key).alias("rows"), distinct.alias("distinct_keys"))


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null count per column, all columns in one pass."""
    one_row = df.agg(*(F.count_if(F.col(name).isNull()).alias(name) for name in columns))
    return one_row.unpivot([], list(columns), "column", "nulls")


def null_comparison(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null counts before and after imputation, side by side."""
    first = null_report(before, columns).withColumnRenamed("nulls", "nulls_before")
    second = null_report(after, columns).withColumnRenamed("nulls", "nulls_after")
    return first.join(second, "column")


def party_totals(documents: DataFrame, *keys: str) -> DataFrame:
    """Documents and amount per issuer, per receiver or per pair."""
    return documents.groupBy(*keys).agg(
        F.count("*").alias("documents"), F.sum(F.col(v.AMOUNT).cast("double")).alias("total_monto")
    )


def integrity_report(documents: DataFrame, profile: DataFrame) -> DataFrame:
    """Missing keys, repeated document keys and parties without a profile, one row per check."""
    missing = documents.agg(
        *(
            F.count_if(F.col(name).isNull()).alias(f"null_{name}")
            for name in (*v.DOCUMENT_KEY, "dhdr_rut_recep", "dhdr_dv_recep", v.AMOUNT, v.SIGNED)
        )
    )
    repeated = (
        documents.groupBy(*v.DOCUMENT_KEY).count().where("count > 1")
        .agg(F.count("*").alias("repeated_document_keys"))
    )
    checks = [
        missing.unpivot([], missing.columns, "check", "found"),
        repeated.unpivot([], repeated.columns, "check", "found"),
    ]
    known = profile.select(v.RUT, v.DV)
    for role, (rut, dv) in v.ROLE_KEY.items():
        parties = documents.groupBy(F.col(rut).alias(v.RUT), F.col(dv).alias(v.DV)).count()
        unknown = parties.join(known, [v.RUT, v.DV], "left_anti").agg(
            F.coalesce(F.sum("count"), F.lit(0)).alias(f"documents_without_{v.ROLE_SUFFIX[role]}_profile")
        )
        checks.append(unknown.unpivot([], unknown.columns, "check", "found"))
    return reduce(DataFrame.unionByName, checks)
