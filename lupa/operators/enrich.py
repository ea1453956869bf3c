"""Attach taxpayer profiles to both parties of a document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as v
from .documents import party_statistics
from .keys import spread_left_join, with_prefix

# Parties of a role, with their statistics and profile (some 300 bytes each), that are sent to all tasks.
MOST_SENT = 500_000


def attach_profile(
    documents: DataFrame, profile: DataFrame, role: str, counted: DataFrame | None = None
) -> DataFrame:
    """Left join of the prefixed profile on id and check digit."""
    rut, dv = v.ROLE_KEY[role]
    on = [(rut, f"{role}{v.RUT}"), (dv, f"{role}{v.DV}")]
    return spread_left_join(documents, with_prefix(profile, role), on, counted=counted)


def parties(documents: DataFrame, profile: DataFrame) -> DataFrame:
    """Documents with the profile of issuer (``emis_``) and receiver (``recep_``).

    ``documents`` is also read to count its keys, so it should be stored rather than computed.
    """
    issued = attach_profile(documents, profile, v.ISSUER)
    return attach_profile(issued, profile, v.RECEIVER, counted=documents)


def enriched_sample(documents: DataFrame, profile: DataFrame) -> DataFrame:
    """The 53 columns kept for sampled documents."""
    return parties(documents, profile).select(*v.ENRICHED_SAMPLE)


def enriched_full(documents: DataFrame, profile: DataFrame) -> DataFrame:
    """The 57 columns kept for all documents: the sample's plus both parties' keys."""
    return parties(documents, profile).select(*v.ENRICHED_FULL)


def parties_with_statistics(
    documents: DataFrame, profile: DataFrame, columns: Sequence[str] = v.PROFILE_COLUMNS
) -> DataFrame:
    """``with_party_statistics`` and ``parties`` with one join per role instead of two.

    Statistics match on the id, profiles on id and check digit. Since a profile has one row per
    id, both are merged per id first and the check digit is compared afterwards, so the documents
    move twice in all rather than four times, and once if a role has at most ``MOST_SENT`` parties: those of the
    role with fewer are then sent to all tasks, after the join of the other role, which moves the documents alone.
    ``documents`` is read once more to count parties. What a party brings travels and is sorted as one struct, which
    is copied as a whole, and is opened once both joins are done.
    """
    opened = list(documents.columns)
    joins = {}
    for role in (v.ISSUER, v.RECEIVER):
        rut, dv = v.ROLE_KEY[role]
        stats = party_statistics(documents, role).withColumnRenamed(rut, "_party")
        side = with_prefix(profile.select(*columns), role)
        packed = f"_{role}"
        dimension = stats.join(side, F.col("_party") == F.col(f"{role}{v.RUT}"), "left").select(
            "_party", F.struct(F.struct(*v.stat_columns(role)).alias("statistics"), F.struct(*side.columns).alias("profile")).alias(packed)
        )
        joins[role] = (rut, dimension)
        same = F.col(dv) == F.col(f"{packed}.profile.{role}{v.DV}")
        opened += [F.col(f"{packed}.statistics.{name}") for name in v.stat_columns(role)]
        opened += [F.when(same, F.col(f"{packed}.profile.{name}")).alias(name) for name in side.columns]
    sent = _sent_role(documents)
    result = documents
    for role in sorted(joins, key=lambda r: r == sent):
        rut, dimension = joins[role]
        if role == sent:
            result = result.join(F.broadcast(dimension), F.col(rut) == F.col("_party"), "left").drop("_party")
        else:
            result = spread_left_join(result, dimension, [(rut, "_party")], counted=documents).drop("_party")
    return result.select(*opened)


def _sent_role(documents: DataFrame) -> str | None:
    """The role with fewer parties, if they are few enough to be sent to all tasks."""
    counts = documents.agg(*(F.approx_count_distinct(v.ROLE_KEY[role][0]).alias(role) for role in v.ROLE_KEY)).first()
    fewest = min(v.ROLE_KEY, key=lambda role: counts[role])
    return fewest if counts[fewest] <= MOST_SENT else None
