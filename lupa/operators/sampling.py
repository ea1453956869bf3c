"""Reproducible class-balanced samples.

All draws depend on document keys and a seed, never on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as v
from ..functions import columns as c
from .keys import spread_left_join

CLASS = "tipo_contribuyente"
ROLE_CLASS = {v.ISSUER: "tipo_emisor", v.RECEIVER: "tipo_receptor"}


def with_class(
    documents: DataFrame, profile: DataFrame, role: str, name: str = CLASS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Documents with the taxpayer class of one party; unknown parties are ``indefinido``."""
    rut, dv = v.ROLE_KEY[role]
    label = c.taxpayer_class(F.col("ES_EMPRESA"), F.col("ES_PERSONA"))
    classes = profile.select(F.col(v.RUT).alias("_rut"), F.col(v.DV).alias("_dv"), label.alias("_class"))
    joined = spread_left_join(documents, classes, [(rut, "_rut"), (dv, "_dv")], counted=counted)
    return joined.select(
        *documents.columns, F.coalesce("_class", F.lit(v.UNDEFINED)).alias(name)
    )


def class_sizes(
    classed: DataFrame, count_key: str | None = "dhdr_rut_emisor", name: str = CLASS
) -> DataFrame:
    """Distinct parties per class, or rows per class when ``count_key`` is None.

    Issuers are counted for receiver classes as well by default. Fractions from parties do not
    balance the number of rows; fractions from rows do.
    """
    size = F.count("*") if count_key is None else F.countDistinct(count_key)
    return classed.groupBy(name).agg(size.alias("num_cont_rut_unicos"))


def fractions(sizes: DataFrame, name: str = CLASS) -> DataFrame:
    """Share of rows to keep per class: smallest class size over own size.

    ``sizes`` has one row per class label, at most six, so one window over all of it is fine.
    """
    everything = Window.partitionBy(F.lit(1))
    smallest = F.min("num_cont_rut_unicos").over(everything)
    return sizes.select(
        name, (smallest / F.nullif(F.col("num_cont_rut_unicos"), F.lit(0))).alias("fraccion")
    )


def stratified(
    classed: DataFrame, shares: DataFrame, seed: int = 42, key: Sequence[str] = v.DOCUMENT_KEY,
    name: str = CLASS,
) -> DataFrame:
    """Bernoulli sample with one fraction per class.

    The fractions table has one row per class label, which bounds the broadcast.
    """
    return (
        classed.join(F.broadcast(shares), name)
        .where(c.hash01(key, seed) < F.col("fraccion"))
        .select(*classed.columns)
    )


def equalise(
    first: DataFrame, second: DataFrame, seed: int = 43, key: Sequence[str] = v.DOCUMENT_KEY
) -> tuple[DataFrame, DataFrame]:
    """Thin the larger of two samples to the expected size of the smaller one."""
    sides = first.select(F.lit(1).alias("side")).unionByName(second.select(F.lit(2).alias("side")))
    n = sides.agg(
        F.struct(F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 2).alias("n2"))
    ).scalar()
    draw = c.hash01(key, seed)
    return first.where(draw * n["n1"] < n["n2"]), second.where(draw * n["n2"] < n["n1"])


def union_distinct(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union by column name without repeated rows."""
    return first.unionByName(second).dropDuplicates()


def with_both_classes(documents: DataFrame, profile: DataFrame) -> DataFrame:
    """Documents with the class of the issuer and of the receiver."""
    issued = with_class(documents, profile, v.ISSUER, ROLE_CLASS[v.ISSUER])
    return with_class(issued, profile, v.RECEIVER, ROLE_CLASS[v.RECEIVER], counted=documents)


def balanced_of(
    classed: DataFrame, seed: int = 42, key: Sequence[str] = v.DOCUMENT_KEY,
    count_key: str | None = "dhdr_rut_emisor",
) -> DataFrame:
    """Balanced sample over issuer classes and receiver classes, equalised and merged.

    Both samples are drawn from the same rows, so their union without repeats is one filter and
    one ``dropDuplicates``. ``classed`` is read a few times: stage it first on large data.
    """
    columns = [name for name in classed.columns if name not in ROLE_CLASS.values()]
    marked = classed
    for role, name in ROLE_CLASS.items():
        shares = fractions(class_sizes(classed, count_key, name), name)
        drawn = c.hash01(key, seed) < F.col("fraccion")
        marked = marked.join(F.broadcast(shares), name).withColumn(f"_in_{role}", drawn).drop("fraccion")
    inside = {role: F.col(f"_in_{role}") for role in ROLE_CLASS}
    n = marked.agg(F.struct(*(F.count_if(hit).alias(role) for role, hit in inside.items()))).scalar()
    again = c.hash01(key, seed + 1)
    first, second = ROLE_CLASS
    keep = (inside[first] & (again * n[first] < n[second])) | (
        inside[second] & (again * n[second] < n[first])
    )
    return marked.where(keep).select(*columns).dropDuplicates()


def balanced(
    documents: DataFrame, profile: DataFrame, seed: int = 42, key: Sequence[str] = v.DOCUMENT_KEY
) -> DataFrame:
    return balanced_of(with_both_classes(documents, profile), seed, key)


def split(
    df: DataFrame, test_share: float = 0.2, seed: int = 42, key: Sequence[str] = v.DOCUMENT_KEY
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows, divided by the hash of the document key."""
    in_test = c.hash01(key, seed) < test_share
    return df.where(~in_test), df.where(in_test)
