"""Exact quantiles by repeated histograms, and summaries built on them.

No pass shuffles values: tasks count the values of each bin, and only these counts are shuffled, at most as
many for each task as there are bins. The first histogram has ``OCTAVE`` bins for each doubling of the
value; running totals over its bins tell which bin holds each wanted rank. Each further one counts the
values of those bins alone, in ``FINE`` bins between the lowest and highest value seen in them, until a
bin that holds a rank has one value. A bin becomes narrower by ``FINE`` each time, so that doubles take
five passes at most; whole amounts up to some millions take two.

Every pass reads the values again: store what is costly to compute.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .keys import spread_left_join

# Bins for each doubling. Doubles span 2,098 doublings and two signs, so there are some two million bins for
# any data; amounts from 1 to 10 billion make 17,000.
OCTAVE = 512
# Bins between the lowest and highest value of a bin of the pass before.
FINE = 4096
# Bounds of groups that are sent to all tasks; more of them are joined by group.
MOST_SENT = 200_000


def _numbers(df: DataFrame, value: str, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    number = F.col(value).cast("double")
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(number))
    for key in keys:
        kept = kept.where(F.col(key).isNotNull())
    return kept, number


def values_of(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Keys and value ``v`` of each row; null keys, null values and NaN are left out."""
    kept, number = _numbers(df, value, keys)
    return kept.select(*keys, number.alias("v"))


def with_group_rows(rows: DataFrame, few: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """``rows`` joined to a table with one row for each group, of ``size`` rows.

    The table is sent to all tasks if it is small, else hot groups are spread. Without keys its one row is a
    constant of the plan.
    """
    if not keys:
        return rows.withColumns({name: few.select(name).scalar() for name in few.columns})
    if size <= MOST_SENT:
        return rows.join(F.broadcast(few), list(keys))
    named = few.select(*(F.col(k).alias(f"_group{i}") for i, k in enumerate(keys)), *(c for c in few.columns if c not in keys))
    return spread_left_join(rows, named, [(k, f"_group{i}") for i, k in enumerate(keys)]).where("_group0 IS NOT NULL")


def _log_bin(v: Column) -> Column:
    """A whole number that never falls where the value rises; the infinities have bins of their own."""
    height = F.least(F.log2(F.abs(v)), F.lit(1025.0)) + 1075
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * (F.floor(height * OCTAVE) + 1)).cast("long")


def _of_ranks(bins: DataFrame, part: Sequence[str], bin: str, ranks: Column) -> DataFrame:
    """The bins that hold a rank, once for each of these ``ranks``, with the rank inside the bin.

    ``bins`` has ``bin``, ``n``, ``lowest`` and ``highest``; there is a running total for each ``part``.
    """
    group = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))
    running = group.orderBy(bin).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = bins.withColumn("_total", F.sum("n").over(group)).withColumn("_upto", F.sum("n").over(running))
    before = F.col("_upto") - F.col("n")
    here = F.filter(F.col("_ranks"), lambda w: (w["rank"] > before) & (w["rank"] <= F.col("_upto")))
    return totals.withColumn("_ranks", ranks).withColumn("_before", before).withColumn("_here", F.explode(here))


def _selected(values: DataFrame, keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """For each group and probability, ``name``, the order statistics ``low`` and ``high`` around it as
    ``side``, their value ``lowest`` and the rows of the group."""
    keys = list(keys)
    last = F.col("_total") - 1
    wanted = F.array(*(
        F.struct(
            F.lit(name).alias("name"), F.lit(side).alias("side"),
            (rounding(last * F.lit(float(q))) + 1).cast("long").alias("rank"),
        )
        for name, q in probs.items()
        for side, rounding in (("low", F.floor), ("high", F.ceil))
    ))
    counted = [F.count("*").alias("n"), F.min("v").alias("lowest"), F.max("v").alias("highest")]
    bins = values.groupBy(*keys, _log_bin(F.col("v")).alias("_bin")).agg(*counted)
    here = [F.col(f"_here.{c}").alias(c) for c in ("name", "side")]
    inside = (F.col("_here.rank") - F.col("_before")).alias("rank")
    found = stage(
        _of_ranks(bins, keys, "_bin", wanted).select(*keys, F.col("_total").alias("rows"), *here, inside, "lowest", "highest"), "ranks"
    )
    while True:
        open_ = found.where("lowest < highest")
        ranges = open_.groupBy(*keys).agg(F.collect_set(F.struct("lowest", "highest")).alias("_ranges"))
        size = ranges.where(F.size("_ranges") > 0).count()
        if not size:
            return found
        held = F.get(F.filter("_ranges", lambda r: (F.col("v") >= r["lowest"]) & (F.col("v") <= r["highest"])), F.lit(0))
        near = with_group_rows(values, ranges, keys, size).select(*keys, "v", held.alias("_range")).where("_range IS NOT NULL")
        share = (F.col("v") - F.col("_range.lowest")) / (F.col("_range.highest") - F.col("_range.lowest"))
        fine = F.floor(share * FINE).cast("int")
        bins = near.groupBy(*keys, F.col("_range.lowest").alias("_from"), F.col("_range.highest").alias("_to"), fine.alias("_fine")).agg(*counted)
        part = [*keys, "_from", "_to"]
        goals = open_.groupBy(*keys, F.col("lowest").alias("_from"), F.col("highest").alias("_to"), "rows").agg(
            F.collect_list(F.struct("name", "side", "rank")).alias("_ranks")
        )
        narrower = _of_ranks(bins.join(goals, part), part, "_fine", F.col("_ranks"))
        narrower = narrower.select(*keys, "rows", *here, inside, "lowest", "highest")
        found = stage(found.where("NOT lowest < highest").unionByName(narrower), "ranks")


def _interpolate(name: str, q: float) -> Column:
    low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
    position = (F.col("rows") - 1) * F.lit(float(q))
    # equal ends, which may be infinite, have no distance
    return F.when(low == high, low).otherwise(low + (high - low) * (position - F.floor(position)))


def quantiles(
    df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = (),
    accuracy: int | None = None,
) -> DataFrame:
    """Quantiles per group and the group's row count ``rows``.

    Exact and interpolated by default; with ``accuracy``, a one-pass sketch whose rank error is at
    most ``1 / accuracy``.
    """
    if accuracy is None:
        found = _selected(values_of(df, value, keys), keys, probs)
        at = lambda name, side: F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("lowest")))
        ends = [at(name, side).alias(f"_{name}_{side}") for name in probs for side in ("low", "high")]
        groups = found.groupBy(*keys).agg(F.max("rows").alias("rows"), *ends)
        return groups.select(*keys, "rows", *(_interpolate(name, q).alias(name) for name, q in probs.items()))
    kept, number = _numbers(df, value, keys)
    return kept.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        *(F.percentile_approx(number, q, accuracy).alias(name) for name, q in probs.items()),
    )


def iqr_fences(df: DataFrame, value: str, keys: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """First and third quartile and the fences 1.5 interquartile ranges outside them."""
    quartiles = quantiles(df, value, {"q1": 0.25, "q3": 0.75}, keys, accuracy)
    spread = F.col("q3") - F.col("q1")
    return quartiles.select(
        *keys, "q1", "q3", spread.alias("iqr"), (F.col("q1") - 1.5 * spread).alias("lower_bound"),
        (F.col("q3") + 1.5 * spread).alias("upper_bound"),
    )


def within_fences(df: DataFrame, value: str, accuracy: int | None = None) -> DataFrame:
    """Rows inside the fences of the whole set, both ends included."""
    bounds = iqr_fences(df, value, accuracy=accuracy)
    fence = bounds.select(F.struct("lower_bound", "upper_bound")).scalar()
    number = F.col(value).cast("double")
    return df.where((number >= fence["lower_bound"]) & (number <= fence["upper_bound"]))


def box_summary(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Per group: rows, quartiles and whiskers, the extreme values inside 1.5 interquartile ranges."""
    keys = list(keys)
    values = values_of(df, value, keys)
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    summary = stage(quantiles(df, value, probs, keys).drop("rows"), "quartiles")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach)
    return (
        with_group_rows(values, summary, keys, summary.count())
        .groupBy(*keys, *probs)
        .agg(
            F.count("*").alias("rows"), F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        )
    )
