"""Key handling: prefixes, latest records, unique keys and joins that tolerate hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key counts as hot when it holds more than this share of the rows, so there are fewer than
# 1 / HOT_SHARE hot keys whatever the size of the data.
HOT_SHARE = 0.002
HOT_SPLITS = 64
# Rows of a hot key that share a sub-key, about.
SPLIT_ROWS = 1_000_000
# Keys that a sketch follows and keys it returns. Its error is at most 3.5 / TRACKED of the rows, so every key
# above the share is among the returned ones, with room to spare.
TRACKED = 16384
RETURNED = 1024
SKETCHES = 64


def with_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(name).alias(prefix + name) for name in df.columns))


def latest_with_ties(
    df: DataFrame, key: Sequence[str], order: Column, match: Sequence[str] | None = None
) -> DataFrame:
    """Rows whose ``order`` is the largest of their key; ties stay, null orders and keys go.

    A partial maximum per key is joined back on (key, order). Unlike a rank window, no task ever
    holds all rows of a key, however many of them tie. With ``match``, a part of the key, a row
    stays when it equals the maximum of any key that shares those columns.
    """
    ordered = df.withColumn("_order", order).where(F.col("_order").isNotNull())
    best = ordered.groupBy(*key).agg(F.max("_order").alias("_order"))
    on = [*(match or key), "_order"]
    if match:
        best = best.select(*on).distinct()
    pairs = [(name, f"_best{i}") for i, name in enumerate(on)]
    best = best.select(*(F.col(name).alias(new) for name, new in pairs))
    return spread_left_join(ordered, best, pairs, how="left_semi").select(*df.columns)


def latest_one(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Exactly one row per key, the first by ``order``.

    Spark keeps one row per key in each map task before the shuffle, so a hot key costs one row
    per task.
    """
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(window)).where("_row = 1").drop("_row")


def unique_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key value occurs exactly once; null keys go.

    Keys are counted with partial counts in the map tasks, and rows of hot keys, which are none of those, are
    spread while the others find theirs.
    """
    known = df.where(F.col(key).isNotNull())
    once = known.groupBy(F.col(key).alias("_once")).count().where("count = 1").select("_once")
    return spread_left_join(known, once, [(key, "_once")], how="left_semi")


def spread_left_join(
    left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], splits: int = HOT_SPLITS,
    counted: DataFrame | None = None, how: str = "left",
) -> DataFrame:
    """``left`` outer- or semi-joined to ``right``, with hot left keys spread over tasks.

    ``right`` should hold few rows per key. Rows of a hot key get one of at least ``splits`` sub-keys,
    more of them the more rows it has, and the matching right rows are repeated once per sub-key; all other keys have a single sub-key.
    Rows with a null key match nothing and are spread as well.

    ``counted`` is where keys are counted: the documents before earlier joins, so that a chain of
    joins does not repeat itself inside every count.
    """
    lkeys, rkeys = [l for l, _ in on], [r for _, r in on]
    hot = _marked_hot(left if counted is None else counted, lkeys, splits)
    any_null = reduce(Column.__or__, (F.col(k).isNull() for k in lkeys))
    spread = _with_hot(left, hot, lkeys).select(
        *left.columns,
        F.when(F.col("_is_hot") | any_null, _sub_key(left, splits)).otherwise(0).alias("_sub"),
    )
    repeated = _with_hot(right, hot, rkeys).select(
        *right.columns, F.explode(_sub_keys(F.lit(0))).alias("_rsub")
    )
    condition = reduce(
        Column.__and__, (F.col(l) == F.col(r) for l, r in on), F.col("_sub") == F.col("_rsub")
    )
    return spread.join(repeated, condition, how).drop("_sub", "_rsub")


def spread_right_join(
    left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], splits: int = HOT_SPLITS
) -> DataFrame:
    """``left`` outer-joined to ``right`` where a key may have very many rows on the right.

    Here the right rows of a hot key get sub-keys and the left rows are repeated. A hot key does
    have right rows, so its left rows always match somewhere and the repeats that find nothing are
    dropped. Left rows with a null key match nothing and are spread. Hot left keys are left to
    adaptive execution, which may split the left side.
    """
    lkeys, rkeys = [l for l, _ in on], [r for _, r in on]
    hot = _marked_hot(right, rkeys, splits)
    any_null = reduce(Column.__or__, (F.col(k).isNull() for k in lkeys))
    alone = F.when(any_null, _sub_key(left, splits)).otherwise(0)
    repeated = _with_hot(left, hot, lkeys).select(
        *left.columns, "_is_hot", F.explode(_sub_keys(alone)).alias("_sub")
    )
    spread = _with_hot(right, hot, rkeys).select(
        *right.columns, F.when(F.col("_is_hot"), _sub_key(right, splits)).otherwise(0).alias("_rsub")
    )
    condition = reduce(
        Column.__and__, (F.col(l) == F.col(r) for l, r in on), F.col("_sub") == F.col("_rsub")
    )
    found = F.col("_is_hot").isNull() | F.col("_rsub").isNotNull()
    return repeated.join(spread, condition, "left").where(found).drop("_is_hot", "_sub", "_rsub")


def hot_keys(
    df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE, least: int = 1
) -> DataFrame:
    """Key values that hold more than ``share`` of the rows: fewer than ``1 / share`` of them."""
    return _counted_hot(df, keys, share, least).select(*keys)


def _candidates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hashes ``_code`` of the most frequent keys, fewer than ``RETURNED``, and the number of rows ``_all``.

    A sketch of frequent items for each task, merged in two steps; keys themselves are not shuffled.
    """
    parts = df.select(F.xxhash64(*keys).alias("_code"), F.pmod(F.spark_partition_id(), F.lit(SKETCHES)).alias("_part"))
    sketches = parts.groupBy("_part").agg(F.expr(f"approx_top_k_accumulate(_code, {TRACKED})").alias("_sketch"), F.count("*").alias("_rows"))
    # by a group, as tasks without rows would pass on sketches that can't be merged
    whole = sketches.groupBy(F.col("_part") < 0).agg(F.expr(f"approx_top_k_combine(_sketch, {TRACKED})").alias("_sketch"), F.sum("_rows").alias("_all"))
    found = whole.select("_all", F.explode(F.expr(f"approx_top_k_estimate(_sketch, {RETURNED})")).alias("_item"))
    return found.select(F.col("_item.item").alias("_code"), "_all")


def _counted_hot(df: DataFrame, keys: Sequence[str], share: float, least: int) -> DataFrame:
    """Hot keys with their exact number of rows: a sketch names the candidates, then only those are counted."""
    known = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).select(*keys)
    near = known.join(F.broadcast(_candidates(known, keys)), F.xxhash64(*keys) == F.col("_code"))
    counts = near.groupBy(*keys).agg(F.count("*").alias("_rows"), F.max("_all").alias("_all"))
    hot = counts.where((F.col("_rows") > F.col("_all") * share) & (F.col("_rows") >= least))
    return hot.select(*keys, "_rows")


def _marked_hot(df: DataFrame, keys: Sequence[str], splits: int) -> DataFrame:
    """Hot keys under neutral names. The list is short by construction, see ``HOT_SHARE``."""
    hot = _counted_hot(df, keys, HOT_SHARE, splits)
    needed = F.greatest(F.lit(splits), F.ceil(F.col("_rows") / SPLIT_ROWS).cast("int"))
    named = hot.select(*(F.col(k).alias(f"_hot{i}") for i, k in enumerate(keys)), needed.alias("_splits"))
    return named.withColumn("_is_hot", F.lit(True))


def _with_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with ``_is_hot``, true or null, and ``_splits`` from the short list of hot keys."""
    same = reduce(Column.__and__, (F.col(k) == F.col(f"_hot{i}") for i, k in enumerate(keys)))
    return df.join(F.broadcast(hot), same, "left")


def _sub_key(df: DataFrame, splits: int) -> Column:
    """A sub-key from the row's content and its input partition.

    Never from a random number: a task that is run again must produce the same rows. The partition
    keeps exact copies from staying together.
    """
    content = F.xxhash64(*df.columns)
    return F.pmod(content + F.spark_partition_id(), F.coalesce("_splits", F.lit(splits))).cast("int")


def _sub_keys(alone: Column) -> Column:
    """All sub-keys of a hot key, else the one that is given."""
    every = F.sequence(F.lit(0), F.col("_splits") - 1)
    return F.when(F.col("_is_hot"), every).otherwise(F.array(alone))
