"""Imputation, encoding, scaling and assembly of the model's columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as v
from ..operators.keys import spread_left_join
from ..session import stage

# Levels of a column that are sent to all tasks; more of them are joined.
MOST_SENT = 200_000


def fill_alerts(df: DataFrame, columns: Sequence[str] = v.MODEL_ALERTS) -> DataFrame:
    return df.na.fill(0, list(columns))


def fill_numeric(df: DataFrame, columns: Sequence[str] = v.NUMERIC) -> DataFrame:
    return df.na.fill(0, list(columns))


def fill_category(df: DataFrame, columns: Sequence[str] = v.IMPUTED_TEXT) -> DataFrame:
    return df.na.fill(v.UNKNOWN, list(columns))


def imputed(df: DataFrame) -> DataFrame:
    """Alerts and numbers become 0 where missing, segments and subsectors ``Desconocido``.

    The day and week columns of a document without signature time become 0 as well.
    """
    return fill_category(fill_numeric(fill_alerts(df))).na.fill(0, list(v.PASS_THROUGH))


def levels(df: DataFrame, columns: Sequence[str] = v.TEXT) -> DataFrame:
    """Distinct values per text column, as (column, level)."""
    return df.select(*columns).unpivot([], list(columns), "column", "level").distinct()


# -- one-hot encoding --------------------------------------------------------


@dataclass
class Encoder:
    """Fitted one-hot encoding; the alphabetically first level of each column has no slot.

    ``table`` holds ``column``, ``level`` and ``rank``, 0 for the alphabetically last level: it may have any number
    of levels. ``sizes`` has the number of levels per column. A column with a single level has no slot and is left out.
    """

    table: DataFrame
    sizes: dict[str, int]

    @property
    def columns(self) -> list[str]:
        return list(self.sizes)

    @property
    def labels(self) -> dict[str, list[str]]:
        """All levels by rank, for columns with few of them."""
        found = {col: [] for col in self.sizes}
        for row in self.table.where(F.col("column").isin(self.columns)).orderBy("column", "rank").collect():
            found[row["column"]].append(row["level"])
        return found

    @property
    def names(self) -> list[str]:
        """Names of all slots, for columns with few levels."""
        return [f"{col}_{level}" for col, levels in self.labels.items() for level in levels[:-1]]

    def names_of(self, slots: Sequence[int]) -> dict[int, str]:
        """Names of some slots, counted over all columns."""
        first, wanted = 0, []
        for col, size in self.sizes.items():
            wanted += [(slot, col, slot - first) for slot in slots if first <= slot < first + size - 1]
            first += size - 1
        if not wanted:
            return {}
        few = self.table.sparkSession.createDataFrame(wanted, "slot int, column string, rank long")
        found = self.table.join(F.broadcast(few), ["column", "rank"]).select("slot", "column", "level").collect()
        return {row["slot"]: f"{row['column']}_{row['level']}" for row in found}

    @property
    def slots(self) -> dict[str, int]:
        """Slots per ``<column>_index``."""
        return {f"{col}_index": size - 1 for col, size in self.sizes.items()}

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``<column>_index``, the rank of the level; one not seen in fitting gets that of the first level, no slot.

        The levels of a column are joined, sent to all tasks if they are few, else with hot levels spread.
        """
        result = df
        for col, size in self.sizes.items():
            ranks = self.table.where(F.col("column") == col).select(F.col("level").alias("_level"), F.col("rank").alias("_rank"))
            if size <= MOST_SENT:
                joined = result.join(F.broadcast(ranks), F.col(col) == F.col("_level"), "left")
            else:
                joined = spread_left_join(result, ranks, [(col, "_level")], counted=df)
            index = F.coalesce("_rank", F.lit(size - 1)).cast("double")
            result = joined.withColumn(f"{col}_index", index).drop("_level", "_rank")
        return result


def fit_encoder(df: DataFrame, columns: Sequence[str] = v.TEXT) -> Encoder:
    """Levels ranked without gathering them: sorted over ranges, each range numbered by itself, and moved
    on by the number of levels of its column in the ranges before."""
    found = levels(df, columns).where(F.col("level").isNotNull())
    order = ["column", F.desc("level")]
    ranged = found.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(ranged.withColumn("_place", F.monotonically_increasing_id()), "levels").withColumn("_range", F.shiftright("_place", 33))
    ranges = placed.groupBy("column", "_range").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy("column").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("column", "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = placed.join(offsets, ["column", "_range"]).select(
        "column", "level", (F.col("_place") - F.col("_first") + F.col("_before")).alias("rank")
    )
    table = stage(ranked, "ranks")
    sizes = {row["column"]: row["count"] for row in table.groupBy("column").count().collect()}
    return Encoder(table, {col: sizes[col] for col in columns if sizes.get(col, 0) > 1})


def level_totals(encoded: DataFrame, encoder: Encoder) -> DataFrame:
    """Documents per one-hot slot, as (column, level, total); also of levels that no document has."""
    index = [F.col(f"{col}_index").cast("long").alias(col) for col in encoder.columns]
    tall = encoded.select(*index).unpivot([], encoder.columns, "column", "rank")
    counts = tall.groupBy("column", "rank").agg(F.count("*").alias("_total"))
    sizes = F.create_map(*(F.lit(x) for pair in encoder.sizes.items() for x in pair))
    kept = encoder.table.where(F.col("rank") < F.coalesce(F.get(F.array(sizes), F.lit(0))[F.col("column")], F.lit(0)) - 1)
    return kept.join(counts, ["column", "rank"], "left").select("column", "level", F.coalesce("_total", F.lit(0)).alias("total"))


# -- scaling -----------------------------------------------------------------


@dataclass
class Scaler:
    """Mean and population deviation per column; a constant column scales to 0."""

    means: dict[str, float]
    deviations: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                name: (F.col(name) - mean) / (self.deviations[name] or 1.0)
                for name, mean in self.means.items()
            }
        )


def moments(df: DataFrame, columns: Sequence[str] = v.NUMERIC) -> DataFrame:
    """One row with mean and population deviation of each column, in one pass."""
    return df.agg(
        *(fn(name).alias(f"{label}_{name}") for name in columns for label, fn in (("mean", F.avg), ("std", F.stddev_pop)))
    )


def fit_scaler(df: DataFrame, columns: Sequence[str] = v.NUMERIC) -> Scaler:
    row = moments(df, columns).first()
    return Scaler(
        {name: row[f"mean_{name}"] or 0.0 for name in columns},
        {name: row[f"std_{name}"] or 0.0 for name in columns},
    )


# -- assembly ----------------------------------------------------------------


def feature_names(encoder: Encoder) -> list[str]:
    """Names of the slots of the assembled vector, in order."""
    return [*v.NUMERIC, *v.PASS_THROUGH, *encoder.names]


def names_of(encoder: Encoder, slots: Sequence[int], plain: Sequence[str] = (*v.NUMERIC, *v.PASS_THROUGH)) -> dict[int, str]:
    """Names of some slots of the assembled vector."""
    found = encoder.names_of([slot - len(plain) for slot in slots])
    return {slot: plain[slot] if slot < len(plain) else found[slot - len(plain)] for slot in slots}


def assemble(encoded: DataFrame, encoder: Encoder, output: str = "features") -> DataFrame:
    """One sparse vector per document; the identifying columns stay beside it.

    For Spark ML's estimators, which keep an attribute for every slot: with very many levels take ``entries``.
    """
    index = {
        f"{col}_index": F.col(f"{col}_index").alias(f"{col}_index", metadata={"ml_attr": {"type": "nominal", "num_vals": size}})
        for col, size in encoder.sizes.items()
    }
    sized = encoded.withColumns(index)
    onehot = [f"{col}_onehot" for col in encoder.columns]
    if onehot:
        encoding = OneHotEncoder(inputCols=list(index), outputCols=onehot, dropLast=True)
        # the index columns carry their number of levels, so no row is read here
        sized = encoding.fit(sized.select(*index).limit(0)).transform(sized)
    vector = VectorAssembler(inputCols=[*v.NUMERIC, *v.PASS_THROUGH, *onehot], outputCol=output).transform(sized)
    return vector.drop(*onehot)


def entries(
    encoded: DataFrame, encoder: Encoder, output: str = "features", plain: Sequence[str] = (*v.NUMERIC, *v.PASS_THROUGH)
) -> DataFrame:
    """The assembled vector as a struct of its parts, without attributes, for any number of levels.

    It has the fields of a sparse vector: ``type`` 0, ``size``, ``indices`` and ``values``, of which some may be 0: all
    plain columns, and the slot of the level of each encoded one.
    """
    indices = [F.lit(i) for i in range(len(plain))]
    values = [F.coalesce(F.col(name).cast("double"), F.lit(0.0)) for name in plain]
    first = len(plain)
    for col, size in encoder.sizes.items():
        index = F.col(f"{col}_index").cast("int")
        indices.append(index + first)
        values.append(F.when(index < size - 1, 1.0).otherwise(0.0))
        first += size - 1
    parts = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(first).alias("size"), F.array(*indices).alias("indices"), F.array(*values).alias("values")
    )
    return encoded.withColumn(output, parts)
