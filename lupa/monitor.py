"""Tracking of predictions: scoring runs, delayed truth, and error per time window."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab as v

# Numbers of copies made in one array.
COPIES = 65536


def predict(
    scored: DataFrame, run_id: str, predicted_at: Column, key: Sequence[str] = v.DOCUMENT_KEY,
    prediction: str = "score",
) -> DataFrame:
    """One tracked prediction per document, with a unique id that a repeated run reproduces.

    The id is made from key, prediction and run, and from the number of the copy where several
    documents agree in all of these. Copies are counted before they are numbered, so many copies of
    one document meet as partial counts; numbers are made in blocks of ``COPIES``.
    """
    counted = scored.groupBy(*key, F.col(prediction).alias("prediction")).agg(F.count("*").alias("_n"))
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES).cast("long"))
    first = F.col("_block") * COPIES + 1
    copies = F.sequence(first, F.least(first + (COPIES - 1), F.col("_n")))
    rows = counted.withColumn("_block", F.explode(blocks)).withColumn("_copy", F.explode(copies))
    parts = [_marked(F.col(name).cast("string")) for name in (*key, "prediction", "_copy")]
    return rows.select(
        F.sha2(F.concat(*parts, _marked(F.lit(run_id))), 256).alias("uuid"), *key, "prediction",
        predicted_at.alias("predicted_at"), F.lit(run_id).alias("run_id"),
    )


def _marked(text: Column) -> Column:
    """A text behind its length, and a mark for null, so that different keys never read the same."""
    return F.when(text.isNull(), "-").otherwise(F.concat(F.char_length(text).cast("string"), F.lit(":"), text))


def read(predictions: DataFrame, start: Column, end: Column, time: str = "predicted_at") -> DataFrame:
    """Predictions made between two times, both included."""
    return predictions.where((F.col(time) >= start) & (F.col(time) <= end))


def with_truth(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions with the result known later, null while unknown."""
    return predictions.join(truth.select("uuid", "actual_result"), "uuid", "left")


def mean_absolute_error(tracked: DataFrame) -> DataFrame:
    """Mean absolute error over the predictions whose result is known."""
    known = tracked.where(F.col("actual_result").isNotNull())
    error = F.abs(F.col("actual_result") - F.col("prediction"))
    return known.agg(F.avg(error).alias("mean_absolute_error"), F.count("*").alias("predictions"))


def metric(value: DataFrame, name: str, start: Column, end: Column, model: str) -> DataFrame:
    """One metric row for a time window: start, end, model, name, value."""
    return value.select(
        start.alias("window_start"), end.alias("window_end"), F.lit(model).alias("model"),
        F.lit(name).alias("metric"), F.col(name).alias("value"),
    )


def record(rows: DataFrame, path: str, run_id: str) -> None:
    """Add the rows of a run to the table at ``path``, partitioned by ``run_id``.

    A run that is repeated replaces its own rows and no others.
    """
    rows.drop("run_id").write.mode("overwrite").parquet(f"{path.rstrip('/')}/run_id={quote(run_id, safe='')}")
