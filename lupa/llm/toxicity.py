"""Toxicity by a chain of linear classifiers.

The categories are learned in a fixed order. The model of a category sees the features of the text and
the probabilities of all categories before it. While training, those probabilities come from models
that were fitted without the document's fold, so a later model does not learn to trust scores that the
earlier model could only give to documents it knew.

Features are hashed: each lower-cased word and its first three to five bytes, and the last two bytes of
each run without blanks, present or not, in ``BUCKETS`` buckets. Every model is fitted on the ``SELECTED`` buckets that depend most on its category
(chi-square over its own training rows). Training uses the documents of at most ``SAMPLE`` labelled
rows, those with the lowest hash of their id. Scoring is a pass over all documents with no shuffle; the
weights that all tasks get have a fixed size of ``4 * BUCKETS`` bytes for each category.

Null and empty texts have no features and get the score of the intercept. Labels of one id are folded
to the highest; null labels are left out. Rows that repeat an id are scored each by their own text, and all of them
train with its labels. Buckets that tie are taken by number. Very long texts are hashed whole. Without any labels
every probability is one half. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupa.llm import words as W
from lupa.session import stage

BUCKETS = 1 << 20
SAMPLE = 20_000
FOLDS = 3
SELECTED = 2048
PREFIXES = (3, 4, 5)

_STRENGTH = 1e-4
_PARTS = 5  # of the bounded sample; few, as every round sums one gradient for each
_ROUNDS = 40


def _table() -> np.ndarray:
    """Words are runs of letters and digits, in lower case, and characters beyond ASCII."""
    return W.ascii_words_table()


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of all texts one after the other, and the number of each text's."""
    words = W.words_of(column, _table())
    owner = words.text_of()
    keys = [words.hash]
    for size in PREFIXES:
        keys.append(W.hashes(words.data, words.start, np.minimum(words.end, words.start + size), seed=100 + size))
    bucket = np.concatenate([k % np.uint64(BUCKETS) for k in keys]).astype(np.int64)
    pair = np.tile(owner, len(keys)) * BUCKETS + bucket
    # how words end, punctuation included
    ends = W.words_of(column, W.split_table())
    tail = W.hashes(ends.data, np.maximum(ends.start, ends.end - 2), ends.end, seed=200) % np.uint64(BUCKETS)
    pair = np.unique(np.concatenate([pair, ends.text_of() * BUCKETS + tail.astype(np.int64)]))
    return pair % BUCKETS, np.bincount(pair // BUCKETS, minlength=len(words.first) - 1)


@dataclass
class Chain:
    """Categories with their weights; category ``i`` has ``i`` weights more, for those before it."""

    categories: tuple[str, ...]
    weights: list[np.ndarray]
    intercepts: list[float]

    def probabilities(self, column) -> list[np.ndarray]:
        bucket, sizes = features(column)
        bounds = np.append(0, np.cumsum(sizes))
        out: list[np.ndarray] = []
        for weights, intercept in zip(self.weights, self.intercepts, strict=True):
            total = np.append(0.0, np.cumsum(weights[bucket]))
            score = total[bounds[1:]] - total[bounds[:-1]] + intercept
            for i, earlier in enumerate(out):
                score = score + weights[BUCKETS + i] * earlier
            out.append(1 / (1 + np.exp(-np.clip(score, -500, 500))))
        return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in W.text_batches(whole, "_text"):
            bucket, sizes = features(batch.column("_text"))
            bounds = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.ListArray.from_arrays(bounds, pa.array(bucket.astype(np.int32)))], ["_id", "_buckets"]
            )


def select(rows: DataFrame, category: str) -> np.ndarray:
    """The buckets of at least three rows that depend most on the category, in ascending order."""
    total = rows.agg(F.count("*").alias("n"), F.sum(category).alias("yes")).first()
    n, yes = float(total["n"]), float(total["yes"])
    held = rows.select(category, F.explode("_buckets").alias("bucket")).groupBy("bucket").agg(
        F.count("*").cast("double").alias("in"), F.sum(category).alias("both")
    ).filter(F.col("in") >= 3)
    gap = n * F.col("both") - yes * F.col("in")
    spread = F.col("in") * (n - F.col("in")) * yes * (n - yes)
    best = held.select("bucket", (n * gap * gap / F.greatest(spread, F.lit(1.0))).alias("chi")).orderBy(F.desc("chi"), "bucket")
    return np.sort(np.array([r["bucket"] for r in best.limit(SELECTED).collect()], np.int64))


def _fit(rows: DataFrame, category: str, earlier: int) -> tuple[np.ndarray, float]:
    """Weights of all buckets and of the earlier categories, and the intercept."""
    chosen = select(rows, category)
    shared = rows.sparkSession.sparkContext.broadcast(chosen)

    @F.udf(VectorUDT())
    def vector(buckets, before):  # only for the bounded training sample
        known = shared.value
        at = np.searchsorted(known, buckets) if len(known) and buckets else np.zeros(0, np.int64)
        held = [i for i, bucket in zip(at.tolist(), buckets, strict=True) if i < len(known) and known[i] == bucket]
        size = len(known) + len(before)
        return SparseVector(size, [*held, *range(len(known), size)], [1.0] * len(held) + [float(x) for x in before])

    ready = rows.withColumn("_features", vector("_buckets", "_earlier")).select("_features", category, "_weight")
    model = LogisticRegression(
        featuresCol="_features", labelCol=category, weightCol="_weight", regParam=_STRENGTH, maxIter=_ROUNDS,
        standardization=False, family="binomial",
    ).fit(ready)
    found = model.coefficients.toArray()
    weights = np.zeros(BUCKETS + earlier, np.float32)
    weights[chosen] = found[: len(chosen)]
    weights[BUCKETS:] = found[len(chosen) :]
    return weights, float(model.intercept)


def sample_of(labels: DataFrame, categories: Sequence[str], id: str, sample: int) -> DataFrame:
    """One row for each of at most ``sample`` ids with all labels."""
    folded = labels.filter(F.col(id).isNotNull()).groupBy(F.col(id).alias("_labelled")).agg(
        *(F.max(F.col(c).cast("double")).alias(c) for c in categories)
    )
    return folded.dropna(subset=list(categories)).orderBy(F.xxhash64("_labelled"), "_labelled").limit(sample)


def fit(documents: DataFrame, labels: DataFrame, categories: Sequence[str], id: str = "doc_id", text: str = "text",
        label_id: str | None = None, sample: int = SAMPLE, folds: int = FOLDS) -> Chain:
    """The chain over the label columns ``categories``, in this order."""
    chosen = sample_of(labels, categories, label_id or id, sample)
    docs = documents.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    # at most ``sample`` rows of an id and the labels
    known = docs.join(F.broadcast(chosen), F.col("_id") == F.col("_labelled")).drop("_labelled")
    kind = documents.schema[id].dataType.simpleString()
    found = known.select("_id", "_text").mapInArrow(_featured, f"_id {kind}, _buckets array<int>")
    rows = stage(
        found.join(F.broadcast(chosen), F.col("_id") == F.col("_labelled")).drop("_labelled")
        .withColumn("_fold", F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(folds)).cast("int"))
        .withColumn("_earlier", F.array().cast("array<double>")).repartition(_PARTS),
        "features",
    )
    weights, intercepts = [], []
    for place, category in enumerate(categories):
        share = rows.agg(F.mean(category).alias("share")).first()["share"]
        if share is None or share in (0.0, 1.0):  # nothing to tell apart
            fixed = {None: 0.0, 0.0: -20.0, 1.0: 20.0}[share]
            weights.append(np.zeros(BUCKETS + place, np.float32))
            intercepts.append(fixed)
            rows = rows.withColumn("_earlier", F.concat("_earlier", F.array(F.lit(1 / (1 + np.exp(-fixed))))))
            continue
        weight = F.when(F.col(category) > 0, 0.5 / share).otherwise(0.5 / (1 - share))
        ready = rows.withColumn("_weight", weight)
        last = place == len(categories) - 1
        whole = _fit(ready, category, place)
        weights.append(whole[0])
        intercepts.append(whole[1])
        if last:
            break
        scored = None
        for fold in range(folds):
            w, b = _fit(ready.filter(F.col("_fold") != fold), category, place)
            part = _scored(ready.filter(F.col("_fold") == fold), w, b)
            scored = part if scored is None else scored.union(part)
        rows = stage(
            scored.withColumn("_earlier", F.concat("_earlier", F.array("_p"))).drop("_p", "_weight"), "chained"
        )
    return Chain(tuple(categories), weights, intercepts)


def _scored(rows: DataFrame, weights: np.ndarray, intercept: float) -> DataFrame:
    """Probability of held-out rows of the sample."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, intercept))

    @F.pandas_udf("double")
    def probability(buckets, earlier):
        w, b = shared.value
        score = [w[x].sum() + (w[BUCKETS:] * y).sum() + b for x, y in zip(buckets, earlier, strict=True)]
        import pandas as pd

        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(score, float), -500, 500))))

    return rows.withColumn("_p", probability("_buckets", "_earlier"))


def _score(chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.text_batches(whole, "_text"):
                p = chain.value.probabilities(batch.column("_text"))
                yield pa.RecordBatch.from_arrays([batch.column("_id"), *map(pa.array, p)], ["_id", *(f"_{i}" for i in range(len(p)))])

    return run


def score(documents: DataFrame, chain: Chain, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and the probability ``p_<category>`` of each category of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(chain)
    docs = documents.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    kind = documents.schema[id].dataType.simpleString()
    columns = ", ".join(f"_{i} double" for i in range(len(chain.categories)))
    names = {f"_{i}": f"p_{c}" for i, c in enumerate(chain.categories)}
    return docs.mapInArrow(_score(shared), f"_id {kind}, {columns}").withColumnsRenamed({"_id": id, **names})
