"""Whitening of embeddings by an eigendecomposition that is built up vector by vector.

An entry ``c`` becomes the whole number ``floor(256 c)``. Rows whose vector is null, empty or holds null or
non-finite entries are left out. The fit list has each distinct vector once; ``fit`` makes from it

1. one ``Spectrum`` for each task, by a centred rank-one update for each vector (``spectra``);
2. one spectrum of all, by merging groups of ``FAN`` spectra level by level, again by rank-one updates;
3. a Rayleigh-Ritz refinement: the exact centred vectors are projected on the spectrum's basis in a map,
   their products are summed over all tasks, and the small matrix is diagonalised. The basis is complete, so
   this gives the components of the whole fit list to double precision, whatever rounding 1 and 2 made.

Sums of whole numbers are exact, and centring is by ``n x - S``, so no large mean is ever subtracted from
rounded products. Copies are joined as partial results in the map tasks and count once in the fit; each of
them gets its own rows in the result. What a task or the driver holds is some spectra or matrices of
``dimension ** 2`` numbers, whatever the number of rows.

Vectors of another length than most distinct vectors have (the longest of tied lengths) have no place in the
components: they are left out as well. Null ids and repeated ids are rows like any other. A component without
variance (equal vectors, more dimensions than vectors) has ``whitened`` 0 and takes no part in
``identity_error``. An empty table, or one without a usable vector, gives no rows. Other columns, whatever
their names, are not read. Entries beyond the range of a long are held at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupa.llm.spectra import Spectrum
from lupa.session import stage

SCALE = 256
FAN = 16
COMPONENTS = 4

_SPECTRUM = "part int, n long, sums array<decimal(38,0)>, mean array<double>, values array<double>, vectors array<double>"
_EXACT = 1 << 62
_TASK = 4096  # vectors of a task that updates a spectrum, a millisecond each
_MOST_TASKS = 50_000
_SLICE = 4096  # vectors multiplied at once


@dataclass(frozen=True)
class Model:
    """Number and sums of the fit list; components as columns by falling eigenvalue; trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    basis: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    @property
    def dimension(self) -> int:
        return len(self.sums)


def whole_numbers(vectors: DataFrame, id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``_id`` and ``_x``, the vector in whole numbers, of every row with a usable vector."""
    wide = F.transform(F.col(vector), lambda c: c.cast("double"))
    usable = F.forall(wide, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    known = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & usable)
    return known.select(F.col(id).alias("_id"), F.transform(wide, lambda c: F.floor(c * float(scale))).alias("_x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column, one in each row; all have the same length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _exact_sums(x: np.ndarray) -> list[int]:
    if len(x) * max(1, float(np.abs(x.astype(float)).max(initial=0))) < _EXACT:
        return [int(s) for s in x.sum(0)]
    return [int(s) for s in x.astype(object).sum(0)]


def scaled_distance(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``n x - S`` in whole numbers, as Python's own where a long is too short."""
    most = n * max(1.0, float(np.abs(x.astype(float)).max(initial=0))) + max(map(abs, sums), default=0)
    if most < _EXACT:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return scaled_distance(x, n, sums).astype(float) / n


def _spectrum_row(part: int, spectrum: Spectrum, sums: list[int]) -> pa.RecordBatch:
    number = pa.decimal128(38, 0)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part], pa.int32()), pa.array([spectrum.n], pa.int64()),
            pa.array([[Decimal(s) for s in sums]], pa.list_(number)), pa.array([spectrum.mean.tolist()], pa.list_(pa.float64())),
            pa.array([spectrum.values.tolist()], pa.list_(pa.float64())),
            pa.array([spectrum.vectors.ravel().tolist()], pa.list_(pa.float64())),
        ],
        ["part", "n", "sums", "mean", "values", "vectors"],
    )


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One spectrum of all vectors of the task."""
    spectrum, sums = None, []
    for batch in batches:
        if not len(batch):
            continue
        x = _matrix(batch.column("_x"))
        if spectrum is None:
            spectrum, sums = Spectrum(x.shape[1]), [0] * x.shape[1]
        sums = [a + b for a, b in zip(sums, _exact_sums(x), strict=True)]
        for row in x.astype(float):
            spectrum.add(row)
    if spectrum is not None:
        yield _spectrum_row(TaskContext.get().partitionId(), spectrum, sums)


def _merge(table: pa.Table) -> pa.Table:
    """One spectrum of a group, in the order of its parts."""
    whole, sums, part = None, [], 0
    for row in sorted(table.to_pylist(), key=lambda r: r["part"]):
        other = Spectrum.of(row["n"], row["mean"], row["values"], row["vectors"])
        if whole is None:
            whole, sums, part = other, [int(s) for s in row["sums"]], row["_group"]
        else:
            whole.merge(other)
            sums = [a + int(b) for a, b in zip(sums, row["sums"], strict=True)]
    return pa.Table.from_batches([_spectrum_row(part, whole, sums)])


def spectrum_of(fit_list: DataFrame) -> DataFrame:
    """The spectrum of all vectors ``_x`` as one row, or none if there are no vectors."""
    spectra = stage(fit_list.mapInArrow(_grow, _SPECTRUM), "spectra")
    while spectra.count() > 1:
        grouped = spectra.withColumn("_group", F.floor(F.col("part") / FAN).cast("int"))
        spectra = stage(grouped.groupBy("_group").applyInArrow(_merge, _SPECTRUM), "spectra")
    return spectra


def _projected(shared):
    """Per task, the sums of the projections and of their products around ``shift``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, basis, shift = shared.value
        total, products = np.zeros(basis.shape[1]), np.zeros((basis.shape[1],) * 2)
        for batch in batches:
            for at in range(0, len(batch), _SLICE):
                y = _centred(_matrix(batch.column("_x").slice(at, _SLICE)), n, sums) @ basis - shift
                total += y.sum(0)
                products += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total, products.ravel()]).tolist()])], ["_sums"])

    return run


def moments(fit_list: DataFrame, n: int, sums: tuple[int, ...], basis: np.ndarray, shift=0.0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and mean product of the projections on ``basis``, less ``shift``, of all vectors.

    ``k + k * k`` sums for ``k`` components come to the driver.
    """
    shared = fit_list.sparkSession.sparkContext.broadcast((n, sums, basis, shift))
    k = basis.shape[1]
    parts = fit_list.mapInArrow(_projected(shared), "_sums array<double>").select(F.posexplode("_sums").alias("_at", "_sum"))
    found = parts.groupBy("_at").agg(F.sum("_sum").alias("_sum")).toPandas().sort_values("_at")["_sum"].to_numpy()
    shared.unpersist()
    return found[:k] / n, found[k:].reshape(k, k) / n


def fit(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> Model | None:
    """The components of the distinct vectors, or None if no row has a usable vector."""
    distinct = stage(whole_numbers(vectors, id, vector, scale).select("_x").distinct(), "fit-list")
    length = F.size("_x").alias("_length")
    most = distinct.groupBy(length).count().orderBy(F.desc("count"), F.desc("_length")).first()
    if most is None:
        return None
    fit_list = distinct.filter(F.size("_x") == most["_length"])
    tasks = min(_MOST_TASKS, -(-most["count"] // _TASK))
    found = spectrum_of(fit_list.repartition(tasks, F.xxhash64("_x"))).first()
    n, sums = found["n"], tuple(int(s) for s in found["sums"])
    # rounding may have turned the eigenvectors by some units in the last place
    basis, _ = np.linalg.qr(np.array(found["vectors"]).reshape(len(sums), len(sums)))
    _, products = moments(fit_list, n, sums, basis)
    values, turned = np.linalg.eigh((products + products.T) / 2)
    order = np.argsort(-values, kind="stable")
    basis, values = basis @ turned[:, order], np.maximum(values[order], 0.0)
    basis, values, trace = basis[:, :components], values[:components], float(values.sum())
    # less than rounding leaves of the largest eigenvalue is no variance
    values = np.where(values > len(sums) * np.finfo(float).eps * values.max(initial=0), values, 0.0)
    model = Model(n, sums, basis, values, trace, 0.0)
    return Model(n, sums, basis, values, trace, _identity_error(fit_list, model))


def _stretched(model: Model) -> np.ndarray:
    return model.basis / np.where(model.values > 0, np.sqrt(model.values), np.inf)


def _identity_error(fit_list: DataFrame, model: Model) -> float:
    """Largest entry of the covariance of the whitened fit list less the identity."""
    stretched = _stretched(model)[:, model.values > 0]
    if not stretched.shape[1]:
        return 0.0
    mean, _ = moments(fit_list, model.n, model.sums, stretched)
    _, products = moments(fit_list, model.n, model.sums, stretched, mean)
    return float(np.abs(products - np.eye(len(products))).max())


def _whitened(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        stretched = _stretched(model)
        for whole in batches:
            for at in range(0, len(whole), _SLICE):
                batch = whole.slice(at, _SLICE)
                off = scaled_distance(_matrix(batch.column("_x")), model.n, model.sums)
                w = (off.astype(float) / model.n) @ stretched
                values = pa.array(w.ravel())
                bounds = pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), _squares(off), pa.ListArray.from_arrays(bounds, values)], ["_id", "_deviation", "_whitened"]
                )

    return run


def _squares(off: np.ndarray) -> pa.Array:
    """Sum of the squares of each row, exact, as decimal."""
    most = float(np.abs(off.astype(float)).max(initial=0))
    number = pa.decimal128(38, 0)
    if off.dtype != object and most * most * off.shape[1] < _EXACT:
        return pc.cast(pa.array((off * off).sum(1)), number)
    return pa.array([Decimal(int(s)) for s in (off.astype(object) ** 2).sum(1)], number)


def whiten(vectors: DataFrame, model: Model, id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """One row for each usable row: ``id``, ``deviation`` (exact sum of ``(n x - S) ** 2``, a decimal) and
    ``whitened``, an array with an entry for each component of the model. No shuffle."""
    rows = whole_numbers(vectors, id, vector, scale).filter(F.size("_x") == model.dimension)
    kind = vectors.schema[id].dataType.simpleString()
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    found = rows.mapInArrow(_whitened(shared), f"_id {kind}, _deviation decimal(38,0), _whitened array<double>")
    return found.withColumnsRenamed({"_id": id, "_deviation": "deviation", "_whitened": "whitened"})


def components(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Fit and whiten: one row for each usable row and component, numbered from 1, with ``n``,
    ``deviation``, ``whitened``, ``explained`` (share of the trace, 0 without variance) and ``identity_error``.

    ``deviation`` is a long; a sum beyond its range is null here and exact in the decimal of ``whiten``.
    """
    model = fit(vectors, id, vector, count, scale)
    kind = vectors.schema[id].dataType.simpleString()
    if model is None:
        return vectors.sparkSession.createDataFrame(
            [], f"`{id}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        )
    shares = F.array(*(F.lit(float(v / model.trace) if model.trace > 0 else 0.0) for v in model.values))
    return whiten(vectors, model, id, vector, scale).select(
        id, F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("_at", "_value")
    ).select(
        id, (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col("_value").alias("whitened"), F.element_at(shares, F.col("_at") + 1).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
