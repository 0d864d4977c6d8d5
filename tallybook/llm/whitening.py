"""Whitening of embeddings: exact moments over distinct vectors, leading components by spectrum slicing, projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import shuffle_partitions, stored
from tallybook.llm.spectrum import leading_eigenpairs

#: Entries are kept as floor(STEPS * entry) + ORIGIN.
STEPS, ORIGIN = 64, 1_000_000
#: Rows that a task multiplies at a time.
TOGETHER = 4096
#: An eigenvalue below this share of the trace is rounding, and no component.
LEAST_SHARE = 1e-12


def whole_steps(vector: Column) -> Column:
    """The vector's entries as whole steps, an array of longs; null if it is null or holds null or non-finite entries."""
    usable = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return F.when(usable, F.transform(vector, lambda e: F.floor(e * STEPS) + ORIGIN))


def _matrix(batch: pa.RecordBatch, column: str, dims: int) -> np.ndarray:
    """A column of arrays of one length, as rows."""
    lists = batch[column]
    return np.asarray(lists.flatten(), np.float64).reshape(len(lists), dims)


def _blocks(batches: Iterator[pa.RecordBatch], column: str, dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for first in range(0, batch.num_rows, TOGETHER):
            yield _matrix(batch.slice(first, TOGETHER), column, dims)


def _summed(rows: DataFrame, made, width: int) -> np.ndarray:
    """The sum of a square matrix of `width` that `made` gives for blocks of rows: each task adds up its own, rows of the
    matrix meet by their number, and each is added up as it arrives, so that no task holds more than its share of rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in made(batches):
            total = block if total is None else total + block
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["at", "entries"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, entries in zip(batch["at"].to_pylist(), batch["entries"].to_pylist(), strict=True):
                row = np.frombuffer(entries, "<f8")
                sums[at] = sums[at] + row if at in sums else row
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([r.tobytes() for r in sums.values()], pa.binary())], ["at", "entries"])

    schema = "at int, entries binary"
    found = rows.mapInArrow(partial, schema).repartition(shuffle_partitions(rows.sparkSession), "at").mapInArrow(added, schema).collect()
    out = np.zeros((width, width))
    for row in found:
        out[row["at"]] = np.frombuffer(row["entries"], "<f8")
    return out


def covariance(rows: DataFrame, column: str, dims: int, n: int, mean: np.ndarray) -> np.ndarray:
    """Divisor n, centred before multiplying."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for x in _blocks(batches, column, dims):
            z = x - mean
            yield z.T @ z

    return _summed(rows.select(column), products, dims) / n


def whitened_vectors(embeddings: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row and component up to `components`: vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries become whole steps; moments are over each distinct vector once: n of them, their sums exact. Components are
    numbered by falling eigenvalue of the covariance. A row's whitened value is its centred vector on the component over
    the root of the eigenvalue; deviation is the exact sum of squares of n * x - S, an error beyond the range of a long;
    explained is the eigenvalue's share of the trace; identity_error is measured over the distinct vectors' whitened values.

    Distinct vectors go through one shuffle, copies merged before it, and are stored once. Sums and products are added up
    by task; what reaches the driver is a matrix of the dimensions, whatever the number of rows.

    Rows whose vector is null or holds null or non-finite entries are left out, as are rows whose vector's length is not
    the commonest (of two, the longer). Directions without variance are no components: fewer than `components` come back
    of fewer dimensions or vectors, and none of one distinct vector or empty vectors. Repeated rows and null ids give
    rows like any other. Columns of other names stay behind. An empty table gives an empty result.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), whole_steps(F.col(vector_col).cast("array<double>")).alias("x")).where("x is not null")
    commonest = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if commonest is None or commonest["dims"] == 0:
        return spark.createDataFrame([], schema)
    dims = commonest["dims"]
    rows = rows.where(F.size("x") == dims)
    fit = stored(rows.select("x").distinct())
    sums = fit.select(F.posexplode("x").alias("at", "step")).groupBy("at").agg(F.sum(F.col("step").cast("decimal(20,0)")).alias("total"), F.count(F.lit(1)).alias("n")).orderBy("at").collect()
    n, total = sums[0]["n"], [int(r["total"]) for r in sums]
    mean = np.array([t // n + (t % n) / n for t in total])
    spread = covariance(fit, "x", dims, n, mean)
    trace = float(np.trace(spread))
    values, vectors = leading_eigenpairs(spread, components)
    kept = values > LEAST_SHARE * trace
    values, vectors = values[kept], vectors[kept]
    if not len(values):
        return spark.createDataFrame([], schema)
    turn = vectors.T / np.sqrt(values)

    def whitened_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """Sums of the whitened values' products, the values' own sums in one row more."""
        for x in _blocks(batches, "x", dims):
            w = (x - mean) @ turn
            w = np.column_stack([w, np.ones(len(w))])
            yield w.T @ w

    moments = _summed(fit, whitened_moments, len(values) + 1) / n
    of_mean = moments[-1, :-1]
    identity_error = float(np.abs(moments[:-1, :-1] - np.outer(of_mean, of_mean) - np.eye(len(values))).max())
    explained = (values / trace).tolist()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(first, TOGETHER)
                w, k = (_matrix(batch, "x", dims) - mean) @ turn, len(values)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["vec_id"].take(pa.array(np.repeat(np.arange(len(w)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(w))),
                        batch["deviation"].take(pa.array(np.repeat(np.arange(len(w)), k))), pa.array(w.ravel()), pa.array(explained * len(w), pa.float64()),
                    ],
                    ["vec_id", "component", "deviation", "whitened", "explained"],
                )

    away = F.zip_with("x", F.from_json(F.lit(str(total)), "array<long>"), lambda x, s: x * n - s)
    deviation = F.aggregate(away, F.lit(0).cast("long"), lambda so_far, a: so_far + a * a)
    placed = rows.withColumn("deviation", deviation).mapInArrow(project, "vec_id long, component int, deviation long, whitened double, explained double")
    return placed.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(identity_error).alias("identity_error"))
