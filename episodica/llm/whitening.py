"""PCA whitening of embeddings by TSQR: exact sums centre the rows, each partition is reduced to its R factor, factors are merged in a tree, and
the singular value decomposition of the last one gives the components. No covariance of the vectors is formed."""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .util import shared_table

#: x = floor(SCALE * c) + SHIFT for each entry c.
SCALE, SHIFT = 1024, 100_000
#: Partial results that one task merges.
FAN = 16
#: Largest absolute x: above it sums of doubles are no whole numbers.
LARGEST = 1 << 53


class Whitening(NamedTuple):
    n: int
    sums: list[int]  # of x by dimension
    components: np.ndarray  # a row each, by falling eigenvalue
    eigenvalues: np.ndarray  # of the same
    trace: float


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, x array<long>: the rows that have a vector.

    Left out: null vectors, those with null or non-finite entries or entries beyond 2^53 / 1024, and those whose length is not the
    table's (the most common one; of equally common ones the largest): no covariance holds vectors of different lengths.
    """
    c = F.col(vector_col).cast("array<double>")
    x = F.transform(c, lambda v: F.floor(v * SCALE) + F.lit(SHIFT).cast("long"))
    fine = F.forall(c, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) * SCALE < LARGEST - SHIFT), F.lit(False)))
    good = vectors.where(F.coalesce(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & fine, F.lit(False)))
    lengths = good.groupBy(F.size(vector_col).alias("d")).agg(F.count("*").alias("rows"))  # a row for each length in use
    most = lengths.agg(F.max(F.struct("rows", "d"))["d"]).first()[0]
    return good.where(F.size(vector_col) == F.lit(most or 0)).select(F.col(id_col).alias("id"), x.alias("x"))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").values.to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0), dtype=np.int64)


def exact(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, as whole numbers: of 64 bits where they fit, else of Python."""
    most = max(n, 1) * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    kind = np.int64 if most < 1 << 62 else object
    return n * x.astype(kind) - np.array(sums, dtype=kind)


def merged(parts: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
    """One array of those of `parts` (slot int, data array<double>), of which there is one at least: those of FAN neighbouring slots meet in a task at each level of the tree."""

    def level(key: tuple, found: pa.Table) -> pa.Table:
        data = merge([d.values.to_numpy() for d in found.sort_by("slot")["data"]])
        return pa.table({"slot": pa.array([key[0].as_py()], pa.int32()), "data": pa.ListArray.from_arrays(pa.array([0, len(data)], pa.int32()), pa.array(data))})

    parts = shared_table(parts, "whiten-parts")
    left = parts.agg(F.max("slot")).first()[0] + 1
    while left > 1:
        parts = parts.groupBy(F.floor(F.col("slot") / FAN).cast("int").alias("to")).applyInArrow(level, "slot int, data array<double>")
        left = -(-left // FAN)
    return np.array(parts.first().data)


def by_partition(rows: DataFrame, fold: Callable[[np.ndarray | None, np.ndarray], np.ndarray]) -> DataFrame:
    """slot, data: each partition's matrices (as in matrix()) folded into one flat array of doubles; empty partitions give none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, slot = None, 0
        for b in batches:
            if b.num_rows:
                held, slot = fold(held, matrix(b)), b.column("slot")[0].as_py()
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.ListArray.from_arrays(pa.array([0, held.size], pa.int32()), pa.array(held.ravel()))], ["slot", "data"])

    return rows.select(F.spark_partition_id().alias("slot"), "x").mapInArrow(work, "slot int, data array<double>")


def triangle(rows: np.ndarray) -> np.ndarray:
    """The R factor, square: rows of zeros where there are fewer rows than dimensions."""
    r = np.linalg.qr(rows, mode="r")
    return r if len(r) == r.shape[1] else np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])


def fit(rows: DataFrame, most: int = 8) -> Whitening | None:
    """Components of the rows of whole_vectors(), `most` at most; None without rows.

    What reaches the driver is bounded by the dimension: exact sums, one R factor.
    """
    d = rows.select(F.size("x")).limit(1).collect()
    if not d:
        return None
    d = d[0][0]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exact sums of each partition: no int64 overflows within a block, Python's numbers add the blocks."""
        n, total = 0, [0] * d
        for b in batches:
            x = matrix(b)
            for k in range(0, len(x), 512):  # 512 numbers under 2^53 stay under 2^63
                n += len(x[k : k + 512])
                total = [a + int(s) for a, s in zip(total, x[k : k + 512].sum(axis=0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n] * d), pa.array(range(d), pa.int32()), pa.array([str(t) for t in total])], ["n", "dim", "total"])

    found = rows.select("x").mapInArrow(add, "n long, dim int, total string").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    n, sums = found[0].n, [int(r.total) for r in sorted(found, key=lambda r: r.dim)]

    def reduce(held: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        for k in range(0, len(x), 4 * d):
            centred = exact(x[k : k + 4 * d], n, sums).astype(np.float64) / n
            held = triangle(centred if held is None else np.vstack([held, centred]))
        return held

    r = merged(by_partition(rows, reduce), lambda parts: triangle(np.vstack([p.reshape(d, d) for p in parts])).ravel())
    _, s, right = np.linalg.svd(r.reshape(d, d))
    return Whitening(n, sums, right[:most], (s * s / n)[:most], float((s * s).sum() / n))


def project(x: np.ndarray, w: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S, and the whitened coordinates; those of components without variance are NaN."""
    centred = exact(x, w.n, w.sums)
    scale = np.where(positive(w), np.sqrt(np.where(positive(w), w.eigenvalues, 1)), np.nan)
    return centred, (centred.astype(np.float64) / w.n) @ w.components.T / scale


def positive(w: Whitening) -> np.ndarray:
    """Whether a component has more variance than rounding alone makes."""
    top = max(float(w.eigenvalues[0]), 0.0) if len(w.eigenvalues) else 0.0
    return w.eigenvalues > top * (np.finfo(float).eps * max(len(w.sums), 1)) ** 2


def identity_error(rows: DataFrame, w: Whitening) -> float | None:
    """The largest entry of the whitened coordinates' covariance minus the identity, over all rows: counts, means and centred products of
    each partition, merged in pairs. None if no component has variance."""
    good = positive(w)
    k = int(good.sum())
    if not k:
        return None

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, m = a[0], b[0]
        apart = b[1 : k + 1] - a[1 : k + 1]
        mean = a[1 : k + 1] + apart * (m / (n + m))
        return np.concatenate([[n + m], mean, a[k + 1 :] + b[k + 1 :] + (np.outer(apart, apart) * (n * m / (n + m))).ravel()])

    def fold(held: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        z = project(x, w)[1][:, good]
        mean = z.mean(axis=0)
        now = np.concatenate([[len(z)], mean, ((z - mean).T @ (z - mean)).ravel()])
        return now if held is None else join(held, now)

    def merge(parts: list[np.ndarray]) -> np.ndarray:
        out = parts[0]
        for p in parts[1:]:
            out = join(out, p)
        return out

    total = merged(by_partition(rows, fold), merge)
    return float(np.abs(total[k + 1 :].reshape(k, k) / total[0] - np.eye(k)).max())


WHITENED = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 8) -> DataFrame:
    """A row for each vector and component, `most` at most: id_col, component (from 1, by falling variance), n, deviation, whitened, explained, identity_error.

    Rows are read four times (sums, factors, check, result) and never shuffled; factors travel, one a partition. Rows without a whole
    vector are left out (whole_vectors), as contract and covariance ask; repeated rows, and any id, null included, keep their rows and
    count in the fit; an empty table gives an empty result; other columns are ignored, so that their names can't clash. A component without
    variance (fewer distinct vectors than components, or one vector) has whitened null and explained 0; identity_error is over the others, null
    if there are none.
    """
    rows = whole_vectors(vectors, id_col, vector_col)
    schema = StructType([rows.schema["id"], *StructType.fromDDL(WHITENED).fields])
    w = fit(rows, most)
    if w is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    error = identity_error(rows, w)
    explained = np.where(positive(w), w.eigenvalues / (w.trace or 1.0), 0.0)
    k = len(w.components)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = decimal.Context(prec=38)
        for b in batches:
            if not b.num_rows:
                continue
            centred, z = project(matrix(b), w)
            fits = centred.dtype != object and int(np.abs(centred).max(initial=0)) < 1 << 28  # squares of 2^56 and up to 64 dimensions
            squares = (centred * centred).sum(axis=1).tolist() if fits and centred.shape[1] <= 64 else [sum(v * v for v in row) for row in centred.tolist()]
            at = pa.array(np.repeat(np.arange(b.num_rows), k))
            columns = [
                b.column("id").take(at), pa.array(np.tile(np.arange(1, k + 1), b.num_rows), pa.int32()), pa.array(np.full(len(at), w.n)),
                pa.array([context.create_decimal(s) for s in squares], pa.decimal128(38, 0)).take(at), pa.array(z.ravel(), from_pandas=True),
                pa.array(np.tile(explained, b.num_rows)), pa.array([error] * len(at), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(work, schema).withColumnRenamed("id", id_col)
