"""Whitening of vectors by their leading principal components, found without ever forming a covariance matrix.

Block Lanczos with full reorthogonalisation: each step multiplies a block of vectors by the covariance in one pass over the rows (X'Xv of centred rows, each task
adding up its own part, the parts added by position before a matrix of dimensions x block comes to the driver), takes out what lies in the basis so far, twice, and makes the rest orthonormal. Where
the rest has lost rank, the columns that broke down are restarted by random ones, orthogonal to the basis. As the products of all basis vectors are kept, the residual of each Ritz pair is known exactly after
each pass; when all that are asked for have converged, or the basis is the whole space, the steps end. So the number of passes depends on the spectrum and is at most dimensions / block. The driver holds two
matrices of dimensions x (steps x block), whatever the number of rows.

Two more passes refine and confirm: the covariance of the projected rows is diagonalised, which gives small variances to full relative precision and turns the components to match, and the covariance
of what comes out is compared with the identity.

Rows are whole numbers, so sums and deviations are exact: each entry is centred as x - floor(S/n) in integers, less the fraction S/n - floor(S/n) in doubles. The trace is the sum of deviations, by n^3.

Edge cases: rows whose vector is null or holds a null, NaN or infinite entry are left out; where lengths differ, shorter vectors count as filled up with the number that zero becomes. Rows that share a vec_id, or have
none, are rows of their own. Fewer dimensions than components: as many as there are. A component without variance can't be scaled to one, so it is left out: equal rows, a single one, or empty vectors give no rows, nor does an
empty table. Equal eigenvalues: any basis of their space, the same for all rows. A deviation that no 64-bit integer holds is null in the query; the operator gives decimals. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectors

PLUS = 100_000
COMPONENTS = 8
#: A Ritz pair has converged when its residual is below so much of the largest eigenvalue, times the root of the dimensions: what rounding leaves.
RESIDUAL = 16 * 2.0**-52
#: A column of a block has broken down when so little of it is left.
BREAKDOWN = 1e-10
#: Variance below so much of the largest, times the dimensions, is rounding.
RANK = 1e-14
#: Rows that a task multiplies at once.
ROWS = 4096
DECIMAL = pa.decimal128(38, 0)
_OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


class Centre:
    """The rows' number and sums, as Python integers."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.floor = [s // n for s in sums]
        self.rest = np.array([(s - f * n) / n for s, f in zip(sums, self.floor, strict=True)])

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array(self.floor, np.int64)).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """For each row the sum of (n * x - S)^2."""
        top = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        d = x.astype(object) * self.n - np.array(self.sums, object) if top >= 2**63 else x * self.n - np.array(self.sums, np.int64)
        largest = int(np.abs(d).max(initial=0))
        if largest * largest * max(1, d.shape[1]) >= 2**63:
            d = d.astype(object)
        return [int(v) for v in (d * d).sum(1)]


def fit_rows(rows: DataFrame, plus: int = PLUS) -> tuple[DataFrame, Centre | None]:
    """The rows of rows(vec_id, x), all of one length, as a table in the shared folder, and their centre; None if there are none, or all are empty."""
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not d:
        return rows, None
    filled = F.concat("x", F.array_repeat(F.lit(plus).cast("long"), F.lit(d) - F.size("x")))
    table = common.materialize(rows.select("vec_id", filled.alias("x")), "vectors")
    sums = table.select(F.posexplode("x")).groupBy("pos").agg(F.count("*").alias("n"), F.sum(F.col("col").cast("decimal(20,0)")).alias("s")).orderBy("pos").collect()  # a row for each dimension
    return table, Centre(sums[0]["n"], [int(r["s"]) for r in sums])


def _slices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            yield vectors.matrix(b.slice(lo, ROWS).column("x"), dims)


def added(table: DataFrame, dims: int, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of part(rows) over slices of the rows: added up in each task, then by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for x in _slices(batches, dims):
            total += part(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["pos", "value"])

    out = np.zeros(shape)
    found = common.map_arrow(table.select("x"), run, "pos int, value double").groupBy("pos").agg(F.sum("value").alias("value")).toArrow()
    out.ravel()[np.asarray(found["pos"])] = np.asarray(found["value"])
    return out


def total_deviation(table: DataFrame, centre: Centre) -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(sum(centre.deviations(x)) for x in _slices(batches, len(centre.sums)))
        yield pa.RecordBatch.from_arrays([pa.array([Decimal(total)], DECIMAL)], names=["t"])

    return int(common.map_arrow(table.select("x"), run, "t decimal(38,0)").agg(F.sum("t")).first()[0])


def orthonormal(block: np.ndarray, basis: np.ndarray, width: int, random: np.random.Generator) -> tuple[np.ndarray, int]:
    """width orthonormal columns, orthogonal to the basis, that span what of the block lies outside of it, filled up by random ones where a column breaks down; and how many of these there are."""
    out, restarts = [], 0
    scale = np.linalg.norm(block, axis=0).max(initial=0)
    waiting = [block[:, j] for j in range(block.shape[1])]
    while len(out) < width:
        fresh = not waiting
        v = random.standard_normal(basis.shape[0]) if fresh else waiting.pop(0)
        size = np.linalg.norm(v) if fresh else scale
        so_far = np.column_stack([basis, *out])
        for _ in range(2):
            v = v - so_far @ (so_far.T @ v)
        left = np.linalg.norm(v)
        if size and left > BREAKDOWN * size:
            v = v / left
            v = v - so_far @ (so_far.T @ v)
            out.append(v / np.linalg.norm(v))
            restarts += fresh
    return np.column_stack(out) if out else np.zeros((basis.shape[0], 0)), restarts


def lanczos(apply: Callable[[np.ndarray], np.ndarray], dims: int, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, dict]:
    """The k largest eigenvalues of the symmetric matrix that apply() multiplies by, falling, their eigenvectors as columns, and what it took: passes, restarts, residual."""
    random, width = np.random.default_rng(seed), min(k, dims)
    block, _ = orthonormal(np.zeros((dims, 0)), np.zeros((dims, 0)), width, random)
    basis, images, took = np.zeros((dims, 0)), np.zeros((dims, 0)), {"passes": 0, "restarts": 0, "residual": 0.0}
    while True:
        image = apply(block)
        basis, images = np.column_stack([basis, block]), np.column_stack([images, image])
        took["passes"] += 1
        t = basis.T @ images
        values, turn = np.linalg.eigh((t + t.T) / 2)
        values, turn = values[::-1][:width], turn[:, ::-1][:, :width]
        found = basis @ turn
        took["residual"] = float(np.linalg.norm(images @ turn - found * values, axis=0).max(initial=0))
        if basis.shape[1] == dims or took["residual"] <= RESIDUAL * math.sqrt(dims) * max(values[0], 0):
            return values, found, took
        block, restarts = orthonormal(image, basis, min(width, dims - basis.shape[1]), random)
        took["restarts"] += restarts


class Whitening:
    """centre, components (columns), variances, explained shares, identity_error, and what the search for them took."""

    def __init__(self, table: DataFrame, centre: Centre, k: int = COMPONENTS):
        d, n = len(centre.sums), centre.n
        trace = total_deviation(table, centre)
        self.centre = centre

        def product(v: np.ndarray) -> np.ndarray:
            def part(x: np.ndarray) -> np.ndarray:
                c = centre.of(x)
                return c.T @ (c @ v)

            return added(table, d, part, v.shape) / n

        _, found, self.took = lanczos(product, d, k) if trace else (None, np.zeros((d, 0)), {"passes": 0, "restarts": 0, "residual": 0.0})
        w = found.shape[1]

        def gram(x: np.ndarray) -> np.ndarray:
            p = centre.of(x) @ found
            return p.T @ p

        values, turn = np.linalg.eigh(added(table, d, gram, (w, w)) / n)
        values, turn = values[::-1], turn[:, ::-1]
        real = values > RANK * d * max(values.max(initial=0), 0)
        self.variances, self.components = values[real], (found @ turn)[:, real]
        # trace is n^3 times that of the covariance
        self.explained = np.array([float(v) * n / (trace / n / n) for v in self.variances])
        w = len(self.variances)

        def squares(x: np.ndarray) -> np.ndarray:
            p = self.of(x)
            return np.vstack([p.T @ p, p.sum(0)])

        s = added(table, d, squares, (w + 1, w)) / n
        self.identity_error = float(np.abs(s[:w] - np.outer(s[w], s[w]) - np.eye(w)).max(initial=0))

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.centre.of(x) @ self.components / np.sqrt(self.variances)


def whitened(rows: DataFrame, k: int = COMPONENTS, plus: int = PLUS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each of rows(vec_id, x: array of long) and component."""
    table, centre = fit_rows(rows, plus)
    model = Whitening(table, centre, k) if centre else None
    if model is None or not len(model.variances):
        return rows.sparkSession.createDataFrame([], _OUT)
    centre, w, explained, error = model.centre, len(model.variances), model.explained, model.identity_error
    components, scale = model.components, np.sqrt(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, m = vectors.matrix(b.column("x"), len(centre.sums)), b.num_rows
            each = np.repeat(np.arange(m), w)
            deviation = pa.array([Decimal(v) if v < 10**38 else None for v in centre.deviations(x)], DECIMAL)
            values = centre.of(x) @ components / scale
            columns = [b.column("vec_id").take(pa.array(each)), np.tile(np.arange(1, w + 1, dtype=np.int32), m), np.full(m * w, centre.n), deviation.take(pa.array(each)), values.ravel(), np.tile(explained, m), np.full(m * w, error)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return common.map_arrow(table, run, _OUT)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitened(vectors.whole(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), plus=PLUS))
    return out.withColumn("deviation", F.expr("try_cast(deviation as long)"))
