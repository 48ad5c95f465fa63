"""Whitening of embeddings from exact cross-products, by bit-sliced scatter.

Entries become whole numbers. Each dimension is shifted by its least value, and bit p of all rows is packed into words, a plane. The
sum of products of two dimensions is then the sum of 2 ** (p + q) times the ones in the AND of their planes p and q, whole
numbers at every step: tasks add up counts, Spark adds up tasks, and the covariance is centred as integers before the one division.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashlens.llm.common import stored

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16

#: Rows whose planes are made at a time, bytes of one AND of planes, rows of which counts are added up in a task at most.
ROWS, AND_BYTES, MOST_ROWS = 1 << 14, 1 << 22, 1 << 24

#: Sums leave a task in limbs of so many bits, so that they fit into a long whatever the entries are.
LIMB = 30


def whole_numbers(vector: str | Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """floor(scale * entry) + shift of a vector, as longs; null if it is null or has a null or non-finite entry, or one beyond a long."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    scaled = F.transform(vector, lambda c: F.lit(float(scale)) * c.cast("double"))
    bad = F.exists(scaled, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(1 << 62)))
    return F.when(F.coalesce(bad, F.lit(True)), None).otherwise(F.transform(scaled, lambda c: F.floor(c).cast("long") + F.lit(shift).cast("long")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _shifted(column: pa.Array, low: np.ndarray) -> np.ndarray:
    """Entries above the least of their dimension; unsigned, so that any two longs can be apart."""
    return _matrix(column, len(low)).astype(np.uint64) - low.astype(np.uint64)


def _bounds(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, total = 0, np.full(width, np.iinfo(np.int64).max), np.full(width, np.iinfo(np.int64).min), [0] * width
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            if len(x):
                n += len(x)
                low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
                top, rest = (x >> LIMB).sum(0), (x & ((1 << LIMB) - 1)).sum(0)
                total = [t + (int(a) << LIMB) + int(b) for t, a, b in zip(total, top, rest, strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(width), pa.int32()), "n": pa.array([n] * width, pa.int64()), "low": low, "high": high, "total": pa.array([str(t) for t in total])})

    return run


def _planes(x: np.ndarray, place: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """(planes, words): bit ``bit[i]`` of dimension ``place[i]`` of all rows; missing rows of the last word are 0."""
    packed = np.zeros((len(place), -(-len(x) // 64) * 8), np.uint8)
    for i, (j, p) in enumerate(zip(place.tolist(), bit.tolist(), strict=True)):
        ones = np.packbits(((x[:, j] >> np.uint64(p)) & np.uint64(1)).astype(bool))
        packed[i, : len(ones)] = ones
    return packed.view(np.uint64)


def _common_ones(planes: np.ndarray, into: np.ndarray) -> None:
    """Add the ones that each two planes have in common, above the diagonal and on it."""
    block = max(AND_BYTES // max(planes.nbytes, 1), 1)
    for start in range(0, len(planes), block):
        both = planes[start : start + block, None] & planes[None, start:]
        into[start : start + block, start:] += np.bitwise_count(both).sum(-1, dtype=np.int64)


def _scatter(low: np.ndarray, bits: np.ndarray):
    place = np.repeat(np.arange(len(bits)), bits)
    bit = np.arange(len(place)) - np.repeat(np.cumsum(bits) - bits, bits)

    def sums(counts: np.ndarray) -> pa.RecordBatch:
        counts = np.triu(counts) + np.triu(counts, 1).T
        power = bit[:, None] + bit[None]
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
        dims = place[starts]
        upper = np.triu_indices(len(dims))
        out = []
        for limb in range(int(power.max(initial=-1)) // LIMB + 1):
            weighed = np.where(power // LIMB == limb, counts << (power % LIMB), 0)
            cells = np.add.reduceat(np.add.reduceat(weighed, starts, 0), starts, 1)[upper]
            out.append((dims[upper[0]], dims[upper[1]], np.full(len(cells), limb), cells))
        a, b, limb, cells = (np.concatenate(c) for c in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 4
        return pa.RecordBatch.from_pydict({"a": a.astype(np.int32), "b": b.astype(np.int32), "limb": limb.astype(np.int32), "value": cells})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros((len(place), len(place)), np.int64), 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.column("x").slice(start, ROWS)
                _common_ones(_planes(_shifted(part, low), place, bit), counts)
                seen += len(part)
                if seen >= MOST_ROWS:
                    yield sums(counts)
                    counts[:], seen = 0, 0
        if seen:
            yield sums(counts)

    return run


class Whitening:
    """What a fit gives: n, per dimension the least value, sum and mean above it, components as columns, eigenvalues, their shares, the error."""

    def __init__(self, n: int, low: np.ndarray, sums: list[int], products: list[list[int]], components: int):
        self.n, self.low, self.sums = n, low, sums  # sums above the least values
        width = len(sums)
        # n * (sum of products) - (product of sums) is n * n times the covariance; only the division rounds, correctly.
        exact = [[n * products[a][b] - sums[a] * sums[b] for b in range(width)] for a in range(width)]
        covariance = np.array([[cell / (n * n) for cell in row] for row in exact]).reshape(width, width)
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = values[::-1], vectors[:, ::-1]
        trace = sum(exact[a][a] for a in range(width)) / (n * n)
        real = values > max(width, 1) * np.finfo(float).eps * (values[0] if width else 0)
        used = np.flatnonzero(real)[:components]
        self.values, self.vectors = values[used], vectors[:, used]
        self.explained = self.values / trace if len(used) else self.values
        self.mean = np.array([s / n for s in sums])
        self.error = 0.0

    def project(self, shifted: np.ndarray) -> np.ndarray:
        return ((shifted.astype(np.float64) - self.mean) @ self.vectors) / np.sqrt(self.values)

    def deviation(self, shifted: np.ndarray) -> list[int]:
        """sum over dimensions of (n * x - S) ** 2 as exact numbers; in longs where these suffice, else in Python's."""
        most, width = int(shifted.max(initial=0)), len(self.sums)
        if width * most * max(most, max(self.sums, default=0)) < 1 << 62:
            u = shifted.astype(np.int64)
            squares, mixed = (u * u).sum(1).tolist(), (u @ np.array(self.sums, np.int64)).tolist()
        else:
            u = shifted.astype(object)
            squares, mixed = (u * u).sum(1).tolist(), (u @ np.array(self.sums, object)).tolist()
        n, rest = self.n, sum(s * s for s in self.sums)
        return [n * n * q - 2 * n * m + rest for q, m in zip(squares, mixed, strict=True)]


def _spread(model: Whitening):
    """Sums and cross-products of whitened rows, one matrix a task: the sums stand in the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        total = np.zeros((k, k + 1))
        for batch in batches:
            z = model.project(_shifted(batch.column("x"), model.low))
            total += np.c_[z.T @ z, z.sum(0)]
        a, b = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({"a": a.ravel().astype(np.int32), "b": b.ravel().astype(np.int32), "value": total.ravel()})

    return run


def _numbers(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is whole, with it as ``x`` beside the caller's columns."""
    return vectors.withColumn("x", whole_numbers(vector)).where("x is not null")


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors (as whole numbers); None if there are none.

    Vectors of another length than most (ties: the longest) take no part. A dimension that is constant adds nothing; at
    most ``components`` components of eigenvalue above rounding are kept, so a table of equal vectors has none. The driver gets rows for each
    two dimensions, whatever the number of vectors.
    """
    whole = _numbers(vectors.select(F.col(vector).alias("v")), "v").select("x")
    lengths = whole.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if lengths is None:
        return None
    width = lengths["width"]
    distinct = stored(whole.where(F.size("x") == width).distinct(), "vectors")
    if not width:
        return Whitening(1, np.zeros(0, np.int64), [], [], components)
    wide = F.col("total").cast("decimal(38,0)")
    parts = distinct.mapInArrow(_bounds(width), "dim int, n long, low long, high long, total string")
    rows = sorted(parts.groupBy("dim").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum(wide).alias("total")).collect())
    n, low = rows[0]["n"], np.array([r["low"] for r in rows], np.int64)
    sums = [int(r["total"]) - n * r["low"] for r in rows]
    bits = np.array([(r["high"] - r["low"]).bit_length() for r in rows])
    products = [[0] * width for _ in range(width)]
    cells = distinct.mapInArrow(_scatter(low, bits), "a int, b int, limb int, value long")
    for r in cells.groupBy("a", "b", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).toLocalIterator():
        products[r["a"]][r["b"]] += int(r["value"]) << (LIMB * r["limb"])
    for a in range(width):
        for b in range(a):
            products[a][b] = products[b][a]
    model = Whitening(n, low, sums, products, components)
    k = len(model.values)
    spread = np.zeros((k, k + 1))
    for r in distinct.mapInArrow(_spread(model), "a int, b int, value double").groupBy("a", "b").agg(F.sum("value").alias("value")).collect():
        spread[r["a"], r["b"]] = r["value"]
    mean = spread[:, k] / n
    model.error = float(np.abs(spread[:, :k] / n - np.outer(mean, mean) - np.eye(k)).max(initial=0))
    return model


def whiten(vectors: DataFrame, model: Whitening | None, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each whole vector and component: id, component (from 1, largest eigenvalue first), n, deviation (exact),
    whitened, explained (share of the variance), identity_error (largest entry of the whitened covariance minus the identity).

    Repeated rows and null ids come as they are. ``deviation`` is a decimal of 38 digits; null if it has more. An empty table, or vectors that
    are all equal, give no rows.
    """
    kind = dict(vectors.dtypes)[id]
    schema = f"id {kind}, n long, deviation string, whitened array<double>"
    whole = _numbers(vectors.select(F.col(id).alias("id"), F.col(vector).alias("v")), "v").select("id", "x")
    model = model or Whitening(1, np.zeros(0, np.int64), [], [], 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shifted = _shifted(batch.column("x"), model.low) if len(model.low) else np.zeros((batch.num_rows, 0), np.uint64)
            z = model.project(shifted)
            whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([model.n] * len(z), pa.int64()), pa.array([str(d) for d in model.deviation(shifted)], pa.string()), whitened],
                ["id", "n", "deviation", "whitened"],
            )

    found = whole.where(F.size("x") == len(model.low)).mapInArrow(run, schema)
    shares = F.array(*(F.lit(float(e)) for e in model.explained)) if len(model.explained) else F.array().cast("array<double>")
    exploded = found.select("*", F.posexplode("whitened").alias("at", "value"))
    return exploded.select(
        F.col("id").alias(id), (F.col("at") + 1).alias("component"), "n", F.col("deviation").try_cast("decimal(38,0)").alias("deviation"),
        F.col("value").alias("whitened"), F.get(shares, F.col("at")).alias("explained"), F.lit(model.error).alias("identity_error"),
    )
