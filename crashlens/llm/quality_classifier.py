"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed pieces of text gives a document's place on a single axis; ordered thresholds part the axis into
grades: P(grade > k) = sigmoid(score - threshold[k]). From these come the expected grade and the tail probability by which
documents are selected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.llm.common import slices, utf8_buffer

#: Lengths in bytes of the pieces, and bits of the hash; each length has a table of its own.
LENGTHS = (2, 3, 5)
BITS = 15


def hashed(data: np.ndarray) -> list[np.ndarray]:
    """For each length the table index of the piece that starts at each byte; those at the very end are left out."""
    one = data.astype(np.uint32)
    out = []
    for k, length in enumerate(LENGTHS):
        n = max(len(one) - length + 1, 0)
        h = np.zeros(n, np.uint32)
        for j in range(length):
            h *= np.uint32(0x01000193)
            h ^= one[j : j + n]
        h *= np.uint32(0x9E3779B1)
        out.append((h >> np.uint32(32 - BITS)).astype(np.int32) + (k << BITS))
    return out


def repetition(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One more hashed feature of each text: how far it compresses, by its length."""
    out = np.empty(len(offsets) - 1, np.int64)
    for k, (start, end) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
        n = end - start
        ratio = len(zlib.compress(data[start:end], 1)) / n if n else 1.0
        out[k] = (len(LENGTHS) << BITS) + min(15, int(ratio * 20)) + 16 * min(15, n.bit_length() // 2)
    return out


#: Entries of all tables.
SIZE = (len(LENGTHS) << BITS) + 256


def spread(weights: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Weights in which each cell of repetition that no row of the fit fell into (``seen``: indices of the others) has that of the nearest
    one: texts of any length, also longer than all of the sample, are judged by how far they compress."""
    first = len(LENGTHS) << BITS
    seen = np.unique(seen)
    if not len(seen):
        return weights
    weights = weights.copy()
    cells = np.arange(first, SIZE)
    length, ratio = (np.abs(part(cells - first)[:, None] - part(seen - first)) for part in (lambda c: c // 16, lambda c: c % 16))
    weights[cells] = weights[seen[np.argmin(16 * (length + ratio) + ratio, axis=1)]]
    return weights


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray  # a table for each length, then one for repetition
    thresholds: np.ndarray  # ascending, one fewer than grades

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of the texts between the offsets: the mean weight of all pieces, by length, summed."""
        total = np.zeros(len(offsets) - 1)
        for length, index in zip(LENGTHS, hashed(data), strict=True):
            below = np.zeros(len(data) + 1)
            np.cumsum(self.weights[index], out=below[1 : len(index) + 1])
            ends = np.maximum(offsets[1:] - length + 1, offsets[:-1])
            total += (below[ends] - below[offsets[:-1]]) / np.maximum(ends - offsets[:-1], 1)
        return total + np.where(np.diff(offsets) > 0, self.weights[repetition(data, offsets)], 0.0)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text (row) and threshold k (column)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, steps: int = 150, penalty: float = 1e-6) -> OrdinalModel:
    """Maximum likelihood by Adam steps over all rows; each row has table indices and their values."""
    n, levels = len(rows), max(int(grades.max(initial=1)) + 1, 2)
    counts = np.bincount(grades, minlength=levels) + 1.0
    above = 1 - np.cumsum(counts)[:-1] / counts.sum()
    start = np.log((1 - above) / above)  # the thresholds that fit without weights
    params = np.r_[start[0], np.log(np.maximum(np.diff(start), 1e-3))]
    weights = np.zeros(SIZE)
    if not n:
        return OrdinalModel(weights, start)
    index = np.concatenate([r[0] for r in rows]).astype(np.intp)
    value = np.concatenate([r[1] for r in rows]).astype(np.float32)
    sizes = np.array([len(r[0]) for r in rows])
    starts = np.cumsum(sizes) - sizes

    def thresholds(p: np.ndarray) -> np.ndarray:
        return np.cumsum(np.r_[p[0], np.exp(p[1:])])

    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (weights, params)]
    for step in range(1, steps + 1):
        score = np.add.reduceat(value * weights[index], starts)
        edges = np.r_[-np.inf, thresholds(params), np.inf]
        low, high = (1 / (1 + np.exp(np.clip(score - edges[grades + k], -500, 500))) for k in (0, 1))
        p = np.maximum(high - low, 1e-12)
        d_score = -(high + low - 1) / n
        d_high, d_low = -high * (1 - high) / p / n, low * (1 - low) / p / n
        d_edges = np.bincount(grades + 1, d_high, levels + 1) + np.bincount(grades, d_low, levels + 1)
        after = np.cumsum(d_edges[1:-1][::-1])[::-1]
        d_params = np.r_[after[0], after[1:] * np.exp(params[1:])]
        d_weights = np.bincount(index, value * np.repeat(d_score.astype(np.float32), sizes), len(weights)) + penalty * weights
        for x, g, (m, v), rate in ((weights, d_weights, moments[0], 0.5), (params, d_params, moments[1], 0.05)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return OrdinalModel(weights, thresholds(params))


def held_out(id_column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, fit_rows: int, most_bytes: int, id_column: str, text_column: str) -> DataFrame:
    """Texts and grades of at most ``fit_rows`` rated documents: those of smallest hash that are not held out; texts over ``most_bytes``
    bytes are left out of the sample.

    Grades from the ratings: 0 is low quality, 1 is toxic and otherwise good, 2 is good.
    """
    key = F.col(f"`{id_column}`")
    chosen = (
        labels.where(key.isNotNull() & F.col("quality").isNotNull() & ~held_out(id_column))
        .groupBy(key.alias("id"))
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(fit_rows)
        .select("id", F.when(F.col("quality") < 1, 0).when(F.col("toxic") > 0, 1).otherwise(2).alias("grade"))
    )
    # fit_rows bounds what is broadcast.
    text = F.col(f"`{text_column}`")
    short = docs.where(F.coalesce(F.octet_length(text), F.lit(0)) <= most_bytes)
    return short.select(key.cast("long").alias("id"), text.alias("text")).join(F.broadcast(chosen), "id")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    fit_rows: int = 2000,
    most_bytes: int = 20_000,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> OrdinalModel:
    """Fit on a bounded sample of rated documents; their features are made in tasks and meet on the driver.

    Without ratings the weights are zero. Texts over ``most_bytes`` bytes take no part; when scored, they are weighed like the longest
    that do. Ids that are null rate nothing; of several ratings of an id the lowest quality
    counts, and a copy of a rated row counts as often as it is there, ``2 * fit_rows`` rows at most.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = utf8_buffer(batch.column("text"))
            found = []
            for start, end, kind in zip(offsets.tolist(), offsets[1:].tolist(), repetition(data, offsets), strict=False):
                index, value = [np.array([kind], np.int32)], [np.array([end > start], np.float32)]
                for part in hashed(data[start:end]):
                    kinds, counts = np.unique(part, return_counts=True)
                    index.append(kinds.astype(np.int32))
                    value.append((counts / max(len(part), 1)).astype(np.float32))
                found.append((np.concatenate(index).tobytes(), np.concatenate(value).tobytes()))
            index, value = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("grade"), pa.array(index, pa.binary()), pa.array(value, pa.binary())],
                ["id", "grade", "i", "v"],
            )

    rows = (
        labelled(docs, labels, fit_rows, most_bytes, id_column, text_column)
        .mapInArrow(features, "id long, grade int, i binary, v binary")
        .limit(2 * fit_rows)
        .collect()
    )
    rows.sort(key=lambda r: (r["id"], r["i"], r["v"]))
    parts = [(np.frombuffer(r["i"], np.int32), np.frombuffer(r["v"], np.float32)) for r in rows]
    model = fit_ordinal(parts, np.array([r["grade"] for r in rows], np.int64))
    seen = np.array([index[0] for index, value in parts if value[0]], np.int64)  # repetition comes first
    return OrdinalModel(spread(model.weights, seen), model.thresholds)


def score(docs: DataFrame, model: OrdinalModel, grade: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Expected grade and P(grade >= ``grade``) of every whole text.

    A null or empty text has no evidence, so it gets what the thresholds alone say. Repeated rows are scored one by one, an id
    may be null, an empty table gives no rows, other columns are not read. Result: id, expected_grade, tail.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            tails = model.tails(model.scores(*utf8_buffer(batch.column("text"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(tails.sum(axis=1)), pa.array(tails[:, grade - 1])], ["id", "expected_grade", "tail"]
            )

    return (
        docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))
        .mapInArrow(run, "id long, expected_grade double, tail double")
        .withColumnRenamed("id", id_column)
    )


def select(docs: DataFrame, model: OrdinalModel, grade: int = 1, least: float = 0.5, text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, whose P(grade >= ``grade``) is at least ``least``. Rows are neither joined nor moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            tails = model.tails(model.scores(*utf8_buffer(batch.column(text_column))))
            yield batch.filter(pa.array(tails[:, grade - 1] >= least))

    return docs.mapInArrow(run, docs.schema)
