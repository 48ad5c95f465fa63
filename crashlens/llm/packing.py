"""Mixture-controlled packing of token ids into sequences.

Every source is a queue of its documents' ids, and every window (sequence) is dealt out in slots of ``grain`` tokens by deficit
round-robin: in each slot a queue earns its target share, the queue that is owed most is served, and what it is still owed or has
got ahead goes with it into the next slot, window and partition. Served so, the j-th slot of a queue of share w is due at
time (j + 1/2) / w, and its place is the number of slots, of all queues, that are due earlier. So a task can carry the deficits of
all the windows before its own without having seen them: only the queues' lengths and its own first places are needed. Which slots
a window holds decides its proportions, not their order in it: they are laid out queue by queue, so that a document's lie together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crashlens.llm.common import slices, stored, texts
from crashlens.llm.tokens import encoder

END_ID = 1

#: Bytes of text whose ids are made at a time; the encoder's arrays for them take some thirty times as many.
ENCODE_BYTES = 256 << 10
PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, queue string"


class Schedule:
    """Places of slots under deficit round-robin. Queues by number; lengths in tokens, weights as whole numbers.

    Due times are doubles, rounded the same way in every task; equal ones are served in the order of the queues.
    """

    def __init__(self, lengths: list[int], weights: list[int], window: int, grain: int):
        if window % grain:
            raise ValueError("a window has to hold a whole number of slots")
        self.window, self.grain, self.slots = window, grain, window // grain
        self.lengths = np.array(lengths, np.int64)
        self.counts = -(-self.lengths // grain)
        self.weights = np.array(weights, np.float64)
        # If tokens flowed evenly: when each queue would run dry, and the slots served until then.
        self.dry = np.unique(np.append(2 * self.counts / self.weights, 0.0))
        self.flowed = np.minimum(self.dry[:, None] * self.weights / 2, self.counts).sum(1)

    def due(self, queue: int | slice, slots: np.ndarray) -> np.ndarray:
        return (2 * slots + 1) / self.weights[queue]

    def served(self, queue: int | slice, times: np.ndarray) -> np.ndarray:
        """Slots of a queue that are due at these times or earlier."""
        known = (times * (self.weights[queue] * 0.5) - 0.5).astype(np.int64)
        for _ in range(2):  # at most two too few, as the product is rounded
            known = known + (self.due(queue, known) <= times)
        return np.minimum(known, self.counts[queue])

    def places(self, queue: int, slots: np.ndarray) -> np.ndarray:
        """Places, among the slots of all queues, of some slots of one queue."""
        times = self.due(queue, slots)
        sooner = np.nextafter(times, -1)
        total = slots.astype(np.int64)
        for other in range(len(self.counts)):
            if other != queue:
                total = total + self.served(other, times if other < queue else sooner)
        return total

    def before(self, places: np.ndarray) -> np.ndarray:
        """For each place, how many slots of each queue (a column each) have an earlier one."""
        places, every = places[:, None], slice(None)
        apart = len(self.counts)  # more than even flow and served slots can differ
        bits, high = (  # doubles from 0 up are ordered like their bits
            np.interp(places + by, self.flowed, self.dry).view(np.int64) for by in (-apart, apart + 1)
        )
        while (bits < high).any():  # the earliest time at which the slot of this place is due
            middle = bits + (high - bits) // 2
            enough = self.served(every, middle.view(np.float64)).sum(1, keepdims=True) > places
            bits, high = np.where(enough, bits, np.minimum(middle + 1, high)), np.where(enough, middle, high)
        times = bits.view(np.float64)
        sooner = self.served(every, np.nextafter(times, -1))
        ties = self.served(every, times) - sooner
        left = places - sooner.sum(1, keepdims=True) - (np.cumsum(ties, 1) - ties)
        return sooner + np.clip(left, 0, ties)

    def deficit(self, queue: int, window: int) -> float:
        """Slots that a queue is owed after so many windows; below 0 if it is ahead."""
        served = int(self.before(np.array([window * self.slots]))[0, queue])
        return window * self.slots * self.weights[queue] / self.weights.sum() - served

    def position(self, queues: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window of each slot and its offset there; a window's slots lie queue by queue, so a queue's are side by side."""
        places = np.empty(len(slots), np.int64)
        for k in np.unique(queues):
            own = queues == k
            places[own] = self.places(int(k), slots[own])
        windows, at = np.unique(places // self.slots, return_inverse=True)
        edges, edge = np.unique([windows, windows + 1], return_inverse=True)
        first, end = self.before(edges * self.slots)[edge.reshape(2, -1)]
        missing = np.where((first < end) & (end == self.counts), self.counts * self.grain - self.lengths, 0)
        tokens = (end - first) * self.grain - missing  # only the last slot of a queue can be short
        begin = np.cumsum(tokens, 1) - tokens
        return windows[at], begin[at, queues] + (slots - first[at, queues]) * self.grain


def tokenize(docs: DataFrame, vocabulary: str, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """Ids of each text and the end id, with the place in the queue of its source within its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, used = TaskContext.get().partitionId(), {}
        encode = encoder(vocabulary).encode
        for batch in slices(batches, "text", ENCODE_BYTES):
            data, counts, starts = [], [], []
            sources = batch.column("source").to_pylist()
            for ids, source in zip(encode(texts(batch.column("text"))), sources, strict=True):
                data.append(np.append(ids, ids.dtype.type(END_ID)).tobytes())
                counts.append(len(ids) + 1)
                starts.append(used.get(source, 0))
                used[source] = starts[-1] + counts[-1]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id"),
                    "source": batch.column("source"),
                    "ids": pa.array(data, pa.binary()),
                    "n": pa.array(counts, pa.int64()),
                    "part": pa.array([part] * len(data), pa.int32()),
                    "start": pa.array(starts, pa.int64()),
                }
            )

    return docs.select(
        F.col(f"`{id_column}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{source_column}`").cast("string"), F.lit("")).alias("source"),
        F.col(f"`{text_column}`").alias("text"),
    ).mapInArrow(run, "id long, source string, ids binary, n long, part int, start long")


def pack(
    docs: DataFrame,
    vocabulary: str,
    window: int = 2048,
    grain: int = 64,
    weights: Mapping[str, int] | None = None,
    max_queues: int = 1024,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """Cut the token ids of all documents into pieces and place each piece in a sequence of at most ``window`` ids.

    ``weights`` gives the target proportion of each source as a whole number; without it a source's proportion is that of its
    tokens in the corpus, so all queues run dry together. If a queue runs dry before the others, these share its part in
    proportion. Each window holds every source's target to one slot of ``grain`` tokens. Sequences but the last are full,
    short of less than a slot for each source whose last slot they hold. A document is one piece in each window that holds some of it.
    With over ``max_queues`` sources, these are hashed to so many queues, and the proportions are those of the queues.

    A null or empty text is the end id alone; a null source is the queue with the empty name; ids may be null or repeat, each row
    is a document. An empty table gives no rows. Other columns are not read.

    Result: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, queue (the source or its hash), a row a piece.
    """
    spark = docs.sparkSession
    tokens = stored(tokenize(docs, vocabulary, id_column, text_column, source_column), "packing")
    sums = stored(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "packing-sums")
    queue = F.col("source")
    if sums.select("source").distinct().limit(max_queues + 1).count() > max_queues:
        if weights is not None:
            raise ValueError(f"weights are for at most {max_queues} sources")
        queue = F.pmod(F.xxhash64("source"), F.lit(max_queues)).cast("string")
    earlier = Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", "source", "n", queue.alias("queue")).select(
        "part", "source", "queue", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")
    )
    lengths = {
        row["queue"]: row["n"] for row in sums.groupBy(queue.alias("queue")).agg(F.sum("n").alias("n")).collect()
    }  # at most max_queues rows
    names = sorted(lengths)
    if weights is not None and (lost := [name for name in names if weights.get(name, 0) < 1]):
        raise ValueError(f"no weight for the sources {lost}")
    counts = [lengths[name] for name in names]
    schedule = Schedule(counts, [weights[n] for n in names] if weights else [-(-n // grain) for n in counts], window, grain)
    number = {name: k for k, name in enumerate(names)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            queues = np.array([number[q] for q in batch.column("queue").to_pylist()])
            first = batch.column("at").to_numpy()
            n = batch.column("n").to_numpy()
            from_slot, to_slot = first // grain, (first + n - 1) // grain
            many = to_slot - from_slot + 1
            row = np.repeat(np.arange(len(n)), many)
            slot = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + from_slot[row]
            begin = np.maximum(first[row], slot * grain)
            length = np.minimum(first[row] + n[row], (slot + 1) * grain) - begin
            sequence, offset = schedule.position(queues[row], slot)
            offset += begin - slot * grain
            joined = (row[1:] == row[:-1]) & (sequence[1:] == sequence[:-1])
            heads = np.flatnonzero(np.r_[True, ~joined])
            length = np.add.reduceat(length, heads)
            row, start, sequence, offset = row[heads], (begin - first[row])[heads], sequence[heads], offset[heads]
            crcs, last, ids = [], -1, b""
            data = batch.column("ids")
            for r, b, e in zip(row.tolist(), (4 * start).tolist(), (4 * (start + length)).tolist(), strict=True):
                if r != last:
                    last, raw = r, data[r].as_buffer()
                    ids = memoryview(np.frombuffer(raw, f"<u{raw.size // int(n[r])}").astype("<u4").tobytes())
                crcs.append(zlib.crc32(ids[b:e]))
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id").take(pa.array(row)),
                    "start": start,
                    "length": length,
                    "ids_crc32": pa.array(crcs, pa.int64()),
                    "doc_tokens": n[row],
                    "sequence_id": sequence,
                    "offset": offset,
                    "source": batch.column("source").take(pa.array(row)),
                    "queue": batch.column("queue").take(pa.array(row)),
                }
            )

    placed = tokens.join(bases, ["part", "source"]).select(
        "id", "ids", "n", "source", "queue", (F.col("base") + F.col("start")).alias("at")
    )
    return placed.mapInArrow(cut, PIECES).withColumnRenamed("id", id_column)
