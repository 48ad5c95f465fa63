"""Which keys of a document (shingles, anchors) other documents have too, and how many.

Every key of every document takes part. A task sends the keys of a slice of texts as packed arrays by range of keys, a key that
several texts of the slice have once with its count; so a key that a third of all documents hold costs an entry for each
slice. The ranges add up the counts and answer the slices, and these tell their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.llm.common import give_back, slices, utf8_buffer

#: Bits of a key. A range takes at least 8 of them, so the rest and the text's number in its slice fit into 64.
KEY_BITS = 56
SLICE_ROWS = 1 << 16

#: Bytes of text in a slice, of text whose keys are made at a time, and of packed keys that are sorted at a time.
SEND_BYTES, MAKE_BYTES, SORT_BYTES = 4 << 20, 512 << 10, 4 << 20
SEVERAL = (1 << 16) - 1  # instead of a text's number: all texts of the slice that have the key

SENT = "range long, slice long, one binary, several binary, ids binary, digests binary, sizes binary, held binary, held_by binary"
ANSWER = "slice long, numbers binary, keys binary, counts binary, ids binary, digests binary, sizes binary, held binary, held_by binary"
RESULT = "id long, digest binary, n_keys long, n_total long, keys binary, counts binary, most long"

#: For a text's bytes: its distinct keys, ascending, and how often each is there.
Keys = Callable[[np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]


def _runs(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [field.split() for field in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _send(keys_of: Keys, range_bits: int):
    low_bits = np.uint64(KEY_BITS - range_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", SEND_BYTES):
            for start in range(0, batch.num_rows, SLICE_ROWS - 1):
                part = batch.slice(start, SLICE_ROWS - 1)
                found, digests = [], []
                for few in slices([part], "text", MAKE_BYTES):
                    data, offsets = utf8_buffer(few.column("text"))
                    found += keys_of(data, offsets)
                    spans = zip(offsets.tolist(), offsets[1:].tolist(), strict=False)
                    digests += [hashlib.md5(data[a:b], usedforsecurity=False).digest() for a, b in spans]
                number += 1
                keys = np.concatenate([k for k, _ in found])
                text = np.repeat(np.arange(len(found)), [len(k) for k, _ in found])
                order = np.argsort(keys, kind="stable")
                keys, text = keys[order], text[order]
                first = _runs(keys) if len(keys) else np.zeros(0, np.int64)
                count = np.diff(np.r_[first, len(keys)])
                single, multi = first[count == 1], first[count > 1]
                held_by = text[np.repeat(count > 1, count)].astype(np.uint16)
                held = np.stack([keys[multi], count[count > 1].astype(np.uint64)])
                sizes = np.array([(len(k), c.sum()) for k, c in found], np.int64)
                # What belongs to the slice travels with one of its ranges, each slice's with another.
                rows = [(number * 0x9E3779B1 % ((1 << 61) - 1) & ((1 << range_bits) - 1), number, None, None, part.column("id").to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), b"".join(digests), sizes.tobytes(), held.tobytes(), held_by.tobytes())]
                packed = [
                    (keys[at] >> low_bits, ((keys[at] & np.uint64((1 << int(low_bits)) - 1)) << np.uint64(16)) | extra.astype(np.uint64))
                    for at, extra in ((single, text[single]), (multi, count[count > 1]))
                ]
                cuts = [np.searchsorted(r, np.arange((1 << range_bits) + 1, dtype=np.uint64)) for r, _ in packed]
                for r in np.union1d(packed[0][0], packed[1][0]).astype(np.int64).tolist():
                    one, several = (p[c[r] : c[r + 1]].tobytes() for (_, p), c in zip(packed, cuts, strict=True))
                    rows.append((r, number, one, several, None, None, None, None, None))
                yield _table(rows, SENT)

    return run


def _answer(range_bits: int):
    """Counts of keys, from rows sorted by range: some ranges at a time, so a task holds few of its keys."""
    low_bits = np.uint64(KEY_BITS - range_bits)

    def counted(rows: list[dict]) -> Iterator[tuple]:
        keys, extra, source, several = [], [], [], []
        for n, row in enumerate(rows):
            for packed, many in ((row["one"], False), (row["several"], True)):
                if packed:
                    entries = np.frombuffer(packed, np.uint64)
                    keys.append((entries >> np.uint64(16)) | (np.uint64(row["range"]) << low_bits))
                    extra.append((entries & np.uint64(SEVERAL)).astype(np.int32))
                    source.append(np.full(len(entries), n, np.int32))
                    several.append(np.full(len(entries), many))
        keys, extra, source, several = (np.concatenate(x) for x in (keys, extra, source, several))
        order = np.argsort(keys, kind="stable")
        keys, extra, source, several = keys[order], extra[order], source[order], several[order]
        first = _runs(keys)
        total = np.add.reduceat(np.where(several, extra, 1).astype(np.int64), first)
        total = np.repeat(total, np.diff(np.r_[first, len(keys)]))
        shared = np.flatnonzero(total > 1)
        slice_of = np.array([row["slice"] for row in rows])[source[shared]]
        order = np.argsort(slice_of, kind="stable")
        shared, slice_of = shared[order], slice_of[order]
        bounds = [*_runs(slice_of).tolist(), len(shared)] if len(shared) else [0]
        for a, b in zip(bounds, bounds[1:], strict=False):
            at = shared[a:b]
            texts = np.where(several[at], SEVERAL, extra[at]).astype(np.uint16)
            yield int(slice_of[a]), texts.tobytes(), keys[at].tobytes(), total[at].tobytes(), None, None, None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["ids"] is not None:
                    out.append((row["slice"], None, None, None, *(row[c] for c in ("ids", "digests", "sizes", "held", "held_by"))))
                    continue
                if held and size > SORT_BYTES and row["range"] != held[-1]["range"]:
                    out += counted(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["one"]) + len(row["several"])
            yield _table(out, ANSWER)
        if held:
            yield _table(list(counted(held)), ANSWER)
        held.clear()
        give_back()

    return run


def _tell(keep: Callable[[int, int, np.ndarray, np.ndarray], bool]):
    def of_slice(rows: list[dict]) -> Iterator[tuple]:
        info = next(r for r in rows if r["ids"] is not None)
        ids, sizes = np.frombuffer(info["ids"], np.int64), np.frombuffer(info["sizes"], np.int64).reshape(-1, 2)
        held = np.frombuffer(info["held"], np.uint64).reshape(2, -1)
        held_by = np.frombuffer(info["held_by"], np.uint16)
        ends = np.cumsum(held[1]).astype(np.int64)
        numbers, keys, counts = [], [], []
        for row in rows:
            if row["keys"]:
                n, k, c = (np.frombuffer(row[x], kind) for x, kind in (("numbers", np.uint16), ("keys", np.uint64), ("counts", np.int64)))
                one = n != SEVERAL
                at = np.searchsorted(held[0], k[~one])
                times = held[1][at].astype(np.int64)
                members = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(ends[at] - times, times)
                numbers += [n[one], held_by[members]]
                keys += [k[one], np.repeat(k[~one], times)]
                counts += [c[one], np.repeat(c[~one], times)]
        numbers, keys, counts = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((numbers, np.uint16), (keys, np.uint64), (counts, np.int64)))
        order = np.lexsort((keys, numbers))
        numbers, keys, counts = numbers[order], keys[order], counts[order]
        bounds = np.searchsorted(numbers, np.arange(len(ids) + 1))
        for i, (n_keys, n_total) in enumerate(sizes.tolist()):
            own = slice(bounds[i], bounds[i + 1])
            if keep(n_keys, n_total, keys[own], counts[own]):
                yield int(ids[i]), info["digests"][16 * i : 16 * i + 16], n_keys, n_total, keys[own].tobytes(), counts[own].tobytes(), int(counts[own].max(initial=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_rows: list[dict] = []
        for batch in batches:  # sorted by slice
            out = []
            for row in batch.to_pylist():
                if slice_rows and row["slice"] != slice_rows[0]["slice"]:
                    out += of_slice(slice_rows)
                    slice_rows = []
                slice_rows.append(row)
            yield _table(out, RESULT)
        if slice_rows:
            yield _table(list(of_slice(slice_rows)), RESULT)
        slice_rows.clear()
        give_back()

    return run


def shared_keys(docs: DataFrame, keys_of: Keys, keep: Callable[[int, int, np.ndarray, np.ndarray], bool], rows: int) -> DataFrame:
    """For documents (id long, not null; text) the keys that two or more have, with the number of documents of each.

    ``keys_of`` gives distinct keys of ``KEY_BITS`` bits; ``keep(n_keys, n_total, keys, counts)`` says whether a document is
    returned; ``rows`` is about the number of documents and sets how finely keys are parted.

    Result: id, digest (md5 of the text), n_keys, n_total, keys (64-bit, ascending), counts (64-bit), most (the largest count).
    """
    range_bits = min(max((rows // 64).bit_length(), 8), 24)
    return (
        docs.select("id", "text")
        .mapInArrow(_send(keys_of, range_bits), SENT)
        .repartition("range")
        .sortWithinPartitions("range")
        .mapInArrow(_answer(range_bits), ANSWER)
        .repartition("slice")
        .sortWithinPartitions("slice")
        .mapInArrow(_tell(keep), RESULT)
    )
