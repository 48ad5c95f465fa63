"""Removal of repeated byte strings, as a suffix array over all documents would show them, from hash-compared suffix sorts.

A byte goes if a 50-byte string that covers it also starts in a document of smaller id. Equal strings have equal anchor keys,
so documents exchange the keys first; where several documents have a key, the bytes of its windows are brought together and
their suffixes sorted. Every window of every text takes part. A key that very many documents have would bring too much to one
task: there, equal segments are counted before they are moved, and their windows are spread by their bytes. Long stretches of a
short period (rules, padding) have as many different windows as the period: only these move, with how far they repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.llm.anchors import PLACES, WINDOW, runs
from crashlens.llm.common import slices, stored, utf8_buffer
from crashlens.llm.shared_keys import shared_keys
from crashlens.llm.shingles import mixed
from crashlens.llm.suffix_sort import earlier_windows
from crashlens.operators.positions import free_name

#: Bytes of segments sorted at a time, and of text cut at a time.
SORT_BYTES, CUT_BYTES = 1 << 20, 1 << 20

#: Runs of more windows than ``LONG`` are searched for stretches of a short period; what is left is cut into ``PIECE`` windows.
LONG, PIECE = 128, 4096

#: Rows of an id and a digest that are broadcast; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 500_000

#: A span that takes a whole text.
WHOLE = 1 << 60


def anchor_keys(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    keys, _, _, text = runs(data, offsets)
    bounds = np.searchsorted(text, np.arange(len(offsets)))
    return [np.unique(keys[a:b], return_counts=True) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of the ranges, one range after another."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def binaries(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[ranges(starts, lengths)]))]
    return pa.Array.from_buffers(pa.binary(), len(starts), buffers)


def _pieces(own: np.ndarray) -> list[tuple[int, int, int, int]]:
    """The windows of a long run of windows, each in a piece: first and last window sent, period, and windows after the first
    that the piece stands for.

    The key's string is in every window, so it repeats after at most ``PLACES`` bytes and no longer period is looked for.
    """
    rest, pieces = np.ones(len(own) - WINDOW + 1, bool), []
    for period in range(1, PLACES + 1):
        if not rest.any():
            break
        # Windows that hold no byte unlike the one a period after it lie between two such bytes.
        edges = np.r_[-1, np.flatnonzero(own[period:] != own[:-period]), len(own) - period]
        first, last = edges[:-1] + 1, edges[1:] - WINDOW + period
        for k in np.flatnonzero(last - first >= LONG).tolist():
            open_ = np.flatnonzero(rest[first[k] : last[k] + 1])
            if len(open_) > LONG:
                a, b = int(first[k] + open_[0]), int(first[k] + open_[-1])
                rest[a : b + 1] = False
                pieces.append((a, a + period - 1, period, b - a))
    left = np.flatnonzero(np.diff(np.r_[False, rest, False].astype(np.int8)))
    for a, b in left.reshape(-1, 2).tolist():
        pieces += [(c, min(c + PIECE, b) - 1, 1, 0) for c in range(a, b, PIECE)]
    return pieces


def folded(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows as pieces: the run's number, first and last window sent, period, windows after the first stood for."""
    long = last - first > LONG
    numbers = np.flatnonzero(~long)
    one = np.ones(len(numbers), np.int64)
    columns = [[numbers], [first[numbers]], [last[numbers]], [one], [0 * one]]
    for k in np.flatnonzero(long).tolist():
        at = int(first[k])
        a, b, period, more = np.array(_pieces(data[at : int(last[k]) + WINDOW]), np.int64).T
        for column, values in zip(columns, (np.full(len(a), k), a + at, b + at, period, more), strict=True):
            column.append(values)
    return tuple(np.concatenate(column) for column in columns)


def _cut(hot: bool, hot_documents: int):
    """Segments (the bytes of a run of windows) of the keys that several documents have: the hot ones or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CUT_BYTES):
            data, offsets = utf8_buffer(batch.column("text"))
            known = []
            for k, (keys, counts) in enumerate(zip(batch.column("keys"), batch.column("counts"), strict=True)):
                keys, counts = np.frombuffer(keys.as_buffer(), np.int64).view(np.uint64), np.frombuffer(counts.as_buffer(), np.int64)
                known.append(mixed(keys[(counts > hot_documents) == hot] + np.uint64(k << 8)))
            known = np.sort(np.concatenate(known))
            key, first, last, text = runs(data, offsets)
            if not len(known) or not len(key):
                continue
            own = mixed(key + (text.astype(np.uint64) << np.uint64(8)))
            at = np.searchsorted(known, own)
            chosen = known[np.minimum(at, len(known) - 1)] == own
            key, first, last, text = key[chosen], first[chosen], last[chosen], text[chosen]
            run, first, last, period, more = folded(data, first, last)
            key, text = key[run], text[run]
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            digests = batch.column("digest").take(pa.array(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(ids[text]), digests, pa.array(first - offsets[text]), pa.array(period), pa.array(more), binaries(data, first, last - first + WINDOW)],
                ["key", "id", "digest", "start", "period", "more", "segment"],
            )

    return run


CUT = "key long, id long, digest binary, start long, period long, more long, segment binary"
SPANS = "id long, digest binary, start long, end long"


def _spans(table: pa.Table, segment: np.ndarray, inside: np.ndarray) -> pa.RecordBatch:
    """Bytes that the windows and their repeats cover, as spans; the windows of a segment are ascending. A window of a stretch with
    a period (shorter than a window) is there again after each period, without a gap between."""
    new = np.flatnonzero(np.r_[True, (segment[1:] != segment[:-1]) | (inside[1:] > inside[:-1] + WINDOW)]) if len(segment) else segment
    start, period, more = (table.column(c).to_numpy() for c in ("start", "period", "more"))
    further = np.maximum(more[segment] - inside, 0)
    last = inside + further - further % period[segment]
    last = np.maximum.reduceat(last, new) if len(new) else new
    rows = pa.array(segment[new])
    return pa.RecordBatch.from_arrays(
        [
            table.column("id").combine_chunks().take(rows),
            table.column("digest").combine_chunks().take(rows),
            pa.array(start[segment[new]] + inside[new]),
            pa.array(start[segment[new]] + last + WINDOW),
        ],
        ["id", "digest", "start", "end"],
    )


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans from segments sorted by key. All segments of a key are worked on together, some keys at a time."""

    def work(table: pa.Table) -> pa.RecordBatch:
        data, offsets = utf8_buffer(table.column("segment").combine_chunks())
        keys, ids = table.column("key").to_numpy().view(np.uint64), table.column("id").to_numpy()
        return _spans(table, *earlier_windows(data, offsets, keys, ids))

    held, size = [], 0
    for batch in slices(batches, "segment", SORT_BYTES):
        held.append(batch)
        size += batch.column("segment").nbytes
        if size < SORT_BYTES:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column("key").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield work(table.slice(0, cut))
        held = table.slice(cut).to_batches()
        size = sum(b.column("segment").nbytes for b in held)
    if held:
        yield work(pa.Table.from_batches(held))


def _hot_spans(segments: DataFrame) -> DataFrame:
    """Arrays of spans for keys of very many documents: equal segments meet as one row, and their windows by their bytes."""
    different = segments.groupBy("key", "segment").agg(F.min("id").alias("first"))
    places = F.sequence(F.lit(0), F.length("segment") - WINDOW)
    windows = stored(
        different.select("key", "segment", "first", F.explode(places).alias("inside")).withColumn(
            "window", F.expr(f"substring(segment, inside + 1, {WINDOW})")
        ),
        "suffix-windows",
    )
    least = windows.groupBy("window").agg(F.min("first").alias("least"))
    window = F.struct(F.col("inside").cast("long").alias("start"), "least")
    known = (
        windows.join(least, "window")
        .groupBy("key", "segment")
        .agg(F.collect_list(window).alias("found"), F.min("least").alias("least"))  # the windows of one segment
    )
    # One more join column gives the small side an exchange of its own, so that Spark can split a hot segment.
    part = F.pmod(F.col("key"), F.lit(2)).alias("part")
    met = segments.select("*", part).join(known.select("*", part), ["key", "segment", "part"]).where(F.col("least") < F.col("id"))
    further = "greatest(more - w.start, 0L)"
    spans = F.expr(f"""transform(filter(found, w -> w.least < id), w -> named_struct(
        'start', start + w.start, 'end', start + w.start + {further} - {further} % period + {WINDOW}L))""")
    return met.select("id", "digest", spans.alias("spans"))


def repeated_spans(docs: DataFrame, rows: int, hot_documents: int) -> DataFrame:
    """Spans to remove (id, digest, arrays of start and end), which may overlap; docs: id, not null, digest, text."""
    told = stored(
        shared_keys(docs, anchor_keys, lambda n_keys, n_total, keys, counts: len(keys) > 0, rows).withColumnRenamed("id", "told_id"),
        "suffix-shared",
    )
    # The first of equal texts stays; copies are found by id and digest, so many copies of one text do not meet in one task.
    firsts = told.groupBy("digest").agg(F.min("told_id").alias("first_id")).withColumnRenamed("digest", "first_digest")
    is_first = (F.col("told_id") == F.col("first_id")) & (F.col("digest") == F.col("first_digest"))
    copies = told.select("told_id", "digest").join(firsts, is_first, "left_anti").select(
        F.col("told_id").alias("id"),
        "digest",
        F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(WHOLE).alias("end"))).alias("spans"),
    )
    told = told.join(firsts, is_first, "left_semi").withColumnRenamed("digest", "told_digest")
    same = (F.col("id") == F.col("told_id")) & (F.col("digest") == F.col("told_digest"))
    told = told.dropDuplicates(["told_id", "told_digest"])
    texts = docs.join(told, same)
    columns = ["id", "digest", "text", "keys", "counts"]
    sorted_segments = texts.select(columns).mapInArrow(_cut(False, hot_documents), CUT).repartition("key").sortWithinPartitions("key")
    spans = stored(sorted_segments.mapInArrow(_sort, SPANS), "suffix-spans").select(
        "id", "digest", F.array(F.struct("start", "end")).alias("spans")
    )
    hot = told.where(F.col("most") > hot_documents)
    if (hot_rows := hot.count()) > 0:
        # Few documents with hot keys: only their texts move. Their ids are narrow rows, broadcast up to a number.
        chosen = docs.join(F.broadcast(hot.select("told_id", "told_digest")), same, "left_semi") if hot_rows <= BROADCAST_ROWS else docs
        hot_texts = chosen.join(hot, same)
        hot_segments = stored(hot_texts.select(columns).mapInArrow(_cut(True, hot_documents), CUT), "suffix-hot")
        spans = spans.union(stored(_hot_spans(hot_segments), "suffix-hot-spans"))
    return spans.union(copies)


def _left(data: np.ndarray, offsets: np.ndarray, spans: pa.Array) -> Iterator[tuple[int, int, bytes]]:
    """Length, number of removed runs and remaining bytes of each text."""
    for k, own_spans in enumerate(spans):
        own = data[offsets[k] : offsets[k + 1]]
        if not own_spans.is_valid or not len(own_spans):
            yield len(own), 0, own.tobytes()
            continue
        pairs = np.array([(s["start"], s["end"]) for s in own_spans.as_py()], np.int64)
        edge = np.zeros(len(own) + 1, np.int32)
        np.add.at(edge, np.minimum(pairs[:, 0], len(own)), 1)
        np.add.at(edge, np.minimum(pairs[:, 1], len(own)), -1)
        gone = np.cumsum(edge[:-1]) > 0
        yield len(own), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), own[~gone].tobytes()


def prepared(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    return docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.unhex(F.md5(text)).alias("digest"), text.alias("text"))


def with_spans(docs: DataFrame, spans_column: str, hot_documents: int, id_column: str, text_column: str) -> DataFrame:
    """The rows with all their columns, and the spans to remove as one more, ``spans_column``."""
    rows = prepared(docs, id_column, text_column)
    key, told = free_name("_id", docs), free_name("_digest", docs)
    spans = (
        repeated_spans(rows.where(F.col("id").isNotNull()), docs.count(), hot_documents)
        .groupBy("id", "digest")
        .agg(F.flatten(F.collect_list("spans")).alias(spans_column))  # of one document
        .withColumnsRenamed({"id": key, "digest": told})
    )
    digest = F.unhex(F.md5(F.coalesce(F.col(f"`{text_column}`"), F.lit(""))))
    same = (F.col(f"`{id_column}`").cast("long") == F.col(key)) & (digest == F.col(told))
    return docs.join(spans, same, "left").drop(key, told)


def remove_repeats(docs: DataFrame, hot_documents: int = 20_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every document without the bytes of 50-byte strings that start in a document of smaller id.

    ``hot_documents``: keys of more documents than this, whose segments would be over some MB in a task, go the way for hot keys;
    the result is the same. A null text is empty.
    Texts of under 50 bytes stay as they are. A document without an id is compared with none. Rows of the same id are not
    smaller than one another: each keeps what no smaller id has. An empty table gives no rows; other columns are not read.

    Result: id, n_bytes, n_removed, n_spans, kept (the remaining bytes, which can begin or end inside a character).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [(n, n - len(kept), spans, kept) for n, spans, kept in _left(*utf8_buffer(batch.column("text")), batch.column("spans"))]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    plain = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))
    found = with_spans(plain, "spans", hot_documents, "id", "text")
    return found.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_column)


def clean(docs: DataFrame, hot_documents: int = 20_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows with all their columns and what ``remove_repeats`` leaves of the text.

    Bytes of a character that was cut go with it. A row of which nothing is left goes; one that was empty before stays.
    """
    spans_column = free_name("_spans", docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            column = batch.column(text_column)
            left = [
                (kept.decode("utf-8", "ignore") if spans else old.as_py(), not spans or bool(kept.strip()))
                for old, (_, spans, kept) in zip(column, _left(*utf8_buffer(column), batch.column(spans_column)), strict=True)
            ]
            texts, stays = zip(*left, strict=True)
            at = batch.schema.get_field_index(text_column)
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, column.type))
            yield batch.drop_columns([spans_column]).filter(pa.array(stays))

    return with_spans(docs, spans_column, hot_documents, id_column, text_column).mapInArrow(run, docs.schema)
