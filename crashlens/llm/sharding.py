"""Sharding by histogram sort: shards of near equal bytes, by splitters found from counts alone.

Rows are ordered by (hash of the text, id, row). Rounds of counting give the exact bytes below candidate keys over
all partitions; the candidates close in on the keys at which the wished share of all bytes lies below. When every
splitter meets the tolerance, or no key lies between its candidates, the rows are exchanged once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crashlens.llm.common import stored

#: What a row costs beside its text.
ROW_BYTES = 16

KEY_BYTES = 24
KEYED = "h long, id long, row long, size long, text_crc32 long"


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """The sort key as 24 bytes that compare like (h, id, row), null first."""
    parts = np.empty((batch.num_rows, 3), ">u8")
    for k, name in enumerate(("h", "id", "row")):
        column = batch.column(name).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        parts[:, k] = column.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return parts.view(f"S{KEY_BYTES}").ravel()


def _as_array(keys: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(k.to_bytes(KEY_BYTES, "big") for k in keys), f"S{KEY_BYTES}")


def histogram(keyed: DataFrame, probes: list[int]) -> list[dict]:
    """Bytes, rows, smallest and largest key of each interval between probes, counted exactly.

    Each partition sends a row for each interval it has keys in, so what is exchanged doesn't grow with the rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _as_array(probes)
        found: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _keys(batch)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            cell = np.searchsorted(bounds, keys, side="right")
            size = batch.column("size").to_numpy()[order]
            starts = np.flatnonzero(np.r_[True, np.diff(cell) > 0])
            ends = np.r_[starts[1:], len(cell)]
            for start, end, total in zip(starts, ends, np.add.reduceat(size, starts), strict=True):
                low, high = (keys[i].ljust(KEY_BYTES, b"\0") for i in (start, end - 1))
                old = found.get(int(cell[start]), [0, 0, low, high])
                found[int(cell[start])] = [old[0] + int(total), old[1] + int(end - start), min(old[2], low), max(old[3], high)]
        rows = [[cell, *values] for cell, values in found.items()]
        schema = pa.schema([("cell", pa.int64()), ("bytes", pa.int64()), ("rows", pa.int64()), ("low", pa.binary()), ("high", pa.binary())])
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    counts = (
        keyed.select("h", "id", "row", "size")
        .mapInArrow(count, "cell long, bytes long, rows long, low binary, high binary")
        .groupBy("cell")
        .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"))
    )
    cells = [{"bytes": 0, "rows": 0} for _ in range(len(probes) + 1)]
    for row in counts.collect():  # one row for each probe at most
        low, high = (int.from_bytes(bytes(x), "big") for x in (row["low"], row["high"]))
        cells[row["cell"]] = {"bytes": row["bytes"], "rows": row["rows"], "low": low, "high": high}
    return cells


def splitters(keyed: DataFrame, measure: str, targets: list[float], tolerances: list[float], probes: int) -> list[int]:
    """For each target the key below which the nearest amount of ``measure`` (bytes or rows) lies."""
    found: dict[int, int] = {}
    probe_keys: list[int] = []
    while len(found) < len(targets):
        cells = histogram(keyed, probe_keys)
        below = np.cumsum([0, *(c[measure] for c in cells)]).tolist()
        open_cells: dict[int, dict] = {}
        for k, target in enumerate(targets):
            if k in found:
                continue
            i = min(int(np.searchsorted(below[1:], target, side="right")), len(cells) - 1)
            while i and not cells[i]["rows"]:
                i -= 1
            cell = cells[i]
            if not cell["rows"]:
                found[k] = 0
                continue
            before, after = abs(target - below[i]), abs(below[i + 1] - target)
            if min(before, after) <= tolerances[k] or cell["low"] == cell["high"]:
                found[k] = cell["low"] if before <= after else cell["high"] + 1
            else:
                open_cells[i] = cell
        probe_keys = sorted(
            {
                key
                for cell in open_cells.values()
                for j in range(probes + 1)
                if (key := cell["low"] + -(-(cell["high"] + 1 - cell["low"]) * j // probes))
            }
        )
    return [found[k] for k in range(len(targets))]


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 40,
    tolerance: float = 0.001,
    probes: int = 32,
    range_rows: int = 2_000_000,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Put every row into one of ``shards`` shards of near equal bytes (those of the text, and 16).

    A splitter is at most ``tolerance`` of a shard off, or as near as the order of the rows allows. Equal texts follow one
    another, so only a group at a splitter is divided. ``range_rows``: a shard of more rows is numbered in several
    ranges, so no task gets a whole one.

    A null text has 0 bytes and the crc of no bytes; a null id comes first among equal texts. Repeated rows are rows of their
    own. An empty table gives no rows. Other columns are not read.

    Result: id, size, text_crc32, shard, slot (gapless from 0 in the shard).
    """
    text = F.col(f"`{text_column}`")
    keyed = stored(
        docs.select(
            F.xxhash64(text).alias("h"),
            F.col(f"`{id_column}`").cast("long").alias("id"),
            F.monotonically_increasing_id().alias("row"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        ),
        "sharding",
    )
    (whole,) = histogram(keyed, [])
    share = whole["bytes"] / shards
    cuts = splitters(keyed, "bytes", [share * k for k in range(1, shards)], [tolerance * share] * (shards - 1), probes)
    cuts = np.maximum.accumulate(np.array([0, *cuts], dtype=object)).tolist()
    cells = histogram(keyed, cuts[1:])
    starts = np.cumsum([0, *(c["rows"] for c in cells)]).tolist()
    inner = [
        starts[s] + cells[s]["rows"] * j / pieces
        for s in range(shards)
        if (pieces := -(-cells[s]["rows"] // range_rows)) > 1
        for j in range(1, pieces)
    ]
    inner_cuts = splitters(keyed, "rows", inner, [range_rows / 4] * len(inner), probes) if inner else []
    bounds = sorted([(cut, s) for s, cut in enumerate(cuts)] + [(cut, -1) for cut in inner_cuts], key=lambda x: (x[0], x[1] < 0))
    firsts = starts if not inner else np.cumsum([0, *(c["rows"] for c in histogram(keyed, [b[0] for b in bounds[1:]]))]).tolist()
    shard_of, shard_first = [], []
    for (_, s), first in zip(bounds, firsts, strict=False):
        shard_of.append(s if s >= 0 else shard_of[-1])
        shard_first.append(first if s >= 0 else shard_first[-1])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _as_array([b[0] for b in bounds[1:]])
        shard, base = np.array(shard_of), np.array(firsts[: len(bounds)]) - np.array(shard_first)
        for batch in batches:
            if batch.num_rows:
                at = np.searchsorted(edges, _keys(batch), side="right")
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(at.astype(np.int32)), pa.array(shard[at].astype(np.int32)), pa.array(base[at].astype(np.int64))],
                    [*batch.schema.names, "part", "shard", "base"],
                )

    in_range = Window.partitionBy("part").orderBy("h", F.col("id").asc_nulls_first(), "row")
    return keyed.mapInArrow(deal, f"{KEYED}, part int, shard int, base long").select(
        F.col("id").alias(id_column),
        "size",
        "text_crc32",
        "shard",
        (F.col("base") + F.row_number().over(in_range) - 1).cast("long").alias("slot"),
    )
