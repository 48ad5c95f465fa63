"""Toxicity of whole texts: the network of ``gru`` scores overlapping windows of 32 words, one for every eight words, so that each passage of
up to 25 words lies whole in one; a text has the score of its worst window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.llm.common import slices, utf8_buffer
from crashlens.llm.gru import Network, train
from crashlens.llm.quality_classifier import held_out

#: Bytes of text whose windows are made at a time.
READ_BYTES = 1 << 20


def fit(
    docs: DataFrame,
    labels: DataFrame,
    toxic_rows: int = 1000,
    clean_rows: int = 2000,
    most_bytes: int = 20_000,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> Network:
    """Train on a bounded sample of labelled rows: of those not held out, the ones of smallest hash, at most ``toxic_rows`` toxic and
    ``clean_rows`` other ones; texts over ``most_bytes`` bytes are left out of the sample.

    The sample is all that the driver gets. Ids that are null label nothing; an id labelled toxic once is toxic. Without
    labels of both kinds all scores are near 0, or near 1 if all labels are toxic.
    """
    key = F.col(f"`{id_column}`")
    known = (
        labels.where(key.isNotNull() & F.col("toxic").isNotNull() & ~held_out(id_column))
        .groupBy(key.alias("id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    smallest = lambda kind, n: known.where(kind).orderBy(F.xxhash64("id"), "id").limit(n)
    sample = smallest(F.col("toxic") > 0, toxic_rows).union(smallest(F.col("toxic") <= 0, clean_rows))
    text = F.col(f"`{text_column}`")
    rows = (
        docs.where(F.octet_length(text).between(1, most_bytes))
        .select(key.cast("long").alias("id"), text.alias("text"))
        .join(F.broadcast(sample), "id")  # toxic_rows + clean_rows rows
        .limit(2 * (toxic_rows + clean_rows))
        .toArrow()
        .sort_by([("id", "ascending"), ("text", "ascending")])
        .combine_chunks()
    )
    if not rows.num_rows:
        return train(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0))
    data, offsets = utf8_buffer(rows.column("text").chunk(0))
    return train(data, offsets, rows.column("toxic").to_numpy() > 0)


def score(docs: DataFrame, network: Network, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Score of every whole text, by its overlapping windows from the first word to the last: id, score (0 to 1), predicted (1 from 0.5).

    A text without words, null and empty ones too, has the score 0. Repeated rows are scored one by one, an id may be null, an
    empty table gives no rows, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", READ_BYTES):
            logit = network.scores(*utf8_buffer(batch.column("text")))
            found = 1 / (1 + np.exp(-np.clip(logit, -700, 700)))
            found[np.isneginf(logit)] = 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["id", "score", "predicted"]
            )

    return (
        docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))
        .mapInArrow(run, "id long, score double, predicted int")
        .withColumnRenamed("id", id_column)
    )
