"""Near-duplicate documents by improved consistent weighted sampling.

A document is the weighted set of its five-word shingles, each weighing its count in the text times a damped inverse document
frequency over the whole corpus. Consistent weighted samples agree for two documents as often as their weighted Jaccard
similarity says; samples in bands bring likely pairs together, and the similarity itself is then computed for them.

What never meets another document is settled first: shingles of one document only are in no common part, so a document
where they weigh over a fifth is similar to none. The others go by:

1. equal texts become one document,
2. in every bucket of a band, the members meet the member of smallest id; links join components,
3. in buckets that still hold several components, members outside the largest meet those of other components, block against
   block and where their weights allow the similarity; only links leave a task,
4. components of all links are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crashlens.llm.common import slices, stored, utf8_buffer
from crashlens.llm.graph import components
from crashlens.llm.shared_keys import shared_keys
from crashlens.llm.shingles import mixed, shingle_sets
from crashlens.operators.positions import free_name

#: Bands and samples in each: a pair of similarity 0.8 is in no common bucket with a chance of 2 in 10,000.
BANDS, ROWS = 12, 3

#: Part of a weight that depends on the document frequency.
IDF_PART = 0.3

_RANDOM = np.random.RandomState(7)
_R = (-np.log(_RANDOM.random_sample(1 << 16) * _RANDOM.random_sample(1 << 16))).astype(np.float32)
_LOG_C = np.log(-np.log(_RANDOM.random_sample(1 << 16) * _RANDOM.random_sample(1 << 16))).astype(np.float32)
_SEEDS = _RANDOM.randint(0, 1 << 62, BANDS * ROWS, np.int64).astype(np.uint64)

FEATURES = "id long, keys binary, weights binary, total double, common double, bands array<long>"


def idf(counts: np.ndarray, documents: int) -> np.ndarray:
    """1 - IDF_PART for a shingle of all documents, up to 1 for that of one."""
    rare = 1 - np.log(np.maximum(counts, 1)) / np.log(max(documents, 2))
    return 1 - IDF_PART + IDF_PART * np.clip(rare, 0, 1)


def samples(keys: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Consistent weighted samples of sets that begin at ``starts``: a row a set, a column a sample.

    For each element and sample the hash gives r and c, drawn from gamma(2, 1), and b, uniform; the element's weight is rounded
    down to y on the grid exp(r (t - b)), and the sample is the (element, t) of smallest c / (y exp(r)).
    """
    log_w = np.log(weights).astype(np.float32)
    sizes = np.diff(np.r_[starts, len(keys)])
    out = np.empty((len(starts), len(_SEEDS)), np.uint64)
    for k, seed in enumerate(_SEEDS):
        h = mixed(keys ^ seed)
        r = _R[h & np.uint64(0xFFFF)]
        b = ((h >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.float32) / np.float32(1 << 16)
        t = np.floor(log_w / r + b)
        a = _LOG_C[(h >> np.uint64(16)) & np.uint64(0xFFFF)] - r * (t - b) - r
        at = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), sizes))
        at = at[np.searchsorted(at, starts)]
        out[:, k] = mixed(keys[at] ^ (t[at].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return out


def band_hashes(found: np.ndarray) -> np.ndarray:
    parts = found.reshape(len(found), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for j in range(ROWS):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return h.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], totals: tuple[float, float]) -> float:
    """Weighted Jaccard similarity of two sets given as ascending keys and their weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    return common / (totals[0] + totals[1] - common)


def _features(documents: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(*utf8_buffer(batch.column("text")))
            weights, common = [], []
            for (keys, times), known, counts in zip(sets, batch.column("keys"), batch.column("counts"), strict=True):
                known, counts = (np.frombuffer(x.as_buffer(), np.int64).view(kind) for x, kind in ((known, np.uint64), (counts, np.int64)))
                df = np.ones(len(keys), np.int64)
                at = np.searchsorted(keys, known)
                df[at] = counts
                weights.append((times * idf(df, documents)).astype(np.float32))
                common.append(float(weights[-1][at].sum(dtype=np.float64)))
            filled = [k for k, (keys, _) in enumerate(sets) if len(keys)]
            bands = [[] for _ in sets]
            for part in (filled[i : i + 64] for i in range(0, len(filled), 64)):
                keys = np.concatenate([sets[k][0] for k in part])
                starts = np.cumsum([0, *(len(sets[k][0]) for k in part[:-1])])
                found = band_hashes(samples(keys, np.concatenate([weights[k] for k in part]), starts))
                for k, row in zip(part, found.tolist(), strict=True):
                    bands[k] = row
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([k.tobytes() for k, _ in sets], pa.binary()),
                    pa.array([w.tobytes() for w in weights], pa.binary()),
                    pa.array([float(w.sum(dtype=np.float64)) for w in weights]),
                    pa.array(common),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                ["id", "keys", "weights", "total", "common", "bands"],
            )

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(slices(batches, "keys_a"), "keys_b"):
        own = {n: batch.column(n) for n in ("keys_a", "weights_a", "keys_b", "weights_b")}
        totals = batch.column("total_a").to_numpy(), batch.column("total_b").to_numpy()
        found = []
        for k in range(batch.num_rows):
            keys_a, weights_a, keys_b, weights_b = (
                np.frombuffer(own[n][k].as_buffer(), np.uint64 if n < "w" else np.float32) for n in own
            )
            found.append(similarity((keys_a, weights_a), (keys_b, weights_b), (totals[0][k], totals[1][k])))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], ["a", "b", "similarity"])


def verified(pairs: DataFrame, features: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of at least the similarity ``least``, with it."""
    side = lambda s: features.select(*(F.col(c).alias(f"{c}_{s}") for c in ("id", "keys", "weights", "total")))
    joined = (
        pairs.join(side("a"), F.col("a") == F.col("id_a"))
        .join(side("b"), F.col("b") == F.col("id_b"))
        .select("a", "b", "keys_a", "weights_a", "total_a", "keys_b", "weights_b", "total_b")
    )
    return joined.mapInArrow(_compare, "a long, b long, similarity double").where(F.col("similarity") >= least)


def _links_between(asking: list[dict], block: list[dict], bucket: int, least: float) -> Iterator[tuple[int, int]]:
    """Links of at least the similarity ``least`` between members of two blocks of a bucket, as many as join their components.

    A pair is compared in the first band it shares, and where the weights of shingles that others have allow the similarity.
    """
    column = lambda rows, name: np.array([r[name] for r in rows])
    ids, parts, totals, commons, open_ = (column(block, n) for n in ("id", "component", "total", "common", "open"))
    bands = column(block, "bands")
    keys = [np.frombuffer(r["keys"], np.uint64) for r in block]
    owner = np.repeat(np.arange(len(block)), [len(k) for k in keys])
    keys, weights = np.concatenate(keys), np.concatenate([np.frombuffer(r["weights"], np.float32) for r in block])
    order = np.argsort(keys, kind="stable")
    keys, weights, owner = keys[order], weights[order], owner[order]
    joined: dict[int, int] = {}

    def find(x: int) -> int:
        while joined.get(x, x) != x:
            x = joined[x]
        return x

    for row in asking:
        most = np.minimum(commons, row["common"])
        may = (parts != row["component"]) & ~(open_ & (ids < row["id"])) & (most >= least * (totals + row["total"] - most) * (1 - 1e-6))
        shared = bands == np.array(row["bands"])
        may &= bands[np.arange(len(block)), shared.argmax(axis=1)] == bucket
        if not may.any():
            continue
        own, own_weights = np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["weights"], np.float32)
        first, last = np.searchsorted(keys, own), np.searchsorted(keys, own, side="right")
        times = last - first
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
        common = np.bincount(owner[at], np.minimum(weights[at], np.repeat(own_weights, times)).astype(np.float64), len(block))
        for k in np.flatnonzero(may & (common >= least * (totals + row["total"] - common))).tolist():
            mine, other = find(row["component"]), find(int(parts[k]))
            if mine != other:
                joined[mine] = other
                yield row["id"], int(ids[k])


def _meet(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                links = list(_links_between(row["asking"], row["members"], row["bucket"], least))
                columns = [pa.array([link[i] for link in links], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    return run


def _rest(members: DataFrame, labels: DataFrame, features: DataFrame, least: float, block_bytes: int) -> DataFrame:
    """Links that the first round left open: in buckets of several components, those outside the largest against all others."""
    named = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = named.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed_buckets = (
        sizes.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("n", F.negate("component"))).alias("largest"))
        .where("parts > 1")
        .select("bucket", "largest")
    )
    # Classes of similar weight: more than two classes apart, the weights alone forbid the similarity.
    width = -np.log(least) / 2
    placed = named.join(mixed_buckets, "bucket").select(
        "bucket", "id", "component", (F.col("component") != F.col("largest")).alias("open"), F.floor(F.log("total") / width).alias("class")
    )
    filled = stored(placed.join(features, "id"), "near-open")
    weight = filled.groupBy("bucket", "class").agg(F.ceil(F.sum(F.octet_length("keys") * 1.5 + 200) / block_bytes).alias("blocks"))
    salted = filled.join(weight, ["bucket", "class"]).withColumn("salt", F.pmod(F.xxhash64("id"), "blocks"))
    member = F.struct("id", "component", "open", "total", "common", "bands", "keys", "weights")
    blocks = salted.groupBy("bucket", "class", "salt").agg(F.collect_list(member).alias("members"))  # about block_bytes each
    asking = salted.where("open").groupBy("bucket", "class", "salt").agg(F.collect_list(member).alias("asking"))
    near = asking.select("bucket", "asking", F.explode(F.array(*(F.col("class") + F.lit(d) for d in range(-2, 3)))).alias("class"))
    return near.join(blocks, ["bucket", "class"]).select("bucket", "asking", "members").mapInArrow(_meet(least), "a long, b long")


def _several_texts(rows: DataFrame) -> DataFrame:
    """Ids (not null) whose rows have different texts, and the smallest digest over all of these rows."""
    digest = F.unhex(F.md5("text"))
    found = (
        rows.where(F.col("id").isNotNull())
        .select("id", digest.alias("digest"))
        .groupBy("id")
        .agg(F.min("digest").alias("chosen"), F.max("digest").alias("last"))
        .where("chosen <> last")
    )
    return stored(found.select(F.col("id").alias("several_id"), "chosen"), "near-several")


def near_classes(
    docs: DataFrame,
    least: float = 0.8,
    block_bytes: int = 2 << 20,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """For each document the class of its near-duplicates: id, class_id (the smallest id of the class).

    Texts without words are similar only if equal, null and empty ones among them. Texts of one to four words have one
    shingle of all their words. Rows that repeat an id are one document: with different texts, those of the row with the
    smallest digest over all of them. A null id has no class, so it gets a null class_id. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    known = rows.where(F.col("id").isNotNull())
    several = _several_texts(rows)
    if not several.isEmpty():  # from here on an id has one text
        other = (F.col("id") == F.col("several_id")) & (F.unhex(F.md5("text")) != F.col("chosen"))
        known = known.join(several, other, "left_anti")
    documents = docs.count()
    top = 1.0  # the weight of a shingle of one document

    def keep(n_keys: int, n_total: int, keys: np.ndarray, counts: np.ndarray) -> bool:
        """False if the shingles of this document alone weigh too much for any link; never for another reason."""
        alone = (n_keys - len(keys)) * top
        others = float(n_total - (n_keys - len(keys))) * top
        return others >= least * (others + alone) * (1 - 1e-6)

    told = stored(shared_keys(known, shingle_sets, keep, documents), "near-shared")
    equal = told.groupBy("digest").agg(F.min("id").alias("rep"))
    # One more join column gives the small side an exchange of its own, so that Spark can split a text of many copies.
    part = F.pmod(F.xxhash64("digest"), F.lit(2)).alias("part")
    named = told.groupBy("id").agg(F.min("digest").alias("digest")).select("id", "digest", part)
    members = named.join(equal.select("digest", "rep", part), ["digest", "part"]).select("id", "rep")
    members = stored(members, "near-members")
    reps = told.join(members.where("id = rep"), "id").where("n_keys > 0").groupBy("id").agg(
        F.min_by(F.struct("keys", "counts"), "digest").alias("k")
    )
    texts = known.join(reps, "id").select("id", "text", "k.keys", "k.counts")
    features = stored(texts.mapInArrow(_features(documents), FEATURES).dropDuplicates(["id"]), "near-features")

    in_bands = features.select("id", "total", "common", F.explode("bands").alias("bucket"))
    heads = in_bands.groupBy("bucket").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = stored(in_bands.join(heads.select("bucket", "head"), "bucket"), "near-buckets")
    may = F.least("common", "head_common") >= least * (F.col("total") + F.col("head_total") - F.least("common", "head_common")) * (1 - 1e-6)
    stars = buckets.where("id <> head").select("id", "head", "total", "common").distinct()
    weighed = features.select(F.col("id").alias("head"), F.col("total").alias("head_total"), F.col("common").alias("head_common"))
    pairs = stars.join(weighed, "head").where(may).select(F.col("head").alias("a"), F.col("id").alias("b"))
    links = stored(verified(pairs, features, least), "near-links")
    labels = components(links, "near-first")
    more = _rest(buckets.select("bucket", "id", "total"), labels, features, least, block_bytes)
    final = components(links.select("a", "b").union(stored(more, "near-more")), "near-all")

    classes = members.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("class_id"))
    return (
        rows.select(F.col("id").alias(id_column))
        .join(classes.withColumnRenamed("id", "__id"), F.col(id_column) == F.col("__id"), "left")
        .select(id_column, F.coalesce("class_id", id_column).alias("class_id"))
    )


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows, with all their columns, of the document of smallest id in each class; of rows that repeat an id, one stays: with
    different texts, one with the text that was compared.

    Rows without an id stay.
    """
    classes = near_classes(docs, id_column=id_column, text_column=text_column, **options)
    other, row = free_name("_other", docs), free_name("_row", docs)
    gone = classes.where(F.col(id_column) != F.col("class_id")).select(F.col(id_column).alias(other)).distinct()
    left = docs.join(gone, F.col(f"`{id_column}`") == F.col(other), "left_anti")
    repeated = stored(docs.groupBy(F.col(f"`{id_column}`").alias(other)).count().where("`count` > 1").select(other), "near-repeated")
    if repeated.isEmpty():
        return left
    again = F.col(f"`{id_column}`") == F.col(other)
    digest = F.unhex(F.md5(F.coalesce(F.col(f"`{text_column}`"), F.lit(""))))
    one = (
        left.join(repeated, again, "left_semi")
        .groupBy(F.col(f"`{id_column}`").alias(other))
        .agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), digest).alias(row))
    )
    return left.join(repeated, again, "left_anti").union(one.select(f"`{row}`.*"))
