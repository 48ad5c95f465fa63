"""Allow and block rules for URLs, looked up in a sorted digest array.

A rule is a host and a path. It fits its host and all subdomains where the URL's path starts with the rule's; the longest rule that fits
decides. Spark hashes and sorts the rules; 64-bit keys, offsets and full strings lie in files that every executor maps into memory, so
its workers share one copy. A task probes the keys of a batch's distinct hosts and paths by one binary search and compares the stored string at each hit.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The seed that Spark's ``xxhash64`` has; keys are made by Spark for rules and by ``xxhash`` for probes.
SEED = 42

#: Bytes of rules that are sent to the executors; more rules are joined instead.
MOST_BYTES = 256 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str | Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, allow: Iterable[str] = (), block: Iterable[str] = ()) -> DataFrame:
    """Rules (host, path, verdict) written as ``host/path``; without a slash they fit any path."""
    rows = [(*_parted(rule), verdict) for verdict, rules in (("allow", allow), ("block", block)) for rule in rules]
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def _parted(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def _normal(rules: DataFrame) -> DataFrame:
    """One row a rule: (rule, path_length, verdict); a null path is empty, a rule without host or verdict none, of two verdicts the blocking one stays."""
    host, path = F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit(""))
    rows = rules.where("host is not null and verdict is not null").select(F.concat(host, path).alias("rule"), F.length(path).alias("path_length"), "verdict")
    return rows.groupBy("rule", "path_length").agg(F.max("verdict").alias("verdict"))


class DigestArray:
    """Sorted keys with the strings they stand for. ``bits`` of a key below 64 make collisions, for tests."""

    def __init__(self, folder: str, name: str, bits: int = 64):
        arrays = [np.load(os.path.join(folder, f"{name}-{part}.npy"), mmap_mode="r") for part in ("keys", "offsets", "strings", "verdicts", "lengths")]
        self.keys, self.offsets, self.strings, self.verdicts, self.lengths = arrays
        self.shift = np.uint64(64 - bits)

    @staticmethod
    def write(rules: pa.Table, folder: str, name: str, bits: int = 64) -> list[str]:
        """Files of a table (key, rule, path_length, verdict), sorted by key, for ``DigestArray(folder, name)``."""
        rule = rules.column("rule").combine_chunks().cast(pa.large_binary())
        strings = b"".join(rule.to_pylist())
        parts = {
            "keys": rules.column("key").to_numpy().view(np.uint64) >> np.uint64(64 - bits),
            "offsets": np.r_[0, np.cumsum(pc.binary_length(rule).to_numpy())].astype(np.int64),
            "strings": np.frombuffer(strings or b"\0", np.uint8),
            "verdicts": np.array([v == "block" for v in rules.column("verdict").to_pylist()], np.uint8),
            "lengths": np.unique(rules.column("path_length").to_numpy()),
        }
        paths = []
        for part, values in parts.items():
            paths.append(os.path.join(folder, f"{name}-{part}.npy"))
            np.save(paths[-1], values if len(values) else np.zeros(1, values.dtype)[:0])
        return paths

    def find(self, probes: list[bytes]) -> np.ndarray:
        """Number of the rule that each probe is, or -1."""
        found = np.full(len(probes), -1, np.int64)
        digests = np.array([xxhash.xxh64_intdigest(p, SEED) for p in probes], np.uint64) >> self.shift
        at = np.searchsorted(self.keys, digests)
        asking = np.arange(len(probes))
        while len(asking):
            asking = asking[at[asking] < len(self.keys)]
            asking = asking[self.keys[at[asking]] == digests[asking]]
            same = np.array([self.rule(at[i]) == probes[i] for i in asking], bool)
            found[asking[same]] = at[asking[same]]
            asking = asking[~same]  # another string of the same key: the next one may be it
            at[asking] += 1
        return found

    def rule(self, i: int) -> bytes:
        return self.strings[self.offsets[i] : self.offsets[i + 1]].tobytes()


@lru_cache(maxsize=1)
def _driver_folder() -> str:
    """Where the driver keeps the files that Spark serves to executors, until Python ends."""
    own = tempfile.TemporaryDirectory(prefix="crashlens-rules-", ignore_cleanup_errors=True)
    atexit.register(own.cleanup)
    return own.name


@lru_cache(maxsize=4)
def _mapped(name: str, bits: int) -> DigestArray:
    return DigestArray(SparkFiles.getRootDirectory(), name, bits)


def suffixes(host: str) -> list[str]:
    """The host and the domains it lies in, the longest first."""
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))]


def longest_rules(array: DigestArray, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
    """Number of the longest rule that fits each host and path, -1 where none does; of equally long ones that of the longer host."""
    best, length, host_length = (np.full(len(hosts), -1, np.int64) for _ in range(3))
    hosts = hosts.dictionary_encode()
    names, host_at = hosts.dictionary.to_pylist(), hosts.indices.to_numpy()
    sizes = pc.utf8_length(paths).to_numpy()
    for k in array.lengths.tolist():
        rows = np.flatnonzero(sizes >= k)
        starts = pc.utf8_slice_codeunits(paths.take(pa.array(rows)), 0, k).dictionary_encode()
        prefixes = starts.dictionary.to_pylist()
        pairs, which = np.unique(host_at[rows].astype(np.int64) * max(len(prefixes), 1) + starts.indices.to_numpy(), return_inverse=True)
        probes, of_pair = [], []
        for i, pair in enumerate(pairs.tolist()):
            own = suffixes(names[pair // len(prefixes)])
            probes += [(host, prefixes[pair % len(prefixes)]) for host in own]
            of_pair += [i] * len(own)
        found = array.find([(host + prefix).encode() for host, prefix in probes])
        hit, first = np.unique(np.array(of_pair, np.int64)[found >= 0], return_index=True)
        rule, name = np.full(len(pairs), -1, np.int64), np.full(len(pairs), -1, np.int64)
        at = np.flatnonzero(found >= 0)[first]
        rule[hit], name[hit] = found[at], [len(probes[i][0]) for i in at.tolist()]
        rule, name = rule[which], name[which]
        better = (rule >= 0) & ((name + k > length[rows]) | ((name + k == length[rows]) & (name > host_length[rows])))
        rows = rows[better]
        best[rows], length[rows], host_length[rows] = rule[better], name[better] + k, name[better]
    return best


def decision(rules: DataFrame, bits: int = 64, default: str = "allow", most_bytes: int = MOST_BYTES):
    """A function (host, path) -> struct (rule, verdict) of columns, or None if the rules have over ``most_bytes``."""
    spark = rules.sparkSession
    normal = _normal(rules)
    size = normal.agg(F.sum(F.octet_length("rule") + 32)).first()[0] or 0
    if size > most_bytes:
        return None
    # Spark orders signed keys; as unsigned ones they are ordered with the first bit turned.
    ordered = normal.withColumn("key", F.xxhash64("rule")).orderBy(F.col("key") < 0, "key", "rule")
    name = f"rules-{uuid.uuid4().hex}"
    for path in DigestArray.write(ordered.toArrow(), _driver_folder(), name, bits):
        spark.sparkContext.addFile(path)  # Spark serves the file from the driver; no executor reads the driver's folder

    @F.arrow_udf("struct<rule string, verdict string>")
    def decide(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        array = _mapped(name, bits)
        found = longest_rules(array, hosts, paths)
        used, which = np.unique(found, return_inverse=True)
        texts = [None if i < 0 else array.rule(i).decode() for i in used.tolist()]
        verdicts = [default if i < 0 else "block" if array.verdicts[i] else "allow" for i in used.tolist()]
        take = pa.array(which)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()).take(take), pa.array(verdicts, pa.string()).take(take)], ["rule", "verdict"])

    return decide


def _joined(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """(host, path, rule, verdict) for distinct hosts and paths, by a join with all that could be a rule."""
    normal = _normal(rules)
    lengths = [r[0] for r in normal.select("path_length").distinct().collect()]
    pairs = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = pairs.withColumn("name", F.explode(hosts)).withColumn("k", F.explode(F.array(*(F.lit(k) for k in lengths)).cast("array<int>")))
    tried = tried.where(F.length("path") >= F.col("k")).withColumn("rule", F.concat("name", F.substring("path", F.lit(1), F.col("k"))))
    order = F.struct(F.length("rule"), F.length("name"), "rule", "verdict")
    found = tried.join(normal.select("rule", "verdict").distinct(), "rule").groupBy("host", "path").agg(F.max(order).alias("best"))
    left = pairs.join(found, ["host", "path"], "left")
    return left.select("host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url", bits: int = 64, default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(id, host, path, rule, verdict) for each row of ``pages``; ``rules`` (host, path, verdict: allow or block).

    A URL that no rule fits has a null rule and the verdict ``default``; so has a null one unless a rule fits the empty host. Rows repeat as they do in ``pages``;
    other columns don't come along. No rules: ``default`` for all. Rules of up to ``most_bytes`` go to the executors, more of them are joined.
    """
    urls = pages.select(F.col(id).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    decide = decision(rules, bits, default, most_bytes)
    if decide:
        found = urls.withColumn("d", decide("host", "path")).select("id", "host", "path", "d.rule", "d.verdict")
    else:
        found = urls.join(_joined(urls, rules, default), ["host", "path"]).select("id", "host", "path", "rule", "verdict")
    return found.withColumnRenamed("id", id) if id not in ("host", "path", "rule", "verdict") else found


def allowed(pages: DataFrame, rules: DataFrame, url: str = "url", bits: int = 64, default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of ``pages``, with their columns as they are, whose URL is allowed."""
    decide = decision(rules, bits, default, most_bytes)
    host, path = host_of(F.col(url)), path_of(F.col(url))
    if decide:
        return pages.where(decide(host, path)["verdict"] == "allow")
    names = [f"{c}_{uuid.uuid4().hex}" for c in ("host", "path")]
    urls = pages.select(host.alias("host"), path.alias("path"))
    blocked = _joined(urls, rules, default).where("verdict = 'block'").select(F.col("host").alias(names[0]), F.col("path").alias(names[1]))
    return pages.join(blocked, (host == F.col(names[0])) & (path == F.col(names[1])), "left_anti")
