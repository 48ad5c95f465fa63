"""Near-duplicates and repeated strings against brute force, on hand-made groups and edge cases."""

import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_frames import *  # noqa: F403  (fixtures)
from llm_frames import frame
from pyspark.sql import functions as F

from crashlens.llm import near_dedup, suffix_dedup
from crashlens.llm.anchors import WINDOW, runs
from crashlens.llm.common import utf8_buffer
from crashlens.llm.graph import components
from crashlens.llm.near_dedup import idf, near_classes, one_of_each, samples, similarity
from crashlens.llm.shingles import shingle_sets
from crashlens.llm.suffix_dedup import remove_repeats
from crashlens.llm.suffix_sort import earlier_windows


def edited(text, seed, share):
    draw, words = random.Random(seed), text.split()
    for k in range(len(words)):
        if draw.random() < share:
            words[k] = f"new{draw.randint(0, 10**6)}"
    return " ".join(words)


def union(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def brute_classes(docs):
    sets = {i: shingle_sets(*utf8_buffer(pa.array([t])))[0] for i, t, _ in docs}
    counts = Counter(k for keys, _ in sets.values() for k in keys.tolist())
    weights = {i: times * idf(np.array([counts[k] for k in keys.tolist()], np.int64), len(docs)) for i, (keys, times) in sets.items()}
    texts = {i: t or "" for i, t, _ in docs}
    ids = sorted(sets)
    pairs = []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if texts[a] == texts[b]:
                pairs.append((a, b))
            elif len(weights[a]) and len(weights[b]):
                one, two = (sets[a][0], weights[a]), (sets[b][0], weights[b])
                if similarity(one, two, (weights[a].sum(), weights[b].sum())) >= 0.8:
                    pairs.append((a, b))
    return union(pairs, ids)


def classes_of(df):
    return {r["doc_id"]: r["class_id"] for r in df.collect()}


@pytest.fixture(scope="module")
def groups(prose):
    """A hot group of near copies around texts of which none has the smallest id, small groups, and texts alone."""
    base, docs = prose(900, 160), []
    for k in range(150):
        docs.append((k, edited(base, k, 0.004 * (k % 12)), "a"))
    docs += [(200, base, "a"), (201, base, "a"), (202, base, "b")]
    for k in range(20):
        text = prose(1000 + k, 120)
        docs += [(300 + 3 * k, text, "a"), (301 + 3 * k, edited(text, k, 0.005 * (k % 8)), "a"), (302 + 3 * k, prose(2000 + k, 100), "a")]
    return docs


@pytest.mark.parametrize("block_bytes", [2 << 20, 4000])
def test_classes_are_those_of_all_pairs(spark, groups, block_bytes):
    expected = brute_classes(groups)
    assert len(set(expected.values())) > 45
    assert classes_of(near_classes(frame(spark, groups), block_bytes=block_bytes)) == expected


def test_one_document_of_each_class_stays(spark, groups):
    docs = frame(spark, groups)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_classes(groups).values()))


def test_near_edge_cases(edge_docs, edge_rows, no_docs):
    got = near_classes(edge_docs)
    assert got.count() == len(edge_rows)
    assert got.where("doc_id is null and class_id is not null").count() == 0
    found = classes_of(got.where("doc_id is not null"))
    assert {found[i] for i in (1, 2, 15)} == {1} and found[3] == 3  # null and empty texts are equal
    assert {found[i] for i in (6, 7, 8)} == {6} and found[10] == 9 and found[11] == 11
    assert all(found[i] == i for i in (4, 5, 12, 13, 14, 16))
    left = [r["doc_id"] for r in one_of_each(edge_docs).select("doc_id").collect()]
    assert sorted(i for i in left if i is not None) == [1, 3, 4, 5, 6, 9, 11, 12, 13, 14, 16] and left.count(None) == 2
    assert near_classes(no_docs).count() == 0 and one_of_each(no_docs).count() == 0


@pytest.mark.parametrize("null_first", [True, False])
def test_an_id_with_two_texts_is_the_one_of_smallest_digest(spark, prose, null_first):
    """One of the texts is null, unlike or like other documents; the rest shares shingles with them."""
    digest = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    base = next(t for k in range(100) if ((t := prose(3000 + k, 150)) and (digest(None) < digest(t)) == null_first))
    alone = sorted((prose(4000 + k, 150) for k in range(20)), key=digest)
    near, like = base + " near", [f"{base} tail{k}" for k in range(20)]
    like.sort(key=digest)
    docs = [
        (1, near, "a"), (2, base, "a"), (2, None, "b"), (3, "z" + alone[0], "a"), (3, base + " end", "a"),
        (4, alone[0], "a"), (4, like[-1], "b"), (5, like[0], "a"), (5, alone[-1], "b"), (6, None, "a"), (7, alone[0], "c"), (8, alone[-1] + " x", "c"),
    ]
    assert digest(alone[0]) < digest(like[-1]) and digest(like[0]) < digest(alone[-1])
    one = {}
    for row in docs:
        if row[0] not in one or digest(row[1]) < digest(one[row[0]][1]):
            one[row[0]] = row
    expected = brute_classes([one[i] for i in sorted(one)])
    assert expected[4] == expected[7] != 1 and expected[5] == 1
    frames = [frame(spark, order) for order in (docs, docs[::-1])]
    for df in frames:
        got = near_classes(df)
        assert got.count() == len(docs) and classes_of(got) == expected
        kept = one_of_each(df)
        assert kept.columns == df.columns and kept.dtypes == df.dtypes
        assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {one[i][:2] for i in expected.values()}


def test_samples_agree_as_often_as_texts_are_similar():
    draw = np.random.RandomState(1)
    hits, sims = [], []
    for _ in range(300):
        keys = np.sort(draw.randint(0, 1 << 56, 60, np.int64).astype(np.uint64))
        weights = draw.uniform(0.5, 3, 60).astype(np.float32)
        other = (weights * draw.uniform(0.6, 1.0, 60)).astype(np.float32)
        found = samples(np.r_[keys, keys], np.r_[weights, other], np.array([0, 60]))
        hits.append((found[0] == found[1]).mean())
        sims.append(similarity((keys, weights), (keys, other), (weights.sum(), other.sum())))
    assert abs(np.mean(hits) - np.mean(sims)) < 0.02


def test_components_of_paths_stars_and_loops(spark):
    pairs = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 150)] + [(200, 200), (7, 300)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    expected = union(pairs, {x for p in pairs for x in p})
    assert got == {i: c for i, c in expected.items() if i != 200}


def brute_repeats(docs):
    first = {}
    for i, text, _ in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        data = (text or "").encode()
        for s in range(len(data) - WINDOW + 1):
            first.setdefault(data[s : s + WINDOW], i)
    out = []
    for i, text, _ in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - WINDOW + 1):
            if i is not None and first[data[s : s + WINDOW]] < i:
                gone[s : s + WINDOW] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(data), int(gone.sum()), spans, bytes(np.frombuffer(data, np.uint8)[~gone])))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def passages(prose):
    draw, parts = random.Random(4), [prose(k, n) for k, n in enumerate((8, 20, 60, 200))] + ["ab" * 120, "é" * 70, "x" * 90]
    docs = []
    for k in range(120):
        text = "".join(
            draw.choice(parts)[draw.randint(0, 40) :] if draw.random() < 0.5 else prose(draw.randint(0, 10**6), 15) for _ in range(draw.randint(0, 5))
        )
        docs.append(((k * 37) % 120, text, "a"))
    return docs + [(500, docs[5][1], "a"), (501, docs[5][1] + " tail", "b"), (502, parts[2], "b")]


@pytest.mark.parametrize("hot_documents", [20_000, 3, 1])
def test_repeats_are_those_of_all_windows(spark, passages, hot_documents):
    got = remove_repeats(frame(spark, passages), hot_documents)
    expected = brute_repeats(passages)
    assert sorted((tuple(r[:4]) + (bytes(r[4]),) for r in got.collect()), key=repr) == expected
    assert sum(r[2] for r in expected) > 5000


@pytest.mark.parametrize("hot_documents", [20_000, 1])
def test_repeat_edge_cases(edge_docs, edge_rows, no_docs, hot_documents):
    got = remove_repeats(edge_docs, hot_documents).collect()
    assert sorted((tuple(r[:4]) + (bytes(r[4]),) for r in got), key=repr) == brute_repeats(edge_rows)
    assert remove_repeats(no_docs, hot_documents).count() == 0


def test_cleaning_keeps_columns_and_whole_characters(spark, passages, no_docs):
    docs = frame(spark, passages)
    kept = suffix_dedup.clean(docs)
    assert kept.columns == docs.columns and suffix_dedup.clean(no_docs).count() == 0
    expected = {i: rest.decode("utf-8", "ignore") for i, n, gone, _, rest in brute_repeats(passages) if not gone or rest.strip()}
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == expected


def with_stretches(size, n):
    """Texts with long stretches of short periods, at other phases and lengths in each, and rules with fillers between."""
    units = ["-", "ab", "= ", "|----", "0123456", "é", "\n" + "-" * 20 + "+"]
    docs = []
    for k in range(n):
        draw = random.Random(k)
        own = units[k % 3 :: 2] if k % 5 else units
        parts = [(u * (size // len(u) + 2))[draw.randint(0, 1) * (u == "ab") :][: size + 2 * draw.randint(0, 40)] for u in own]
        fillers = ["-" * 20 + str(draw.randint(0, 99)) for _ in range(20)]
        docs.append((k, f"head {k} " + f" part {k % 4} ".join(parts) + "".join(fillers) + f"tail {k}", "a"))
    return docs


@pytest.mark.parametrize("hot_documents", [20_000, 1])
def test_stretches_of_a_short_period(spark, hot_documents):
    docs = with_stretches(400, 24)
    got = remove_repeats(frame(spark, docs), hot_documents)
    assert sorted((tuple(r[:4]) + (bytes(r[4]),) for r in got.collect()), key=repr) == brute_repeats(docs)


def test_pieces_hold_every_window_once_or_by_its_period():
    draw = random.Random(3)
    texts = ["-" * 9000, "ab" * 700, "".join("-" * 20 + str(draw.randint(0, 9)) for _ in range(900))]
    texts += ["x" * 300 + "y" * 20 + "xy" * 300 + "".join(draw.choice("xy") for _ in range(500)) + "xxy" * 200]
    for text in texts:
        own = np.frombuffer(text.encode(), np.uint8)
        told = np.zeros(len(own) - WINDOW + 1, int)
        for a, b, period, more in suffix_dedup._pieces(own):
            assert b - a < suffix_dedup.PIECE
            for w in range(a, max(a + more, b) + 1):
                model = a + (w - a) % period if more else w
                assert a <= model <= b and (own[model : model + WINDOW] == own[w : w + WINDOW]).all()
                told[w] += 1
        assert told.min() == 1 and told.max() <= 2


@pytest.mark.parametrize("unit", ["-", "ab"])
def test_long_stretches_take_little_memory(unit):
    """200 texts with 200 KB of one byte or of two, in one task."""
    texts = [f"head {k} " + unit * (200_000 // len(unit)) + f" tail {k}" for k in range(200)]
    key = runs(*utf8_buffer(pa.array([texts[0]])))[0]
    keys, counts = np.unique(key).tobytes(), np.full(len(np.unique(key)), 200).tobytes()

    def batches():
        for k, text in enumerate(texts):
            yield pa.RecordBatch.from_pydict({"id": [k], "digest": [bytes(16)], "text": [text], "keys": [keys], "counts": [counts]})

    tracemalloc.start()
    rows = pa.Table.from_batches(list(suffix_dedup._cut(False, 20_000)(batches()))).sort_by("key")
    spans = list(suffix_dedup._sort(iter(rows.to_batches())))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20 and rows.nbytes < 1 << 20
    found = pa.Table.from_batches(spans).to_pylist()
    covered = {i: max(r["end"] - r["start"] for r in found if r["id"] == i) for i in range(1, 200)}
    assert min(covered.values()) >= 200_000 and all(r["id"] for r in found)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh "])
def test_windows_of_small_alphabets(letters):
    draw = random.Random(2)
    parts = ["".join(draw.choice(letters) for _ in range(draw.randint(30, 300))) for _ in range(6)] + ["a" * 200, "xy" * 100]
    texts = ["".join(draw.choice(parts)[: draw.randint(0, 300)] for _ in range(draw.randint(0, 6))) for _ in range(30)]
    data, offsets = utf8_buffer(pa.array(texts))
    key, first, last, text = runs(data, offsets)
    assert (last - first + 1).sum() == sum(max(0, len(t) - WINDOW + 1) for t in texts)
    order = np.argsort(key, kind="stable")
    key, first, last, text = key[order], first[order], last[order], text[order]
    segments = [data[a : b + WINDOW] for a, b in zip(first, last, strict=True)]
    at, inside = earlier_windows(np.concatenate(segments), np.cumsum([0, *map(len, segments)]), key, text)
    got = defaultdict(set)
    for s, k in zip(at.tolist(), inside.tolist(), strict=True):
        got[int(text[s])].add(int(first[s] + k - offsets[text[s]]))
    seen = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - WINDOW + 1):
            seen.setdefault(t[s : s + WINDOW], i)
    assert got == {i: w for i, t in enumerate(texts) if (w := {s for s in range(len(t) - WINDOW + 1) if seen[t[s : s + WINDOW]] < i})}


def test_colliding_hashes_join_nothing(monkeypatch):
    from crashlens.llm import suffix_sort

    monkeypatch.setattr(suffix_sort.Prefixes, "of", lambda self, at, length: np.zeros(len(at), np.uint64))
    data = np.frombuffer(("a" * 60 + "b" * 60).encode(), np.uint8)
    number = suffix_sort.classes(suffix_sort.Prefixes(data), np.array([0, 60]), np.array([60, 60]), np.array([1, 1]), np.array([1, 2]))
    assert number[0] != number[1]
    number = suffix_sort.classes(suffix_sort.Prefixes(data), np.array([0, 60]), np.array([60, 60]), np.array([1, 1]), np.array([1, 1]))
    assert number[0] != number[1]


def test_a_key_of_every_document_is_counted_once_for_each(spark, prose):
    docs = [(k, "same five words stand here " + prose(k, 30), "a") for k in range(500)]
    told = near_dedup.shared_keys(
        frame(spark, docs).select(F.col("doc_id").alias("id"), "text"), shingle_sets, lambda n, total, keys, counts: True, 500
    ).collect()
    assert len(told) == 500 and all(r["most"] == 500 for r in told)
