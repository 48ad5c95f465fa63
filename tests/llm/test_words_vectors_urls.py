"""Spelling variants, whitening and URL rules against brute force, and on odd rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from llm_frames import *  # noqa: F403  (fixtures)
from llm_frames import frame, rows

from crashlens.llm import spelling, url_rules, whitening
from crashlens.llm.queries import QUERIES

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(docs):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {word: n for word, n in counts.items() if len(word) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    """Every two words that share a word left by taking a letter out, compared one by one."""
    left = defaultdict(set)
    for word in counts:
        for key in {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}:
            left[key].add(word)
    near = {word: set() for word in counts}
    for group in left.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[word] = best if best and counts[best] >= 10 * counts[word] else None
    out = []
    for word, n in counts.items():
        root = word
        while form[root]:
            root = form[root]
        out.append((word, form[word], root, n, len(near[word]), counts[form[word]] if form[word] else None))
    return sorted(out, key=repr)


def test_spelling_query_is_brute_force(spark, duck, sf_dir):
    docs = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    found = QUERIES["op11_spelling"](spark, sf_dir).select("word", "form", "root", "n", "n_near", "form_n")
    assert rows(found) == brute_variants(brute_counts(docs))


@pytest.mark.parametrize("crowd", [1, 32])
def test_words_of_few_letters_share_all_signatures(spark, monkeypatch, crowd):
    """Words of two letters are crowded in every signature; repeated letters, long words and chains of forms are there too."""
    monkeypatch.setattr(spelling, "CROWD", crowd)
    counts = {"".join("ab"[i >> k & 1] for k in range(9)): 2 + i % 7 for i in range(512)}
    counts |= {"".join("ab"[i >> k & 1] for k in range(8)): 3 for i in range(256)}
    counts |= {"colouring": 1, "coloring": 30, "colorings": 300, "colorinks": 40_000, "é" * 4000: 2, "é" * 4001: 20, "q" * 7: 5, "zebrafish": 9}
    found = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3))
    assert rows(found) == brute_variants(counts)


def test_spelling_of_odd_documents(spark, edge_docs, edge_rows, no_docs):
    found = spelling.spelling_groups(edge_docs).select("word", "form", "root", "n", "n_near", "form_n")
    assert rows(found) == brute_variants(brute_counts([(r[0], r[1]) for r in edge_rows]))
    assert spelling.spelling_groups(no_docs).count() == 0
    latin = [(1, "ÀÖØÞßàöøþÿ×÷ straßenbahn STRASSENBAHN İstanbuler Ünïcödés", "a")] * 2
    assert rows(spelling.word_counts(frame(spark, latin))) == sorted(brute_counts([r[:2] for r in latin]).items(), key=repr)


def brute_whitening(vectors, k=16):
    x = [[math.floor(64 * float(c)) + 1000000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(column) for column in zip(*fit, strict=True)]
    cov = np.array([[sum((n * r[a] - sums[a]) * (n * r[b] - sums[b]) for r in fit) / n**3 for b in range(len(sums))] for a in range(len(sums))])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    centred = np.array([[(n * c - s) / n for c, s in zip(r, sums, strict=True)] for r in x])
    deviations = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    return n, deviations, centred @ vectors / np.sqrt(values), values / np.trace(cov)


def vectors_frame(spark, vectors, kind="float"):
    rows = [(i, v, "x", 1.0, 2) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, component string, n double, x int").repartition(3)


def check_whitening(spark, vectors, kind="float"):
    table = vectors_frame(spark, vectors, kind)
    found = whitening.whiten(table, whitening.fit(table)).toArrow().to_pylist()
    n, deviations, whitened, explained = brute_whitening(vectors)
    assert len(found) == whitened.size
    for component in range(whitened.shape[1]):
        mine = sorted((r for r in found if r["component"] == component + 1), key=lambda r: r["vec_id"])
        z = np.array([r["whitened"] for r in mine])
        sign = np.sign(z @ whitened[:, component])
        assert np.allclose(z * sign, whitened[:, component], rtol=1e-7, atol=1e-7)
        assert [int(r["deviation"]) for r in mine] == deviations
        assert {r["n"] for r in mine} == {n} and np.allclose([r["explained"] for r in mine], explained[component], rtol=1e-9)
        assert all(0 <= r["identity_error"] < 1e-9 for r in mine)


def test_whitening_is_brute_force(spark):
    draw = np.random.default_rng(3)
    few = draw.normal(size=(300, 5)).astype(np.float32) * [1, 2, 3, 4, 5]
    check_whitening(spark, [*few.tolist(), *few[:40].tolist(), *[few[7].tolist()] * 150])  # copies count once
    check_whitening(spark, draw.normal(size=(200, 20)).tolist(), "double")


def test_whitening_of_far_apart_numbers_is_exact(spark):
    draw = np.random.default_rng(4)
    far = draw.normal(size=(90, 3)) * [1e9, 2e13, 1.0] + [3e14, 0, 5]
    table = vectors_frame(spark, far.tolist(), "double")
    model = whitening.fit(table)
    found = {r["vec_id"]: r["deviation"] for r in whitening.whiten(table, model).select("vec_id", "deviation").distinct().collect()}
    n, deviations, _, _ = brute_whitening(far.tolist())
    assert [int(found[i]) for i in range(90)] == deviations


def test_common_ones_are_cross_products():
    draw = np.random.default_rng(5)
    x = draw.integers(0, 1 << 40, size=(1000, 4))
    low, bits = x.min(0), np.array([int(b).bit_length() for b in x.max(0) - x.min(0)])
    batch = pa.RecordBatch.from_pydict({"x": pa.array(x.tolist(), pa.list_(pa.int64()))})
    sums = defaultdict(int)
    for out in whitening._scatter(low, bits)(iter([batch.slice(0, 77), batch.slice(77)])):
        for r in out.to_pylist():
            sums[r["a"], r["b"]] += r["value"] << (whitening.LIMB * r["limb"])
    u = (x - low).astype(object)
    assert sums == {(a, b): int((u[:, a] * u[:, b]).sum()) for a in range(4) for b in range(a, 4)}


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 7.0], [1.5, -2.0, 7.0], [0.25, 0.0, 7.0], [-3.0, 9.0, 7.0]]
    odd = [None, [], [1.0, None, 2.0], [nan, 1.0, 1.0], [inf, 0.0, 0.0], [1.0, -inf, 0.0], [3e38, 0.0, 0.0], [1.0, 2.0]]
    table = vectors_frame(spark, good + odd)
    found = whitening.whiten(table, whitening.fit(table))
    assert rows(found.select("vec_id", "component")) == sorted(((i, c) for i in range(4) for c in (1, 2)), key=repr)  # the third is constant
    assert found.where("n <> 4 or identity_error > 1e-9").count() == 0
    for none in (vectors_frame(spark, [None, [nan]]), table.where("false"), vectors_frame(spark, [[]]), vectors_frame(spark, [[1.0, 2.0]] * 3)):
        assert whitening.whiten(none, whitening.fit(none)).count() == 0


RULES = ["com/", "www.example.com/en/"], ["example.com/en/", "net/es/", "net/fr/"]


def brute_judge(url, allow, block):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(FOLD)
    best = (-1, -1, None, "allow")
    for verdict, rules in (("allow", allow), ("block", block)):
        for rule in rules:
            name, slash, start = rule.partition("/")
            name, start = name.translate(FOLD), slash + start
            if (host == name or host.endswith("." + name)) and path.startswith(start):
                best = max(best, (len(name + start), len(name), name + start, verdict))
    return host, path, best[2], best[3]


URLS = [
    None, "", "example.com/en/", "http://", "http:///en/", "http://example.com", "http://example.com/", "https://EXAMPLE.com/en/x?y#z",
    "http://www.example.com/en/a", "http://a.www.example.com/en/", "http://notexample.com/en/", "http://example.com/EN/", "http://x.net/es/?q", "ftp://x.net/fr",
    "http://net/fr/", "http://com/", "http://com", "http://é.NET/es/ñandú", "http://a.com:80/x", "http://a?b/en/", "x://y://example.com/en/",
    "http://example.com./en/", "http://.com/", "http://..com//", "http://x.net/es/\nline", "http://İ.com/", "http://example.com/en/" + "long" * 9000,
]


@pytest.mark.parametrize("options", [{}, {"bits": 2}, {"most_bytes": 0}], ids=["keys", "collisions", "join"])
@pytest.mark.parametrize("rules", [RULES, (["", "a.com", "é.net/es/ñ", "com/x/y"], ["com", "A.com", "net/e", "net/es/ñandú", "com/x"]), ([], [])], ids=["contract", "odd", "none"])
def test_rules_are_brute_force(spark, rules, options):
    pages = spark.createDataFrame([(i, url, "a", 1, "r") for i, url in enumerate(URLS * 2)], "page_id long, url string, host string, `key` int, rule string")
    found = url_rules.judge(pages, url_rules.rules_table(spark, *rules), **options)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert rows(found) == sorted(((i, *brute_judge(url, *rules)) for i, url in enumerate(URLS * 2)), key=repr)
    left = url_rules.allowed(pages, url_rules.rules_table(spark, *rules), **options)
    assert left.columns == pages.columns
    assert rows(left.select("page_id")) == sorted(((i,) for i, url in enumerate(URLS * 2) if brute_judge(url, *rules)[3] == "allow"), key=repr)


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(none, url_rules.rules_table(spark, *RULES)).count() == 0


def test_many_rules_of_one_length(spark, tmp_path):
    """Keys of 6 bits for 500 rules: every key stands for several strings, each is told apart by its string."""
    block = [f"h{i}.org/p{i % 10}/" for i in range(500)]
    pages = spark.createDataFrame([(i, f"http://www.h{i}.org/p{i % 10 if i % 3 else 'x'}/q") for i in range(700)], "page_id long, url string")
    found = {r["page_id"]: r["rule"] for r in url_rules.judge(pages, url_rules.rules_table(spark, block=block), bits=6).collect()}
    assert found == {i: f"h{i}.org/p{i % 10}/" if i < 500 and i % 3 else None for i in range(700)}


def test_duckdb_agrees_on_odd_urls(spark):
    from crashlens.llm.queries import ORACLES

    con = duckdb.connect()
    pages = pa.table({"page_id": list(range(len(URLS))), "url": URLS})  # noqa: F841
    con.register("pages", pages)
    expected = sorted(((i, *brute_judge(url, *RULES)) for i, url in enumerate(URLS)), key=repr)
    assert sorted(con.execute(ORACLES["op13_url_filters"]).fetchall(), key=repr) == expected
