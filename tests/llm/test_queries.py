"""Every registered query of the subpackage over whole tables, against its SQL where there is one."""

import pytest
from llm_frames import *  # noqa: F403  (fixtures)
from llm_frames import rows
from pyspark.sql import functions as F

import corpus_pipeline
from crashlens.llm.queries import ORACLES, QUERIES


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    expected = sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)
    assert rows(df.select(columns)) == expected


CONTRACT = {
    "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op5_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op7_html_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op8_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op10_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
}


@pytest.mark.parametrize("name", CONTRACT)
def test_query_returns_its_columns_for_every_row(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in CONTRACT[name]} == CONTRACT[name]
    source, key = ("pages", "page_id") if name.startswith("op7") else ("documents", "doc_id")
    ids = spark.read.parquet(f"{sf_dir}/{source}.parquet").select(key)
    assert df.select(key).distinct().count() == ids.distinct().count()
    if name != "op3_packing":
        assert df.count() == ids.count()


def test_stages_return_documents_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
        after = after.cache()
        before_ids, ids = ({r[0] for r in d.select("doc_id").collect()} for d in (docs, after))
        assert ids <= before_ids and len(ids) == after.count()
        kept[name] = (before_ids, ids)
        docs = after
    before, after = kept["quality classifier"]
    good = {i for i in before if labels.get(i) == 1}
    assert len(good & after) >= 0.97 * len(good)
    assert len({i for i in before if labels.get(i) == 0} & after) <= 3
    assert all(r["n_chars"] == len(r["text"]) for r in docs.select("n_chars", "text").collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_pipeline_runs_as_a_whole(spark, sf_dir):
    df = corpus_pipeline.run(spark, sf_dir)
    sizes = [r["n"] for r in df.groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()]
    assert sizes and max(sizes) <= 2048


CLASHES = ("_id", "_digest", "_spans", "_other", "_row", "_found", "id", "key", "keys", "segment", "class_id", "n", "part")


@pytest.fixture(scope="module")
def edge_folder(spark, sf_dir, edge_rows, tmp_path_factory):
    """Documents with nulls, empty and long texts, repeated rows and ids, ids with several texts, and columns named as inside."""
    folder = tmp_path_factory.mktemp("edges")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    edges = [(i and 10**6 + i, t, None, s, None if t is None else len(t)) for i, t, s in edge_rows]
    edges += [(10**6 + 6, "another text of the same id", "en", "a", 27), (10**6 + 6, None, None, None, None)]
    kinds = ", ".join(f"`{n}` {k}" for n, k in docs.select("doc_id", "text", "lang", "source", "n_chars").dtypes)
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(edges, kinds))
    rows.withColumns({name: F.lit(name) for name in CLASHES}).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_stages_take_edge_rows_and_empty_tables(spark, edge_folder):
    """Every stage over the edge rows themselves, then over what the stages before it leave, then over no rows."""
    docs = spark.read.parquet(f"{edge_folder}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        alone = stage(spark, docs, edge_folder)
        assert alone.columns == docs.columns and 0 < alone.count() <= docs.count()
        kept = stage(spark, kept, edge_folder).cache()
        assert kept.columns == docs.columns and all(r["_id"] == "_id" for r in kept.select("_id").collect())
        assert stage(spark, docs.where(F.lit(False)), edge_folder).count() == 0
    pack = corpus_pipeline.STAGES[-1][1]
    assert pack(spark, docs.where(F.lit(False)), edge_folder).count() == 0
    for rows in (docs, kept):
        pieces = pack(spark, rows, edge_folder)
        assert pieces.where("start = 0").count() == rows.count()
