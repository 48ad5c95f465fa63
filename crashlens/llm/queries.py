"""The registered queries of the numbered operators, each over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.llm.common import ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return function(spark, sf_dir)

        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLES[function.__name__] = sql.strip()
        return function

    return register


def vocabulary() -> str:
    """The vocabulary file to pack with: VOCABULARY, or the public one."""
    if path := os.environ.get("VOCABULARY"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crashlens.llm import toxicity
    from crashlens.llm.quality_classifier import held_out

    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query()
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crashlens.llm import quality_classifier as quality

    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.withColumns({"held_out": quality.held_out(), "kept": F.col("tail") >= 0.5})


@query()
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crashlens.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary())


@query(
    """
WITH placed AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS k
    FROM conversations
), logged AS (
    SELECT conv_id, list({'role': role, 'text': text} ORDER BY k) AS turns,
        string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY k) AS text
    FROM placed GROUP BY conv_id
), shorter AS (
    SELECT DISTINCT turns[1:n] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS n FROM logged)
)
SELECT min(conv_id) AS conv_id, CAST(len(turns) AS BIGINT) AS n_turns, count(*) AS copies, any_value(text) AS text
FROM logged WHERE turns NOT IN (SELECT turns FROM shorter) GROUP BY turns
"""
)
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crashlens.llm.chat import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


@query()
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crashlens.llm.sharding import shard_by_bytes

    shards = shard_by_bytes(table(spark, sf_dir, "documents"))
    return shards.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def _template_sql() -> str:
    """Documents that hold the template of a benchmark item, as ``decontamination.contaminated`` with its defaults finds them."""
    from crashlens.llm.decontamination import NAME, NUMBER, NUMBER_WORDS, TOKEN, UNIT, UNITS

    quoted = lambda values: "(" + ", ".join(f"'{value}'" for value in values) + ")"
    text = lambda value: "'" + value.replace("'", "''") + "'"
    ends = "'.!?' || chr(10) || chr(39) || '\")] ' || chr(9) || chr(13)"
    bare = lambda token: f"ltrim({token}, {ends})"
    number = lambda token: f"(regexp_matches({token}, '^[0-9]') OR lower({token}) IN {quoted(NUMBER_WORDS)})"
    capitalised = lambda word: f"({word}[1] <> lower({word}[1]) AND {word}[2] <> upper({word}[2]))"
    template = f"""list_transform(tokens, lambda x, i: CASE WHEN {number(bare("x"))} THEN '{NUMBER}'
        WHEN lower({bare("x")}) IN {quoted(UNITS)} AND i > 1 AND {number(bare("tokens[i - 1]"))} THEN '{UNIT}'
        WHEN i > 1 AND length({bare("x")}) = length(x) AND {capitalised(bare("x"))} THEN '{NAME}'
        ELSE lower({bare("x")}) END)"""
    typed = quoted((NUMBER, NAME, UNIT))
    parted = lambda table, key: f"""SELECT {key}, tokens, {template} AS template FROM (
        SELECT {key}, regexp_extract_all(coalesce(text, ''), {text(TOKEN)}) AS tokens FROM {table})"""  # noqa: E731
    windows = lambda table, key: f"""SELECT {key}, place, template[place:place + 7] AS w FROM (
        SELECT {key}, template, unnest(range(1, len(template) - 6)) AS place FROM {table})"""  # noqa: E731
    return f"""
WITH docs AS ({parted("documents", "doc_id")}), items AS ({parted("benchmark", "item_id")}),
first_words AS (
    SELECT *, template[1] NOT IN {typed} AND {capitalised(bare("tokens[1]"))} AS as_name FROM items WHERE len(tokens) >= 8
), candidates AS (
    SELECT * FROM ({windows("items", "item_id")})
    UNION ALL SELECT item_id, 1, ['{NAME}'] || template[2:8] FROM first_words WHERE as_name
), item_windows AS (SELECT DISTINCT * FROM candidates WHERE 2 * len(list_filter(w, lambda x: x NOT IN {typed})) >= 8),
totals AS (SELECT item_id, count(DISTINCT place) AS item_windows FROM item_windows GROUP BY item_id),
met AS (
    SELECT DISTINCT doc_id, item_id, d.place - i.place AS shift, i.place AS item_at
    FROM ({windows("docs", "doc_id")}) d JOIN item_windows i USING (w)
), placed AS (
    SELECT *, lag(item_at) OVER (PARTITION BY doc_id, item_id, shift ORDER BY item_at) AS before FROM met
), runs AS (
    SELECT doc_id, item_id, shift, item_at,
        count(*) FILTER (WHERE before IS NULL OR item_at > before + 8) OVER (PARTITION BY doc_id, item_id, shift ORDER BY item_at) AS run
    FROM placed
), covered AS (
    SELECT DISTINCT doc_id, item_id, shift, run, item_at + k AS place FROM runs, range(8) AS r(k)
), slots AS (
    SELECT doc_id, item_id, shift, run, place, i.template[place] AS kind, lower({bare("i.tokens[place]")}) AS asked,
        lower({bare("d.tokens[place + shift]")}) AS given
    FROM covered JOIN items i USING (item_id) JOIN docs d USING (doc_id) WHERE i.template[place] IN {typed}
), judged AS (
    SELECT *, asked <> given AS changed,
        min(given) OVER same <> max(given) OVER same AS torn
    FROM slots WINDOW same AS (PARTITION BY doc_id, item_id, shift, run, kind, asked)
), conflicts AS (
    SELECT r.doc_id, r.item_id, r.shift, r.item_at FROM runs r JOIN judged j
        ON r.doc_id = j.doc_id AND r.item_id = j.item_id AND r.shift = j.shift AND j.place BETWEEN r.item_at AND r.item_at + 7
    GROUP BY ALL HAVING bool_or(changed) AND bool_or(torn)
), kept AS (
    SELECT runs.* FROM runs ANTI JOIN conflicts USING (doc_id, item_id, shift, item_at) JOIN items i USING (item_id) JOIN docs d USING (doc_id)
    WHERE item_at > 1 OR i.template[1] IN {typed} OR lower({bare("i.tokens[1]")}) = lower({bare("d.tokens[1 + shift]")})
), counted AS (
    SELECT doc_id, item_id, shift, count(DISTINCT j.place) AS n_slots, count(DISTINCT j.place) FILTER (WHERE changed) AS changed_slots
    FROM kept k JOIN judged j USING (doc_id, item_id, shift) WHERE j.place BETWEEN k.item_at AND k.item_at + 7 GROUP BY ALL
)
SELECT doc_id, item_id, count(DISTINCT item_at) AS n_windows, any_value(item_windows) AS item_windows, max(coalesce(n_slots, 0)) AS n_slots,
    max(coalesce(changed_slots, 0)) AS changed_slots, max(coalesce(changed_slots, 0)) = 0 AS verbatim
FROM kept LEFT JOIN counted USING (doc_id, item_id, shift) JOIN totals USING (item_id) GROUP BY doc_id, item_id
HAVING count(DISTINCT item_at) >= least(6, any_value(item_windows))"""


@query(_template_sql())
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crashlens.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crashlens.llm.html_text import extract, fit

    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))


@query()
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crashlens.llm.suffix_dedup import remove_repeats

    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


@query()
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crashlens.llm.near_dedup import near_classes

    return near_classes(table(spark, sf_dir, "documents"))


@query(
    """
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, coalesce(text, '') AS text FROM documents
), placed AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words
), windows AS (
    SELECT doc_id, pos, word AS a, lead(word) OVER p AS b, lead(word, 2) OVER p AS c
    FROM placed WINDOW p AS (PARTITION BY doc_id ORDER BY pos)
), counted AS (
    SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows WHERE c IS NOT NULL
), repeated AS (
    SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words FROM counted, range(3) AS r(k) WHERE n > 1 GROUP BY doc_id
), lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words
), line_counts AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), measured AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS capitals,
        length(regexp_replace(text, '[^!]', '', 'g')) AS marks, length(regexp_replace(text, '[^\\n]', '', 'g')) + 1 AS n_lines
    FROM words LEFT JOIN repeated USING (doc_id) LEFT JOIN line_counts USING (doc_id)
), judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 5 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words
        OR word_chars > 20 * n_words OR 2 * capitals > n_words OR 2 * marks > n_words) AS kept
FROM judged
"""
)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crashlens.llm.quality_rules import apply_rules

    return apply_rules(table(spark, sf_dir, "documents")).drop("rejected_by", "rules_run")


@query()
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crashlens.llm.spelling import spelling_groups

    return spelling_groups(table(spark, sf_dir, "documents"))


@query()
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crashlens.llm.whitening import fit, whiten

    vectors = table(spark, sf_dir, "embeddings")
    return whiten(vectors, fit(vectors)).withColumn("deviation", F.col("deviation").try_cast("long"))


@query(
    """
WITH parted AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), urls AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM parted
), rules(name, start, verdict) AS (
    VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'),
        ('net', '/fr/', 'block')
), fitting AS (
    SELECT page_id, url_row, host, path, name || start AS rule, verdict,
        row_number() OVER (PARTITION BY url_row ORDER BY length(name || start) DESC NULLS LAST, length(name) DESC) AS place
    FROM (SELECT *, row_number() OVER () AS url_row FROM urls)
    LEFT JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fitting WHERE place = 1
"""
)
def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from crashlens.llm.url_rules import judge, rules_table

    rules = rules_table(spark, allow=["com/", "www.example.com/en/"], block=["example.com/en/", "net/es/", "net/fr/"])
    return judge(table(spark, sf_dir, "pages"), rules)
