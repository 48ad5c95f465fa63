"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so a benchmark question with other values has the same template. Windows of
template tokens are hash-joined with those of the benchmark; where they meet, the values in the slots have to be exchanged
consistently: a value of the question always for the same value of the document. That is judged in each run of windows, and only
windows with a value that is not are dropped; a window whose values are all unchanged always counts.

All of it is built-in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashlens.llm.common import stored
from crashlens.operators.positions import free_name

#: A word or number, with the end of a sentence before it.
TOKEN = r"(?:[.!?\n]['\")\]\s]*)?(?:\p{L}[\p{L}\p{M}]*|\p{N}+(?:[.,]\p{N}+)*)"
SENTENCE_END = ".!?\n'\")] \t\r"

#: Words that are numbers, and units where a number stands before them.
NUMBER_WORDS = ("two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty hundred thousand "
                "million dozen half twice").split()  # fmt: skip
UNITS = ("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams pound pounds ton tons ml l liter liters "
         "litre litres second seconds minute minutes hour hours day days week weeks month months year years percent degree "
         "degrees dollar dollars cent cents euro euros meter meters metre metres kilometers kilograms").split()  # fmt: skip
NUMBER, NAME, UNIT = "#number", "#name", "#unit"

#: Tables of narrow rows (24 bytes) are broadcast up to this many rows; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def bare(token: Column) -> Column:
    """A token without the end of a sentence before it."""
    return F.ltrim(token, F.lit(SENTENCE_END))


def _is_number(token: Column) -> Column:
    first = token.substr(1, 1)
    return ((first >= "0") & (first <= "9")) | F.lower(token).isin(NUMBER_WORDS)


def _is_capitalised(word: Column) -> Column:
    first, second = word.substr(1, 1), word.substr(2, 1)
    return (first != F.lower(first)) & (second != F.upper(second))


def template(found: str) -> Column:
    """Template tokens of the tokens in column ``found``."""

    def typed(token: Column, k: Column) -> Column:
        word = bare(token)
        starts_sentence = (k == 0) | (F.length(word) < F.length(token))
        low = F.lower(word)
        return (
            F.when(_is_number(word), F.lit(NUMBER))
            .when(low.isin(UNITS) & (k > 0) & _is_number(bare(F.get(F.col(found), k - 1))), F.lit(UNIT))
            .when(~starts_sentence & _is_capitalised(word), F.lit(NAME))
            .otherwise(low)
        )

    return F.transform(found, typed)


def windows(hashes: str, width: int) -> Column:
    """(hash, at) of each window of ``width`` token hashes."""
    last = F.size(hashes) - width
    at = lambda k: F.struct(F.xxhash64(*(F.get(F.col(hashes), k + j) for j in range(width))).alias("window"), k.alias("at"))
    return F.transform(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), at)


def _small(df: DataFrame) -> DataFrame:
    """With a broadcast hint if counting shows that it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 8,
    least_windows: int = 6,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pairs of a document and a benchmark item whose template it holds, in whole or over ``width + least_windows - 1`` tokens.

    A pair counts with at least ``least_windows`` windows of the item (or all, if it has fewer) found where the slots agree: windows
    at one shift whose places touch are a run, and a window with a changed value goes if it holds a value that the run gives in two ways. Two values of
    the item may have one value in the document. An item's first word, which starts a sentence there, is found as the same word within a
    sentence too. Windows with fewer than half of their tokens outside slots are no evidence, and an item with no other window, or of
    fewer than ``width`` tokens, matches nothing. Null and empty texts match nothing. A null id is an id like any other; repeated rows
    and documents of one id are one document, items of one id one item. Other columns are not read.

    Result: id, item_id, n_windows, item_windows, n_slots, changed_slots, verbatim.
    """
    items = (
        benchmark.where(F.col("item_id").isNotNull())
        .select("item_id", tokens(F.col("text")).alias("item_tokens"))
        .select("item_id", "item_tokens", template("item_tokens").alias("item_template"))
    )
    slot = lambda t: t.isin(NUMBER, NAME, UNIT)
    literal = F.size(F.filter(F.slice("item_template", F.col("w.at") + 1, width), lambda t: ~slot(t)))
    first = bare(F.get("item_tokens", F.lit(0)))
    # Within a sentence a document's template has a name for the first word.
    as_name = items.where(~slot(F.get("item_template", F.lit(0))) & _is_capitalised(first)).withColumn(
        "item_template", F.concat(F.array(F.lit(NAME)), F.slice("item_template", 2, width - 1))
    )
    item_windows = (
        items.union(as_name)
        .withColumn("h", F.transform("item_template", lambda t: F.xxhash64(t)))
        .select("item_id", "item_template", F.explode(windows("h", width)).alias("w"))
        .where(2 * literal >= width)
        .select("item_id", F.col("w.window").alias("window"), F.col("w.at").alias("item_at"))
    )
    totals = item_windows.groupBy("item_id").agg(F.countDistinct("item_at").alias("item_windows"))
    probe = _small(item_windows)

    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))
    met = stored(
        texts.select("id", tokens(F.col("text")).alias("tokens"))
        .select("id", template("tokens").alias("template"))
        .select("id", F.transform("template", lambda t: F.xxhash64(t)).alias("h"))
        .select("id", F.explode(windows("h", width)).alias("w"))
        .select("id", F.col("w.window").alias("window"), F.col("w.at").alias("at"))
        .join(probe, "window")
        .groupBy("id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
        .agg(F.sort_array(F.collect_set("item_at")).alias("found")),  # at most the windows of one item
        "decontamination",
    )

    # The values in the slots: only documents with a hit are read again.
    ids = _small(met.select(F.col("id").alias("met_id")).distinct())
    again = texts.join(ids, F.col("id").eqNullSafe(F.col("met_id")), "left_semi").select("id", tokens(F.col("text")).alias("tokens"))
    # Of a document's tokens only those under the windows go on, so a text with many hits is not copied for each.
    own = F.slice("tokens", F.col("shift") + F.get("found", F.lit(0)) + 1, F.element_at("found", -1) - F.get("found", F.lit(0)) + width)
    hits = again.join(met.withColumnRenamed("id", "met_id"), F.col("id").eqNullSafe(F.col("met_id"))).select(
        "id", "item_id", "shift", "found", own.alias("given")
    )
    covers = lambda f, k: (f <= k) & (k < f + width)
    asked = lambda k: F.lower(bare(F.get(F.col("item_tokens"), k)))
    given = lambda k: F.lower(bare(F.get(F.col("given"), k - F.get("found", F.lit(0)))))
    # A run starts at each window that stands apart from the one before; the start is its name.
    starts = F.filter("found", lambda f, i: (i == 0) | (f > F.get(F.col("found"), i - 1) + width))
    run = lambda k: F.array_max(F.filter("starts", lambda s: s <= k))
    slots = F.transform(
        "item_template",
        lambda t, k: F.when(
            slot(t) & F.exists("found", lambda f: covers(f, k)),
            F.struct(k.alias("k"), F.struct(run(k), t, asked(k)).alias("value"), given(k).alias("given"), (asked(k) != given(k)).alias("changed")),
        ),
    )
    torn = F.filter("slots", lambda s: F.exists("slots", lambda o: (o["value"] == s["value"]) & (o["given"] != s["given"])))
    holds = lambda name, f, test: F.exists(name, lambda s: covers(f, s["k"]) & test(s))
    conflict = lambda f: holds("slots", f, lambda s: s["changed"]) & holds("torn", f, lambda s: F.lit(True))
    other_word = (asked(F.lit(0)) != given(F.lit(0))) & ~slot(F.get("item_template", F.lit(0)))
    kept = F.filter("found", lambda f: ~conflict(f) & ~((f == 0) & other_word))
    return (
        hits.join(items, "item_id")
        .withColumn("starts", starts)
        .withColumn("slots", F.filter(slots, lambda s: s.isNotNull()))
        .withColumn("torn", torn)
        .withColumn("kept", kept)
        .withColumn("slots", F.filter("slots", lambda s: F.exists("kept", lambda f: covers(f, s["k"]))))
        .select(
            "id",
            "item_id",
            F.explode("kept").alias("item_at"),
            F.size("slots").alias("slots"),
            F.size(F.filter("slots", lambda s: s["changed"])).alias("changed"),
        )
        .groupBy("id", "item_id")
        .agg(
            F.countDistinct("item_at").alias("n_windows"),
            F.max("slots").cast("long").alias("n_slots"),
            F.max("changed").cast("long").alias("changed_slots"),
        )
        .join(totals, "item_id")
        .where(F.col("n_windows") >= F.least(F.lit(least_windows), "item_windows"))
        .select(
            F.col("id").alias(id_column),
            "item_id",
            "n_windows",
            "item_windows",
            "n_slots",
            "changed_slots",
            (F.col("changed_slots") == 0).alias("verbatim"),
        )
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The rows, with all their columns, of documents that hold no benchmark item."""
    name = free_name("found", docs)
    found = _small(
        stored(
            contaminated(docs, benchmark, id_column=id_column, **options).select(F.col(id_column).alias(name)).distinct(),
            "decontamination",
        )
    )
    return docs.join(found, docs[id_column].eqNullSafe(F.col(name)), "left_anti")
