"""Groups spelling variants: words one edit apart, found by PartEnum signatures of their letters.

A word's letters are a multiset, that is a binary vector with one place for each further occurrence of a letter. One edit
changes at most two places. The letters are parted into ``PARTS`` parts, so two words at that distance agree in all but two parts, and
each choice of the others is an exact signature; it is taken once for every half of the word, as one edit leaves a half as it is.
Words with an equal signature meet by an equi-join and the pair is verified. A signature that more than ``CROWD`` words have
joins on what is left of the other half when one letter is taken out: such a key has only true pairs, so no group is
joined with itself.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log2, log10

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashlens.llm.common import stored

#: Letters from frequent to rare, dealt to the parts in turn so that each part tells words apart; fixed values.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz" + "".join(map(chr, range(0xC0, 0x100)))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, LEAST_RATIO = 7, 2, 10
PARTS, CHANGED, CROWD = 4, 2, 32


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", drop_one_in: int | None = 31) -> DataFrame:
    """(word, n): maximal runs of Latin letters of whole texts, A-Z lower-cased, of ``LEAST_LENGTH`` letters and more.

    With ``drop_one_in`` a run loses a letter where the crc32 of ``id:run`` is divisible by it, the letter at the crc32 modulo the length.
    A null text has no words; a null id counts as an empty one. Counting starts before the shuffle, so a frequent word costs a row a task.
    """
    run = F.explode(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0)))
    words = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("key"), run.alias("word"))
    if drop_one_in:
        words = words.withColumn("h", F.crc32(F.concat("key", F.lit(":"), "word")))
        at = (F.col("h") % F.length("word")).cast("int")
        left = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = words.select(F.when(F.col("h") % drop_one_in == 0, left).otherwise(F.col("word")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))


def _members(words: DataFrame) -> DataFrame:
    """(word, n, key, own, last) for each signature of each word.

    ``key`` stands for: the length of the shorter word of a pair, the half that both share (the ``last`` one or the first), and two of the
    parts of their letters. ``own``: the word is of that length; otherwise it is longer by one letter.
    """
    # Each step is a column of its own, so that Spark takes it once and not once for each signature.
    sorted_letters = F.array_join(F.array_sort(F.split("word", "")), "")
    parts = {f"p{part}": F.translate("letters", "".join(c for i, c in enumerate(LETTERS) if i % PARTS != part), "") for part in range(PARTS)}
    chosen = {f"c{i}": F.xxhash64(F.lit(i), *(f"p{part}" for part in some)) for i, some in enumerate(combinations(range(PARTS), PARTS - CHANGED))}
    halves = {}
    for own in (True, False):
        shorter = F.length("word") - (0 if own else 1)
        half = F.floor(shorter / 2).cast("int")
        halves[f"h{own}{False}"] = F.xxhash64(shorter, F.lit(0), F.substring("word", F.lit(1), half))
        halves[f"h{own}{True}"] = F.xxhash64(shorter, F.lit(1), F.substring("word", half - shorter, F.length("word")))
    table = words.select("word", "n").withColumn("letters", sorted_letters).withColumns(parts).withColumns(chosen | halves)
    kinds = [(own, last) for own in (True, False) for last in (True, False)]
    signatures = [F.struct(F.xxhash64(c, f"h{own}{last}").alias("key"), F.lit(own).alias("own"), F.lit(last).alias("last")) for c in chosen for own, last in kinds]
    return table.select("word", "n", F.inline(F.array(*signatures)))


def _rest() -> Column:
    """The half of a word that the signature does not hold."""
    shorter = F.length("word") - F.when(F.col("own"), 0).otherwise(1)
    half = F.floor(shorter / 2).cast("int")
    return F.when(F.col("last"), F.substring("word", F.lit(1), F.length("word") - shorter + half)).otherwise(F.substring("word", half + 1, F.length("word")))


def _without_one_letter(tagged: bool) -> Column:
    """Keys of the rest with one letter taken out; tagged with its place, they meet only where the same place was changed."""
    places = F.sequence(F.lit(1), F.length("rest"))
    left = lambda i: F.concat(F.substring("rest", F.lit(1), i - 1), F.substring("rest", i + 1, F.length("rest")))
    return F.array_distinct(F.transform(places, lambda i: F.xxhash64("key", i if tagged else F.lit(0), left(i))))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of words (distinct; with their n), both ways, that differ by exactly one inserted, deleted or replaced letter.

    A pair is never lost: equal hashes of a signature only bring pairs that don't hold to the verification. A word of a crowded
    signature has a key for each letter of half the word, so a run of many thousand letters costs that number squared there.
    """
    members = _members(words)
    # A crowded key is counted before the shuffle; a key alone, or without a word of its length, has no pair.
    sizes = members.groupBy("key").agg(F.count("*").alias("size"), F.count(F.when(F.col("own"), 1)).alias("owners"))
    live = sizes.where("size > 1 and owners > 0").select("key", (F.col("size") > CROWD).alias("crowded"))
    members = stored(members.join(live, "key"), "signatures")
    calm, crowd = members.where("not crowded"), members.where("crowded").withColumn("rest", _rest())

    def pairs(one: DataFrame, other: DataFrame, key: str) -> DataFrame:
        other = other.select(key, F.col("own").alias("same"), F.col("word").alias("near"), F.col("n").alias("near_n"))
        apart = F.when(F.col("same"), F.col("word") < F.col("near")).otherwise(True)
        met = one.select(key, "word", "n").join(other, key).where(apart)
        return met.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")

    split = crowd.where("own").withColumns({"at": F.explode(_without_one_letter(True))})
    replaced = pairs(split, split, "at")
    whole = crowd.where("own").withColumns({"at": F.xxhash64("key", F.lit(0), "rest")})
    inserted = pairs(whole, crowd.where("not own").withColumns({"at": F.explode(_without_one_letter(False))}), "at")
    found = pairs(calm.where("own"), calm, "key").union(replaced).union(inserted).distinct()
    both = F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return found.select(both.alias("p")).select("p.*")


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a table (word, n) of distinct words.

    A word's form is its near word of largest n, the smallest in code-point order among ties, if that n is ``LEAST_RATIO`` times the
    word's or more. The root is the last word that forms lead to, or the word. As n grows tenfold with each form, the
    largest n bounds the steps; each round of joins doubles them.
    """
    words = stored(words.select("word", "n"), "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    strong = F.col("form_n") >= LEAST_RATIO * F.col("n")
    found = stored(found.withColumns({"form": F.when(strong, F.col("form")), "form_n": F.when(strong, F.col("form_n"))}), "forms")
    most, least = words.agg(F.max("n"), F.min("n")).first()
    steps = int(log10(max(most or 1, 1) / max(least or 1, 1))) + 2  # one more than can be, for the rounding
    roots = found.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(ceil(log2(steps))):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stored(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Variants among the words that the texts have ``LEAST_COUNT`` times or more."""
    return variants(word_counts(docs, id, text).where(F.col("n") >= LEAST_COUNT))
