"""Quality rules as a short-circuit cascade.

A bounded sample shows what each rule costs and how much it rejects; rules then run in the order of rejection per cost, and a
text leaves at the first rule that rejects it. The order changes the cost only: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.llm.common import slices, texts

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
CONTINUATION = bytes(range(0x80, 0xC0))


class Text:
    """A text as UTF-8 bytes; what several rules need is worked out once, and only if a rule asks."""

    def __init__(self, text: str):
        self.data = text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()  # bytes.split() parts at space, tab, \n, \v, \f and \r only

    @cached_property
    def word_chars(self) -> int:
        return len(self.data.translate(None, CONTINUATION + SPACES))

    @cached_property
    def symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def duplicate_lines(self) -> int:
        lines = [line for line in self.data.split(b"\n") if line.strip(SPACES)]
        return len(lines) - len(set(lines))

    @cached_property
    def repeated_words(self) -> int:
        """Words inside a window of three words that is found twice or more in the text."""
        n, number = len(self.words), {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, n)
        if n < 4 or len(number) == n:
            return 0
        _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
        windows = pairs[:-1].astype(np.int64) * len(number) + ids[2:]
        _, kind, count = np.unique(windows, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(count[kind] > 1)
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[starts + k] = True
        return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a text that has to go."""

    name: str
    rejects: Callable[[Text], bool]


BASE_RULES = (
    Rule("few_words", lambda t: len(t.words) < 50),
    Rule("repeated_words", lambda t: 100 * t.repeated_words > 50 * len(t.words)),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda t: 5 * t.symbols > len(t.words)),
    Rule("duplicate_lines", lambda t: 2 * t.duplicate_lines > t.data.count(b"\n") + 1),
    Rule("word_length", lambda t: not 2 * len(t.words) <= t.word_chars <= 20 * len(t.words)),
    Rule("capitals", lambda t: 2 * sum(map(bytes.isupper, t.words)) > len(t.words)),
    Rule("exclamations", lambda t: 2 * t.data.count(b"!") > len(t.words)),
)


@dataclass(frozen=True)
class Estimate:
    rule: str
    seconds: float  # per text
    rejected: float  # share of the texts

    @property
    def gain(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def estimate(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    sample_rows: int = 2000,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> list[Estimate]:
    """Cost and rejection of every rule alone, over about ``sample_rows`` texts, measured in the tasks that read them.

    The sample (by hash of the id) sets the order of the rules and nothing else.
    """
    share = sample_rows / max(docs.count(), sample_rows)
    chosen = F.pmod(F.xxhash64(F.col(f"`{id_column}`")), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = docs.where(chosen).select(F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected, n = [0.0] * len(rules), [0] * len(rules), 0
        for batch in slices(batches, "text"):
            for raw in texts(batch.column("text")):
                n += 1
                for k, rule in enumerate(rules):
                    fresh = Text(raw)
                    start = time.perf_counter()
                    rejected[k] += bool(rule.rejects(fresh))
                    seconds[k] += time.perf_counter() - start
        yield pa.RecordBatch.from_pydict(
            {"rule": list(range(len(rules))), "seconds": seconds, "rejected": rejected, "n": [n] * len(rules)}
        )

    sums = sample.mapInArrow(measure, "rule long, seconds double, rejected long, n long").groupBy("rule")
    rows = {r["rule"]: r for r in sums.agg(*(F.sum(c).alias(c) for c in ("seconds", "rejected", "n"))).collect()}
    return [
        Estimate(rule.name, rows[k]["seconds"] / rows[k]["n"], rows[k]["rejected"] / rows[k]["n"])
        if k in rows and rows[k]["n"]
        else Estimate(rule.name, 0.0, 0.0)
        for k, rule in enumerate(rules)
    ]


def ordered(rules: tuple[Rule, ...], estimates: list[Estimate]) -> tuple[Rule, ...]:
    """Rules by rejection per cost, the highest first; ties by name."""
    gain = {e.rule: e.gain for e in estimates}
    return tuple(sorted(rules, key=lambda r: (-gain[r.name], r.name)))


def first_rejection(text: Text, cascade: tuple[Rule, ...]) -> tuple[str | None, int]:
    """The rule that rejects the text, if any, and how many rules ran."""
    for n, rule in enumerate(cascade, 1):
        if rule.rejects(text):
            return rule.name, n
    return None, len(cascade)


def apply_rules(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    sample_rows: int = 2000,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Judge every whole text by the cascade; beside the verdict, the counts of the base rules.

    A null or empty text has no words, so ``few_words`` rejects it. Repeated rows are judged one by one, an empty table gives
    no rows, other columns are not read, and an id may be null.

    Result: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and, depending on the order of
    the rules, rejected_by and rules_run.
    """
    cascade = ordered(rules, estimate(docs, rules, sample_rows, id_column, text_column))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = []
            for raw in texts(batch.column("text")):
                text = Text(raw)
                by, run = first_rejection(text, cascade)
                failed = any(rule.rejects(text) for rule in BASE_RULES)
                found.append(
                    (len(text.words), text.word_chars, text.symbols, text.duplicate_lines, text.repeated_words)
                    + (failed, by is None and not failed, by, run)
                )
            arrays = [pa.array(column, kind) for column, kind in zip(zip(*found, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], ["id", *names])

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by", "rules_run"]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string(), pa.int64()]
    sql = ["long"] * 5 + ["boolean"] * 2 + ["string", "long"]
    return (
        docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))
        .mapInArrow(judge, "id long, " + ", ".join(f"{n} {k}" for n, k in zip(names, sql, strict=True)))
        .withColumnRenamed("id", id_column)
    )
