"""Quality rules, chats and decontamination on small tables."""

import pytest
from llm_frames import *  # noqa: F403  (fixtures)
from llm_frames import frame
from pyspark.sql import functions as F

from crashlens.llm.chat import collapse, format_chats
from crashlens.llm.decontamination import clean, contaminated
from crashlens.llm.quality_rules import RULES, Estimate, Rule, Text, apply_rules, estimate, first_rejection, ordered


def test_counts_of_a_text():
    text = Text("a b c x\na b c\n\n \na b c x\n#é$ \x0b\x85 z")
    assert (len(text.words), text.word_chars, text.symbols, text.duplicate_lines) == (14, 16, 2, 1)
    assert text.repeated_words == 11
    assert Text("a a a a").repeated_words == 4 and Text("a b c d").repeated_words == 0 and Text("").repeated_words == 0


def test_rules_run_by_rejection_per_cost():
    rules = (Rule("a", lambda t: False), Rule("b", lambda t: True), Rule("c", lambda t: True))
    cascade = ordered(rules, [Estimate("a", 1.0, 0.1), Estimate("b", 2.0, 0.9), Estimate("c", 0.1, 0.5)])
    assert [r.name for r in cascade] == ["c", "b", "a"]
    assert first_rejection(Text("x"), cascade) == ("c", 1)
    assert first_rejection(Text("x"), (rules[0],)) == (None, 1)


def test_estimates_and_order_do_not_change_the_verdict(edge_docs, edge_rows, no_docs):
    costs = estimate(edge_docs)
    assert [e.rule for e in costs] == [r.name for r in RULES] and max(e.rejected for e in costs) > 0
    got = apply_rules(edge_docs).collect()
    assert len(got) == len(edge_rows)
    by_text = {}
    for i, text, _ in edge_rows:
        doc = Text(text or "")
        by_text.setdefault(i, set()).add(not any(r.rejects(doc) for r in RULES))
    assert all(r["kept"] in by_text[r["doc_id"]] for r in got)
    assert all((r["rejected_by"] is None) == r["kept"] for r in got)
    backwards = apply_rules(edge_docs, RULES[::-1], sample_rows=1)
    plain = ["doc_id", "n_words", "kept", "base_failed"]
    assert backwards.select(plain).exceptAll(apply_rules(edge_docs).select(plain)).isEmpty()
    assert apply_rules(no_docs).count() == 0


CHATS = "conv_id long, turn long, role string, text string, k string, n int"


def chats(spark, turns):
    return spark.createDataFrame([(*t, "x", 1) for t in turns], CHATS).repartition(3)


def test_snapshots_collapse(spark):
    long = [("user", "hi"), ("assistant", "hello"), ("user", "bye")]
    turns = [(c, k, *long[k]) for c, n in ((5, 1), (4, 2), (3, 3), (9, 3), (7, 2)) for k in range(n)]
    turns += [(1, 0, "user", "hi"), (1, 1, "assistant", "other"), (2, 0, "user", "hi "), (6, 1, "assistant", "hello"), (6, 2, "user", "bye")]
    got = {r["conv_id"]: (r["n_turns"], r["copies"]) for r in collapse(chats(spark, turns)).collect()}
    assert got == {3: (3, 2), 1: (2, 1), 2: (1, 1), 6: (2, 1)}
    texts = {r["conv_id"]: r["text"] for r in format_chats(chats(spark, turns)).collect()}
    assert texts[1] == "<|user|>\nhi<|end|>\n<|assistant|>\nother<|end|>\n"


def test_chat_edge_cases(spark):
    turns = [(None, 1, "user", "a"), (None, None, None, None), (1, 1, "user", "a"), (1, 1, "user", "a"), (2, 1, "user", "x" * 200_000), (3, None, "", "")]
    got = {r["conv_id"]: r["text"] for r in format_chats(chats(spark, turns)).collect()}
    assert got[None] == "<|user|>\na<|end|>\n<|>\n<|end|>\n".replace("<|>", "<||>")
    assert got[1] == 2 * "<|user|>\na<|end|>\n" and len(got[2]) > 200_000 and got[3] == "<||>\n<|end|>\n"
    assert format_chats(chats(spark, turns).where("conv_id = 99")).count() == 0


def test_many_equal_conversations(spark):
    turns = [(c, k, "user", f"t{k}") for c in range(300) for k in range(3 if c % 2 else 2)]
    assert [tuple(r) for r in collapse(chats(spark, turns)).collect()] == [(1, 3, 150)]


QUESTION = (
    "A farmer called Maria has 12 apples and gives 5 apples to her friend Peter, who walks 3 km home. "
    "How many apples does Maria have left after Peter has walked the whole way back?"
)


@pytest.fixture(scope="module")
def benchmark(spark, prose):
    rows = [(1, QUESTION), (2, prose(77, 40)), (3, "too short"), (4, None), (None, prose(78, 40)), (5, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16")]
    return spark.createDataFrame([(*r, 1) for r in rows], "item_id long, text string, window int")


def pairs(df):
    return {(r["doc_id"], r["item_id"]): r for r in df.collect()}


def test_templates_and_slots(spark, prose, benchmark):
    changed = QUESTION.replace("Maria", "Helga").replace("12", "90").replace(" 5 ", " 7 ").replace("3 km", "8 miles")
    mixed = QUESTION.replace("does Maria", "does Helga")  # Maria is exchanged in one place only
    docs = [
        (1, prose(1, 50) + " " + QUESTION + " " + prose(2, 50), "a"),
        (2, prose(3, 50) + ". " + changed, "a"),
        (3, prose(4, 50), "a"),
        (4, prose(5, 20) + " " + mixed.split("How")[1], "a"),
        (5, prose(77, 40).upper(), "b"),
        (6, " ".join(prose(77, 40).split()[10:26]), "b"),
        (7, " ".join(prose(77, 40).split()[10:20]), "b"),
        (8, "20 21 22 23 24 25 26 27 28 29 30 31 32 33 34 35", "b"),
        (1, prose(9, 5), "c"),
    ]
    got = pairs(contaminated(frame(spark, docs), benchmark))
    assert set(got) == {(1, 1), (2, 1), (4, 1), (5, 2), (6, 2)}
    assert got[1, 1]["verbatim"] and not got[2, 1]["verbatim"] and got[2, 1]["changed_slots"] >= 4
    kept = clean(frame(spark, docs), benchmark)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 7, 8]


RINGS = "Tom sings and Tom dances while Tom reads so Tom waits until Tom leaves because Tom sleeps when Tom returns after Tom eats"
CAPITAL = "What is the capital city of the oldest republic known"


@pytest.fixture(scope="module")
def reused(spark, prose):
    """Items and re-uses of them: (documents, items, the pairs that hold)."""
    items = [(1, "Well " + RINGS, 1), (2, CAPITAL, 1), (3, QUESTION, 1), (4, "Red dogs and 3 apples with 5 pears were put into one old box and then sold", 1)]
    one_changed = QUESTION.replace("Maria has 12", "Helga has 12")  # the other Maria stays
    ways = iter(["Bob", "Sam"] * 9)
    torn = "Well " + " ".join(next(ways) if word == "Tom" else word for word in RINGS.split())
    docs = [
        (1, "So " + one_changed, "a"),
        (2, "Here: " + torn, "a"),
        (3, "Here: well " + RINGS.replace("Tom", "Bob"), "a"),
        (4, "Question: " + CAPITAL, "a"),
        (5, "Question: Which " + CAPITAL[5:], "a"),
        (6, prose(4, 9) + " Red dogs and 4 apples with 4 pears were put into one old box and then sold", "a"),
        (7, "So " + QUESTION.replace("12 apples", "9 apples").replace("5 apples", "8 apples") + " " + prose(5, 30) + " " + QUESTION.split("?")[0], "a"),
    ]
    return docs, items, {(1, 3), (3, 1), (4, 2), (6, 4), (7, 3)}


def test_only_windows_with_a_conflict_are_dropped(spark, reused):
    docs, items, expected = reused
    got = pairs(contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string, kept int")))
    assert set(got) == expected
    assert got[4, 2]["verbatim"] and got[7, 3]["verbatim"] is False and not got[6, 4]["verbatim"]
    assert got[1, 3]["n_windows"] >= 20


def test_sql_judges_the_same_windows(spark, reused):
    import duckdb
    import pyarrow as pa

    from crashlens.llm.queries import ORACLES

    docs, items, expected = reused
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [d[0] for d in docs], "text": [d[1] for d in docs]}))
    con.register("benchmark", pa.table({"item_id": [i[0] for i in items], "text": [i[1] for i in items]}))
    result = con.execute(ORACLES["op6_decontamination"])
    names = [c[0] for c in result.description]
    mine = contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string, kept int")).select(names)
    assert sorted(result.fetchall(), key=repr) == rows(mine)


def test_decontamination_edge_cases(spark, prose, benchmark, edge_docs, edge_rows, no_docs):
    assert contaminated(edge_docs, benchmark).count() == 0
    assert clean(edge_docs, benchmark).count() == len(edge_rows) and clean(edge_docs, benchmark).columns == edge_docs.columns
    assert contaminated(no_docs, benchmark).count() == 0 and clean(no_docs, benchmark).count() == 0
    assert contaminated(edge_docs, benchmark.where(F.lit(False))).count() == 0
    nameless = frame(spark, [(None, "So " + QUESTION, "a"), (None, prose(8, 30), "a"), (2, "So " + QUESTION + " " + prose(7, 40_000), "a")])
    assert set(pairs(contaminated(nameless, benchmark))) == {(None, 1), (2, 1)}


def test_decontamination_is_native(spark, benchmark, edge_docs):
    plan = contaminated(edge_docs, benchmark)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
