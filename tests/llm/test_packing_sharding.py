"""Packing by a round trip, sharding by its law."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_frames import *  # noqa: F403  (fixtures)
from llm_frames import frame
from tokenizers import Tokenizer

from crashlens.llm import tokens
from crashlens.llm.packing import Schedule, pack
from crashlens.llm.sharding import shard_by_bytes
from crashlens.llm.tokens import Encoder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return np.array([*Tokenizer.from_file(VOCABULARY).encode(text or "", add_special_tokens=False).ids, 1], "<u4")


@pytest.mark.parametrize(
    "text",
    ["Don't stop123 I'LL 'sfoo 'S it's<|x", "A\x1cb \x85 c", "ªº²³ ¼ µM œuvre ŒUVRE ß", "<|endoftext|> a", "İstanbul ΣΑΣ", "", " ", "été", "''''s's'tt'", "x­b a\xa0b", "😀 ok", "\x00 \x01a"],
)
def test_kept_words_give_the_ids_of_the_tokenizer(text):
    assert Encoder(VOCABULARY).encode([text])[0].tolist() == ids_of(text)[:-1].tolist()


@pytest.mark.parametrize("hashes", [1, 40, None], ids=["one", "few", "all"])
def test_words_of_one_hash_are_told_apart(monkeypatch, prose, hashes):
    """Words whose hashes are equal, an encoder that forgets, and texts met again give the same ids."""
    if hashes:
        real = tokens.chunks
        monkeypatch.setattr(tokens, "chunks", lambda data: (*real(data)[:2], real(data)[2] % np.uint64(hashes)))
    encoder = Encoder(VOCABULARY, kept_bytes=20_000)
    texts = ["", " \n", "Don't stop123, foo-bar foo bar", *(f"{prose(k, 80)}, {prose(k, 9)}'s 12{k}!" for k in range(12)), "Ünï çödé", "\U0001f600 ok", "x" * 5000]
    for part in (texts[:9], texts[9:], texts, texts[::-1]):
        assert [ids.tolist() for ids in encoder.encode(part)] == [ids_of(text)[:-1].tolist() for text in part]


def test_words_are_kept_without_the_marks_around_them():
    """A word beside other marks, or with a contraction, is no other word to encode and keep."""
    encoder = Encoder(VOCABULARY)
    new = []
    encoder.model = type("Model", (), {"tokenize": lambda _, word, own=encoder.model.tokenize: new.append(word) or own(word)})()
    texts = ["Quux, quux. (quux) quux's", "'quux' QUUX-quux've été. 77", "quux étés"]
    assert [ids.tolist() for text in texts for ids in encoder.encode([text])] == [ids_of(text)[:-1].tolist() for text in texts]
    mapped = ["Ã©tÃ©", "Ã©tÃ©s"]  # é in the vocabulary's alphabet of bytes
    assert sorted(new) == sorted(["quux", ",", ".", "(", ")", "'s", "'", "-", "'ve", "7", *mapped])
    encoder.encode(texts)
    assert len(new) == 12


def test_words_met_again_outlast_those_met_once(prose):
    """When the arrays are full, a word of an earlier text that came again stays."""
    encoder = Encoder(VOCABULARY)
    for text in ("quux corge", "quux grault garply waldo"):
        encoder.encode([text])
    encoder.words.shrink(0)
    data = np.frombuffer(b"quux corge grault" + tokens.PAD, np.uint8)
    assert (encoder.words.find(data, *tokens.chunks(data)) > 0).tolist() == [True, False, False]


def test_texts_are_parted_as_the_tokenizer_parts_them():
    """Contractions, digits, marks and letters of one and two bytes in any order, words with equal first 8 and 32 bytes."""
    parts = [*"'a1 -é²×ŒªsS\n", "'re", "'ll", "'ve", "'d", "½", "12345678", "ab" * 16, "ab" * 17, "ab" * 20, "abababab", "ababababc", "ab" * 16 + "é"]
    chosen = np.random.default_rng(3).integers(0, len(parts), (400, 12))
    texts = ["".join(parts[k] for k in row) for row in chosen]
    tokenizer = Tokenizer.from_file(VOCABULARY)
    expected = [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    encoder = Encoder(VOCABULARY, kept_bytes=20_000)
    got = [ids.tolist() for at in range(0, 400, 50) for ids in encoder.encode(texts[at : at + 50])]
    assert all(map(tokens.plain, texts)) and got == expected


def test_a_vocabulary_that_keeps_capitals_is_taken_as_it_is(spark, tmp_path):
    """Only the file's own folding and parting are done fast; any other goes to the tokenizer whole."""
    import json

    with open(VOCABULARY) as file:
        cased = json.load(file)
    cased["normalizer"] = None
    path = str(tmp_path / "cased.json")
    with open(path, "w") as file:
        json.dump(cased, file)
    text = "Don't SHOUT at Ünïcödé 123 don't"
    expected = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert Encoder(path).encode([text])[0].tolist() == expected != ids_of(text)[:-1].tolist()
    piece = pack(frame(spark, [(1, text, "a")]), path).collect()
    assert [(p["length"], p["ids_crc32"]) for p in piece] == [(len(expected) + 1, zlib.crc32(np.array([*expected, 1], "<u4").tobytes()))]


def check_pieces(pieces, docs, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    expected = defaultdict(list)
    for i, text, _ in docs:
        ids = ids_of(text)
        expected[i, len(ids)].append(ids)
    assert set(by_doc) == set(expected)
    for key, copies in expected.items():
        got = sorted((p["start"], p["length"], p["ids_crc32"]) for p in by_doc[key])
        assert sum(n for _, n, _ in got) == sum(map(len, copies))
        assert all(any(zlib.crc32(ids[s : s + n].tobytes()) == c for ids in copies) for s, n, c in got)
        if len(copies) == 1:
            assert [s for s, _, _ in got] == np.cumsum([0, *(n for _, n, _ in got[:-1])]).tolist()
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == np.cumsum([0, *(p["length"] for p in own[:-1])]).tolist()
        assert sum(p["length"] for p in own) <= window
    return by_sequence


@pytest.mark.parametrize(("window", "grain"), [(2048, 64), (128, 16), (64, 1)])
def test_packing_is_a_round_trip(spark, edge_docs, edge_rows, window, grain):
    pieces = pack(edge_docs, VOCABULARY, window, grain).collect()
    sequences = check_pieces(pieces, edge_rows, window)
    full = sum(sum(p["length"] for p in own) == window for own in sequences.values())
    assert sorted(sequences) == list(range(len(sequences))) and full >= len(sequences) - 5


def test_windows_hold_the_target_proportions(spark, prose):
    docs = [(k, prose(k, 150), "hot" if k % 3 else f"s{k % 4}") for k in range(300)]
    weights = {"hot": 2, "s0": 1, "s1": 1, "s2": 1, "s3": 1}
    sequences = check_pieces(pack(frame(spark, docs), VOCABULARY, 512, 32, weights).collect(), docs, 512)
    for n in range(len(sequences) // 4):  # while no queue has run dry
        share = sum(p["length"] for p in sequences[n] if p["source"] == "hot")
        assert abs(share - 512 * 2 / 6) <= 32
    with pytest.raises(ValueError, match="no weight"):
        pack(frame(spark, docs), VOCABULARY, weights={"hot": 1})


@pytest.mark.parametrize("lengths", [[1000, 300, 77, 1], [5], [64, 64, 64], [10_000, 1, 1]])
def test_places_are_those_of_a_deficit_round_robin(lengths):
    s = Schedule(lengths, [-(-n // 8) for n in lengths], 64, 8)
    due = sorted(((2 * j + 1) / w, k, j) for k, w in enumerate(s.weights) for j in range(s.counts[k]))
    expected = {(k, j): place for place, (_, k, j) in enumerate(due)}
    for k, count in enumerate(s.counts):
        assert s.places(k, np.arange(count)).tolist() == [expected[k, j] for j in range(count)]
        assert all(abs(s.deficit(k, w)) < len(lengths) for w in range(len(due) // s.slots))
    ends = np.arange(len(due) + 20)
    assert s.before(ends).tolist() == [[sum(k == q for _, q, _ in due[:p]) for k in range(len(lengths))] for p in ends]


@pytest.mark.parametrize("scale", [1, 1 << 20, 1 << 36])
def test_windows_are_filled_at_any_size(scale):
    """Around some places of long queues, every window holds each place once and its tokens side by side."""
    lengths = [1000 * scale + 5, 300 * scale, 77 * scale + 1, 9]
    s = Schedule(lengths, [3, 2, 1, 1], 64, 8)
    total = int(s.counts.sum())
    for window in {0, 1, total // 16, total // 8 - 2, total // 11}:
        first, end = s.before(np.array([window, window + 1]) * s.slots)
        assert first.sum() == min(window * s.slots, total) and end.sum() == min((window + 1) * s.slots, total)
        queues = np.repeat(np.arange(4), end - first)
        slots = np.concatenate([np.arange(a, b) for a, b in zip(first, end, strict=True)])
        assert sorted(np.concatenate([s.places(k, slots[queues == k]) for k in range(4)]).tolist()) == list(range(first.sum(), end.sum()))
        windows, offsets = s.position(queues, slots)
        sizes = np.minimum(8, s.lengths[queues] - slots * 8)
        assert set(windows.tolist()) <= {window} and offsets.tolist() == (np.cumsum(sizes) - sizes).tolist()


def test_a_document_is_one_piece_in_a_window(spark, prose):
    docs = [(k, prose(k, 400), f"s{k % 3}") for k in range(60)]
    pieces = pack(frame(spark, docs), VOCABULARY, 512, 32).collect()
    assert len({(p["doc_id"], p["sequence_id"]) for p in pieces}) == len(pieces)
    assert {(p["doc_id"], p["source"]) for p in pieces} == {(k, s) for k, _, s in docs}
    share = 512 / 3
    assert sum(p["length"] for p in pieces) / len(pieces) > 0.8 * share


def test_many_sources_are_hashed_to_queues(spark, prose):
    docs = [(k, prose(k, 20), f"s{k}") for k in range(40)]
    pieces = pack(frame(spark, docs), VOCABULARY, 128, 16, max_queues=4).collect()
    check_pieces(pieces, docs, 128)
    assert len({p["queue"] for p in pieces}) <= 4
    assert {(p["doc_id"], p["source"]) for p in pieces} == {(k, s) for k, _, s in docs}


def check_shards(rows, docs, shards):
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted(
        (i is None, i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in docs
    )
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("range_rows", [2_000_000, 7])
def test_shards_of_edge_cases(edge_docs, edge_rows, range_rows):
    rows = [(r["doc_id"] or 0, r) for r in shard_by_bytes(edge_docs, 4, range_rows=range_rows).collect()]
    known = [x for x in edge_rows if x[0] is not None]
    assert len(rows) == len(edge_rows)
    slots = defaultdict(list)
    for _, r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    got = sorted((r["doc_id"], r["size"], r["text_crc32"]) for _, r in rows if r["doc_id"] is not None)
    assert got == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in known)


@pytest.mark.parametrize("range_rows", [2_000_000, 50])
def test_shards_have_near_equal_bytes_with_a_hot_text(spark, prose, range_rows):
    docs = [(k, prose(k if k % 3 else 0, 30), "a") for k in range(1500)]
    rows = shard_by_bytes(frame(spark, docs), 8, range_rows=range_rows).collect()
    check_shards(rows, docs, 8)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 8
    assert max(abs(n - mean) for n in sizes.values()) < 0.01 * mean + 500


def test_no_rows(no_docs):
    assert pack(no_docs, VOCABULARY).count() == 0
    assert shard_by_bytes(no_docs).count() == 0
