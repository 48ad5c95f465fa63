"""Token ids of whole texts, with the ids of words kept from text to text.

The tokenizer parts a text into pretokens first (words, single digits, marks), so the ids of a text are those of its pretokens one
after another. Invented and inflected words come back often enough that keeping them saves most of the work.
They are kept in a few flat arrays, about 50 bytes a word, and looked up for many texts at once. Texts with
characters beyond the plain ones below go to the tokenizer whole, and so do all texts under a vocabulary that parts them in another way.
"""

from __future__ import annotations

import json
import re
from hashlib import blake2b
from functools import cache

import numpy as np
import regex

from crashlens.llm.shingles import mixed

#: How the vocabulary's file parts lower-case text, and the characters for which this module does the same.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
NOT_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xffŒœ]")
CONTROLS = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
WORD_END = "</w>"

#: Bytes of the arrays of words kept in a worker. Beyond that, words not met since the last time go; all if these are few.
KEPT_BYTES = 28 << 20

#: White space after the texts, so that eight bytes can be read from any place in them.
PAD = b"\n" * 8

#: Kinds of characters, and of the bytes of texts with ASCII alone. Plain characters have at most two bytes.
SPACE, LETTER, NUMBER, MARK = range(4)
_KINDS = np.array(
    [SPACE if c.isspace() else LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else MARK for c in map(chr, range(0x180))],
    np.uint8,
)
_BYTE_KINDS = np.where(np.arange(256) < 0x80, _KINDS[:256], LETTER).astype(np.uint8)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of the ranges, one range after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def eights(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first eight bytes of each word as a number, zero beyond its end."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))[starts] & _MASKS.take(lengths, mode="clip")


def chunks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and hash of each pretoken of plain, lower-case texts with the white space ``PAD`` after them."""
    kinds = _BYTE_KINDS.take(data)
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        kinds[lead] = kinds[lead + 1] = _KINDS[(data[lead] & 0x1F).astype(np.int64) << 6 | data[lead + 1] & 0x3F]
    begins = kinds == NUMBER
    begins[0] = True
    begins[1:] |= kinds[1:] != kinds[:-1]
    begins[lead + 1] = False
    quote = np.flatnonzero(data == ord("'"))
    quote = quote[begins[quote]]
    if len(quote):  # 's, 't, 'm and 'd, 're, 've and 'll are pretokens, whatever letters follow
        one, two = data[quote + 1], data[quote + 2]
        short = np.isin(one, [*b"stmd"])
        long = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        begins[quote[short | long] + 1] = False
        after = np.r_[quote[short] + 2, quote[long] + 3]
        begins[after[kinds[after] == LETTER]] = True
    starts = np.flatnonzero(begins)
    lengths = np.diff(starts, append=len(data))
    own = np.flatnonzero(kinds[starts] != SPACE)
    starts, lengths = starts[own], lengths[own]
    hashes = mixed(eights(data, starts, lengths))
    for at in (8, 16, 24):
        more = np.flatnonzero(lengths > at)
        hashes[more] = mixed(hashes[more] + eights(data, starts[more] + at, lengths[more] - at))
    for k in np.flatnonzero(lengths > 32).tolist():
        hashes[k] = int.from_bytes(blake2b(data[starts[k] : starts[k] + lengths[k]], digest_size=8).digest())
    return starts, lengths, hashes


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or a copy with room for ``size`` entries and a quarter more."""
    if size <= len(array):
        return array
    out = np.zeros(size + size // 4, array.dtype)
    out[: len(array)] = array
    return out


class Words:
    """Words and their ids. A word's number is in the first of the places from its hash on that holds it, and is taken only if its bytes are the same."""

    def __init__(self, kind: str):
        self.kind = kind
        self._clear()

    def _clear(self) -> None:
        self.places = np.zeros(1 << 10, np.int32)
        self.count = 1  # number 0, of no bytes, is no word's
        self.hashes, self.heads = np.zeros(1, np.uint64), np.zeros(1, np.uint64)
        self.lengths, self.met = np.zeros(1, np.int32), np.zeros(1, bool)
        #: Bytes after a word's eighth, and its ids; each word's end where the next one's start.
        self.tails, self.tail_at = np.zeros(0, np.uint8), np.zeros(2, np.int32)
        self.ids, self.ids_at = np.zeros(0, self.kind), np.zeros(2, np.int32)

    def size(self) -> int:
        return sum(a.nbytes for a in (self.places, self.hashes, self.heads, self.lengths, self.met, self.tails, self.tail_at, self.ids, self.ids_at))

    def find(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, or 0."""
        last = len(self.places) - 1
        heads = eights(data, starts, lengths)
        place = (hashes & np.uint64(last)).view(np.int64)
        numbers = self.places[place]
        other = np.flatnonzero(~self._same(numbers, data, starts, lengths, heads))
        left = other[numbers[other] > 0]  # they met another word in their place
        numbers[other] = 0
        place = place[left]
        while len(left):
            place = (place + 1) & last
            number = self.places[place]
            same = self._same(number, data, starts[left], lengths[left], heads[left])
            numbers[left[same]] = number[same]
            more = ~same & (number > 0)
            left, place = left[more], place[more]
        return numbers

    def _same(self, numbers: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, heads: np.ndarray) -> np.ndarray:
        same = (self.heads[numbers] == heads) & (self.lengths[numbers] == lengths)
        long = np.flatnonzero(same & (lengths > 8))
        if len(long):
            n = lengths[long] - 8
            unlike = data[ranges(starts[long] + 8, n)] != self.tails[ranges(self.tail_at[numbers[long]], n)]
            if unlike.any():
                same[long[np.logical_or.reduceat(unlike, np.cumsum(n) - n)]] = False
        return same

    def _place(self, numbers: np.ndarray) -> None:
        """Put each number into the first free place from its hash on."""
        last = len(self.places) - 1
        place = (self.hashes[numbers] & np.uint64(last)).view(np.int64)
        while len(numbers):
            free = self.places[place] == 0
            self.places[place[free]] = numbers[free]  # where several want a place, one has it
            left = self.places[place] != numbers
            numbers, place = numbers[left], (place[left] + 1) & last

    def add(self, hashes: np.ndarray, heads: np.ndarray, lengths: np.ndarray, tails: np.ndarray, ids: np.ndarray, ids_n: np.ndarray) -> None:
        """Add new and distinct words; tails and ids of one stand after those of the other."""
        old, count = self.count, self.count + len(hashes)
        ends = self.tail_at[old] + np.cumsum(np.maximum(lengths - 8, 0)), self.ids_at[old] + np.cumsum(ids_n)
        for name, first, values in (
            ("hashes", old, hashes),
            ("heads", old, heads),
            ("lengths", old, lengths),
            ("met", old, np.zeros(len(hashes), bool)),
            ("tails", int(self.tail_at[old]), tails),
            ("tail_at", old + 1, ends[0]),
            ("ids", int(self.ids_at[old]), ids),
            ("ids_at", old + 1, ends[1]),
        ):
            array = grown(getattr(self, name), first + len(values))
            array[first : first + len(values)] = values
            setattr(self, name, array)
        self.count = count
        if 2 * count > len(self.places):
            self.places = np.zeros(1 << (2 * count).bit_length(), np.int32)
            old = 1
        self._place(np.arange(old, count, dtype=np.int32))

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after another, and how many each has."""
        first = self.ids_at[numbers]
        n = self.ids_at[1:][numbers] - first
        return self.ids[ranges(first, n)], n

    def shrink(self, limit: int) -> None:
        if self.size() <= limit:
            return
        own = np.flatnonzero(self.met[1 : self.count]) + 1
        if len(own) > self.count // 2:
            own = own[:0]
        ids, ids_n = self.ids_of(own)
        hashes, heads, lengths = self.hashes[own], self.heads[own], self.lengths[own]
        tails = self.tails[ranges(self.tail_at[own], np.maximum(lengths - 8, 0))]
        self._clear()
        self.add(hashes, heads, lengths, tails, ids, ids_n)


class Encoder:
    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.kept_bytes = kept_bytes
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.known = known(self.tokenizer)
        self.model = self.tokenizer.model
        self.bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.words = Words(self.kind)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as numbers of 16 bits, or 32 for vocabularies of more."""
        self.words.shrink(self.kept_bytes)
        fast = [i for i, text in enumerate(texts) if self.known and plain(text)]
        out: dict[int, np.ndarray] = {}
        if fast:
            parts = [texts[i].lower().encode() for i in fast]
            data = np.frombuffer(b"\n".join(parts) + PAD, np.uint8)
            starts, lengths, hashes = chunks(data)
            numbers = self.words.find(data, starts, lengths, hashes)
            new = np.flatnonzero(numbers == 0)
            self.words.met[numbers] = True
            if len(new):
                self._learn(data, starts[new], lengths[new], hashes[new])
                numbers[new] = self.words.find(data, starts[new], lengths[new], hashes[new])
            ids, n = self.words.ids_of(numbers)
            begins = np.cumsum([0, *(len(part) + 1 for part in parts)])
            cuts = np.r_[0, np.cumsum(n)][np.searchsorted(starts, begins)]
            for k, i in enumerate(fast):
                out[i] = ids[cuts[k] : cuts[k + 1]]
        return [out[i] if i in out else self._whole(text) for i, text in enumerate(texts)]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _learn(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> None:
        """Add pretokens that are not known yet; a pretoken may be there more than once."""
        first = np.sort(np.unique(hashes, return_index=True)[1])
        self._add(data, starts[first], lengths[first], hashes[first])
        left = np.flatnonzero(self.words.find(data, starts, lengths, hashes) == 0)
        if len(left):  # other words of the same hash
            spans = zip(left.tolist(), starts[left].tolist(), lengths[left].tolist(), strict=True)
            left = np.array(list({data[s : s + n].tobytes(): row for row, s, n in spans}.values()))
            self._add(data, starts[left], lengths[left], hashes[left])

    def _add(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> None:
        """Encode distinct pretokens and add them. The model takes each as it is, one by one, without the tokenizer's passes over a text."""
        joined = np.full(int(lengths.sum()) + len(lengths), ord(" "), np.uint8)
        joined[ranges(np.cumsum(lengths + 1) - lengths - 1, lengths)] = data[ranges(starts, lengths)]
        words = joined[:-1].tobytes().decode().split(" ")
        if joined.max() >= 0x80:
            words = [word if word.isascii() else self.bytes.pre_tokenize_str(word)[0][0] for word in words]
        ids, ids_n = [], []
        for word in words:
            own = self.model.tokenize(word)
            ids += [token.id for token in own]
            ids_n.append(len(own))
        long = lengths > 8
        tails = data[ranges(starts[long] + 8, lengths[long] - 8)]
        self.words.add(hashes, eights(data, starts, lengths), lengths, tails, np.array(ids, self.kind), np.array(ids_n))


def known(tokenizer) -> bool:
    """Whether a vocabulary's file parts and folds texts the way this module does."""
    state = lambda part: part and json.loads(part.__getstate__())
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    return state(tokenizer.normalizer) == NORMALIZER and state(tokenizer.pre_tokenizer) == PRE_TOKENIZER and suffix == WORD_END


def plain(text: str) -> bool:
    return "<|" not in text and (text.isascii() and not CONTROLS.search(text) or not NOT_PLAIN.search(text))


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path)
