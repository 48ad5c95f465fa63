"""A bidirectional gated recurrent network with attention pooling over windows of words, in numpy, with its training.

A word comes in as a word (a vector of its own, if it is in the vocabulary) and as characters (the mean of the vectors of its
hashed three-byte pieces). Two gated layers read the window from both ends; attention weighs their states, and the weighted
state gives the window's logit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from crashlens.llm.shingles import mixed, word_spans

LENGTH, STEP, FIT_STEP = 32, 8, 16  # words in a window, and from one window to the next: in scoring, in training
WORD, CHAR, HIDDEN, ATTEND = 8, 8, 8, 8
PIECE_BITS = 13
BLOCK = 4096  # windows worked on at a time


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the three-byte pieces of each word, with a mark at both ends, one word after another, and how many each has."""
    size = ends - starts
    total = size + 2
    first = np.cumsum(total) - total
    marked = np.zeros(int(total.sum()), np.uint32)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    byte = data[np.repeat(starts, size) + inner].astype(np.uint32)
    byte += np.where((byte >= 65) & (byte <= 90), np.uint32(32), np.uint32(0))
    marked[np.repeat(first + 1, size) + inner] = byte + 1
    here = np.repeat(first, size) + inner
    h = marked[here] | marked[here + 1] << np.uint32(9) | marked[here + 2] << np.uint32(18)
    return ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - PIECE_BITS)).astype(np.int64), size


@dataclass
class Network:
    vocabulary: np.ndarray  # hashes of words, ascending; a word's vector is one row further
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, vocabulary: np.ndarray, seed: int = 3) -> Network:
        draw = np.random.RandomState(seed)
        normal = lambda *shape, scale=0.3: (draw.standard_normal(shape) * scale).astype(np.float32)
        p = {
            "word": normal(len(vocabulary) + 2, WORD, scale=0.1),
            "piece": normal(1 << PIECE_BITS, CHAR, scale=0.1),
            "attend": normal(2 * HIDDEN, ATTEND),
            "attend_out": normal(ATTEND),
            "out": normal(2 * HIDDEN),
            "bias": np.zeros(1, np.float32),
        }
        for side in ("forth", "back"):
            p |= {f"{side}_x": normal(WORD + CHAR, 3 * HIDDEN), f"{side}_h": normal(HIDDEN, 3 * HIDDEN), f"{side}_b": np.zeros(3 * HIDDEN, np.float32)}
        p["word"][0] = 0
        return cls(vocabulary, p)

    def words_of(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each word in the table of word vectors; row 1 for words that aren't in the vocabulary, row 0 for none."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), max(len(self.vocabulary) - 1, 0))
        known = self.vocabulary[at] == hashes if len(self.vocabulary) else np.zeros(len(hashes), bool)
        return np.where(known, at + 2, 1)

    def inputs(self, words: np.ndarray, piece: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Input vector of each word, and a last row of zeros for the padding of short windows."""
        x = np.zeros((len(words) + 1, WORD + CHAR), np.float32)
        x[:-1, :WORD] = self.p["word"][words]
        if len(piece):
            sums = np.add.reduceat(self.p["piece"][piece], np.cumsum(size) - size, axis=0)
            x[:-1, WORD:] = sums / size[:, None]
        return x

    def logits(self, x: np.ndarray, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logit of each window, given as rows of ``x``; its last row is padding. ``keep`` gets what the gradient needs."""
        p, n, pad = self.p, len(windows), windows == len(x) - 1
        states = np.zeros((windows.shape[1], n, 2 * HIDDEN), np.float32)
        gates, padded = {}, pad.any()
        for side, at, order in (("forth", 0, range(windows.shape[1])), ("back", HIDDEN, range(windows.shape[1] - 1, -1, -1))):
            told = x @ p[f"{side}_x"] + p[f"{side}_b"]
            told[:, : 2 * HIDDEN] *= 0.5
            u = p[f"{side}_h"].copy()
            u[:, : 2 * HIDDEN] *= 0.5  # sigmoid(a) is (1 + tanh(a / 2)) / 2
            h = np.zeros((n, HIDDEN), np.float32)
            for t in order:
                word = told[windows[:, t]]
                own = h @ u
                gate = np.tanh(word[:, : 2 * HIDDEN] + own[:, : 2 * HIDDEN])
                gate += 1
                gate *= 0.5
                z, r = gate[:, :HIDDEN], gate[:, HIDDEN:]
                c = np.tanh(word[:, 2 * HIDDEN :] + r * own[:, 2 * HIDDEN :])
                if keep is not None:
                    gates[side, t] = (h, z, r, c, own[:, 2 * HIDDEN :])
                new = c + z * (h - c)
                h = np.where(pad[:, t, None], h, new) if padded else new
                states[t, :, at : at + HIDDEN] = h
        inner = np.tanh(states @ p["attend"])
        weight = inner @ p["attend_out"]
        weight[pad.T] = -1e9
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (states * weight[:, :, None]).sum(axis=0)
        if keep is not None:
            keep.extend((states, gates, inner, weight, pooled, pad))
        return pooled @ p["out"] + p["bias"]

    def gradient(self, x: np.ndarray, windows: np.ndarray, d_logit: np.ndarray, kept: list) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters behind ``x``, and of ``x``."""
        p, g = self.p, {}
        states, gates, inner, weight, pooled, pad = kept
        g["out"], g["bias"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["out"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = (states * d_pooled).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["attend_out"] = np.tensordot(inner, d_score, ((0, 1), (0, 1)))
        d_inner = d_score[:, :, None] * p["attend_out"] * (1 - inner * inner)
        g["attend"] = np.tensordot(states, d_inner, ((0, 1), (0, 1)))
        d_states += d_inner @ p["attend"].T
        d_x = np.zeros_like(x)
        for side, at, order in (("forth", 0, range(windows.shape[1] - 1, -1, -1)), ("back", HIDDEN, range(windows.shape[1]))):
            u = p[f"{side}_h"]
            d_h = np.zeros((len(windows), HIDDEN), np.float32)
            d_u, d_told = np.zeros_like(u), np.zeros((len(x), 3 * HIDDEN), np.float32)
            for t in order:
                d_h = d_h + d_states[t, :, at : at + HIDDEN]
                h, z, r, c, own = gates[side, t]
                d_here = np.where(pad[:, t, None], 0, d_h)
                d_c = d_here * (1 - z) * (1 - c * c)
                d_z = d_here * (h - c) * z * (1 - z)
                d_r = d_c * own * r * (1 - r)
                d_own = np.concatenate([d_z, d_r, d_c * r], axis=1)
                d_u += h.T @ d_own
                np.add.at(d_told, windows[:, t], np.concatenate([d_z, d_r, d_c], axis=1))
                d_h = np.where(pad[:, t, None], d_h, d_here * z + d_own @ u.T)
            g[f"{side}_h"], g[f"{side}_b"], g[f"{side}_x"] = d_u, d_told[:-1].sum(axis=0), x.T @ d_told
            d_x += d_told @ p[f"{side}_x"].T
        return g, d_x

    def window_rows(self, counts: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
        """First word and text of the overlapping windows over texts of so many words, one for every ``step`` words; the last one ends with the
        text. A passage of up to ``LENGTH - step + 1`` words lies whole in one of them wherever it stands."""
        n = np.where(counts > 0, np.maximum(-(-(counts - LENGTH) // step), 0) + 1, 0)
        text = np.repeat(np.arange(len(counts)), n)
        k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        first = np.minimum(k * step, np.maximum(counts[text] - LENGTH, 0))
        return first + (np.cumsum(counts) - counts)[text], text

    def read(self, data: np.ndarray, offsets: np.ndarray, step: int = STEP) -> tuple[np.ndarray, tuple, np.ndarray, np.ndarray]:
        """Texts as: kind of each word in a table of different words, that table (words, pieces, sizes), windows, their texts."""
        hashes, starts, ends, at = word_spans(data, offsets)
        kinds, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
        piece, size = pieces(data, starts[first], ends[first])
        counts = np.diff(at)
        begin, text = self.window_rows(counts, step)
        rows = begin[:, None] + np.arange(LENGTH)
        beyond = rows >= at[1:][text][:, None]
        padded = np.r_[kind, len(kinds)]
        windows = padded[np.where(beyond, len(kind), rows)]
        return kind, (kinds, piece, size), windows, text

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Largest logit over the windows of each text, one for every ``STEP`` words; -inf for texts without words."""
        best = np.full(len(offsets) - 1, -np.inf)
        _, (kinds, piece, size), windows, text = self.read(data, offsets)
        if not len(windows):
            return best
        x = self.inputs(self.words_of(kinds), piece, size)
        found = np.concatenate([self.logits(x, windows[k : k + BLOCK]) for k in range(0, len(windows), BLOCK)])
        np.maximum.at(best, text, found)
        return best


def log_odds(hashes: np.ndarray, text: np.ndarray, toxic: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Words in at least ``least`` texts, at most ``most`` of them (the commonest), and how much more often toxic texts have them."""
    pairs = np.unique(mixed(hashes) ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    words, kind = np.unique(hashes[pairs], return_inverse=True)
    bad = np.bincount(kind, toxic[text[pairs]], len(words))
    good = np.bincount(kind, 1 - toxic[text[pairs]], len(words))
    chosen = np.flatnonzero(bad + good >= least)
    chosen = np.sort(chosen[np.argsort(-(bad + good)[chosen], kind="stable")[:most]])
    share = max(toxic.sum(), 1) / max(len(toxic) - toxic.sum(), 1)
    return words[chosen], np.clip(np.log((bad[chosen] + 2 * share) / (good[chosen] * share + 2 * share)), -3, 3)


def train(data: np.ndarray, offsets: np.ndarray, toxic: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.01, seed: int = 3) -> Network:
    """Train on texts with labels. A label is one of a whole text: each epoch picks the windows that speak for toxicity most, one
    of a toxic text, two of another, and a random one, and learns from these."""
    draw = np.random.RandomState(seed)
    hashes, _, _, at = word_spans(data, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    toxic = toxic.astype(np.float64)
    vocabulary, odds = log_odds(hashes, owner, toxic, 3, 20_000) if len(hashes) else (np.zeros(0, np.uint64), np.zeros(0))
    net = Network.start(vocabulary, seed)
    _, (kinds, piece, size), windows, text = net.read(data, offsets, FIT_STEP)
    if not len(windows) or not 0 < toxic.sum() < len(toxic):
        net.p["bias"][:] = 8.0 if len(toxic) and toxic.all() else -8.0
        net.p["out"][:] = 0
        return net
    words = net.words_of(kinds)
    net.p["word"][2:, 0] = odds
    known = np.r_[0.0, 0.0, odds][words]
    piece_word = np.repeat(np.arange(len(kinds)), size)
    seen = np.bincount(piece, (words[piece_word] > 1).astype(float), 1 << PIECE_BITS)
    net.p["piece"][:, 0] = np.bincount(piece, known[piece_word], 1 << PIECE_BITS) / (seen + 2)
    guess = np.r_[known, -9.0][windows].max(axis=1)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    order_by = np.lexsort((-guess, text))
    for epoch in range(epochs):
        if epoch:
            x = net.inputs(words, piece, size)
            score = np.concatenate([net.logits(x, windows[k : k + BLOCK]) for k in range(0, len(windows), BLOCK)])
            order_by = np.lexsort((-score, text))
        rank = np.arange(len(text)) - np.searchsorted(text[order_by], text[order_by])
        label = toxic[text]
        chosen = order_by[(rank == 0) | ((rank == 1) & (label[order_by] == 0))]
        clean = np.flatnonzero(label == 0)
        chosen = np.r_[chosen, draw.choice(clean, min(len(clean), int((toxic == 0).sum())), replace=False)]
        draw.shuffle(chosen)
        for k in range(0, len(chosen), batch):
            own, rows = np.unique(windows[chosen[k : k + batch]], return_inverse=True)
            rows = rows.reshape(-1, LENGTH)  # padding is the largest number, so the row behind all words
            real = own[own < len(kinds)]
            parts = np.flatnonzero(np.isin(piece_word, real))
            x = net.inputs(words[real], piece[parts], size[real])
            kept: list = []
            y = label[chosen[k : k + batch]]
            logit = net.logits(x, rows, kept)
            weight = np.where(y > 0, 2.0, 1.0)
            d_logit = ((1 / (1 + np.exp(-logit)) - y) * weight / len(y)).astype(np.float32)
            g, d_x = net.gradient(x, rows, d_logit, kept)
            d_word, d_piece = np.zeros_like(net.p["word"]), np.zeros_like(net.p["piece"])
            np.add.at(d_word, words[real], d_x[:-1, :WORD])
            share = d_x[:-1, WORD:] / size[real][:, None]
            np.add.at(d_piece, piece[parts], share[np.repeat(np.arange(len(real)), size[real])])
            g |= {"word": d_word, "piece": d_piece}
            step += 1
            for name, value in net.p.items():
                m, v = moments[name]
                m += 0.1 * (g[name] - m)
                v += 0.01 * (g[name] ** 2 - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            net.p["word"][0] = 0
    return net
