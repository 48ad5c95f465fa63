"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A block's features are the tags above it, the words of their classes and ids, and what its text looks like; a chain of two
labels, main text or not, runs over the blocks of a page. It is trained on labelled pages: layouts written down here with their
labels, and a bounded sample of the pages whose blocks HTML's own sectioning tags label. Viterbi decoding gives the most
likely labels of a whole page.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.llm.common import slices, texts
from crashlens.llm.html_blocks import Block, blocks

BITS = 14

#: Layouts of labelled pages: where a block stands, what kind of text it has, and 1 for main text.
LAYOUTS = """
header h1 site 0|nav ul li links 0|article h1 title 1|article p prose 1|article p prose 1|article p short 1|aside p prose 0|footer p legal 0
div.navbar a links 0|div.content h1 title 1|div.content p prose 1|div.content p short 1|div.content p prose 1|div.sidebar ul li links 0|div.footer legal 0
div#header site 0|div#menu ul li links 0|div#main h2 title 1|div#main p prose 1|div#main ul li short 1|div#main p prose 1|div#comments h3 short 0|div#comments p prose 0|div#footer legal 0
header.site-header div site 0|nav.main-menu li links 0|main h1 title 1|main p prose 1|main blockquote p prose 1|main p short 1|section.comments p prose 0|section.comments p short 0|footer legal 0
div.cookie-notice p prose 0|div.top-bar links 0|div.post h1 title 1|div.post-body p prose 1|div.post-body p prose 1|div.share links 0|div.related li links 0|div.newsletter form short 0|div.copyright legal 0
div.banner short 0|nav links 0|div.ad prose 0|article h1 title 1|article p prose 1|article div.ad prose 0|article p prose 1|article p short 1|footer legal 0
div.ad short 0|section.article h1 title 1|section.article p prose 1|section.article table tr td short 1|section.article p prose 1|aside.sidebar div prose 0|form.search short 0|div.site-footer legal 0
header nav li links 0|article header h1 title 1|article p prose 1|article h2 short 1|article p prose 1|article pre short 1|article section.comment-list p prose 0|aside.promo p prose 0|footer ul li links 0
div.alert prose 0|div.breadcrumb links 0|div.story h1 title 1|div.story div.text prose 1|div.story div.text prose 1|div.story div.sponsored prose 0|div.widget prose 0|div#respond form short 0|div.disclaimer legal 0
nav li links 0|article h1 title 1|article p short 1|footer legal 0
nav li links 0|article p prose 1|footer legal 0
div.popup prose 0|div.header site 0|div.entry p prose 1|div.entry p prose 1|div.entry p prose 1|ol.comment-list li p prose 0|ol.comment-list li p prose 0|div.comment-form form short 0|div.footer short 0
div.notice p prose 0|main article h1 title 1|main article p prose 1|main article ul li prose 1|main aside p prose 0|main div.advert p prose 0|main form label short 0|footer div legal 0
div.nav links 0|div p prose 1|div p prose 1|div p short 1|div.discussion p prose 0|div.bottom legal 0
nav li links 0|article h1 title 1|article p prose 1|article div.ad prose 0|article p prose 1|article section.comments p prose 0|footer legal 0
div.ad prose 0|article h1 title 1|article p prose 1|article aside p prose 0|article p short 1|article form p short 0|article footer p short 0|footer legal 0
div.menu links 0|div.article h2 title 1|div.article p prose 1|div.article div.ads p prose 0|div.article p prose 1|div.article div.comment p prose 0|div.footer legal 0
header site 0|main h1 title 1|main p prose 1|main div.advertisement prose 0|main p short 1|main div.related p prose 0|main ul.comments li prose 0|footer legal 0
article header h1 title 1|article nav ul li links 0|article p prose 1|article div.notice prose 0|article ul li short 1|article p prose 1|article div.share short 0|aside p prose 0
header p prose 0|div.article-content p prose 1|div.article-content figure figcaption short 1|div.article-content p prose 1|div.reader-comments div prose 0|div.subscribe short 0|footer p legal 0
""".strip().split("\n")

#: Sectioning elements inside and outside the main text.
INSIDE = frozenset("article main".split())
OUTSIDE = frozenset("nav aside footer form button select dialog".split())
OUTSIDE_NAMES = frozenset("ad advert advertisement comment sidebar cookie notice banner promo share related newsletter menu nav footer".split())

#: Words of classes and ids that say of a block that it is no main text, or that it is.
BESIDE = OUTSIDE_NAMES | frozenset(
    "adv advertising sponsor sponsored sponsorship consent gdpr alert popup modal overlay breadcrumb navigation navbar topbar toolbar header "
    "masthead copyright legal disclaimer social sharing recommended recommendation recommend suggestion popular trending widget aside respond "
    "reply discussion disqus thread response reader feedback form login signup subscribe subscription search pagination pager tag cloud meta "
    "byline author bio rating review skip".split()
)
MAIN = frozenset("article content main post entry story body text blog prose".split())


def training_pages(copies: int = 12) -> list[tuple[list[Block], list[int]]]:
    """The layouts with texts of several lengths; words are of random letters, so that no word tells a label."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("aeinorstldu") for _ in range(draw.randint(2, 9)))
    words = lambda low, high: " ".join(word() for _ in range(draw.randint(low, high)))
    sentence = lambda: words(4, 18).capitalize() + "."
    kinds = {
        "prose": lambda: " ".join(sentence() for _ in range(draw.randint(2, 8))),
        "short": lambda: words(1, 6).capitalize() + draw.choice(["", ".", ":"]),
        "title": lambda: words(3, 10).capitalize(),
        "site": lambda: words(1, 3).capitalize(),
        "links": lambda: words(1, 3).capitalize(),
        "legal": lambda: "© 20" + str(draw.randint(10, 30)) + " " + words(1, 5) + draw.choice(["", " · " + words(1, 3)]),
    }
    pages = []
    for _ in range(copies):
        for layout in LAYOUTS:
            found, labels = [], []
            for item in layout.split("|"):
                *steps, kind, label = item.split()
                tags = ("html", "body", *(s.split(".")[0].split("#")[0] for s in steps if s.split(".")[0].split("#")[0] != "a"))
                names = frozenset(
                    n[:-1] if len(n) > 3 and n.endswith("s") else n for s in steps for n in s.replace("#", ".").replace("-", ".").split(".")[1:]
                )
                for _ in range(draw.randint(1, 5) if kind in ("prose", "links") else 1):
                    text = kinds[kind]()
                    found.append(Block(tags, names, text, len(text) if kind == "links" else 0))
                    labels.append(int(label))
            pages.append((found, labels))
    return pages


def tagged(found: list[Block]) -> list[int] | None:
    """Labels of a page by its sectioning tags; None for a page without them."""
    if not any(INSIDE.intersection(b.path) for b in found):
        return None
    return [int(bool(INSIDE.intersection(b.path)) and not OUTSIDE.intersection(b.path) and not OUTSIDE_NAMES & b.names) for b in found]


def features(found: list[Block]) -> list[list[int]]:
    """Hashed features of each block of a page."""
    out = []
    cache: dict[str, int] = {}
    for k, b in enumerate(found):
        n = len(b.text)
        size = min(n.bit_length(), 10)
        parts = {f"t:{tag}" for tag in b.path[1:]} | {f"n:{name}" for name in b.names}
        parts |= {
            f"p:{b.path[-1] if b.path else ''}",
            f"s:{size}",
            f"l:{4 * b.linked // n}",
            f"e:{b.text[-1] if b.text[-1] in '.!?:' else ''}",
            f"c:{min(b.text.count(','), 3)}",
            "first" if k == 0 else "last" if k == len(found) - 1 else "middle",
            "bias",
        }
        parts |= {
            name
            for name, holds in (
                ("beside name", b.names & BESIDE),
                ("main name", b.names & MAIN),
                ("beside tag", OUTSIDE.intersection(b.path)),
                ("main tag", INSIDE.intersection(b.path)),
            )
            if holds
        }
        if "©" in b.text[:40]:
            parts.add("copyright")
        for part in parts:
            if part not in cache:
                cache[part] = zlib.crc32(part.encode()) & ((1 << BITS) - 1)
        out.append([cache[part] for part in parts])
    return out


@dataclass(frozen=True)
class Chain:
    """Weights of features for label 1 (label 0 has none), and of the four steps from label to label."""

    weights: np.ndarray
    steps: np.ndarray

    def decode(self, rows: list[list[int]]) -> list[int]:
        """Viterbi: the labels of highest total score; of two equal ones, not main text."""
        best, back = (0.0, 0.0), []
        (to00, to01), (to10, to11) = self.steps.tolist()
        for k, row in enumerate(rows):
            score = float(self.weights[row].sum())
            if k == 0:
                best = (0.0, score)
                continue
            stay, leave, enter, go_on = best[0] + to00, best[1] + to10, best[0] + to01, best[1] + to11
            back.append((0 if stay >= leave else 1, 0 if enter >= go_on else 1))
            best = (max(stay, leave), max(enter, go_on) + score)
        if not rows:
            return []
        labels = [int(best[1] > best[0])]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def train(pages: Iterable[tuple[list[list[int]], list[int]]], rounds: int = 250, penalty: float = 1e-4) -> Chain:
    """Maximum conditional likelihood of the labels of whole pages, by forward-backward over all pages at once and Adam."""
    pages = sorted((p for p in pages if p[0]), key=lambda p: -len(p[0]))
    weights, steps = np.zeros(1 << BITS), np.zeros((2, 2))
    if not pages:
        return Chain(weights, steps)
    longest, n = len(pages[0][0]), len(pages)
    cells = [(t, k) for k, (rows, _) in enumerate(pages) for t in range(len(rows))]
    cell = np.array([t * n + k for t, k in cells])
    index = np.concatenate([row for rows, _ in pages for row in rows])
    owner = np.repeat(cell, [len(row) for rows, _ in pages for row in rows])
    gold = np.full((longest, n), -1)
    gold.ravel()[cell] = np.concatenate([labels for _, labels in pages])
    alive = gold >= 0
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (gold[:-1][alive[1:]], gold[1:][alive[1:]]), 1)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (weights, steps)]
    for step in range(1, rounds + 1):
        score = np.zeros((longest, n, 2))
        score[:, :, 1] = np.bincount(owner, weights[index], longest * n).reshape(longest, n)
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[0] = score[0]
        for t in range(1, longest):
            onward = np.logaddexp(alpha[t - 1][:, :1] + steps[0], alpha[t - 1][:, 1:] + steps[1]) + score[t]
            alpha[t] = np.where(alive[t][:, None], onward, alpha[t - 1])
        for t in range(longest - 2, -1, -1):
            later = beta[t + 1] + score[t + 1]
            onward = np.logaddexp(later[:, :1] + steps[:, 0], later[:, 1:] + steps[:, 1])
            beta[t] = np.where(alive[t + 1][:, None], onward, beta[t + 1])
        whole = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
        one = np.where(alive, np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - whole, 0)), 0)
        joint = alpha[:-1, :, :, None] + steps + (beta[1:] + score[1:])[:, :, None, :] - whole[:, None, None]
        expected = np.where(alive[1:][:, :, None, None], np.exp(np.minimum(joint, 0)), 0).sum(axis=(0, 1))
        d_weights = np.bincount(index, (one - (gold == 1)).ravel()[owner], 1 << BITS) / n + penalty * weights
        d_steps = (expected - pairs) / n + penalty * steps
        for x, g, (m, v) in ((weights, d_weights, moments[0]), (steps, d_steps, moments[1])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Chain(weights, steps)


def fit(pages: DataFrame, sample_rows: int = 100, id_column: str = "page_id", html_column: str = "html") -> Chain:
    """Train on the labelled layouts and on about ``sample_rows`` pages with sectioning tags, by hash; never on over twice as many.

    The sampled pages are parted into features where they are read; the driver gets these.
    """
    share = sample_rows / max(pages.count(), sample_rows)
    chosen = F.pmod(F.xxhash64(F.col(f"`{id_column}`")), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = pages.where(chosen).select(F.coalesce(F.col(f"`{html_column}`"), F.lit("")).alias("html"))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            rows = []
            for raw in texts(batch.column("html")):
                found = blocks(raw)
                if labels := tagged(found):
                    rows.append((features(found), labels))
            kinds = (pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in (0, 1)], ["features", "labels"])

    own = [(features(found), labels) for found, labels in training_pages()]
    kinds = "features array<array<int>>, labels array<int>"
    seen = sample.mapInArrow(labelled, kinds).limit(2 * sample_rows).collect()
    return train([*own, *sorted((r["features"], r["labels"]) for r in seen)])


def main_text(page: str, chain: Chain) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, label in zip(found, chain.decode(features(found)), strict=True) if label)


def extract(pages: DataFrame, chain: Chain, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """The main text of every page: id, url, text, n_chars (code points).

    The whole page is parted and decoded. A null or empty page, or one without text, gives the empty text. Ids and urls may be
    null or repeat, each row is a page. An empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [main_text(raw, chain) for raw in texts(batch.column("html"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                ["id", "url", "text", "n_chars"],
            )

    return (
        pages.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{url_column}`").alias("url"), F.col(f"`{html_column}`").alias("html"))
        .mapInArrow(run, "id long, url string, text string, n_chars long")
        .withColumnsRenamed({"id": id_column, "url": url_column})
    )
