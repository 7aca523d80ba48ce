"""HTML extraction by a recurrent block labeller.

A page is read once into leaf blocks: runs of text between block-level tags, each with the path of open tags (names, classes,
ids). Every block becomes a vector of hashed path tokens, hashed words and a few shape figures; a bidirectional LSTM in numpy reads the
page's sequence both ways and gives each block, in view of the whole page, the probability of being main text.

The model is trained on the driver when a query runs: on at most ``SAMPLE_PAGES`` pages picked by hash (a documented bound), labelled by the
tags HTML defines for the purpose (article, main; nav, header, footer, aside, form), and on rearrangements of their blocks in
``LAYOUTS`` made-up layouts whose labels are known. Training is seeded. Labelling reads whole pages.

Null and empty pages give an empty text; unclosed, stray and broken tags never fail; scripts, styles, comments, the head and other
text that is not shown are skipped; a page without a main block gives an empty text; repeated rows get equal answers; an empty
table gives no rows and trains on made-up text alone.
"""

from __future__ import annotations

import html as entities
import random
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import append, not_space, utf8, word_hashes, word_spans

SAMPLE_PAGES = 300
LAYOUTS = 800
HIDDEN, PATH_DIM, WORD_DIM, SHAPE_DIM = 16, 192, 64, 6
EPOCHS, BATCH, RATE = 6, 16, 0.01
#: elements of a formula
MATH = frozenset("annotation annotation-xml math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
#: elements that stand for something other than text, and cells of a formula: words beside them stay apart
APART = frozenset("br canvas img mtd mtr object svg".split())
#: elements that flow inside a block
INLINE = MATH | APART | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose content is not shown as text of the page
HIDDEN_TAGS = ("script", "style", "noscript", "template", "head", "textarea", "select", "option", "iframe", "object", "svg", "annotation", "annotation-xml", "canvas", "title")
#: those of them whose content is no markup: unclosed, they reach to the end of the page
RAW_TEXT = frozenset("script style textarea iframe title".split())
#: elements that one of the same kind closes
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>", re.S)
NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS_IN_NAMES = re.compile(r"[a-z]+")


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """Leaf blocks of a page in order: path tokens, text, and how many of its characters are in links."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked, at, n = 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        s = " ".join(entities.unescape("".join(text)).split())
        if s:
            out.append((tuple(t for tag, names in stack if tag not in INLINE for t in (tag, *names)), s, min(linked, len(s))))
        text.clear()
        linked = 0

    while at < n:
        m = TAG.search(page, at)
        end = m.start() if m else n
        if end > at:
            text.append(page[at:end])
            if any(t == "a" for t, _ in stack):
                linked += end - at
        if not m:
            break
        at = m.end()
        closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in APART:
            text.append(" ")
        block = tag not in INLINE
        if block:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in VOID or attrs.endswith("/") and (tag in ("svg", "path") or tag in MATH):
            continue
        if tag in HIDDEN_TAGS:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else (n if tag in RAW_TEXT else at)
            continue
        if tag in SELF_CLOSING:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in SELF_CLOSING[tag]:
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        names = tuple(f"{tag}.{w}" if k.lower() == "class" else f"{k.lower()}.{w}" for k, a, b, c in NAMES.findall(attrs) for w in WORDS_IN_NAMES.findall((a or b or c).lower()))
        stack.append((tag, (*names, *(f"~{x.partition('.')[2]}" for x in names))))
    flush()
    return out


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed tokens of the path; the innermost element counts again on its own."""
    v = np.zeros(PATH_DIM, np.float32)
    for t in path:
        v[crc32(t.encode()) % PATH_DIM] = 1
    tags = [t for t in path if "." not in t and t[0] != "~"]
    if tags:
        v[crc32(("last " + tags[-1]).encode()) % PATH_DIM] = 1
    return v


def vectors(found: list[tuple[tuple[str, ...], str, int]], cache: dict) -> np.ndarray:
    """One row per block: path, words, shape."""
    if not found:
        return np.zeros((0, PATH_DIM + WORD_DIM + SHAPE_DIM), np.float32)
    texts = pa.array([t for _, t, _ in found], pa.string())
    data, off = utf8(texts)
    start, end, bounds = word_spans(data, off, not_space())
    n = np.diff(bounds)
    slot = (word_hashes(data, start, end, lower=True) % np.uint64(WORD_DIM)).astype(np.int64)
    words = np.bincount(np.repeat(np.arange(len(found)), n) * WORD_DIM + slot, minlength=len(found) * WORD_DIM).reshape(-1, WORD_DIM)
    words = words / np.sqrt(1.0 + (words * words).sum(axis=1, keepdims=True))
    chars = np.diff(off)
    link = np.array([l for _, _, l in found]) / np.maximum(chars, 1)
    stops = np.array([t.count(".") + t.count(",") for _, t, _ in found])
    place = np.arange(len(found)) / len(found)
    shape = np.stack([np.log1p(n) / 5, np.log1p(chars) / 8, link, np.log1p(stops) / 3, place, np.ones(len(found))], axis=1)
    paths = []
    for p, _, _ in found:
        if p not in cache:
            cache[p] = path_vector(p)
        paths.append(cache[p])
    return np.concatenate((np.array(paths), words * 0.5, shape), axis=1).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output per block. Batches are (steps, pages, features) with a mask."""

    def __init__(self, seed: int = 11):
        rng, d, h = np.random.default_rng(seed), PATH_DIM + WORD_DIM + SHAPE_DIM, HIDDEN
        self.w = {}
        for way in "fb":
            self.w["x" + way] = (rng.standard_normal((d, 4 * h)) / np.sqrt(d)).astype(np.float32)
            self.w["h" + way] = (rng.standard_normal((h, 4 * h)) / np.sqrt(h)).astype(np.float32)
            self.w["b" + way] = np.concatenate((np.zeros(h), np.ones(h), np.zeros(2 * h))).astype(np.float32)
        self.w["o"] = (rng.standard_normal((2 * h + d, 1)) / np.sqrt(2 * h)).astype(np.float32)
        self.w["c"] = np.zeros(1, np.float32)

    def run(self, way: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states of one direction, and what the gradient needs. A masked step keeps the state."""
        steps, pages = x.shape[:2]
        h = c = np.zeros((pages, HIDDEN), np.float32)
        pre = x @ self.w["x" + way] + self.w["b" + way]
        out, tape = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.w["h" + way]
            i, f, o = (sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            c2 = np.where(m, f * c + i * g, c)
            tc = np.tanh(c2)
            h2 = np.where(m, o * tc, h)
            tape.append((t, h, c, i, f, o, g, tc, m))
            h, c = h2, c2
            out[t] = h
        return out, tape

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        hf, tf = self.run("f", x, mask)
        hb, tb = self.run("b", x, mask)
        both = np.concatenate((hf, hb, x), axis=2)
        return sigmoid((both @ self.w["o"])[:, :, 0] + self.w["c"]), (both, tf, tb)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, (both, tf, tb) = self.forward(x, mask)
        dz = np.where(mask, p - y, 0).astype(np.float32)[:, :, None] / max(1, mask.sum())
        grad = {"o": np.tensordot(both, dz, ((0, 1), (0, 1))), "c": dz.sum(axis=(0, 1))}
        back = dz @ self.w["o"].T
        for way, tape, dh_all in (("f", tf, back[:, :, :HIDDEN]), ("b", tb, back[:, :, HIDDEN:2 * HIDDEN])):
            dh = dc = np.zeros_like(dh_all[0])
            wh, dpre = self.w["h" + way], np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            gh = np.zeros_like(wh)
            for t, h0, c0, i, f, o, g, tc, m in reversed(tape):
                dh = dh + dh_all[t]
                dhm = np.where(m, dh, 0)
                dcm = np.where(m, dc + dhm * o * (1 - tc * tc), 0)
                d = np.concatenate((dcm * g * i * (1 - i), dcm * c0 * f * (1 - f), dhm * tc * o * (1 - o), dcm * i * (1 - g * g)), axis=1)
                dpre[t] = d
                gh += h0.T @ d
                dh = np.where(m, d @ wh.T, dh)
                dc = np.where(m, dcm * f, dc)
            grad["h" + way] = gh
            grad["x" + way] = np.tensordot(x, dpre, ((0, 1), (0, 1)))
            grad["b" + way] = dpre.sum(axis=(0, 1))
        return grad

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> None:
        """Adam on batches of pages of like length."""
        rng = random.Random(seed)
        pages = sorted((p for p in pages if len(p[0])), key=lambda p: len(p[0]))
        batches = [pages[i:i + BATCH] for i in range(0, len(pages), BATCH)]
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for _ in range(epochs):
            rng.shuffle(batches)
            for b in batches:
                x, mask = padded([p[0] for p in b])
                y = np.zeros(mask.shape, np.float32)
                for i, p in enumerate(b):
                    y[:len(p[1]), i] = p[1]
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] = (self.w[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text per block and page; pages of like length go together."""
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        at = 0
        while at < len(order):
            # a batch holds a bounded number of blocks
            most = max(1, min(64, 40_000 // max(1, len(pages[order[min(at + 63, len(order) - 1)]]))))
            part = order[at:at + most]
            at += most
            if len(pages[part[-1]]):
                x, mask = padded([pages[i] for i in part])
                p, _ = self.forward(x, mask)
                for j, i in enumerate(part):
                    out[i] = p[:len(pages[i]), j]
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), PATH_DIM + WORD_DIM + SHAPE_DIM), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for i, p in enumerate(pages):
        x[:len(p), i] = p
        mask[:len(p), i] = True
    return x, mask


#: words by which authors name containers, for made-up layouts
MAIN_TAGS = ["article", "article", "article", "main", "div.content", "div.article", "div.post", "div.entry", "section.story", "div.body", "main.page"]
OTHER = {
    "nav": ["nav", "div.menu", "ul.nav", "div.navbar", "div.breadcrumb", "div.pagination", "nav.toc"],
    "header": ["header", "div.header", "div.masthead", "div.topbar", "header.site"],
    "footer": ["footer", "div.footer", "footer.site", "div.copyright", "div.legal"],
    "aside": ["aside", "div.sidebar", "aside.sidebar", "div.related", "div.recommended", "div.widget", "section.related", "div.tags", "div.share", "div.social", "div.author"],
    "notice": ["div.cookie", "div.notice", "div.banner", "div.consent", "div.alert", "div.popup", "div.modal", "p.notice", "div.newsletter", "div.subscribe", "section.notice", "div#cookie"],
    "advert": ["div.ad", "div.ad", "div.ads", "div.advert", "div.advertisement", "aside.ad", "div.promo", "div.sponsored", "p.ad", "section.promo", "ins.ad"],
    "form": ["form", "form.search", "form.login", "div.form", "form.newsletter"],
    "comments": ["section.comments", "div.comments", "ul.comments", "div.comment", "ol.commentlist", "section#comments", "div.discussion", "div.replies", "article.comment"],
}


def shell(spec: str, inside: str) -> str:
    tag, dot, name = re.match(r"(\w+)([.#]?)(.*)", spec).groups()
    attr = f' {"id" if dot == "#" else "class"}="{name}"' if name else ""
    return f"<{tag}{attr}>{inside}</{tag}>"


def made_up(texts: list[str], rng: random.Random) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pages in made-up layouts. Main blocks carry a mark in front while the page is built, which gives their labels."""
    def some(most: int) -> str:
        w = rng.choice(texts).split()
        if rng.random() < 0.15:  # junk: one word again and again
            w = [rng.choice(w)] * rng.randint(1, most)
        a = rng.randrange(max(1, len(w)))
        return entities.escape(" ".join(w[a:a + rng.randint(1, most)]) or "x")

    def body(mark: str) -> str:
        parts = [f"<h1>{mark}{some(9)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            t = mark + (some(3) if kind < 0.12 else some(90))
            parts.append(f"<h2>{t}</h2>" if kind < 0.05 else f"<ul><li>{t}</li><li>{mark}{some(12)}</li></ul>" if kind > 0.95 else
                         f"<blockquote>{t}</blockquote>" if kind > 0.92 else f"<p><b>{t}<br>" if kind > 0.85 else f"<div>{t}</div>" if kind > 0.8 else f"<p>{t}</p>")
            if rng.random() < 0.12:
                parts.append(other(rng.choice(["advert", "notice", "aside", "form"])))
        return "".join(parts)

    def other(kind: str) -> str:
        n = rng.randint(1, 8 if kind in ("nav", "comments") else 4)
        item = lambda: (f'<li><a href="/x">{some(3)}</a></li>' if kind == "nav" and rng.random() < 0.8 else f"<p>{some(40)}</p>" if rng.random() < 0.5 else
                        f"<div>{some(25)}</div>" if rng.random() < 0.5 else some(15) if rng.random() < 0.6 else f"<h3>{some(4)}</h3>")
        inside = "".join(item() for _ in range(n))
        return shell(rng.choice(OTHER[kind]), f"<ul>{inside}</ul>" if kind == "nav" and rng.random() < 0.6 else inside)

    out, cache, mark = [], {}, "\u2063"
    for _ in range(LAYOUTS):
        main = rng.choice(MAIN_TAGS)
        before = [other(k) for k in ("notice", "header", "nav", "advert", "form", "aside") if rng.random() < 0.45]
        after = [other(k) for k in ("aside", "comments", "advert", "form", "nav", "footer") if rng.random() < 0.45]
        rng.shuffle(before)
        inner = body(mark) + (other("comments") if rng.random() < 0.2 else "")
        if rng.random() < 0.2:
            inner = other("header").replace("<h3>", "<p>") + inner
        page = "".join(before) + shell(main, inner) + "".join(after)
        if rng.random() < 0.3:
            page = shell(rng.choice(["div.container", "div.wrapper", "div#page"]), page)
        found = blocks(f"<html><body>{page}</body></html>")
        y = np.array([t.startswith(mark) for _, t, _ in found], np.float32)
        out.append((vectors([(p, t.removeprefix(mark) or "x", l) for p, t, l in found], cache), y))
    return out


MAIN_ELEMENTS = {"article", "main"}
SIDE_ELEMENTS = {"nav", "header", "footer", "aside", "form"}
SIDE_NAMES = {x.partition(".")[2] or x.partition("#")[2] for xs in OTHER.values() for x in xs} - {""}


def by_tags(path: tuple[str, ...]) -> float | None:
    """Label of a block whose path says it plainly; None where it does not."""
    named = {t[1:] for t in path if t[0] == "~"}
    if named & SIDE_NAMES or SIDE_ELEMENTS & set(path):
        return 0.0
    return 1.0 if MAIN_ELEMENTS & set(path) else None


def fit(pages: DataFrame, html: str = "html", key: str = "page_id", sample: int = SAMPLE_PAGES) -> Labeller:
    """Train on a bounded sample of ``pages`` and on made-up layouts of its text."""
    rows = pages.select(F.col(html).alias("h"), F.xxhash64(F.col(key).cast("string"), html, F.lit("sample")).alias("k")).where("h is not null")
    # about ``sample`` pages by hash; repeated rows share one hash and count once
    share = sample / max(1, pages.count())
    some = rows if share >= 1 else rows.where(F.pmod("k", F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))
    got = [r.h for r in sorted(some.dropDuplicates(["k"]).collect(), key=lambda r: r.k)]
    rng, known, cache = random.Random(3), [], {}
    texts = []
    for h in got:
        found = blocks(h)
        y = [by_tags(p) for p, _, _ in found]
        texts += [t for _, t, _ in found]
        if any(v == 1.0 for v in y) and None not in y:
            known.append((vectors(found, cache), np.array(y, np.float32)))
    if not texts:
        texts = [" ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(120)) for _ in range(50)]
    model = Labeller()
    rows = known + made_up(texts, rng)
    blind = [(np.where(np.arange(x.shape[1]) // PATH_DIM == 0, x, 0).astype(np.float32), y) for x, y in rows[::4]]  # the path alone must do, too
    model.train(rows + blind)
    return model


def extract(pages: DataFrame, model: Labeller, html: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of every page."""
    def find(col: pa.Array) -> list[pa.Array]:
        res, cache = [], {}
        for lo in range(0, len(col), 128):
            found = [blocks(h) if h else [] for h in col.slice(lo, 128).to_pylist()]
            for f, p in zip(found, model.label([vectors(f, cache) for f in found])):
                res.append("\n\n".join(t for (_, t, _), x in zip(f, p) if x >= 0.5))
            if len(cache) > 20_000:
                cache.clear()
        return [pa.array(res, pa.string())]

    return append(pages, html, [T.StructField(out, T.StringType())], find)


def pages_query(pages: DataFrame) -> DataFrame:
    """Contract columns of every page."""
    rows = pages.select("page_id", "url", "html")
    return extract(rows, fit(rows)).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
