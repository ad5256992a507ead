"""HTML extraction: a recurrent block labeller.

A page is cut into leaf blocks: the text between block-level tags, with character
references decoded and white space (as Python's ``str.split`` has it) made one
space.  Each block is a vector of its tag path (hashed tags, classes and
identifiers of all open block elements), its hashed words and a few ratios.  A
bidirectional LSTM reads all blocks of the page, in numpy, and labels each one as
main text or not; the main blocks joined by one space are the page's text.

The model is trained here, by Adam on pages that ``synthetic_pages`` composes
from a seed: articles in various containers between menus, headers, footers,
sidebars, notices, adverts, forms and reader comments, of invented words.

Defined cases: null and empty pages, and pages without a main block, have an empty
text; unclosed elements end where HTML's common rules end them; only scripts,
styles and comments are cut, and one that is never closed runs to the end: text of all
other elements is the labeller's to judge; repeated rows stay repeated.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_chunk, small_batches

#: Fixed values of HTML: elements that start a block, that have no end, whose content is no text, whose text is a block of its own within a paragraph, and that end an open paragraph.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NO_TEXT = "script|style"
APART = frozenset("canvas iframe noscript select template textarea".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "body": ("head", "title")}
SCOPE = frozenset("table ul ol dl article section div main body aside nav header footer form blockquote".split())

# No part of a tag runs past a ``<`` that may begin another, so reading is linear in the page, stray quotes or not.
_QUOTED = r"\"(?:[^\"<]|<(?![a-zA-Z/!?]))*+\"|'(?:[^'<]|<(?![a-zA-Z/!?]))*+'"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({NO_TEXT})(?=[\s/>])(?:[^'\"<>]|{_QUOTED})*+>.*?(?:</\1\s*>|\Z)|<({NO_TEXT})(?=[\s/>])[^<>]*>.*?(?:</\2\s*>|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^'\"<>]|{_QUOTED})*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PARTS = re.compile(r"[a-z]+")

PATHS, WORDS, PATH_DIM, WORD_DIM, RATIOS, HIDDEN = 1024, 1024, 16, 8, 4, 16


@dataclass(frozen=True)
class Block:
    path: tuple[int, ...]  # hashed tokens of all open elements and of the innermost one
    text: str
    linked: int  # characters inside links


@lru_cache(maxsize=50_000)
def _element(name: str, attributes: str) -> frozenset[int]:
    """An element's hashed tokens: its tag and the lower-case parts of class, id and role."""
    tokens = {name}
    for _, value in _ATTRIBUTE.findall(attributes):
        tokens.update(f"@{p}" for p in _PARTS.findall(value.lower()))
    return frozenset(zlib.crc32(t.encode()) % PATHS for t in tokens)


@lru_cache(maxsize=100_000)
def _path(inside: frozenset[int], leaf: str) -> tuple[int, ...]:
    return tuple(sorted(inside | {zlib.crc32(f"leaf:{leaf}".encode()) % PATHS}))


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page, in order."""
    if not page:
        return []
    out: list[Block] = []
    # Open elements with the tokens of all down to them (nested alike, they share one set), and how many of each name.
    stack: list[tuple[str, frozenset[int]]] = []
    depth: Counter[str] = Counter()
    parts: list[str] = []
    linked = links = drawn = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            leaf, inside = stack[-1] if stack else ("", frozenset())
            out.append(Block(_path(inside, leaf), text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def enter(name: str, attributes: str) -> None:
        own, outer = _element(name, attributes), stack[-1][1] if stack else frozenset()
        stack.append((name, outer if own <= outer else outer | own))
        depth[name] += 1

    def leave(to: int) -> None:
        for name, _ in stack[to:]:
            depth[name] -= 1
        del stack[to:]

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if links:
                linked += len(piece.strip())
        at = m.end()
        name = m[4] or m[7]
        if not name:
            if m[1] or m[2]:
                parts.append(" ")
            continue
        name, end = name.lower(), (m[3] or m[6]) == "/"
        if name == "br":
            parts.append(" ")
        elif name == "a":
            links = 0 if end else 1
        elif name in ("svg", "math"):
            if end:
                drawn = max(drawn - 1, 0)
            elif not m[0].endswith("/>"):
                drawn += 1
        elif name == "title" and drawn:
            parts.append(" ")
        elif name in APART:
            flush()
            if not end:
                enter(name, m[5] or m[8] or "")
            elif depth[name]:
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                leave(i)
        elif name in BLOCK:
            flush()
            if end:
                if depth[name]:
                    i = len(stack) - 1
                    while stack[i][0] != name:
                        i -= 1
                    leave(i)
                continue
            if stack and stack[-1][0] == "p" and name not in ("html", "head"):
                leave(len(stack) - 1)
            for i in range(len(stack) - 1, -1, -1) if name in CLOSES else ():
                if stack[i][0] in CLOSES[name]:
                    leave(i)
                    break
                if stack[i][0] in SCOPE:
                    break
            if name not in VOID:
                enter(name, m[5] or m[8] or "")
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def _word_ids(text: str) -> list[int]:
    crc = zlib.crc32
    return [crc(w.encode()) % WORDS for w in text.lower().split()]


def _ratios(b: Block) -> tuple[float, float, float, float]:
    n = len(b.text)
    return min(np.log1p(n) / 6, 2.0), b.linked / n, float(b.text[-1] in ".!?…"), 1.0


class Labeller:
    """The network: embeddings, one LSTM each way, a linear output."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        size = PATH_DIM + WORD_DIM + RATIOS
        self.p = {"path": r.normal(0, 0.1, (PATHS, PATH_DIM)), "word": np.zeros((WORDS, WORD_DIM)), "out": r.normal(0, 0.2, 2 * HIDDEN), "skip": np.zeros(size), "bias": np.zeros(1)}
        for d in "fb":
            self.p[f"w{d}"] = r.normal(0, 0.2, (size + HIDDEN, 4 * HIDDEN))
            self.p[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])

    def vectors(self, page: list[Block]) -> np.ndarray:
        out = np.zeros((len(page), PATH_DIM + WORD_DIM + RATIOS))
        for i, b in enumerate(page):
            out[i, :PATH_DIM] = self.p["path"][list(b.path)].sum(axis=0)
            out[i, PATH_DIM : PATH_DIM + WORD_DIM] = self.p["word"][_word_ids(b.text)].mean(axis=0)
            out[i, PATH_DIM + WORD_DIM :] = _ratios(b)
        return out

    @staticmethod
    def _pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((max(map(len, rows)), len(rows), rows[0].shape[1]))
        mask = np.zeros(x.shape[:2])
        for i, r in enumerate(rows):
            x[: len(r), i], mask[: len(r), i] = r, 1
        return x, mask

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        h = c = np.zeros((x.shape[1], HIDDEN))
        out, trace = np.zeros((*x.shape[:2], HIDDEN)), []
        w, bias = self.p[f"w{d}"], self.p[f"c{d}"]
        for t in steps:
            z = np.concatenate((x[t], h), axis=1)
            g = z @ w + bias
            s = 1 / (1 + np.exp(-g[:, : 3 * HIDDEN]))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            u = np.tanh(g[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = m * (f * c + i * u) + (1 - m) * c
            e = np.tanh(c2)
            h2 = m * (o * e) + (1 - m) * h
            if keep:
                trace.append((t, z, i, f, o, u, c, e, m))
            h, c = h2, c2
            out[t] = h
        return out, trace

    def logits(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """Of each page's blocks; pages are padded with others of near length."""
        result: list[np.ndarray] = [np.zeros(0)] * len(rows)
        order = sorted((i for i, r in enumerate(rows) if len(r)), key=lambda i: len(rows[i]))
        at = 0
        while at < len(order):
            n = at + 1
            while n < len(order) and n - at < 256 and len(rows[order[n]]) <= 1.2 * len(rows[order[at]]) + 2:
                n += 1
            part = order[at:n]
            x, mask = self._pad([rows[i] for i in part])
            h = np.concatenate([self._run(x, mask, d, False)[0] for d in "fb"], axis=2)
            z = h @ self.p["out"] + x @ self.p["skip"] + self.p["bias"]
            for j, i in enumerate(part):
                result[i] = z[: len(rows[i]), j]
            at = n
        return result

    def gradients(self, pages: list[list[Block]], labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        rows = [self.vectors(p) for p in pages]
        x, mask = self._pad(rows)
        y, _ = self._pad([v[:, None].astype(float) for v in labels])
        y = y[:, :, 0]
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        h = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        z = h @ self.p["out"] + x @ self.p["skip"] + self.p["bias"]
        prob = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        total = mask.sum()
        loss = float(-(mask * (y * np.log(prob + 1e-12) + (1 - y) * np.log(1 - prob + 1e-12))).sum() / total)
        dz = mask * (prob - y) / total
        g = {"out": np.einsum("tb,tbh->h", dz, h), "skip": np.einsum("tb,tbh->h", dz, x), "bias": np.array([dz.sum()])}
        dx = dz[:, :, None] * self.p["skip"]
        dh_all = dz[:, :, None] * self.p["out"]
        for k, d in enumerate("fb"):
            w = self.p[f"w{d}"]
            gw, gc = np.zeros_like(w), np.zeros(4 * HIDDEN)
            dh = np.zeros((x.shape[1], HIDDEN))
            dc = np.zeros_like(dh)
            for t, zt, i, f, o, u, c, e, m in reversed(runs[d][1]):
                dh = dh + dh_all[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                do = dh * m * e
                dc2 = dc + dh * m * o * (1 - e * e)
                di, df, du = dc2 * m * u, dc2 * m * c, dc2 * m * i
                dg = np.concatenate((di * i * (1 - i), df * f * (1 - f), do * o * (1 - o), du * (1 - u * u)), axis=1)
                gw += zt.T @ dg
                gc += dg.sum(axis=0)
                back = dg @ w.T
                dx[t] += back[:, : x.shape[2]]
                dh = back[:, x.shape[2] :] + dh * (1 - m)
                dc = dc2 * (m * f + (1 - m))
            g[f"w{d}"], g[f"c{d}"] = gw, gc
        g["path"], g["word"] = np.zeros_like(self.p["path"]), np.zeros_like(self.p["word"])
        for j, page in enumerate(pages):
            for t, b in enumerate(page):
                np.add.at(g["path"], list(b.path), dx[t, j, :PATH_DIM])
                ids = _word_ids(b.text)
                np.add.at(g["word"], ids, dx[t, j, PATH_DIM : PATH_DIM + WORD_DIM] / len(ids))
        return loss, g

    def main_text(self, pages: list[str | None]) -> list[str]:
        cut = [blocks(p) for p in pages]
        scores = self.logits([self.vectors(b) if b else np.zeros((0, 1)) for b in cut])
        return [" ".join(b.text for b, z in zip(bs, zs, strict=True) if z > 0) for bs, zs in zip(cut, scores, strict=True)]


def synthetic_pages(n: int, seed: int = 5) -> list[tuple[list[Block], np.ndarray]]:
    """Composed pages with the label of each block (1: main text)."""
    r = np.random.default_rng(seed)
    syllables = "an er th in on ti es re or en st ed nd ha ou le ai ch ver der ge ung sch ci os ar ue bo la qu".split()

    def word() -> str:
        return "".join(r.choice(syllables, r.integers(1, 5)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(r.integers(low, high)))

    def sentence() -> str:
        return words(1, 40).capitalize() + "."

    pick = lambda *x: str(x[r.integers(len(x))])

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 4)}</a></li>' for i in range(k))

    def element(opened: str, inner: str) -> str:
        return f"<{opened}>{inner}</{opened.split()[0]}>"

    def boilerplate(inside: bool = False) -> str:
        kind = pick("ad", "aside", "form", "comments", "notice", "related", "share") if inside else pick("nav", "nav", "header", "footer", "footer", "ad", "ad", "aside", "form", "comments", "notice", "related", "share", "menu", "crumbs")
        text = pick(words(1, 12), sentence(), sentence() + " " + sentence())
        if kind == "nav":
            return element(pick("nav", "nav", "nav class=menu"), element("ul", links(r.integers(1, 9))))
        if kind == "menu":
            return element(f'{pick("ul", "div")} class="{pick("menu", "navigation", "navbar", "nav")}"', links(r.integers(1, 6)))
        if kind == "crumbs":
            return element(f'div class="{pick("breadcrumb", "breadcrumbs")}"', f'<a href="/">{word()}</a> {word()}')
        if kind == "header":
            return element(pick("header", "header", "div id=header", "header class=site-header"), pick(element("h1", text), element("p", text), text))
        if kind == "footer":
            return element(pick("footer", "footer", "footer", "div class=footer", "div id=site-footer"), pick(f"&copy; {word()}.example &middot; {text}", element("p", text), text))
        if kind == "aside":
            return element(pick("aside", "aside class=sidebar", "div class=sidebar", "div id=sidebar"), pick(element("h2", words(1, 4)), "") + element("p", text))
        if kind == "form":
            return element(f'form class="{pick("", "search", "newsletter", "login")}"', f"<label>{text}</label>" + element("p", words(1, 5)) + "<input name=q>")
        if kind == "comments":
            return element(f"{pick('div', 'section')} {pick('class=comments', 'id=comments', 'class=comment-list')}", pick(element("h3", words(1, 4)), "") + "".join(element("div class=comment", element("p", sentence())) for _ in range(r.integers(1, 5))))
        label = {"ad": ("ad", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner ad"), "notice": ("cookie", "cookie-notice", "notice", "consent", "alert notice", "cookie-banner"), "related": ("related", "related-posts", "recommended"), "share": ("share", "social", "share-buttons")}[kind]
        return element(f'{pick("div", "div", "section")} {pick("class", "class", "id")}="{pick(*label)}"', pick(element("p", text), text, text))

    def article() -> str:
        out = [f"<h1>{sentence()}</h1>" if r.random() < 0.8 else ""]
        for _ in range(r.integers(1, 14)):
            x = r.random()
            if x < 0.62:
                out.append(element("p", " ".join(sentence() for _ in range(r.integers(1, 6)))))
            elif x < 0.7:
                out.append(f"<p><b>{sentence()}<br>")
            elif x < 0.76:
                out.append(element("h2", words(1, 8)))
            elif x < 0.82:
                out.append(element("ul", "".join(element("li", words(1, 12)) for _ in range(r.integers(1, 5)))))
            elif x < 0.86:
                out.append(element("blockquote", sentence()))
            elif x < 0.9:
                out.append(element("table", "".join(f"<tr><td>{words(1, 4)}</td><td>{word()}</td></tr>" for _ in range(r.integers(1, 4)))))
            elif x < 0.93:
                out.append(element("pre", words(2, 20)))
            elif x < 0.96:
                out.append(element("p", f'{words(1, 6)} <a href="/x">{words(1, 3)}</a> {words(1, 6)}'))
            else:
                out.append("\x00" + boilerplate(True) + "\x01")
        inner = "".join(out)
        if r.random() < 0.15:
            return element("main", element("article", inner))
        return element(pick("article", "article", "article", "article", "main", "article class=post", "div class=content", "div class=article-body", "div class=entry-content", "main id=content", "section class=article"), inner)

    pages = []
    for _ in range(n):
        body = "".join(boilerplate() for _ in range(r.integers(0, 5)))
        end = "".join(boilerplate() for _ in range(r.integers(0, 5)))
        page = f"<!DOCTYPE html><html><head><title>{sentence()}</title></head><body>{body}\x02{article() if r.random() < 0.97 else ''}\x03{end}</body></html>"
        labels, found, main, junk = [], [], False, False
        # The marks lie between elements; they are read off each block's text and taken out.
        for b in blocks(page):
            text = ""
            kept = None
            for ch in b.text:
                if ch in "\x00\x01\x02\x03":
                    main, junk = (ch == "\x02" or (main and ch != "\x03")), (ch == "\x00" or (junk and ch != "\x01"))
                else:
                    if kept is None and ch != " ":
                        kept = main and not junk
                    text += ch
            text = text.strip()
            if text:
                found.append(Block(b.path, text, min(b.linked, len(text))))
                labels.append(bool(kept))
        if found:
            pages.append((found, np.array(labels)))
    return pages


@lru_cache(maxsize=2)
def train_labeller(n: int = 1000, epochs: int = 14, rate: float = 0.01, seed: int = 5) -> Labeller:
    """A model trained on composed pages; the same for the same arguments."""
    data = synthetic_pages(n, seed)
    model = Labeller()
    random = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs):
        order = random.permutation(len(data))
        for at in range(0, len(order), 24):
            part = [data[i] for i in order[at : at + 24]]
            _, g = model.gradients([p for p, _ in part], [y for _, y in part])
            step += 1
            now = rate * (1 - epoch / epochs)
            g["word"] += 1e-4 * model.p["word"]  # invented words mean nothing
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                model.p[k] = model.p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def extract(pages: DataFrame, model: Labeller | None = None, *, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` for every row."""
    model = model or train_labeller()
    small_batches(pages.sparkSession)
    kind, url_kind = pages.schema[key].dataType.simpleString(), pages.schema[url].dataType.simpleString()

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = model.main_text(part.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["key", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).cast("string").alias("page"))
    return rows.mapInArrow(per_chunk(run, 2), f"key {kind}, url {url_kind}, text string, n_chars long").select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")
