"""Main text of HTML pages by a recurrent block labeller.

A page is cut into leaf blocks (text between block-level tags). Each block is a vector of its whole tag path (hashed tags and
words of class and id), its hashed words, all of them, and a few measures; a bidirectional LSTM reads the page's blocks in order and
labels each as main text or not, so that each label depends on the whole page. The model (NumPy only) is trained on the
driver with a fixed seed on pages written by a template generator, where every block's label is known.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fluxloom.llm.common import id_type, map_batches

PATH_DIMENSIONS, WORD_DIMENSIONS, MEASURES = 256, 24, 8
HIDDEN = 20
TRAINING_PAGES = 1200
EPOCHS = 14
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|noscript|template|iframe|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?:.*?</\1\s*+>|.*\Z)"
    r"|<svg\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:(?<=/)>|>(?:.*?</svg\s*+>|.*\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>|[^<]++|<",
    re.S | re.I,
)
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@functools.lru_cache(100_000)
def _bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % size


class Block:
    __slots__ = ("text", "path", "linked", "tag")

    def __init__(self, text: str, path: np.ndarray, linked: int, tag: str):
        self.text, self.path, self.linked, self.tag = text, path, linked, tag


@functools.lru_cache(20_000)
def _names(tag: str, attributes: str) -> tuple[int, ...]:
    """Buckets of a tag and the words of its class, id and role."""
    words = [tag]
    for m in _NAMED.finditer(attributes):
        words += [w.lower() for w in _NAME_WORD.findall(m[1] or m[2] or m[3] or "")]
    return tuple(_bucket(w, PATH_DIMENSIONS) for w in words)


class _Stack(list):
    """Open tags (tag, buckets), with counts of open tags by name and of the buckets on the path."""

    def __init__(self):
        self.open: Counter[str] = Counter()
        self.path = np.zeros(PATH_DIMENSIONS, np.int64)

    def push(self, tag: str, names: tuple[int, ...]) -> None:
        self.append((tag, names))
        self.open[tag] += 1
        for k in names:
            self.path[k] += 1

    def close_from(self, k: int) -> None:
        while len(self) > k:
            tag, names = self.pop()
            self.open[tag] -= 1
            for j in names:
                self.path[j] -= 1


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order; text with character references decoded and white space as one space."""
    found: list[Block] = []
    stack = _Stack()
    pieces: list[str] = []
    linked = 0

    def end_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                tag = next((t for t, _ in reversed(stack) if t not in _INLINE), "")
                found.append(Block(text, stack.path > 0, linked, tag))
        linked = 0

    for m in _TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            raw = m[0]
            if m[1] is None and (raw[0] != "<" or len(raw) == 1):
                pieces.append(raw)
                if stack.open["a"]:
                    linked += len(raw)
            continue
        tag = tag.lower()
        inline = tag in _INLINE
        if m[2]:
            if not inline:
                end_block()
            for k in range(len(stack) - 1, -1, -1) if stack.open[tag] else ():
                if stack[k][0] == tag:
                    stack.close_from(k)
                    break
                if inline and stack[k][0] not in _INLINE:
                    break
            continue
        if tag in _VOID:
            if tag == "br":
                pieces.append(" ")
            elif not inline and tag != "img":
                end_block()
            continue
        if not inline:
            end_block()
            closes = _CLOSED_BY.get(tag, frozenset()) | {"p"}
            for k in range(len(stack) - 1, -1, -1) if any(stack.open[t] for t in closes) else ():
                t = stack[k][0]
                if t in closes:
                    stack.close_from(k)
                    break
                if t not in _INLINE:
                    break
        if not m[4].rstrip().endswith("/") or tag in ("a", "p", "div"):
            stack.push(tag, _names(tag, m[4] or ""))
    end_block()
    return found


def vectors(found: list[Block]) -> np.ndarray:
    x = np.zeros((len(found), PATH_DIMENSIONS + WORD_DIMENSIONS + MEASURES), np.float32)
    n = max(1, len(found))
    for k, b in enumerate(found):
        row = x[k]
        row[:PATH_DIMENSIONS] = b.path
        row[_bucket("leaf " + b.tag, PATH_DIMENSIONS)] = 1
        words = b.text.lower().split()
        each = 0.15 * min(1.0, 24 / len(words))  # long blocks weigh no more than 24 words do
        row[PATH_DIMENSIONS:-MEASURES] = each * np.bincount([_bucket(w.strip(".,:;!?"), WORD_DIMENSIONS) for w in words], minlength=WORD_DIMENSIONS)
        size = len(b.text)
        row[-MEASURES:] = (np.log1p(size) / 6, min(1.0, b.linked / size), k / n, 1 - k / n, size > 80, b.text[-1] in ".!?", min(n, 100) / 100, 1)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output on both states and the block's own vector."""

    def __init__(self, seed: int = 5, size: int = PATH_DIMENSIONS + WORD_DIMENSIONS + MEASURES, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * np.sqrt(1.5 / shape[0])).astype(np.float32)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p |= {f"x{d}": draw(size, 4 * hidden), f"h{d}": draw(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"c{d}"][hidden : 2 * hidden] = 1
        self.p |= {"o": draw(2 * hidden + size, 1), "z": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States over time for padded pages (time, page, vector)."""
        steps, pages, _ = x.shape
        H, wh = self.hidden, self.p[f"h{d}"]
        pre = x.reshape(steps * pages, -1) @ self.p[f"x{d}"] + self.p[f"c{d}"]
        pre = pre.reshape(steps, pages, 4 * H)
        h, c = np.zeros((pages, H), np.float32), np.zeros((pages, H), np.float32)
        out = np.zeros((steps, pages, H), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = pre[t] + h @ wh
            g = _sigmoid(a[:, : 3 * H])
            i, f, o, u = g[:, :H], g[:, H : 2 * H], g[:, 2 * H :], np.tanh(a[:, 3 * H :])
            m = mask[t][:, None]
            new = f * c + i * u
            th = np.tanh(new)
            if keep is not None:
                keep.append((t, i, f, o, u, c, th, h, m))
            c = np.where(m, new, c)
            h = np.where(m, o * th, h)
            out[t] = h
        return out

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b"), x], axis=2)
        return _sigmoid(both @ self.p["o"] + self.p["z"])[:, :, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x, mask, "f", kept["f"]), self._run(x, mask, "b", kept["b"]), x], axis=2)
        error = (_sigmoid(both @ self.p["o"] + self.p["z"])[:, :, 0] - y) * mask / max(1, mask.sum())
        flat = error.reshape(-1, 1).astype(np.float32)
        g = {"o": both.reshape(len(flat), -1).T @ flat, "z": flat.sum(0)}
        H = self.hidden
        for n, d in enumerate("fb"):
            g[f"h{d}"] = np.zeros_like(self.p[f"h{d}"])
            da_all = np.zeros((*x.shape[:2], 4 * H), np.float32)
            dh = np.zeros((x.shape[1], H), np.float32)
            dc = np.zeros_like(dh)
            weight = self.p["o"][n * H : (n + 1) * H, 0]
            for t, i, f, o, u, c, th, h, m in reversed(kept[d]):
                dh = dh + error[t][:, None] * weight
                go = dh * m
                dn = go * o * (1 - th * th) + dc * m
                da = np.concatenate([dn * u * i * (1 - i), dn * c * f * (1 - f), go * th * o * (1 - o), dn * i * (1 - u * u)], axis=1)
                da_all[t] = da
                g[f"h{d}"] += h.T @ da
                dh = np.where(m, da @ self.p[f"h{d}"].T, dh)
                dc = np.where(m, dn * f, dc)
            flat_a = da_all.reshape(-1, 4 * H)
            g[f"x{d}"] = x.reshape(-1, x.shape[2]).T @ flat_a
            g[f"c{d}"] = flat_a.sum(0)
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.01, batch: int = 20, seed: int = 6) -> "Labeller":
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        turn = 0
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for k in range(0, len(order), batch):
                x, mask, y = pad([pages[j] for j in order[k : k + batch]])
                turn += 1
                step = rate * (1 - epoch / epochs)
                for name, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.99 * second[name] + 0.01 * g * g
                    self.p[name] -= (step * first[name] / (1 - 0.9**turn) / (np.sqrt(second[name] / (1 - 0.99**turn)) + 1e-6)).astype(np.float32)
        return self


def pad(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(1, max(len(x) for x, _ in pages))
    out = np.zeros((steps, len(pages), pages[0][0].shape[1]), np.float32)
    mask, labels = np.zeros((steps, len(pages)), bool), np.zeros((steps, len(pages)), np.float32)
    for k, (x, y) in enumerate(pages):
        out[: len(x), k], mask[: len(x), k], labels[: len(x), k] = x, True, y
    return out, mask, labels


def training_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page in one of many layouts and the texts of its main blocks."""
    syllables = "an ti re lo mas ver ine que sch er ou la don ta mi ge po".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    text = lambda a, b, end=".": " ".join(word() for _ in range(rng.randint(a, b))).capitalize() + end
    link = lambda: f'<a href="/{word()}">{text(1, 3, "")}</a>'
    main: set[str] = set()

    def mine(tag: str, t: str, inner: str | None = None) -> str:
        main.add(t)
        return f"<{tag}>{inner or t}</{tag}>"

    def paragraph() -> str:
        t = text(*rng.choice([(2, 8), (8, 40), (30, 120)]))
        main.add(t)
        r = rng.random()
        if r < 0.15:
            return f"<p><b>{t}<br>"  # never closed
        if r < 0.3:
            a, _, b = t.partition(" ")
            return f'<p>{a} <a href="/{word()}">{b}</a></p>' if rng.random() < 0.3 else f"<p><em>{a}</em> {b}</p>"
        return f"<p>{t}" if r < 0.4 else f"<p>{t}</p>"

    def in_article() -> str:
        r = rng.random()
        if r < 0.72:
            return paragraph()
        if r < 0.8:
            return mine(rng.choice(["h2", "h3"]), text(1, 7, ""))
        if r < 0.86:
            return "<ul>" + "".join(mine("li", text(2, 14)) for _ in range(rng.randint(2, 5))) + "</ul>"
        if r < 0.9:
            return "<blockquote>" + paragraph() + "</p></blockquote>"
        if r < 0.93:
            return "<table><tr>" + mine("th", text(1, 3, "")) + mine("td", text(1, 4, "")) + "</tr></table>"
        return noise(rng.choice(["ad", "share", "form", "related", "notice"]))

    def deep(inner: str) -> str:
        depth = rng.choice([0, 0, 0, 1, 2, 5, 12, 16])
        return "".join(f'<div class="{rng.choice(["row", "col", "inner", "box", "grid", word()])}">' for _ in range(depth)) + inner + "</div>" * depth

    def noise(kind: str) -> str:
        lines = deep("".join(f"<p>{text(*rng.choice([(2, 8), (8, 60)]))}</p>" for _ in range(rng.randint(1, 3))))
        short = text(3, 16)
        name = lambda *names: rng.choice(names)
        closed = lambda tag, inner: f"<{tag}>{inner}</{tag.split()[0]}>"
        if kind == "nav":
            items = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 9)))
            return rng.choice([f"<nav><ul>{items}</ul></nav>", f'<div class="{name("menu", "nav", "navbar", "navigation", "breadcrumbs")}"><ul>{items}</ul></div>', f'<ul id="menu">{items}</ul>', f"<nav>{' '.join(link() for _ in range(4))}</nav>"])
        if kind == "header":
            return closed(name("header", "div class=header", "div id=header", "div class=masthead", "div class=banner"), f"<h1>{text(1, 4, '')}</h1><p>{short}</p>")
        if kind == "footer":
            return rng.choice([f"<footer>&copy; {word()} &middot; {short}</footer>", f'<div class="{name("footer", "site-footer", "copyright")}">{lines}&copy; 2024</div>', f'<footer class="footer"><ul><li>{link()}</li></ul><p>{short}</p></footer>'])
        if kind == "ad":
            return closed(name("div", "aside", "section") + f' class="{name("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner")}"', name(short, lines))
        if kind == "aside":
            return rng.choice([f"<aside>{lines}</aside>", f'<div class="{name("sidebar", "widget", "related", "aside")}"><h3>{text(1, 4, "")}</h3>{lines}<ul><li>{link()}</li></ul></div>', f'<aside class="sidebar"><h4>{text(1, 3, "")}</h4><ul><li>{link()}</li><li>{link()}</li></ul></aside>'])
        if kind == "notice":
            return f'<div {name("class", "id")}="{name("notice", "cookie", "cookies", "cookie-notice", "consent", "alert", "popup", "newsletter")}">{name(short, lines)}<button>{text(1, 2, "")}</button></div>'
        if kind == "form":
            return f'<form action="/{word()}"><label>{text(1, 4, "")}</label><input type="text"><p>{short}</p><select><option>{word()}</option><option>{word()}</option></select><button>{text(1, 2, "")}</button></form>'
        if kind == "share":
            return f'<div class="{name("share", "social", "tags", "sharing")}">{link()} {link()} {short}</div>'
        if kind == "related":
            return f'<div class="{name("related", "more", "recommended")}"><h3>{text(1, 4, "")}</h3><ul><li>{link()}</li><li>{link()}</li></ul></div>'
        each = lambda: closed(name("div", "li", "article") + f' class="{name("comment", "reply", "comment-body")}"', f"<b>{word()}</b><p>{text(3, 50)}</p>")
        inside = f"<h2>{text(1, 3, '')}</h2>" + deep("".join(each() for _ in range(rng.randint(1, 5))))
        return closed(name("section", "div") + f' {name("class", "id")}="{name("comments", "comment-list", "responses", "discussion", "comments-area")}"', inside)

    head, tail = [], []
    for kind, p in (("notice", 0.3), ("header", 0.4), ("nav", 0.8), ("ad", 0.5), ("aside", 0.25), ("form", 0.15)):
        if rng.random() < p:
            head.append(noise(kind))
    for kind, p in (("share", 0.2), ("form", 0.2), ("related", 0.25), ("comments", 0.45), ("aside", 0.35), ("ad", 0.2), ("nav", 0.15), ("notice", 0.15), ("footer", 0.85)):
        if rng.random() < p:
            tail.append(noise(kind))
    if rng.random() < 0.3:
        rng.shuffle(head)
    wrap = rng.choice(["article", "article", "article", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="article-body"', 'div class="entry-content"', 'section class="story"', 'div class="main-text"', 'article class="post"'])
    title = mine("h1", text(2, 10, rng.choice(["", "."]))) if rng.random() < 0.8 else ""
    body = title + "".join(in_article() for _ in range(rng.randint(1, 12)))
    core = deep(f"<{wrap}>{deep(body)}</{wrap.split()[0]}>")
    if rng.random() < 0.25:
        core = f"<main>{core}{noise('comments') if rng.random() < 0.3 else ''}</main>"
    inside = "".join(head) + core + "".join(tail)
    if rng.random() < 0.3:
        inside = f'<div class="{rng.choice(["page", "wrapper", "container", "site"])}">{inside}</div>'
    script = '<script>var t="</p>";</script>' if rng.random() < 0.5 else ""
    return f"<!DOCTYPE html><html><head><title>{text(1, 5)}</title><style>p{{margin:0}}</style>{script}</head><body>{inside}</body></html>", main


@functools.lru_cache(1)
def trained(pages: int = TRAINING_PAGES, seed: int = 11) -> Labeller:
    rng = random.Random(seed)
    made = []
    for _ in range(pages):
        page, main = training_page(rng)
        found = blocks(page)
        made.append((vectors(found), np.array([b.text in main for b in found], np.float32)))
    return Labeller().fit(made)


def main_text(labeller: Labeller, pages: list[str]) -> list[str]:
    """The main blocks of each page, joined by one space. Pages of like length are read together."""
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if found[k]), key=lambda k: len(found[k]))
    k = 0
    while k < len(order):
        group, steps = [], 0
        while k < len(order) and (not group or (len(group) < 128 and len(found[order[k]]) * (len(group) + 1) <= 20_000)):
            group.append(order[k])
            k += 1
        x, mask, _ = pad([(vectors(found[j]), np.zeros(len(found[j]), np.float32)) for j in group])
        p = labeller.probabilities(x, mask)
        for column, j in enumerate(group):
            out[j] = " ".join(b.text for b, q in zip(found[j], p[:, column]) if q >= 0.5)
    return out


def extract(pages: DataFrame, labeller: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars. Null, empty and text-free pages have an empty text; broken markup is read as
    far as it goes; nothing is cut. Rows that repeat are read each, ids and URLs may be null, other columns are not read. An empty table
    gives no rows."""
    box = pages.sparkSession.sparkContext.broadcast(labeller or trained())

    def make():
        model = box.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts: list[str] = []
            for k in range(0, batch.num_rows, 512):
                texts += main_text(model, [x.as_py() or "" for x in batch.column(2).slice(k, 512)])
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return step

    rows = pages.selectExpr(f"`{id_col}` AS page_id", f"cast(`{url_col}` AS string) AS url", f"cast(`{html_col}` AS string) AS html")
    return map_batches(rows, make, f"page_id {id_type(rows, 'page_id')}, url string, text string, n_chars long")
