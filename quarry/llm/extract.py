"""Main text of web pages by a recurrent block labeller.

A page's leaf blocks, each with a vector of its tag path, hashed words and shape, pass through a bidirectional
LSTM in numpy, so that every block is labelled in the light of the whole page; the blocks labelled as article
are joined. The network is trained here, on pages that a seeded generator lays out with their labels: one of
many containers for the article, and menus, headers, footers, sidebars, notices, adverts, forms and comments
around and inside it.

Defined results: a null or empty page has no blocks and an empty text; repeated rows each get a row; a page is
read whole, however long; other columns of the input are ignored.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.blocks import LAST, PATH, SIZE, WORDS, Block, blocks, features
from quarry.llm.common import map_columns

HIDDEN, PAGES, STEPS, BATCH, RATE, SEED = 16, 2000, 600, 32, 0.01, 11
#: Shares of training pages whose words, and whose texts altogether, are hidden, so that paths must do; weight decay a step.
WORDLESS, TEXTLESS, DECAY = 0.3, 0.5, 1e-3
#: Blocks of several pages that are labelled at once, padding included; a longer page is labelled alone, in pieces.
AT_ONCE, PIECE = 1 << 15, 4096


class Layout:
    """Random pages: pieces of html, each with whether it is article."""

    CONTENT = ("content", "post", "entry content", "article body", "story", "main text", "post-body", "page-content", "")
    SIDE = ("sidebar", "side", "widget", "related", "aside rail", "secondary")
    MENU = ("menu", "nav", "navbar", "navigation", "breadcrumb", "top links", "pagination", "tags", "share social")
    NOTICE = ("cookie notice", "banner", "alert", "consent", "gdpr", "notice", "popup modal", "newsletter", "subscribe")
    AD = ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad")
    COMMENT = ("comments", "comment list", "comment", "discussion", "disqus thread", "responses replies", "reader-comments")
    FOOT = ("footer", "foot", "bottom", "copyright", "site-info", "colophon")

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.letters = self.r.choice(("etaoinshrdlucm", "eéèaêuirstnlq", "enisratdhuüöäß", "aeosrnidlcíóñt", "оеаинтсрвлкмд"))
        self.vocabulary = [self.word() for _ in range(120)]

    def word(self) -> str:
        return "".join(self.r.choice(self.letters) for _ in range(self.r.randint(1, 10)))

    def words(self, least: int, most: int) -> str:
        return " ".join(self.r.choice(self.vocabulary) for _ in range(self.r.randint(least, most)))

    def sentence(self, least: int = 3, most: int = 18) -> str:
        s = self.words(least, most)
        if self.r.random() < 0.5 and " " in s:
            s = s.replace(" ", ", ", 1)
        return s.capitalize() + self.r.choice((".", ".", ".", "!", "?", ""))

    def prose(self) -> str:
        s = " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 2, 3, 5, 8, 16))))
        if self.r.random() < 0.2:
            a = self.words(1, 3)
            s += f' <a href="/x">{a}</a> ' + self.sentence()
        return f"<b>{s}" if self.r.random() < 0.08 else s

    def named(self, tag: str, names: tuple[str, ...], sure: bool = False) -> tuple[str, str]:
        name = self.r.choice(names) if sure or self.r.random() < 0.85 else ""
        kind = self.r.choice(("class", "class", "id"))
        return (f'<{tag} {kind}="{name}">' if name else f"<{tag}>"), f"</{tag}>"

    def links(self, n: int) -> str:
        items = [f'<a href="/{k}">{self.words(1, 3)}</a>' for k in range(n)]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if self.r.random() < 0.7 else " | ".join(items)

    def boilerplate(self, kind: str) -> str:
        r = self.r
        if kind == "menu":
            a, b = ("<nav>", "</nav>") if r.random() < 0.5 else self.named("div", self.MENU, True)
            return a + self.links(r.randint(2, 8)) + b
        if kind == "header":
            a, b = ("<header>", "</header>") if r.random() < 0.7 else self.named("div", ("header", "masthead", "site-header", "branding"), True)
            return a + r.choice((f"<h1>{self.words(1, 3)}</h1>", f"<p>{self.words(1, 6)}</p>", f"<div>{self.sentence()}</div>")) + (self.links(r.randint(2, 6)) if r.random() < 0.5 else "") + b
        if kind == "ad":
            a, b = self.named(r.choice(("div", "div", "aside", "section", "p")), self.AD, True)
            return a + (r.choice(("Advertisement ", "Sponsored ", "")) + self.sentence() if a.startswith("<p") or r.random() < 0.6 else f"<p>{self.sentence()}</p>") + b
        if kind == "notice":
            a, b = self.named(r.choice(("div", "section", "aside")), self.NOTICE, True)
            return a + f"<p>{r.choice(('We use cookies. ', 'Subscribe now. ', ''))}{self.sentence()}</p>" * (r.random() < 0.9) + self.sentence() * (r.random() < 0.3) + (f"<button>{self.words(1, 2)}</button>" if r.random() < 0.6 else "") + b
        if kind == "side":
            a, b = ("<aside>", "</aside>") if r.random() < 0.5 else self.named("div", self.SIDE, True)
            return a + f"<h{(k := r.randint(2, 4))}>{self.words(1, 3)}</h{k}>" * (r.random() < 0.7) + r.choice((self.links(r.randint(2, 6)), f"<p>{self.prose()}</p>", f"<div>{self.sentence()}</div>")) + b
        if kind == "form":
            return f'<form action="/s"><label>{self.words(1, 2)}</label><input name="q"><button>{self.words(1, 1)}</button>' + f"<p>{self.sentence()}</p>" * (r.random() < 0.4) + "</form>"
        if kind == "comments":
            a, b = self.named(r.choice(("div", "section", "ol", "ul")), self.COMMENT, True)
            item = "li" if a[1] in "ou" else r.choice(("div", "article", "p"))
            one = lambda: (f"<{item}>" if item == "p" else self.named(item, self.COMMENT, item == "article")[0]) + (f"{self.prose()}" if item == "p" else f"<span>{self.words(1, 2)}</span><p>{self.prose()}</p>") + f"</{item}>"
            return a + f"<h3>{self.words(1, 2)}</h3>" * (r.random() < 0.6 and a[1] not in "ou") + "".join(one() for _ in range(r.randint(1, 6))) + b
        a, b = ("<footer>", "</footer>") if r.random() < 0.6 else self.named("div", self.FOOT, True)
        return a + r.choice((f"&copy; {self.words(1, 3)} &middot; {self.sentence()}", f"<p>&copy; {self.sentence()}</p>", self.links(r.randint(2, 5)) + f"<p>{self.sentence()}</p>")) + b

    def article(self) -> list[tuple[str, bool]]:
        r = self.r
        head = r.choice(("h1", "h1", "h1", "h2"))
        out = [(f"<{head}>{self.words(2, 10).capitalize()}</{head}>", True)] if r.random() < 0.7 else []
        for _ in range(r.choice((1, 1, 1, 2, 2, 3, 5, 9, 14, 25, 40))):
            kind = r.random()
            if kind < 0.68:
                out.append((f"<p>{self.prose()}" + ("<br>" if r.random() < 0.1 else "</p>"), True))
            elif kind < 0.75:
                out.append((f"<h{(k := r.randint(2, 4))}>{self.words(1, 6).capitalize()}</h{k}>", True))
            elif kind < 0.81:
                out.append(("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(r.randint(1, 5))) + "</ul>", True))
            elif kind < 0.84:
                out.append((f"<blockquote><p>{self.prose()}</p></blockquote>", True))
            elif kind < 0.86:
                out.append((f"<table><tr><th>{self.words(1, 2)}</th><td>{self.words(1, 4)}</td></tr></table>", True))
            elif kind < 0.88:
                out.append((f"<div>{self.prose()}</div>", True))
            else:
                out.append((self.boilerplate(r.choice(("ad", "notice", "side", "form"))), False))
        if r.random() < 0.15:
            out.append((self.boilerplate("comments"), False))
        return out

    def page(self) -> list[tuple[str, bool]]:
        r = self.r
        before = [k for k in ("notice", "header", "menu", "ad", "side", "form", "menu") if r.random() < 0.4]
        after = [k for k in ("ad", "side", "comments", "form", "menu", "notice", "footer", "footer") if r.random() < 0.4]
        out = [(f"<html><head><title>{self.words(2, 9)}</title></head><body>", False)]
        wrap = self.named("div", ("wrapper", "container", "page", "site")) if r.random() < 0.4 else ("", "")
        inner = r.random()
        a, b = ("<article>", "</article>") if inner < 0.4 else ("<main>", "</main>") if inner < 0.55 else self.named(r.choice(("div", "div", "section", "article")), self.CONTENT, True)
        body = [(a, False), *self.article(), (b, False)]
        return out + [(wrap[0], False)] + [(self.boilerplate(k), False) for k in before] + body + [(self.boilerplate(k), False) for k in after] + [(wrap[1] + "</body></html>", False)]


def labelled(seed: int) -> tuple[list[Block], np.ndarray]:
    """A page's blocks and labels: article words carry a mark that is taken away again."""
    pieces = Layout(seed).page()
    # text of article pieces is led by a private-use letter in every block
    marked = "".join(piece if not article else _mark(piece) for piece, article in pieces)
    found = blocks(marked)
    truth = np.array([MARK in b.text for b in found], np.float32)
    return [b._replace(text=b.text.replace(MARK, "") or "x", linked=min(b.linked, max(1, len(b.text.replace(MARK, ""))))) for b in found], truth


#: What is left of a feature vector without its words, and without its text.
WORDLESS_VIEW, PATHS = np.ones(SIZE, np.float32), np.ones(SIZE, np.float32)
WORDLESS_VIEW[PATH + LAST : PATH + LAST + WORDS] = 0
PATHS[PATH + LAST :] = 0
MARK = ""


def _mark(piece: str) -> str:
    out, inside = [], False
    for c in piece:
        inside = True if c == "<" else inside
        out.append(c)
        if c == ">":
            inside = False
            out.append(MARK)
    return "".join(out)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start(seed: int = SEED) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    out: dict[str, np.ndarray] = {}
    for side in "fb":
        out[f"x{side}"] = r.normal(0, 0.1, (SIZE, 4 * HIDDEN)).astype(np.float32)
        out[f"h{side}"] = r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        out[f"c{side}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)  # the forget gate starts open
    return out | {"w": r.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), "o": np.zeros(1, np.float32)}


def forward(x: np.ndarray, p: dict[str, np.ndarray], side: str, keep: bool = False):
    """States of one direction over (time, page, feature); with ``keep``, what the way back needs."""
    z = x @ p[f"x{side}"] + p[f"c{side}"]
    steps, n = x.shape[:2]
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, kept = np.empty((steps, n, HIDDEN), np.float32), []
    for t in range(steps):
        g = z[t] + h @ p[f"h{side}"]
        gates = sigmoid(g[:, : 3 * HIDDEN])
        i, f, o = (gates[:, k * HIDDEN : (k + 1) * HIDDEN] for k in (0, 1, 2))
        u = np.tanh(g[:, 3 * HIDDEN :])
        before = c
        c = f * c + i * u
        tanh = np.tanh(c)
        if keep:
            kept.append((h, before, i, f, o, u, tanh))
        h = o * tanh
        out[t] = h
    return out, kept


def backward(x: np.ndarray, p: dict[str, np.ndarray], side: str, kept: list, dout: np.ndarray) -> dict[str, np.ndarray]:
    steps, n = x.shape[:2]
    dz = np.empty((steps, n, 4 * HIDDEN), np.float32)
    dh_next, dc_next = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    dhh = np.zeros_like(p[f"h{side}"])
    for t in range(steps - 1, -1, -1):
        h, before, i, f, o, u, tanh = kept[t]
        dh = dout[t] + dh_next
        dc = dh * o * (1 - tanh * tanh) + dc_next
        dz[t] = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - u * u)], axis=1)
        dhh += h.T @ dz[t]
        dh_next, dc_next = dz[t] @ p[f"h{side}"].T, dc * f
    flat = dz.reshape(-1, 4 * HIDDEN)
    return {f"x{side}": x.reshape(-1, SIZE).T @ flat, f"h{side}": dhh, f"c{side}": flat.sum(axis=0)}


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(time, page, feature), the same with each page turned round, and the index that turns it back."""
    longest = max(map(len, pages))
    x = np.zeros((longest, len(pages), SIZE), np.float32)
    back = np.zeros((longest, len(pages)), np.int64)
    for k, page in enumerate(pages):
        x[: len(page), k] = page
        back[:, k] = np.concatenate([np.arange(len(page))[::-1], np.arange(len(page), longest)])
    return x, x[back, np.arange(len(pages))], back


@cache
def trained(steps: int = STEPS, seed: int = SEED) -> dict[str, np.ndarray]:
    """The network, by Adam on generated pages; the same each time, made once a process."""
    p = start(seed)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    pool = sorted(((features(b), y) for b, y in (labelled(seed * 100_003 + k) for k in range(PAGES)) if b), key=lambda x: len(x[1]))
    r = np.random.default_rng(seed)
    for step in range(1, steps + 1):
        at = int(r.integers(0, len(pool) - BATCH))  # pages of like length, so that little is padding
        some = pool[at : at + BATCH]
        shown = r.random(len(some))
        x, turned, back = padded([f * (PATHS if s < TEXTLESS else WORDLESS_VIEW if s < TEXTLESS + WORDLESS else 1) for (f, _), s in zip(some, shown, strict=True)])
        page = np.arange(len(some))
        mask, y = np.zeros(x.shape[:2], np.float32), np.zeros(x.shape[:2], np.float32)
        for k, (_, labels) in enumerate(some):
            mask[: len(labels), k], y[: len(labels), k] = 1 / len(labels), labels
        hf, kf = forward(x, p, "f", True)
        hb, kb = forward(turned, p, "b", True)
        both = np.concatenate([hf, hb[back, page]], axis=2)
        d = (sigmoid(both @ p["w"] + p["o"]) - y) * mask / len(some)
        dboth = d[..., None] * p["w"]
        dturned = np.zeros_like(hb)
        dturned[back, page] = dboth[..., HIDDEN:]
        grad = backward(x, p, "f", kf, np.ascontiguousarray(dboth[..., :HIDDEN])) | backward(turned, p, "b", kb, dturned)
        grad |= {"w": np.tensordot(d, both, axes=([0, 1], [0, 1])), "o": np.array([d.sum()], np.float32)}
        rate = RATE * (1 - 0.9 * step / steps)
        for k, g in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] = p[k] * (1 - DECAY * (k[0] in "xh")) - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return p


def projected(found: list[Block], p: dict[str, np.ndarray], sides: str, first: int = 0, last: int | None = None) -> np.ndarray:
    """What the gates of the directions get from the blocks' vectors: (block, gate of each side)."""
    last = len(found) if last is None else last
    weights, offsets = np.concatenate([p[f"x{s}"] for s in sides], axis=1), np.concatenate([p[f"c{s}"] for s in sides])
    return np.concatenate([features(found, at, min(at + PIECE, last)) @ weights + offsets for at in range(first, last, PIECE)])


def run(z: np.ndarray, state: tuple[np.ndarray, np.ndarray], p: dict[str, np.ndarray], side: str) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """What the states of one direction add to the label, over (time, page, gate), and the last state."""
    h, c = state
    w = p["w"][:HIDDEN] if side == "f" else p["w"][HIDDEN:]
    out, kept = np.empty(z.shape[:2], np.float32), p[f"h{side}"]
    for t in range(len(z)):
        g = z[t] + h @ kept
        gates = sigmoid(g[:, : 3 * HIDDEN])
        c = gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * np.tanh(g[:, 3 * HIDDEN :])
        h = gates[:, 2 * HIDDEN :] * np.tanh(c)
        out[t] = h @ w
    return out, (h, c)


def rest(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)


def label_long(found: list[Block], p: dict[str, np.ndarray]) -> np.ndarray:
    """The same for one page in pieces, so that only its blocks are held whole."""
    out, n = np.zeros(len(found), np.float32), len(found)
    for side in "fb":
        state = rest(1)
        for at in range(0, n, PIECE):
            low, high = (at, min(at + PIECE, n)) if side == "f" else (max(0, n - at - PIECE), n - at)
            z = projected(found, p, side, low, high)[:: 1 if side == "f" else -1, None]
            added, state = run(z, state, p, side)
            out[low:high] += added[:: 1 if side == "f" else -1, 0]
    return sigmoid(out + p["o"])


def label(pages: list[list[Block]], p: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The probability of article for each block of each page; pages of like length run abreast."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    while order and len(pages[order[-1]]) > AT_ONCE:
        out[order[-1]] = label_long(pages[order[-1]], p)
        order.pop()
    while order:
        longest = len(pages[order[-1]])
        some = order[-max(1, AT_ONCE // longest) :]
        del order[-len(some) :]
        z = {side: np.zeros((longest, len(some), 4 * HIDDEN), np.float32) for side in "fb"}
        for column, k in enumerate(some):
            own = projected(pages[k], p, "fb")
            z["f"][: len(own), column], z["b"][: len(own), column] = own[:, : 4 * HIDDEN], own[::-1, 4 * HIDDEN :]
        forth, back = (run(z[side], rest(len(some)), p, side)[0] for side in "fb")
        for column, k in enumerate(some):
            n = len(pages[k])
            out[k] = sigmoid(forth[:n, column] + back[:n, column][::-1] + p["o"])
    return out


def main_texts(pages: list[str | None], p: dict[str, np.ndarray]) -> list[str]:
    found = [blocks(page) for page in pages]
    return [" ".join(b.text for b, s in zip(own, score, strict=True) if s >= 0.5) for own, score in zip(found, label(found, p), strict=True)]


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, url, text): the main text of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def make():
        return lambda ids, urls, texts: [ids, urls, main_texts(texts, shared.value)]

    return map_columns(pages.select(F.col(id_col).cast("long"), "url", F.col(html_col)), make, "page_id long, url string, text string", rows=64)


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
