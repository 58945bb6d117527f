"""Main-text extraction by a recurrent block labeller.

A page is cut into its leaf blocks.  Every block is read as a vector: its tag path (names, class and id
words of all open elements, hashed), its hashed words, and a few shares (length, links, place).  A numpy
bidirectional LSTM runs over all blocks of the page and labels each from the context of the whole
document.  It is trained here, on pages made by a small grammar of site layouts with known labels, so no
outside data and no sample of the corpus is needed.  A third of these pages have no names at all: bare text,
line breaks, unclosed or deeply nested elements, with or without menus, related links and buttons.
"""

from __future__ import annotations

import html
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm.hashing import LOWER, Prefix, join_texts

PATH, WORD, EXTRA = 48, 12, 8
INPUT = PATH + WORD + EXTRA
HIDDEN = 24
#: Elements without displayed text of their own, skipped with all they hold.
HIDDEN_TAGS = {"script", "style", "head", "title", "noscript", "template", "svg", "math", "iframe", "object", "select", "textarea"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Elements that do not end a block.
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
CLOSES_P = {"p", "div", "ul", "ol", "li", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "aside", "form", "blockquote", "pre", "main", "figure", "hr", "dl", "fieldset", "address", "details"}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<([/]?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN_STYLE = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
SPLIT = re.compile(r"[^a-zA-Z]+")

_vectors: dict[tuple[str, int], np.ndarray] = {}


def hashed(word: str, size: int) -> np.ndarray:
    """A fixed random unit vector of a word."""
    got = _vectors.get((word, size))
    if got is None:
        if len(_vectors) > 200_000:
            _vectors.clear()
        got = np.random.default_rng(zlib.crc32(f"{size}:{word}".encode())).standard_normal(size).astype(np.float32)
        got = _vectors[word, size] = got / np.linalg.norm(got)
    return got


def path_vector(tag: str, attributes: str) -> np.ndarray:
    """The vector of one open element."""
    key = (tag + "|" + attributes if attributes else tag, -PATH)
    got = _vectors.get(key)
    if got is None:
        got = 0.5 * hashed("<" + tag, PATH)
        for m in NAMES.finditer(attributes):
            for w in SPLIT.split((m[1] or m[2] or m[3] or "").lower()):
                if w:
                    got = got + hashed(w, PATH)
        if len(_vectors) < 200_000:
            _vectors[key] = got
    return got


def blocks_of(page: str) -> tuple[list[str], list[np.ndarray], list[float]]:
    """The texts of a page's blocks in order, their path vectors and their shares of link text."""
    texts, paths, links = [], [], []
    stack: list[tuple[str, np.ndarray]] = [("", np.zeros(PATH, np.float32))]
    part: list[str] = []
    linked, in_link, hidden = 0, 0, 0

    def close_block():
        nonlocal linked
        if part:
            text = " ".join(html.unescape("".join(part)).split())
            part.clear()
            if text:
                texts.append(text)
                paths.append(stack[-1][1])
                links.append(min(1.0, linked / len(text)))
            linked = 0

    def pop_to(depth: int):
        nonlocal hidden
        while len(stack) > depth:
            hidden -= stack.pop()[0] in HIDDEN_TAGS

    at, end = 0, len(page)
    open_at: dict[str, list[int]] = {}
    while at < end:
        m = TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at and not hidden:
            piece = page[at:stop]
            part.append(piece)
            if in_link:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = bool(m[1])
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            continue
        close_block()
        if tag in VOID:
            continue
        if closing:
            places = open_at.get(tag)
            while places and (places[-1] >= len(stack) or stack[places[-1]][0] != tag):
                places.pop()
            if places:
                pop_to(places.pop())
                in_link = 0
            continue
        if tag in CLOSES_P and stack[-1][0] == "p" or tag == "li" and stack[-1][0] == "li":
            pop_to(len(stack) - 1)
        attributes = m[3].rstrip("/")
        name = "template" if HIDDEN_STYLE.search(attributes) else tag
        open_at.setdefault(tag if name == tag else name, []).append(len(stack))
        if name != tag:  # a hidden element is closed by its own tag
            open_at.setdefault(tag, []).append(len(stack))
        stack.append((tag, 0.8 * stack[-1][1] + path_vector(tag, attributes)))
        hidden += tag in HIDDEN_TAGS
        if tag in RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = close.start() if close else end
    close_block()
    return texts, paths, links


_words = np.random.default_rng(3).standard_normal((4096, WORD)).astype(np.float32) / WORD**0.5
_between = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])  # bytes that separate words


def word_vectors(texts: list[str]) -> np.ndarray:
    """For each text the sum of its hashed words' vectors over the root of their number, of length 2 at most (one word over and over)."""
    data, starts = join_texts([t.encode("utf-8", "surrogatepass") for t in texts])
    data = LOWER[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _between[data], [True]]).astype(np.int8)))
    first, last = edge[0::2], edge[1::2]
    row = np.searchsorted(starts, first, "right") - 1
    v = _words[(Prefix(data).runs(first, last) % np.uint64(len(_words))).astype(np.int64)]
    count = np.maximum(np.bincount(row, minlength=len(texts)), 1)
    out = np.stack([np.bincount(row, v[:, k], len(texts)) for k in range(WORD)], axis=1) / np.sqrt(count)[:, None]
    return out * np.minimum(1, 2 / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9))


def block_inputs(pages: list[tuple[list[str], list[np.ndarray], list[float]]]) -> list[np.ndarray]:
    """The input vectors of the blocks of each page."""
    texts = [t for p in pages for t in p[0]]
    if not texts:
        return [np.zeros((0, INPUT), np.float32) for _ in pages]
    n = np.array([len(p[0]) for p in pages])
    ends = np.cumsum(n)
    place = np.arange(len(texts)) - np.repeat(ends - n, n)
    of = np.repeat(n, n)
    size = np.fromiter(map(len, texts), np.float64, len(texts))
    x = np.zeros((len(texts), INPUT), np.float32)
    x[:, :PATH] = [v for p in pages for v in p[1]]
    x[:, PATH : PATH + WORD] = word_vectors(texts)
    blanks = np.fromiter((t.count(" ") for t in texts), np.float64, len(texts))
    stops = np.fromiter((t[-1] in ".!?\"" for t in texts), np.float64, len(texts))
    links = np.fromiter((v for p in pages for v in p[2]), np.float64, len(texts))
    x[:, PATH + WORD :] = np.stack([np.minimum(2.0, np.log1p(size) / 4), links, np.minimum(1.0, size / 400), place / of, place == 0, place == of - 1, blanks / size * 4, stops], axis=1)
    return np.split(x, ends[:-1])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one output for each block."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        s = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"x{d}": s(INPUT, 4 * HIDDEN), f"h{d}": s(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32), f"o{d}": s(HIDDEN, 1)}
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1
        self.p |= {"ox": 0.1 * s(INPUT, 1), "oc": np.zeros(1, np.float32)}

    def direction(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States over time of (time, page, input); padding passes the state on."""
        steps, pages, _ = x.shape
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        inputs = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        out, saved = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = inputs[t] + h @ self.p[f"h{d}"]
            i, f, o = (sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            live = mask[t][:, None]
            if keep:
                saved.append((t, h, c, i, f, o, g, new))
            c = np.where(live, new, c)
            h = np.where(live, o * np.tanh(new), h)
            out[t] = h
        return out, saved

    def scores(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, sf = self.direction(x, mask, "f", keep)
        b, sb = self.direction(x, mask, "b", keep)
        z = (f @ self.p["of"] + b @ self.p["ob"] + x @ self.p["ox"] + self.p["oc"])[:, :, 0]
        return z, (f, b, sf, sb)

    def gradients(self, x, mask, y):
        z, (f, b, sf, sb) = self.scores(x, mask, True)
        dz = ((sigmoid(z) - y) * mask / mask.sum())[:, :, None].astype(np.float32)
        g = {"of": np.einsum("tph,tpo->ho", f, dz), "ob": np.einsum("tph,tpo->ho", b, dz), "ox": np.einsum("tph,tpo->ho", x, dz), "oc": dz.sum(axis=(0, 1))}
        for d, saved in (("f", sf), ("b", sb)):
            out = dz @ self.p[f"o{d}"].T
            dh, dc = np.zeros_like(out[0]), np.zeros_like(out[0])
            g |= {f"x{d}": np.zeros_like(self.p[f"x{d}"]), f"h{d}": np.zeros_like(self.p[f"h{d}"]), f"c{d}": np.zeros_like(self.p[f"c{d}"])}
            for t, h, c, i, fo, o, gg, new in reversed(saved):
                live = mask[t][:, None]
                up = dh + out[t]
                th = np.tanh(new)
                dn = np.where(live, dc + up * o * (1 - th * th), 0)
                gates = np.concatenate([dn * gg * i * (1 - i), dn * c * fo * (1 - fo), np.where(live, up * th, 0) * o * (1 - o), dn * i * (1 - gg * gg)], axis=1)
                g[f"x{d}"] += x[t].T @ gates
                g[f"h{d}"] += h.T @ gates
                g[f"c{d}"] += gates.sum(axis=0)
                dh = np.where(live, gates @ self.p[f"h{d}"].T, up)
                dc = np.where(live, dn * fo, dc)
        return g

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, size: int = 32, rate: float = 0.01, seed: int = 2):
        """Adam over batches of (inputs, labels) in a fixed order."""
        rng = np.random.default_rng(seed)
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for epoch in range(epochs):
            now = rate * 0.6 ** max(0, epoch - epochs // 2)  # smaller steps towards the end
            order = rng.permutation(len(pages))
            for at in range(0, len(order), size):
                some = [pages[i] for i in order[at : at + size]]
                x, mask = padded([a for a, _ in some])
                y = np.zeros(mask.shape, np.float32)
                for k, (_, b) in enumerate(some):
                    y[: len(b), k] = b
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def label(self, inputs: list[np.ndarray], size: int = 64) -> list[np.ndarray]:
        """Whether each block of each page is main text; pages of like length are run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(inputs)
        order = sorted(range(len(inputs)), key=lambda i: len(inputs[i]))
        at = 0
        while at < len(order):
            some = order[at : at + max(1, min(size, 20_000 // max(1, len(inputs[order[min(at + size, len(order)) - 1]]))))]
            at += len(some)
            if len(inputs[some[-1]]):
                x, mask = padded([inputs[i] for i in some])
                z, _ = self.scores(x, mask)
                for k, i in enumerate(some):
                    out[i] = z[: len(inputs[i]), k] > 0
        return out


def padded(inputs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, inputs))
    x = np.zeros((steps, len(inputs), INPUT), np.float32)
    mask = np.zeros((steps, len(inputs)), bool)
    for k, a in enumerate(inputs):
        x[: len(a), k] = a
        mask[: len(a), k] = True
    return x, mask


def made_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page of the training grammar and whether each of its blocks is main text."""
    syllables = [rng.choice("bcdfglmnprst") + rng.choice("aeiouéüñ") for _ in range(30)]
    labels: list[bool] = []

    def words(lo, hi, end="."):
        text = " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(lo, hi)))
        kind = rng.random()
        if kind < 0.1:
            text = text.upper().replace(" ", "!! ")
        elif kind < 0.2:
            text = " | ".join(text.split())
        elif kind < 0.3:
            text = " ".join(w + rng.choice(("***", "%%%", "$$$", "&amp;&amp;")) for w in text.split())
        return text.capitalize() + (end if rng.random() < 0.8 else "")

    def block(text, main):
        labels.append(main)
        return text

    def lots(f, lo, hi):
        return "".join(f() for _ in range(rng.randint(lo, hi)))

    def bare(lo, hi):
        """Side text, with or without paragraphs of its own."""
        return block(words(lo, hi), False) if rng.random() < 0.4 else lots(lambda: block(f"<p>{words(lo, hi)}</p>", False), 1, 2)

    link = lambda: block(f"<li><a href='/x'>{words(1, 3, '')}</a></li>", False)
    pick = rng.choice
    name = lambda *options: pick(("class", "class", "id")) + f'="{pick(options)}"'

    def nav():
        kind = rng.random()
        if kind < 0.5:
            return f"<nav><ul>{lots(link, 2, 8)}</ul></nav>"
        return f"<{(t := pick(('div', 'ul', 'nav')))} {name('menu', 'nav', 'navbar', 'main-menu', 'navigation', 'breadcrumb', 'breadcrumbs', 'topnav', 'pagination', 'tags')}>{lots(link, 2, 8)}</{t}>"

    def header():
        return pick(("<header>{}</header>", '<div id="header">{}</div>', '<div class="site-header masthead">{}</div>', '<header class="banner top">{}</header>')).format(lots(lambda: block(f"<{(t := pick(('h1', 'p', 'div', 'a')))}>{words(1, 6, '')}</{t}><br>", False), 1, 2))

    def footer():
        return pick(("<footer>{}</footer>", '<div id="footer">{}</div>', '<div class="site-footer copyright legal">{}</div>')).format(block(f"&copy; {words(1, 14)}", False) if rng.random() < 0.3 else lots(lambda: block(f"<p>&copy; {words(2, 14)}</p>", False), 1, 3))

    def advert():
        return f"<{(t := pick(('div', 'aside', 'section')))} {name('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner-ad', 'ad-slot', 'promotion', 'sponsor')}>{bare(2, 25)}</{t}>"

    def sidebar():
        return pick(("<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="sidebar" class="widget">{}</div>', '<aside class="related">{}</aside>', '<div class="related-posts recommended">{}</div>', '<div class="share social newsletter">{}</div>')).format(block(f"<h3>{words(1, 4, '')}</h3>", False) + lots(lambda: block(f"<p>{words(2, 30)}</p>", False) if rng.random() < 0.6 else link(), 1, 4))

    def notice():
        return f"<{(t := pick(('div', 'section')))} {name('cookie', 'cookie-notice', 'notice', 'cookies consent', 'gdpr', 'alert', 'modal popup', 'disclaimer', 'subscribe', 'paywall')}>{bare(4, 25)}</{t}>"

    def form():
        return f"<form action='/s' {name('search', 'login', 'signup', 'subscribe')}>{block(f'<label>{words(1, 6)}</label>', False)}<input name='q'></form>"

    def comments():
        one = lambda: block(f"<div {name('comment', 'reply', 'comment-body')}>{words(3, 40)}</div>", False)
        return pick(('<section id="comments">{}</section>', '<div class="comments">{}</div>', '<ol class="comment-list discussion">{}</ol>', '<section class="comments responses">{}</section>')).format((block(f"<h2>{words(1, 3, '')}</h2>", False) if rng.random() < 0.5 else "") + lots(one, 1, 5))

    def related():
        item = lambda: block(f"<li><a href='/r'>{words(2, 9, '')}</a></li>", False)
        head = block(f"<{(t := pick(('h3', 'h4', 'p', 'strong')))}>{words(1, 4, '')}</{t}>" if rng.random() < 0.5 else f"<p>{words(2, 15)}</p>", False)
        return f"<{(t := pick(('aside', 'aside', 'div')))} {name('related', 'related-links', 'see-also', 'recommended', 'more')}>{head}{'<ul>' + lots(item, 1, 4) + '</ul>' if rng.random() < 0.6 else ''}</{t}>"

    def button():
        return block(f"<button{pick(('', ' type=submit', ' class=btn'))}>{words(1, 4, '')}</button>", False)

    def plain_body():
        """Main text without names: bare text, line breaks, nested or unclosed elements."""
        kind = rng.random()
        some = lambda: words(1, 40) if rng.random() < 0.5 else words(1, 6)
        inline = lambda t: t if rng.random() < 0.6 else f"{t} <{(i := pick(('b', 'i', 'em', 'span', 'code')))}>{words(1, 3, '')}</{i}> {words(1, 4)}"
        count = rng.choice((1, 1, 2, 2, 3, 5, 9))
        if kind < 0.12:
            return block(inline(some()), True)
        if kind < 0.15:
            return f"<p>{block(some(), True)} {button()} {block(words(1, 8), True)}</p>"
        if kind < 0.3:
            return "<br>".join(block(inline(some()), True) for _ in range(count))
        if kind < 0.45:
            return "".join(f"<p>{block(inline(some()), True)}" for _ in range(count))
        tag = pick(("p", "p", "div", "section", "span-div"))
        tag = "div" if tag == "span-div" else tag
        parts = [f"<{tag}{pick(('', '', ' class=x', ' style=\"margin:0\"', f' class=\"{pick(syllables)}{pick(syllables)}\"'))}>{block(inline(some()), True)}</{tag}>" for _ in range(count)]
        if rng.random() < 0.3:
            parts.insert(0, f"<{(t := pick(('h1', 'h2', 'h3')))}>{words(1, 8, '')}</{t}>")
            labels.insert(len(labels) - count, True)
        return "".join(parts)

    def plain_page():
        menu = nav() if rng.random() < 0.3 else ""  # labels are noted in page order
        out = plain_body()
        if rng.random() < 0.25:
            out += related() if rng.random() < 0.7 else button()
            out += plain_body() if rng.random() < 0.5 else ""
        for _ in range(rng.choice((0, 0, 1, 2, 3, 6))):
            out = f"<{(t := pick(('div', 'div', 'div', 'section', 'main', 'article', 'center')))}{pick(('', '', f' class=\"{pick(syllables)}\"', ' class=\"row\"', ' id=\"a1\"'))}>{out}</{t}>"
        out = menu + out
        if rng.random() < 0.3:
            out += footer()
        kind = rng.random()
        if kind < 0.4:
            return out
        return f"<html>{'<head><title>' + words(1, 4) + '</title></head>' if kind < 0.8 else ''}<body>{out}</body></html>"

    def body():
        out = block(f"<h1>{words(2, 10, '')}</h1>", True) if rng.random() < 0.85 else ""
        for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 14))):
            r = rng.random()
            if r < 0.03:
                out += "<br>".join(block(words(1, 20), True) for _ in range(rng.randint(1, 3))) + "<hr>"
            elif r < 0.72:
                t = words(1, 70)
                out += block(f"<p>{t}</p>" if rng.random() < 0.7 else f"<p><b>{t}<br>", True)
            elif r < 0.8:
                out += f"<h2>{block(words(1, 6, ''), True)}</h2>"
            elif r < 0.87:
                out += "<ul>" + lots(lambda: block(f"<li>{words(1, 15)}</li>", True), 1, 4) + "</ul>"
            elif r < 0.92:
                out += f"<blockquote>{block(words(3, 30), True)}</blockquote>"
            elif r < 0.95:
                out += "<table><tr>" + lots(lambda: block(f"<td>{words(1, 6, '')}</td>", True), 1, 4) + "</tr></table>"
            elif r < 0.965:
                out += advert()
            elif r < 0.98:
                out += related()
            elif r < 0.985:
                out += button()
            else:
                out += sidebar()
        return out

    def article():
        shell = pick(("<article>{}</article>",) * 4 + ("<main><article>{}</article></main>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="content"><div class="post entry">{}</div></div>', '<div class="article-body story">{}</div>', '<section class="post-content">{}</section>', '<div id="main"><div class="text">{}</div></div>', "<div>{}</div>", "<article class='post'><div class='body'>{}</div></article>"))
        return shell.format(body())

    if rng.random() < 0.3:
        return plain_page(), labels
    top = [f for f, chance in ((header, 0.4), (nav, 0.85), (notice, 0.25), (form, 0.2), (advert, 0.5)) if rng.random() < chance]
    rng.shuffle(top)
    bottom = [f for f, chance in ((comments, 0.35), (sidebar, 0.4), (advert, 0.2), (nav, 0.15), (notice, 0.1), (form, 0.1)) if rng.random() < chance]
    rng.shuffle(bottom)
    parts = [f() for f in top]
    if rng.random() < 0.97:
        parts.append(article())
    parts += [f() for f in bottom]
    if rng.random() < 0.85:
        parts.append(footer())
    if rng.random() < 0.25:
        parts = ['<div class="wrapper page container">', *parts, "</div>"]
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><script>var t='</p>';</script></head><body>{''.join(parts)}</body></html>", labels


_trained: list[Labeller] = []


def trained(pages: int = 6_000, seed: int = 11) -> Labeller:
    """The labeller, trained once in a process on pages of the grammar."""
    if not _trained:
        rng = random.Random(seed)
        data = []
        while len(data) < pages:
            page, labels = made_page(rng)
            texts, paths, links = blocks_of(page)
            if texts and len(texts) == len(labels):
                data.append(((texts, paths, links), np.array(labels, np.float32)))
        labeller = Labeller()
        labeller.train(list(zip(block_inputs([b for b, _ in data]), [y for _, y in data])))
        _trained.append(labeller)
    return _trained[0]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_main of every row.

    A NULL or empty html, or one without main text, has an empty text.  Rows that repeat a page_id are
    read each; an empty table gives no rows.  One pass without a shuffle.
    """
    model = pages.sparkSession.sparkContext.broadcast(trained().p)

    def run(batches):
        labeller = Labeller()
        labeller.p = model.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                blocks = [blocks_of(h or "") for h in some.column("html").to_pylist()]
                main = labeller.label(block_inputs(blocks))
                texts = [" ".join(t for t, keep in zip(x[0], m) if keep) for x, m in zip(blocks, main)]
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(x[0]) for x in blocks], pa.int64()), pa.array([int(m.sum()) for m in main], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_main of every page; a NULL or empty html has an empty text, repeated rows are read each."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
