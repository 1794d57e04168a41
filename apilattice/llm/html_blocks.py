"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks: text between block-level tags, without scripts,
styles and comments.  A block's vector holds its hashed tag path (tags, and the words of
class, id and role, of all open elements), its hashed words, and a few figures (length, link
share, place).  A bidirectional LSTM in numpy reads the whole sequence, so that every block is
labelled with the document around it; blocks labelled main are joined in page order.

The labeller is trained here, on pages that this module generates: articles of paragraphs,
headings, lists, tables, definitions, quotations, code and figures, in semantic tags, in
nameless boxes, in layout tables or bare in the body, among menus, headers, footers, sidebars,
notices, adverts, forms and reader comments, in words drawn anew for each page.  Training is
seeded, so reruns agree.

Character references are decoded, white space inside a block becomes one space.  Null and
empty html give an empty text, broken markup is read as far as it goes, nothing is cut.
Repeated rows stay; other columns are ignored.  Markup is read in linear time however deep it
nests, and a page of more than ``MOST_BLOCKS`` blocks is labelled in pieces that hand the
LSTM's state on, with the same result: beyond its text a page takes bounded memory.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apilattice.llm.shingles import slices, words
from apilattice.llm.staging import small_batches

PATH_DIM, LEAF_DIM, WORD_DIM, FIGURES, HIDDEN = 224, 64, 32, 8, 24
PATHS = PATH_DIM + LEAF_DIM
DIM = PATHS + WORD_DIM + FIGURES
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg".split())
#: Blocks whose vectors are held at once.
MOST_BLOCKS = 20_000
#: An opening tag ends open elements of the same list, up to the nearest of the second.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?=>|\Z)|[^>]*+))(?:>|\Z)""", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PART = re.compile(r"[a-z]+")


class _Paths:
    """Vectors of tag paths by number; paths of equal vectors share one.  One for each batch."""

    def __init__(self) -> None:
        self.of: dict[tuple, int] = {}
        self.vectors = [np.zeros(PATHS, np.float32)]
        self.numbers = {self.vectors[0].tobytes(): 0}

    def below(self, parent: int, tag: str, attributes: str) -> int:
        names = (f"<{tag}", *(w for v in NAMED.findall(attributes) for w in PART.findall(v.lower()))) if attributes else (f"<{tag}",)
        key = (parent, names)
        if key not in self.of:
            vector = self.vectors[parent].copy()
            vector[PATH_DIM:] = 0
            for name in names:
                code = crc32(name.encode())
                vector[code % PATH_DIM] = vector[(code >> 16) % PATH_DIM] = vector[PATH_DIM + code % LEAF_DIM] = 1
            self.of[key] = self.numbers.setdefault(vector.tobytes(), len(self.vectors))
            if self.of[key] == len(self.vectors):
                self.vectors.append(vector)
        return self.of[key]


class _Open:
    """The open elements; finding the nearest of a name and closing up to it take no longer than what closes."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.at: dict[str, list[int]] = {}

    def top(self) -> tuple[str, int]:
        return self.stack[-1] if self.stack else ("", 0)

    def push(self, tag: str, path: int) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, path))

    def nearest(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def close(self, place: int) -> None:
        while len(self.stack) > place:
            self.at[self.stack.pop()[0]].pop()


def blocks(page: str, paths: _Paths) -> list[tuple[int, str, int]]:
    """(path node, text, characters in links) of each block with text."""
    out: list[tuple[int, str, int]] = []
    open_ = _Open()
    held: list[str] = []
    path, linked, links, at = 0, 0, 0, 0

    def flush() -> None:
        nonlocal held, linked, path
        text = " ".join(html.unescape("".join(held)).split()) if held else ""
        if text:
            out.append((path, text, min(linked, len(text))))
        held, linked, path = [], 0, open_.top()[1]

    while at < len(page):
        m = TAG.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            held.append(page[at:end])
            if links:
                linked += len(" ".join(held[-1].split()))
        if m is None:
            break
        at = m.end()
        if m.group(2) is None:
            if m.group().startswith("<![CDATA["):
                held.append(html.escape(m.group()[9:].removesuffix("]]>")))
            continue
        tag, closing = m.group(2).lower(), bool(m.group(1))
        if tag == "a":
            links = max(0, links - 1) if closing else links + 1
        if tag in INLINE:
            continue
        flush()
        links = 0
        if closing:
            if (place := open_.nearest((tag,))) >= 0:
                open_.close(place)
        elif tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
        elif tag not in VOID:
            if open_.top()[0] == "p":
                open_.close(len(open_.stack) - 1)
            if tag in ENDS:
                same, stop = ENDS[tag]
                if (place := open_.nearest(same)) > open_.nearest(stop):
                    open_.close(place)
            open_.push(tag, paths.below(open_.top()[1], tag, m.group(3)))
        path = open_.top()[1]
    flush()
    return out


def features(pages: list[list[tuple[int, str, int]]], paths: _Paths, places: np.ndarray | None = None) -> list[np.ndarray]:
    """A matrix (blocks, DIM) for each page; places: where the blocks stand in their page, if not the whole page is given."""
    flat = [b for page in pages for b in page]
    x = np.zeros((len(flat), DIM), np.float32)
    if not flat:
        return [x for _ in pages]
    x[:, :PATHS] = np.array(paths.vectors)[[b[0] for b in flat]]
    hashes, at = words(pa.array([b[1] for b in flat]))
    owner = np.repeat(np.arange(len(flat)), np.diff(at))
    count = np.bincount(owner * WORD_DIM + (hashes >> np.uint64(40)).astype(np.int64) % WORD_DIM, minlength=len(flat) * WORD_DIM)
    many = np.maximum(np.diff(at), 1).astype(np.float32)
    x[:, PATHS : PATHS + WORD_DIM] = np.sqrt(count.reshape(len(flat), WORD_DIM) / many[:, None])
    size = np.array([len(b[1]) for b in flat], np.float32)
    place = np.concatenate([np.arange(len(p), dtype=np.float32) / max(1, len(p) - 1) for p in pages]) if places is None else places.astype(np.float32)
    last = np.array([b[1][-1] in ".!?…" for b in flat], np.float32)
    own = [np.log1p(size) / 6, np.log1p(many) / 5, np.array([b[2] for b in flat], np.float32) / size, place, 1 - place, last, (many < 4).astype(np.float32), (many > 25).astype(np.float32)]
    x[:, PATHS + WORD_DIM :] = np.stack(own, axis=1)
    return np.split(x, np.cumsum([len(p) for p in pages])[:-1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class Labeller:
    """Two LSTMs, one in each direction, and a logistic output on both states of a block."""

    def __init__(self, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = rng.normal(0, 0.1, (DIM, 4 * HIDDEN)).astype(np.float32)
            self.w[f"h{d}"] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.w[f"c{d}"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)
        self.w["o"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        self.w["ob"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool, state: tuple | None = None):
        """States of all steps, what backward steps need, and the state at the end."""
        steps, n, _ = x.shape
        gates = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h, c = state or (np.zeros((n, HIDDEN), np.float32),) * 2
        out, tape = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = gates[t] + h @ self.w[f"h{d}"]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep:
                tape.append((t, h, c, i, f, o, g, tc, m))
            c, h = m * new, m * (o * tc)
            out[t] = h
        return out, tape, (h, c)

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d, False)[0] for d in "fb"], axis=2)
        return _sigmoid(both @ self.w["o"] + self.w["ob"])

    def long_scores(self, page: list[tuple[int, str, int]], paths: _Paths) -> np.ndarray:
        """The scores of one page's blocks, MOST_BLOCKS of them at a time."""
        total, n = np.zeros(len(page), np.float32), len(page)
        for k, d in enumerate("fb"):
            state, starts = None, range(0, n, MOST_BLOCKS)
            for lo in starts if d == "f" else reversed(starts):
                hi = min(lo + MOST_BLOCKS, n)
                (x,) = features([page[lo:hi]], paths, np.arange(lo, hi) / max(1, n - 1))
                out, _, state = self._run(x[:, None], np.ones((hi - lo, 1), np.float32), d, False, state)
                total[lo:hi] += out[:, 0] @ self.w["o"][k * HIDDEN : (k + 1) * HIDDEN]
        return _sigmoid(total + self.w["ob"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        delta = (_sigmoid(both @ self.w["o"] + self.w["ob"]) - y) * mask / mask.sum()
        grads = {"o": (both * delta[:, :, None]).sum((0, 1)), "ob": delta.sum(keepdims=True).ravel()}
        for k, d in enumerate("fb"):
            up = delta[:, :, None] * self.w["o"][k * HIDDEN : (k + 1) * HIDDEN]
            wh = self.w[f"h{d}"]
            dz_all, gh = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(wh)
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h0, c0, i, f, o, g, tc, m in reversed(runs[d][1]):
                dh = (dh + up[t]) * m
                dn = dc * m + dh * o * (1 - tc * tc)
                dz = np.concatenate([dn * g * i * (1 - i), dn * c0 * f * (1 - f), dh * tc * o * (1 - o), dn * i * (1 - g * g)], axis=1)
                dz_all[t] = dz
                gh += h0.T @ dz
                dh, dc = dz @ wh.T, dn * f
            grads[f"h{d}"] = gh
            grads[f"c{d}"] = dz_all.sum((0, 1))
            grads[f"x{d}"] = x.reshape(-1, DIM).T @ dz_all.reshape(-1, 4 * HIDDEN)
        return grads


def padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(x) for x in xs)
    x, mask = np.zeros((steps, len(xs), DIM), np.float32), np.zeros((steps, len(xs)), np.float32)
    for k, one in enumerate(xs):
        x[: len(one), k], mask[: len(one), k] = one, 1
    return x, mask


# --- generated training pages -------------------------------------------------------------

#: Names that pages use for their parts.
MAIN = ("article", "main", "content", "post", "entry", "story", "body", "text")
SIDE = {
    "nav": ("nav", "menu", "navigation", "navbar", "breadcrumb", "links", "tabs", "pagination"),
    "header": ("header", "masthead", "top", "banner", "site-header", "logo"),
    "footer": ("footer", "bottom", "copyright", "site-footer", "legal"),
    "aside": ("sidebar", "aside", "related", "widget", "recommended", "popular", "more", "rail", "tags"),
    "div": ("ad", "ads", "advert", "advertisement", "sponsor", "promo", "cookie", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "share", "social", "banner", "disclaimer", "warning"),
    "form": ("form", "search", "login", "signup", "newsletter", "contact", "subscribe"),
    "section": ("comments", "comment", "discussion", "replies", "responses", "respond", "feedback"),
}


class _Writer:
    """A page in words drawn for it, with the parts of its main text marked by U+0001."""

    def __init__(self, rng: random.Random) -> None:
        self.rng, self.pick = rng, rng.choice
        parts = ["".join(rng.choices("abcdefghijklmnoprstuvwzéèüßñ", k=rng.randint(1, 3))) for _ in range(30)]
        self.vocabulary = ["".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(150)]
        self.tail = self.pick(["", "", "***", "%%%", "###", "(1)", "&nbsp;"])

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def text(self, low: int, high: int) -> str:
        ws = self.rng.choices(self.vocabulary, k=self.rng.randint(low, high))
        for k in range(len(ws)):
            if self.chance(0.1):
                ws[k] += self.pick([".", ",", ",", ".", "!", "?", ":", "&amp;", self.tail])
        return " ".join(ws).capitalize() + ("." if self.chance(0.7) else "")

    def sized(self) -> str:
        return self.text(*self.pick([(1, 3), (2, 12), (10, 40), (30, 120)]))

    def link(self, low: int, high: int) -> str:
        words = self.text(low, high)
        return f'<a href="/{words[:7]}">{words}</a>'

    def named(self, tag: str, names: tuple[str, ...], sure: bool = False) -> str:
        if not sure and self.chance(0.4):
            return f"<{tag}>"
        name = self.pick(names)
        if self.chance(0.3):
            name = self.pick(["site", "page", "main", "block", "box", "wrap", "x"]) + self.pick(["-", "_", " "]) + name
        return f'<{tag} {self.pick(["class", "class", "id", "role"])}="{name}">'

    def menu(self) -> str:
        links = [self.link(1, 3) for _ in range(self.rng.randint(2, 8))]
        kind = self.rng.random()
        if kind < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>"
        if kind < 0.7:
            return "<ul>" + "".join(f"<li>{x}" for x in links) + "</ul>"
        return self.pick([" | ", " ", " &middot; ", "<br>", " &raquo; "]).join(links)

    def part(self, kind: str) -> str:
        tag = kind if kind in ("nav", "header", "footer", "aside", "form", "section") and self.chance(0.7) else "div"
        if kind == "section":
            tag = self.pick(["section", "div", "ol", "ul"])
        if kind == "nav" and self.chance(0.1):
            tag = "ul"
        sure = tag in ("div", "section", "ol", "ul")
        n = self.rng.randint(1, 6)
        if tag == "ul" and kind == "nav":
            inner = "".join(f"<li>{self.link(1, 3)}</li>" for _ in range(n))
        elif kind == "nav" or (kind in ("footer", "aside") and self.chance(0.4)):
            inner = self.pick(["", "", f"<h3>{self.text(1, 3)}</h3>", f"<h4>{self.text(1, 2)}</h4>"]) + self.menu()
        elif kind == "header":
            level = self.pick(["h1", "h1", "h1", "h2", "div", "p", "span"])
            inner = f"<{level}>{self.pick([self.text(1, 4), self.link(1, 3)])}</{level}>" + self.pick(["", "", f"<p>{self.text(2, 9)}</p>", f"<div>{self.sized()}</div>", self.menu(), f"<nav>{self.menu()}</nav>"])
        elif kind == "form":
            field = ['<input name="q"/>', "<textarea></textarea>", f"<textarea>{self.text(1, 5)}</textarea>", f"<select><option>{self.text(1, 2)}<option>{self.text(1, 2)}</select>"]
            inner = "".join(f"{self.pick(['<label>', '<p><label>', '<div>', '<p>'])}{self.text(1, 5)}{self.pick(['</label>', ''])}{self.pick(field)}" for _ in range(n)) + f"<button>{self.text(1, 2)}</button>"
            if tag == "div" and self.chance(0.8):
                inner = f"<form>{inner}</form>"
        elif kind == "section":
            who = f"{self.pick(['<cite>', '<b>', '<span>', '<h4>'])}{self.text(1, 2)}"
            inner = f"<h3>{self.text(1, 3)}</h3>" * self.chance(0.5) + "".join(f'{self.pick(["<div class=comment>", "<li>", "<p>", "<article class=comment>", "<div class=reply>" + who, "<li class=comment>"])}<p>{self.sized()}</p>' for _ in range(n))
        else:
            inner = self.pick(["{}", "<p>{}</p>", "<p>{}</p><p>{}</p>", "<h2>{}</h2><p>{}</p>", "<span>{}</span>", "<h3>{}</h3><p>{}</p>", "<p>{} " + self.link(1, 4) + "</p>"])
            inner = re.sub(r"\{\}", lambda _: self.pick(["&copy; ", "", "", ""]) + self.sized(), inner)
        return f"{self.named(tag, SIDE[kind], sure)}{inner}</{tag}>"

    def noise(self, p: float, kinds: list[str]) -> str:
        return "".join(self.part(self.pick(kinds)) for _ in range(self.rng.randint(1, 3)) if self.chance(p))

    def cell(self) -> str:
        return self.text(*self.pick([(1, 2), (1, 4), (3, 12)]))

    def piece(self) -> str:
        """A part of an article's body."""
        mark, body, kind = "\x01", self.sized(), self.rng.random()
        if kind < 0.6:
            forms = [f"<p>{mark}{body}</p>", f"<p>{mark}{body}</p>", f"<p>{mark}{body}", f"<p><b>{mark}{body}<br>", f"<p>{mark}{body} {self.link(1, 4)} {self.text(1, 9)}</p>", f"<div>{mark}{body}</div>", f"<p>{mark}{self.link(1, 6)}</p>", f"{mark}{body}<br><br>", f"<section><h2>{mark}{self.text(1, 6)}</h2><p>{mark}{body}</p></section>"]
            return self.pick(forms)
        if kind < 0.68:
            h = self.pick(["h2", "h2", "h3", "h4"])
            return f"<{h}>{mark}{self.text(1, 8)}</{h}>"
        if kind < 0.75:
            ul = self.pick(["ul", "ol"])
            return f"<{ul}>" + "".join(f"<li>{mark}{self.pick([self.sized(), self.cell(), self.link(1, 5) + ' ' + self.sized()])}{self.pick(['</li>', ''])}" for _ in range(self.rng.randint(1, 6))) + f"</{ul}>"
        if kind < 0.79:
            return f"<blockquote>{self.pick(['<p>', ''])}{mark}{body}</blockquote>"
        if kind < 0.84:
            cells = lambda t: "<tr>" + "".join(f"<{t}>{mark}{self.cell()}</{t}>" for _ in range(wide)) + "</tr>"
            wide = self.rng.randint(1, 4)
            return "<table>" + f"<caption>{mark}{self.text(1, 6)}</caption>" * self.chance(0.2) + cells("th") * self.chance(0.5) + "".join(cells("td") for _ in range(self.rng.randint(1, 4))) + "</table>"
        if kind < 0.88:
            return f"<pre>{self.pick(['<code>', ''])}{mark}{body}\n  {self.text(1, 9)}</pre>"
        if kind < 0.92:
            return "<dl>" + "".join(f"<dt>{mark}{self.cell()}{self.pick(['</dt>', ''])}<dd>{mark}{self.pick([self.sized(), '<p>' + mark + self.sized() + '</p>'])}</dd>" for _ in range(self.rng.randint(1, 5))) + "</dl>"
        if kind < 0.96:
            return f'<figure><img src="a.png"><figcaption>{mark}{self.text(2, 14)}</figcaption></figure>'
        return self.part(self.pick(["aside", "div", "form", "nav"]))

    def title(self) -> str:
        h = self.pick(["h1", "h1", "h1", "h2"])
        return f"<{h}>\x01{self.sized()}</{h}>"

    def article(self) -> str:
        out = []
        if self.chance(0.85):
            h = self.title()
            out.append(f"{self.named('header', ('entry-header', 'post-header', 'article-header', 'title'))}{h}</header>" if self.chance(0.25) else h)
        n = self.rng.randint(1, 13)
        out += [self.piece() for _ in range(n)]
        if self.chance(0.1):  # of one kind only
            same = self.pick(["<pre>\x01{}</pre>", "<dl><dt>\x01{}<dd>\x01{}</dl>", "<table><tr><td>\x01{}<td>\x01{}</table>", "<ul><li>\x01{}</ul>", "<p>\x01{}", "<div>\x01{}</div>", "<blockquote>\x01{}</blockquote>", "<figure><figcaption>\x01{}</figcaption></figure>"])
            out = out[:1] * self.chance(0.6) + [re.sub(r"\{\}", lambda _: self.sized(), same) for _ in range(n)]
        if self.chance(0.3):
            out.append(self.part(self.pick(["section", "section", "aside", "div", "form", "footer"])))
        return "".join(out)

    def body(self) -> str:
        kind = self.rng.random()
        top = self.noise(0.8, ["nav", "header", "header", "div", "form", "nav"])
        end = self.noise(0.75, ["footer", "section", "section", "aside", "div", "nav", "footer", "form"])
        if kind < 0.16:  # a table lays the page out
            td = lambda inner, names: f"{self.pick(['<td>', '<td>', '<td valign=top>', '<td width=160>', self.named('td', names)])}{inner}</td>"
            rows = [f"<tr>{td(self.pick([self.menu(), f'<h1>{self.text(1, 3)}</h1>', self.text(1, 4), self.part('header')]), SIDE['header'])}</tr>"] * self.chance(0.7)
            sides = [td(self.pick([self.menu(), self.menu(), self.part("aside")]), SIDE["nav"])] * self.chance(0.7)
            main = [td(self.article(), MAIN)]
            right = [td(self.part(self.pick(["aside", "div"])), SIDE["aside"])] * self.chance(0.3)
            rows += ["<tr>" + "".join(sides + main + right) + "</tr>"]
            rows += [f"<tr>{td(self.pick(['&copy; ' + self.text(1, 6), self.menu(), self.text(2, 9), self.text(2, 9)]), SIDE['footer'])}</tr>"] * self.chance(0.8)
            table = f"<table{self.pick(['', ' width=100%', ' border=0'])}>{''.join(rows)}</table>"
            return self.pick(["", "", top]) + self.pick([table, f"<center>{table}</center>"]) + self.pick(["", "", end])
        if kind < 0.28:  # nothing around the text
            return top + self.article() + end
        tag = self.pick(["article", "article", "article", "main", "div", "section"])
        main = self.named(tag, MAIN, sure=tag in ("div", "section") and self.chance(0.7)) + self.article() + f"</{tag}>"
        if self.chance(0.1) and tag == "article":
            main = self.title() + main
        if self.chance(0.4):
            main = f"{self.pick(['<main>', '<div id=content>', '<div class=wrap>', '<div>', '<div class=row><div class=col>'])}{main}{self.noise(0.3, ['section', 'aside', 'div'])}</div>"
        return top + main + end

    def page(self) -> str:
        body = self.body()
        head = f"<title>{self.text(2, 12)}</title>" + "<style>p{}</style><script>var t='</p>';</script>" * self.chance(0.7)
        if self.chance(0.1):
            return f"<title>{self.text(2, 12)}</title>" * self.chance(0.7) + body
        return f"<!DOCTYPE html><html><head>{head}</head><body>{body}" + "</body></html>" * self.chance(0.85)


def generated(n: int, seed: int) -> Iterator[tuple[list[tuple[int, str, int]], list[bool], _Paths]]:
    """Training pages as blocks, which of them are main, and their paths."""
    rng = random.Random(seed)
    paths = _Paths()
    for _ in range(n):
        found = blocks(_Writer(rng).page(), paths)
        yield [(p, t.replace("\x01", "") or "-", k) for p, t, k in found], ["\x01" in t for _, t, _ in found], paths


@lru_cache(maxsize=2)
def trained(pages: int = 3200, rounds: int = 4, seed: int = 7) -> Labeller:
    """A labeller fitted with Adam on generated pages."""
    made = list(generated(pages, seed))
    xs = features([b for b, _, _ in made], made[0][2])
    ys = [np.array(y, np.float32) for _, y, _ in made]
    rng, model = np.random.default_rng(seed), Labeller(seed)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    size, step = 32, 0
    for _ in range(rounds):
        order = np.argsort([len(x) + rng.uniform(0, 8) for x in xs])
        groups = [order[k : k + size] for k in range(0, len(order), size)]
        for at in rng.permutation(len(groups)):
            x, mask = padded([xs[k] for k in groups[at]])
            y = np.zeros(mask.shape, np.float32)
            for col, k in enumerate(groups[at]):
                y[: len(ys[k]), col] = ys[k]
            step += 1
            for name, g in model.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                model.w[name] -= (0.01 * first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def main_texts(model: Labeller, pages: list[str]) -> list[str]:
    """The main text of each page."""
    paths = _Paths()
    found = [blocks(p, paths) for p in pages]
    out = [""] * len(pages)
    joined = lambda k, scores: " ".join(b[1] for b, score in zip(found[k], scores) if score >= 0.5)
    order = sorted((k for k in range(len(pages)) if found[k]), key=lambda k: len(found[k]))
    while order:
        most = len(found[order[-1]])
        if most > MOST_BLOCKS:
            k = order.pop()
            out[k] = joined(k, model.long_scores(found[k], paths))
            continue
        n = max(1, min(len(order), MOST_BLOCKS // most))
        some, order = order[-n:], order[:-n]
        scores = model.scores(*padded(features([found[k] for k in some], paths)))
        for col, k in enumerate(some):
            out[k] = joined(k, scores[:, col])
    return out


def extract(pages: DataFrame, model: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(trained() if model is None else model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 1 << 20):
            texts = main_texts(shared.value, [t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(label, "page_id bigint, url string, text string, n_chars bigint")
