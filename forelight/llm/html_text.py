"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, with the path of
open tags above them. A bidirectional LSTM (numpy) reads the whole sequence of blocks of
a page, each as the sum of hashed tag-path vectors (tags, classes, ids), the mean of
hashed word vectors and a few numbers, and labels every block as article or not from
what stands before and after it. It is trained at the driver, once per application, on
generated pages whose labels are known: a fixed number of layouts with menus, headers,
footers, side columns, notices, adverts, forms and reader comments around an article,
with random words.

Comments, scripts, styles, titles, frames, templates, drawings and form fields never make blocks;
the head holds nothing else, so it may lack its end tag. Character references are
decoded, white space inside a block becomes one space, and article blocks are joined by
one line end in page order.

Defined results: null and empty pages, and pages without article blocks, give an empty
text; unclosed and crossing tags are closed by what encloses them; text outside any tag
is a block; repeated pages each get their own row.
"""

from __future__ import annotations

import bisect
import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import ship, trim

# Elements of HTML by their kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= set("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts semantics annotation".split())
RAW = "script|style|iframe|textarea"  # as in browsers, without an end tag they reach to the end of the page
SKIPPED = "title|template|svg|canvas|select"  # without an end tag only the tag itself is skipped
RAW_NAMES = set(RAW.split("|"))
IGNORED = set(f"{RAW}|{SKIPPED}|head".split("|"))
CLOSES_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

# A quote opens a value only after "="; anywhere else it is a letter like others. Possessive groups:
# whatever a page holds, no part of a tag is read twice.
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!?[/a-zA-Z?](?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^<>])*+>", re.S)
_END = re.compile(rf"</({RAW}|{SKIPPED})(?=[\s/>])[^>]*>", re.I)
_NAME = re.compile(r"</?\s*([a-zA-Z][\w:-]*)")
_LABEL = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

PATHS, WORDS = 512, 1024
SIZE, HIDDEN, NUMBERS = 16, 16, 5
TRAIN_PAGES, PAGES_AT_ONCE, RATE = 1200, 40, 0.015
#: blocks, padding included, that are labelled at a time; characters of pages that are cut at a time
CELLS, CHARS = 40_000, 8_000_000


class Path:
    """An open tag with its labels, below the one that encloses it. Blocks share the paths above them."""

    __slots__ = ("above", "labels")

    def __init__(self, above: Path | None, labels: tuple[str, ...]):
        self.above, self.labels = above, labels


class _Ends:
    """Places after the end tags of a page's raw and skipped elements, found in one pass when first asked for."""

    def __init__(self, page: str):
        self.page, self.of = page, None

    def after(self, name: str, at: int) -> int | None:
        if self.of is None:
            self.of = {}
            for m in _END.finditer(self.page):
                starts, ends = self.of.setdefault(m[1].lower(), ([], []))
                starts.append(m.start())
                ends.append(m.end())
        starts, ends = self.of.get(name, ((), ()))
        k = bisect.bisect_left(starts, at)
        return ends[k] if k < len(ends) else None


def blocks(page: str | None) -> list[tuple[Path | None, str, float]]:
    """Of each block: its path, its text, the share of it inside links."""
    if not page:
        return []
    out, stack, parts, linked = [], [], [], 0
    inside_link, ends = 0, _Ends(page)
    open_of: Counter = Counter()  # open tags by name, so that an end tag without one costs nothing

    def close() -> None:
        nonlocal parts, linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append((stack[-1][1] if stack else None, text, min(1.0, linked / max(1, len(text)))))
        parts, linked = [], 0

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * bool(inside_link)
        at = m.end()
        tag = m.group()
        if tag.startswith(("<!", "<?")):
            continue
        name = _NAME.match(tag)
        if not name:
            continue
        name = name.group(1).lower()
        if name in IGNORED:
            if name == "head":
                close()
            elif tag[1] != "/" and not (name == "svg" and tag.endswith("/>")):
                after = ends.after(name, at)
                at = after if after is not None else len(page) if name in RAW_NAMES else at
            continue
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            if name == "a":
                inside_link = 0 if tag[1] == "/" else 1
            continue
        close()
        inside_link = 0
        if tag[1] == "/":
            if open_of.get(name):
                while stack:
                    last = stack.pop()[0]
                    open_of[last] -= 1
                    if last == name:
                        break
        elif name not in VOID and not tag.endswith("/>"):
            closes = CLOSES_ITSELF.get(name, ())
            while stack and stack[-1][0] in closes:
                open_of[stack.pop()[0]] -= 1
            if stack and stack[-1][0] == "p" and name != "p":
                open_of[stack.pop()[0]] -= 1
            named = [w for g in _LABEL.findall(tag) for w in re.split(r"[^a-z]+", "".join(g).lower()) if w]
            stack.append((name, Path(stack[-1][1] if stack else None, (name, *("." + w for w in named)))))
            open_of[name] += 1
    if at < len(page):
        parts.append(page[at:])
    close()
    return out


def _hash(word: str, size: int) -> int:
    return xxhash.xxh32_intdigest(word) % size


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all lists, and how many each has."""
    sizes = np.fromiter(map(len, lists), np.int32, len(lists))
    return np.fromiter((i for some in lists for i in some), np.int16, int(sizes.sum())), sizes


def _paths(found: list) -> tuple[np.ndarray, ...]:
    """The paths of a page as a tree, each tag once, those above first: the buckets of each tag's own labels
    and how many, the tag above (-1: none), its depth, and the tag of each block."""
    number: dict[int, int] = {}
    own, above, depth, blocks_at = [], [], [], np.zeros(len(found), np.int32)
    for i, (path, _, _) in enumerate(found):
        new, p = [], path
        while p is not None and id(p) not in number:
            new.append(p)
            p = p.above
        up = -1 if p is None else number[id(p)]
        for p in reversed(new):
            number[id(p)] = len(own)
            own.append([_hash(x, PATHS) for x in p.labels])
            above.append(up)
            depth.append(0 if up < 0 else depth[up] + 1)
            up = number[id(p)]
        if path is None and None not in number:  # text outside any tag
            number[None] = len(own)
            own.append([0])
            above.append(-1)
            depth.append(0)
        blocks_at[i] = number[None] if path is None else number[id(path)]
    return (*_flat(own), np.array(above, np.int32), np.array(depth, np.int32), blocks_at)


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    """The tags of each depth but the first."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)[1:] if len(depth) else []


def features(found: list) -> tuple[tuple, tuple, np.ndarray]:
    """Paths, word buckets and numbers of a page's blocks; a page is kept in flat arrays."""
    n = len(found)
    parts = []
    for k in range(0, n, 4096):
        parts.append(_flat([[_hash(w, WORDS) for w in set(text.lower().split())] for _, text, _ in found[k : k + 4096]]))
    words = tuple(np.concatenate(x) if x else np.zeros(0, np.int16) for x in zip(*parts, strict=True)) or _flat([])
    numbers = np.array([[np.log1p(len(text)) / 8, link, i / max(1, n - 1), text.count(".") / max(1, text.count(" ") + 1), float(text[-1] in ".!?")] for i, (_, text, link) in enumerate(found)], np.float32).reshape(-1, NUMBERS)
    return _paths(found), words, numbers


class Labeller:
    """Bidirectional LSTM with hashed inputs; padded batches of pages, T x B."""

    def __init__(self, weights: dict | None = None, seed: int = 3):
        r = np.random.default_rng(seed)
        n = lambda *s: r.normal(0, 0.15, s).astype(np.float32)
        wide = SIZE * 2 + NUMBERS
        self.p = weights or {"P": n(PATHS, SIZE), "W": n(WORDS, SIZE) * 0.3, **{f"{k}{d}": n(*s) for d in "fb" for k, s in (("X", (wide, 4 * HIDDEN)), ("H", (HIDDEN, 4 * HIDDEN)), ("c", (4 * HIDDEN,)))}, "O": n(2 * HIDDEN), "o": np.zeros(1, np.float32)}

    def inputs(self, pages: list) -> tuple:
        t_max = max(len(p[2]) for p in pages)
        x = np.zeros((t_max, len(pages), SIZE * 2 + NUMBERS), np.float32)
        real = np.zeros((t_max, len(pages)), bool)
        trace = []
        for b, (paths, words, numbers) in enumerate(pages):
            n = len(numbers)
            if not n:
                continue
            flat, sizes, above, depth, at = paths
            sums, levels = self._sums(self.p["P"], flat, sizes), _levels(depth)
            for tags in levels:  # a path's sum is its own tag's and that of the path above
                sums[tags] += sums[above[tags]]
            x[:n, b, :SIZE] = sums[at]
            x[:n, b, SIZE : 2 * SIZE] = self._sums(self.p["W"], *words) / np.maximum(1, words[1])[:, None]
            trace.append((b, n, paths, levels, words))
            x[:n, b, SIZE * 2 :] = numbers
            real[:n, b] = True
        return x, real, trace

    @staticmethod
    def _sums(table: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sums of the table's rows by block, some blocks at a time."""
        out, upto = np.zeros((len(sizes), table.shape[1]), table.dtype), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        for k in range(0, len(sizes), 4096):
            ends = upto[k : k + 4097]
            full = np.flatnonzero(np.diff(ends))
            if len(full):
                out[k + full] = np.add.reduceat(table[flat[ends[0] : ends[-1]]], ends[full] - ends[0], axis=0)
        return out

    def _direction(self, x, real, d, keep):
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        pre = x @ self.p[f"X{d}"] + self.p[f"c{d}"]
        out, trace = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        for t in steps:
            a = pre[t] + h @ self.p[f"H{d}"]
            s = 1 / (1 + np.exp(-np.clip(a[:, : 3 * HIDDEN], -20, 20)))
            g = np.tanh(a[:, 3 * HIDDEN :])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            on = real[t][:, None]
            new = f * c + i * g
            u = np.tanh(new)
            if keep:
                trace.append((t, h, c, i, f, o, g, u, on))
            c = np.where(on, new, c)
            h = np.where(on, o * u, h)
            out[t] = h
        return out, trace

    def forward(self, pages: list, keep: bool = False):
        x, real, trace = self.inputs(pages)
        f, tf = self._direction(x, real, "f", keep)
        b, tb = self._direction(x, real, "b", keep)
        if not keep:
            return f @ self.p["O"][:HIDDEN] + b @ self.p["O"][HIDDEN:] + self.p["o"][0], real
        h = np.concatenate([f, b], axis=2)
        score = h @ self.p["O"] + self.p["o"][0]
        return score, real, x, h, trace, tf, tb

    def gradients(self, pages: list, labels: list[np.ndarray]):
        score, real, x, h, trace, tf, tb = self.forward(pages, keep=True)
        y = np.zeros(score.shape, np.float32)
        for b, some in enumerate(labels):
            y[: len(some), b] = some
        prob = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        n = max(1, int(real.sum()))
        loss = -float((np.log(np.where(y > 0, prob, 1 - prob) + 1e-9) * real).sum()) / n
        ds = ((prob - y) * real / n).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["O"], g["o"] = np.einsum("tb,tbh->h", ds, h), ds.sum(keepdims=True).reshape(1)
        dh_all = ds[:, :, None] * self.p["O"]
        dx = np.zeros_like(x)
        for d, steps, cut in (("f", tf, slice(0, HIDDEN)), ("b", tb, slice(HIDDEN, 2 * HIDDEN))):
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h0, c0, i, f, o, gg, u, on in reversed(steps):
                dh = dh + dh_all[t][:, cut]
                here = np.where(on, dh, 0)
                dn = np.where(on, dc, 0) + here * o * (1 - u * u)
                da = np.concatenate([dn * gg * i * (1 - i), dn * c0 * f * (1 - f), here * u * o * (1 - o), dn * i * (1 - gg * gg)], axis=1).astype(np.float32)
                g[f"H{d}"] += h0.T @ da
                g[f"X{d}"] += x[t].T @ da
                g[f"c{d}"] += da.sum(axis=0)
                dx[t] += da @ self.p[f"X{d}"].T
                dh = np.where(on, 0, dh) + da @ self.p[f"H{d}"].T
                dc = np.where(on, dn * f, dc)
        for b, n, (flat, sizes, above, _, at), levels, (words, counts) in trace:
            sums = np.zeros((len(sizes), SIZE), dx.dtype)
            np.add.at(sums, at, dx[:n, b, :SIZE])
            for tags in reversed(levels):
                np.add.at(sums, above[tags], sums[tags])
            np.add.at(g["P"], flat, np.repeat(sums, sizes, axis=0))
            np.add.at(g["W"], words, np.repeat(dx[:n, b, SIZE : 2 * SIZE] / np.maximum(1, counts)[:, None], counts, axis=0))
        return loss, g

    def fit(self, pages: list, labels: list[np.ndarray], rate: float = RATE) -> float:
        m, q = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        order = np.random.default_rng(5).permutation(len(pages))
        loss = 0.0
        for step, k in enumerate(range(0, len(order), PAGES_AT_ONCE), 1):
            some = order[k : k + PAGES_AT_ONCE]
            loss, g = self.gradients([pages[i] for i in some], [labels[i] for i in some])
            for n, v in self.p.items():
                m[n] += 0.1 * (g[n] - m[n])
                q[n] += 0.01 * (g[n] ** 2 - q[n])
                v -= rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(q[n] / (1 - 0.99**step)) + 1e-8)
        return loss

    def label(self, pages: list) -> list[np.ndarray]:
        """True for article blocks; pages of like length run side by side, CELLS blocks at a time
        (a longer page alone)."""
        out: list = [None] * len(pages)
        order = sorted(range(len(pages)), key=lambda i: -len(pages[i][2]))
        while order:
            side = max(1, min(128, CELLS // max(1, len(pages[order[0]][2]))))
            some, order = order[:side], order[side:]
            if len(pages[some[0]][2]) == 0:
                for i in some:
                    out[i] = np.zeros(0, bool)
                continue
            score, _ = self.forward([pages[i] for i in some])
            for b, i in enumerate(some):
                out[i] = score[: len(pages[i][2]), b] > 0
        return out


# Names that layouts of pages commonly use for their parts.
PARTS = {
    "menu": "nav menu navbar navigation breadcrumb toc topnav links tabs", "header": "header masthead banner top branding logo", "footer": "footer bottom legal copyright colophon",
    "side": "aside sidebar related widget rail recommended popular trending tags share social", "notice": "cookie notice consent alert popup modal newsletter subscribe gdpr paywall",
    "ad": "ad ads advert advertisement sponsored promo banner sponsor", "form": "form search login signup contact", "comments": "comments comment reply replies discussion disqus respond",
}
MAIN = "article main content post entry story body text page container wrapper".split()


def sample_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A generated page and whether each of its blocks is article, in page order."""
    syllables = ["".join(rng.choices("bcdfghlmnprstvzéñöüaeiou", k=rng.randint(2, 4))) for _ in range(60)]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    html: list[str] = []
    truth: list[bool] = []

    def text(low: int, high: int) -> str:
        words = [word() for _ in range(rng.randint(low, high))]
        for i in range(len(words)):
            if i == 0 or rng.random() < 0.12:
                words[i] = words[i].capitalize()
                if i:
                    words[i - 1] += "."
        return " ".join(words) + rng.choice([".", ".", "", "!", "?"])

    def leaf(tag: str, content: str, good: bool, close: bool = True) -> None:
        if rng.random() < 0.15:
            content = f"<b>{content}<br>" if rng.random() < 0.5 else f"<span>{content}</span>"
        html.append(f"<{tag}>{content}" + (f"</{tag}>" if close else ""))
        truth.append(good)

    def part(kind: str) -> None:
        names = PARTS[kind].split()
        own = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind)
        tag = own if own and rng.random() < 0.6 else rng.choice(["div", "section", "div", "ul" if kind == "menu" else "div"])
        attr = "" if tag == own and rng.random() < 0.6 else f' {rng.choice(["class", "id"])}="{rng.choice(names)}{rng.choice(["", "-box", "-1", "_inner"])}"'
        html.append(f"<{tag}{attr}>")
        if kind == "menu":
            html.append("" if tag == "ul" else "<ul>")
            for _ in range(rng.randint(3, 8)):
                html.append("<li>")
                html.append(f'<a href="/{word()}">{text(1, 2)}</a>')
                truth.append(False)
                html.append("</li>")
            html.append("" if tag == "ul" else "</ul>")
        elif kind == "comments":
            for _ in range(rng.randint(1, 5)):
                html.append(f'<div class="{rng.choice(["comment", "reply", "comment-body"])}">')
                leaf(rng.choice(["p", "h4", "div"]), text(1, 4), False)
                leaf("p", text(5, 60), False)
                html.append("</div>")
        elif rng.random() < 0.5:
            html.append(rng.choice(["&copy; ", "", ""]) + text(2, 25))
            truth.append(False)
        else:
            for _ in range(rng.randint(1, 4)):
                leaf(rng.choice(["p", "div", "h3", "li", "label"] if kind == "form" else ["p", "div", "h3", "p"]), text(1, 30), False)
        html.append(f"</{tag}>")

    html.append("<html><head><title>" + text(2, 6) + "</title></head><body>")
    before, after = ["header", "menu", "notice", "ad", "side", "form"], ["side", "comments", "footer", "ad", "notice", "menu", "form"]
    for kind in before:
        if rng.random() < 0.45:
            part(kind)
    if rng.random() < 0.4:
        html.append(f'<div class="{rng.choice(MAIN)}">')
    tag = rng.choice(["article", "article", "main", "div", "section"])
    attr = "" if tag in ("article", "main") and rng.random() < 0.6 else f' {rng.choice(["class", "id"])}="{rng.choice(MAIN)}"'
    html.append(f"<{tag}{attr}>")
    if rng.random() < 0.85:
        leaf("h1", text(2, 12), True)
    paragraphs = rng.choice([1, 1, 2, 3, 5, 8, 12])
    for k in range(paragraphs):
        leaf("p", text(1, 5) if rng.random() < 0.2 else text(4, 90), True, close=rng.random() < 0.85)
        roll = rng.random()
        if roll < 0.05:
            leaf("h2", text(1, 6), True)
        elif roll < 0.09:
            html.append("<ul>")
            for _ in range(rng.randint(2, 4)):
                leaf("li", text(2, 15), True, close=rng.random() < 0.7)
            html.append("</ul>")
        elif roll < 0.12:
            leaf(rng.choice(["blockquote", "pre", "figcaption", "td"]), text(3, 30), True)
        elif roll < 0.16 and k < paragraphs - 1:
            part(rng.choice(["ad", "side", "notice"]))
    if rng.random() < 0.15:
        part("comments")
    html.append(f"</{tag}>")
    for kind in after:
        if rng.random() < 0.4:
            part(kind)
    html.append("</body></html>")
    return "".join(html), truth


def trained(pages: int = TRAIN_PAGES, seed: int = 17) -> dict:
    """Weights from generated pages; pages whose cut differs from what was written (inline
    tags next to each other) are left out."""
    rng = random.Random(seed)
    xs, ys = [], []
    while len(xs) < pages:
        page, truth = sample_page(rng)
        found = blocks(page)
        if len(found) == len(truth):
            xs.append(features(found))
            ys.append(np.array(truth, np.float32))
    m = Labeller()
    for rate in (RATE, RATE / 3):
        m.fit(xs, ys, rate)
    return m.p


_TRAINED: dict = {}


def extract(pages: list, weights: dict) -> list[str]:
    found = [blocks(p if isinstance(p, str) else None) for p in pages]
    kept = Labeller(weights).label([features(f) for f in found])
    return ["\n".join(text for (_, text, _), good in zip(f, k, strict=True) if good) for f, k in zip(found, kept, strict=True)]


def main_text(spark, html: Column) -> Column:
    """The article of a page; the model has a fixed size."""
    ship(spark)
    if "weights" not in _TRAINED:
        _TRAINED["weights"] = trained()
    shared = spark.sparkContext.broadcast(_TRAINED["weights"])

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            out: list[str] = []
            some, size = [], 0
            for p in pages:
                some.append(p)
                size += len(p) if isinstance(p, str) else 0
                if len(some) == 512 or size > CHARS:
                    out += extract(some, shared.value)
                    some, size = [], 0
            yield pd.Series(out + extract(some, shared.value), dtype=object)
        trim()

    return run(html)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return pages.select("page_id", "url", main_text(pages.sparkSession, F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
