"""Main text of web pages by a recurrent block labeller, in numpy.

A page becomes the sequence of its leaf blocks. Each block is described by the tags and classes on
its path, its hashed words and a few measures; a bidirectional LSTM reads the sequence, so that every
block is judged by the whole page, and a logistic layer says whether it is main text. It learns from
pages of the table itself, labelled by plain rules about containers (weak labels) and varied: other
containers for the article, and foreign blocks between its own.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PATHS, WORDS, MEASURES = 1024, 1024, 4
PATH_DIM, WORD_DIM, HIDDEN = 12, 6, 16
#: Bounds of what is learned from: pages, and bytes of them.
SAMPLE = 600
SAMPLE_BYTES = 4_000_000
VARIED = 1200
EPOCHS = 12

# Elements without text for readers. math and object are not among them: what they hold
# is shown.
RAW_TAGS = set("script style noscript template textarea iframe title".split())
_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
# Attributes up to the end of a tag: a quote opens a value only after =. No two parts of the pattern
# can take the same character, and the groups are possessive, so a tag is read in one pass.
_ATTRIBUTES = re.compile(r"""(?:[^>=]++|=[\t\n\f\r ]*+(?:"[^"]*+"|'[^']*+'|(?=[^"'])|(?=\Z)))*+>""")
_MARK = re.compile(r"(?<![\w-])(class|id|role|hidden)(?![\w-])(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.I)
_NAME = re.compile(r"[a-z0-9]+")

# Elements that break the text into blocks.
BLOCK_TAGS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
# Elements without an end tag, and those that a new one of their kind ends.
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_NEXT = {t: {t} for t in ("p", "li", "option", "td", "th", "tr", "dt", "dd")}
CLOSED_BY_NEXT |= {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}}
# Fixed values of the weak labels: containers that are never main text, names in class, id or role
# that say the same, and containers of an article.
OTHER_TAGS = set("nav header footer aside form button select option menu dialog head legend fieldset".split())
OTHER_NAMES = set(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs byline comment comments consent contentinfo cookie "
    "cookies copyright dialog disqus footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo promotion recommended related reply replies respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
ARTICLE_TAGS = {"article", "main"}
ARTICLE_NAMES = set("article content entry post story main body".split())


class Place:
    """An open element: its own features (tag, and names of class, id and role with a dot), the element
    around it, and what the path down to it tells. Blocks of one element share its place, and a place
    holds no list of its path, so a page costs what it is long however deep it is."""

    __slots__ = ("tag", "names", "parent", "other", "article", "depth")

    def __init__(self, tag: str, names: tuple[str, ...], parent: "Place | None"):
        self.tag, self.names, self.parent = tag, names, parent
        self.depth = parent.depth + 1 if parent else 0
        plain = [x[1:] for x in names if x[0] == "."]
        self.other = bool(parent and parent.other) or tag in OTHER_TAGS or any(x in ("hidden", "hidden!") or x in OTHER_NAMES for x in plain)
        self.article = bool(parent and parent.article) or tag in ARTICLE_TAGS or any(x in ARTICLE_NAMES for x in plain)

    @property
    def path(self) -> tuple[str, ...]:
        out, at = [], self
        while at is not None:
            out.append(at.names)
            at = at.parent
        return tuple(x for names in reversed(out) for x in names)


def place(path: tuple[str, ...]) -> Place:
    """The place with this path: a tag and its names, then the next tag and its names."""
    at = None
    for x in path:
        if x[0] != ".":
            at = Place(x, (x,), at)
        else:
            at = Place(at.tag, (*at.names, x), at.parent)
    return at or Place("", (), None)


class _Ends:
    """Finds the end of elements and tags; what does not occur any more is not looked for again."""

    def __init__(self, page: str):
        self.page, self.none = page, set()
        self.quoted = True

    def element(self, tag: str, at: int) -> int:
        """The place behind the end tag from `at` on, or -1."""
        if tag in self.none:
            return -1
        found = _END.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I | re.A)).search(self.page, at)
        if found is None:
            self.none.add(tag)
            return -1
        return found.end()

    def tag(self, at: int) -> int:
        """The place behind the > that ends a tag whose name ends at `at`, or -1."""
        if self.quoted:
            found = _ATTRIBUTES.match(self.page, at)
            if found:
                return found.end()
            self.quoted = False  # a value is never closed: from here on the next > ends a tag
        return self.page.find(">", at) + 1 or -1


_END: dict[str, re.Pattern] = {}


def blocks(page: str) -> list[tuple[Place, str, float]]:
    """(place, text, share of the text in links) of each leaf block with text, in page order. White
    space is one space, character references are decoded."""
    out: list[tuple[Place, str, float]] = []
    root = Place("", (), None)
    stack: list[Place] = [root]
    opened: dict[str, int] = {}
    text: list[str] = []
    linked, in_link, at = 0, 0, 0
    ends = _Ends(page)

    def end() -> None:
        nonlocal linked
        if text:
            plain = " ".join(html.unescape("".join(text)).split())
            if plain:
                out.append((stack[-1], plain, min(1.0, linked / len(plain))))
            text.clear()
            linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        if in_link:
            linked += len(piece)

    def pop() -> None:
        opened[stack.pop().tag] -= 1

    while m := _OPEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        tag = (m[2] or "").lower()
        if not tag:
            if m[0] == "<!--":
                found = page.find("-->", m.end())
                at = found + 3 if found >= 0 else len(page)
            else:
                at = page.find(">", m.end()) + 1 or len(page)
            continue
        closing, begin = m[1], m.end()
        if page[begin : begin + 1] not in _AFTER_NAME:
            add(page[m.start() : begin])
            at = begin
            continue
        at = ends.tag(begin)
        if at < 0:  # no > any more: text
            at = m.start()
            break
        marks = page[begin : at - 1]
        if tag in RAW_TAGS and not closing:
            found = ends.element(tag, at)
            at = found if found >= 0 else len(page)
            continue
        if tag == "svg" and not closing and not marks.endswith("/"):
            found = ends.element(tag, at)
            at = found if found >= 0 else at  # one that is never closed hides nothing
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag == "br":
            text.append(" ")
        if tag not in BLOCK_TAGS:
            continue
        end()
        if closing:
            if opened.get(tag):
                while stack[-1].tag != tag:
                    pop()
                pop()
        else:
            last = stack[-1].tag
            if last and (last in CLOSED_BY_NEXT.get(tag, ()) or last == "p"):
                pop()
            if tag not in VOID_TAGS and not marks.endswith("/"):
                names = (tag,)
                if marks and ("=" in marks or "hidden" in marks.lower()):
                    for k in _MARK.finditer(marks):
                        said = k[2] or k[3] or k[4]
                        if k[1].lower() == "hidden":
                            names += (".hidden!",)
                        elif said:
                            names += tuple("." + x for x in _NAME.findall(said.lower()))
                stack.append(Place(tag, names, stack[-1]))
                opened[tag] = opened.get(tag, 0) + 1
    if at < len(page):
        add(page[at:])
    end()
    return out


#: What may follow a tag's name.
_AFTER_NAME = set("\t\n\f\r />")


def weak_label(at: Place, text: str, links: float) -> int:
    """1 for main text by plain rules about the path; outside of articles, by length and links."""
    if at.other:
        return 0
    if at.article:
        return 1
    return int(links < 0.3 and (len(text) >= 60 or at.tag in ("p", "h1", "h2", "h3")))


def _varied(page: list, rng: np.random.Generator) -> list[tuple[Place, str, float, int]]:
    """The page with labels; mostly with foreign blocks added and its article in another container."""
    labelled = [(p, t, k, weak_label(p, t, k)) for p, t, k in page]
    if rng.random() < 0.2 or not labelled:
        return labelled
    frames = [("main",), ("article", ".post"), ("div", ".content"), ("div", ".entry"), ("section", ".story"), ("main", "article"), ("article", "section")]
    frame = frames[rng.integers(len(frames))]
    leaf = ("p", "p", "p", "li", "blockquote", "h2", "h3", "td", "pre", "div", "dd", "figcaption")
    out = []
    for at, text, links, label in labelled:
        if label:
            kind = at.tag if at.tag in ("p", "h1") and rng.random() < 0.7 else leaf[rng.integers(len(leaf))]
            wrap = ("ul",) if kind == "li" else ("table", "tr") if kind == "td" else ()
            at = place(("html", "body", *frame, *wrap, kind))
        out.append((at, text, links, label))
    texts = [t for _, t, _, _ in labelled]
    tags, names = sorted(OTHER_TAGS), sorted(OTHER_NAMES)
    for _ in range(rng.integers(3, 10)):
        inside = ("article",) if rng.random() < 0.5 else ()
        outer = (tags[rng.integers(len(tags))],) if rng.random() < 0.5 else (("div", "section", "ul", "aside", "p")[rng.integers(5)], "." + names[rng.integers(len(names))])
        kind = (*(("ul",) if rng.random() < 0.3 else ()), leaf[rng.integers(len(leaf))])
        at = rng.integers(0, len(out) + 1)
        links = float(rng.random() < 0.4)
        out[at:at] = [(place(("html", "body", *inside, *outer, *kind)), texts[rng.integers(len(texts))], links, 0) for _ in range(rng.integers(1, 6))]
    return out


_hashed: dict[str, int] = {}


def _row(word: str, rows: int) -> int:
    got = _hashed.get(word)
    if got is None:
        got = zlib.crc32(word.encode("utf-8", "replace"))
        if len(_hashed) < 200_000:
            _hashed[word] = got
    return got % rows


class Page:
    """Features of a page's blocks: measures, hashed words as flat rows with bounds, and the path. That is
    the sum over the elements around a block, so it is kept as the tree: own rows of each place (`own`,
    with bounds), the place around it (`parent`, before it), places by depth (`levels`), and each
    block's place (`at`)."""

    def __init__(self, page: list):
        n = len(page)
        words = []
        self.measures = np.zeros((n, MEASURES), np.float32)
        number: dict[int, int] = {}
        places: list[Place] = []
        self.at = np.zeros(n, np.int64)
        for i, (at, text, links, *_) in enumerate(page):
            new = []
            while at is not None and id(at) not in number:
                new.append(at)
                at = at.parent
            for x in reversed(new):
                number[id(x)] = len(places)
                places.append(x)
            self.at[i] = number[id(page[i][0])]
            own = text.split(" ")
            words.append([_row(w, WORDS) for w in own])
            self.measures[i] = (np.log1p(len(own)) / 5, links, (text[-1] in ".!?:;\"'") * 1.0, i / max(1, n - 1))
        rows = [[_row(x, PATHS) for x in p.names] or [0] for p in places]
        self.own = (np.array([x for r in rows for x in r], np.int64), common.offsets([len(r) for r in rows]))
        self.parent = np.array([number[id(p.parent)] if p.parent is not None else -1 for p in places], np.int64)
        depth = np.array([p.depth for p in places], np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []
        self.words = (np.array([x for w in words for x in w], np.int64), common.offsets([len(w) for w in words]))
        self.size = n

    def path(self, table: np.ndarray) -> np.ndarray:
        """The sum of the rows of each block's path."""
        sums = _sums(table, *self.own)
        for level in self.levels[1:]:
            sums[level] += sums[self.parent[level]]
        return sums[self.at]

    def path_gradient(self, each: np.ndarray, grad: np.ndarray) -> None:
        """Adds to grad what the blocks' gradients come to for the rows of their paths."""
        sums = np.zeros((len(self.parent), each.shape[1]), np.float32)
        np.add.at(sums, self.at, each)
        for level in reversed(self.levels[1:]):
            np.add.at(sums, self.parent[level], sums[level])
        np.add.at(grad, self.own[0], np.repeat(sums, np.diff(self.own[1]), axis=0))


def _sums(table: np.ndarray, rows: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return np.add.reduceat(table[rows], cut[:-1], axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        d = PATH_DIM + WORD_DIM + MEASURES
        normal = lambda *shape: rng.normal(0, 0.2, shape).astype(np.float32)
        self.p = {"path": normal(PATHS, PATH_DIM), "words": normal(WORDS, WORD_DIM), "out": normal(2 * HIDDEN + d), "bias": np.zeros(1, np.float32)}
        for side in ("f", "b"):
            self.p |= {f"w{side}": normal(d + HIDDEN, 4 * HIDDEN), f"c{side}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{side}"][HIDDEN : 2 * HIDDEN] = 1

    def inputs(self, pages: list[Page]) -> list[np.ndarray]:
        return [np.concatenate([x.path(self.p["path"]), _sums(self.p["words"], *x.words) / np.diff(x.words[1])[:, None], x.measures], axis=1) for x in pages]

    def _lstm(self, side: str, x: np.ndarray, keep: list | None) -> np.ndarray:
        """x (block, page, feature) in reading order -> hidden states; keep gets what the gradient needs."""
        w, c0 = self.p[f"w{side}"], self.p[f"c{side}"]
        steps, n, _ = x.shape
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps):
            joined = np.concatenate([x[t], h], axis=1)
            z = joined @ w + c0
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep is not None:
                keep.append((joined, i, f, o, g, before, tc))
        return out

    @staticmethod
    def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, page, feature) padded at the end; the mask; and for each page the order that
        turns its own blocks round and leaves the padding at the end."""
        steps = max(len(r) for r in rows)
        x = np.zeros((steps, len(rows), rows[0].shape[1]), np.float32)
        mask = np.zeros((steps, len(rows)), bool)
        turn = np.tile(np.arange(steps)[:, None], (1, len(rows)))
        for j, r in enumerate(rows):
            x[: len(r), j] = r
            mask[: len(r), j] = True
            turn[: len(r), j] = np.arange(len(r))[::-1]
        return x, mask, turn

    def _forward(self, rows: list[np.ndarray], keep: dict | None = None):
        x, mask, turn = self._padded(rows)
        column = np.arange(x.shape[1])
        kf, kb = ([], []) if keep is not None else (None, None)
        f = self._lstm("f", x, kf)
        b = self._lstm("b", x[turn, column], kb)[turn, column]
        every = np.concatenate([f, b, x], axis=2)
        if keep is not None:
            keep |= {"x": x, "turn": turn, "f": kf, "b": kb, "every": every}
        return every @ self.p["out"] + self.p["bias"], mask

    def labels(self, pages: list[Page]) -> list[np.ndarray]:
        """Whether each block is main text. Pages of like length go through together."""
        out = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p.size), key=lambda i: pages[i].size)
        for lo, hi in common.batches([pages[i].size for i in order], 16_384):
            own = order[lo:hi]
            logit, _ = self._forward(self.inputs([pages[i] for i in own]))
            for j, i in enumerate(own):
                out[i] = logit[: pages[i].size, j] >= 0
        return out

    def _back(self, side: str, keep: list, d_out: np.ndarray, grads: dict) -> np.ndarray:
        w = self.p[f"w{side}"]
        steps, n, _ = d_out.shape
        d = w.shape[0] - HIDDEN
        dx = np.empty((steps, n, d), np.float32)
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        gw, gc = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32)
        for t in range(steps - 1, -1, -1):
            joined, i, f, o, g, before, tc = keep[t]
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            gw += joined.T @ dz
            gc += dz.sum(0)
            back = dz @ w.T
            dx[t], dh = back[:, :d], back[:, d:]
            dc = dc * f
        grads[f"w{side}"], grads[f"c{side}"] = gw, gc
        return dx

    def train(self, pages: list[Page], y: list[np.ndarray], epochs: int = EPOCHS, batch: int = 16, step: float = 0.01, seed: int = 2) -> "Labeller":
        """Adam on the cross entropy of the blocks."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        by_size = sorted(range(len(pages)), key=lambda i: pages[i].size)
        groups = [by_size[k : k + batch] for k in range(0, len(by_size), batch)]
        for _ in range(epochs):
            for g in rng.permutation(len(groups)):
                own = [pages[i] for i in groups[g]]
                keep: dict = {}
                logit, mask = self._forward(self.inputs(own), keep)
                target = np.zeros_like(logit)
                for j, i in enumerate(groups[g]):
                    target[: len(y[i]), j] = y[i]
                d = (_sigmoid(logit) - target) * mask / mask.sum()
                grads = {"out": np.tensordot(d, keep["every"], ([0, 1], [0, 1])), "bias": d.sum(keepdims=True).reshape(1)}
                d_every = d[:, :, None] * self.p["out"]
                column = np.arange(d.shape[1])
                dx = d_every[:, :, 2 * HIDDEN :] + self._back("f", keep["f"], d_every[:, :, :HIDDEN], grads)
                dx = dx + self._back("b", keep["b"], d_every[:, :, HIDDEN : 2 * HIDDEN][keep["turn"], column], grads)[keep["turn"], column]
                grads["path"], grads["words"] = np.zeros_like(self.p["path"]), np.zeros_like(self.p["words"])
                for j, page in enumerate(own):
                    page.path_gradient(dx[: page.size, j, :PATH_DIM], grads["path"])
                    rows, cut = page.words
                    n = np.diff(cut)
                    np.add.at(grads["words"], rows, np.repeat(dx[: page.size, j, PATH_DIM : PATH_DIM + WORD_DIM] / n[:, None], n, axis=0))
                t += 1
                for k, v in grads.items():
                    first[k] += 0.1 * (v - first[k])
                    second[k] += 0.001 * (v * v - second[k])
                    self.p[k] -= (step * (1 - (t - 1) / (epochs * len(groups))) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def train(pages: DataFrame, rows: int = SAMPLE, size: int = SAMPLE_BYTES) -> Labeller:
    """Learn from up to `rows` pages and `size` bytes of them, whole ones (see common.sample), each varied
    so often that they make up VARIED pages, though eight times at most."""
    own = pages.select(F.col("page_id").cast("long"), F.col("html").cast("string"), F.lit(0).alias("all"))
    got = common.sample(own, "page_id", "html", "all", rows, size)
    rng = np.random.default_rng(4)
    times = min(8, max(1, VARIED // max(1, len(got))))
    varied = [v for v in (_varied(blocks(h), rng) for _ in range(times) for h in got["text"]) if v]
    model = Labeller()
    if varied:
        model.train([Page(v) for v in varied], [np.array([x[3] for x in v], np.float32) for v in varied])
    return model


def extract(pages: DataFrame, model: Labeller, into: str = "main_text") -> DataFrame:
    """pages, whose columns stay, with a column `into`: the blocks labelled main text, one a line. If there is one of
    that name, the new one gets underscores in front (common.fresh). Null and empty html give an empty text.
    Rows keep their places, repeated ones are told alike; nothing is cut."""
    into = common.fresh(pages, into)
    told = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def look(source: pd.Series) -> pd.Series:
        out = []
        texts = ["" if not isinstance(x, str) else x for x in source]
        for lo, hi in common.batches([len(t) for t in texts], 2 << 20):
            own = [blocks(t) for t in texts[lo:hi]]
            for page, keep in zip(own, told.value.labels([Page(b) for b in own])):
                out.append("\n".join(b[1] for b, k in zip(page, keep) if k))
        return pd.Series(out, dtype=object)

    return pages.withColumn(into, look(F.col("html").cast("string")))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("long"), "url", "html")
    found = extract(pages, train(pages))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
