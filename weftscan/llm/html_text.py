"""Main text of web pages by a recurrent block labeller.

A page becomes its leaf blocks, each with a vector of its tag path (names, and words of class and id), of its hashed
words, and of a few measures. A bidirectional LSTM in numpy reads the sequence of a whole page and says of every
block whether it is main text. It is trained here, on pages that :func:`training_pages` makes up with known labels.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import narrow_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>", re.S)
#: What takes the rest of a page where no ``>`` follows.
_OPEN = re.compile(r"<[!?]")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Elements whose content is no text, those of them that take the rest of a page if they do not end, elements that hold nothing, and those that do not end a block.
RAW = frozenset("script style textarea title iframe select".split())
ENDLESS = frozenset("script style".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset(
    "math maction merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation".split()
)
#: What an open element of the first kind ends at.
_ENDS = {"p": frozenset("p div ul ol li dl dt dd h1 h2 h3 h4 h5 h6 table tr td th pre blockquote form section article aside header footer nav main figure hr".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}

TAGS, NAMES, WORDS, MEASURES = 64, 96, 48, 8
WIDTH = TAGS + NAMES + WORDS + MEASURES
HIDDEN = 20
PAGES, EPOCHS, BATCH, RATE = 700, 8, 32, 0.01


@lru_cache(maxsize=1 << 16)
def _bucket(word: str, n: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % n


class Block:
    __slots__ = ("text", "linked", "path", "names")

    def __init__(self, text: str, linked: int, path: list[str], names: list[str]):
        self.text, self.linked, self.path, self.names = text, linked, path, names


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order: decoded, white space turned into single spaces, empty ones left out.

    Tags that are never closed or never opened do no harm; a comment, script or style that does not end takes the rest,
    any other raw element that does not end is its tag alone. Markup in ``xmp`` is text.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0
    where: list[tuple[str, tuple[str, ...]]] = []
    in_link = 0
    spoken = False  # whether the parts hold more than blanks
    last = page.rfind(">")  # beyond it there are no tags
    endless: set[str] = set()  # raw elements without a further end tag in the page
    deeper: Counter[str] = Counter()  # elements open beyond what the stack holds

    def flush() -> None:
        nonlocal linked, spoken
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, linked, [t for t, _ in where], [n for _, ns in where for n in ns]))
            parts.clear()
        linked, spoken = 0, False

    def put(raw: str, decode: bool = True) -> None:
        nonlocal linked, where, spoken
        if raw:
            text = html.unescape(raw) if decode and "&" in raw else raw
            if not spoken:
                where, spoken = list(stack), not text.isspace()
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at) if at <= last or _OPEN.search(page, at) else None
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        name, attributes = (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
        if not name:
            continue
        if m[1] or m[4]:
            if name not in INLINE:
                flush()
            if deeper[name]:
                deeper[name] -= 1
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        deeper.clear()
                        break
            if name == "a":
                in_link = 0
            continue
        empty = attributes.endswith("/")
        if name in RAW or name == "xmp":
            flush()
            end = None if empty or name in endless else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if end:
                if name == "xmp":
                    put(page[at : end.start()], False)
                    flush()
                at = end.end()
            elif not empty and name in ENDLESS:
                at = len(page)
            elif not empty:
                endless.add(name)
            continue
        if name == "br":
            parts.append(" ")
        if name not in INLINE and name != "br":
            flush()
            while stack and not deeper.total() and (name in _ENDS.get(stack[-1][0], ()) or (stack[-1][0] in INLINE and any(name in _ENDS.get(t, ()) for t, _ in stack[-4:]))):
                stack.pop()
        if name not in VOID and not empty:
            found = tuple(p.lower() for a in _ATTRIBUTE.finditer(attributes) for p in _PIECE.findall(a[2] or a[3] or a[4] or ""))
            if len(stack) < 200:
                stack.append((name, found))
            else:
                deeper[name] += 1
            if name == "a":
                in_link = 1
    flush()
    return out


def vectors(found: list[Block]) -> np.ndarray:
    x = np.zeros((len(found), WIDTH), np.float32)
    for k, b in enumerate(found):
        row = x[k]
        for t in b.path:
            row[_bucket(t, TAGS)] = 1
        for n in b.names:
            row[TAGS + _bucket(n, NAMES)] = 1
        words = b.text.lower().split()
        n = len(b.text)
        m = TAGS + NAMES + WORDS
        for w in words:
            row[TAGS + NAMES + _bucket(w, WORDS)] += 1
        row[TAGS + NAMES : m] = np.log1p(row[TAGS + NAMES : m]) / 3
        row[m] = np.log1p(len(words)) / 4
        row[m + 1] = min(1.0, b.linked / n)
        row[m + 2] = b.text[-1] in ".!?:"
        row[m + 3] = min(1.0, 10 * sum(map(b.text.count, ",.;")) / n)
        row[m + 4] = k / len(found)
        row[m + 5] = 1.0 if k == 0 else 0.0
        row[m + 6] = b.text[0] in "©®"
        row[m + 7] = len(b.path) / 12
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


Model = dict[str, np.ndarray]


def _scan(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """One direction of the LSTM over (batch, time, width); padded steps keep the state."""
    n, steps, _ = x.shape
    size = u.shape[0]
    h, c = np.zeros((n, size), x.dtype), np.zeros((n, size), x.dtype)
    out, kept = np.zeros((n, steps, size), x.dtype), []
    inputs = x @ w + b
    for t in range(steps):
        z = inputs[:, t] + h @ u
        i, f, o, g = _sigmoid(z[:, :size]), _sigmoid(z[:, size : 2 * size]), _sigmoid(z[:, 2 * size : 3 * size]), np.tanh(z[:, 3 * size :])
        on = mask[:, t, None]
        new = f * c + i * g
        th = np.tanh(new)
        kept.append((h, c, i, f, o, g, th, on))
        c = np.where(on, new, c)
        h = np.where(on, o * th, h)
        out[:, t] = h
    return out, kept


def _scan_back(x: np.ndarray, u: np.ndarray, kept: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, steps, _ = x.shape
    size = u.shape[0]
    dh, dc = np.zeros((n, size), x.dtype), np.zeros((n, size), x.dtype)
    dz_all, du = np.zeros((n, steps, 4 * size), x.dtype), np.zeros_like(u)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, th, on = kept[t]
        dh = dh + dout[:, t]
        live = np.where(on, dh, 0)
        dnew = np.where(on, dc, 0) + live * o * (1 - th * th)
        dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), live * th * o * (1 - o), dnew * i * (1 - g * g)], axis=1)
        dz_all[:, t] = dz
        du += h.T @ dz
        dh = np.where(on, 0, dh) + dz @ u.T
        dc = np.where(on, dnew * f, dc)
    flat = dz_all.reshape(-1, 4 * size)
    return x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(axis=0)


def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, mask = np.zeros((len(pages), longest, WIDTH), np.float32), np.zeros((len(pages), longest), bool)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, True
    return x, mask


def _forward(m: Model, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
    one, kept1 = _scan(x, mask, m["w1"], m["u1"], m["b1"])
    two, kept2 = _scan(x[:, ::-1], mask[:, ::-1], m["w2"], m["u2"], m["b2"])
    both = np.concatenate([one, two[:, ::-1]], axis=2)
    return _sigmoid(both @ m["v"] + m["c"]), (both, kept1, kept2)


def train(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 0) -> Model:
    """Weights from (vectors, labels) of pages, by Adam on the log loss of every block."""
    rng = np.random.default_rng(seed)
    m: Model = {}
    for k in "12":
        m["w" + k], m["u" + k] = rng.normal(0, 0.1, (WIDTH, 4 * HIDDEN)), rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
        m["b" + k] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
    m["v"], m["c"] = rng.normal(0, 0.2, 2 * HIDDEN), np.zeros(1)
    m = {k: v.astype(np.float32) for k, v in m.items()}
    pages = sorted(pages, key=lambda p: len(p[0]))
    groups = [pages[k : k + BATCH] for k in range(0, len(pages), BATCH)]
    one, two, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    for _ in range(epochs):
        for g in rng.permutation(len(groups)):
            x, mask = _pad([p[0] for p in groups[g]])
            y = np.zeros(mask.shape, np.float32)
            for k, p in enumerate(groups[g]):
                y[k, : len(p[1])] = p[1]
            p, (both, kept1, kept2) = _forward(m, x, mask)
            error = np.where(mask, p - y, 0) / mask.sum()
            dboth = error[:, :, None] * m["v"]
            w1, u1, b1 = _scan_back(x, m["u1"], kept1, dboth[:, :, :HIDDEN])
            w2, u2, b2 = _scan_back(x[:, ::-1], m["u2"], kept2, dboth[:, ::-1, HIDDEN:])
            grads = {"w1": w1, "u1": u1, "b1": b1, "w2": w2, "u2": u2, "b2": b2, "v": (both * error[:, :, None]).sum(axis=(0, 1)), "c": error.sum(keepdims=True).ravel()[:1]}
            step += 1
            for k, d in grads.items():
                d = np.clip(d, -1, 1)
                one[k] = 0.9 * one[k] + 0.1 * d
                two[k] = 0.999 * two[k] + 0.001 * d * d
                m[k] = (m[k] - RATE * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def label(m: Model, pages: list[np.ndarray]) -> list[np.ndarray]:
    """The probability of main text for each block of each page."""
    out: list[np.ndarray] = [np.empty(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    for at in range(0, len(order), 64):
        part = order[at : at + 64]
        p, _ = _forward(m, *_pad([pages[k] for k in part]))
        for row, k in zip(p, part, strict=True):
            out[k] = row[: len(pages[k])]
    return out


_PARTS = "an en or al is ti ra me no so ve lu ka mi to de fe ga ri po sha ber und que ción eau the ing tion st oli".split()


def training_pages(n: int = PAGES, seed: int = 5) -> Iterator[tuple[str, list[int]]]:
    """Made-up pages with the label of every block: 1 for the article's headings, paragraphs, lists, quotes, tables and captions."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p

    def word() -> str:
        w = "".join(_PARTS[k] for k in rng.integers(0, len(_PARTS), int(rng.integers(1, 4))))
        return w + mark if mark else w

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(int(rng.integers(low, high))))

    def sentence() -> str:
        return words(1, 16).capitalize() + pick(".", ".", ".", ",", "")

    def text() -> str:
        return " ".join(sentence() for _ in range(int(rng.integers(1, 6)))) + pick("", ".", "&amp; more.", "&eacute;")

    for _ in range(n):
        mark = pick(*[""] * 8, "%%%", "***", "!!", "&amp;&amp;")
        out, labels = [], []
        emit = lambda s: out.append(s)

        def block(tag: str, inner: str, y: int, attrs: str = "", close: bool = True, out=out, labels=labels) -> None:
            out.append(f"<{tag}{attrs}>{inner}" + (f"</{tag}>" if close else ""))
            labels.append(y)

        def attr(*names: str) -> str:
            return f' {pick("class", "class", "id")}="{pick("", "", "site-", "page_", "js-")}{pick(*names)}{pick("", "", "-" + pick("inner", "wrap", "box", "1", "container"))}"'

        def links(wrap: str, attrs: str) -> None:
            emit(f"<{wrap}{attrs}>" + pick("", "<ul>"))
            for _ in range(int(rng.integers(2, 9))):
                block(pick("li", "li", "div"), f'<a href="/{word()}">{words(1, 4)}</a>', 0)
            emit(f"</{wrap}>")

        def junk() -> None:
            kind = int(rng.integers(9))
            if kind == 0:
                links(*pick(("nav", ""), ("nav", attr("nav", "menu")), ("div", attr("nav", "menu", "navigation", "navbar", "breadcrumb", "topbar", "links"))))
            elif kind == 1:
                block("div", text(), 0, attr("ad", "ads", "advert", "advertisement", "sponsor", "promo", "banner", "sponsored"))
            elif kind == 2:
                tag, attrs = pick(("aside", ""), ("aside", attr("sidebar", "related")), ("div", attr("sidebar", "related", "widget", "recommended", "trending", "popular", "side")))
                emit(f"<{tag}{attrs}>")
                for _ in range(int(rng.integers(1, 5))):
                    block(pick("h3", "p", "li", "div"), pick(words(1, 6), text(), f'<a href="#">{words(2, 6)}</a>'), 0)
                emit(f"</{tag}>")
            elif kind == 3:
                emit("<form" + pick("", attr("search", "subscribe", "newsletter", "login", "signup", "contact")) + ">")
                block(pick("label", "div", "p"), pick(text(), words(1, 5)), 0)
                emit("<input type=text>")
                if chance(0.7):
                    block("button", words(1, 3), 0)
                emit("</form>")
            elif kind == 4:
                block(pick("div", "section", "p"), text(), 0, attr("cookie", "consent", "notice", "gdpr", "alert", "popup", "modal", "cookies", "privacy", "disclaimer", "message", "paywall"))
            elif kind == 5:
                tag = pick("section", "div")
                emit(f"<{tag}{attr('comments', 'comment', 'discussion', 'replies', 'responses', 'disqus', 'feedback')}>")
                if chance(0.5):
                    block("h2", words(1, 4), 0)
                for _ in range(int(rng.integers(1, 6))):
                    if chance(0.3):
                        emit("<article" + attr("comment", "reply") + ">")
                        block("p", text(), 0)
                        emit("</article>")
                    else:
                        block(pick("p", "div", "li"), text(), 0, pick("", attr("comment", "reply", "comment-body")))
                emit(f"</{tag}>")
            elif kind == 6:
                block(pick("div", "ul"), f'<a href="#">{words(1, 3)}</a> <a href="#">{words(1, 3)}</a>', 0, attr("share", "social", "tags", "sharing", "follow", "toolbar", "meta", "byline", "pagination"))
            elif kind == 7:
                tag, attrs = pick(("header", ""), ("header", attr("header", "masthead")), ("div", attr("header", "masthead", "top", "logo", "branding")))
                emit(f"<{tag}{attrs}>")
                for _ in range(int(rng.integers(1, 3))):
                    block(pick("h1", "p", "div", "h2"), words(1, 6), 0)
                if chance(0.4):
                    links("nav", "")
                emit(f"</{tag}>")
            else:
                emit("<!-- " + words(1, 4) + " -->")

        def footer() -> None:
            tag, attrs = pick(("footer", ""), ("footer", ""), ("footer", attr("footer")), ("div", attr("footer", "bottom", "copyright", "colophon", "legal")))
            emit(f"<{tag}{attrs}>" + pick("", "&copy; ", "&copy; ") + pick(text(), words(2, 10)))
            labels.append(0)
            if chance(0.4):
                links(pick("ul", "nav", "div"), "")
            emit(f"</{tag}>")

        def body_part() -> None:
            kind = int(rng.integers(14))
            if kind <= 7:
                if chance(0.15):
                    block("p", f"<b>{text()}<br>", 1, close=False)
                else:
                    inner = text()
                    block("p", inner if chance(0.7) else f'{inner} <a href="#">{words(1, 3)}</a> {pick("<i>", "<span>")}{words(1, 4)}</i>', 1, close=chance(0.9))
            elif kind == 8:
                block(pick("h2", "h3", "h4"), words(1, 8), 1)
            elif kind == 9:
                emit(pick("<ul>", "<ol>"))
                for _ in range(int(rng.integers(1, 5))):
                    block("li", pick(text(), words(1, 8)), 1)
                emit("</ul>")
            elif kind == 10:
                block(pick("blockquote", "pre", "div"), text(), 1)
            elif kind == 11:
                emit("<figure><img src=x>")
                block("figcaption", words(2, 9), 1)
                emit("</figure>")
            elif kind == 12:
                emit("<table><tr>")
                for _ in range(int(rng.integers(1, 5))):
                    block(pick("td", "th"), words(1, 4), 1)
                emit("</table>")
            else:
                block("p", word(), 1)

        emit("<!DOCTYPE html><html><head><title>" + words(2, 6) + "</title><script>var a='<p>';</script></head><body>")
        for _ in range(int(rng.integers(0, 4))):
            junk()
        tag, attrs = pick(("article", ""), ("article", ""), ("article", ""), ("article", attr("post", "story")), ("main", ""), ("div", attr("content", "article", "post", "entry", "story", "main", "article-body", "post-content", "text", "body")))
        outer = pick("", "", "<main>", '<div id="page">', '<div class="container">')
        emit(outer + f"<{tag}{attrs}>")
        if chance(0.85):
            block("h1", words(1, 10), 1)
        for _ in range(int(rng.integers(1, 16))):
            body_part()
            if chance(0.06):
                junk()
        emit(f"</{tag}>")
        if outer:
            emit({"<main>": "</main>"}.get(outer, "</div>"))
        for _ in range(int(rng.integers(0, 3))):
            junk()
        if chance(0.9):
            footer()
        emit(pick("", "</body></html>"))
        yield "".join(out), labels


@lru_cache(maxsize=2)
def default_model(pages: int = PAGES, epochs: int = EPOCHS) -> tuple[tuple[str, np.ndarray], ...]:
    made = []
    for page, y in training_pages(pages):
        found = blocks(page)
        if len(found) == len(y):
            made.append((vectors(found), np.array(y, float)))
    return tuple(train(made, epochs).items())


EXTRACTED = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def main_text(m: Model, pages: list[str | None], threshold: float = 0.5) -> list[str]:
    found = [blocks(p) for p in pages]
    scored = label(m, [vectors(f) for f in found])
    return [" ".join(b.text for b, p in zip(f, ps, strict=True) if p >= threshold) for f, ps in zip(found, scored, strict=True)]


def extract(pages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html; other columns are not read).

    Null and empty pages give an empty text; null ids and urls stay null; repeated rows are read each.
    """
    narrow_batches(pages.sparkSession, 256)
    model = dict(default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_text(model, batch.column(2).to_pylist(), threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=EXTRACTED.names)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, EXTRACTED)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
