"""Main text of web pages by a recurrent labeller of blocks (operator 10)."""

from __future__ import annotations

import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import text_of
from platewise.llm.tokens import slices

# Elements whose content is never shown as text, elements without content, and elements inside a line.
HIDDEN = set("script style noscript template head title iframe object svg canvas math select textarea button "
             "datalist audio video map".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output progress "
             "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input".split())
#: A start tag of the first closes an open element of the second.
CLOSES = {t: ("p",) for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header "
          "hr main nav ol p pre section table ul".split()} | {
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"),
    "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
SCOPES = set("ul ol dl table article section div body td th aside nav main header footer form blockquote".split())

#: Hidden elements whose content is text up to their end tag, whatever it looks like; script and style the parser knows.
RAW = ("title", "textarea", "iframe", "noscript")
RAW_END = re.compile(r"</\s*(" + "|".join(RAW) + r")\s*>", re.IGNORECASE)
COMMENT_END = re.compile(r"--(?:\s*|!)>")

PATH_BITS, WORD_BITS, PLAIN = 64, 24, 6
FEATURES = PATH_BITS + WORD_BITS + PLAIN
HIDDEN_UNITS = 16


class Blocks(HTMLParser):
    """Leaf blocks of a page in order: (names on the path from the body, text, letters inside links)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple]] = []
        self.blocks: list[tuple[tuple, str, int]] = []
        self.buffer: list[str] = []
        self.linked = self.hidden = self.anchors = 0
        self.ends: dict[str, int] = {}

    def read(self, html):
        """Parse a whole page, fed at once."""
        # the last end tag of each raw element, counted from the page's end: without one, the element hides nothing more
        self.ends = {m[1].lower(): len(html) - m.start() for m in RAW_END.finditer(html)}
        self.feed(html)
        self.close()
        self.flush()

    def parse_starttag(self, i):
        k = super().parse_starttag(i)
        tag = self.lasttag
        if k >= 0 and self.stack and self.stack[-1][0] == tag and len(self.rawdata) - k >= self.ends.get(tag, len(self.rawdata) + 1):
            self.set_cdata_mode(tag)
        return k

    def parse_comment(self, i, report=1):
        """A comment ends at --> or --!>, at once in <!--> and <!--->, and at the page's end if nowhere before."""
        for short in ("<!-->", "<!--->"):
            if self.rawdata.startswith(short, i):
                return i + len(short)
        end = COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def flush(self):
        text = " ".join("".join(self.buffer).split())
        if text:
            path = tuple(n for tag, names in self.stack if tag not in INLINE for n in names)
            self.blocks.append((path, text, self.linked))
        self.buffer, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
        if tag == "br":
            self.buffer.append(" ")
        if tag in VOID:
            return
        if tag == "body":
            self.stack, self.hidden, self.anchors = [], 0, 0  # what a head left open ends here
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in CLOSES.get(tag, ()):
                self._cut(i)
                break
            if self.stack[i][0] in SCOPES:
                break
        names = [tag]
        for key, value in attrs:
            if key in ("class", "id", "role", "itemprop") and value:
                names += [f".{part}" for part in value.lower().replace("_", "-").replace(" ", "-").split("-") if part]
        self.stack.append((tag, tuple(names)))
        self.hidden += tag in HIDDEN
        self.anchors += tag == "a"

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag in INLINE:
            self.handle_starttag(tag, attrs)
            if tag not in VOID:
                self.handle_endtag(tag)
        else:  # the slash means nothing on other elements
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if tag not in INLINE:
                    self.flush()
                self._cut(i)
                return
            if tag in INLINE and self.stack[i][0] not in INLINE:
                return  # an inline end tag does not close blocks
        if tag not in INLINE:
            self.flush()

    def _cut(self, at):
        self.hidden -= sum(t in HIDDEN for t, _ in self.stack[at:])
        self.anchors -= sum(t == "a" for t, _ in self.stack[at:])
        del self.stack[at:]

    def handle_data(self, data):
        if not self.hidden:
            self.buffer.append(data)
            if self.anchors:
                self.linked += len(data)


def blocks_of(html: str) -> list[tuple[tuple, str, int]]:
    """The blocks of a page; a tag or comment that the end of the page cuts off is no text. What is a comment, the parser says."""
    open_ = html.rfind("<")
    if open_ >= 0 and ">" not in html[open_:] and (open_ + 1 == len(html) or html[open_ + 1].isalpha()
                                                   or html[open_ + 1] in "/!?"):
        html = html[:open_]
    parser = Blocks()
    parser.read(html)
    return parser.blocks


_HASHED: dict[str, int] = {}


def _hash(name: str) -> int:
    at = _HASHED.get(name)
    if at is None:
        if len(_HASHED) > 200_000:
            _HASHED.clear()
        at = _HASHED[name] = zlib.crc32(name.encode("utf-8", "surrogatepass"))
    return at


def features(blocks: list[tuple[tuple, str, int]]) -> np.ndarray:
    """A row per block: hashed tag path, hashed words, and lengths, links, punctuation and place."""
    out, crc = np.zeros((len(blocks), FEATURES), np.float32), zlib.crc32
    for i, (path, text, linked) in enumerate(blocks):
        row = out[i]
        for name in path:
            row[_hash(name) % PATH_BITS] = 1
        if path:
            row[_hash("last " + path[-1]) % PATH_BITS] = 1
        words = text.lower().split()
        n, found = len(words), [0] * WORD_BITS
        for w in words:
            found[crc(w.encode("utf-8", "surrogatepass")) % WORD_BITS] += 1
        row[PATH_BITS:PATH_BITS + WORD_BITS] = found
        row[PATH_BITS:PATH_BITS + WORD_BITS] /= n ** 0.5 * 4
        row[-PLAIN:] = (min(np.log1p(n) / 5, 2), linked / len(text), min(sum(text.count(c) for c in ".,;!?") / n, 1),
                        text[-1] in ".!?:", i / len(blocks), 1)
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM over the blocks of a page, with one score per block."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        h = HIDDEN_UNITS
        self.p = {}
        for d in "fb":
            self.p["W" + d] = rng.normal(0, 0.15, (FEATURES, 4 * h))
            self.p["U" + d] = rng.normal(0, 0.15, (h, 4 * h))
            self.p["c" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.p["v"] = rng.normal(0, 0.15, 2 * h)
        self.p["o"] = np.zeros(1)

    def _run(self, d, x, mask, keep=False):
        """States over time of one direction; x: time, page, feature."""
        h = HIDDEN_UNITS
        steps, n, _ = x.shape
        z_in = x @ self.p["W" + d] + self.p["c" + d]
        out = np.zeros((steps, n, h))
        state, cell, tape = np.zeros((n, h)), np.zeros((n, h)), []
        for t in (range(steps) if d == "f" else range(steps - 1, -1, -1)):
            z = z_in[t] + state @ self.p["U" + d]
            gates = _sigmoid(z[:, :3 * h])
            i, f, o = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:]
            g = np.tanh(z[:, 3 * h:])
            m = mask[t][:, None]
            new = f * cell + i * g
            tanh = np.tanh(new)
            if keep:
                tape.append((t, state, cell, i, f, o, g, tanh, m))
            cell = m * new + (1 - m) * cell
            state = m * (o * tanh) + (1 - m) * state
            out[t] = state
        return out, tape

    def _scores(self, x, mask):
        both = np.concatenate([self._run("f", x, mask)[0], self._run("b", x, mask)[0]], axis=2)
        return both @ self.p["v"] + self.p["o"]

    @staticmethod
    def _pad(pages):
        steps = max(len(p) for p in pages)
        x, mask = np.zeros((steps, len(pages), FEATURES)), np.zeros((steps, len(pages)))
        for k, p in enumerate(pages):
            x[:len(p), k], mask[:len(p), k] = p, 1
        return x, mask

    def predict(self, pages: list[np.ndarray], at_once: int = 2048) -> list[np.ndarray]:
        """For each page which blocks are main text; pages of like length go together, `at_once` blocks or one page."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        start = 0
        while start < len(order):
            stop = start + 1
            while stop < len(order) and (stop + 1 - start) * len(pages[order[stop]]) <= at_once:
                stop += 1
            group = order[start:stop]
            scores = self._scores(*self._pad([pages[k] for k in group]))
            for j, k in enumerate(group):
                out[k] = scores[:len(pages[k]), j] > 0
            start = stop
        return out

    def _gradients(self, x, mask, y):
        h = HIDDEN_UNITS
        runs = {d: self._run(d, x, mask, keep=True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        error = (_sigmoid(both @ self.p["v"] + self.p["o"]) - y) * mask / mask.sum()
        grad = {"v": np.einsum("tn,tnh->h", error, both), "o": np.array([error.sum()])}
        for k, d in enumerate("fb"):
            d_out = error[:, :, None] * self.p["v"][k * h:(k + 1) * h]
            d_state, d_cell = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
            d_z_all, d_u = np.zeros((*x.shape[:2], 4 * h)), np.zeros((h, 4 * h))
            for t, state, cell, i, f, o, g, tanh, m in reversed(runs[d][1]):
                d_state = d_state + d_out[t]
                d_new = m * (d_state * o * (1 - tanh ** 2) + d_cell)
                d_z = np.concatenate([d_new * g * i * (1 - i), d_new * cell * f * (1 - f),
                                      m * d_state * tanh * o * (1 - o), d_new * i * (1 - g ** 2)], axis=1)
                d_z_all[t] = d_z
                d_u += state.T @ d_z
                d_state = d_z @ self.p["U" + d].T + (1 - m) * d_state
                d_cell = d_new * f + (1 - m) * d_cell
            grad |= {"U" + d: d_u, "W" + d: np.einsum("tnf,tnz->fz", x, d_z_all), "c" + d: d_z_all.sum((0, 1))}
        return grad

    def fit(self, pages, labels, epochs: int = 6, batch: int = 16, rate: float = 0.02, seed: int = 0):
        """Adam on mean cross-entropy."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for s in range(0, len(order), batch):
                group = order[s:s + batch]
                x, mask = self._pad([pages[k] for k in group])
                y = np.zeros_like(mask)
                for j, k in enumerate(group):
                    y[:len(labels[k]), j] = labels[k]
                step += 1
                for k, g in self._gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - rate * (first[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
        return self


def lesson(rng: random.Random) -> tuple[str, list[bool]]:
    """A made-up page with the label of each of its blocks, to learn from.

    Words are made of random syllables; what surrounds an article comes in many layouts: menus, bars, notices, adverts,
    side columns, forms, reader comments, footers, with and without semantic elements, names that say what a
    part is, end tags, and a cut-off end.
    """
    syllables = [a + b for a in "bdfgklmnprstvz" for b in ("a", "e", "i", "o", "u", "en", "or", "ü", "é", "ñ")]
    out: list[str] = []
    labels: list[bool] = []

    def words(low, high):
        return ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
                for _ in range(rng.randint(low, high))]

    def sentence(low, high):
        w = words(low, high)
        mark = rng.choice(["", "", "", "", "&amp;&amp;&amp;", "***", "!!"])
        w = [x + (mark if rng.random() < 0.7 else "") + ("," if rng.random() < 0.1 else "") for x in w]
        return " ".join(w).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def prose(low, high):
        return " ".join(sentence(3, 18) for _ in range(rng.randint(low, high)))

    def put(html, label):
        out.append(html)
        labels.append(label)

    def wrap(tag, names, body):
        # a part that says what it is by element, by class or id, or by both
        kind = rng.choice(["tag", "class", "id", "both"])
        name = rng.choice(names)
        if kind == "tag" and tag != "div":
            out.append(f"<{tag}>")
        else:
            tag = tag if kind == "both" else "div"
            out.append(f'<{tag} {"id" if kind == "id" else "class"}="{name}">')
        body()
        out.append(f"</{tag}>")

    def links(low, high):
        style = rng.choice(["list", "div", "span"])
        if style == "list":
            out.append("<ul>")
        items = [" ".join(words(1, 3)) for _ in range(rng.randint(low, high))]
        if style == "span":
            put("<div>" + " | ".join(f'<a href="/x">{x}</a>' for x in items) + "</div>", False)
        else:
            for x in items:
                t = "li" if style == "list" else "div"
                put(f'<{t}><a href="/{x}">{x}</a></{t}>', False)
        if style == "list":
            out.append("</ul>")

    def menu():
        wrap("nav", ["nav", "menu", "navbar main", "top-nav", "breadcrumb", "navigation"], lambda: links(2, 9))

    def head():
        def body():
            if rng.random() < 0.6:
                put("<{0}>{1}</{0}>".format(rng.choice(["div", "p", "h2"]), " ".join(words(1, 4))), False)
            if rng.random() < 0.4:
                links(2, 5)
        wrap("header", ["header", "site-header", "masthead", "banner", "topbar"], body)

    def ad():
        text = sentence(2, 12)
        wrap("div", ["ad", "ads", "advert", "sponsored", "promo", "banner-ad", "advertisement"],
             lambda: put(text if rng.random() < 0.5 else f"<p>{text}</p>", False))

    def notice():
        def body():
            put(f"<p>{prose(1, 2)}</p>", False)
            if rng.random() < 0.4:
                put(f'<div><a href="#">{" ".join(words(1, 2))}</a></div>', False)
        wrap("div", ["cookie-notice", "cookie", "consent", "notice", "alert", "gdpr-banner", "popup", "paywall",
                     "newsletter"], body)

    def aside():
        def body():
            put("<{0}>{1}</{0}>".format(rng.choice(["h3", "h2", "div"]), " ".join(words(1, 3))), False)
            links(2, 6) if rng.random() < 0.7 else put(f"<p>{prose(1, 2)}</p>", False)
        wrap("aside", ["sidebar", "aside", "related", "widget", "side-bar right", "recommended", "share social"], body)

    def form():
        out.append(f'<form class="{rng.choice(["search", "login", "subscribe", "contact"])}" action="/q">')
        put(f"<label>{' '.join(words(1, 3))}</label> <input name=q><div>", False)
        if rng.random() < 0.5:
            put(f"<p>{sentence(2, 10)}</p>", False)
        out.append("</div></form>")

    def comments():
        def body():
            if rng.random() < 0.7:
                put(f"<h3>{' '.join(words(1, 3))}</h3>", False)
            for _ in range(rng.randint(1, 6)):
                out.append(rng.choice(['<div class="comment">', "<li>", "<div>", '<article class="comment">']))
                tag = out[-1][1:].split(" ")[0].split(">")[0]
                if rng.random() < 0.5:
                    put(f"<span>{' '.join(words(1, 2))}</span><div></div>", False)
                put(f"<p>{prose(1, 3)}</p>", False)
                out.append(f"</{tag}>")
        wrap("section", ["comments", "comment-list", "reader-comments", "discussion", "replies", "disqus-thread"], body)

    def footer():
        def body():
            if rng.random() < 0.4:
                links(2, 6)
            put(f"<p>&copy; {' '.join(words(1, 3))} &middot; {sentence(2, 10)}</p>" if rng.random() < 0.5 else
                f"&copy; {'.'.join(words(2, 3))} &middot; {sentence(2, 10)}", False)
        wrap("footer", ["footer", "site-footer", "copyright", "legal", "bottom"], body)

    def article():
        if rng.random() < 0.85:
            lead = " ".join(words(2, 12))
            put(f"<h1>{lead}</h1>", True)
        for k in range(rng.choice([rng.randint(1, 4), rng.randint(4, 14), rng.randint(10, 40)])):
            kind = rng.random()
            if kind < 0.05:
                put(f"<h2>{' '.join(words(1, 6))}</h2>", True)
            elif kind < 0.09:
                out.append("<ul>")
                for _ in range(rng.randint(2, 5)):
                    put(f"<li>{sentence(2, 14)}</li>", True)
                out.append("</ul>")
            elif kind < 0.12:
                put(f"<blockquote>{prose(1, 3)}</blockquote>", True)
            elif kind < 0.15 and k:
                ad()
            elif kind < 0.17 and k:
                aside()
            elif kind < 0.25:
                put(f"<p>{' '.join(words(1, 3)).capitalize()}.</p>", True)
            elif kind < 0.33:
                put(f"<p><b>{prose(1, 3)}<br>", True)
            elif kind < 0.37:
                put(f'<p>{prose(1, 2)} <a href="/y">{" ".join(words(1, 3))}</a> {prose(1, 2)}</p>', True)
            else:
                put(f"<p>{prose(1, 7)}</p>", True)

    out.append("<!DOCTYPE html><html><head><title>x</title></head><body>")
    for part, p in ((notice, .2), (head, .4), (menu, .75), (form, .15), (ad, .4), (aside, .15)):
        if rng.random() < p:
            part()
    tag, names = rng.choice([("article", ""), ("article", ""), ("article", ""), ("main", ""), ("div", ' class="content"'),
                             ("div", ' class="post-content"'), ("div", ' id="article"'), ("section", ' class="story"'),
                             ("div", ' class="main-text"'), ("div", "")])
    outer = rng.random() < 0.3
    out.append(("<main>" if outer else "") + f"<{tag}{names}>")
    article()
    out.append(f"</{tag}>" + ("</main>" if outer else ""))
    for part, p in ((ad, .15), (aside, .3), (comments, .35), (form, .1), (notice, .1), (footer, .8)):
        if rng.random() < p:
            part()
    out.append("</body></html>")
    return "".join(out), labels


_TRAINED: dict[tuple, dict] = {}


def trained(n: int = 480, seed: int = 7, epochs: int = 8) -> dict:
    """Weights learned from `n` made-up pages; the same for the same arguments, and kept for the process."""
    key = (n, seed, epochs)
    if key not in _TRAINED:
        rng = random.Random(seed)
        pages, labels = [], []
        while len(pages) < n:
            html, y = lesson(rng)
            blocks = blocks_of(html)
            if len(blocks) == len(y):  # a part whose blocks ran together teaches nothing
                pages.append(features(blocks))
                labels.append(np.array(y, float))
        _TRAINED[key] = Labeller(seed).fit(pages, labels, epochs, seed=seed).p
    return _TRAINED[key]


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """`id, url, text, n_chars, n_blocks, kept_blocks` per row of `pages` (null html: empty).

    A page is parsed into blocks, white space in a block becomes one space, and the blocks that the labeller takes for main
    text are joined by line ends. Unclosed and cut-off markup is read as browsers do; a page without blocks has an
    empty text. Rows do not depend on each other, so repeated rows give repeated results and an empty table an
    empty one; no shuffle.
    """
    held = pages.sparkSession.sparkContext.broadcast(trained())  # some 60 kB
    plain = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), text_of(html).alias("html"))
    kind = plain.schema["id"].dataType.simpleString()

    def label(batches):
        model = Labeller()
        model.p = held.value
        for batch in batches:
            for part in slices(batch, "html"):
                found = [blocks_of(h) for h in part.column("html").to_pylist()]
                marks = model.predict([features(b) for b in found])
                texts = ["\n".join(b[1] for b, m in zip(bs, ms, strict=True) if m)
                         for bs, ms in zip(found, marks, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in found], pa.int64()),
                     pa.array([int(m.sum()) for m in marks], pa.int64())],
                    ["id", "url", "text", "n_chars", "n_blocks", "kept_blocks"])

    return plain.mapInArrow(label, f"id {kind}, url string, text string, n_chars long, n_blocks long, kept_blocks long"
                            ).withColumnsRenamed({"id": id, "url": url})
