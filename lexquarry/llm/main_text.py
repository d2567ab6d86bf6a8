"""Main text of web pages by a maximum-scoring run of tokens.

A page is a sequence of texts and tags.  A word scores what the kinds of its text
weigh: the elements around it, the words of their class and id, whether they carry
a mark of what is no article (an advert, a menu, reader comments and so on), whether
it is a link, how much of its block is links, how long the block is, and whether
it stands in, or beside, what a page marks as its article.  Tags score negative.  A
linear scan finds the run with the largest sum, and its texts that score positive
are the main text: character references are decoded, white space inside a block is
one space, blocks are joined by a line feed in page order.  A text that scores
negative counts once in the scan, however long, so that an advert inside an article
doesn't outweigh what follows; inside a marked article it and tags count little.

The weights are those of a logistic regression on labelled pages: those that mark
an article, of which SAMPLE at most, the least by a hash of their id, are read.
All kinds but two are learned as if the marked article were not marked, so that
they must tell words apart by themselves; the weights of standing in and beside a
marked article are learned after them.  They are drawn to PRIOR, which is what they
are without labelled pages.

A null or empty page, and one without words, has the empty text.  Markup that is
cut off or not closed ends with the page; a very long page takes memory in
proportion to it.  Repeated rows give repeated results; an empty table an empty
result.  Other columns stay; one with the name of a result is replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexquarry.llm.arrow import append
from lexquarry.llm.labelled import least_hashes

#: Labelled pages that the weights are learned from, at most.
SAMPLE = 2000
#: Steps of the fit, its rate, how far weights are drawn to PRIOR, and the words of a text that count in it.
STEPS, RATE, DECAY, COUNTED = 300, 0.1, 2e-3, 30
#: The largest score of a word; the least of a text set apart and of a tag, and what both are inside a marked article.
MOST, LEAST_TEXT, LEAST_TAG, INSIDE = 6.0, -2.0, -0.5, -0.05

# Fixed values of HTML: elements without content, elements whose content is no markup, block elements.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: Elements that a start tag closes, and elements that keep them open.
_CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("button caption dl html ol select table td template th ul".split())
#: Elements, roles and words of class or id that mark what is no article.
_APART = frozenset("aside button dialog footer form head iframe input label legend menu nav noscript object option script search select style svg template textarea title".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_MARKS = frozenset(
    "ad adbox ads adsense advert advertisement advertising advertorial adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion disqus footer footnav gdpr header login "
    "masthead menu modal nav navbar navigation navigationbar newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related reply replies respond search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?")
_SPACE = re.compile(r"[\s/]*")
_COMMENT = re.compile(r"--!?>|\Z")
_WORD = re.compile(r"[^\W\d_]+")

#: Weights without labelled pages.
PRIOR = {"word": 1.5, "article": 3.0, "beside": -12.0, "marked": -12.0, "hidden": -12.0, "header": -12.0, "link": -1.0, "links:2": -1.0, "links:3": -3.0, "long:0": -0.5, "long:3": 0.5, "long:4": 1.0, "sign": -6.0}


def _attributes(page: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """(name, value) of each attribute from behind a tag's name on, and where the tag ends."""
    out, end = [], len(page)
    while True:
        at = _SPACE.match(page, at).end()
        if at >= end:
            return out, end
        if page[at] == ">":
            return out, at + 1
        m = _ATTRIBUTE.match(page, at)
        out.append((m[1].lower(), m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""))
        at = m.end()


def _tokens(page: str):
    """("", text), (name, attributes) and ("/name", None) in page order."""
    at, end, text = 0, len(page), 0
    while at < end:
        at = page.find("<", at)
        if at < 0 or at + 1 >= end:
            break
        c = page[at + 1]
        if c in "!?" or c == "/" and not page[at + 2 : at + 3].isascii() or c == "/" and not page[at + 2 : at + 3].isalpha():
            if text < at:
                yield "", page[text:at]
            if page.startswith("<!--", at):
                stop = at + 5 if page.startswith("<!-->", at) else at + 6 if page.startswith("<!--->", at) else _COMMENT.search(page, at + 4).end()
            else:
                stop = page.find(">", at) + 1 or end
            at = text = stop
            continue
        m = _NAME.match(page, at + 1 + (c == "/"))
        if not m:
            at += 1
            continue
        if text < at:
            yield "", page[text:at]
        name = m[0].lower()
        attributes, at = _attributes(page, m.end())
        yield (f"/{name}", None) if c == "/" else (name, attributes)
        if c != "/" and name in _RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = close.start() if close else end
        text = at
    if text < end:
        yield "", page[text:]


def _element(name: str, attributes: list[tuple[str, str]]) -> tuple[frozenset[str], bool]:
    """The kinds that an element gives to the texts in it, and whether it says that it is the article."""
    kinds, article = set(), name in ("article", "main")
    if name in _APART:
        kinds |= {"marked", f"in:{name}"}
    elif name == "a":
        kinds.add("link")
    elif name not in ("article", "main", "html", "body"):
        kinds.add(f"in:{name}")
    for key, raw in attributes:
        value = html.unescape(raw)
        if key in ("class", "id"):
            words = {w.lower() for w in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", value) if w}
            if words & _MARKS and name not in ("html", "body", "article", "main") or words & {"comment", "teaser"} and name == "article":
                kinds.add("marked")
            kinds |= {f"named:{w}" for w in words}
        elif key == "role" and value.lower() in _ROLES:
            kinds.add("marked")
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            kinds.add("hidden")
        elif key == "itemprop" and value == "articleBody":
            article = True
    return frozenset(kinds), article and not kinds & {"marked", "hidden"}


def parse(page: str | None) -> list[tuple[str, str, frozenset[str], bool]]:
    """(tag, text, kinds of the elements around, whether in a marked article) of each token; a text has the tag ""."""
    out, inside = [], 0
    stack = [("", frozenset(), "", False)]  # name, kinds, nearest block, whether this is the article
    still = Counter()  # names of open elements, so that tags that close nothing cost nothing
    for tag, what in _tokens(page or ""):
        if not tag:
            out.append(("", what, stack[-1][1], inside > 0))
            continue
        name = tag.lstrip("/")
        if what is None or name in _BLOCK:
            closing = (name,) if what is None else ("p", *_CLOSES.get(name, ()))
            for i in range(len(stack) - 1, 0, -1) if any(still[c] for c in closing) else ():
                if stack[i][0] in closing:
                    inside -= sum(s[3] for s in stack[i:])
                    still.subtract(s[0] for s in stack[i:])
                    del stack[i:]
                    if what is None or stack[-1][0] not in closing:
                        break
                elif what is not None and (stack[i][0] in _SCOPE or stack[i][0] in ("article", "main", "section", "div", "body")):
                    break
        if what is None:
            out.append((tag, "", stack[-1][1], inside > 0))
            continue
        kinds, article = _element(name, what)
        if name == "header" and not inside:
            kinds |= {"header"}
        parent = stack[-1]
        block = name if name in _BLOCK and name not in ("html", "body", "article", "main") else parent[2]
        around = parent[1] | kinds
        if block != parent[2]:
            around = frozenset(k for k in around if k[:3] not in ("at:", "on:")) | {f"at:{block}", f"on:{parent[2]}"}
        out.append((name, "", around, inside > 0))
        if name not in _VOID and name not in _RAW:
            stack.append((name, around, block, article))
            still[name] += 1
            inside += article
    return out


def units(page: str | None) -> list[tuple[str, str, frozenset[str], bool, int]]:
    """The tokens of a page with the kinds of their texts complete, and the number of words of each text."""
    tokens, out, block = parse(page), [], []
    counts = [0 if tag else len(text.split()) for tag, text, _, _ in tokens]

    def close():
        n = sum(counts[i] for i in block)
        links = sum(counts[i] for i in block if "link" in tokens[i][2])
        share = f"links:{0 if not links else 1 if 3 * links < n else 2 if 3 * links < 2 * n else 3}"
        long = f"long:{0 if n < 3 else 1 if n < 8 else 2 if n < 16 else 3 if n < 40 else 4}"
        for i in block:
            tag, text, kinds, inside = tokens[i]
            out[i] = (tag, text, kinds | {"word", share, long} | ({"sign"} if "©" in text or "&copy" in text else set()), inside, counts[i])
        block.clear()

    for i, (tag, text, kinds, inside) in enumerate(tokens):
        out.append((tag, text, kinds, inside, counts[i]))
        if not tag:
            if counts[i]:
                block.append(i)
        elif tag.lstrip("/") in _BLOCK:
            close()
    close()
    return out


class Weights(dict):
    """Weight of each kind of text, of the kind "article", and of each tag (`<name>`); PRIOR where nothing is known."""

    def __missing__(self, kind: str) -> float:
        return -0.25 if kind[0] == "<" else PRIOR.get(kind, 0.0)

    def word(self, kinds: frozenset[str], where: str) -> float:
        """The score of a word, at most MOST; `where` is article, beside one, or empty where a page marks none."""
        return max(LEAST_TEXT, min(MOST, sum([self[k] for k in kinds]) + (self[where] if where else 0.0)))

    @classmethod
    def learn(cls, texts: list[tuple[tuple[str, ...], bool, float]], tags: list[tuple[str, int, int]]) -> "Weights":
        """From (kinds, whether in an article, words) and (tag, number inside articles, outside)."""
        out = cls({f"<{t}>": max(LEAST_TAG, min(-0.25, float(np.log((inside + 1) / (outside + 1))))) for t, inside, outside in tags})
        y = np.array([inside for _, inside, _ in texts], float)
        if not len(y) or y.min() == y.max():
            return out
        weight = np.array([n for _, _, n in texts], float)
        weight = np.where(y == 1, weight / weight[y == 1].sum(), weight / weight[y == 0].sum())
        number = {k: i for i, k in enumerate(sorted({k for kinds, _, _ in texts for k in kinds}))}
        row = np.repeat(np.arange(len(texts)), [len(kinds) for kinds, _, _ in texts])
        at = np.array([number[k] for kinds, _, _ in texts for k in kinds])
        prior = np.array([PRIOR.get(k, 0.0) for k in number])
        w = _fit(prior, lambda x: np.bincount(row, x[at], len(y)), lambda g: np.bincount(at, g[row], len(number)), y, weight)
        offset = np.bincount(row, w[at], len(y))
        article, beside = _fit(np.array([PRIOR["article"], PRIOR["beside"]]), lambda x: offset + np.where(y == 1, x[0], x[1]), lambda g: np.array([(g * y).sum(), (g * (1 - y)).sum()]), y, weight)
        return cls({**out, **dict(zip(number, w.tolist())), "article": float(article), "beside": float(beside)})


def _fit(prior: np.ndarray, score, slope, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression drawn to a prior, by Adam's steps."""
    x, m, v = prior.copy(), np.zeros_like(prior), np.zeros_like(prior)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(score(x), -30, 30)))
        g = slope(weight * (p - y)) + DECAY * (x - prior)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return x


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the first run with the largest positive sum."""
    best, total, start, found = 0.0, 0.0, 0, (0, 0)
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, found = total, (start, i + 1)
    return found


def scores(tokens: list[tuple[str, str, frozenset[str], bool, int]], weights: Weights) -> list[float]:
    """What each token adds to a run."""
    out, marked = [], any(inside and n for _, _, _, inside, n in tokens)
    for tag, _, kinds, inside, n in tokens:
        if tag:
            out.append(INSIDE if inside else weights[f"<{tag.lstrip('/')}>"])
        elif n:
            x = weights.word(kinds, "article" if inside else "beside" if marked else "")
            out.append(x * n if x > 0 else INSIDE if inside else x)
        else:
            out.append(0.0)
    return out


def extract(page: str | None, weights: Weights) -> str:
    tokens = units(page)
    value = scores(tokens, weights)
    a, b = best_run(value)
    blocks, now = [], []
    for (tag, text, _, _, n), x in zip(tokens[a:b], value[a:b]):
        name = tag.lstrip("/")
        if not tag:
            if x > 0 or not n:
                now.append(html.unescape(text))
        elif name in _BLOCK:
            blocks.append("".join(now))
            now = []
        elif name == "br":
            now.append(" ")
    blocks.append("".join(now))
    return "\n".join(filter(None, (" ".join(x.split()) for x in blocks)))


def learn(pages: DataFrame, sample: int = SAMPLE) -> Weights:
    """Weights from pages(page_id, html) that mark an article."""
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    chosen = least_hashes(marked.select("page_id").where("page_id IS NOT NULL").distinct(), "page_id", sample)
    labelled = marked.join(F.broadcast(chosen), "page_id").select("html")  # `sample` ids at most

    def run(batches):
        total: dict[tuple[str, bool], int] = {}
        for batch in batches:
            for page in batch.column(0).to_pylist():
                for tag, _, kinds, inside, n in units(page):
                    if tag:
                        total[f"<{tag.lstrip('/')}>", inside] = total.get((f"<{tag.lstrip('/')}>", inside), 0) + 1
                    elif n:
                        key = " ".join(sorted(kinds)), inside and not kinds & {"marked", "hidden"}
                        total[key] = total.get(key, 0) + min(n, COUNTED)
        yield pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _ in total], pa.string()), "inside": pa.array([bool(i) for _, i in total], pa.bool_()), "n": pa.array(total.values(), pa.int64())})

    counts = labelled.mapInArrow(run, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()  # kinds of the sample
    tags: dict[str, list[int]] = {}
    for r in counts:
        if r["kind"][0] == "<":
            tags.setdefault(r["kind"][1:-1], [0, 0])[0 if r["inside"] else 1] += r["n"]
    texts = sorted((tuple(r["kind"].split()), bool(r["inside"]), float(r["n"])) for r in counts if r["kind"][0] != "<")
    return Weights.learn(texts, sorted((t, *n) for t, n in tags.items() if t not in ("article", "main")))


def main_text(pages: DataFrame, weights: Weights, html_column: str = "html") -> DataFrame:
    """pages with text and n_chars, the text's code points."""

    def make():
        own = Weights(weights)

        def f(batch):
            texts = [extract(p, own) for p in batch.column(html_column).to_pylist()]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return f

    return append(pages, html_column, [("text", T.StringType()), ("n_chars", T.LongType())], make)
