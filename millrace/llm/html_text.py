"""HTML extraction by minimum-cut labelling.

A page is cut into blocks of text. A logistic classifier gives each block the log odds of being content; they are the
capacity to one of the two terminals. Blocks that follow one another are tied by smoothness edges, weaker by the square of
the containers that open and close between them, and so are blocks of one container that others part. A maximum flow
separates the blocks at least cost; those on the source's side are the text. So a block that by itself says little goes with
its surroundings.

The classifier is fitted for each table: its rows are blocks of a bounded sample of pages whose own mark-up says what they
are (an article, a menu, ...). Each counts twice, once without the mark-up, so that words, links and punctuation learn to
stand alone. Fixed weights are the prior mean; the sample counts as at most SAMPLE_WEIGHT rows beside it.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import ROWS_AT_ONCE, pick, read, text_map

#: Pages of the sample (those of the least hashes of id and url), and blocks taken from each at most.
SAMPLE_PAGES, SAMPLE_BLOCKS = 500, 60
#: What the sample counts for against the prior, whose weights have this deviation.
SAMPLE_WEIGHT, DEVIATION = 200.0, 1.0
#: Smoothness of blocks in a row without a container between them, and of blocks of one container with others between them.
FOLLOWS, SIBLINGS = 1.25, 0.6

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]+)(?:\s*=\s*)?")
BARE = re.compile(r"[^\s>]*")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Tags by what they do to the text.
RAW = frozenset("script style iframe textarea noscript title".split())
SKIPPED = frozenset("template svg select object canvas math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("nav header footer aside form button menu dialog head option fieldset".split())
CONTENT_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_TAGS = HEADINGS | frozenset("p li tr td th dt dd pre blockquote".split())
_ENDS_P = frozenset("p div ul ol li table tr td th h1 h2 h3 h4 h5 h6 section article aside nav header footer form blockquote pre dl dt dd hr main figure".split())
CLOSED_BY = {
    "p": _ENDS_P, "li": frozenset(["li"]), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")),
    "tr": frozenset(["tr"]), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(["option"]),
}
#: Words of class, id and role names that speak for or against content; a word ending in * stands for all that begin so.
BOILER_NAMES = frozenset(
    "ad ads advert* alert banner breadcrumb* comment comments cookie* consent discussion disqus footer header login masthead menu modal nav* newsletter notice notices popup promo* recommend* related replies reply responses "
    "search share sharing sidebar signup skip social sponsor* subscribe tag tags toolbar widget contentinfo complementary".split()
)
CONTENT_NAMES = frozenset("article content entry main post story text body".split())
_BOILER_STARTS = tuple(w[:-1] for w in BOILER_NAMES if w.endswith("*"))
#: Features and the prior's mean weights.
PRIOR = {
    "one": -2.0, "words": 0.9, "linked": -5.0, "sentence": 0.8, "copyright": -3.0, "p": 0.8, "heading": 1.2, "item": -0.3,
    "boiler_tag": -9.0, "boiler_name": -9.0, "content_tag": 3.0, "content_name": 1.5,
}
FEATURES = tuple(PRIOR)
#: The features that come from mark-up around the block, not from the block.
MARKUP = tuple(FEATURES.index(f) for f in ("boiler_tag", "boiler_name", "content_tag", "content_name"))


class Block:
    __slots__ = ("parts", "linked", "flags", "tag", "where", "apart", "text")

    def __init__(self, flags: tuple[int, int, int, int], tag: str, where: int) -> None:
        self.parts: list[str] = []
        self.linked, self.flags, self.tag, self.where = 0, flags, tag, where
        self.apart = 0  # containers that open or close between the block before and this one


def says(names: str) -> tuple[bool, bool]:
    """Whether class, id and role names speak against and for content."""
    words = re.split(r"[\s_-]+", names.lower())
    return any(w in BOILER_NAMES or w.startswith(_BOILER_STARTS) for w in words), any(w in CONTENT_NAMES for w in words)


class Scanner:
    """Goes through a page once. Whatever is missing or broken, each character is looked at a bounded number of times."""

    def __init__(self, html: str) -> None:
        self.html, self.low = html, html.translate(_LOWER)
        self.unclosed: set[str] = set()  # closing marks that do not come any more

    def seek(self, mark: str, at: int) -> int:
        if mark in self.unclosed:
            return -1
        found = self.low.find(mark, at)
        if found < 0:
            self.unclosed.add(mark)
        return found

    def attributes(self, at: int) -> tuple[str, bool, int]:
        """Class, id and role of the tag whose name ends at `at`; whether it closes itself; where it ends."""
        html, names = self.html, []
        while True:
            m = ATTRIBUTE.match(html, at)
            if not m:
                end = self.seek(">", at)
                if end < 0:
                    return " ".join(names), False, len(html)
                return " ".join(names), html[end - 1] == "/", end + 1
            at = m.end()
            value = ""
            if "=" in m[0]:
                quote = html[at : at + 1]
                close = self.seek(quote, at + 1) if quote in ('"', "'") and quote else -1
                if close >= 0:
                    value, at = html[at + 1 : close], close + 1
                else:
                    bare = BARE.match(html, at)
                    value, at = bare[0], bare.end()
            if m[1].lower() in ("class", "id", "role"):
                names.append(value)

    def parts(self) -> Iterator[tuple[str, str, str]]:
        """("text", text, ""), ("open", tag, names) and ("close", tag, "") in page order; without comments and what is never text."""
        html, at, text = self.html, 0, 0
        while (start := html.find("<", at)) >= 0:
            kind = html[start + 1 : start + 2]
            if kind == "!" or kind == "?":
                if html.startswith("<!--", start):
                    if html.startswith(">", start + 4) or html.startswith("->", start + 4):
                        end = html.index(">", start) + 1
                    else:
                        end = self.seek("-->", start + 4)
                        end = len(html) if end < 0 else end + 3
                else:
                    end = self.seek(">", start)
                    end = len(html) if end < 0 else end + 1
                event = None
            elif kind == "/" and (m := NAME.match(html, start + 2)):
                end = self.seek(">", m.end())
                end = len(html) if end < 0 else end + 1
                event = ("close", m[0].lower(), "")
            elif m := NAME.match(html, start + 1):
                tag = m[0].lower()
                names, itself, end = self.attributes(m.end())
                event = ("open", tag, names)
                if tag in RAW or tag in SKIPPED and not itself:
                    close = self.seek(f"</{tag}", end)
                    if close < 0 and tag in ("script", "style"):
                        close = len(html)
                    if close >= 0:
                        stop = self.seek(">", close)
                        end = len(html) if stop < 0 else stop + 1
                        event = ("open", "hr", "") if tag not in INLINE else None
                if itself and event and event[1] in SKIPPED:
                    event = None
            else:
                at = start + 1
                continue
            if start > text:
                yield "text", html[text:start], ""
            if event:
                yield event
            at = text = end
        if text < len(html):
            yield "text", html[text:], ""


def blocks_of(html: str) -> list[Block]:
    """Blocks with text, in page order, each with what its ancestors say."""
    stack: list[tuple[str, tuple[int, int, int, int], int]] = [("", (0, 0, 0, 0), 0)]  # tag, flags, container
    opened: Counter[str] = Counter()
    found: list[Block] = []
    now = Block((0, 0, 0, 0), "", 0)
    containers = apart = 0

    def cut() -> None:
        nonlocal now, apart
        if now.parts:
            now.apart = apart
            raw = "".join(now.parts)
            now.text = " ".join((unescape(raw) if "&" in raw else raw).split())
            now.linked = min(1.0, now.linked / max(1, len(raw)))
            if now.text:
                found.append(now)
                apart = 0
        now = Block(stack[-1][1], stack[-1][0] if stack[-1][0] != "a" or len(stack) < 2 else stack[-2][0], stack[-1][2])

    def pop_to(i: int) -> None:
        nonlocal apart
        for tag, *_ in stack[i:]:
            opened[tag] -= 1
            apart += tag not in INLINE and tag not in TEXT_TAGS
        del stack[i:]

    for kind, value, names in Scanner(html).parts():
        if kind == "text":
            now.parts.append(value)
            now.linked += len(value) * (opened["a"] > 0)
            continue
        tag = value
        if tag == "br" or tag == "wbr":
            if tag == "br":
                now.parts.append(" ")
            continue
        if kind == "close":
            before = apart
            if opened[tag] > 0:
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                changed, apart = apart, 0
                if tag not in INLINE:
                    apart = before
                    cut()
                    pop_to(i)
                    cut()
                    continue
                pop_to(i)
                apart += changed
            elif tag not in INLINE:
                cut()
            continue
        if tag in INLINE:
            if tag == "a":
                opened["a"] += 1
                stack.append(("a", stack[-1][1], stack[-1][2]))
            continue
        cut()
        while len(stack) > 1 and (stack[-1][0] == "a" and len(stack) > 2 and tag in CLOSED_BY.get(stack[-2][0], ()) or tag in CLOSED_BY.get(stack[-1][0], ())):
            pop_to(len(stack) - 1)
        if tag not in VOID:
            boiler_tag, boiler_name, content_tag, content_name = stack[-1][1]
            against, speaks_for = says(names) if names else (False, False)
            if tag in CONTENT_TAGS:
                content_tag = 1
            elif tag not in ("html", "body"):
                boiler_name |= against
                content_name |= speaks_for and not against
            # An article's own header has its headline, which stays.
            if tag in BOILER_TAGS:
                boiler_tag = 2 if tag == "header" and content_tag and not boiler_tag else 1
            if tag in HEADINGS and boiler_tag == 2:
                boiler_tag = 0
            if tag not in TEXT_TAGS:
                containers += 1
                apart += 1
            opened[tag] += 1
            stack.append((tag, (boiler_tag, int(boiler_name), content_tag, int(content_name)), stack[-1][2] if tag in TEXT_TAGS else containers))
        now = Block(stack[-1][1], stack[-1][0], stack[-1][2])
    cut()
    return found


def features(b: Block) -> tuple[float, ...]:
    """Values of FEATURES."""
    words = b.text.count(" ") + 1
    boiler_tag, boiler_name, content_tag, content_name = b.flags
    return (
        1.0, math.log1p(min(words, 100)), b.linked, float(b.text[-1] in ".!?…:;\"”»"), float("©" in b.text or "All rights" in b.text),
        float(b.tag == "p"), float(b.tag in HEADINGS), float(b.tag in ("li", "td", "th", "dt", "dd")),
        float(boiler_tag > 0), float(boiler_name), float(content_tag), float(content_name),
    )


def mark_up_says(x: tuple[float, ...]) -> int | None:
    """The label of a block whose mark-up is clear: 1 content, 0 boilerplate; else None."""
    boiler_tag, boiler_name, content_tag, content_name = (x[i] for i in MARKUP)
    if boiler_tag or boiler_name:
        return None if content_name and not (content_tag or boiler_tag) else 0
    return 1 if content_tag or content_name else None


def fit(rows: np.ndarray, labels: np.ndarray, weight: float = SAMPLE_WEIGHT) -> np.ndarray:
    """Weights of greatest posterior by Newton steps; the prior's where there are no rows."""
    prior = np.array(list(PRIOR.values()))
    w = prior.copy()
    if not len(rows):
        return w
    each = min(1.0, weight / len(rows))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        gradient = each * rows.T @ (p - labels) + (w - prior) / DEVIATION**2
        curve = each * (rows * (p * (1 - p))[:, None]).T @ rows + np.eye(len(w)) / DEVIATION**2
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut; edges hold both ways. Of cuts of equal cost, the one with fewest nodes there."""
    n = len(source)
    # What a node can send straight on to the sink is sent first; then it has capacity left on one terminal only.
    left = [s - t for s, t in zip(source, sink)]
    capacity: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        capacity[a][b] = capacity[a].get(b, 0.0) + c
        capacity[b][a] = capacity[b].get(a, 0.0) + c
    inside = [False] * n
    tiny = 1e-9
    for s in range(n):
        while left[s] > tiny and not inside[s]:
            via, queue, end = {s: -1}, deque([s]), -1
            while queue and end < 0:
                a = queue.popleft()
                for b, c in capacity[a].items():
                    if c > tiny and b not in via and not inside[b]:
                        via[b] = a
                        if left[b] < -tiny:
                            end = b
                            break
                        queue.append(b)
            if end < 0:
                for a in via:  # nothing of this set reaches the sink any more
                    inside[a] = True
                break
            flow, b = min(left[s], -left[end]), end
            while via[b] >= 0:
                flow, b = min(flow, capacity[via[b]][b]), via[b]
            left[s] -= flow
            left[end] += flow
            b = end
            while via[b] >= 0:
                a = via[b]
                capacity[a][b] -= flow
                capacity[b][a] += flow
                b = a
    return inside


def label(blocks: list[Block], weights: np.ndarray) -> tuple[list[bool], list[bool]]:
    """Of each block, whether it is content by the minimum cut, and whether it is by the classifier alone."""
    odds = (np.array([features(b) for b in blocks]) @ weights).tolist()
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, FOLLOWS / (1 + b.apart) ** 2))
        if last.get(b.where, i - 1) != i - 1:
            edges.append((last[b.where], i, SIBLINGS))
        last[b.where] = i
    return min_cut([max(z, 0.0) for z in odds], [max(-z, 0.0) for z in odds], edges), [z > 0 for z in odds]


def main_text(html: str | None, weights: np.ndarray | None = None) -> str:
    blocks = blocks_of(html) if html else []
    if not blocks:
        return ""
    keep, _ = label(blocks, np.array(list(PRIOR.values())) if weights is None else weights)
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def fitted(pages: DataFrame, html: str = "html", by: tuple[str, ...] = ("page_id", "url"), sample: int = SAMPLE_PAGES, each: int = SAMPLE_BLOCKS) -> np.ndarray:
    """The classifier's weights from a sample of at most `sample` pages and `each` blocks a page; only the blocks' features come to the driver."""
    df = pick(pages, **{f"_k{i}": k for i, k in enumerate(by)}, _html=html)
    df = df.select(F.xxhash64(*[f"_k{i}" for i in range(len(by))]).alias("h"), "_html").where("length(_html) > 0")
    least = [r["h"] for r in df.select("h").orderBy("h").limit(sample).collect()]
    if not least:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                rows = [[x for b in sampled(blocks_of(t), each) for x in features(b)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["h", "x"])

    got = df.where(F.col("h") <= least[-1]).limit(sample).mapInArrow(run, "h long, x array<double>").collect()
    rows = np.array([x for r in sorted(got) for x in r["x"]]).reshape(-1, len(FEATURES))
    labels = [mark_up_says(tuple(x)) for x in rows.tolist()]
    known = np.array([y is not None for y in labels], bool)
    rows, y = rows[known], np.array([y for y in labels if y is not None], float)
    bare = rows.copy()
    bare[:, MARKUP] = 0.0
    return fit(np.concatenate([rows, bare]), np.concatenate([y, y]))


def sampled(blocks: list[Block], n: int) -> list[Block]:
    """At most n blocks, evenly over the page."""
    step = max(1, -(-len(blocks) // n))
    return blocks[::step]


def extract_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), weights: np.ndarray | None = None) -> DataFrame:
    """The columns `keep`, then text and n_chars (code points) for every row; no shuffle.

    Without weights the classifier is fitted to these pages first. A null or empty page, or one with no content block, has
    empty text. Null ids and repeated rows give a row each; an empty table an empty one; other columns are not read. Pages are
    read whole; cuts of equal cost keep fewer blocks. An unclosed comment, script or style goes on to the page's end; any other
    unclosed element ends at once, and an unclosed quote is part of a bare value.
    """
    weights = fitted(pages, html, keep) if weights is None else weights

    def make() -> Callable[[list], list]:
        return lambda rows: [(t, len(t)) for t in (main_text(r, weights) for r in rows)]

    return text_map(pick(pages, **{k: k for k in keep}, **{html: html}), make, "text string, n_chars long", keep=keep, text=html)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))
