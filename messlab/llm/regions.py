"""Operator 11, main text of web pages as the maximum-scoring run of words and tags.

A page is a sequence of words and tags.  A word scores up to +1, less the less
often labelled pages have words of its elements in their main text; below a
twentieth it is negative.  A tag scores minus the rarity of that tag inside main
text.  Elements that are never main text, by name or class (fixed values below), are
taken out of the sequence.  One linear scan finds the contiguous run of the highest sum (of equal
ones the first, and of those the shortest); its words with a positive score are the text.

*Labelled pages* are those that mark their main text themselves, by an
``article`` or ``main`` element.  A bounded sample of them, ``sample`` pages at
most, gives for each feature of an element (its name, its class and id words) how
many pages have it inside and how many outside.  Words outside count for the
outermost element that holds no main text, so list items of a menu do not speak against
lists.

Text is decoded after the tags are found.  White space is what Python's
``str.split`` takes for it, no-break spaces included.  Block elements and line
breaks separate words, inline elements do not.  Null and empty pages, and pages
without words outside such elements, give the empty text.  Unclosed tags, comments and scripts end with
the page.  Every row gives a row, repeated ones too; only the three named columns are read.  An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Labelled pages that the weights are learnt from, at most; pages a feature must be met on.
SAMPLE, LEAST_PAGES = 4096, 3
#: Share of pages with a feature inside main text below which its words count as negative.
BREAK_EVEN = 0.05
#: Pages inside that every feature is taken to have; cost of a tag of which nothing is known, and the least cost.
PRIOR, UNKNOWN, LEAST = 0.25, 0.2, 0.02

# Names of HTML, and words by which pages mark what is not their main text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCKS = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup
option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul""".split())
NEVER_ELEMENTS = frozenset("""head title script style noscript template iframe noembed noframes object svg canvas nav menu
aside footer header form fieldset button select option textarea input dialog search xmp audio video map""".split())
NEVER_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav
navbar navigation breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent notice popup modal
overlay newsletter subscribe signup login share sharing social related recommended comment comments disqus respond
pagination pager widget toolbar skip contentinfo complementary search""".split())
CONTAINERS = frozenset("div section span p ul ol li dl dd dt table tbody tr td th a".split())
ROOTS = frozenset("html body main article".split())
NEGATIONS = frozenset("has with no without is not".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)
|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)
 (?P<rest>(?:[^<>"']|"[^"<>]*+"|'[^'<>]*+'|"[^"]{0,4096}+"|'[^']{0,4096}+')*+)(?:>|\Z)
|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/<>]*+)(?P<rest2>[^<>]*+)(?:>|(?=<)|\Z)""", re.S | re.X)
MARKS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])|\Z", re.I) for name in RAW}


@dataclass
class Page:
    """Tokens (element, text, tag), tag '' for text; and per element its parent, name, features and whether it never counts."""

    tokens: list[tuple[int, str, str]] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    name: list[str] = field(default_factory=list)
    marks: list[list[str]] = field(default_factory=list)
    titled: list[bool] = field(default_factory=list)

    def features(self, e: int) -> list[str]:
        """What an element is known by; one that holds the title or the main element is not known by its classes."""
        name, marks = self.name[e], self.marks[e]
        if self.titled[e] or name in ROOTS and name != "article":
            return [name]
        return ([] if marks and name in CONTAINERS else [name]) + ["." + m for m in marks]

    def never(self) -> list[bool]:
        out: list[bool] = []
        for e, up in enumerate(self.parent):
            own = self.name[e] in NEVER_ELEMENTS or any(f[1:] in NEVER_WORDS for f in self.features(e) if f[0] == ".")
            out.append(own or up >= 0 and out[up])
        return out


def marks_of(rest: str) -> list[str]:
    """The words of an element's class, id and role, those of tokens like ``has-menu`` left out."""
    out = []
    for value in MARKS.findall(rest):
        for token in entities.unescape(value.strip("\"'")).lower().split():
            parts = re.findall("[a-z]+", token)
            if parts and parts[0] not in NEGATIONS:
                out += [p for p in dict.fromkeys(parts)]
    return list(dict.fromkeys(out))


def parse(source: str | None) -> Page:
    """The page's tokens in order and its elements; time grows with the length."""
    page, stack, open_, at, source = Page(), [], {}, 0, source or ""

    def text(start: int, stop: int) -> None:
        if start < stop:
            page.tokens.append((stack[-1] if stack else -1, entities.unescape(source[start:stop]), ""))

    while True:
        found = TAG.search(source, at)
        if not found:
            text(at, len(source))
            return page
        text(at, found.start())
        at = found.end()
        name = (found["name"] or found["name2"] or "").lower()
        if not name:
            continue
        if found["end"] or found["end2"]:
            page.tokens.append((stack[-1] if stack else -1, "", "/" + name))
            while open_.get(name, 0):
                closed = page.name[stack.pop()]
                open_[closed] -= 1
                if closed == name:
                    break
            continue
        up, e = stack[-1] if stack else -1, len(page.parent)
        page.parent.append(up)
        page.name.append(name)
        rest = found["rest"] if found["name"] else found["rest2"]
        page.marks.append(marks_of(rest) if "=" in rest else [])
        page.titled.append(False)
        if name in ("h1", "main"):
            while up >= 0 and not page.titled[up]:
                page.titled[up] = True
                up = page.parent[up]
        page.tokens.append((e, "", name))
        if name in RAW:
            at = RAW_END[name].search(source, at).start()
        elif name not in VOID:
            stack.append(e)
            open_[name] = open_.get(name, 0) + 1


# ----------------------------------------------------------------- weights

def observed(page: Page) -> tuple[dict[str, list[int]], dict[str, list[int]]] | None:
    """Of a labelled page: features and tags with (inside, outside), features as 0 or 1; None if it has no label."""
    never = page.never()
    main = next((e for e, name in enumerate(page.name) if name in ("article", "main") and not never[e]), None)
    if main is None:
        return None
    inside, holds, outermost = [], [False] * len(never), []
    up = main
    while up >= 0:
        holds[up], up = True, page.parent[up]
    for e, up in enumerate(page.parent):
        inside.append(e == main or up >= 0 and inside[up])
        outermost.append(-1 if holds[e] else e if up < 0 or holds[up] else outermost[up])
    features: dict[str, list[int]] = {}
    tags: dict[str, list[int]] = {}
    seen: set[int] = set()
    for e, text, tag in page.tokens:
        if tag:
            if e < 0 or not never[e]:  # else it is taken out anyway
                within = e >= 0 and inside[e] and tag.lstrip("/") not in ("article", "main")
                tags.setdefault(tag, [0, 0])[0 if within else 1] += 1
        elif e >= 0 and e not in seen and text.strip():
            seen.add(e)
            if not inside[e]:
                for f in page.features(outermost[e]) if outermost[e] >= 0 else []:
                    features.setdefault(f, [0, 0])[1] = 1
            elif not never[e]:
                while True:
                    for f in page.features(e):
                        features.setdefault(f, [0, 0])[0] = 1
                    if e == main:
                        break
                    e = page.parent[e]
    return features, tags


@dataclass
class Weights:
    """Scores of words by the features of their elements, and of tags; what is not listed has the prior's."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def element_scores(self, page: Page) -> list[float]:
        """Score of a word of each element; 0 for elements that are taken out."""
        out: list[float] = []
        for e, (up, never) in enumerate(zip(page.parent, page.never())):
            above = out[up] if up >= 0 else 1.0
            out.append(0.0 if never else min([above, *(self.words.get(f, 1.0) for f in page.features(e))]))
        return out


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (html): (kind, name, inside, outside) sums over the batch's labelled pages."""
    for batch in batches:
        sums: dict[tuple[str, str], list[int]] = {}
        for source in batch.column("html").to_pylist():
            found = observed(parse(source))
            for kind, own in zip(("word", "tag"), found or ()):
                for name, (a, b) in own.items():
                    total = sums.setdefault((kind, name), [0, 0])
                    total[0] += a
                    total[1] += b
        yield pa.RecordBatch.from_pydict({
            "kind": pa.array([k for k, _ in sums], pa.string()), "name": pa.array([n for _, n in sums], pa.string()),
            "inside": pa.array([a for a, _ in sums.values()], pa.int64()),
            "outside": pa.array([b for _, b in sums.values()], pa.int64())})


def learn(pages: DataFrame, id: str = "page_id", html: str = "html", sample: int = SAMPLE) -> Weights:
    """Weights from about ``sample`` of the pages that mark their main text, chosen by a hash of id and page.

    What comes to the driver is bounded by the sample: features met on
    ``LEAST_PAGES`` of its pages or more.
    """
    marked = pages.select(F.col(id).alias("id"), F.col(html).alias("html")).where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    share = min(1.0, sample / max(1, marked.count()))
    chosen = marked.where(F.pmod(F.xxhash64(F.lit(41), "id", F.length("html")), F.lit(1 << 30)) < int(share * (1 << 30)))
    sums = chosen.select("html").mapInArrow(count_features, "kind string, name string, inside long, outside long")
    rows = sums.groupBy("kind", "name").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).where(
        F.col("inside") + F.col("outside") >= LEAST_PAGES).collect()
    out = Weights()
    for r in rows:
        share = (r.inside + PRIOR) / (r.inside + r.outside + PRIOR)
        if r.kind == "word":
            out.words[r["name"]] = max(-1.0, 1 - math.log(share) / math.log(BREAK_EVEN))
        else:
            out.tags[r["name"]] = -max(LEAST, -math.log(share))
    return out


# -------------------------------------------------------------- extraction

def best_run(scores: list[float]) -> tuple[int, int]:
    """(start, stop) of the contiguous run of the greatest sum above 0; (0, 0) if there is none."""
    best, run, begin, span = 0.0, 0.0, 0, (0, 0)
    for k, score in enumerate(scores):
        if run <= 0.0:
            run, begin = 0.0, k
        run += score
        if run > best:
            best, span = run, (begin, k + 1)
    return span


def main_text(source: str | None, weights: Weights) -> str:
    """The main text of one page."""
    page = parse(source)
    own = weights.element_scores(page)
    scores = [(0.0 if e >= 0 and own[e] == 0.0 else weights.tags.get(tag, -UNKNOWN)) if tag else
              (own[e] if e >= 0 else 1.0) * len(text.split()) for e, text, tag in page.tokens]
    start, stop = best_run(scores)
    parts = [(" " if tag.lstrip("/") in BLOCKS else "") if tag else text if e < 0 or own[e] > 0 else ""
             for e, text, tag in page.tokens[start:stop]]
    return " ".join("".join(parts).split())


def extractor(weights: Weights):
    """A column function: html to its main text."""
    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            yield pd.Series([main_text(s, weights) for s in sources], dtype=object)
    return extract.asNondeterministic()


def main_texts(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", sample: int = SAMPLE) -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    extract = extractor(learn(pages, id, html, sample))
    return pages.select(F.col(id).alias(id), F.col(url).alias(url), extract(F.col(html)).alias("text")).withColumn(
        "n_chars", F.length("text").cast("long"))
