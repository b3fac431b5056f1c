"""HTML extraction as a maximum-scoring subsequence.

A page becomes a row of tokens: words, which score positive, and tags, which score negative. A word's
score depends on the block that it stands in. Weights are log odds of standing inside the main region,
learned from pages whose authors mark that region; a linear scan finds the contiguous tokens with the best
sum. Blocks that are no article text (by their tag, or by the weights of their class, id and role names) count
nothing in the scan and are left out of its text, so that a long aside or form doesn't cut an article in two.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import extended

#: Labelled pages that weights are learned from: the bound of what reaches the driver.
SAMPLE_PAGES = 400
#: Longer pages don't go into the sample (they are extracted from like any other).
SAMPLE_CHARS = 200_000
#: Weight of a name that stands for something else than article text, before anything is learned; a block goes below this sum.
PRIOR, DROP_BELOW = -3.0, -1.0

# Tags by what they do to the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg".split())
DROPPED = frozenset("nav header footer aside form script style noscript template textarea title iframe object svg button select option head dialog menu".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES_SELF = frozenset("li dt dd tr td th option".split())
BARRIERS = frozenset("article main section div ul ol table body".split())
CONTAINERS = frozenset("div section ul ol dl table figure details aside span".split())
# Parts of names of blocks that hold no article text, and parts that say nothing by themselves.
BOILERPLATE = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription "
    "sidebar menu menubar nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments disqus discussion replies share sharing social related recommended login signup signin search complementary contentinfo alert".split()
)
NEUTRAL = frozenset("left right top bottom inner outer site page box bar block wrapper wrap container widget item items list area panel section group row col primary secondary global thread posts links icons button buttons form field label text content".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|=)*+)(?:>|\Z)|([^<]+|<)", re.S
)  # a quote opens a value only right after =
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_MARKED = re.compile(r"<(article|main)\b", re.I)


class Token(NamedTuple):
    """kind: word:<block>, open or close; off: inside a block that its tag drops; named: the innermost block with bad names, or -1."""

    kind: str
    text: str
    off: bool
    named: int
    marked: bool
    names: tuple[str, ...] = ()


def names_of(attributes: str) -> tuple[str, ...]:
    """The class, id and role names of a tag, in lower case."""
    return tuple(w for found in _ATTRIBUTE.findall(attributes) for x in found if x for w in x.lower().split()) if attributes else ()


def prior(name: str) -> float:
    """What a name counts by itself: all of its parts are known, and one of them as boilerplate."""
    parts = [x for x in re.split(r"[-_\d]+", name) if x]
    return PRIOR if any(x in BOILERPLATE for x in parts) and all(x in BOILERPLATE or x in NEUTRAL for x in parts) else 0.0


def tokens(page: str, weights: dict[str, float]) -> tuple[list[Token], list[bool]]:
    """The tokens of a page, and for each block with bad names whether it is dropped.

    Elements that a page leaves open end with what holds them, comments and scripts with the page. A block
    with bad names stays if it holds most of the page's text together with a heading of the first order, a
    marked region or three paragraphs: then it is the page's frame. Time is linear in the page's length.
    """
    out: list[Token] = []
    stack: list[tuple[str, bool, int]] = []  # tag, dropped by its tag, the named block it opens or -1
    where: dict[str, list[int]] = defaultdict(list)  # places of open tags on the stack
    blocks, barriers, named = [], [], []  # places of open blocks and barriers; open named blocks
    parent, chars, signs = [], [], []  # of each named block
    dropped = marked = total = 0

    def leave(to: int) -> None:
        nonlocal dropped, marked
        while len(stack) > to:
            tag, off, own = stack.pop()
            where[tag].pop()
            dropped -= off
            marked -= tag in ("article", "main")
            if tag not in INLINE:
                blocks.pop()
            if tag in BARRIERS:
                barriers.pop()
            if own >= 0:
                named.pop()

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        cdata, closing, name, attributes, text = m.groups()
        inner = named[-1] if named else -1
        if text is not None or cdata is not None:
            text = cdata if text is None else text
            if not dropped:
                n = len(text) - text.count(" ")
                total += n
                if inner >= 0:
                    chars[inner] += n
            block = stack[blocks[-1]][0] if blocks else ""
            out.append(Token(f"word:{block}{'/a' if where['a'] else ''}", text, dropped > 0, inner, marked > 0))
            continue
        if name is None:
            continue
        tag = name.lower()
        if closing:
            out.append(Token("close", tag, dropped > 0, inner, marked > 0))
            if where[tag]:
                leave(where[tag][-1])
            continue
        if tag in CLOSES_P or tag in CLOSES_SELF:
            places = where["p" if tag in CLOSES_P else tag]
            if places and (places[-1] > (barriers[-1] if barriers else -1) or tag in CLOSES_P and blocks[-1] == places[-1]):
                leave(places[-1])
                inner = named[-1] if named else -1
        names = names_of(attributes) if tag in CONTAINERS else ()
        off, own = tag in DROPPED, -1
        if names and not off and sum(weights.get(f"name:{x}", 0.0) + prior(x) for x in set(names)) <= DROP_BELOW:
            own = len(parent)
            parent.append(inner)
            chars.append(0)
            signs.append(0)
        if inner >= 0 and tag in ("h1", "article", "main", "p"):
            signs[inner] += 1 if tag == "p" else 3
        out.append(Token("open", tag, dropped > 0 or off, own if own >= 0 else inner, marked > 0, names))
        if tag in VOID or attributes.endswith("/") and tag not in RAW:
            continue
        place = len(stack)
        stack.append((tag, off, own))
        where[tag].append(place)
        dropped += off
        marked += tag in ("article", "main")
        if tag not in INLINE:
            blocks.append(place)
        if tag in BARRIERS:
            barriers.append(place)
        if own >= 0:
            named.append(own)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = stop.start() if stop else end
    for i in range(len(parent) - 1, -1, -1):  # a block opens after what holds it
        if parent[i] >= 0:
            chars[parent[i]] += chars[i]
            signs[parent[i]] += signs[i]
    gone = [2 * n <= total or s < 3 for n, s in zip(chars, signs, strict=True)]
    for i, p in enumerate(parent):
        gone[i] = gone[i] or p >= 0 and gone[p]
    return out, gone


def learn(pages: list[str]) -> dict[str, float]:
    """Log odds inside marked regions against outside: of words by block, of tags (held below zero), and of names by block.

    Blocks of a marked region that go by their tag or by the names known beforehand are not inside it.
    """
    inside, outside = Counter(), Counter()
    for page in pages:
        if not _MARKED.search(page):
            continue
        row, gone = tokens(page, {})
        for kind, text, off, named, marked, names in row:
            off = off or named >= 0 and gone[named]
            for x in names:
                (inside if marked and not off else outside)[f"name:{x}"] += 1
            if off:
                continue
            key, n = (kind, len(text.split())) if kind.startswith("word:") else (f"{kind}:{text}", 1)
            (inside if marked else outside)[key] += n
    out = {}
    for key in inside.keys() | outside.keys():
        odds = math.log((inside[key] + 1) / (outside[key] + 1))
        if key.startswith("name:"):
            out[key] = max(-3.0, min(3.0, odds)) if inside[key] else 0.0  # what is never inside may be the frame of a region
        else:
            out[key] = max(-6.0, min(6.0, odds)) if key.startswith("word:") else max(-1.5, min(-0.05, odds / 4))
    return out


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of a page: blocks in page order, joined by an empty line; empty if nothing scores."""
    if not page:
        return ""
    row, gone = tokens(page, weights)
    best = total = 0.0
    begin, region = 0, (0, 0)
    for i, (kind, text, off, named, _, _) in enumerate(row):
        if off or named >= 0 and gone[named]:
            continue
        if kind.startswith("word:"):
            total += weights.get(kind, 0.25 if kind.endswith("/a") else 1.0) * len(text.split())
        else:
            total += weights.get(f"{kind}:{text}", -0.5)
        if total <= 0:
            total, begin = 0.0, i + 1
        elif total > best:
            best, region = total, (begin, i + 1)
    blocks: list[list[str]] = [[]]
    for kind, text, off, named, _, _ in row[slice(*region)]:
        if kind.startswith("word:"):
            if not off and (named < 0 or not gone[named]):
                blocks[-1].append(html.unescape(text))
        elif text == "br":
            blocks[-1].append(" ")
        elif text not in INLINE:
            blocks.append([])
    done = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(b for b in done if b)


def train(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from at most ``sample`` pages that mark their main region, chosen by a hash of the page."""
    marked = pages.select(F.col(html_col).alias("page"), F.xxhash64(html_col).alias("h")).filter(F.col("page").rlike(r"(?i)<(article|main)\b") & (F.length("page") <= SAMPLE_CHARS))
    # Only hashes are ranked; then the pages of the chosen ones are fetched, copies of a page once.
    chosen = [r["h"] for r in marked.select("h").distinct().orderBy("h").limit(sample).collect()]
    rows = marked.filter(F.col("h").isin(chosen)).groupBy("h").agg(F.min("page").alias("page")).collect() if chosen else []
    return learn(sorted(r["page"] for r in rows))


def extract_text(pages: DataFrame, weights: dict[str, float], html_col: str = "html") -> DataFrame:
    """Every row of ``pages`` with text and n_chars (code points).

    Null html counts as empty and gives an empty text, as does a page without any region that scores.
    Markup may be broken anywhere; pages of any length and depth of nesting take time in proportion to their
    length. Repeated rows give repeated results, an empty table none. Other columns pass through; columns
    named text or n_chars are replaced.
    """
    pages = pages.drop("text", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                texts = [extract(x.as_py(), weights) for x in batch.column(html_col)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names, "text", "n_chars"])

    return pages.mapInArrow(run, extended(pages.schema, "text string, n_chars bigint"))
