"""Main text of web pages.

The standard library's streaming parser turns a page into blocks (the lines of the method)
with their text, tags, links and containers.  The text-to-tag ratio of each block is
smoothed by a Gaussian and cut by a threshold; the clusters above it decide which container
is the article, and which of its parts stay: a part (div or section) of several blocks that
lies mostly below the threshold goes, as do elements that are never article text (menus,
forms and the like) and those whose names say so plainly.  A name that only holds such a word
("post-header-story") halves the ratio of its blocks and leaves the decision to the clusters.
Other blocks of the container are kept, however short.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skiff.llm.sample import with_scores
from skiff.session import ship_package

SIGMA, RADIUS = 1.0, 3
#: Blocks whose smoothed ratio is at least this share of the mean ratio are content.
THRESHOLD = 0.5
#: A part of the article is judged by its clusters from so many blocks on.
PART_BLOCKS = 3
PARTS = frozenset("div section".split())
#: Weight of the ratio of a block in an element whose name holds a mark among other words.
WEAK = 0.5
#: Share of the content's characters that the chosen container holds at least.
HOLDS = 0.8

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br img picture map".split()
)
NEVER = frozenset(
    "head nav footer aside form script style noscript template button select option textarea input iframe object embed "
    "svg canvas audio video menu dialog map title".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open paragraph (and one another, where they repeat).
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table select".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id names that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar footer header masthead banner cookie cookies consent gdpr notice notices notification popup modal overlay "
    "newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments "
    "disqus reply replies respond widget toolbar login "
    "anzeige werbung kommentar kommentare publicite commentaire commentaires publicidad comentario comentarios".split()
)
#: Words that leave the meaning of a mark beside them as it is.
NEUTRAL = frozenset(
    "site page main top bottom left right box block wrap wrapper container area list section item items bar inner outer content "
    "link links post posts article articles stories news entry text body title icon icons button buttons btn global primary "
    "secondary mobile desktop fixed sticky user by form module panel group row col column reader readers thread".split()
)
#: Words before a mark that take its meaning away ("with-sidebar").
UNMARKS = frozenset("with has no without".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    text: str
    tags: int
    link_chars: int
    containers: tuple[int, ...]
    banned: bool
    weak: tuple[int, ...] = ()

    @property
    def ratio(self) -> float:
        return (len(self.text) - self.link_chars) / max(1, self.tags) * (WEAK if self.weak else 1.0)


@dataclass
class _Open:
    tag: str
    key: int
    banned: bool
    header: bool = False
    heading: bool = False
    weak: tuple[int, ...] = ()


def _marked(tag: str, attrs: dict) -> int:
    """0: no mark; 1: a name holds a mark among words of its own; 2: a plain mark."""
    if tag in ("html", "body", "main", "article"):
        names = attrs.get("class") or ""
        return 2 * (tag == "article" and bool({"comment", "reply", "ad", "advert", "sponsored", "promo", "related"} & {w.lower() for w in _NAME.findall(names)}))
    if (attrs.get("role") or "").strip().lower() in ROLES:
        return 2
    strength = 0
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        words = [w.lower() for w in _NAME.findall(name)]
        if any(w in MARKS and (k == 0 or words[k - 1] not in UNMARKS) for k, w in enumerate(words)):
            strength = max(strength, 2 if all(w in MARKS or w in NEUTRAL or w in UNMARKS for w in words) else 1)
    return strength


@dataclass
class _Page(HTMLParser):
    blocks: list[Block] = field(default_factory=list)
    semantic: dict[int, str] = field(default_factory=dict)
    parts_open: set[int] = field(default_factory=set)

    def __post_init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = [_Open("", 0, False)]
        self.keys = 0
        self.parts: list[str] = []
        self.tags = 0
        self.links = 0
        self.link_chars = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.open[-1]
            banned = top.banned or (top.header and not top.heading)
            self.blocks.append(Block(text, self.tags + 1, min(self.link_chars, len(text)), tuple(o.key for o in self.open), banned, top.weak))
        self.parts.clear()
        self.tags = self.link_chars = 0

    def _close(self, index: int) -> None:
        self._flush()
        del self.open[index:]

    def _close_open(self, names, stop) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in names:
                self._close(k)
                return
            if self.open[k].tag in stop:
                return

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "a":
            self.links += 1
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(attrs.get("style") or ""))
        if tag in INLINE and tag not in NEVER and not hidden and not _marked(tag, attrs):
            self.tags += 1
            if tag == "br":
                self.parts.append(" ")
            return
        if tag in VOID:
            self._flush()
            return
        if tag in CLOSES_P:
            self._close_open(("p",), CLOSES_P - {"p"})
        if tag in SAME:
            self._close_open(SAME[tag], SCOPE)
        self._flush()
        up = self.open[-1]
        self.keys += 1
        strength = _marked(tag, attrs)
        mark = strength == 2
        header = tag == "header" or (mark and bool({"header"} & {w.lower() for w in _NAME.findall(f"{attrs.get('class') or ''} {attrs.get('id') or ''}")}))
        in_article = any(o.tag in ("article", "main") for o in self.open)
        if header and in_article:  # of a header inside the article, its headings stay
            banned = up.banned or hidden
        else:
            banned, header = up.banned or hidden or tag in NEVER or tag == "header" or mark, False
        node = _Open(tag, self.keys, banned, up.header or header, up.heading or tag in HEADINGS)
        node.weak = (*up.weak, node.key) if strength == 1 else up.weak
        self.open.append(node)
        if tag in PARTS:
            self.parts_open.add(node.key)
        if tag in ("article", "main") and not banned:
            self.semantic[node.key] = tag

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag in INLINE:
            self.handle_starttag(tag, attrs)
            self.links -= tag == "a"

    def handle_endtag(self, tag):
        if tag == "a":
            self.links = max(0, self.links - 1)
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self._close(k)
                return
            if tag in INLINE or (tag == "p" and self.open[k].tag in SCOPE):
                break
        if tag == "br":
            self.parts.append(" ")
        elif tag not in INLINE:
            self._flush()

    def handle_data(self, data):
        self.parts.append(data)
        if self.links:
            self.link_chars += len(data.strip())


def smooth(values: list[float]) -> list[float]:
    """Gaussian smoothing; at the ends the kernel is cut and scaled."""
    kernel = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(values)):
        num = den = 0.0
        for k, w in zip(range(i - RADIUS, i + RADIUS + 1), kernel):
            if 0 <= k < len(values):
                num += w * values[k]
                den += w
        out.append(num / den)
    return out


def _low_parts(found: list[Block], high: set[int], parts: set[int], region: set[int]) -> set[int]:
    """Keys of the parts inside the region whose blocks lie mostly below the threshold, and
    of weakly marked elements of any size that do.  ``high``: ids of the blocks above it."""
    inside: dict[int, list[int]] = {}
    for b in found:
        deep = max(b.containers.index(k) for k in region if k in b.containers)
        for key in b.containers[deep + 1 :]:
            if key in parts or key in b.weak:
                count = inside.setdefault(key, [0, 0, 0])
                count[0] += 1
                count[1] += id(b) in high
                count[2] += key in b.weak
    return {k for k, (n, above, weak) in inside.items() if 2 * above < n and n < len(found) and (n >= PART_BLOCKS or weak)}


def _article(blocks: list[Block], semantic: dict[int, str], parts: set[int]) -> list[Block]:
    allowed = [b for b in blocks if not b.banned]
    if not allowed:
        return []
    chars = sum(len(b.text) for b in allowed)
    held: dict[int, int] = {}
    for b in allowed:
        for key in b.weak:
            held[key] = held.get(key, 0) + len(b.text)
    # an element around most of the text is no menu, whatever its name
    for b in allowed:
        b.weak = tuple(k for k in b.weak if held[k] < HOLDS * chars)
    level = smooth([0.0 if b.banned else b.ratio for b in blocks])
    mean = sum(b.ratio for b in allowed) / len(allowed)
    content = [b for b, x in zip(blocks, level) if not b.banned and x >= THRESHOLD * mean and 2 * b.link_chars <= len(b.text)] or allowed
    total = sum(len(b.text) for b in content)
    inside: dict[int, int] = {}
    for b in content:
        for key in b.containers:
            inside[key] = inside.get(key, 0) + len(b.text)
    articles = [k for k, tag in semantic.items() if tag == "article" and inside.get(k, 0) > 0]
    if articles and sum(len(b.text) for b in content if set(articles) & set(b.containers)) >= 0.5 * total:
        best = max(inside[k] for k in articles)
        chosen = {k for k in articles if inside[k] >= 0.2 * best}
    else:
        mains = [k for k, tag in semantic.items() if tag == "main" and inside.get(k, 0) >= 0.5 * total]
        # containers open later have larger keys: the last that holds enough is the innermost
        chosen = {max(mains or [k for k, n in inside.items() if n >= HOLDS * total])}
    found = [b for b in allowed if chosen & set(b.containers)]
    # the threshold inside the region is that of its own mean
    cut = THRESHOLD * sum(b.ratio for b in found) / max(1, len(found))
    high = {id(b) for b, x in zip(blocks, level) if x >= cut and 2 * b.link_chars <= len(b.text)}
    low = _low_parts(found, high, parts, chosen)
    found = [b for b in found if not low.intersection(b.containers)]
    if chosen & set(semantic):
        return found
    # no article element: link lists beside the text are menus, and what lies before the
    # first or after the last content block is not part of the region
    marked = [k for k, b in enumerate(found) if any(b is c for c in content)]
    return [b for b in found[marked[0] : marked[-1] + 1] if 2 * b.link_chars <= len(b.text)] if marked else []


def main_text(html: str | None) -> str:
    """The article's blocks joined by line ends; empty for a null, empty or textless page."""
    if not html:
        return ""
    page = _Page()
    page.feed(html)
    page.close()
    page._flush()
    return "\n".join(b.text for b in _article(page.blocks, page.semantic, page.parts_open))


def extract_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` plus the main text (never null).  Repeated rows and extra columns pass through."""
    ship_package(pages.sparkSession)

    def make(html: pa.Array) -> list[pa.Array]:
        return [pa.array([main_text(h) for h in html.to_pylist()], pa.string())]

    return with_scores(pages, html_col, make, [T.StructField(text_col, T.StringType())])


def op1_html_extraction(spark, sf_dir):
    """Contract query: main text of every page."""
    from skiff.llm.common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = extract_main_text(pages)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
