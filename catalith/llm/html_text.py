"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events into lines: a block-level tag ends one. A line's ratio is its
visible characters over its tags; where it stands weighs: double inside an article or main element, nothing inside boilerplate.
Ratios are smoothed along the page by a Gaussian kernel, so that a short paragraph between long ones counts with them, and the
lines are split into two clusters by a threshold that is moved to the middle of the clusters' means until it stands.

The upper cluster is the content, with what belongs to it: an article or main element of which it has SHARE of the characters is taken whole, and
each of several such elements; elsewhere, what stands between two of its lines in one container, headings right before its lines, and
short paragraphs right after them in their container.

Menus, footers, sidebars, dialogs and reader comments are never content. Forms, page headers and what a class, id or role calls an advert, notice
or the like are not either, unless the ratios speak against the name: an element with most of the upper cluster's characters is content if it
has an article or main element in it, or if the page has none outside of such elements. Headings in the header of an article or main element
are its own. Scripts, styles and markup comments are no text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right as bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import slices

# fixed values: elements of the HTML standard, by role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select option datalist".split())
BOILERPLATE = frozenset("nav footer aside menu dialog button".split())
DOUBTFUL = frozenset("form header fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body div section article main blockquote center td th table ul ol dl form fieldset details figure".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption optgroup option".split()
)
REGION = frozenset(["article", "main"])
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Words of a class or id that mark boilerplate.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar side "
    "aside widget footer header masthead cookie cookies consent gdpr notice notification alert popup modal overlay comment comments disqus reply replies respond "
    "share sharing social related recommended newsletter subscribe subscription signup login form search pagination pager skip toolbar".split()
)
#: Those that name reader comments, which no ratio tells from content.
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
#: Words that make a class or id the name of a layout rather than of its part.
LAYOUT = frozenset("with without no has layout wrapper container".split())
#: A start tag that ends an open paragraph, and what an open element of these ends.
CLOSES_P = BLOCK - frozenset("body html dd dt li td th tr tbody thead tfoot caption optgroup option summary legend figcaption".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Width of the Gaussian kernel in lines.
SIGMA = 1.0
#: How many times the lower cluster's mean the upper one's must be; nearer means are one cluster.
APART = 4.0
#: Weight of a line inside an article or main element, and the share of such an element's characters from which it is taken whole.
INSIDE, SHARE = 2.0, 0.3

_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")


def marks_boilerplate(name: str) -> frozenset[str]:
    """The words by which a class or id names boilerplate: its first or last one, unless it names a layout."""
    words = _WORD.findall(name)
    return WORDS.intersection((words[0], words[-1])) if words and LAYOUT.isdisjoint(words) else frozenset()


@dataclass(frozen=True)
class Line:
    """region: the outermost open article or main, 0 for none; doubt: the outermost element that may be boilerplate, 0 for none; container: what it stands in."""

    text: str
    tags: int
    region: int
    doubt: int
    container: int
    heading: bool


@dataclass
class Open:
    tag: str
    hidden: bool
    boilerplate: bool
    doubt: int
    region: int
    container: int


class Lines(HTMLParser):
    """Collects the lines of a page that aren't in boilerplate."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[Open] = []
        self.counts: Counter[str] = Counter()
        self.parts: list[str] = []
        self.tags = self.hidden = self.boilerplate = self.region = self.doubt = self.container = self.number = 0
        #: Doubtful elements that are or have an article or main element.
        self.holding: set[int] = set()
        #: The last header that began inside an article or main element.
        self.titling = -1

    def end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            heading = any(self.counts[h] for h in HEADINGS)
            doubt = 0 if heading and self.doubt == self.titling else self.doubt
            self.lines.append(Line(text, self.tags, self.region, doubt, self.container, heading))
        self.parts, self.tags = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P:
            self.close_open({"p"}, {"table", "td", "th", "div", "article", "section", "li", "button"})
        if tag == "body":
            self.close_open({"head"}, set())
        if tag in ("article", "main", "footer"):
            self.close_open({"nav"}, set())
        if tag in SIBLINGS:
            self.close_open(*SIBLINGS[tag])
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        values = {k: (v or "").lower() for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden", "style")}
        named = frozenset().union(*map(marks_boilerplate, f"{values.get('class', '')} {values.get('id', '')}".split())) if tag not in ("html", "body", "main") else frozenset()
        hidden = tag in HIDDEN or "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "")
        boilerplate = tag in BOILERPLATE or bool(named & COMMENTS)
        doubtful = tag in DOUBTFUL or bool(named) or values.get("role") in ROLES
        self.number += 1
        doubt = self.number if doubtful and not self.doubt else 0
        self.doubt = self.doubt or doubt
        if doubt and self.region and tag == "header" and not named:
            self.titling = doubt
        region = self.number if tag in REGION and not self.region and not self.boilerplate and not boilerplate else 0
        self.region = self.region or region
        if region and self.doubt:
            self.holding.add(self.doubt)
        self.open.append(Open(tag, hidden, boilerplate, doubt, region, self.container))
        if tag in CONTAINERS:
            self.container = self.number
        self.counts[tag] += 1
        self.hidden += hidden
        self.boilerplate += boilerplate

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in HIDDEN:
            self.handle_endtag(tag)

    def close_open(self, names: set[str], within: set[str]) -> None:
        """Ends the innermost open element of these names, if none of `within` is open inside it."""
        if not any(self.counts[n] for n in names):
            return
        for element in reversed(self.open):
            if element.tag in names:
                self.handle_endtag(element.tag)
                return
            if element.tag in within:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.end_line()
        if not self.counts[tag]:
            return
        while self.open:
            element = self.open.pop()
            if element.region or element.doubt or element.tag in HEADINGS or element.tag in CONTAINERS:
                self.end_line()
            self.counts[element.tag] -= 1
            self.hidden -= element.hidden
            self.boilerplate -= element.boilerplate
            self.container = element.container
            if element.region:
                self.region = 0
            if element.doubt:
                self.doubt = 0
            if element.tag == tag:
                break

    def handle_data(self, data: str) -> None:
        if not self.hidden and not self.boilerplate:
            self.parts.append(data)
        elif not self.hidden and self.parts == [] and data.strip():
            self.tags += 1  # boilerplate between two lines parts them


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing over three standard deviations to each side, normalised at the ends."""
    reach = math.ceil(3 * sigma)
    weight = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    out = []
    for i in range(len(values)):
        near = range(max(0, i - reach), min(len(values), i + reach + 1))
        out.append(sum(values[j] * weight[abs(i - j)] for j in near) / sum(weight[abs(i - j)] for j in near))
    return out


def threshold(values: list[float]) -> float:
    """Between two clusters: the middle of their means, from the mean of all until it stands; the least value if there is one cluster."""
    cut = sum(values) / len(values)
    for _ in range(100):
        low, high = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not low or not high:
            break
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    low, high = [v for v in values if v < cut], [v for v in values if v >= cut]
    return cut if low and high and sum(high) / len(high) >= APART * sum(low) / len(low) else min(values)


def upper_cluster(lines: list[Line], weights: list[float]) -> set[int]:
    """The lines whose smoothed weighted ratio is in the upper cluster; those without weight never are.

    One that only its neighbours lift counts if a line of its container is in the cluster by itself.
    """
    own = [len(x.text) / max(1, x.tags) * w for x, w in zip(lines, weights, strict=True)]
    ratios = smoothed(own)
    cut = threshold(ratios)
    high = {i for i, (r, w) in enumerate(zip(ratios, weights, strict=True)) if w and r >= cut}
    sure = {lines[i].container for i in high if own[i] >= cut}
    return {i for i in high if lines[i].container in sure}


def main_text(html: str | None) -> str:
    """The content lines of a page, one \\n between two; empty if there is none."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = parser.lines
    if not lines:
        return ""
    inside = [INSIDE if x.region else 1.0 for x in lines]
    # doubtful elements that the ratios speak for
    size: Counter[int] = Counter()
    for i in upper_cluster(lines, inside):
        size[lines[i].doubt] += len(lines[i].text)
    plain_region = any(x.region and not x.doubt for x in lines)
    cleared = {d for d, n in size.items() if 2 * n > size.total() and (d in parser.holding or not plain_region)} | {0}
    high = upper_cluster(lines, [w if x.doubt in cleared else 0.0 for x, w in zip(lines, inside, strict=True)])

    whole, upper = Counter(), Counter()
    for i, x in enumerate(lines):
        if x.region and x.doubt in cleared:
            whole[x.region] += len(x.text)
            upper[x.region] += len(x.text) if i in high else 0
    taken = {r for r in whole if upper[r] >= SHARE * whole[r]}
    chosen = {i for i, x in enumerate(lines) if x.doubt in cleared and (x.region in taken if x.region else i in high)}
    outside = [i for i, x in enumerate(lines) if not x.region and x.doubt in cleared]
    held = [i for i in outside if i in high]
    last: dict[int, int] = {}
    for i in outside:
        c = lines[i].container
        if i in high:
            chosen.update(k for k in outside[bisect(outside, last.get(c, i)) : bisect(outside, i)] if lines[k].container == c)
            last[c] = i
        elif not lines[i].heading and i - 1 in chosen and lines[i - 1].container == c and last.get(c) is not None:
            chosen.add(i)
    for i in reversed(outside):
        if lines[i].heading and i + 1 in chosen and held:
            chosen.add(i)
    return "\n".join(lines[i].text for i in sorted(chosen))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    A null or empty page has an empty text, as has one without content. Repeated rows give repeated results; nothing is
    cut, however long a page is; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
