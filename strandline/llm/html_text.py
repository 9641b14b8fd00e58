"""The main text of web pages, from the standard library's parser events.

Events make lines: the text between the borders of block elements, with its tags and its linked
text. The text-to-tag ratio of the lines, smoothed by a Gaussian along the page, is high over
stretches of prose. The lines over a threshold form clusters, and where the clusters lie chooses
the content: the element that holds them, without such parts of it as have no dense line.

Names weigh in at two places only. Lines in elements whose tag, role or class says that they are
beside the content (menus, adverts, comments) have the ratio 0; and an element that the clusters
choose is widened to the article or main element around it.
"""

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm.bytetext import pieces

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li"
    " main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th"
    " thead title tr ul".split()
)
#: Parts that may have short lines only, as lists and tables of an article.
_LISTS = frozenset("dl menu ol table ul".split())
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CONTENT = frozenset(("article", "main"))
#: Elements that may be the content's, or a part of it; others are single pieces of text.
_CONTAINERS = frozenset(
    "article aside body center dd details dialog div fieldset footer form frameset header html li"
    " main menu nav ol search section table tbody td th tr ul".split()
)
#: Elements without text of the page.
_SILENT = frozenset(
    "audio button canvas datalist embed head iframe math noscript object script select style svg"
    " template textarea title video".split()
)
#: Elements beside the content; an article or main element that begins in one ends it.
_BESIDE = frozenset("aside dialog footer form header menu nav search".split())
_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search"
    " status toolbar".split()
)
#: Words of a class or id that name such elements.
_NAMES = frozenset(
    "ad ads adsense adsbygoogle advert adverts advertisement advertising banner breadcrumb"
    " breadcrumbs consent cookie cookies copyright footer gdpr header login masthead menu modal"
    " nav navbar navigation newsletter notice notification outbrain overlay pager pagination"
    " paywall popup promo promoted promotion recommended related share sharing sidebar signup skip"
    " social sponsor sponsored subscribe subscription taboola toolbar widget".split()
)
_COMMENTS = frozenset("comment comments disqus replies reply respond".split())
#: Elements that a start tag ends, up to a border.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
}
_PARTS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

_RADIUS = 2
_WEIGHTS = [math.exp(-(i * i) / 2) for i in range(-_RADIUS, _RADIUS + 1)]
_BRIDGE = 3


@dataclass
class _Line:
    text: str
    tags: int
    linked: int
    beside: bool
    box: int  # the container around it
    heading: bool
    ratio: float = field(default=0.0)


class _Lines(HTMLParser):
    """The lines of a page, in page order, and its containers, outer ones before inner ones."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.open: list[tuple[str, str]] = []  # element and kind, "" for an ordinary one
        self.kinds: Counter[str] = Counter()  # of the open elements, and how often each is open
        self.names: Counter[str] = Counter()
        self.besides: list[int] = []  # places of open elements beside the content
        self.boxes: list[tuple[str, int]] = [("", 0)]  # containers with the one around each
        self.inside = [0]  # the open ones
        self.homes = 0
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.heading = False

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            beside = bool(self.kinds["beside"] or self.kinds["comments"])
            beside = beside or bool(self.kinds["head"] and not (self.heading and self.homes))
            linked = min(self.linked, len(text))
            self.lines.append(
                _Line(text, self.tags, linked, beside, self.inside[-1], self.heading)
            )
        self.parts, self.tags, self.linked = [], 0, 0

    def _kind(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        if tag in _SILENT:
            return "silent"
        given = {name: value or "" for name, value in attrs}
        if "hidden" in given or _HIDDEN.search(given.get("style", "")):
            return "silent"
        if tag in ("html", "body", "main"):
            return ""
        words: set[str] = set()
        for name in ("class", "id"):
            if value := given.get(name):
                words.update(_PARTS.findall(_CAMEL.sub(" ", value).lower()))
        if words & _COMMENTS:
            return "comments"
        if tag == "article":
            return ""
        if tag == "header" or (words & _NAMES) == {"header"}:
            return "head"
        if tag in _BESIDE or words & _NAMES or given.get("role", "").lower() in _ROLES:
            return "beside"
        return ""

    def _push(self, tag: str, kind: str) -> None:
        if kind in ("beside", "head"):
            self.besides.append(len(self.open))
        if tag in _CONTAINERS:
            self.boxes.append((tag, self.inside[-1]))
            self.inside.append(len(self.boxes) - 1)
        self.open.append((tag, kind))
        self.kinds[kind] += 1
        self.names[tag] += 1
        self.homes += tag in _CONTENT

    def _pop(self, at: int) -> None:
        """End the element at this place and all inside it."""
        for tag, kind in reversed(self.open[at:]):
            self.kinds[kind] -= 1
            self.names[tag] -= 1
            self.homes -= tag in _CONTENT
            if tag in _CONTAINERS:
                self.inside.pop()
        while self.besides and self.besides[-1] >= at:
            self.besides.pop()
        del self.open[at:]

    def _end_implied(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            name, _ = self.open[at]
            if name == "p":
                self._pop(at)
                break
            if name in _BLOCKS:
                break
        if tag in _ENDS and any(self.names[name] for name in _ENDS[tag][0]):
            ended, borders = _ENDS[tag]
            for at in range(len(self.open) - 1, -1, -1):
                name, _ = self.open[at]
                if name in borders:
                    break
                if name in ended:
                    self._pop(at)
                    break

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in _BLOCKS:
            self._flush()
            self._end_implied(tag)
            self.tags += 1
            self.heading = tag in _HEADINGS
        if tag == "br":
            self.parts.append(" ")
        if tag in _VOID:
            return
        kind = self._kind(tag, attrs)
        if tag in _CONTENT and kind == "" and not self.kinds["comments"] and self.besides:
            self._pop(self.besides[0])  # it was never closed
        self._push(tag, kind)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do, the slash means nothing

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in _BLOCKS:
            self._flush()
            self.heading = False
        elif tag == "br":
            self.parts.append(" ")
        if not self.names[tag]:
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._pop(at)
                break
            if tag not in _BLOCKS and self.open[at][0] in _BLOCKS:
                break  # an inline element doesn't end blocks

    def handle_data(self, data: str) -> None:
        if self.kinds["silent"]:
            return
        self.parts.append(data)
        if self.names["a"]:
            self.linked += len(data)

    def finish(self) -> list[_Line]:
        self.close()
        self._flush()
        return self.lines


def _smoothed(ratios: list[float]) -> list[float]:
    out = []
    for at in range(len(ratios)):
        total = weights = 0.0
        for shift, weight in enumerate(_WEIGHTS, at - _RADIUS):
            if 0 <= shift < len(ratios):
                total += weight * ratios[shift]
                weights += weight
        out.append(total / weights)
    return out


def _bridged(dense: list[bool], free: list[bool]) -> list[bool]:
    """The clusters: dense lines, with the few others between two of them."""
    out = list(dense)
    at = [i for i, ok in enumerate(dense) if ok]
    for a, b in zip(at, at[1:]):
        if 1 < b - a <= _BRIDGE + 1:
            out[a + 1 : b] = free[a + 1 : b]
    return out


def _chosen(lines: list[_Line], boxes: list[tuple[str, int]]) -> list[bool]:
    """The lines of the content.

    A line is dense if its smoothed ratio reaches half the standard deviation of all lines', and
    its own ratio a quarter of the mean of such lines. The content is in the smallest container that has half the text
    of the clusters of dense lines, or in one around it as long as half of the lines that this
    adds are twice as dense as that, and in the article or main element around it. Of its parts, those
    without a line that is dense by itself go, and so do rows of links; all other lines stay.
    """
    for line in lines:
        line.ratio = 0.0 if line.beside else (len(line.text) - line.linked) / max(line.tags, 1)
    smooth = _smoothed([line.ratio for line in lines])
    mean = sum(smooth) / len(smooth)
    limit = math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth)) / 2
    above = [x for x, line in zip(smooth, lines) if x >= limit and not line.beside]
    level = sum(above) / max(1, len(above)) / 4
    free = [not line.beside for line in lines]
    plain = [2 * line.linked <= len(line.text) for line in lines]
    dense = [
        ok and own and x >= limit and line.ratio >= level
        for ok, own, x, line in zip(free, plain, smooth, lines)
    ]
    if not any(dense):
        best = max(range(len(lines)), key=lambda i: (free[i], smooth[i]))
        dense[best] = free[best]
    clusters = _bridged(dense, [ok and own for ok, own in zip(free, plain)])
    text, some, rich, poor = ([0] * len(boxes) for _ in range(4))
    for line, chosen, ok, is_dense in zip(lines, clusters, free, dense):
        text[line.box] += len(line.text) * chosen
        some[line.box] += is_dense
        rich[line.box] += is_dense and line.ratio >= 2 * level
        poor[line.box] += ok and not (is_dense and line.ratio >= 2 * level)
    for box in range(len(boxes) - 1, 0, -1):  # inner ones come last
        for sums in (text, some, rich, poor):
            sums[boxes[box][1]] += sums[box]
    region = max(box for box in range(len(boxes)) if 2 * text[box] >= text[0])
    while region and boxes[region][0] not in _CONTENT:
        around = boxes[region][1]
        if rich[around] - rich[region] < poor[around] - poor[region]:
            break
        region = around
    box = region
    while box and boxes[box][0] not in _CONTENT:
        box = boxes[box][1]
    region = box or region
    part = [0] * len(boxes)  # the region's child that a container is in, 0 outside of it
    for box in range(len(boxes)):
        if box == region:
            part[box] = -1
        elif box:
            around = part[boxes[box][1]]
            part[box] = box if around == -1 else around
    kept = [ok and part[line.box] != 0 for ok, line in zip(free, lines)]
    for i, line in enumerate(lines):
        own = part[line.box]
        if kept[i] and own > 0 and not some[own] and boxes[own][0] not in _LISTS:
            kept[i] = False
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(lines)]
        if not plain[i] and (own > 0 or any(not plain[j] for j in near)):
            kept[i] = False
    return kept


def main_text(html: str) -> str:
    """The content's lines, white space in each as one space, two line ends between them."""
    parser = _Lines()
    parser.feed(html.replace("<![", "<!"))  # marked sections are comments in HTML
    lines = parser.finish()
    if not lines:
        return ""
    return "\n\n".join(line.text for line, ok in zip(lines, _chosen(lines, parser.boxes)) if ok)


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html"):
        texts = [main_text(html or "") for html in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"),
                batch.column("url"),
                pa.array(texts, pa.string()),
                pa.array([len(text) for text in texts], pa.int64()),
            ],
            names=["page_id", "url", "text", "n_chars"],
        )


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (its code points) for each row of ``pages``.

    The text is the article of the whole ``html`` without menus, headers, footers, sidebars,
    notices, adverts, forms, scripts, styles, markup and reader comments; it is empty if there is
    none, and for null. Broken markup is read as far as the parser's events go: an element that
    isn't closed ends with the one around it, or where an article begins. A page is held whole in
    one task. Null ids and URLs are returned as they are, repeated rows are each read, and other
    columns are not.
    """
    rows = pages.select("page_id", "url", "html")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(
        _extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )
