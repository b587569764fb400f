"""Main text of web pages: text-to-tag ratios of lines, smoothed and clustered.

One pass of the standard library's parser cuts a page into lines at block-level tags. A line's ratio
is its length over the number of tags it has. The ratios are smoothed with a Gaussian, and those
above a threshold set by their spread are content. The content decides the region: of all elements (but paragraphs, items
and the like) the one whose text agrees best with the content lines, by the F measure of their lengths, is the
core, and the outermost element around it that agrees nearly as well is the region. Where no element agrees by half, the content lines alone are the text.

Names only refine that. Navigation, footers and controls are left out by their tags. A header, form, advert, comment list and the like, told by tag, class, id or role, is
left out too, unless it holds most of the page's content lines (nearly all of them, for reader comments), or all content lies in such elements: then names are not believed.
Elements that are mostly links are left out beside the core, not within it (the body as a whole being no core in this). Content lines that are neither are kept outside the region too.

Defined cases: a null or empty page has an empty text, and so has one without any text. Unclosed
tags are closed by their parents, text after a cut-off is kept as far as it goes, character
references are decoded. Nothing is cut at any length. Columns carried along may have any name; the text comes last.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspan.llm.common import fresh, slices, texts

#: Elements that begin and end lines.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without text of the page, elements that never hold an article, and elements that are furniture unless they wrap it.
SILENT = frozenset("applet audio canvas embed head iframe math noscript object script style svg template title video".split())
NEVER = frozenset("button footer input label menu nav select textarea".split())
FURNITURE = frozenset("aside dialog fieldset form header".split())
#: Elements without an end tag.
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class, id or role that mark furniture.
MARKS = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|gdpr|header|login|masthead|menu|modal|"
    r"nav|navbar|navigation|newsletter|notices?|popup|promo|promotion|recommended|related|replies|respond|search|share|sharing|sidebar|signup|social|sponsored?|subscribe|toolbar|widget)(?:$|[\s_-])"
)
#: Names that only tell what an element has or lacks beside it.
ASIDE = re.compile(r"(?i)\b(?:no|has|with|without)[-_][\w-]+")
BODIES = frozenset(("article", "main", "body", "html"))
COMMENTS = re.compile(r"(?i)(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|respond)(?:$|[\s_-])")
#: Elements that are parts of a text or of a list, never the whole of it.
PARTS = frozenset("address blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 hgroup li option p pre summary tbody td tfoot th thead tr".split())
LINKS = 3  # links in an element that is mostly links, at least
MOST, NEARLY_ALL, ALWAYS = 0.5, 0.9, 2.0  # shares of the content above which names of furniture, and of comments, are not believed
AGREES, WIDER = 0.5, 0.95  # F measure of a core, at least; share of the core's that a wider region needs


class Lines(HTMLParser):
    """Lines of a page: number of tags, and atoms (element, text, code points in links, links), an atom being a run of text in one element.

    Blocks, and inline elements that look like furniture, are numbered as they open, so a parent's number is below its children's; 0 is the page.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []  # tag, number of the numbered element it is or is in
        self.opened: Counter = Counter()
        self.parent, self.name, self.doubt = [0], ["html"], [0.0]  # doubt: share of content above which a furniture name is not believed, 0 for others
        self.lines: list[tuple[int, list]] = []
        self.atoms: list[list] = []
        self.tags = self.silent = 0
        self.link = False

    def inner(self) -> int:
        return self.open[-1][1] if self.open else 0

    def end_line(self) -> None:
        if any(not t.isspace() for _, parts, _, _ in self.atoms for t in parts):
            self.lines.append((max(1, self.tags), [(e, "".join(parts), n, k) for e, parts, n, k in self.atoms]))
        self.atoms, self.tags, self.link = [], 0, False

    def add(self, data: str) -> None:
        at = self.inner()
        if not self.atoms or self.atoms[-1][0] != at:
            self.atoms.append([at, [], 0, 0])
        self.atoms[-1][1].append(data)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        block = tag in BLOCKS
        if block:
            self.end_line()
            if tag in ("p", "li"):
                self.close_like(tag)
        self.tags += 1
        if tag == "a":
            self.link = any(k == "href" for k, _ in attrs)
        if tag == "br" and not self.silent:
            self.add("\n")
        if tag in EMPTY:
            return
        named = [v for k, v in attrs if k in ("class", "id", "role") and v and MARKS.search(v) and MARKS.search(ASIDE.sub(" ", v))] if tag not in BODIES else []
        doubt = ALWAYS if tag in NEVER else (NEARLY_ALL if any(COMMENTS.search(ASIDE.sub(" ", v)) for v in named) else MOST) if named or tag in FURNITURE else 0.0
        number = self.inner()
        if block or doubt:
            self.parent.append(number)
            self.name.append(tag)
            self.doubt.append(doubt)
            number = len(self.parent) - 1
        self.open.append((tag, number))
        self.opened[tag] += 1
        self.silent += tag in SILENT

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if tag == "br" and not self.silent:
            self.add("\n")

    def close_like(self, tag: str) -> None:
        """A paragraph or item ends where the next one begins in the same parent."""
        if self.opened[tag]:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    return self.pop_to(k)
                if self.open[k][0] in BLOCKS:
                    return None

    def pop_to(self, k: int) -> None:
        for tag, _ in self.open[k:]:
            self.silent -= tag in SILENT
            self.opened[tag] -= 1
        del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if tag == "a":
            self.link = False
        if self.opened[tag]:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    return self.pop_to(k)
                if tag not in BLOCKS and self.open[k][0] in BLOCKS:
                    return None  # a stray inline end tag doesn't close blocks

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.add(data)
            if self.link and (n := len(" ".join(data.split()))):
                self.atoms[-1][2] += n
                self.atoms[-1][3] += 1


def smooth(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing, with the kernel's weights renormalised at the ends."""
    radius = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    total = np.convolve(values, kernel)[radius : radius + len(values)]
    return total / np.convolve(np.ones(len(values)), kernel)[radius : radius + len(values)]


def content_lines(sizes: list[int], tags: list[int]) -> list[bool]:
    """Which lines are content: their smoothed ratio isn't far below the mean, by the ratios' spread and by half."""
    ratio = smooth(np.array(sizes, float) / np.array(tags, float))
    return (ratio >= min(ratio.mean() - 0.5 * ratio.std(), ratio.mean() / 2)).tolist()


def summed(parent: list[int], atoms: list[tuple[int, int]]) -> list[int]:
    """For each element the sum over (element, value) of itself and all within it."""
    out = [0] * len(parent)
    for e, value in atoms:
        out[e] += value
    for e in range(len(out) - 1, 0, -1):
        out[parent[e]] += out[e]
    return out


def inherited(parent: list[int], own: list[bool]) -> list[bool]:
    """Whether each element, or one around it, has the property."""
    out = own[:1]
    for e in range(1, len(own)):
        out.append(own[e] or out[parent[e]])
    return out


def main_text(html: str) -> str:
    """The blocks of the page's main text, in page order, one to a line."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    if not parser.lines:
        return ""
    parent, name = parser.parent, parser.name
    atoms = [(k, e, t, len(" ".join(t.split())), n, m) for k, (_, parts) in enumerate(parser.lines) for e, t, n, m in parts]
    sizes = [0] * len(parser.lines)
    for k, _, _, n, _, _ in atoms:
        sizes[k] += n
    content = content_lines(sizes, [n for n, _ in parser.lines])
    weight = summed(parent, [(e, n) for k, e, _, n, _, _ in atoms if content[k]])
    furniture = inherited(parent, [0 < d and weight[e] <= d * weight[0] for e, d in enumerate(parser.doubt)])
    if all(furniture[e] for k, e, *_ in atoms if content[k]):
        furniture = inherited(parent, [d == ALWAYS for d in parser.doubt])
    atoms = [x for x in atoms if not furniture[x[1]]]

    every = summed(parent, [(e, n) for _, e, _, n, _, _ in atoms])
    linked, links = summed(parent, [(e, n) for _, e, _, _, n, _ in atoms]), summed(parent, [(e, n) for _, e, _, _, _, n in atoms])
    whole = [t not in PARTS and t not in BODIES for t in name]
    lists = inherited(parent, [whole[e] and links[e] >= LINKS and 2 * linked[e] > every[e] for e in range(len(parent))])
    if all(lists[e] for k, e, *_ in atoms if content[k]):
        lists = [False] * len(parent)
    plain = [x for x in atoms if not lists[x[1]]]

    every, weight = summed(parent, [(e, n) for _, e, _, n, _, _ in plain]), summed(parent, [(e, n) for k, e, _, n, _, _ in plain if content[k]])
    agrees = [-1.0 if t in PARTS else 2 * w / max(1, n + weight[0]) for t, w, n in zip(name, weight, every, strict=True)]
    best = max(agrees)
    core = max(e for e, f in enumerate(agrees) if f == best)  # numbers grow inwards
    if not weight[0]:
        return ""
    if best < AGREES:
        return joined(len(sizes), [x for x in plain if content[x[0]]])
    wide = core
    for e in ancestors(parent, core):
        wide = e if agrees[e] >= WIDER * best else wide
    in_core = inherited(parent, [e == core and name[e] not in ("body", "html") for e in range(len(parent))])
    in_wide = inherited(parent, [e == wide for e in range(len(parent))])
    return joined(len(sizes), [x for x in atoms if in_core[x[1]] or not lists[x[1]] and (in_wide[x[1]] or content[x[0]])])


def joined(lines: int, atoms: list[tuple]) -> str:
    """The atoms' texts, one line each, white space as single blanks."""
    out: list[list[str]] = [[] for _ in range(lines)]
    for k, _, t, *_ in atoms:
        out[k].append(t)
    return "\n".join([t for parts in out if parts and (t := " ".join("".join(parts).split()))])


def ancestors(parent: list[int], element: int) -> Iterator[int]:
    while element:
        element = parent[element]
        yield element


def extract(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (by default the id; one called text is left out), and ``text``, of every page. One pass, no shuffle."""
    carry = [c for c in carry or [id_column] if c.lower() != "text"]
    frame = pages.select(*carry, F.col(html_column).alias(fresh(carry, "markup")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = texts(batch.column(batch.num_columns - 1))
            for lo, hi in slices(batch, [len(t) for t in html], 1 << 23):
                found = [main_text(t) for t in html[lo:hi]]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-1], pa.array(found, pa.string())], names=[*carry, "text"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1]]
    return frame.mapInArrow(run, ", ".join([*fields, "text string"]))
