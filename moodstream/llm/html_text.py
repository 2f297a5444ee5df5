"""Main text of web pages by composite text density.

A page becomes a small tree.  Every node's density is its characters per tag, lowered where many
of the characters stand in links; a node's density sum adds up its children's densities.  The
subtree with the largest sum holds the article; along the path from there up to the body the
smallest density is the threshold that other subtrees must reach to count as well.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Element names of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe noembed noframes xmp svg".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: Never part of an article, by element, role, or a whole name in class or id.
OUTSIDE = set(
    "head nav header footer aside form menu dialog button select option datalist label fieldset object audio video "
    "canvas annotation annotation-xml".split()
)
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar "
    "sidenav rail aside widget widgets cookie cookies consent gdpr notice notices notification alert popup modal "
    "overlay subscribe subscription newsletter signup login comment comments disqus respond replies share sharing "
    "social related recommended recommendations pagination pager toolbar skip discussion discussions".split()
)
#: What may stand beside such a name without changing what it names ("sidebar-left", "main-nav").
BESIDE = set(
    "left right top bottom main site page global primary secondary sub box area bar block container wrapper wrap inner "
    "outer list item items links link section form button buttons icons text message panel unit slot zone".split()
)
#: Classes and ids don't drop what is a piece of text by its element.
TEXT = set("html body main article h1 h2 h3 h4 h5 h6 p pre blockquote table".split())
#: A start tag on the left ends an open element on the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
          "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
LISTS = {"ul", "ol", "dl", "table", "select", "body", "article", "section", "div", "td", "th"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"<]*+"|'[^'<]*+')*+)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.DOTALL,
)
#: One attribute: its whole name, and its value if it has one.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s"'>/=]*+)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s"'>][^\s>]*+)))?|"[^"]*+"?|'[^']*+'?""")
_UNSEEN = re.compile(r"(?:^|;)\s*+(?:display\s*+:\s*+none|visibility\s*+:\s*+hidden)")
_PARTS = re.compile(r"[a-z0-9]+")


class Page:
    """The elements of a page in page order; each has its parent's number and its text pieces."""

    def __init__(self, html: str):
        self.tags, self.parents, self.dead = ["html"], [-1], [False]
        self.named = [False]  # by class or id
        self.pieces: list[tuple[int, str]] = []  # (node, text), or (node, "") where a block begins or ends
        self._build(html)
        self._drop_named()

    def _drop_named(self) -> None:
        """Drop what classes and ids name as outside, unless the page would have no other text."""
        named = list(self.named)
        for node in range(1, len(named)):
            named[node] = named[node] or named[self.parents[node]]
        texts = [node for node, text in self.pieces if not self.dead[node] and text and not text.isspace()]
        if any(not named[node] for node in texts):
            self.dead = [a or b for a, b in zip(self.dead, named)]

    def _build(self, html: str) -> None:
        stack, at = [0], 0
        while at < len(html):
            token = _TOKEN.search(html, at)
            text = html[at : token.start() if token else len(html)]
            if text and not self.dead[stack[-1]]:
                self.pieces.append((stack[-1], entities.unescape(text) if "&" in text else text))
            if not token:
                break
            at = token.end()
            name = token[2] or token[5]
            if not name:
                continue
            name = name.lower()
            if token[1] or token[4]:
                self._end(stack, name)
                continue
            attributes = token[3] or token[6] or ""
            if name in RAW:
                if not attributes.endswith("/") or name in ("script", "style", "title", "textarea"):
                    close = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
                    at = close.end() if close else len(html)
                continue
            self._start(stack, name, attributes)

    def _start(self, stack: list[int], name: str, attributes: str) -> None:
        if name in ("html", "body") and name in (self.tags[n] for n in stack):
            return
        if name in BLOCKS:
            self._close(stack, {"p"}, {"table", "td", "th", "button", "body"})
        if name in CLOSES:
            self._close(stack, CLOSES[name], LISTS - CLOSES[name])
        node = len(self.tags)
        self.tags.append(name)
        self.parents.append(stack[-1])
        dead, named = _outside(name, attributes)
        self.dead.append(self.dead[stack[-1]] or dead)
        self.named.append(named)
        if name == "br":
            self.pieces.append((stack[-1], " "))
        elif name in BLOCKS:
            self.pieces.append((stack[-1], ""))
        if name not in VOID:
            stack.append(node)

    def _close(self, stack: list[int], names: set[str], stop: set[str]) -> None:
        """Close up to the outermost open element of ``names`` that no element of ``stop`` shields."""
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[depth]]
            if tag in names:
                del stack[depth:]
                self.pieces.append((stack[-1], ""))
            elif tag in stop:
                return

    def _end(self, stack: list[int], name: str) -> None:
        if name in BLOCKS:
            self.pieces.append((stack[-1], ""))
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[depth]]
            if tag == name:
                del stack[depth:]
                return
            if name not in BLOCKS and tag in BLOCKS:
                return  # the end of an inline element does not end a block

    def densities(self) -> tuple[list[float], list[float]]:
        """Density and density sum of every node; what lies outside articles weighs nothing."""
        n = len(self.tags)
        chars, tags, linked, links = [0] * n, [0] * n, [0] * n, [0] * n
        for node, text in self.pieces:
            if not self.dead[node]:
                chars[node] += len(text) - text.count(" ") - text.count("\n")
        for node in range(n - 1, 0, -1):
            if self.dead[node]:
                continue
            parent = self.parents[node]
            if self.tags[node] == "a":
                linked[node], links[node] = chars[node], links[node] + 1
            for sums in (chars, linked, links):
                sums[parent] += sums[node]
            tags[parent] += tags[node] + 1
        share = linked[0] / max(chars[0], 1)
        density = [0.0] * n
        for node in range(n):
            c = chars[node]
            if c:
                plain = max(c - linked[node], 1)
                base = log(c / plain * linked[node] + share * c + e)
                ratio = c / max(linked[node], 1) * max(tags[node], 1) / max(links[node], 1)
                density[node] = c / max(tags[node], 1) * max(log(max(ratio, 1.0)) / base, 0.0)
        # inline elements are part of their block; a block without blocks inside has its own density
        total = [0.0] * n
        for node in range(1, n):
            if self.tags[node] in BLOCKS:
                up = self.parents[node]
                while up and self.tags[up] not in BLOCKS:
                    up = self.parents[up]
                total[up] += density[node]
        return density, [t or d * (tag in BLOCKS) for t, d, tag in zip(total, density, self.tags)]

    def article(self) -> set[int]:
        """The nodes whose texts are the article's: from the best subtree, and all of the article or
        main element around it if the page names one; else what reaches the threshold beside it and
        holds a paragraph or the like.
        """
        density, total = self.densities()
        best = max(range(len(total)), key=total.__getitem__)
        if total[best] <= 0:  # no elements, or all characters in links
            return {k for k in range(len(self.tags)) if not self.dead[k]}
        path = [best]
        while path[-1] > 0:
            path.append(self.parents[path[-1]])
        threshold = min(density[node] for node in path)
        named = [node for node in path if self.tags[node] in ("article", "main")]
        written = [tag in TEXT for tag in self.tags]  # loose text beside the best subtree is none of it
        for node in range(len(self.tags) - 1, 0, -1):
            if not self.dead[node]:
                written[self.parents[node]] |= written[node]
        whole = {named[-1] if named else best}
        chosen = set() if named else set(path)
        for node in range(len(self.tags)):
            parent = self.parents[node]
            if self.dead[node]:
                continue
            if node in whole or parent in whole:
                whole.add(node)
            elif not named and parent in chosen and density[node] >= threshold and written[node] and node not in path:
                whole.add(node)  # beside the path, and as dense
        return chosen | whole

    def blocks(self) -> list[str]:
        chosen, out, run = self.article(), [], []
        for node, text in [*self.pieces, (0, "")]:
            if text == "":
                block = " ".join("".join(run).split())
                run = []
                if block:
                    out.append(block)
            elif node in chosen:
                run.append(text)
            else:
                run.append(" ")
        return out


def _outside(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether the element is outside any article by itself, and whether its class or id says so."""
    if name in OUTSIDE:
        return True, False
    if not attributes or name in ("html", "body", "main", "article"):
        return False, False
    seen, named = set(), False
    for match in _ATTRIBUTE.finditer(attributes):
        kind, value = (match[1] or "").lower(), (match[2] or match[3] or match[4] or "").lower()
        if kind in seen:  # of a repeated attribute the first counts
            continue
        seen.add(kind)
        if kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "style" and _UNSEEN.search(value):
            return True, False
        if kind == "role" and value.strip() in ROLES:
            return True, False
        if kind in ("class", "id") and name not in TEXT:
            named = named or any(_names_outside(word) for word in value.split())
    return False, named


def _names_outside(word: str) -> bool:
    """A class or id that names a part of the page around the article, as a whole."""
    parts = _PARTS.findall(word)
    return not NAMES.isdisjoint(parts) and all(part in NAMES or part in BESIDE for part in parts)


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in page order, joined by a space; empty if there is none."""
    return " ".join(Page(html).blocks()) if html else ""


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` (the article) and ``n_chars`` (its code points) in place of ``html``.

    Whole pages are read.  A page that is null, empty or has no article gives an empty text.
    Columns of these names are replaced.
    """
    pages = pages.drop("text", "n_chars")
    at = pages.columns.index(html)
    fields = [f for f in pages.schema.fields if f.name != html]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(at)]
            rest = [c for k, c in enumerate(batch.columns) if k != at]
            columns = [*rest, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return pages.mapInArrow(run, schema)
