"""Main text of web pages by composite text density.

Every node of a page gets its number of characters C and tags T, and those within links (LC, LT). Its density is
C/T times the logarithm of (C/LC)(T/LT) to the base ln(C/(C-LC) LC + LCb/Cb C + e), where b is the body: links cost it. A node's sum is
that of its children's densities, and the block with the largest sum is the core of the article. What holds the whole
page counts only by children that can't be cores themselves. The threshold is the least
density on the path from the body (not counted, as it holds everything) to the core: going up that path, the blocks beside it that reach
the threshold and hold a `part` of the core's characters belong to the article too, with headings before the core; nothing else beside it does. An enclosing article
or main element is taken whole. What HTML itself marks as no part of an article (navigation, footers, forms, scripts, adverts, reader comments and so on)
takes no part in any count. Where a page marks nothing, density alone decides.

Free style: one pass over each page in Arrow batches, map-only. Its time is linear in the page, whatever tags are left open or nested.

Defined results: null or empty pages and pages without text give an empty text, repeated rows repeat, unclosed tags end where
their parents end, of blocks with the same sum the first is the core, a page of any length is read whole, further columns stay and one named like the new one is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""",
    re.S,
)
COMMENT = re.compile("<!--.*", re.S)
MARKED = re.compile(r"""\b(class|id|role|hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
#: Elements of HTML by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
LINES = BLOCK - {"td", "th"}
ENDS_P = BLOCK - frozenset("body html td th tr tbody thead tfoot option legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
#: Blocks that are parts of a text rather than its whole.
INNER = HEADINGS | frozenset("p li pre table tr td tbody ul ol dl".split())
#: Elements, roles and words in class or id that are no part of an article.
APART = frozenset("nav footer aside form script style noscript template head title button select textarea input menu dialog iframe svg canvas object audio video search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus respond cookie cookies consent gdpr notice banner popup modal newsletter subscribe share sharing social related recommended pagination pager toolbar masthead skip".split()
)
#: First words of names that say what is beside an element, and of those that are part of an article.
OTHERS, PARTS = frozenset("no with without has show hide".split()), frozenset("article post entry content story section".split())
#: An open element of the first kind ends where one of the second begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
#: Elements that an end tag from within doesn't reach across.
WALLS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "option": {"select"}, "p": {"td", "th", "table", "button", "object"}}


#: What a start tag closes, by group: the innermost open element of the first names that no wall hides.
GROUPS = [({"p"}, WALLS["p"]), *((CLOSES[k], WALLS[k]) for k in CLOSES)]
GROUP_OF = {k: n + 1 for n, k in enumerate(CLOSES)}
#: How an element changes what a later start tag reaches: the groups that it belongs to, and those that it hides.
REACHED = {name: [n for n, (names, _) in enumerate(GROUPS) if name in names] for names, _ in GROUPS for name in names}
HIDDEN = {name: [n for n, (_, walls) in enumerate(GROUPS) if name in walls] for _, walls in GROUPS for name in walls}


class Page:
    """A page's nodes in page order, as parallel lists; texts as (node, raw text)."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.apart, self.linked, self.inside = ["#"], [-1], [False], [False], [False]
        self.texts: list[tuple[int, str]] = []
        # the open elements, for each what each group of start tags would close, and where each name is open
        self.stack, self.reach, self.places = [0], [(0,) * len(GROUPS)], {}
        at, held, last = 0, 0, html.rfind(">")
        while True:
            # beyond the last > there is no tag, at most an open comment
            m = TOKEN.search(html, at) if at <= last else COMMENT.search(html, at)
            end = m.start() if m else len(html)
            if end > held and not self.apart[self.stack[-1]]:
                self.texts.append((self.stack[-1], html[held:end]))
            if not m:
                return
            at = held = m.end()
            name = (m[2] or m[5]) if m.re is TOKEN else None
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                if self.places.get(name):
                    self.close(self.places[name][-1])
                continue
            if name in ENDS_P and self.reach[-1][0]:
                self.close(self.reach[-1][0])
            if name in GROUP_OF and self.reach[-1][GROUP_OF[name]]:
                self.close(self.reach[-1][GROUP_OF[name]])
            node, above = len(self.tag), self.stack[-1]
            self.tag.append(name)
            self.parent.append(above)
            self.apart.append(self.apart[above] or self.is_apart(name, m[3] or m[6] or "", self.inside[above]))
            self.linked.append(self.linked[above] or name == "a")
            self.inside.append(self.inside[above] or name in ("article", "main"))
            if name in RAW:
                stop = re.compile(f"</{name}[^>]*>", re.I).search(html, at)
                if not self.apart[node]:
                    self.texts.append((node, html[at : stop.start() if stop else len(html)]))
                at = held = stop.end() if stop else len(html)
            elif name not in VOID and not (m[3] or "").endswith("/"):
                self.open(node, name)
            elif name in ("br", "hr", "wbr"):
                self.texts.append((node, " " if name == "br" else ""))

    def open(self, node: int, name: str) -> None:
        place = len(self.stack)
        reach = self.reach[-1]
        if name in REACHED or name in HIDDEN:
            own = list(reach)
            for n in HIDDEN.get(name, ()):
                own[n] = 0
            for n in REACHED.get(name, ()):
                own[n] = place
            reach = tuple(own)
        self.stack.append(node)
        self.reach.append(reach)
        self.places.setdefault(name, []).append(place)

    def close(self, place: int) -> None:
        """Ends the open element at this place, with all in it."""
        while len(self.stack) > place:
            self.places[self.tag[self.stack.pop()]].pop()
            self.reach.pop()

    def is_apart(self, name: str, attributes: str, inside: bool) -> bool:
        if name in APART or name == "header" and not inside:
            return True
        if not attributes or name in ("html", "body", "article", "main") or name not in BLOCK:
            return False
        for m in MARKED.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "role" and value in ROLES:
                return True
            if key in ("class", "id") and any(self.named_apart(x, inside or name in HEADINGS) for x in value.split()):
                return True
        return False

    @staticmethod
    def named_apart(name: str, inside: bool) -> bool:
        """By the first or last word of a class or id: sidebar-left and site-footer, but neither with-sidebar nor article-header."""
        words = [x for x in re.split("[^a-z]+", name) if x]
        if not words or words[0] in OTHERS:
            return False
        ends = {words[0], words[-1]}
        return bool(ends & WORDS) or ("header" in ends and not inside and words[0] not in PARTS)

    def densities(self, own: list[tuple[int, str]]) -> tuple[list[int], list[float], list[float]]:
        """Every node's characters, composite density, and sum of its children's densities."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for k, t in own:
            c = len(t) - t.count(" ") - t.count("\n")
            chars[k] += c
            link_chars[k] += c if self.linked[k] else 0
        for k in range(n - 1, 0, -1):
            if not self.apart[k]:
                p = self.parent[k]
                chars[p] += chars[k]
                tags[p] += tags[k] + 1
                link_chars[p] += link_chars[k]
                link_tags[p] += link_tags[k] + (self.tag[k] == "a")
        body = self.body()
        share = link_chars[body] / max(1, chars[body])

        def density(k: int) -> float:
            c, t, lc, lt = chars[k], max(1, tags[k]), max(1, link_chars[k]), max(1, link_tags[k])
            if not c:
                return 0.0
            base = log(c / max(1, c - link_chars[k]) * link_chars[k] + share * c + e)
            return c / t * max(0.0, log(c / lc * t / lt)) / log(base) if base > 1.0 + 1e-9 else c / t

        dense = [0.0 if self.apart[k] else density(k) for k in range(n)]
        sums = [0.0] * n
        for k in range(1, n):
            sums[self.parent[k]] += dense[k]
        return chars, dense, sums

    def body(self) -> int:
        return next((k for k, t in enumerate(self.tag) if t == "body"), 0)

    def chosen(self, own: list[tuple[int, str]], part: float) -> set[int]:
        """The roots of the article's subtrees."""
        chars, dense, sums = self.densities(own)
        body = self.body()
        fit = [k for k, t in enumerate(self.tag) if not self.apart[k] and chars[k] and (k == 0 or t in BLOCK and t not in INNER)]
        if not chars[0] or not fit:
            return set()
        # what holds the whole page counts by what in it can't be a core itself: text and paragraphs straight in the body
        blocks = set(fit)
        whole = {k for k in fit if k in (0, body) or self.tag[k] == "html"}
        own_sums = dict.fromkeys(whole, 0.0)
        for k in range(1, len(self.tag)):
            if self.parent[k] in whole and k not in blocks:
                own_sums[self.parent[k]] += dense[k]
        core = max(fit, key=lambda k: (own_sums.get(k, sums[k]), k in whole, -k))
        if self.inside[core]:
            while self.tag[core] not in ("article", "main"):
                core = self.parent[core]
            return {core}
        path = [core]
        while path[-1] > 0 and path[-1] != body:
            path.append(self.parent[path[-1]])
        threshold = min([dense[k] for k in path if k != body and k > 0], default=0.0)
        beside: dict[int, list[int]] = {k: [] for k in path[1:]}
        for k in range(1, len(self.tag)):
            if self.parent[k] in beside and not self.apart[k] and chars[k]:
                beside[self.parent[k]].append(k)
        found = {core}
        for below, above in zip(path, path[1:], strict=False):
            found.update(k for k in beside[above] if k != below and (dense[k] >= threshold and chars[k] >= part * chars[core] or self.tag[k] in HEADINGS and k < below))
        return found

    def text(self, part: float = 0.25) -> str:
        own = [(k, unescape(t) if "&" in t else t) for k, t in self.texts]
        return self.blocks(self.chosen(own, part), own)

    def blocks(self, roots: set[int], own: list[tuple[int, str]]) -> str:
        """The texts under the roots, a line for each block."""
        n = len(self.tag)
        inside, block = [False] * n, [0] * n
        inside[0] = 0 in roots
        for k in range(1, n):
            inside[k] = inside[self.parent[k]] or k in roots
            block[k] = k if self.tag[k] in LINES else block[self.parent[k]]
        lines: list[list[str]] = []
        now = None
        for k, t in own:
            if inside[k]:
                if block[k] != now:
                    lines.append([])
                    now = block[k]
                elif self.tag[k] in ("td", "th"):
                    lines[-1].append(" ")
                lines[-1].append(t)
        out = (" ".join("".join(x).split()) for x in lines)
        return "\n".join(x for x in out if x)


def main_text(html: str) -> str:
    return Page(html).text() if html else ""


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """pages' other columns with the main text; a column of that name is replaced."""
    import pyarrow as pa

    kept = [c for c in pages.columns if c not in (html, into)]
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept), f"`{into}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = [main_text(x) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.string())], names=[*kept, into])

    return pages.select(*(F.col(f"`{c}`") for c in kept), text_of(f"`{html}`").alias("__html")).mapInArrow(run, schema)
