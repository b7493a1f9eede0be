"""Main text of web pages by composite text density (Sun, Song and Liao, 2011).

Every DOM node gets its link-adjusted characters per tag; the densities of a node's children add up to its density sum. The node
of the largest sum is the core. The smallest density on the path from the body to it is the threshold: wherever a node reaches it,
the node of the largest sum below is content too. The smallest subtree that holds all content, widened to the article around it, is the
main text. Menus, page headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles are cut before. Outside an article that goes by element,
role, words of class or id, and blocks that are mostly links; what holds the article, or on a page without article and heading most of the text, is not cut. Inside an article it goes
by element and role, by names that mean comments, and by names that stand alone, of parts that hold little of the article's text: a section of links, or one called `related-work`, stays.

Pages are read by a scanner that passes over every character a bounded number of times, whatever the markup: unclosed tags, quotes and comments end with the page.

Defined results: null, empty or textless pages give the empty text; broken markup is read as far as it goes (an unclosed element
ends with its parent); text outside any element counts; repeated rows each get their result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import lean

#: Elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style noscript template iframe svg annotation annotation-xml canvas audio video map title datalist".split())
BOILER = frozenset("nav footer aside form button select textarea input fieldset menu dialog".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]), "thead": frozenset(["tr", "td", "th", "tbody"]), "tbody": frozenset(["tr", "td", "th", "thead", "tbody"]),
}
SCOPE = {"li": frozenset(["ul", "ol", "menu"]), "tr": frozenset(["table"]), "td": frozenset(["table", "tr"]), "th": frozenset(["table", "tr"]), "tbody": frozenset(["table"]), "thead": frozenset(["table"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"])}
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended trending "
    "comment comments disqus respond reply replies discussion widget toolbar pagination pager skip search paywall".split()
)
#: Parts that mark a name also where it is written as one word with others.
MARKS = re.compile(r"sidebar|footer|breadcrumb|cookie|newsletter|advert|navbar|navigation|^nav|nav$|menu$|^comment(?!ary)|comments?$")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


#: Words that stand for a part's purpose beside one of WORDS, so that the name still stands alone.
SHAPES = frozenset("box boxes list container wrapper wrap block section buttons bar area links posts articles stories form unit slot inner item items content top bottom left right".split())
#: Names that inside an article may as well head its own sections.
OWN = frozenset("discussion search notice notices alert reply replies respond social navigation menu banner overlay widget skip".split())
READERS = re.compile(r"(?:(?:user|reader|post|article|all)[-_]?)?comments?(?:[-_]?(?:list|section|area|thread|form|wrapper|container|box|block))?|disqus\w*")
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
TAG, SPACE, ATTRIBUTE, BARE = re.compile(r"[a-zA-Z][^\s/>]*"), re.compile(r"[\s/]*"), re.compile(r"[^\s/>=][^\s/>=]*|="), re.compile(r"[^\s>]*")
EQUALS = re.compile(r"\s*=\s*")
WHITE = re.compile(r"\s+")

P, P_SCOPE, HEAD = frozenset(["p"]), frozenset(["table", "td", "th", "button", "blockquote", "li", "div", "article", "section", "body"]), frozenset(["head"])
#: What a start tag closes: (tags, elements behind which they stay open).
RULES = [(P, P_SCOPE), (HEAD, frozenset()), *((CLOSES[t], SCOPE.get(t, frozenset())) for t in CLOSES)]
OF_P, OF_HEAD, RULE = 0, 1, {t: 2 + i for i, t in enumerate(CLOSES)}
#: For each element the rules in which it counts as a tag or as a scope.
AS_TAG = {t: [i for i, (tags, _) in enumerate(RULES) if t in tags] for t in {t for tags, _ in RULES for t in tags}}
AS_SCOPE = {t: [i for i, (tags, scope) in enumerate(RULES) if t in scope and t not in tags] for t in {t for _, scope in RULES for t in scope}}


class Tree:
    """Nodes in page order (parent, tag, attributes) and the events: (0 start | 1 end | 2 text, node, text)."""

    def __init__(self):
        self.tag, self.parent, self.attrs = ["#root"], [-1], [{}]
        self.events: list[tuple[int, int, str]] = [(0, 0, "")]
        self.stack = [0]
        self.open: Counter = Counter()  # by tag, so that a search for what is not open costs nothing
        self.near = [[0] for _ in RULES]  # of each rule: open tags within each open scope, so that one for what is out of scope costs nothing either

    def _push(self, node: int, tag: str) -> None:
        self.stack.append(node)
        self.open[tag] += 1
        for r in AS_TAG.get(tag, ()):
            self.near[r][-1] += 1
        for r in AS_SCOPE.get(tag, ()):
            self.near[r].append(0)

    def _pop(self) -> None:
        node = self.stack.pop()
        tag = self.tag[node]
        self.open[tag] -= 1
        for r in AS_SCOPE.get(tag, ()):
            self.near[r].pop()
        for r in AS_TAG.get(tag, ()):
            self.near[r][-1] -= 1
        self.events.append((1, node, ""))

    def _close(self, rule: int) -> None:
        """Closes the innermost open element of the rule's tags unless an element of its scope stands between."""
        if self.near[rule][-1]:
            tags = RULES[rule][0]
            while self.tag[self.stack[-1]] not in tags:
                self._pop()
            self._pop()

    def start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag in CLOSES:
            for _ in range(2 if tag in ("tr", "tbody", "thead") else 1):
                self._close(RULE[tag])
        elif tag in BLOCK:
            self._close(OF_P)
            if tag == "body":
                self._close(OF_HEAD)
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.attrs.append(attrs)
        self.events.append((0, node, ""))
        if tag in VOID or closed and tag in ("script", "style", "svg", "path", "iframe", "use", "g", "rect", "circle"):
            self.events.append((1, node, ""))
        else:
            self._push(node, tag)

    def end(self, tag: str) -> None:
        if tag in VOID or not self.open[tag]:
            return
        while self.tag[self.stack[-1]] != tag:
            self._pop()
        self._pop()

    def data(self, text: str) -> None:
        if text:
            self.events.append((2, self.stack[-1], unescape(text)))

    def finish(self, html: str) -> Tree:
        at, n = 0, len(html)
        while at < n:
            i = html.find("<", at)
            if i < 0:
                self.data(html[at:])
                break
            self.data(html[at:i])
            at = self._tag(html, i)
        while self.stack:
            self._pop()
        return self

    def _tag(self, html: str, i: int) -> int:
        """Reads the markup at html[i], a "<"; gives the place behind it."""
        n = len(html)
        if m := TAG.match(html, i + 1):
            return self._start_tag(html, m)
        if html.startswith("</", i) and (m := TAG.match(html, i + 2)):
            end = html.find(">", m.end())
            if end < 0:
                return n
            self.end(m[0].lower())
            return end + 1
        if html.startswith("<!--", i):
            if html.startswith((">", "->"), i + 4):
                return html.index(">", i) + 1
            end = html.find("-->", i + 4)
            return n if end < 0 else end + 3
        if html.startswith(("<!", "<?", "</"), i):
            end = html.find(">", i)
            return n if end < 0 else end + 1
        self.data("<")
        return i + 1

    def _start_tag(self, html: str, m: re.Match) -> int:
        n, tag, attrs, at = len(html), m[0].lower(), {}, m.end()
        while True:
            before, at = at, SPACE.match(html, at).end()
            if at >= n:
                return n  # a tag that never ends is none
            if html[at] == ">":
                closed = "/" in html[before:at]
                at += 1
                break
            a = ATTRIBUTE.match(html, at)
            name, value, at = a[0].lower(), "", a.end()
            if e := EQUALS.match(html, at):
                at = e.end()
                if at < n and html[at] in "\"'":
                    end = html.find(html[at], at + 1)
                    if end < 0:
                        return n
                    value, at = html[at + 1 : end], end + 1
                else:
                    v = BARE.match(html, at)
                    value, at = v[0], v.end()
            attrs.setdefault(name, unescape(value))
        self.start(tag, attrs, closed)
        if tag in RAW and self.stack and self.tag[self.stack[-1]] == tag:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, at)
            stop = end.start() if end else n
            if tag not in SILENT:
                self.data(html[at:stop])
            at = stop
        return at


def names(attrs: dict) -> set[str]:
    return {x.lower() for k in ("class", "id") if k in attrs for x in NAME_PART.findall(attrs[k])}


def stands_alone(name: str) -> bool:
    """A name of one of WORDS, alone or with words for a part's shape or place."""
    parts = {x.lower() for x in NAME_PART.findall(name)}
    return bool(parts & WORDS) and parts <= WORDS | SHAPES and not parts <= OWN | SHAPES


class Page:
    def __init__(self, html: str):
        self.tree = t = Tree().finish(html)
        n = len(t.tag)
        self.children: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            self.children[t.parent[i]].append(i)
        self.cut = [False] * n
        self.measure()
        self.prune()
        self.measure()

    def measure(self) -> None:
        """Characters, tags, link characters and link tags of each node's subtree, without what is cut."""
        t, n = self.tree, len(self.tree.tag)
        gone, link = [False] * n, [False] * n
        for i in range(n):
            p = t.parent[i]
            gone[i] = self.cut[i] or t.tag[i] in SILENT or (p >= 0 and gone[p])
            link[i] = t.tag[i] == "a" or (p >= 0 and link[p])
        chars, link_chars = [0] * n, [0] * n
        for kind, i, text in t.events:
            if kind == 2 and not gone[i] and (size := len(WHITE.sub("", text))):
                chars[i] += size
                link_chars[i] += size * link[i]
        tags = [int(not gone[i]) for i in range(n)]
        link_tags = [int(not gone[i] and t.tag[i] == "a") for i in range(n)]
        for i in range(n - 1, 0, -1):
            p = t.parent[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i]
            link_tags[p] += link_tags[i]
        self.gone, self.chars, self.tags, self.link_chars, self.link_tags = gone, chars, tags, link_chars, link_tags

    def prune(self) -> None:
        t = self.tree
        n = len(t.tag)
        within, holds = [0] * n, [False] * n  # within: the outermost article around, or 0
        for i in range(1, n):
            p = t.parent[i]
            within[i] = within[p] or (p if t.tag[p] in ("article", "main") else 0)
        for i in range(n - 1, 0, -1):
            holds[t.parent[i]] |= holds[i] or t.tag[i] in ("article", "main", "h1")
        plain = [c - x for c, x in zip(self.chars, self.link_chars, strict=True)]
        for i in range(1, n):
            tag, attrs = t.tag[i], t.attrs[i]
            if tag in ("html", "body", "article", "main") and not names(attrs) & {"comment", "comments", "ad", "advert", "sponsored", "related", "reply"} or tag in ("html", "body"):
                continue
            bad = tag in BOILER or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
            if tag == "header" or "header" in (found := names(attrs)):
                bad |= not within[i] and not holds[i]
            if within[i]:
                own = [x.lower() for k in ("class", "id") if k in attrs for x in attrs[k].split()]
                bad |= any(map(READERS.fullmatch, own)) or (8 * plain[i] <= plain[within[i]] and any(map(stands_alone, (x for k in ("class", "id") if k in attrs for x in attrs[k].split()))))
                self.cut[i] = bad
                continue
            bad |= bool(found & WORDS or any(map(MARKS.search, found)))
            if bad and tag not in BOILER and (holds[i] or ((within[i] or not holds[0]) and 2 * plain[i] > plain[0])) and not found & {"comment", "comments"}:
                bad = False
            if not bad and tag in ("ul", "ol", "div", "section", "table", "p") and self.link_tags[i] >= 3 and self.link_chars[i] >= 0.6 * self.chars[i]:
                bad = not holds[i]
            self.cut[i] = bad

    def densities(self) -> list[float]:
        """Composite text density: characters per tag, adjusted by the shares of link characters and link tags."""
        body = next((i for i, t in enumerate(self.tree.tag) if t == "body"), 0)
        share = self.link_chars[body] / self.chars[body] if self.chars[body] else 0.0
        out = []
        for c, t, lc, lt in zip(self.chars, self.tags, self.link_chars, self.link_tags, strict=True):
            if not c:
                out.append(0.0)
                continue
            t, free = max(t, 1), max(c - lc, 1)
            base = math.log(c / free * lc + share * c + math.e)
            value = max(c / max(lc, 1) * (t / max(lt, 1)), 1.0)
            out.append(c / t * math.log(value) / math.log(base) if base > 1 + 1e-9 else c / t * math.log(value))
        return out

    def main_node(self) -> int:
        t = self.tree
        n = len(t.tag)
        body = next((i for i, x in enumerate(t.tag) if x == "body"), 0)
        if not self.chars[body]:
            body = 0
        if not self.chars[body]:
            return body
        own = self.densities()
        total = [sum(own[c] for c in kids if not self.gone[c]) for kids in self.children]
        # a node's own text counts as one child
        direct = list(self.chars)
        for i in range(1, n):
            direct[t.parent[i]] -= self.chars[i]
        total = [s + (own[i] if direct[i] > 0 else 0.0) for i, s in enumerate(total)]
        last = list(range(n))
        for i in range(n - 1, 0, -1):
            last[t.parent[i]] = max(last[t.parent[i]], last[i])
        best = list(range(n))
        for i in range(n - 1, body, -1):
            p = t.parent[i]
            if p >= 0 and not self.gone[i] and total[best[i]] > total[best[p]]:
                best[p] = best[i]
        core, threshold, i = best[body], math.inf, best[body]
        while i != body and i > 0:
            threshold = min(threshold, own[i])
            i = t.parent[i]
        threshold = min(threshold, own[body])
        marked, todo = [], [body]
        while todo:
            i = todo.pop()
            if not self.gone[i] and own[i] >= threshold - 1e-9 and self.chars[i]:
                marked.append(best[i])
                todo += self.children[i]
        low, high = min([core, *marked]), max(last[x] for x in [core, *marked])
        node = core
        while node != body and not (node <= low and last[node] >= high):
            node = t.parent[node]
        return self.widen(node, core, body, last)

    def widen(self, node: int, core: int, body: int, last: list[int]) -> int:
        """The article around the core that holds all content, or the content's node if articles hold only parts of it; without any, a parent that adds little more than a heading."""
        t = self.tree
        up, part = core, False
        while up > 0:
            if t.tag[up] in ("article", "main") or t.attrs[up].get("role") == "main":
                if up <= node and last[up] >= last[node]:
                    return up
                part = True
            up = t.parent[up]
        if part:
            return node
        while node not in (body, 0):
            p = t.parent[node]
            more = self.chars[p] - self.chars[node]
            if 4 * more > self.chars[p] or self.link_chars[p] - self.link_chars[node] > 0.3 * more:
                break
            node = p
        return node

    def text(self) -> str:
        t, node = self.tree, self.main_node()
        blocks, parts, depth = [], [], 0

        def flush():
            if block := WHITE.sub(" ", "".join(parts)).strip():
                blocks.append(block)
            parts.clear()

        for kind, i, text in t.events:
            if i == node and kind != 2:
                depth += 1 - 2 * kind
                flush()
            if not depth or self.gone[i]:
                continue
            if kind == 2:
                parts.append(text)
            elif t.tag[i] in BLOCK:
                flush()
            elif t.tag[i] in ("br", "td", "th", "option", "img"):
                parts.append(" ")
        flush()
        return "\n".join(blocks)


def main_text(html: str | None) -> str:
    return Page(html).text() if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages' id and all other columns but the html, with out_col: the main text, empty if there is none. A column of that name is replaced."""
    rest = [c for c in pages.columns if c not in (html_col, out_col)]
    named = pages.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(rest)), F.col(html_col).alias("html"))

    def run(batches):
        for b in batches:
            text = pa.array([main_text(h) for h in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], text], [*b.schema.names[:-1], "text"])

    out = named.mapInArrow(lean(run), named.drop("html").schema.add("text", "string"))
    order = [id_col, *(c for c in rest if c != id_col)]
    return out.select(*(F.col(f"c{rest.index(c)}").alias(c) for c in order), F.col("text").alias(out_col))
