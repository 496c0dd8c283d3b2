"""Main text of web pages by consensus paths of their hosts.

Every page is parsed once to score its containers: characters of text that is not boilerplate,
less those of link text.  The best container votes for its generalised path, tags and classes
from the root with digits as #.  Spark counts the votes by host and path and takes the path with
the most votes of each host.  Then every page is extracted with the path of its host; a page
uses its own best container where that path gives nothing, or has no first heading and less than
half of the characters.

A name such as header or widget, or a form, does not make boilerplate alone: an element that
holds most of the page's sentences is a wrapper and its text stays (`Page._wrappers`).

Votes are rows of (host, path), counted before the shuffle, so a host with a third of all pages
is no hot group.  The pages are joined with one row per host: broadcast if few, else shuffled,
with hot hosts split by adaptive execution.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from credence.llm.common import column, join_checked, records, stored

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style", "xmp", "noembed", "noframes"))
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "li legend main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split())
#: Elements that hold no text of an article.
_DROPPED = frozenset(
    "head title script style noscript template nav menu footer aside label legend button select "
    "textarea input iframe object embed svg canvas dialog datalist audio video map xmp noembed noframes"
    .split())
_CONTAINER = frozenset("html body article main section div td center table blockquote".split())
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: First or last part of a class or id of boilerplate.
_MARKS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidenav footer header "
    "masthead banner ad ads advert adverts advertisement advertising adsense sponsor sponsored "
    "promo promotion cookie cookies consent gdpr notice notices disclaimer alert popup modal "
    "overlay comment comments disqus respond replies reply discussion share sharing social "
    "related recommended recommendations pagination pager newsletter subscribe subscription "
    "signup login search toolbar widget widgets tags toc".split())
#: Of these, names of layout too: such an element may be a wrapper of the article.
_LAYOUT = frozenset("header banner masthead widget widgets toolbar overlay modal popup notice notices "
                    "alert search login promo promotion tags nav navbar menu sidebar".split())
#: A header with one of these in its name belongs to the article.
_ARTICLE = frozenset("article post entry story content news blog".split())
_LONG_BLOCK = 8     # words from which a block counts as sentences
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog "
                   "menu menubar toolbar".split())
_NO_MARK = frozenset(("has", "with", "no", "is", "without", "js"))
_KEPT = frozenset(("html", "body", "article", "main"))
#: A start tag of the first set ends an open element of the second, up to the nearest third.
_P_ENDS = _BLOCK - frozenset(("body", "head", "html", "title", "option", "optgroup", "legend",
                              "caption", "tbody", "td", "tfoot", "th", "thead", "tr"))
_ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)),
         "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
         "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
         "option": (("option",), ("select",)), "tbody": (("tbody", "thead", "tr", "td", "th"),
                                                         ("table",))}
_SCOPE = frozenset(("table", "td", "th", "html", "article", "button", "object", "caption"))
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def _tags(html: str) -> Iterator[tuple[str, str, str]]:
    """('', text, ''), (name, attributes, '') and ('/', name, '') in order.

    One pass: no part of the page is looked at more often than a few times, whatever is missing.
    """
    at, end, quotes = 0, len(html), {'"': True, "'": True}
    while at < end:
        open_ = html.find("<", at)
        if open_ < 0:
            yield "", html[at:], ""
            return
        if open_ > at:
            yield "", html[at:open_], ""
        if html.startswith("<!--", open_):
            close = html.find("-->", open_ + 4)
            at = end if close < 0 else close + 3
            continue
        if html.startswith(("<!", "<?"), open_):
            close = html.find(">", open_)
            at = end if close < 0 else close + 1
            continue
        name = _NAME.match(html, open_ + 1)
        if not name:
            yield "", "<", ""
            at = open_ + 1
            continue
        close = name.end()
        while True:
            close = _PLAIN.match(html, close).end()
            if close >= end or html[close] == ">":
                break
            quote = html[close]     # a quote that never ends is a character like any other
            after = html.find(quote, close + 1) if quotes[quote] else -1
            quotes[quote] = quotes[quote] and after >= 0
            close = close + 1 if after < 0 else after + 1
        tag, at = name[1].lower(), close + 1
        if html[open_ + 1] == "/":
            yield "/", tag, ""
            continue
        yield tag, html[name.end():close], ""
        if tag in _RAW or tag in ("textarea", "title"):
            past = re.compile(f"</{tag}", re.I).search(html, at)
            if tag in _RAW or not past:
                at = past.start() if past else (end if tag in _RAW else at)
            else:
                yield "", html[at:past.start()], ""
                at = past.start()


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _marks(names: str) -> set[str]:
    """The words of boilerplate in classes and ids."""
    out = set()
    for name in names.lower().split():
        parts = [p for p in re.split(r"[-_:]+", re.sub(r"[0-9]+", "", name)) if p]
        if parts and parts[0] not in _NO_MARK:
            found = _MARKS.intersection((parts[0], parts[-1]))
            if found != {"header"} or not _ARTICLE.intersection(parts):
                out |= found
    return out


#: Kinds of elements: text, dropped whatever it holds, boilerplate by name, by a name of layout,
#: and a discussion, which is one of readers if something in it is boilerplate too.
_TEXT, _GONE, _NAMED, _WEAK, _TALK = range(5)


def _kind(tag: str, given: dict[str, str], in_article: bool) -> int:
    if tag in _DROPPED:
        return _GONE
    if tag in _KEPT or tag in _HEADING:
        return _TEXT
    style = given.get("style", "").replace(" ", "").lower()
    if ("hidden" in given or given.get("aria-hidden") == "true" or "display:none" in style
            or "visibility:hidden" in style or given.get("role", "").lower() in _ROLES):
        return _GONE
    marks = _marks(given.get("class", "") + " " + given.get("id", "")) if given else set()
    if marks and tag not in _BLOCK:
        return _GONE        # inside a line nothing is a wrapper
    if marks == {"discussion"}:
        return _TALK
    if marks - _LAYOUT:
        return _NAMED
    return _WEAK if marks or tag == "form" or tag == "header" and not in_article else _TEXT


def generalised(tag: str, classes: str) -> str:
    """One step of a path: the tag and its sorted classes, digits as #."""
    names = sorted({re.sub(r"[0-9]+", "#", c).replace("/", "_")
                    for c in classes.lower().split()})
    return ".".join([tag, *names])


class Page:
    """Elements of a page as parallel lists, and its blocks of text."""

    def __init__(self, html: str):
        self.parent, self.tag, self.path, self.article = [-1], ["#root"], [0], [False]
        self._steps: dict[tuple[int, str], int] = {}    # path and step below -> path
        self._up: list[tuple[int, str]] = [(0, "")]     # path -> path above and step
        self._count: Counter = Counter()                # open elements by tag
        self.blocks: list[tuple[int, str, int]] = []     # element, text, characters in links
        self._stack, self._texts, self._links, self._linked = [0], [], 0, 0
        self._skip = 0      # open elements from the first dropped one on
        self._kinds: dict[int, int] = {}                # elements that may be boilerplate
        for kind, value, _ in _tags(html):
            if not kind:
                if not self._skip:
                    self._add(value)
            elif kind == "/":
                self._close(value)
            else:
                self._open(kind, value)
        self._flush()
        if self._kinds:
            self._drop()

    def _add(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        self._texts.append(text)
        if self._linked:
            self._links += len(text.strip())

    def _flush(self) -> None:
        if self._texts:
            text = " ".join("".join(self._texts).split())
            if text:
                self.blocks.append((self._stack[-1], text, self._links))
            self._texts.clear()
        self._links = 0

    def _pop(self, depth: int) -> None:
        """Close all elements above this depth of the stack."""
        for element in reversed(self._stack[depth:]):
            if self.tag[element] in _BLOCK and not self._skip:
                self._flush()
            self._linked -= self.tag[element] == "a" and not self._skip
            self._count[self.tag[element]] -= 1
            self._stack.pop()
            if self._skip:
                self._skip -= 1

    def _close(self, tag: str) -> None:
        if tag == "br" or tag == "p":
            self._texts.append(" ")
        for depth in range(len(self._stack) - 1, 0, -1) if self._count[tag] else ():
            own = self.tag[self._stack[depth]]
            if own == tag:
                self._pop(depth)
                return
            if tag not in _BLOCK and own in _BLOCK:
                return      # an inline end tag ends nothing outside its block
            if own in ("td", "th", "table", "article") and tag in ("p", "div", "li", "span"):
                return

    def _end_implied(self, tag: str) -> None:
        if tag in _P_ENDS and self._count["p"]:
            for depth in range(len(self._stack) - 1, 0, -1):
                own = self.tag[self._stack[depth]]
                if own == "p":
                    self._pop(depth)
                    break
                if own in _BLOCK:
                    break
        ends, stop = _ENDS.get(tag, ((), ()))
        found = any(self._count[t] for t in ends)
        for depth in range(len(self._stack) - 1, 0, -1) if found else ():
            own = self.tag[self._stack[depth]]
            if own in stop:
                break
            if own in ends:
                self._pop(depth)
                if tag not in ("tr", "tbody"):
                    break

    def _open(self, tag: str, text: str) -> None:
        if self._skip:      # within a dropped element only the nesting counts
            if tag not in _VOID and not text.endswith("/"):
                self._push(tag, self.path[self._stack[-1]], False)
                self._skip += 1
            return
        self._end_implied(tag)
        if tag == "br":
            self._texts.append(" ")
        elif tag in _BLOCK:
            self._flush()
        if tag in _VOID:
            return
        given = _attributes(text) if text.strip() else {}
        up = self._stack[-1]
        article = self.article[up] or tag in ("article", "main")
        what = _kind(tag, given, article)
        path = self.path[up]
        if tag in _CONTAINER or tag in _BLOCK:
            key = (path, generalised(tag, given.get("class", "")))
            path = self._steps.setdefault(key, len(self._up))
            if path == len(self._up):
                self._up.append(key)
        self._push(tag, path, article)
        self._linked += tag == "a"
        if what > _GONE:
            self._kinds[len(self.tag) - 1] = what
        elif what == _GONE:
            if tag in _BLOCK:
                self._flush()
            self._skip = 1

    def _push(self, tag: str, path: int, article: bool) -> None:
        self.parent.append(self._stack[-1])
        self.tag.append(tag)
        self.path.append(path)
        self.article.append(article)
        self._count[tag] += 1
        self._stack.append(len(self.tag) - 1)

    def _drop(self) -> None:
        """Take away the blocks of boilerplate."""
        kinds, n = self._kinds, len(self.tag)
        inner = [False] * n         # whether a marked element is inside
        for k in range(n - 1, 0, -1):
            if inner[k] or k in kinds:
                inner[self.parent[k]] = True
        marked = {k for k, what in kinds.items() if what != _TALK or inner[k]}
        owner = [0] * n             # the marked element that is next above, or the element
        for k in range(1, n):
            owner[k] = k if k in marked else owner[self.parent[k]]
        kept = self._wrappers(sorted(marked), owner)
        self.blocks = [b for b in self.blocks if owner[b[0]] in kept]

    def _wrappers(self, marked: list[int], owner: list[int]) -> set[int]:
        """0 and the marked elements that hold the article: those with a name of layout, or
        forms, with more than twice the sentences (blocks of eight words) outside of marked
        elements.  One without a first heading is none if there is such a heading outside.
        """
        own, first = Counter(), set()
        for element, text, links in self.blocks:
            if text.count(" ") >= _LONG_BLOCK - 1:
                own[owner[element]] += max(0, len(text) - 2 * links)
            if self.tag[element] == "h1":
                first.add(owner[element])
        weight, below, heading = Counter(own), {}, set(first)
        for m in reversed(marked):
            up = owner[self.parent[m]]
            below.setdefault(up, []).append(m)
            if self._kinds[m] == _WEAK:
                weight[up] += weight[m]
                if m in heading:
                    heading.add(up)
        free, kept, heap = own[0], {0}, []
        new, has_first = 0, 0 in first
        while True:
            for m in below.get(new, ()):
                if self._kinds[m] == _WEAK:
                    heappush(heap, (-weight[m], m))
            while heap and has_first and heap[0][1] not in heading:
                heappop(heap)
            if not heap or -heap[0][0] <= 2 * free:
                return kept
            new = heappop(heap)[1]
            kept.add(new)
            free += own[new]
            has_first |= new in first

    def scores(self) -> list[tuple[int, bool]]:
        """Of each element: characters of text less twice those in links, and whether a first
        heading is inside."""
        score, heading = [0] * len(self.tag), [False] * len(self.tag)
        for element, text, links in self.blocks:
            score[element] += len(text) - 2 * links
            heading[element] |= self.tag[element] == "h1"
        for k in range(len(self.tag) - 1, 0, -1):       # an element comes after its parent
            score[self.parent[k]] += score[k]
            heading[self.parent[k]] |= heading[k]
        return list(zip(score, heading))

    def best(self) -> int:
        """The container of the article.

        Among those with nine tenths of the best score it is an article or main element, then one
        with the first heading, then the innermost.  Unless it is such an element, it grows to the
        outermost of them that has paragraphs or headings of its own next to it: a lead or a
        closing paragraph belongs to the article, a container beside it does not.
        """
        scores = {k: s for k, s in enumerate(self.scores())
                  if k == 0 or self.tag[k] in _CONTAINER and s != (0, False)}
        most = max(s for s, _ in scores.values())
        enough = most - 0.1 * abs(most)
        best = max((k for k, (s, _) in scores.items() if s >= enough), key=lambda k: (
            self.tag[k] in ("article", "main"), scores[k][1], k))
        if self.tag[best] in ("article", "main"):
            return best
        flows = set()               # containers with text outside of inner containers
        for element, text, links in self.blocks:
            if 2 * links < len(text):
                while element and self.tag[element] not in _CONTAINER:
                    element = self.parent[element]
                flows.add(element)
        at = best
        while at:
            at = self.parent[at]
            if at in flows and at in scores and scores[at][0] >= enough:
                best = at
        return best

    def vote(self) -> str:
        steps, at = [], self.path[self.best()]
        while at:
            at, step = self._up[at]
            steps.append(step)
        return "/".join(steps[::-1])

    def _elements(self, path: str) -> set[int]:
        at = 0
        for step in path.split("/") if path else ():
            at = self._steps.get((at, step), -1)
        return {k for k, p in enumerate(self.path)
                if p == at and (k == 0 or self.tag[k] in _CONTAINER)}

    def text(self, path: str | None) -> str:
        """Blocks inside the elements with this path, or else inside the best container."""
        found = self._inside(self._elements(path)) if path is not None else []
        if any(self.tag[element] == "h1" for element, _, _ in found):
            own = []
        else:
            own = self._inside({self.best()})
        size = lambda blocks: sum(len(t) for _, t, _ in blocks)
        return "\n".join(t for _, t, _ in (own if 2 * size(found) < size(own) else found))

    def _inside(self, chosen: set[int]) -> list[tuple[int, str, int]]:
        inside = [False] * len(self.tag)
        for k, up in enumerate(self.parent):
            inside[k] = k in chosen or k > 0 and inside[up]
        return [b for b in self.blocks if inside[b[0]]]


def main_text(html: str, path: str | None = None) -> str:
    return Page(html).text(path)


def _votes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        paths = [Page(html).vote() for (html,) in records(part, "html")]
        yield pa.RecordBatch.from_arrays(
            [part.column(part.schema.get_field_index("host")), pa.array(paths, pa.string())],
            names=["host", "path"])


def _texts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        texts = [main_text(html, path) for html, path in records(part, "html", "path")]
        yield pa.RecordBatch.from_arrays(
            [part.column(part.schema.get_field_index(n)) for n in ("page_id", "url")]
            + [pa.array(texts, pa.string()), part.column(part.schema.get_field_index("path"))],
            names=["page_id", "url", "text", "host_path"])


def consensus_paths(pages: DataFrame) -> DataFrame:
    """host -> path with the most votes; of equal ones the longer, then the larger hash."""
    votes = pages.where("html <> ''").select("host", "html").mapInArrow(
        _votes, "host string, path string").groupBy("host", "path").agg(
        F.count("*").alias("n"))
    return votes.groupBy("host").agg(F.max_by("path", F.struct(
        "n", F.length("path"), F.xxhash64("path"))).alias("path"))


def extract(df: DataFrame, id_column: str = "page_id", url_column: str = "url",
            html_column: str = "html") -> DataFrame:
    """One row per row: page_id, url, text, host_path.

    Blocks are joined in page order by one line feed; white space inside a block is one space.  A
    null or empty page has an empty text and no vote; pages without a URL are one host.  Paths with
    equal votes are told apart by length, then by hash.  Repeated rows vote and are extracted each; other columns are ignored.
    """
    url = column(url_column).cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z+.-]+://([^/?#]*)", 1))
    pages = df.select(column(id_column).alias("page_id"), url.alias("url"), host.alias("host"),
                      F.coalesce(column(html_column).cast("string"), F.lit("")).alias("html"))
    winners = stored(consensus_paths(pages), "host-paths")
    kind = pages.schema["page_id"].dataType.simpleString()
    return join_checked(pages, winners, ["host"]).select(
        "page_id", "url", "html", "path").mapInArrow(
        _texts, f"page_id {kind}, url string, text string, host_path string")
