"""Visible text of web pages.

The first <article>, else the first <main>, else the body, is read in document order.  Text under
excluded tags or hidden elements is left out, <br> is a line end, and so is the end of a text whose
parent is a block tag.  A body with nothing but preformatted text gives that.  A selection, if not
blank, is taken as it is.  What is hidden is told by attributes and by the cascade (styles) of inline
styles and of the rules in <style> elements above it; linked sheets aren't read.

By the standard some character references count without their semicolon, so a text cut within `&amp;`
reads `&`.  With open_references=False only closed ones do and others stay as they are written.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from glossaria.sources.styles import Around, Sheet

# Tags without reading text, and tags that end a line.
EXCLUDED = frozenset("script style noscript template nav header footer aside form input textarea select option datalist button pre code kbd samp var svg canvas iframe object embed video audio".split())
BLOCKS = frozenset("p div section article main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th caption blockquote figure figcaption address details summary dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_CLOSES_P = BLOCKS - {"tr", "td", "th", "thead", "tbody", "caption"} | {"pre", "form", "hr", "header", "footer", "nav", "aside"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_BARRIERS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}}
_ROOTS = ("article", "main", "body")
# What the standard says of tables, of where an end tag is looked for, and of what formatting tags can't be around.
_IN_TABLE = frozenset("table tbody thead tfoot tr".split())
_CELLS = frozenset("td th caption".split())
_TABLE_PARTS = frozenset("tbody thead tfoot tr td th caption col colgroup".split())
_SCOPES = frozenset("table td th caption object template".split())
_P_SCOPES = _SCOPES | {"button"}
_SPECIAL = BLOCKS | _TABLE_PARTS | frozenset("aside button center dir fieldset footer form frameset header hgroup iframe listing menu nav noscript object pre select template textarea".split())
_NO_LINES = [False]
_ROUNDS = 8  # how many blocks the end of a formatting tag looks into
ALIKE, MOST_FORMATS = 3, 64
_HEAD = frozenset("head title meta link base script style noscript template".split())
#: Scripts and styles, in which nothing is a reference, and an & that begins no closed reference.
_OPEN_REFERENCE = re.compile(r"<(script|style)\b.*?(?:</\1|\Z)|&(?![A-Za-z][A-Za-z0-9]{0,40};|#[0-9]{1,10};|#[xX][0-9A-Fa-f]{1,10};)", re.S | re.I)


def has_hiding_attribute(attrs: dict[str, str | None]) -> bool:
    """What hides an element whatever the styles say."""
    return "hidden" in attrs or attrs.get("aria-hidden") == "true"


class _Element:
    __slots__ = ("tag", "attrs", "hidden", "at", "matched", "around", "out", "before", "ends_lines")

    def __init__(self, tag: str, attrs: tuple = (), hidden: bool = False, matched: frozenset = frozenset()):
        self.tag, self.attrs, self.hidden, self.at = tag, attrs, hidden, -1  # at: the place among the open ones
        self.matched, self.around = matched, None  # the steps of selectors that it and its children match
        self.out: list = []  # where what is in it goes
        self.before: list | None = None  # of a table: what stands in it and belongs before it
        self.ends_lines = [tag in BLOCKS]  # whether texts directly in it do; kept by the texts, as it may change for those so far


class _Page(HTMLParser):
    """Keeps each text and <br> with what is around it, where the standard's tree has them.

    Formatting tags that a block closed are opened again, but not within a cell; the end of one that
    has blocks in it leaves the blocks open and takes what was in them so far along; what may not stand in
    a table goes before it.  Time is linear in the page but for re-opened tags, of which there are three
    alike and MOST_FORMATS in all at most, as in browsers, and for rules whose parts name neither tag,
    class, id nor attribute.  What is around a text is kept as counters of open elements; an element
    closed in the middle leaves an empty place among the open ones.
    """

    def __init__(self, excluded: frozenset, hidden: Callable[[str, dict], bool] | None):
        super().__init__(convert_charrefs=True)
        self.excluded, self.is_hidden = excluded, hidden
        self.open: list[_Element | None] = []
        self.places: dict[str, list[int]] = defaultdict(list)  # of each tag among the open ones
        self.special: list[int] = []  # the places of those that an end tag isn't looked for beyond
        self.quirks = True  # until there is a doctype
        self.begins_pre = False  # a line end there doesn't count
        self.formats: list[_Element | None] = []  # None: a cell begins, within which those before don't count
        self.first: dict[str, _Element] = {}
        self.sheet = Sheet()
        self.in_head = self.unseen = self.unseen_but_pre = 0
        self.events: list = []  # texts with what is around them; None where an element or comment parts texts; lists of what goes before a table

    def _count(self, e: _Element, by: int):
        for step in e.matched:
            self.sheet.open[step] += by
        self.in_head += by * (e.tag in _HEAD)
        self.unseen += by * (e.tag in self.excluded or e.hidden)
        self.unseen_but_pre += by * (e.tag in self.excluded and e.tag != "pre" or e.hidden)

    def _out(self) -> list:
        """Where what comes now goes."""
        if not self.open:
            return self.events
        e = self.open[-1]
        return self.open[self.places["table"][-1]].before if e.tag in _IN_TABLE and self.places["table"] else e.out

    def _push(self, e: _Element):
        if e.tag in _TABLE_PARTS or e.tag in ("script", "style", "template"):
            e.out = self.open[-1].out if self.open else self.events
        else:
            e.out = self._out()
        if e.tag == "table":
            e.before = []
            e.out.append(e.before)
        e.out.append(None)
        e.at = len(self.open)
        self.open.append(e)
        self.places[e.tag].append(e.at)
        if e.tag in _SPECIAL:
            self.special.append(e.at)
        self.first.setdefault(e.tag, e)
        self._count(e, 1)

    def _pop(self):
        e = self.open.pop()
        if e:
            self.places[e.tag].pop()
            if e.tag in _SPECIAL:
                self.special.pop()
            self._count(e, -1)
            e.at = -1
            if e.tag in _CELLS and None in self.formats:
                while self.formats.pop() is not None:
                    pass
        while self.open and self.open[-1] is None:
            self.open.pop()

    def _take_out(self, e: _Element):
        if e.at == len(self.open) - 1:
            self._pop()
        elif e.at >= 0:
            self.open[e.at] = None
            places = self.places[e.tag]
            del places[bisect_left(places, e.at)]  # they rise, and it is nearly always the last
            self._count(e, -1)
            e.at = -1

    def _last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _close(self, tags, stop=frozenset()):
        """Closes the innermost of the tags and all in it, unless one of stop lies further in."""
        at = self._last(tags)
        if at >= 0 and at > self._last(stop):
            while len(self.open) > at:
                self._pop()

    def _in_body(self):
        if "body" not in self.first:
            while self.open and self.open[-1].tag != "html":
                self._pop()
            self._push(_Element("body"))

    def _reopen(self):
        closed = []
        for e in reversed(self.formats):
            if e is None:
                break
            if e.at < 0:
                closed.append(e)
        for e in reversed(closed):
            self._push(e)

    def _seen(self, text: str | None):
        """A text, or the end of a line."""
        out, e = self._out(), self.open[-1] if self.open else None
        if e and e.tag in _IN_TABLE and self.places["table"]:
            if text is not None and not text.strip(" \t\n\f\r"):
                out = e.out  # blanks stay in a table
            else:
                at = self.places["table"][-1] - 1
                while at >= 0 and self.open[at] is None:
                    at -= 1
                e = self.open[at] if at >= 0 else None
        inside = tuple(tag in self.first and self.first[tag].at >= 0 for tag in _ROOTS)
        out.append((text, e.ends_lines if e else _NO_LINES, self.unseen == 0, self.unseen_but_pre == 0, inside))

    def _read_sheet(self, css: str):
        self.sheet.add(css)
        for e in (self.first.get("html"), self.first.get("body")):  # they stand around all that follows
            if e and e.at >= 0 and not self.is_hidden:
                self._count(e, -1)
                e.hidden, e.matched = self._styled(e.tag, dict(e.attrs), Around())
                self._count(e, 1)

    def _styled(self, tag: str, attrs: dict, around: Around | None = None) -> tuple[bool, frozenset]:
        """Whether an element is hidden, and the steps of selectors that it matches."""
        if self.is_hidden:
            return self.is_hidden(tag, attrs), frozenset()
        matched = frozenset()
        if self.sheet.n:
            parent = self.open[-1] if self.open and not around else None  # the outermost has none
            if parent:
                around = parent.around = parent.around or Around()
            around = around or Around()
            matched = around.last = self.sheet.matched(tag, attrs, parent.matched if parent else frozenset(), around)
            around.any |= matched
        return has_hiding_attribute(attrs) or (bool(matched) or "style" in attrs) and self.sheet.hides(matched, attrs), matched

    def handle_decl(self, decl):
        self.quirks = self.quirks and not (decl.lower().startswith("doctype") and "html" not in self.first)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash means nothing

    def handle_comment(self, data):
        self._out().append(None)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            if tag not in self.first:
                self._close({"head"})
                self._push(_Element(tag, tuple(attrs), *self._styled(tag, dict(attrs))))
            return
        if tag not in _HEAD or "body" in self.first:
            self._in_body()
        in_table = bool(self.open) and self.open[-1].tag in _IN_TABLE
        if tag in _CLOSES_P and not (tag == "table" and self.quirks):
            self._close({"p"}, _P_SCOPES)
        if tag == "table" and in_table:
            self._close({"table"})
        if tag in _SIBLINGS:
            self._close(_SIBLINGS[tag], _BARRIERS[tag])
        if tag in _TABLE_PARTS:
            if not self.places["table"]:
                return  # outside of tables they mean nothing
            self._to_table_part(tag)
        elif tag not in BLOCKS and tag not in _HEAD:
            self._reopen()
        if tag == "br":
            self._seen(None)
        styled = self._styled(tag, dict(attrs))
        if tag in VOID:
            self._out().append(None)
            return
        e = _Element(tag, tuple(attrs), *styled)
        self._push(e)
        self.begins_pre = tag == "pre"
        if tag in _CELLS:
            self.formats.append(None)
        if tag in FORMATTING:
            alike = [x for x in self.formats if x and x.tag == tag and x.attrs == e.attrs]
            if len(alike) == ALIKE or len(self.formats) == MOST_FORMATS:
                self.formats.remove(alike[0] if len(alike) == ALIKE else next(x for x in self.formats if x))
            self.formats.append(e)

    def _to_table_part(self, tag: str):
        """Closes what a part of a table can't stand in: up to the table, or to its section or row."""
        within = {"table"} | ({"tbody", "thead", "tfoot"} if tag == "tr" else {"tr"} if tag in ("td", "th") else set())
        keep = self._last(within)
        while len(self.open) - 1 > keep:
            self._pop()

    def _end_of_format(self, known: _Element):
        """The blocks in it stay open, and what was directly in them so far stays within the tag."""
        self.formats.remove(known)
        if known.at < 0 or known.at < self._last(_SCOPES):
            return
        at = known.at
        blocks = self.special[bisect_left(self.special, at) :][:_ROUNDS]
        for k in blocks:
            e = self.open[k]
            e.ends_lines[0] = False  # texts directly in it so far are in the formatting tag from now on
            e.ends_lines = [e.tag in BLOCKS]
        if blocks:
            self._take_out(known)
        else:
            while len(self.open) > at:
                self._pop()

    def handle_endtag(self, tag):
        self.begins_pre = False
        if tag in FORMATTING:
            known = next((e for e in _until_none(reversed(self.formats)) if e.tag == tag), None)
            if known:
                self._end_of_format(known)
            elif self.places.get(tag) and self.places[tag][-1] > (self.special[-1] if self.special else -1):
                self._close({tag})
        elif tag == "br":
            self.handle_starttag("br", [])
        elif tag == "p" and (not self.places["p"] or self.places["p"][-1] < self._last(_P_SCOPES)):
            if "body" in self.first:
                self.handle_starttag("p", [])
                self._close({"p"})
        elif tag not in ("html", "body"):
            self._close({tag}, _SCOPES if tag not in _TABLE_PARTS and tag != "table" else frozenset({"table"}) - {tag})

    def handle_data(self, data):
        if self.begins_pre:
            data, self.begins_pre = data.removeprefix("\n"), False
            if not data:
                return
        if self.open and self.open[-1].tag == "style":
            self._read_sheet(data)
        if not self.in_head:
            if "body" not in self.first and not data.strip():
                return
            self._in_body()
            if not (self.open[-1].tag in _IN_TABLE and not data.strip()):
                self._reopen()
        self._seen(data)


def _until_none(found: Iterator) -> Iterator:
    for e in found:
        if e is None:
            return
        yield e


def _flat(events: list) -> Iterator:
    stack = [iter(events)]
    while stack:
        for e in stack[-1]:
            if isinstance(e, list):
                stack.append(iter(e))
                break
            yield e
        else:
            stack.pop()


def _visible(page: _Page, root: str, with_pre: bool = False) -> str:
    out, at, last = [], _ROOTS.index(root), None  # last: what tells whether the text before ends a line, if the next goes on with it
    for e in _flat(page.events):
        if e is None:
            if last and last[0]:
                out.append("\n")
            last = None
            continue
        text, ends_lines, seen, seen_with_pre, inside = e
        if last is not None and last is not ends_lines:
            if last[0]:
                out.append("\n")
            last = None
        if not inside[at]:
            continue
        if text is None:
            out.append("\n")
        elif seen_with_pre if with_pre else seen:
            out.append(text)
            last = ends_lines
    if last and last[0]:
        out.append("\n")
    return "".join(out)


def page_text(html: str | None, selection: str | None = None, excluded: frozenset = EXCLUDED, hidden: Callable[[str, dict], bool] | None = None, open_references: bool = True) -> tuple[str, str]:
    """(text, source): source is selection, article, main or body.  hidden(tag, attributes), if given, alone tells what isn't visible."""
    if selection and selection.strip():
        return selection, "selection"
    if html and not open_references:
        html = _OPEN_REFERENCE.sub(lambda m: "&amp;" if m[0] == "&" else m[0], html)
    page = _Page(excluded, hidden)
    page.feed(html or "")
    page.close()
    for root in ("article", "main"):
        if root in page.first:
            return _visible(page, root), root
    if "body" not in page.first:
        return "", "body"
    text = _visible(page, "body")
    return (text if text.strip() else _visible(page, "body", with_pre=True)), "body"


def collect_pages(pages: DataFrame, *ids: str, excluded: frozenset = EXCLUDED, hidden: Callable[[str, dict], bool] | None = None, open_references: bool = True) -> DataFrame:
    """(*ids, source, text) from pages(*ids, html[, selection]); see page_text."""
    chosen = pages.select(*ids, "html", *(["selection"] if "selection" in pages.columns else []))
    schema = ", ".join([f"{c} {chosen.schema[c].dataType.simpleString()}" for c in ids] + ["source string", "text string"])

    def run(batches):
        for b in batches:
            selections = b["selection"].to_pylist() if "selection" in b.schema.names else [None] * b.num_rows
            found = [page_text(h, s, excluded, hidden, open_references) for h, s in zip(b["html"].to_pylist(), selections)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ids), pa.array([f[1] for f in found], pa.string()), pa.array([f[0] for f in found], pa.string())], [*ids, "source", "text"])

    return chosen.mapInArrow(run, schema)
