"""HTML pages to the node table, error-tolerant: the standard tokenizer and implied tags."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.sources.tree import COMMENT, DOCTYPE, ELEMENT, TEXT, Nodes
from thicket.sources.xml import ParseOptions, _rows, wanted_columns

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("base link meta noscript script style template title".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: A start tag closes an open element of these, unless a barrier lies between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
BARRIER = frozenset("applet body button caption dl html marquee object ol select table td template th ul".split())


#: Open elements at most, where no options say otherwise.
MOST_OPEN = 512


#: A reference's ampersand; what is no place for references, or holds them as they are, comes first.
_AMPERSAND = re.compile(r"(<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\2|\Z))|&(?:(#[0-9]+|#x[0-9a-f]+|[a-z][a-z0-9]*)(;?))?", re.S | re.I)


def _as_text(m: re.Match) -> str:
    """An ampersand that begins no reference with an end is written as one that does."""
    if m[1] is not None or m[4] and (m[3][0] == "#" or f"{m[3]};" in html5):
        return m[0]
    return f"&amp;{m[0][1:]}"


class _Builder(HTMLParser):
    def __init__(self, nodes: Nodes, doc_id, o: ParseOptions):
        super().__init__(convert_charrefs=True)
        self.nodes, self.mark, self.o = nodes, nodes.begin(doc_id), o
        self.names: list[str] = []  # of open elements
        self.spots = [0]  # theirs, the document's first
        self.pieces: list[str] = []  # of the text node that came last
        self.cut_off: str | None = None

    def _cut(self):
        """What follows is no part of the text node that came last."""
        if len(self.pieces) > 1:
            self.nodes.content[-1] = "".join(self.pieces)
        self.pieces = []

    def _leaf(self, kind, name=None, content=None):
        self._cut()
        self.nodes.add(kind, len(self.spots), self.nodes.spot_of(self.nodes.name_of(name)), content)

    def _text(self, data):
        if not self.pieces:
            self.nodes.add(TEXT, len(self.spots), 1, data)
        self.pieces.append(data)

    def finish(self):
        self.close()
        if not self.names:
            self._imply(None)
        self._cut()
        self.nodes.end(self.mark, self.cut_off)

    def _open(self, tag, attrs=()):
        seen: dict[str, str] = {}
        for k, v in attrs:
            if len(seen) == self.o.max_attributes:
                self.cut_off = "too many attributes"
                break
            seen.setdefault(k, v or "")
        if len(self.names) >= self.o.max_depth:  # the innermost makes room: what follows is its sibling
            self.cut_off = "elements nested too deep"
            self._close(1)
        self._cut()
        self.nodes.owner += [len(self.nodes)] * len(seen)
        self.nodes.attributes += [(k, v, None, None) for k, v in seen.items()]
        spot = self.nodes.spot_below(self.spots[-1], self.nodes.name_of(tag))
        self.nodes.add(ELEMENT, len(self.spots), spot)
        self.spots.append(spot)
        self.names.append(tag)

    def _close(self, count: int):
        if count:
            self._cut()
            del self.names[-count:], self.spots[-count:]

    def _imply(self, tag: str | None):
        """html, head and body where they are left out."""
        if not self.names:
            self._open("html")
        if tag in HEAD and len(self.names) == 1 and not self.seen_body:
            self._open("head")
        elif tag not in HEAD and self.names[-1:] == ["head"]:
            self._close(1)
        if len(self.names) == 1 and tag not in HEAD:
            self._open("body")
            self.seen_body = True

    seen_body = False

    def _near(self, wanted, barrier) -> int:
        """How many elements to close up to the innermost of ``wanted``; 0 if a barrier comes first."""
        for k, name in enumerate(reversed(self.names)):
            if name in wanted:
                return k + 1
            if name in barrier:
                return 0
        return 0

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return self._open(tag, attrs) if not self.names else None
        if tag in ("head", "body"):
            if not self.names:
                self._open("html")
            if self.names[-1] == "head":
                self._close(1)
            if len(self.names) == 1 and not self.seen_body:
                self._open(tag, attrs)
                self.seen_body = tag == "body"
            return None
        self._imply(tag)
        if tag in CLOSES_P:
            self._close(self._near({"p"}, BARRIER))
        if tag in CLOSES:
            n = self._near(CLOSES[tag], BARRIER - CLOSES[tag])
            while n:
                self._close(n)
                n = self._near(CLOSES[tag], BARRIER - CLOSES[tag])
        self._open(tag, attrs)
        if tag in VOID:
            self._close(1)
        return None

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.names[-1:] == [tag] and tag not in ("html", "body", "head"):
            self._close(1)

    def handle_endtag(self, tag):
        if tag in ("html", "body") or tag in VOID:
            return
        if tag == "p" and "p" not in self.names:
            self._imply("p")
            self._open("p")
        self._close(self._near({tag}, {"table", "body", "html"} - {tag}))

    def handle_data(self, data):
        inside = len(self.names) > 1
        if not inside and not data.strip():
            return
        if self.names[-1:] == ["head"] or not inside:
            if not data.strip():
                return self._text(data) if inside else None
            self._imply(None)
        self._text(data)
        return None

    def handle_comment(self, data):
        self._leaf(COMMENT, content=data)

    def handle_decl(self, decl):
        if decl[:7].lower() == "doctype" and not self.names:
            name, _, rest = decl[7:].strip().partition(" ")
            self._leaf(DOCTYPE, name.lower() or None, rest.strip() or None)

    def handle_pi(self, data):
        self._leaf(COMMENT, content=f"?{data}")

    unknown_decl = handle_pi


def html_reader(nodes: Nodes, o: ParseOptions):
    """A function that appends the nodes of a page, by its id and text, to ``nodes``."""

    def parse(doc_id, text) -> None:
        b = _Builder(nodes, doc_id, o)
        text = text if isinstance(text, str) else text.decode("utf-8", "replace")
        b.feed(_AMPERSAND.sub(_as_text, text) if o.ended_references else text)
        b.finish()

    return parse


def parse_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", options: ParseOptions | None = None, columns: list[str] | None = None, paths: list[str] | None = None) -> DataFrame:
    """The node table of a column of HTML texts.  Whatever comes is a tree.

    Unclosed elements end with their parent, end tags without a start are passed over, html,
    head and body are implied, script and style hold raw text, and character references are
    resolved.  Formatting elements that cross block borders are nested as they come; they are
    not reopened.  ``columns`` and ``paths`` are those of ``parse_xml``.

    As HTML has it, ``&amp`` without its semicolon is a reference too, unless ``options`` say
    ended_references.  Of the others, max_depth (``MOST_OPEN`` without options) and max_attributes hold: an
    element that would lie deeper stands beside the innermost open one instead of in it, and
    further attributes are left out; no text is lost, and the document node's ``error`` says so.
    """
    o = options or ParseOptions(max_depth=MOST_OPEN, max_attributes=1 << 16)
    names, schema = wanted_columns(columns)
    only = None if paths is None else frozenset(paths)
    return pages.select(F.col(id_col).cast("long"), F.col(html_col)).mapInArrow(lambda it: _rows(it, o, html_reader, names, only), schema)
