"""HTML to rows: the one step that runs in Python.

Every page becomes a set of numbered rows. ``pre`` is the document order,
``end`` the largest ``pre`` in the subtree, so ``d`` lies below ``a`` exactly when
``a.pre < d.pre <= a.end``. Everything after this step is ordinary Spark work.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable
from html import unescape
from html.parser import HTMLParser
from itertools import chain

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import scatter

# Workers get this module with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements without content, and the groups used below.
VOID = set("area base br col embed frame hr img input link meta param source track wbr".split())
HEAD_ONLY = set("base link meta script style title".split())
HEADINGS = "h1 h2 h3 h4 h5 h6"
FONT_STYLE = "b big i s small strike tt u"
BLOCKS = (
    "address article aside blockquote center dir div dl fieldset figure footer form header "
    "hr main menu nav ol pre section table ul"
)
# Which open elements an opening tag closes, as the lenient HTML
# parser behind the original results does. Only the innermost element is looked at,
# again and again, until one stays open.
CLOSES: dict[str, set[str]] = {tag: {"p", "head"} for tag in BLOCKS.split()}
CLOSES.update({tag: {"p", "head", *HEADINGS.split()} - {tag} for tag in HEADINGS.split()})
CLOSES["p"] = {"p", "head", *HEADINGS.split(), *FONT_STYLE.split()}
CLOSES["li"] = {"li", "p", "head", "dl", "address", "pre", *HEADINGS.split()}
CLOSES["a"] = {"a", "head"}
CLOSES["body"] = {"head", "style", "script", "title"}
CLOSES["dt"] = {"dt", "dd", "p", "head"}
CLOSES["dd"] = {"dt", "dd", "p", "head"}
CLOSES["dl"] = {"p", "dt", "head"}
CLOSES["option"] = {"option"}
CLOSES["optgroup"] = {"option"}
CLOSES["table"] = {"p", "head", "pre", "a", *HEADINGS.split()}
CLOSES["caption"] = {"p"}
CLOSES["colgroup"] = {"caption", "colgroup", "col", "p"}
CLOSES["thead"] = {"caption", "col", "colgroup"}
CLOSES["tbody"] = {"th", "td", "tr", "caption", "col", "colgroup", "thead", "tfoot", "tbody", "p"}
CLOSES["tfoot"] = {"th", "td", "tr", "caption", "col", "colgroup", "thead", "tbody", "p"}
CLOSES["tr"] = {"th", "td", "tr", "caption", "col", "colgroup", "p"}
CLOSES["td"] = CLOSES["th"] = {"th", "td", "p", "span", "font", "a", "b", "i", "u"}
# An end tag never closes through an element of a higher rank.
END_RANK = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180,
            "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220}
# Text directly inside these belongs to them alone, not to the elements around them.
OWN_TEXT_ONLY = {"script", "style", "template", "rt", "rp"}

SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("pre", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("child_idx", T.IntegerType()),
        T.StructField("nth_of_type", T.IntegerType()),
        T.StructField("n_siblings", T.IntegerType()),
        T.StructField("n_same_type", T.IntegerType()),
        T.StructField("n_children", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("classes", T.ArrayType(T.StringType())),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("own", T.StringType()),
        T.StructField("own_len", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("up", T.ArrayType(T.IntegerType())),
    ]
)
_ARROW_TYPES = [
    pa.int64(), *[pa.int32()] * 9, pa.string(), pa.list_(pa.string()),
    pa.map_(pa.string(), pa.string()), pa.string(), pa.int32(), pa.string(), pa.list_(pa.int32()),
]
_ROWS_PER_BATCH = 20_000

# Text and the plain tag behind it: nothing escaped, quoted otherwise or left open in the tag.
_PLAIN = re.compile(r'([^<]*)<(/?)([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z-]+="[^"&<>]*")*)>')
_PLAIN_ATTR = re.compile(r' ([a-zA-Z-]+)="([^"]*)"')
# Elements whose content one or another version of the parser reads in a way of its own.
RAW_TEXT = set("iframe noembed noframes noscript plaintext script style textarea title xmp".split())


class _Node:
    __slots__ = ("pre", "end", "parent", "depth", "idx", "nth", "tag", "attrs", "own",
                 "own_len", "t0", "t1", "kids", "kinds", "up")

    def __init__(self, pre, parent, tag, attrs):
        self.pre, self.end, self.parent, self.tag, self.attrs = pre, pre, parent, tag, attrs
        self.depth = parent.depth + 1 if parent else 0
        self.own, self.own_len, self.up = [], 0, []
        self.t0 = self.t1 = 0
        self.kids, self.kinds = 0, {}
        self.idx = self.nth = 0
        if parent:
            parent.kids += 1
            self.idx = parent.kids
            self.nth = parent.kinds[tag] = parent.kinds.get(tag, 0) + 1


class _Tree(HTMLParser):
    """Open-element stack over the token stream; keeps nodes in document order."""

    def __init__(self, comments: bool):
        super().__init__(convert_charrefs=True)
        self.comments = comments

    def build(self, html: str) -> list[_Node]:
        self.reset()
        self.count, self.chars, self.buffer = 0, 0, []
        self.texts: list[str] = []
        self.pieces: list[tuple] = []
        self.open_rows: list[int] = []
        self.open_cells: list[int] = []
        root = _Node(0, None, "#document", {})
        self.nodes, self.stack = [root], [root]
        self.seen: dict[str, _Node] = {}
        self.feed(html)
        self.close()
        self._flush()
        while self.stack:
            self._pop()
        return self.nodes

    def goahead(self, end):
        """The parser's loop, with plain tags taken in one match each. What is left open, or text
        as in a script, goes the parser's own way from there to the end."""
        raw, i = self.rawdata, 0
        while self.cdata_elem is None:
            plain = _PLAIN.match(raw, i)
            if plain and not (plain[4] if plain[2] else plain[3].lower() in RAW_TEXT):
                text, slash, tag, named = plain.groups()
                if text:
                    self.handle_data(unescape(text) if "&" in text else text)
                if slash:
                    self.handle_endtag(tag.lower())
                else:
                    attrs = [(k.lower(), v) for k, v in _PLAIN_ATTR.findall(named)] if named else []
                    self.handle_starttag(tag.lower(), attrs)
                i = plain.end()
                continue
            at = raw.find("<", i)
            if at < 0:
                break
            if at > i:
                self.handle_data(unescape(raw[i:at]))
            i = at
            if raw[at + 1 : at + 2].isalpha() and raw[at + 1].isascii():
                ahead = self.parse_starttag(at)
            elif raw.startswith("</", at):
                ahead = self.parse_endtag(at)
            elif raw.startswith("<!--", at):
                ahead = self.parse_comment(at)
            elif raw.startswith("<!", at):
                ahead = self.parse_html_declaration(at)
            else:
                break
            if ahead < 0:
                break
            i = ahead
        self.rawdata = raw[i:]
        super().goahead(end)

    def _push(self, tag: str, attrs: dict) -> None:
        self.count += 1
        node = _Node(self.count, self.stack[-1], tag, attrs)
        node.t0 = self.chars
        self.nodes.append(node)
        self.stack.append(node)
        if tag in ("html", "head", "body"):
            self.seen[tag] = node
        elif tag == "tr":
            self.open_rows.append(node.pre)
        elif tag in ("td", "th"):
            node.up = list(self.open_rows)
            self.open_cells.append(node.pre)

    def _pop(self) -> None:
        node = self.stack.pop()
        node.end, node.t1 = self.count, self.chars
        if node.tag == "tr":
            self.open_rows.pop()
        elif node.tag in ("td", "th"):
            self.open_cells.pop()

    def _imply(self, tag: str) -> None:
        """Open the html, head or body element the markup left out."""
        if "html" not in self.seen and tag != "html":
            self._push("html", {})
        if tag in ("html", "head", "body", "frameset") or "body" in self.seen:
            return
        if tag in HEAD_ONLY:
            if "head" not in self.seen:
                self._push("head", {})
        elif self.stack[-1].tag != "head":
            self._push("body", {})

    def handle_starttag(self, tag, attrs):
        self._flush()
        named = {}
        for k, v in attrs:
            named.setdefault(k, v or "")
        if tag in self.seen:
            for k, v in named.items():
                self.seen[tag].attrs.setdefault(k, v)
            return
        while self.stack[-1].tag in CLOSES.get(tag, {"head"} if tag not in HEAD_ONLY else ()):
            self._pop()
        self._imply(tag)
        self._push(tag, named)
        if tag in VOID:
            self._pop()

    def handle_endtag(self, tag):
        self._flush()
        if tag in VOID or tag in ("html", "body"):
            return
        rank = END_RANK.get(tag, 100)
        for depth in range(len(self.stack) - 1, 0, -1):
            open_tag = self.stack[depth].tag
            if open_tag == tag:
                while len(self.stack) > depth:
                    self._pop()
                return
            if END_RANK.get(open_tag, 100) > rank:
                return

    def handle_data(self, data):
        self.buffer.append(data)

    def handle_comment(self, data):
        if self.comments:
            self.handle_data(data)
        else:
            self._flush()

    def parse_marked_section(self, i, report=1):
        # Marked sections with an unknown keyword are comments, as for a browser.
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def unknown_decl(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def _flush(self) -> None:
        """Close the current run of character data and file it as one piece."""
        if not self.buffer:
            return
        piece = "".join(self.buffer)
        self.buffer.clear()
        core = piece.strip()
        if not core:
            return
        if self.stack[-1].tag in ("#document", "html", "head"):
            while self.stack[-1].tag == "head":
                self._pop()
            if "body" not in self.seen:
                self._imply("p")
            self._push("p", {})
        self.count += 1
        top = self.stack[-1]
        top.own.append(piece)
        if top.tag not in OWN_TEXT_ONLY:
            top.own_len += len(core)
            self.chars += len(core)
            self.texts.append(core)
            if self.open_cells:
                self.pieces.append((self.count, top, core, list(self.open_cells)))


def _build(tree: _Tree, html: str | None) -> str | None:
    """Parse a page into ``tree``; what went wrong, if anything did."""
    try:
        tree.build(html or "")
    except Exception as exc:  # noqa: BLE001 - no page may end a job
        return f"{type(exc).__name__}: {exc}"
    return None


def subtree_text(node: _Node, full: str) -> str:
    """The text of an element and all below it; ``full`` is the page's."""
    if node.tag in OWN_TEXT_ONLY:
        return "".join(p.strip() for p in node.own)
    return full[node.t0 : node.t1]


def _page_rows(tree: _Tree, page_id, url, text_for, ancestors, keep=None) -> Iterable[tuple]:
    nodes = tree.nodes
    if url is not None:
        nodes[0].attrs["url"] = url
    full = "".join(tree.texts) if text_for else ""
    tags, classes_wanted = text_for if text_for and text_for != "all" else ((), ())
    for n in nodes:
        classes = n.attrs["class"].split() if "class" in n.attrs else []
        if keep and n.pre and not (n.tag in keep[0] or n.attrs.get("id") in keep[2] or not keep[1].isdisjoint(classes)):
            continue
        text = None
        if text_for and (text_for == "all" or n.tag in tags or not classes_wanted.isdisjoint(classes)):
            text = subtree_text(n, full)
        p, up = n.parent, n.up
        if ancestors:
            up = []
            while p is not None and p.parent is not None and len(up) < ancestors:
                up.append(p.pre)
                p = p.parent
            p = n.parent
        yield (page_id, n.pre, n.end, p.pre if p else None, n.depth, n.idx, n.nth,
               p.kids if p else 0, p.kinds[n.tag] if p else 0, n.kids, n.tag, classes,
               list(n.attrs.items()), "".join(n.own) if n.own else None, n.own_len, text, up)


def _piece_rows(tree: _Tree, page_id) -> Iterable[tuple]:
    for pre, parent, core, cells in tree.pieces:
        yield (page_id, pre, pre, parent.pre, parent.depth + 1, 0, 0, 0, 0, 0, None, None,
               None, core, len(core), None, cells)


def shred(
    pages: DataFrame,
    *,
    text_for: str | tuple[Iterable[str], Iterable[str]] | None = None,
    keep: tuple[Iterable[str], Iterable[str], Iterable[str]] | None = None,
    cell_pieces: bool = False,
    ancestors: int = 0,
    include_comments: bool = False,
) -> DataFrame:
    """Element rows of every page in ``pages(page_id, html)``.

    A ``#document`` row with ``pre = 0`` stands for the page itself and carries its
    ``url``, where ``pages`` has one, among its attributes. ``own`` is the
    text directly inside an element, ``own_len`` its length with each piece stripped.
    The options say what else the caller will read, so that nothing more crosses
    into Spark:

    text_for
        ``(tags, classes)`` of the elements whose subtree text goes to ``text``, or
        ``"all"``.
    keep
        ``(tags, classes, ids)``: no other elements get a row. Numbers and texts stay those
        of the whole page.
    cell_pieces
        add a row (``tag`` NULL) per text piece inside table cells; its ``up`` lists
        the enclosing cells. The ``up`` of a cell lists the enclosing rows.
    ancestors
        fill ``up`` with that many ancestors, nearest first, instead.

    A page that cannot be parsed has no rows here; ``failures`` lists it.
    """
    if text_for and text_for != "all":
        text_for = (frozenset(text_for[0]), frozenset(text_for[1]))
    if keep:
        keep = tuple(map(frozenset, keep))

    def to_rows(batches):
        tree = _Tree(include_comments)
        rows: list[tuple] = []

        def batch():
            columns = zip(*rows) if rows else [[] for _ in _ARROW_TYPES]
            arrays = [pa.array(c, t) for c, t in zip(columns, _ARROW_TYPES)]
            return pa.RecordBatch.from_arrays(arrays, SCHEMA.fieldNames())

        for incoming in batches:
            ids, htmls = incoming.column(0), incoming.column(1)
            urls = incoming.column(2) if incoming.num_columns > 2 else None
            for i in range(incoming.num_rows):
                page_id, url = ids[i].as_py(), urls[i].as_py() if urls else None
                if _build(tree, htmls[i].as_py()) is not None:
                    continue
                found = _page_rows(tree, page_id, url, text_for, ancestors, keep)
                for row in chain(found, _piece_rows(tree, page_id) if cell_pieces else ()):
                    rows.append(row)
                    if len(rows) >= _ROWS_PER_BATCH:
                        yield batch()
                        rows.clear()
        if rows:
            yield batch()

    columns = ["page_id", "html", *(["url"] if "url" in pages.columns else [])]
    return scatter(pages.select(*columns)).mapInArrow(to_rows, SCHEMA)


def failures(pages: DataFrame) -> DataFrame:
    """``page_id, error`` of the pages ``shred`` gives no rows for. Parses them anew."""

    def to_errors(batches):
        tree = _Tree(False)
        for incoming in batches:
            found = [(i, _build(tree, html.as_py())) for i, html in zip(incoming.column(0), incoming.column(1))]
            found = [(i.as_py(), error) for i, error in found if error is not None]
            ids, errors = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(errors, pa.string())], ["page_id", "error"])

    return scatter(pages.select("page_id", "html")).mapInArrow(to_errors, "page_id bigint, error string")
