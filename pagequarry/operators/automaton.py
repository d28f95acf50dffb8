"""Many selectors in one pass: an automaton over the elements of a page in document order.

The chains of all selectors share their beginnings, each beginning is a state, and the
states that an element reaches are the bits of one number. What an element may reach
follows from its ancestors, its parent and the siblings before it, so every open element
carries four such numbers and no element is looked at twice. Tests are found by tag,
class or id, and run only where a state waits for them: the work grows with the matches,
not with the number of selectors, and neither does the plan.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import scatter
from ..sources import shred
from .selectors import Field, parse, tests_of

# Workers get this module with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Attributes that hold lists of words, read with single spaces.
WORD_LISTS = ("class", "rel", "rev", "headers", "accesskey")
_SPACES = re.compile(r"[ \t\n\x0b\f\r]+")
_ROWS_PER_BATCH = 20_000


def _attr_met(value: str | None, op: str | None, want: str | None, fold: bool) -> bool:
    if op == "!=" and value is None:
        return True
    if value is None or not op:
        return value is not None
    if fold:
        value, want = value.lower(), want.lower()
    if op in ("=", "!="):
        return (value == want) == (op == "=")
    if op == "|=":
        return value == want or value.startswith(want + "-")
    if not want:
        return False
    if op == "~=":
        return not _SPACES.search(want) and want in _SPACES.split(value)
    return {"^=": value.startswith, "$=": value.endswith, "*=": value.__contains__}[op](want)


def _met(node, tests: list[tuple]) -> bool:
    """Whether an element of the tree meets all the tests of ``tests_of``."""
    return all(_one_met(node, kind, of) for kind, *of in tests)


def _one_met(node, kind: str, of: list) -> bool:
    if kind == "tag":
        return node.tag == of[0]
    if kind == "id":
        return node.attrs.get("id") == of[0]
    if kind == "class":
        return of[0] in node.attrs.get("class", "").split()
    if kind == "attr":
        return _attr_met(node.attrs.get(of[0]), *of[1:])
    if kind == "nth":
        of_type, from_end, a, b = of
        at = node.nth if of_type else node.idx
        if from_end:
            at = (node.parent.kinds[node.tag] if of_type else node.parent.kids) - at + 1
        return at == b if a == 0 else (at - b) % a == 0 and (at - b) // a >= 0
    if kind == "only":
        return (node.parent.kinds[node.tag] if of[0] else node.parent.kids) == 1
    if kind == "empty":
        return not node.kids and not node.own
    if kind == "root":
        return node.parent.pre == 0
    return any(_met(node, tests) for tests in of[0]) == (kind == "any")


def _bits(number: int) -> Iterator[int]:
    while number:
        low = number & -number
        yield low.bit_length() - 1
        number ^= low


class Automaton:
    """States shared by the chains of ``selectors``; a selector is known by its place."""

    def __init__(self, selectors: list[str]):
        self.tests: list[list[tuple]] = []
        #: For each test, the states whose last step it is.
        self.wait: list[int] = []
        #: Tests by what they ask first: a class, an id, a tag, or nothing.
        self.by_class, self.by_id, self.by_tag = defaultdict(list), defaultdict(list), defaultdict(list)
        self.others: list[int] = []
        #: For each state, those that may follow below, as a child, right after, anywhere after.
        self.next: list[dict[str, int]] = []
        self.first = self.final = self.inner = 0
        self.found: dict[int, list[int]] = defaultdict(list)
        #: For each selector, all the states of its chains.
        self.states: list[int] = []
        numbers: dict[str, int] = {}
        known: dict[tuple, int] = {}
        for place, selector in enumerate(selectors):
            own = 0
            for chain in parse(selector):
                before, prefix = None, ()
                for step in chain:
                    prefix += (step,)
                    if prefix not in known:
                        known[prefix] = state = len(self.next)
                        self.next.append(dict.fromkeys(" >+~", 0))
                        if step.source not in numbers:
                            numbers[step.source] = self._add_test(step.source)
                        self.wait[numbers[step.source]] |= 1 << state
                        if before is None:
                            self.first |= 1 << state
                        else:
                            self.next[before][step.combinator] |= 1 << state
                            self.inner |= 1 << before
                    before = known[prefix]
                    own |= 1 << before
                self.final |= 1 << before
                if place not in self.found[before]:
                    self.found[before].append(place)
            self.states.append(own)

    def _add_test(self, source: str) -> int:
        number, tests = len(self.tests), tests_of(source)
        self.tests.append(tests)
        self.wait.append(0)
        first = {kind: of[0] for kind, *of in reversed(tests) if of}
        for kind, index in (("class", self.by_class), ("id", self.by_id), ("tag", self.by_tag)):
            if kind in first:
                index[first[kind]].append(number)
                return number
        self.others.append(number)
        return number

    def mask(self, places) -> int:
        """The states that these selectors need."""
        out = 0
        for place in places:
            out |= self.states[place]
        return out

    def _candidates(self, node) -> Iterator[int]:
        yield from self.by_tag.get(node.tag, ())
        if "class" in node.attrs:
            for name in set(node.attrs["class"].split()):
                yield from self.by_class.get(name, ())
        if "id" in node.attrs:
            yield from self.by_id.get(node.attrs["id"], ())
        yield from self.others

    def run(self, nodes: list, mask: int) -> Iterator[tuple[object, int]]:
        """``(element, selector)`` of every match of the masked states' selectors, in document order."""
        # below, as a child, right after the last child, after any child
        carried = {0: [0, 0, 0, 0]}
        for node in nodes:
            if node.parent is None:
                continue
            around = carried[node.parent.pre]
            allowed = (self.first | around[0] | around[1] | around[2] | around[3]) & mask
            reached = 0
            for number in self._candidates(node):
                waiting = self.wait[number] & allowed
                if waiting and _met(node, self.tests[number]):
                    reached |= waiting
            hits = {place for state in _bits(reached & self.final) for place in self.found[state]}
            for place in sorted(hits):
                yield node, place
            below = child = after = later = 0
            for state in _bits(reached & self.inner):
                follow = self.next[state]
                below, child = below | follow[" "], child | follow[">"]
                after, later = after | follow["+"], later | follow["~"]
            around[2] = after
            around[3] |= later
            if node.kids:
                carried[node.pre] = [around[0] | below, child, 0, 0]


def _page_batches(batches, columns: list[tuple[str, pa.DataType]], of_page) -> Iterator[pa.RecordBatch]:
    """Rows of ``of_page(tree, nodes, page's other columns)`` for every page that can be parsed."""
    tree = shred._Tree(False)
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        arrays = [pa.array(c, t) for c, (_, t) in zip(zip(*rows), columns)]
        return pa.RecordBatch.from_arrays(arrays, [n for n, _ in columns])

    for incoming in batches:
        for values in zip(*incoming.columns):
            html, *others = (v.as_py() for v in values)
            if shred._build(tree, html) is not None:
                continue
            for row in of_page(tree, tree.nodes, *others):
                rows.append(row)
                if len(rows) >= _ROWS_PER_BATCH:
                    yield batch()
                    rows.clear()
    if rows:
        yield batch()


def match_many(pages: DataFrame, selectors: list[str]) -> DataFrame:
    """``page_id, pre, selector`` of every match of any of ``selectors``, by its place in the list."""
    automaton = Automaton(selectors)
    every = automaton.mask(range(len(selectors)))
    columns = [("page_id", pa.int64()), ("pre", pa.int32()), ("selector", pa.int32())]

    def of_page(tree, nodes, page_id):
        return ((page_id, node.pre, place) for node, place in automaton.run(nodes, every))

    found = scatter(pages.select("html", "page_id"))
    return found.mapInArrow(lambda b: _page_batches(b, columns, of_page), "page_id long, pre int, selector int")


def first_values(pages: DataFrame, fields: dict[str, list[Field]], group: str) -> DataFrame:
    """``page_id, group, col, value``: the first match of each field of the page's group.

    ``fields`` lists the fields by the values of the column ``group``; a field without a
    match has ``''``, as does one whose attribute is missing. Pages without a group, or of
    a group not listed, give nothing and are not parsed.
    """
    selectors = sorted({f.selector for own in fields.values() for f in own})
    place_of = {s: k for k, s in enumerate(selectors)}
    automaton = Automaton(selectors)
    masks = {name: automaton.mask({place_of[f.selector] for f in own}) for name, own in fields.items()}
    columns = [("page_id", pa.int64()), (group, pa.string()), ("col", pa.string()), ("value", pa.string()), ("words", pa.bool_())]

    def of_page(tree, nodes, page_id, name):
        own = fields[name]
        wanted = {place_of[f.selector] for f in own}
        first: dict[int, object] = {}
        for node, place in automaton.run(nodes, masks[name]):
            if first.setdefault(place, node) is node and len(first) == len(wanted):
                break
        full = "".join(tree.texts)
        for f in own:
            node, value = first.get(place_of[f.selector]), ""
            if node is not None:
                value = node.attrs.get(f.attribute.lower(), "") if f.attribute else shred.subtree_text(node, full)
            yield page_id, name, f.name, value, (f.attribute or "").lower() in WORD_LISTS

    listed = pages.where(F.col(group).isNotNull()).select("html", "page_id", group)
    schema = f"page_id long, `{group}` string, col string, value string, words boolean"
    found = scatter(listed).mapInArrow(lambda b: _page_batches(b, columns, of_page), schema)
    value = F.when(F.col("words"), text.normalise(F.col("value"))).otherwise(F.col("value"))
    return found.select("page_id", group, "col", value.alias("value"))
