"""CSS selectors as Spark plans.

A simple selector is a predicate on one element row. Combinators are windows over
the rows that satisfy any part of the selectors at hand, so only those rows are
shuffled, once, on ``page_id``, and no page is ever joined with itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shred import shred
from .dom import in_order, so_far

_IDENT = r"-?(?:[A-Za-z_\u0080-\uffff]|\\[0-9a-fA-F]{1,6}\s?|\\[^\n])(?:[\w\u0080-\uffff-]|\\[0-9a-fA-F]{1,6}\s?|\\[^\n])*"
_TOKEN = re.compile(
    rf"""(?P<tag>\*|{_IDENT})
    |\#(?P<id>{_IDENT})
    |\.(?P<cls>{_IDENT})
    |\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~|^$*!]?=)\s*
        (?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*(?P<flag>[iIsS])?\s*)?\]
    |:(?P<pseudo>[\w-]+)(?:\((?P<arg>[^()]*(?:\([^()]*\)[^()]*)*)\))?""",
    re.X,
)
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
_ATTR_SUFFIX = re.compile(r"(?s)(.*)@([A-Za-z_-][A-Za-z0-9_-]*)")


class SelectorError(ValueError):
    """A selector outside the supported grammar; raised before any job runs."""


@dataclass(frozen=True)
class Step:
    combinator: str
    source: str  # the text of the simple selectors, unique per predicate


@dataclass(frozen=True)
class Field:
    """One output column: its selector, and the attribute to read instead of text."""

    name: str
    selector: str
    attribute: str | None = None


def split_spec(spec: str) -> tuple[str, str | None]:
    """``a.next@href`` -> ``("a.next", "href")``; no trailing name leaves it whole."""
    m = _ATTR_SUFFIX.fullmatch(spec)
    if m and m[1].strip():
        return m[1].strip(), m[2]
    return spec, None


def fields_of(selectors: dict[str, str], attribute: str | None = None) -> list[Field]:
    if not selectors:
        raise SelectorError("no selectors given")
    out = []
    for name, spec in selectors.items():
        sel, attr = split_spec(spec)
        parse(sel)
        out.append(Field(name, sel, attr or attribute))
    return out


def parse(selector: str) -> list[list[Step]]:
    """Alternatives of a selector list, each a chain of steps from left to right."""
    return [_parse_chain(part.strip(), selector) for part in _split_commas(selector)]


def _split_commas(selector: str) -> list[str]:
    parts = re.findall(r"""(?:\\.|"[^"]*"|'[^']*'|\[[^\]]*\]|\([^)]*\)|[^,])+""", selector)
    if any(not p.strip() for p in parts) or not parts or ",".join(parts) != selector:
        raise SelectorError(f"bad selector {selector!r}")
    return parts


def _parse_chain(chain: str, whole: str) -> list[Step]:
    steps, pos, combinator, start = [], 0, "", 0
    while pos < len(chain):
        m = _TOKEN.match(chain, pos)
        if m:
            if m["tag"] and pos != start:
                raise SelectorError(f"bad selector {whole!r}")
            pos = m.end()
            continue
        c = _COMBINATOR.match(chain, pos)
        if not c or pos == start:
            raise SelectorError(f"bad selector {whole!r}")
        steps.append(Step(combinator, chain[start:pos]))
        combinator, pos = c[1] or " ", c.end()
        start = pos
    if start == len(chain):
        raise SelectorError(f"bad selector {whole!r}")
    steps.append(Step(combinator, chain[start:pos]))
    for step in steps:
        tests_of(step.source, whole)
    return steps


def _unescape(ident: str) -> str:
    ident = re.sub(r"\\([0-9a-fA-F]{1,6})\s?", lambda m: chr(int(m[1], 16)), ident)
    return re.sub(r"\\(.)", r"\1", ident)


def tests_of(source: str, whole: str | None = None) -> list[tuple]:
    """A run of simple selectors such as ``li.card[data-id]`` as data, one tuple per test.

    ``(kind, ...)`` with the kinds ``tag``, ``id``, ``class``, ``attr`` (name, operator,
    value, ignore case), ``nth`` (of type, from the end, a, b), ``only`` (of type),
    ``empty``, ``root``, and ``any`` and ``none`` with lists of such runs.
    """
    whole = whole or source
    out: list[tuple] = []
    for m in _TOKEN.finditer(source):
        if m["tag"]:
            if m["tag"] != "*":
                out.append(("tag", _unescape(m["tag"]).lower()))
        elif m["id"]:
            out.append(("id", _unescape(m["id"])))
        elif m["cls"]:
            out.append(("class", _unescape(m["cls"])))
        elif m["attr"]:
            want = next((v for v in (m["dq"], m["sq"], m["bare"]) if v is not None), None)
            out.append(("attr", m["attr"].lower(), m["op"], want, (m["flag"] or "").lower() == "i"))
        else:
            out.append(_pseudo(m["pseudo"].lower(), m["arg"], whole))
    return out


_FIRST = {"first-child": ("nth", False, False), "last-child": ("nth", False, True),
          "first-of-type": ("nth", True, False), "last-of-type": ("nth", True, True)}
_NTH = {"nth-child": (False, False), "nth-last-child": (False, True),
        "nth-of-type": (True, False), "nth-last-of-type": (True, True)}
_PLAIN = {"only-child": ("only", False), "only-of-type": ("only", True), "empty": ("empty",), "root": ("root",)}
_NESTED = {"not": "none", "is": "any", "where": "any"}


def _pseudo(name: str, arg: str | None, whole: str) -> tuple:
    if arg is None and name in _FIRST:
        return (*_FIRST[name], 0, 1)
    if arg is None and name in _PLAIN:
        return _PLAIN[name]
    if name in _NTH:
        return ("nth", *_NTH[name], *_nth(arg, whole))
    if name in _NESTED and arg and arg.strip():
        parts = [p.strip() for p in _split_commas(arg)]
        if all(_only_simple(p) for p in parts):
            return (_NESTED[name], [tests_of(p, whole) for p in parts])
    raise SelectorError(f"unsupported selector {whole!r}")


def _nth(arg: str | None, whole: str) -> tuple[int, int]:
    arg = (arg or "").replace(" ", "").lower()
    arg = {"odd": "2n+1", "even": "2n"}.get(arg, arg)
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", arg)
    if not arg or not m:
        raise SelectorError(f"bad selector {whole!r}")
    a = 0 if m[1] is None else int(m[1] + "1" if m[1] in ("", "+", "-") else m[1])
    return a, int(m[2] or 0)


def predicate(source: str, whole: str | None = None) -> Column:
    """The row test for a run of simple selectors."""
    return _holds(tests_of(source, whole))


def _holds(tests: list[tuple]) -> Column:
    met = [F.col("pre") > 0, F.col("tag").isNotNull(), *map(_test, tests)]
    return F.coalesce(reduce(lambda a, b: a & b, met), F.lit(False))


def _test(test: tuple) -> Column:
    kind, *of = test
    if kind == "tag":
        return F.col("tag") == of[0]
    if kind == "id":
        return _attr("id") == of[0]
    if kind == "class":
        return F.array_contains("classes", of[0])
    if kind == "attr":
        return _attr_test(*of)
    if kind == "nth":
        of_type, from_end, a, b = of
        at, many = (F.col("nth_of_type"), F.col("n_same_type")) if of_type else (F.col("child_idx"), F.col("n_siblings"))
        position = many - at + 1 if from_end else at
        return position == b if a == 0 else ((position - b) % a == 0) & ((position - b) / a >= 0)
    if kind == "only":
        return F.col("n_same_type" if of[0] else "n_siblings") == 1
    if kind == "empty":
        return (F.col("n_children") == 0) & F.col("own").isNull()
    if kind == "root":
        return F.col("parent") == 0
    found = reduce(lambda a, b: a | b, map(_holds, of[0]))
    return ~found if kind == "none" else found


def _attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name.lower()))


def _attr_test(name: str, op: str | None, want: str | None, fold: bool) -> Column:
    value = _attr(name)
    if not op:
        return value.isNotNull()
    if fold:
        value, want = F.lower(value), want.lower()
    if op == "=":
        return value == want
    if op == "!=":
        return F.coalesce(value != want, F.lit(True))
    if op == "~=":
        hit = F.array_contains(F.split(value, r"\s+"), want)
        return hit if want and not re.search(r"\s", want) else F.lit(False)
    if op == "|=":
        return (value == want) | value.startswith(want + "-")
    if not want:
        return F.lit(False)
    return {"^=": value.startswith, "$=": value.endswith, "*=": value.contains}[op](want)


def _only_simple(source: str) -> bool:
    pos = 0
    while pos < len(source):
        m = _TOKEN.match(source, pos)
        if not m:
            return False
        pos = m.end()
    return True


def text_hint(fields: list[Field]):
    """Which elements need subtree text: tags and classes of the last steps."""
    tags, classes = set(), set()
    for f in fields:
        if f.attribute:
            continue
        for chain in parse(f.selector):
            m = _TOKEN.match(chain[-1].source)
            cls = next((t["cls"] for t in _TOKEN.finditer(chain[-1].source) if t["cls"]), None)
            if m["tag"] and m["tag"] != "*":
                tags.add(_unescape(m["tag"]).lower())
            elif cls:
                classes.add(_unescape(cls))
            else:
                return "all"
    return (tags, classes) if tags or classes else None


def anchors(selectors: Iterable[str]):
    """``(tags, classes, ids)`` one of which every element has that meets a step of the
    selectors; None if some step asks for none of them."""
    found = {"tag": set(), "class": set(), "id": set()}
    for source in {step.source for s in selectors for chain in parse(s) for step in chain}:
        first = next((t for t in reversed(tests_of(source)) if t[0] in found), None)
        if first is None:
            return None
        found[first[0]].add(first[1])
    return tuple(found.values())


def _value(field: Field) -> Column:
    if not field.attribute:
        return F.coalesce("text", F.lit(""))
    raw = F.coalesce(_attr(field.attribute), F.lit(""))
    if field.attribute.lower() in ("class", "rel", "rev", "headers", "accesskey"):
        return text.normalise(raw)
    return raw


def match(dom: DataFrame, selectors: dict[str, str], values: dict[str, Column] | None = None) -> DataFrame:
    """Rows satisfying any of ``selectors``, with one boolean column per name.

    ``values`` are read from the element rows before anything is shuffled. The
    ``#document`` row of each page stays, with every flag false.
    """
    chains = {name: parse(sel) for name, sel in selectors.items()}
    sources: dict[str, str] = {}
    for alternatives in chains.values():
        for step in (s for chain in alternatives for s in chain):
            sources.setdefault(step.source, f"_t{len(sources)}")
    # The tests met go into one array per row: a filter over many named booleans makes
    # the optimizer derive constraints for every combination of them.
    rows = dom.select(
        "page_id", "pre", "end", "parent", "child_idx",
        _numbers_of([predicate(src) for src in sources]).alias("_met"),
        *[v.alias(k) for k, v in (values or {}).items()],
    )
    rows = rows.where((F.size("_met") > 0) | (F.col("pre") == 0))
    flags = [F.array_contains("_met", i).alias(flag) for i, flag in enumerate(sources.values())]
    rows = rows.select("page_id", "pre", "end", "parent", "child_idx", *flags, *(values or {}))

    reached: dict[tuple[Step, ...], str] = {}
    for alternatives in chains.values():
        for chain in alternatives:
            for n in range(1, len(chain) + 1):
                prefix = tuple(chain[:n])
                if prefix in reached:
                    continue
                flag = sources[chain[n - 1].source]
                if n > 1:
                    out = f"_s{len(reached)}"
                    rows = _combine(rows, chain[n - 1].combinator, reached[prefix[:-1]], flag, out)
                    flag = out
                reached[prefix] = flag
    hits = {
        name: reduce(lambda a, b: a | b, [F.col(reached[tuple(c)]) for c in alternatives])
        for name, alternatives in chains.items()
    }
    rows = rows.select("page_id", "pre", "end", _numbers_of(list(hits.values())).alias("_hit"), *(values or {}))
    rows = rows.where((F.size("_hit") > 0) | (F.col("pre") == 0))
    named = [F.array_contains("_hit", i).alias(name) for i, name in enumerate(hits)]
    return rows.select("page_id", "pre", "end", *named, *(values or {}))


def _numbers_of(tests: list[Column]) -> Column:
    """The positions of the tests that hold."""
    return F.array_compact(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)]))


def _combine(rows: DataFrame, combinator: str, left: str, right: str, out: str) -> DataFrame:
    """Add ``out``: ``right`` holds here and ``left`` on the related element."""
    if combinator == " ":
        reach = F.max(F.when(F.col(left), F.col("end"))).over(
            in_order().rowsBetween(Window.unboundedPreceding, -1)
        )
        return rows.withColumn(out, F.col(right) & F.coalesce(reach >= F.col("pre"), F.lit(False)))
    if combinator == ">":
        # Each row meets its parent's row in the parent's family.
        families = rows.withColumn(
            "_family", F.explode(F.when(F.col(left), F.array("pre", "parent")).otherwise(F.array("parent")))
        )
        is_parent = F.col("_family") == F.col("pre")
        hit = F.max(is_parent).over(Window.partitionBy("page_id", "_family"))
        return (
            families.withColumn(out, F.col(right) & hit)
            .where(~is_parent | F.col("parent").isNull())
            .drop("_family")
        )
    siblings = Window.partitionBy("page_id", "parent").orderBy("child_idx")
    frame = (
        siblings.rangeBetween(-1, -1)
        if combinator == "+"
        else siblings.rowsBetween(Window.unboundedPreceding, -1)
    )
    hit = F.coalesce(F.max(F.col(left)).over(frame), F.lit(False))
    return rows.withColumn(out, F.col(right) & hit)


def select(pages: DataFrame, selector: str) -> DataFrame:
    """``page_id, pre`` of every element a selector matches."""
    hits = match(shred(pages, keep=anchors([selector])), {"hit": selector})
    return hits.where("hit").select("page_id", "pre")


def _fields_on(pages: DataFrame, fields: list[Field], extra: dict[str, str] | None = None) -> DataFrame:
    selectors = {f"_m{i}": f.selector for i, f in enumerate(fields)} | (extra or {})
    dom = shred(pages, text_for=text_hint(fields), keep=anchors(selectors.values()))
    values = {f"_v{i}": _value(f) for i, f in enumerate(fields)}
    values["_url"] = F.when(F.col("pre") == 0, _attr("url"))
    return match(dom, selectors, values)


def extract_flat(pages: DataFrame, selectors: dict[str, str], attribute: str | None = None) -> DataFrame:
    """Cells ``page_id, row_idx, col, col_ord, value``; columns may differ in length."""
    fields = fields_of(selectors, attribute)
    hits = _fields_on(pages, fields).where("pre > 0")
    cells = F.array(
        *[
            F.struct(
                F.col(f"_m{i}").alias("hit"),
                F.lit(f.name).alias("col"),
                F.lit(i).alias("col_ord"),
                F.col(f"_v{i}").alias("value"),
            )
            for i, f in enumerate(fields)
        ]
    )
    long = hits.select("page_id", "pre", F.inline(cells)).where("hit")
    row_idx = F.row_number().over(Window.partitionBy("page_id", "col").orderBy("pre")) - 1
    return long.select("page_id", row_idx.alias("row_idx"), "col", "col_ord", "value")


def extract_rows(
    pages: DataFrame,
    row_selector: str,
    selectors: dict[str, str],
    attribute: str | None = None,
    with_url: bool = False,
) -> DataFrame:
    """One row per ``row_selector`` match: ``page_id, row_idx``, the fields, its ``url``.

    The first match of a field inside a row is the next match after the row's start
    in document order, provided it lies before the row's end.
    """
    fields = fields_of(selectors, attribute)
    hits = _fields_on(pages, fields, {"_row": row_selector})
    following = {
        f"_n{i}": F.expr(
            f"lead(if(_m{i}, struct(pre, _v{i} as value), null)) ignore nulls "
            "over (partition by page_id order by pre)"
        )
        for i in range(len(fields))
    }
    url = [F.max("_url").over(so_far()).alias("url")] if with_url else []
    hits = hits.select("page_id", "pre", "end", "_row", *[c.alias(n) for n, c in following.items()], *url)
    inside = [
        F.coalesce(F.when(F.col(f"_n{i}.pre") <= F.col("end"), F.col(f"_n{i}.value")), F.lit("")).alias(f.name)
        for i, f in enumerate(fields)
    ]
    return hits.where("_row").select(
        "page_id", (F.row_number().over(in_order()) - 1).alias("row_idx"), *inside, *(["url"] if with_url else [])
    )


def extract_one(
    pages: DataFrame,
    selectors: dict[str, str],
    attribute: str | None = None,
    row_selector: str | None = None,
    with_url: bool = False,
) -> DataFrame:
    """One row per page with the first match of every field, ``''`` for none.

    With ``row_selector`` the fields of the first matching row are taken.
    """
    fields = fields_of(selectors, attribute)
    extra = {"_row": row_selector} if row_selector else None
    hits = _fields_on(pages, fields, extra)
    if row_selector:
        # Only what lies below the first row counts; it is known once it has begun.
        row = F.min(F.when(F.col("_row"), F.struct("pre", "end"))).over(so_far())
        hits = hits.withColumn("_open", row)
        below = (F.col("pre") > F.col("_open.pre")) & (F.col("pre") <= F.col("_open.end"))
        inside = {f"_m{i}": F.col(f"_m{i}") & F.coalesce(below, F.lit(False)) for i in range(len(fields))}
        hits = hits.withColumns(inside)
    firsts = [
        F.coalesce(
            F.min(F.when(F.col(f"_m{i}"), F.struct("pre", F.col(f"_v{i}").alias("value"))))["value"],
            F.lit(""),
        ).alias(f.name)
        for i, f in enumerate(fields)
    ]
    if with_url:
        firsts.append(F.max("_url").alias("url"))
    return hits.groupBy("page_id").agg(*firsts)
