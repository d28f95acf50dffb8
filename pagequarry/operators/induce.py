"""Selectors from example elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import semi_join, stage
from ..sources.shred import shred
from . import selectors as css
from .dom import by_page

# How long paths may get, and how many classes name a path part.
FIELD_PATH, NODE_PATH, NODE_CLASSES = 9, 7, 3


def css_escape(c: Column) -> Column:
    """An identifier as CSS writes it."""
    safe = F.regexp_replace(c, r"([^A-Za-z0-9_\-\x{80}-\x{10FFFF}])", r"\\$1")
    return F.regexp_replace(safe, r"^(-?)([0-9])", r"$1\\3$2 ")


def _class_part(classes: Column) -> Column:
    return F.array_join(F.transform(classes, lambda c: F.concat(F.lit("."), css_escape(c))), "")


def class_selector(classes: Column | None = None) -> Column:
    return F.concat(F.col("tag"), _class_part(F.col("classes") if classes is None else classes))


def path_part(max_classes: int | None = None) -> Column:
    """Tag and classes, or the place among like siblings when there are no classes."""
    classes = F.col("classes") if max_classes is None else F.slice("classes", 1, max_classes)
    nth = F.when(
        F.col("n_same_type") > 1,
        F.concat(F.lit(":nth-of-type("), F.col("nth_of_type").cast("string"), F.lit(")")),
    ).otherwise(F.lit(""))
    return F.when(F.size("classes") > 0, class_selector(classes)).otherwise(F.concat("tag", nth))


def _group():
    return Window.partitionBy("page_id", "parent", "tag", "class_sig")


def _nodes(pages: DataFrame, ancestors: int, picked: DataFrame | None = None) -> DataFrame:
    """The elements of ``pages``; with ``picked`` ``(page_id, pre)`` also whether they are among these, ``_picked``."""
    attr = lambda a: F.try_element_at("attrs", F.lit(a))
    nodes = shred(pages, ancestors=ancestors).where("pre > 0").select(
        "page_id", "pre", "end", "depth", "parent", "tag", "classes", "n_children", "up",
        F.array_join(F.array_sort("classes"), ".").alias("class_sig"),
        class_selector().alias("selector"),
        path_part().alias("part"),
        path_part(NODE_CLASSES).alias("node_part"),
        F.coalesce(attr("id"), F.lit("")).alias("id"),
        F.coalesce(attr("aria-label"), F.lit("")).alias("aria"),
    )
    if picked is None:
        nodes = by_page(nodes)
    else:
        # Picks travel as rows of their page, so that all that follows shares its exchange.
        picks = picked.select("page_id", "pre", F.lit(True).alias("_picked"))
        nodes = by_page(nodes.withColumn("_picked", F.lit(False)).unionByName(picks, allowMissingColumns=True))
        at = Window.partitionBy("page_id", "pre")
        nodes = nodes.withColumn("_picked", F.max("_picked").over(at)).where("tag is not null")
    return nodes.withColumn("n_same", F.count("*").over(_group()))


def _lines(nodes: DataFrame, picked: Column, info: list[str]) -> DataFrame:
    """One row per picked node and each element on its line up, ``lvl`` 0 being itself.

    Every node files its facts under its own number; picked nodes also ask for the
    facts of the numbers above them. One window brings both together.
    """
    above = F.transform(F.concat(F.array("pre"), "up"), lambda a, i: F.struct(a.alias("node"), i.alias("lvl")))
    asked = F.when(picked, above).otherwise(F.array().cast("array<struct<node:int,lvl:int>>"))
    own = F.array(F.struct(F.col("pre").alias("node"), F.lit(-1).alias("lvl")))
    rows = nodes.select("page_id", F.col("pre").alias("target"), *info, F.inline(F.concat(own, asked)))
    facts = F.max(F.when(F.col("lvl") < 0, F.struct(*info))).over(Window.partitionBy("page_id", "node"))
    return rows.withColumn("f", facts).where("lvl >= 0").select("page_id", "target", "node", "lvl", "f.*")


def _lines_by_sweep(nodes: DataFrame, info: list[str], useful: Column) -> DataFrame:
    """``_lines`` up to the root, for few picked nodes of trees of any depth.

    Every element opens at ``pre`` and closes at ``end``. A running count of the picked
    nodes at both places says which of them lie inside, so an element costs two rows
    however deep it lies, and a pair is made only of a picked node and an element above
    it that is ``useful`` or among the nearest ``FIELD_PATH``.
    """
    sides = F.array(*[F.struct(F.col(c).alias("at"), F.lit(side).alias("side")) for side, c in enumerate(("pre", "end"))])
    opens = F.col("_picked") & (F.col("side") == 0)
    order = Window.partitionBy("page_id").orderBy("at", "side", "pre").rowsBetween(Window.unboundedPreceding, 0)
    swept = nodes.withColumn("_useful", useful).select("page_id", "pre", "depth", "_picked", "_useful", *info, F.inline(sides))
    swept = swept.withColumn("_n", F.count(F.when(opens, 1)).over(order))
    facts = F.max(F.when(F.col("side") == 0, F.struct("depth", "_picked", "_useful", *info)))
    spans = swept.groupBy("page_id", "pre").agg(F.min("_n").alias("_first"), F.max("_n").alias("_last"), facts.alias("f"))
    spans = stage(spans, "spans")  # both sides of the join below read them
    # a picked node's own number is the count at its opening, which holds itself
    first = F.col("_first") + F.when(F.col("f._picked"), 0).otherwise(1)
    above = spans.where(F.col("_last") >= first).select(
        "page_id", F.col("pre").alias("node"), "f", F.explode(F.sequence(first, F.col("_last"))).alias("_k")
    )
    asked = spans.where("f._picked").select("page_id", F.col("_first").alias("_k"), F.col("pre").alias("target"), F.col("f.depth").alias("_deep"))
    lines = above.join(asked, ["page_id", "_k"]).withColumn("lvl", F.col("_deep") - F.col("f.depth"))
    lines = lines.where(F.col("f._useful") | (F.col("lvl") < FIELD_PATH))
    return lines.select("page_id", "target", "node", "lvl", *[F.col(f"f.{c}").alias(c) for c in info])


def induce(pages: DataFrame, examples: DataFrame) -> DataFrame:
    """Row and field selectors for example elements ``examples(page_id, pre)``.

    The row is the nearest element, from the example up, that has a class and a
    sibling of the same tag and classes. The field path leads from the row down.
    Examples without such a row are left out.
    """
    # Written once: they are counted, sent out and joined. Only pages with an example are parsed.
    wanted = stage(examples.select("page_id", "pre").distinct(), "examples")
    pages = semi_join(pages, wanted, "page_id")
    nodes = _nodes(pages, ancestors=0, picked=wanted)
    info = ["tag", "classes", "class_sig", "selector", "part", "aria", "n_same"]
    is_row = ~F.col("tag").isin("html", "body") & (F.col("class_sig") != "") & (F.col("n_same") >= 2)
    lines = by_page(_lines_by_sweep(nodes, info, is_row), "target")
    line = Window.partitionBy("page_id", "target")
    lines = lines.withColumn("row_lvl", F.min(F.when(is_row, F.col("lvl"))).over(line)).where(
        F.col("lvl") <= F.col("row_lvl")
    )
    at_row = F.col("lvl") == F.col("row_lvl")
    label = (
        F.when(F.col("aria") != "", text.slug(F.col("aria")))
        .when(F.size("classes") > 0, text.slug(F.col("classes")[0]))
        .otherwise(F.col("tag"))
    )
    path = F.expr(
        f"listagg(if(lvl < row_lvl and lvl < {FIELD_PATH}, part, null), ' > ') within group (order by lvl desc)"
    )
    return lines.groupBy("page_id", F.col("target").alias("pre")).agg(
        F.max(F.when(at_row, F.col("node"))).alias("row_pre"),
        F.max(F.when(at_row, F.col("selector"))).alias("row_selector"),
        F.max(F.when(at_row, F.col("n_same"))).alias("n_rows"),
        F.coalesce(path, F.lit("")).alias("field_selector"),
        F.max(F.when(F.col("lvl") == 0, label)).alias("label"),
    )


def node_selectors(pages: DataFrame, picked: Column | None = None) -> DataFrame:
    """A selector for each element: its id, else its path below the body."""
    lines = _lines(
        _nodes(pages, ancestors=NODE_PATH - 1),
        F.lit(True) if picked is None else picked,
        ["tag", "id", "node_part"],
    )
    at_body = Window.partitionBy("page_id", "target")
    lines = lines.withColumn("_stop", F.min(F.when(F.col("tag") == "body", F.col("lvl"))).over(at_body))
    path = F.expr(
        "listagg(if(_stop is null or lvl < _stop, node_part, null), ' > ') within group (order by lvl desc)"
    )
    own_id = F.max(F.when((F.col("lvl") == 0) & (F.col("id") != ""), F.col("id")))
    return lines.groupBy("page_id", F.col("target").alias("pre")).agg(
        F.when(own_id.isNotNull(), F.concat(F.lit("#"), css_escape(own_id)))
        .otherwise(F.coalesce(path, F.lit("")))
        .alias("selector")
    )


def _row_nodes(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """The elements of the pages of ``rows(page_id, row_pre)``, these ``_picked``. Other pages are not parsed."""
    picked = stage(rows.select("page_id", F.col("row_pre").alias("pre")).distinct(), "rows")
    return _nodes(semi_join(pages, picked, "page_id"), ancestors=0, picked=picked)


def _filed(*sides: Column) -> Column:
    """An element once for each of the ``sides(node, side)`` that is not NULL: under which number, and as what.

    Elements meet where they are filed under one number of a page, by windows over the
    exchange the nodes have had: nodes are far too many to be sent to every task, though
    a written table of their numbers takes few bytes and would be taken for a small one.
    """
    return F.inline(F.array_compact(F.array(*sides)))


def _side(node: str, side: str, when: Column | None = None) -> Column:
    filed = F.struct(F.col(node).alias("node"), F.lit(side).alias("side"))
    return filed if when is None else F.when(when, filed)


def _at_node():
    return Window.partitionBy("page_id", "node")


def broaden(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """One level up from ``rows(page_id, row_pre)`` where the parent repeats too."""
    repeats = (F.col("parent") > 0) & (F.col("n_same") >= 2)
    sides = _filed(_side("parent", "row", F.col("_picked")), _side("pre", "self", repeats))
    met = _row_nodes(pages, rows).select("page_id", "pre", "selector", "n_same", sides)
    wider = F.when(F.col("side") == "self", F.struct(F.col("selector").alias("row_selector"), F.col("n_same").alias("n_rows")))
    return (
        met.withColumn("_wider", F.collect_list(wider).over(_at_node()))
        .where("side = 'row'")
        .select("page_id", F.col("pre").alias("row_pre"), F.col("node").cast("int").alias("new_row_pre"), F.inline("_wider"))
    )


def narrow(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """One level down where each row of the set holds exactly one element.

    The element inside the row at hand must have a class; the new rows are the
    elements inside all of them, the first standing for the set.
    """
    nodes = _row_nodes(pages, rows).withColumn("single", F.min(F.col("n_children") == 1).over(_group())).withColumn(
        "first", F.min("pre").over(_group())
    )
    sides = _filed(
        _side("parent", "inner"),
        _side("pre", "first", F.col("single") & (F.col("pre") == F.col("first"))),
        _side("pre", "row", F.col("single") & F.col("_picked")),
    )
    met = nodes.select("page_id", "pre", "selector", "class_sig", "n_same", "first", sides)
    is_inner, is_row = F.col("side") == "inner", F.col("side") == "row"
    met = met.withColumns({
        "_classed": F.max(is_inner & (F.col("class_sig") != "")).over(_at_node()),
        "_heads": F.max(F.col("side") == "first").over(_at_node()),
    }).where(is_row & F.col("_classed") | is_inner & F.col("_heads"))
    # Rows that hold a class go on to the first of their set, whose inner element names the new rows.
    met = met.withColumn("node", F.when(is_row, F.col("first")).otherwise(F.col("node")))
    inner = F.when(is_inner, F.struct(F.col("pre").cast("int").alias("new_row_pre"), F.col("selector").alias("row_selector")))
    return (
        met.withColumn("_inner", F.collect_list(inner).over(_at_node()))
        .where(is_row)
        .select("page_id", F.col("pre").alias("row_pre"), F.inline("_inner"), F.col("n_same").alias("n_rows"))
    )


def pick(pages: DataFrame, examples: DataFrame, sample: int = 5) -> dict:
    """A preset from examples on one page: row selector, fields, samples, row count.

    The examples of one user on one page are few; only their selectors and ``sample``
    rows reach the driver.
    """
    page = pages.join(examples.select("page_id").distinct(), "page_id", "left_semi")
    found = induce(page, examples).orderBy("pre").collect()
    if not found:
        return {"row_selector": None, "selectors": {}, "samples": {}, "row_count": 0}
    row_selector = found[0]["row_selector"]
    same = [r for r in found if r["row_selector"] == row_selector and r["field_selector"]]
    names = text.suffixed([r["label"] for r in same])
    picked = {n: r["field_selector"] for n, r in zip(names, same)}
    rows = css.extract_rows(page, row_selector, picked) if picked else None
    head = rows.orderBy("page_id", "row_idx").limit(sample).collect() if picked else []
    return {
        "row_selector": row_selector,
        "selectors": picked,
        "samples": {n: [r[n] for r in head] for n in names},
        "row_count": rows.count() if picked else 0,
    }
