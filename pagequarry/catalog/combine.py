"""Queries D: joining the output of several pages."""

from pyspark.sql import functions as F

from ..operators import cells as long
from ..operators import follow, paginate, selectors
from ..operators.heuristic import HeuristicSpec, heuristic_cells
from .base import (
    CHAIN, ORDERS_PER_PAGE, PER_PAGE, big, card_pages, card_url, html, order_details, order_lists,
    query, table,
)
from .extract import _LINKS, _TABLE_COLS, LEAVES, part_tables


@query(
    "d1_aligned_union",
    f"""SELECT 0 AS step, c_custkey // {PER_PAGE} AS page_id, c_custkey % {PER_PAGE} AS row_idx, c_name AS name,
          printf('$%.2f', c_acctbal) AS balance, '' AS href FROM customer
        UNION ALL SELECT 1, c_custkey // {PER_PAGE}, c_custkey % {PER_PAGE}, c_name, '', '/customer/' || c_custkey
        FROM customer""",
)
def d1(spark, sf):
    pages = card_pages(spark, sf)
    first = selectors.extract_rows(pages, "li.card", {"name": "h3", "balance": ".balance"})
    second = selectors.extract_rows(pages, "li.card", {"href": "a@href", "name": ".name"})
    both = long.align([first, second])
    return both.select(big("step"), "page_id", big("row_idx"), "name", "balance", "href")


@query(
    "d1_positional_concat",
    f"""WITH {_LINKS}, {LEAVES}, cells AS (
          SELECT page_id, row_idx AS o, 'link' AS col, value FROM links
          UNION ALL SELECT page_id, ord, 'bold', stripped FROM leaves WHERE key = 'b')
        SELECT col, row_number() OVER (PARTITION BY col ORDER BY page_id, o) - 1 AS pos, value, page_id FROM cells""",
)
def d1_positional(spark, sf):
    flat = selectors.extract_flat(table(spark, sf, "pages"), {"link": "nav a@href", "bold": "article b"})
    return long.positional_concat(flat).select("col", big("pos"), "value", "page_id")


@query(
    "d2_cells_records",
    f"""WITH {_LINKS}, {LEAVES}, b AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS r,
              stripped FROM leaves WHERE key = 'b'),
          filled AS (SELECT coalesce(l.page_id, b.page_id) AS page_id, coalesce(l.row_idx, b.r) AS row_idx,
                     coalesce(l.value, '') AS link, coalesce(b.stripped, '') AS bold
                   FROM links l FULL OUTER JOIN b ON l.page_id = b.page_id AND l.row_idx = b.r)
        SELECT page_id, row_idx, 'link' AS col, link AS value FROM filled
        UNION ALL SELECT page_id, row_idx, 'bold', bold FROM filled""",
)
def d2(spark, sf):
    flat = selectors.extract_flat(table(spark, sf, "pages"), {"link": "nav a@href", "bold": "article b"})
    wide = long.to_wide(flat, ["link", "bold"])
    return long.to_cells(wide, ["link", "bold"]).select("page_id", big("row_idx"), "col", "value")


_PAGE = f"c_custkey // {PER_PAGE}"
_NEXT_KINDS = ["rel", "link", "text", "label", "class", "none"]


def _pagers(spark, sf):
    """Card pages whose way onward takes a different form on every page."""
    pages = card_pages(spark, sf)
    pid = F.col("page_id").cast("string")
    forms = [
        html('<nav><a rel="next nofollow" href="/r/', pid, '">on</a></nav>'),
        html('<a rel="next" href="/a/x">a</a><link rel="next" href="../l/', pid, '">'),
        html('<a href="/t/', pid, '#x"> <b>Next</b> </a>'),
        html('<a aria-label="Next Page" href="?p=', pid, '">o</a>'),
        html('<a class="btn-next" href="//cdn.example.org/', pid, '">o</a>'),
        html('<a href="/prev/', pid, '">next one</a><link rel="next">'),
    ]
    pick = F.element_at(F.array(*forms), (F.col("page_id") % len(forms) + 1).cast("int"))
    markup = F.regexp_replace("html", '(?s)<nav class="pager">.*?</nav>', "\u0001")
    return pages.select("page_id", "url", F.replace(markup, F.lit("\u0001"), pick).alias("html"))


@query(
    "d4_next_link",
    f"""SELECT page_id, CASE page_id % 6
            WHEN 0 THEN 'https://shop.example.com/r/' || page_id
            WHEN 1 THEN 'https://shop.example.com/l/' || page_id
            WHEN 2 THEN 'https://shop.example.com/t/' || page_id || '#x'
            WHEN 3 THEN 'https://shop.example.com/list/' || page_id || '?p=' || page_id
            WHEN 4 THEN 'https://cdn.example.org/' || page_id END AS next_url
        FROM (SELECT DISTINCT {_PAGE} AS page_id FROM customer) WHERE page_id % 6 <> 5""",
)
def d4(spark, sf):
    return paginate.next_links(_pagers(spark, sf)).select("page_id", "next_url")


def _starts(spark, sf):
    firsts = table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / PER_PAGE).alias("p"))
    return firsts.where(F.col("p") % CHAIN == 0).select(card_url(F.col("p")).alias("url")).distinct()


_WALK = f"""SELECT 'https://shop.example.com/list/' || p // {CHAIN} * {CHAIN} AS start, p % {CHAIN} AS depth, p AS page_id
            FROM (SELECT DISTINCT {_PAGE} AS p FROM customer)"""


@query("d5_walk", _WALK)
def d5(spark, sf):
    reached = paginate.walk_pages(card_pages(spark, sf), _starts(spark, sf))
    return reached.select("start", big("depth"), "page_id")


@query(
    "d6_paginated_extract",
    f"""SELECT w.start, w.depth, c_custkey % {PER_PAGE} AS row_idx, c_name AS name, printf('$%.2f', c_acctbal) AS balance
        FROM ({_WALK}) w JOIN customer ON {_PAGE} = w.page_id WHERE w.depth < 10""",
)
def d6(spark, sf):
    fields = {"name": "h3", "balance": "span.balance"}
    rows = paginate.extract_paginated(
        card_pages(spark, sf), _starts(spark, sf), "ul.cards > li", fields, max_pages=10, next_selector="a.next"
    )
    return rows.select("start", big("depth"), big("row_idx"), *fields)


@query(
    "d7_follow_urls",
    f"""WITH {_LINKS} SELECT l.page_id, l.row_idx, CASE WHEN l.value LIKE '/%'
          THEN regexp_extract(p.url, '^[a-z]+://[^/?#]+', 0) || l.value END AS target,
          'https://mirror.example.org/x' || l.value AS prefixed
        FROM links l JOIN pages p ON p.page_id = l.page_id""",
)
def d7(spark, sf):
    pages = table(spark, sf, "pages")
    links = selectors.extract_flat(pages, {"link": "nav a@href"}).join(pages.select("page_id", "url"), "page_id")
    plain = follow.with_targets(links, "value")
    glued = follow.urls.resolve_follow(F.col("value"), F.col("url"), "https://mirror.example.org/x/")
    return plain.select("page_id", big("row_idx"), "target", glued.alias("prefixed"))


_LIST_FIELDS = {"title": "h2.title", "status": "p", "link": "a@href"}
_DETAIL_FIELDS = {"title": "h1.title", "first": "div.body > p", "tag": "li.tag", "total": ".buyer", "buyer": ".buyer@data-key"}


def _order_rows(spark, sf):
    return selectors.extract_rows(order_lists(spark, sf), "article.post", _LIST_FIELDS, with_url=True)


_HIT = "o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT'"


@query(
    "d8_follow_join",
    f"""SELECT o_orderkey // {ORDERS_PER_PAGE} AS page_id, o_orderkey % {ORDERS_PER_PAGE} AS row_idx,
          CASE WHEN {_HIT} THEN 'Detail ' ELSE 'Order ' END || o_orderkey AS title, o_orderstatus AS status,
          CASE WHEN {_HIT} THEN 'Priority ' || o_orderpriority ELSE '' END AS first,
          CASE WHEN {_HIT} THEN o_orderstatus ELSE '' END AS tag,
          CASE WHEN {_HIT} THEN printf('$%.2f', o_totalprice) ELSE '' END AS total,
          CASE WHEN {_HIT} THEN o_custkey::VARCHAR ELSE '' END AS buyer FROM orders""",
)
def d8(spark, sf):
    joined = follow.follow(_order_rows(spark, sf), order_details(spark, sf), "link", _DETAIL_FIELDS)
    return joined.select("page_id", big("row_idx"), "title", "status", "first", "tag", "total", "buyer")


@query(
    "d9_follow_misses",
    """SELECT 'http://orders.example.org/order/' || o_orderkey || '?v=1' AS target, 1 AS n_rows FROM orders
       WHERE o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT'""",
)
def d9(spark, sf):
    return follow.misses(_order_rows(spark, sf), order_details(spark, sf), "link")


@query(
    "d10_follow_first_row",
    f"""SELECT o_orderkey // {ORDERS_PER_PAGE} AS page_id, o_orderkey % {ORDERS_PER_PAGE} AS row_idx,
          CASE WHEN {_HIT} THEN o_orderstatus ELSE '' END AS tag FROM orders""",
)
def d10(spark, sf):
    # Each tag list is a row set; the first tag of the detail page counts.
    joined = follow.follow(
        _order_rows(spark, sf), order_details(spark, sf), "link", {"tag": "li"}, row_selector="ul.tags"
    )
    return joined.select("page_id", big("row_idx"), "tag")


@query(
    "d11_step_union",
    f"""SELECT 0 AS step, p_partkey // 20 AS page_id, p_partkey % 20 AS row_idx, p_partkey::VARCHAR AS "Key",
          trim(p_name) AS "Part", '' AS name FROM part
        UNION ALL SELECT 1, c_custkey // {PER_PAGE}, c_custkey % {PER_PAGE}, '', '', c_name FROM customer""",
)
def d11(spark, sf):
    found = heuristic_cells(part_tables(spark, sf), HeuristicSpec(threshold=1))
    by_table = long.to_wide(found, _TABLE_COLS[:2])
    by_card = selectors.extract_rows(card_pages(spark, sf), "li.card", {"name": "h3"})
    both = long.align([by_table, by_card])
    return both.select(big("step"), "page_id", big("row_idx"), "Key", "Part", "name")
