"""Registration of queries and their SQL twins, and pages built from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def big(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


# ------------------------------------------------------------------ markup


def esc(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    c = F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;"))
    c = F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(c, F.lit('"'), F.lit("&quot;"))


def html(*parts: Column | str) -> Column:
    """Concatenate literal markup and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def in_pages(df: DataFrame, page: Column, order: str, item: Column, size_note: str = "") -> DataFrame:
    """``page_id, items``: the item markup of each page in order.

    ``page`` is a quotient of a unique key, so a page holds a fixed number of items.
    """
    rows = df.select(page.cast("bigint").alias("page_id"), F.col(order).alias("_o"), item.alias("_i"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("_o", "_i"))), lambda s: s["_i"])
    return rows.groupBy("page_id").agg(F.array_join(items, "\n").alias("items"))


PER_PAGE = 12


def money(c: str) -> Column:
    return F.format_string("$%.2f", F.col(c))


def card_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve customer cards a page, with navigation, filters and a pager around them."""
    cust = table(spark, sf, "customer")
    item = html(
        '<li class="card" data-id="', esc("c_custkey"), '"><a class="card-link" href="/customer/',
        esc("c_custkey"), '"><h3 class="card-title name">', esc("c_name"),
        '</h3></a><div><span class="segment">', esc(F.concat("c_mktsegment", F.lit(" & <co>"))),
        '</span>  <span class="balance"> ', esc(money("c_acctbal")), " \n</span></div></li>",
    )
    pages = in_pages(cust, F.floor(F.col("c_custkey") / PER_PAGE), "c_custkey", item)
    chain = F.floor(F.col("page_id") / CHAIN)
    last = F.floor(F.col("page_id") / CHAIN) * CHAIN + CHAIN - 1
    # The last page of a chain links back to its first, so walks meet a loop.
    nxt = F.when(F.col("page_id") == last, chain * CHAIN).otherwise(F.col("page_id") + 1)
    body = html(
        "<!DOCTYPE html><html><head><title>Customers ", F.col("page_id").cast("string"),
        "</title></head><body><header><a href='/'>Home of all customers</a></header>",
        '<div class="site-nav"><a class="nav-link">Alpha link</a><a class="nav-link">Beta link</a>',
        '<a class="nav-link">Gamma link</a><a class="nav-link">Delta link</a></div>',
        '<aside><p>Some filter text</p><p>Other filter text</p></aside><ul class="cards">',
        F.col("items"), '</ul><div id="cookie-box"><p>We use cookies here</p></div>',
        '<nav class="pager"><a class="next" rel="next" href="/list/', nxt.cast("string"),
        '">Next</a></nav><footer>Imprint and terms</footer></body></html>',
    )
    return pages.select("page_id", card_url(F.col("page_id")).alias("url"), body.alias("html"))


CHAIN = 40


def card_url(page: Column) -> Column:
    return F.concat(F.lit("https://shop.example.com/list/"), page.cast("bigint").cast("string"))


def part_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty parts a page in an HTML table with awkward headers and cells."""
    part = table(spark, sf, "part")
    item = html(
        "<tr><td>", esc("p_partkey"), "<td> ", esc("p_name"), " </td><td><b>", esc("p_brand"),
        "</b> <i>", esc("p_type"), "</i></td><td></td><td>each</td><td>", esc("p_size"),
        "</td><td>extra</td></tr>",
    )
    pages = in_pages(part, F.floor(F.col("p_partkey") / 20), "p_partkey", item)
    body = html(
        '<html><body><table class="layout"><tr><td>one</td></tr></table><table><thead><tr>',
        "<th>Key</th><th>Part</th><th>Part</th><th> </th><th>Unit</th><th>Part_2</th></tr></thead><tbody>",
        F.col("items"), "</tbody></table><ul><li>short</li></ul></body></html>",
    )
    url = F.concat(F.lit("https://shop.example.com/parts/"), F.col("page_id").cast("string"))
    return pages.select("page_id", url.alias("url"), body.alias("html"))


ORDERS_PER_PAGE = 10


def order_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Ten orders a page, each linking to its detail page; urgent ones without a link."""
    orders = table(spark, sf, "orders")
    link = F.when(
        F.col("o_orderpriority") == "1-URGENT", html("<span>no link</span>")
    ).otherwise(html('<a href="../order/', esc("o_orderkey"), '?v=1">details</a>'))
    item = html(
        '<article class="post"><h2 class="title">Order ', esc("o_orderkey"), "</h2><p>",
        esc("o_orderstatus"), "</p>", link, "</article>",
    )
    pages = in_pages(orders, F.floor(F.col("o_orderkey") / ORDERS_PER_PAGE), "o_orderkey", item)
    url = F.concat(F.lit("http://orders.example.org/all/"), F.col("page_id").cast("string"))
    return pages.select(
        "page_id", url.alias("url"), html("<body>", F.col("items"), "</body>").alias("html")
    )


def order_details(spark: SparkSession, sf: str) -> DataFrame:
    """A detail page per order; pages of pending orders were never captured."""
    orders = table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    body = html(
        '<html><body><article class="detail"><h1 class="title">Detail ', esc("o_orderkey"),
        '</h1><div class="body"><p>Priority ', esc("o_orderpriority"), '</p><p>second</p></div>',
        '<ul class="tags"><li class="tag">', esc("o_orderstatus"), '</li><li class="tag">x</li></ul>',
        '<span class="buyer" data-key="', esc("o_custkey"), '">', esc(money("o_totalprice")),
        "</span></article></body></html>",
    )
    url = F.concat(F.lit("http://orders.example.org/order/"), F.col("o_orderkey").cast("string"), F.lit("?v=1"))
    # Ids above the list pages' keep the two kinds apart.
    page_id = -F.col("o_orderkey") - 1
    return orders.select(page_id.alias("page_id"), url.alias("url"), body.alias("html"))


# ------------------------------------------------------ SQL for real pages


def unescaped(x: str) -> str:
    """The entities that occur in the captured pages, decoded."""
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
        x = f"replace({x}, '{entity}', '{char}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


# Every text in the captured pages directly follows the tag it belongs to.
TEXTS = f"""texts AS (
  SELECT page_id, ord, tag, trim(regexp_replace({unescaped("raw")}, '\\s+', ' ', 'g')) AS text,
         trim({unescaped("raw")}, E' \\n\\t\\r') AS stripped
  FROM (SELECT page_id, ord, regexp_extract(m, '^<([a-z0-9]+)', 1) AS tag,
               regexp_extract(m, '>([^<]+)$', 1) AS raw
        FROM (SELECT page_id, unnest(l) AS m, generate_subscripts(l, 1) AS ord
              FROM (SELECT page_id, regexp_extract_all(html, '<[a-z][^>]*>[^<]+') AS l FROM pages)))
  WHERE trim(raw, E' \\n\\t\\r') <> ''
)"""
LEAVES = TEXTS + """, leaves AS (
  SELECT page_id, ord, tag, CASE tag WHEN 'div' THEN 'ad' ELSE tag END AS key, text, stripped
  FROM texts WHERE tag IN ('p', 'b', 'h1', 'div'))"""
