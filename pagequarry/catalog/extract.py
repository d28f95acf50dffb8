"""Queries B and C: node tables and extraction."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import cells as long
from ..operators import dom, heuristic, selectors
from ..operators.heuristic import HeuristicSpec
from ..session import stage
from ..sources.shred import shred
from .base import (
    LEAVES, PER_PAGE, TEXTS, big, card_pages, html, part_tables, query, table, unescaped,
)

# ------------------------------------------------------------------- nodes


@query(
    "b1_tag_counts",
    """SELECT page_id, tag, count(*) AS n FROM (
         SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages)
       GROUP BY page_id, tag""",
)
def b1(spark, sf):
    nodes = shred(table(spark, sf, "pages")).where("pre > 0")
    return nodes.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(
    "b2_body_scope",
    """SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(
         regexp_extract(html, '(?s)<body>.*', 0), '<[a-z]')) AS t FROM pages) GROUP BY page_id""",
)
def b2(spark, sf):
    # The body itself is the scope and not one of its own elements.
    nodes = dom.in_scope(shred(table(spark, sf, "pages"))).groupBy("page_id").agg(F.count("*").alias("n"))
    return nodes.select("page_id", (F.col("n") + 1).alias("n"))


@query(
    "b3_strip_structural",
    """SELECT page_id, tag, count(*) AS n FROM (
         SELECT page_id, unnest(regexp_extract_all(regexp_replace(html,
           '(?s)^.*<body>|<nav>.*</nav>|<footer>.*$', '', 'g'), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages)
       GROUP BY page_id, tag""",
)
def b3(spark, sf):
    nodes = dom.narrow(shred(table(spark, sf, "pages")), dom.is_noise(keywords=()))
    live = dom.alive(dom.in_scope(nodes))
    return live.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


_CARD_LEAVES = f"""SELECT c_custkey // {PER_PAGE} AS page_id, key, value, count(*) AS n FROM (
  SELECT c_custkey, 'card-title' AS key, c_name AS value FROM customer
  UNION ALL SELECT c_custkey, 'segment', c_mktsegment || ' & <co>' FROM customer
  UNION ALL SELECT c_custkey, 'balance', printf('$%.2f', c_acctbal) FROM customer)
  GROUP BY ALL"""


@query("b4_strip_keywords", _CARD_LEAVES)
def b4(spark, sf):
    leaves = dom.leaf_text(shred(card_pages(spark, sf)))
    return leaves.groupBy("page_id", "key", F.col("text").alias("value")).agg(F.count("*").alias("n"))


@query(
    "b5_leaf_text",
    f"""WITH {LEAVES} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS nth, key, text
        FROM leaves""",
)
def b5(spark, sf):
    leaves = dom.leaf_text(shred(table(spark, sf, "pages")))
    nth = F.row_number().over(dom.in_order())
    return leaves.select("page_id", nth.cast("bigint").alias("nth"), "key", "text")


@query(
    "b6_subtree_text",
    f"""WITH {TEXTS} SELECT page_id, string_agg(stripped, '' ORDER BY ord) AS text FROM texts
        WHERE tag IN ('h1', 'p', 'b') GROUP BY page_id""",
)
def b6(spark, sf):
    nodes = shred(table(spark, sf, "pages"), text_for=({"article"}, ()))
    return nodes.where("tag = 'article'").select("page_id", "text")


@query(
    "b7_field_keys",
    f"""SELECT key, count(*) AS n FROM (
         SELECT unnest(['card-title', 'segment', 'balance', 'card', 'card-link', 'div']) AS key FROM customer
         UNION ALL SELECT 'cards' FROM (SELECT DISTINCT c_custkey // {PER_PAGE} FROM customer)) GROUP BY key""",
)
def b7(spark, sf):
    nodes = dom.narrow(shred(card_pages(spark, sf)))
    live = dom.alive(dom.in_scope(nodes))
    return live.groupBy("key").agg(F.count("*").alias("n"))


@query(
    "b8_normalise",
    """SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents""",
)
def b8(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalise(F.col("text")).alias("text"))


# --------------------------------------------------------------- heuristic

_TABLE = """SELECT p_partkey // 20 AS page_id, p_partkey % 20 AS row_idx, p_partkey::VARCHAR AS "Key",
  trim(p_name) AS "Part", p_brand || ' ' || p_type AS "Part_2", p_size::VARCHAR AS "Part_2_2" FROM part"""
_TABLE_COLS = ["Key", "Part", "Part_2", "Part_2_2"]
SMALL = HeuristicSpec(threshold=5)


@query("c1_table_extract", _TABLE)
def c1(spark, sf):
    found = heuristic.post_clean(heuristic.table_cells(part_tables(spark, sf), SMALL))
    wide = long.to_wide(found, _TABLE_COLS)
    return wide.select("page_id", big("row_idx"), *_TABLE_COLS)


@query(
    "c2_header_dedupe",
    """SELECT h.c AS col, h.o AS col_ord, count(*) AS n FROM part,
         (SELECT unnest(['Key', 'Part', 'Part_2', 'Unit', 'Part_2_2']) AS c, unnest([0, 1, 2, 4, 5]) AS o) h
       GROUP BY ALL""",
)
def c2(spark, sf):
    found = heuristic.table_cells(part_tables(spark, sf), SMALL).where("col is not null")
    return found.groupBy("col", big("col_ord")).agg(F.count("*").alias("n"))


def _headless(spark, sf):
    """Tables without header cells: the first row names the columns and stays a row."""
    part = part_tables(spark, sf)
    bare = F.regexp_replace("html", "(?s)<thead>.*</thead>", "")
    return part.select("page_id", "url", bare.alias("html"))


@query(
    "c3_body_cells",
    """WITH h AS (SELECT p_partkey // 20 AS page_id, p_partkey::VARCHAR AS k, trim(p_name) AS n,
                         p_brand || ' ' || p_type AS b, p_size::VARCHAR AS s FROM part WHERE p_partkey % 20 = 0),
            c AS (SELECT p_partkey // 20 AS page_id, p_partkey % 20 AS row_idx, unnest([0, 1, 2, 4, 5, 6]) AS i,
                         unnest([p_partkey::VARCHAR, trim(p_name), p_brand || ' ' || p_type, 'each',
                                 p_size::VARCHAR, 'extra']) AS value FROM part),
            d AS (SELECT c.page_id, c.row_idx, c.value, c.i, CASE i WHEN 0 THEN k WHEN 1 THEN n WHEN 2 THEN b
                         WHEN 4 THEN 'each' WHEN 5 THEN CASE WHEN s = k THEN s || '_2' ELSE s END
                         ELSE 'extra' END AS col FROM c JOIN h ON c.page_id = h.page_id)
       SELECT page_id, row_idx, col, value FROM d""",
)
def c3(spark, sf):
    found = heuristic.table_cells(_headless(spark, sf), SMALL).where("col is not null")
    return found.select("page_id", big("row_idx"), "col", "value")


def _rival_pages(spark, sf):
    """Card pages with a second list of the same length and shorter text."""
    pages = card_pages(spark, sf)
    size = F.size(F.split("html", '<li class="card"')) - 1
    rival = F.concat(F.lit("<ul class='tags'>"), F.repeat(F.lit("<li class='tag'>short tag</li>"), size), F.lit("</ul>"))
    both = F.replace("html", F.lit('<ul class="cards">'), html(rival, '<ul class="cards">'))
    return pages.select("page_id", "url", both.alias("html"))


_SCORES = f"""WITH t AS (SELECT c_custkey // {PER_PAGE} AS page_id, count(*) AS n,
    avg(length(c_name) + length(c_mktsegment || ' & <co>') + length(printf('$%.2f', c_acctbal))) AS a
    FROM customer GROUP BY 1 HAVING count(*) >= 5)"""


@query(
    "c4_record_candidates",
    _SCORES + """ SELECT page_id, 'li card' AS sig, n FROM t
       UNION ALL SELECT page_id, 'li tag', n FROM t""",
)
def c4(spark, sf):
    return heuristic.record_sets(_rival_pages(spark, sf), SMALL).select("page_id", "sig", big("n"))


@query(
    "c5_record_choice",
    _SCORES + """ SELECT page_id, 'li card' AS sig, n,
       round(n * (1.0::DOUBLE + least(a, 1500.0) / 1500.0) * (0.4::DOUBLE + 0.6::DOUBLE * (n / n)), 9) AS score FROM t""",
)
def c5(spark, sf):
    sets = heuristic.record_sets(_rival_pages(spark, sf), SMALL).where("chosen")
    return sets.select("page_id", "sig", big("n"), F.round("score", 9).alias("score"))


_CARDS = f"""SELECT c_custkey // {PER_PAGE} AS page_id, c_custkey % {PER_PAGE} AS row_idx,
  c_name AS "card-title", c_mktsegment || ' & <co>' AS segment, printf('$%.2f', c_acctbal) AS balance FROM customer
  WHERE c_custkey // {PER_PAGE} IN (SELECT c_custkey // {PER_PAGE} FROM customer GROUP BY 1 HAVING count(*) >= 5)"""
_CARD_COLS = ["card-title", "segment", "balance"]


@query("c6_record_fields", _CARDS)
def c6(spark, sf):
    found = heuristic.record_or_flat_cells(card_pages(spark, sf), SMALL).where("mode = 'records'")
    wide = long.to_wide(found, _CARD_COLS)
    return wide.select("page_id", big("row_idx"), *_CARD_COLS)


def _gappy_pages(spark, sf):
    """Cards where a negative balance or a BUILDING segment is left out."""
    pages = card_pages(spark, sf)
    no_debt = F.regexp_replace("html", r'<span class="balance">\s*\$-[0-9.]+\s*</span>', "")
    no_building = F.regexp_replace(no_debt, '<span class="segment">BUILDING[^<]*</span>', "<span class='segment'> </span>")
    return pages.select("page_id", "url", no_building.alias("html"))


@query(
    "c7_record_alignment",
    f"""SELECT page_id, row_idx, "card-title", CASE WHEN segment LIKE 'BUILDING%' THEN '' ELSE segment END AS segment,
           CASE WHEN balance LIKE '$-%' THEN '' ELSE balance END AS balance FROM ({_CARDS})""",
)
def c7(spark, sf):
    found = heuristic.record_or_flat_cells(_gappy_pages(spark, sf), SMALL).where("mode = 'records'")
    wide = long.to_wide(found, _CARD_COLS)
    return wide.select("page_id", big("row_idx"), *_CARD_COLS)


_FLAT = f"""WITH {LEAVES}, ok AS (SELECT * FROM leaves WHERE length(text) BETWEEN 1 AND 4000),
  cols AS (SELECT page_id, key FROM ok GROUP BY 1, 2 HAVING count(*) >= 3 AND count(DISTINCT text) > 1
           AND count(DISTINCT text) / count(*) >= 1.0::DOUBLE - 0.85::DOUBLE)"""
FLAT = HeuristicSpec(threshold=3, prefer_records=False)


@query(
    "c8_flat_extract",
    _FLAT + """ SELECT page_id, row_number() OVER (PARTITION BY page_id, key ORDER BY ord) - 1 AS row_idx,
       key AS col, text AS value FROM ok WHERE (page_id, key) IN (SELECT (page_id, key) FROM cols)""",
)
def c8(spark, sf):
    found = heuristic.heuristic_cells(table(spark, sf, "pages"), FLAT)
    return found.select("page_id", big("row_idx"), "col", "value")


@query("c9_flat_filter", _FLAT + " SELECT key AS col, count(*) AS pages FROM cols GROUP BY key")
def c9(spark, sf):
    found = heuristic.record_or_flat_cells(table(spark, sf, "pages"), FLAT)
    return found.groupBy("col").agg(F.count_distinct("page_id").alias("pages"))


@query(
    "c10_drop_blank_cols",
    """SELECT page_id, unnest(list_concat(CASE WHEN k > 1 THEN ['Key'] ELSE [] END, list_concat(
           CASE WHEN p > 1 THEN ['Part'] ELSE [] END, list_concat(CASE WHEN b > 1 THEN ['Part_2'] ELSE [] END,
           CASE WHEN s > 1 THEN ['Part_2_2'] ELSE [] END)))) AS col, n
       FROM (SELECT p_partkey // 20 AS page_id, count(*) AS n, count(DISTINCT p_partkey) AS k, count(DISTINCT p_name) AS p,
               count(DISTINCT p_brand || p_type) AS b, count(DISTINCT p_size) AS s FROM part GROUP BY 1)""",
)
def c10(spark, sf):
    # The column under the blank header gets cells of blanks first; the cleaning takes them out,
    # and with them the columns of one value.
    found = stage(heuristic.table_cells(part_tables(spark, sf), SMALL), "cells")
    rows = found.select("page_id", "row_idx", "mode").distinct()
    blank = rows.select("page_id", "row_idx", "mode", F.lit("column").alias("col"), F.lit(3).alias("col_ord"),
                        F.when(F.col("row_idx") % 2 == 0, " ").otherwise("\t").alias("value"))
    cleaned = heuristic.post_clean(found.unionByName(blank, allowMissingColumns=True))
    return cleaned.where("col is not null").groupBy("page_id", "col").agg(F.count("*").alias("n"))


@query(
    "c11_drop_constant_cols",
    """SELECT page_id, c AS col, CASE c WHEN 'Key' THEN k WHEN 'Part' THEN p WHEN 'Part_2' THEN b
                 WHEN 'Unit' THEN 1 ELSE s END = 1 AS dropped
       FROM (SELECT p_partkey // 20 AS page_id, count(DISTINCT p_partkey) AS k, count(DISTINCT p_name) AS p,
                    count(DISTINCT p_brand || p_type) AS b, count(DISTINCT p_size) AS s FROM part GROUP BY 1),
            (SELECT unnest(['Key', 'Part', 'Part_2', 'Unit', 'Part_2_2']) AS c)""",
)
def c11(spark, sf):
    marked = heuristic.drop_uniform(heuristic.table_cells(part_tables(spark, sf), SMALL))
    return marked.where("col is not null").select("page_id", "col", F.col("_drop").alias("dropped")).distinct()


def _twin_pages(spark, sf):
    """Cards that state the name twice more, under a shorter and a longer class."""
    pages = card_pages(spark, sf)
    twice = F.regexp_replace(
        "html", '<h3 class="card-title name">([^<]*)</h3>',
        '<i class="nm">$1</i><h3 class="card-title name">$1</h3><b class="card-title-again">$1</b>',
    )
    return pages.select("page_id", "url", twice.alias("html"))


@query(
    "c12_merge_identical_cols",
    f"""SELECT page_id, row_idx, "card-title" AS "card-title-again", segment, balance FROM ({_CARDS})""",
)
def c12(spark, sf):
    found = heuristic.heuristic_cells(_twin_pages(spark, sf), SMALL)
    cols = ["card-title-again", "segment", "balance"]
    # Any other surviving name would show up as an extra column here.
    assert set(long.discover_columns(found)) == set(cols)
    return long.to_wide(found, cols).select("page_id", big("row_idx"), *cols)


@query(
    "c13_dispatch_mode",
    f"""WITH {LEAVES}, per AS (SELECT page_id, count(*) FILTER (key = 'b') AS nb,
          count(*) FILTER (key IN ('p', 'b')) AS np, count(DISTINCT text) FILTER (key = 'b') AS db,
          avg(length(stripped)) FILTER (key IN ('p', 'b')) AS a FROM leaves WHERE length(text) > 0 GROUP BY page_id),
        real AS (SELECT page_id, CASE WHEN np >= 3 AND nb >= 3 AND a >= 8
                   AND np * (1.0 + least(a, 1500) / 1500) * (0.4 + 0.6 * np / (np + 1)) - 1 > -1
                   THEN 'records' ELSE 'flat' END AS mode, db FROM per)
        SELECT page_id, mode FROM real WHERE mode = 'records' AND db > 1
        UNION ALL SELECT page_id, 'flat' FROM ({_FLAT} SELECT DISTINCT page_id FROM cols)
          WHERE page_id IN (SELECT page_id FROM real WHERE mode = 'flat')
        UNION ALL SELECT DISTINCT -1 - p_partkey // 20, 'table' FROM part""",
)
def c13(spark, sf):
    tables = part_tables(spark, sf).select((-F.col("page_id") - 1).alias("page_id"), "url", "html")
    both = table(spark, sf, "pages").select("page_id", "url", "html").unionByName(tables)
    return heuristic.heuristic_cells(both, HeuristicSpec(threshold=3)).select("page_id", "mode").distinct()


# --------------------------------------------------------------- selectors


@query(
    "c14_selector_specs",
    f"""SELECT c_custkey // {PER_PAGE} AS page_id, c_custkey::VARCHAR AS id, '/customer/' || c_custkey AS href,
          c_name AS "at" FROM customer""",
)
def c14(spark, sf):
    specs = {"id": "li@data-id", "href": "a.card-link@href", "at": 'a[href*="/customer/"]'}
    flat = selectors.extract_flat(card_pages(spark, sf), specs)
    return long.to_wide(flat, list(specs)).select("page_id", *specs)


def _css(name: str, selector: str, sql: str):
    @query(f"c15_css_{name}", sql)
    def run(spark, sf):
        hits = selectors.select(table(spark, sf, "pages"), selector)
        return hits.groupBy("page_id").agg(F.count("*").alias("n"))

    return run


def _occurrences(pattern: str, scope: str = "html") -> str:
    return f"""SELECT page_id, n FROM (SELECT page_id, len(regexp_extract_all({scope}, '{pattern}')) AS n FROM pages)
               WHERE n > 0"""


_NAV = "regexp_extract(html, '(?s)<nav>.*</nav>', 0)"
_ART = "regexp_extract(html, '(?s)<article>.*', 0)"
_css("type", "li", _occurrences("<li>"))
_css("class", "div.ad", _occurrences('<div class="ad">'))
_css("descendant", "nav a", _occurrences("<a ", _NAV))
_css("child", "article > p > b", _occurrences("<p><b>", _ART))
_css("adjacent", "h1 + p", _occurrences("</h1><p>", _ART))
_css("sibling", "h1 ~ p", _occurrences("<p>", _ART))
_css("list", "h1, li a, nav li", f"""SELECT page_id, 1 + 2 * len(regexp_extract_all(html, '<li>')) AS n FROM pages""")
_css("attribute", 'a[href^="/"][href*="e"]', _occurrences('<a href="/[^"]*e'))
_css("nth", "li:nth-child(2n+1)", """SELECT page_id, (len(regexp_extract_all(html, '<li>')) + 1) // 2 AS n FROM pages
      WHERE html LIKE '%<li>%'""")  # fmt: skip
_css("not", "body > :not(nav, footer)", "SELECT page_id, 2 AS n FROM pages")
_css("last", "li:last-child > a", """SELECT page_id, 1 AS n FROM pages WHERE html LIKE '%<li>%'""")
_css("nth_last", "nav li:nth-last-child(-n+2)", """SELECT page_id, least(2, len(regexp_extract_all(html, '<li>'))) AS n FROM pages
      WHERE html LIKE '%<li>%'""")  # fmt: skip
_css("nth_last_type", "body > :nth-last-of-type(1)", "SELECT page_id, 4 AS n FROM pages")
_css("empty", "article :empty", _occurrences("<br>", _ART))
_css("root", ":root > body", "SELECT page_id, 1 AS n FROM pages")
_css("is", "nav :is(li, a:where([href]))", "SELECT page_id, 2 * len(regexp_extract_all(html, '<li>')) AS n FROM pages")
_css("attribute_case", 'a[href^="/E" i]', _occurrences('<a href="/[eE]'))
_css("attribute_other", 'nav a[href!="/en"]', """SELECT page_id, len(regexp_extract_all(html, '<li>'))
      - len(regexp_extract_all(html, '<a href="/en"')) AS n FROM pages
      WHERE len(regexp_extract_all(html, '<li>')) > len(regexp_extract_all(html, '<a href="/en"'))""")  # fmt: skip

_LINKS = f"""links AS (SELECT page_id, i - 1 AS row_idx, {unescaped("l[i]")} AS value FROM (
  SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
    SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)))"""


@query(
    "c16_flat_selector",
    f"""WITH {_LINKS}, {LEAVES}
        SELECT page_id, row_idx, 'link' AS col, value FROM links
        UNION ALL SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1, 'bold', stripped
        FROM leaves WHERE key = 'b'""",
)
def c16(spark, sf):
    flat = selectors.extract_flat(table(spark, sf, "pages"), {"link": "nav li a@href", "bold": "article p b"})
    return flat.select("page_id", big("row_idx"), "col", "value")


@query(
    "c17_row_scoped",
    f"""SELECT c_custkey // {PER_PAGE} AS page_id, c_custkey % {PER_PAGE} AS row_idx, c_name AS name,
          CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment || ' & <co>' END AS segment,
          CASE WHEN c_acctbal < 0 THEN '' ELSE printf('$%.2f', c_acctbal) END AS balance,
          '/customer/' || c_custkey AS href FROM customer""",
)
def c17(spark, sf):
    fields = {"name": "h3.name", "segment": "ul.cards .segment", "balance": "div > span.balance", "href": "a@href"}
    rows = selectors.extract_rows(_gappy_pages(spark, sf), "li.card", fields)
    return rows.select("page_id", big("row_idx"), *fields)


@query(
    "c18_single_record",
    f"""WITH {TEXTS}, {_LINKS} SELECT p.page_id, t.stripped AS title, h.stripped AS h1, coalesce(b.v, '') AS bold,
          coalesce(l.value, '') AS link, '' AS nothing FROM pages p
        LEFT JOIN texts t ON t.page_id = p.page_id AND t.tag = 'title'
        LEFT JOIN texts h ON h.page_id = p.page_id AND h.tag = 'h1'
        LEFT JOIN (SELECT page_id, min_by(stripped, ord) AS v FROM texts WHERE tag = 'b' GROUP BY 1) b
          ON b.page_id = p.page_id
        LEFT JOIN links l ON l.page_id = p.page_id AND l.row_idx = 0""",
)
def c18(spark, sf):
    fields = {"title": "title", "h1": "article h1", "bold": "p > b", "link": "a@href", "nothing": "main p"}
    return selectors.extract_one(table(spark, sf, "pages"), fields)


@query(
    "c19_attr_value",
    f"""SELECT c_custkey // {PER_PAGE} AS page_id, c_custkey % {PER_PAGE} AS row_idx, 'card-title name' AS cls,
          c_custkey::VARCHAR AS id, '' AS none, '/customer/' || c_custkey AS dflt FROM customer""",
)
def c19(spark, sf):
    fields = {"cls": "h3@class", "id": "ul > li@data-id", "none": "li.card@title", "dflt": "li a"}
    flat = selectors.extract_flat(card_pages(spark, sf), fields, attribute="href")
    return long.to_wide(flat, list(fields)).select("page_id", big("row_idx"), *fields)
