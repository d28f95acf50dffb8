"""Queries H and I: streams, action logs, specs, jobs and induction."""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import values
from ..operators import actions, induce, paginate, sinks, versions
from ..operators import selectors as css
from ..plans import job, pipeline, registry, sites
from ..plans.spec import ExtractSpec
from ..session import scratch_path
from ..sources.pages import pages_for, read_pages
from ..sources.store import CaptureStore
from ..streaming import watch
from .base import PER_PAGE, TEXTS, big, card_pages, order_details, order_lists, query, table, unescaped
from .combine import _HIT, _WALK, _starts
from .extract import _CARDS

_TITLES = f"""WITH {TEXTS} SELECT page_id, max(CASE WHEN tag = 'title' THEN stripped END) AS title,
   max(CASE WHEN tag = 'h1' THEN stripped END) AS h1 FROM texts GROUP BY page_id"""
_FIELDS = {"title": "title", "h1": "article h1"}


def _landed(spark, sf):
    """The captured pages as a crawler would drop them: their folder, and the files of a quarter of them."""
    path = scratch_path(spark, "landing")
    table(spark, sf, "pages").repartition(4 * spark.sparkContext.defaultParallelism, "page_id").write.parquet(path)
    return path, -(-len(spark.read.parquet(path).inputFiles()) // 4)


def _streamed(spark, sf):
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "state")
    land, files = _landed(spark, sf)
    stream = watch.captures(spark, land, maxFilesPerTrigger=max(files, 1))
    watch.watch(stream, lambda p: css.extract_one(p, _FIELDS), out, state).awaitTermination()
    return out


@query("h1_stream_extract", _TITLES)
def h1(spark, sf):
    return spark.read.parquet(f"{_streamed(spark, sf)}/rows").select("page_id", "title", "h1")


@query(
    "h2_scheduled_runs",
    _TITLES,
)
def h2(spark, sf):
    # Two scheduled starts over a growing folder: the second takes only what is new.
    out, state, land = (scratch_path(spark, n) for n in ("out", "state", "land"))
    pages = table(spark, sf, "pages")
    for part in ("url like 'https:%'", "url not like 'https:%'"):
        pages.where(part).write.mode("append").parquet(land)
        stream = watch.captures(spark, land)
        watch.watch(stream, lambda p: css.extract_one(p, _FIELDS), out, state).awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("page_id", "title", "h1")


_LANDINGS = """SELECT page_id AS id, url, CASE page_id % 3 WHEN 0 THEN 12 WHEN 1 THEN 10 ELSE 11 END AS hour, 0 AS run FROM pages
  UNION ALL SELECT page_id + 10000000, url, CASE WHEN page_id % 4 = 0 THEN 13 ELSE 11 END, 1 FROM pages WHERE page_id % 2 = 0
  UNION ALL SELECT page_id + 20000000, url, CASE WHEN page_id % 5 = 0 THEN 1 ELSE 12 END, 2 FROM pages"""


@query(
    "h1_late_captures",
    f"""WITH l AS ({_LANDINGS}),
        seen AS (SELECT *, max(hour::BIGINT * 1000000000 - id) OVER (PARTITION BY url ORDER BY run RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                 AS best FROM l),
        marked AS (SELECT *, best IS NOT NULL AND hour::BIGINT * 1000000000 - id <= best AS is_late FROM seen)
        SELECT url, max_by(id, hour::BIGINT * 1000000000 - id) AS page_id, max(hour) AS hour,
               count(*) FILTER (is_late) AS late FROM marked GROUP BY url""",
)
def h1_late(spark, sf):
    # Three runs over a folder into which ever later captures of the same URLs fall.
    land, out, state = (scratch_path(spark, n) for n in ("land", "out", "state"))
    pages = table(spark, sf, "pages")
    at = lambda hour: F.timestamp_seconds(hour * 3600 + 1_700_000_000).alias("fetched_at")
    first = pages.select("page_id", "url", at(F.expr("case page_id % 3 when 0 then 12 when 1 then 10 else 11 end")))
    second = pages.where("page_id % 2 = 0").select(F.col("page_id") + 10_000_000, "url", at(F.expr("if(page_id % 4 = 0, 13, 11)")))
    third = pages.select(F.col("page_id") + 20_000_000, "url", at(F.expr("if(page_id % 5 = 0, 1, 12)")))
    for landing in (first, second, third):
        landing.toDF("page_id", "url", "fetched_at").write.mode("append").parquet(land)
        stream = watch.captures(spark, land, schema="page_id bigint, url string, fetched_at timestamp")
        watch.newest(stream, out, state).awaitTermination()
    lost = watch.late(spark, out).groupBy("url").agg(F.count("*").alias("late"))
    hour = ((F.unix_seconds("fetched_at") - 1_700_000_000) / 3600).cast("bigint").alias("hour")
    return watch.newest_now(spark, out).join(lost, "url", "left").select("url", "page_id", hour, F.coalesce("late", F.lit(0)).alias("late"))


@query("h4_run_metrics", "SELECT count(*) AS pages, count(*) AS \"rows\", 0 AS failed FROM pages")
def h4(spark, sf):
    metrics = spark.read.parquet(f"{_streamed(spark, sf)}/metrics")
    return metrics.agg(
        F.sum("pages").alias("pages"), F.sum("rows").alias("rows"), F.count("error").alias("failed")
    )


_LOG = """log AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'signup' THEN 'goto' WHEN 'error' THEN 'click'
    ELSE 'fill' END AS action, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN
    CASE WHEN value < 20 THEN 'input.q' WHEN value < 40 THEN 'input.z' END END AS selector,
    CASE WHEN event_type = 'signup' THEN CASE WHEN value < 30 THEN '/a' ELSE '/b' END END AS url FROM events)"""


@query(
    "h3_compact_actions",
    f"""WITH {_LOG}, n AS (SELECT *, lead(action) OVER w AS na, lead(selector) OVER w AS ns,
          lag(action) OVER w AS pa, lag(url) OVER w AS pu FROM log WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT event_id, action FROM n
        WHERE NOT coalesce(action = 'fill' AND na = 'fill' AND ns IS NOT DISTINCT FROM selector, false)
          AND NOT coalesce(action = 'goto' AND pa = 'goto' AND pu IS NOT DISTINCT FROM url, false)""",
)
def h3(spark, sf):
    log = table(spark, sf, "events").selectExpr(
        "event_id", "user_id", "ts",
        "case event_type when 'signup' then 'goto' when 'error' then 'click' else 'fill' end as action",
        "case when event_type in ('click', 'view', 'purchase') then case when value < 20 then 'input.q'"
        " when value < 40 then 'input.z' end end as selector",
        "case when event_type = 'signup' then if(value < 30, '/a', '/b') end as url",
    )
    return actions.compact(log, "user_id", ["ts", "event_id"]).select("event_id", "action")


# ------------------------------------------------------------ specs and jobs


@query(
    "i1_layered_specs",
    """SELECT n_nationkey AS site, CASE WHEN n_regionkey = 2 THEN 10 WHEN n_regionkey = 3 THEN 7
           ELSE n_nationkey + 20 END AS threshold,
         CASE WHEN n_regionkey IN (1, 4) THEN 'own' ELSE 'preset' END AS keep,
         'name=.' || lower(n_name) || ',price=.' || CASE WHEN n_regionkey IN (1, 4) THEN 'own' ELSE 'preset' END
           || CASE WHEN n_regionkey IN (1, 4) THEN ',extra=i' ELSE '' END AS selectors FROM nation""",
)
def i1(spark, sf):
    nation = table(spark, sf, "nation").selectExpr("cast(n_nationkey as bigint) as site", "n_name", "n_regionkey")
    # Preset layer below, job layer above; region 2 sets nothing, region 3 only a
    # preset, and a job at the default of 10 does not undo a preset.
    preset = nation.selectExpr(
        "site", "1 as layer", "case n_regionkey when 3 then 7L when 2 then null else 99L end as threshold",
        "array('preset') as keep", "map('name', concat('.', lower(n_name)), 'price', '.preset') as selectors",
    )
    jobs = nation.selectExpr(
        "site", "2 as layer", "case when n_regionkey in (2, 3) then 10L else site + 20 end as threshold",
        "if(n_regionkey in (1, 4), array('own'), array()) as keep",
        "if(n_regionkey in (1, 4), map('price', '.own', 'extra', 'i'), map()) as selectors",
    )
    out = sites.layered(preset.unionByName(jobs), "site", "layer", {"threshold": 10}, ("keep",), ("selectors",))
    order = F.transform(
        F.array(F.lit("name"), F.lit("price"), F.lit("extra")),
        lambda k: F.concat(k, F.lit("="), F.try_element_at("selectors", k)),
    )
    pairs = F.array_join(F.filter(order, lambda x: x.isNotNull()), ",")
    return out.select("site", "threshold", F.array_join("keep", ",").alias("keep"), pairs.alias("selectors"))


_SITES = {
    "example.org": {"t": "title"},
    "blog.tionsh.example.net": {"h": "h1"},
    "Example.NET": {"t": "title"},
    "com": {"h": "h1"},
}


@query(
    "i2_site_routing",
    f"""WITH {TEXTS}, h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host FROM pages),
        r AS (SELECT page_id, CASE WHEN host LIKE '%.example.net' THEN 'Example.NET'
            WHEN host LIKE '%.com' THEN 'com' WHEN host LIKE '%.example.org' THEN 'example.org' END AS site FROM h)
        SELECT r.page_id, r.site, CASE WHEN r.site = 'com' THEN 'h' ELSE 't' END AS col, stripped AS value
        FROM r JOIN texts t ON t.page_id = r.page_id AND t.tag = CASE WHEN r.site = 'com' THEN 'h1' ELSE 'title' END
        WHERE r.site IS NOT NULL""",
)
def i2(spark, sf):
    return sites.extract_by_site(table(spark, sf, "pages"), _SITES)


#: Seventy selectors a site, all different: links from the front, from the back, and after another.
_MANY = {
    "com": {f"f{k:02}": f"nav li:nth-child({k}) > a@href" for k in range(1, 71)},
    "Example.NET": {f"f{k:02}": f"nav > ul li:nth-last-child({k}) a@href" for k in range(1, 71)},
    "example.org": {f"f{k:02}": f"nav li:nth-child({k}) ~ li > a[href^='/']@href" for k in range(1, 71)},
}


@query(
    "i2_many_sites",
    f"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host,
                  regexp_extract_all(html, '<li><a href="([^"]*)"', 1) AS l FROM pages),
        r AS (SELECT *, CASE WHEN host LIKE '%.example.net' THEN 'Example.NET'
            WHEN host LIKE '%.com' THEN 'com' WHEN host LIKE '%.example.org' THEN 'example.org' END AS site FROM h)
        SELECT page_id, site, 'f' || lpad(k::VARCHAR, 2, '0') AS col, coalesce({unescaped("CASE site WHEN 'com' THEN l[k]"
            " WHEN 'Example.NET' THEN CASE WHEN len(l) >= k THEN l[len(l) - k + 1] END ELSE l[k + 1] END")}, '') AS value
        FROM r, range(1, 71) t(k) WHERE site IS NOT NULL""",
)
def i2_many(spark, sf):
    return sites.extract_by_site(table(spark, sf, "pages"), _MANY)


_JOB = {
    "name": "cards",
    "params": {"first": {"type": "int", "default": 0}, "n": {"type": "int", "required": True}, "tag": {"default": "h3"}},
    "steps": [
        {"action": "goto", "url": "https://shop.example.com/list/{{first}}"},
        {"action": "extract_paginated", "row_selector": "li.card", "next_selector": "nav a[rel=next]",
         "selectors": {"name": "a {{tag}}", "href": "a@href"}, "max_pages": "{{ n }}"},
    ],
}


@query(
    "i3_job_spec",
    f"""SELECT w.page_id, c_custkey % {PER_PAGE} AS row_idx, c_name AS customer, '/customer/' || c_custkey AS href
        FROM ({_WALK}) w JOIN customer ON c_custkey // {PER_PAGE} = w.page_id
        WHERE w.start = 'https://shop.example.com/list/0'""",
)
def i3(spark, sf):
    # The walk from page 0 ends where its chain loops, long before the limit.
    result = job.run_job(
        job.load_job(_JOB), card_pages(spark, sf), {"n": "100"}, ExtractSpec(rename_columns={"name": "customer"})
    )
    return result.table.select(F.col("__page_id").alias("page_id"), F.col("__row_idx").cast("bigint").alias("row_idx"), "customer", "href")


@query(
    "i3_pipeline",
    f"""SELECT CASE WHEN {_HIT} THEN 'Detail ' ELSE 'Order ' END || o_orderkey AS title, o_orderstatus AS status,
          o_custkey::VARCHAR AS buyer FROM orders WHERE {_HIT}""",
)
def i3_pipeline(spark, sf):
    spec = ExtractSpec(
        extractor="selector",
        row_selector="article.post",
        selectors={"title": "h2.title", "state": "p", "link": "a@href"},
        follow_field="link",
        follow_selectors={"title": "h1.title", "buyer": ".buyer@data-key"},
        drop_columns=["link"],
        rename_columns={"state": "status"},
        required_columns=["buyer"],
    )
    lists, details = order_lists(spark, sf), order_details(spark, sf)
    # Detail pages hold no post, so the whole crawl can serve as input.
    return pipeline.run(lists.unionByName(details), spec).rows()


# -------------------------------------------------------------- induction


def _examples(spark, sf):
    """Every balance and every link of the card pages, as if pointed at."""
    pages = card_pages(spark, sf)
    hits = css.select(pages, "span.balance, a.card-link, div > span.segment")
    return pages, hits


@query(
    "i4_induce_selectors",
    f"""SELECT page_id, 'li.card' AS row_selector, n AS n_rows, f AS field_selector, l AS label, n AS examples FROM
          (SELECT c_custkey // {PER_PAGE} AS page_id, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1),
          (SELECT unnest(['div > span.segment', 'div > span.balance', 'a.card-link']) AS f,
                  unnest(['segment', 'balance', 'card_link']) AS l)""",
)
def i4(spark, sf):
    pages, examples = _examples(spark, sf)
    found = induce.induce(pages, examples)
    return found.groupBy("page_id", "row_selector", big("n_rows"), "field_selector", "label").agg(
        F.count("*").alias("examples")
    )


def _nested_rows(spark, sf):
    """Card pages where each card sits alone in a box of its own class."""
    pages = card_pages(spark, sf)
    boxed = F.regexp_replace(F.regexp_replace("html", '<li class="card"', '<li class="box"><div class="card"'), "</div></li>", "</div></div></li>")
    return pages.select("page_id", "url", boxed.alias("html"))


_BIG = f"SELECT c_custkey // {PER_PAGE} AS page_id, count(*) AS n FROM customer GROUP BY 1"


@query("i5_broaden", f"SELECT page_id, 'li.box' AS row_selector, n AS n_rows, n AS from_rows FROM ({_BIG}) WHERE n > 1")
def i5(spark, sf):
    pages = _nested_rows(spark, sf)
    rows = css.select(pages, "div.card").withColumnRenamed("pre", "row_pre")
    wider = induce.broaden(pages, rows)
    return wider.groupBy("page_id", "row_selector", "n_rows").agg(F.count("*").alias("from_rows"))


@query("i5_narrow", f"SELECT page_id, 'div.card' AS row_selector, n AS n_rows, n AS from_rows FROM ({_BIG})")
def i5_narrow(spark, sf):
    pages = _nested_rows(spark, sf)
    rows = css.select(pages, "li.box").withColumnRenamed("pre", "row_pre")
    inner = induce.narrow(pages, rows)
    return inner.groupBy("page_id", "row_selector", "n_rows").agg(F.count("*").alias("from_rows"))


@query(
    "i8_absolute_selectors",
    f"""SELECT page_id, s AS selector, count(*) AS n FROM (
          SELECT c_custkey // {PER_PAGE} AS page_id, unnest(['ul.cards > li.card', 'ul.cards > li.card > a.card-link',
              'ul.cards > li.card > a.card-link > h3.card-title.name', 'ul.cards > li.card > div',
              'ul.cards > li.card > div > span.segment', 'ul.cards > li.card > div > span.balance']) AS s FROM customer
          UNION ALL SELECT page_id, unnest(['html', 'html > head', 'html > head > title', '', 'header', 'header > a',
              'div.site-nav', 'div.site-nav > a.nav-link', 'div.site-nav > a.nav-link', 'div.site-nav > a.nav-link',
              'div.site-nav > a.nav-link', 'aside', 'aside > p:nth-of-type(1)', 'aside > p:nth-of-type(2)', 'ul.cards',
              '#cookie-box', 'div:nth-of-type(2) > p', 'nav.pager', 'nav.pager > a.next', 'footer']) FROM ({_BIG}))
        GROUP BY 1, 2""",
)
def i8(spark, sf):
    all_paths = induce.node_selectors(card_pages(spark, sf))
    return all_paths.groupBy("page_id", "selector").agg(F.count("*").alias("n"))


@query(
    "entry_links_per_host",
    """SELECT host, count(*) AS n_links FROM (
         SELECT regexp_extract(url, '://([^/?#:]+)', 1) AS host, unnest(regexp_extract_all(html, '<a href="')) AS a
         FROM pages) GROUP BY host""",
)
def entry_links(spark, sf):
    from ..functions import urls

    pages = table(spark, sf, "pages")
    links = css.extract_flat(pages, {"link": "nav li a@href"}).join(pages.select("page_id", "url"), "page_id")
    target = urls.resolve_follow(F.col("value"), F.col("url"))
    return links.groupBy(urls.host(target).alias("host")).agg(F.count("*").alias("n_links"))


@query(
    "h1_failed_batch_retried",
    "SELECT page_id, page_id % 2 = 1 AS retried FROM pages",
)
def h1_failed(spark, sf):
    # Every batch with an odd page fails; its pages are kept for the retry.
    out, state, land = (scratch_path(spark, n) for n in ("out", "state", "land"))
    for odd in (0, 1):
        table(spark, sf, "pages").where(f"page_id % 2 = {odd}").write.mode("append").parquet(land)
        stream = watch.captures(spark, land)
        taken = lambda p, odd=odd: p.select("page_id", F.assert_true(F.lit(odd == 0)).alias("ok"))
        watch.watch(stream, taken, out, state, fail_fast=False).awaitTermination()
    good = spark.read.parquet(f"{out}/rows").select("page_id", F.lit(False).alias("retried"))
    return good.union(watch.retries(spark, out).select("page_id", F.lit(True)))


_BAD = ["'<![ if x]>' || html", "'<![1x]><![]><![foo[' || '>' || html", "html || '<b'", "NULL", "''"]


@query(
    "b1_bad_pages",
    """SELECT page_id, count(*) AS n FROM (
         SELECT page_id, unnest(regexp_extract_all(html, '<a href="')) AS a FROM pages WHERE page_id % 6 NOT IN (3, 4))
       GROUP BY 1""",
)
def b1_bad(spark, sf):
    # Broken declarations, cut-off tags, NULL and empty pages among the good ones.
    cases = " ".join(f"WHEN {i} THEN {form}" for i, form in enumerate(_BAD))
    pages = table(spark, sf, "pages").selectExpr("page_id", "url", f"CASE page_id % 6 {cases} ELSE html END AS html")
    links = css.extract_flat(pages, {"link": "nav li a@href"})
    return links.groupBy("page_id").agg(F.count("*").alias("n"))


@query(
    "d8_follow_url_field",
    """SELECT o_orderkey::VARCHAR AS target, 'Order ' || o_orderkey AS url, 'Order ' || o_orderkey AS "Url_2",
              CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE 'details' END AS "U.S. $" FROM orders""",
)
def d8_url_field(spark, sf):
    # Fields named like internal columns, in two cases, and with a dot, through the flow.
    spec = ExtractSpec(
        extractor="selector", row_selector="article.post",
        selectors={"url": "h2", "Url": "h2", "target": "h2", "U.S. $": "a"},
    )
    rows = pipeline.run(order_lists(spark, sf), spec).rows()
    return rows.withColumn("target", F.regexp_replace("target", "Order ", ""))


@query(
    "d2_odd_names",
    f"""SELECT c_custkey // {PER_PAGE} AS p, 'NAME' AS col, c_name AS value FROM customer
        UNION ALL SELECT c_custkey // {PER_PAGE}, 'name_2', printf('$%.2f', c_acctbal) FROM customer
        UNION ALL SELECT c_custkey // {PER_PAGE}, 'a.b', c_mktsegment || ' & <co>' FROM customer""",
)
def d2_odd(spark, sf):
    fields = {"NAME": "h3", "name": "span.balance", "a.b": "span.segment"}
    flow = ExtractSpec(extractor="selector", row_selector="ul.cards > li", selectors=fields)
    table_ = pipeline.run(card_pages(spark, sf), flow).table
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").alias("value")) for c in ("NAME", "name_2", "a.b")])
    return table_.select(F.col("__page_id").alias("p"), F.inline(cells))


@query(
    "f3_bad_numbers",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey + 0.5 WHEN 1 THEN -o_orderkey::DOUBLE
              WHEN 2 THEN o_orderkey * 10.0 END::DOUBLE AS number FROM orders""",
)
def f3_bad(spark, sf):
    forms = "CASE o_orderkey % 5 WHEN 0 THEN concat(o_orderkey, '.5') WHEN 1 THEN concat('-', o_orderkey) " \
        "WHEN 2 THEN concat(o_orderkey, 'e1') WHEN 3 THEN concat(o_orderkey, 'd') ELSE concat(o_orderkey, 'f') END"
    return table(spark, sf, "orders").select("o_orderkey", values.to_number(F.expr(forms)).alias("number"))


@query(
    "c13_long_output",
    f"""SELECT page_id, url, row_idx, col, col_ord, value FROM (
          SELECT page_id, 'https://shop.example.com/list/' || page_id AS url, row_idx,
                 unnest(['card-title', 'segment', 'balance']) AS col, unnest([0, 1, 2]) AS col_ord,
                 unnest(["card-title", segment, balance]) AS value FROM ({_CARDS}))
        WHERE page_id IN (SELECT page_id FROM ({_CARDS}) GROUP BY 1 HAVING count(*) >= 10)""",
)
def c13_long(spark, sf):
    # Discovered columns without a wide table.
    found = pipeline.run_long(card_pages(spark, sf), ExtractSpec(threshold=10))
    return found.select("page_id", "url", big("row_idx"), "col", big("col_ord"), "value")


class HeadingTable:
    """A table function over one page: its title and heading, found in the markup."""

    @staticmethod
    def analyze(pages):
        from pyspark.sql.types import LongType, StringType, StructType
        from pyspark.sql.udtf import AnalyzeResult

        schema = StructType().add("page_id", LongType()).add("row_idx", LongType()).add("col", StringType())
        return AnalyzeResult(schema.add("col_ord", LongType()).add("value", StringType()))

    def eval(self, page):
        import html
        import re

        for at, (name, tag) in enumerate((("title", "title"), ("heading", "h1"))):
            found = re.search(f"<{tag}>([^<]*)", page["html"] or "")
            if found and found[1].strip():
                yield page["page_id"], 0, name, at, html.unescape(found[1].strip())


@query(
    "i7_registered",
    f"""WITH {TEXTS} SELECT page_id, max(CASE WHEN tag = 'title' THEN stripped END) AS title,
          max(CASE WHEN tag = 'h1' THEN stripped END) AS heading FROM texts WHERE tag IN ('title', 'h1') GROUP BY page_id""",
)
def i7(spark, sf):
    registry.register_table_function("headings", udtf(HeadingTable))
    result = pipeline.run(table(spark, sf, "pages"), ExtractSpec(extractor="headings", trim_cells=False))
    return result.table.select(F.col("__page_id").alias("page_id"), "title", "heading")


def _orders_of(spark, sf, status):
    rows = table(spark, sf, "orders").where(F.col("o_orderstatus") == status)
    return rows.select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_totalprice").cast("string").alias("price"))


@query(
    "g10_replace",
    """SELECT * FROM (SELECT 'first' AS step, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, 1 AS version FROM orders WHERE o_orderstatus = 'F'
       UNION ALL SELECT 'broken', count(*), sum(o_orderkey)::BIGINT, 1 FROM orders WHERE o_orderstatus = 'F'
       UNION ALL SELECT 'second', count(*), sum(o_orderkey)::BIGINT, 2 FROM orders WHERE o_orderstatus = 'O'
       UNION ALL SELECT 'empty', count(*), sum(o_orderkey)::BIGINT, 2 FROM orders WHERE o_orderstatus = 'O')""",
)
def g10(spark, sf):
    # One output, replaced by runs of which one breaks off after its rows and one has none.
    path = scratch_path(spark, "published")

    def broken(folder):
        raise RuntimeError("broken off")

    def publish(rows, **parts):
        wrote = {"rows": lambda to: sinks.write_csv(rows, to, keys=())} | parts
        try:
            versions.publish(spark, path, "csv", wrote)
        except (RuntimeError, sinks.EmptyTable):
            pass

    def now(step):
        rows = versions.read_part(spark, path).select(F.col("key").cast("bigint").alias("key"))
        number = versions.current(spark, path).number
        return rows.agg(F.count("*").alias("n"), F.sum("key").alias("keys")).select(
            F.lit(step).alias("step"), "n", "keys", F.lit(number).alias("version")
        )

    steps = [("first", "F", {}), ("broken", "P", {"quality": broken}), ("second", "O", {}), ("empty", "none", {})]
    seen = []
    for step, status, parts in steps:
        publish(_orders_of(spark, sf, status), **parts)
        seen.append(now(step))
    return reduce(lambda a, b: a.unionByName(b), seen)


@query(
    "g9_empty_rule",
    """SELECT c_mktsegment AS segment, count(*) FILTER (c_acctbal > 9000) AS "rows",
         count(*) FILTER (c_acctbal > 9000) > 0 AS written FROM customer GROUP BY 1
       UNION ALL SELECT 'none', 0, false""",
)
def g9(spark, sf):
    # A table a segment, of rich customers; a segment without any writes nothing and stops nothing.
    rich = table(spark, sf, "customer").where("c_acctbal > 9000").selectExpr("c_name as name", "c_mktsegment as segment")
    segments = [r.s for r in table(spark, sf, "customer").selectExpr("c_mktsegment s").distinct().collect()]
    out = []
    for segment in sorted(segments) + ["none"]:
        rows = rich.where(F.col("segment") == segment).select("name")
        path = scratch_path(spark, "segment")
        try:
            sinks.write_json(rows, path, keys=())
            count = spark.read.json(path).count()
        except sinks.EmptyTable:
            count = 0
        out.append((segment, count, count > 0))
    return spark.createDataFrame(out, "segment string, rows bigint, written boolean")


@query(
    "i6_picker",
    f"""SELECT 'li.card' AS row_selector, f AS col, s AS selector, n AS row_count FROM (
          SELECT count(*) AS n FROM customer WHERE c_custkey // {PER_PAGE} = 1),
        (SELECT unnest(['segment', 'balance', 'card_link']) AS f,
                unnest(['div > span.segment', 'div > span.balance', 'a.card-link']) AS s)""",
)
def i6(spark, sf):
    # What a user gets who points at three elements of one page's first card.
    pages, examples = _examples(spark, sf)
    page = pages.where("page_id = 1")
    firsts = examples.where("page_id = 1").orderBy("pre").limit(3)
    found = induce.pick(page, firsts)
    rows = [(found["row_selector"], c, s, found["row_count"]) for c, s in found["selectors"].items()]
    return spark.createDataFrame(rows, "row_selector string, col string, selector string, row_count bigint")


@query(
    "a1_page_formats",
    "SELECT format, page_id, url, length(html) AS chars FROM pages, (SELECT unnest(['parquet', 'orc', 'json']) AS format)",
)
def a1(spark, sf):
    # Captures with columns of their own, in each format; only the three of a page are read.
    pages = table(spark, sf, "pages").withColumn("status", F.lit(200))
    read = []
    for fmt in ("parquet", "orc", "json"):
        path = scratch_path(spark, "crawl")
        pages.write.format(fmt).save(path)
        found = read_pages(spark, path, fmt).select("page_id", "url", F.char_length("html").cast("bigint").alias("chars"))
        read.append(found.withColumn("format", F.lit(fmt)))
    return reduce(lambda a, b: a.unionByName(b), read)


@query("g11_all_urls", "SELECT DISTINCT url FROM pages")
def g11_urls(spark, sf):
    spec = ExtractSpec(extractor="selector", selectors={"title": "title"}, provenance=True, quality_report=True)
    path = scratch_path(spark, "output")
    pipeline.run(table(spark, sf, "pages"), spec).write("parquet", path)
    beside = [spark.read.json(f"{path}.{kind}") for kind in ("meta", "quality")]
    if any(df.isEmpty() for df in beside):
        raise ValueError("a file beside the output is empty")
    return spark.read.parquet(f"{path}.urls")


@query(
    "d6_recaptured",
    f"""SELECT c_custkey // {PER_PAGE} AS page_id, c_custkey % {PER_PAGE} AS row_idx, c_name AS name FROM customer""",
)
def d6_recaptured(spark, sf):
    # Every page captured twice, the later capture emptied: one counts, the earlier id.
    pages = card_pages(spark, sf)
    again = pages.select((F.col("page_id") + 10_000_000).alias("page_id"), "url", F.lit("<p>").alias("html"))
    rows = paginate.extract_paginated(pages.union(again), _starts(spark, sf), "ul.cards > li", {"name": "h3"}, 100)
    return rows.select("page_id", big("row_idx"), "name")


def _store(spark, *landings, **how):
    """A capture store of its own folder, filled by one landing after the other."""
    path = scratch_path(spark, "store")
    store = CaptureStore(spark, "s" + path.rsplit("-", 1)[1], path, buckets=8, **how)
    for captures in landings:
        store.add(captures)
    return store


@query("d5_indexed_walk", _WALK)
def d5_indexed(spark, sf):
    pages = card_pages(spark, sf)
    # Landed in two runs, the second of which brings the first one's captures again.
    store = _store(spark, pages.where("page_id % 3 = 0"), pages)
    reached = paginate.walk_pages(store.pages, _starts(spark, sf), index=store.index())
    return reached.select("start", big("depth"), "page_id")


@query(
    "a8_capture_store",
    """SELECT url, CASE WHEN page_id % 10 = 0 THEN page_id + 10000000 ELSE page_id END AS page_id,
         CASE WHEN page_id % 10 = 0 THEN 6 ELSE length(html) END AS chars FROM pages WHERE page_id % 5 = 0""",
)
def a8_store(spark, sf):
    pages = table(spark, sf, "pages")
    first = pages.withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp"))
    again = pages.where("page_id % 10 = 0").select(
        (F.col("page_id") + 10_000_000).alias("page_id"), "url", F.lit("<p>new").alias("html"),
        F.lit("2024-02-01").cast("timestamp").alias("fetched_at"),
    )
    store = _store(spark, first, again, first.where("page_id % 2 = 0"))
    wanted = pages.where("page_id % 5 = 0").select("url")
    found = pages_for(store.pages, wanted, fits=0)
    return found.select("url", "page_id", F.char_length("html").cast("bigint").alias("chars"))


@query(
    "d11_job_heuristic",
    f"""SELECT c_custkey % {PER_PAGE} AS row_idx, c_name AS name FROM customer WHERE c_custkey // {PER_PAGE} = 1""",
)
def d11_job(spark, sf):
    # A promo block, which only the full keyword list of job steps takes out.
    promo = '<div class="promo">' + "".join(f'<p class="deal"><b class="x">Deal {k}</b></p>' for k in range(40)) + "</div>"
    pages = card_pages(spark, sf).withColumn("html", F.replace("html", F.lit("<aside>"), F.lit(promo + "<aside>")))
    steps = [{"action": "goto", "url": "https://shop.example.com/list/1"}, {"action": "extract", "heuristic": True, "threshold": 10}]
    found = job.run_job(job.load_job({"name": "promo", "steps": steps}), pages).table
    names = [c for c in found.columns if c.startswith("card_title") or c in ("name", "card-title", "title")]
    return found.select(F.col("__row_idx").cast("bigint").alias("row_idx"), F.coalesce(*[F.col(f"`{c}`") for c in names]).alias("name"))
