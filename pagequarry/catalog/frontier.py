"""Queries A: sources and the crawl table."""

from pyspark.sql import functions as F

from ..functions import urls
from ..sources import frontier
from ..sources.pages import pages_for
from .base import big, query, table


@query(
    "a2_url_set",
    """SELECT page_id, url FROM pages
       WHERE url IN (SELECT url FROM pages WHERE url LIKE 'https:%' AND url LIKE '%/en/%')""",
)
def a2(spark, sf):
    pages = table(spark, sf, "pages")
    wanted = pages.where("url like 'https:%' and url like '%/en/%'").select("url")
    return pages_for(pages, wanted).select("page_id", "url")


@query(
    "a3_page_ranges",
    """SELECT c_custkey, i - 1 AS pos, l[i] AS page FROM (
         SELECT c_custkey, l, unnest(range(1, len(l) + 1)) AS i FROM (
           SELECT c_custkey, list_concat(range(c_custkey + 1, c_custkey + 2 + c_nationkey),
                                         [c_nationkey::BIGINT + 7, 3::BIGINT]) AS l FROM customer))""",
)
def a3(spark, sf):
    spec = F.expr(
        "concat(c_custkey + 1, '-', c_custkey + 1 + c_nationkey, ', ', c_nationkey + 7, ',,3')"
    )
    df = table(spark, sf, "customer").select("c_custkey", spec.alias("spec"))
    return frontier.expand_ranges(df, "spec").select("c_custkey", big("pos"), "page")


@query(
    "a4_template_urls",
    """SELECT s_suppkey, page, 'http://s' || s_nationkey || '.example.com/' || page || '/l?p=' || page AS url
       FROM (SELECT s_suppkey, s_nationkey, unnest(range(2, 5 + s_nationkey)) AS page FROM supplier)""",
)
def a4(spark, sf):
    df = table(spark, sf, "supplier").select(
        "s_suppkey",
        F.expr("concat('http://s', s_nationkey, '.example.com/{page}/l?p={page}')").alias("template"),
        F.expr("concat('2-', 4 + s_nationkey)").alias("spec"),
    )
    return frontier.expand_template(df, "template", "spec").select("s_suppkey", "page", "url")


_VARIANTS = {
    "as_is": "url",
    "no_scheme": "regexp_replace(url, '^[a-z]+:', '')",
    "ftp": "regexp_replace(url, '^[a-z]+:', 'ftp:')",
    "upper": "replace(url, 'http', 'HTTP')",
    "path_only": "regexp_replace(url, '^[a-z]+://[^/]+', '')",
    "no_host": "regexp_replace(url, '//[^/?#]+', '//')",
    "port": "regexp_replace(url, '(example[.][a-z]+)', '\\1:8080')",
    "blank": "''",
}


def _variants_sql() -> str:
    return " UNION ALL ".join(f"SELECT page_id, '{n}' AS variant, {e} AS u, url FROM pages" for n, e in _VARIANTS.items())


def _variants(spark, sf):
    pairs = ", ".join(
        f"struct('{n}' as variant, {e.replace(chr(92) + '1', '$1')} as u)" for n, e in _VARIANTS.items()
    )
    return table(spark, sf, "pages").selectExpr("page_id", "url", f"inline(array({pairs}))")


@query(
    "a5_valid_urls",
    f"SELECT page_id, variant, regexp_matches(u, '^(?i:https?)://[^/?#]') AS valid FROM ({_variants_sql()})",
)
def a5(spark, sf):
    return _variants(spark, sf).select("page_id", "variant", urls.is_valid(F.col("u")).alias("valid"))


@query(
    "a5_same_origin",
    f"""SELECT page_id, variant, lower(regexp_extract(u, '^([a-zA-Z]*):?(//[^/?#]*)', 1))
          = regexp_extract(url, '^([a-zA-Z]*):?(//[^/?#]*)', 1)
          AND regexp_extract(u, '^([a-zA-Z]*):?(//[^/?#]*)', 2)
          = regexp_extract(url, '^([a-zA-Z]*):?(//[^/?#]*)', 2) AS same FROM ({_variants_sql()})""",
)
def a5_same(spark, sf):
    same = urls.same_origin(F.col("u"), F.col("url"))
    return _variants(spark, sf).select("page_id", "variant", same.alias("same"))


# How each kind of reference resolves, told from the parts of the base alone.
_PARTS = """parts AS (SELECT page_id, regexp_extract(url, '^[a-z]+', 0) AS s,
  regexp_extract(url, '^[a-z]+://[^/?#]+', 0) AS o, regexp_extract(url, '^[^?#]+', 0) AS p,
  regexp_extract(url, '^[^#]+', 0) AS q, url,
  regexp_replace(regexp_extract(url, '^[^?#]+', 0), '[^/]*$', '') AS dir FROM pages)"""
_REFS = {
    "/a/b?x=1#y": "o || '/a/b?x=1#y'",
    "c.html": "dir || 'c.html'",
    "./c/": "dir || 'c/'",
    "../z": "regexp_replace(dir, '([^/:])/[^/]+/$', '\\1/') || 'z'",
    "../../../z": "o || '/z'",
    "a/./b/../c": "dir || 'a/c'",
    "?q=2": "p || '?q=2'",
    "#top2": "q || '#top2'",
    "//cdn.example.org/lib": "s || '://cdn.example.org/lib'",
    "https://other.example.com/x/../y": "'https://other.example.com/x/../y'",
    "mailto:a@b.example": "'mailto:a@b.example'",
    "": "url",
}


@query(
    "a6_url_join",
    f"WITH {_PARTS} "
    + " UNION ALL ".join(f"SELECT page_id, '{r}' AS ref, {e} AS joined FROM parts" for r, e in _REFS.items()),
)
def a6(spark, sf):
    refs = F.array(*[F.lit(r) for r in _REFS])
    df = table(spark, sf, "pages").select("page_id", "url", F.explode(refs).alias("ref"))
    return df.select("page_id", "ref", urls.join(F.col("url"), F.col("ref")).alias("joined"))


_HOSTS = {
    "as_is": "url",
    "second_level": "replace(url, '.example.', '.co.')",
    "two_labels": "regexp_replace(url, '//.*[.](example[.][a-z]+)', '//\\1')",
    "one_label": "regexp_replace(url, '//[^/?#]+', '//localhost')",
    "invalid": "replace(url, '://', ':')",
}


@query(
    "a7_site_name",
    "SELECT page_id, variant, CASE WHEN NOT regexp_matches(u, '^https?://[^/?#]') THEN 'site' "
    "WHEN len(c) >= 3 AND c[-2] IN ('co','com','net','org','gov','edu','ac') THEN c[-3] "
    "WHEN len(c) >= 2 THEN c[-2] ELSE c[1] END AS site FROM (SELECT *, "
    "string_split(regexp_extract(u, '://([^/?#:]+)', 1), '.') AS c FROM ("
    + " UNION ALL ".join(f"SELECT page_id, '{n}' AS variant, {e} AS u FROM pages" for n, e in _HOSTS.items())
    + "))",
)
def a7(spark, sf):
    pairs = ", ".join(f"struct('{n}' as variant, {e.replace(chr(92) + '1', '$1')} as u)" for n, e in _HOSTS.items())
    df = table(spark, sf, "pages").selectExpr("page_id", f"inline(array({pairs}))")
    return df.select("page_id", "variant", urls.site_name(F.col("u")).alias("site"))


@query(
    "a8_snapshot_cache",
    """WITH snap AS (SELECT 'http://u' || user_id || '.example.com/' || event_type AS url, ts, event_id,
                            row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
                     FROM events),
            wanted AS (SELECT DISTINCT 'http://u' || c_custkey || '.example.com/' || t AS url
                       FROM customer, (SELECT DISTINCT event_type AS t FROM events)),
            live AS (SELECT * FROM snap WHERE rn = 1 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY)
       SELECT w.url, l.url IS NOT NULL AS hit, l.event_id AS capture FROM wanted w LEFT JOIN live l ON w.url = l.url""",
)
def a8(spark, sf):
    events = table(spark, sf, "events")
    url = F.expr("concat('http://u', user_id, '.example.com/', event_type)")
    snaps = events.select(
        url.alias("url"), F.col("ts").cast("timestamp").alias("fetched_at"), F.col("event_id").alias("capture")
    )
    types = F.array(*[F.lit(t) for t in ("signup", "click", "view", "purchase", "error")])
    wanted = table(spark, sf, "customer").select("c_custkey", F.explode(types).alias("t"))
    wanted = wanted.select(F.expr("concat('http://u', c_custkey, '.example.com/', t)").alias("url"))
    now = events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    return frontier.with_cache(wanted, snaps, ["capture"], F.lit(now), ttl_seconds=2 * 86400)


@query(
    "a9_robots_gate",
    """WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]+', 0) AS o,
                         regexp_replace(url, '^[a-z]+://[^/?#]+', '') AS p FROM pages)
       SELECT page_id, CASE
           WHEN o LIKE '%//m.%' THEN false
           WHEN o LIKE '%//blog.%' THEN NOT p LIKE '/fr/%'
           WHEN p LIKE '/en/1%' THEN true
           WHEN p LIKE '/en/%' OR p LIKE '/de/9%' THEN false
           ELSE true END AS allowed,
         (CASE WHEN o LIKE '%//m.%' OR o LIKE '%//blog.%' THEN 0.0 ELSE 2.5 END)::DOUBLE AS crawl_delay FROM u""",
)
def a9(spark, sf):
    pages = table(spark, sf, "pages")
    origins = pages.select(urls.origin(F.col("url")).alias("origin")).distinct()
    # Every origin has a general group; blogs also name our agent, mobile hosts fail.
    columns = ("ord", "agent", "allow", "path", "crawl_delay")

    def listed(*rules):
        return F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(r, columns)]) for r in rules]))

    general = listed(
        (1, "*", True, "/en/1", 2.5), (2, "*", False, "/en/", 2.5), (3, "*", False, "/de/9", 2.5)
    )
    ours = F.inline(F.array(F.struct(
        F.lit(4).alias("ord"), F.lit("Mozilla").alias("agent"), F.lit(False).alias("allow"),
        F.lit("/fr/").alias("path"), F.lit(None).cast("double").alias("crawl_delay"),
    )))
    rules = origins.select("origin", general).unionByName(
        origins.where("origin like '%//blog.%'").select("origin", ours)
    )
    lost = origins.where("origin like '%//m.%'")
    gated = frontier.robots_gate(pages.select("page_id", "url"), rules, lost)
    return gated.select("page_id", "allowed", "crawl_delay")


@query(
    "a9_encoded_paths",
    """WITH u AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/?#]+', '') AS p FROM pages)
       SELECT page_id, NOT (p LIKE '/en/1%' OR p LIKE '/fr/%') AS allowed FROM u""",
)
def a9_encoded(spark, sf):
    # Paths escaped in one way in the rules, and in three ways, or not at all, in the URLs.
    pages = table(spark, sf, "pages")
    forms = [("/", "/"), ("/en/", "/%65n/"), ("/en/1", "/e%6E/%31"), ("/fr/", "/f%72%2f")]
    url = F.col("url")
    for k, (plain, escaped) in enumerate(forms):
        url = F.when(F.col("page_id") % len(forms) == k, F.replace("url", F.lit(plain), F.lit(escaped))).otherwise(url)
    columns = "origin string, ord int, agent string, allow boolean, path string, crawl_delay double"
    origins = pages.select(urls.origin(F.col("url")).alias("origin")).distinct()
    rules = spark.createDataFrame([(1, "*", False, "/%65%6e/1"), (2, "*", False, "/%66r/")], "ord int, agent string, allow boolean, path string")
    every = origins.select("origin", F.explode(F.array(F.lit(1), F.lit(2))).alias("ord")).join(rules, "ord")
    every = every.withColumn("crawl_delay", F.lit(None).cast("double")).select(*[c.split()[0] for c in columns.split(", ")])
    return frontier.robots_gate(pages.select("page_id", url.alias("url")), every).select("page_id", "allowed")


@query(
    "a10_fetch_slots",
    """WITH RECURSIVE e AS (
         SELECT event_id, user_id, epoch_us(ts) AS a,
                row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
       r AS (SELECT event_id, user_id, i, a AS slot FROM e WHERE i = 1
             UNION ALL SELECT e.event_id, e.user_id, e.i, greatest(e.a, r.slot + 7200000000)
             FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
       SELECT event_id, user_id, slot FROM r""",
)
def a10(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    slots = frontier.fetch_slots(events, "user_id", "ts", "event_id", 1 / 7200)
    return slots.select("event_id", "user_id", "slot")


@query(
    "a11_fetch_outcomes",
    """WITH a AS (SELECT user_id || '/' || event_type AS url, value > 40 AS ok,
                         row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)
       SELECT url, coalesce(min(CASE WHEN ok THEN n END), max(n)) AS tries,
              min(CASE WHEN ok THEN n END) IS NOT NULL AS fetched FROM a WHERE n <= 3 GROUP BY url""",
)
def a11(spark, sf):
    attempts = table(spark, sf, "events").selectExpr(
        "concat(user_id, '/', event_type) as url", "event_id as attempt_no", "value > 40 as ok"
    )
    return frontier.fetch_outcomes(attempts, retries=2)


@query(
    "a10_null_arrivals",
    """SELECT event_id, user_id, slot FROM (
         WITH RECURSIVE e AS (
           SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END AS user_id, epoch_us(ts) AS a,
                  row_number() OVER (PARTITION BY CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END ORDER BY ts, event_id) AS i
           FROM events ),
         r AS (SELECT event_id, user_id, i, a AS slot FROM e WHERE i = 1
               UNION ALL SELECT e.event_id, e.user_id, e.i, greatest(e.a, r.slot + 7200000000)
               FROM r JOIN e ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.i = r.i + 1)
         SELECT * FROM r)""",
)
def a10_null(spark, sf):
    # A NULL host is a host like any other: its fetches are spaced, none is lost.
    events = table(spark, sf, "events").selectExpr(
        "event_id", "nullif(user_id, case when user_id % 5 = 0 then user_id end) as user_id", "ts"
    )
    slots = frontier.fetch_slots(events, "user_id", "ts", "event_id", 1 / 7200)
    return slots.select("event_id", "user_id", "slot")
