"""Preparing the crawl table: ranges, templates, snapshots, robots, slots, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import scan


def _checked(bad: Column, message: Column, value: Column) -> Column:
    return F.when(bad, F.raise_error(message).cast("array<struct<lo:bigint,hi:bigint>>")).otherwise(value)


def page_ranges(spec: Column, max_pages: int = 10_000) -> Column:
    """``"1-3,5"`` as a list of ``(lo, hi)``; a bad spec fails the query."""
    chunks = F.filter(F.transform(F.split(spec, ","), text.strip), lambda c: c != "")
    number = r"^\s*\+?\d+\s*$"

    def bounds(chunk: Column) -> Column:
        ranged = chunk.contains("-")
        lo = F.when(ranged, F.regexp_extract(chunk, r"^([^-]*)-(?s)(.*)$", 1)).otherwise(chunk)
        hi = F.when(ranged, F.regexp_extract(chunk, r"^([^-]*)-(?s)(.*)$", 2)).otherwise(chunk)

        def whole(c):
            return F.when(c.rlike(number), text.strip(c).try_cast("bigint"))

        return F.struct(whole(lo).alias("lo"), whole(hi).alias("hi"))

    parts = F.transform(chunks, bounds)
    not_number = F.exists(parts, lambda p: p["lo"].isNull() | p["hi"].isNull())
    below_one = F.exists(parts, lambda p: (p["lo"] < 1) | (p["hi"] < 1))
    reversed_ = F.exists(parts, lambda p: p["lo"] > p["hi"])
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc + p["hi"] - p["lo"] + 1)

    def say(what: str) -> Column:
        return F.concat(F.lit(f"{what}: "), spec)

    out = _checked(total > max_pages, say(f"more than {max_pages} pages"), parts)
    out = _checked(reversed_, say("reversed page range"), out)
    out = _checked(below_one, say("page numbers start at 1"), out)
    out = _checked(not_number, say("bad page range"), out)
    return _checked(F.size(chunks) == 0, F.lit("empty page range"), out)


def expand_ranges(df: DataFrame, spec: str, max_pages: int = 10_000) -> DataFrame:
    """One row per page number, ``pos`` keeping the order written, repeats included."""
    pages = F.flatten(F.transform(page_ranges(F.col(spec), max_pages), lambda p: F.sequence(p["lo"], p["hi"])))
    return df.select("*", F.posexplode(pages).alias("pos", "page"))


def expand_template(df: DataFrame, template: str, spec: str, max_pages: int = 10_000) -> DataFrame:
    """``expand_ranges`` plus ``url``, the template with each ``{page}`` filled in."""
    t = F.col(template)
    filled = F.replace(t, F.lit("{page}"), F.col("page").cast("string"))
    url = F.when(t.contains("{page}"), filled).otherwise(
        F.raise_error(F.concat(F.lit("template lacks {page}: "), t)).cast("string")
    )
    return expand_ranges(df, spec, max_pages).withColumn("url", url)


def latest_snapshots(snapshots: DataFrame, payload: list[str]) -> DataFrame:
    """The newest capture per URL. Pre-aggregated, so much-captured URLs do no harm."""
    return (
        snapshots.groupBy(F.sha1(F.col("url").cast("binary")).alias("key"))
        .agg(F.max(F.struct("fetched_at", "url", *payload)).alias("s"))
        .select("key", "s.*")
    )


def with_cache(
    wanted: DataFrame, snapshots: DataFrame, payload: list[str], now: Column, ttl_seconds: int = 0
) -> DataFrame:
    """``wanted`` URLs with ``hit`` and, on a hit, the stored payload.

    A snapshot serves while it is no older than ``ttl_seconds``; zero keeps it for ever.
    """
    latest = latest_snapshots(snapshots, payload).drop("url")
    if ttl_seconds > 0:
        age = F.unix_micros(now) - F.unix_micros("fetched_at")
        latest = latest.where(age <= ttl_seconds * 1_000_000)
    keyed = wanted.withColumn("key", F.sha1(F.col("url").cast("binary")))
    return (
        keyed.join(latest, "key", "left")
        .withColumn("hit", F.col("fetched_at").isNotNull())
        .drop("key", "fetched_at")
    )


def decoded(path: Column) -> Column:
    """A path with its percent escapes read, so that ``/%7Ea`` and ``/~a`` are one; what is no
    escape stays as it is, and so does a plus sign."""
    path = F.regexp_replace(path, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def robots_gate(
    wanted: DataFrame,
    rules: DataFrame,
    unreadable: DataFrame | None = None,
    agent: str = "mozilla",
    allow_on_error: bool = False,
) -> DataFrame:
    """Add ``allowed`` and ``crawl_delay`` by the rules of each URL's origin.

    ``rules(origin, ord, agent, allow, path, crawl_delay)``: the first group naming a
    part of our agent applies, else the ``*`` group; in it the first rule whose path
    starts the URL's path decides, both with their escapes read. A rule list is bounded by one robots file, so it
    travels as an array and each URL meets one row, whatever its origin's share.
    """
    agent = agent.split("/")[0].lower()
    rules = rules.withColumn("path", decoded(F.col("path")))
    per_origin = rules.groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("ord", "agent", "allow", "path", "crawl_delay"))).alias("r")
    )
    named = F.filter("r", lambda x: (x["agent"] != "*") & F.lit(agent).contains(F.lower(x["agent"])))
    # A group is an unbroken run of rules for one agent; a later group for the same
    # agent doesn't count.
    after = F.filter("r", lambda x: x["ord"] >= named[0]["ord"])
    breaks = F.array_position(F.transform(after, lambda x: x["agent"] == named[0]["agent"]), False)
    group = F.when(breaks > 0, F.slice(after, F.lit(1), (breaks - 1).cast("int"))).otherwise(after)
    ours = F.when(F.size(named) > 0, group).otherwise(F.filter("r", lambda x: x["agent"] == "*"))
    per_origin = per_origin.select("origin", ours.alias("ours"))
    if unreadable is not None:
        lost = unreadable.select("origin").distinct().withColumn("lost", F.lit(True))
        per_origin = per_origin.join(lost, "origin", "full_outer")
    else:
        per_origin = per_origin.withColumn("lost", F.lit(None).cast("boolean"))
    tail = F.regexp_extract("url", r"(?s)^[^:/?#]+://[^/?#]*(.*)$", 1)
    path = F.when(tail == "", F.lit("/")).otherwise(decoded(tail))
    first = F.try_element_at(
        F.filter("ours", lambda x: (x["path"] == "*") | path.startswith(x["path"])), F.lit(1)
    )
    verdict = F.when(first["path"] == "", True).otherwise(first["allow"])
    delay = F.try_element_at(F.filter("ours", lambda x: x["crawl_delay"].isNotNull()), F.lit(1))
    return (
        wanted.withColumn("origin", urls.origin(F.col("url")))
        .join(per_origin, "origin", "left")
        .withColumn(
            "allowed",
            F.when(F.col("lost"), F.lit(allow_on_error)).otherwise(F.coalesce(verdict, F.lit(True))),
        )
        .withColumn("crawl_delay", F.coalesce(F.when(~F.coalesce("lost", F.lit(False)), delay["crawl_delay"]), F.lit(0.0)))
        .drop("origin", "ours", "lost")
    )


def fetch_slots(
    requests: DataFrame, host: str, arrival: str, tie: str, per_second: float
) -> DataFrame:
    """Add ``slot`` (microseconds): requests to one host at least ``1/per_second`` apart."""
    micros = F.unix_micros(F.col(arrival).cast("timestamp"))
    if per_second <= 0:
        return requests.withColumn("slot", micros)
    gap = round(1_000_000 / per_second)
    return scan.spaced_slots(requests, [host], [arrival, tie], None, micros, gap, "slot")


def fetch_outcomes(attempts: DataFrame, retries: int = 2) -> DataFrame:
    """Per URL: tries used and the first success within ``retries + 1`` attempts.

    ``attempts(url, attempt_no, ok)``. ``row_number`` with a bound is cut down before
    the shuffle, so a URL with very many attempts does not matter.
    """
    rank = F.row_number().over(Window.partitionBy("url").orderBy("attempt_no"))
    used = attempts.withColumn("n", rank).where(F.col("n") <= retries + 1)
    first_ok = F.min(F.when(F.col("ok"), F.col("n")))
    return used.groupBy("url").agg(
        F.coalesce(first_ok, F.max("n")).cast("bigint").alias("tries"),
        first_ok.isNotNull().alias("fetched"),
    )
