"""Per-site specs: layered settings and routing of pages to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import automaton
from ..operators import selectors as css
from ..session import stage


def layered(
    layers: DataFrame,
    key: str,
    layer: str,
    scalars: dict[str, object] | None = None,
    lists: tuple[str, ...] = (),
    maps: tuple[str, ...] = (),
) -> DataFrame:
    """Settle stacked settings, one row per ``key`` and ``layer`` number.

    The highest layer wins. A scalar counts only where it is set and differs from its
    default in ``scalars``; a list counts when filled; maps merge key by key.
    """
    aggs: list[Column] = []
    for name, default in (scalars or {}).items():
        given = F.col(name).isNotNull() & ~F.col(name).eqNullSafe(F.lit(default))
        top = F.max_by(name, F.when(given, F.col(layer)))
        aggs.append(F.coalesce(top, F.lit(default)).alias(name))
    for name in lists:
        top = F.max_by(name, F.when(F.size(name) > 0, F.col(layer)))
        aggs.append(F.coalesce(top, F.array().cast("array<string>")).alias(name))
    for name in maps:
        # A key has one row per layer; later layers overwrite in order.
        stack = F.array_sort(F.collect_list(F.struct(F.col(layer).alias("l"), F.map_entries(name).alias("e"))))
        entries = F.flatten(F.transform(stack, lambda s: s["e"]))
        merged = F.aggregate(
            entries,
            F.array().cast("array<struct<key:string,value:string>>"),
            lambda acc, e: F.concat(F.filter(acc, lambda x: x["key"] != e["key"]), F.array(e)),
        )
        aggs.append(F.map_from_entries(merged).alias(name))
    return layers.groupBy(key).agg(*aggs)


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))


def _first_site(rows: DataFrame, key: str, host: Column, names: DataFrame) -> DataFrame:
    """``key, site``: the first name, in name order, that is the host or a dot-suffix of it.

    Hosts are unfolded into their suffixes, so this is an equi-join."""
    hosts = rows.select(key, F.explode(_suffixes(host)).alias("_suffix")).where("_suffix <> ''")
    known = names.select(F.col("name").alias("site"), F.lower("name").alias("_suffix"))
    return hosts.join(known, "_suffix").groupBy(key).agg(F.min("site").alias("site"))


def route(pages: DataFrame, names: DataFrame) -> DataFrame:
    """``page_id, site``: the first name, in name order, that is the page's host or a
    dot-suffix of it."""
    return _first_site(pages, "page_id", F.lower(urls.authority(F.col("url"))), names)


def with_site(pages: DataFrame, names: DataFrame, fits: int = 100_000) -> DataFrame:
    """``pages`` of a named site, with its ``site``.

    Only distinct hosts are routed. Up to ``fits`` of them, counted first, are sent to the
    tasks, so that pages stay where they are; more are joined by a shuffle.
    """
    own = pages.withColumn("_host", F.lower(urls.authority(F.col("url"))))
    hosts = stage(_first_site(own.select("_host").distinct(), "_host", F.col("_host"), names), "hosts")
    few = hosts.limit(fits + 1).count() <= fits
    return own.join(F.broadcast(hosts) if few else hosts, "_host").drop("_host")


def extract_by_site(pages: DataFrame, specs: dict[str, dict[str, str]]) -> DataFrame:
    """``page_id, site, col, value``: the first match of each field, by site spec.

    Pages of no site are left out before anything is parsed. One automaton holds the
    selectors of all sites, and each page is held against those of its own site, so
    neither the plan nor a page's work grows with the number of sites.
    """
    names = pages.sparkSession.createDataFrame([(s,) for s in specs], "name string")
    fields = {site: css.fields_of(selectors) for site, selectors in specs.items()}
    return automaton.first_values(with_site(pages, names), fields, "site")
