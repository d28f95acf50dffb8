"""The capture store: no exchange over pages, and walks along its links that parse nothing."""

import uuid

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import follow, paginate
from pagequarry.plans import job, pipeline
from pagequarry.plans.spec import ExtractSpec
from pagequarry.sources.pages import pages_for
from pagequarry.sources.store import CaptureStore
from pagequarry.streaming import watch

SITE = "https://site.example.com"


def listing(i):
    rows = "".join(f'<li class=row><b>p{i}-{k}</b><a href="/d/{i}{k}">x</a></li>' for k in range(2))
    return (f"{SITE}/l/{i}", f'<ul>{rows}</ul><a rel=next href="/l/{i + 1}">n</a><em><a href="/l/{i + 2}">o</a></em>')


@pytest.fixture
def store(spark, tmp_path):
    return CaptureStore(spark, "t" + uuid.uuid4().hex, str(tmp_path / "store"), buckets=4, rules=("em a",))


def starts(spark, *numbers):
    return spark.createDataFrame([(f"{SITE}/l/{i}",) for i in numbers], "url string")


def over_html(plan):
    """The exchanges of a physical plan below which a scan reads html."""
    lines = plan.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    scans = [k for k, line in enumerate(lines) if "Scan parquet" in line and "html" in line]
    found = []
    for k in scans:
        level = depth(lines[k])
        for line in reversed(lines[:k]):
            if depth(line) < level:
                level = depth(line)
                if "Exchange" in line:
                    found.append(line)
    return found


def test_adding_again_changes_nothing(spark, pages, store):
    df = pages(*map(listing, range(6)))
    store.add(df.where("page_id < 3"))
    store.add(df)
    store.add(df.limit(0))
    assert store.pages.count() == 6 and store.links.count() == 12
    again = df.where("page_id = 0").select(F.lit(-5).cast("long").alias("page_id"), "url", F.lit("<p>").alias("html"))
    store.add(again)
    assert {r.url[-1]: r.page_id for r in store.latest().collect()}["0"] == -5
    assert store.index().where("rule = ''").count() == 5  # the capture that counts has no link


def test_pages_are_not_moved(spark, pages, store):
    store.add(pages(*map(listing, range(8))))
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        found = pages_for(store.pages, starts(spark, 1, 2, 77), fits=0)
        plan = found._jdf.queryExecution().executedPlan().toString()
        moved = pages_for(store.pages.select("page_id", F.concat("url", F.lit("")).alias("url"), "html"), starts(spark, 1), fits=0)
        assert over_html(moved._jdf.queryExecution().executedPlan().toString())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "html" in plan and not over_html(plan)
    assert sorted(r.url[-1] for r in found.collect()) == ["1", "2"]


def unread(df, *visited):
    """The pages, of which only the visited ones can be parsed."""
    ok = F.col("url").isin([f"{SITE}/l/{i}" for i in visited])
    return df.withColumn("html", F.when(ok, F.col("html")).otherwise(F.raise_error(F.concat(F.lit("parsed "), "url")).cast("string")))


def test_only_visited_pages_are_parsed(spark, pages, store):
    df = pages(*map(listing, range(30)))
    store.add(df)
    index = store.index()
    reached = paginate.walk_pages(unread(df), starts(spark, 3), max_pages=4, index=index).orderBy("depth")
    assert [(r.depth, r.page_id) for r in reached.collect()] == [(0, 3), (1, 4), (2, 5), (3, 6)]
    rows = paginate.extract_paginated(unread(df, 3, 5, 7), starts(spark, 3), "li.row", {"t": "b"}, 3, "em a", index=index)
    assert [r.t for r in rows.orderBy("depth", "row_idx").collect()] == ["p3-0", "p3-1", "p5-0", "p5-1", "p7-0", "p7-1"]
    steps = {"name": "x", "steps": [{"action": "goto", "url": f"{SITE}/l/8"},
             {"action": "extract_paginated", "row_selector": "li.row", "selectors": {"t": "b"}, "max_pages": 2}]}
    got = job.run_job(job.load_job(steps), unread(df, 8, 9), index=index)
    assert got.rows().count() == 4
    spec = ExtractSpec(extractor="selector", row_selector="li.row", selectors={"t": "b"}, url=f"{SITE}/l/1", auto_paginate=True, max_auto_pages=2)
    assert pipeline.run(unread(df, 1, 2), spec, index).rows().count() == 4
    with pytest.raises(Exception, match="parsed"):
        paginate.walk_pages(unread(df), starts(spark, 3), max_pages=2).collect()


def test_follow_from_the_store(spark, pages, store):
    df = pages(listing(1), (f"{SITE}/d/10", "<h1>ten</h1>"), (f"{SITE}/d/11", "<h1>eleven</h1>"), (f"{SITE}/d/99", "<h1>no</h1>"))
    store.add(df)
    rows = spark.createDataFrame([(f"/d/{i}", f"{SITE}/l/1") for i in (10, 11, 12)], "link string, url string")
    got = follow.follow(rows, store.pages, "link", {"h": "h1"})
    assert sorted((r.link, r.h) for r in got.collect()) == [("/d/10", "ten"), ("/d/11", "eleven"), ("/d/12", "")]


def test_stream_keeps_the_store_up_to_date(spark, pages, store, tmp_path):
    land, out, state = (str(tmp_path / n) for n in ("land", "out", "state"))
    df = pages(*map(listing, range(4)))
    for part in ("page_id < 2", "page_id >= 2"):
        df.where(part).write.mode("append").parquet(land)
        watch.watch(watch.captures(spark, land), lambda p: p.select("page_id"), out, state, store=store).awaitTermination()
    assert store.pages.count() == 4
    reached = paginate.walk_pages(store.pages, starts(spark, 0), index=store.index())
    assert sorted(r.page_id for r in reached.collect()) == [0, 1, 2, 3]
