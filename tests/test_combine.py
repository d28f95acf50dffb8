"""Walks, follows, crawl preparation, jobs and streams."""

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import follow, induce, paginate, scan
from pagequarry.operators import selectors as css
from pagequarry.plans import job, pipeline, registry, sites
from pagequarry.plans.spec import ExtractSpec
from pagequarry.sources import frontier
from pagequarry.streaming import watch

SITE = "https://site.example.com"


def listing(i, n, nxt):
    rows = "".join(f'<li class=row><b>p{i}-{k}</b><a href="/d/{i}{k}">x</a></li>' for k in range(n))
    return (f"{SITE}/l/{i}", f"<body><ul>{rows}</ul>{nxt}</body>")


def test_walk_and_paginated_extract(spark, pages):
    df = pages(
        listing(1, 3, '<a rel=next href="/l/2">n</a>'),
        listing(2, 3, '<a href="3">Next</a>'),
        listing(3, 1, '<a class=next href="/l/2">back</a>'),
        listing(4, 1, '<a rel=next href="https://other.example.com/l/5">n</a>'),
        ("https://other.example.com/l/5", "<p>other</p>"),
        listing(6, 1, '<a rel=next href="/missing">n</a>'),
    )
    starts = spark.createDataFrame([(f"{SITE}/l/{i}",) for i in (1, 4, 6)], "url string")
    got = sorted((r.start[-1], r.depth, r.url[-1]) for r in paginate.walk_pages(df, starts).collect())
    assert got == [("1", 0, "1"), ("1", 1, "2"), ("1", 2, "3"), ("4", 0, "4"), ("6", 0, "6")]
    two = paginate.walk_pages(df, starts, max_pages=2).where("depth > 0").collect()
    assert [(r.start[-1], r.depth) for r in two] == [("1", 1)]
    rows = paginate.extract_paginated(df, starts.limit(1), "li.row", {"t": "b"}, max_pages=2)
    assert [r.t for r in rows.orderBy("depth", "row_idx").collect()] == ["p1-0", "p1-1", "p1-2", "p2-0", "p2-1", "p2-2"]


def test_follow(spark, pages):
    df = pages(
        (f"{SITE}/all", '<article><h2>A</h2><a href="d/1">l</a></article><article><h2>B</h2></article>'
         '<article><h2>C</h2><a href="/gone">l</a></article>'),
        (f"{SITE}/d/1", "<h2>Detail</h2><p> body </p><ul><li>t1<li>t2</ul>"),
    )
    rows = css.extract_rows(df.where("page_id = 0"), "article", {"title": "h2", "link": "a@href"}, with_url=True)
    fields = {"title": "h2", "body": "p", "tag": "li"}
    got = follow.follow(rows, df, "link", fields).orderBy("row_idx").collect()
    assert [(r.title, r.body, r.tag) for r in got] == [("Detail", "body", "t1"), ("B", "", ""), ("C", "", "")]
    assert [r.target for r in follow.misses(rows, df, "link").collect()] == [f"{SITE}/gone"]
    with pytest.raises(Exception, match="no captured page"):
        follow.follow(rows, df, "link", fields, on_miss="fail").collect()


def test_page_ranges(spark):
    def expand(spec, cap=1000):
        df = spark.createDataFrame([(spec,)], "s string")
        return [r.page for r in frontier.expand_ranges(df, "s", cap).orderBy("pos").collect()]

    assert expand("1-3,5, 7-8,,2") == [1, 2, 3, 5, 7, 8, 2]
    for bad in ("3-1", "", "0-5", "1-50000", "a", "1-", "-3", "1,0", "600-1000,1-700"):
        with pytest.raises(Exception, match="page"):
            expand(bad)


def test_scans_match_sequential_rules(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice("aab"), rng.randint(0, 500)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string, t long")
    slots = scan.spaced_slots(df, ["k"], ["t", "id"], F.floor(F.col("t") / 37), F.col("t"), 4, "slot")
    got, last, want = {r.id: r.slot for r in slots.collect()}, {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = last[k] = max(t, last.get(k, -100) + 4)
    assert got == want
    near = scan.with_neighbours(df, ["k"], ["t", "id"], F.floor(F.col("t") / 37), F.col("id")).collect()
    for key in "ab":
        ordered = [r[0] for r in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))]
        links = {r.id: (r.prev, r.next) for r in near if r.k == key}
        assert links == {x: (p, n) for x, p, n in zip(ordered, [None, *ordered], [*ordered[1:], None])}


def test_job(pages):
    df = pages(
        listing(1, 2, '<a rel=next href="/l/2">n</a>'), listing(2, 2, ""),
        *[(f"{SITE}/d/{i}{k}", f"<h1>detail {i}{k}</h1>") for i in (1, 2) for k in (0, 1)],
    )
    spec = {
        "name": "j", "params": {"n": {"type": "int", "required": True}},
        "steps": [
            {"action": "goto", "url": f"{SITE}/l/1"},
            {"action": "extract_paginated", "row_selector": "li.row", "selectors": {"t": "b", "u": "a@href"}, "max_pages": "{{n}}"},
            {"action": "extract", "selectors": {"t": "li:first-child b"}},
            {"action": "follow", "field": "u", "selectors": {"d": "h1"}},
        ],
    }
    out = job.run_job(job.load_job(spec), df, {"n": "5"})
    rows = out.table.orderBy("__page_ord", "__row_idx").collect()
    # The plain extract runs on the page the walk ended on.
    assert [(r.t, r.d) for r in rows] == [
        ("p1-0", "detail 10"), ("p1-1", "detail 11"), ("p2-0", "detail 20"), ("p2-1", "detail 21"), ("p2-0", ""),
    ]
    for broken in (
        "{", [], {"steps": []}, {"name": "x", "steps": []}, {"name": "x", "steps": [{"action": "fly"}]},
        {"name": "x", "steps": [{"action": "extract"}]}, {"name": "x", "version": 9, "steps": [{"action": "goto", "url": "u"}]},
        {"name": "x", "steps": [{"action": "follow", "field": "u"}]},
    ):
        with pytest.raises(job.JobError):
            job.load_job(broken)
    with pytest.raises(job.JobError, match="no value for"):
        job.resolve_params({"n": {"required": True}}, {})
    assert job.resolve_params({"b": {"type": "bool"}, "f": {"type": "float", "default": 1.5}}, {"b": "Yes", "z": 1}) == {"b": True, "f": 1.5, "z": 1}
    assert job.fill_in({"a": ["x{{ p }}y", 3]}, {"p": 7}) == {"a": ["x7y", 3]}
    with pytest.raises(job.JobError, match="has no value"):
        job.fill_in("{{q}}", {})


def test_pipeline_writes(pages, tmp_path):
    df = pages(listing(1, 12, ""), listing(2, 12, ""))
    out = pipeline.run(df, ExtractSpec(url=f"{SITE}/l/1", rename_columns={"b": "name"}, deduplicate=True))
    assert out.columns == ["name"] and out.rows().count() == 12
    out.write("csv", str(tmp_path / "o"))
    assert [r.name for r in out.preview(2).collect()] == ["p1-0", "p1-1"]
    spec = ExtractSpec(
        page_template=f"{SITE}/l/{{page}}", pages="2,1", extractor="selector", row_selector="li.row", selectors={"b": "b"}
    )
    swapped = pipeline.run(df, spec).preview(13).collect()
    assert [r.b for r in swapped][:2] == ["p2-0", "p2-1"] and swapped[12].b == "p1-0"
    with pytest.raises(KeyError, match="available: csv"):
        registry.sink("xml")


def test_spec_merge():
    base = ExtractSpec(threshold=5, selectors={"a": "1"}, keep_columns=["x"])
    over = ExtractSpec(threshold=10, selectors={"b": "2"}, deduplicate=True)
    merged = base.merge(over)
    assert merged.threshold == 5 and merged.selectors == {"a": "1", "b": "2"}
    assert merged.keep_columns == ["x"] and merged.deduplicate


def test_routing(spark, pages):
    df = pages(("http://a.b.example.org/x", ""), ("http://example.org:80/", ""), ("http://xexample.org/", ""), ("http://B.example.org/", ""))
    names = spark.createDataFrame([("example.org",), ("b.example.org",)], "name string")
    got = {r.page_id: r.site for r in sites.route(df, names).collect()}
    assert got == {0: "b.example.org", 3: "b.example.org"}


def test_picker(spark, pages):
    cards = "".join(f'<li class="card hot"><i>{k}</i><div><b class=price>{k}$</b><b class=price>old</b></div></li>' for k in range(3))
    df = pages(f"<body><ul>{cards}</ul><p id='x:1'>z</p></body>")
    hits = css.select(df, "li:first-child i, li:first-child div")
    picked = induce.pick(df, hits)
    assert picked["row_selector"] == "li.card.hot" and picked["row_count"] == 3
    assert picked["selectors"] == {"i": "i", "div": "div"} and picked["samples"]["i"] == ["0", "1", "2"]
    paths = {r.selector for r in induce.node_selectors(df).collect()}
    assert r"#x\:1" in paths and "ul > li.card.hot > div > b.price" in paths


def test_stream_goes_on_after_a_failed_batch(spark, pages, tmp_path):
    land, out = str(tmp_path / "land"), str(tmp_path / "out")
    pages(listing(1, 2, "")).coalesce(1).write.parquet(land)

    def extract(batch):
        if batch.where("page_id > 5").count():
            raise RuntimeError("broken capture")
        return css.extract_rows(batch, "li.row", {"t": "b"})

    def start():
        watch.watch(watch.captures(spark, land), extract, out, str(tmp_path / "state"), fail_fast=False).awaitTermination()

    start()
    bad = spark.createDataFrame([(9, "http://x/", "<p>")], watch.PAGE_SCHEMA)
    bad.write.mode("append").parquet(land)
    start()
    pages(listing(1, 2, ""), listing(2, 1, "")).where("page_id = 1").coalesce(1).write.mode("append").parquet(land)
    start()
    rows = spark.read.parquet(f"{out}/rows")
    assert sorted(r.t for r in rows.collect()) == ["p1-0", "p1-1", "p2-0"]
    metrics = spark.read.parquet(f"{out}/metrics").orderBy("batch_id").collect()
    assert [(m.pages, m.rows) for m in metrics] == [(1, 2), (1, None), (1, 1)] and "broken" in metrics[1].error
    assert [(r.page_id, r.batch) for r in watch.retries(spark, out).collect()] == [(9, 1)]


def test_stream_stops_at_a_failed_batch_and_takes_it_again(spark, pages, tmp_path):
    land, out = str(tmp_path / "land"), str(tmp_path / "out")
    pages(listing(1, 2, "")).coalesce(1).write.parquet(land)

    def start(extract):
        watch.watch(watch.captures(spark, land), extract, out, str(tmp_path / "state")).awaitTermination()

    def broken(batch):
        raise RuntimeError("store away")

    with pytest.raises(Exception, match="store away"):
        start(broken)
    start(lambda batch: css.extract_rows(batch, "li.row", {"t": "b"}))
    assert sorted(r.t for r in spark.read.parquet(f"{out}/rows").collect()) == ["p1-0", "p1-1"]


def hot_log(spark, n=6000):
    """A third of all rows of one host, nearly all of them in one second; null hosts and times too."""
    rows = []
    for i in range(n):
        host = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"h{i % 7}"
        at = 5 if i % 3 == 0 and i > 60 else None if i % 40 == 2 else i * 37 % 900
        rows.append((host, at, i, "goto" if i % 5 else "fill", f"s{i % 2}", f"u{i % 3}"))
    return spark.createDataFrame(rows, "host string, t long, id long, action string, selector string, url string").repartition(6), rows


def in_line(rows):
    lines = {}
    for r in rows:
        lines.setdefault(r[0], []).append(r)
    for line in lines.values():
        line.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    return lines


def test_scans_over_sampled_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df, rows = hot_log(spark)
        dealt = scan.cut(df.repartition(30), ["host"], ["t", "id"])
        sizes = sorted(r["count"] for r in dealt.groupBy("_chunk").count().collect())
        assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        summed = scan.running_sum(df, ["host"], ["t", "id"], None, F.col("id"), "s").collect()
        spaced = scan.spaced_slots(df.where("t is not null"), ["host"], ["t", "id"], None, F.col("t"), 4, "slot").collect()
        near = scan.with_neighbours(df, ["host"], ["t", "id"], None, F.col("id")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sums, slots, ends = {}, {}, {}
    for line in in_line(rows).values():
        total, last = 0, None
        ids = [None, *[r[2] for r in line], None]
        for k, r in enumerate(line):
            total += r[2]
            sums[r[2]], ends[r[2]] = total, (ids[k], ids[k + 2])
            if r[1] is not None:
                last = r[1] if last is None else max(r[1], last + 4)
                slots[r[2]] = last
    assert {r.id: r.s for r in summed} == sums and {r.id: r.slot for r in spaced} == slots
    assert {r.id: (r.prev, r.next) for r in near} == ends


def test_hot_sessions_are_compacted_alike(spark):
    from pagequarry.operators import actions

    df, rows = hot_log(spark, 900)
    got = {r.id for r in actions.compact(df, "host", ["t", "id"]).collect()}
    want = set()
    for line in in_line(rows).values():
        for before, r, after in zip([None, *line], line, [*line[1:], None]):
            lost = r[3] == "fill" and after is not None and after[3] == "fill" and after[4] == r[4]
            again = r[3] == "goto" and before is not None and before[3] == "goto" and before[5] == r[5]
            if not lost and not again:
                want.add(r[2])
    assert got == want


def test_newest_captures_and_late_ones(spark, tmp_path):
    land, out, state = (str(tmp_path / n) for n in ("land", "out", "state"))
    hour = lambda h: f"timestamp_seconds({h} * 3600)"
    runs = [
        [(1, "a", 100), (2, "a", 99), (3, "b", 100), (4, "c", 50)],
        [(5, "a", 100), (6, "a", 101), (0, "b", 100), (7, "b", 98), (8, "d", 100), (9, None, 100)],
        [(10, "c", 300)],
        [(11, "a", 200), (12, "e", 10), (13, "c", 290), (14, "a", 299), (15, None, 298), (16, "a", None)],
        [(17, "a", 277), (18, "b", 298)],
    ]
    for rows in runs:
        values = ", ".join(f"({i}L, {'null' if u is None else repr(u)}, {'null' if h is None else hour(h)})" for i, u, h in rows)
        spark.sql(f"select * from values {values} as t(page_id, url, fetched_at)").selectExpr(
            "page_id", "cast(url as string) url", "cast(fetched_at as timestamp) fetched_at"
        ).coalesce(1).write.mode("append").parquet(land)
        stream = watch.captures(spark, land, schema="page_id bigint, url string, fetched_at timestamp")
        watch.newest(stream, out, state).awaitTermination()
    now = {r.url: r.page_id for r in watch.newest_now(spark, out).collect()}
    assert now == {"a": 14, "b": 18, "c": 10, "d": 8, "e": 12, None: 15}
    # 2 and 11 were beaten in their own batches; 0 beats 3 by its smaller id
    assert sorted(r.page_id for r in watch.late(spark, out).collect()) == [5, 7, 13, 16, 17]
    # a capture of a URL forgotten meanwhile stands among the newest, and is late all the same
    lost = spark.read.parquet(f"{out}/newest/batch=0").where("url = 'b'").selectExpr("url", "99L as page_id", "fetched_at - interval 1 hour as fetched_at")
    lost.write.parquet(f"{out}/newest/batch=1000")
    assert sorted(r.page_id for r in watch.late(spark, out).collect()) == [5, 7, 13, 16, 17, 99]
    assert {r.url: r.page_id for r in watch.newest_now(spark, out).collect()} == now


def test_examples_far_down_a_page(spark, pages):
    deep = 4000
    html = "<ul><li class=r><i class=v>1</i></li><li class=r>" + "<div>" * deep + "<i class=v>2</i>" + "</div>" * deep + "</li></ul>"
    page = pages(html, "<ul><li class=r><b>x</b></li><li class=r><b>y</b><p><em>z</em></p></li></ul>")
    examples = css.select(page, "i.v, b, em")
    got = {(r.page_id, r.label): r for r in induce.induce(page, examples.where("page_id = 1")).collect()}
    assert {r.row_selector for r in got.values()} == {"li.r"} and got[1, "em"].field_selector == "p > em"
    found = induce.induce(page, examples).where("page_id = 0").orderBy("pre").collect()
    assert [(r.row_selector, r.n_rows) for r in found] == [("li.r", 2), ("li.r", 2)]
    assert found[0].field_selector == "i.v" and found[1].field_selector == " > ".join(["div"] * 8 + ["i.v"])


def test_escaped_paths_meet_escaped_rules(spark):
    rules = [("/%7Eme/", False), ("/a%2Fb", False), ("/50%", False), ("/x+y", False), ("/%C3%A9t%C3%A9", False), ("/ok", True)]
    df = spark.createDataFrame([("http://h", i, "*", allow, p, None) for i, (p, allow) in enumerate(rules)],
                               "origin string, ord int, agent string, allow boolean, path string, crawl_delay double")
    cases = {"/~me/x": False, "/%7eme/": False, "/~m": True, "/a/b/c": False, "/a%2fb": False, "/50%25": False, "/50%zz": False,
             "/x+y": False, "/x%2By": False, "/x y": True, "/x%20y": True, "/été/1": False, "/%c3%a9t%C3%A9": False, "/ok%": True, "": True}
    wanted = spark.createDataFrame([(f"http://h{p}",) for p in cases], "url string")
    got = {r.url[8:]: r.allowed for r in frontier.robots_gate(wanted, df).collect()}
    assert got == cases


def test_rows_and_examples_are_found_once(spark, pages):
    df = pages("<ul>" + "<li class=box><div class=card><b class=n>x</b></div></li>" * 4 + "</ul>")
    for step, selector, name in ((induce.broaden, "div.card", "row_pre"), (induce.narrow, "li.box", "row_pre"), (induce.induce, "b.n", "pre")):
        seen = spark.sparkContext.accumulator(0)

        def counted(batches, seen=seen):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        rows = css.select(df, selector).withColumnRenamed("pre", name)
        assert len(step(df, rows.mapInArrow(counted, rows.schema)).collect()) == 4
        assert seen.value == 4


def test_rows_one_level_up_or_down_broadcast_no_nodes(spark, pages):
    # Nodes written to a table take few bytes a row: a join would take those of all pages for a small table.
    df = pages(*["<ul>" + "<li class=box><div class=card><b class=n>x</b></div></li>" * 4 + "</ul>"] * 2)
    df = df.unionByName(df.where("page_id = 1"))
    for step, selector, other in ((induce.broaden, "div.card", "li.box"), (induce.narrow, "li.box", "div.card")):
        rows = css.select(df, selector).select("page_id", F.col("pre").cast("bigint").alias("row_pre"))
        found = step(df, rows)
        assert {k: t for k, t in found.dtypes if "pre" in k} == {"row_pre": "bigint", "new_row_pre": "int"}
        got = found.groupBy("page_id", "row_selector", "n_rows").agg(F.count("*"), F.countDistinct("row_pre")).orderBy("page_id").collect()
        assert [tuple(r) for r in got] == [(0, other, 4, 4, 4), (1, other, 8, 16, 4)]
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == plan.count("Join LeftSemi, (page_id#") > 0


def test_newest_keeps_no_state_and_forgets(spark, tmp_path):
    land, out, state = (str(tmp_path / n) for n in ("land", "out", "state"))
    for run, keep in enumerate(("1 day", "1 day", "0 seconds")):
        spark.sql(f"select {run}L as page_id, 'a' as url, timestamp_seconds({100 - run}) as fetched_at").write.mode("append").parquet(land)
        stream = watch.captures(spark, land, schema="page_id bigint, url string, fetched_at timestamp")
        watch.newest(stream, out, state, keep).awaitTermination()
    assert not (tmp_path / "state" / "state").exists()
    assert [r.page_id for r in spark.read.parquet(f"{out}/late").collect()] == [1]
    assert sorted(r.page_id for r in watch.late(spark, out).collect()) == [1, 2]
    assert [r.page_id for r in watch.newest_now(spark, out).collect()] == [0]


def test_landings_take_no_single_task(spark, tmp_path, monkeypatch):
    from pagequarry.catalog import runs

    sf = str(tmp_path / "sf")
    crawl = spark.range(64).selectExpr("id as page_id", "concat('https://x.example/', id) as url", "'<title>t</title><article><h1>h</h1></article>' as html")
    crawl.repartition(8).write.parquet(f"{sf}/pages.parquet")
    monkeypatch.setattr(runs, "scratch_path", lambda spark, name: str(tmp_path / name))
    assert runs.h4(spark, sf).first().pages == 64
    assert len(list((tmp_path / "landing").glob("part-*"))) > 8
    assert len(list((tmp_path / "stream" / "rows").glob("batch=*"))) == 4
    assert runs.h1_failed(spark, sf).count() == 64
    assert len(list((tmp_path / "land").glob("part-*"))) > 2


def test_pages_are_dealt_once_for_induction(spark, pages):
    df = pages("<ul>" + "<li class=box><b class=n>x</b></li>" * 4 + "</ul>")
    nodes = induce._nodes(df, 0, css.select(df, "b.n").distinct().cache())
    assert [(r._picked, r.n) for r in nodes.groupBy("_picked").agg(F.count("*").alias("n")).orderBy("_picked").collect()] == [(False, 7), (True, 4)]
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    # merged partitions would grow with the input: the node rows are exchanged by number, once
    assert "hashpartitioning(page_id" in plan and "REPARTITION_BY_NUM" in plan and "SortMergeJoin" not in plan
