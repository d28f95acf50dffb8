"""Shaping, typing, profiling and export on small string tables."""

import json

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import text, values
from pagequarry.operators import cells as long
from pagequarry.operators import profile, shape, sinks

KEYS = ("row_idx",)


@pytest.fixture
def frame(spark):
    def make(**columns):
        n = max(len(v) for v in columns.values())
        padded = {k: v + [""] * (n - len(v)) for k, v in columns.items()}
        rows = [(i, *vals) for i, vals in enumerate(zip(*padded.values()))]
        return spark.createDataFrame(rows, "row_idx long, " + ", ".join(f"`{k}` string" for k in padded))

    return make


def columns(df):
    rows = df.orderBy("row_idx").collect()
    return {c: [r[c] for r in rows] for c in df.columns if c != "row_idx"}


def test_trim_rename_and_pick(frame):
    assert columns(shape.trim(frame(a=["  hi ", "\tworld\n", "ok "]), KEYS)) == {"a": ["hi", "world", "ok"]}
    df = frame(a=["1"], b=["2"], c=["3"])
    assert columns(shape.rename(df, {"a": "x", "b": "x"}, KEYS)) == {"x": ["1"], "x_2": ["2"], "c": ["3"]}
    assert shape.renamed(["a", "x"], {"a": "x"}) == ["x", "x_2"]
    assert columns(shape.keep_or_drop(df, ["c", "zz", "a"], ["a"], KEYS)) == {"c": ["3"], "a": ["1"]}
    assert columns(shape.keep_or_drop(df, (), ["a", "zz"], KEYS)) == {"b": ["2"], "c": ["3"]}
    assert shape.keep_or_drop(df, ["zz"], (), KEYS).count() == 0


def test_required_and_lock(frame):
    people = frame(name=["Alice", "", "Charlie"], city=["NYC", "SF", " "])
    assert columns(shape.require(people, ["name", "city"], KEYS)) == {"name": ["Alice"], "city": ["NYC"]}
    assert shape.require(people, ["zz"], KEYS).count() == 3
    late = frame(always=list("abcd"), late=["", "", "", "x"])
    assert shape.locked_columns(late, 2, KEYS) == ["always"]
    assert shape.locked_columns(late, 4, KEYS) == ["always", "late"]
    assert shape.locked_columns(late, 0, KEYS) == ["always", "late"]


def test_dedupe_and_whole_flow(frame):
    assert columns(shape.dedupe(frame(a=["1", "1", "2"], b=["x", "x", "y"]), KEYS)) == {"a": ["1", "2"], "b": ["x", "y"]}
    raw = frame(raw_name=[" Alice ", "", "Charlie"], junk=["x", "y", "z"], score=["1", "2", "3"])
    out = shape.shape(raw, drop=["junk"], mapping={"raw_name": "name"}, required=["name"], keys=KEYS)
    assert columns(out) == {"name": ["Alice", "Charlie"], "score": ["1", "3"]}


def test_kinds(spark):
    cases = {
        "12": "integer", "-3": "integer", "1234567890123456": "number", "1.5": "number", "1,5": "number", "1,500.2": "string",
        "$1,200.50": "currency", "€ 3": "currency", "$x": "string", "2024-3-4": "date", "31/12/2024": "date",
        "12/31/2024": "date", "2024/02/30": "string", "1-2-2024": "date", "3 march 2024": "date", "March 3, 2024": "date",
        "3 Sep 2024": "date", "0000-01-01": "string", "Yes": "boolean", "false": "boolean", " ": "empty", "abc": "string",
        "٣": "integer", "32/1/2024": "string", "3 Foo 2024": "string",
    }
    df = spark.createDataFrame(list(cases.items()), "v string, k string")
    assert {r.v: r.got for r in df.select("v", values.kind(F.col("v")).alias("got")).collect()} == cases
    dates = {"3/4/2024": "2024-04-03", "13/4/2024": "2024-04-13", "4/13/2024": "2024-04-13", " 5 May 2024": "2024-05-05", "x": None}
    df = spark.createDataFrame([(d,) for d in dates], "v string")
    assert {r.v: r.d for r in df.select("v", values.parse_date(F.col("v")).cast("string").alias("d")).collect()} == dates


def test_profile_and_types(frame):
    df = frame(n=["1", "2", "3"], name=["a", "", "c"], when=["3/4/2024", "12/25/2024", "1/2/2024"], flag=["yes", "no", "maybe"])
    out = {r.name: r for r in profile.quality(df, KEYS).collect()}
    assert out["n"].inferred_type == "integer" and out["n"].sample == ["1", "2", "3"]
    assert (out["name"].non_empty, out["name"].empty, out["name"].unique) == (2, 1, 3)
    assert out["name"].null_ratio == pytest.approx(1 / 3) and out["flag"].inferred_type == "string"
    typed = profile.coerce(df, keys=KEYS).orderBy("row_idx").collect()
    # One layout per column: the month-first one reads all three.
    assert [str(r.when)[:10] for r in typed] == ["2024-03-04", "2024-12-25", "2024-01-02"]
    prices = frame(n=["1", "2.5", "3", "4", "5"], price=["$10.00", "$20.50", "5", "$1,000.5", "$2"])
    typed = profile.coerce(prices, {"n": "integer", "price": "currency"}, keys=KEYS).orderBy("row_idx").collect()
    assert [r.n for r in typed] == [1, None, 3, 4, 5] and [r.price for r in typed] == [10.0, 20.5, 5.0, 1000.5, 2.0]


def test_export(spark, frame, tmp_path):
    df = frame(name=["=cmd", "Alice", "+1", "a,\"b\"\nc"], empty=["", " ", "", ""], city=["NYC", "", "SF", ""])
    assert sinks.filled_columns(df, KEYS) == ["name", "city"]
    path = str(tmp_path / "csv")
    sinks.write_csv(df, path, safe=True, sort=True, keys=KEYS)
    back = sinks.read_csv(spark, path)
    assert back.columns == ["city", "name"]
    assert sorted(r.name for r in back.collect()) == sorted(["'=cmd", "Alice", "'+1", 'a,"b"\nc'])
    for policy, city in (("empty", ""), ("null", None), ("skip", "absent")):
        out = str(tmp_path / policy)
        sinks.write_json(df, out, policy=policy, keys=KEYS)
        rows = [json.loads(r.value) for r in spark.read.text(out).collect()]
        assert next(r for r in rows if r["name"] == "Alice").get("city", "absent") == city
    with pytest.raises(sinks.EmptyTable):
        sinks.write_csv(df.limit(0), path, keys=KEYS)
    with pytest.raises(ValueError):
        sinks.write_parquet(df, path, codec="brotli", keys=KEYS)
    named = sinks.normalise_keys(df.withColumnsRenamed({"name": "Some Title!", "city": "some-title"}), KEYS)
    assert named.columns == ["row_idx", "some_title", "empty", "some_title_2"]


def test_names(spark):
    df = spark.createDataFrame([("a/b:c. ",), ("nul",), ("...",), ("x" * 300,)], "v string")
    got = [r[0] for r in df.select(text.sanitise_name(F.col("v"))).collect()]
    assert got == ["a_b_c", "output", "output", "x" * 200]


def test_positional_concat_shifts_and_align_does_not(spark):
    cells = spark.createDataFrame(
        [(1, 0, "a", 0, "1"), (1, 1, "a", 0, "2"), (2, 0, "a", 0, "3"), (2, 0, "b", 1, "9")],
        "page_id long, row_idx int, col string, col_ord int, value string",
    )
    got = long.positional_concat(cells, chunk=1).orderBy("col", "pos").collect()
    assert [(r.col, r.pos, r.value) for r in got] == [("a", 0, "1"), ("a", 1, "2"), ("a", 2, "3"), ("b", 0, "9")]
    wide = long.to_wide(cells, ["a", "b"]).orderBy("page_id", "row_idx").collect()
    assert [(r.a, r.b) for r in wide] == [("1", ""), ("2", ""), ("3", "9")]


def test_profiles_of_runs_merge(spark):
    from pagequarry.operators import profile

    runs = [
        [(str(i), f"{i % 7}.5", "x" if i % 2 else "") for i in range(400)],
        [(str(i), "n/a", " ") for i in range(300, 500)],
    ]
    parts = [spark.createDataFrame(r, "a string, b string, c string") for r in runs]
    parts[1] = parts[1].drop("c").withColumn("d", parts[1]["a"])
    states = profile.profile_state(parts[0], ()).unionByName(profile.profile_state(parts[1], ()))
    got = {r.name: r for r in profile.merged_profile(states).collect()}
    assert (got["a"].non_empty, got["a"].empty, got["a"].inferred_type) == (600, 0, "integer")
    assert abs(got["a"].unique - 500) <= 25 and got["b"].unique == 8 and got["b"].inferred_type == "string"
    assert (got["c"].non_empty, got["c"].empty) == (200, 400) and (got["d"].non_empty, got["d"].empty) == (200, 400)
    assert profile.merged_profile(states.limit(0)).collect() == []
