"""Queries E, F and G: shaping, typing, profiling and sinks."""

from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import profile, shape, sinks
from ..session import scatter, scratch_path
from .base import query, table

KEYS = ("c_custkey",)


def contacts(spark, sf):
    """A scraped-looking customer table: padded, gappy, with repeats and junk."""
    cust = table(spark, sf, "customer")
    return cust.select(
        "c_custkey",
        F.concat(F.lit(" \t"), "c_name", F.lit("\u00a0\n")).alias("name"),
        F.when(F.col("c_acctbal") < 0, "  ").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.concat(F.lit("$"), F.format_number("c_acctbal", 2)).alias("balance"),
        F.col("c_nationkey").cast("string").alias("nation"),
        F.when(F.col("c_custkey") < 90, "").otherwise("x").alias("late"),
        F.lit("").alias("blank"),
    )


_SEGMENT = "CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END"
_BALANCE = "'$' || format('{:,.2f}', c_acctbal)"
_LATE = "CASE WHEN c_custkey < 90 THEN '' ELSE 'x' END"


@query(
    "e1_trim",
    f"""SELECT c_custkey, c_name AS name, {_SEGMENT} AS segment, {_BALANCE} AS balance,
          c_nationkey::VARCHAR AS nation, {_LATE} AS late, '' AS blank FROM customer""",
)
def e1(spark, sf):
    return shape.trim(contacts(spark, sf), KEYS)


@query("e2_keep_drop", f"SELECT c_custkey, c_nationkey::VARCHAR AS nation, {_BALANCE} AS balance FROM customer")
def e2(spark, sf):
    kept = shape.keep_or_drop(contacts(spark, sf), keep=["nation", "missing", "balance", "late"], keys=KEYS)
    return shape.keep_or_drop(kept, drop=["late", "unknown"], keys=KEYS)


@query(
    "e3_rename",
    f"""SELECT c_custkey, {_BALANCE} AS x, c_nationkey::VARCHAR AS x_2, {_LATE} AS x_3, '' AS blank FROM customer""",
)
def e3(spark, sf):
    df = shape.keep_or_drop(contacts(spark, sf), drop=["name", "segment"], keys=KEYS)
    return shape.rename(df, {"balance": "x", "nation": "x", "late": "x"}, KEYS)


@query(
    "e4_required",
    "SELECT c_custkey, c_mktsegment AS segment, 'x' AS late FROM customer WHERE c_acctbal >= 0 AND c_custkey >= 90",
)
def e4(spark, sf):
    df = shape.keep_or_drop(contacts(spark, sf), keep=["segment", "late"], keys=KEYS)
    return shape.require(df, ["segment", "late", "nowhere"], KEYS)


@query("e5_schema_lock", f"SELECT c_custkey, {_BALANCE} AS balance, c_nationkey::VARCHAR AS nation FROM customer")
def e5(spark, sf):
    df = shape.keep_or_drop(contacts(spark, sf), drop=["name", "segment"], keys=KEYS)
    return shape.lock_schema(df, 50, KEYS)


@query(
    "e6_dedupe",
    f"""SELECT min(c_custkey) AS c_custkey, nation, segment FROM (
          SELECT c_custkey, c_nationkey::VARCHAR AS nation, {_SEGMENT} AS segment FROM customer)
        GROUP BY nation, segment""",
)
def e6(spark, sf):
    df = shape.keep_or_drop(shape.trim(contacts(spark, sf), KEYS), keep=["nation", "segment"], keys=KEYS)
    return shape.dedupe(df, KEYS)


@query(
    "e7_shape",
    f"""SELECT min(c_custkey) AS c_custkey, segment, country FROM (
          SELECT c_custkey, c_mktsegment AS segment, c_nationkey::VARCHAR AS country FROM customer WHERE c_acctbal >= 0)
        GROUP BY segment, country""",
)
def e7(spark, sf):
    return shape.shape(
        contacts(spark, sf),
        keep=["segment", "nation", "blank"],
        mapping={"nation": "country"},
        required=["segment"],
        lock_after=20,
        deduplicate=True,
        keys=KEYS,
    )


# ------------------------------------------------------------------ typing

_MONTH = "strftime(o_orderdate, '%B')"
# Cell texts of every kind, built alike on both sides from one order.
_CELLS = [
    ("integer", "o_orderkey::VARCHAR", "cast(o_orderkey as string)"),
    ("integer", "'-' || o_custkey", "concat('-', o_custkey)"),
    ("number", "'-' || o_custkey || ',5'", "concat('-', o_custkey, ',5')"),
    ("number", "' ' || o_custkey || '.25 '", "concat(' ', o_custkey, '.25 ')"),
    ("currency", "'€ ' || format('{:,.2f}', o_totalprice)", "concat('€ ', format_number(o_totalprice, 2))"),
    ("currency", "'$' || o_custkey", "concat('$', o_custkey)"),
    ("date", "strftime(o_orderdate, '%Y-%m-%d')", "date_format(o_orderdate, 'yyyy-MM-dd')"),
    ("date", "strftime(o_orderdate, '%-d/%-m/%Y')", "date_format(o_orderdate, 'd/M/yyyy')"),
    ("date", "strftime(o_orderdate, '%-m/%-d/%Y')", "date_format(o_orderdate, 'M/d/yyyy')"),
    ("date", "strftime(o_orderdate, '%d-%m-%Y')", "date_format(o_orderdate, 'dd-MM-yyyy')"),
    ("date", "strftime(o_orderdate, '%d %B %Y')", "date_format(o_orderdate, 'dd MMMM yyyy')"),
    ("date", "upper(strftime(o_orderdate, '%B %-d, %Y'))", "upper(date_format(o_orderdate, 'MMMM d, yyyy'))"),
    ("date", "strftime(o_orderdate, '%-d %b %Y')", "date_format(o_orderdate, 'd MMM yyyy')"),
    ("boolean", "CASE WHEN o_orderstatus = 'F' THEN 'TRUE' ELSE ' no' END", "if(o_orderstatus = 'F', 'TRUE', ' no')"),
    ("string", "o_orderpriority", "o_orderpriority"),
    ("string", "strftime(o_orderdate, '%Y-%m') || '-32'", "concat(date_format(o_orderdate, 'yyyy-MM'), '-32')"),
    ("string", "'$' || o_orderstatus", "concat('$', o_orderstatus)"),
    ("string", "o_custkey || '.5.5'", "concat(o_custkey, '.5.5')"),
    ("empty", "' '", "' '"),
]


def _cell_sql(expr="v") -> str:
    return " UNION ALL ".join(
        f"SELECT o_orderkey, {i} AS i, {sql} AS v, '{kind}' AS kind, o_orderdate FROM orders"
        for i, (kind, sql, _) in enumerate(_CELLS)
    )


def _cells(spark, sf):
    cells = ", ".join(f"struct({i} as i, {e} as v)" for i, (_, _, e) in enumerate(_CELLS))
    return scatter(table(spark, sf, "orders")).selectExpr("o_orderkey", f"inline(array({cells}))")


@query("f1_classify", f"SELECT o_orderkey, i, kind FROM ({_cell_sql()})")
def f1(spark, sf):
    return _cells(spark, sf).select("o_orderkey", F.col("i").cast("bigint").alias("i"), values.kind(F.col("v")).alias("kind"))


def listing(spark, sf):
    """A wide all-string order table with one column of each type and two mixed."""
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "cast(o_custkey as string) as buyer",
        "concat('$', format_number(o_totalprice, 2)) as total",
        "date_format(o_orderdate, 'M/d/yyyy') as placed",
        "if(o_orderstatus = 'F', 'Yes', if(o_orderstatus = 'O', 'no', '')) as done",
        "o_orderpriority as priority",
        "if(o_orderstatus = 'P', 'n/a', cast(o_custkey as string)) as mostly",
        "if(o_orderpriority in ('1-URGENT', '2-HIGH'), 'n/a', concat(o_custkey, '.5')) as mixed",
        "' ' as nothing",
    )


LISTING = ("o_orderkey",)
_TYPES = {
    "buyer": "integer", "total": "currency", "placed": "date", "done": "boolean",
    "priority": "string", "mixed": "string", "nothing": "string",
}


@query(
    "f2_infer",
    "SELECT unnest(["
    + ", ".join(f"'{c}'" for c in [*_TYPES, "mostly"])
    + "]) AS name, unnest(["
    + ", ".join(f"'{t}'" for t in _TYPES.values())
    + ", (SELECT CASE WHEN count(*) FILTER (o_orderstatus <> 'P') / count(*) >= 0.8 THEN 'integer' ELSE 'string' END"
    " FROM orders)]) AS inferred_type",
)
def f2(spark, sf):
    return profile.profile(listing(spark, sf), LISTING).select("name", "inferred_type")


@query(
    "f3_coerce",
    """SELECT o_orderkey, o_custkey AS buyer, round(o_totalprice, 2) AS total,
         strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS placed,
         CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS done, o_orderpriority AS priority,
         CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS mostly FROM orders""",
)
def f3(spark, sf):
    types = {**_TYPES, "mostly": "integer"}
    typed = profile.coerce(listing(spark, sf), types, keys=LISTING)
    return typed.select(
        "o_orderkey", "buyer", F.round("total", 2).alias("total"),
        F.date_format("placed", "yyyy-MM-dd HH:mm:ss").alias("placed"), "done", "priority", "mostly",
    )


@query(
    "f4_currency",
    f"""SELECT o_orderkey, i, CASE i WHEN 2 THEN -(o_custkey::VARCHAR || '5')::DOUBLE
          WHEN 3 THEN o_custkey + 0.25::DOUBLE WHEN 4 THEN round(o_totalprice, 2) WHEN 5 THEN o_custkey::DOUBLE
        END AS amount FROM ({_cell_sql()}) JOIN orders USING (o_orderkey) WHERE i BETWEEN 2 AND 5""",
)
def f4(spark, sf):
    amounts = _cells(spark, sf).where("i between 2 and 5")
    amount = values.to_number(F.col("v"))
    return amounts.select("o_orderkey", F.col("i").cast("bigint").alias("i"), amount.alias("amount"))


@query("f5_boolean", "SELECT o_orderkey, o_orderstatus = 'F' AS done FROM orders")
def f5(spark, sf):
    flags = _cells(spark, sf).where("i = 13")
    return flags.select("o_orderkey", values.to_boolean(F.col("v")).alias("done"))


# Slashed dates read day first where that is a date; the month-first form of a day
# above twelve is the only one left for the second layout.
@query(
    "f6_dates",
    f"""SELECT o_orderkey, i, strftime(CASE WHEN i = 8 AND day(o_orderdate) <= 12
          THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) ELSE o_orderdate END, '%Y-%m-%d') AS d
        FROM ({_cell_sql()}) WHERE i BETWEEN 6 AND 12""",
)
def f6(spark, sf):
    dates = _cells(spark, sf).where("i between 6 and 12")
    parsed = values.parse_date(F.col("v")).cast("string")
    return dates.select("o_orderkey", F.col("i").cast("bigint").alias("i"), parsed.alias("d"))


_LISTING_SQL = """SELECT o_orderkey, c AS name, v FROM (SELECT o_orderkey,
    unnest(['buyer', 'total', 'placed', 'done', 'priority', 'nothing']) AS c,
    unnest([o_custkey::VARCHAR, '$' || format('{:,.2f}', o_totalprice), strftime(o_orderdate, '%-m/%-d/%Y'),
            CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'no' ELSE '' END, o_orderpriority, ' ']) AS v
    FROM orders)"""
_PROFILE = f"""SELECT name, count(*) FILTER (trim(v) <> '') AS non_empty, count(*) FILTER (trim(v) = '') AS empty,
    count(DISTINCT v) AS uniq, count(*) FILTER (trim(v) = '') / count(*) AS null_ratio,
    coalesce(array_to_string(list(v ORDER BY o_orderkey) FILTER (trim(v) <> '')[1:3], '|'), '') AS sample
    FROM ({_LISTING_SQL}) GROUP BY name"""


@query("f7_profile", f"SELECT name, non_empty, empty, uniq AS \"unique\", sample FROM ({_PROFILE})")
def f7(spark, sf):
    df = listing(spark, sf).drop("mostly", "mixed")
    out = profile.summarize(df, LISTING)
    return out.select("name", "non_empty", "empty", "unique", F.array_join("sample", "|").alias("sample"))


@query(
    "f7_merged_profile",
    f"""SELECT name, non_empty, empty, true AS close FROM ({_PROFILE})""",
)
def f7_merged(spark, sf):
    # Four runs, each profiled and stored on its own; the estimate is held against the exact count.
    df = listing(spark, sf).drop("mostly", "mixed")
    path = scratch_path(spark, "profiles")
    part = F.pmod(F.xxhash64("o_orderkey"), F.lit(4))
    for run in range(4):
        profile.profile_state(df.where(part == run), LISTING).write.mode("append").parquet(path)
    merged = profile.merged_profile(spark.read.parquet(path))
    exact = profile.profile(df, LISTING).select("name", F.col("unique").alias("_exact"), F.col("inferred_type").alias("_type"))
    near = F.abs(F.col("unique") - F.col("_exact")) <= F.greatest(F.lit(1.0), 0.06 * F.col("_exact"))
    close = (near & (F.col("inferred_type") == F.col("_type"))).alias("close")
    return merged.join(exact, "name").select("name", "non_empty", "empty", close)


@query(
    "f8_quality",
    f"SELECT name, non_empty + empty AS \"rows\", round(null_ratio, 9) AS null_ratio FROM ({_PROFILE})",
)
def f8(spark, sf):
    out = profile.quality(listing(spark, sf).drop("mostly", "mixed"), LISTING)
    return out.select("name", "rows", F.round("null_ratio", 9).alias("null_ratio"))


@query("f9_preview", "SELECT o_orderkey, o_custkey::VARCHAR AS buyer FROM orders ORDER BY o_orderkey LIMIT 5")
def f9(spark, sf):
    return profile.preview(listing(spark, sf).select("o_orderkey", "buyer"), keys=LISTING)


# ------------------------------------------------------------------- sinks


@query(
    "g1_drop_empty",
    """SELECT o_orderkey, o_custkey::VARCHAR AS buyer, CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'no'
         ELSE '' END AS done, o_orderpriority AS priority FROM orders""",
)
def g1(spark, sf):
    df = listing(spark, sf).select("o_orderkey", "priority", "nothing", "done", "buyer")
    return sinks.sort_columns(sinks.drop_empty_columns(df, LISTING), LISTING)


@query(
    "g3_formula_guard",
    """SELECT o_orderkey, i, CASE WHEN regexp_matches(v, '^[=+@\\t\\r-]') THEN '''' || v ELSE v END AS v FROM (
         SELECT o_orderkey, unnest(range(0, 7)) AS i, unnest(['=' || o_custkey, '+' || o_custkey, '-' || o_custkey,
           '@' || o_orderstatus, chr(9) || o_orderstatus, o_custkey || '=', '']) AS v FROM orders)""",
)
def g3(spark, sf):
    df = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "posexplode(array(concat('=', o_custkey), concat('+', o_custkey), concat('-', o_custkey),"
        " concat('@', o_orderstatus), concat(char(9), o_orderstatus), concat(o_custkey, '='), '')) as (i, v)",
    )
    return sinks.guard_formulas(df.withColumn("i", F.col("i").cast("bigint")), LISTING)


@query(
    "g5_normalise_keys",
    """SELECT c_custkey, c_name AS some_title, c_mktsegment AS some_title_2, c_acctbal::VARCHAR AS price_usd,
         c_nationkey::VARCHAR AS field FROM customer""",
)
def g5(spark, sf):
    df = table(spark, sf, "customer").selectExpr(
        "c_custkey", "c_name as `Some Title!`", "c_mktsegment as `some-title`",
        "cast(c_acctbal as string) as `Price-USD`", "cast(c_nationkey as string) as `?!`",
    )
    return sinks.normalise_keys(df, KEYS)


@query(
    "g6_null_policy",
    """SELECT c_custkey, nullif(s, '') AS segment, n AS name, j AS json FROM (
         SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END AS s, ' ' AS n,
           CASE WHEN c_acctbal < 0 THEN '{"name":" "}'
                ELSE '{"segment":"' || c_mktsegment || '","name":" "}' END AS j FROM customer)""",
)
def g6(spark, sf):
    df = table(spark, sf, "customer").selectExpr(
        "c_custkey", "if(c_acctbal < 0, '', c_mktsegment) as segment", "' ' as name"
    )
    out = sinks.null_policy(df, "skip", KEYS)
    return out.withColumn("json", F.to_json(F.struct("segment", "name")))


@query(
    "g12_sanitise",
    r"""SELECT page_id, CASE WHEN n = '' OR n = 'con' THEN 'output' ELSE n[1:200] END AS name FROM (
          SELECT page_id, trim(regexp_replace(u, '[<>:"/\\|?*]', '_', 'g'), ' .') AS n FROM (
            SELECT page_id, unnest([url, ' .. ' , ' con.', repeat(url, 9) || '?.']) AS u FROM pages))""",
)
def g12(spark, sf):
    names = F.array("url", F.lit(" .. "), F.lit(" con."), F.concat(F.repeat("url", F.lit(9)), F.lit("?.")))
    df = table(spark, sf, "pages").select("page_id", F.explode(names).alias("u"))
    return df.select("page_id", text.sanitise_name(F.col("u")).alias("name"))


def _awkward(spark, sf):
    """Texts with quotes, commas, line breaks, blanks at both ends and gaps."""
    return table(spark, sf, "documents").selectExpr(
        "doc_id", "cast(doc_id as string) as id", "concat(' ', text, '\\n\"x\", ') as text",
        "if(lang = 'en', '', source) as source", "'' as blank",
    )


DOC = ("doc_id",)
_AWKWARD = """SELECT doc_id::VARCHAR AS id, ' ' || text || E'\\n"x", ' AS text,
                CASE WHEN lang = 'en' THEN '' ELSE source END AS source FROM documents"""


@query("g2_csv_roundtrip", _AWKWARD)
def g2(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.write_csv(_awkward(spark, sf), path, keys=DOC)
    return sinks.read_csv(spark, path)


@query("g4_json_roundtrip", _AWKWARD.replace("ELSE source END", "ELSE source END").replace("THEN ''", "THEN NULL"))
def g4(spark, sf):
    path = scratch_path(spark, "json")
    sinks.write_json(_awkward(spark, sf), path, policy="null", normalise=True, sort=True, keys=DOC)
    return spark.read.schema("id string, text string, source string").json(path)


@query("g7_parquet_roundtrip", _AWKWARD)
def g7(spark, sf):
    path = scratch_path(spark, "parquet")
    sinks.write_parquet(_awkward(spark, sf), path, codec="zstd", keys=DOC)
    return spark.read.parquet(path)


@query("g8_table_roundtrip", f"{_AWKWARD} UNION ALL {_AWKWARD}")
def g8(spark, sf):
    name, path = "pagequarry_scrape", scratch_path(spark, "table")
    df = _awkward(spark, sf)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    sinks.write_table(df, name, if_exists="fail", path=path, keys=DOC)
    sinks.write_table(df, name, if_exists="append", path=path, keys=DOC)
    back = spark.read.parquet(path)
    spark.sql(f"DROP TABLE {name}")
    return back


@query(
    "g11_provenance",
    """SELECT count(DISTINCT url) AS n_pages, array_to_string((SELECT list(url ORDER BY url) FROM
         (SELECT DISTINCT url FROM pages ORDER BY url LIMIT 100)), ' ') AS first_urls, 'selector' AS extractor FROM pages""",
)
def g11(spark, sf):
    row = sinks.provenance(
        table(spark, sf, "pages"), started="2024-01-01", finished="2024-01-02", extractor="selector",
        selectors={"title": "title"}, sample=100,
    )
    return row.select("n_pages", F.array_join("source_urls", " ").alias("first_urls"), "extractor")
