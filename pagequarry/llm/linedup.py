"""Repeated line runs, by a suffix array over line ids built with prefix doubling.

The corpus is read as sequences of lines (lines without a word are left out). Suffixes
are ranked by their first line, then by their first 2, 4, 8 ... lines: the rank of 2k
lines at a place comes from the pair of ranks of k lines there and k lines on. Suffixes
whose prefix is unique leave the ranking, since nothing longer can repeat there. Suffixes
with one prefix of L lines form a longest-common-prefix interval of depth L; two
overlapping power-of-two ranks identify it for any L, so intervals of different depths
are read from the same tables.

A run is repeated if it has at least ``min_words`` words and occurs at an earlier place
as well (in order of doc_id, then line). Every line of a repeated run lies in a repeated
run that is as short as the word limit allows, from its start or from its end; so the
intervals at these two depths mark exactly the lines of all maximal repeated runs. The
first place keeps its lines, all later ones lose them.

Defined results: a null text counts as empty; null doc_ids come last; documents of equal
doc_id are ordered by a hash of their text, and rows alike in both count as one document
and get the same result; lines compare exactly; a run that overlaps its own copy keeps
its first period; an empty table gives an empty result; extra columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.llm.common import WORD, running_total, text_of, whole_row
from pagequarry.session import stage

MIN_WORDS = 50
DOC = ["d", "h"]
PLACE = [*DOC, "idx"]


def _keys() -> dict:
    return {
        "d": F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)),
        "h": F.xxhash64(F.col("doc_id").isNull(), text_of()),
    }


def _lines(docs: DataFrame) -> DataFrame:
    """``(d, h, idx, line_no, words, h1, h2)``: the lines with a word, numbered within their document."""
    numbered = F.transform(
        F.split(text_of(), "\n", -1),
        lambda x, i: F.struct(i.alias("line_no"), F.regexp_count(x, F.lit(WORD)).alias("words"), x.alias("line")),
    )
    rows = docs.select(*[c.alias(n) for n, c in _keys().items()], numbered.alias("all"))
    rows = rows.select(*DOC, F.posexplode(F.filter("all", lambda x: x["words"] > 0)).alias("idx", "x"))
    line = F.col("x.line")
    return rows.select(
        *PLACE, "x.line_no", "x.words", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")
    )


def _ranked(rows: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """Rows whose key occurs again, with ``rank``: how many of these rows have a smaller key."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1")
    ranks = running_total(counts, [], by, "n", "rank")
    return stage(rows.join(ranks, by).select(*keep, "rank"), "ranked")


def suffix_ranks(lines: DataFrame, longest: int) -> tuple[DataFrame, list[DataFrame]]:
    """The repeated lines, and for 1, 2, 4 ... lines up to ``longest`` the rank of each repeated prefix."""
    first = _ranked(lines.dropDuplicates(PLACE), ["h1", "h2"], [*PLACE, "line_no", "words"])
    levels, k = [first.select(*PLACE, "rank")], 1
    while 2 * k <= longest:
        here = levels[-1].withColumnRenamed("rank", "r1")
        there = levels[-1].select(*DOC, (F.col("idx") - k).alias("idx"), F.col("rank").alias("r2"))
        level = _ranked(here.join(there, PLACE), ["r1", "r2"], PLACE)
        if level.isEmpty():
            break
        levels.append(level)
        k *= 2
    return first, levels


def _shortest(found, min_words: int):
    """Of an array of (words, line_no): the length of the shortest prefix with enough words, and its last line."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("line_no"))
    step = lambda s, x: F.when(s["sum"] >= min_words, s).otherwise(
        F.struct((s["sum"] + x["words"]).alias("sum"), (s["n"] + 1).alias("n"), x["line_no"].alias("line_no"))
    )
    return F.aggregate(found, start, step)


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(d, h, lo, hi)``: lines lo to hi of a document that repeat an earlier run."""
    lines = stage(_lines(docs), "lines")
    repeated, levels = suffix_ranks(lines, min_words)
    # a run is unbroken: number the stretches of repeated lines of each document
    island = F.col("idx") - F.row_number().over(W.partitionBy(*DOC).orderBy("idx"))
    repeated = repeated.withColumn("island", island)
    within = W.partitionBy(*DOC, "island").orderBy("idx")
    line = F.struct("words", "line_no")
    ahead = F.collect_list(line).over(within.rowsBetween(0, min_words - 1))
    behind = F.reverse(F.collect_list(line).over(within.rowsBetween(1 - min_words, 0)))
    both = repeated.select(
        *PLACE,
        "line_no",
        _shortest(ahead, min_words).alias("a"),
        _shortest(behind, min_words).alias("b"),
    )
    down = both.select(*PLACE, F.col("a.n").alias("n"), F.col("line_no").alias("lo"), F.col("a.line_no").alias("hi"), "a.sum")
    up = both.select(
        *DOC, (F.col("idx") - F.col("b.n") + 1).alias("idx"), F.col("b.n").alias("n"), F.col("b.line_no").alias("lo"), F.col("line_no").alias("hi"), "b.sum"
    )
    blocks = down.union(up).filter(F.col("sum") >= min_words).drop("sum").distinct()
    level = F.floor(F.log2("n")).cast("int")
    blocks = blocks.withColumn("level", level).withColumn(
        "end", (F.col("idx") + F.col("n") - F.pow(F.lit(2), F.col("level"))).cast("int")
    )
    table = None
    for k, each in enumerate(levels):
        each = each.select(F.lit(k).alias("level"), *PLACE, "rank")
        table = each if table is None else table.union(each)
    at_start = table.withColumnRenamed("rank", "ra")
    at_end = table.select("level", *DOC, F.col("idx").alias("end"), F.col("rank").alias("rb"))
    named = stage(blocks.join(at_start, ["level", *PLACE]).join(at_end, ["level", *DOC, "end"]), "named")
    # an interval at depth n; its earliest place is the original
    place = F.struct(*PLACE)
    interval = named.groupBy("n", "ra", "rb").agg(F.min(place).alias("first"), F.count("*").alias("many")).filter("many > 1")
    copies = named.join(interval, ["n", "ra", "rb"]).filter(place != F.col("first")).select(*DOC, "lo", "hi")
    copies = stage(copies, "copies")
    sorted_ = W.partitionBy(*DOC).orderBy("lo", "hi")
    reach = F.max("hi").over(sorted_.rowsBetween(W.unboundedPreceding, -1))
    opens = (F.col("lo") > F.coalesce(reach, F.lit(-1))).cast("int")
    merged = copies.withColumn("opens", opens).withColumn("part", F.sum("opens").over(sorted_))
    return merged.groupBy(*DOC, "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("part")


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without their repeated runs, and ``_deleted``: how many lines went."""
    columns = docs.columns
    cuts = repeated_runs(docs, min_words).groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("_cuts"))
    cuts = cuts.withColumnsRenamed({"d": "_d", "h": "_h"})
    keys = [c.alias(f"_{n}") for n, c in _keys().items()]
    keyed = docs.select(*keys, F.split(text_of(), "\n", -1).alias("_parts"), whole_row(docs, ("text",)).alias("_row"))
    joined = keyed.join(cuts, ["_d", "_h"], "left")
    last = lambda i: F.when(i > 0, F.col("_cuts")[i - 1]["hi"]).otherwise(F.lit(-1))
    between = F.transform("_cuts", lambda x, i: F.slice("_parts", last(i) + 2, x["lo"] - last(i) - 1))
    end = F.element_at("_cuts", -1)["hi"]
    tail = F.slice("_parts", end + 2, F.size("_parts"))
    kept = F.when(F.col("_cuts").isNull(), F.col("_parts")).otherwise(F.flatten(F.concat(between, F.array(tail))))
    gone = F.aggregate("_cuts", F.lit(0).cast("long"), lambda s, x: s + x["hi"] - x["lo"] + 1)
    text = F.array_join(kept, "\n").alias("text")
    return joined.select(
        *[text if c == "text" else F.col(f"_row.`{c}`") for c in columns],
        F.size("_parts").cast("long").alias("_lines"),
        F.coalesce(gone, F.lit(0).cast("long")).alias("_deleted"),
    )


def clean_documents(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without their repeated runs; documents of which nothing is left go, ``n_chars`` follows the text."""
    cut = F.col("_deleted") > 0
    out = drop_repeats(docs, min_words).filter(~cut | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(cut, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
