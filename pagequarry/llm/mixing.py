"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

A source has a weight, hence a target number of words, and a schedule: how its weight
moves over training time 0..1. The integral of the schedule is the source's cumulative
demand, which rises from 0 to its target. Lining up the source's documents end to end
(in an order drawn from their ids, once per pass) and inverting the demand at a
document's place gives the training time at which that copy is read.

Defined results: a null text has size 0; documents of size 0 are never taken; a null
source is a source of its own and sorts last; a null ``doc_id`` takes part like any
other; repeated rows take part one by one; with no words at all every target is 0; extra
columns are ignored by :func:`mix` and kept by :func:`mixed_documents`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.llm.common import running_total, text_of, word_count
from pagequarry.session import stage

WEIGHTS = (5.0, 2.0, 1.0)
#: Weight against training time, as (time, relative weight) knots joined by lines, one
#: schedule after the other like the weights: fading, steady, rising.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))


def demand_inverse(share: Column, knots) -> Column:
    """The time by which a schedule has asked for ``share`` (0..1) of its target."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    done, time = 0.0, F.lit(1.0)
    pieces = []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        w0, w1 = w0 / area, w1 / area
        part = (t1 - t0) * (w0 + w1) / 2
        # w0 * x + slope / 2 * x^2 = rest, solved for x in the form that bears slope 0
        rest = share - F.lit(done)
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + 2 * (w1 - w0) / (t1 - t0) * rest))
        pieces.append((done + part, F.least(F.lit(t1), F.lit(t0) + 2 * rest / (F.lit(w0) + root))))
        done += part
    for end, at in reversed(pieces):
        time = F.when(share <= F.lit(end), at).otherwise(time)
    return F.greatest(F.lit(0.0), time)


def targets(sizes: DataFrame, weights=WEIGHTS, cap: float = 3.0) -> DataFrame:
    """One row per source: its words and its target.

    All words are shared by weight; a target stops at ``cap`` times its source and the
    excess goes to the others by weight. With sources in order of cap / weight, the ones
    stopped come first, so running sums give a level for each place where the
    stopped ones may end; the highest level that holds for its own source is the right one.
    """
    per = sizes.groupBy("no_source", "src").agg(F.sum("size").alias("source_size"))
    per = running_total(per.withColumn("one", F.lit(1)), [], ["no_source", "src"], "one", "place")
    repeating = F.array(*[F.lit(float(w)) for w in weights])
    per = (
        per.withColumn("kind", (F.col("place") % len(weights)).cast("int"))
        .withColumn("weight", repeating[F.col("kind")])
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("stops", F.col("most") / F.col("weight"))
    )
    filling = ["stops", "no_source", "src"]
    per = running_total(per, [], filling, "most", "most_before")
    per = stage(running_total(per, [], filling, "weight", "weight_before"), "targets")
    # two numbers, and then one, of all sources together
    words, weighed = per.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    level = (F.lit(words) - F.col("most_before")) / (F.lit(weighed) - F.col("weight_before"))
    fits = F.max(F.when(level * F.col("weight") <= F.col("most"), level))
    found = F.lit(per.agg(fits).first()[0]).cast("double")
    return per.select(
        "no_source",
        "src",
        "kind",
        "source_size",
        F.when(found.isNull() | (found * F.col("weight") > F.col("most")), F.col("most")).otherwise(found * F.col("weight")).alias("target"),
    )


def mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, cap: float = 3.0) -> DataFrame:
    """A row per document: doc_id, source, text_hash, size, source_size, target, copies, taken, positions.

    ``positions`` holds the training time of each copy: when its source's cumulative
    demand reaches the copy's middle. A copy is taken if that is before the end, so a
    source comes within half a document of its target.
    """
    sized = docs.select(
        "doc_id",
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("src"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        word_count(text_of()).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("draw"),
    )
    placed = running_total(sized, ["no_source", "src"], ["draw", "size", "text_hash"], "size", "offset")
    placed = stage(placed, "placed")
    full = placed.join(targets(placed, weights, cap), ["no_source", "src"])
    passes = F.sequence(F.lit(0), F.lit(math.ceil(cap) - 1))
    middle = lambda e: e * F.col("source_size") + F.col("offset") + F.col("size") / 2

    def position(e: Column) -> Column:
        share = middle(e) / F.col("target")
        at = demand_inverse(share, schedules[-1])
        for k in range(len(schedules) - 1):
            at = F.when(F.col("kind") % len(schedules) == k, demand_inverse(share, schedules[k])).otherwise(at)
        return at

    # the demand is met at time 1: copies that would come then or later are not asked for
    times = F.when((F.col("size") > 0) & (F.col("target") > 0), F.filter(F.transform(passes, position), lambda t: t < 1))
    return full.withColumn("positions", F.coalesce(times, F.array().cast("array<double>"))).select(
        "doc_id",
        F.when(~F.col("no_source"), F.col("src")).alias("source"),
        "text_hash",
        "size",
        "source_size",
        "target",
        F.size("positions").alias("copies"),
        (F.size("positions") * F.col("size")).alias("taken"),
        "positions",
        "draw",
    )


def training_places(mixed: DataFrame) -> DataFrame:
    """``mixed`` with ``first_at`` and ``last_at``, a document's first and last time in billionths, and
    ``first_place``, how many copies are read before its first; null where none is taken.

    Copies are range-sorted by time; copies of one billionth stand in order of source,
    draw, size and text.
    """
    rows = mixed.withColumn("_times", F.transform("positions", lambda t: F.floor(t * 1_000_000_000)))
    rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "mixed")
    order = [F.col("source").isNull().alias("_none"), "source", "draw", "size", "text_hash", "_row"]
    copies = rows.select(F.explode("_times").alias("_at"), F.lit(1).alias("_one"), *order)
    placed = running_total(copies, [], ["_at", "_none", "source", "draw", "size", "text_hash", "_row"], "_one", "_place")
    first = placed.groupBy("_row").agg(F.min("_place").alias("first_place"))
    times = F.array_min("_times").alias("first_at"), F.array_max("_times").alias("last_at")
    return rows.join(first, "_row", "left").select(*mixed.columns, *times, "first_place")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each once per copy, range-sorted by training time."""
    columns = docs.columns
    plan = mix(docs, **options).withColumn("_src", F.col("source")).select("doc_id", "_src", "text_hash", "positions")
    keyed = docs.select(
        F.col("doc_id").alias("_id"),
        F.col("source").alias("_from"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"),
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"),
    )
    nth = lambda *c: F.row_number().over(W.partitionBy(*c).orderBy(F.lit(0)))
    plan = plan.filter(F.size("positions") > 0).withColumn("_n", nth("doc_id", "_src", "text_hash"))
    keyed = keyed.withColumn("_m", nth("_id", "_from", "_hash"))
    same = (
        F.col("_id").eqNullSafe(F.col("doc_id"))
        & F.col("_from").eqNullSafe(F.col("_src"))
        & (F.col("_hash") == F.col("text_hash"))
        & (F.col("_m") == F.col("_n"))
    )
    copies = keyed.join(plan, same).select("_row", F.explode("positions").alias("_at"))
    return copies.repartitionByRange("_at").sortWithinPartitions("_at").select("_row.*")
