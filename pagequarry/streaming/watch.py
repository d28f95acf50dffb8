"""Extraction over newly captured pages as a Structured Streaming job."""

from __future__ import annotations

import traceback
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import stage
from ..sources.store import CaptureStore

PAGE_SCHEMA = "page_id bigint, url string, html string"


def captures(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = PAGE_SCHEMA, **options) -> DataFrame:
    """A stream of the pages landing in ``path``."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def fresh(stream: DataFrame, fetched_at: str = "fetched_at", keep: str = "1 day") -> DataFrame:
    """Drop repeats of one capture; state is held for ``keep`` only.

    A capture that comes later than ``keep`` is dropped too; ``dropped_late`` counts those
    of the stream's last updates. :func:`newest` drops none.
    """
    return stream.withWatermark(fetched_at, keep).dropDuplicatesWithinWatermark(["url", fetched_at])


FOUND = "url string, page_id long, fetched_at timestamp, batch long"


def _known(spark: SparkSession, out: str, number: int, keep: str) -> DataFrame | None:
    """``_url, _best``: the newest capture of each URL that the batches before ``number`` wrote within ``keep``."""
    try:
        found = spark.read.schema(FOUND).parquet(f"{out}/newest")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    lately = F.col("_metadata.file_modification_time") >= F.current_timestamp() - F.expr(f"interval {keep}")
    return found.where((F.col("batch") < number) & lately).groupBy(F.col("url").alias("_url")).agg(F.max(_age()).alias("_best"))


def newest(stream: DataFrame, out: str, checkpoint: str, keep: str = "1 day") -> StreamingQuery:
    """The streaming form of ``latest_snapshots``: what is new and what is late, batch by batch.

    ``stream`` holds ``page_id, url, fetched_at``; only these are kept. ``out/newest/batch=N``
    gets the captures that are the newest known of their URL when they come in,
    ``out/late/batch=N`` those that came after a newer one; :func:`newest_now` and
    :func:`late` read both. What is known is what earlier batches wrote to ``newest``, joined
    with each batch by URL; files written over ``keep`` of wall time ago are forgotten, which
    changes neither. No capture is dropped for its time. Captures
    beaten within their own batch are in neither table. A capture without a time is older
    than any other; those without a URL are captures of one URL. Pages are fetched by id,
    with ``pages_for``.
    """
    narrow = stream.select(
        F.col("page_id").cast("long").alias("page_id"), "url",
        F.coalesce(F.col("fetched_at").cast("timestamp"), F.lit(0).cast("timestamp")).alias("fetched_at"),
    )

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = _known(spark, out, number, keep)
        if known is None:
            marked = batch.withColumn("_late", F.lit(False))
        else:
            marked = batch.join(known, F.col("url").eqNullSafe(F.col("_url")), "left")
            marked = marked.withColumn("_late", F.coalesce(_age() <= F.col("_best"), F.lit(False))).drop("_url", "_best")
        marked = stage(marked, "captures")
        kept = marked.where(~F.col("_late")).groupBy("url").agg(F.max_by(F.struct("page_id", "fetched_at"), _age()).alias("b"))
        for kind, rows in (("newest", kept.select("url", "b.*")), ("late", marked.where("_late").select("url", "page_id", "fetched_at"))):
            rows.write.mode("overwrite").parquet(f"{out}/{kind}/batch={number}")

    writer = narrow.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


def _age():
    return F.struct("fetched_at", (-F.col("page_id")).alias("id"))


def newest_now(spark: SparkSession, out: str) -> DataFrame:
    """``url, page_id, fetched_at``: the newest capture of every URL so far."""
    best = F.max_by(F.struct("page_id", "fetched_at"), _age()).alias("b")
    return spark.read.parquet(f"{out}/newest").groupBy("url").agg(best).select("url", "b.*")


def late(spark: SparkSession, out: str) -> DataFrame:
    """``url, page_id, fetched_at, batch`` of every capture that came after a newer one.

    One whose URL had been forgotten meanwhile stands among the newest, behind the newer one
    of an earlier batch.
    """
    before = Window.partitionBy("url").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    stood = spark.read.parquet(f"{out}/newest").withColumn("_best", F.max(_age()).over(before))
    beaten = stood.where(F.coalesce(_age() <= F.col("_best"), F.lit(False))).drop("_best")
    return spark.read.parquet(f"{out}/late").unionByName(beaten)


def retries(spark: SparkSession, out: str) -> DataFrame:
    """The pages of all batches that failed under ``out``, with their ``batch``."""
    return spark.read.parquet(f"{out}/retry")


def dropped_late(query: StreamingQuery) -> int:
    """How many captures ``fresh`` has dropped for coming later than it keeps state."""
    operators = [op for progress in query.recentProgress for op in progress["stateOperators"]]
    return sum(op.get("numRowsDroppedByWatermark", 0) for op in operators)


def watch(
    stream: DataFrame,
    extract: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    every: str | None = None,
    fail_fast: bool = True,
    store: CaptureStore | None = None,
) -> StreamingQuery:
    """Run ``extract`` on each batch of new pages and write its rows under ``out``.

    With ``every`` ("30 seconds") the query keeps running; without, it takes what is
    new and stops, for an outside schedule to start. The checkpoint remembers what was
    taken. Rows go to ``out/rows/batch=N`` and counts to ``out/metrics/batch=N``; both
    are overwritten when a batch is retried, so each batch counts once. A batch that
    fails ends the query, and the next start takes it again. Without ``fail_fast`` the
    query goes on: the failed batch's pages are kept whole in ``out/retry/batch=N``, to
    be read by ``retries``, and the error is recorded in the metrics. With a ``store`` each
    batch's captures, and the links to next pages they hold, are added to it first.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows, error = None, None
        try:
            if store:
                store.add(batch)
            written = Observation()
            result = extract(batch).observe(written, F.count(F.lit(1)).alias("rows"))
            result.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
            rows = written.get["rows"]
        except Exception as exc:  # noqa: BLE001 - recorded, and the next batch runs
            if fail_fast:
                raise
            error = "".join(traceback.format_exception_only(exc)).strip()
            kept = f"{out}/retry/batch={number}"
            batch.write.mode("overwrite").parquet(kept)
        # the ids are read again rather than whole pages kept
        record = [(number, batch.select("page_id").count(), rows, error)]
        spark.createDataFrame(
            record, "batch_id bigint, pages bigint, rows bigint, error string"
        ).write.mode("overwrite").parquet(f"{out}/metrics/batch={number}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()
