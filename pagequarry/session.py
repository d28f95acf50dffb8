"""Session helpers: shared scratch space and dealing out inputs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def builder(
    master: str | None = None, shuffle_partitions: int | None = None, input_partitions: int | None = None
):
    """A session builder with the settings the operators assume (UTC, AQE).

    ``input_partitions`` deals small inputs over so many tasks before they are parsed.
    """
    b = (
        SparkSession.builder.appName("pagequarry")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        # Call sites per column cost a round trip each; plans here hold thousands.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        b = b.master(master)
    if input_partitions:
        b = b.config("spark.pagequarry.partitions", str(input_partitions))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    A local master may run without it and gets a temporary folder; on a cluster
    the setting is required, since a machine-local folder would not be shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="pagequarry-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files behind: nobody reads those of a written table again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once under the shared folder and read it back.

    Used where a result feeds a loop or several consumers: it cuts the lineage,
    survives lost executors, and later readers prune columns in the scan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_counted(df: DataFrame, name: str = "stage") -> tuple[DataFrame, int]:
    """``stage``, and the number of rows, counted while they are written."""
    seen = Observation()
    staged = stage(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return staged, seen.get["n"]


def scatter(df: DataFrame) -> DataFrame:
    """Narrow ``df`` dealt over the partitions asked for in ``spark.pagequarry.partitions``.

    Unset, over as many as node rows go to: a file of one row group, or a few splits of
    megabytes, would else be parsed by as few tasks. 0 leaves the rows where they are.
    """
    spark = df.sparkSession
    fixed = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = int(spark.conf.get("spark.pagequarry.partitions", None) or fixed)
    # By a hash of all that a row holds: nothing is sorted, and rows without an id don't meet.
    return df.repartition(n, F.xxhash64(*df.columns)) if n else df


def semi_join(rows: DataFrame, keys: DataFrame, on: str | list[str], fits: int | None = None) -> DataFrame:
    """The ``rows`` whose key is among ``keys``.

    Up to ``fits`` keys, counted first, are sent to every task, so that wide rows such as
    whole pages stay where they are; more keys are joined by a shuffle. By default a
    million whole numbers fit, or 100,000 keys of another kind.
    """
    keys = keys.select(on).distinct()
    if fits is None:
        fits = 1_000_000 if all(isinstance(f.dataType, IntegralType) for f in keys.schema) else 100_000
    few = keys.limit(fits + 1).count() <= fits
    return rows.join(F.broadcast(keys) if few else keys, on, "left_semi")
