"""What staged tables leave behind, and how inputs are dealt out."""

from pathlib import Path

from pyspark.sql import functions as F

from pagequarry.session import scatter, stage


def shuffle_files(spark):
    root = Path(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()[0])
    return {str(p) for p in root.rglob("shuffle_*.data")}


def test_a_staged_table_leaves_no_shuffle_files(spark):
    import time

    before = shuffle_files(spark)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    counted = stage(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "counted")
    assert counted.count() == 10 and spark.conf.get(key) == setting
    for _ in range(50):
        left = shuffle_files(spark) - before
        if len(left) <= 1:  # of the count itself
            break
        time.sleep(0.1)
    assert len(left) <= 1


def test_pages_of_one_split_are_dealt_before_they_are_parsed(spark):
    pages = spark.range(64).selectExpr("nullif(id % 2, 1) as page_id", "concat('<p>', id, '</p>') as html").coalesce(1)
    before = spark.conf.get("spark.pagequarry.partitions", None)
    spark.conf.unset("spark.pagequarry.partitions")
    try:
        dealt = scatter(pages)
        assert dealt.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        # rows without an id are spread as well
        assert dealt.where("page_id is null").select(F.spark_partition_id()).distinct().count() > 1
        assert sorted(r.html for r in dealt.collect()) == sorted(r.html for r in pages.collect())
        spark.conf.set("spark.pagequarry.partitions", "0")
        assert scatter(pages).rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.pagequarry.partitions")
        if before is not None:
            spark.conf.set("spark.pagequarry.partitions", before)
