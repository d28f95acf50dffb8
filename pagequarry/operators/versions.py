"""Outputs that are replaced as a whole: versions in folders of their own, and a manifest last.

``<path>/versions/<id>`` holds the parts of one version (the rows, the quality report, the
provenance, the visited URLs, the pages that failed), each written by Spark. Only when all
of them stand does ``<path>/manifests/<number>-<id>`` name them, in one small file that the
job's commit puts in place. Readers follow the highest manifest, so a run that breaks off
anywhere leaves the version before it whole, and a reader never sees parts of two.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "number long, id string, format string, parts map<string,string>, created string"


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """All versions that were completed, one row each."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifests/*")
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in (exc.getCondition() or ""):
            raise
        return spark.createDataFrame([], MANIFEST)


def current(spark: SparkSession, path: str):
    """The manifest of the version that counts, or None before the first."""
    return manifests(spark, path).orderBy(F.desc("number"), F.desc("created"), "id").first()


def publish(spark: SparkSession, path: str, fmt: str, parts: dict[str, Callable[[str], None]]) -> int:
    """Write a version, each part by its function of a folder, and then name it. Its number."""
    last = current(spark, path)
    number, name = (last.number if last else 0) + 1, uuid.uuid4().hex
    folders = {part: f"{path}/versions/{name}/{part}" for part in parts}
    for part, write in parts.items():
        write(folders[part])
    row = [(number, name, fmt, folders, datetime.now(timezone.utc).isoformat())]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.json(f"{path}/manifests/{number:09}-{name}")
    return number


def read_part(spark: SparkSession, path: str, part: str = "rows") -> DataFrame:
    """A part of the version that counts; small reports are JSON, URLs and failed pages Parquet."""
    last = current(spark, path)
    if last is None or part not in last.parts:
        raise LookupError(f"no {part} published under {path}")
    kinds = {"rows": last.format, "quality": "json", "provenance": "json"}
    kind = kinds.get(part, "parquet")
    reader = spark.read.options(header=True, escape='"', multiLine=kind == "csv")
    return reader.format("json" if kind == "jsonl" else kind).load(last.parts[part])
