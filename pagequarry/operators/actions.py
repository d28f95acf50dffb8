"""Compacting recorded action logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan


def compact(log: DataFrame, session: str, order: list[str], chunk: Column | None = None) -> DataFrame:
    """Drop fills overwritten by the next action and repeats of the same goto.

    ``log`` has ``action, selector, url``. Of consecutive fills of one selector the
    last stays, of consecutive gotos to one URL the first. The log is dealt by sampled
    ranges, or by ``chunk``, if it is known to cut the order into even pieces.
    """
    this = F.struct("action", "selector", "url")
    log = scan.with_neighbours(log, [session], order, chunk, this)
    overwritten = (
        (F.col("action") == "fill")
        & (F.col("next.action") == "fill")
        & F.col("next.selector").eqNullSafe(F.col("selector"))
    )
    repeated = (
        (F.col("action") == "goto")
        & (F.col("prev.action") == "goto")
        & F.col("prev.url").eqNullSafe(F.col("url"))
    )
    kept = ~F.coalesce(overwritten, F.lit(False)) & ~F.coalesce(repeated, F.lit(False))
    return log.where(kept).drop("prev", "next")
