"""Streams: notes are scrubbed as they come; pages announce a change of shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.redact import scrub_patterns


def scrubbed(notes: DataFrame) -> DataFrame:
    """Works on a batch or a stream alike, in append mode: no state between notes."""
    return notes.withColumn("redacted_text", scrub_patterns(F.col("text")))


def quiet(events: DataFrame, key: str, at: str, order: list[str], seconds: float) -> DataFrame:
    """The events of a key after which none follows for so many seconds: where a debounced rule would run."""
    w = W.partitionBy(key).orderBy(at, *order)
    gap = F.timestamp_diff("MICROSECOND", F.col(at), F.lead(F.col(at)).over(w))
    return events.withColumn("_gap", gap).filter(F.col("_gap").isNull() | (F.col("_gap") >= int(seconds * 1e6))).drop("_gap")


def changes(events: DataFrame, key: str, order: list[str], signature: Column) -> DataFrame:
    """The rows at which a key's signature differs from the one before; the first counts as a change."""
    w = W.partitionBy(key).orderBy(*order)
    marked = events.withColumn("_sig", signature).withColumn("_was", F.lag("_sig").over(w))
    return marked.filter(~F.col("_sig").eqNullSafe(F.col("_was"))).drop("_sig", "_was")
