"""Page inventories captured step by step, merged into one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merged(controls: DataFrame) -> DataFrame:
    """One row per control of a form, with ref c1, c2, ... in the order of first sight.

    controls: form, dump (order of the captures), ord, step, name, id, selector, visible and any others. A control's
    key is its name, else id, else selector. Its first capture counts, or its first visible one if that is hidden.
    """
    key = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("name", "id", "selector")], F.lit(""))
    row = F.struct(*[F.col(c) for c in controls.columns])
    seq = F.struct("dump", "ord")
    hidden = ~F.coalesce("visible", F.lit(False))
    one = controls.groupBy("form", key.alias("_key")).agg(F.min_by(row, F.struct(hidden, seq)).alias("_row"), F.min(seq).alias("_first"))
    ref = F.concat(F.lit("c"), F.row_number().over(W.partitionBy("form").orderBy("_first")).cast("string"))
    return one.select("_row.*", ref.alias("ref"))


def counters(dumps: DataFrame) -> DataFrame:
    """Per form: password fields left out and strings scrubbed, over its captures. dumps: form, skipped, scrubbed."""
    return dumps.groupBy("form").agg(F.sum("skipped").alias("skipped"), F.sum("scrubbed").alias("scrubbed"))
