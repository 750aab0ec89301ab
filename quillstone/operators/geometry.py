"""Boxes of forms: nearest text, sane boxes, refusals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


LEFT, ABOVE = 260, 40
EDGE, LEAST_W, LEAST_H, MOST_AREA = 0.02, 0.01, 0.004, 0.25


def _line(h: Column) -> Column:
    """How far from a box's middle its line reaches."""
    return 1.4 * F.greatest(h, F.lit(8.0))


def _strips(lo: Column, hi: Column, size: Column | float) -> Column:
    """Numbers of the strips of a size that a range touches."""
    return F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))


def nearest_text(widgets: DataFrame, runs: DataFrame, most: int = 4) -> DataFrame:
    """(page, widget, rank, text): text left on the line before text above, the nearest first, each text once.

    widgets: page, widget, x, y (top), h. runs: page, text, tx, ty and, to break ties, tord. A line is as far from the box's
    middle as 1.4 of its height, or of 8 points; what begins left on it, however far, is never above.

    Boxes and text meet in the cells of a grid, LEFT wide and ABOVE high, or a power of two times as high for boxes whose line is: a box asks the
    few cells that its line and the place above it touch, a text stands in one cell of each height that its page's boxes have. Boxes of one place and
    height are one when they ask, and of different texts at one place only the first `most` can be among a box's.
    """
    runs = runs if "tord" in runs.columns else runs.withColumn("tord", F.lit(0))
    spot = W.partitionBy("page", "tx", "ty").orderBy("tord", "text")
    runs = runs.groupBy("page", "tx", "ty", "text").agg(F.min("tord").alias("tord")).withColumn("_n", F.row_number().over(spot)).filter(F.col("_n") <= most).drop("_n")
    own, widgets = widgets.select("page", "widget", "x", "y", "h"), widgets.select("page", "x", "y", "h").distinct().withColumn("widget", F.struct("x", "y", "h"))
    middle, reach = F.col("y") + F.col("h") / 2, _line(F.col("h"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(2 * reach / ABOVE))).cast("int")
    tall = F.pow(F.lit(2.0), F.col("level")) * ABOVE
    asks = widgets.filter("x IS NOT NULL AND y IS NOT NULL AND h IS NOT NULL").withColumn("level", level)
    asks = asks.withColumn("i", F.explode(_strips(F.col("x") - LEFT, F.col("x") + LEFT, LEFT)))
    asks = asks.withColumn("j", F.explode(_strips(F.least(F.col("y") - ABOVE, middle - reach), F.greatest(F.col("y"), middle + reach), tall)))
    levels = asks.select("page", "level").distinct()
    stands = runs.join(levels, "page").withColumns({"i": F.floor(F.col("tx") / LEFT).cast("long"), "j": F.floor(F.col("ty") / tall).cast("long")})
    j = asks.join(stands, ["page", "level", "i", "j"])
    left, above = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    line = (F.abs(F.col("ty") - F.col("y") - F.col("h") / 2) < _line(F.col("h"))) & (left > 0)
    place = F.when(line, F.when(left <= LEFT, 0)).when((above > 0) & (above <= ABOVE) & (F.abs(left) <= LEFT), 1)
    near = j.withColumn("place", place).filter("place IS NOT NULL").withColumn("gap", F.when(F.col("place") == 0, left).otherwise(above))
    once = near.groupBy("page", "widget", "text").agg(F.min(F.struct("place", "gap", "tord")).alias("b"))
    w = W.partitionBy("page", "widget").orderBy("b.place", "b.gap", "b.tord", "text")
    got = once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return own.join(got.select("page", "widget.*", "rank", "text"), ["page", "x", "y", "h"]).select("page", "widget", "rank", "text")


def sane_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Fractions of a page as a box in points, or null: finite, begun on the page, over its far edge by 0.02 at most, not too small, not a section."""
    finite = F.forall(F.array(x, y, w, h), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    on = (x >= 0) & (y >= 0) & (x < 1) & (y < 1) & (x + w <= 1 + EDGE) & (y + h <= 1 + EDGE) & (w > 0) & (h > 0)
    cw, ch = F.least(w, 1 - x), F.least(h, 1 - y)
    ok = finite & on & (cw >= LEAST_W) & (ch >= LEAST_H) & (cw * ch <= MOST_AREA)
    return F.when(ok, F.struct((x * width).alias("x"), (y * height).alias("y"), (cw * width).alias("w"), (ch * height).alias("h")))


def flipped(x0: Column, y0: Column, x1: Column, y1: Column, height: Column) -> Column:
    """A rectangle by two corners from the page's bottom as a box from its top: x, y, w, h."""
    left, top = F.least(x0, x1), F.greatest(y0, y1)
    return F.struct(left.alias("x"), (height - top).alias("y"), F.abs(x1 - x0).alias("w"), F.abs(y1 - y0).alias("h"))


def zoom(width: Column, height: Column, edge: float = 1500.0) -> Column:
    """How much a page is enlarged so that its long edge has so many pixels."""
    return F.lit(edge) / F.greatest(width, height)


def has_text(chars: Column, pages: Column) -> Column:
    """Whether a file's text is more than a scan's: 20 characters a page."""
    return chars >= 40 * F.greatest(pages, F.lit(1)) / 2


def has_answer(value: Column) -> Column:
    """Whether a form field's value is one: neither blank nor the name of an unticked box."""
    return F.coalesce(~F.trim(value).isin("", "/Off"), F.lit(False))


def refusal(encrypted: Column, pages: Column, fillable: Column, has_text: Column, can_render: bool = False) -> Column:
    """Why a form can't be taken in, or null: the first reason in this order that holds."""
    return (
        F.when(encrypted, "encrypted")
        .when(pages == 0, "no pages")
        .when(fillable | F.lit(can_render), None)
        .when(~has_text, "scan")
        .otherwise("nowhere to write")
    )
