"""Uploaded files as tables of pages, text runs and boxes. What reads a file's bytes is given: no reader of PDFs is built in."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.geometry import flipped, has_answer, has_text, nearest_text, refusal

#: bytes -> {"encrypted": bool, "pages": [{"width", "height", "text", "runs": [{"x", "y", "text"}], "boxes": [{"name", "kind", "x0", "y0", "x1", "y1", "states", "value"}]}]}; y from the bottom.
Reader = Callable[[bytes], dict]
RUN = pa.struct([("x", pa.float64()), ("y", pa.float64()), ("text", pa.string())])
BOX = pa.struct([("name", pa.string()), ("kind", pa.string()), *((c, pa.float64()) for c in ("x0", "y0", "x1", "y1")), ("states", pa.list_(pa.string())), ("value", pa.string())])
PAGE = pa.struct([("width", pa.float64()), ("height", pa.float64()), ("text", pa.string()), ("runs", pa.list_(RUN)), ("boxes", pa.list_(BOX))])
FILE = pa.struct([("encrypted", pa.bool_()), ("pages", pa.list_(PAGE)), ("error", pa.string())])
BOX_DDL = "struct<name:string,kind:string,x0:double,y0:double,x1:double,y1:double,states:array<string>,value:string>"
FILE_DDL = f"encrypted boolean, pages array<struct<width:double,height:double,text:string,runs:array<struct<x:double,y:double,text:string>>,boxes:array<{BOX_DDL}>>>, error string"


class ReaderMissing(RuntimeError):
    """Nothing was given that reads the bytes of files."""


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of a folder."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def opened(files: DataFrame, reader: Reader | None) -> DataFrame:
    """files (file, content) with encrypted, pages and error; a file that the reader fails on is `not readable`, and nothing of it is named."""
    if reader is None:
        raise ReaderMissing("give a reader of files: there is none here")

    def one(content: bytes | None) -> dict:
        try:
            got = reader(content)
            return {"encrypted": bool(got.get("encrypted")), "pages": [] if got.get("encrypted") else got["pages"], "error": None}
        except Exception:  # whatever a reader does on bytes that aren't its kind
            return {"encrypted": False, "pages": [], "error": "not readable"}

    def run(content: pa.Array) -> pa.Array:
        return pa.array([one(x.as_py()) for x in content], FILE)

    return files.select("file", F.arrow_udf(run, FILE_DDL)("content").alias("f")).select("file", "f.*")


def _pages(open_: DataFrame) -> DataFrame:
    return open_.select("file", F.posexplode("pages").alias("page", "p")).select("file", (F.col("page") + 1).alias("page"), "p.*")


def probes(open_: DataFrame, can_render: bool = False) -> DataFrame:
    """(file, pages, boxes, text_chars, filled, refusal): what each file is, and why it can't be taken in."""
    every = lambda c: F.flatten(F.transform("pages", lambda p: F.coalesce(p[c], F.array().cast(f"array<{BOX_DDL}>"))))
    own: dict[str, Column] = {"n": F.size("pages"), "boxes": F.size(every("boxes")), "text_chars": F.aggregate(F.transform("pages", lambda p: F.length(F.trim(F.coalesce(p["text"], F.lit(""))))), F.lit(0), lambda a, x: a + x), "filled": F.exists(every("boxes"), lambda b: has_answer(b["value"]))}
    p = open_.select("file", "error", "encrypted", *[c.alias(k) for k, c in own.items()])
    why = F.coalesce("error", refusal(F.col("encrypted"), F.col("n"), F.col("boxes") > 0, has_text(F.col("text_chars"), F.col("n")), can_render))
    return p.select("file", F.col("n").alias("pages"), "boxes", "text_chars", "filled", why.alias("refusal"))


def page_texts(open_: DataFrame) -> DataFrame:
    """(file, page, text), as provider.note_text and intake.page_prompts take them."""
    return _pages(open_).select("file", "page", "text")


def runs(open_: DataFrame) -> DataFrame:
    """(file, page, ord, x, y, text) of non-blank runs of text, blanks squashed, y from the top."""
    r = _pages(open_).select("file", "page", "height", F.posexplode("runs").alias("ord", "r"))
    text = F.trim(F.regexp_replace("r.text", r"(?U)\s+", " "))
    return r.select("file", "page", "ord", F.col("r.x").alias("x"), (F.col("height") - F.col("r.y")).alias("y"), text.alias("text")).filter("text <> ''")


def boxes(open_: DataFrame) -> DataFrame:
    """(file, page, ord, name, kind, box, states, value): a file's own fields, boxes from the top, states other than off."""
    b = _pages(open_).select("file", "page", "height", F.posexplode("boxes").alias("ord", "b"))
    box = flipped(F.col("b.x0"), F.col("b.y0"), F.col("b.x1"), F.col("b.y1"), F.col("height"))
    return b.select("file", "page", "ord", "b.name", "b.kind", box.alias("box"), F.filter(F.coalesce("b.states", F.array().cast("array<string>")), lambda s: s != "/Off").alias("states"), "b.value")


def widgets(open_: DataFrame) -> DataFrame:
    """The boxes with nearby: at most four texts that stand near enough to name them, the nearest first."""
    b = boxes(open_).withColumn("page_", F.struct("file", "page"))
    near = nearest_text(b.select(F.col("page_").alias("page"), F.col("ord").alias("widget"), "box.x", "box.y", "box.h"), runs(open_).select(F.struct("file", "page").alias("page"), "text", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("ord").alias("tord")))
    w = W.partitionBy("page", "widget").orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    named = near.withColumn("nearby", F.collect_list("text").over(w)).filter("rank = 1").select(F.col("page").alias("page_"), F.col("widget").alias("ord"), "nearby")  # at most four
    j = b.join(named, ["page_", "ord"], "left")
    return j.select("file", "page", "ord", "name", "kind", "box", "states", "value", F.coalesce("nearby", F.array().cast("array<string>")).alias("nearby"))
