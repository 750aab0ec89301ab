"""Forms from uploaded files: what a reader of pages said about their boxes becomes fields. The reading itself is a provider's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .geometry import sane_box
from .live import sources, with_ids

BOX_REPLY = "struct<boxes:array<struct<ref:string,label:string,description:string,type:string,options:array<string>,include:boolean>>>"
PAGE_REPLY = "struct<fields:array<struct<label:string,description:string,type:string,options:array<string>,x:double,y:double,w:double,h:double>>>"
MOST_PAGES = 12
TYPES = ("text", "date", "checkbox")


def pages_of(widgets: DataFrame) -> DataFrame:
    """Adds ref (b0, b1, ... on each page) to widgets: form, page, ord, name, kind, states, nearby."""
    return widgets.withColumn("ref", F.concat(F.lit("b"), (F.row_number().over(W.partitionBy("form", "page").orderBy("ord")) - 1).cast("string")))


def page_prompts(widgets: DataFrame, page_text: DataFrame) -> DataFrame:
    """(form, page, prompt): a page's printed text and its boxes, as the reader of pages is asked."""
    kind = F.when(F.col("kind") == "/Btn", "checkbox").when(F.col("kind") == "/Ch", "choice").otherwise("text")
    states = F.when(F.size("states") > 0, F.concat(F.lit(' accepts="'), F.array_join("states", " | "), F.lit('"'))).otherwise("")
    line = F.concat(F.lit('<box ref="'), "ref", F.lit('" pdf_name="'), "name", F.lit('" type="'), kind, F.lit('" nearby="'), F.array_join("nearby", " | "), F.lit('"'), states, F.lit(" />"))
    boxes = pages_of(widgets).withColumn("line", line).groupBy("form", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("lines"))  # a page's own boxes
    j = boxes.join(page_text.select("form", "page", "text"), ["form", "page"], "left")
    prompt = F.concat_ws("\n", F.concat(F.lit('<page number="'), F.col("page").cast("string"), F.lit('">')), F.lit("<printed_text>"), F.coalesce("text", F.lit("")), F.lit("</printed_text>"), F.lit("<boxes>"), F.col("lines"), F.lit("</boxes>"), F.lit("</page>"))
    return j.select("form", "page", prompt.alias("prompt"))


def picture_prompts(pictures: DataFrame) -> DataFrame:
    """(form, page, prompt) of pictures of pages (form, page, picture as bytes): which questions stand where? Of a form, the first MOST_PAGES."""
    ask = F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" of a form. Give each question with its box as fractions of the page.\n<picture>\n"), F.base64("picture"), F.lit("\n</picture>"))
    return pictures.filter((F.col("page") <= MOST_PAGES) & F.col("picture").isNotNull()).select("form", "page", ask.alias("prompt"))


def _replies(prompts: DataFrame, provider: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(form, page, reply) of a provider to prompts (form, page, prompt); a page that gets none is left out, not fatal."""
    key = F.to_json(F.struct(F.col("form").cast("string").alias("form"), "page"))
    said = provider(prompts.select(key.alias("key"), "prompt"))
    back = prompts.select(key.alias("key"), "form", "page")
    return said.filter("reply IS NOT NULL").join(back, "key").select("form", "page", "reply")


def read_boxes(widgets: DataFrame, page_text: DataFrame, provider: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The boxes of forms as a provider describes them, in the order of pages and boxes whatever the order of replies."""
    return described_boxes(widgets, _replies(page_prompts(widgets, page_text), provider))


def read_pictures(pages: DataFrame, pictures: DataFrame, provider: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The questions of forms without boxes as a provider sees them in pictures of their pages."""
    return described_pages(pages, _replies(picture_prompts(pictures), provider))


def _options(kind: Column, options: Column) -> Column:
    """A tick box has none; blank ones go."""
    none = F.array().cast("array<string>")
    return F.when(kind == "checkbox", none).otherwise(F.filter(F.coalesce(options, none), lambda o: F.trim(o) != ""))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ord, id and source; rows: form, label, ..."""
    s = sources(rows.withColumn("page_", F.col("page")).withColumn("page", F.col("form")).select(*rows.columns, "page_")).drop("page").withColumnRenamed("page_", "page")
    placed = s.withColumn("ord", F.row_number().over(W.partitionBy("form").orderBy(*order)) - 1)
    return with_ids(placed, "form", "ord")


def described_boxes(widgets: DataFrame, replies: DataFrame) -> DataFrame:
    """(form, ord, id, pdf_field_name, type, source, label, description, options): the boxes that the replies include under a label, in the order of pages and boxes.

    replies: form, page, reply. Of two entries for one box the first counts; unreadable replies leave their page out. The file says what is
    a tick box: no other box becomes one, whatever the reply says.
    """
    w = pages_of(widgets)
    said = replies.select("form", "page", F.from_json("reply", BOX_REPLY).alias("r")).select("form", "page", F.posexplode("r.boxes").alias("n", "b")).select("form", "page", "n", "b.*").filter("ref IS NOT NULL")
    said = said.groupBy("form", "page", "ref").agg(F.min_by(F.struct("label", "description", "type", "options", "include"), "n").alias("a")).select("form", "page", "ref", "a.*")
    j = w.join(said, ["form", "page", "ref"]).filter(F.coalesce("include", F.lit(False)) & (F.trim("label") != ""))
    told = F.when(F.col("type").isin(*TYPES), F.col("type")).otherwise("text")
    kind = F.when(F.col("kind") == "/Btn", "checkbox").when(told == "checkbox", "text").otherwise(told)
    rows = j.select("form", "page", F.col("ord").alias("box_ord"), F.col("name").alias("pdf_field_name"), kind.alias("type"), F.trim("label").alias("label"), F.nullif(F.trim("description"), F.lit("")).alias("description"), "options")
    return _numbered(rows, ["page", "box_ord"]).withColumn("options", _options(F.col("type"), F.col("options"))).select("form", "ord", "id", "pdf_field_name", "type", "source", "label", "description", "options")


def described_pages(pages: DataFrame, replies: DataFrame) -> DataFrame:
    """(form, ord, id, box, type, source, label, description, options) of forms without boxes of their own, from replies about pictures of their first 12 pages.

    pages: form, page, width, height (points). replies: form, page, reply. Entries without a label or with a box that can't be are left out.
    """
    said = replies.filter(F.col("page") <= MOST_PAGES).select("form", "page", F.from_json("reply", PAGE_REPLY).alias("r")).select("form", "page", F.posexplode("r.fields").alias("n", "b")).select("form", "page", "n", "b.*")
    j = said.filter(F.trim("label") != "").join(pages.select("form", "page", "width", "height"), ["form", "page"])
    box = sane_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("width"), F.col("height"))
    told = F.when(F.col("type").isin(*TYPES), F.col("type")).otherwise("text")
    rows = j.withColumn("b", box).filter("b IS NOT NULL").select("form", "page", "n", F.struct(F.col("page").alias("page"), "b.*").alias("box"), told.alias("type"), F.trim("label").alias("label"), F.nullif(F.trim("description"), F.lit("")).alias("description"), "options")
    return _numbered(rows, ["page", "n"]).withColumn("options", _options(F.col("type"), F.col("options"))).select("form", "ord", "id", "box", "type", "source", "label", "description", "options")


def _grammar(name: str, item: Column) -> Column:
    return F.to_json(F.struct(F.lit("object").alias("type"), F.struct(F.struct(F.lit("array").alias("type"), item.alias("items")).alias(name)).alias("properties"), F.array(F.lit(name)).alias("required"), F.lit(False).alias("additionalProperties")))


def _item(**properties: Column) -> Column:
    names = list(properties)
    return F.struct(F.lit("object").alias("type"), F.struct(*[c.alias(n) for n, c in properties.items()]).alias("properties"), F.array(*map(F.lit, names)).alias("required"), F.lit(False).alias("additionalProperties"))


def _kind(name: str, among: Column | None = None) -> Column:
    return F.struct(F.lit(name).alias("type")) if among is None else F.struct(F.lit(name).alias("type"), among.alias("enum"))


STRINGS = ("string", "number", "boolean")


def box_grammar(refs: Column) -> Column:
    """What a reply about a page's boxes must look like, as a JSON schema; the refs may be no others."""
    texts = F.struct(F.lit("array").alias("type"), _kind("string").alias("items"))
    return _grammar("boxes", _item(ref=_kind("string", refs), label=_kind("string"), description=_kind("string"), type=_kind("string", F.array(*map(F.lit, TYPES))), options=texts, include=_kind("boolean")))


def page_grammar() -> Column:
    """The same of a reply about a picture of a page: boxes in fractions of it."""
    texts = F.struct(F.lit("array").alias("type"), _kind("string").alias("items"))
    return _grammar("fields", _item(label=_kind("string"), description=_kind("string"), type=_kind("string", F.array(*map(F.lit, TYPES))), options=texts, **{c: _kind("number") for c in "xywh"}))


def answer_grammar(ids: Column) -> Column:
    """What a reply about a form's questions must look like: one shared entry whose id is one of the form's."""
    status = F.array(*map(F.lit, ("extracted", "inferred", "missing")))
    return _grammar("fields", _item(id=_kind("string", ids), value=_kind("string"), status=_kind("string", status), source=_kind("string"), reasoning=_kind("string")))
