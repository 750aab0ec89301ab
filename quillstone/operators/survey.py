"""What a page is asked about at once: which form it is, how well the forms fit it, and what may be asked on it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import html
from .live import live_fields, page_errors
from .panel import detected, page_scores
from .provider import Provider, mapped
from .tables import written


class Survey(NamedTuple):
    """pages: page, host, form, how, fields, error. scores: a row a page and form, counts alone. fields: the questions as a form of their own."""

    pages: DataFrame
    scores: DataFrame
    fields: DataFrame


def survey(pages: DataFrame, forms: DataFrame, fields: DataFrame, parts: int | None = None) -> Survey:
    """Surveys pages (page_id, url, html). forms: form, form_ord, hosts. fields: form, field, field_ord, label, step.

    Only controls that can be written and are shown count; no value of a page leaves it. Pages of one host that show the same labels in the same
    order are of one kind, and a kind is scored once. Its key is a hash, which doesn't compress: tables of page numbers do, so that Spark takes
    millions of their rows for a few and sends them to all executors through the driver.
    """
    shown = F.filter("controls", lambda c: c["visible"] & ~c["disabled"] & ~c["read_only"])
    dump = html.dumps(pages, parts).withColumn("labels", F.transform(shown, lambda c: c["label"]))
    dump = written(dump.withColumn("kind", F.sha2(F.to_json(F.struct("host", "labels")), 256)), "dumps")  # pages are parsed once
    kinds = written(dump.select(F.col("kind").alias("page"), "host", "labels").distinct(), "kinds")
    labels = kinds.select("page", F.posexplode("labels").alias("ord", "label"))
    scores = written(page_scores(fields, labels.select("page", F.col("ord").alias("control"), F.col("ord").alias("control_ord"), "label")), "scores")
    heads = kinds.select("page").join(detected(kinds.select("page", "host"), forms, scores), "page", "left").join(page_errors(labels), "page", "left")
    heads = heads.select(F.col("page").alias("kind"), "form", "how", F.coalesce("n_fields", F.lit(0)).cast("long").alias("fields"), F.when(F.col("n_fields").isNull(), "no labelled fields").otherwise(F.col("error")).alias("error"))
    page = dump.select(F.col("page_id").alias("page"), "host", "kind")
    c = dump.select(F.col("page_id").alias("page"), F.posexplode("controls").alias("ord", "c")).select("page", "ord", "c.*")
    live = c.filter("visible AND NOT disabled AND NOT read_only")
    asked = live.select("page", "ord", "label", "type", F.col("options.values").alias("options"), F.lit("").alias("description"), "instance")
    own = page.select("page", "kind").join(scores.withColumnRenamed("page", "kind"), "kind").drop("kind")
    return Survey(page.join(written(heads, "heads"), "kind").drop("kind"), own, live_fields(asked))


def mapped_live(notes: DataFrame, fields: DataFrame, provider: Provider, records: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(review rows, errors) of notes (key, page, redacted_text) on the questions of a page as survey gives them."""
    own = fields.withColumnRenamed("page", "form").drop("label")
    claims = notes.select("key", F.col("page").alias("form"), "redacted_text")
    return mapped(claims, own, provider, records)
