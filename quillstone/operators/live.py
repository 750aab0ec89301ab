"""Forms made from the controls of a page as it stands: labels of entries, ids, sources and limits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import slug
from .extract import label_field
from .redact import scrub_patterns

MOST_FIELDS = 50


def entry_label(label: Column, instance: Column) -> Column:
    """The label of a question that is asked once an entry carries the entry's number."""
    return F.when(instance.isNull(), label).otherwise(F.concat(label, F.lit(" (entry "), instance.cast("string"), F.lit(")")))


def field_type(kind: Column) -> Column:
    k = F.lower(kind)
    return F.when(k.isin("checkbox", "radio-group", "checkbox-group"), "checkbox").when(k == "date", "date").otherwise("text")


def sources(controls: DataFrame) -> DataFrame:
    """Adds source: a label's demographic if no other control of the page asks for it and it isn't asked once an entry, else llm.

    controls: page, label and, where questions repeat, instance.
    """
    attr = F.when(F.col("instance").isNull(), label_field(F.col("label"))) if "instance" in controls.columns else label_field(F.col("label"))
    n = F.count("_attr").over(W.partitionBy("page", "_attr"))
    c = controls.withColumn("_attr", attr)
    return c.withColumn("source", F.when(F.col("_attr").isNotNull() & (n == 1), F.concat(F.lit("demographics."), F.col("_attr"))).otherwise("llm")).drop("_attr")


def with_ids(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds id: slugs of labels in order within a group, repeated ones as base_2, base_3, ..., never one that is taken, as text.numbered_slugs gives them.

    Ids of slugs that differ in more than numbers at their end never meet, so these families are numbered by themselves, row by row. What is
    remembered of a slug is the next number: all below it are taken.
    """
    keyed = rows.withColumn("id", slug(F.col("label"))).withColumn("_family", F.regexp_replace("id", "(_[0-9]+)+$", ""))
    keyed = keyed.withColumn("_key", F.to_json(F.struct(F.col(group).alias("g"), "_family")))
    names = [c for c in keyed.columns if c not in ("_family", "_key")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, after = None, {}  # by slug that stands as an id, the next number
        for b in it:
            ids = []
            for key, base in zip(b.column("_key").to_pylist(), b.column("id").to_pylist(), strict=True):
                if key != now:
                    now, after = key, {}

                def taken(x: str) -> bool:
                    head, _, n = x.rpartition("_")
                    return x in after or (n.isdigit() and n[0] != "0" and 2 <= int(n) < after.get(head, 0))

                if taken(base):
                    n = after.get(base, 2)
                    while taken(f"{base}_{n}"):
                        n += 1
                    after[base] = n + 1
                    ids.append(f"{base}_{n}")
                else:
                    after[base] = 2
                    ids.append(base)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()) if c == "id" else b.column(c) for c in names], names=names)

    dealt = keyed.repartition("_key").sortWithinPartitions("_key", *order)
    return dealt.mapInArrow(run, keyed.select(*names).schema)


def page_errors(controls: DataFrame) -> DataFrame:
    """(page, n_fields, error): a page with no label, or with more fields than one call may map, is refused, never cut."""
    g = controls.groupBy("page").agg(F.count_if(F.trim("label") != "").alias("n_fields"))
    return g.withColumn("error", F.when(F.col("n_fields") == 0, "no labelled fields").when(F.col("n_fields") > MOST_FIELDS, "too many fields"))


def live_fields(controls: DataFrame) -> DataFrame:
    """(page, ord, id, type, source, label, description, options) of the pages that page_errors lets pass.

    controls: page, ord, label, type, options, description, instance. Labels, descriptions and options are scrubbed.
    """
    ok = page_errors(controls).filter("error IS NULL").select("page")
    kept = sources(controls).filter(F.trim("label") != "").join(ok, "page", "left_semi")
    entry = entry_label(F.col("label"), F.col("instance"))
    rows = kept.select("page", "ord", entry.alias("label"), field_type(F.col("type")).alias("type"), "source", F.coalesce(F.nullif("description", F.lit("")), "label").alias("description"), "options")
    rows = with_ids(rows, "page", "ord", "label")
    options = F.transform(F.filter(F.coalesce("options", F.array().cast("array<string>")), lambda o: F.trim(o) != ""), scrub_patterns)
    return rows.select("page", "ord", "id", "type", "source", scrub_patterns(F.col("label")).alias("label"), scrub_patterns(F.col("description")).alias("description"), options.alias("options"))
