"""Answers against form schemas: parsing, strict coercion, assembly and review gating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import iso_to_day_first, needs_recheck, short_year
from .match import matched_option

RECHECK = "check the day and month are the right way round"
REPLY = "struct<fields:array<struct<id:string,value:string,status:string,source:string,reasoning:string>>>"


def parsed_replies(replies: DataFrame) -> DataFrame:
    """(claim, id, ord, value, status, source, reasoning): the first entry of each id; unreadable replies give no rows."""
    one = replies.select("claim", F.from_json("reply", REPLY).alias("r")).select("claim", F.posexplode("r.fields").alias("ord", "f")).select("claim", "ord", "f.*").filter("id IS NOT NULL")
    return one.withColumn("rn", F.row_number().over(W.partitionBy("claim", "id").orderBy("ord"))).filter("rn = 1").drop("rn")


def coerced(fields: DataFrame, answers: DataFrame) -> DataFrame:
    """Every field with its answer or `missing`: bad status, empty and off-list values are missing; options beat type.

    fields: claim, id, ord, type, source, description, options. answers: as parsed_replies gives them.
    """
    a = answers.select("claim", "id", F.col("value").alias("v"), F.col("status").alias("s"), F.col("source").alias("quote"), "reasoning")
    j = fields.join(a, ["claim", "id"], "left")
    has = F.col("s").isin("extracted", "inferred") & (F.col("v") != "")
    listed = F.size(F.coalesce("options", F.array().cast("array<string>"))) > 0
    flag = F.lower(F.trim("v"))
    text = (
        F.when(~has | F.col("v").isNull(), None)
        .when(listed, matched_option(F.col("v"), F.col("options")))
        .when(F.col("type") == "checkbox", None)
        .when(F.col("type") == "date", short_year(F.col("description"), F.col("v")))
        .otherwise(F.col("v"))
    )
    tick = F.when(has & ~listed & (F.col("type") == "checkbox"), F.when(flag == "true", True).when(flag == "false", False))
    j = j.withColumns({"value_str": text, "value_bool": tick})
    known = F.col("value_str").isNotNull() | F.col("value_bool").isNotNull()
    keep = lambda c: F.when(known, F.nullif(F.col(c), F.lit("")))
    return j.withColumns({"status": F.when(known, F.col("s")).otherwise("missing"), "quote": keep("quote"), "reasoning": keep("reasoning")}).drop("v", "s")


def assembled(rows: DataFrame, mode: str = "server") -> DataFrame:
    """Review rows. server: a date that may be read two ways is held for review; redacted: only its status counts, and fill_from names the demographic."""
    attr = F.when(F.col("source").startswith("demographics."), F.substring_index("source", ".", -1))
    recheck = F.when(needs_recheck(F.col("type"), F.col("value_str")), RECHECK)
    unsure = ~F.col("status").isin("extracted", "demographic")
    out = rows.withColumn("fill_from", attr)
    if mode == "redacted":
        return out.withColumn("needs_review", unsure)
    return out.withColumn("recheck", recheck).withColumn("needs_review", unsure | F.col("recheck").isNotNull())


def with_demographics(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Copies a record's values into the rows that ask for them; dates of birth day first. records: claim and one column per attribute.

    A row that asks for one stays `demographic` without a value, too. Where rows have form_insurer, it stands in for an insurer that the record hasn't.
    """
    attrs = [c for c in records.columns if c != "claim"]
    long = records.unpivot("claim", [F.col(c).cast("string").alias(c) for c in attrs], "fill_from", "known") if len(attrs) > 1 else records.select("claim", F.lit(attrs[0]).alias("fill_from"), F.col(attrs[0]).cast("string").alias("known"))
    j = rows.join(long, ["claim", "fill_from"], "left")
    value = F.nullif(F.when(F.col("fill_from") == "dob", iso_to_day_first(F.col("known"))).otherwise(F.col("known")), F.lit(""))
    if "form_insurer" in rows.columns:
        value = F.when(F.col("fill_from") == "insurer", F.coalesce(value, "form_insurer")).otherwise(value)
    asked = F.col("fill_from").isNotNull()
    j = j.withColumns({"value_str": F.when(asked, value).otherwise(F.col("value_str")), "status": F.when(asked, "demographic").otherwise(F.col("status"))}).drop("known")
    held = needs_recheck(F.col("type"), F.col("value_str"))
    if "recheck" in j.columns:
        j = j.withColumn("recheck", F.when(asked, F.when(held, RECHECK)).otherwise(F.col("recheck")))
    return j.withColumn("needs_review", F.when(asked, held).otherwise(F.col("needs_review")))


def restored(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """Answers with their tokens turned back into values; maps: claim, entries.

    A value with a token that stays is blanked, missing and held for review; such a citation is dropped, and so is the reasoning of
    what isn't inferred.
    """
    from .redact import ENTRIES, remerged

    j = rows.join(maps.select("claim", "entries"), "claim", "left").withColumn("entries", F.coalesce("entries", F.array().cast(ENTRIES)))
    back = remerged(F.col("value_str"), F.col("entries"))
    lost = F.coalesce(F.size(back["unresolved"]) > 0, F.lit(False))
    cite = lambda c: F.when(F.size(remerged(F.col(c), F.col("entries"))["unresolved"]) == 0, remerged(F.col(c), F.col("entries"))["text"])
    new = {"_lost": lost, "value_str": F.when(~lost, back["text"]), "quote": cite("quote"), "reasoning": cite("reasoning")}
    j = j.withColumns(new)
    j = j.withColumns({"status": F.when(F.col("_lost"), "missing").otherwise(F.col("status")), "needs_review": F.col("_lost") | F.col("needs_review")})
    return j.withColumn("reasoning", F.when(F.col("status") == "inferred", F.col("reasoning"))).drop("_lost", "entries")


def has_value() -> Column:
    return F.coalesce(F.trim("value_str") != "", F.lit(False)) | F.col("value_bool").isNotNull()


def ready(rows: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Rows with a value that need no review or that somebody confirmed (claim, id)."""
    c = confirmed.select("claim", "id").distinct().withColumn("ok", F.lit(True))
    return rows.join(c, ["claim", "id"], "left").filter(has_value() & (~F.col("needs_review") | F.coalesce("ok", F.lit(False)))).drop("ok")


def sole_demographics(labels: DataFrame, lookup: Column) -> DataFrame:
    """A label keeps its demographic only if no other label of the form resolves to it; else `llm`. labels: form, label."""
    j = labels.withColumn("attr", lookup)
    n = F.count("attr").over(W.partitionBy("form", "attr"))
    return j.withColumn("source", F.when(F.col("attr").isNotNull() & (n == 1), F.concat(F.lit("demographics."), F.col("attr"))).otherwise("llm")).drop("attr")


def unknown_ids(values: DataFrame, fields: DataFrame) -> DataFrame:
    return values.select("claim", "id").distinct().join(fields.select("claim", "id"), ["claim", "id"], "left_anti")
