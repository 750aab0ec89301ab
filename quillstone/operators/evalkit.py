"""Scores: leaks and over-redaction; faults and misses of filled forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leak_metrics(cases: DataFrame, swept: bool = False) -> DataFrame:
    """Per case: identifiers that survived and clinical strings that didn't. cases: id, redacted, must_not_survive, must_survive, sweep_only."""
    text = F.lower("redacted")
    leaks = F.filter("must_not_survive", lambda s: F.contains(text, F.lower(s)))
    lost = F.filter("must_survive", lambda s: ~F.contains(text, F.lower(s)))
    exempt = F.coalesce("sweep_only", F.lit(False)) & F.lit(not swept)
    return cases.select("id", F.when(exempt, 0).otherwise(F.size(leaks)).cast("long").alias("leaks"), F.size(lost).cast("long").alias("over_redacted"))


def case_scores(rows: DataFrame, checks: DataFrame) -> DataFrame:
    """faults and misses of each case. rows: case, field, value (null where a box is unticked), needs_review and, for
    phrases that run over values, ord. checks: case, kind, field, want.

    A check of a field that the form hasn't is a fault. fills: blank is a miss. blank: a value is a fault. equals: another value
    is a fault, none a miss. holds: a row that isn't held for review is a fault. forbid_in: the text within the field's value, and
    forbid: within any value, is a fault; case doesn't matter to these two alone.
    """
    v = F.coalesce(F.col("value"), F.lit(""))
    per = checks.filter("kind <> 'forbid'").join(rows.withColumn("known", F.lit(True)), ["case", "field"], "left").withColumn("v", v)
    unknown, kind = F.col("known").isNull(), F.col("kind")
    bucket = (
        F.when(unknown & kind.isin("fills", "blank", "equals"), "fault")
        .when((kind == "fills") & (F.col("v") == ""), "miss")
        .when((kind == "blank") & (F.col("v") != ""), "fault")
        .when((kind == "equals") & (F.col("v") != F.coalesce("want", F.lit(""))), F.when(F.col("v") == "", "miss").otherwise("fault"))
        .when((kind == "holds") & ~unknown & ~F.coalesce("needs_review", F.lit(False)), "fault")
        .when((kind == "forbid_in") & F.contains(F.lower("v"), F.lower("want")), "fault")
    )
    one = per.select("case", bucket.alias("bucket"))
    place = F.col("ord") if "ord" in rows.columns else F.lit(0)
    listed = F.array_sort(F.collect_list(F.struct(place.alias("ord"), "value")))  # a form's own values
    every = rows.filter("value <> ''").groupBy("case").agg(F.lower(F.concat_ws(" ", F.transform(listed, lambda x: x["value"]))).alias("all"))
    anywhere = checks.filter("kind = 'forbid'").select("case", "want").join(every, "case", "left")
    two = anywhere.select("case", F.when(F.contains("all", F.lower("want")), "fault").alias("bucket"))
    return one.union(two).groupBy("case").agg(F.count_if(F.col("bucket") == "fault").alias("faults"), F.count_if(F.col("bucket") == "miss").alias("misses"))


def case_records(cases: DataFrame) -> DataFrame:
    """Cases of the redaction corpus as patient records: absent identifiers are null, the date of birth a date."""
    text = lambda c: F.nullif(F.col(f"record.{c}"), F.lit(""))
    return cases.select("id", F.coalesce("record.full_name", F.lit("")).alias("full_name"), F.coalesce("record.nric", F.lit("")).alias("nric"), F.try_to_date("record.dob", "yyyy-MM-dd").alias("dob"), text("phone").alias("phone"), text("address").alias("address"), text("policy_number").alias("policy_number"), F.col("note").alias("clinical_text"))


def summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count_if((F.col("faults") == 0) & (F.col("misses") == 0)).alias("clean"), F.count("*").alias("total"), F.sum("faults").alias("faults"), F.sum("misses").alias("misses"))
