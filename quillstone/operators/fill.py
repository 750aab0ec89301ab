"""Write-back as an outcome table: never over an answer, never the same option twice, nothing if the match is unsafe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import day_first_to_iso
from ..functions.patterns import TICK, UNTICK
from ..functions.text import option_key
from .match import is_none_option

GROUPS = ("radio-group", "checkbox-group")
NONE = "array<string>"


def tick_intent(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin(*TICK), True).when(v.isin(*UNTICK), False)


def _list(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast(NONE))


def chosen_option(value: Column, labels: Column, values: Column) -> Column:
    """Place (from 1) of the option whose text, or else whose value, is the answer, case and outer blanks aside; null if it is off the list."""
    place = lambda options: F.nullif(F.array_position(F.transform(options, lambda o: F.lower(F.trim(o))), F.lower(F.trim(value))), F.lit(0))
    return F.when(F.trim(value) != "", F.coalesce(place(labels), place(values)))


def chosen_member(value: Column, labels: Column, values: Column) -> Column:
    """The same for groups: the first member of which either fits."""
    own = F.lower(F.trim(value))
    either = F.zip_with(labels, values, lambda a, b: F.coalesce(F.lower(F.trim(a)) == own, F.lit(False)) | F.coalesce(F.lower(F.trim(b)) == own, F.lit(False)))
    return F.when(own != "", F.nullif(F.array_position(either, F.lit(True)), F.lit(0)))


def repeat_key(kind: Column, labels: Column) -> Column:
    """What selects that repeat one question share: their options. Null for other controls and for fewer than two options."""
    keys = F.filter(F.transform(labels, option_key), lambda o: o != "")
    return F.when((kind == "select") & (F.size(keys) >= 2), F.array_join(keys, "|"))


def fillable() -> Column:
    """Whether a control can be written at all; only these are matched."""
    return ~F.coalesce("disabled", F.lit(False)) & ~F.coalesce("read_only", F.lit(False))


def answered() -> Column:
    ticked = F.coalesce("checked", F.lit(False))
    return F.when(F.col("type").isin("checkbox", "radio", *GROUPS), ticked).otherwise(F.trim(F.coalesce("existing", F.lit(""))) != "")


def ambiguous_group() -> Column:
    """Nothing ticked and no option that says so: not answered, or none of them."""
    own = F.zip_with(_list("options"), _list("option_values"), is_none_option)
    return (F.col("type") == "checkbox-group") & ~F.coalesce("checked", F.lit(False)) & ~F.exists(own, lambda x: x)


def outcomes(plan: DataFrame) -> DataFrame:
    """status and reason of each planned write.

    plan: form, field, ord, status (of the match), type, value, existing (value now), shown (a select's text now), checked (a
    box, or any member of a group), disabled, read_only, options (texts), option_values and safe. status, shown and
    option_values may be absent. Rows with a null field are controls of the page that the plan doesn't write: their options
    count as taken, and they get no row.
    """
    extra = {"status": F.lit("matched"), "shown": F.col("existing"), "option_values": F.lit(None).cast(NONE)}
    p = plan.withColumns({c: v for c, v in extra.items() if c not in plan.columns})
    single = ~F.col("type").isin(*GROUPS)
    labels, values = _list("options"), _list("option_values")
    option = F.when(F.col("type") == "select", chosen_option(F.col("value"), labels, values)).otherwise(chosen_member(F.col("value"), labels, values))
    intent = tick_intent(F.col("value"))
    reason = (
        F.when(F.col("status") != "matched", F.col("status"))
        .when(F.col("value").isNull(), "no value")
        .when(single & (F.col("disabled") | F.col("read_only")), "not writable")
        .when(answered(), "already answered")
        .when(ambiguous_group(), "unanswered or none")
        .when(F.col("type").isin("select", "radio", *GROUPS) & (F.trim("value") == ""), "no value")
        .when(F.col("type").isin("select", "radio", *GROUPS) & option.isNull(), "no matching option")
        .when((F.col("type") == "checkbox") & intent.isNull(), "not a tick")
        .when((F.col("type") == "date") & day_first_to_iso(F.col("value")).isNull(), "not a date")
    )
    unchanged = (F.col("type") == "checkbox") & (intent == F.coalesce("checked", F.lit(False)))
    base = p.withColumns({"_reason": reason, "_unchanged": F.coalesce(unchanged, F.lit(False)), "_key": repeat_key(F.col("type"), labels), "_own": option_key(F.col("value")), "_shown": option_key(F.col("shown"))})
    seeds = base.filter("_key IS NOT NULL AND _shown <> ''").select(F.col("form").alias("_f"), F.col("_key").alias("_k"), F.col("_shown").alias("_o")).distinct().withColumn("_seed", F.lit(True))
    rows = base.filter("field IS NOT NULL").join(seeds, (F.col("form") == F.col("_f")) & (F.col("_key") == F.col("_k")) & (F.col("_own") == F.col("_o")), "left")
    w = W.partitionBy("form", "_key", "_own").orderBy("ord", "field").rowsBetween(W.unboundedPreceding, -1)
    before = F.sum(F.when(F.col("_reason").isNull(), 1).otherwise(0)).over(w)  # the first that can be filled takes the option
    taken = F.col("_key").isNotNull() & F.col("value").isNotNull() & (F.col("status") == "matched") & (F.coalesce("_seed", F.lit(False)) | (F.coalesce(before, F.lit(0)) > 0))
    why = F.when(~F.col("safe"), "match is not safe").when(taken, "option already chosen").otherwise(F.col("_reason"))
    done = F.when(why.isNotNull(), "skipped").when(F.col("_unchanged"), "unchanged").otherwise("filled")
    return rows.select("form", "field", done.alias("status"), why.alias("reason"))


def kept_value(kind: Column, text: Column) -> Column:
    """What a control keeps of a text that is put into it: nothing of what isn't its kind, and no line ends but in an area."""
    line = F.regexp_replace(text, "[\r\n]", "")
    shape = lambda pattern: F.when(text.rlike(pattern), text).otherwise("")
    return (
        F.when(kind == "number", shape(r"^-?(\d+|\d*\.\d+)([eE][-+]?\d+)?$"))
        .when(kind == "date", F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), text).otherwise(""))
        .when(kind == "time", shape(r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d)?$"))
        .when(kind.isin("email", "url"), F.trim(line))
        .when(kind == "textarea", F.regexp_replace(text, "\r\n?", "\n"))
        .otherwise(line)
    )


def read_back(rows: DataFrame) -> DataFrame:
    """(form, field, status, reason, now): filled text controls whose value doesn't stand as it was written get theirs back and count as skipped.

    rows: form, field, type, value, existing, status, reason. Dates are written as a date control wants them.
    """
    asked = F.when(F.col("type") == "date", day_first_to_iso(F.col("value"))).otherwise(F.col("value"))
    texts = (F.col("status") == "filled") & ~F.col("type").isin("select", "radio", "checkbox", *GROUPS)
    r = rows.withColumn("_asked", F.when(F.col("value").isNull(), "").otherwise(asked))  # null: no date
    stands = F.coalesce(kept_value(F.col("type"), F.col("_asked")) == F.col("_asked"), F.lit(False))
    now = F.when(texts & stands, F.col("_asked")).otherwise(F.col("existing"))
    status, reason = (F.when(texts & ~stands, told).otherwise(F.col(c)) for c, told in (("status", "skipped"), ("reason", "value not taken")))
    return r.select("form", "field", status.alias("status"), reason.alias("reason"), now.alias("now"))


def filled_counts(rows: DataFrame) -> DataFrame:
    """Per form: how many were filled, of how many."""
    return rows.groupBy("form").agg(F.count_if(F.col("status") == "filled").alias("filled"), F.count("*").alias("planned"), F.bool_and(F.coalesce(F.col("reason") == "match is not safe", F.lit(False))).alias("refused"))


def filled_page(fields: DataFrame, controls: DataFrame, values: DataFrame) -> DataFrame:
    """Locates the fields anew on a page as it is now and gives the outcomes of writing their values.

    fields and controls: as match.located_by_step takes them; controls also with type, existing, shown, checked, disabled,
    read_only, options and option_values. values: grp, field, value. Disabled and read-only controls are no candidates; the options
    they show count as taken.
    """
    from .match import located_by_step, report

    own = [c for c in ("grp", "control", "control_ord", "label", "selector") if c in controls.columns]
    rows, _ = located_by_step(fields, controls.filter(fillable()).select(*own))
    safe = report(rows).select(F.col("grp").alias("_g"), "safe_to_fill")
    on = controls.drop("label", "control_ord", "selector")
    j = rows.drop("score").join(values, ["grp", "field"], "left").join(on, ["grp", "control"], "left").join(safe, F.col("grp") == F.col("_g"))
    rest = on.join(rows.filter("control IS NOT NULL").select("grp", "control"), ["grp", "control"], "left_anti").join(safe, F.col("grp") == F.col("_g"))
    cols = ["type", "existing", "shown", "checked", "disabled", "read_only", "options", "option_values"]
    both = j.select(F.col("grp").alias("form"), "field", F.col("field_ord").cast("long").alias("ord"), "status", "value", *cols, F.col("safe_to_fill").alias("safe"))
    rest = rest.select(F.col("grp").alias("form"), F.lit(None).cast(both.schema["field"].dataType).alias("field"), F.lit(0).cast("long").alias("ord"), F.lit("matched").alias("status"), F.lit(None).cast("string").alias("value"), *cols, F.col("safe_to_fill").alias("safe"))
    return outcomes(both.union(rest))
