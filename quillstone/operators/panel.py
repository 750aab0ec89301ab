"""Rules of the reviewing side: edits over parses, offers and badges, which form a page is, and what a change of page discards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .match import FEWEST, FORM_MARGIN, FORM_RATE, host_matches, located_by_step, report
from .review import ready


def _blank(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit(""))) == ""


def merged_details(state: DataFrame, parse: DataFrame) -> DataFrame:
    """state (claim, field, value, touched) after a new parse (claim, field, value, choices): untouched fields take what was found, even nothing.

    Adds choices, which are shown while the field is blank and untouched, and badge.
    """
    j = state.join(parse.select("claim", "field", F.col("value").alias("p_value"), "choices"), ["claim", "field"], "left")
    value = F.when(F.col("touched"), F.col("value")).otherwise(F.coalesce("p_value", F.lit("")))
    j = j.withColumn("value", value)
    shown = offered(F.col("choices"), F.col("touched"), F.col("value"))
    return j.withColumn("choices", shown).withColumn("badge", badge(F.col("value"), F.col("touched"), F.size("choices") > 0)).drop("p_value")


def offered(choices: Column, touched: Column, value: Column) -> Column:
    """The candidates that are put to somebody: none for a field that is typed or known."""
    none = F.array().cast("array<string>")
    return F.when(~touched & _blank(value), F.coalesce(choices, none)).otherwise(none)


def badge(value: Column, touched: Column, asking: Column) -> Column:
    return F.when(asking, "needs checking").when(_blank(value), "nothing found").when(touched, "typed").otherwise("found")


def inferred_insurer(value: Column, touched: Column, choices: Column, insurer: Column) -> Column:
    """The form's insurer where the field is blank, untouched and not a question."""
    free = _blank(value) & ~touched & (F.size(F.coalesce(choices, F.array().cast("array<string>"))) == 0)
    return F.when(free & ~_blank(insurer), insurer).otherwise(value)


def effective(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows with the edit of each (claim, id, edit) in place of its value; an edit may be blank."""
    e = edits.select("claim", "id", "edit", F.lit(True).alias("_edited")).dropDuplicates(["claim", "id"])
    j = rows.join(e, ["claim", "id"], "left")
    return j.withColumn("value_str", F.when(F.col("_edited"), F.col("edit")).otherwise(F.col("value_str"))).drop("edit", "_edited")


def fill_plan(rows: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(claim, id, label, step, value_str, value_bool) of what is ready to be written."""
    r = ready(rows, confirmed)
    return r.select("claim", "id", "label", F.coalesce("step", F.lit("")).alias("step"), "value_str", "value_bool")


def fill_values(rows: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(claim, values): a map from id to value of each claim."""
    r = ready(rows, confirmed).groupBy("claim").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", F.coalesce("value_str", F.col("value_bool").cast("string")))))).alias("values"))  # a claim's own rows
    return r


def page_scores(forms: DataFrame, controls: DataFrame) -> DataFrame:
    """(page, form, matched, intended, match_rate, best_step_rate, best_step_matched): how well each form's fields fit each page; counts alone.

    forms: form, field, field_ord, label, step. controls: page, control, control_ord, label. A page is tried against the forms that share a word with it.
    """
    pair = F.struct("page", "form").alias("grp")
    f = _candidates(forms, controls)
    fields = f.join(forms, "form").select(pair, "field", "field_ord", "label", "step")
    shown = f.join(controls, "page").select(pair, "control", "control_ord", "label")
    rows, steps = located_by_step(fields, shown)
    whole = report(rows).select("grp", "matched", "intended", "match_rate")
    w = W.partitionBy("grp").orderBy(F.col("match_rate").desc(), F.col("matched").desc())
    several = steps.withColumn("n", F.count("*").over(W.partitionBy("grp")))
    best = several.filter("n > 1").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("grp", F.col("match_rate").alias("best_step_rate"), F.col("matched").alias("best_step_matched"))
    return whole.join(best, "grp", "left").select("grp.page", "grp.form", "matched", "intended", "match_rate", "best_step_rate", "best_step_matched")


def _candidates(forms: DataFrame, controls: DataFrame) -> DataFrame:
    """(page, form) that have a label's content word in common: no other pair can match a field."""
    from ..functions.text import content_tokens, normalised

    words = lambda c: F.explode(F.concat(content_tokens(c), F.array(F.concat(F.lit("="), normalised(c)))))
    a = forms.select("form", words(F.col("label")).alias("k")).distinct()
    b = controls.select("page", words(F.col("label")).alias("k")).distinct()
    return a.join(b, "k").filter("k <> '='").select("page", "form").distinct()


def fit(scores: DataFrame) -> DataFrame:
    """Adds fit_rate and fit_matched: of the best step of a form in steps, else of the whole form."""
    stepped = F.col("best_step_rate").isNotNull()
    return scores.withColumns({"fit_rate": F.when(stepped, F.col("best_step_rate")).otherwise(F.col("match_rate")), "fit_matched": F.when(stepped, F.col("best_step_matched")).otherwise(F.col("matched"))})


def detected(pages: DataFrame, forms: DataFrame, scores: DataFrame) -> DataFrame:
    """(page, form, how): among the forms of the page's host, or all if none has it, the one that clearly fits best; else the only one of the host; else null.

    pages: page, host. forms: form, form_ord, hosts. scores: as page_scores gives them.
    """
    f = forms.select(F.col("form").alias("hf"), F.explode("hosts").alias("pattern"))
    # A host meets the patterns that are its own ending: of its labels from each on.
    parts = F.split(F.lower("host"), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosted = pages.select("page", "host", F.explode(ends).alias("e")).join(f.withColumn("e", F.regexp_replace(F.lower("pattern"), r"^\*\.", "")), "e").filter(host_matches(F.col("host"), F.array("pattern"))).select("page", F.col("hf").alias("form")).distinct()
    count = hosted.groupBy("page").agg(F.count("*").alias("n_host"), F.any_value("form").alias("only"))
    s = fit(scores).join(hosted.withColumn("by_host", F.lit(True)), ["page", "form"], "left").join(count.select("page", "n_host"), "page", "left").join(forms.select("form", "form_ord"), "form")
    s = s.filter((F.col("n_host").isNull() | F.col("by_host")) & (F.col("fit_matched") >= FEWEST) & (F.col("fit_rate") >= FORM_RATE))
    w = W.partitionBy("page").orderBy(F.col("fit_rate").desc(), "form_ord")
    best = s.withColumns({"rn": F.row_number().over(w), "second": F.lead("fit_rate").over(w)}).filter("rn = 1")
    best = best.filter(F.round(F.col("fit_rate") - F.coalesce("second", F.lit(-1.0)), 9) >= FORM_MARGIN).select("page", F.col("form").alias("best"))
    j = pages.join(best, "page", "left").join(count, "page", "left")
    only = F.when(F.col("n_host") == 1, F.col("only"))
    return j.select("page", F.coalesce("best", only).alias("form"), F.when(F.col("best").isNotNull(), "fit").when(only.isNotNull(), "host").alias("how"))


def enrichable(fields: DataFrame) -> DataFrame:
    """(grp, field, field_ord, label) of a form's fields (form, field, field_ord, label, source) whose instruction may go to a question of a page: those that a model answers."""
    return fields.filter("source = 'llm'").select(F.col("form").alias("grp"), "field", "field_ord", "label")


def after_change(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """The answers that stay when pages have changed: those to a changed page's old questions go, with their edits and confirmations. rows and changed: page."""
    return rows.join(changed.select("page").distinct(), "page", "left_anti")


def questions_left(rows: DataFrame) -> DataFrame:
    """(page, n, text): how many questions of a page are known."""
    g = rows.groupBy("page").agg(F.count("label").alias("n"))
    return g.withColumn("text", F.when(F.col("n") == 0, "none yet").otherwise(F.col("n").cast("string")))


def loose_recheck(kind: Column, value: Column) -> Column:
    """The reviewing side's own test of a date that reads two ways: years of two to four digits, too."""
    day = F.regexp_extract(F.trim(value), r"^(\d{1,2})/\d{1,2}/\d{2,4}$", 1)
    return F.coalesce((kind == "date") & (day != "") & (F.try_to_number(F.nullif(day, F.lit("")), F.lit("99")) <= 12), F.lit(False))
