"""Queries of form schemas as files, plans to fill, redacted claims, uploads, surveys and asked prompts over the driver's tables, and their SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import bank, dumps, evalkit, panel, provider, review, sinks, survey
from ..operators.tables import temporary_folder
from ..sources import forms as schemas
from .queries import MAIL, query, t

LINES = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)"


def _lines(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_quantity", "l_returnflag")])


@query("""
WITH b AS (SELECT p_brand AS form_id, CAST(split_part(p_brand, '#', 2) AS INTEGER) AS n, count(*) AS fields FROM part GROUP BY 1)
SELECT form_id, CASE WHEN n % 3 = 0 THEN 'second' ELSE 'first' END AS display_name, CASE n % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'overlay' ELSE 'acroform' END AS fill_mode, CAST(fields AS BIGINT) AS n_fields,
       CASE WHEN n % 4 = 0 AND n % 5 < 3 THEN 'a web form has no pdf_path' WHEN n % 4 = 1 THEN 'an overlay field needs a box' WHEN n % 4 = 3 THEN 'an acroform field needs its name' END AS error
FROM b WHERE n % 7 > 0
""")
def form_catalogue(spark, sf_dir):
    """Brands as form schemas in files of their own, some there twice, some internal: what a list of forms shows, and which can't be addressed."""
    n, k = F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int"), F.col("p_partkey")
    one = F.struct(F.concat(F.lit("f"), k.cast("string")).alias("id"), F.col("p_type").alias("label"), F.when(n % 4 == 2, F.col("p_name")).alias("pdf_field_name"), F.lit("text").alias("type"), F.lit("llm").alias("source"))
    g = t(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(one)).alias("fields"))  # a form's own fields
    mode = F.when(n % 4 == 0, "web").when(n % 4 == 1, "overlay")
    form = lambda name: F.struct(F.col("p_brand").alias("form_id"), F.lit(name).alias("display_name"), mode.alias("fill_mode"), F.when(n % 5 < 3, "x.pdf").alias("pdf_path"), F.when(n % 7 == 0, True).alias("internal"), "fields")
    folder = temporary_folder(spark, "forms")
    for name, rows in (("first", g), ("second", g.filter(n % 3 == 0))):
        rows.select(F.to_json(form(name)).alias("value")).write.option("maxRecordsPerFile", 1).text(f"{folder}/v={name}")
    found = schemas.catalogue(schemas.read(spark, folder))
    count = schemas.fields(found).groupBy("form_id").agg(F.count("*").alias("n_fields"))
    return found.select("form_id", "display_name", "fill_mode").join(count, "form_id").join(schemas.checked(found), "form_id").select("form_id", "display_name", "fill_mode", "n_fields", "error")


@query(f"""
SELECT l_orderkey AS claim, l_linenumber AS id, 'line ' || l_linenumber AS label, CASE WHEN l_linenumber % 2 = 0 THEN 'two' ELSE '' END AS step, CASE WHEN l_linenumber <> 4 THEN l_returnflag END AS value_str, CASE WHEN l_linenumber = 4 THEN l_quantity > 25 END AS value_bool
FROM {LINES} WHERE (l_linenumber = 4 OR l_returnflag <> 'N') AND (l_returnflag <> 'R' OR l_linenumber = 2)
""")
def fill_plans(spark, sf_dir):
    """Orders' lines as reviewed rows: what is ready to be written, and on which step."""
    x, n = _lines(spark, sf_dir), F.col("l_linenumber")
    rows = x.select(F.col("l_orderkey").alias("claim"), n.alias("id"), F.concat(F.lit("line "), n.cast("string")).alias("label"), F.when(n % 2 == 0, "two").alias("step"), F.when((n != 4) & (F.col("l_returnflag") != "N"), F.col("l_returnflag")).alias("value_str"), F.when(n == 4, F.col("l_quantity") > 25).alias("value_bool"), (F.col("l_returnflag") == "R").alias("needs_review"))
    return panel.fill_plan(rows, rows.filter("id = 2").select("claim", "id"))


@query("""
SELECT o_orderkey AS claim, v.id, CASE WHEN v.id = 'born' THEN 'dob' END AS fill_from, CASE WHEN v.id = 'born' THEN true ELSE o_orderstatus <> 'F' END AS needs_review,
       CASE WHEN v.id = 'seen' THEN strftime(o_orderdate, '%d/%m/%Y') END AS value FROM orders, (VALUES ('born'), ('seen')) v(id)
""")
def redacted_rows(spark, sf_dir):
    """Orders as claims mapped without records: demographics are named, not filled in, and a date that reads two ways isn't held for that alone."""
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim"), "o_orderdate", "o_orderstatus", F.explode(F.array(F.lit("born"), F.lit("seen"))).alias("id"))
    born = F.col("id") == "born"
    status = F.when(born, "missing").when(F.col("o_orderstatus") == "F", "extracted").otherwise("inferred")
    rows = o.select("claim", "id", F.lit("date").alias("type"), F.when(born, "demographics.dob").otherwise("llm").alias("source"), F.when(~born, F.date_format("o_orderdate", "dd/MM/yyyy")).alias("value_str"), F.lit(None).cast("boolean").alias("value_bool"), status.alias("status"))
    return review.assembled(rows, "redacted").select("claim", "id", "fill_from", "needs_review", F.col("value_str").alias("value"))


@query("SELECT p_partkey AS file FROM part WHERE NOT (p_size % 3 = 0 AND trim(p_type) <> '' OR p_partkey % 10 = 4)")
def fresh_uploads(spark, sf_dir):
    """Parts as uploads with the values of their fields: only those that nobody has filled in may be banked."""
    n, k, none = F.col("p_size"), F.col("p_partkey"), F.lit(None).cast("string")
    answers = F.when(n % 3 == 0, F.array(F.lit("/Off"), F.col("p_type"))).when(k % 10 == 4, F.array(F.lit(" x "))).when(k % 10 == 5, F.array(F.lit(" "), F.lit("/Off"), none))
    return sinks.fresh_forms(t(spark, sf_dir, "part").select(k.alias("file"), answers.alias("answers"))).select("file")


@query("SELECT CAST(count(*) FILTER (WHERE c_custkey % 3 = 0 AND c_nationkey % 2 = 0) AS BIGINT) AS clean, CAST(count(*) AS BIGINT) AS total, CAST(sum(c_custkey % 3) AS BIGINT) AS faults, CAST(sum(c_nationkey % 2) AS BIGINT) AS misses FROM customer")
def case_summary(spark, sf_dir):
    """Customers as scored cases, summed up."""
    return evalkit.summary(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case"), (F.col("c_custkey") % 3).alias("faults"), (F.col("c_nationkey") % 2).alias("misses")))


@query("SELECT p_brand AS grp, p_partkey AS field, p_type AS label FROM part WHERE p_size % 4 > 0")
def enrichable_fields(spark, sf_dir):
    """Parts as fields of their brand's form, a quarter of them the patient's own: which may explain a page's question."""
    p = t(spark, sf_dir, "part").select(F.col("p_brand").alias("form"), F.col("p_partkey").alias("field"), F.col("p_partkey").alias("field_ord"), F.col("p_type").alias("label"), F.when(F.col("p_size") % 4 > 0, "llm").otherwise("demographics.dob").alias("source"))
    return panel.enrichable(p).select("grp", "field", "label")


@query(f"SELECT DISTINCT l_orderkey AS claim, l_linenumber AS id FROM {LINES} WHERE l_linenumber > 3 AND l_orderkey % 2 = 0")
def foreign_answers(spark, sf_dir):
    """Orders' lines as answers to forms of three questions, or of all: which name a question that isn't there?"""
    x = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("claim"), F.col("l_linenumber").alias("id"))
    return review.unknown_ids(x, x.filter("id <= 3 OR claim % 2 = 1"))


@query("SELECT p_brand AS form, p_partkey AS field, CASE WHEN p_size % 2 = 0 THEN p_name END AS value_str, CASE WHEN p_size % 5 = 0 AND p_size % 2 = 0 THEN true END AS value_bool FROM part")
def full_values(spark, sf_dir):
    """Parts as fields, half of them answered: every field has a row."""
    p = t(spark, sf_dir, "part")
    values = p.filter("p_size % 2 = 0").select(F.col("p_brand").alias("form"), F.col("p_partkey").alias("field"), F.col("p_name").alias("value_str"), F.when(F.col("p_size") % 5 == 0, True).alias("value_bool"))
    return sinks.full_values(p.select(F.col("p_brand").alias("form"), F.col("p_partkey").alias("field")), values.union(values))


@query("SELECT user_id AS form, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS skipped, CAST(sum(event_id % 3) AS BIGINT) AS scrubbed FROM events GROUP BY user_id")
def dump_counters(spark, sf_dir):
    """Users' events as captures: what was left out and scrubbed over all of a form's."""
    e = t(spark, sf_dir, "events").select(F.col("user_id").alias("form"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("skipped"), (F.col("event_id") % 3).alias("scrubbed"))
    return dumps.counters(e)


@query("""
WITH p AS (SELECT substr(sha256(html), 1, 32) AS key, page_id, page_id % 3 AS m FROM pages), f AS (SELECT key, min(m) AS m FROM p GROUP BY key)
SELECT key, '{"by":' || m || '}' AS form FROM f
""")
def bank_commits(spark, sf_dir):
    """Pages banked by three writers one after the other, then put together: of a key the first writer's form stays."""
    folder = temporary_folder(spark, "bank")
    k = bank.key(F.encode("html", "utf-8"))
    for m in range(3):
        bank.append(t(spark, sf_dir, "pages").filter(F.col("page_id") % 3 == m).select(k.alias("key"), F.lit(json.dumps({"by": m}, separators=(",", ":"))).alias("form")), folder)
    bank.compacted(spark, folder)
    return bank.banked(spark, folder)


@query(rf"""
SELECT conv_id || ':' || turn AS key, regexp_extract_all(text, '{MAIL}') AS findings FROM conversations WHERE text IS NOT NULL
""")
def asked_sweeps(spark, sf_dir):
    """Turns of conversations swept by a function in a model's place, which names the e-mail addresses in its prompt; each prompt is asked once."""
    import re

    found = re.compile(r"\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+\b", re.ASCII)
    ask = provider.asking(lambda prompt: ("end", "\n".join(found.findall(prompt)) or "NONE"), temporary_folder(spark, "ledger"), rounds=2)
    c = t(spark, sf_dir, "conversations").filter("text IS NOT NULL").select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.col("text").alias("redacted_text"))
    return provider.swept(c, ask)


@query("""
SELECT c_custkey AS page, 'portal.example' AS host, CASE c_custkey % 2 WHEN 0 THEN 'ward' END AS form, CASE c_custkey % 2 WHEN 0 THEN 'fit' END AS how, CAST(3 AS BIGINT) AS fields, CAST(NULL AS VARCHAR) AS error FROM customer
""")
def page_surveys(spark, sf_dir):
    """Pages about customers, every second one with a known form's questions: which form it is and how many questions may be asked."""
    words = {0: ("Ward", "Doctor", "Diagnosis"), 1: ("Colour", "Weight", "Height")}
    inputs = {m: "<form>" + "".join(f"<div><label for=i{k}>{w} of {{k}}</label><input id=i{k}></div>" for k, w in enumerate(ws)) + "<input name=off disabled><input type=password></form>" for m, ws in words.items()}
    k = F.col("c_custkey")
    body = F.replace(F.when(k % 2 == 0, F.lit(inputs[0])).otherwise(F.lit(inputs[1])), F.lit("{k}"), F.lit("patient"))
    pages = t(spark, sf_dir, "customer").select(k.alias("page_id"), F.concat(F.lit("https://portal.example/"), k.cast("string")).alias("url"), body.alias("html"))
    forms = spark.createDataFrame([("ward", 1, ["*.portal.example"]), ("plan", 2, ["portal.example"]), ("plan2", 3, ["portal.example"])], "form string, form_ord int, hosts array<string>")
    fields = spark.createDataFrame([(f, w, i, f"{w} of patient", "") for f, ws in (("ward", words[0]), ("plan", ("Plan", "Premium", "Payer")), ("plan2", ("Limit", "Share", "Term"))) for i, w in enumerate(ws)], "form string, field string, field_ord int, label string, step string")
    return survey.survey(pages, forms, fields, spark.sparkContext.defaultParallelism).pages
