"""Queries of extraction, live forms, intake, sinks and review over inputs made from the driver's tables, and their SQL, written from the rules."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text
from ..operators import bank, evalkit, extract, fill, geometry, intake, live, match, panel, provider, quotes, review, sinks
from ..sources import files, html
from ..operators.tables import spread, temporary_folder
from ..streaming import pages
from ..streaming.changes import changes, quiet
from .queries import AS_OF, query, t

NAMES = ("Tan Wei Ling", "Lim Ah Kow", "Rahmat bin Osman", "Sivakumar s/o Raju")
#: Notes in twelve layouts about customers; {n} name, {i} number, {p} phone, {d} digits. What each must give stands in EXPECTED.
LAYOUTS = (
    "Name: {n}\nNRIC: {i}\nDOB: 14/03/1971\nTel: {p}\nAddress: 18 Toa Payoh Road\nInsurer: Acme Mutual",
    "{n} {i} 04/11/1972 {p} GHS-{d}\nSeen for cough. Review in a week.",
    "Patient: {n} · {i} · 04/11/1972 · {p} · Blk 18 Toa Payoh, Singapore 310018",
    "{n}\n{i}\n04/11/1972\n\nWell on review, plan as before.",
    "NRIC {i}  DOB 14/03/1978\nHP {p} / 61234567\nPolicy discussed with patient",
    "Seen alone for cough.\nClinic tel 62551234\nHer number is {p}",
    "{i}, seen together with husband S6234567C\nClinic address 9 Serangoon Road, Singapore 218000",
    "Fever since Monday. Stays at Bishan Street 12, Singapore 570118. Cover by AIA Singapore.",
    "Old notes of 01/02/1950 and 03/04/2023.\nMember no GH-{d}, later policy GHS-{d}",
    "Call {p} or 61234567. Insurers named: AIA and Bupa Global",
    "Seen 02/08/2023, sore throat. Covered by AIA.",
    "Patient: {n}  Policy no. GHS-{d}  {p}",
)
#: field, value, how, choices of each layout.
EXPECTED = (
    (("full_name", "{n}", "labelled", 0), ("nric", "{i}", "labelled", 0), ("dob", "1971-03-14", "labelled", 0), ("phone", "{p}", "labelled", 0), ("address", "18 Toa Payoh Road", "labelled", 0), ("insurer", "Acme Mutual", "labelled", 0)),
    (("full_name", "{n}", "header-line", 0), ("nric", "{i}", "header-line", 0), ("dob", "1972-11-04", "header-line", 0), ("phone", "{p}", "header-line", 0), ("policy_number", "GHS-{d}", "header-line", 0)),
    (("full_name", "{n}", "patient-line", 0), ("nric", "{i}", "patient-line", 0), ("dob", "1972-11-04", "patient-line", 0), ("phone", "{p}", "patient-line", 0), ("address", "Blk 18 Toa Payoh, Singapore 310018", "patient-line", 0)),
    (("full_name", "{n}", "header-block", 0), ("nric", "{i}", "header-block", 0), ("dob", "1972-11-04", "header-block", 0)),
    (("nric", "{i}", "header-line", 0), ("dob", "1978-03-14", "header-line", 0), ("phone", None, None, 2)),
    (("phone", "{p}", "sole-match", 0),),
    (("nric", "{i}", "sole-match", 0),),
    (("insurer", "AIA", "sole-match", 0), ("address", "Fever since Monday. Stays at Bishan Street 12, Singapore 570118. Cover by AIA Singapore.", "sole-match", 0)),
    (("dob", None, None, 1), ("policy_number", "GHS-{d}", "labelled-inline", 0)),
    (("phone", None, None, 2), ("insurer", None, None, 2)),
    (("insurer", "AIA", "sole-match", 0),),
    (("full_name", "{n}", "patient-line", 0), ("phone", "{p}", "patient-line", 0), ("policy_number", "GHS-{d}", "patient-line", 0)),
)


def _parts():
    k = F.col("c_custkey")
    digits = F.lpad(k.cast("string"), 7, "0")
    names = F.element_at(F.array(*map(F.lit, NAMES)), (k % len(NAMES) + 1).cast("int"))
    return {"{n}": names, "{i}": F.concat(F.lit("S"), digits, F.lit("D")), "{p}": F.concat(F.lit("9"), digits), "{d}": F.concat(F.lit("4"), digits)}


def _notes(spark, sf_dir):
    body = F.element_at(F.array(*map(F.lit, LAYOUTS)), (F.col("c_custkey") % len(LAYOUTS) + 1).cast("int"))
    for mark, value in _parts().items():
        body = F.replace(body, F.lit(mark), value)
    return t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("note_id"), body.alias("text"))


def _sql_text(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


EXPECTED_ROWS = ", ".join(f"({k}, '{f}', {_sql_text(v)}, {_sql_text(how)}, {n})" for k, rows in enumerate(EXPECTED) for f, v, how, n in rows)
FILLED = "replace(replace(replace(replace(e.v, '{n}', ['%s'][c_custkey %% 4 + 1]), '{i}', 'S' || lpad(c_custkey::VARCHAR, 7, '0') || 'D'), '{p}', '9' || lpad(c_custkey::VARCHAR, 7, '0')), '{d}', '4' || lpad(c_custkey::VARCHAR, 7, '0'))" % "', '".join(NAMES)


@query(f"""
SELECT c_custkey AS note_id, e.f AS field, {FILLED} AS value, e.how AS how, CAST(e.n AS BIGINT) AS n_choices
FROM customer JOIN (VALUES {EXPECTED_ROWS}) e(k, f, v, how, n) ON c_custkey % {len(LAYOUTS)} = e.k
""")
def parse_notes(spark, sf_dir):
    """Notes about customers in twelve layouts: labelled, header line, patient line, header block, labels within lines, sole matches, other people's values, addresses, dates."""
    got = extract.parsed(_notes(spark, sf_dir), F.lit(AS_OF).cast("date"))
    return got.select("note_id", "field", "value", "how", F.coalesce(F.size("choices"), F.lit(0)).cast("long").alias("n_choices"))


@query(f"""
WITH c AS (SELECT c_custkey AS k, ['{"', '".join(NAMES)}'] AS names FROM customer),
n AS (SELECT k, names[k % 4 + 1] AS a, names[(k + 1) % 4 + 1] AS b FROM c)
SELECT k AS note_id, CASE k % 4 WHEN 0 THEN a WHEN 1 THEN b END AS full_name, CASE WHEN k % 4 < 2 THEN 'header-line' END AS how FROM n
""")
def known_names(spark, sf_dir):
    """Headers with two names about customers: the one that was known beforehand is the patient's; with another or none known, neither is."""
    k = F.col("c_custkey")
    name = lambda n: F.element_at(F.array(*map(F.lit, NAMES)), (n % len(NAMES) + 1).cast("int"))
    note = F.concat_ws(" · ", name(k), name(k + 1), F.concat(F.lit("S"), F.lpad(k.cast("string"), 7, "0"), F.lit("D")), F.lit("04/11/1972"))
    known = F.when(k % 4 == 0, F.upper(name(k))).when(k % 4 == 1, name(k + 1)).when(k % 4 == 2, "Somebody Else")
    notes = t(spark, sf_dir, "customer").select(k.alias("note_id"), note.alias("text"), known.alias("known_name"))
    got = extract.parsed(notes, F.lit(AS_OF).cast("date")).filter("field = 'full_name'").select(F.col("note_id").alias("n"), "value", "how")
    return notes.join(got, F.col("note_id") == F.col("n"), "left").select("note_id", F.col("value").alias("full_name"), "how")


ASKS = (
    ("Patient's Full Name", "full_name"), ("Hospital name", None), ("Name of the Patient", "full_name"), ("NRIC No.", "nric"), ("D.O.B", "dob"), ("Please enter the Policy Number", "policy_number"), ("Name of attending physician", None),
    ("Contact No", "phone"), ("Date of Birth", "dob"), ("Plan", None), ("Insurance company", "insurer"), ("the the", None), ("Residential Address", "address"),
)
ASKED_ROWS = ", ".join(f"({k}, {_sql_text(a)}, {_sql_text(f)})" for k, (a, f) in enumerate(ASKS))


@query(f"""
WITH c AS (SELECT c_nationkey AS page, c_custkey AS ord, a.label, a.field, c_custkey % 7 = 0 AS again FROM customer JOIN (VALUES {ASKED_ROWS}) a(k, label, field) ON (c_custkey // 25) % {len(ASKS)} = a.k),
d AS (SELECT *, CASE WHEN NOT again THEN field END AS attr FROM c)
SELECT page, ord, label, CASE WHEN attr IS NOT NULL AND count(attr) OVER (PARTITION BY page, attr) = 1 THEN 'demographics.' || attr ELSE 'llm' END AS source FROM d
""")
def label_sources(spark, sf_dir):
    """Labels of forms by nation: which one of the patient's own fields each asks for, if only one does and it isn't asked once an entry."""
    k = F.floor(F.col("c_custkey") / 25) % len(ASKS) + 1
    label = F.element_at(F.array(*[F.lit(a) for a, _ in ASKS]), k.cast("int"))
    c = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("page"), F.col("c_custkey").alias("ord"), label.alias("label"), F.when(F.col("c_custkey") % 7 == 0, F.lit(2)).alias("instance"))
    return live.sources(c).select("page", "ord", "label", "source")


def _lines(spark, sf_dir):
    """One line of each number of an order."""
    ways = F.array(*map(F.lit, ("AIR", "RAIL", "SHIP", "TRUCK")))
    lines = t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_quantity", "l_returnflag")])
    return lines.withColumn("l_way", F.element_at(ways, (F.col("l_partkey") % 4 + 1).cast("int")))


def _controls(spark, sf_dir):
    c = _lines(spark, sf_dir)
    label = F.when(F.col("l_way") == "RAIL", "").otherwise(F.concat(F.lit("Way of "), F.lower("l_way"), F.lit(", call 91234567")))
    return c.select((F.col("l_orderkey") % 200).alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), label.alias("label"), F.when(F.col("l_linenumber") == 1, "date").when(F.col("l_linenumber") == 2, "radio-group").otherwise("select-one").alias("type"),
                    F.array(F.col("l_returnflag"), F.lit(" ")).alias("options"), F.lit("").alias("description"), F.when(F.col("l_linenumber") == 3, F.lit(4)).alias("instance"))


@query("""
SELECT l_orderkey % 200 AS page, CAST(count(*) FILTER (WHERE ['AIR', 'RAIL', 'SHIP', 'TRUCK'][l_partkey % 4 + 1] <> 'RAIL') AS BIGINT) AS n_fields,
       CASE WHEN count(*) FILTER (WHERE ['AIR', 'RAIL', 'SHIP', 'TRUCK'][l_partkey % 4 + 1] <> 'RAIL') = 0 THEN 'no labelled fields' WHEN count(*) FILTER (WHERE ['AIR', 'RAIL', 'SHIP', 'TRUCK'][l_partkey % 4 + 1] <> 'RAIL') > 50 THEN 'too many fields' END AS error
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) AS l GROUP BY ALL
""")
def live_limits(spark, sf_dir):
    return live.page_errors(_controls(spark, sf_dir))


@query("""
WITH c AS (SELECT l_orderkey AS page, l_linenumber AS ord, 'Way of ' || lower(['AIR', 'RAIL', 'SHIP', 'TRUCK'][l_partkey % 4 + 1]) || CASE WHEN l_linenumber = 3 THEN ', call 91234567 (entry 4)' ELSE ', call 91234567' END AS raw,
             trim(regexp_replace('way_of_' || lower(['AIR', 'RAIL', 'SHIP', 'TRUCK'][l_partkey % 4 + 1]) || CASE WHEN l_linenumber = 3 THEN '_call_91234567_entry_4' ELSE '_call_91234567' END, '[^a-z0-9]+', '_', 'g'), '_') AS base, l_linenumber AS n, l_returnflag AS flag FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) AS l),
k AS (SELECT *, row_number() OVER (PARTITION BY page, base ORDER BY ord) AS r FROM c)
SELECT page, ord, base || CASE WHEN r > 1 THEN '_' || r ELSE '' END AS id, CASE n WHEN 1 THEN 'date' WHEN 2 THEN 'checkbox' ELSE 'text' END AS type, 'llm' AS source, replace(raw, '91234567', '[PHONE_2]') AS label, flag AS options FROM k
""")
def live_fields(spark, sf_dir):
    """Orders' lines as controls of a page each: entry labels, numbered ids, types, scrubbed labels and options."""
    c = _lines(spark, sf_dir)
    c = c.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("Way of "), F.lower("l_way"), F.lit(", call 91234567")).alias("label"), F.when(F.col("l_linenumber") == 1, "Date").when(F.col("l_linenumber") == 2, "radio-group").otherwise("number").alias("type"), F.array(F.col("l_returnflag"), F.lit(" ")).alias("options"), F.lit("").alias("description"), F.when(F.col("l_linenumber") == 3, F.lit(4)).alias("instance"))
    return live.live_fields(c).select("page", "ord", "id", "type", "source", "label", F.array_join("options", ",").alias("options"))


@query("""
WITH f AS (SELECT p_brand AS form, p_partkey AS field, 1 + p_partkey % 4 AS page, (p_size * 7 % 300) * 1.0 AS x, (p_size * 11 % 700) * 1.0 AS y, p_partkey % 6 = 0 AS tick, p_partkey % 10 = 1 AS token, p_partkey % 11 = 2 AS blank, p_name, 10.0 + p_size % 5 AS h FROM part),
v AS (SELECT * FROM f WHERE NOT blank UNION ALL SELECT 'Brand#11', -p_partkey - 1, NULL, NULL, NULL, false, false, false, p_name, NULL FROM part WHERE p_size = 7)
SELECT form, field, CAST(page AS INTEGER) AS page, CASE WHEN tick THEN 'tick' ELSE 'text' END AS what, CASE WHEN field < 0 THEN 'unknown field' WHEN token AND NOT tick THEN 'unresolved token' WHEN page > 3 THEN 'no such page' END AS error,
       CASE WHEN field >= 0 AND NOT (token AND NOT tick) AND page < 4 THEN CAST(x + 2 AS DOUBLE) END AS left, CASE WHEN field >= 0 AND NOT (token AND NOT tick) AND page < 4 THEN CAST(842 - y - 2 AS DOUBLE) END AS top, CASE WHEN field >= 0 AND tick AND page < 4 THEN CAST(round(least(400, h + 20) * 0.9, 6) AS DOUBLE) END AS tick_size
FROM v
""")
def overlay_rows(spark, sf_dir):
    """Parts as boxes on three pages: ticks, texts, blanks, unknown ids with and without a value, tokens and a page too many."""
    p = t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    box = F.struct((1 + k % 4).cast("int").alias("page"), (F.col("p_size") * 7 % 300).cast("double").alias("x"), (F.col("p_size") * 11 % 700).cast("double").alias("y"), F.lit(400.0).alias("w"), (30.0 + F.col("p_size") % 5).alias("h"), F.lit(None).cast("double").alias("size"))
    fields = p.select(F.col("p_brand").alias("form"), k.alias("field"), box.alias("box"))
    tick = k % 6 == 0
    own = p.select(F.col("p_brand").alias("form"), k.alias("field"), F.when(k % 11 == 2, F.when(~tick, "")).when(~tick, F.when(k % 10 == 1, F.concat("p_name", F.lit(" [NRIC_2]"))).otherwise(F.col("p_name"))).alias("value_str"), F.when(tick, k % 11 != 2).alias("value_bool"))
    odd = p.filter("p_size = 7").select(F.lit("Brand#11").alias("form"), (-k - 1).alias("field"), F.when(k % 4 == 0, F.col("p_name")).when(k % 4 == 1, "").alias("value_str"), F.when(k % 4 == 2, False).alias("value_bool"))
    pages = p.select(F.col("p_brand").alias("form")).distinct().select("form", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("page"), F.lit(842.0).alias("height"))
    got = sinks.overlay_rows(fields, own.union(odd), pages)
    return got.select("form", "field", "page", "what", "error", "left", "top", F.when(F.col("what") == "tick", F.round("size", 6)).alias("tick_size"))


@query("""
WITH w AS (SELECT i + 31 AS code, [278,278,355,556,556,889,667,191,333,333,389,584,278,333,278,278,556,556,556,556,556,556,556,556,556,556,278,278,584,584,584,556,1015,667,667,722,722,667,611,778,722,278,500,667,556,833,722,778,667,778,722,667,611,722,667,944,667,667,611,278,278,278,469,556,333,556,556,500,556,556,278,556,556,222,222,500,222,833,556,556,556,556,333,500,278,556,500,722,500,500,500,334,260,334,584][i] AS w FROM range(1, 96) r(i)),
c AS (SELECT p_partkey, unicode(unnest(string_split(p_name, ''))) AS code FROM part)
SELECT p_partkey, round(sum(coalesce(w, 556)) * 11 / 1000.0, 6) AS width FROM c LEFT JOIN w USING (code) GROUP BY p_partkey
""")
def text_widths(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", F.round(sinks.text_width(F.col("p_name"), F.lit(11)), 6).alias("width"))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_linenumber % 7 AS m, l_quantity > 25 AS yes, ['AIR', 'RAIL', 'SHIP', 'TRUCK'][l_partkey % 4 + 1] AS way FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) AS l)
SELECT l_orderkey AS form, l_linenumber AS name,
       CASE WHEN m = 1 THEN CASE WHEN yes THEN 'Yes' ELSE '/Off' END WHEN m IN (4, 6) THEN way WHEN m = 3 AND NOT yes THEN '/Off' END AS write,
       CAST(CASE WHEN m = 1 OR (m = 3 AND NOT yes) THEN 0 WHEN m IN (4, 6) THEN 2 END AS BIGINT) AS flags,
       CASE WHEN m = 2 THEN 'a tick box wants a yes or no' WHEN m = 3 AND yes THEN 'a tick box without a state' WHEN m = 5 THEN 'not a tick box' WHEN m = 0 THEN 'unknown field' END AS error FROM x
""")
def form_rows(spark, sf_dir):
    """Orders' lines as values for a file's own fields: tick boxes with and without a state, wrong kinds, comb fields, unknown names with and without a value."""
    x = _lines(spark, sf_dir).withColumn("m", F.col("l_linenumber") % 7)
    m = F.col("m")
    box = m.isin(1, 2, 3)
    fields = x.filter("m <> 0").select(F.col("l_orderkey").alias("form"), F.col("l_linenumber").alias("name"), F.when(box, "/Btn").otherwise("/Tx").alias("kind"), F.when(m == 3, F.array(F.lit("/Off"))).otherwise(F.array(F.lit("/Off"), F.lit("Yes"), F.lit("No"))).alias("states"), F.when(box, 0).otherwise((1 << 24) + (1 << 23) + 2).alias("flags"))
    yes = F.col("l_quantity") > 25
    values = x.select(F.col("l_orderkey").alias("form"), F.col("l_linenumber").alias("name"), F.when(m.isin(2, 4, 6) | ((m == 0) & yes), F.col("l_way")).alias("value_str"), F.when(m.isin(1, 3, 5), yes).alias("value_bool"))
    return sinks.form_rows(fields, values)


@query("""
WITH f AS (SELECT DISTINCT l_orderkey AS form, l_linenumber AS field FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) AS l),
u AS (SELECT o_orderkey AS form, string_agg(f.n::VARCHAR, ', ' ORDER BY f.n::VARCHAR) AS ids FROM orders, (VALUES (1), (6), (12)) f(n) WHERE NOT EXISTS (SELECT 1 FROM f x WHERE x.form = o_orderkey AND x.field = f.n) GROUP BY 1)
SELECT o_orderkey AS form, CASE WHEN o_orderstatus = 'F' THEN 'filled in the browser' ELSE 'unknown field ids: ' || ids END AS error FROM orders LEFT JOIN u ON form = o_orderkey WHERE (o_orderstatus = 'F' OR ids IS NOT NULL)
""")
def fill_errors(spark, sf_dir):
    """Orders as forms of as many fields as they have lines, each asked to fill fields 1, 6 and 12."""
    o = t(spark, sf_dir, "orders")
    fields = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("form"), F.col("l_linenumber").cast("int").alias("field")).distinct()
    values = o.select(F.col("o_orderkey").alias("form"), F.explode(F.array(*map(F.lit, (1, 6, 12)))).alias("field"))
    forms = o.select(F.col("o_orderkey").alias("form"), F.when(F.col("o_orderstatus") == "F", "web").otherwise("overlay").alias("fill_mode"))
    return sinks.fill_errors(forms, fields, values)


@query("""
WITH a AS (SELECT c_custkey AS k, md5(c_custkey::VARCHAR) AS key FROM customer)
SELECT k, CASE WHEN k % 4 = 0 THEN CASE WHEN k % 8 = 0 THEN 'curated' END WHEN k % 4 = 1 THEN 'carried' WHEN k % 4 = 2 THEN CASE WHEN k % 3 = 0 THEN 'banked' END WHEN k % 24 = 3 THEN 'banked' END AS found_in FROM a
""")
def schema_chain(spark, sf_dir):
    """Customers ask for forms: our own (some unknown, some with a schema of theirs that doesn't count), uploaded with a schema along, and banked."""
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.md5(F.col("c_custkey").cast("string").cast("binary")).alias("key"))
    k = F.col("k")
    own = c.withColumn("form_id", F.when(k % 4 == 0, F.concat(F.lit("form_"), k.cast("string"))).otherwise(F.concat(F.lit("upload_"), "key")))
    asked = own.select("k", "form_id", F.when(k % 4 < 2, F.lit("theirs")).alias("carried"))
    curated = own.filter("k % 8 = 0").select("form_id", F.lit("ours").alias("schema"))
    banked = c.filter("(k % 4 = 2 AND k % 3 = 0) OR k % 24 = 3").select("key", F.lit("kept").alias("schema"))
    return sinks.resolved_schemas(asked, curated, banked).select("k", "found_in")


@query("""
WITH a AS (SELECT page_id AS k, substr(sha256(html), 1, 32) AS key, html FROM pages),
b AS (SELECT DISTINCT key FROM a WHERE k % 3 = 0), j AS (SELECT a.*, b.key IS NOT NULL AS kept FROM a LEFT JOIN b USING (key))
SELECT k, CASE WHEN k % 5 = 0 THEN 'path' WHEN k % 5 = 1 THEN 'carried' WHEN k % 5 = 2 THEN NULL WHEN kept THEN 'banked' END AS source,
       CASE WHEN k % 5 = 2 THEN 'another form''s file' WHEN k % 5 > 2 AND NOT kept THEN 'the blank form is gone' END AS error FROM j
""")
def blank_chain(spark, sf_dir):
    """Pages as blank forms: our own files, bytes that came along and are or aren't that form's, the bank's, or gone."""
    p = t(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), F.encode("html", "utf-8").alias("b")).withColumn("key", F.substring(F.sha2("b", 256), 1, 32))
    k = F.col("k")
    path = F.when(k % 5 == 0, "forms/own.pdf").otherwise(F.concat(F.lit("bank://"), "key"))
    asked = p.select("k", F.concat(F.lit("upload_"), "key").alias("form_id"), path.alias("pdf_path"), F.when(k % 5 == 1, F.col("b")).when(k % 5 == 2, F.encode(F.lit("else"), "utf-8")).alias("carried"))
    return sinks.blank_forms(asked, p.filter("k % 3 = 0").select("key")).select("k", "source", "error")


@query("""
SELECT page_id, substr(html, 1, 1) = '<' AS has_file, CASE WHEN page_id % 9 = 0 THEN 'not readable' WHEN page_id % 9 = 1 THEN 'empty' WHEN page_id % 125 = 3 THEN 'too large' END AS error FROM pages
""")
def upload_guards(spark, sf_dir):
    """Pages as uploads: some not in base64, some empty, some of more than 20 MB."""
    k = F.col("page_id")
    p = t(spark, sf_dir, "pages")
    large = F.base64(F.encode(F.repeat(F.lit("x"), 20 * 1024 * 1024 + 1), "utf-8"))
    encoded = F.when(k % 9 == 0, "?no base64?").when(k % 9 == 1, "").when(k % 125 == 3, large).otherwise(F.base64(F.encode("html", "utf-8")))
    files = p.select(k.alias("file"), encoded.alias("encoded"))
    bad = sinks.upload_errors(files)
    return bad.join(p.select("page_id", F.col("html").startswith("<").alias("has_file")), F.col("file") == F.col("page_id")).select("page_id", "has_file", "error")


WIDGETS = """
w AS (SELECT p_brand AS form, 1 + p_partkey % 3 AS page, p_partkey AS k, p_name AS name, p_partkey % 5 = 0 AS box, CASE p_partkey % 6 WHEN 0 THEN 'date' WHEN 1 THEN 'checkbox' WHEN 2 THEN 'number' ELSE 'text' END AS told, p_partkey % 7 <> 0 AS inc, CASE WHEN p_partkey % 8 = 0 THEN ' ' ELSE ' ' || p_type || ' ' END AS label FROM part),
r AS (SELECT *, CASE WHEN box THEN 'checkbox' WHEN told IN ('checkbox', 'number') THEN 'text' ELSE told END AS type FROM w WHERE inc AND trim(label) <> '' AND NOT (page = 2 AND form = 'Brand#11')),
n AS (SELECT *, rtrim(left(trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_'), 40), '_') AS base, row_number() OVER (PARTITION BY form ORDER BY page, k) - 1 AS ord FROM r)
"""


@query(f"""
WITH {WIDGETS}
SELECT form, CAST(ord AS INTEGER) AS ord, base || CASE WHEN row_number() OVER (PARTITION BY form, base ORDER BY ord) > 1 THEN '_' || row_number() OVER (PARTITION BY form, base ORDER BY ord) ELSE '' END AS id,
       name AS pdf_field_name, type, trim(label) AS label, CASE WHEN type = 'checkbox' THEN '' ELSE 'a' END AS options FROM n
""")
def intake_boxes(spark, sf_dir):
    """Small parts as boxes of their brand's form: replies name some of them, one page's reply can't be read, and the file decides what is a tick box."""
    p = t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    page = (1 + k % 3).cast("int")
    widgets = p.select(F.col("p_brand").alias("form"), page.alias("page"), k.alias("ord"), F.col("p_name").alias("name"), F.when(k % 5 == 0, "/Btn").otherwise("/Tx").alias("kind"), F.array().cast("array<string>").alias("states"), F.array().cast("array<string>").alias("nearby"))
    told = F.when(k % 6 == 0, "date").when(k % 6 == 1, "checkbox").when(k % 6 == 2, "number").otherwise("text")
    said = intake.pages_of(widgets).join(p.select(k.alias("ord"), told.alias("told"), (k % 7 != 0).alias("include"), F.when(k % 8 == 0, " ").otherwise(F.concat(F.lit(" "), "p_type", F.lit(" "))).alias("label")), "ord")
    box = F.struct("ref", "label", F.lit("").alias("description"), F.col("told").alias("type"), F.array(F.lit("a"), F.lit(" ")).alias("options"), "include")
    replies = said.groupBy("form", "page").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("ord", box.alias("b"))))["b"].alias("boxes"))).alias("reply"))
    replies = replies.withColumn("reply", F.when((F.col("form") == "Brand#11") & (F.col("page") == 2), "{").otherwise(F.col("reply")))
    return intake.described_boxes(widgets, replies).select("form", "ord", "id", "pdf_field_name", "type", "label", F.array_join("options", ",").alias("options"))


@query("""
WITH b AS (SELECT s_nationkey AS form, 1 + s_suppkey % 14 AS page, s_suppkey AS k, (s_suppkey % 50) / 40.0 AS x, (s_suppkey % 30) / 30.0 - 0.1 AS y, (s_suppkey % 9) / 10.0 AS w, (s_suppkey % 5) / 20.0 AS h FROM supplier),
c AS (SELECT *, least(w, 1 - x) AS cw, least(h, 1 - y) AS ch FROM b WHERE page <= 12 AND x >= 0 AND y >= 0 AND x < 1 AND y < 1 AND w > 0 AND h > 0 AND x + w <= 1.02 AND y + h <= 1.02)
SELECT form, CAST(page AS INTEGER) AS page, k, round(x * 600, 6) AS x, round(y * 800, 6) AS y, round(cw * 600, 6) AS w, round(ch * 800, 6) AS h, 'supplier_' || k AS id FROM c WHERE cw >= 0.01 AND ch >= 0.004 AND cw * ch <= 0.25
""")
def intake_pages(spark, sf_dir):
    """Suppliers as boxes that a reader of pictures found, most of which can't be; pages beyond the twelfth aren't read."""
    s, k = t(spark, sf_dir, "supplier"), F.col("s_suppkey")
    part = lambda n, d: (k % n).cast("double") / d
    one = F.struct(F.concat(F.lit("Supplier "), k.cast("string")).alias("label"), F.lit("text").alias("type"), part(50, 40).alias("x"), (part(30, 30) - 0.1).alias("y"), part(9, 10).alias("w"), part(5, 20).alias("h"))
    own = s.select(F.col("s_nationkey").alias("form"), (1 + k % 14).cast("int").alias("page"), one.alias("b"))
    replies = own.groupBy("form", "page").agg(F.to_json(F.struct(F.collect_list("b").alias("fields"))).alias("reply"))
    pages = own.select("form", "page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height")).distinct()
    got = intake.described_pages(pages, replies)
    return got.select("form", "box.page", F.regexp_extract("label", "[0-9]+", 0).cast("long").alias("k"), *[F.round(f"box.{c}", 6).alias(c) for c in "xywh"], "id")


@query("""
SELECT p_partkey AS k, CAST(p_size % 7 AS DOUBLE) AS x, CAST(842.0 - ((p_size % 11) * 10 + 20) AS DOUBLE) AS y, CAST(30 AS DOUBLE) AS w, CAST(20 AS DOUBLE) AS h, round(1500.0 / greatest(600 + p_size, 842), 9) AS zoom, p_size * 13 >= 40 * greatest(p_size % 5, 1) / 2.0 AS has_text, p_size % 4 = 1 AS has_answer FROM part
""")
def page_shapes(spark, sf_dir):
    """Corners of rectangles, sizes, characters and values of parts as if they were pages and their fields."""
    p, n = t(spark, sf_dir, "part"), F.col("p_size")
    box = geometry.flipped((n % 7 + 30).cast("double"), (n % 11 * 10).cast("double"), (n % 7).cast("double"), (n % 11 * 10 + 20).cast("double"), F.lit(842.0))
    value = F.when(n % 4 == 0, " ").when(n % 4 == 1, "x").when(n % 4 == 2, " /Off")
    return p.select(F.col("p_partkey").alias("k"), box.alias("b"), F.round(geometry.zoom((600 + n).cast("double"), F.lit(842.0)), 9).alias("zoom"), geometry.has_text(n * 13, n % 5).alias("has_text"), geometry.has_answer(value).alias("has_answer")).select("k", "b.*", "zoom", "has_text", "has_answer")


@query("""
WITH x AS (SELECT c_custkey AS claim, c_custkey % 3 = 0 AS touched, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS typed, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS found, c_custkey % 7 = 0 AS asking, c_mktsegment AS insurer FROM customer),
v AS (SELECT *, CASE WHEN touched THEN typed ELSE coalesce(found, '') END AS value FROM x),
s AS (SELECT *, NOT touched AND trim(value) = '' AND asking AS shown FROM v)
SELECT claim, value, CAST(CASE WHEN shown THEN 2 ELSE 0 END AS BIGINT) AS n_choices, CASE WHEN shown THEN 'needs checking' WHEN trim(value) = '' THEN 'nothing found' WHEN touched THEN 'typed' ELSE 'found' END AS badge,
       CASE WHEN trim(value) = '' AND NOT touched AND NOT shown THEN insurer ELSE value END AS with_insurer FROM s
""")
def panel_details(spark, sf_dir):
    """Customers' details after a new parse: what was typed stays, candidates are offered for blanks, and a blank insurer comes from the form."""
    c, k = t(spark, sf_dir, "customer"), F.col("c_custkey")
    state = c.select(k.alias("claim"), F.lit("phone").alias("field"), F.when(k % 5 == 0, "").otherwise(F.col("c_mktsegment")).alias("value"), (k % 3 == 0).alias("touched"))
    parse = c.select(k.alias("claim"), F.lit("phone").alias("field"), F.when(k % 4 != 0, F.col("c_name")).alias("value"), F.when(k % 7 == 0, F.array(F.lit("a"), F.lit("b"))).alias("choices"))
    got = panel.merged_details(state, parse).join(c.select(k.alias("ck"), "c_mktsegment"), F.col("claim") == F.col("ck"))
    return got.select("claim", "value", F.size("choices").cast("long").alias("n_choices"), "badge", panel.inferred_insurer(F.col("value"), F.col("touched"), F.col("choices"), F.col("c_mktsegment")).alias("with_insurer"))


@query("""
WITH r AS (SELECT l_orderkey AS claim, l_linenumber AS id, CASE WHEN l_linenumber % 3 = 0 THEN CASE WHEN l_quantity > 25 THEN '' ELSE 'edited' END WHEN l_returnflag = 'A' THEN NULL ELSE ['AIR', 'RAIL', 'SHIP', 'TRUCK'][l_partkey % 4 + 1] END AS v, l_returnflag = 'R' AS held, l_linenumber = 2 AS ok FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) AS l)
SELECT claim, string_agg(id || '=' || v, ',' ORDER BY id) AS plan FROM (SELECT DISTINCT * FROM r) WHERE trim(v) <> '' AND (NOT held OR ok) GROUP BY claim
""")
def fill_values(spark, sf_dir):
    """Orders' lines as reviewed rows: edits win, even blank ones, and rows held for review go only if confirmed."""
    x = _lines(spark, sf_dir)
    rows = x.select(F.col("l_orderkey").alias("claim"), F.col("l_linenumber").alias("id"), F.when(F.col("l_returnflag") != "A", F.col("l_way")).alias("value_str"), F.lit(None).cast("boolean").alias("value_bool"), (F.col("l_returnflag") == "R").alias("needs_review"))
    edits = x.filter("l_linenumber % 3 = 0").select(F.col("l_orderkey").alias("claim"), F.col("l_linenumber").alias("id"), F.when(F.col("l_quantity") > 25, "").otherwise("edited").alias("edit"))
    confirmed = x.filter("l_linenumber = 2").select(F.col("l_orderkey").alias("claim"), F.col("l_linenumber").alias("id"))
    got = panel.fill_values(panel.effective(rows, edits), confirmed)
    pairs = F.transform(F.map_entries("values"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]))
    return got.select("claim", F.array_join(pairs, ",").alias("plan"))


@query("""
WITH s AS (SELECT o_orderpriority || '|' || o_orderkey % 20 AS page, o_orderstatus AS form, count(*) AS matched, avg(CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END) AS rate, CASE WHEN o_orderstatus = 'P' THEN 0.62 END AS step FROM orders GROUP BY ALL),
f AS (SELECT page, form, coalesce(step, rate) AS fit, matched FROM s),
g AS (SELECT DISTINCT page, split_part(page, '|', 2)::INTEGER AS n FROM f),
h AS (SELECT page, form FROM g, (VALUES ('F', 0), ('F', 1), ('O', 1), ('P', 2)) v(form, m) WHERE n % 4 = m),
c AS (SELECT page, count(*) AS n_host, any_value(form) AS lone FROM h GROUP BY page),
e AS (SELECT f.*, row_number() OVER w AS rn, lead(fit) OVER w AS second FROM f LEFT JOIN h USING (page, form) LEFT JOIN c USING (page) WHERE (n_host IS NULL OR h.form IS NOT NULL) AND matched >= 3 AND fit >= 0.4 WINDOW w AS (PARTITION BY page ORDER BY fit DESC, form))
SELECT g.page, coalesce(b.form, CASE WHEN n_host = 1 THEN lone END) AS form, CASE WHEN b.form IS NOT NULL THEN 'fit' WHEN n_host = 1 THEN 'host' END AS how
FROM g LEFT JOIN (SELECT page, form FROM e WHERE rn = 1 AND round(fit - coalesce(second, -1.0), 9) >= 0.15) b USING (page) LEFT JOIN c USING (page)
""")
def form_detect(spark, sf_dir):
    """Orders as fits of three forms to pages, on hosts that have one, two or none of the forms."""
    o = t(spark, sf_dir, "orders").withColumn("page", F.concat("o_orderpriority", F.lit("|"), (F.col("o_orderkey") % 20).cast("string")))
    s = o.groupBy("page", F.col("o_orderstatus").alias("form")).agg(F.count("*").alias("matched"), F.avg(F.when(F.col("o_totalprice") > 200000, 1.0).otherwise(0.0)).alias("match_rate"))
    s = s.withColumns({"best_step_rate": F.when(F.col("form") == "P", 0.62), "best_step_matched": F.when(F.col("form") == "P", F.col("matched"))})
    n = F.substring_index("page", "|", -1).cast("int") % 4
    pages = o.select("page").distinct().withColumn("host", F.element_at(F.array(*map(F.lit, ("a.insurer.sg", "b.Insurer.sg", "portal.org", "elsewhere.org"))), n + 1))
    hosts = {"F": ["*.a.insurer.sg", "b.insurer.sg"], "O": ["B.insurer.sg", "xportal.org"], "P": ["portal.org"]}
    forms = spark.createDataFrame([(f, f, hs) for f, hs in hosts.items()], "form string, form_ord string, hosts array<string>")
    return panel.detected(pages, forms, s)


@query("""
WITH r AS (SELECT o_custkey AS c, o_orderkey % 7 AS f, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS v, o_orderstatus = 'F' AS held, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 7 ORDER BY o_orderkey) AS n FROM orders),
o AS (SELECT * FROM r WHERE n = 1),
k AS (SELECT c, kind, f, want FROM (SELECT DISTINCT c FROM o), (VALUES ('fills', 0, ''), ('fills', 9, ''), ('blank', 1, ''), ('equals', 2, '1-URGENT'), ('equals', 3, '1-urgent'), ('holds', 4, ''), ('holds', 9, ''), ('forbid_in', 5, 'low'), ('forbid', -1, 'Not Spec')) v(kind, f, want)),
j AS (SELECT k.*, o.c IS NOT NULL AS known, coalesce(v, '') AS v, held, (SELECT string_agg(lower(v), ' ') FROM o x WHERE x.c = k.c AND v <> '') AS whole FROM k LEFT JOIN o ON o.c = k.c AND o.f = k.f),
b AS (SELECT c, CASE WHEN kind = 'forbid' THEN CASE WHEN contains(whole, lower(want)) THEN 'fault' END WHEN kind IN ('fills', 'blank', 'equals') AND NOT known THEN 'fault' WHEN kind = 'fills' AND v = '' THEN 'miss' WHEN kind = 'blank' AND v <> '' THEN 'fault'
  WHEN kind = 'equals' AND v <> want THEN CASE WHEN v = '' THEN 'miss' ELSE 'fault' END WHEN kind = 'holds' AND known AND NOT held THEN 'fault' WHEN kind = 'forbid_in' AND contains(lower(v), want) THEN 'fault' END AS b FROM j)
SELECT c AS "case", CAST(count(*) FILTER (WHERE b = 'fault') AS BIGINT) AS faults, CAST(count(*) FILTER (WHERE b = 'miss') AS BIGINT) AS misses FROM b GROUP BY c
""")
def case_scores(spark, sf_dir):
    """Customers as cases: their orders are the rows, and each is checked in nine ways."""
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case"), (F.col("o_orderkey") % 7).cast("int").alias("field"), F.struct("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("value"), (F.col("o_orderstatus") == "F").alias("needs_review")).alias("r"))
    rows = o.groupBy("case", "field").agg(F.min("r").alias("r")).select("case", "field", "r.value", "r.needs_review")
    kinds = [("fills", 0, ""), ("fills", 9, ""), ("blank", 1, ""), ("equals", 2, "1-URGENT"), ("equals", 3, "1-urgent"), ("holds", 4, ""), ("holds", 9, ""), ("forbid_in", 5, "low"), ("forbid", -1, "Not Spec")]
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(f).alias("field"), F.lit(w).alias("want")) for k, f, w in kinds]))
    checks = rows.select("case").distinct().select("case", every.alias("x")).select("case", "x.*")
    return evalkit.case_scores(rows, checks)


@query("""
WITH x AS (SELECT p_partkey AS field, p_partkey % 3 AS kind, p_partkey % 5 = 0 AS ticked, p_partkey % 2 = 0 AS has_none, ['a', ' B ', 'v3', 'z', ''][p_partkey % 5 + 1] AS value FROM part),
m AS (SELECT *, CASE WHEN trim(lower(value)) IN ('a', 'b', 'v3') OR (has_none AND trim(lower(value)) = 'none of these.') THEN true ELSE false END AS known FROM x)
SELECT field, CASE WHEN ticked OR (kind = 1 AND NOT has_none) OR value = '' OR NOT known THEN 'skipped' ELSE 'filled' END AS status,
       CASE WHEN ticked THEN 'already answered' WHEN kind = 1 AND NOT has_none THEN 'unanswered or none' WHEN value = '' THEN 'no value' WHEN NOT known THEN 'no matching option' END AS reason FROM m
""")
def option_groups(spark, sf_dir):
    """Parts as radio groups, checkbox groups and lone radios: labels or values, groups that say none of them or don't."""
    k = F.col("p_partkey")
    last = F.when(k % 2 == 0, "None of these.").otherwise("Other")
    p = t(spark, sf_dir, "part").select(
        F.lit(1).alias("form"), k.alias("field"), k.alias("ord"), F.element_at(F.array(*map(F.lit, ("radio-group", "checkbox-group", "radio"))), (k % 3 + 1).cast("int")).alias("type"),
        F.element_at(F.array(*map(F.lit, ("a", " B ", "v3", "z", ""))), (k % 5 + 1).cast("int")).alias("value"), F.lit(None).cast("string").alias("existing"), (k % 5 == 0).alias("checked"), F.lit(False).alias("disabled"), F.lit(False).alias("read_only"),
        F.array(F.lit("A"), F.lit("b"), F.lit("C"), last).alias("options"), F.array(*map(F.lit, ("v1", "v2", "V3", "v4"))).alias("option_values"), F.lit(True).alias("safe"),
    )
    return fill.outcomes(p).select("field", "status", "reason")


@query("""
WITH x AS (SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'Policy AB123456789 of' WHEN 1 THEN 'Mail  to a.b@x.sg.' WHEN 2 THEN 'IC s 1234567 d,  9123 4567' WHEN 3 THEN '1234-5678-9012 or 12345678' WHEN 4 THEN ' Ward  B1 ' ELSE 'No 91234567-8' END AS s FROM customer)
SELECT id, CASE id % 6 WHEN 0 THEN 'Policy AB[NUMBER] of' WHEN 1 THEN 'Mail to [EMAIL].' WHEN 2 THEN 'IC [NRIC], [PHONE]' WHEN 3 THEN '[NUMBER] or 12345678' WHEN 4 THEN 'Ward B1' ELSE 'No [PHONE]-8' END AS label, id % 6 <> 4 AS changed FROM x
""")
def label_scrub(spark, sf_dir):
    """Labels of six kinds, and what of them an inventory may show."""
    kinds = ("Policy AB123456789 of", "Mail  to a.b@x.sg.", "IC s 1234567 d,  9123 4567", "1234-5678-9012 or 12345678", " Ward  B1 ", "No 91234567-8")
    s = F.element_at(F.array(*map(F.lit, kinds)), (F.col("c_custkey") % 6 + 1).cast("int"))
    return t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.scrub_label(s).alias("label"), text.scrub_changes(s).alias("changed"))


@query("""
SELECT p_partkey AS id, CAST(2 + p_size AS INTEGER) AS n, p_partkey % 4 <> 0 AND p_size + 2 > 30 AS truncated, p_partkey % 4 = 0 AS withheld, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE least(30, p_size + 2) END AS shown FROM part
""")
def offered_options(spark, sf_dir):
    """Options of parts: thirty at most are shown, and none where one of them holds a number that identifies."""
    k = F.col("p_partkey")
    more = F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: F.concat(F.lit("Option "), i.cast("string")))
    own = F.concat(F.array(F.lit(" "), F.lit("First"), F.when(k % 4 == 0, "Call 91234567").otherwise("Second")), more)
    return spread(t(spark, sf_dir, "part"), "p_partkey").select(k.alias("id"), text.emitted_options(own).alias("o")).select("id", F.col("o.count").alias("n"), "o.truncated", "o.withheld", F.size("o.values").alias("shown"))


FORM_HTML = (
    '<form><h2>Call 91234567</h2><fieldset><legend>Admission {k}</legend><label for=a>Name</label><input id=a name=n required maxlength=40><table><tr><td>Ward</td><td><select name=w><option value="">-<option>A<option selected>B</select></td></tr></table>'
    '<div><input name=late></div><p>Prose</p><input name=prose placeholder="Say S1234567D"><span>Bed</span><input name=bed disabled><label>Yes<input type=radio name=r value=1></label><label>No<input type=radio name=r value=0 checked></label>'
    '<label><input type=checkbox name=c> One</label><label><input type=checkbox name=c> Two</label><input type=checkbox name=lone aria-label="Alone"><input type=password name=p><input type=hidden name=h></fieldset>'
    '<div><b>Entry</b><input name=x1></div><div><b>Entry</b><input name=x2 readonly value=v></div><div style="display: none"><textarea name=t>w</textarea></div></form>'
)
CONTROL_ROWS = """('c1', 'text', 'n', 'Name', 'label[for]', '#a', NULL, 1, false, true, ''), ('c2', 'select', 'w', 'Ward', 'table-cell', 'select[name="w"]', NULL, 1, true, true, '-|A|B'), ('c3', 'text', 'late', '', 'none', 'input[name="late"]', NULL, 1, false, true, ''),
 ('c4', 'text', 'prose', 'Say [NRIC]', 'placeholder', 'input[name="prose"]', NULL, 1, false, true, ''), ('c5', 'text', 'bed', 'Bed', 'preceding-sibling', 'input[name="bed"]', NULL, 1, false, true, ''), ('c6', 'text', 'x1', 'Entry', 'preceding-sibling', 'input[name="x1"]', 1, 1, false, true, ''),
 ('c7', 'text', 'x2', 'Entry', 'preceding-sibling', 'input[name="x2"]', 2, 1, true, true, ''), ('c8', 'text', 't', '', 'none', 'textarea[name="t"]', NULL, 1, true, false, ''), ('c9', 'radio-group', 'r', 'Admission', 'section-heading', 'input[name="r"]', NULL, 2, true, true, 'Yes|No'),
 ('c10', 'checkbox-group', 'c', 'Admission', 'section-heading', 'input[name="c"]', NULL, 2, false, true, 'One|Two'), ('c11', 'checkbox', 'lone', 'Alone', 'aria-label', 'input[name="lone"]', NULL, 1, false, true, '')"""


def _form_pages(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    return t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("https://Portal.example/claims?id="), k).alias("url"), F.replace(F.lit(FORM_HTML), F.lit("{k}"), k).alias("html"))


@query(f"""
SELECT c_custkey AS page_id, v.ref, v.type, v.name, CASE WHEN how = 'section-heading' THEN label || ' ' || c_custkey ELSE label END AS label, how AS label_source, selector, CAST(entry AS INTEGER) AS entry, CAST(members AS INTEGER) AS members, has_value, visible, opts AS options
FROM customer, (VALUES {CONTROL_ROWS}) v(ref, type, name, label, how, selector, entry, members, has_value, visible, opts)
""")
def page_controls(spark, sf_dir):
    """Forms about customers, each with all ways to name a control, groups, entries, hidden parts and types that are left out."""
    c = html.controls(_form_pages(spark, sf_dir), spark.sparkContext.defaultParallelism)
    return c.select("page_id", "ref", "type", "name", "label", "label_source", "selector", F.col("instance").alias("entry"), "members", "has_value", "visible", F.coalesce(F.array_join("options.values", "|"), F.lit("")).alias("options"))


@query("""
SELECT c_custkey AS page_id, 'portal.example' AS host, CAST(11 AS INTEGER) AS control_count, 'Admission ' || c_custkey AS step_hint, CAST(1 AS INTEGER) AS skipped_passwords, CAST(1 AS INTEGER) AS scrubbed_strings,
       'text:1:Name|select:1:Ward|text:1:|text:1:Say [NRIC]|text:1:Bed|text:1:Entry|text:1:Entry|text:0:|radio-group:1:Admission ' || c_custkey || '|checkbox-group:1:Admission ' || c_custkey || '|checkbox:1:Alone' AS signature FROM customer
""")
def page_dumps(spark, sf_dir):
    """What a dump of each of these forms says of the page, and its signature."""
    d = html.dumps(_form_pages(spark, sf_dir), spark.sparkContext.defaultParallelism)
    return d.withColumn("signature", html.signed(F.col("controls"))).select("page_id", "host", "control_count", "step_hint", "skipped_passwords", "scrubbed_strings", "signature")


@query(r"""
SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
       CAST(len(regexp_extract_all(html, '(?i)<(?:select|textarea|input)[\s/>]')) - len(regexp_extract_all(html, '(?i)<input[^>]*type=["'']?(?:password|submit|button|reset|image|file|hidden)')) AS INTEGER) AS control_count,
       CAST(len(regexp_extract_all(html, '(?i)<input[^>]*type=["'']?password')) AS INTEGER) AS skipped_passwords FROM pages
""")
def page_inventory(spark, sf_dir):
    """What the inventory says of each page of the table."""
    return html.dumps(t(spark, sf_dir, "pages"), spark.sparkContext.defaultParallelism).select("page_id", "host", "control_count", "skipped_passwords")


@query("""
WITH c AS (SELECT o_orderkey AS k, o_orderstatus, o_orderkey % 8 AS m FROM orders),
r AS (SELECT k, m, f.id, f.typ FROM c, (VALUES ('name', 'demographics.full_name'), ('seen', 'llm'), ('ward', 'llm'), ('well', 'llm')) f(id, typ) WHERE m NOT IN (0, 1, 2, 3)),
v AS (SELECT k AS claim, id, CASE id WHEN 'name' THEN CASE WHEN m = 4 THEN NULL ELSE 'Tan ' || k END WHEN 'seen' THEN CASE WHEN m = 5 THEN '05/03/24' ELSE '25/03/24' END WHEN 'ward' THEN CASE WHEN m = 6 THEN NULL ELSE 'Ward B1' END ELSE 'true' END AS value,
        CASE id WHEN 'name' THEN 'demographic' WHEN 'seen' THEN 'extracted' WHEN 'ward' THEN CASE WHEN m = 6 THEN 'missing' ELSE 'inferred' END ELSE 'extracted' END AS status FROM r)
SELECT claim, id, value, status, NULL AS error FROM v
UNION ALL SELECT k, NULL, NULL, NULL, CASE m WHEN 0 THEN 'refused' WHEN 1 THEN 'cut short' WHEN 2 THEN 'no text' ELSE 'not readable' END FROM c WHERE m IN (0, 1, 2, 3)
""")
def provider_replay(spark, sf_dir):
    """Orders as claims on one form, answered from recorded replies: answers, off-list and coerced values, demographics copied in, and four kinds of failure."""
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 8).alias("m"))
    claims = o.select("key", F.lit("f").alias("form"), F.concat(F.lit("Seen. [PATIENT] "), F.col("key").cast("string")).alias("redacted_text"))
    none = None
    fields = spark.createDataFrame(
        [("f", 0, "name", "text", "demographics.full_name", none, none), ("f", 1, "seen", "date", "llm", "Date seen, DD/MM/YY", none), ("f", 2, "ward", "text", "llm", none, ["Ward B1", "ICU"]), ("f", 3, "well", "checkbox", "llm", none, none)],
        "form string, ord int, id string, type string, source string, description string, options array<string>",
    )
    one = lambda i, v, s: F.struct(F.lit(i).alias("id"), v.alias("value"), F.lit(s).alias("status"), F.lit("").alias("source"), F.lit("").alias("reasoning"))
    m = F.col("m")
    said = F.to_json(F.struct(F.array(one("seen", F.when(m == 5, "05/03/2024").otherwise("25/03/2024"), "extracted"), one("ward", F.when(m == 6, "Ward C").otherwise(" ward  b1"), "inferred"), one("well", F.lit("True"), "extracted"), one("well", F.lit("false"), "extracted"), one("other", F.lit("x"), "extracted")).alias("fields")))
    asked = provider.map_requests(claims, fields).join(o, "key")
    stop = F.when(m == 0, "refusal").when(m == 1, "max_tokens").otherwise("end")
    recordings = asked.select(F.sha2("prompt", 256).alias("prompt_sha256"), stop.alias("stop"), F.when(m == 2, None).when(m == 3, "{").otherwise(said).alias("reply"))
    records = o.select(F.col("key").alias("claim"), F.when(m != 4, F.concat(F.lit("Tan "), F.col("key").cast("string"))).alias("full_name"))
    rows, bad = provider.mapped(claims, fields, provider.recorded(recordings), records)
    rows = rows.select("claim", "id", F.coalesce("value_str", F.col("value_bool").cast("string")).alias("value"), "status", F.lit(None).cast("string").alias("error"))
    return rows.unionByName(bad.select(F.col("key").alias("claim"), "error"), allowMissingColumns=True)


@query(r"""
WITH x AS (SELECT conv_id, turn, trim(text) AS s FROM conversations), l AS (SELECT conv_id, turn, list_transform(string_split_regex(s, '\r\n|\n|\r'), lambda v: trim(ltrim(trim(v), '-• '))) AS a FROM x WHERE s IS NOT NULL)
SELECT conv_id, turn, CAST(len(list_filter(a, lambda v: v <> '' AND upper(v) <> 'NONE')) AS BIGINT) AS n_found FROM l
""")
def sweep_replies(spark, sf_dir):
    """Turns of conversations as if they were a sweep's replies: a finding a line."""
    c = t(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    return c.select("conv_id", "turn", F.size(provider.sweep_findings(F.col("text"))).cast("long").alias("n_found"))


@query(r"""
WITH x AS (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM conversations), g AS (SELECT conv_id, coalesce(string_agg(s, chr(10) || chr(10) ORDER BY turn, s) FILTER (WHERE s <> ''), '') AS s FROM x GROUP BY conv_id)
SELECT conv_id AS file, CASE WHEN length(s) >= 200 THEN sha256(s) END AS text_sha256, CASE WHEN length(s) < 200 THEN 'hardly any text' END AS error FROM g
""")
def note_pages(spark, sf_dir):
    """Conversations as files whose turns are pages."""
    c = t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("page"), "text")
    return provider.note_text(c, 200).select("file", F.sha2("text", 256).alias("text_sha256"), "error")


@query("""
SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 1 THEN NULL WHEN c_custkey % 3 = 2 THEN 'Seen by Tan ' || c_custkey ELSE NULL END AS source, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE c_custkey % 12 < 10 AND c_custkey % 4 = 2 END AS recheck FROM customer
""")
def citations(spark, sf_dir):
    """Citations with tokens turned back, or dropped where one stays or there is none; and dates of short years that read two ways."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("Tan "), k.cast("string"))
    entries = F.array(F.struct(F.lit("[PATIENT]").alias("token"), name.alias("value")))
    said = F.when(k % 3 == 1, "Told by [REDACTED_9] and [PATIENT]").when(k % 3 == 2, "Seen by [PATIENT]").otherwise("")
    value = F.when(k % 4 == 0, " 5/3/24 ").when(k % 4 == 1, "13/3/24").when(k % 4 == 2, F.concat(F.when(k % 12 == 10, "14").otherwise("04"), F.lit("/11/024"))).otherwise("5 Mar 24")
    return t(spark, sf_dir, "customer").select(k.alias("k"), provider.restored_or_none(said, entries).alias("source"), panel.loose_recheck(F.lit("date"), value).alias("recheck"))


@query(r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
b AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM benchmark),
p AS (SELECT item_id, string_split(q, ' ') AS w FROM b),
s AS (SELECT item_id, array_to_string(w[1:8], ' ') || '. ' || array_to_string(w[9:], ' ') AS q FROM p),
e AS (SELECT item_id, string_split(regexp_replace(q, '([.;]) ', '\1' || chr(10), 'g'), chr(10)) AS ps FROM s),
k AS (SELECT item_id, unnest(range(1, len(ps) + 1)) AS piece, unnest(ps) AS raw FROM e),
f AS (SELECT item_id, piece, raw, 0 AS form FROM k WHERE contains(raw, ' ') UNION ALL SELECT item_id, piece, regexp_replace(raw, '[.,;:]+$', ''), 1 FROM k WHERE contains(raw, ' ')),
h AS (SELECT doc_id, item_id, piece, form, raw, len(string_split(t, raw)) - 1 AS n FROM d JOIN f ON contains(t, raw) WHERE raw <> ''),
o AS (SELECT doc_id, item_id, piece, arg_min(struct_pack(r := raw, n := n), form) AS x FROM h GROUP BY ALL)
SELECT doc_id AS note_id, item_id AS quote_id, CAST(piece AS INTEGER) AS piece, x.r AS found FROM o JOIN s USING (item_id) JOIN d USING (doc_id) WHERE x.n = 1 AND NOT contains(t, q)
""")
def quote_pieces(spark, sf_dir):
    """Benchmark passages cut after their eighth word, as quotes that no note holds whole: the pieces that occur once in the notes."""
    notes = spread(t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(F.col("doc_id").alias("note_id"), text.squashed(F.col("text")).alias("text"))
    w = F.split(text.squashed(F.col("text")), " ")
    asked = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.concat(F.array_join(F.slice(w, 1, 8), " "), F.lit(". "), F.array_join(F.slice(w, F.lit(9), F.size(w)), " ")).alias("quote"))
    return quotes.pieces_located(notes, asked)


@query("""
WITH f AS (SELECT DISTINCT p_brand AS form FROM part), p AS (SELECT DISTINCT p_brand || '|' || (p_size % 4) AS page, p_brand, p_size % 4 AS m FROM part)
SELECT page, p_brand AS form, CAST(CASE m WHEN 0 THEN 6 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS matched, CAST(CASE WHEN m = 1 THEN 3 ELSE 6 END AS BIGINT) AS intended,
       CASE m WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN round(1 / 6.0, 6) ELSE 0.0 END AS match_rate, CASE m WHEN 2 THEN round(1 / 3.0, 6) WHEN 3 THEN 0.0 ELSE 1.0 END AS best_step_rate FROM p WHERE m < 3
""")
def form_scores(spark, sf_dir):
    """Brands as forms of two steps of three questions, on pages that hold all, one step, one question or none of them."""
    p = t(spark, sf_dir, "part").select(F.col("p_brand").alias("form"), (F.col("p_size") % 4).alias("m")).distinct()
    words = ("alpha", "bravo", "carol", "delta", "echo", "fox")
    one = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(words)]))
    label = F.concat(F.col("x.w"), F.lit(" "), F.translate("form", "#0123456789", "xabcdefghij"))
    forms = p.select("form").distinct().select("form", one.alias("x")).select("form", F.col("x.w").alias("field"), F.col("x.i").alias("field_ord"), label.alias("label"), F.when(F.col("x.i") < 3, "one").otherwise("two").alias("step"))
    shown = p.select("form", F.concat_ws("|", "form", F.col("m").cast("string")).alias("page"), "m", one.alias("x")).filter(((F.col("m") == 0) & (F.col("x.i") < 6)) | ((F.col("m") == 1) & (F.col("x.i") < 3)) | ((F.col("m") == 2) & (F.col("x.i") < 1)))
    controls = shown.select("page", F.col("x.w").alias("control"), F.col("x.i").alias("control_ord"), label.alias("label"))
    got = panel.page_scores(forms, controls).filter(F.substring_index("page", "|", 1) == F.col("form"))
    return got.select("page", "form", "matched", "intended", F.round("match_rate", 6).alias("match_rate"), F.round("best_step_rate", 6).alias("best_step_rate"))


@query("""
SELECT p_partkey AS k, CAST(p_size + 2 AS DOUBLE) AS left, CAST(842.0 - p_size - 2 AS DOUBLE) AS top, CASE WHEN p_partkey % 2 = 0 THEN 'field_' || p_partkey END AS value_str, CASE WHEN p_partkey % 2 = 1 THEN true END AS value_bool FROM part WHERE p_size % 5 > 0
""")
def proof_sheet(spark, sf_dir):
    """Parts with a place on a form: the sheet that shows each box's own name or a tick."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("double")
    box = F.when(F.col("p_size") % 5 > 0, F.struct(F.lit(1).alias("page"), n.alias("x"), n.alias("y"), F.lit(90.0).alias("w"), F.lit(20.0).alias("h"), F.lit(None).cast("double").alias("size")))
    fields = t(spark, sf_dir, "part").select(F.lit(1).alias("form"), F.concat(F.lit("field_"), k.cast("string")).alias("field"), F.when(k % 2 == 1, "checkbox").otherwise("text").alias("type"), box.alias("box"))
    at = fields.select(F.col("field").alias("f"), sinks.origin(F.col("box"), F.lit(842.0)).alias("o"))
    both = sinks.proof(fields.withColumn("form", F.substring_index("field", "_", -1).cast("long"))).withColumnRenamed("form", "k")
    at = at.select(F.substring_index("f", "_", -1).cast("long").alias("j"), "o.left", "o.top")
    return both.join(at, F.col("k") == F.col("j")).select("k", "left", "top", "value_str", "value_bool")


@query("""
WITH r AS (SELECT o_orderkey AS claim, o_orderkey % 6 AS m, o_custkey % 3 = 0 AS blank FROM orders),
f AS (SELECT claim, m, blank, v.id FROM r, (VALUES ('who'), ('note'), ('payer'), ('born')) v(id))
SELECT claim, id, CASE id WHEN 'who' THEN CASE WHEN m < 2 THEN 'Seen by Tan ' || claim WHEN m < 4 THEN NULL ELSE 'plain' END WHEN 'note' THEN 'ok' WHEN 'payer' THEN CASE WHEN blank THEN 'Form Mutual' ELSE 'Own Mutual' END ELSE CASE WHEN m = 0 THEN '25/03/1970' ELSE '04/03/1970' END END AS value,
       CASE id WHEN 'who' THEN CASE WHEN m IN (2, 3) THEN 'missing' ELSE 'extracted' END WHEN 'note' THEN 'inferred' ELSE 'demographic' END AS status,
       CASE id WHEN 'who' THEN m IN (2, 3) WHEN 'note' THEN true WHEN 'payer' THEN false ELSE m <> 0 END AS needs_review,
       CASE WHEN id = 'who' AND m NOT IN (2, 3) THEN NULL WHEN id = 'note' THEN 'as Tan ' || claim || ' said' END AS reasoning FROM f
""")
def claim_rows(spark, sf_dir):
    """Orders as claims: tokens turned back or, where one stays, the value blanked; details copied in, the insurer from the form where there is none."""
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim"), (F.col("o_orderkey") % 6).alias("m"), (F.col("o_custkey") % 3 == 0).alias("blank"))
    kinds = (("who", "text", "llm"), ("note", "text", "llm"), ("payer", "text", "demographics.insurer"), ("born", "date", "demographics.dob"))
    f = o.select("*", F.explode(F.array(*[F.struct(F.lit(a).alias("id"), F.lit(b).alias("type"), F.lit(c).alias("source")) for a, b, c in kinds])).alias("x")).select("claim", "m", "x.*")
    who = F.when(F.col("m") < 2, "Seen by [PATIENT]").when(F.col("m") < 4, "By [NRIC_7] and [PATIENT]").otherwise("plain")
    value = F.when(F.col("id") == "who", who).when(F.col("id") == "note", "ok")
    rows = f.select("claim", "id", "type", "source", value.alias("value_str"), F.lit(None).cast("boolean").alias("value_bool"), F.when(F.col("id") == "who", "extracted").when(F.col("id") == "note", "inferred").otherwise("missing").alias("status"), F.lit("by [PATIENT]").alias("quote"), F.lit("as [PATIENT] said").alias("reasoning"), F.lit("Form Mutual").alias("form_insurer"))
    name = F.concat(F.lit("Tan "), F.col("claim").cast("string"))
    maps = o.select("claim", F.array(F.struct(F.lit("[PATIENT]").alias("token"), name.alias("value"))).alias("entries"))
    records = o.select("claim", F.when(F.col("blank"), "").otherwise("Own Mutual").alias("insurer"), F.when(F.col("m") == 0, "1970-03-25").otherwise("1970-03-04").alias("dob"))
    got = review.restored(review.with_demographics(review.assembled(rows), records), maps)
    return got.select("claim", "id", F.col("value_str").alias("value"), "status", "needs_review", "reasoning")


@query("""
WITH p AS (SELECT page_id, substr(sha256(html), 1, 32) AS key FROM pages), c AS (SELECT key, max(page_id) AS page FROM p WHERE page_id % 4 = 0 GROUP BY key), b AS (SELECT DISTINCT key FROM p WHERE page_id % 3 = 0)
SELECT page_id, CASE WHEN c.key IS NOT NULL THEN 'form ' || lpad(c.page::VARCHAR, 9, '0') WHEN b.key IS NOT NULL THEN '{"kept":1}' END AS form, CASE WHEN c.key IS NOT NULL THEN 'curated' WHEN b.key IS NOT NULL THEN 'banked' END AS found_in
FROM p LEFT JOIN c USING (key) LEFT JOIN b USING (key)
""")
def known_forms(spark, sf_dir):
    """Pages asked for by their bytes: our own forms come before the bank's, and of two of ours with the same bytes the later by name counts."""
    p = t(spark, sf_dir, "pages").select("page_id", F.encode("html", "utf-8").alias("content"))
    name = F.concat(F.lit("form "), F.lpad(F.col("page_id").cast("string"), 9, "0"))
    curated = sinks.curated_index(p.filter("page_id % 4 = 0").select(name.alias("form_id"), "content")).withColumnRenamed("form_id", "form")
    kept = p.filter("page_id % 3 = 0").select(bank.key(F.col("content")).alias("key"), F.lit('{"kept":1}').alias("form"))
    return bank.looked_up(p.select("page_id", bank.key(F.col("content")).alias("key")), curated, kept).select("page_id", "form", "found_in")


@query("""
WITH e AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events), q AS (SELECT * FROM e WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) >= 3600000000),
c AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM q)
SELECT event_id, user_id, event_type FROM c WHERE was IS DISTINCT FROM event_type
""")
def settled_changes(spark, sf_dir):
    """Events after which a user is quiet for an hour, where their type differs from that of the quiet point before."""
    q = quiet(t(spark, sf_dir, "events"), "user_id", "ts", ["event_id"], 3600)
    return changes(q, "user_id", ["ts", "event_id"], F.col("event_type")).select("event_id", "user_id", "event_type")


#: Users as pages: their clicks are answers, their other events show what the page is; quiet is an hour without those.
POINTS = """
WITH e AS (SELECT user_id::VARCHAR AS page, ts, event_id, CASE WHEN event_type <> 'click' THEN event_type END AS sig FROM events),
q AS (SELECT *, lead(ts) OVER (PARTITION BY page ORDER BY ts, event_id) AS nxt FROM e WHERE sig IS NOT NULL),
d AS (SELECT *, sig IS DISTINCT FROM lag(sig) OVER (PARTITION BY page ORDER BY ts, event_id) AS changed FROM q WHERE (nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) >= 3600000000) AND {decided}),
c AS (SELECT *, lag(ts) OVER (PARTITION BY page ORDER BY ts, event_id) AS was FROM d WHERE changed),
n AS (SELECT c.event_id, count(*) AS n FROM c JOIN e ON e.page = c.page AND e.sig IS NULL AND epoch_us(e.ts) <= epoch_us(c.ts) + 3600000000 AND (was IS NULL OR epoch_us(e.ts) > epoch_us(was) + 3600000000) GROUP BY 1)
SELECT page, event_id AS ord, sig, changed, CAST(coalesce(n, 0) AS BIGINT) AS discarded FROM d LEFT JOIN n USING (event_id)
"""


def _page_events(e):
    return e.select(F.col("user_id").alias("page"), F.col("ts").alias("at"), F.col("event_id").alias("ord"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("sig"))


@query(POINTS.format(decided="true"))
def quiet_points(spark, sf_dir):
    """Where each page comes to rest, whether it has changed by then, and how many answers the change ends."""
    return pages.points_of(_page_events(t(spark, sf_dir, "events")), 3600).drop("at")


@query(POINTS.format(decided="epoch_us(ts) + 3600000000 < (SELECT max(epoch_ms(ts)) FROM events) * 1000"))
def streamed_points(spark, sf_dir):
    """The same from a stream with state and timers: what is decided when the stream has read all events."""
    source = spark.readStream.schema(t(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/[e]vents.parquet")
    return pages.drained(pages.points(_page_events(source), 3600), temporary_folder(spark, "points")).drop("at")


@query("""
WITH c AS (SELECT DISTINCT user_id FROM events WHERE event_id % 50 = 0), r AS (SELECT e.user_id AS page, e.event_type AS label FROM events e WHERE e.user_id NOT IN (SELECT user_id FROM c))
SELECT page, CAST(count(*) AS BIGINT) AS n, count(*)::VARCHAR AS text FROM r GROUP BY page
""")
def after_change(spark, sf_dir):
    """Users' events as answers to their pages' questions: those of pages that changed go, the others are counted."""
    e = t(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_type").alias("label"), "event_id")
    return panel.questions_left(panel.after_change(e, e.filter("event_id % 50 = 0"))).select("page", "n", "text")


@query("""
WITH r AS (SELECT o_custkey AS form, count(*) FILTER (WHERE o_orderkey % 3 = 0 AND o_custkey % 10 > 0) AS filled, count(*) AS planned FROM orders GROUP BY ALL)
SELECT form, CAST(filled AS BIGINT) AS filled, CAST(planned AS BIGINT) AS planned, form % 10 = 0 AS refused FROM r
""")
def filled_counts(spark, sf_dir):
    """Orders as outcomes of their customers' forms: how many were filled, and which forms were refused as a whole."""
    unsafe, ok = F.col("o_custkey") % 10 == 0, F.col("o_orderkey") % 3 == 0
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("form"), F.when(ok & ~unsafe, "filled").otherwise("skipped").alias("status"), F.when(unsafe, "match is not safe").when(~ok, "no value").alias("reason"))
    return fill.filled_counts(o)


@query(r"""
WITH p AS (SELECT p_brand AS form, p_partkey AS field, p_partkey % 5 AS m, p_size, CASE WHEN p_partkey % 7 = 0 THEN 'skipped' ELSE 'filled' END AS status FROM part),
x AS (SELECT *, CASE m WHEN 0 THEN p_size % 2 = 0 WHEN 1 THEN p_size <= 28 WHEN 2 THEN p_size % 3 > 0 WHEN 3 THEN true ELSE p_size % 4 > 0 END AS ok,
             CASE m WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN '-' || p_size || '.5' ELSE p_size || ' mg' END WHEN 1 THEN '2023-02-' || lpad(p_size::VARCHAR, 2, '0') WHEN 2 THEN CASE WHEN p_size % 3 > 0 THEN 'a@b.sg' ELSE ' a@b.sg' END
                    WHEN 3 THEN 'one' || chr(10) || 'two' ELSE CASE WHEN p_size % 4 > 0 THEN 'plain' ELSE 'one' || chr(10) || 'two' END END AS asked FROM p)
SELECT form, field, CASE WHEN status = 'filled' AND NOT ok THEN 'skipped' ELSE status END AS status, CASE WHEN status = 'skipped' THEN 'no value' WHEN NOT ok THEN 'value not taken' END AS reason, CASE WHEN status = 'filled' AND ok THEN asked ELSE 'before' END AS now FROM x
""")
def values_read_back(spark, sf_dir):
    """Parts as controls of five kinds after writing: what a control didn't keep is undone and told."""
    k, n = F.col("p_partkey"), F.col("p_size")
    m, two = k % 5, F.lit("one\ntwo")
    kind = F.when(m == 0, "number").when(m == 1, "date").when(m == 2, "email").when(m == 3, "textarea").otherwise("text")
    value = F.when(m == 0, F.when(n % 2 == 0, F.concat(F.lit("-"), n.cast("string"), F.lit(".5"))).otherwise(F.concat(n.cast("string"), F.lit(" mg")))).when(m == 1, F.concat(F.lpad(n.cast("string"), 2, "0"), F.lit("/02/2023")))
    value = value.when(m == 2, F.when(n % 3 > 0, "a@b.sg").otherwise(" a@b.sg")).when(m == 3, two).otherwise(F.when(n % 4 > 0, "plain").otherwise(two))
    out = k % 7 == 0
    rows = t(spark, sf_dir, "part").select(F.col("p_brand").alias("form"), k.alias("field"), kind.alias("type"), value.alias("value"), F.lit("before").alias("existing"), F.when(out, "skipped").otherwise("filled").alias("status"), F.when(out, "no value").alias("reason"))
    return fill.read_back(rows)


@query("""
WITH f AS (SELECT p_brand AS form, string_agg('"b' || (n - 1) || '"', ',' ORDER BY n) AS refs FROM (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) GROUP BY 1)
SELECT form, '{"type":"object","properties":{"boxes":{"type":"array","items":{"type":"object","properties":{"ref":{"type":"string","enum":[' || refs || ']},"label":{"type":"string"},"description":{"type":"string"},"type":{"type":"string","enum":["text","date","checkbox"]},"options":{"type":"array","items":{"type":"string"}},"include":{"type":"boolean"}},"required":["ref","label","description","type","options","include"],"additionalProperties":false}}},"required":["boxes"],"additionalProperties":false}' AS boxes,
 '{"type":"object","properties":{"fields":{"type":"array","items":{"type":"object","properties":{"id":{"type":"string","enum":[' || refs || ']},"value":{"type":"string"},"status":{"type":"string","enum":["extracted","inferred","missing"]},"source":{"type":"string"},"reasoning":{"type":"string"}},"required":["id","value","status","source","reasoning"],"additionalProperties":false}}},"required":["fields"],"additionalProperties":false}' AS answers FROM f
""")
def reply_grammars(spark, sf_dir):
    """What replies about a brand's boxes and questions must look like."""
    p = t(spark, sf_dir, "part").select(F.col("p_brand").alias("form"), F.lit(1).alias("page"), F.col("p_partkey").alias("ord"))
    refs = intake.pages_of(p).groupBy("form").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "ref"))), lambda x: x["ref"]).alias("refs"))
    return refs.select("form", intake.box_grammar(F.col("refs")).alias("boxes"), intake.answer_grammar(F.col("refs")).alias("answers"))


@query("""
WITH w AS (SELECT p_brand AS form, p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n, p_name, p_size FROM part),
l AS (SELECT form, string_agg('<box ref="b' || n || '" pdf_name="' || p_name || '" type="' || CASE WHEN p_size = 1 THEN 'checkbox' WHEN p_size = 2 THEN 'choice' ELSE 'text' END || '" nearby="Near | ' || p_size || '"' || CASE WHEN p_size < 3 THEN ' accepts="Yes | No"' ELSE '' END || ' />', chr(10) ORDER BY k) AS lines FROM w GROUP BY form)
SELECT form, '<page number="1">' || chr(10) || '<printed_text>' || chr(10) || 'Printed ' || form || chr(10) || '</printed_text>' || chr(10) || '<boxes>' || chr(10) || lines || chr(10) || '</boxes>' || chr(10) || '</page>' AS prompt FROM l
""")
def page_prompts(spark, sf_dir):
    """Parts as the boxes of their brand's page, as a reader of pages is asked about them."""
    n, none = F.col("p_size"), F.array().cast("array<string>")
    w = t(spark, sf_dir, "part").select(F.col("p_brand").alias("form"), F.lit(1).alias("page"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.when(n == 1, "/Btn").when(n == 2, "/Ch").otherwise("/Tx").alias("kind"), F.when(n < 3, F.array(F.lit("Yes"), F.lit("No"))).otherwise(none).alias("states"), F.array(F.lit("Near"), n.cast("string")).alias("nearby"))
    printed = w.select("form", "page", F.concat(F.lit("Printed "), "form").alias("text")).distinct()
    return intake.page_prompts(w, printed).select("form", "prompt")


@query("""
WITH f AS (SELECT p_brand AS form, string_agg('{"id":"f' || p_partkey || '","type":"text","description":"' || CASE WHEN p_size = 2 THEN '' ELSE p_type END || '"' || CASE WHEN p_size = 1 THEN ',"options":["a","b"]' ELSE '' END || '}', ',' ORDER BY p_partkey) AS qs FROM part WHERE p_partkey % 5 > 0 GROUP BY p_brand)
SELECT form, '[' || qs || ']' AS questions FROM f
""")
def question_lines(spark, sf_dir):
    """Parts as questions of their brand's form; those that the patient's details answer aren't asked."""
    n, k, none = F.col("p_size"), F.col("p_partkey"), F.array().cast("array<string>")
    f = t(spark, sf_dir, "part").select(F.col("p_brand").alias("form"), k.alias("ord"), F.concat(F.lit("f"), k.cast("string")).alias("id"), F.lit("text").alias("type"), F.when(k % 5 > 0, "llm").otherwise("demographics.dob").alias("source"), F.when(n != 2, F.col("p_type")).alias("description"), F.when(n == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(none).alias("options"))
    return provider.question_lines(f)


@query("""
WITH f AS (SELECT c_nationkey AS n, CASE WHEN c_custkey % 4 = 0 THEN 'upload_' || md5(c_custkey::VARCHAR) ELSE 'form_' || c_custkey END AS form_id, c_custkey AS k, c_name, c_mktsegment FROM customer)
SELECT form_id, k || ':' || c_mktsegment || ':text' AS fields, CASE WHEN k % 4 = 0 THEN '{"fields":[{"id":"' || k || '","label":"' || c_mktsegment || '","type":"text"}]}' END AS schema FROM f
""")
def upload_rows(spark, sf_dir):
    """Customers as forms of one field, a quarter of them uploaded: these alone carry their schema."""
    k = F.col("c_custkey")
    uid = F.when(k % 4 == 0, F.concat(F.lit("upload_"), F.md5(k.cast("string").cast("binary")))).otherwise(F.concat(F.lit("form_"), k.cast("string")))
    one = F.struct(k.cast("string").alias("id"), F.col("c_mktsegment").alias("label"), F.lit("text").alias("type"))
    got = sinks.upload_rows(t(spark, sf_dir, "customer").select(uid.alias("form_id"), F.array(one).alias("fields")))
    return got.select("form_id", F.array_join(F.transform("fields", lambda x: F.concat_ws(":", x["id"], x["label"], x["type"])), ",").alias("fields"), "schema")


@query("""
WITH g AS (SELECT p_brand AS grp, p_partkey AS k, p_size % 4 AS m, p_size % 7 = 3 AS shut FROM part),
b AS (SELECT grp, count(*) AS n, count(*) FILTER (WHERE NOT shut) AS live FROM g GROUP BY grp)
SELECT g.grp AS form, k AS field, CASE WHEN b.live < 3 OR b.live < 0.7 * b.n OR shut OR m < 2 THEN 'skipped' ELSE 'filled' END AS status,
       CASE WHEN b.live < 3 OR b.live < 0.7 * b.n THEN 'match is not safe' WHEN shut THEN 'unmatched' WHEN m = 0 THEN 'no value' WHEN m = 1 THEN 'already answered' END AS reason FROM g JOIN b USING (grp)
""")
def filled_page(spark, sf_dir):
    """Parts as a brand's questions on a page that shows the same: located anew and written where nothing stands. Some have a twin that is disabled, some are read-only."""
    p = t(spark, sf_dir, "part")
    k, none, n = F.col("p_partkey"), F.lit(None).cast("string"), F.col("p_size")
    label = F.concat(F.lit("q"), k.cast("string"))
    fields = p.select(F.col("p_brand").alias("grp"), k.alias("field"), k.alias("field_ord"), label.alias("label"), F.lit("").alias("step"))
    shown = lambda rows, ref, off, shut: rows.select(F.col("p_brand").alias("grp"), ref.alias("control"), ref.alias("control_ord"), label.alias("label"), F.lit("text").alias("type"), F.when(n % 4 == 1, "set").alias("existing"), none.alias("shown"), F.lit(False).alias("checked"), off.alias("disabled"), shut.alias("read_only"), F.lit(None).cast("array<string>").alias("options"), F.lit(None).cast("array<string>").alias("option_values"))
    controls = shown(p, 2 * k, F.lit(False), n % 7 == 3).union(shown(p.filter("p_size % 5 = 0"), 2 * k + 1, F.lit(True), F.lit(False)))  # no two controls share an id, whatever the keys
    values = p.select(F.col("p_brand").alias("grp"), k.alias("field"), F.when(n % 4 != 0, "x").alias("value"))
    return fill.filled_page(fields, controls, values)


@query("""
WITH x AS (SELECT p_partkey, p_type, p_size FROM part)
SELECT p_partkey AS k, p_size % 3 = 0 AS hit, CASE WHEN p_size % 2 = 0 THEN upper(substr('date of birth', 1, 1)) || substr('date of birth', 2) ELSE p_type END AS shown FROM x
""")
def hosts_and_labels(spark, sf_dir):
    """Hosts of parts against a form's patterns, and what a field is called."""
    n = F.col("p_size")
    host = F.when(n % 3 == 0, F.when(n % 2 == 0, "Claims.Insurer.SG").otherwise("insurer.sg")).otherwise("notinsurer.sg")
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), match.host_matches(host, F.array(F.lit("*.insurer.sg"), F.lit(""))).alias("hit"), text.display_label(F.when(n % 2 != 0, F.col("p_type")), F.lit("date_of_birth")).alias("shown"))


@query("""
SELECT p_partkey AS k, CASE WHEN p_size % 7 = 0 THEN 'encrypted' WHEN p_size % 5 = 0 THEN 'no pages' WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'scan' ELSE 'nowhere to write' END AS why,
       CASE WHEN p_size % 7 = 0 THEN 'encrypted' WHEN p_size % 5 = 0 THEN 'no pages' END AS why_rendered FROM part
""")
def intake_refusals(spark, sf_dir):
    """Parts as uploads: why each can't be taken in, without and with a way to render pages."""
    n = F.col("p_size")
    why = lambda render: geometry.refusal(n % 7 == 0, F.when(n % 5 == 0, 0).otherwise(2), n % 3 == 0, n % 2 != 0, render)
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), why(False).alias("why"), why(True).alias("why_rendered"))


WORDS = ("true", " Yes", "Y", "ON", "checked", "1", "false", "no ", "N", "Off", "unchecked", "0", "maybe", "", "yes please")


@query("""
SELECT p_partkey AS k, CASE WHEN p_partkey % 15 < 6 THEN true WHEN p_partkey % 15 < 12 THEN false END AS intent FROM part
""")
def tick_words(spark, sf_dir):
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), fill.tick_intent(F.element_at(F.array(*map(F.lit, WORDS)), (F.col("p_partkey") % 15 + 1).cast("int"))).alias("intent"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%-d %B %Y') || CASE WHEN day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) THEN ' (or ' || strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%-d %B %Y') || ')' ELSE '' END AS said FROM orders
""")
def readable_dates(spark, sf_dir):
    from ..functions import dates

    return t(spark, sf_dir, "orders").select("o_orderkey", dates.readable(dates.day_first(F.col("o_orderdate"))).alias("said"))


@query("""
WITH f AS (SELECT o_orderkey, unnest([strftime(o_orderdate, '%d/%m/%Y'), strftime(o_orderdate, '%-d/%-m/%Y'), strftime(o_orderdate, '%d/%m/%y'), strftime(o_orderdate, '%d-%m-%Y'), strftime(o_orderdate, '%-d-%-m-%Y'), strftime(o_orderdate, '%d.%m.%Y'), strftime(o_orderdate, '%-d.%-m.%Y'), strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%-d %b %Y'), strftime(o_orderdate, '%d %b %Y'), strftime(o_orderdate, '%-d %B %Y'), strftime(o_orderdate, '%d %B %Y')]) AS s FROM orders),
d AS (SELECT DISTINCT o_orderkey, s FROM f)
SELECT o_orderkey, string_agg(s, '|' ORDER BY length(s) DESC, s) AS forms FROM d GROUP BY o_orderkey
""")
def birth_renderings(spark, sf_dir):
    """The ways in which a date may stand in a note, the longest first."""
    from ..functions import dates

    o = t(spark, sf_dir, "orders").select("o_orderkey", dates.renderings(F.col("o_orderdate")).alias("r"))
    falls = F.forall(F.sequence(F.lit(1), F.size("r") - 1), lambda i: F.length(F.get("r", i - 1)) >= F.length(F.get("r", i)))
    ordered = F.array_sort(F.transform("r", lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    return o.select("o_orderkey", F.when(falls, F.array_join(F.transform(ordered, lambda y: y["x"]), "|")).alias("forms"))


@query("""
SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN 'a b c' WHEN 2 THEN 'Uploaded form' WHEN 3 THEN 'Uploaded form' ELSE left(repeat('x', 100), 80) END AS shown,
       CASE WHEN p_partkey % 2 = 0 THEN md5(p_name) END AS key, p_partkey % 3 = 0 AS valid FROM part
""")
def names_and_keys(spark, sf_dir):
    """File names as a bank shows them, form ids and hashes."""
    k, name = F.col("p_partkey"), F.col("p_name")
    file = F.when(k % 5 == 0, F.concat(F.lit("C:\\docs\\"), name, F.lit(".PDF"))).when(k % 5 == 1, "/x/a*b?  c.pdf").when(k % 5 == 2, ".hidden.pdf").when(k % 5 == 3, "x/??.pdf").otherwise(F.concat(F.repeat(F.lit("x"), 100), F.lit(".pdf")))
    digest = F.md5(name.cast("binary"))
    ident = F.when(k % 2 == 0, bank.form_id(digest)).otherwise(F.concat(F.lit("upload_x"), digest))
    asked = F.when(k % 3 == 0, F.upper(F.sha2(name, 256))).when(k % 3 == 1, F.lit("abc")).otherwise(F.concat(F.lit("z"), digest))
    return t(spark, sf_dir, "part").select(k.alias("k"), bank.display_name(file).alias("shown"), bank.key_of(ident).alias("key"), bank.valid_hash(asked).alias("valid"))


@query("""
WITH x AS (SELECT p_partkey AS k, ['None of the above.', 'N/A', 'not  applicable (NA)', 'Nil', 'None whatsoever', ''][p_partkey % 6 + 1] AS label, CASE WHEN p_partkey % 4 = 0 THEN 'none' ELSE p_type END AS value FROM part)
SELECT k, CASE k % 6 WHEN 4 THEN false WHEN 5 THEN k % 4 = 0 ELSE true END AS none FROM x
""")
def none_options(spark, sf_dir):
    """Options that say none of the others, by their labels and, where there is none, their values."""
    k = F.col("p_partkey")
    label = F.element_at(F.array(*map(F.lit, ("None of the above.", "N/A", "not  applicable (NA)", "Nil", "None whatsoever", ""))), (k % 6 + 1).cast("int"))
    return t(spark, sf_dir, "part").select(k.alias("k"), match.is_none_option(label, F.when(k % 4 == 0, "none").otherwise(F.col("p_type"))).alias("none"))


@query("""
SELECT c_custkey, '[PATIENT] came with [REDACTED_1], lives at ' || CASE WHEN c_custkey % 2 = 0 THEN '[REDACTED_2]' ELSE 'home' END || '.' AS redacted_text, CAST(4 + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_entries,
       c_name || ' came with Dr  Koh, lives at ' || CASE WHEN c_custkey % 2 = 0 THEN '12 Lor Ah Soo' ELSE 'home' END || '. [GONE_3]' AS back FROM customer
""")
def swept_notes(spark, sf_dir):
    """Notes about customers that a sweep looked over after the two passes, and the tokens turned back."""
    from ..operators import redact

    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    home = F.when(k % 2 == 0, "12 Lor Ah Soo").otherwise("home")
    note = F.concat("c_name", F.lit(" came with Dr  Koh, lives at "), home, F.lit("."))
    n = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("full_name"), F.lit("").alias("nric"), F.lit("1950-01-01").cast("date").alias("dob"), none.alias("phone"), none.alias("address"), none.alias("policy_number"), note.alias("clinical_text"))
    found = F.array(F.lit(" dr  koh "), F.lit("[X_1]"), F.lit("nobody"), F.lit(""), F.when(k % 2 == 0, "12 lor ah soo").otherwise("absent"))
    got = redact.redacted(n, sweep=found)
    # The sweep's own wording stands in the map; here the note's, so that the text comes back as it was.
    entries = F.transform("redaction_map", lambda e: F.struct(e["token"].alias("token"), F.when(e["token"] == "[REDACTED_1]", "Dr  Koh").when(e["token"] == "[REDACTED_2]", "12 Lor Ah Soo").otherwise(e["value"]).alias("value")))
    back = redact.remerged(F.concat("redacted_text", F.lit(" [GONE_3]")), entries)
    return got.select("c_custkey", "redacted_text", F.size("redaction_map").cast("long").alias("n_entries"), back["text"].alias("back"))


def _files(spark, sf_dir):
    """Nations as files of JSON: suppliers with even keys are boxes, the others text around them; some files are encrypted or broken."""
    k = F.col("s_suppkey")
    y = 800.0 - (k * 53 % 800).cast("double")
    box = F.when(k % 2 == 0, F.struct(F.concat(F.lit("f"), k.cast("string")).alias("name"), F.lit("/Tx").alias("kind"), (k * 37 % 600).cast("double").alias("x0"), (y - 40).alias("y0"), (k * 37 % 600 + 50).cast("double").alias("x1"), y.alias("y1"), F.array(F.lit("/Off"), F.lit("Yes")).alias("states"), F.when(k % 10 == 0, "x").otherwise(" ").alias("value")))
    run = F.when(k % 2 == 1, F.struct((k * 37 % 600).cast("double").alias("x"), y.alias("y"), F.concat(F.lit(" "), "s_name", F.lit("\n")).alias("text")))
    s = t(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") % 5).alias("file")).agg(F.transform(F.array_sort(F.collect_list(F.struct(k, box.alias("b"), run.alias("r")))), lambda x: F.struct(x["b"], x["r"])).alias("x"))
    page = F.struct(F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.lit("Printed").alias("text"), F.filter(F.transform("x", lambda z: z["r"]), lambda r: r.isNotNull()).alias("runs"), F.filter(F.transform("x", lambda z: z["b"]), lambda b: b.isNotNull()).alias("boxes"))
    body = F.to_json(F.struct((F.col("file") == 3).alias("encrypted"), F.array(page).alias("pages")))
    return s.select("file", F.encode(F.when(F.col("file") == 4, "{").otherwise(body), "utf-8").alias("content"))


@query("""
WITH b AS (SELECT s_nationkey % 5 AS file, s_suppkey AS k, s_name AS text, (s_suppkey * 37 % 600) * 1.0 AS x, (s_suppkey * 53 % 800) * 1.0 AS y FROM supplier WHERE s_nationkey % 5 < 3),
j AS (SELECT w.file, w.k, r.text, r.k AS o, w.x - r.x AS ahead, w.y - r.y AS above, abs(r.y - w.y - 20) < 56 AND r.x < w.x AS line FROM b w JOIN b r ON w.file = r.file AND w.k % 2 = 0 AND r.k % 2 = 1),
c AS (SELECT *, CASE WHEN line THEN CASE WHEN ahead <= 260 THEN 0 END WHEN above > 0 AND above <= 40 AND abs(ahead) <= 260 THEN 1 END AS place FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY file, k ORDER BY place, CASE WHEN place = 0 THEN ahead ELSE above END, o) AS rank FROM c WHERE place IS NOT NULL),
n AS (SELECT file, k, string_agg(text, '|' ORDER BY rank) AS nearby FROM r WHERE rank <= 4 GROUP BY ALL)
SELECT b.file, 'f' || b.k AS name, CAST(b.x AS DOUBLE) AS x, CAST(b.y AS DOUBLE) AS y, CAST(50 AS DOUBLE) AS w, CAST(40 AS DOUBLE) AS h, 'Yes' AS states, coalesce(nearby, '') AS nearby FROM b LEFT JOIN n USING (file, k) WHERE b.k % 2 = 0
""")
def file_widgets(spark, sf_dir):
    """The boxes of files with the texts near them, by a reader of JSON."""
    w = files.widgets(files.opened(_files(spark, sf_dir), json.loads))
    return w.select("file", "name", "box.x", "box.y", F.round("box.w", 6).alias("w"), F.round("box.h", 6).alias("h"), F.array_join("states", ",").alias("states"), F.array_join("nearby", "|").alias("nearby"))


@query("""
SELECT s_nationkey % 5 AS file, CAST(CASE WHEN s_nationkey % 5 < 3 THEN 1 ELSE 0 END AS INTEGER) AS pages, CAST(CASE WHEN s_nationkey % 5 < 3 THEN count(*) FILTER (WHERE s_suppkey % 2 = 0) ELSE 0 END AS INTEGER) AS boxes, CAST(CASE WHEN s_nationkey % 5 < 3 THEN 7 ELSE 0 END AS INTEGER) AS text_chars,
       CASE WHEN s_nationkey % 5 < 3 THEN count(*) FILTER (WHERE s_suppkey % 10 = 0) > 0 ELSE false END AS filled, CASE s_nationkey % 5 WHEN 3 THEN 'encrypted' WHEN 4 THEN 'not readable' END AS refusal FROM supplier GROUP BY s_nationkey % 5
""")
def file_probes(spark, sf_dir):
    return files.probes(files.opened(_files(spark, sf_dir), json.loads))
