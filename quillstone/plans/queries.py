"""Queries of the note-to-form operators over the driver's tables, and their SQL, written from the rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions.patterns import EMAIL
from ..operators import bank, dumps, fill, geometry, match, quotes, redact, review
from ..operators.evalkit import leak_metrics
from ..operators.tables import spread
from ..streaming.changes import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = "2024-01-01"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
SCRUBBED = rf"""SELECT doc_id, text, regexp_extract_all(text, '{MAIL}') AS m, string_split_regex(text, '{MAIL}') AS g FROM documents"""
REDACTED = "array_to_string(list_transform(g, lambda s, i: s || CASE WHEN i <= len(m) THEN '[EMAIL_' || len(list_distinct(m[1:list_position(m, m[i])])) || ']' ELSE '' END), '')"


@query(f"SELECT doc_id, CASE WHEN len(m) = 0 THEN text ELSE {REDACTED} END AS redacted_text, CAST(len(m) AS BIGINT) AS n_emails FROM ({SCRUBBED})")
def scrub_email(spark, sf_dir):
    x = F.col("text")
    return t(spark, sf_dir, "documents").select("doc_id", text.numbered(x, EMAIL, "EMAIL", 1).alias("redacted_text"), F.size(text.find_all(x, EMAIL)).cast("long").alias("n_emails"))


@query()
def scrub_patterns(spark, sf_dir):
    """All three patterns: look-arounds keep this from the other engine's expressions."""
    both = t(spark, sf_dir, "documents").select("doc_id", redact.pattern_pass(F.col("text")).alias("x"))
    return both.select("doc_id", F.col("x.text").alias("redacted_text"), F.size("x.entries").cast("long").alias("n_tokens"))


@query(rf"""
SELECT 'documents' AS kind, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(len(m)) AS BIGINT) AS n_found, CAST(sum(len(list_distinct(m))) AS BIGINT) AS n_distinct FROM (SELECT regexp_extract_all(text, '{MAIL}') AS m FROM documents) WHERE len(m) > 0
UNION ALL SELECT 'pages', CAST(count(*) AS BIGINT), CAST(sum(len(m)) AS BIGINT), CAST(sum(len(list_distinct(m))) AS BIGINT) FROM (SELECT regexp_extract_all(html, '{MAIL}') AS m FROM pages) WHERE len(m) > 0
""")
def pattern_census(spark, sf_dir):
    one = lambda name, c: t(spark, sf_dir, name).select(F.lit(name).alias("kind"), text.find_all(F.col(c), EMAIL).alias("m")).filter(F.size("m") > 0)
    both = one("documents", "text").union(one("pages", "html"))
    return both.groupBy("kind").agg(F.count("*").alias("n_rows"), F.sum(F.size("m")).alias("n_found"), F.sum(F.size(F.array_distinct("m"))).alias("n_distinct"))


@query(rf"""
SELECT doc_id, CASE WHEN len(d) = 1 THEN d[1] END AS email, CAST(CASE WHEN len(d) > 1 THEN len(d) ELSE 0 END AS BIGINT) AS n_choices
FROM (SELECT doc_id, list_distinct(regexp_extract_all(text, '{MAIL}')) AS d FROM documents) WHERE len(d) > 0
""")
def sole_email_or_choices(spark, sf_dir):
    d = F.array_distinct(text.find_all(F.col("text"), EMAIL))
    one = F.size("d") == 1
    return t(spark, sf_dir, "documents").select("doc_id", d.alias("d")).filter(F.size("d") > 0).select("doc_id", F.when(one, F.element_at("d", 1)).alias("email"), F.when(one, 0).otherwise(F.size("d")).cast("long").alias("n_choices"))


@query(r"""
SELECT doc_id, line, label, value FROM (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, regexp_replace(lower(regexp_extract(s, '^\s*([A-Za-z][A-Za-z .#/]{0,23})\s*[:\-–]\s*(.+?)\s*$', 1)), '[^a-z]', '', 'g') AS label,
         regexp_extract(s, '^\s*([A-Za-z][A-Za-z .#/]{0,23})\s*[:\-–]\s*(.+?)\s*$', 2) AS value
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE label <> ''
""")
def labelled_lines(spark, sf_dir):
    from ..functions.patterns import LABELLED

    one = t(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("line", "s"))
    return one.select("doc_id", "line", text.label_key(F.regexp_extract("s", LABELLED, 1)).alias("label"), F.regexp_extract("s", LABELLED, 2).alias("value")).filter("label <> ''")


@query(r"""
SELECT conv_id, turn, CAST(len(list_filter(string_split_regex(text, '\n(?:[ \t]*\n)+'), lambda x: trim(x) <> '')) AS BIGINT) AS n_blocks FROM conversations
""")
def text_blocks(spark, sf_dir):
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(text.blocks(F.col("text"))).cast("long").alias("n_blocks"))


@query(rf"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b\d{{1,2}}[/.\-]\d{{1,2}}[/.\-]\d{{2,4}}\b|\b\d{{4}}-\d{{1,2}}-\d{{1,2}}\b')) AS s FROM documents),
d AS (SELECT doc_id, coalesce(CASE WHEN regexp_full_match(s, '\d{{1,2}}[/.\-]\d{{1,2}}[/.\-]\d{{4}}') THEN try_strptime(regexp_replace(s, '[.\-]', '/', 'g'), '%d/%m/%Y') END, CASE WHEN regexp_full_match(s, '\d{{4}}-\d{{1,2}}-\d{{1,2}}') THEN try_strptime(s, '%Y-%m-%d') END) AS d FROM m)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_dates, CAST(count(*) FILTER (WHERE d BETWEEN DATE '1900-01-01' AND DATE '{AS_OF}') AS BIGINT) AS n_valid, CAST(count(*) FILTER (WHERE d BETWEEN DATE '1900-01-01' AND DATE '2022-01-01') AS BIGINT) AS n_birth FROM d GROUP BY doc_id
""")
def date_candidates(spark, sf_dir):
    as_of = F.lit(AS_OF).cast("date")
    pattern = r"\b\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}\b|\b\d{4}-\d{1,2}-\d{1,2}\b"
    one = t(spark, sf_dir, "documents").select("doc_id", F.explode(text.find_all(F.col("text"), pattern)).alias("s")).withColumn("d", dates.parse_date(F.col("s"), as_of))
    return one.groupBy("doc_id").agg(F.count("*").alias("n_dates"), F.count("d").alias("n_valid"), F.count_if(F.col("d") <= F.add_months(as_of, -24)).alias("n_birth"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS shown, day(o_orderdate) <= 12 AS recheck, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders
""")
def date_recheck(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", dates.day_first(F.col("o_orderdate")).alias("shown"))
    return o.select("o_orderkey", "shown", dates.needs_recheck(F.lit("date"), F.col("shown")).alias("recheck"), dates.day_first_to_iso(F.col("shown")).alias("iso"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%d/%m/%y') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS shown FROM orders
""")
def short_year(spark, sf_dir):
    wants = F.when(F.col("o_orderstatus") == "F", "Date (DD/MM/YY)").otherwise("Date (DD/MM/YYYY)")
    return t(spark, sf_dir, "orders").select("o_orderkey", dates.short_year(wants, dates.day_first(F.col("o_orderdate"))).alias("shown"))


@query(r"""
SELECT p_partkey, CASE WHEN s = '' THEN 'field' ELSE s END AS slug FROM (
  SELECT p_partkey, rtrim(left(trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '_', 'g'), '_'), 40), '_') AS s FROM part)
""")
def slug_text(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


def _plan(spark, sf_dir):
    """Small parts ask (fields), large ones answer (controls), in groups of a brand and a type."""
    p = t(spark, sf_dir, "part").withColumns({"grp": F.concat_ws("|", "p_brand", "p_type"), "label": F.concat_ws(" ", "p_name", F.lit("of the"), "p_type", F.lit("size"), (F.col("p_size") % 5).cast("string"))})
    fields = p.filter("p_size <= 25").select("grp", F.col("p_partkey").alias("field"), F.col("p_partkey").alias("field_ord"), "label")
    controls = p.filter("p_size > 25").select("grp", F.col("p_partkey").alias("control"), F.col("p_partkey").alias("control_ord"), "label")
    return fields, controls


LOCATED = r"""
WITH p AS (SELECT p_partkey AS k, p_size, p_brand || '|' || p_type AS grp, lower(p_name || ' of the ' || p_type || ' size ' || (p_size % 5)) AS l FROM part),
n AS (SELECT k, p_size, grp, trim(regexp_replace(regexp_replace(l, '^[\s(]*(?:\d+\s*[a-z]?|[ivxlc]+)[\s.)\-:]+', ''), '[^a-z0-9]+', ' ', 'g')) AS n FROM p),
w AS (SELECT *, list_distinct(list_filter(string_split(n, ' '), lambda x: x <> '' AND x NOT IN ('please','the','a','an','of','for','to','in','and','or','your','any','if','is','are','was','were','give','state','indicate','provide','specify','enter','advise'))) AS ts FROM n),
s AS (SELECT f.grp, f.k AS field, c.k AS control, CASE WHEN f.n = c.n THEN 1.0 ELSE CAST(2.0 AS DOUBLE) * len(list_intersect(f.ts, c.ts)) / (len(f.ts) + len(c.ts)) END AS score
      FROM w f JOIN w c ON f.grp = c.grp AND f.p_size <= 25 AND c.p_size > 25 WHERE f.n = c.n OR len(list_intersect(f.ts, c.ts)) > 0),
r AS (SELECT *, row_number() OVER o AS rn, lead(score) OVER o AS second FROM s WINDOW o AS (PARTITION BY grp, field ORDER BY score DESC, control)),
b AS (SELECT *, CASE WHEN score < 0.6 THEN 'unmatched' WHEN round(score - coalesce(second, -1.0), 9) < 0.05 THEN 'ambiguous' ELSE 'matched' END AS st FROM r WHERE rn = 1),
q AS (SELECT *, row_number() OVER (PARTITION BY grp, control ORDER BY score DESC, field) AS claim FROM b WHERE st = 'matched'),
z AS (SELECT w.grp, w.k AS field, CASE WHEN q.claim > 1 THEN 'ambiguous' ELSE coalesce(b.st, 'unmatched') END AS status, b.control AS c, coalesce(b.score, 0.0) AS score
      FROM w LEFT JOIN b ON b.grp = w.grp AND b.field = w.k LEFT JOIN q ON q.grp = w.grp AND q.field = w.k WHERE w.p_size <= 25)
"""


@query(LOCATED + "SELECT grp, field, CASE WHEN status = 'matched' THEN c END AS control, round(score, 6) AS score, status FROM z")
def label_locate(spark, sf_dir):
    return match.located(*_plan(spark, sf_dir)).select("grp", "field", "control", F.round("score", 6).alias("score"), "status")


@query(LOCATED + "SELECT grp, CAST(count(*) FILTER (WHERE status = 'matched') AS BIGINT) AS matched, CAST(count(*) AS BIGINT) AS intended, count(*) FILTER (WHERE status = 'matched') / count(*) AS match_rate, count(*) FILTER (WHERE status = 'matched') >= 3 AND count(*) FILTER (WHERE status = 'matched') / count(*) >= 0.7 AS safe_to_fill FROM z GROUP BY grp")
def match_guard(spark, sf_dir):
    return match.report(match.located(*_plan(spark, sf_dir)))


@query(LOCATED + "SELECT DISTINCT w.grp, w.k AS control FROM w LEFT JOIN z ON z.grp = w.grp AND z.c = w.k AND z.status = 'matched' WHERE p_size > 25 AND z.field IS NULL")
def unclaimed_controls(spark, sf_dir):
    fields, controls = _plan(spark, sf_dir)
    return match.unclaimed(controls, match.located(fields, controls)).select("grp", "control")


@query(LOCATED.replace("WITH p AS", "WITH RECURSIVE p AS") + """, c AS (SELECT grp, control, list(struct_pack(f := field, s := score) ORDER BY score DESC, field) AS cands, max(score) AS top FROM s GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY top DESC, control) AS turn FROM c),
g AS (
  SELECT grp, 0::BIGINT AS turn, []::BIGINT[] AS taken, NULL::BIGINT AS control, NULL::BIGINT AS field, NULL::DOUBLE AS score FROM (SELECT DISTINCT grp FROM t)
  UNION ALL
  SELECT grp, turn, CASE WHEN ok THEN list_append(taken, l[1].f) ELSE taken END, control, CASE WHEN ok THEN l[1].f END, CASE WHEN ok THEN l[1].s END
  FROM (SELECT *, coalesce(l[1].s >= 0.6 AND (l[2] IS NULL OR round(l[1].s - l[2].s, 9) >= 0.05), false) AS ok
        FROM (SELECT t.grp, t.turn, g.taken, t.control, list_filter(t.cands, lambda x: NOT list_contains(g.taken, x.f)) AS l FROM g JOIN t ON t.grp = g.grp AND t.turn = g.turn + 1)))
SELECT grp, field, control, round(score, 6) AS score FROM g WHERE field IS NOT NULL
""")
def enrich_greedy(spark, sf_dir):
    """Controls take turns at the fields of their group."""
    return match.enriched_labels(*_plan(spark, sf_dir)).select("grp", "field", "control", F.round("score", 6).alias("score"))


@query("""
WITH s AS (SELECT o_orderpriority AS page, o_orderstatus AS form, count(*) AS matched, avg(CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END) AS match_rate FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rn, lead(match_rate) OVER w AS second FROM s WINDOW w AS (PARTITION BY page ORDER BY match_rate DESC, form))
SELECT page, CASE WHEN matched >= 3 AND match_rate >= 0.4 AND round(match_rate - coalesce(second, -1.0), 9) >= 0.15 THEN form END AS form, CAST(matched AS BIGINT) AS matched, round(match_rate, 6) AS match_rate FROM r WHERE rn = 1
""")
def form_identify(spark, sf_dir):
    o = t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("page"), F.col("o_orderstatus").alias("form")).agg(F.count("*").alias("matched"), F.avg(F.when(F.col("o_totalprice") > 200000, 1.0).otherwise(0.0)).alias("match_rate"))
    return match.identified(o.withColumn("form_ord", F.col("form"))).withColumn("match_rate", F.round("match_rate", 6))


@query("""
SELECT c_custkey, CASE lower(trim(c_mktsegment)) WHEN 'building' THEN 'Building' WHEN 'machinery' THEN 'Machinery' WHEN 'household' THEN 'Household' END AS answer FROM customer
""")
def option_match(spark, sf_dir):
    options = F.array(*map(F.lit, ("Building", "Machinery", "Household")))
    return t(spark, sf_dir, "customer").select("c_custkey", match.matched_option(F.col("c_mktsegment"), options).alias("answer"))


@query("""
SELECT o_orderkey AS claim, coalesce(CASE WHEN l_returnflag IN ('A', 'R') THEN CASE l_returnflag WHEN 'A' THEN 'extracted' ELSE 'inferred' END END, 'missing') AS status,
       CASE WHEN l_returnflag IN ('A', 'R') THEN l_linestatus END AS value
FROM orders LEFT JOIN (SELECT l_orderkey, any_value(l_returnflag) AS l_returnflag, any_value(l_linestatus) AS l_linestatus FROM lineitem WHERE l_linenumber = 2 GROUP BY l_orderkey) ON l_orderkey = o_orderkey
""")
def answers_left_default(spark, sf_dir):
    """Every order asks for its second line's status, of several the first in the table; lines with flag N come with a status that isn't one."""
    fields = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim"), F.lit("line").alias("id"), F.lit(0).alias("ord"), F.lit("text").alias("type"), F.lit("llm").alias("source"), F.lit("").alias("description"), F.array().cast("array<string>").alias("options"))
    status = F.when(F.col("l_returnflag") == "A", "extracted").when(F.col("l_returnflag") == "R", "inferred").otherwise("guessed")
    place = F.struct("_metadata.file_path", "_metadata.row_index")  # of several second lines the first in the table, whatever the number of tasks
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c)
    answers = t(spark, sf_dir, "lineitem").filter("l_linenumber = 2").groupBy("l_orderkey").agg(first("l_returnflag"), first("l_linestatus"))
    answers = answers.select(F.col("l_orderkey").alias("claim"), F.lit("line").alias("id"), F.col("l_linestatus").alias("value"), status.alias("status"), F.lit("").alias("source"), F.lit("").alias("reasoning"))
    return review.coerced(fields, answers).select("claim", "status", F.col("value_str").alias("value"))


@query("""
SELECT form, label, CASE WHEN attr IS NOT NULL AND count(attr) OVER (PARTITION BY form, attr) = 1 THEN 'demographics.' || attr ELSE 'llm' END AS source
FROM (SELECT c_nationkey AS form, c_custkey AS label, CASE c_mktsegment WHEN 'BUILDING' THEN 'dob' WHEN 'MACHINERY' THEN 'nric' END AS attr FROM customer)
""")
def duplicate_demographic_refused(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("form"), F.col("c_custkey").alias("label"), "c_mktsegment")
    return review.sole_demographics(c, F.when(F.col("c_mktsegment") == "BUILDING", "dob").when(F.col("c_mktsegment") == "MACHINERY", "nric")).select("form", "label", "source")


@query("SELECT DISTINCT l_suppkey AS claim, l_partkey AS id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def unknown_ids(spark, sf_dir):
    values = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("claim"), F.col("l_partkey").alias("id"))
    fields = t(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("id"))
    return values.distinct().join(fields, "id", "left_anti").select("claim", "id")


@query("""
WITH x AS (SELECT o_custkey AS form, o_orderkey AS field, o_orderpriority AS v, o_orderstatus = 'F' AS ro, o_totalprice < 50000 AS answered FROM orders),
s AS (SELECT DISTINCT form, CASE WHEN field % 2 = 0 THEN '2-HIGH' ELSE '3-MEDIUM' END AS v FROM x WHERE answered),
b AS (SELECT x.*, s.v IS NOT NULL AS shown, CASE WHEN ro THEN 'not writable' WHEN answered THEN 'already answered' WHEN x.v NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'no matching option' END AS why FROM x LEFT JOIN s ON s.form = x.form AND s.v = x.v),
r AS (SELECT *, shown OR coalesce(sum(CASE WHEN why IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY form, v ORDER BY field ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS taken FROM b)
SELECT form, field, CASE WHEN taken OR why IS NOT NULL THEN 'skipped' ELSE 'filled' END AS status, CASE WHEN taken THEN 'option already chosen' ELSE why END AS reason FROM r
""")
def fill_outcomes(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("form"), F.col("o_orderkey").alias("field"), F.col("o_orderkey").alias("ord"), F.lit("select").alias("type"), F.col("o_orderpriority").alias("value"),
        F.when(F.col("o_totalprice") < 50000, F.when(F.col("o_orderkey") % 2 == 0, "2-HIGH").otherwise("3-MEDIUM")).alias("existing"), F.lit(False).alias("checked"), F.lit(False).alias("disabled"), (F.col("o_orderstatus") == "F").alias("read_only"),
        F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM"))).alias("options"), F.lit(True).alias("safe"),
    )
    return fill.outcomes(o)


@query("""
WITH k AS (SELECT page_id, substr(sha256(html), 1, 32) AS key FROM pages), c AS (SELECT key, min(page_id) AS first FROM k GROUP BY key)
SELECT page_id, k.key AS key, 'upload_' || k.key AS form_id, CASE WHEN page_id = first THEN NULL ELSE 'banked' END AS found_in FROM k JOIN c USING (key)
""")
def content_key_bank(spark, sf_dir):
    """Pages in order of their id: a page whose bytes came before is in the bank."""
    k = t(spark, sf_dir, "pages").select("page_id", bank.key(F.encode("html", "utf-8")).alias("key"))
    first = k.groupBy("key").agg(F.min("page_id").alias("first"))
    return k.join(first, "key").select("page_id", "key", bank.form_id(F.col("key")).alias("form_id"), F.when(F.col("page_id") != F.col("first"), "banked").alias("found_in"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was IS DISTINCT FROM event_type")
def page_changed(spark, sf_dir):
    return changes(t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type")).select("event_id", "user_id", "event_type")


@query(r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), b AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM benchmark)
SELECT doc_id AS note_id, item_id AS quote_id, CAST(len(string_split(t, q)) - 1 AS BIGINT) AS hits FROM d JOIN b ON contains(t, q)
""")
def quote_locate(spark, sf_dir):
    notes = spread(t(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), "text"), "note_id")
    return quotes.located(notes, t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")))


@query(f"""
SELECT doc_id AS id, CAST(len(list_filter(list_distinct(m), lambda x: contains(lower({REDACTED}), lower(x)))) AS BIGINT) AS leaks, CAST(0 AS BIGINT) AS over_redacted FROM ({SCRUBBED}) WHERE len(m) > 0
""")
def leak_count(spark, sf_dir):
    x = F.col("text")
    cases = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.numbered(x, EMAIL, "EMAIL", 1).alias("redacted"), F.array_distinct(text.find_all(x, EMAIL)).alias("must_not_survive"), F.array().cast("array<string>").alias("must_survive"), F.lit(False).alias("sweep_only"))
    return leak_metrics(cases.filter(F.size("must_not_survive") > 0))


@query("""
SELECT c_custkey, 'Seen at Mount Alvernia Hospital: [PATIENT], born [DOB], balance ' || c_acctbal || '. Call [PHONE_2].' AS redacted_text, CAST(4 AS BIGINT) AS n_entries FROM customer
""")
def dictionary_redact(spark, sf_dir):
    """Notes written about customers: the name, number and date in them must go, the hospital's must stay."""
    c = t(spark, sf_dir, "customer")
    born = F.date_add(F.lit("1950-01-01").cast("date"), (F.col("c_custkey") % 15000).cast("int"))
    note = F.concat(F.lit("Seen at Mount Alvernia Hospital: "), "c_name", F.lit(", born "), F.date_format(born, "d MMM yyyy"), F.lit(", balance "), F.col("c_acctbal").cast("string"), F.lit(". Call 91234567."))
    notes = c.select("c_custkey", F.col("c_name").alias("full_name"), F.lit("S1234567D").alias("nric"), born.alias("dob"), F.lit(None).cast("string").alias("phone"), F.lit(None).cast("string").alias("address"), F.lit(None).cast("string").alias("policy_number"), note.alias("clinical_text"))
    return redact.redacted(notes).select("c_custkey", "redacted_text", F.size("redaction_map").cast("long").alias("n_entries"))


@query("""
WITH e AS (SELECT user_id AS form, event_id, event_type AS name, event_id % 3 = 0 AS visible FROM events),
k AS (SELECT form, name, min(event_id) AS first, coalesce(min(event_id) FILTER (WHERE visible), min(event_id)) AS kept FROM e GROUP BY form, name)
SELECT form, name, kept AS ord, kept % 3 = 0 AS visible, 'c' || row_number() OVER (PARTITION BY form ORDER BY first) AS ref FROM k
""")
def merge_dumps(spark, sf_dir):
    """Users' events as captures of their pages' controls."""
    e = t(spark, sf_dir, "events").select(F.col("user_id").alias("form"), F.lit(1).alias("dump"), F.col("event_id").alias("ord"), F.lit("").alias("step"), F.col("event_type").alias("name"), F.lit("").alias("id"), F.lit("").alias("selector"), (F.col("event_id") % 3 == 0).alias("visible"))
    return dumps.merged(e).select("form", "name", "ord", "visible", "ref")


@query("""
WITH b AS (SELECT s_nationkey % 5 AS page, s_suppkey AS k, s_name AS text, (s_suppkey * 37 % 600) * 1.0 AS x, (s_suppkey * 53 % 800) * 1.0 AS y, CASE WHEN s_suppkey % 4 = 0 THEN 40.0 ELSE 4.0 END AS h FROM supplier),
j AS (SELECT w.page, w.k AS widget, r.text, r.k AS o, w.x - r.x AS ahead, w.y - r.y AS above, abs(r.y - w.y - w.h / 2) < greatest(w.h, 8.0) * 1.4 AND r.x < w.x AS line FROM b w JOIN b r ON w.page = r.page AND w.k % 2 = 0 AND r.k % 2 = 1),
c AS (SELECT *, CASE WHEN line THEN CASE WHEN ahead <= 260 THEN 0 END WHEN above > 0 AND above <= 40 AND abs(ahead) <= 260 THEN 1 END AS place FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY page, widget ORDER BY place, CASE WHEN place = 0 THEN ahead ELSE above END, o) AS rank FROM c WHERE place IS NOT NULL)
SELECT page, widget, CAST(rank AS INTEGER) AS rank, text FROM r WHERE rank <= 4
""")
def nearest_text(spark, sf_dir):
    """Suppliers on a grid: even ones are boxes, low and high, odd ones the text around them."""
    k = F.col("s_suppkey")
    s = t(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("page"), k.alias("k"), "s_name", (k * 37 % 600).cast("double").alias("x"), (k * 53 % 800).cast("double").alias("y"), F.when(k % 4 == 0, 40.0).otherwise(4.0).alias("h"))
    widgets = s.filter("k % 2 = 0").select("page", F.col("k").alias("widget"), "x", "y", "h")
    runs = s.filter("k % 2 = 1").select("page", F.col("s_name").alias("text"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("k").alias("tord"))
    return geometry.nearest_text(widgets, runs)


@query("SELECT p_partkey, p_size < 10 OR (p_size = 10 AND p_partkey % 20 < 7) AS older FROM part")
def version_gate(spark, sf_dir):
    version = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 20).cast("string"))
    return t(spark, sf_dir, "part").select("p_partkey", text.older_than(version, F.lit("10.7")).alias("older"))


@query(r"""
WITH RECURSIVE s AS (SELECT conv_id, turn, string_split(text, chr(10)) AS a FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, CAST(len(a) - len(list_filter(a[1:len(a) - 1], lambda x: regexp_matches(rtrim(x), '[·|;,—-]$'))) - CASE WHEN a[len(a)] = '' AND NOT (len(a) > 1 AND regexp_matches(rtrim(a[len(a) - 1]), '[·|;,—-]$')) THEN 1 ELSE 0 END AS BIGINT) AS n_lines FROM s
""")
def logical_lines(spark, sf_dir):
    return t(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", F.size(text.logical_lines(F.col("text"))).cast("long").alias("n_lines"))


STEPPED = LOCATED.replace("w AS (SELECT *, list_distinct", "w0 AS (SELECT *, list_distinct").replace(
    "s AS (SELECT f.grp",
    """w AS (SELECT k, p_size, grp || '~' || (k % 2) AS grp, n, ts FROM w0 WHERE p_size <= 25 UNION ALL SELECT k, p_size, grp || '~' || v.s, n, ts FROM w0, (VALUES (0), (1)) v(s) WHERE p_size > 25),
s AS (SELECT f.grp""",
)


@query(STEPPED + """, e AS (SELECT split_part(grp, '~', 1) AS grp, 'step ' || split_part(grp, '~', 2) AS step, CAST(count(*) FILTER (WHERE status = 'matched') AS BIGINT) AS matched, CAST(count(*) AS BIGINT) AS intended FROM z GROUP BY ALL),
y AS (SELECT *, matched / intended AS match_rate, matched >= 3 AND matched / intended >= 0.7 AS safe_to_fill FROM e)
SELECT *, count(*) OVER (PARTITION BY grp) > 1 AND bool_or(safe_to_fill) OVER (PARTITION BY grp) AND NOT safe_to_fill AS deferred FROM y
""")
def step_guard(spark, sf_dir):
    """Parts in steps by number: which steps of a plan are on the page?"""
    fields, controls = _plan(spark, sf_dir)
    stepped = fields.withColumn("step", F.concat(F.lit("step "), (F.col("field") % 2).cast("string")))
    return match.located_by_step(stepped, controls)[1]


@query()
def scrub_label_titles(spark, sf_dir):
    """Headings of pages whose text the label rules change."""
    heads = F.regexp_extract_all("html", F.lit(r"(?is)<(?:h[1-4]|legend|label)[^>]*>(.*?)</(?:h[1-4]|legend|label)>"), F.lit(1))
    one = t(spark, sf_dir, "pages").select("page_id", F.posexplode(heads).alias("ord", "s")).withColumn("s", F.regexp_replace("s", "<[^>]*>", ""))
    return one.select("page_id", "ord", text.scrub_label(F.col("s")).alias("label"), (text.scrub_label(F.col("s")) != text.squashed(F.col("s"))).alias("changed"))
