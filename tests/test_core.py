"""Rules of the note-to-form operators on authored cases."""

import datetime

from pyspark.sql import Row
from pyspark.sql import functions as F

from quillstone.functions import dates, patterns, text
from quillstone.operators import bank, dumps, evalkit, extract, fill, geometry, intake, match, provider, quotes, redact, review, sinks
from quillstone.sources import html, registry
from quillstone.streaming.changes import scrubbed

AS_OF = datetime.date(2026, 1, 1)


def one(spark, expr, **cols):
    df = spark.createDataFrame([Row(**cols)]) if cols else spark.range(1)
    return df.select(expr.alias("v")).first()["v"]


def test_numbering_follows_first_appearance(spark):
    got = one(spark, redact.scrub_patterns(F.col("t")), t="a@x.sg b@x.sg a@x.sg S1234567D +65 91234567 91234567")
    assert got == "[EMAIL_1] [EMAIL_2] [EMAIL_1] [NRIC_2] [PHONE_2] [PHONE_3]"
    assert one(spark, redact.scrub_patterns(F.lit(None).cast("string"))) is None


def test_dictionary_pass_keeps_institutions(spark):
    note = "Mdm tan wei ming (S 1234567 D, born 4 Mar 1980) seen at Tan Tock Seng Hospital. Tan Wei  Ming, angina. He is well. Call 9123 4567."
    row = Row(full_name="Tan Wei Ming", nric="S1234567D", dob=datetime.date(1980, 3, 4), phone="+65 91234567", address="", policy_number="", clinical_text=note)
    got = redact.redacted(spark.createDataFrame([row])).first()
    assert got["redacted_text"] == "Mdm [PATIENT] ([NRIC], born [DOB]) seen at Tan Tock Seng Hospital. [PATIENT], angina. He is well. Call [PHONE]."
    entries = [(e["token"], e["value"]) for e in got["redaction_map"]]
    assert entries[:4] == [("[PATIENT]", "Tan Wei Ming"), ("[NRIC]", "S1234567D"), ("[DOB]", "04/03/1980"), ("[PHONE]", "+65 91234567")]


def test_strict_redaction_takes_values_that_end_in_punctuation(spark):
    row = Row(full_name="Tan Ah", nric="", dob=datetime.date(1980, 3, 4), phone=None, address="9 Hill Road, Singapore 440005.", policy_number=None, clinical_text="Lives at 9 Hill Road, Singapore 440005. Well.")
    df = spark.createDataFrame([row], "full_name string, nric string, dob date, phone string, address string, policy_number string, clinical_text string")
    loose, strict = (redact.redacted(df, strict=x).first()["redacted_text"] for x in (False, True))
    assert "440005" in loose and strict == "Lives at [ADDRESS] Well."


def test_sweep_and_remerge(spark):
    row = Row(full_name="Lim Ah", nric="", dob=datetime.date(1980, 3, 4), phone=None, address=None, policy_number=None, clinical_text="Lim Ah came with Dr Koh. ah well")
    df = redact.redacted(spark.createDataFrame([row], "full_name string, nric string, dob date, phone string, address string, policy_number string, clinical_text string"), sweep=F.array(F.lit(" dr koh "), F.lit("[X]"), F.lit("nobody")))
    got = df.select("redacted_text", redact.remerged(F.concat("redacted_text", F.lit(" [GONE]")), F.col("redaction_map")).alias("back")).first()
    assert got["redacted_text"] == "[PATIENT] came with [REDACTED_1]. ah well"
    assert got["back"]["unresolved"] == ["[GONE]"] and "dr koh" in got["back"]["text"]


def test_dates(spark):
    parse = lambda t: one(spark, dates.parse_date(F.col("t"), F.lit(AS_OF)), t=t)
    assert parse("4/3/1980") == parse("1980-03-04") == parse("4 Mar 1980.") == parse("04 march 1980") == datetime.date(1980, 3, 4)
    assert [parse(x) for x in ("31/02/1990", "4/3/80", "4/3/2027", "4 Foo 1980", "1/1/1899")] == [None] * 5
    assert one(spark, dates.short_year(F.lit("as DD/MM/YY"), F.lit("14/03/2026"))) == "14/03/26"
    assert one(spark, dates.needs_recheck(F.lit("date"), F.lit("25/07/2020"))) is False
    assert one(spark, dates.readable(F.lit("03/04/2026"))) == "3 April 2026 (or 4 March 2026)"


def test_text_rules(spark):
    assert one(spark, text.lines(F.lit("a\r\nb\x0bc\n"))) == ["a", "b", "c"]
    assert one(spark, text.logical_lines(F.lit("Name,\nTan\nx"))) == ["Name, Tan", "x"]
    assert one(spark, text.normalised(F.lit("4a. ICD-10  Code:"))) == "icd 10 code"
    assert one(spark, text.numbered_slugs(F.array(*map(F.lit, ("Date", "Date 2", "Date", "!!"))))) == ["date", "date_2", "date_3", "field"]
    assert one(spark, text.display_label(F.lit(""), F.lit("date_of_birth"))) == "Date of birth"
    assert one(spark, text.older_than(F.lit("0.2.9"), F.lit("0.3"))) is True and one(spark, text.older_than(F.lit("1"), F.lit("1.0"))) is False


def test_two_candidates_mean_neither(spark):
    notes = spark.createDataFrame([(1, "Name: Tan Ah\nTel 91234567 and 81234567\nS1234567D"), (2, "call +65 91234567 or 9123 4567, seen 01/02/1950")], "note_id long, text string")
    got = {(r["note_id"], r["field"]): r for r in extract.parsed(notes, F.lit(AS_OF)).collect()}
    assert got[1, "full_name"]["value"] == "Tan Ah" and got[1, "full_name"]["how"] == "labelled"
    assert got[1, "phone"]["value"] is None and len(got[1, "phone"]["choices"]) == 2
    assert got[1, "nric"]["how"] == "sole-match" and got[2, "phone"]["value"] == "+65 91234567"
    assert got[2, "dob"]["value"] is None and got[2, "dob"]["choices"] == ["1950-02-01"]


def test_matching_refuses_ties_and_conflicts(spark):
    fields = spark.createDataFrame([("g", "a", 1, "Date of admission"), ("g", "b", 2, "Admission date"), ("g", "c", 3, "Diagnosis"), ("g", "d", 4, "of the")], "grp string, field string, field_ord int, label string")
    controls = spark.createDataFrame([("g", "x", 1, "1. Date of admission"), ("g", "y", 2, "Diagnosis code"), ("g", "z", 3, "Diagnosis text"), ("g", "w", 4, "Of the")], "grp string, control string, control_ord int, label string")
    rows = match.located(fields, controls)
    assert {r["field"]: (r["status"], r["control"]) for r in rows.collect()} == {"a": ("matched", "x"), "b": ("ambiguous", None), "c": ("ambiguous", None), "d": ("matched", "w")}
    assert match.report(rows).first()["safe_to_fill"] is False
    assert {r["control"] for r in match.unclaimed(controls, rows).collect()} == {"y", "z"}
    assert [r["control"] for r in match.enriched(match.pairs(fields, controls)).collect()] == ["y", "w"]  # x has two equal fields, so it takes none


def test_answers(spark):
    fields = spark.createDataFrame([("k", i, n, t, "llm", d, o) for n, (i, t, d, o) in enumerate([("a", "text", "", None), ("b", "checkbox", "", None), ("c", "text", "", ["Ward B1", "ICU"]), ("d", "date", "DD/MM/YY", None), ("e", "text", "", None)])], "claim string, id string, ord int, type string, source string, description string, options array<string>")
    reply = '{"fields":[{"id":"a","value":"x","status":"extracted"},{"id":"a","value":"y","status":"extracted"},{"id":"b","value":"maybe","status":"extracted"},{"id":"c","value":" ward  b1","status":"inferred"},{"id":"d","value":"05/03/2026","status":"extracted"}]}'
    answers = review.parsed_replies(spark.createDataFrame([("k", reply), ("bad", "{")], "claim string, reply string"))
    rows = review.assembled(review.coerced(fields, answers))
    got = {r["id"]: (r["value_str"], r["status"], r["needs_review"]) for r in rows.collect()}
    assert got == {"a": ("x", "extracted", False), "b": (None, "missing", True), "c": ("Ward B1", "inferred", True), "d": ("05/03/26", "extracted", False), "e": (None, "missing", True)}
    confirmed = spark.createDataFrame([("k", "c")], "claim string, id string")
    assert {r["id"] for r in review.ready(rows, confirmed).collect()} == {"a", "c", "d"}


def test_fill_never_overwrites_or_repeats(spark):
    ddl = "form int, field int, ord int, type string, value string, existing string, checked boolean, disabled boolean, read_only boolean, options array<string>, safe boolean"
    rows = [(1, 1, 1, "select", "a", None, False, False, False, ["A", "B"], True), (1, 2, 2, "select", "a", None, False, False, False, ["A", "B"], True), (1, 3, 3, "text", "a", "b", False, False, False, None, True), (1, 4, 4, "checkbox", "yes", None, False, False, False, None, True), (1, 5, 5, "date", "31/02/2020", None, False, False, False, None, True)]
    got = [r["status"] for r in fill.outcomes(spark.createDataFrame(rows, ddl)).orderBy("field").collect()]
    assert got == ["filled", "skipped", "skipped", "filled", "skipped"]
    more = ddl.replace("form int", "form int, shown string")
    rows = [
        (1, "A", 1, 1, "select", "b", "A", False, False, False, ["A", "B"], True), (1, "", 2, 2, "select", "A", "", False, False, False, ["A", "B"], True), (1, "", 3, 3, "select", "b ", "", False, False, False, ["A", "B"], True),
        (1, "", 4, 4, "select", " B", "", False, False, False, ["A", "B"], True), (1, "", 5, 5, "select", "Z", "", False, False, False, ["A", "B"], True), (1, "", 6, 6, "select", "z", "", False, False, False, ["A", "B"], True),
        (1, None, 7, 7, "radio-group", "Yes", None, False, False, False, ["Yes", "No"], True), (1, None, 8, 8, "radio-group", "yes", None, False, False, False, ["Yes", "No"], True), (1, None, 9, 9, "radio-group", "yes", None, True, False, False, ["Yes", "No"], True),
        (2, "A", None, 0, "select", None, "A", False, False, False, ["X", "A"], True), (2, "", 1, 1, "select", "a", "", False, False, False, ["X", "A"], True), (2, "", 2, 2, "select", "x", "", False, False, False, ["X", "A"], False),
    ]
    got = {(r["form"], r["field"]): (r["status"], r["reason"]) for r in fill.outcomes(spark.createDataFrame(rows, more)).collect()}
    taken, off = ("skipped", "option already chosen"), ("skipped", "no matching option")
    assert [got[1, k] for k in range(1, 10)] == [("skipped", "already answered"), taken, ("filled", None), taken, off, off, ("filled", None), ("filled", None), ("skipped", "already answered")]
    assert got[2, 1] == taken and got[2, 2] == ("skipped", "match is not safe") and len(got) == 11


def test_bank_quotes_geometry_and_scores(spark):
    k = one(spark, bank.key(F.encode(F.lit("x"), "utf-8")))
    assert len(k) == 32 and one(spark, bank.key_of(bank.form_id(F.lit(k)))) == k and one(spark, bank.display_name(F.lit("a/b/My form.PDF"))) == "My form"
    notes = spark.createDataFrame([(1, "the  patient\nhas a cold. has a cold")], "note_id long, text string")
    asked = spark.createDataFrame([(1, "has a cold"), (2, "has no"), (3, "patient")], "quote_id long, quote string")
    assert {(r["quote_id"], r["hits"]) for r in quotes.located(notes, asked).collect()} == {(1, 2), (3, 1)}
    f = lambda *a: one(spark, geometry.sane_box(*[F.lit(float(x)) for x in (*a, 600, 800)]))
    assert f(0.1, 0.1, 0.2, 0.05)["x"] == 60 and f(0.1, 0.1, 0.9, 0.9) is None and f(-0.01, 0, 0.1, 0.1) is None and round(f(0.95, 0.1, 0.06, 0.1)["w"], 6) == 30 and f(0.95, 0.1, 0.08, 0.1) is None and f(float("inf"), 0, 0.1, 0.1) is None and f(float("nan"), 0, 0.1, 0.1) is None
    cases = spark.createDataFrame([("a", "saw TAN at home", ["Tan", "S12"], ["home", "fever"], False)], "id string, redacted string, must_not_survive array<string>, must_survive array<string>, sweep_only boolean")
    assert tuple(evalkit.leak_metrics(cases).first()) == ("a", 1, 1)


def test_html_inventory(spark):
    page = '<form><label for=a>Name</label><input id=a name=n><table><tr><td>Ward</td><td><select name=w><option>A</option><option>B</option></select></td></tr></table><div><input name=late></div><fieldset><legend>Well?</legend><label>Yes<input type=radio name=r></label><label>No<input type=radio name=r required></label></fieldset><input type=password name=p></form>'
    got = html.controls(spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<input name=x aria-label='S1234567D'><select><option>Call 91234567<option>b</select>")], "page_id long, html string")).orderBy("page_id", "ord").collect()
    assert [(r["type"], r["label"], r["label_source"]) for r in got][:4] == [("text", "Name", "label[for]"), ("select", "Ward", "table-cell"), ("text", "", "none"), ("radio-group", "Well?", "section-heading")]
    assert len(got) == 6 and got[3]["members"] == 2 and got[3]["required"] and got[3]["options"]["values"] == ["Yes", "No"]
    assert got[4]["label"] == "[NRIC]" and got[5]["options"].asDict() == {"count": 2, "truncated": False, "withheld": True, "values": []}


def test_inventory_takes_time_by_length():
    import time

    n = 8000
    pages = (
        "".join(f"<div><label>Q{i}</label><input name=n{i}></div>" for i in range(n)),
        "<form><div>" + "<b>much text</b>" * 2000 + "</div><div>" + "".join(f"<input name=n{i}>" for i in range(n)) + "</div></form>",
        "<div>" * 3000 + "<b>t</b><input>" * n,
        "<fieldset><legend>One</legend>" + "<p><input name=a></p>" * n + "</fieldset>",
        "<div>" * n + "</span>" * n + "<p>" * n,
    )
    for page in pages:
        began = time.perf_counter()
        html.dumped(page)
        assert time.perf_counter() - began < 5


def test_entries_count_within_their_own_parent():
    row = "<li><b>Entry</b><input name=a{i}></li>"
    page = "<ul>" + "".join(row.format(i=i) for i in range(3)) + "</ul><div><div><input name=x><input name=y></div><div><input name=z><input name=w></div></div><div><div hidden><input><input type=date></div><div><input><input type=date></div></div>"
    got = [(c["name"], c["instance"]) for c in html.dumped(page)["controls"]]
    assert got == [("a0", 1), ("a1", 2), ("a2", 3), ("x", 1), ("y", 1), ("z", 2), ("w", 2), ("", None), ("", None), ("", None), ("", None)]


def test_inline_labels_and_insurers(spark):
    note = "NRIC S8012345D  DOB 14/03/1978\nHP 9123 4567 / 6123 4567\nPolicy discussed with patient, Clinic tel 62551234\nCovered by AIA Singapore (GHS plan)"
    got = {r["field"]: (r["value"], r["how"], r["choices"]) for r in extract.parsed(spark.createDataFrame([(1, note), (2, None), (3, "")], "note_id long, text string"), F.lit(AS_OF)).collect()}
    assert got["nric"] == ("S8012345D", "header-line", None) and got["dob"] == ("1978-03-14", "header-line", None)  # two fields and no prose make a header
    assert got["phone"] == (None, None, ["9123 4567", "6123 4567"]) and got["insurer"] == ("AIA", "sole-match", None) and "policy_number" not in got
    assert one(spark, extract.insurer_of(F.lit("great  eastern LIFE"))) == "Great Eastern" and one(spark, extract.insurer_of(F.lit("AIA or Bupa"))) is None
    kept = spark.createDataFrame([(1, "Insurer: Acme Mutual\nNRIC: none")], "note_id long, text string")
    assert [(r["field"], r["value"]) for r in extract.parsed(kept, F.lit(AS_OF)).collect()] == [("insurer", "Acme Mutual")]


def test_steps_dumps_and_refusals(spark):
    words = ("ward", "bed", "doctor", "nurse", "drug", "dose")
    fields = spark.createDataFrame([("p", w, i, w, "one" if i < 3 else "two") for i, w in enumerate(words)], "grp string, field string, field_ord int, label string, step string")
    shown = spark.createDataFrame([("p", w, i, w) for i, w in enumerate(words[:3])], "grp string, control string, control_ord int, label string")
    rows, steps = match.located_by_step(fields, shown)
    assert {r["field"]: r["status"] for r in rows.collect()} == dict.fromkeys(words[:3], "matched")
    assert {r["step"]: r["deferred"] for r in steps.collect()} == {"one": False, "two": True}
    rows, _ = match.located_by_step(fields, shown.filter("control_ord < 2"))
    assert rows.count() == 6
    seen = [("f", 1, 1, "s1", "a", "", "", False), ("f", 1, 2, "s1", "", "b", "", True), ("f", 2, 1, "s2", "", "b", "", True), ("f", 2, 2, "s2", "a", "", "", True), ("f", 3, 1, "s3", "a", "", "", True)]
    got = dumps.merged(spark.createDataFrame(seen, "form string, dump int, ord int, step string, name string, id string, selector string, visible boolean")).orderBy("ref").collect()
    assert [(r["ref"], r["name"] or r["id"], r["step"]) for r in got] == [("c1", "a", "s2"), ("c2", "b", "s1")]
    why = lambda *a, **k: one(spark, geometry.refusal(*map(F.lit, a), **k))
    assert why(True, 0, False, False) == "encrypted" and why(False, 0, True, True) == "no pages" and why(False, 1, True, False) is None
    assert why(False, 1, False, False) == "scan" and why(False, 1, False, True) == "nowhere to write" and why(False, 1, False, False, can_render=True) is None


def test_scrub_runs_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "mail a@b.sg")], "note_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = scrubbed(spark.readStream.schema("note_id long, text string").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("notes").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("notes").first()["redacted_text"] == "mail [EMAIL_1]"


def test_entry_imports_and_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_quotes_are_found_anywhere(spark):
    texts = [(1, '(take two tablets daily'), (2, '"take two  tablets\ndaily.'), (3, "take two tablets. take two tablets, xtake two tabletsy"), (4, "take  two"), (5, None), (None, "mistake two."), (6, "a\\Eb c\\Eb c")]
    notes = spark.createDataFrame(texts, "note_id long, text string")
    asked = spark.createDataFrame([(1, "take two tablets daily"), (2, "take two tablets"), (3, "take two"), (4, "ake"), (5, ""), (6, None), (7, "take two"), (8, "\\Eb c"), (9, "x two tablets daily")], "quote_id long, quote string")
    flat = [(i, " ".join(t.split())) for i, t in texts if t is not None]
    want = {(i, r["quote_id"]): t.count(q) for i, t in flat for r in asked.collect() if (q := r["quote"]) and q in t}
    got = quotes.located(notes, asked).collect()
    assert {(r["note_id"], r["quote_id"]): r["hits"] for r in got} == want and len(got) == len(want)
    assert want[1, 1] == want[2, 1] == want[4, 3] == want[None, 3] == 1 and want[3, 2] == 3 and want[6, 8] == 2


def test_pieces_of_quotes_count_where_they_occur_once(spark):
    notes = spark.createDataFrame([(1, "Seen by Dr Ong; MC 14 days. Review in\nclinic. fever fever, no rash. no rash. one one one")], "note_id long, text string")
    said = ["MC 14 days; Seen by Dr Ong.", "Review in clinic; Ong.", "no rash. Seen by Dr Ong;", "Diagnosis: fever; MC 15 days", "MC 14 days.", "one one; in clinic."]
    got = {(r["quote_id"], r["piece"], r["found"]) for r in quotes.pieces_located(notes, spark.createDataFrame(list(enumerate(said)), "quote_id long, quote string")).collect()}
    assert got == {(0, 1, "MC 14 days"), (0, 2, "Seen by Dr Ong"), (1, 1, "Review in clinic"), (2, 2, "Seen by Dr Ong;"), (5, 2, "in clinic.")}


def test_passes_and_owners(spark):
    as_of = F.lit(AS_OF)
    notes = [
        (1, "Patient: Chua Beng Huat · S7211043C · 04/11/1972 · 91112233 · 18 Toa Payoh, Singapore 310018", None), (2, "husband S6234567C present\nClinic tel 62551234", None), (3, "Tan Wei Ling, Chua Ah Kow, S7211043C 04/11/1972", "ling tan wei"),
        (4, "Seen 02/08/2024, sore throat. Covered by AIA.", None), (5, "Lim Ah\nS7211043C\n04/11/1972\nwell today", None), (6, None, None), (7, "", None),
    ]
    got = {}
    for r in extract.parsed(spark.createDataFrame(notes, "note_id long, text string, known_name string"), as_of).collect():
        got.setdefault(r["note_id"], {})[r["field"]] = (r["value"], r["how"])
    assert got[1] == {"full_name": ("Chua Beng Huat", "patient-line"), "nric": ("S7211043C", "patient-line"), "dob": ("1972-11-04", "patient-line"), "phone": ("91112233", "patient-line"), "address": ("18 Toa Payoh, Singapore 310018", "patient-line")}
    assert 2 not in got and got[3]["full_name"] == ("Tan Wei Ling", "header-line") and "dob" not in got[4] and got[4]["insurer"] == ("AIA", "sole-match")
    assert "full_name" not in got[5] and got[5]["nric"][1] == "sole-match" and set(got) == {1, 3, 4, 5}
    one_ = lambda e: spark.range(1).select(e.alias("v")).first()["v"]
    assert one_(extract.policy_values(F.lit("GH-88213004 then GHS-88213004, GE-88213004 and GHS/88213004"))) == ["GHS-88213004", "GE-88213004"]
    assert one_(extract.is_same_name(F.lit("Beng Huat, CHUA"), F.lit("chua beng huat"))) and not one_(extract.is_same_name(F.lit(""), F.lit("")))


def test_pattern_pass_against_python(spark):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: (r["x"]["text"], [tuple(e) for e in r["x"]["entries"]]) for r in docs.select("doc_id", redact.pattern_pass(F.col("text")).alias("x")).collect()}
    for d in docs.collect():
        text_, entries = d["text"], []
        for pattern, base, first in patterns.TOKENED:
            seen = {}
            if text_ is not None:
                text_ = patterns.compiled(pattern).sub(lambda m: f"[{base}_{seen.setdefault(m[0], len(seen)) + first}]", text_)
            entries += [(f"[{base}_{k + first}]", v) for v, k in seen.items()]
        assert got[d["doc_id"]] == (text_, entries)
    many = " ".join(f"a{k % 1500}@x.sg," for k in range(4000))
    assert one(spark, redact.scrub_patterns(F.col("t")), t=many) == re.sub(r"a(\d+)@x\.sg", lambda m: f"[EMAIL_{int(m[1]) + 1}]", many)


def test_text_fits_its_box(spark):
    assert sinks.wrapped("one two  three", 10, 40) == ["one two", "three"] and sinks.wrapped("abcdefghij", 10, 30) == ["abcde", "fghij"]
    lines, size = sinks.fitting("word " * 40, 100, 60, None)
    assert 6 <= size < 11 and len(lines) * size * 1.15 <= 56 and sinks.fitting("x", 50, 20, 9.0) == (["x"], 9.0)
    assert len(sinks.fitting("word " * 400, 60, 30, None)[0]) == 3


def test_replies_need_a_recording(spark):
    req = spark.createDataFrame([("a", "p"), ("b", "q")], "key string, prompt string")
    rec = spark.createDataFrame([("p", "end", '{"fields": []}')], "prompt string, stop string, reply string").select(F.sha2("prompt", 256).alias("prompt_sha256"), "stop", "reply")
    assert {r["key"]: r["error"] for r in provider.reply_errors(provider.recorded(rec)(req)).collect()} == {"a": None, "b": "no text"}
    assert one(spark, provider.sweep_findings(F.lit("- Tan Ah\n• 12 Road\nNONE\n\n"))) == ["Tan Ah", "12 Road"] and one(spark, provider.sweep_findings(F.lit("none"))) == []
    assert '"enum":["b0"]' in one(spark, intake.box_grammar(F.array(F.lit("b0")))) and '"number"' in one(spark, intake.page_grammar()) and '"enum":["x"]' in one(spark, intake.answer_grammar(F.array(F.lit("x"))))


def test_pattern_files_fail_closed(spark, tmp_path):
    import json

    import pytest

    good = {"patterns": [{"field": f, "regex": r, "ignore_case": f == "nric", "token": f.upper(), "start": n} for f, r, n in (("nric", r"\b[STFGM]\d{7}[A-Z]\b", 2), ("phone", r"\b\d{8}\b", 2), ("email", r"\S+@\S+", 1))], "shields": [{"regex": "Clinic", "ignore_case": False}]}
    (tmp_path / "p.json").write_text(json.dumps(good))
    specs, shields = registry.patterns(spark, str(tmp_path / "p.json"))
    got = one(spark, redact.pattern_pass(F.col("t"), specs), t="s1234567d or 91234567 or a@b.sg")
    assert got["text"] == "[NRIC_2] or [PHONE_2] or [EMAIL_1]" and shields == ("(?U)Clinic",)
    for body in ("{", "{}", json.dumps({"patterns": good["patterns"][:2]})):
        (tmp_path / "bad.json").write_text(body)
        with pytest.raises(registry.PatternError):
            registry.patterns(spark, str(tmp_path / "bad.json"))


def test_requests_corpora_and_banks(spark, tmp_path):
    raw = spark.createDataFrame([(1, '{"fields": [{"label": "Name", "instance": 2}], "redacted_text": "x"}'), (2, "{"), (3, None), (4, "[]")], "request_id int, body string")
    got = {r["request_id"]: (r["error"], r["redacted_text"], r["fields"]) for r in registry.requests(raw, "map-redacted").collect()}
    assert got[1][:2] == (None, "x") and got[1][2][0]["instance"] == 2 and [got[k][0] for k in (2, 3, 4)] == ["not readable"] * 3
    (tmp_path / "c.json").write_text('{"cases": [{"id": "a", "note": "n", "record": {"full_name": "Tan", "dob": "1970-01-02", "phone": ""}}]}')
    cases = registry.corpus(spark, str(tmp_path / "c.json"), "struct<id:string,note:string,record:struct<full_name:string,nric:string,dob:string,phone:string,address:string,policy_number:string>>")
    r = evalkit.case_records(cases).first()
    assert (r["full_name"], r["nric"], r["dob"], r["phone"], r["clinical_text"]) == ("Tan", "", datetime.date(1970, 1, 2), None, "n")
    folder = str(tmp_path / "bank")
    bank.append(spark.createDataFrame([("k", '{"a": 1}'), ("bad", "{")], "key string, form string"), folder)
    bank.append(spark.createDataFrame([("k", '{"a": 2}'), ("n", '{"b": 1}')], "key string, form string"), folder)
    assert {tuple(x) for x in bank.banked(spark, folder).collect()} == {("k", '{"a": 1}'), ("n", '{"b": 1}')} and bank.banked(spark, None).count() == 0
    assert [bank.backend(*x) for x in (("d", "t"), (None, "t"), ("", None))] == ["folder", "remote", "none"]
