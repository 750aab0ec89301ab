"""Joins by structure against plain comparison: labels, turns, quotes, boxes, lines of text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillstone.functions.text import content_tokens, normalised
from quillstone.operators import evalkit, fill, geometry, match, quotes, sinks

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    """Every part as a field or control of its brand, labelled by its name and type, and a few odd ones."""
    p = spark.read.parquet(f"{SF}/part.parquet").select("p_brand", "p_partkey", "p_size", F.concat_ws(" ", "p_name", F.lit("of the"), "p_type", (F.col("p_size") % 5).cast("string")).alias("label"))
    rows = [(r[0], r[1], r[2], r[3]) for r in p.collect()]
    rows += [("x", 1, 1, "1. Date"), ("x", 2, 1, "of the"), ("x", 3, 1, ""), ("x", 4, 1, "date of birth"), ("x", 11, 30, "Date"), ("x", 12, 30, "Of the"), ("x", 13, 30, ""), ("x", 14, 30, "Birth date"), ("x", 15, 30, "birth, date of (patient)")]
    df = spark.createDataFrame(rows, "grp string, k long, size int, label string")
    fields = df.filter("size <= 25").select("grp", F.col("k").alias("field"), F.col("k").alias("field_ord"), "label")
    controls = df.filter("size > 25").select("grp", F.col("k").alias("control"), F.col("k").alias("control_ord"), "label")
    return fields, controls


def scored_plainly(fields, controls):
    """(grp, field, control) -> score of all pairs with a score, from words worked out row by row."""
    words = lambda df, k: [(r["grp"], r[k], r["n"], set(r["t"])) for r in df.select("grp", k, normalised(F.col("label")).alias("n"), content_tokens(F.col("label")).alias("t")).collect()]
    by = {}
    for c in words(controls, "control"):
        by.setdefault(c[0], []).append(c)
    out = {}
    for g, f, n, t in words(fields, "field"):
        for _, c, m, u in by.get(g, ()):
            s = 1.0 if n and n == m else 2 * len(t & u) / (len(t) + len(u)) if t and u else 0.0
            if s:
                out[g, f, c] = s
    return out


def test_similar_labels_by_their_rarest_words(labels):
    want = scored_plainly(*labels)
    for least in (0.55, 0.8, 1.0):
        got = {(r["grp"], r["field"], r["control"]): r["score"] for r in match.pairs(*labels, least).collect()}
        assert got == {k: s for k, s in want.items() if s >= least - 1e-9} and got
    every = {(r["grp"], r["field"], r["control"]): r["score"] for r in match.pairs(*labels).collect()}
    assert every == want
    f, c = match._labels(labels[0], "field", "f"), match._labels(labels[1], "control", "c")
    assert match._prefixed(f, c, 0.55).count() < 0.7 * len(want)


def test_common_words_make_no_candidates(spark):
    """Thousands of labels of one page share words; only those that share the rare ones meet."""
    n = 4000
    label = lambda k: F.concat(F.lit("patient name number "), F.concat(F.lit("q"), k), F.lit(" part "), F.concat(F.lit("r"), k))
    fields = spark.range(n).select(F.lit("g").alias("grp"), F.col("id").alias("field"), F.col("id").alias("field_ord"), label(F.col("id").cast("string")).alias("label"))
    controls = fields.select("grp", F.col("field").alias("control"), F.col("field").alias("control_ord"), "label")
    got = match.pairs(fields, controls, 0.7)
    assert got.count() == n and match._prefixed(match._labels(fields, "field", "f"), match._labels(controls, "control", "c"), 0.7).count() == n


def test_located_without_weak_scores(labels):
    full, few = ({(r["grp"], r["field"]): (r["status"], r["control"], r["score"] if r["score"] >= match.LEAST else 0.0) for r in match.located(*labels, scores=s).collect()} for s in (True, False))
    assert full == few and {x[0] for x in full.values()} == {"matched", "ambiguous", "unmatched"}


def turns(scores):
    """Controls one after the other, the best-scored first, then in their own order."""
    out = set()
    for g in {k[0] for k in scores}:
        own = {(f, c): s for (grp, f, c), s in scores.items() if grp == g}
        top = {}
        for (f, c), s in own.items():
            top[c] = max(top.get(c, 0), s)
        taken = set()
        for c in sorted(top, key=lambda c: (-top[c], c)):
            ranked = sorted((-s, f) for (f, d), s in own.items() if d == c and f not in taken)
            if ranked and -ranked[0][0] >= match.LEAST and not (len(ranked) > 1 and round(ranked[1][0] - ranked[0][0], 9) < match.MARGIN):
                taken.add(ranked[0][1])
                out.add((g, ranked[0][1], c))
    return out


def test_turns_in_rounds(spark, labels):
    got = [(r["grp"], r["field"], r["control"]) for r in match.enriched(match.pairs(*labels)).collect()]
    want = turns(scored_plainly(*labels))
    assert set(got) == want and len(got) == len(want) > 20
    r = random.Random(3)
    scores = {(f"g{g}", f, c): r.choice([0.5, 0.56, 0.6, 0.62, 0.7, 0.9, 1.0]) for g in range(4) for f in range(12) for c in range(12) if r.random() < 0.3}
    rows = spark.createDataFrame([(g, f, f, c, c, s) for (g, f, c), s in scores.items()], "grp string, field long, field_ord long, control long, control_ord long, score double")
    assert {(r["grp"], r["field"], r["control"]) for r in match.enriched(rows).collect()} == turns(scores)
    assert match.enriched(rows.limit(0)).count() == 0


def test_a_selector_decides_between_likely_controls(spark):
    fields = spark.createDataFrame([("g", "a", 1, "Date of admission", "#two"), ("g", "b", 2, "Diagnosis", "#none"), ("g", "c", 3, "Surname", "#one")], "grp string, field string, field_ord int, label string, selector string")
    controls = spark.createDataFrame([("g", "x", 1, "Date of admission", "#one"), ("g", "y", 2, "Admission date", "#two"), ("g", "z", 3, "Diagnosis", "#three")], "grp string, control string, control_ord int, label string, selector string")
    got = {r["field"]: (r["status"], r["control"]) for r in match.located(fields, controls).collect()}
    assert got == {"a": ("matched", "y"), "b": ("matched", "z"), "c": ("unmatched", None)}


def test_disabled_controls_are_no_candidates(spark):
    fields = spark.createDataFrame([("g", k, k, f"Question {k} about subject{k}", "") for k in range(1, 5)], "grp string, field int, field_ord int, label string, step string")
    ddl = "grp string, control string, control_ord int, label string, type string, existing string, shown string, checked boolean, disabled boolean, read_only boolean, options array<string>, option_values array<string>"
    one = lambda name, k, off=False, ro=None: ("g", name, k, f"Question {k} about subject{k}", "text", "", None, False, off, ro, None, None)
    controls = spark.createDataFrame([*[one(f"c{k}", k) for k in range(1, 4)], one("off", 4, True), one("on", 4), one("ro", 1, None, True)], ddl)
    values = spark.createDataFrame([("g", k, "x") for k in range(1, 5)], "grp string, field int, value string")
    got = {r["field"]: (r["status"], r["reason"]) for r in fill.filled_page(fields, controls, values).collect()}
    assert got == {k: ("filled", None) for k in range(1, 5)}


def test_short_quotes_by_automata(spark, monkeypatch):
    r = random.Random(8)
    syllables = ["ab", "ba", "c", "ca", "é", "日"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))
    notes = [(k, " ".join(word() for _ in range(30))) for k in range(60)] + [(100, None), (101, ""), (102, "ab  \n ba")]
    asked = [(k, " ".join(word() for _ in range(r.choice([1, 2, 2, 3, 4])))) for k in range(300)] + [(500, " ab\tba "), (501, ""), (502, None)]
    n, q = spark.createDataFrame(notes, "note_id long, text string"), spark.createDataFrame(asked, "quote_id long, quote string")
    plain = lambda t: re.sub(r"\s+", " ", t or "").strip()
    want = {(i, j, plain(t).count(plain(x))) for i, t in notes for j, x in asked if plain(x) and plain(x) in plain(t)}
    for shard in (quotes.SHARD, 900):
        monkeypatch.setattr(quotes, "SHARD", shard)
        found = quotes.located(n, q)
        assert {tuple(x) for x in found.collect()} == want and len(want) > 100
        assert "Cartesian" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
    assert quotes.located(n, q.limit(0)).count() == 0 and quotes.located(n.limit(0), q).count() == 0


def test_pieces_and_whole_quotes_are_found_in_one_pass(spark, monkeypatch):
    r = random.Random(9)
    word = lambda: r.choice(["ab", "ba", "c.", "ca;", "é", "日", "dd", "e"])
    notes = spark.createDataFrame([(k, " ".join(word() for _ in range(60))) for k in range(40)] + [(None, "ab ba c. dd  e ca"), (90, None)], "note_id long, text string")
    asked = spark.createDataFrame([(k, " ".join(word() for _ in range(r.choice([3, 4, 6])))) for k in range(80)] + [(200, "ab ba c. dd e"), (201, None), (None, "ab ba; dd e")], "quote_id long, quote string")
    passes, texts = [], quotes._texts
    monkeypatch.setattr(quotes, "_texts", lambda n: passes.append(1) or texts(n))
    found = quotes.pieces_located(notes, asked)
    rows = sorted(map(str, found.collect()))
    assert passes == [1] and "xxhash64" not in found._jdf.queryExecution().optimizedPlan().toString() and len(rows) > 20
    monkeypatch.setattr(quotes, "PASSES", 0)  # by runs of words
    assert sorted(map(str, quotes.pieces_located(notes, asked).collect())) == rows
    held = {(x["note_id"], x["quote_id"]) for x in quotes.located(notes, asked).collect()}
    assert held and not held & {(x["note_id"], x["quote_id"]) for x in found.collect()}


def test_many_short_quotes_make_no_product(spark):
    n = spark.range(500).select(F.col("id").alias("note_id"), F.concat_ws(" ", F.lit("w"), *[(F.col("id") * k % 997).cast("string") for k in range(1, 40)]).alias("text"))
    q = spark.range(10000).select(F.col("id").alias("quote_id"), F.concat_ws(" ", (F.col("id") % 997).cast("string"), (F.col("id") * 7 % 997).cast("string")).alias("quote"))
    found = quotes.located(n, q)
    assert "Cartesian" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
    texts = [" ".join(["w", *(str(i * k % 997) for k in range(1, 40))]) for i in range(500)]
    assert found.count() == sum(f"{j % 997} {j * 7 % 997}" in t for j in range(10000) for t in texts)


def plain_nearest(widgets, runs, most=4):
    out = set()
    for page, wid, x, y, h in widgets:
        best = {}
        for p, text, tx, ty, o in runs:
            if p != page:
                continue
            left, above = x - tx, y - ty
            if abs(ty - y - h / 2) < 1.4 * max(h, 8.0) and left > 0:
                key = (0, left, o) if left <= 260 else None
            else:
                key = (1, above, o) if 0 < above <= 40 and abs(left) <= 260 else None
            if key and (text not in best or key < best[text]):
                best[text] = key
        out |= {(page, wid, k + 1, t) for k, (_, t) in enumerate(sorted((v, t) for t, v in best.items())[:most])}
    return out


def test_nearest_text_on_a_grid(spark):
    r = random.Random(1)
    widgets = [(p, k, r.uniform(-50, 700), r.uniform(-50, 900), r.choice([0.0, 4.0, 12.0, 40.0, 333.0, 2000.0])) for p in (1, 2) for k in range(60)] + [(3, 1, 10.0, 10.0, 5.0)]
    runs = [(p, f"t{r.randrange(80)}", r.uniform(-100, 800), r.uniform(-100, 1000), k) for p in (1, 2, 4) for k in range(200)] + [(1, "edge", 260.0, 40.0, 900)]
    widgets += [(1, 900, 520.0, 80.0, 0.0), (1, 901, 0.0, 80.0, 0.0)]
    w, x = spark.createDataFrame(widgets, "page int, widget int, x double, y double, h double"), spark.createDataFrame(runs, "page int, text string, tx double, ty double, tord int")
    assert {tuple(g) for g in geometry.nearest_text(w, x).collect()} == plain_nearest(widgets, runs)


def test_a_page_of_many_runs(spark):
    """Boxes and text of a very tall page meet a constant number of times each."""
    n = 100_000
    runs = spark.range(n).select(F.lit(1).alias("page"), F.concat(F.lit("t"), "id").alias("text"), (F.col("id") % 3 * 200.0).alias("tx"), (F.col("id") * 5.0).alias("ty"), F.col("id").alias("tord"))
    boxes = spark.range(n // 10).select(F.lit(1).alias("page"), F.col("id").alias("widget"), F.lit(450.0).alias("x"), (F.col("id") * 50.0).alias("y"), F.lit(10.0).alias("h"))
    assert geometry.nearest_text(boxes, runs).groupBy("rank").count().count() == 4


def greedy_lines(text, size, room):
    """Word by word, letter by letter."""
    w = lambda s: sum(sinks.WIDTHS[ord(c) - 32] if 32 <= ord(c) < 127 else 556 for c in s) * size / 1000
    out = []
    for part in text.split("\n"):
        rows = [""]
        for word in part.split():
            if rows[-1] and w(rows[-1] + " " + word) > room:
                rows.append("")
            rows[-1] = f"{rows[-1]} {word}".strip()
        for row in rows:
            head = ""
            for c in row:
                if head and w(row) > room and w(head + c) > room:
                    out.append(head)
                    row, head = row[len(head) :], ""
                head += c
            out.append(head)
    return out


def test_twins_of_any_key_are_controls_of_their_own(spark, tmp_path):
    from quillstone.plans import forms

    for k in (-1, 0, 1, 2):
        spark.createDataFrame([(k, "Brand#1", 5 if k == 0 else 2)], "p_partkey long, p_brand string, p_size int").write.mode("append").parquet(f"{tmp_path}/part.parquet")
    got = sorted((r["field"], r["status"], r["reason"]) for r in forms.filled_page(spark, str(tmp_path)).collect())
    assert got == [(-1, "filled", None), (0, "skipped", "already answered"), (1, "filled", None), (2, "filled", None)]


def test_text_is_measured_once(spark):
    r = random.Random(6)
    texts = ["", "a", "\n", "x\n\ny", " lead and trail ", "W" * 60, "one " + "M" * 40 + " two", "tab\there é日本"]
    texts += [" ".join("".join(r.choice("ilmWe.é") for _ in range(r.choice([1, 3, 8, 30]))) for _ in range(r.randrange(30))) for _ in range(60)]
    for text in texts:
        for size, room in ((6.0, 40.0), (11.0, 100.0), (7.5, 3.0), (10.2, 61.344)):
            assert sinks.Measured(text).lines(size, room) == greedy_lines(text, size, room), (text, size, room)
        for w, h, top in ((100.0, 30.0, None), (60.0, 90.0, 10.2), (20.0, 10.0, 24.0), (300.0, 300.0, 4.0)):
            size, want = top or 11.0, None
            while size >= 6 and want is None:
                ls = greedy_lines(text, size, w - 4)
                want, size = ((ls, size), size) if len(ls) * size * 1.15 <= h - 4 else (None, size - 0.5)
            want = want or (greedy_lines(text, 6.0, w - 4)[: max(1, int((h - 4) // (6 * 1.15)))], 6.0)
            assert sinks.fitting(text, w, h, top) == want, (text, w, h, top)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sinks.text_width(F.col("t"), F.lit(1000)).alias("w")).collect()
    assert all(round(r["w"]) == sum(sinks.WIDTHS[ord(c) - 32] if 32 <= ord(c) < 127 else 556 for c in r["t"]) for r in rows)


def test_unknown_ids_are_told_whatever_their_value(spark):
    box = "struct<page:int,x:double,y:double,w:double,h:double,size:double>"
    fields = spark.createDataFrame([("f", "a", (1, 0.0, 0.0, 90.0, 30.0, None)), ("f", "b", (1, 0.0, 40.0, 90.0, 30.0, None))], f"form string, field string, box {box}")
    values = spark.createDataFrame([("f", "a", "x", None), ("f", "b", "", None), ("f", "zz", None, None), ("f", "yy", "", None), ("f", "ww", None, False)], "form string, field string, value_str string, value_bool boolean")
    pages = spark.createDataFrame([("f", 1, 842.0)], "form string, page int, height double")
    got = {r["field"]: r["error"] for r in sinks.overlay_rows(fields, values, pages).collect()}
    assert got == {"a": None, "zz": "unknown field", "yy": "unknown field", "ww": "unknown field"}
    own = spark.createDataFrame([("f", "a", "/Tx", None, 0), ("f", "b", "/Tx", None, 0)], "form string, name string, kind string, states array<string>, flags int")
    got = {r["name"]: r["error"] for r in sinks.form_rows(own, values.withColumn("value_str", F.nullif("value_str", F.lit(""))).withColumnRenamed("field", "name")).collect()}
    assert got == {"a": None, "zz": "unknown field", "yy": "unknown field", "ww": "unknown field"}


def test_texts_are_fitted_by_many_tasks(spark):
    box = "struct<page:int,x:double,y:double,w:double,h:double,size:double>"
    fields = spark.createDataFrame([("f", f"k{k}", (1, 0.0, 0.0, 90.0, 30.0, None)) for k in range(64)], f"form string, field string, box {box}").coalesce(1)
    values = fields.select("form", "field", F.lit("as long as all others").alias("value_str"), F.lit(None).cast("boolean").alias("value_bool"))
    rows = sinks.overlay_rows(fields, values, spark.createDataFrame([("f", 1, 842.0)], "form string, page int, height double"))
    assert len({r[0] for r in rows.select(F.spark_partition_id()).collect()}) > 4 and rows.select("lines", "size").distinct().count() == 1


def test_forbidden_phrases_run_over_values_in_order(spark):
    rows = spark.createDataFrame([("k", "f1", "zulu alpha", False, 1), ("k", "f2", "beta", False, 2)], "case string, field string, value string, needs_review boolean, ord int")
    checks = spark.createDataFrame([("k", "forbid", None, "Alpha beta"), ("k", "forbid", None, "beta zulu")], "case string, kind string, field string, want string")
    assert evalkit.case_scores(rows, checks).first()["faults"] == 1


def plainly_located(fields, controls):
    """field -> (control, status) by comparing every row with every row; fields and controls: (grp, id, label, selector)."""
    noise = {"of", "the"}
    words = lambda s: set(s.lower().split()) - noise
    best = {}
    for g, f, a, sel in fields:
        rows = []
        for h, c, b, own in controls:
            t, u = words(a), words(b)
            s = 0.0 if g != h else 1.0 if a.lower() == b.lower() else 2 * len(t & u) / (len(t) + len(u))
            if s:
                rows.append((-(s >= 0.6 and own is not None and own == sel), -s, c))
        rows.sort()
        if not rows or rows[0][1] > -0.6:
            best[g, f] = (rows[0][2] if rows else None, 0.0, "unmatched")
        else:
            clear = rows[0][0] or len(rows) == 1 or round(rows[1][1] - rows[0][1], 9) >= 0.05
            best[g, f] = (rows[0][2], rows[0][1], "matched" if clear else "ambiguous")
    claims = {}
    for (g, f), (c, s, st) in best.items():
        if st == "matched":
            claims[g, c] = min(claims.get((g, c), (0.0, 0)), (s, f))
    return {(g, f): (c, "matched") if st == "matched" and claims[g, c][1] == f else (None, "ambiguous" if st != "unmatched" else st) for (g, f), (c, s, st) in best.items()}


def test_labels_that_repeat_are_compared_once(spark):
    """Rows with equal labels, with selectors of their own and without: as by comparing rows, while only different labels meet."""
    r = random.Random(5)
    pool = ["name of ward", "name of doctor", "name of the ward nurse", "date", "date of visit", "date visit time", "bed", "ward bed number"]
    rows = lambda n: [(r.choice("gh"), k, r.choice(pool), r.choice((None, None, "s1", "s2"))) for k in range(n)]
    fields, controls = rows(40), [*rows(12), ("i", 12, "bed", None)]
    f = spark.createDataFrame(fields, "grp string, field long, label string, selector string").withColumn("field_ord", F.col("field"))
    c = spark.createDataFrame(controls, "grp string, control long, label string, selector string").withColumn("control_ord", F.col("control"))
    for scores in (True, False):
        got = {(x["grp"], x["field"]): (x["control"], x["status"]) for x in match.located(f, c, scores).collect()}
        assert got == plainly_located(fields, controls)
    many = spark.range(3000).select(F.lit("g").alias("grp"), F.col("id").alias("field"), F.col("id").alias("field_ord"), F.concat(F.lit("ward "), (F.col("id") % 3).cast("string")).alias("label"))
    shown = many.withColumnsRenamed({"field": "control", "field_ord": "control_ord"})
    assert match._scored(match._labels(many, "field", "f"), match._labels(shown, "control", "c"), 0.0).count() == 9


def test_turns_of_labels_that_repeat(spark):
    """Controls and fields with equal labels: by label the same as by taking turns row by row, in as many rounds as fields are taken at most."""
    r = random.Random(8)
    pool = ["ward name", "ward name bed", "date", "date of visit", "visit date time", "bed number", "bed", "time", "nurse", "nurse name", "plan", "plan number limit"]
    for _ in range(2):
        rows = lambda n: [(g, k * 2 + (g == "h"), r.choice(pool)) for g in "gh" for k in range(n)]
        f = spark.createDataFrame(rows(9), "grp string, field long, label string").withColumn("field_ord", F.col("field"))
        c = spark.createDataFrame(rows(16), "grp string, control long, label string").withColumn("control_ord", F.col("control"))
        want = {tuple(x) for x in match.enriched(match.pairs(f, c)).select("grp", "field", "control").collect()}
        assert {tuple(x) for x in match.enriched_labels(f, c).select("grp", "field", "control").collect()} == want and want
    many = spark.range(6000).select(F.lit("g").alias("grp"), F.col("id").alias("field"), F.col("id").alias("field_ord"), F.concat(F.lit("ward "), (F.col("id") % 3).cast("string")).alias("label"))
    assert match.enriched_labels(many, many.withColumnsRenamed({"field": "control", "field_ord": "control_ord"})).count() == 0


def test_many_texts_and_boxes_at_one_place(spark):
    """Thousands of boxes and texts at a few places: places meet, and the first texts of each are enough."""
    boxes = spark.range(3000).select(F.lit(1).alias("page"), F.col("id").alias("widget"), (100.0 + F.col("id") % 2).alias("x"), F.lit(50.0).alias("y"), F.lit(10.0).alias("h"))
    runs = spark.range(3000).select(F.lit(1).alias("page"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), (90.0 - F.col("id") % 3).alias("tx"), F.lit(50.0).alias("ty"), (-F.col("id")).alias("tord"))
    got = geometry.nearest_text(boxes, runs)
    assert got.groupBy("rank", "text").count().orderBy("rank").collect() == [(1, "t2997", 3000), (2, "t2994", 3000), (3, "t2991", 3000), (4, "t2988", 3000)]
