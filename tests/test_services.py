"""The bank's commits, providers that ask, and the survey of a page."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from quillstone.operators import bank, intake, provider, survey


def forms(spark, rows):
    return spark.createDataFrame(rows, "key string, form string")


def test_the_first_writer_of_a_key_wins(spark, tmp_path):
    folder = f"file://{tmp_path}/bank"
    assert bank.snapshot(spark, folder) == (0, []) and bank.banked(spark, folder).count() == 0
    gate, done = threading.Barrier(4), []

    def write(k):
        gate.wait()
        done.append(bank.append(forms(spark, [("same", f'{{"by": {k}}}'), (f"own{k}", "{}")]), folder))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(done) == [1, 2, 3, 4]
    got = {r["key"]: r["form"] for r in bank.banked(spark, folder).collect()}
    assert set(got) == {"same", "own0", "own1", "own2", "own3"} and bank.banked(spark, folder).count() == 5
    first = got["same"]
    bank.append(forms(spark, [("same", '{"by": 9}')]), folder)
    assert {r["form"] for r in bank.banked(spark, folder).filter("key = 'same'").collect()} == {first}


def test_a_failed_writer_leaves_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/bank"
    bank.append(forms(spark, [("a", "{}")]), folder)
    broken = forms(spark, [("b", "{}"), ("c", "{}")]).withColumn("form", F.when(F.col("key") == "c", F.raise_error(F.lit("no"))).otherwise(F.col("form")))
    with pytest.raises(Exception, match="no"):
        bank.append(broken, folder)
    assert [r["key"] for r in bank.banked(spark, folder).collect()] == ["a"] and bank.snapshot(spark, folder)[0] == 1
    bank.append(forms(spark, [("b", "{}")]), folder)
    old = bank.banked(spark, folder)  # a reader of the state before
    assert bank.compacted(spark, folder) == 3 and len(bank.snapshot(spark, folder)[1]) == 1 and bank.compacted(spark, folder) == 3
    assert old.count() == bank.banked(spark, folder).count() == 2
    assert bank.cleaned(spark, folder) in (2, 3) and bank.banked(spark, folder).count() == 2


def test_prompts_are_asked_once(spark, tmp_path):
    """Every third prompt fails twice, one always, one hangs; what the ledger has isn't asked again."""
    seen = str(tmp_path / "asked")
    os.makedirs(seen)

    def work(prompt):
        import time
        import uuid

        n = int(prompt.split()[1])
        with open(f"{seen}/{n}-{uuid.uuid4().hex}", "w"):
            pass
        times = sum(f.startswith(f"{n}-") for f in os.listdir(seen))
        if n == 7 or (n % 3 == 0 and times < 3):
            raise ValueError("secret words")
        if n == 8:
            time.sleep(4)
        return "end", f"reply {n}"

    ask = lambda: provider.asking(work, f"file://{tmp_path}/ledger", rounds=3, tries=3, seconds=0.5)
    requests = spark.createDataFrame([(f"k{i}", f"prompt {i % 20}") for i in range(40)] + [("none", None)], "key string, prompt string")
    got = {r["key"]: r["reply"] for r in ask()(requests).collect()}
    assert got == {f"k{i}": None if i % 20 in (7, 8) else f"reply {i % 20}" for i in range(40)} | {"none": None}
    count = lambda: {n: sum(f.startswith(f"{n}-") for f in os.listdir(seen)) for n in range(20)}
    first = count()
    assert all(first[n] == (3 if n % 3 == 0 or n == 7 else 1) for n in range(20))
    ask()(requests.limit(100)).collect()
    again = count()
    assert {n for n in range(20) if again[n] > first[n]} == {7, 8}  # only those without a reply


def test_a_lost_round_costs_no_reply_twice(spark, tmp_path):
    seen = str(tmp_path / "asked")
    os.makedirs(seen)

    def work(prompt):
        import uuid

        if not os.path.exists(f"{seen}/mended") and prompt == "p 11":
            os._exit(1)  # the worker dies, not the prompt
        with open(f"{seen}/{prompt[2:]}-{uuid.uuid4().hex}", "w"):
            pass
        return "end", prompt.upper()

    ask = provider.asking(work, f"file://{tmp_path}/ledger", rounds=6)
    requests = spark.createDataFrame([(str(i), f"p {i}") for i in range(30)], "key string, prompt string")
    with pytest.raises(Exception):
        ask(requests)
    kept = {r["reply"] for r in spark.read.parquet(f"file://{tmp_path}/ledger").collect()} if os.path.exists(f"{tmp_path}/ledger") else set()
    before = len(os.listdir(seen))
    open(f"{seen}/mended", "w").close()
    assert {r["key"]: r["reply"] for r in ask(requests).collect()} == {str(i): f"P {i}" for i in range(30)}
    assert len(os.listdir(seen)) - 1 - before == 30 - len(kept)


def test_sweeps_and_pages_go_through_a_provider(spark, tmp_path):
    def work(prompt):
        import re

        if "<picture>" in prompt:
            return "end", '{"fields":[{"label":"Name","type":"text","x":0.1,"y":0.1,"w":0.5,"h":0.05},{"label":"","type":"text","x":0.1,"y":0.2,"w":0.5,"h":0.05}]}'
        if "<boxes>" in prompt:
            refs = re.findall(r'ref="(b\d+)" pdf_name="(\w+)"', prompt)
            return "end", '{"boxes":[' + ",".join(f'{{"ref":"{r}","label":"{n}","description":"","type":"text","options":[],"include":true}}' for r, n in reversed(refs)) + "]}"
        return "end", "\n".join(f"- {x}" for x in re.findall(r"Dr \w+", prompt)) or "NONE"

    ask = provider.asking(work, f"file://{tmp_path}/ledger", rounds=2)
    texts = spark.createDataFrame([(1, "Seen by Dr Ong and Dr Lim"), (2, "Seen by [PATIENT]"), (3, None)], "key int, redacted_text string")
    assert {r["key"]: r["findings"] for r in provider.swept(texts, ask).collect()} == {1: ["Dr Ong", "Dr Lim"], 2: [], 3: []}
    widgets = spark.createDataFrame([("f", p, o, f"box{p}{o}", "/Tx", [], []) for p in (2, 1) for o in (2, 1)], "form string, page int, ord int, name string, kind string, states array<string>, nearby array<string>")
    got = intake.read_boxes(widgets, spark.createDataFrame([], "form string, page int, text string"), ask).orderBy("ord").collect()
    assert [r["label"] for r in got] == ["box11", "box12", "box21", "box22"]
    pages = spark.createDataFrame([("g", 1, 600.0, 800.0)], "form string, page int, width double, height double")
    pictures = spark.createDataFrame([("g", 1, bytearray(b"jpeg")), ("g", 13, bytearray(b"late"))], "form string, page int, picture binary")
    (one,) = intake.read_pictures(pages, pictures, ask).collect()
    assert one["label"] == "Name" and round(one["box"]["x"]) == 60


def test_survey_of_a_page(spark):
    page = "<form>" + "".join(f"<div><label for=i{k}>{w} of patient</label><input id=i{k}{' disabled' if w == 'Bed' else ''}></div>" for k, w in enumerate(("Ward", "Doctor", "Diagnosis", "Bed"))) + "</form>"
    pages = spark.createDataFrame([(1, "https://portal.example/x?id=9", page), (2, "https://else.example/", "<p>none</p>")], "page_id long, url string, html string")
    forms = spark.createDataFrame([("claim", 1, ["portal.example"]), ("other", 2, ["*.other.example"])], "form string, form_ord int, hosts array<string>")
    fields = spark.createDataFrame([(f, w, k, f"{w} of patient", "") for f, ws in (("claim", ("Ward", "Doctor", "Diagnosis")), ("other", ("Plan", "Premium", "Payer"))) for k, w in enumerate(ws)], "form string, field string, field_ord int, label string, step string")
    got = survey.survey(pages, forms, fields)
    assert {r["page"]: (r["host"], r["form"], r["how"], r["fields"], r["error"]) for r in got.pages.collect()} == {1: ("portal.example", "claim", "fit", 3, None), 2: ("else.example", None, None, 0, "no labelled fields")}
    assert {(r["page"], r["form"], r["matched"]) for r in got.scores.filter("matched > 0").collect()} == {(1, "claim", 3)}
    asked = got.fields.orderBy("ord").collect()
    assert [r["id"] for r in asked] == ["ward_of_patient", "doctor_of_patient", "diagnosis_of_patient"]
    notes = spark.createDataFrame([("n1", 1, "Seen in B1.")], "key string, page long, redacted_text string")
    said = '{"fields":[{"id":"ward_of_patient","value":"B1","status":"extracted","source":"Seen in B1.","reasoning":""}]}'
    rows, errors = survey.mapped_live(notes, got.fields, lambda r: r.select("key", F.lit("end").alias("stop"), F.lit(said).alias("reply")))
    assert {r["id"]: (r["value_str"], r["status"]) for r in rows.collect()} == {"ward_of_patient": ("B1", "extracted"), "doctor_of_patient": (None, "missing"), "diagnosis_of_patient": (None, "missing")} and errors.count() == 0


def test_pages_of_one_kind_are_scored_once(spark, monkeypatch):
    """Pages of one host with the same labels in the same order are scored once; host, order and what can't be written still tell them apart, and every page has its own rows."""
    page = lambda ws, off="": "<form>" + "".join(f"<div><label for=i{k}>{w} of patient</label><input id=i{k}{' disabled' if w == off else ''}></div>" for k, w in enumerate(ws)) + "</form>"
    a, b, none = ("Ward", "Doctor", "Diagnosis"), ("Plan", "Premium", "Payer"), "no labelled fields"
    kinds = [
        ("portal.example", page(a), "claim", "fit", 3, None), ("portal.example", page(b), "claim", "host", 3, None), ("portal.example", page(a[::-1]), "claim", "fit", 3, None), ("portal.example", page(a, "Ward"), "claim", "host", 2, None),
        ("else.example", page(a), "claim", "fit", 3, None), ("x.other.example", page(a), "other", "host", 3, None), (None, page(a), "claim", "fit", 3, None), ("portal.example", None, "claim", "host", 0, none), ("else.example", "<p>none</p>", None, None, 0, none),
    ]
    of = {k: kinds[k % len(kinds)] for k in range(20 * len(kinds))}
    pages = spark.createDataFrame([(k, x[0] and f"https://{x[0]}/{k}", x[1]) for k, x in of.items()], "page_id long, url string, html string")
    forms = spark.createDataFrame([("claim", 1, ["portal.example"]), ("other", 2, ["*.other.example"])], "form string, form_ord int, hosts array<string>")
    fields = spark.createDataFrame([(f, w, k, f"{w} of patient", "") for f, ws in (("claim", a), ("other", b)) for k, w in enumerate(ws)], "form string, field string, field_ord int, label string, step string")
    asked, score = [], survey.page_scores
    monkeypatch.setattr(survey, "page_scores", lambda f, c: asked.append(c.select("page").distinct().count()) or score(f, c))
    got = survey.survey(pages, forms, fields)
    assert {r["page"]: tuple(r)[1:] for r in got.pages.collect()} == {k: (x[0], *x[2:]) for k, x in of.items()} and got.pages.count() == len(of)
    matched = {(r["page"], r["form"]): r["matched"] for r in got.scores.collect()}
    assert matched == {(k, f): (x[4] if f == ("other" if k % 9 == 1 else "claim") else 0) for k, x in of.items() if x[4] for f in ("claim", "other")} and got.scores.count() == len(matched)
    assert got.fields.groupBy("page").count().count() == 7 * 20 and got.fields.count() == 20 * (6 * 3 + 2)
    assert asked == [7]


def test_ids_of_many_labels(spark):
    """Ids of a form by row, families of slugs by themselves: as by one pass over all labels, and for forms of many thousand boxes too."""
    import random

    from pyspark.sql import functions as F

    from quillstone.functions import text
    from quillstone.operators import live

    r = random.Random(3)
    pool = ["Date", "Date 2", "Date 2 2", "Date 3", "Date 02", "!!", "field", "field 2", "2", "x" * 45, "x" * 40 + " 2", "Other"]
    rows = [(form, k, r.choice(pool)) for form in (1, 2) for k in range(60)]
    df = spark.createDataFrame(rows, "form int, ord int, label string")
    got = {(x["form"], x["ord"]): x["id"] for x in live.with_ids(df, "form", "ord").collect()}
    for form in (1, 2):
        labels = F.array(*[F.lit(x[2]) for x in rows if x[0] == form])
        assert [got[form, k] for k in range(60)] == spark.range(1).select(text.numbered_slugs(labels)).first()[0]
    many = spark.range(20000).select(F.lit(1).alias("form"), F.col("id").alias("ord"), F.lit("Date").alias("label"))
    assert live.with_ids(many, "form", "ord").agg(F.max("ord"), F.countDistinct("id")).first()[1] == 20000


def test_a_page_is_parsed_once(spark):
    """Whatever is asked of a page's controls, the plan parses it in one place."""
    from pyspark.sql import functions as F

    from quillstone.plans import CORE
    from quillstone.sources import html

    plans = [html.controls(spark.createDataFrame([(1, "<input name=a>")], "page_id int, html string")), CORE.QUERIES["page_dumps"](spark, "/root/testdata/sf0.001"), CORE.QUERIES["page_controls"](spark, "/root/testdata/sf0.001")]
    for df in plans:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    assert html.scrub(" Call  91234567 ") == "Call [PHONE]" and html.scrub("a@b.sg") == "[EMAIL]" and plans[0].select(F.col("name")).first()[0] == "a"


def test_the_first_of_several_second_lines_counts(spark, tmp_path):
    """Of lines with one number the first in the table counts, however the file is split; and options of a file of one part are shown by several tasks."""
    from pyspark.sql import functions as F

    from quillstone.plans import CORE

    n = 20000
    spark.range(n).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.range(0, 3 * n, 1, 1).select((F.col("id") % n).alias("l_orderkey"), F.lit(2).alias("l_linenumber"), F.when(F.col("id") < n, "R").otherwise("A").alias("l_returnflag"), F.when(F.col("id") < n, "first").otherwise(F.col("id").cast("string")).alias("l_linestatus"))
    lines.write.option("parquet.block.size", 20000).parquet(f"{tmp_path}/lineitem.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = CORE.QUERIES["answers_left_default"](spark, str(tmp_path)).groupBy("status", "value").count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [("inferred", "first", n)]
    assert CORE.QUERIES["offered_options"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1
