"""SimHash links, collocations and infilling against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillstone.llm import collocation, infill, simhash

DDL = "doc_id long, text string, lang string, source string, n_chars long, fp long, cell long, phrase string, whole string"


def frame(spark, rows):
    """Documents with further columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 7, 9, "x", "y") for i, t, lang in rows], DDL)


# SimHash


def print_of(text):
    ws = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    grams = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def groups_of(prints):
    """doc_id -> smallest reachable doc_id, by comparing all pairs."""
    ids = [i for i, _ in prints]
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, x) in enumerate(prints):
        for j, y in prints[:a]:
            if (x ^ y).bit_count() <= 4 and top(i) != top(j):
                up[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i in ids}


def test_simhash_against_all_pairs(spark, sf="/root/testdata/sf0.01"):
    r = random.Random(5)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").limit(400).collect()
    rows = [tuple(d) for d in docs]
    top = 10**6
    for k in range(300):  # near copies of a few texts, with words changed
        ws = rows[k % 7][1].split()
        for _ in range(r.randrange(4)):
            ws[r.randrange(len(ws))] = f"new{r.randrange(99)}"
        rows.append((top + k, " ".join(ws), "en"))
    rows += [(top + 900, None, None), (top + 901, "", "en"), (top + 902, " \t\n", "en"), (top + 903, "ONE two", "en"), (top + 904, "one TWO", None), (None, "one two", "en"), (top + 903, "one two", "en")]
    got = simhash.grouped(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = [(i, print_of(t)) for i, t, _ in rows if i is not None]
    want, fps = groups_of(prints), dict(prints)
    for g in got:
        if g["doc_id"] is None:
            assert g["component_id"] is None and g["fp"] % 2**64 == print_of("one two")
        else:
            assert (g["fp"] % 2**64, g["component_id"]) == (fps[g["doc_id"]], want[g["doc_id"]])
    assert sum(g["component_id"] == top + 900 for g in got) == 3
    assert simhash.grouped(frame(spark, [])).count() == 0


def test_shingles_of_long_texts_come_in_runs(monkeypatch):
    text = " ".join(f"w{k % 97}" for k in range(3000))
    monkeypatch.setattr(simhash, "RUN", 256)
    assert simhash.fingerprint(text) == print_of(text) and len(list(simhash.shingle_hashes(text))) == 12


@pytest.mark.parametrize("block,sample", [(512, 64), (8, 64), (8, 1)])
def test_links_in_crowded_cells(spark, monkeypatch, block, sample):
    """Two clouds of fingerprints, chains among them, and random ones; small blocks and salted cells must lose no link."""
    r = np.random.default_rng(block + sample)
    flip = lambda x, k: x ^ int(sum(1 << int(b) for b in r.choice(64, k, replace=False)))
    fps = {0, 2**64 - 1}
    for centre in (0x0123456789ABCDEF, 0x0123456789ABC000):
        fps |= {flip(centre, int(r.integers(0, 5))) for _ in range(150)}
    chain = int(r.integers(0, 2**63))
    for _ in range(40):
        fps.add(chain := flip(chain, 4))
    fps |= {int(x) for x in r.integers(0, 2**63, 100)}
    fps = sorted(fps)
    rows = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SAMPLE", sample)
    monkeypatch.setattr(simhash, "LARGE", 16)
    made = simhash.components(simhash.edges(simhash.settled(rows, "t"))).collect()
    got = {m["node"] % 2**64: m["component"] for m in made}
    want = groups_of([(x - 2**64 if x >= 2**63 else x, x) for x in fps])
    for x in fps:
        signed = x - 2**64 if x >= 2**63 else x
        same = {y for y in fps if want[y - 2**64 if y >= 2**63 else y] == want[signed]}
        if len(same) == 1:
            assert x not in got
        else:
            assert {y for y in fps if got.get(y) == got[x]} == same


def test_cells_are_a_lower_bound():
    """Any two fingerprints within four bits meet in a cell; cells of one fingerprint differ."""
    r = np.random.default_rng(2)
    for _ in range(300):
        x = int(r.integers(0, 2**63))
        y = x ^ sum(1 << int(b) for b in r.choice(64, int(r.integers(0, 5)), replace=False))
        keys, of = simhash.cells_of(np.array([x, y], np.uint64))
        assert set(keys[of == 0].tolist()) & set(keys[of == 1].tolist())
        assert len(set(keys[of == 0].tolist())) == (of == 0).sum() <= 3 * 45


# Collocations


def phrases_of(rows, least, percent, top):
    """lang, rank, phrase, a, l, r, n, score by counting all phrases."""
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, 6):
                for i in range(len(ws) - m + 1):
                    f.setdefault(lang, Counter())[tuple(ws[i : i + m])] += 1
    out = set()
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in cands.items():
            for m in range(2, len(p)):
                gone |= {q for i in range(len(p) - m + 1) if 100 * a >= percent * cands.get(q := p[i : i + m], 10**9)}
        scores = []
        for p, a in cands.items():
            if p not in gone:
                s, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                scores.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out |= {(lang, k + 1, p.decode(), -a, x, y, n[lang], -s) for k, (s, a, p, x, y) in enumerate(sorted(scores)[:top])}
    return out


def phrase_rows():
    r = random.Random(4)
    words = ["the", "of", "Über", "ÉA", "a", "x\x1cy", "日本", "token", "[]"]
    mk = lambda k: "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " . "]) for _ in range(k))
    rows = [(k, mk(60), r.choice(["en", "de", None, "und"])) for k in range(60)]
    return rows + [(100, "a a a a a a a a", "en"), (101, None, "en"), (102, "", None), (103, " ,.;", "xx"), (104, mk(3000), "en"), (100, "a a a a a a a a", "en"), (None, "a a the of", "en")]


def test_collocations_against_counting(spark):
    rows = phrase_rows()
    for least, percent, top in ((5, 100, 2000), (9, 80, 10)):
        got = collocation.mined(frame(spark, rows), least, percent, top).collect()
        assert {tuple(g) for g in got} == phrases_of(rows, least, percent, top) and len(got) == len({tuple(g) for g in got})
    assert collocation.mined(frame(spark, [])).count() == 0
    assert collocation.mined(frame(spark, rows[:3])).count() == 0


def test_collocations_in_rounds_and_passes(spark, monkeypatch):
    """Few slots a round, few patterns a pass and texts in short runs give the same."""
    rows = phrase_rows()
    monkeypatch.setattr(collocation, "HOT", 40)
    monkeypatch.setattr(collocation, "PASS", 500)
    got = collocation.mined(frame(spark, rows), 5).collect()
    assert {tuple(g) for g in got} == phrases_of(rows, 5, 100, 2000)


def test_long_patterns_are_counted_in_one_pass(spark, monkeypatch):
    """Six million characters of patterns are read in one scan of the documents, long texts in parts, overlaps counted."""
    ws = [f"{k:04}" * 500 for k in range(200)] + ["a"]
    text = " ".join(ws[k % 201] for k in range(1000)) + " a a a a.a\ta"
    passes, counted = [], collocation.counted
    monkeypatch.setattr(collocation, "counted", lambda docs, made: passes.append(1) or counted(docs, made))
    phrases = [("en", " ".join(ws[k + j] for j in range(m))) for m in (2, 3, 4, 5) for k in range(200 - m)] + [("en", "a a"), ("en", "a a a"), ("en", "a b")]
    got = {r["phrase"]: r["f"] for r in collocation.counts(frame(spark, [(1, text, "en"), (2, text.upper(), "en"), (3, "a a", "de")]), spark.createDataFrame(phrases, "lang string, phrase string")).collect()}
    assert passes == [1] and got[""] == 2 * 1006 and got["a a"] == 2 * 4 and got["a a a"] == 2 * 2 and "a b" not in got and "b" not in got
    assert all(got[p] == 2 * (f" {text} ".replace(".", " . ")).count(f" {p} ") for _, p in phrases[:-3])


def test_runs_cut_long_pieces(monkeypatch):
    text = " ".join(f"w{k % 13}" for k in range(500))
    whole = collocation.Run(1 << 16)
    for ws, starts in collocation.runs(text):
        whole.add(ws, starts, 1)
    monkeypatch.setattr(collocation, "CUT", 100)
    cut = collocation.Run(1 << 16)
    for ws, starts in collocation.runs(text):
        cut.add(ws, starts, 1)
    assert len(cut.size) > 10 and [np.sort(h).tolist() for _, _, h in whole.phrases()] == [np.sort(h).tolist() for _, _, h in cut.phrases()]


def test_exact_products_beyond_64_bits(spark):
    big = 3 * 10**15
    counts = spark.createDataFrame([("en", "", 10**16), ("en", "a", big), ("en", "b", big + 1), ("en", "a b", big - 7)], "lang string, phrase string, f long")
    got = collocation.ranked(collocation.scored(counts)).first()
    assert got["score"] == 1000 * (big - 7) * 10**16 // (big * (big + 1))


# Infilling


def test_infilling_round_trip(spark):
    texts = [None, "", "a", "é日本\U0001f600x\ny", "has <P> inside", "<S", "<M><", "plain text of some words " * 40, "é x" * 9, "<S><P>", "\r\n" * 5, "ab" * 30000]
    rows = [(k, t, "en") for k, t in enumerate(texts * 12)] + [(None, "some words", "en"), (3, texts[3], "en"), (7, "<" * 50, "en")]
    made = infill.arranged(frame(spark, rows))
    got = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {g["form"] for g in got} == {"plain", "psm", "spm"}
    for g, (i, t, _) in zip(sorted(got, key=lambda g: (g["doc_id"] is None, g["doc_id"])), sorted(rows, key=lambda x: (x[0] is None, x[0])), strict=True):
        t = t or ""
        h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        n = len(t)
        lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
        if i in (3, 7):
            continue
        form = "plain" if not t or re.search("<[PSM]>", t) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        p, m, s = t[:lo], t[lo:hi], t[hi:]
        want = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (g["n"], g["form"], g["output"]) == (n, form, want)
        assert (g["prefix_chars"], g["middle_chars"]) == ((None, None) if form == "plain" else (lo, hi - lo))
    texts_of = {}
    for i, t, _ in rows:
        texts_of.setdefault(i, set()).add(t or "")
    assert all(g["back"] in texts_of[g["doc_id"]] for g in got)
    assert infill.arranged(frame(spark, [])).count() == 0


def test_infilling_stays_in_the_jvm(spark):
    from contextlib import redirect_stdout
    from io import StringIO

    with redirect_stdout(StringIO()) as out:
        infill.arranged(frame(spark, [(1, "a b", "en")])).explain()
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue() and "regexp_extract_all" in out.getvalue()
