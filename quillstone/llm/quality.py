"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection rate are estimated on a sample; the rules then run in the order of
rejection per cost and stop at the first that rejects. A document is kept only if no rule rejects it, so
the verdict doesn't depend on the order, and reruns agree even though measured times differ.

Defined cases: a null or empty text has no words and fails the base rule; repeated rows each get a row; rules of equal
rank go by name; very long texts are read whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, batch, map_rows, pieces, table

SYMBOLS = "#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_())])
#: Documents of the sample that orders the rules. It changes no verdict.
SAMPLE = 512


def repeat_words(ws: list[bytes], n: int = 3) -> int:
    """Words that stand in an n-word window found twice or more, the first occurrence included."""
    if len(ws) < n + 1:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in ws], np.int64)
    key = ids
    for j in range(1, n):
        key = key[: len(ws) - j] * len(seen) + ids[j:]
        if len(seen) ** (j + 1) > 2**40:  # renumber before the next product can overflow
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(key), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(ws), bool)
    for j in range(n):
        covered[j : j + len(hit)] |= hit
    return int(covered.sum())


def worded_lines(text: str) -> list[str]:
    return [x for x in text.split("\n") if x.strip(SPACES)]


def dup_lines(text: str) -> int:
    lines = worded_lines(text)
    return len(lines) - len(set(lines))


class Facts:
    """Of one text; what a rule asks for is counted when it asks, once."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.words = self.text.encode("utf-8", "replace").split()
        self.n = len(self.words)
        self.chars = len(self.text) - sum(map(self.text.count, SPACES))
        self.symbols = sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> int:
        return len(worded_lines(self.text))

    @cached_property
    def dup_lines(self) -> int:
        return dup_lines(self.text)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Facts], bool]


def _share(f: Facts, found: Callable[[str], bool]) -> float:
    letters = [c for c in f.text if c.isalpha()]
    return sum(map(found, letters)) / len(letters) if letters else 0.0


#: Thresholds in tenths or parts of the counts; all are whole-text properties.
RULES = (
    Rule("mean_word_length", lambda f: not 2 * f.n <= f.chars <= 14 * f.n),
    Rule("symbol_ratio", lambda f: 10 * f.symbols > f.n),
    Rule("exclamations", lambda f: 5 * f.text.count("!") > f.n),
    Rule("duplicate_lines", lambda f: 10 * f.dup_lines > 3 * max(1, f.lines)),
    Rule("wordless", lambda f: 10 * sum(1 for w in f.words if w.isdigit()) > 4 * f.n),
    Rule("capitals", lambda f: _share(f, str.isupper) > 0.5),
)


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejection: float


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> list[Estimate]:
    """Mean seconds and rejection rate of every rule on at most `sample` documents, drawn from all of the table."""
    share = min(1.0, 4 * sample / max(1, docs.count()))
    drawn = docs.select("text").sample(share, 17).orderBy(F.rand(17)) if share < 1 else docs.select("text")  # in any order, so that the limit favours no part of the table

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, no, n = [0.0] * len(rules), [0] * len(rules), 0
        for b in it:
            for t in b.column("text").to_pylist():
                f, n = Facts(t or ""), n + 1
                for i, r in enumerate(rules):
                    began = time.perf_counter()
                    no[i] += r.rejects(f)
                    cost[i] += time.perf_counter() - began
        s = pa.schema([("i", pa.int32()), ("cost", pa.float64()), ("no", pa.int64()), ("n", pa.int64())])
        yield batch(s, [list(range(len(rules))), cost, no, [n] * len(rules)])

    rows = map_rows(drawn.limit(sample), ["text"], run, "i int, cost double, no long, n long").groupBy("i").sum("cost", "no", "n").collect()
    found = {r[0]: r[1:] for r in rows}
    out = []
    for i, r in enumerate(rules):
        cost, no, n = found.get(i, (0.0, 0, 0))
        out.append(Estimate(r.name, cost / max(n, 1), no / max(n, 1)))
    return out


def ordered(rules: tuple[Rule, ...], estimates: list[Estimate]) -> tuple[Rule, ...]:
    rank = {e.name: -e.rejection / max(e.seconds, 1e-9) for e in estimates}
    return tuple(sorted(rules, key=lambda r: (rank[r.name], r.name)))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """Base counts and verdict of each document; `rules` run as a cascade ordered on a sample."""
    cascade = ordered(rules, estimate(docs, rules, sample))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in pieces(whole):
                out: list[list] = [[] for _ in ARROW]
                for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    f = Facts(t or "")
                    rep = repeat_words(f.words)
                    bad = f.n < 50 or 100 * rep > 50 * f.n
                    kept = not bad and not any(r.rejects(f) for r in cascade)
                    for c, v in zip(out, (d, f.n, f.chars, f.symbols, f.dup_lines, rep, bad, kept), strict=True):
                        c.append(v)
                yield batch(ARROW, out)

    return map_rows(docs, ["doc_id", "text"], run, SCHEMA)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dl AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT i + k) AS n_rep FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
b AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words,
             length(regexp_replace(t, '[^!]', '', 'g')) AS n_bang, greatest(coalesce(n_lines, 0), 1) AS n_lines,
             len(list_filter(ws, lambda x: regexp_full_match(x, '[0-9]+'))) AS n_digit,
             length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS n_alpha, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper
      FROM w LEFT JOIN dl USING (doc_id) LEFT JOIN rw USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars BETWEEN 2 * n_words AND 14 * n_words
         AND NOT 10 * n_symbols > n_words AND NOT 5 * n_bang > n_words AND NOT 10 * n_dup_lines > 3 * n_lines
         AND NOT 10 * n_digit > 4 * n_words AND NOT 2 * n_upper > n_alpha AS kept
FROM b
"""
