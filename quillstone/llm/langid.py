"""Language identification by a linear-chain conditional random field over words.

A word's features are its character n-grams with its ends marked (which holds prefixes and suffixes) and the
language of which a lexicon knows it; transitions are learned. Forward-backward gives each word's marginal
probabilities, in code-switched text too; a document's language is the one with the largest mean.

The model is fit on a bounded sample of the labelled documents whose crc32(doc_id) mod 4 isn't 2: at most
PER_LANGUAGE of each language and TRAIN_WORDS words of each, in runs spread over its whole text. As labels are
by document, pieces of several documents are spliced for the transitions to be learned. Prediction reads every
whole text and nothing else. Texts are worked on in groups of AT_ONCE characters and longer ones in blocks of that
size, whose ends carry the chain on: memory is bounded whatever the length, and no text is cut short.

Defined cases: null texts and texts without a letter are `und` with score 0, and so is all where nothing is
labelled; of two languages with equal means the first by name counts; repeated rows each get a row; very long
texts are read whole; an empty table gives an empty result; further columns are not read, or pass through accepted().
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, give_back, map_rows, pieces, table

#: Bounds of the training sample, and of the model.
PER_LANGUAGE, TRAIN_WORDS, RUN, LEXICON = 400, 200, 40, 20_000
#: Characters that a worker has features and marginals of at a time.
AT_ONCE = 500_000
DIMS = 1 << 17
#: A word's log potential is at most this far below that of its best label: no single word decides a text.
FLOOR = -16.0
LETTERS = re.compile(r"[^\W\d_]+")
FOLDS, HELD = 4, 2


def letter_words(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    if not text:
        return []
    found = LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


def spread(ws: list[str], most: int = TRAIN_WORDS, run: int = RUN) -> list[str]:
    """At most `most` words in runs of `run`, evenly spread from the first word to the last."""
    if len(ws) <= most:
        return ws
    n = max(1, most // run)
    starts = [k * (len(ws) - run) // max(1, n - 1) for k in range(n)]
    return [w for a in starts for w in ws[a : a + run]]


def ngrams(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words one after another, and where each word's begin."""
    text = "".join(f" {w} " for w in ws)
    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = np.cumsum(np.fromiter((len(w) + 2 for w in ws), np.int64, len(ws)))
    starts = np.concatenate([[0], ends[:-1]])
    word = np.repeat(np.arange(len(ws)), ends - starts)
    left = np.repeat(ends, ends - starts) - np.arange(len(c))  # characters up to the word's end, this one included
    found, own, h = [], [], np.zeros(len(c), np.uint64)
    for n in range(1, 5):
        h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :] * np.uint64(0x9E3779B97F4A7C15)
        ok = left[: len(h)] >= n
        mixed = h[ok] ^ (h[ok] >> np.uint64(29))
        found.append(((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64) % DIMS)
        own.append(word[: len(h)][ok])
    f, w = np.concatenate(found), np.concatenate(own)
    order = np.argsort(w, kind="stable")
    return f[order], np.searchsorted(w[order], np.arange(len(ws)))


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # features x labels
    lexicon: dict[str, int]
    by_lexicon: np.ndarray  # (labels + 1) x labels; the last row is for words outside
    transitions: np.ndarray  # from x to, log potentials
    initial: np.ndarray

    def emissions(self, ws: list[str], at_once: int = AT_ONCE) -> np.ndarray:
        out, none = np.zeros((len(ws), len(self.labels)), np.float32), len(self.labels)
        done, size = 0, 0
        for i, w in enumerate(ws):
            size += len(w)
            if size > at_once // 10 or i + 1 == len(ws):
                f, at = ngrams([x[:at_once] for x in ws[done : i + 1]])
                out[done : i + 1] = np.add.reduceat(self.weights[f], at, axis=0)
                for a in range(at_once, len(w), at_once):  # a run of letters of that length goes on in parts
                    out[i] += self.weights[ngrams([w[a : a + at_once]])[0]].sum(0)
                done, size = i + 1, 0
        return out + self.by_lexicon[np.fromiter((self.lexicon.get(w, none) for w in ws), np.int64, len(ws))]

    def marginals(self, rows: np.ndarray, lengths: np.ndarray, pairwise: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward over many sequences in step. rows: emissions of all words, sequence by sequence (each of 1 word or more).

        Gives the marginals in the same order, and the expected counts of transitions (if asked) and of first labels.
        """
        n = len(lengths)
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        most = int(sizes[0])
        active = n - np.searchsorted(sizes[::-1], np.arange(most), "right")  # sequences longer than t
        offset = np.concatenate([[0], np.cumsum(active)])
        begin = (np.cumsum(lengths) - lengths)[order]
        rank = np.repeat(np.arange(n), sizes)
        t = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = offset[t] + rank  # of the t-th word of the sequence of that rank
        source = np.repeat(begin, sizes) + t
        e = np.empty((len(rows), rows.shape[1]), np.float32)
        e[place] = np.exp(np.maximum(rows - rows.max(1, keepdims=True), FLOOR))[source]
        trans = np.exp(self.transitions).astype(np.float32)
        ones = np.ones((e.shape[1], 1), np.float32)
        alpha = np.empty_like(e)
        scale = np.empty((len(e), 1), np.float32)
        cur = e[: active[0]] * np.exp(self.initial).astype(np.float32)
        steps = list(zip(active.tolist(), offset.tolist(), strict=False))
        for k, (a, o) in enumerate(steps):
            if k:
                cur = (cur[:a] @ trans) * e[o : o + a]
            c = cur @ ones
            cur /= c
            alpha[o : o + a] = cur
            scale[o : o + a] = c
        beta = np.ones_like(e)
        e /= scale
        back = np.ascontiguousarray(trans.T)
        pairs = np.zeros_like(trans)
        for k in range(most - 1, 0, -1):
            a, o = steps[k]
            nxt = e[o : o + a] * beta[o : o + a]
            p = steps[k - 1][1]
            beta[p : p + a] = nxt @ back
            if pairwise:
                pairs += alpha[p : p + a].T @ nxt * trans
        gamma = alpha * beta
        gamma /= gamma @ ones
        out = np.empty_like(gamma)
        out[source] = gamma[place]
        return out, pairs, gamma[: active[0]].sum(0)

    def predict(self, texts: list[str | None], at_once: int = AT_ONCE) -> list[tuple[str, float]]:
        """Language and score of each text. Texts of like length go together; those over `at_once` characters alone, in blocks."""
        out = [("und", 0.0)] * len(texts)
        if not self.labels:
            return out
        order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i]))
        group: list[int] = []
        size = 0
        for i in order:
            n = len(texts[i])
            if n > at_once:
                means = [self._long_mean(texts[i], at_once)]
                self._set(out, [i], means)
                continue
            if size + n > at_once:
                self._set(out, group, self._means([texts[j] for j in group]))
                group, size = [], 0
            group.append(i)
            size += n
        self._set(out, group, self._means([texts[j] for j in group]))
        return out

    def _set(self, out: list[tuple[str, float]], at: list[int], means: list[np.ndarray | None]) -> None:
        for i, m in zip(at, means, strict=True):
            if m is not None:
                k = int(m.argmax())
                out[i] = (self.labels[k], float(min(1.0, m[k])))

    def _means(self, texts: list[str]) -> list[np.ndarray | None]:
        """Mean marginals of each text's words; None where it has no letter."""
        cut = [letter_words(t) for t in texts]
        lengths = np.array([len(w) for w in cut], np.int64)
        out: list[np.ndarray | None] = [None] * len(texts)
        if not lengths.sum():
            return out
        number: defaultdict[str, int] = defaultdict(count().__next__)
        ids = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), np.int64, int(lengths.sum()))
        some = np.flatnonzero(lengths)
        gamma, _, _ = self.marginals(self.emissions(list(number))[ids], lengths[some])
        starts = np.cumsum(lengths[some]) - lengths[some]
        for i, m in zip(some.tolist(), np.add.reduceat(gamma.astype(np.float64), starts, axis=0) / lengths[some][:, None], strict=True):
            out[i] = m
        return out

    def _long_mean(self, text: str, at_once: int) -> np.ndarray | None:
        """The same of one text, block by block: forward to know how each block begins, then backward with each block's forward part anew."""
        low, cuts = text.lower(), [0]
        while cuts[-1] < len(low):
            at = min(len(low), cuts[-1] + at_once)
            while at < len(low) and low[at].isalpha():  # no run of letters is cut
                at += 1
            cuts.append(at)
        trans, first = np.exp(self.transitions), np.exp(self.initial)

        def potentials(k: int) -> np.ndarray:
            rows = self.emissions(letter_words(low[cuts[k] : cuts[k + 1]]), at_once)
            return np.exp(np.maximum(rows - rows.max(1, keepdims=True), FLOOR)).astype(np.float64) if len(rows) else rows

        def forward(e: np.ndarray, before: np.ndarray | None) -> np.ndarray:
            out = np.empty_like(e)
            for t, x in enumerate(e):
                before = x * (first if before is None else before @ trans)
                before /= before.sum()
                out[t] = before
            return out

        ends: list[np.ndarray | None] = [None]
        for k in range(len(cuts) - 1):
            alpha = forward(potentials(k), ends[-1])
            ends.append(alpha[-1] if len(alpha) else ends[-1])
        total, n, beta = np.zeros(len(self.labels)), 0, np.ones(len(self.labels))
        for k in range(len(cuts) - 2, -1, -1):
            e = potentials(k)
            alpha = forward(e, ends[k])
            for t in range(len(e) - 1, -1, -1):
                g = alpha[t] * beta
                total += g / g.sum()
                beta = trans @ (e[t] * beta)
                beta /= beta.sum()
            n += len(e)
        return total / n if n else None


def spliced(docs: list[tuple[int, list[str]]], seed: int, words: int = 40) -> list[list[tuple[str, int]]]:
    """Sequences from runs of 4 to 20 words; at the end of a run the text goes on, or another document follows."""
    rng = np.random.default_rng(seed)
    total = sum(len(w) for _, w in docs)
    out = []
    for _ in range(max(1, total // words)):
        seq: list[tuple[str, int]] = []
        label, ws = docs[rng.integers(len(docs))]
        at = int(rng.integers(max(1, len(ws) - 20)))
        while len(seq) < words:
            n = int(rng.integers(4, 21))
            seq += [(w, label) for w in ws[at : at + n]]
            at += n
            if at >= len(ws) or rng.random() < 0.25:
                label, ws = docs[rng.integers(len(docs))]
                at = int(rng.integers(max(1, len(ws) - 20)))
        out.append(seq[:words])
    return out


def fit(labelled: list[tuple[str, list[str]]], seed: int = 5, epochs: int = 4, rate: float = 0.15) -> Model:
    """labelled: language and words of documents. Adaptive gradient steps on the conditional likelihood."""
    labels = sorted({x for x, _ in labelled})
    k = len(labels)
    docs = [(labels.index(x), ws) for x, ws in labelled if ws]
    seen: dict[str, Counter] = {}
    for y, ws in docs:
        for w in set(ws):
            seen.setdefault(w, Counter())[y] += 1
    known = [(sum(c.values()), w, c.most_common(1)[0]) for w, c in seen.items()]
    strong = sorted(((-n, w, y) for n, w, (y, m) in known if n >= 3 and m > 0.8 * n))[:LEXICON]
    model = Model(labels, np.zeros((DIMS, k), np.float32), {w: y for _, w, y in strong}, np.zeros((k + 1, k), np.float32), np.zeros((k, k)), np.zeros(k))
    if k < 2 or not docs:
        return model
    grads = [np.full_like(x, 1e-6) for x in (model.weights, model.by_lexicon, model.transitions, model.initial)]

    def step(i: int, x: np.ndarray, g: np.ndarray, at=slice(None)) -> None:
        grads[i][at] += g * g
        x[at] += rate * g / np.sqrt(grads[i][at] + 1e-8)

    sequences = spliced(docs, seed)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(sequences))
        for b in range(0, len(order), 256):
            some = [sequences[i] for i in order[b : b + 256]]
            number: dict[str, int] = {}
            ids = np.array([number.setdefault(w, len(number)) for s in some for w, _ in s])
            gold = np.array([y for s in some for _, y in s])
            vocabulary = list(number)
            lengths = np.array([len(s) for s in some], np.int64)
            gamma, pairs, first = model.marginals(model.emissions(vocabulary)[ids], lengths, True)
            diff = -gamma.astype(np.float64)
            diff[np.arange(len(gold)), gold] += 1
            by_word = np.zeros((len(vocabulary), k))
            np.add.at(by_word, ids, diff)
            f, at = ngrams(vocabulary)
            per = np.repeat(np.arange(len(vocabulary)), np.diff(np.append(at, len(f))))
            used, inv = np.unique(f, return_inverse=True)
            g = np.stack([np.bincount(inv, by_word[per, y], len(used)) for y in range(k)], 1)
            step(0, model.weights, g / len(some), used)
            lex = np.array([model.lexicon.get(w, k) for w in vocabulary])
            step(1, model.by_lexicon, np.stack([np.bincount(lex, by_word[:, y], k + 1) for y in range(k)], 1) / len(some))
            ends = np.cumsum(lengths)
            inside = np.ones(len(gold), bool)
            inside[ends - 1] = False
            j = np.flatnonzero(inside)
            real = np.zeros((k, k))
            np.add.at(real, (gold[j], gold[j + 1]), 1)
            step(2, model.transitions, (real - pairs) / len(some))
            step(3, model.initial, (np.bincount(gold[ends - lengths], minlength=k) - first) / len(some))
    return model


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == HELD


#: Hashes of ids are below this: far more than there can be documents.
HASHES = 1 << 62


def threshold(n: int, per_language: int) -> int:
    """Of n hashes, somewhat more than per_language lie below it, however many there are."""
    return min(HASHES, 3 * per_language * HASHES // (2 * n))


def learned(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """The model fit on a bounded sample: in each language the documents with the smallest hashes of their doc_id."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not counts:
        return fit([])
    near = F.lit(False)
    for lang, n in sorted(counts.items()):
        near |= (F.col("lang") == lang) & (F.col("h") < threshold(n, per_language))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("doc_id", pa.int64()), ("w", pa.string())])
        for b in it:
            yield batch(s, [b.column("lang"), b.column("h").cast(pa.int64()), b.column("doc_id").cast(pa.int64()), [" ".join(spread(letter_words(t))) for t in b.column("text").to_pylist()]])

    found: dict[str, list] = {}
    for r in map_rows(rows.filter(near), ["lang", "h", "doc_id", "text"], run, "lang string, h long, doc_id long, w string").collect():
        found.setdefault(r["lang"], []).append((r["h"], -1 if r["doc_id"] is None else r["doc_id"], r["w"]))
    return fit([(lang, w.split()) for lang in sorted(found) for _, _, w in sorted(found[lang])[:per_language]])


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
ARROW = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])


def _predicted(model: Model, b: pa.RecordBatch) -> tuple[list, list]:
    got = model.predict(b.column("text").to_pylist())
    return [x for x, _ in got], [s for _, s in got]


def identified(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: DIMS weights a language and LEXICON words

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *ARROW])
        for whole in it:
            for b in pieces(whole, 4_000_000):
                yield batch(s, [b.column("doc_id").cast(pa.int64()), b.column("held_out"), *_predicted(shared.value, b)])

    return map_rows(docs.withColumn("held_out", held_out()), ["doc_id", "held_out", "text"], run, SCHEMA)


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents whose language is known with a score of at least `least`; rows and columns as they came."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in pieces(whole, 4_000_000):
                lang, score = _predicted(shared.value, b)
                yield b.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score, strict=True)]))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identified(docs, learned(docs))
