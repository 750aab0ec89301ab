"""Collocations: phrases of two and more words, scored by their least likely cut.

Candidates come from a sketch. Each phrase occurrence falls, by a hash of its language and words, into one of so many slots
that a slot has few occurrences of rare phrases; the tasks' counts of slots are summed slice by slice. A slot's sum is an upper
bound for each of its phrases, so a phrase that is frequent enough lies in a slot whose sum is, too. Those slots are sent
to the tasks in rounds of at most HOT, and the phrases in them are the candidates.

Candidates and the words in them are then counted. Passes of about PASS characters of patterns become an automaton of words for each
language; it reads the documents, piece by piece, and counts overlapping matches. The sums are exact, and thresholds, cuts and ranks are columns.

Defined cases: a null text is empty, a null language is `und`; texts without words add nothing; repeated rows count
repeatedly; ties are broken by count and then by the phrase's bytes; very long texts and pieces are read in runs; an
empty table gives no rows; further columns aren't read.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch, encoded, hashes, map_rows, partitions, pieces, rolled, settled, table

LEAST, LONGEST, PERCENT, TOP = 100, 5, 100, 2000
UNKNOWN = "und"
#: Characters of text for each slot, and slots of a slice at most.
CHARS, SLICE = 4, 1 << 20
#: Frequent slots that a round sends to all tasks (32 MB) and characters of patterns that a pass does (with their automata some 250 MB in a worker).
HOT, PASS = 4_000_000, 32_000_000
#: Words that are hashed at once, and bytes of a piece after which it is cut into runs.
RUN, CUT = 1 << 20, 1 << 22
#: Blanks and the ends of pieces become one character each, A to Z lower case.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")


def folded(text: str | None) -> bytes:
    return encoded(text).translate(FOLD)


def runs(text: str | None) -> Iterator[tuple[list[bytes], int]]:
    """Words of each piece and how many of them may begin a phrase; of a cut piece, the words after those are the next run's first."""
    for part in folded(text).split(b"\n"):
        while len(part) > CUT and (at := part.find(b" ", CUT)) > 0:
            ws = part[:at].split()
            rest = part[at:]
            yield ws + rest.split(None, LONGEST)[: LONGEST - 1], len(ws)
            part = rest
        if ws := part.split():
            yield ws, len(ws)


class Run:
    """Words of many pieces, and the slots of the phrases in them."""

    def __init__(self, slots: int) -> None:
        self.bits = np.uint64(64 - (slots.bit_length() - 1))
        self.words: list[bytes] = []
        self.size: list[int] = []
        self.starts: list[int] = []
        self.lang: list[int] = []

    def add(self, ws: list[bytes], starts: int, lang: int) -> None:
        self.words += ws
        self.size.append(len(ws))
        self.starts.append(starts)
        self.lang.append(lang)

    def phrases(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length of phrases, their places and hashes; slots() gives the slots."""
        size = np.array(self.size)
        end = np.repeat(np.cumsum(size), size)
        begin = np.repeat(np.cumsum(size) - size, size)
        at = np.arange(len(self.words))
        may = at - begin < np.repeat(self.starts, size)
        own = np.repeat(np.fromiter((xxhash.xxh3_64_intdigest(b"%d" % x) for x in self.lang), np.uint64, len(self.lang)), size)
        h = hashes(self.words)
        for n in range(2, LONGEST + 1):
            r = rolled(h, n)
            ok = np.flatnonzero(may[: len(r)] & (at[: len(r)] + n <= end[: len(r)]))
            with np.errstate(over="ignore"):
                x = (r[ok] ^ own[ok]) * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
            yield n, ok, x ^ (x >> np.uint64(29))

    def slots(self, h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h * np.uint64(0xBF58476D1CE4E5B9)) >> self.bits


def _runs_of(it: Iterator[pa.RecordBatch], slots: int) -> Iterator[tuple[Run, list[str]]]:
    """Runs of about RUN words with the languages that their numbers stand for. Numbers are hashes of the names, so that tasks agree."""
    run, names = Run(slots), {}
    for whole in it:
        for b in pieces(whole):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                lang = UNKNOWN if lang is None else lang
                code = xxhash.xxh3_64_intdigest(encoded(lang))
                names[code] = lang
                for ws, starts in runs(text):
                    run.add(ws, starts, code)
                    if len(run.words) >= RUN:
                        yield run, names
                        run = Run(slots)
    if run.words:
        yield run, names


def _packed(positions: np.ndarray, counts: np.ndarray) -> bytes:
    """Positions as gaps of 4 bytes and counts of 8, byte by byte, so that zeros stand together."""
    gaps = np.diff(positions, prepend=0).astype("<u4")
    return zstandard.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes() + counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(zstandard.decompress(data), np.uint8)
    n = len(rows) // 12
    gaps, counts = (np.ascontiguousarray(x.reshape(size, -1).T).view(f"<u{size}").reshape(-1) for x, size in ((rows[: 4 * n], 4), (rows[4 * n :], 8)))
    return np.cumsum(gaps, dtype=np.int64), counts.astype(np.int64)


def sketch(docs: DataFrame, slots: int) -> DataFrame:
    """slice and counts: a part of the counts of the slots of a slice."""
    names = pa.schema([("slice", pa.int64()), ("counts", pa.binary())])
    width = min(slots, SLICE)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, _ in _runs_of(it, slots):
            s = np.concatenate([r.slots(h) for _, _, h in r.phrases()])
            if not len(s):
                continue
            s.sort()
            new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            s, c = s[new].astype(np.int64), np.diff(np.append(new, len(s)))
            part = s // width
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            for lo in range(0, len(at) - 1, 256):  # rows of one batch
                ends = at[lo : lo + 257]
                yield batch(names, [pa.array(part[ends[:-1]]), [_packed(s[i:j] % width, c[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]])

    return map_rows(docs, ["lang", "text"], run, "slice long, counts binary")


def frequent(sketched: DataFrame, slots: int, least: int) -> DataFrame:
    """The slots whose counts reach the least. Rows of a slice come after each other and are added up as they come."""
    names = pa.schema([("slot", pa.int64())])
    width = min(slots, SLICE)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(width, np.int64)
        for b in it:
            for k, data in zip(b.column("slice").to_pylist(), b.column("counts"), strict=True):
                if k != now:
                    if now is not None:
                        yield batch(names, [pa.array(np.flatnonzero(sums >= least) + now * width)])
                    now = k
                    sums[:] = 0
                at, counts = _unpacked(data.as_buffer())
                sums[at] += counts
        if now is not None:
            yield batch(names, [pa.array(np.flatnonzero(sums >= least) + now * width)])

    return sketched.repartition(2 * partitions(sketched.sparkSession), "slice").sortWithinPartitions("slice").mapInArrow(run, "slot long")


def in_slots(docs: DataFrame, slots: int, hot: Broadcast) -> DataFrame:
    """lang and phrase of the phrases that occur in the given sorted slots.

    A task tells each phrase once; what it tells of a language and slice of hashes is one compressed row, and the rows are united where the
    slice goes. They hold no more than the occurrences of frequent phrases.
    """
    spark = docs.sparkSession
    told_schema = pa.schema([("lang", pa.string()), ("slice", pa.int32()), ("phrases", pa.binary())])
    names = pa.schema([("lang", pa.string()), ("phrase", pa.string())])
    n_slices = 2 * partitions(spark)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = hot.value
        size = 1 << max(23, (4 * len(wanted)).bit_length())
        mask = np.uint64(size - 1)
        maybe = np.zeros(size, bool)
        maybe[(wanted & mask).astype(np.int64)] = True
        told: set[int] = set()
        rows: dict[tuple[str, int], list[bytes]] = {}
        kept = 0

        def flushed() -> pa.RecordBatch:
            keys = list(rows)
            return batch(told_schema, [[k[0] for k in keys], [k[1] for k in keys], [zstandard.compress(b"\n".join(sorted(rows[k])), 1) for k in keys]])

        for r, langs in _runs_of(it, slots):
            of = np.repeat(np.arange(len(r.size)), r.size)
            for n, at, h in r.phrases():
                s = r.slots(h)
                few = np.flatnonzero(maybe[(s & mask).astype(np.int64)])
                place = np.minimum(np.searchsorted(wanted, s[few]), len(wanted) - 1)
                few = few[wanted[place] == s[few]]
                key, first = np.unique(h[few], return_index=True)
                at = at[few[first]].tolist()
                for k, x in enumerate(key.tolist()):
                    if x not in told:
                        told.add(x)
                        a = at[k]
                        phrase = b" ".join(r.words[a : a + n])
                        rows.setdefault((langs[r.lang[of[a]]], x % n_slices), []).append(phrase)
                        kept += len(phrase)
            if kept > 1 << 25:
                yield flushed()
                rows, kept = {}, 0
                told.clear()
        if rows:
            yield flushed()

    def united(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, set()
        out = lambda: batch(names, [[now[0]] * len(held), [p.decode("utf-8", "replace") for p in held]])
        for b in it:
            for lang, k, data in zip(*(b.column(c).to_pylist() for c in ("lang", "slice", "phrases")), strict=True):
                if (lang, k) != now:
                    if held:
                        yield out()
                    now, held = (lang, k), set()
                held.update(zstandard.decompress(data).split(b"\n"))
        if held:
            yield out()

    told = map_rows(docs, ["lang", "text"], run, "lang string, slice int, phrases binary")
    return told.repartition(n_slices, "lang", "slice").sortWithinPartitions("lang", "slice").mapInArrow(united, "lang string, phrase string")


#: Patterns whose counts make one row.
COUNTS = 1 << 14
_automata: dict[tuple[str, str], Automaton] = {}


class Automaton:
    """A language's patterns as states and moves from state to state by a word. The empty pattern, its first, matches nothing.

    A state is the words read since some place; its moves are rows of a sorted array, 8 bytes each, and no state has more words than the
    longest pattern. All places of a text are read at once, so a move further is one search for all that are still in a state.
    """

    def __init__(self, patterns: list[str]) -> None:
        self.n = len(patterns)
        split = [p.encode().split(b" ") for p in patterns[1:]]
        flat = [w for ws in split for w in ws]
        self.words = {w: k for k, w in enumerate(dict.fromkeys(flat))}
        word = np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat))
        size = np.fromiter(map(len, split), np.int64, len(split))
        begin = np.cumsum(size) - size
        state, own = word[begin], np.arange(1, self.n)
        self.moves: list[np.ndarray] = []
        self.pattern = [self._ends(len(self.words), state, own, size == 1)]
        for m in range(1, size.max(initial=0)):
            on = size > m
            state, own, begin, size = state[on], own[on], begin[on], size[on]
            moves, state = np.unique(state * len(self.words) + word[begin + m], return_inverse=True)
            self.moves.append(moves)
            self.pattern.append(self._ends(len(moves), state, own, size == m + 1))

    @staticmethod
    def _ends(states: int, state: np.ndarray, own: np.ndarray, here: np.ndarray) -> np.ndarray:
        """The pattern that ends in each state, or 0."""
        out = np.zeros(states, np.int32)
        out[state[here]] = own[here]
        return out

    def read(self, text: bytes) -> np.ndarray:
        """Numbers of a folded text's words and the breaks between its pieces, -1 for those of no pattern; long texts in parts."""
        out = []
        while text:
            at = text.find(b" ", CUT) if len(text) > CUT else -1
            part, text = (text, b"") if at < 0 else (text[:at], text[at:])
            ws = part.replace(b"\n", b" . ").split()  # no word holds a full stop
            out.append(np.fromiter(map(self.words.get, ws, repeat(-1)), np.int64, len(ws)))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def matches(self, word: np.ndarray) -> np.ndarray:
        """How often each pattern begins at some place of the words."""
        at = np.flatnonzero(word >= 0)
        state = word[at]
        sums = np.bincount(self.pattern[0][state], minlength=self.n)
        for m, (moves, pattern) in enumerate(zip(self.moves, self.pattern[1:], strict=True), 1):
            on = at + m < len(word)
            at, state = at[on], state[on]
            on = word[at + m] >= 0
            at, state = at[on], state[on]
            move = state * len(self.words) + word[at + m]
            state = np.minimum(np.searchsorted(moves, move), len(moves) - 1)
            on = moves[state] == move
            at, state = at[on], state[on]
            sums += np.bincount(pattern[state], minlength=self.n)
        sums[0] = 0
        return sums


def _automaton(made: Broadcast, lang: str) -> Automaton:
    """A worker keeps the automata of one pass."""
    key = (made.value["pass"], lang)
    if key not in _automata:
        if any(k[0] != key[0] for k in _automata):
            _automata.clear()
        _automata[key] = Automaton(made.value["patterns"][lang])
    return _automata[key]


def counted(docs: DataFrame, made: Broadcast) -> DataFrame:
    """lang, phrase and f: the matches of each pattern, and the number of all words as that of the empty one."""
    names = pa.schema([("slice", pa.int64()), ("counts", pa.binary())])
    out = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, first = made.value["patterns"], made.value["first"]
        sums = np.zeros(made.value["size"], np.int64)
        for whole in it:
            for b in pieces(whole, 1 << 22):
                texts: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                    lang = UNKNOWN if lang is None else lang
                    if lang in patterns and text:
                        line = folded(text)
                        read = _automaton(made, lang).read(line)
                        sums[first[lang]] += len(read) - line.count(b"\n")
                        texts.setdefault(lang, []).extend((read, np.array([-1])))
                for lang, ts in texts.items():
                    a, n = first[lang], len(patterns[lang])
                    if n > 1:
                        sums[a : a + n] += _automaton(made, lang).matches(np.concatenate(ts))
        for k in range(0, len(sums), COUNTS):
            at = np.flatnonzero(sums[k : k + COUNTS])
            if len(at):
                yield batch(names, [[k // COUNTS], [_packed(at, sums[k + at])]])

    def added(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(COUNTS, np.int64)
        langs, first = list(made.value["first"]), list(made.value["first"].values())

        def total() -> pa.RecordBatch:
            at = np.flatnonzero(sums)
            of = [(langs[k], x - first[k]) for x in (at + now * COUNTS).tolist() for k in (bisect_right(first, x) - 1,)]
            return batch(out, [[lang for lang, _ in of], [made.value["patterns"][lang][x] for lang, x in of], pa.array(sums[at])])

        for b in it:
            for k, data in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist(), strict=True):
                if k != now:
                    if now is not None:
                        yield total()
                    now = k
                    sums[:] = 0
                at, c = _unpacked(data)
                sums[at] += c
        if now is not None:
            yield total()

    parts = map_rows(docs, ["lang", "text"], run, "slice long, counts binary")
    return parts.repartition(partitions(docs.sparkSession), "slice").sortWithinPartitions("slice").mapInArrow(added, "lang string, phrase string, f long")


def candidates(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang and phrase of all phrases that the sketch doesn't rule out, as a written table."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    slots = 1 << max(16, (chars // CHARS).bit_length())
    hot = settled(frequent(sketch(docs, slots), slots, least), "col-slots")
    many = hot.count()
    rounds = max(1, -(-many // HOT))
    found = []
    for k in range(rounds if many else 0):  # slots are hashes: equal ranges hold about as many
        part = hot.filter((F.col("slot") >= k * slots // rounds) & (F.col("slot") < (k + 1) * slots // rounds))
        wanted = np.sort(part.toArrow().column("slot").to_numpy()).astype(np.uint64)
        if not len(wanted):
            continue
        sent = spark.sparkContext.broadcast(wanted)
        found.append(settled(in_slots(docs, slots, sent), "col-candidates"))
        sent.destroy()
    out = spark.createDataFrame([], "lang string, phrase string")
    for df in found:
        out = out.union(df)
    return out


def counts(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """lang, phrase and f of the phrases and the words in them, and of the empty phrase: the number of a language's words, once a pass."""
    spark = docs.sparkSession
    of = phrases.select("lang", F.explode(F.split("phrase", " ")).alias("phrase"))
    patterns = settled(phrases.union(of).distinct(), "col-patterns")
    passes = max(1, -(-(patterns.agg(F.sum(F.length("phrase") + 2)).first()[0] or 0) // PASS))
    found = None
    for k in range(passes):  # patterns are dealt by the hash of their first words, whose states they share: passes have about as many characters
        by: dict[str, list[str]] = {}
        for lang, phrase in zip(*(c.to_pylist() for c in patterns.filter(F.pmod(F.xxhash64("lang", F.substring_index("phrase", " ", 2)), F.lit(passes)) == k).select("lang", "phrase").toArrow().columns), strict=True):
            by.setdefault(lang, [""]).append(phrase)
        first, size = {}, 0
        for lang, ps in by.items():
            first[lang], size = size, size + len(ps)
        sent = spark.sparkContext.broadcast({"pass": uuid.uuid4().hex, "patterns": by, "first": first, "size": size})
        part = settled(counted(docs, sent), "col-counts")
        sent.destroy()
        found = part if found is None else found.union(part)
    return found


def scored(counts: DataFrame, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """lang, phrase, a, l, r, n and score of the candidates that no longer one makes superfluous."""
    n = counts.filter("phrase = ''").groupBy("lang").agg(F.max("f").alias("n"))
    cands = counts.withColumn("words", F.split("phrase", " ")).filter((F.size("words") >= 2) & (F.col("f") >= least))
    joined = lambda at, size: F.array_join(F.slice("words", at, size), " ")
    cut = cands.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    f = lambda key, out: counts.select("lang", F.col("phrase").alias(key), F.col("f").alias(out))
    cut = cut.join(f("first", "l"), ["lang", "first"]).join(f("rest", "r"), ["lang", "rest"]).join(n, "lang")
    exact = "(cast(1000 as decimal(4, 0)) * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
    best = cut.withColumn("score", F.expr(exact)).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))

    longer = cands.filter(F.size("words") > 2).select("lang", "words", F.col("f").alias("longer"), F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("m"))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)))
    inside = longer.select("lang", joined(F.col("at"), F.col("m")).alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    return kept.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")


def ranked(scores: DataFrame, top: int = TOP) -> DataFrame:
    order: list[Column] = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*order))  # a limit on it lets each task keep only its own first ones
    best = scores.withColumn("rank", rank).filter(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def mined(docs: DataFrame, least: int = LEAST, percent: int = PERCENT, top: int = TOP) -> DataFrame:
    """The best phrases of each language."""
    found = settled(counts(docs, candidates(docs, least)), "col-found")
    return ranked(scored(found, least, percent), top)


def op12_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
size AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cut AS (
  SELECT lang, phrase, m, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, s.n, CAST((1000::HUGEINT * c.a * s.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest JOIN size s ON s.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + p - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT *, unnest(range(1, m - p + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS p FROM f WHERE m > 2)) GROUP BY 1, 2),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 100 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""
