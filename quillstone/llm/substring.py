"""Substring dedup: words that a window shares with an earlier document go.

Matching statistics come from suffix automata of reference shards. A shard is the passages of one document
that later documents repeat; each automaton is built where its queries are, since sending every shard to
every task grows with the square of the corpus. What has to meet is found first: hashes of all windows are
dealt out by value, each chunk of documents asking once for what it holds, and answered with the smallest
document that has the same value. Runs of answered windows are the queries of that document's automaton;
equal queries are asked once. Only what the automaton matches over LENGTH words or more is removed.

Defined cases: a null text has no words; with fewer words than LENGTH nothing is removed; repeated rows
and equal doc_ids don't count as earlier; rows with a null doc_id are neither reference nor cut; very long texts are
read whole; an empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, hashes, map_rows, partitions, pieces, rolled, settled, table, words

LENGTH = 13
#: Words of a chunk, which asks for each of its windows once; documents to a part of the values.
CHUNK_WORDS, PART_DOCS = 2_000_000, 2000
#: Queries to one shard in one task; beyond that the shard goes to several.
QUERIES = 512
LOW = np.uint64((1 << 48) - 1)


class SuffixAutomaton:
    """Of several word sequences: a match never runs from one into another."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list[bytes]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in sequence:
            if (q := nxt[last].get(w)) is not None:  # known from an earlier sequence
                last = q if length[q] == length[last] + 1 else self._split(last, w, q)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
            last = cur

    def _split(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def statistics(self, sequence: list[bytes]) -> list[int]:
        """For each word the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        out, state, n = [], 0, 0
        for w in sequence:
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                n += 1
            out.append(n)
        return out

    def spans(self, sequence: list[bytes], least: int = LENGTH) -> list[tuple[int, int]]:
        """Maximal spans of the sequence covered by matches of `least` words or more."""
        out: list[tuple[int, int]] = []
        for i, n in enumerate(self.statistics(sequence)):
            if n >= least:
                a = i + 1 - n
                if out and a <= out[-1][1]:
                    out[-1] = (min(a, out[-1][0]), i + 1)
                else:
                    out.append((a, i + 1))
        return out


ASKED = pa.schema([("part", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("doc", pa.int64()), ("key", pa.int64()), ("src", pa.int64())])
ASKED_DDL = "part long, keys binary, docs binary, doc long, key long, src long"
FOUND = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("src", pa.int64())])


def _ordered(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by key, then document, and for each row the smallest document of its key."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    begin = np.concatenate([[True], k[1:] != k[:-1]])
    return k, d, d[begin][np.cumsum(begin) - 1]


def asked(docs: DataFrame, parts: int) -> DataFrame:
    """Per chunk and part: the keys of its windows, each with the smallest of the chunk's documents; matches inside the chunk as (doc, key, src)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        held: list[np.ndarray] = []
        owners: list[tuple[int, int]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, d, least = _ordered(np.concatenate(held), np.repeat(np.array([o for o, _ in owners], np.int64), [n for _, n in owners]))
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
            first = np.concatenate([[True], h[1:] != h[:-1]])
            inner = new & (d > least)
            if inner.any():
                n = int(inner.sum())
                yield batch(ASKED, [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(d[inner]), pa.array((h[inner] & LOW).astype(np.int64)), pa.array(least[inner])])
            h, d = h[first], d[first]
            part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # rises with h
            ends = np.searchsorted(part, np.arange(parts + 1))
            rows: list[list] = [[], [], []]
            for p in np.flatnonzero(np.diff(ends)).tolist():
                a, b = ends[p], ends[p + 1]
                o = np.argsort(d[a:b], kind="stable")
                rows[0].append(p)
                rows[1].append(np.ascontiguousarray(h[a:b][o].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes())
                rows[2].append(z.compress(np.diff(d[a:b][o], prepend=0).astype("<i8").tobytes()))
            n = len(rows[0])
            yield batch(ASKED, [*rows, *(pa.nulls(n, pa.int64()) for _ in range(3))])

        for whole in it:
            for b in pieces(whole):
                for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    g = rolled(hashes(words(t)), LENGTH)
                    if len(g) and d is not None:
                        held.append(g)
                        owners.append((d, len(g)))
                        size += len(g)
                    if size >= CHUNK_WORDS:
                        yield from flush()
                        held, owners, size = [], [], 0
        if held:
            yield from flush()

    return map_rows(docs, ["doc_id", "text"], run, ASKED_DDL)


def answered(rows: DataFrame) -> DataFrame:
    """(doc, key, src): windows of doc whose value the earlier document src has too."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        part, keys, docs = None, [], []

        def work() -> Iterator[pa.RecordBatch]:
            k, d, least = _ordered(np.concatenate(keys), np.concatenate(docs))
            hit = d > least
            if hit.any():
                yield batch(FOUND, [pa.array(d[hit]), pa.array(k[hit].astype(np.int64)), pa.array(least[hit])])

        for b in it:
            inner = b.filter(b.column("part").is_null())
            if inner.num_rows:
                yield batch(FOUND, [inner.column(c) for c in FOUND.names])
            for p, k, d in zip(*(b.filter(b.column("part").is_valid()).column(c).to_pylist() for c in ("part", "keys", "docs")), strict=True):
                if p != part and keys:
                    yield from work()
                    keys, docs = [], []
                part = p
                full = np.zeros((len(k) // 6, 8), np.uint8)
                full[:, :6] = np.frombuffer(k, np.uint8).reshape(-1, 6)
                keys.append(full.view("<u8").reshape(-1).astype(np.uint64))
                docs.append(np.cumsum(np.frombuffer(z.decompress(d), "<i8")))
        if keys:
            yield from work()

    spread = F.coalesce("part", -1 - F.pmod(F.col("doc"), F.lit(1 << 20)))  # matches inside a chunk go anywhere
    return rows.repartition(2 * partitions(rows.sparkSession), spread).sortWithinPartitions("part").mapInArrow(run, "doc long, key long, src long")


PASSAGE = pa.schema([("shard", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("mark", pa.binary()), ("passage", pa.binary())])


def passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Runs of windows: (shard, doc, start, mark, passage); of the shard's own document where doc is null."""
    per = found.select("doc", "key", "src").union(found.select(F.col("src").alias("doc"), "key", F.lit(None).cast("long").alias("src")).distinct())
    per = per.groupBy("doc").agg(F.collect_list(F.struct("key", "src")).alias("w"))  # of one document's own windows

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list[list] = [[] for _ in PASSAGE]

            def add(shard: int, doc: int | None, a: int, e: int, ws: list[bytes], out=out) -> None:
                p = b" ".join(ws[a : e + LENGTH])
                for c, v in zip(out, (shard, doc, a, xxhash.xxh3_128_digest(p), p), strict=True):
                    c.append(v)

            for i, (d, t) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)):
                w = b.column("w")[i].values
                key, src = w.field("key").to_numpy(), w.field("src")
                own = src.is_null().to_numpy(zero_copy_only=False)
                src = src.fill_null(-1).to_numpy()
                ws = words(t)
                g = (rolled(hashes(ws), LENGTH) & LOW).astype(np.int64)
                for mine in (True, False):
                    k, s = key[own == mine], src[own == mine]
                    if not len(k) or not len(g):
                        continue
                    o = np.lexsort((s, k))
                    k, s = k[o], s[o]
                    at = np.minimum(np.searchsorted(k, g), len(k) - 1)
                    hit = np.flatnonzero(k[at] == g)
                    if not len(hit):
                        continue
                    of = s[at[hit]]
                    cuts = np.flatnonzero((np.diff(hit) > 1) | (of[1:] != of[:-1])) + 1
                    for r in np.split(np.arange(len(hit)), cuts):
                        add(d if mine else int(of[r[0]]), None if mine else d, int(hit[r[0]]), int(hit[r[-1]]), ws)
            yield batch(PASSAGE, out)

    joined = docs.select("doc_id", "text").join(per, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "w")
    return joined.mapInArrow(run, "shard long, doc long, start long, mark binary, passage binary")


MATCHED = pa.schema([("shard", pa.int64()), ("mark", pa.binary()), ("spans", pa.list_(pa.list_(pa.int64())))])


def matched(rows: DataFrame) -> DataFrame:
    """(shard, mark, spans): spans of each different query that the automaton of its shard matches."""
    ask = rows.filter("doc IS NOT NULL").groupBy("shard", "mark").agg(F.any_value("passage").alias("passage"))
    # A shard that many ask is built in several tasks, and its queries are dealt to them.
    busy = rows.filter("doc IS NOT NULL").groupBy("shard").agg(F.ceil(F.approx_count_distinct("mark") / QUERIES).cast("int").alias("copies")).filter("copies > 1")
    copies = F.coalesce("copies", F.lit(1))
    own = rows.filter("doc IS NULL").select("shard", "mark", "passage").join(busy, "shard", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).select("shard", "copy", F.lit(0).alias("role"), "mark", "passage")
    ask = ask.join(busy, "shard", "left").select("shard", F.pmod(F.xxhash64("mark"), copies).cast("int").alias("copy"), F.lit(1).alias("role"), "mark", "passage")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton = None, SuffixAutomaton()
        for b in it:
            out: list[list] = [[], [], []]
            for s, copy, role, mark, p in zip(*(b.column(c).to_pylist() for c in ("shard", "copy", "role", "mark", "passage")), strict=True):
                if (s, copy) != shard:
                    shard, automaton = (s, copy), SuffixAutomaton()
                if not role:
                    automaton.add(p.split())
                    continue
                spans = automaton.spans(p.split())
                if spans:
                    for c, v in zip(out, (s, mark, [list(x) for x in spans]), strict=True):
                        c.append(v)
            yield batch(MATCHED, out)

    return own.union(ask).repartition(2 * partitions(rows.sparkSession), "shard", "copy").sortWithinPartitions("shard", "copy", "role").mapInArrow(run, "shard long, mark binary, spans array<array<long>>")


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def covered(docs: DataFrame) -> DataFrame:
    """(doc, spans): word spans of each document that a window shares with an earlier one."""
    parts = max(2 * partitions(docs.sparkSession), docs.select("doc_id").count() // PART_DOCS)
    found = settled(answered(asked(docs, parts)), "sub-found")
    rows = settled(passages(docs, found), "sub-passages")
    good = matched(rows)
    back = rows.filter("doc IS NOT NULL").select("shard", "mark", "doc", "start").join(good, ["shard", "mark"])
    one = back.select("doc", F.explode(F.transform("spans", lambda s: F.struct((F.col("start") + s[0]).alias("a"), (F.col("start") + s[1]).alias("e")))).alias("s"))
    return settled(one.groupBy("doc").agg(F.collect_list("s").alias("spans")), "sub-spans")


def removed(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the hash of what is left."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in pieces(whole):
                out: list[list] = [[] for _ in RESULT]
                for d, t, ss in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                    ws = words(t)
                    n, gone = len(ws), 0
                    if ss:
                        keep = np.ones(n, bool)
                        for s in ss:
                            keep[s["a"] : s["e"]] = False
                        gone = n - int(keep.sum())
                        ws = [ws[i] for i in np.flatnonzero(keep)]
                    for c, v in zip(out, (d, n, gone, hashlib.sha256(b" ".join(ws)).hexdigest()), strict=True):
                        c.append(v)
                yield batch(RESULT, out)

    joined = docs.select("doc_id", "text").join(spans, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return removed(docs, covered(docs))


OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) > 12)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM g),
c AS (SELECT DISTINCT doc_id, i + k AS j FROM f, (SELECT unnest(range(0, 13)) AS k) WHERE least < doc_id),
r AS (SELECT doc_id, list(j) AS js FROM c GROUP BY doc_id),
x AS (SELECT w.doc_id, ws, coalesce(js, []) AS js FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(js) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(ws, lambda v, i: NOT list_contains(js, i)), ' ')) AS kept_sha256
FROM x
"""
