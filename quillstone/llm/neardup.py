"""Near-duplicate detection from bottom-k sketches.

One hash function orders the shingles; a document retains its RETAINED smallest. Inverted lists of the
INDEXED smallest retained values generate overlaps, the sketch of the union estimates the similarity and
drops what is far below the threshold, and exact Jaccard on the full sets verifies every link.

Documents that meet in a list of at most SMALL are paired. In a longer one (thousands of near copies, a passage
that many share) each document is paired with the list's smallest only. Where that leaves the list in more than one
part, its documents meet again in the short lists of all their retained values; those of whose values a third or more
stand in long lists go through an exact join on the rarest quarter of their full sets as well, with a bound from the
places of a common shingle. Its lists are dealt in blocks of PART rows, which meet blocks of the rows with other labels than the
list's largest. So no list emits all its pairs, and no task gets more than one block of each side.

Probabilities, for two large sets at the threshold of 0.75, where each of the smallest values of their union is common
with probability 0.75. They meet in no list with 0.25 ** 24 = 4e-15. That all they have in common of 64 values stands in
long lists and is yet less than a third of one's values needs at most 21 common ones: 1e-12. The estimate of 64 values
falls under 0.48 with 1.4e-6. Sets of at most 64 shingles are retained whole and nothing of theirs is missed. Hashes
have 63 bits.

Defined cases: texts with fewer than five words are one shingle; null, empty and blank texts have none and
are linked with nothing; documents with a null doc_id are linked with nothing and kept; copies and repeated
rows share a class; rows with one doc_id and different texts are judged by their texts; of equal similarities none
is preferred, as all links count; very long texts are hashed whole; an empty table gives an empty result; further
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, hashes, map_rows, partitions, pieces, rolled, settled, table

SHINGLE, RETAINED, INDEXED, SMALL, PART = 5, 64, 24, 32, 512
#: Ids of documents that are sent to all tasks: 16 MB at most.
FEW = 1_000_000
#: Least similarity in hundredths, and least estimate for a pair to be verified.
PERCENT, ESTIMATE = 75, 0.48
NONE = np.int32(2**31 - 1)


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the n-word shingles, A-Z lower-cased."""
    ws = (text or "").encode("utf-8", "replace").lower().split()
    if not ws:
        return np.zeros(0, np.int64)
    return np.unique(rolled(hashes(ws), min(n, len(ws))) >> np.uint64(1)).astype(np.int64)


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def estimated(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Similarity of the rows of two arrays of sketches (padded with NONE) from the smallest RETAINED values of their unions."""
    out = np.empty(len(s))
    for at in range(0, len(s), 4096):
        u = np.sort(np.concatenate([s[at : at + 4096], t[at : at + 4096]], 1), 1)
        real = u != NONE
        twice = np.zeros(u.shape, bool)
        twice[:, 1:] = (u[:, 1:] == u[:, :-1]) & real[:, 1:]
        rank = np.cumsum(real & ~twice, 1)  # of the distinct values
        inside = real & (rank <= RETAINED)
        out[at : at + 4096] = (twice & inside).sum(1) / np.maximum(1, (inside & ~twice).sum(1))
    return out


SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("mark", pa.binary()), ("sketch", pa.list_(pa.int64()))])


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), mark (128-bit fingerprint of the whole set) and sketch of each document."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in pieces(whole):
                sets = [shingles(t) for t in b.column("text").to_pylist()]
                yield batch(SKETCH, [b.column("doc_id").cast(pa.int64()), [len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [s[:RETAINED] for s in sets]])

    return map_rows(docs, ["doc_id", "text"], run, "doc_id long, n long, mark binary, sketch array<long>")


def by_list(df: DataFrame, key: str, columns: list[str], pairs, schema: str) -> DataFrame:
    """Runs pairs(columns as arrays, begin of each list) over whole lists: rows of one key, which a task gets together."""
    names = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            k = t.column(key).to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            for a, b in pairs(t, np.append(begin, len(k))):
                if len(a):
                    a, b = np.minimum(a, b), np.maximum(a, b)
                    order = np.lexsort((b, a))
                    a, b = a[order], b[order]
                    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])  # lists of one group give the same pairs
                    yield batch(names, [pa.array(a[new]), pa.array(b[new])])

        for b in it:
            if not b.num_rows:
                continue
            k = b.column(key).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(k, k[-1], "left"))  # the last list may go on in the next batch
            if cut:
                yield from work(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield from work(pa.Table.from_batches(held))

    return df.select(key, *columns).repartition(2 * partitions(df.sparkSession), key).sortWithinPartitions(key, columns[0]).mapInArrow(run, schema)


def _short_pairs(t: pa.Table, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of each short list whose sizes may reach the threshold and whose labels, if they have any, differ."""
    rep, n = t.column("rep").to_numpy(), t.column("n").to_numpy()
    label = t.column("label").to_numpy() if "label" in t.column_names else rep
    size = np.diff(ends)
    for k in range(2, int(size.max()) + 1):
        at = ends[:-1][size == k]
        for lo in range(0, len(at), 4096):
            x, y = np.triu_indices(k, 1)
            i, j = (at[lo : lo + 4096, None] + x).reshape(-1), (at[lo : lo + 4096, None] + y).reshape(-1)
            ok = (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])) & (label[i] != label[j])
            yield rep[i[ok]], rep[j[ok]]


def _rows(lists: pa.Array) -> np.ndarray:
    """Sketches as rows, padded with NONE."""
    size = np.diff(lists.offsets.to_numpy())
    out = np.full((len(size), RETAINED), NONE, np.int32)
    out[np.repeat(np.arange(len(size)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    return out


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches don't put them far below the threshold."""
    names = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ok = estimated(_rows(b.column("sa")), _rows(b.column("sb"))) >= ESTIMATE
            yield batch(names, [b.column("a"), b.column("b")]).filter(pa.array(ok, pa.bool_()))

    # The upper 31 bits are enough for an estimate and keep the order.
    of = lambda x: classes.select(F.col("rep").alias(x), F.transform("sketch", lambda v: F.shiftright(v, 32).cast("int")).alias(f"s{x}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def _bounded_pairs(t: pa.Table, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of an asking and a dealt row with different labels that may still reach the threshold if their first common shingle is this one."""
    cols = [t.column(c).to_numpy() for c in ("rep", "n", "pos", "label", "asks")]
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        rep, n, pos, label, asks = (c[a:b] for c in cols)
        few, dealt = np.flatnonzero(asks == 1), np.flatnonzero(asks == 0)
        if not len(few) or not len(dealt):
            continue
        left = n - pos
        for at in range(0, len(few), 256):
            r = few[at : at + 256]
            ok = (label[r][:, None] != label[dealt]) & ((100 + PERCENT) * np.minimum(left[r][:, None], left[dealt]) >= PERCENT * (n[r][:, None] + n[dealt]))
            x, y = np.nonzero(ok)
            yield rep[r[x]], rep[dealt[y]]


def _dealt(prefix: DataFrame) -> DataFrame:
    """Lists in blocks: all their rows, in blocks of about PART, meet those that aren't of the list's largest label, in blocks of their own."""
    by_label = prefix.groupBy("sh", "label").agg(F.count("*").alias("c"))
    of = by_label.groupBy("sh").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.max("c").alias("top"), F.sum("c").alias("all"), F.count("*").alias("labels")).filter("labels > 1")
    blocks = lambda c: F.ceil(c / PART).cast("int")
    rows = prefix.join(settled(of, "dup-parts"), "sh").withColumns({"dealt": blocks(F.col("all")), "asking": blocks(F.col("all") - F.col("top"))})
    key = lambda i, j: F.xxhash64("sh", i.cast("int"), j.cast("int")).alias("part")
    mine = lambda of: F.pmod(F.xxhash64("rep", F.lit(of)), F.col(of))
    own = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("asking") - 1))).select(key(mine("dealt"), F.col("j")), "rep", "n", "pos", "label", F.lit(0).cast("long").alias("asks"))
    few = rows.filter("label <> most").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("dealt") - 1)))
    return own.union(few.select(key(F.col("i"), mine("asking")), "rep", "n", "pos", "label", F.lit(1).cast("long").alias("asks")))


def of_these(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of texts whose rep is among ids (a table already written), with what else ids has: joined where they are while the ids are few, else by shuffling both."""
    return texts.join(F.broadcast(ids) if ids.count() <= FEW else ids, "rep")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are alike."""
    pairs = settled(pairs, "dup-pairs")
    texts = of_these(texts, settled(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "dup-paired"))
    names = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached = lru_cache(64)(shingles)
        for b in it:
            ok = [alike(cached(x), shingles(y)) for x, y in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True)]
            yield batch(names, [b.column("a"), b.column("b")]).filter(pa.array(ok, pa.bool_()))

    two = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a")
    return two.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of all nodes that have an edge; labels spread and are followed, in rounds."""
    both = settled(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct(), "dup-edges")
    now = both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("x"), F.min("y")).alias("component"))
    while True:
        now = settled(now, "dup-labels")
        of = now.select(F.col("node").alias("y"), F.col("component").alias("c"))
        near = both.join(of, "y").groupBy(F.col("x").alias("node")).agg(F.min("c").alias("c"))
        new = now.join(near, "node").select("node", F.least("component", "c").alias("component"), F.col("component").alias("old"))
        far = now.select(F.col("node").alias("component"), F.col("component").alias("farther"))
        new = new.join(far, "component", "left").select("node", F.least("component", "farther").alias("component"), "old")
        new = settled(new, "dup-labels")
        if new.filter("component <> old").isEmpty():
            return new.select("node", "component")
        now = new.select("node", "component")


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document."""
    return _grouped(docs).drop("mark")


def _grouped(docs: DataFrame) -> DataFrame:
    rows = settled(sketched(docs), "dup-sketches")
    classes = settled(rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("mark").agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")), "dup-classes")

    # Inverted lists of values that more than one class retains.
    lists = settled(_with_sizes(classes.select("rep", "n", F.explode(F.slice("sketch", 1, INDEXED)).alias("v"))), "dup-lists")
    texts = docs.select(F.col("doc_id").alias("rep"), "text")
    near = by_list(lists.filter(F.col("df") <= SMALL), "v", ["rep", "n"], _short_pairs, "a long, b long")
    hot = lists.filter(F.col("df") > SMALL).select("v", "rep")
    led = hot.join(settled(hot.groupBy("v").agg(F.min("rep").alias("leader")), "dup-leaders"), "v").filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b"))
    first = settled(verified(likely(near.union(led).distinct(), classes), texts), "dup-links")

    # Documents of long lists that the first links leave in several parts meet in the short lists of all they retain.
    labels = first.groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("label"))
    marked = hot.join(labels, "rep", "left").select("v", "rep", F.coalesce("label", "rep").alias("label"))
    split = settled(marked.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("v"), "dup-split")
    open_ = settled(marked.join(split, "v", "left_semi").select("rep", "label").distinct(), "dup-open")
    wide = settled(_with_sizes(classes.join(open_, "rep").select("rep", "n", "label", F.explode("sketch").alias("v"))), "dup-wide")
    again = by_list(wide.filter(F.col("df") <= SMALL), "v", ["rep", "n", "label"], _short_pairs, "a long, b long").distinct()
    second = settled(verified(likely(again.join(first, ["a", "b"], "left_anti"), classes), texts), "dup-links")

    # Those mostly of long lists go through an exact join on rare shingles, too.
    mostly = wide.filter(F.col("df") > SMALL).groupBy("rep").agg(F.count("*").alias("long"), F.any_value("n").alias("n"))
    mostly = mostly.filter(3 * F.col("long") >= F.least(F.col("n"), F.lit(RETAINED))).select("rep")
    open_ = settled(open_.join(mostly, "rep", "left_semi"), "dup-mostly")
    sets = settled(of_these(texts, open_).select("rep", "label", "text").mapInArrow(_exploded, "rep long, label long, n long, sh long"), "dup-sets")
    rare = sets.join(sets.groupBy("sh").agg(F.count("*").alias("df")), "sh")
    ordered = rare.groupBy("rep", "label", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sh"))).alias("s"))  # a document's own set
    prefix = ordered.select("rep", "label", "n", F.posexplode(F.slice("s", F.lit(1), (F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1).cast("int"))).alias("pos", "e"))
    prefix = prefix.filter("e.df > 1").select(F.col("e.sh").alias("sh"), "rep", "n", F.col("pos").cast("long").alias("pos"), "label")
    prefix = settled(prefix, "dup-prefix")
    more = by_list(_dealt(prefix), "part", ["rep", "n", "pos", "label", "asks"], _bounded_pairs, "a long, b long").filter("a <> b").distinct()
    third = settled(verified(more.join(first.union(second), ["a", "b"], "left_anti"), texts), "dup-links")

    found = components(first.union(second).union(third))
    of = classes.select("mark", "rep").join(found, F.col("rep") == F.col("node"), "left").select(F.col("mark").alias("m"), F.coalesce("component", "rep").alias("c"))
    out = rows.join(of, (F.col("mark") == F.col("m")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("c", "doc_id")
    return out.select("doc_id", "mark", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _with_sizes(postings: DataFrame) -> DataFrame:
    """Postings of lists of two or more, with the list's size as df. What is joined to a hot list's rows is a table of its own here and below, so that they can be split over tasks."""
    return postings.join(settled(postings.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "dup-sizes"), "v")


def _repeats(rows: DataFrame, key: str) -> bool:
    return not rows.groupBy(key).count().filter(F.col(key).isNotNull() & (F.col("count") > 1)).isEmpty()


def _exploded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = pa.schema([("rep", pa.int64()), ("label", pa.int64()), ("n", pa.int64()), ("sh", pa.int64())])
    for whole in it:
        for b in pieces(whole, 2_000_000):
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            n = np.array([len(s) for s in sets], np.int64)
            yield batch(names, [pa.array(np.repeat(b.column(c).to_numpy(), n)) for c in ("rep", "label")] + [pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets))])


def unique(docs: DataFrame) -> DataFrame:
    """One row of each group, rows and columns as they came; of rows with one doc_id the one whose text was judged, and of equal rows one.

    Rows with a null doc_id are in no group and stay.
    """
    kept = settled(_grouped(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("mark").alias("kept_mark")).distinct(), "dup-kept")
    own = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names of the documents' columns can't clash with those below
    ident, text = (docs.columns.index(c) for c in ("doc_id", "text"))
    as_they_came = lambda df: df.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
    if kept.count() <= FEW:
        kept = F.broadcast(kept)
    if not _repeats(docs, "doc_id"):
        return as_they_came(own.join(kept, F.col(f"c{ident}").eqNullSafe(F.col("kept_id")), "left_semi"))
    with_mark = T.StructType([*own.schema.fields, T.StructField("mark", T.BinaryType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            marks = [xxhash.xxh3_128_digest(shingles(t).tobytes()) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(marks, pa.binary())], names=[*b.schema.names, "mark"])

    known = own.mapInArrow(run, with_mark).filter(F.col(f"c{ident}").isNotNull())
    one = known.join(kept, (F.col(f"c{ident}") == F.col("kept_id")) & (F.col("mark") == F.col("kept_mark")), "left_semi").dropDuplicates([f"c{ident}", "mark"])
    return as_they_came(one.drop("mark").union(own.filter(F.col(f"c{ident}").isNull())))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"))
