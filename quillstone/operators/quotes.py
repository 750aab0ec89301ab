"""Verbatim citation: a quote counts where it occurs; its pieces only where they occur once."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import squashed


#: Characters of quotes that are sent to all tasks.
FEW = 16_000_000
#: Characters of quotes in one automaton, of some 100 bytes a character at most, and how many passes find all quotes sooner than runs of words do.
SHARD, PASSES = 1_000_000, 4


def _found(n: DataFrame, quotes: DataFrame, anchor: int) -> DataFrame:
    """The rows of n (note_id, t, ...) with each different q that their t holds anywhere, the quotes' rows aside.

    Where a quote occurs, all its words but the first and the last are whole words of the note: the note's first and last
    may go on beyond it. So notes and quotes meet by hashes of runs of at most `anchor` of these inner words, and what meets is
    compared letter by letter. While the quotes are few they are sent to the notes, whose runs then don't move. Quotes of one or two
    words have no inner word: automata of about SHARD characters find them, each in one pass over the notes. All quotes are found so
    where PASSES of these hold them.
    """
    w = F.split("q", " ")
    k = F.greatest(F.lit(0), F.least(F.lit(anchor), F.size(w) - 2))
    q = quotes.select("q").distinct().withColumn("k", k).withColumn("key", F.xxhash64(F.array_join(F.slice(w, F.lit(2), F.col("k")), " ")))
    counts = {r[0]: r[1] for r in q.groupBy("k").agg(F.sum(F.length("q") + 32)).collect()}  # at most anchor + 1 rows
    if sum(counts.values()) <= PASSES * SHARD:
        q, counts = q.withColumn("k", F.lit(0)), {0: sum(counts.values())}
    lengths, few = sorted(counts), sum(counts.values()) <= FEW
    words = n.select("note_id", F.split("t", " ").alias("w"))

    def runs(k: int) -> DataFrame:
        """Each note's different runs of k words."""
        keys = F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, k), " ")))
        return words.filter(F.size("w") >= k).select("note_id", F.lit(k).alias("k"), F.explode(F.array_distinct(keys)).alias("key"))

    out, grams = None, None
    shards = -(-counts.get(0, 0) // SHARD)
    for s in range(shards):
        part = _short(n, q.filter((F.col("k") == 0) & (F.pmod(F.xxhash64("q"), F.lit(shards)) == s)).select("q"))
        out = part if out is None else out.union(part)
    for k in lengths:
        if k:
            grams = runs(k) if grams is None else grams.union(runs(k))
    if grams is not None:
        pairs = grams.join(F.broadcast(q) if few else q, ["k", "key"]).select(F.col("note_id").alias("of"), "q").distinct()
        more = n.join(pairs, F.col("note_id").eqNullSafe(F.col("of"))).drop("of").filter(F.contains("t", "q"))
        out = more if out is None else out.union(more)
    return n.select("*", F.lit("").alias("q")).limit(0) if out is None else out


def _short(n: DataFrame, quotes: DataFrame) -> DataFrame:
    """The rows of n with each q of a bounded set that their t holds: one automaton reads each note once."""
    sent = n.sparkSession.sparkContext.broadcast([r["q"] for r in quotes.toLocalIterator()])
    schema = T.StructType([*n.schema.fields, T.StructField("q", T.StringType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ahocorasick.Automaton()
        for q in sent.value:
            found.add_word(q, q)
        found.make_automaton()
        for b in it:
            rows, held = [], []
            for k, text in enumerate(b.column("t")):
                for q in sorted({q for _, q in found.iter(text.as_py())}) if text.is_valid and sent.value else ():
                    rows.append(k)
                    held.append(q)
            for k in range(0, len(rows), 512):  # a long text may hold many
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(rows[k : k + 512], pa.int64())).columns, pa.array(held[k : k + 512], pa.string())], names=[*b.schema.names, "q"])

    return n.mapInArrow(run, schema)


def _texts(notes: DataFrame) -> DataFrame:
    return notes.select("note_id", squashed(F.col("text")).alias("t"), "text").filter("t IS NOT NULL")


def _occurrences(t: Column, q: Column) -> Column:
    """How often q occurs in t, one after the other."""
    return F.floor((F.length(t) - F.length(F.replace(t, q, F.lit("")))) / F.length(q)).cast("long")


def located(notes: DataFrame, quotes: DataFrame, anchor: int = 3) -> DataFrame:
    """(note_id, quote_id, hits): occurrences of each quote in each note, blanks aside."""
    q = quotes.select("quote_id", squashed(F.col("quote")).alias("q")).filter("q <> ''")
    hits = _found(_texts(notes).drop("text"), q, anchor).select("note_id", "q", _occurrences(F.col("t"), F.col("q")).alias("hits"))
    return hits.join(q, "q").select("note_id", "quote_id", "hits")


def pieces_located(notes: DataFrame, quotes: DataFrame, anchor: int = 3) -> DataFrame:
    """(note_id, quote_id, piece, found): pieces of the quotes that a note doesn't hold whole, where they occur exactly once.

    Quotes are split at blanks after a full stop or semicolon; pieces have two words or more, counted from 1 among all.
    A piece is sought as written, and without the punctuation at its end only where that occurs nowhere. As in the
    reference, places with the piece's own blanks come before those with other blanks.
    """
    q = quotes.select("quote_id", "quote").filter("quote IS NOT NULL").distinct()
    cut = q.select("quote_id", F.posexplode(F.split(F.trim(F.regexp_replace("quote", r"(?U)^\s+|\s+$", "")), r"(?U)(?<=[.;])\s+", -1)).alias("pos", "raw"))
    cut = cut.filter(F.size(F.split(squashed(F.col("raw")), " ")) >= 2)
    both = F.array(F.struct(F.lit(0).alias("form"), F.col("raw")), F.struct(F.lit(1).alias("form"), F.regexp_replace("raw", "[.,;:]+$", "").alias("raw")))
    asked = cut.select("quote_id", (F.col("pos") + 1).alias("piece"), F.explode(both).alias("f")).select("quote_id", "piece", "f.form", "f.raw").withColumn("q", squashed(F.col("raw"))).filter("q <> ''")
    at = F.position("raw", "text")
    once = F.when(F.col("piece") == 0, True).when(at > 0, F.position("raw", "text", at + 1) == 0).otherwise(_occurrences(F.col("t"), F.col("q")) == 1)
    # Whole quotes are sought in the same pass, as piece 0.
    asked = asked.union(q.select("quote_id", F.lit(0), F.lit(0), F.lit(None).cast("string"), squashed(F.col("quote")).alias("q")).filter("q <> ''"))
    held = _found(_texts(notes), asked, anchor).join(asked, "q").select("note_id", "quote_id", "piece", "form", "q", once.alias("once"))
    best = held.groupBy("note_id", "quote_id", "piece").agg(F.min_by(F.struct("once", F.col("q").alias("found")), "form").alias("b"))
    left = best.withColumn("first", F.min("piece").over(W.partitionBy("note_id", "quote_id"))).filter("first > 0 AND b.once")
    return left.select("note_id", "quote_id", "piece", F.col("b.found").alias("found"))
