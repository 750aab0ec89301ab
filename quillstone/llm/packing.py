"""Best-fit packing after Martello-Toth dominance reduction.

Pieces of documents differ to the packer only by length, so the instance is a histogram of at most 2048
lengths whatever the corpus's size. The reduction fixes, for the longest length left, a set that provably
dominates every other set with it: alone if nothing fits beside it; with a partner that fills the sequence;
with the longest fitting partner if no two others fit beside it, or if no three do and no two are longer
than that partner. The rest is packed best-fit, longest first. The plan, rows per length, then places the
pieces by their rank among those of equal length.

Defined cases: a null text is an empty one and has the end id alone; repeated rows are documents of their
own; pieces of equal length go by doc_id and piece; very long texts are cut into pieces of 2048; an empty table gives an
empty result; further columns aren't read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch, give_back, map_rows, pieces, settled, table
from .tokens import REMEMBER, encoder

SEQUENCE = 2048
#: Pieces of one length that are ranked in one go.
RANKED = 500_000
#: Segments (40 bytes each) of a plan that is broadcast.
SMALL_PLAN = 200_000


@dataclass
class Plan:
    """Segments (length, first rank, count, first sequence, pieces of it a sequence, offset of the first)."""

    capacity: int
    left: dict[int, int]
    segments: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    used: dict[int, int] = field(default_factory=lambda: defaultdict(int))
    sequences: int = 0
    fixed: int = 0

    def put(self, length: int, count: int, first: int, each: int, offset: int) -> None:
        self.segments.append((length, self.used[length], count, first, each, offset))
        self.used[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]


def reduce(plan: Plan) -> None:
    """Fixes dominating sets until no length allows one."""
    changed = True
    while changed and plan.left:
        changed = False
        for w in sorted(plan.left, reverse=True):
            while w in plan.left:
                room = plan.capacity - w
                own = plan.left[w]
                rest = dict(plan.left)
                rest[w] -= 1
                sizes = sorted(x for x, c in rest.items() if c)
                fit = bisect.bisect_right(sizes, room)
                if not fit:  # nothing fits beside it
                    plan.put(w, own, plan.sequences, 1, 0)
                    plan.sequences += own
                    plan.fixed += own
                    changed = True
                    break
                best = sizes[fit - 1]
                small = [x for x in sizes[:3] for _ in range(min(3, rest[x]))][:3]
                two = len(small) >= 2 and small[0] + small[1] <= room
                three = len(small) >= 3 and sum(small) <= room
                if best != room and two and (three or _pair(sizes[:fit], rest, room) > best):
                    break
                n = min(own, plan.left[best]) if best != w else own // 2
                first = plan.sequences
                if best == w:
                    plan.put(w, 2 * n, first, 2, 0)
                else:
                    plan.put(w, n, first, 1, 0)
                    plan.put(best, n, first, 1, w)
                plan.sequences += n
                plan.fixed += n
                changed = True


def _pair(sizes: list[int], counts: dict[int, int], room: int) -> int:
    """The largest sum of two pieces that fits, 0 if none does."""
    best, j = 0, len(sizes) - 1
    for i, a in enumerate(sizes):
        while j >= 0 and a + sizes[j] > room:
            j -= 1
        if j < i:
            break
        if j > i or counts[a] > 1:
            best = max(best, a + sizes[j])
        elif j > 0 and j - 1 >= i:
            best = max(best, a + sizes[j - 1])
    return best


def best_fit(plan: Plan) -> None:
    """Longest first, each piece into the open sequence with the least room that takes it; equal pieces go together."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}

    def opened(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n))

    for w in sorted(plan.left, reverse=True):
        while w in plan.left:
            at = bisect.bisect_left(rooms, w)
            m = plan.left[w]
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room, first = plan.capacity, plan.sequences
                n = -(-m // (room // w))
                plan.sequences += n
            each = room // w
            full = min(n, m // each)
            offset = plan.capacity - room
            if full:
                plan.put(w, full * each, first, each, offset)
                opened(room - each * w, first, full)
            some = m - full * each if full < n else 0
            if some:  # fewer than a sequence takes
                plan.put(w, some, first + full, some, offset)
                opened(room - some * w, first + full, 1)
            opened(room, first + full + bool(some), n - full - bool(some))


def planned(histogram: dict[int, int], capacity: int = SEQUENCE) -> Plan:
    plan = Plan(capacity, {w: c for w, c in histogram.items() if c})
    reduce(plan)
    best_fit(plan)
    return plan


def cut(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = SEQUENCE, forget: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32. forget: workers read fewer characters at a time and drop the words they remember after each task, for the sake of the work that follows in them."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), np.array([0], "<u4").tobytes()
        enc.most = REMEMBER // 8 if forget else REMEMBER
        for whole in it:
            for b in pieces(whole, 2_000_000 if forget else 8_000_000):
                out: list[list] = [[] for _ in schema]
                for d, got in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                    got += end
                    for k, at in enumerate(range(0, len(got), 4 * capacity)):
                        part = got[at : at + 4 * capacity]
                        for c, v in zip(out, (d, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            c.append(v)
                yield batch(schema, out)
        if forget:
            enc.memo.clear()
            give_back()

    return map_rows(docs, ["doc_id", "text"], run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = SEQUENCE, forget: bool = False) -> DataFrame:
    spark = docs.sparkSession
    parts = settled(cut(docs, vocabulary, capacity, forget), "pack-pieces")
    histogram = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # a row per length
    salts = max(64, -(-max(histogram.values(), default=0) // RANKED))
    plan = planned(histogram, capacity)
    by: dict[int, list] = defaultdict(list)
    for length, rank, *rest in plan.segments:
        by[length].append((rank, *rest))
    rows = [(w, [s[0] for s in ss], ss) for w, ss in ((w, sorted(x)) for w, x in by.items())]
    wide = spark.createDataFrame(rows, "w long, ranks array<long>, segments array<struct<rank:long,n:long,first:long,each:long,offset:long>>")

    # Ranks among equal lengths: within salted parts, then over the parts.
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    inner = salted.withColumn("inner", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    sums = salted.groupBy("length", "salt").count()
    sums = sums.select(F.col("length").alias("w2"), F.col("salt").alias("salt2"), F.coalesce(F.sum("count").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = inner.join(sums, (F.col("length") == F.col("w2")) & (F.col("salt") == F.col("salt2"))).withColumn("rank", F.col("before") + F.col("inner"))
    # The plan has a row for each length, at most `capacity`, and few segments for each; it is sent to all tasks only if that is so.
    plan_rows = F.broadcast(wide) if len(plan.segments) <= SMALL_PLAN else wide
    found = ranked.join(plan_rows, F.col("length") == F.col("w")).withColumn("i", F.size(F.filter("ranks", lambda r: r <= F.col("rank"))))
    s = F.element_at("segments", F.col("i"))
    k = F.col("rank") - s["rank"]
    seq = s["first"] + F.floor(k / s["each"])
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", seq.cast("long").alias("sequence_id"), (s["offset"] + (k % s["each"]) * F.col("length")).cast("long").alias("offset"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
