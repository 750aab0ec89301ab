"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is dealt in blocks of equal tokens. Block seats go to the sources with the highest quotients
target / (2 k + 1), which gives integer quotas for the mix and, the method being house-monotone, for each
shard of it. A source's blocks are cut from its documents in seeded order; which of them a quota takes is
decided by a seeded permutation of the block numbers in closed form, so nothing is collected but one row
per source. A source's quota is the sum of its quotas of the shards, and a shard's blocks are the places of the
permutation that follow those of the shards before it; the query has no column for the shard and so selects
the places of all shards at once.

Defined cases: a null text has size 0 and is never taken; a null source is a source, last in order; a source
without words has target 0; repeated rows are documents of their own; of equal quotients the earlier source comes first, and
documents with one seeded hash go by doc_id and size; a very long text is as many blocks; an empty table gives an empty
result; further columns aren't read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, settled, table

#: Parts of the weight pattern, for sources in code-point order.
WEIGHTS = (3, 1, 2)
#: The mix's size against all sizes, and how often a document may be taken.
SHARE, EPOCHS = 1.5, 2
BLOCK, SHARD_BLOCKS, MOST_SHARDS, SEED = 32, 65536, 4096, 17
GOLDEN = 0.6180339887498949


@dataclass(frozen=True)
class Quota:
    source: str | None
    rank: int
    total: int
    target: float
    blocks: int
    quota: int
    step: int
    shift: int
    shards: tuple[int, ...] = ()


def targets(totals: list[int], weights: list[int], share: float = SHARE, epochs: int = EPOCHS) -> list[float]:
    """share x all tokens by weight; a target stops at epochs x its source, the rest being reshared."""
    caps = [float(epochs * t) for t in totals]
    left, free = share * sum(totals), sum(weights)
    order = sorted(range(len(totals)), key=lambda i: (caps[i] / weights[i], i))
    stopped = set()
    for i in order:
        if free and caps[i] / weights[i] < left / free:
            stopped.add(i)
            left, free = left - caps[i], free - weights[i]
        else:
            break
    level = left / free if free else 0.0
    return [caps[i] if i in stopped else level * weights[i] for i in range(len(totals))]


def seats(wanted: list[float], house: int, most: list[int]) -> list[int]:
    """Sainte-Laguë: `house` seats by highest quotients, at most most[i] each; ties go to the earlier one."""
    whole = sum(wanted)
    house = min(house, sum(most))
    if not whole or house <= 0:
        return [0] * len(wanted)
    got = [min(most[i], int(w / whole * house)) for i, w in enumerate(wanted)]
    up = lambda i: (wanted[i] / (2 * got[i] + 1), -i)
    down = lambda i: (wanted[i] / (2 * got[i] - 1), -i)
    while True:
        give = max((i for i in range(len(got)) if got[i] < most[i] and wanted[i] > 0), key=up, default=None)
        take = min((i for i in range(len(got)) if got[i] > 0), key=down, default=None)
        used = sum(got)
        if used < house and give is not None:
            got[give] += 1
        elif used > house:
            got[take] -= 1
        elif give is not None and take is not None and give != take and up(give) > down(take):
            got[give] += 1
            got[take] -= 1
        else:
            return got


def per_shard(wanted: list[float], house: int, most: list[int], shard: int = SHARD_BLOCKS) -> list[list[int]]:
    """Quotas of each shard: what a house grown by one shard adds to each source."""
    out, before = [], [0] * len(wanted)
    for h in range(shard, house + shard, shard):
        now = seats(wanted, min(h, house), most)
        out.append([a - b for a, b in zip(now, before, strict=True)])
        before = now
    return out


def quotas(rows: list[tuple[str | None, int]], block: int = BLOCK, seed: int = SEED) -> list[Quota]:
    """rows: source and its tokens, in order."""
    totals = [t for _, t in rows]
    wanted = targets(totals, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))]) if rows else []
    blocks = [-(-t // block) for t in totals]
    house = int(SHARE * sum(totals) // block)
    shards = per_shard(wanted, house, [EPOCHS * b for b in blocks], max(SHARD_BLOCKS, -(-house // MOST_SHARDS)))
    got = [sum(s[i] for s in shards) for i in range(len(rows))]
    out = []
    for i, (source, total) in enumerate(rows):
        n = blocks[i]
        step = max(1, min(int(n * GOLDEN), 2**62 // max(n, 1)))
        while n and math.gcd(step, n) != 1:
            step += 1
        out.append(Quota(source, i + 1, total, wanted[i], n, got[i], step, (seed + 7919 * (i + 1)) % n if n else 0, tuple(s[i] for s in shards)))
    return out


def mixed(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken (tokens that the mix takes of the document)."""
    spark = docs.sparkSession
    sizes = settled(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    per = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()  # a row per source
    plan = quotas([(r["source"], r["size"]) for r in per], block, seed)
    chosen = spark.createDataFrame([(q.source, q.total, q.target, q.blocks, q.quota, q.step, q.shift) for q in plan], "p_source string, source_size long, target double, blocks long, quota long, step long, shift long")

    # Where a document begins in its source: sums within salted parts of the seeded order, then over the parts.
    digits = max(1, math.ceil(math.log(max(2, sum(r["n"] for r in per) / 4096), 16)))
    keyed = sizes.withColumn("k", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    keyed = keyed.withColumn("part", F.substring("k", 1, digits))
    parts = keyed.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    parts = parts.select(F.col("source").alias("b_source"), F.col("part").alias("b_part"), F.coalesce(F.sum("part_size").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = W.partitionBy("source", "part").orderBy("k", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("inner", F.coalesce(F.sum("size").over(own), F.lit(0)))
    placed = placed.join(parts, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("part") == F.col("b_part")))
    placed = placed.join(chosen, F.col("source").eqNullSafe(F.col("p_source")))
    at = F.col("before") + F.col("inner")
    end = at + F.col("size")
    passes = F.floor(F.col("quota") / F.greatest(F.col("blocks"), F.lit(1)))
    rest = F.col("quota") - passes * F.col("blocks")
    placed = placed.withColumns({"at": at, "end": end, "passes": passes, "rest": rest})
    inside = F.aggregate(
        F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block)),
        F.lit(0).cast("long"),
        lambda acc, j: acc + F.when(F.pmod(j * F.col("step") + F.col("shift"), F.col("blocks")) < F.col("rest"), F.least(F.col("end"), (j + 1) * block) - F.greatest(F.col("at"), j * block)).otherwise(F.lit(0)),
    )
    taken = F.when(F.col("size") > 0, F.col("passes") * F.col("size") + inside).otherwise(F.lit(0)).cast("long")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s GROUP BY source),
w AS (SELECT *, [3, 1, 2][(k - 1) % 3 + 1] AS weight, CAST(2 * total AS DOUBLE) AS cap FROM t),
f AS (SELECT *, sum(cap) OVER o AS cap_before, sum(weight) OVER o AS weight_before, CAST(1.5 AS DOUBLE) * (SELECT sum(total) FROM t) AS mix, (SELECT sum(weight) FROM w) AS weights
      FROM w WINDOW o AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, (mix - coalesce(cap_before, 0)) / CAST(weights - coalesce(weight_before, 0) AS DOUBLE) AS level_here FROM f),
lev AS (SELECT level_here AS lev FROM h WHERE NOT cap / weight < level_here ORDER BY cap / weight, k LIMIT 1),
q AS (SELECT source, total, k, CASE WHEN cap / weight < level_here THEN cap ELSE lev * weight END AS target, CAST(ceil(total / 32.0) AS BIGINT) AS blocks, CAST(floor(mix / 32) AS BIGINT) AS house FROM h, lev),
u AS (SELECT source, k, house, target / (2 * i + 1) AS quotient FROM (SELECT *, unnest(range(0, 2 * blocks)) AS i FROM q)),
g AS (SELECT source, k, count(*) AS quota FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, k) AS seat FROM u) WHERE seat <= house GROUP BY ALL),
p AS (SELECT q.*, coalesce(quota, 0) AS quota, coalesce(quota, 0) // greatest(blocks, 1) AS passes, coalesce(quota, 0) % greatest(blocks, 1) AS rest,
             list_filter(range(greatest(1, CAST(floor(blocks * 0.6180339887498949) AS BIGINT)), blocks + 200), lambda x: gcd(x, blocks) = 1)[1] AS step,
             CASE WHEN blocks > 0 THEN (17 + 7919 * q.k) % blocks ELSE 0 END AS shift FROM q LEFT JOIN g ON g.k = q.k),
d AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('17:' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM s),
b AS (SELECT d.doc_id, d.pos, d.size, p.*, unnest(range(CAST(pos // 32 AS BIGINT), CAST((pos + size - 1) // 32 AS BIGINT) + 1)) AS j FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source WHERE size > 0),
c AS (SELECT doc_id, sum(CASE WHEN (j * step + shift) % blocks < rest THEN least(pos + size, (j + 1) * 32) - greatest(pos, j * 32) ELSE 0 END) AS part FROM b GROUP BY doc_id)
SELECT d.doc_id, d.size, p.total AS source_size, p.target, CAST(p.passes * d.size + coalesce(c.part, 0) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN c ON c.doc_id = d.doc_id
"""
