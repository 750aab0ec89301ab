"""Near duplicates by SimHash: fingerprints at few differing bits are linked.

Distinct fingerprints are embedded as the bit counts of SEGMENTS segments of two bits. The Manhattan distance of two such
vectors is at most the number of differing bits, so it is a lower bound. The segments form three groups; of a distance
of at most 4, two groups together hold at most 2. For each two groups, fingerprints therefore go to the cell of their bit
counts and to all cells at a distance of one (never out of range): two of them within 2 meet half-way in one cell. Cells are
joined by their keys and the differing bits of those that meet are counted.

No cell gives all its pairs. Rows of a cell come sorted and in blocks of BLOCK; within a block the linked ones are joined to the
smallest of their part. Cells that a sample of the fingerprints shows to be large are split over tasks. Cells with more than
one block come again: rows of their largest label and the others are dealt in blocks to each other, so what the blocks have
left apart is compared, too. So nothing is lost, and no task gets more than a block of each side.

Defined cases: null, empty and blank texts have fingerprint zero, which is linked like any other; fewer words than a shingle are one
shingle; copies and repeated rows share a fingerprint; rows with a null doc_id get their fingerprint, are linked with nothing and have no
component; a bit set in just half the shingles is 0; very long texts are read in runs of shingles; an empty table gives an empty
result; further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, encoded, map_rows, partitions, pieces, settled, table
from .neardup import FEW, components

SHINGLE, SEED, BITS = 4, 42, 4
SEGMENTS, GROUPS = 32, ((0, 11), (11, 22), (22, 32))
#: Pairs of groups; each pair's cells are a grid of its own.
GRIDS = ((0, 1), (0, 2), (1, 2))
#: Rows of a cell that are compared at once.
BLOCK = 512
#: A fingerprint in SAMPLE counts for large cells; LARGE of them make one.
SAMPLE, LARGE = 64, 32
RUN = 1 << 18


def shingle_hashes(text: str | None) -> Iterator[np.ndarray]:
    """The hashes of all shingles, repeats included, in runs."""
    ws = encoded(text).lower().split()
    whole = memoryview(b" ".join(ws))
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    begins = np.concatenate([[0], ends[:-1]])
    n = min(SHINGLE, len(ws))
    ends, begins = ends[n - 1 :] - 1, begins[: len(ws) - n + 1]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(ends) if n else 0, RUN):
        a, b = begins[at : at + RUN].tolist(), ends[at : at + RUN].tolist()
        yield np.fromiter((digest(whole[i:j], SEED) for i, j in zip(a, b)), np.uint64, len(a))


def fingerprint(text: str | None) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (64 bits as a long) of each row."""
    names = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in pieces(whole):
                fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64)
                yield batch(names, [b.column("doc_id").cast(pa.int64()), pa.array(fps.view(np.int64))])

    return map_rows(docs, ["doc_id", "text"], run, "doc_id long, fp long")


def bit_counts(fps: np.ndarray) -> np.ndarray:
    """Ones in each segment of two bits, a row a fingerprint."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits[:, 0::2] + bits[:, 1::2]


#: A cell's key is the sum of its bit counts times these, so that a step of one in a segment adds or takes one of them.
STEPS = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, SEGMENTS, dtype=np.uint64) | np.uint64(1)


def cells_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the cells of each fingerprint, in all grids, and the index of their fingerprint."""
    counts = bit_counts(fps)
    every = np.arange(len(fps))
    keys, of = [], []
    for g, pair in enumerate(GRIDS):
        dims = np.concatenate([np.arange(*GROUPS[k]) for k in pair])
        with np.errstate(over="ignore"):
            base = (counts[:, dims].astype(np.uint64) * STEPS[dims]).sum(1, dtype=np.uint64) + np.uint64(g * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            keys.append(base)
            of.append(every)
            for step, c in ((STEPS[dims], counts[:, dims] < 2), (-STEPS[dims], counts[:, dims] > 0)):
                i, j = np.nonzero(c)
                keys.append(base[i] + step[j])
                of.append(i)
    return np.concatenate(keys), np.concatenate(of)


def in_cells(rows: DataFrame) -> DataFrame:
    """cell and fp: each fingerprint in all its cells."""
    names = pa.schema([("cell", pa.int64()), ("fp", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, 4096):
                fps = whole.column("fp")[at : at + 4096].to_numpy(zero_copy_only=False)
                keys, of = cells_of(fps.view(np.uint64))
                yield batch(names, [pa.array(keys.view(np.int64)), pa.array(fps[of])])

    return map_rows(rows, ["fp"], run, "cell long, fp long")


def _parts(x: np.ndarray) -> np.ndarray:
    """Of lists of k fingerprints each (rows), the place of the smallest one that each reaches by links."""
    near = np.bitwise_count(x[:, :, None] ^ x[:, None, :]) <= BITS
    label = np.broadcast_to(np.arange(x.shape[1]), x.shape)
    if near.sum() == x.size:
        return label
    while True:
        new = np.where(near, label[:, None, :], x.shape[1]).min(2)
        if (new == label).all():
            return label
        label = new


def linked(rows: DataFrame) -> DataFrame:
    """a and b: fingerprints that are linked through others of one block of a cell, b the smallest; a null b has a cell of several blocks as a."""
    names = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def blocks(cell: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        size = np.diff(np.append(begin, len(cell)))
        found = []
        for k in np.unique(size[size > 1]):
            at = begin[size == k]
            for lo in range(0, len(at), max(1, (1 << 20) // int(k * k))):
                x = np.sort(fp[at[lo : lo + max(1, (1 << 20) // int(k * k)), None] + np.arange(k)].view(np.uint64), 1)
                label = _parts(x)
                i, j = np.nonzero(label != np.arange(k))
                found.append(np.stack([x[i, j], x[i, label[i, j]]], 1))
        if found and sum(map(len, found)):
            pairs = np.unique(np.concatenate(found), axis=0).view(np.int64)
            yield batch(names, [pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        last_long = None
        for b in it:
            cells, fps = np.concatenate([cells, b.column("cell").to_numpy()]), np.concatenate([fps, b.column("fp").to_numpy()])
            # Whole cells and, of the last one, whole blocks are worked on; the rest waits for the next rows.
            begin = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
            place = np.arange(len(cells)) - np.repeat(begin, np.diff(np.append(begin, len(cells))))
            block = place // BLOCK
            ready = len(cells) - (len(cells) - int(begin[-1])) % BLOCK
            ready = ready if ready > begin[-1] else int(begin[-1])
            # A cell whose first block was worked on earlier, or that has more than one block, is long.
            long = np.unique(cells[block > 0]).tolist()
            if last_long is not None and len(cells) and cells[0] == last_long:
                long.append(last_long)
            if long:
                yield batch(names, [pa.array(long, pa.int64()), pa.nulls(len(long), pa.int64())])
            last_long = int(cells[-1]) if ready > begin[-1] else None
            with np.errstate(over="ignore"):
                key = cells[:ready] + block[:ready] * np.int64(0x5851F42D4C957F2D)  # blocks of a cell are lists of their own
            yield from blocks(key, fps[:ready])
            cells, fps = cells[ready:], fps[ready:]
        if len(cells):
            if last_long is not None and cells[0] == last_long:
                yield batch(names, [pa.array([last_long], pa.int64()), pa.nulls(1, pa.int64())])
            yield from blocks(cells, fps)

    return rows.select("cell", "fp").mapInArrow(run, "a long, b long")


def crossed(rows: DataFrame) -> DataFrame:
    """Linked pairs a, b between the two sides of each block of the columns block, fp and asks (1 or 0), one for each asking row and label."""
    names = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in it:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            k = t.column("block").to_numpy()
            cut = int(np.searchsorted(k, k[-1], "left")) if len(k) else 0
            yield from work(t.slice(0, cut))
            held = t.slice(cut).combine_chunks()
        if held is not None:
            yield from work(held)

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        block, fp, label, asks = (t.column(c).to_numpy() for c in ("block", "fp", "label", "asks"))
        at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            x, lx = fp[lo:hi][asks[lo:hi] == 1], label[lo:hi][asks[lo:hi] == 1]
            y, ly = fp[lo:hi][asks[lo:hi] == 0], label[lo:hi][asks[lo:hi] == 0]
            for s in range(0, len(x), BLOCK):
                near = (np.bitwise_count(x[s : s + BLOCK, None].view(np.uint64) ^ y[None].view(np.uint64)) <= BITS) & (lx[s : s + BLOCK, None] != ly[None])
                i, j = np.nonzero(near)
                if len(i):
                    first = np.unique(np.stack([lx[s + i], ly[j]], 1), axis=0, return_index=True)[1]
                    yield batch(names, [pa.array(x[s + i[first]]), pa.array(y[j[first]])])

    return rows.select("block", "fp", "label", "asks").mapInArrow(run, "a long, b long")


def _large(cells: DataFrame) -> DataFrame:
    """cell and parts of the cells that a sample shows to be large."""
    sampled = cells.filter(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0).groupBy("cell").agg(F.count("*").alias("c"))
    return sampled.filter(F.col("c") >= LARGE).select(F.col("cell").alias("large"), F.ceil(F.col("c") / LARGE).cast("int").alias("parts"))


def small(df: DataFrame) -> DataFrame:
    """A written table, sent to all tasks while it has few rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def edges(fps: DataFrame) -> DataFrame:
    """a and b of the written distinct fingerprints: pairs in one component, which together connect all that links connect."""
    cells, n = in_cells(fps), 2 * partitions(fps.sparkSession)
    large = settled(_large(in_cells(fps.filter(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0))), "sim-large")
    many = not large.isEmpty()
    part = F.lit(0)
    if many:
        cells = cells.join(small(large), F.col("cell") == F.col("large"), "left")
        part = F.pmod(F.xxhash64("fp", F.lit(1)), F.coalesce("parts", F.lit(1)))
    spread = cells.select("cell", "fp", part.alias("part"))
    found = settled(linked(spread.repartition(n, "cell", "part").sortWithinPartitions("cell", "part")), "sim-blocks")
    first = settled(found.filter("b IS NOT NULL").distinct(), "sim-edges")
    long = found.filter("b IS NULL").select(F.col("a").alias("long"))
    long = settled((long.union(large.select("large")) if many else long).distinct(), "sim-long")
    if long.isEmpty():
        return first

    # What the blocks of a long cell have left apart.
    label = components(first)
    again = in_cells(fps).join(small(long), F.col("cell") == F.col("long"), "left_semi")
    again = settled(again.join(label, F.col("fp") == F.col("node"), "left").select("cell", "fp", F.coalesce("component", "fp").alias("label")), "sim-again")
    by_label = again.groupBy("cell", "label").agg(F.count("*").alias("c"))
    split = by_label.groupBy("cell").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.max("c").alias("top"), F.sum("c").alias("all"), F.count("*").alias("labels")).filter("labels > 1")
    rows = again.join(small(settled(split.select(F.col("cell").alias("split"), "most", "top", "all"), "sim-split")), F.col("cell") == F.col("split"))
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    rows = rows.select("cell", "fp", "label", "most", blocks(F.col("all")).alias("dealt"), blocks(F.col("all") - F.col("top")).alias("asking"))
    mine = lambda k: F.pmod(F.xxhash64("fp", F.lit(k)), F.col("dealt" if k == 2 else "asking"))
    key = lambda i, j: F.xxhash64("cell", i.cast("int"), j.cast("int")).alias("block")
    dealt = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("asking") - 1))).select(key(mine(2), F.col("j")), "fp", "label", F.lit(0).alias("asks"))
    asking = rows.filter("label <> most").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("dealt") - 1))).select(key(F.col("i"), mine(3)), "fp", "label", F.lit(1).alias("asks"))
    more = crossed(dealt.union(asking).repartition(n, "block").sortWithinPartitions("block"))
    return first.union(settled(more.distinct(), "sim-more"))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of each row."""
    rows = settled(fingerprints(docs), "sim-fingerprints")
    classes = settled(rows.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "sim-classes")
    found = components(edges(classes))
    named = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = settled(named.join(ids, "component").select(F.col("fp").alias("of"), "component_id"), "sim-ids")
    return rows.join(small(of), (F.col("fp") == F.col("of")) & F.col("doc_id").isNotNull(), "left").select("doc_id", "fp", "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouped(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
