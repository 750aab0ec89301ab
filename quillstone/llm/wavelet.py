"""Token ids as binary output: a wavelet matrix per shard.

A shard holds the ids of consecutive documents as bit-planes, the most significant first; each plane is
stably parted into zeros and ones for the next. With counts of ones per block, rank and select give token
access, counting and occurrence lookup from the planes alone. One compressed file holds the planes, their
rank directory and the documents' ids and lengths.

Files get names of their own and a manifest, written by Spark, lists those that count; what a lost
executor left behind is never read.

Defined cases: a null text is an empty one and has the end id alone; null doc_ids come first; repeated rows
are documents of their own, equal doc_ids in the order of their texts; a very long text makes a longer shard; an empty
table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch, fresh_path, map_rows, partitions, pieces, settled, table
from .tokens import encoder

MAGIC = b"QSWM0001"
BLOCK = 512
SHARD_TOKENS = 1 << 20
END = 0


class WaveletMatrix:
    """Access, rank and select over a sequence of ids, from its bit-planes."""

    def __init__(self, n: int, planes: list[np.ndarray], ones: list[np.ndarray]) -> None:
        """planes: packed bits, from the most significant; ones: per plane the ones before each block of 512 bits, and at last all."""
        self.n, self.planes, self.ones = n, planes, ones
        self.zeros = [n - int(o[-1]) for o in ones]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        depth = max(1, int(ids.max()).bit_length() if n else 1)
        cur = ids.astype(np.uint16 if depth <= 16 else np.uint32)
        planes, ones = [], []
        for k in range(depth - 1, -1, -1):
            bit = (cur >> k & 1).astype(bool)
            packed = np.packbits(bit)
            planes.append(packed)
            ones.append(cls._directory(packed))
            cur = np.concatenate([np.compress(~bit, cur), np.compress(bit, cur)])
        return cls(n, planes, ones)

    @staticmethod
    def _directory(packed: np.ndarray) -> np.ndarray:
        step = BLOCK // 8
        full = np.zeros(-(-len(packed) // step) * step, np.uint8)
        full[: len(packed)] = packed
        return np.concatenate([[0], np.cumsum(np.bitwise_count(full).reshape(-1, step).sum(1, dtype=np.int64))]).astype(np.uint32)

    def _bit(self, p: int, i: int) -> int:
        return int(self.planes[p][i >> 3]) >> (7 - (i & 7)) & 1

    def _rank1(self, p: int, i: int) -> int:
        """Ones before i."""
        b = i // BLOCK
        lo = b * (BLOCK // 8)
        got = int(self.ones[p][b]) + int(np.bitwise_count(self.planes[p][lo : i >> 3]).sum())
        return got + (int(self.planes[p][i >> 3]) >> (8 - (i & 7))).bit_count() if i & 7 else got

    def _select(self, p: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) such bit."""
        before = self.ones[p].astype(np.int64)
        if not bit:
            before = np.minimum(np.arange(len(before), dtype=np.int64) * BLOCK, self.n) - before
        b = int(np.searchsorted(before, j, "right")) - 1
        bits = np.unpackbits(self.planes[p][b * (BLOCK // 8) : (b + 1) * (BLOCK // 8)])[: self.n - b * BLOCK]
        return b * BLOCK + int(np.flatnonzero(bits == bit)[j - int(before[b])])

    def access(self, i: int) -> int:
        v = 0
        for p, z in enumerate(self.zeros):
            bit = self._bit(p, i)
            r = self._rank1(p, i)
            v, i = v << 1 | bit, z + r if bit else i - r
        return v

    def _walk(self, token: int, i: int) -> tuple[int, int]:
        lo, hi, depth = 0, i, len(self.planes)
        if token >> depth:
            return 0, 0
        for p, z in enumerate(self.zeros):
            a, b = self._rank1(p, lo), self._rank1(p, hi)
            lo, hi = (z + a, z + b) if token >> (depth - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences before place i."""
        lo, hi = self._walk(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, j: int) -> int:
        """Place of the j-th (from 0) occurrence; IndexError beyond the last."""
        lo, hi = self._walk(token, self.n)
        if not 0 <= j < hi - lo:
            raise IndexError(j)
        i, depth = lo + j, len(self.planes)
        for p in range(depth - 1, -1, -1):
            i = self._select(p, 1, i - self.zeros[p]) if token >> (depth - 1 - p) & 1 else self._select(p, 0, i)
        return i

    def tokens(self) -> np.ndarray:
        """The whole sequence: places follow the planes down, in runs of equal leading bits, and at last each run knows its id."""
        at = np.arange(self.n, dtype=np.uint32 if self.n < 1 << 32 else np.uint64)
        starts, ids = np.zeros(1, np.int64), np.zeros(1, np.uint32)
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            bit = np.unpackbits(plane, count=self.n).view(bool)
            one = np.flatnonzero(bit)
            before = np.searchsorted(one, starts)  # ones before each run
            ones = np.diff(before, append=len(one))
            has0, has1 = np.diff(starts, append=self.n) > ones, ones > 0
            at = np.concatenate([at.take(np.flatnonzero(~bit)), at.take(one)])
            starts = np.concatenate([(starts - before)[has0], zeros + before[has1]])
            ids = np.concatenate([ids[has0] << 1, ids[has1] << 1 | 1])
        out = np.empty(self.n, np.uint32)
        if self.n:
            out[at] = np.repeat(ids, np.diff(starts, append=self.n))
        return out


def dumps(m: WaveletMatrix, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    z = zstandard.ZstdCompressor(level=1)
    parts = [z.compress(np.array([d is None for d in doc_ids], np.uint8).tobytes()), z.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes()), z.compress(np.array(lengths, "<i8").tobytes())]
    for p, o in zip(m.planes, m.ones, strict=True):
        parts += [z.compress(p.tobytes()), z.compress(o.astype("<u4").tobytes())]
    head = json.dumps({"n": m.n, "planes": len(m.planes), "docs": len(doc_ids), "parts": [len(p) for p in parts]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts])


def loads(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    if data[:8] != MAGIC:
        raise ValueError("not a wavelet shard")
    (k,) = struct.unpack_from("<I", data, 8)
    head, at = json.loads(data[12 : 12 + k]), 12 + k
    z, raw = zstandard.ZstdDecompressor(), []
    for n in head["parts"]:
        raw.append(z.decompress(data[at : at + n]))
        at += n
    null = np.frombuffer(raw[0], np.uint8)
    ids = [None if x else int(d) for x, d in zip(null, np.frombuffer(raw[1], "<i8"), strict=True)]
    planes = [np.frombuffer(x, np.uint8) for x in raw[3::2]]
    ones = [np.frombuffer(x, "<u4") for x in raw[4::2]]
    return WaveletMatrix(head["n"], planes, ones), ids, np.frombuffer(raw[2], "<i8")


MANIFEST = "path string, part long, shard long, n_tokens long, n_docs long"


def write_shards(docs: DataFrame, folder: str, vocabulary: str = "byte_bpe_50k.json", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes documents, in ascending doc_id order over all shards, and returns the manifest, already written."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()  # partitions are ranges of doc_id, in order
        end = np.array([END], "<u4").tobytes()
        ids, lengths, held, size, shard = [], [], [], 0, 0
        schema = pa.schema([("path", pa.string()), ("part", pa.int64()), ("shard", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())])

        def flush() -> pa.RecordBatch:
            data = dumps(WaveletMatrix.build(np.frombuffer(b"".join(held), "<u4")), ids, lengths)
            path = f"{folder}/{uuid.uuid4().hex}.qswm"
            fs_, p = pafs.FileSystem.from_uri(path)
            fs_.create_dir(p.rsplit("/", 1)[0], recursive=True)
            with fs_.open_output_stream(p) as f:
                f.write(data)
            return batch(schema, [[path], [part], [shard], [size], [len(ids)]])

        for whole in it:
            for b in pieces(whole):
                for d, got in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                    ids.append(d)
                    lengths.append(len(got) // 4 + 1)
                    held += [got, end]
                    size += lengths[-1]
                    if size >= shard_tokens:
                        yield flush()
                        ids, lengths, held, size, shard = [], [], [], 0, shard + 1
        if ids:
            yield flush()

    spark = docs.sparkSession
    ranged = docs.select("doc_id", "text").repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return settled(map_rows(ranged, ["doc_id", "text"], run, MANIFEST), "wavelet-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    spark = manifest.sparkSession
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select(F.col("part").alias("of"), before(W.orderBy("part")).alias("base"))  # a row per partition that wrote
    own = manifest.select("path", "part", before(W.partitionBy("part").orderBy("shard")).alias("inner"))
    placed = own.join(parts, F.col("part") == F.col("of")).select("path", (F.col("base") + F.col("inner")).alias("start"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for path, start in zip(*(b.column(c).to_pylist() for c in ("path", "start")), strict=True):
                fs, p = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(p) as f:
                    m, ids, lengths = loads(f.read())
                data = memoryview(m.tokens().astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield batch(schema, [ids, pa.array(start + ends - lengths), pa.array(lengths.astype(np.int64)), crc])

    return placed.repartition(2 * partitions(spark), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(table(spark, sf_dir, "documents"), fresh_path(spark, "wavelet")))
