"""WARC archives: records of captures, and the transactions they make.

write_archives() stores each page as a request, a response (or a revisit of an earlier equal payload) and a
metadata record; read_records() reads archives back; assemble() joins the records of a transaction by their
concurrent-to identifiers into one nested row per capture.

Files get names of their own and a manifest, written by Spark, lists those that count.

Defined cases: a null html is an empty payload, and empty payloads count as equal; of repeated rows with
one page_id and payload each is a capture of its own and all that carry the smallest page_id are responses;
a null page_id is never the smallest unless all are null, then all are responses; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, encoded, fresh_path, map_rows, partitions, settled, table

ARCHIVE_BYTES = 32 << 20
CHUNK = 8192
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("target_uri", pa.string()), ("page_id", pa.int64()),
    ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("computed_digest", pa.string()), ("payload", pa.binary()),
])
RECORD_DDL = "record_id string, record_type string, concurrent_to array<string>, target_uri string, page_id long, refers_to long, digest string, payload_bytes long, computed_digest string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record, uncompressed."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", *(f"{k}: {_clean(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _host(url: str) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url)
    return m[1] if m else ""


def capture(page_id: int | None, url: str | None, payload: bytes, first: int | None, new_id) -> list[bytes]:
    """Records of one page. first: the page that this one revisits."""
    url, main = url or "", new_id()
    d = digest(payload)
    target = [("WARC-Target-URI", url), *([("X-Page-Id", str(page_id))] if page_id is not None else [])]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [*target, ("WARC-Payload-Digest", f"sha1:{d}"), ("Content-Type", "application/http; msgtype=response")]
    if first is None:
        answer = record("response", main, head, http + payload)
    else:
        answer = record("revisit", main, [*head, ("WARC-Profile", REVISIT), ("X-Refers-To-Page", str(first))], http)
    ask = f"GET {url} HTTP/1.1\r\nHost: {_host(url)}\r\n\r\n".encode("utf-8", "replace")
    request = record("request", new_id(), [*target, ("WARC-Concurrent-To", f"<{main}>"), ("Content-Type", "application/http; msgtype=request")], ask)
    about = record("metadata", new_id(), [*target, ("WARC-Concurrent-To", f"<{main}>"), ("Content-Type", "application/warc-fields")], b"fetchTimeMs: 0\r\nbytes: %d\r\n" % len(payload))
    return [request, answer, about]


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """pages: page_id, url, html, first (the page it revisits or null). Returns the manifest, already written."""
    schema = pa.schema([("path", pa.string()), ("n_records", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0

        def start() -> str:
            return uuid.uuid4().hex

        name = start()

        def flush() -> pa.RecordBatch:
            path = f"{folder}/{name}.warc.gz"
            fs, p = pafs.FileSystem.from_uri(path)
            fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
            info = record("warcinfo", f"urn:uuid:{uuid.UUID(name)}", [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            with fs.open_output_stream(p, compression=None) as f:
                f.write(b"".join([member(info), *held]))
            return batch(schema, [[path], [n]])

        def new_id() -> str:
            nonlocal n
            n += 1
            return f"urn:uuid:{uuid.UUID(hashlib.md5(f'{name}:{n}'.encode()).hexdigest())}"

        for b in it:
            for page, url, html, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                for r in capture(page, url, encoded(html), first, new_id):
                    held.append(member(r))
                    size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held, size, n, name = [], 0, 0, start()
        if held:
            yield flush()

    return settled(map_rows(pages, ["page_id", "url", "html", "first"], run, "path string, n_records long"), "warc-manifest")


def parse(data: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (names in lower case) and block of each record, gzip member by member or plain."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\x1f\x8b":
            z, out, view = zlib.decompressobj(31), [], memoryview(data)
            while not z.eof and at < len(data):  # in chunks: what follows a member is copied at its end
                out.append(z.decompress(view[at : at + CHUNK]))
                at += CHUNK
            if not z.eof:
                raise ValueError("a member is cut short")
            at = min(at, len(data)) - len(z.unused_data)
            one = b"".join(out)
            yield from _plain(one)
        else:
            yield from _plain(data[at:])
            return


def _plain(data: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    f = io.BytesIO(data)
    while True:
        line = f.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers: dict[str, list[str]] = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers.setdefault(k.strip().lower(), []).append(v.strip())
        yield headers, f.read(int(headers["content-length"][0]))


def read_bytes(path: str) -> bytes:
    fs, p = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(p, compression=None) as f:
        return f.read()


def read_records(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """A row per record of the archives at `path`; without payloads, their lengths and digests only."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for path in b.column("path").to_pylist():
                out: list[list] = [[] for _ in RECORD]
                for h, block in parse(read_bytes(path)):
                    kind = h["warc-type"][0]
                    one = lambda k, h=h: h.get(k, [None])[0]
                    body = block.partition(b"\r\n\r\n")[2] if kind in ("response", "revisit", "request") else block
                    full = kind == "response"
                    d = one("warc-payload-digest")
                    row = (
                        h["warc-record-id"][0].strip("<>"), kind, [x.strip("<>") for x in h.get("warc-concurrent-to", [])], one("warc-target-uri"),
                        int(one("x-page-id")) if one("x-page-id") else None, int(one("x-refers-to-page")) if one("x-refers-to-page") else None,
                        d.rpartition(":")[2] if d else None, len(body) if kind != "revisit" else None, digest(body) if full else None, body if payloads and kind != "revisit" else None,
                    )
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                yield batch(RECORD, out)

    return manifest.select("path").repartition(2 * partitions(manifest.sparkSession), "path").mapInArrow(run, RECORD_DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, answer (response or revisit), request, metadata (structs, null where missing).

    Records point at the answer's identifier by concurrent-to; an answer may also point at its request.
    """
    kinds = records.filter(F.col("record_type").isin("response", "revisit", "request", "metadata"))
    answer = F.col("record_type").isin("response", "revisit")
    keyed = kinds.withColumn("capture_id", F.when(answer | (F.size("concurrent_to") < 1), F.col("record_id")).otherwise(F.element_at("concurrent_to", 1)))
    row = F.struct(*[c for c in RECORD.names if c != "concurrent_to"])
    pick = lambda cond: F.max(F.when(cond, row))
    return keyed.groupBy("capture_id").agg(pick(answer).alias("answer"), pick(F.col("record_type") == "request").alias("request"), pick(F.col("record_type") == "metadata").alias("metadata"))


def with_firsts(pages: DataFrame) -> DataFrame:
    """page_id, url, html and first: the smallest page_id of an equal payload if that's another page."""
    p = pages.select("page_id", "url", "html")
    sha = F.sha1(F.encode(F.coalesce("html", F.lit("")), "utf-8"))
    slim = p.select(F.col("page_id").alias("pid"), sha.alias("sha")).distinct()
    least = slim.groupBy("sha").agg(F.min("pid").alias("least")).withColumnRenamed("sha", "sha2")
    firsts = slim.join(least, F.col("sha") == F.col("sha2")).filter(F.col("least").isNotNull() & ~F.col("pid").eqNullSafe(F.col("least"))).select("pid", "sha", "least")
    firsts = settled(firsts, "warc-firsts")  # revisits only
    return p.withColumn("own", sha).join(firsts, F.col("page_id").eqNullSafe(F.col("pid")) & (F.col("own") == F.col("sha")), "left").select("page_id", "url", "html", F.col("least").alias("first"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_firsts(table(spark, sf_dir, "pages"))
    records = read_records(write_archives(pages, fresh_path(spark, "warc")), payloads=False)
    got = settled(assemble(records), "warc-captures")
    stored = got.filter("answer.record_type = 'response'").groupBy(F.col("answer.computed_digest").alias("d")).agg(F.max("answer.payload_bytes").alias("n"))
    return got.join(stored, F.col("answer.digest") == F.col("d"), "left").select(
        F.col("answer.page_id").alias("page_id"), F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"), F.col("answer.record_type").alias("record_type"),
        F.col("answer.refers_to").alias("refers_to"),
    )


OP10_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h FROM p),
x AS (SELECT *, range(0, 32) AS ix, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(ix, lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
         (instr('0123456789abcdef', substr(h, CAST((5 * i) // 4 + 1 AS BIGINT), 1)) - 1) * 256
         + (instr('0123456789abcdef', substr(h || '0', CAST((5 * i) // 4 + 2 AS BIGINT), 1)) - 1) * 16) // CAST(pow(2, 12 - 5 - (5 * i) % 4) AS BIGINT) % 32 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM x
"""
