"""Secret scans with structural confirmation.

Base spans come from three patterns. Longer base64, hex and dotted candidates are then decoded and only
reported if their structure holds: ASN.1 keys whose nested lengths add up at every depth, the binary container that
begins with "openssh-key-v1", PEM blocks with such a body or with the headers of an encrypted one, and signed tokens whose header is JSON with "alg".

Defined cases: a null text is an empty one and has no spans; an empty table gives an empty result;
repeated rows each get a row; spans are in code points, the end exclusive; of spans that begin together the kind in the order
of KINDS comes first; very long texts are read whole; further columns aren't read.

Time grows with a text's length: a run of characters is decoded once for each of the four places that a key may begin at,
and what follows from a place in it (its element, whether that holds together, where the next one begins) is found once, whoever asks.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch, map_rows, pieces, table

#: Kinds in the order that breaks ties of spans with one start.
KINDS = ("assign", "access", "hex", "pem", "openssh", "der_base64", "der_hex", "token")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Lines of an encoded block, broken at one width: each but the last is full.
BLOCK = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
#: Either alphabet; what stands before the key in the same run of characters is passed over.
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
#: How encoded keys begin: a SEQUENCE with a length in one, two or more bytes, or the container's name.
BEGINS = re.compile(r"M[A-P]|b3BlbnNz")
LINE = re.compile(r"\S+")
HEAD = re.compile(r"-----BEGIN ([A-Z0-9 ]*)KEY-----")
BODY = re.compile(r"[A-Za-z0-9+/=\s:,-]*")
BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
ANYHEX = re.compile(r"[0-9A-Fa-f]{40,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
OPENSSH = b"openssh-key-v1\0"
#: ASN.1 tags that may stand inside a key: the types that the key formats name.
TAGS = {0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x0C, 0x13, 0x16, 0x17, 0x18, 0x30, 0x31}


class Chains:
    """Places of a byte string, each of which leads to the next one behind its element or ends there.

    step(p) gives (next, begin of its inner chain or None, its own mark) or None where no element stands; a place is found to lead on only if its inner
    chain runs into the next place exactly. Places are worked out once, those to the right first; each also keeps a far place on its chain, so
    that whether two places are on one chain takes a logarithm of its length.
    """

    def __init__(self, data: bytes) -> None:
        self.data, none = data, array("i", [-1]) * (len(data) + 1)
        self.next, self.far, self.depth, self.marks, self.inner_marks = none, none[:], none[:], none[:], none[:]

    def step(self, p: int) -> tuple[int, int | None, bool] | None:
        raise NotImplementedError

    def _end(self, p: int) -> None:
        self.next[p] = self.far[p] = p
        self.depth[p] = self.marks[p] = self.inner_marks[p] = 0

    def know(self, p: int) -> None:
        todo, following = [p], self.next
        while todo:
            p = todo[-1]
            if following[p] >= 0:
                todo.pop()
                continue
            found = self.step(p)
            if found is None:
                self._end(p)
                continue
            q, c, mark = found
            if following[q] < 0:
                todo.append(q)
                continue
            if c is not None:
                if following[c] < 0:
                    todo.append(c)
                    continue
                if not self.meets(c, q):
                    self._end(p)
                    continue
            far, depth = self.far, self.depth
            following[p], depth[p] = q, depth[q] + 1
            f = far[q]
            far[p] = far[f] if depth[q] - depth[f] == depth[f] - depth[far[f]] else q
            self.marks[p] = self.marks[q] + mark
            self.inner_marks[p] = self.inner_marks[q] + (mark or (c is not None and self.data[p] == 0x30 and self.marks[c] > self.marks[q]))

    def meets(self, p: int, q: int) -> bool:
        """Whether the chain from p, which is known, comes to q."""
        while p < q:
            f = self.far[p]
            if f <= p:
                return False
            p = f if f <= q else self.next[p]
        return p == q

    def after(self, p: int, steps: int) -> int | None:
        """The place so many elements on from p."""
        self.know(p)
        target = self.depth[p] - steps
        while target >= 0 and self.depth[p] > target:
            f = self.far[p]
            p = f if self.depth[f] >= target else self.next[p]
        return p if target >= 0 else None


class Der(Chains):
    """ASN.1 elements: tags that keys have, lengths in their shortest form, and constructed ones filled exactly. Marks: INTEGER and OBJECT IDENTIFIER."""

    def step(self, p: int) -> tuple[int, int | None, bool] | None:
        data, end = self.data, len(self.data)
        if p + 2 > end:
            return None
        tag, n, at = data[p], data[p + 1], p + 2
        if tag & 0xC0 != 0x80 and tag not in TAGS:
            return None
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end or data[at] == 0:
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
            if n < 0x80:
                return None
        if at + n > end:
            return None
        return at + n, at if tag & 0x20 and n else None, tag in (0x02, 0x06)

    def key_at(self, p: int, size: int) -> bool:
        """One SEQUENCE of that size whose inner lengths add up, holding at least two elements, an INTEGER or an OBJECT IDENTIFIER among them or theirs."""
        found = self.step(p) if size >= 24 and self.data[p] == 0x30 else None
        if not found or found[0] != p + size or found[1] is None:
            return False
        q, c, _ = found
        self.know(c)
        self.know(q)
        return self.meets(c, q) and self.depth[c] - self.depth[q] >= 2 and self.inner_marks[c] > self.inner_marks[q]


class Strings(Chains):
    """Strings with their lengths in four bytes before them."""

    def step(self, p: int) -> tuple[int, int | None, bool] | None:
        q = p + 4 + int.from_bytes(self.data[p : p + 4], "big")
        return (q, None, False) if p + 4 <= len(self.data) and q <= len(self.data) else None

    def container_at(self, p: int) -> tuple[bool, int | None]:
        """Of the container whose name stands at p: whether its cipher, kdf and options are there, and where it ends if all the keys that it counts are."""
        at = self.after(p + len(OPENSSH), 3) if p + len(OPENSSH) <= len(self.data) else None
        if at is None or at + 8 > len(self.data):
            return False, None
        return True, self.after(at + 4, int.from_bytes(self.data[at : at + 4], "big") + 1)


def is_key(data: bytes) -> bool:
    return data[:1] == b"\x30" and Der(data).key_at(0, len(data))


def is_openssh(data: bytes) -> bool:
    """After the magic come length-prefixed strings: cipher, kdf, kdf options, a count, public keys."""
    return data.startswith(OPENSSH) and Strings(data).container_at(0)[0]


def unbase64(s: str) -> bytes | None:
    """Of either alphabet."""
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def key_kind(data: bytes | None) -> str | None:
    if data is None:
        return None
    return "openssh" if is_openssh(data) else "der" if is_key(data) else None


def is_encrypted(block: str) -> bool:
    """A traditional PEM body whose headers name its cipher: ciphertext follows in whole bytes, of which no structure shows."""
    m = re.fullmatch(r"\s*Proc-Type:\s*4,\s*ENCRYPTED\s*?\n\s*DEK-Info:\s*[A-Z0-9-]+,\s*(?:[0-9A-Fa-f]{2})+\s*?\n(.*)", block, re.S)
    body = unbase64(re.sub(r"\s", "", m[1])) if m else None
    return bool(body) and len(body) >= 16


class Decoded:
    """A run of base64 of either alphabet, decoded from each of the four places that a key in it may begin at, and what is known of the bytes."""

    def __init__(self, s: str) -> None:
        self.s, self.size = s, len(s.rstrip("="))
        self.kinds: dict[tuple[type, int], Chains] = {}

    def chains(self, kind: type, phase: int) -> Chains:
        if (kind, phase) not in self.kinds:
            end = self.size - ((self.size - phase) % 4 == 1)
            self.kinds[kind, phase] = kind(unbase64(self.s[phase:end]) or b"")
        return self.kinds[kind, phase]

    def fitting(self, at: int) -> tuple[str, int] | None:
        """Kind and end of the key whose base64 begins at `at`, whatever else follows it in the run."""
        s, phase = self.s, at % 4
        head = unbase64(s[at : at + 28][: (min(28, self.size - at) // 4) * 4])
        if not head or len(head) < 6:
            return None
        place = (at - phase) // 4 * 3
        if head.startswith(OPENSSH):
            if int.from_bytes(head[len(OPENSSH) : len(OPENSSH) + 4], "big") > len(s):  # the first string's length
                return None
            found, stop = self.chains(Strings, phase).container_at(place)
            if not found:
                return None
            end = at + -(-(stop - place) * 4 // 3) if stop is not None else len(s) - ((self.size - at) % 4 == 1)
            kind = "openssh"
        else:
            n, k = head[1], head[1] & 0x7F
            if head[0] != 0x30 or n == 0x80 or (n > 0x80 and k > 4):
                return None
            size = 2 + n if n < 0x80 else 2 + k + int.from_bytes(head[2 : 2 + k], "big")
            inner = head[2 if n < 0x80 else 2 + k]
            end = at + -(-size * 4 // 3)
            if (inner not in TAGS and inner & 0xC0 != 0x80) or size < 24 or end > self.size or not self.chains(Der, phase).key_at(place, size):
                return None
            kind = "der"
        while end < len(s) and s[end] == "=":
            end += 1
        return kind, end


def encoded_keys(text: str) -> list[tuple[int, int, int]]:
    """Keys in base64 of either alphabet: in one run of characters, even glued to others, or broken over lines."""
    out: list[tuple[int, int, int]] = []
    for m in ENCODED.finditer(text):
        free, run = 0, None
        for b in BEGINS.finditer(m[0]):
            run = run or Decoded(m[0])
            if b.start() >= free and (found := run.fitting(b.start())):
                out.append((m.start() + b.start(), _index(found[0]), m.start() + found[1]))
                free = found[1]
    for m in BLOCK.finditer(text):
        if not BEGINS.search(m[0]):
            continue
        lines = [(x.start() + m.start(), x.end() - x.start()) for x in LINE.finditer(m[0])]
        begins = list(accumulate((n for _, n in lines), initial=0))  # of the lines, in what they make together
        run, free = Decoded("".join(text[a : a + n] for a, n in lines)), 0
        for (a, _), k in zip(lines, begins, strict=False):
            if k >= free and BEGINS.match(run.s, k) and (found := run.fitting(k)):
                last = bisect_left(begins, found[1]) - 1
                out.append((a, _index(found[0]), lines[last][0] + found[1] - begins[last]))
                free = found[1]
    return out


def pem_blocks(text: str) -> list[tuple[int, int, int]]:
    """Each end marker with the last begin marker before it, if they are of one kind and a key stands between."""
    out: list[tuple[int, int, int]] = []
    at = text.find("-----BEGIN ")
    end = text.find("-----END ")
    while at >= 0:
        after = text.find("-----BEGIN ", at + 11)
        if 0 <= end < at:
            end = text.find("-----END ", at)
        if end < 0:
            break
        m = HEAD.match(text, at) if after < 0 or end < after else None
        if m and m.end() <= end and text.startswith(f"-----END {m[1]}KEY-----", end) and BODY.fullmatch(text, m.end(), end):
            block = text[m.end() : end]
            if key_kind(unbase64(re.sub(r"\s", "", re.sub(r"^[A-Za-z-]+:.*$", "", block, flags=re.M)))) or is_encrypted(block):
                out.append((at, 3, end + len(m[1]) + 17))
        at = after
    return out


def _index(kind: str, der: str = "der_base64") -> int:
    return KINDS.index("openssh" if kind == "openssh" else der)


def is_token_header(part: str) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and confirmed spans, each (start, kind's index, end)."""
    base, more = [], []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "apikey", "api_key")):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    long = any(len(w) >= 20 for w in text.split())  # each candidate below has 20 characters or more without a blank
    if long:
        base += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    if "-----BEGIN " in text:
        more += pem_blocks(text)
    if long:
        found = {x for x in encoded_keys(text) if not any(s < x[2] and x[0] < e for s, _, e in more)}  # more: PEM so far
        for m in BASE64.finditer(text):
            kind = key_kind(unbase64(m[0]))
            if kind:
                found.add((m.start(), _index(kind), m.end()))
        last = 0
        for x in sorted(found, key=lambda x: (x[0], -x[2])):  # the first line of a container is no key beside the whole
            if x[2] > last:
                more.append(x)
                last = x[2]
        for m in ANYHEX.finditer(text):
            s = m[0]
            if len(s) % 2 == 0 and s[:2] in ("30", "6f", "6F") and (kind := key_kind(bytes.fromhex(s))):
                more.append((m.start(), _index(kind, "der_hex"), m.end()))
        if "." in text:
            for m in TOKEN.finditer(text):
                if is_token_header(m[0].split(".", 1)[0]):
                    more.append((m.start(), KINDS.index("token"), m.end()))
    return sorted(base), sorted(more)


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_confirmed", pa.int64())])


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document with its spans and their counts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in pieces(whole):
                out: list[list] = [[] for _ in ARROW]
                for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    base, more = spans(t or "")
                    kinds = [k for _, k, _ in base]
                    row = (d, *map(kinds.count, (0, 1, 2)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + more)), len(more))
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                yield batch(ARROW, out)

    return map_rows(docs, ["doc_id", "text"], run, SCHEMA)


def masked(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span replaced; overlapping spans become one mark."""
    base, more = spans(text)
    out, at = [], 0
    for s, _, e in sorted(base + more):
        if s >= at:
            out += [text[at:s], mark]
            at = e
        else:
            at = max(at, e)
    return "".join([*out, text[at:]])


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
