"""Media columns: lossless WebP.

decode() reads any lossless stream: prefix codes, back-references, colour cache, groups of codes by region,
and the inverse predictor, cross-colour, green and palette transforms. Images of one group of codes without
a cache are decoded by array operations. store() writes a payload as grey samples of 8 bits, a row for each 576
bytes: green transform, palette of the values that occur, back-references and prefix codes from the counts of
symbols. encode() writes pixels with chosen transforms, cache and back-references.

Defined cases of the text query: a null text is an empty one and becomes one block of 576 bytes 255;
repeated rows and equal texts each get a row with equal values; further columns aren't read; an empty table
gives an empty result. An image has at most 16384 x 16384 pixels; payloads of more than 16384 rows get wider ones.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch, encoded, map_rows, pieces, table

UNIT, MOST = 576, 16384
#: Fixed values of the format: order of code-length codes, and offsets (x, y) of the 120 short distance codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
#: Bytes of a stream that are looked up at once, pixels among which repeats are sought, and least length of one.
SPAN, NEARBY, REPEAT = 1 << 12, 1 << 19, 8
CACHE_MULT = 0x1E35A7BD
MIX, PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(NEARBY - 1)
EIGHT = np.arange(8)


class Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def peek(self) -> int:
        """At least 25 bits, zeros beyond the end."""
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 4], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError("the stream ends early")
        v = self.peek() & ((1 << n) - 1)
        self.at += n
        return v


@lru_cache(None)
def _reversed(depth: int) -> np.ndarray:
    """All numbers of `depth` bits with their bits reversed."""
    i = np.arange(1 << depth)
    return sum((i >> k & 1) << (depth - 1 - k) for k in range(depth))


class Code:
    """A canonical prefix code as a table over its longest length."""

    def __init__(self, lengths: bytes | bytearray) -> None:
        n = np.frombuffer(lengths, np.uint8)
        used = n.nonzero()[0]
        self.only = int(used[0]) if len(used) == 1 else 0 if not len(used) else None
        self.depth, self._table = 0, None
        if self.only is not None:
            self.lens, self.syms = np.zeros(1, np.int64), np.full(1, self.only, np.int64)
            return
        n = n[used].astype(np.int64)
        order = n.argsort(kind="stable")
        n = n[order]
        self.depth = int(n[-1])
        times = 1 << (self.depth - n)
        if times.sum() != 1 << self.depth:
            raise ValueError("the prefix code isn't complete")
        place = _reversed(self.depth)
        self.syms = used[order].repeat(times)[place]
        self.lens = n.repeat(times)[place]

    def table(self) -> list[int]:
        """Symbol << 4 | bits."""
        if self._table is None:
            self._table = (self.syms << 4 | self.lens).tolist()
        return self._table

    def next(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        v = self.table()[bits.peek() & ((1 << self.depth) - 1)]
        bits.at += v & 15
        return v >> 4


@lru_cache(4096)
def _one(symbol: int) -> Code:
    return Code(b"\0" * symbol + b"\1")


def read_code(bits: Bits, alphabet: int) -> Code:
    head = bits.peek()
    if head & 1:
        wide = head >> 2 & 1
        first = head >> 3 & (255 if wide else 1)
        bits.read(4 + 7 * wide)
        if not head & 2:
            return _one(first)
        lengths = bytearray(max(256, alphabet))
        lengths[first] = lengths[bits.read(8)] = 1
        return Code(lengths)
    bits.read(1)
    own, many = bytearray(19), 4 + bits.read(4)
    v = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 9], "little") >> (bits.at & 7)
    for s in LENGTH_ORDER[:many]:
        own[s] = v & 7
        v >>= 3
    bits.read(3 * many)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    lengths, code, before = bytearray(), Code(own), 8
    # What follows fits in the bits of all lengths, each with its extra bits.
    at = bits.at
    window = int.from_bytes(bits.data[at >> 3 : (at >> 3) + 2 * alphabet + 8], "little") >> (at & 7)
    table, mask, only, taken = code.table(), (1 << code.depth) - 1, code.only, 0
    while len(lengths) < alphabet and most:
        most -= 1
        if only is None:
            v = table[window & mask]
            n, k = v >> 4, v & 15
            window >>= k
            taken += k
        else:
            n = only
        if n < 16:
            lengths.append(n)
            before = n or before
            continue
        extra, base = (2, 3) if n == 16 else (3, 3) if n == 17 else (7, 11)
        lengths += bytes([before if n == 16 else 0]) * (base + (window & ((1 << extra) - 1)))
        window >>= extra
        taken += extra
        if len(lengths) > alphabet:
            raise ValueError("code lengths run over")
    bits.read(taken)
    return Code(lengths)


def _value(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB values (uint32) of one entropy-coded image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, regions, shift = 1, None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        regions = (read_pixels(bits, -(-width >> shift), -(-height >> shift), False) >> 8 & 0xFFFF).tolist()
        groups = max(regions) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_code(bits, n) for n in sizes] for _ in range(groups)]
    total = width * height
    if groups == 1 and not cache_bits and (codes[0][0].only or 0) < 256:
        return _by_arrays(bits, codes[0], total, width)
    out: list[int] = []
    cache, per_row = [0] * (1 << cache_bits), -(-width >> shift) if shift else 0
    cached = 0
    while len(out) < total:
        at = len(out)
        green, red, blue, alpha, dist = codes[regions[(at // width >> shift) * per_row + (at % width >> shift)] if regions else 0]
        s = green.next(bits)
        if s < 256:
            r, b = red.next(bits), blue.next(bits)
            out.append(alpha.next(bits) << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            n = _value(bits, s - 256)
            back = _distance(_value(bits, dist.next(bits)), width)
            if back > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            for i in range(at, at + n):
                out.append(out[i - back])
        else:
            while cached < at:
                cache[(CACHE_MULT * out[cached] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[cached]
                cached += 1
            out.append(cache[s - 280])
        if bits.at > 8 * len(bits.data):
            raise ValueError("the stream ends early")
    return np.array(out, np.uint32)


def _extra(prefix: np.ndarray) -> np.ndarray:
    """Extra bits of length and distance symbols."""
    return np.where(prefix < 4, 0, (prefix - 2) >> 1)


def _values(prefix: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Lengths and distance codes of prefix symbols and their extra bits."""
    n = _extra(prefix)
    return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << n) + (more & ((1 << n) - 1)) + 1)


def _by_arrays(bits: Bits, codes: list[Code], total: int, width: int) -> np.ndarray:
    """Pixels of one group of codes without a cache.

    Where a pixel or back-reference would end is found for each bit of the stream at once, by table; following these ends
    from the first gives the true ones, whose symbols are then read together. Codes of one symbol take no bits.
    """
    green, red, blue, alpha, dist = codes
    varied = [(c, shift) for c, shift in ((red, 16), (blue, 0), (alpha, 24)) if c.only is None]
    fixed = sum(c.only << shift for c, shift in ((red, 16), (blue, 0), (alpha, 24)) if c.only is not None)
    if green.only is not None and not varied:
        return np.full(total, fixed | green.only << 8, np.uint32)
    copying = bool((green.syms >= 256).any())
    most = max(green.depth + sum(c.depth for c, _ in varied), (green.depth + dist.depth + 28) * copying)  # bits of a pixel
    both = green.syms << 4 | green.lens
    end, at, made = 8 * len(bits.data), bits.at, 0
    literals, spots, copied = [], [], []
    while made < total:
        if at >= end:
            raise ValueError("the stream ends early")
        lo = at >> 3
        n = min(SPAN, (end - at >> 3) + 1, ((total - made) * most >> 3) + 9)
        raw = np.zeros(n + 24, np.int64)
        part = np.frombuffer(bits.data, np.uint8, min(n + 24, len(bits.data) - lo), lo)
        raw[: len(part)] = part
        five = raw[:-4] | raw[1:-3] << 8 | raw[2:-2] << 16 | raw[3:-1] << 24 | raw[4:] << 32
        last = 8 * len(five) - 1
        ahead = lambda p, five=five: five[p >> 3] >> (p & 7)  # noqa: E731  33 bits or more from a place
        look = lambda table, code, p, ahead=ahead: table[ahead(p) & ((1 << code.depth) - 1)]
        found = both[((five[:, None] >> EIGHT) & ((1 << green.depth) - 1)).reshape(-1)]  # symbol and bits, were a code to begin here
        to = found & 15
        to += np.arange(last + 1)
        np.minimum(to, last, out=to)
        for c, _ in varied:
            to = np.minimum(to + look(c.lens, c, to), last)
        if copying:
            back = (found >= 256 << 4).nonzero()[0]
            p = back + (found[back] & 15)
            p = np.minimum(p + _extra((found[back] >> 4) - 256), last)
            to[back] = np.minimum(p + look(dist.lens, dist, p) + _extra(look(dist.syms, dist, p)), last)
        # Jumps over 1, 2, 4, 8 and 16 symbols: the longest are followed, the shorter fill in between.
        jumps = [to]
        for _ in range(4):
            jumps.append(jumps[-1][jumps[-1]])
        far, starts, p, stop = memoryview(jumps[-1]), [], at - 8 * lo, 8 * n
        while p < stop:
            starts.append(p)
            p = far[p]
        s = np.array(starts)
        for j in reversed(jumps[:-1]):
            some, s = s, np.empty(2 * len(s), np.int64)
            s[::2], s[1::2] = some, j[some]
        s = s[s < stop]
        kind = found[s]
        p1 = s + (kind & 15)
        kind >>= 4
        copies = kind >= 256
        many = copying and copies.any()
        if many:
            count = np.ones(len(s), np.int64)
            count[copies] = _values(kind[copies] - 256, ahead(p1[copies]))
            where = made + np.cumsum(count) - count
        else:
            where = np.arange(made, made + len(s))
        if where[-1] >= total:  # bits that fill the last byte aren't pixels
            keep = where < total
            s, kind, p1, copies, where = (x[keep] for x in (s, kind, p1, copies, where))
            count = count[keep] if many else None
            many = many and copies.any()
        plain = ~copies if many else slice(None)
        v, p = fixed | kind[plain] << 8, p1[plain]
        for c, shift in varied:
            v |= look(c.syms, c, p) << shift
            p = p + look(c.lens, c, p)
        literals.append(v), spots.append(where[plain])
        if many:
            p = p1[copies] + _extra(kind[copies] - 256)
            d = look(dist.syms, dist, p)
            copied += zip(where[copies].tolist(), count[copies].tolist(), _values(d, ahead(p + look(dist.lens, dist, p))).tolist(), strict=True)
        made = int(where[-1]) + (int(count[-1]) if many else 1)
        at = 8 * lo + int(to[s[-1]])
        if at > end:
            raise ValueError("the stream ends early")
    bits.at = at
    out = np.empty(total, np.uint32)
    out[np.concatenate(spots)] = np.concatenate(literals)
    for a, n, code in copied:
        d = _distance(code, width)
        if d > a or a + n > total:
            raise ValueError("a back-reference leaves the image")
        out[a : a + n] = out[a - d : a - d + n] if d >= n else out[a - 1] if d == 1 else out[a - d + np.arange(n) % d]
    return out


def _channels(argb: np.ndarray) -> list[np.ndarray]:
    return [(argb >> s & 255).astype(np.int32) for s in (24, 16, 8, 0)]


def _joined(a, r, g, b) -> np.ndarray:
    return (a.astype(np.uint32) & 255) << 24 | (r.astype(np.uint32) & 255) << 16 | (g.astype(np.uint32) & 255) << 8 | (b.astype(np.uint32) & 255)


def _add(x: int, y: int) -> int:
    return (x & 0xFF00FF00) + (y & 0xFF00FF00) & 0xFF00FF00 | (x & 0x00FF00FF) + (y & 0x00FF00FF) & 0x00FF00FF


def _avg(x: int, y: int) -> int:
    return (((x ^ y) & 0xFEFEFEFE) >> 1) + (x & y)


def _parts(x: int) -> tuple[int, int, int, int]:
    return x >> 24, x >> 16 & 255, x >> 8 & 255, x & 255


def _clamped(values) -> int:
    v = 0
    for x in values:
        v = v << 8 | max(0, min(255, x))
    return v


def predict(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """right: above and to the right; corner: above and to the left."""
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return _avg(_avg(left, right), top)
        case 6:
            return _avg(left, corner)
        case 7:
            return _avg(left, top)
        case 8:
            return _avg(corner, top)
        case 9:
            return _avg(top, right)
        case 10:
            return _avg(_avg(left, corner), _avg(top, right))
        case 11:
            to_left = sum(abs(t - c) for t, c in zip(_parts(top), _parts(corner), strict=True))
            to_top = sum(abs(a - c) for a, c in zip(_parts(left), _parts(corner), strict=True))
            return left if to_left < to_top else top
        case 12:
            return _clamped(a + t - c for a, t, c in zip(_parts(left), _parts(top), _parts(corner), strict=True))
        case 13:
            return _clamped(m + int((m - c) / 2) for m, c in zip(_parts(_avg(left, top)), _parts(corner), strict=True))
    return 0xFF000000


def _predicted(out: list[int], at: int, width: int, mode: int) -> int:
    """In the last column the pixel above and to the right is the first of the pixel's own row: the next in order."""
    x, y = at % width, at // width
    if not at:
        return 0xFF000000
    if not y:
        return out[at - 1]
    if not x:
        return out[at - width]
    return predict(mode, out[at - 1], out[at - width], out[at - width + 1], out[at - width - 1])


def _per_block(values: np.ndarray, width: int, height: int, shift: int) -> np.ndarray:
    per_row = -(-width >> shift)
    y, x = np.divmod(np.arange(width * height), width)
    return values[(y >> shift) * per_row + (x >> shift)]


def _cross(pixels: np.ndarray, elements: np.ndarray, sign: int) -> np.ndarray:
    a, r, g, b = _channels(pixels)
    _, red_to_blue, green_to_blue, green_to_red = (c.astype(np.int8).astype(np.int32) for c in _channels(elements))
    small = lambda c: (c & 255).astype(np.uint8).astype(np.int8).astype(np.int32)
    new = (r + sign * (green_to_red * small(g) >> 5)) & 255
    red = new if sign > 0 else r
    return _joined(a, new, g, b + sign * (green_to_blue * small(g) >> 5) + sign * (red_to_blue * small(red) >> 5))


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, RGBA) of a lossless WebP file."""
    bits = Bits(_chunk(data, b"VP8L"))
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, wide = [], width
    seen = set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS):
            shift = bits.read(3) + 2
            undo.append((kind, wide, shift, read_pixels(bits, -(-wide >> shift), -(-height >> shift), False)))
        elif kind == GREEN:
            undo.append((kind, wide, 0, None))
        else:
            n = bits.read(8) + 1
            deltas = read_pixels(bits, n, 1, False)
            colours = np.cumsum(deltas.view(np.uint8).reshape(-1, 4), 0, np.uint8).view(np.uint32).reshape(-1)  # each channel by itself
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, wide, pack, colours))
            wide = -(-wide >> pack)
    pixels = read_pixels(bits, wide, height, True)
    for kind, own, shift, values in reversed(undo):
        if kind == PREDICTOR:
            modes = (_per_block(values, own, height, shift) >> 8 & 15).tolist()
            out: list[int] = []
            for at, v in enumerate(pixels.tolist()):
                out.append(_add(v, _predicted(out, at, own, modes[at])))
            pixels = np.array(out, np.uint32)
        elif kind == CROSS:
            pixels = _cross(pixels, _per_block(values, own, height, shift), 1)
        elif kind == GREEN:
            green = pixels >> 8 & 255
            pixels = pixels & 0xFF00FF00 | (pixels & 0x00FF00FF) + (green << 16 | green) & 0x00FF00FF
        else:
            index = (pixels >> 8 & 255).reshape(height, -1)
            if shift:
                each = 8 >> shift
                index = np.stack([index >> (each * k) & ((1 << each) - 1) for k in range(1 << shift)], 2).reshape(height, -1)[:, :own]
            colours = np.zeros(256, np.uint32)
            colours[: len(values)] = values
            pixels = colours[index].reshape(-1)
    return _as_rgba(pixels, width, height)


def _as_rgba(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(height, width, 4)[:, :, [2, 1, 0, 3]]


def _chunk(data: bytes, name: bytes) -> bytes:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        n = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == name:
            return data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no such chunk")


def riff(chunks: list[tuple[bytes, bytes]]) -> bytes:
    body = b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) & 1) for k, v in chunks)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


class Writer:
    def __init__(self) -> None:
        self.value, self.n = 0, 0
        self.done: list[bytes] = []

    def put(self, v: int, n: int) -> None:
        self.value |= v << self.n
        self.n += n
        if self.n >= 4096:
            k = self.n >> 3
            self.done.append((self.value & ((1 << 8 * k) - 1)).to_bytes(k, "little"))
            self.value >>= 8 * k
            self.n -= 8 * k

    def bytes(self) -> bytes:
        return b"".join([*self.done, self.value.to_bytes(-(-self.n // 8), "little")])


def write_code(w: Writer, used: set[int], alphabet: int) -> dict[int, tuple[int, int]]:
    """Writes a complete code of nearly equal lengths for the used symbols; gives value and bits of each."""
    syms = sorted(used) or [0]
    if len(syms) == 1 and syms[0] < 256:
        w.put(1, 1), w.put(0, 1), w.put(1, 1), w.put(syms[0], 8)
        return {syms[0]: (0, 0)}
    if len(syms) == 1:
        syms = [0, *syms]
    k = (len(syms) - 1).bit_length()
    short = (1 << k) - len(syms)
    lengths = {s: k - 1 if i < short else k for i, s in enumerate(syms)}
    w.put(0, 1), w.put(15, 4)
    for s in LENGTH_ORDER:
        w.put(4, 3) if s < 16 else w.put(0, 3)  # sixteen lengths of four bits each
    w.put(0, 1)
    for s in range(alphabet):
        w.put(int(f"{lengths.get(s, 0):04b}"[::-1], 2), 4)
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        last = n
        out[s] = (int(f"{code:0{n}b}"[::-1], 2) if n else 0, n)
        code += 1
    return out


def _prefix(v: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits' number and value for a length or distance code from 1."""
    if v <= 4:
        return v - 1, 0, 0
    v -= 1
    n = v.bit_length() - 2
    return 2 * (n + 1) + (v >> n & 1), n, v & ((1 << n) - 1)


def write_pixels(w: Writer, pixels: list[int], width: int, main: bool, cache_bits: int = 0, copies: bool = False) -> None:
    w.put(1, 1) or w.put(cache_bits, 4) if cache_bits else w.put(0, 1)
    if main:
        w.put(0, 1)
    steps: list[tuple[int, ...]] = []
    cache, last, at = [None] * (1 << cache_bits), {}, 0
    while at < len(pixels):
        n = 0
        if copies and at and (back := at - last.get(pixels[at], at)):
            while at + n < len(pixels) and pixels[at + n] == pixels[at + n - back] and n < 4096:
                n += 1
        v = pixels[at]
        if n >= 3:
            steps.append((256 + _prefix(n)[0], n, back + len(NEAR)))
        elif cache_bits and cache[(CACHE_MULT * v & 0xFFFFFFFF) >> (32 - cache_bits)] == v:
            steps.append((280 + ((CACHE_MULT * v & 0xFFFFFFFF) >> (32 - cache_bits)),))
            n = 1
        else:
            steps.append((v >> 8 & 255, v >> 16 & 255, v & 255, v >> 24))
            n = 1
        for i in range(at, at + n):
            last[pixels[i]] = i
            if cache_bits:
                cache[(CACHE_MULT * pixels[i] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[i]
        at += n
    plain = [s for s in steps if len(s) == 4]
    green = write_code(w, {s[0] for s in steps}, 280 + (1 << cache_bits if cache_bits else 0))
    rest = [write_code(w, {s[k] for s in plain}, 256) for k in (1, 2, 3)]
    dist = write_code(w, {_prefix(s[2])[0] for s in steps if len(s) == 3}, 40)
    for s in steps:
        w.put(*green[s[0]])
        if len(s) == 4:
            for k in range(3):
                w.put(*rest[k][s[k + 1]])
        elif len(s) == 3:
            w.put(_prefix(s[1])[2], _prefix(s[1])[1])
            p, n, extra = _prefix(s[2])
            w.put(*dist[p])
            w.put(extra, n)


def encode(rgba: np.ndarray, transforms: tuple[int, ...] = (), mode: int = 11, element: int = 0xFF102030, cache_bits: int = 0, copies: bool = False) -> bytes:
    """Pixels (height, width, RGBA) as a file, with transforms in the order given: one predictor mode or cross-colour element for all."""
    height, width = rgba.shape[:2]
    pixels = np.ascontiguousarray(rgba[:, :, [2, 1, 0, 3]]).view("<u4").reshape(-1)
    w = Writer()
    w.put(0x2F, 8), w.put(width - 1, 14), w.put(height - 1, 14), w.put(1, 1), w.put(0, 3)
    wide = width
    for kind in transforms:
        w.put(1, 1), w.put(kind, 2)
        n = -(-wide >> 4) * -(-height >> 4)
        if kind == PREDICTOR:
            w.put(2, 3)
            write_pixels(w, [0xFF000000 | mode << 8] * n, -(-wide >> 4), False)
            own = pixels.tolist()
            gone = []
            for at, v in enumerate(own):
                p = _predicted(own, at, wide, mode)
                gone.append(_add(v, _add(~p & 0xFFFFFFFF, 0x01010101)))
            pixels = np.array(gone, np.uint32)
        elif kind == CROSS:
            w.put(2, 3)
            write_pixels(w, [element] * n, -(-wide >> 4), False)
            pixels = _cross(pixels, np.full(len(pixels), element, np.uint32), -1)
        elif kind == GREEN:
            a, r, g, b = _channels(pixels)
            pixels = _joined(a, r - g, g, b - g)
        else:
            colours, index = np.unique(pixels, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("more than 256 colours")
            w.put(len(colours) - 1, 8)
            deltas = _joined(*(np.diff(c, prepend=0) for c in _channels(colours)))
            write_pixels(w, deltas.tolist(), len(colours), False)
            pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            index = index.reshape(height, -1)
            wide_new = -(-wide >> pack)
            full = np.zeros((height, wide_new << pack), np.uint32)
            full[:, :wide] = index
            each = 8 >> pack
            bundled = sum(full[:, k :: 1 << pack] << (each * k) for k in range(1 << pack))
            pixels, wide = (0xFF000000 | bundled.astype(np.uint32) << 8).reshape(-1), wide_new
    w.put(0, 1)
    write_pixels(w, pixels.tolist(), wide, True, cache_bits, copies)
    return riff([(b"VP8L", w.bytes())])


def code_lengths(counts: list[int], most: int = 15) -> list[int]:
    """Lengths of a prefix code from counts, none above `most`: Huffman's by two queues, counts being evened out until they fit."""
    used = sorted((c, s) for s, c in enumerate(counts) if c)
    own, out, n = [c for c, _ in used], [0] * len(counts), len(used)
    while n > 1:
        up, made, leaf, inner = [0] * (2 * n - 1), [], 0, 0
        for k in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if inner == len(made) or (leaf < n and own[leaf] <= made[inner]):
                    total += own[leaf]
                    up[leaf] = k
                    leaf += 1
                else:
                    total += made[inner]
                    up[n + inner] = k
                    inner += 1
            made.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[up[k]] + 1
        if max(depth) <= most:
            for (_, s), d in zip(used, depth, strict=False):
                out[s] = d
            break
        own = [c + 1 >> 1 for c in own]
    return out


@lru_cache(1)
def _turned() -> list[int]:
    return _reversed(15).tolist()


def _numbered(lengths: list[int]) -> list[int]:
    """The canonical code's values, first bit lowest."""
    out, turned, at = [0] * len(lengths), _turned(), 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        out[s] = turned[at] & ((1 << n) - 1)
        at += 1 << (15 - n)
    return out


def put_one(w: Writer, symbol: int) -> None:
    """A code of one symbol, which takes no bits."""
    w.put(5 | symbol << 3, 11)


def put_code(w: Writer, counts: list[int]) -> tuple[list[int], list[int]]:
    """Writes the prefix code of the counts; gives value and bits of each symbol."""
    used = [s for s, c in enumerate(counts) if c]
    if len(used) <= 1 and (not used or used[0] < 256):
        put_one(w, used[0] if used else 0)
        return [0] * len(counts), [0] * len(counts)
    if len(used) == 2 and used[1] < 256:
        w.put(7 | used[0] << 3 | used[1] << 11, 19)
        value, bits = [0] * len(counts), [0] * len(counts)
        value[used[1]] = bits[used[0]] = bits[used[1]] = 1
        return value, bits
    if len(used) == 1:
        counts, used = [1, *counts[1:]], [0, *used]
    lengths = code_lengths(counts)
    steps, at = [], 0  # symbol, extra bits, their number
    for s in [*used, len(lengths)]:
        while at < s:
            n = min(s - at, 138)
            at += n
            steps += [(18, n - 11, 7)] if n > 10 else [(17, n - 3, 3)] if n > 2 else [(0, 0, 0)] * n
        if s < len(lengths):
            steps.append((lengths[s], 0, 0))
            at += 1
    seen = [0] * 19
    for s, _, _ in steps:
        seen[s] += 1
    own = bits = code_lengths(seen, 7)
    if not any(own):  # one symbol only: its code has no bits
        own, bits = [1 if s == steps[0][0] else 0 for s in range(19)], [0] * 19
    values = _numbered(bits)
    v, n = 15 << 1, 5
    for s in LENGTH_ORDER:
        v |= own[s] << n
        n += 3
    n += 1
    for s, extra, k in steps:
        v |= (values[s] | extra << bits[s]) << n
        n += bits[s] + k
    w.put(v, n)
    return _numbered(lengths), lengths


def _repeats(samples: np.ndarray, least: int = REPEAT, most: int = 4096) -> list[tuple[int, int, int]]:
    """(start, length, distance) of runs that stood before among the samples (one byte each), in order and apart.

    `least` samples are sought where they stood last; neighbours that stood at one distance make one run.
    """
    out: list[tuple[int, int, int]] = []
    for base in range(0, len(samples) - least, NEARBY):
        own = samples[base : base + NEARBY]
        if len(own) <= least:
            break
        key = np.ndarray(len(own) - 7, "<u8", own.tobytes(), 0, 1)
        order = key * MIX & ~PLACE | np.arange(len(key), dtype=np.uint64)  # by a hash, then by place
        order.sort()
        order = (order & PLACE).astype(np.int64)
        k = key[order]
        same = np.flatnonzero(k[1:] == k[:-1])
        if not len(same):
            continue
        before = np.full(len(key), -1)
        before[order[same + 1]] = order[same]
        at = np.flatnonzero(before >= 0)
        d = at - before[at]
        new = np.ones(len(at) + 1, bool)
        new[1:-1] = (at[1:] - at[:-1] > 1) | (d[1:] != d[:-1])
        first = new.nonzero()[0]
        length = first[1:] - first[:-1] + least - 1
        first = first[:-1]
        free = 0
        for a, n, far in zip(at[first].tolist(), length.tolist(), d[first].tolist(), strict=True):
            end = a + n
            a = max(a, free)
            while end - a >= least:
                n = min(end - a, most)
                out.append((base + a, n, far))
                a += n
            free = max(free, a)
    return out


def put_samples(w: Writer, values: np.ndarray, main: bool) -> None:
    """An image whose green channel holds the values: opaque, red and blue 0; with back-references and codes from counts."""
    w.put(0, 1 + main)  # no cache, no regions
    runs = _repeats(values)
    if runs:
        start, n, far = np.array(runs).T
        gone = np.zeros(len(values) + 1, np.int64)
        gone[start] += 1
        np.subtract.at(gone, start + n, 1)
        plain = (np.cumsum(gone[:-1]) == 0).nonzero()[0]
        lengths, distances = np.array([_prefix(x) for x in n.tolist()]).T, np.array([_prefix(x + len(NEAR)) for x in far.tolist()]).T
        lit, long = values[plain], 256 + lengths[0]
        counts = np.bincount(np.concatenate([lit, long]), minlength=280).tolist()
    else:
        counts = np.bincount(values, minlength=280).tolist()
    gv, gb = map(np.array, put_code(w, counts))
    put_one(w, 0), put_one(w, 0), put_one(w, 255)
    if runs:
        # A run is two entries, its length and then its distance, each with its extra bits.
        dv, db = map(np.array, put_code(w, np.bincount(distances[0], minlength=40).tolist()))
        place = np.concatenate([2 * plain, 2 * start, 2 * start + 1])
        value = np.concatenate([gv[lit], gv[long] | lengths[2] << gb[long], dv[distances[0]] | distances[2] << db[distances[0]]])
        bits = np.concatenate([gb[lit], gb[long] + lengths[1], db[distances[0]] + distances[1]])
        order = place.argsort(kind="stable")
        value, bits = value[order], bits[order]
    else:
        put_one(w, 0)
        value, bits = gv[values], gb[values]
    end = np.cumsum(bits)
    total = int(end[-1])
    at = end - bits
    got = np.zeros((total >> 3) + 6, np.uint8)
    for lo in range(0, len(at), 1 << 18):
        p, x = at[lo : lo + (1 << 18)], value[lo : lo + (1 << 18)]
        base = int(p[0]) >> 3
        x, p = x << (p & 7), (p >> 3) - base
        for k in range(5 if runs else 3):  # bits of different symbols don't meet, so sums join them
            if k == 3:
                wide = (x >= 1 << 24).nonzero()[0]
                if not len(wide):
                    break
                p, x = p[wide], x[wide]
            part = np.bincount(p, x >> (8 * k) & 255).astype(np.uint8)
            got[base + k : base + k + len(part)] += part
    w.put(int.from_bytes(got.tobytes(), "little") & ((1 << total) - 1), total)


def put_colours(w: Writer, greys: np.ndarray) -> None:
    """The palette as differences of neighbours: the first opaque, the others' alpha the same."""
    w.put(0, 1)
    steps = greys.copy()
    steps[1:] -= greys[:-1]
    value, bits = put_code(w, np.bincount(steps, minlength=280).tolist())
    put_one(w, 0), put_one(w, 0)
    alpha, two = [0] * 256, len(greys) > 1
    alpha[255], alpha[0] = 1, int(two)
    a, n = put_code(w, alpha)
    put_one(w, 0)
    v, at = 0, 0
    for k, s in enumerate(steps.tolist()):
        i = 0 if k else 255
        v |= (value[s] | a[i] << bits[s]) << at
        at += bits[s] + n[i]
    w.put(v, at)


def store(payload: bytes) -> bytes:
    """A payload of a positive multiple of 576 bytes as grey samples: a row for each 576 bytes, in wider rows beyond 16384 of them."""
    rows = len(payload) // UNIT
    if not rows or len(payload) % UNIT:
        raise ValueError("not a positive multiple of 576 bytes")
    times = -(-rows // MOST)
    width, height = UNIT * times, -(-rows // times)
    samples = np.frombuffer(payload + b"\xff" * (width * height - len(payload)), np.uint8)
    greys = np.bincount(samples, minlength=256).nonzero()[0]
    if len(greys) > 16:  # samples can't share a pixel, and a palette without gaps takes a bit a colour
        greys = np.arange(greys[0], greys[-1] + 1)
    w = Writer()
    w.put(0x2F, 8), w.put(width - 1, 14), w.put(height - 1, 14), w.put(0, 1), w.put(0, 3)
    w.put(1, 1), w.put(GREEN, 2)  # red and blue are green's and become 0
    w.put(1, 1), w.put(PALETTE, 2), w.put(len(greys) - 1, 8)
    put_colours(w, greys)
    number = np.zeros(256, np.uint8)
    number[greys] = np.arange(len(greys))
    index = samples - np.uint8(greys[0]) if len(greys) > 16 else number[samples]
    pack = 3 if len(greys) <= 2 else 2 if len(greys) <= 4 else 1 if len(greys) <= 16 else 0
    if pack:
        wide, each = -(-width >> pack), 8 >> pack
        full = np.zeros((height, wide << pack), np.uint8)
        full[:, :width] = index.reshape(height, width)
        index = sum(full[:, k :: 1 << pack] << (each * k) for k in range(1 << pack)).astype(np.uint8).reshape(-1)
    w.put(0, 1)
    put_samples(w, index, True)
    return riff([(b"VP8L", w.bytes()), *([(b"qLEN", struct.pack("<Q", len(payload)))] if times > 1 else [])])


def restore(data: bytes) -> tuple[bytes, tuple[int, int]]:
    """The payload that store() put in, and the image's width and height."""
    p = decode(data)
    raw = p[:, :, 1].tobytes()
    try:
        raw = raw[: struct.unpack("<Q", _chunk(data, b"qLEN"))[0]]
    except ValueError:  # only images of more than one unit's width have that chunk
        return raw, (p.shape[1], p.shape[0])
    return raw, (p.shape[1], p.shape[0])


def padded(text: str | None) -> tuple[bytes, int]:
    b = encoded(text)
    return b + b"\xff" * (-len(b) % UNIT or (0 if b else UNIT)), len(b)


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.large_binary())])
FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def as_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text as a lossless image."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in pieces(whole, 4_000_000):
                got = [padded(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([n for _, n in got], pa.int64()), pa.array([store(p) for p, _ in got], pa.binary())], names=MEDIA.names)

    return map_rows(docs, ["doc_id", "text"], run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Reads the stored images back and describes payload and pixels."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list[list] = [[] for _ in FEATURES]
            for d, n, m in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media"), strict=True):
                m = m.as_py()
                raw, (w, h) = restore(m)
                counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
                seen = counts[counts > 0]
                entropy = int(round(1000 * float(-(seen / len(raw) * np.log2(seen / len(raw))).sum())))
                mean = int(counts @ np.arange(256)) * 1000 // len(raw)
                row = (d, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(m), hashlib.sha256(m).hexdigest(), f"{w}x{h} mean={mean} entropy={entropy}")
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            yield batch(FEATURES, out)

    return map_rows(media, ["doc_id", "n_bytes", "media"], run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(as_media(table(spark, sf_dir, "documents")))
