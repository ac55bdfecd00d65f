"""Lossless WebP (VP8L in a RIFF container) on pixel arrays.

Pixels are ``uint32`` values 0xAARRGGBB in row order.  ``decode`` reads any
stream of the format: simple and normal prefix codes, several code groups,
back-references, colour cache, and the predictor, cross-colour, subtract-green
and palette transforms.  ``encode`` writes what its arguments ask for.

The usual stream (one code group, no colour cache) is decoded with array
operations: the code word that would begin at each bit is looked up for all bits
of a window at once, which leaves only the hops from word to word to a loop.
Windows have a fixed number of bits, so memory doesn't grow with the image but
for its pixels.  Other streams take the word-by-word path.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter

import numpy as np

from . import _bytes as B

# Fixed values of the format.
MAX_SIDE = 16384
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
LENGTH_CODES, DISTANCE_CODES = 24, 40
MAX_MATCH = 4096
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3

#: The 120 short distances: places to the left or above, by how far they are.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))

#: Bits of a window of the array path.
WINDOW_BITS = 1 << 20
#: Bytes that a match has at least.
MIN_MATCH = 16


class BitWriter:
    """Bits, the lowest first; they are packed into bytes as they come, ``AT_ONCE`` values at a time."""

    AT_ONCE = 1 << 15

    def __init__(self):
        self.done: list[bytes] = []
        self.parts: list[np.ndarray] = []
        self.open = 0
        self.waiting: list[int] = []  # value, bits, value, bits, ..

    def put(self, value: int, bits: int) -> None:
        self.waiting += (value, bits)

    def put_all(self, values: np.ndarray, bits: np.ndarray) -> None:
        self._flush()
        for k in range(0, len(values), self.AT_ONCE):
            self._append(values[k : k + self.AT_ONCE], bits[k : k + self.AT_ONCE])

    def _append(self, values: np.ndarray, bits: np.ndarray) -> None:
        ends = np.cumsum(bits)
        if len(ends) and ends[-1]:
            shift = np.arange(ends[-1]) - np.repeat(ends - bits, bits)
            self.parts.append(((np.repeat(values, bits) >> shift) & 1).astype(np.uint8))
            self.open += len(shift)
            if self.open >= 8 * self.AT_ONCE:
                every = np.concatenate(self.parts)
                whole = len(every) & ~7
                self.done.append(np.packbits(every[:whole], bitorder="little").tobytes())
                self.parts, self.open = [every[whole:]], len(every) - whole

    def _flush(self) -> None:
        if self.waiting:
            flat = np.array(self.waiting, np.int64).reshape(-1, 2)
            self.waiting = []
            self._append(flat[:, 0], flat[:, 1])

    def bytes(self) -> bytes:
        self._flush()
        return b"".join([*self.done, np.packbits(np.concatenate(self.parts), bitorder="little").tobytes()])


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def get(self, bits: int) -> int:
        if self.at + bits > 8 * len(self.data):
            raise ValueError("the stream ends too early")
        word = int.from_bytes(self.data[self.at >> 3 : (self.at + bits + 7) >> 3], "little") >> (self.at & 7)
        self.at += bits
        return word & ((1 << bits) - 1)


# Prefix codes


def code_lengths(counts: dict[int, int], longest: int) -> dict[int, int]:
    """Huffman code lengths of at most ``longest`` bits; a lone symbol gets a second one beside it."""
    counts = dict(counts)
    for spare in (0, 1):
        if len(counts) < 2:
            counts.setdefault(spare, 1)
    while True:
        heap = [(n, s, (s,)) for s, n in counts.items()]
        heapq.heapify(heap)
        depth = dict.fromkeys(counts, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            both = a[2] + b[2]
            for s in both:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), both))
        if max(depth.values()) <= longest:
            return depth
        counts = {s: (n + 1) // 2 for s, n in counts.items()}


def canonical(lengths: dict[int, int]) -> dict[int, int]:
    """Code words, first bit lowest."""
    code, before, out = 0, 0, {}
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - before
        before = n
        out[s] = int(_reversal(n)[code])
        code += 1
    return out


_reversed: dict[int, np.ndarray] = {}


def _reversal(bits: int) -> np.ndarray:
    if bits not in _reversed:
        x, out = np.arange(1 << bits), np.zeros(1 << bits, np.int64)
        for k in range(bits):
            out |= ((x >> k) & 1) << (bits - 1 - k)
        _reversed[bits] = out
    return _reversed[bits]


class Code:
    """Symbol and length by the next ``bits`` bits."""

    def __init__(self, lengths: np.ndarray, alone: int | None = None):
        if alone is not None:
            self.bits, self.mask, self.symbol, self.length = 0, 0, np.full(1, alone, np.int32), np.zeros(1, np.int32)
            return
        used = np.flatnonzero(lengths)
        if not len(used):
            raise ValueError("a prefix code without symbols")
        if len(used) == 1:
            self.bits, self.symbol, self.length = 0, used.astype(np.int32), np.zeros(1, np.int32)
        else:
            n = lengths[used]
            self.bits = int(n.max())
            order = used[np.argsort(n, kind="stable")]
            span = 1 << (self.bits - lengths[order])
            if span.sum() != 1 << self.bits:
                raise ValueError("a prefix code that isn't complete")
            turn = _reversal(self.bits)
            self.symbol = np.repeat(order, span).astype(np.int32)[turn]
            self.length = np.repeat(lengths[order], span).astype(np.int32)[turn]
        self.mask = (1 << self.bits) - 1

    def read(self, reader: BitReader) -> int:
        if not self.bits:
            return int(self.symbol[0])
        data, at = reader.data, reader.at
        word = (int.from_bytes(data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7)) & self.mask
        reader.at += int(self.length[word])
        if reader.at > 8 * len(data):
            raise ValueError("the stream ends too early")
        return int(self.symbol[word])


def read_code(reader: BitReader, size: int) -> Code:
    if reader.get(1):
        two = reader.get(1)
        first = reader.get(8 if reader.get(1) else 1)
        if not two and first < size:
            return Code(None, first)
        lengths = np.zeros(size, np.int64)
        for s in [first, reader.get(8)] if two else [first]:
            if s >= size:
                raise ValueError("a symbol outside its alphabet")
            lengths[s] = 1
        return Code(lengths)
    lengths, inner = np.zeros(size, np.int64), np.zeros(19, np.int64)
    for k in range(4 + reader.get(4)):
        inner[CODE_LENGTH_ORDER[k]] = reader.get(3)
    code = Code(inner)
    left = 2 + reader.get(2 + 2 * reader.get(3)) if reader.get(1) else size
    k, before = 0, 8
    symbols, spans = code.symbol.tolist(), code.length.tolist()
    data, limit, mask = reader.data, 8 * len(reader.data), code.mask
    while k < size and left:
        left -= 1
        at = reader.at
        word = (int.from_bytes(data[at >> 3 : (at >> 3) + 2], "little") >> (at & 7)) & mask
        s = symbols[word]
        reader.at = at + spans[word]
        if reader.at > limit:
            raise ValueError("the stream ends too early")
        if s < 16:
            lengths[k] = s
            before = s or before
            k += 1
            continue
        value, n = (before, 3 + reader.get(2)) if s == 16 else (0, 3 + reader.get(3)) if s == 17 else (0, 11 + reader.get(7))
        if k + n > size:
            raise ValueError("code lengths run over the alphabet")
        lengths[k : k + n] = value
        k += n
    return Code(lengths)


def _write_code(writer: BitWriter, counts: dict[int, int], size: int) -> tuple[dict[int, int], dict[int, int]]:
    """Writes the code of these counts; its words and their lengths."""
    used = sorted(counts) or [0]
    if len(used) <= 2 and used[-1] < 256:
        writer.put(1, 1)
        writer.put(len(used) - 1, 1)
        writer.put(int(used[0] > 1), 1)
        writer.put(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            writer.put(used[1], 8)
        return dict(zip(used, (0, 1), strict=False)), dict.fromkeys(used, len(used) - 1)
    lengths = code_lengths(counts, 15)
    row = np.zeros(size, np.int64)
    row[list(lengths)] = list(lengths.values())
    cuts = np.flatnonzero(np.diff(row)) + 1
    heads = [0, *cuts.tolist()]
    items: list[tuple[int, int, int]] = []
    for value, n in zip(row[heads].tolist(), np.diff([*heads, size]).tolist(), strict=True):
        if value:
            items.append((value, 0, 0))
            n -= 1
        while n:
            if not value and n >= 11:
                step = min(n, 138)
                items.append((18, step - 11, 7))
            elif n >= 3:
                step = min(n, 6 if value else 10)
                items.append((16, step - 3, 2) if value else (17, step - 3, 3))
            else:
                step = 1
                items.append((value, 0, 0))
            n -= step
    inner = code_lengths(Counter(s for s, _, _ in items), 7)
    many = max(4, 1 + max(k for k, s in enumerate(CODE_LENGTH_ORDER) if inner.get(s)))
    writer.put(0, 1)
    writer.put(many - 4, 4)
    for s in CODE_LENGTH_ORDER[:many]:
        writer.put(inner.get(s, 0), 3)
    writer.put(0, 1)
    words = canonical(inner)
    for s, extra, bits in items:
        writer.waiting += (words[s], inner[s], extra, bits)
    return canonical(lengths), lengths


def _prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and their number of lengths or distance codes from 1."""
    x = values.astype(np.int64) - 1
    high = np.floor(np.log2(np.maximum(x, 1))).astype(np.int64)
    bits = np.where(x < 4, 0, high - 1)
    return np.where(x < 4, x, 2 * high + ((x >> np.maximum(high - 1, 0)) & 1)), x & ((1 << bits) - 1), bits


# Entropy-coded images


def find_matches(pixels: np.ndarray) -> list[tuple[int, int, int]]:
    """Non-overlapping (place, length, distance), greedy from the left; each of at least ``MIN_MATCH`` pixels."""
    n = len(pixels)
    if n < MIN_MATCH + 1:
        return []
    odd = np.uint64(0x9E3779B97F4A7C15)
    word = pixels.astype(np.uint64) + np.uint64(1)
    step = 1
    while step < MIN_MATCH:
        word = B.mix64(word[:-step] * odd + word[step:])
        step *= 2
    # upper bits of the fingerprint, and the place below them; what follows compares the pixels
    bits = np.uint64(n.bit_length())
    keys = np.sort((word >> bits << bits) | np.arange(len(word), dtype=np.uint64))
    same = keys[1:] >> bits == keys[:-1] >> bits
    order = keys & ((np.uint64(1) << bits) - np.uint64(1))
    pairs = np.sort(order[1:][same] << np.uint64(32) | order[:-1][same])
    again, earlier = (pairs >> np.uint64(32)).tolist(), (pairs & np.uint64(0xFFFFFFFF)).tolist()
    out, k = [], 0
    while k < len(again):
        at, back = again[k], again[k] - earlier[k]
        if back <= (1 << 20) - 120:
            most = min(MAX_MATCH, n - at)
            differ = np.flatnonzero(pixels[at : at + most] != pixels[at - back : at - back + most])
            length = int(differ[0]) if len(differ) else most
            if length >= MIN_MATCH:
                out.append((at, length, back))
                k = bisect_left(again, at + length)
                continue
        k += 1
    return out


def _write_image(writer: BitWriter, pixels: np.ndarray, width: int, main: bool, cache_bits: int = 0, matches: bool = False) -> None:
    writer.put(int(cache_bits > 0), 1)
    if cache_bits:
        writer.put(cache_bits, 4)
    if main:
        writer.put(0, 1)
    found = find_matches(pixels) if matches else []
    covered = np.zeros(len(pixels), bool)
    for at, length, _ in found:
        covered[at : at + length] = True
    starts = np.array([m[0] for m in found], np.int64)
    covered[starts] = False  # the first pixel of a match stands for it
    place = np.flatnonzero(~covered)
    argb = pixels[place].astype(np.int64)
    symbols = np.stack([(argb >> 8) & 255, (argb >> 16) & 255, argb & 255, argb >> 24], 1)  # where a match has no red, blue or alpha, its length's extra bits follow
    extra_bits, extra = np.zeros((len(place), 2), np.int64), np.zeros((len(place), 2), np.int64)
    token = np.searchsorted(place, starts)
    distance = np.full(len(place), -1, np.int64)
    if found:
        lengths, back = (np.array([m[k] for m in found], np.int64) for k in (1, 2))
        near = {x + y * width: k + 1 for k, (x, y) in reversed(list(enumerate(NEAR))) if x + y * width > 0}
        code = np.array([near.get(b, b + len(NEAR)) for b in back.tolist()], np.int64)
        symbol, extra[token, 0], extra_bits[token, 0] = _prefix(lengths)
        distance[token], extra[token, 1], extra_bits[token, 1] = _prefix(code)
        symbols[token] = -1
        symbols[token, 0] = 256 + symbol
    if cache_bits:
        cache: dict[int, int] = {}
        slot = ((pixels.astype(np.uint64) * np.uint64(CACHE_MULTIPLIER)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)
        ends = [*place[1:].tolist(), len(pixels)]
        for t, at in enumerate(place.tolist()):
            s = int(slot[at])
            if symbols[t, 1] >= 0 and cache.get(s, 0) == int(pixels[at]):
                symbols[t] = -1
                symbols[t, 0] = 256 + LENGTH_CODES + s
            for p in range(at, ends[t]):
                cache[int(slot[p])] = int(pixels[p])
    sizes = [256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES]
    columns = [symbols[:, 0], symbols[:, 1], symbols[:, 2], symbols[:, 3], distance]
    fields = []
    for column, size, extra_at in zip(columns, sizes, (None, None, None, 0, 1), strict=True):
        counts = np.bincount(column + 1, minlength=1)[1:]
        code, length = _write_code(writer, {s: int(counts[s]) for s in np.flatnonzero(counts).tolist()}, size)
        if len(code) > 1:
            word, many = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)  # -1 reads the last: nothing
            word[list(code)], many[list(code)] = list(code.values()), [length[s] for s in code]
            fields.append((word[column], many[column]))
        if extra_at is not None and found:
            fields.append((extra[:, extra_at], extra_bits[:, extra_at]))
    if len(fields) == 1:
        writer.put_all(*fields[0])
    elif fields:
        writer.put_all(np.stack([v for v, _ in fields], 1).reshape(-1), np.stack([b for _, b in fields], 1).reshape(-1))


def _extra(symbol: int, reader: BitReader) -> int:
    if symbol < 4:
        return symbol + 1
    bits = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << bits) + reader.get(bits) + 1


def _back(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _copy(out: np.ndarray, at: int, length: int, back: int) -> None:
    if back > at:
        raise ValueError("a back-reference before the first pixel")
    if back >= length:
        out[at : at + length] = out[at - back : at - back + length]
    else:
        out[at : at + length] = np.resize(out[at - back : at], length)


def _read_image(reader: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = reader.get(4) if reader.get(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache of more than 11 bits")
    group_of, block, across, groups = None, 0, 1, 1
    if main and reader.get(1):
        block = reader.get(3) + 2
        across = -(-width >> block)
        entropy = _read_image(reader, across, -(-height >> block), False)
        group_of = ((entropy >> 8) & 0xFFFF).astype(np.int64)
        groups = int(group_of.max()) + 1
    sizes = [256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES]
    codes = [[read_code(reader, n) for n in sizes] for _ in range(groups)]
    out = np.zeros(width * height, np.uint32)
    if groups == 1 and not cache_bits:
        _fill_by_windows(reader, codes[0], out, width)
    else:
        _fill_by_words(reader, codes, out, width, cache_bits, group_of, block, across)
    return out


def _fill_by_words(reader, codes, out, width, cache_bits, group_of, block, across) -> None:
    cache = np.zeros(1 << cache_bits, np.uint32)
    at, total, added = 0, len(out), 0
    while at < total:
        green, red, blue, alpha, dist = codes[0 if group_of is None else group_of[(at // width >> block) * across + (at % width >> block)]]
        s = green.read(reader)
        if s < 256:
            r, b = red.read(reader), blue.read(reader)
            out[at] = alpha.read(reader) << 24 | r << 16 | s << 8 | b
            length = 1
        elif s < 256 + LENGTH_CODES:
            length = _extra(s - 256, reader)
            back = _back(_extra(dist.read(reader), reader), width)
            if at + length > total:
                raise ValueError("a back-reference past the last pixel")
            _copy(out, at, length, back)
        else:
            for p in range(added, at):
                cache[(int(out[p]) * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - cache_bits)] = out[p]
            added = at
            out[at] = cache[s - 256 - LENGTH_CODES]
            length = 1
        at += length


def _fill_by_windows(reader: BitReader, codes: list[Code], out: np.ndarray, width: int) -> None:
    green, red, blue, alpha, dist = codes
    data = np.frombuffer(reader.data, np.uint8)
    total_bits = 8 * len(data)
    plain = not (red.bits or blue.bits or alpha.bits)
    at, total, start = 0, len(out), reader.at
    if plain and not green.bits:  # one colour in no bits at all
        if int(green.symbol[0]) >= 256:
            raise ValueError("an image of back-references alone")
        out[:] = int(alpha.symbol[0]) << 24 | int(red.symbol[0]) << 16 | int(green.symbol[0]) << 8 | int(blue.symbol[0])
        return
    if plain:
        hop_by = np.where(green.symbol < 256, green.length, 0).astype(np.uint8)  # 0: here a match begins
        level = int(alpha.symbol[0]) << 24 | int(red.symbol[0]) << 16 | int(blue.symbol[0])
        _fill_plain(reader, green, dist, hop_by, np.uint32(level), out, width)
        return
    while at < total:
        if start >= total_bits:
            raise ValueError("the stream ends too early")
        low = start >> 3
        part = np.zeros(min(WINDOW_BITS // 8 + 32, len(data) - low) + 16, np.uint8)
        part[: len(part) - 16] = data[low : low + len(part) - 16]
        quads = part[:-3].astype(np.uint32) | part[1:-2].astype(np.uint32) << 8 | part[2:-1].astype(np.uint32) << 16 | part[3:].astype(np.uint32) << 24
        word = (quads[:, None] >> np.arange(8, dtype=np.uint32)).reshape(-1).astype(np.int64)
        last = len(word) - 1
        stop = min(WINDOW_BITS, 8 * (len(data) - low))  # words that begin before are read
        symbol = green.symbol[word[:stop] & green.mask]
        after = np.arange(stop) + green.length[word[:stop] & green.mask]
        if not plain:
            for code in (red, blue, alpha):
                if code.bits:
                    after = after + code.length[word[np.minimum(after, last)] & code.mask]
        far = np.flatnonzero(symbol >= 256)
        if len(far):
            s = symbol[far].astype(np.int64) - 256
            p = far + green.length[word[far] & green.mask]
            bits = np.where(s < 4, 0, (s - 2) >> 1)
            length = np.where(s < 4, s + 1, ((2 + (s & 1)) << bits) + (word[np.minimum(p, last)] & ((1 << bits) - 1)) + 1)
            p = p + bits
            w = word[np.minimum(p, last)]
            s, p = dist.symbol[w & dist.mask].astype(np.int64), p + dist.length[w & dist.mask]
            bits = np.where(s < 4, 0, (s - 2) >> 1)
            code = np.where(s < 4, s + 1, ((2 + (s & 1)) << bits) + (word[np.minimum(p, last)] & ((1 << bits) - 1)) + 1)
            after[far] = p + bits
        hop, p, places = after.tolist(), start - 8 * low, []
        add, room = places.append, total - at
        while p < stop and len(places) < room:
            add(p)
            p = hop[p]
        places = np.array(places, np.int64)
        s = symbol[places]
        lengths = np.ones(len(places), np.int64)
        match = s >= 256
        if match.any():
            where = np.searchsorted(far, places[match])
            lengths[match] = length[where]
        ends = np.cumsum(lengths) + at
        used = int(np.searchsorted(ends, total)) + 1
        if used < len(places):  # words after the image's end
            p = int(places[used])
            places, s, lengths, ends, match = places[:used], s[:used], lengths[:used], ends[:used], match[:used]
        if ends[-1] > total:
            raise ValueError("a back-reference past the last pixel")
        literal = ~match
        q = places[literal]
        g = s[literal].astype(np.uint32)
        q = q + green.length[word[q] & green.mask]
        channels = []
        for c in (red, blue, alpha):
            w = word[np.minimum(q, last)] & c.mask
            channels.append(c.symbol[w].astype(np.uint32))
            q = q + c.length[w]
        out[(ends - lengths)[literal]] = channels[2] << 24 | channels[0] << 16 | g << 8 | channels[1]
        if match.any():
            where = np.searchsorted(far, places[match])
            for begin, n, c in zip((ends - lengths)[match].tolist(), lengths[match].tolist(), code[where].tolist(), strict=True):
                _copy(out, begin, n, _back(c, width))
        at, start = int(ends[-1]), 8 * low + p
    if start > total_bits:
        raise ValueError("the stream ends too early")
    reader.at = start


def _fill_plain(reader: BitReader, green: Code, dist: Code, hop_by: np.ndarray, level: np.uint32, out: np.ndarray, width: int) -> None:
    """The array path where only green and matches take bits: hops through literals, one step for each match."""
    data = np.frombuffer(reader.data, np.uint8)
    at, total = 0, len(out)
    while at < total:
        low = reader.at >> 3
        if low >= len(data):
            raise ValueError("the stream ends too early")
        many = min(WINDOW_BITS >> 3, len(data) - low)
        part = np.zeros(many + 3, np.uint32)
        tail = data[low : low + many + 3]
        part[: len(tail)] = tail
        triples = part[:-2][:many] | part[1:-1][:many] << 8 | part[2:][:many] << 16
        word = (triples[:, None] >> np.arange(8, dtype=np.uint32)).reshape(-1) & np.uint32(green.mask)
        base, stop = 8 * low, 8 * many
        hop = np.arange(stop + 16, dtype=np.int32)  # places behind the window lead to themselves, as matches do
        hop[:stop] += hop_by[word]
        two = hop[hop]
        four = memoryview(two[two])
        p = reader.at - base
        while at < total and p < stop:
            heads = []
            add = heads.append
            for _ in range(-(-(total - at) // 4)):
                after = four[p]
                if after == p:
                    break
                add(p)
                p = after
            if heads:
                head = np.array(heads)
                second = two[head]
                places = np.stack([head, hop[head], second, hop[second]], 1).reshape(-1)
                places = places[hop[places] != places]
                if len(places) > total - at:  # words after the image's end
                    p = int(places[total - at])
                    places = places[: total - at]
                out[at : at + len(places)] = green.symbol[word[places]].astype(np.uint32) << 8 | level
                at += len(places)
            if at < total and p < stop:
                reader.at = base + p
                length = _extra(green.read(reader) - 256, reader)
                back = _back(_extra(dist.read(reader), reader), width)
                if at + length > total:
                    raise ValueError("a back-reference past the last pixel")
                _copy(out, at, length, back)
                at += length
                p = reader.at - base
        reader.at = base + p
    if reader.at > 8 * len(data):
        raise ValueError("the stream ends too early")


# Transforms


def _split(argb: np.ndarray) -> np.ndarray:
    """(.., 4) signed channels, blue first."""
    return np.stack([(argb >> k) & 255 for k in (0, 8, 16, 24)], -1).astype(np.int32)


def _join(channels: np.ndarray) -> np.ndarray:
    c = (channels & 255).astype(np.uint32)
    return c[..., 0] | c[..., 1] << 8 | c[..., 2] << 16 | c[..., 3] << 24


def _guess(mode: int, left, top, corner, right):
    """The predictor's channels from those of the neighbours."""
    average = lambda a, b: (a + b) >> 1
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode in (6, 7, 8, 9):
        return average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 5:
        return average(average(left, right), top)
    if mode == 10:
        return average(average(left, corner), average(top, right))
    if mode == 11:
        to_left, to_top = np.abs(top - corner).sum(-1, keepdims=True), np.abs(left - corner).sum(-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = average(left, top)
        return np.clip(mean + np.trunc((mean - corner) / 2).astype(np.int32), 0, 255)
    return np.broadcast_to(np.array([0, 0, 0, 255], np.int32), left.shape)


def _modes(sub: np.ndarray, bits: int, width: int, height: int) -> np.ndarray:
    across = -(-width >> bits)
    blocks = ((sub >> 8) & 15).astype(np.int64).reshape(-1, across)
    modes = blocks[np.arange(height)[:, None] >> bits, np.arange(width)[None] >> bits].copy()
    modes[0], modes[:, 0] = 1, 2
    modes[0, 0] = 0
    return modes


def _predict(argb: np.ndarray, width: int, sub: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    height = len(argb) // width
    modes = _modes(sub, bits, width, height)
    image = _split(argb).reshape(height, width, 4)
    if not inverse:
        flat = image.reshape(-1, 4)
        before = lambda k: np.concatenate([np.zeros((min(k, len(flat)), 4), np.int32), flat[: max(0, len(flat) - k)]])
        left, top, corner, right = before(1), before(width), before(width + 1), before(width - 1) if width > 1 else flat
        out = flat.copy()
        for mode in range(14):
            at = modes.reshape(-1) == mode
            out[at] = flat[at] - _guess(mode, left[at], top[at], corner[at], right[at])
        return _join(out)
    image[0, 0, 3] = (image[0, 0, 3] + 255) & 255
    image[0] = np.cumsum(image[0], 0) & 255
    for y in range(1, height):
        row, above = image[y], image[y - 1]
        row[0] = (row[0] + above[0]) & 255
        kinds = set(modes[y, 1:].tolist())
        if kinds <= {1}:
            row[:] = np.cumsum(row, 0) & 255
            continue
        right = np.concatenate([above[1:], row[:1]])
        if kinds <= {0, 2, 3, 4, 8, 9}:
            for mode in kinds:
                at = np.flatnonzero(modes[y, 1:] == mode) + 1
                row[at] = (row[at] + _guess(mode, above[at], above[at], above[at - 1], right[at])) & 255
            continue
        for x in range(1, width):
            row[x] = (row[x] + _guess(int(modes[y, x]), row[x - 1], above[x], above[x - 1], right[x])) & 255
    return _join(image.reshape(-1, 4))


def _cross(argb: np.ndarray, width: int, sub: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    height = len(argb) // width
    across = -(-width >> bits)
    element = sub.reshape(-1, across)[np.arange(height)[:, None] >> bits, np.arange(width)[None] >> bits].reshape(-1)
    signed = lambda x: ((x & 255) ^ 128) - 128
    green_to_red, green_to_blue, red_to_blue = (signed((element >> k).astype(np.int32)) for k in (0, 8, 16))
    c = _split(argb)
    green = signed(c[:, 1])
    if inverse:
        c[:, 2] = (c[:, 2] + (green_to_red * green >> 5)) & 255
        c[:, 0] += (green_to_blue * green >> 5) + (red_to_blue * signed(c[:, 2]) >> 5)
    else:
        c[:, 0] -= (green_to_blue * green >> 5) + (red_to_blue * signed(c[:, 2]) >> 5)
        c[:, 2] -= green_to_red * green >> 5
    return _join(c)


def _green(argb: np.ndarray, sign: int) -> np.ndarray:
    c = _split(argb)
    c[:, 2] += sign * c[:, 1]
    c[:, 0] += sign * c[:, 1]
    return _join(c)


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _bundle(index: np.ndarray, width: int, bits: int) -> np.ndarray:
    if not bits:
        return index.astype(np.uint32) << 8
    rows = index.reshape(-1, width)
    many, each = 1 << bits, 8 >> bits
    packed = np.zeros((len(rows), -(-width >> bits)), np.uint32)
    for k in range(many):
        part = rows[:, k::many].astype(np.uint32)
        packed[:, : part.shape[1]] |= part << (each * k)
    return packed.reshape(-1) << 8


def _unbundle(argb: np.ndarray, width: int, bits: int, table: np.ndarray) -> np.ndarray:
    green = (argb >> 8) & 255
    if bits:
        many, each = 1 << bits, 8 >> bits
        green = ((green[:, None] >> (each * np.arange(many, dtype=np.uint32))) & ((1 << each) - 1)).reshape(-1, -(-width >> bits) * many)[:, :width].reshape(-1)
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[green]


# Files


def encode(pixels: np.ndarray, width: int, palette: bool = False, predictor: np.ndarray | int | None = None, cross: tuple[int, int, int] | None = None, subtract_green: bool = False, cache_bits: int = 0, matches: bool = True, block_bits: int = 4) -> bytes:
    """A file that holds ``pixels`` (0xAARRGGBB, row by row) exactly.

    ``predictor``: a mode for all blocks or one for each; ``cross``: signed
    (green to red, green to blue, red to blue).  A palette needs 256 colours at
    most and excludes the other transforms.
    """
    height = len(pixels) // width
    if not (1 <= width <= MAX_SIDE and 1 <= height <= MAX_SIDE and width * height == len(pixels)):
        raise ValueError(f"sides are 1 to {MAX_SIDE}")
    writer = BitWriter()
    writer.put(0x2F, 8)
    writer.put(width - 1, 14)
    writer.put(height - 1, 14)
    writer.put(int(bool((pixels >> 24 != 255).any())), 1)
    writer.put(0, 3)
    data, wide = pixels.astype(np.uint32), width
    blocks = (-(-width >> block_bits)) * (-(-height >> block_bits))
    if palette:
        table, index = np.unique(data, return_inverse=True)
        if len(table) > 256:
            raise ValueError("a palette has 256 colours at most")
        writer.put(1, 1)
        writer.put(PALETTE, 2)
        writer.put(len(table) - 1, 8)
        _write_image(writer, _join(np.diff(_split(table), axis=0, prepend=0)), len(table), False)
        bits = _bundle_bits(len(table))
        data, wide = _bundle(index, width, bits), -(-width >> bits)
    else:
        if subtract_green:
            writer.put(1, 1)
            writer.put(SUBTRACT_GREEN, 2)
            data = _green(data, -1)
        if predictor is not None:
            writer.put(1, 1)
            writer.put(PREDICTOR, 2)
            writer.put(block_bits - 2, 3)
            sub = np.broadcast_to(np.asarray(predictor, np.uint32), blocks) << 8 | np.uint32(0xFF000000)
            _write_image(writer, sub, -(-width >> block_bits), False)
            data = _predict(data, width, sub, block_bits, False)
        if cross is not None:
            writer.put(1, 1)
            writer.put(CROSS_COLOUR, 2)
            writer.put(block_bits - 2, 3)
            sub = np.full(blocks, 255 << 24 | (cross[2] & 255) << 16 | (cross[1] & 255) << 8 | cross[0] & 255, np.uint32)
            _write_image(writer, sub, -(-width >> block_bits), False)
            data = _cross(data, width, sub, block_bits, False)
    writer.put(0, 1)
    _write_image(writer, data, wide, True, cache_bits, matches)
    body = writer.bytes()
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def decode(file: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and pixels (0xAARRGGBB) of a lossless WebP file; ValueError for anything else."""
    if len(file) < 25 or file[:4] != b"RIFF" or file[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    at = 12
    while file[at : at + 4] != b"VP8L":
        if at + 8 > len(file):
            raise ValueError("no lossless image in this file")
        at += 8 + int.from_bytes(file[at + 4 : at + 8], "little")
        at += at & 1
    reader = BitReader(file[at + 8 : at + 8 + int.from_bytes(file[at + 4 : at + 8], "little")])
    if reader.get(8) != 0x2F:
        raise ValueError("no lossless image in this file")
    width, height = reader.get(14) + 1, reader.get(14) + 1
    opaque = not reader.get(1)
    if reader.get(3):
        raise ValueError("an unknown version")
    undo, wide, seen = [], width, set()
    while reader.get(1):
        kind = reader.get(2)
        if kind in seen:
            raise ValueError("a transform twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = reader.get(3) + 2
            sub = _read_image(reader, -(-wide >> bits), -(-height >> bits), False)
            undo.append((_predict if kind == PREDICTOR else _cross, (wide, sub, bits, True)))
        elif kind == SUBTRACT_GREEN:
            undo.append((_green, (1,)))
        else:
            size = reader.get(8) + 1
            table = _join(np.cumsum(_split(_read_image(reader, size, 1, False)), 0))
            bits = _bundle_bits(size)
            undo.append((_unbundle, (wide, bits, table)))
            wide = -(-wide >> bits)
    pixels = _read_image(reader, wide, height, True)
    for inverse, arguments in reversed(undo):
        pixels = inverse(pixels, *arguments)
    return width, height, pixels | np.uint32(0xFF000000) if opaque else pixels


def files(data: bytes) -> list[bytes]:
    """The files that lie one after the other in ``data``, by the sizes they state; what follows the last stays with it."""
    out = []
    while True:
        size = 8 + int.from_bytes(data[4:8], "little")
        size += size & 1
        if data[size : size + 4] != b"RIFF":
            return [*out, data]
        out.append(data[:size])
        data = data[size:]


def sides(samples: int, row: int) -> tuple[int, int]:
    """Width (a multiple of ``row``) and height for so many samples; the last row may be in part unused."""
    wide = row * max(1, math.ceil(samples / row / MAX_SIDE))
    if wide > MAX_SIDE:
        raise ValueError("more samples than an image has")
    return wide, max(1, math.ceil(samples / wide))
