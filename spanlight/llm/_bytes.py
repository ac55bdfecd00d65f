"""Vectorised byte-level helpers shared by the text operators.

Everything here works on Arrow batches: the UTF-8 buffer of a text column is
viewed as one ``uint8`` array, so no Python string is built per row.

Fingerprints are 64-bit polynomial sums over random per-byte words, finished
with a multiply-xorshift mixer.  They identify words, n-grams and windows; two
different strings share one with probability of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled by one round of array operations (a longer document is one round alone).
CHUNK_BYTES = 1 << 20

_ODD = 0x9E3779B97F4A7C15 | 1
_ODD_INV = pow(_ODD, -1, 1 << 64)
_U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64-bit words."""
    x = x ^ (x >> _U64(31))
    x = x * _U64(0x7FB5D329728EA185)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U64(33))


_BYTE_WORD = mix64(np.arange(1, 257, dtype=np.uint64) * _U64(0xD1342543DE82EF95))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the fingerprint base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for k, base in enumerate((_ODD, _ODD_INV)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=np.uint64)
    return _powers[0], _powers[1]


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` reads the fingerprint of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_WORD[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of data[start:end]; equal bytes give equal values at any place."""
    inverse = powers(len(sums))[1]
    return mix64((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def utf8_chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of pieces of about ``limit`` bytes; null reads as empty."""
    column = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        stop = min(stop, n)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and per document the index of its first word (one more at the end)."""
    inside = _IS_WORD[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the lower-cased words and per document the index of its first word."""
    data = lower_ascii(data)
    starts, ends, bounds = words(data, offsets)
    return span_hash(rolling(data), starts, ends), bounds


def crc32_text(ids: np.ndarray) -> np.ndarray:
    """crc32 of each integer written in decimal."""
    import zlib

    return np.fromiter((zlib.crc32(str(x).encode()) for x in ids.tolist()), np.int64, len(ids))
