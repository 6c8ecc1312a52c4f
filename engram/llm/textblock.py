"""Whole texts as one byte block per Arrow batch, and vectorised scans over it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are scanned at once. A longer text makes a block of its own.
BLOCK_BYTES = 2 << 20

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Block:
    """Consecutive texts: ``data`` holds their bytes, text t is ``data[offsets[t]:offsets[t + 1]]``."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        self.rows, self.data, self.offsets = rows, data, offsets

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        """The text that holds each byte position."""
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of one value a byte, for each text."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return np.diff(total[self.offsets])

    def words(self, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes b with letter[b], within texts."""
        return runs(letter[self.data], self.offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs that don't cross offsets."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The rows of the batches in blocks of about ``limit`` bytes of text. A null text counts as empty."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        if col.null_count:
            col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
        wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
        _, off, val = col.buffers()
        offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if off and len(col) else np.zeros(len(col) + 1, np.int64)
        data = np.frombuffer(val, np.uint8) if val else np.zeros(0, np.uint8)
        start = 0
        while start < len(col):
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), len(col))
            yield Block(batch.slice(start, end - start), data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
            start = end


class RollingHash:
    """Hashes of any byte range of a block from prefix sums of powers, modulo 2**64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 1):
        n = len(data)
        letter = mix(np.arange(1, 257, dtype=U64) * U64(2 * seed + 1) * _ODD)
        power, self.inverse = self._table(seed, n)
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum(letter[data] * power[:n], out=self.prefix[1:])

    @classmethod
    def _table(cls, seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(seed)
        if have is None or len(have[0]) < n + 1:
            base = int(mix(np.array([seed], U64))[0]) | 1
            size = n + n // 4 + 2
            have = tuple(_geometric(b, size) for b in (base, pow(base, -1, 1 << 64)))
            if size <= 4 * BLOCK_BYTES:
                cls._powers[seed] = have
        return have

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts] + (ends - starts).astype(U64))


def _geometric(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def letters(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true in the closed ranges."""
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: Anything but white space of ASCII.
WORD = ~letters((0x20, 0x20), (0x09, 0x0D))
#: Letters and digits of ASCII and all beyond ASCII.
TERM = letters((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data).astype(np.uint8)
