"""Texts of an Arrow batch as one byte array, and words and hashes of it, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is worked on alone.
CHUNK = 1_000_000

_BASE, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and the n + 1 offsets of n texts into them; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n, buffers = len(column), column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    if buffers[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str, size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """A batch in runs of rows of about ``size`` bytes of text: the rows, their bytes, and offsets."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def parts(batch: pa.RecordBatch, text: str, size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A batch's texts in runs of at most about ``size`` bytes: the row of each part, the bytes, and offsets.

    A text of more bytes comes in several parts, cut after a space or line end where one stands in the last
    tenth of a part, else between two characters.
    """
    first = 0
    for rows, data, offsets in pieces(batch, text, size):
        n = rows.num_rows
        if n > 1 or len(data) <= size:
            yield np.arange(first, first + n), data, offsets
        else:
            at = 0
            while at < len(data):
                to = min(len(data), at + size)
                if to < len(data):
                    near = np.flatnonzero((data[to - size // 10 : to] == 32) | (data[to - size // 10 : to] == 10))
                    to = to - size // 10 + int(near[-1]) + 1 if len(near) else to
                    while to > at + 1 and to < len(data) and data[to] & 0xC0 == 0x80:
                        to -= 1
                yield np.array([first]), data[at:to], np.array([0, to - at], np.int64)
                at = to
        first += n


def byte_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, ..., base ** n modulo 2 ** 64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Hashes of stretches of a sequence, from prefix sums of a polynomial modulo 2 ** 64; the tables grow as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), -1

    def _tables(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 1 << 16)
            self.up, self.down = powers(self.base, self.n), powers(self.inverse, self.n)

    def __call__(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(values)
        self._tables(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * self.up[:n], dtype=np.uint64, out=sums[1:])
        return (sums[ends] - sums[starts]) * self.down[starts]


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 8-byte blocks of words that are not empty, the last one of each filled up with zeros; the number of each block in its word; the n + 1 offsets."""
    size = (ends - starts + 7) >> 3
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    number = np.arange(at[-1]) - np.repeat(at[:-1], size)
    place = np.repeat(starts, size) + 8 * number
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    every = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    return every[place] & _MASKS[np.minimum(np.repeat(ends, size) - place, 8)], number, at


def hash_blocks(block: np.ndarray, number: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each word: its blocks are mixed with their number before they are summed, so no pattern of letters cancels out."""
    mixed = mix(block + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))
    return mix(np.add.reduceat(mixed, at[:-1]) + length.astype(np.uint64) * np.uint64(_MIX))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of words in order of place, ``CHUNK`` bytes at a time; a longer word is worked on alone."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        part = data[lo:hi] if lower is None else lower[data[lo:hi]]
        out[i:j] = hash_blocks(*blocks(part, starts[i:j] - lo, ends[i:j] - lo), ends[i:j] - starts[i:j])
        i = j
    return out


class Words:
    """Words of texts: places in the bytes, the text each belongs to, and a 64-bit hash of each.

    Bytes are worked on ``CHUNK`` at a time, so that a long text takes little more than its own room; a word
    that stands in several chunks is put together again.
    """

    def __init__(self, gaps: bytes = b" \t\n\x0b\x0c\r", lower: bool = False) -> None:
        self.gap, self.lower = byte_table(gaps), lower_table() if lower else None

    def _chunk(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of a chunk; ``begins`` are the places where texts begin."""
        n = len(data)
        gap = self.gap[data]
        edge = np.zeros(n + 1, bool)
        edge[begins] = True
        edge[0] = edge[n] = True
        before, after = edge[:n].copy(), edge[1:].copy()
        before[1:] |= gap[:-1]
        after[:-1] |= gap[1:]
        return np.flatnonzero(before & ~gap), np.flatnonzero(after & ~gap) + 1

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """starts, ends, hashes, and the n + 1 offsets of the texts into them."""
        n = len(data)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, z.astype(np.uint64), np.zeros(len(offsets), np.int64)
        parts: list[list[np.ndarray]] = []
        for at in range(0, n, CHUNK):
            to = min(n, at + CHUNK)
            lo, hi = np.searchsorted(offsets, [at, to])
            starts, ends = (x + at for x in self._chunk(data[at:to], offsets[lo:hi] - at))
            last = next((p for p in reversed(parts) if len(p[0])), None)
            whole = lo < len(offsets) and offsets[lo] == at
            if last is not None and len(starts) and last[1][-1] == at == starts[0] and not whole:  # one word
                last[1][-1] = ends[0]
                starts, ends = starts[1:], ends[1:]
            parts.append([starts, ends])
        starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
        return starts, ends, hash_words(data, starts, ends, self.lower), np.searchsorted(starts, offsets)


def window_ids(offsets: np.ndarray, k: int) -> np.ndarray:
    """Starts of all windows of k words that lie in one text."""
    n = int(offsets[-1])
    if n < k:
        return np.zeros(0, np.int64)
    last = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(n)
    return at[at + k <= last]


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def shingle_sets(hashes: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct k-word hashes of each text, end to end, and their n + 1 offsets.

    A text of fewer words is one run; a text without words has no member.
    """
    counts = np.diff(offsets)
    starts = window_ids(offsets, k)
    rolling = Rolling(_MIX)
    own = rows_of(offsets)
    long = mix(rolling(hashes, starts, starts + k)) if len(starts) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    few = mix(rolling(hashes, offsets[short], offsets[short + 1])) if len(short) else np.zeros(0, np.uint64)
    keys, rows = np.concatenate([long, few]), np.concatenate([own[starts], short]).astype(np.int64)
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    keys, rows = keys[first], rows[first]
    return keys, np.searchsorted(rows, np.arange(len(counts) + 1))
