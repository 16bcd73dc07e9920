"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a maximal run of bytes other than ASCII white space; as UTF-8 never holds such a
byte inside a character, that is the same as cutting the text into words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are worked on at a time; rows of a batch are dealt into blocks of about this.
BLOCK_BYTES = 1 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE = (np.random.Generator(np.random.Philox(20240521)).integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_POWERS = [np.cumprod(np.full(1024, _STEP, np.uint64))]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.cumprod(np.full(2 * n, _STEP, np.uint64))
    return _POWERS[0]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def row_blocks(batch: pa.RecordBatch, column: int, most: int = BLOCK_BYTES):
    """Slices of a batch whose texts in a column have about `most` bytes together; one row at least."""
    _, offsets = flat(batch.column(column))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of flat texts; fold lower-cases A to Z.

    Worked on in runs of BLOCK_BYTES that end at white space, so a very long text needs no
    more than its words' three numbers each.
    """
    found = []
    lo, n = 0, len(data)
    while lo < n:
        hi = min(lo + BLOCK_BYTES, n)
        if hi < n:
            space = np.flatnonzero(_IS_SPACE[data[lo:hi]])
            if len(space):
                hi = lo + int(space[-1]) + 1
            else:
                later = np.flatnonzero(_IS_SPACE[data[hi:]])
                hi = hi + int(later[0]) + 1 if len(later) else n
        found.append(_run(data[lo:hi], offsets, lo, fold))
        lo = hi
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _run(data: np.ndarray, offsets: np.ndarray, base: int, fold: bool):
    inside = ~_IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[np.searchsorted(offsets, base) : np.searchsorted(offsets, base + len(data))] - base
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner = np.cumsum(first) - 1
    place = np.arange(len(data)) - starts[np.maximum(owner, 0)]
    sizes = np.add.reduceat(inside.astype(np.int64), starts)
    values = _BYTE[_FOLD[data] if fold else data] * _powers(int(sizes.max()) + 1)[np.where(inside, place, 0)]
    values[~inside] = 0
    return starts + base, starts + sizes + base, mix(np.add.reduceat(values, starts) ^ sizes.astype(np.uint64))


def ngrams(hashes: np.ndarray, first_word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the runs of n words inside each text; first_word: each text's first, and the end."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(m, np.uint64(n))
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + m]
    text = np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))
    whole = text[:m] == text[n - 1 :]
    return mix(out[whole]), text[:m][whole]


def pack_ascending(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as 32-bit differences in byte planes; larger ones follow whole."""
    steps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    large = steps >= 0xFFFFFFFF
    small = np.where(large, np.uint64(0xFFFFFFFF), steps).astype("<u4")
    planes = np.ascontiguousarray(small.view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(4, "little") + planes.tobytes() + steps[large].astype("<u8").tobytes()


def unpack_ascending(body: bytes) -> np.ndarray:
    """The values of pack_ascending()."""
    n = int.from_bytes(body[:4], "little")
    planes = np.frombuffer(body, np.uint8, 4 * n, 4).reshape(4, n)
    steps = np.ascontiguousarray(planes.T).reshape(-1).view("<u4").astype(np.uint64)
    steps[steps == 0xFFFFFFFF] = np.frombuffer(body, "<u8", offset=4 + 4 * n)
    return np.cumsum(steps, dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as bytes; those from 255 on follow as 64-bit numbers."""
    large = counts >= 255
    return len(counts).to_bytes(4, "little") + np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<u8").tobytes()


def unpack_counts(body: bytes) -> np.ndarray:
    """The counts of pack_counts()."""
    n = int.from_bytes(body[:4], "little")
    out = np.frombuffer(body, np.uint8, n, 4).astype(np.int64)
    out[out == 255] = np.frombuffer(body, "<u8", offset=4 + n)
    return out
