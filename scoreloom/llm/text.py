"""Words of whole Arrow batches as numpy arrays of positions and 64-bit hashes."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLANKS = np.zeros(256, bool)
BLANKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), (1 << 18) + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and row borders of runs of rows of about ``size`` bytes; null rows are empty.

    A longer text is a slice of its own, so texts are never cut.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if n == 0:
        return
    borders = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset: texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(borders, borders[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield raw[borders[first]: borders[last]], borders[first: last + 1] - borders[first]
        first = last


def spans(data: np.ndarray, borders: np.ndarray, kinds: np.ndarray):
    """Start, end and row of every run of bytes of one kind (0 is none); runs do not cross rows."""
    kind = kinds[data]
    change = np.zeros(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[borders] = True
    inside = kind != 0
    starts, ends = np.flatnonzero(inside & change[:-1]), np.flatnonzero(inside & change[1:]) + 1
    return starts, ends, np.searchsorted(borders, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes."""
    up, down = _powers_to(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
