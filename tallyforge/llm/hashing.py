"""64-bit hashes of words, worked out for whole buffers of text at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that separate words: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
U = np.uint64
_rng = np.random.default_rng(20240607)
LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
P = U(0x9E3779B97F4A7C15)
P_INVERSE = U(pow(int(P), -1, 1 << 64))
END = U(0x51ED270B0A3F9C4D)
#: Bytes that are worked on at once; a longer document or word makes a longer buffer.
BYTES = 1 << 21

_powers: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, p in enumerate((P, P_INVERSE)):
            x = np.full(max(n + n // 8, 1 << 19), p, np.uint64)
            x[0] = U(1)
            _powers[k] = np.cumprod(x)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a buffer, A-Z lowered."""
    b = np.frombuffer(data.lower(), np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[b], [True]]).view(np.int8)))
    first, last = edge[::2], edge[1::2]
    up, down = powers(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(LETTER[b] * up, out=total[1:])
    return mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)), first


def documents(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after the other; where each text's words begin, with the total at the end."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.cumsum([0, *(len(d) + 1 for d in data)])
    h, first = words(b"\n".join(data))
    return h, np.append(np.searchsorted(first, starts[:-1]), len(h))


def batches(column: pa.Array, size: int = BYTES) -> Iterator[tuple[int, list[str]]]:
    """First row and texts (null: empty) of runs of rows of about `size` characters."""
    first, run, n = 0, [], 0
    for i, t in enumerate(column):
        run.append(t.as_py() or "")
        n += len(run[-1])
        if n >= size:
            yield first, run
            first, run, n = i + 1, [], 0
    if run:
        yield first, run
