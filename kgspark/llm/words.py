"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import numpy as np

#: Texts of a slice go through the arrays together; a slice ends at about this many bytes.
SLICE_BYTES = 1 << 19
#: Bytes hashed at once; a longer slice (one long text) is cut at white space.
CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n of each at least; only tables of CHUNK_BYTES are kept."""
    if n <= CHUNK_BYTES and _powers:
        return _powers
    tables = []
    for base in (_BASE, _INVERSE):
        table = np.full(max(n, CHUNK_BYTES), base, np.uint64)
        table[0] = 1
        tables.append(np.cumprod(table))
    if n <= CHUNK_BYTES:
        _powers.extend(tables)
    return tables


def slices(texts: list[str | None]):
    """(first, encoded) of runs of texts of about SLICE_BYTES bytes; a null text is an empty one."""
    first, now, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if now and size + len(raw) > SLICE_BYTES:
            yield first, now
            first, now, size = i, [], 0
        now.append(raw)
        size += len(raw) + 1
    if now:
        yield first, now


def _chunks(data: np.ndarray, space: np.ndarray):
    """(first, last) of chunks of about CHUNK_BYTES bytes that end behind white space; a longer word makes a longer chunk."""
    first = 0
    while first < len(data):
        last = min(first + CHUNK_BYTES - 1, len(data))
        while last < len(data) and not space[last - 1]:
            ahead = np.flatnonzero(space[last : last + CHUNK_BYTES])
            last = last + int(ahead[0]) + 1 if len(ahead) else min(last + CHUNK_BYTES, len(data))
        yield first, last
        first = last


def word_hashes(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): of all words `[^ \\t-\\r]+` of the texts, A-Z lower-cased; text i has hashes[ends[i]:ends[i + 1]].

    A word's hash is a polynomial over its bytes, taken from running sums. Very
    long texts go through in chunks cut at white space.
    """
    data = np.frombuffer(b"\n".join(encoded).translate(_LOWER) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
    starts, stops = edge[0::2], edge[1::2]
    hashes = np.empty(len(starts), np.uint64)
    for first, last in _chunks(data, space):
        low, high = np.searchsorted(starts, (first, last))
        power, inverse = _power_tables(last - first + 1)
        total = np.zeros(last - first + 1, np.uint64)
        np.cumsum(_BYTES[data[first:last]] * power[: last - first], out=total[1:])
        begin, end = starts[low:high] - first, stops[low:high] - first
        hashes[low:high] = mixed((total[end] - total[begin]) * inverse[begin])
    begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in encoded])])
    return hashes, np.searchsorted(starts, begins)


def shingle_sets(encoded: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Each text's set of word shingles as sorted distinct hashes; of fewer words, the whole sequence is one shingle."""
    hashes, ends = word_hashes(encoded)
    power = [np.uint64(pow(int(_BASE), k + 1, 1 << 64)) for k in range(words)]
    n = len(hashes) - words + 1
    runs = np.zeros(max(n, 0), np.uint64)
    for k in range(words if n > 0 else 0):
        runs += hashes[k : k + n] * power[k]
    runs = mixed(runs)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            weights = np.array([*power[: b - a], 1], np.uint64)
            out.append(mixed((np.append(hashes[a:b], np.uint64(b - a)) * weights).sum(keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
