"""Polynomial prefix hashes of bytes, and content-defined anchors of fixed-length windows.

Every window of ``WINDOW`` bytes has an anchor: its leftmost ``GRAM``-byte string of least hash. Equal
windows have equal anchors at equal offsets, so repeats can be looked for anchor by anchor; an
anchor serves about 35 neighbouring windows, its piece."""

from __future__ import annotations

import numpy as np

U = np.uint64
WINDOW, GRAM = 100, 32
SPAN = WINDOW - GRAM + 1
BITS = 17
CHUNK = 1 << BITS  # bytes searched for anchors at once; such arrays stay in the processor's cache
LOW = U(CHUNK - 1)

_rng = np.random.default_rng(20240501)
BYTE = [_rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1) for _ in range(2)]
BASE = [U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse modulo 2**64."""
    if which not in _powers or len(_powers[which][0]) < n:
        size = max(CHUNK + 1, 1 << n.bit_length())
        b = BASE[which]
        full = lambda x: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)]))
        _powers[which] = full(b), full(U(pow(int(b), -1, 1 << 64)))
    return _powers[which]


def prefixes(data: np.ndarray, which: int = 0) -> np.ndarray:
    """p[i]: the polynomial hash of the first i bytes."""
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[which][data] * powers(which, len(data))[0][:len(data)], out=p[1:])
    return p


def hashes(p: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the byte strings [start, end), equal for equal strings wherever they lie."""
    return (p[end] - p[start]) * powers(which, len(p))[1][start]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    return x ^ (x >> U(29))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one behind the other in ``data`` and end at ``ends``: hash of each anchor, its first and
    last window start, and the prefix hashes."""
    p = prefixes(data)
    n = len(data)
    none = np.empty(0, np.int64)
    if n < WINDOW:
        return none.astype(np.uint64), none, none, p
    g = mixed((p[GRAM:] - p[:-GRAM]) * powers(0, n)[1][:n - GRAM + 1])
    x = (g & ~LOW) | np.arange(len(g), dtype=np.uint64)
    size = 1
    while 2 * size <= SPAN:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    if SPAN > size:
        x = np.minimum(x[:-(SPAN - size)], x[SPAN - size:])
    at = (x & LOW).astype(np.int64)  # by window start
    starts = np.concatenate([[0], ends[:-1]])
    # window starts whose window ends inside its text
    count = np.maximum(ends - starts - WINDOW + 1, 0)
    s = np.repeat(starts, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    a = at[s]
    new = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else none
    # neighbouring texts can't share an anchor, for a window lies in one text
    last = np.append(new[1:], len(a)) - 1 if len(a) else none
    return g[a[new]], s[new], s[last], p


def spread(sizes: np.ndarray):
    """Groups of parts (start, end) of texts that lie one behind the other, of at most ``CHUNK`` bytes a
    group. Longer texts are cut with an overlap, so that every window lies in just one part."""
    group, size, start = [], 0, 0
    for n in sizes.tolist():
        at = 0
        while n - at >= WINDOW:
            length = min(CHUNK, n - at)
            if size + length > CHUNK:
                yield group
                group, size = [], 0
            group.append((start + at, start + at + length))
            size += length
            if at + length >= n:
                break
            at += length - WINDOW + 1
        start += n
    if group:
        yield group


def chunk_anchors(data: np.ndarray, sizes: np.ndarray):
    """Of all windows of texts that lie one behind the other in ``data``: hash of each anchor, hash of its
    piece (all bytes of its windows), first window start and number of windows."""
    out = [(np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
    for group in spread(sizes):
        at = np.array(group)
        size = at[:, 1] - at[:, 0]
        ends = np.cumsum(size)
        # parts of neighbouring texts mostly lie side by side already
        own = data[at[0, 0]:at[-1, 1]] if at[-1, 1] - at[0, 0] == ends[-1] else np.concatenate([data[a:b] for a, b in group])
        g, first, last, p = anchors(own, ends)
        if not len(g):
            continue
        piece = mixed(hashes(p, first, last + WINDOW) + U(0x9E3779B97F4A7C15) * (last - first).astype(np.uint64))
        part = np.searchsorted(ends, first, side="right")
        out.append((g, piece, first + (at[:, 0] - (ends - size))[part], last - first + 1))
    return tuple(np.concatenate([x[k] for x in out]) for k in range(4))
