"""Vectorised word and shingle hashing on Arrow string buffers.

A word is a run of ASCII letters, digits and non-ASCII bytes; A-Z is folded
to a-z.  Hashes are 64 bit and the same on every executor.  The byte work is
done in blocks of about 1 MB cut between words, so memory does not follow the
length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_Q = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], dtype=np.uint64)

FOLD = np.zeros(256, dtype=np.uint8)
for _b in range(256):
    if 48 <= _b <= 57 or 97 <= _b <= 122 or _b >= 128:
        FOLD[_b] = _b
    elif 65 <= _b <= 90:
        FOLD[_b] = _b + 32

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) < n:
        n = max(n, BLOCK + 1)
        for name, base in (("p", _P), ("i", _PINV)):
            t = np.full(n, base, dtype=np.uint64)
            t[0] = 1
            _POWERS[name] = np.multiply.accumulate(t)
    return _POWERS["p"], _POWERS["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null text is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    n = len(col)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, is_word: np.ndarray, offsets: np.ndarray, size: int = BLOCK):
    """Cut points between words (or at text starts) about ``size`` bytes apart."""
    n, a = len(data), 0
    while a < n:
        b = min(a + size, n)
        if b < n:
            gap = np.flatnonzero(~is_word[data[a:b]])
            k = np.searchsorted(offsets, b, side="right") - 1
            start = int(offsets[k])
            cut = max(a + int(gap[-1]) + 1 if len(gap) else a, start if start > a else a)
            if cut == a:  # one word longer than a block
                nxt = int(offsets[k + 1]) if k + 1 < len(offsets) else n
                cut = b
                while cut < nxt:
                    more = np.flatnonzero(~is_word[data[cut:min(cut + size, nxt)]])
                    if len(more):
                        cut += int(more[0])
                        break
                    cut = min(cut + size, nxt)
            b = cut
        yield a, b
        a = b


def runs(data: np.ndarray, is_word: np.ndarray, offsets: np.ndarray, a: int, b: int):
    """Starts and ends (relative to ``a``) of the words in data[a:b]; a text start always ends a word."""
    m = is_word[data[a:b]]
    st, en = m.copy(), m.copy()
    st[1:] &= ~m[:-1]
    en[:-1] &= ~m[1:]
    inner = offsets[np.searchsorted(offsets, a, side="right"):np.searchsorted(offsets, b, side="left")] - a
    if len(inner):
        st[inner] = m[inner]
        en[inner - 1] = m[inner - 1]
    return np.flatnonzero(st), np.flatnonzero(en) + 1


_IS_WORD = FOLD != 0


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and hashes of all words; ``bounds[i]:bounds[i+1]`` are text i's."""
    starts, ends, hashes = [], [], []
    for a, b in blocks(data, _IS_WORD, offsets):
        s, e = runs(data, _IS_WORD, offsets, a, b)
        p, inv = _powers(b - a + 1)
        c = np.empty(b - a + 1, dtype=np.uint64)
        c[0] = 0
        np.cumsum(FOLD[data[a:b]].astype(np.uint64) * p[:b - a], out=c[1:])
        hashes.append(mix((c[e] - c[s]) * inv[s]))
        starts.append(s + a)
        ends.append(e + a)
    if not starts:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    return starts, ends, np.concatenate(hashes), np.searchsorted(starts, offsets)


def shingle_sets(h: np.ndarray, bounds: np.ndarray, n: int = 5):
    """Per text the sorted distinct hashes of its n-word shingles; a text of
    1..n-1 words has one shingle of all its words, a text without words none."""
    full = np.zeros(0, np.uint64)
    if len(h) >= n:
        full = h[:len(h) - n + 1] * _Q[0]
        for k in range(1, n):
            full = full + h[k:len(h) - n + 1 + k] * _Q[k]
        full = mix(full)
    for i in range(len(bounds) - 1):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if b - a >= n:
            yield np.unique(full[a:b - n + 1])
        elif b > a:
            yield mix((h[a:b] * _Q[:b - a]).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte position (len + 1 entries)."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
