"""Hashed word shingles of whole texts, as numpy arrays.

Words are runs without white space, with A-Z lower-cased.  A word's hash is a
polynomial over random values of its bytes, taken from running sums over many
texts at once, so no word becomes a Python object.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_I = np.uint64(pow(int(_P), -1, 1 << 64))
M = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_BLANKS = b" \t\n\v\f\r"


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Words:
    """Hashes words; one per task, as it keeps tables of powers."""

    def __init__(self):
        value = np.random.default_rng(20250101).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        value[65:91] = value[97:123]
        value[list(_BLANKS)] = 0
        self.value, self.is_word = value, value > 0
        self._grow(SEGMENT + 1)

    def _grow(self, n: int) -> None:
        self.up, self.down = np.empty(n, np.uint64), np.empty(n, np.uint64)
        for table, base in ((self.up, _P), (self.down, _I)):
            table[:] = base
            table[0] = 1
            np.multiply.accumulate(table, out=table)

    def _hashes(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start of each word of one segment."""
        b = np.frombuffer(data, dtype=np.uint8)
        n = len(b)
        if n > len(self.up):
            self._grow(n)
        inside = self.is_word[b]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[b] * self.up[:n], out=total[1:])
        return mix((total[ends] - total[starts]) * self.down[starts]), starts

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts in a row, and where each text's begin (one more at the end)."""
        hashes, counts = [], np.zeros(len(texts), np.int64)
        i = 0
        while i < len(texts):
            j, size, offsets = i, 0, []
            while j < len(texts) and (j == i or size + len(texts[j]) < SEGMENT):
                offsets.append(size)
                size += len(texts[j]) + 1
                j += 1
            if j == i + 1 and size > SEGMENT:
                for part in _parts(texts[i]):
                    h, _ = self._hashes(part)
                    hashes.append(h)
                    counts[i] += len(h)
            else:
                h, starts = self._hashes(b" ".join(texts[i:j]))
                hashes.append(h)
                counts[i:j] = np.diff(np.searchsorted(starts, offsets + [size]))
            i = j
        return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def _parts(text: bytes):
    """A long text in pieces, each cut at white space, or whole words longer than a segment."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SEGMENT)
        if end < len(text):
            cut = max(text.rfind(bytes([c]), at, end) for c in _BLANKS)
            if cut <= at:
                cut = min([k for c in _BLANKS if (k := text.find(bytes([c]), end)) >= 0], default=len(text))
            end = cut
        yield text[at:end]
        at = end + (end < len(text))


def shingle_runs(h: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the width-word shingles of each text in order, and where each text's begin.

    A text with fewer words has its whole sequence as its one shingle; without
    words it has none.
    """
    n = np.diff(at)
    m = len(h)
    if not m:
        return h, np.zeros(len(at), np.int64)
    out = h * M[0]
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    for i in range(1, width):
        out += padded[i : m + i] * M[i % 5]
        out ^= out >> np.uint64(29)
        out *= M[(i + 2) % 5]
    out = mix(out)
    keep = np.ones(m, bool)
    for i in range(1, width):
        tail = at[1:] - i
        keep[tail[tail >= at[:-1]]] = False
    for k in np.flatnonzero((n > 0) & (n < width)):
        own = h[at[k] : at[k + 1]]
        s = np.uint64(len(own))
        for i, x in enumerate(own):
            s = mix(np.array([s * M[0] + x + np.uint64(i)]))[0]
        out[at[k]], keep[at[k]] = s, True
    return out[keep], np.concatenate([[0], np.cumsum(np.where(n >= width, n - width + 1, np.minimum(n, 1)))])


def shingle_sets(words: Words, texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    with np.errstate(over="ignore"):
        s, at = shingle_runs(*words.of(texts), width)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        x = np.sort(s[a:b])
        out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x)
    return out
