"""Hashed word shingles of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Bytes that are shingled at a time, if one text alone does not have more.
CHUNK = 1 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64) * _GOLD + _GOLD)
_PLACE = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(int(_BASE), n), _powers(pow(int(_BASE), -1, 1 << 64), n)
        return self.up, self.down


POWERS = _Powers()


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """h of one more element than buf: buf[a:b] hashes to (h[b] - h[a]) * base ** -a, modulo 2**64."""
    up, _ = POWERS.get(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=out[1:])
    return out


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield start, i
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


#: Powers for words of usual length; longer words have theirs made anew.
_SHORT = _powers(int(_BASE), 256)


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a buffer that begins and ends with a space, some CHUNK bytes at a time."""
    starts, hashes = [], []
    at = 0
    while at < len(buf) - 1:
        end = min(at + CHUNK, len(buf))
        while end < len(buf):  # a window ends at a space
            back = np.flatnonzero(_SPACE[buf[max(at + 1, end - 4096) : end]])
            if len(back):
                end = max(at + 1, end - 4096) + int(back[-1]) + 1
                break
            end = min(end + CHUNK, len(buf))
        w = buf[at:end]
        letter = np.flatnonzero(~_SPACE[w])
        if len(letter):
            first = np.flatnonzero(np.r_[True, np.diff(letter) > 1])
            size = np.diff(np.r_[first, len(letter)])
            place = np.arange(len(letter)) - np.repeat(first, size)
            powers = _SHORT if size.max() <= len(_SHORT) else _powers(int(_BASE), int(size.max()))
            starts.append(letter[first] + at)
            hashes.append(mix(np.add.reduceat(_BYTE[w[letter]] * powers[place], first)))
        at = end - 1 if end < len(buf) else end
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_counts(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices a:b of the texts: (a, b, row, shingle, count), sorted by row and shingle.

    Words are runs of other bytes than ASCII white space in the lower-case text; a shingle is WORDS words in a row. A
    text of fewer words is one shingle; one without words has none.
    """
    raw = [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    for a, b in chunks(raw):
        buf = np.frombuffer(b" " + b" ".join(raw[a:b]) + b" ", np.uint8)
        starts, word = word_hashes(buf)
        if not len(starts):
            yield a, b, *(np.empty(0, x) for x in (np.int64, np.uint64, np.int64))
            continue
        word = np.concatenate([word, np.zeros(WORDS, np.uint64)])
        text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in raw[a:b]), np.int64, b - a)) + 1
        row = np.searchsorted(text_ends, starts, "right")
        n = np.bincount(row, minlength=b - a)
        last = np.cumsum(n)
        place = np.arange(len(starts)) - (last - n)[row]
        keep = np.flatnonzero((place + WORDS <= n[row]) | (place == 0))
        left = n[row[keep]] - place[keep]
        s = np.zeros(len(keep), np.uint64)
        for j in range(WORDS):
            s += np.where(left > j, word[keep + j] * _PLACE[j], np.uint64(0))
        s, r = mix(s), row[keep]
        order = np.lexsort((s, r))
        s, r = s[order], r[order]
        first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (r[1:] != r[:-1])])
        yield a, b, r[first], s[first], np.diff(np.r_[first, len(s)])
