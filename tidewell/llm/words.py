"""Words of many texts at once, as 64-bit hashes computed with numpy over the raw bytes of an Arrow column.

A word is a run of bytes other than white space (0x20, 0x09-0x0D); A-Z count as a-z.  With ``letters`` it is a run of ASCII
letters, digits and bytes beyond ASCII; with ``signs`` runs of other signs are words of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19  # bytes looked at together; a longer text is cut at white space


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def series(seed: int, count: int) -> np.ndarray:
    """Fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15))


class WordHasher:
    """Hash the words of byte strings: a sum over the word of (value of the byte) * (odd value of its place)."""

    def __init__(self, letters: bool = False, signs: bool = False) -> None:
        fold = np.arange(256)
        fold[65:91] += 32
        self.fold = fold.astype(np.uint8)
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        if letters:
            self.space[:128] = [not chr(i).isalnum() for i in range(128)]
        self.kind = (~self.space).astype(np.uint8)  # a word ends where the kind changes
        if signs:
            self.kind[:128] += [not self.space[i] and not chr(i).isalnum() for i in range(128)]
        self.values = series(1, 256)[fold]
        self.values[self.space] = 0
        self.places = series(2, 256) | np.uint64(1)

    def hash(self, data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes, the place of each word's first byte and the number of words that start before each text.

        ``data`` holds the bytes of texts that begin at ``texts`` (rising places).
        """
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        kind = self.kind[data]
        word = kind > 0
        start = word.copy()
        start[1:] &= kind[1:] != kind[:-1]
        inner = texts[(texts > 0) & (texts < len(data))]
        start[inner] |= word[inner]
        starts = np.flatnonzero(start)
        if not len(starts):
            return np.zeros(0, np.uint64), starts, np.zeros(len(texts), np.int64)
        first = int(starts[0])
        place = np.zeros(len(data), np.int64)
        place[first:] = np.arange(first, len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
        place[~word] = 0
        longest = int(place.max()) + 1
        if longest > len(self.places):
            self.places = series(2, max(longest, 2 * len(self.places))) | np.uint64(1)
        values = self.values[data] * self.places[place]
        return mix(np.add.reduceat(values, starts)), starts, np.searchsorted(starts, texts)

    def column(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, word hashes, bounds) for groups of rows: row ``first + i`` has ``hashes[bounds[i]:bounds[i + 1]]``."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        row = 0
        while row < len(texts):
            last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
            begin, end = int(offsets[row]), int(offsets[last])
            if last == row + 1 and end - begin > CHUNK:
                hashes = np.concatenate([self.hash(piece, np.zeros(1, np.int64))[0] for piece in self._pieces(data[begin:end])])
                bounds = np.array([0, len(hashes)])
            else:
                hashes, _, before = self.hash(data[begin:end], offsets[row:last] - begin)
                bounds = np.append(before, len(hashes))
            yield row, hashes, bounds
            row = last

    def _pieces(self, data: np.ndarray) -> Iterator[np.ndarray]:
        while len(data) > CHUNK:
            breaks = np.flatnonzero(self.space[data[:CHUNK]])
            if not len(breaks):  # a giant word: take it whole
                rest = np.flatnonzero(self.space[data])
                cut = int(rest[0]) if len(rest) else len(data)
            else:
                cut = int(breaks[-1])
            yield data[:cut + 1]
            data = data[cut + 1:]
        yield data


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes, sorted, of ``size`` consecutive words; a shorter text is one shingle, no word is none."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    out = np.full(n - size + 1, np.uint64(size))
    for i in range(size):
        out = mix(out ^ hashes[i:n - size + 1 + i]) + np.uint64(0x9E3779B97F4A7C15)
    return np.unique(out)
