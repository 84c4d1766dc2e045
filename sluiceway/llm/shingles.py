"""Hashes of words and word shingles over Arrow batches, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Text bytes that are hashed at a time; longer texts go through in pieces.
PIECE = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def different(x: np.ndarray) -> np.ndarray:
    """The different values of an array, sorted; on 64-bit hashes many times faster than ``np.unique``."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class WordHasher:
    """64-bit hashes of the white-space separated words of a byte string.

    A word's hash is a polynomial of its bytes modulo 2**64, taken as the
    difference of two running sums and moved back to power 0.
    """

    def __init__(self) -> None:
        n = 2 * PIECE + 2
        base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]), dtype=np.uint64)
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]), dtype=np.uint64)
        self.values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        self.space = np.zeros(256, dtype=bool)
        self.space[list(SPACES)] = True

    def _piece(self, raw: bytes) -> np.ndarray:
        data = np.frombuffer(raw, dtype=np.uint8)
        if len(data) > 2 * PIECE:  # one word longer than a piece
            return self._long_words(raw)
        inside = ~self.space[data]
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.values[data] * self.powers[: len(data)], dtype=np.uint64)])
        return mix((sums[ends] - sums[starts]) * self.back[starts])

    def _long_words(self, raw: bytes) -> np.ndarray:
        out = []
        for word in raw.split():
            total, at = 0, 1
            for k in range(0, len(word), PIECE):
                part = np.frombuffer(word[k : k + PIECE], dtype=np.uint8)
                total += int(np.sum(self.values[part] * self.powers[: len(part)], dtype=np.uint64)) * at
                at = at * int(self.powers[len(part)]) % (1 << 64)
            out.append(total % (1 << 64))
        return mix(np.array(out, dtype=np.uint64))

    def __call__(self, raw: bytes) -> np.ndarray:
        """Word hashes of a text in order."""
        if len(raw) <= PIECE:
            return self._piece(raw)
        out, at = [], 0
        while at < len(raw):
            end = min(at + PIECE, len(raw))
            while end < len(raw) and raw[end] not in SPACES:
                end += 1
            out.append(self._piece(raw[at:end]))
            at = end
        return np.concatenate(out)

    def texts(self, raws: list[bytes]) -> Iterator[np.ndarray]:
        """Word hashes of each text; short neighbours are hashed together."""
        group: list[bytes] = []
        size = 0
        for raw in [*raws, None]:
            if group and (raw is None or size + len(raw) > PIECE):
                if len(group) == 1:
                    yield self(group[0])
                else:
                    words = [len(g.split()) for g in group]
                    yield from np.split(self(b"\n".join(group)), np.cumsum(words)[:-1])
                group, size = [], 0
            if raw is not None:
                group.append(raw)
                size += len(raw) + 1


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words; of fewer words, of the whole sequence."""
    n = len(words)
    if n == 0:
        return words
    factors = mix(np.arange(101, 101 + width, dtype=np.uint64))
    if n < width:
        return mix(np.sum(words * factors[:n], dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        total += words[k : n - width + 1 + k] * factors[k]
    return mix(total)
