"""Hashes of words and word shingles of many texts at once, with numpy."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SPAN = 1 << 20  # bytes whose prefix sums are taken together

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """Finds and hashes words: runs of bytes other than white space."""

    def __init__(self) -> None:
        steps = np.full(SPAN, BASE, dtype=U)
        steps[0] = 1
        self.up = np.multiply.accumulate(steps)
        steps[1:] = BASE_INVERSE
        self.down = np.multiply.accumulate(steps)

    @staticmethod
    def spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words of the texts data[ends[i]:ends[i + 1]], and how many each text has."""
        a, b = int(ends[0]), int(ends[-1])
        dark = np.zeros(b - a + 1, dtype=bool)
        dark[:-1] = ~_SPACE[data[a:b]]
        cut = np.zeros(b - a + 1, dtype=bool)
        cut[ends - a] = True
        before = np.zeros_like(dark)
        before[1:] = dark[:-1]
        starts = np.flatnonzero(dark & (~before | cut))
        stops = np.flatnonzero(before & (~dark | cut))
        counts = np.diff(np.searchsorted(starts, ends - a))
        return starts + a, stops + a, counts

    def hashes(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Hash of each word; words lie in order."""
        out = np.zeros(len(starts), dtype=U)
        i = 0
        while i < len(starts):
            at = int(starts[i])
            j = int(np.searchsorted(stops, at + SPAN, side="right"))
            if j <= i:  # a word longer than a span
                out[i] = int.from_bytes(hashlib.blake2b(data[at:stops[i]].tobytes(), digest_size=8).digest(), "little")
                i += 1
                continue
            part = data[at:int(stops[j - 1])].astype(U)
            part += U(1)
            sums = np.zeros(len(part) + 1, dtype=U)
            np.cumsum(part * self.up[:len(part)], out=sums[1:])
            s, e = starts[i:j] - at, stops[i:j] - at
            out[i:j] = (sums[e] - sums[s]) * self.down[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93)
            i = j
        return mixed(out)


def shingles(words: np.ndarray, counts: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words, and how many each text has; a text of fewer words has one shingle of all."""
    firsts = np.concatenate([[0], np.cumsum(counts)])
    short = (counts > 0) & (counts < n)
    per = np.where(short, 1, np.maximum(counts - (n - 1), 0))
    at = np.repeat(firsts[:-1], per) + (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
    length = np.repeat(np.minimum(counts, n), per)
    padded = np.concatenate([words, np.zeros(n, dtype=U)])
    out = padded[at]
    for k in range(1, n):
        more = mixed(out) * U(0x9FB21C651E98DF25) + padded[at + k]
        out = np.where(length > k, more, out) if short.any() else more
    return mixed(out + length.astype(U)), per
