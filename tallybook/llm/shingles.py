"""Word shingles of whole texts, hashed in numpy, a batch of texts at a time."""

from __future__ import annotations

import hashlib

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
#: A fixed random 64-bit number for each byte; words are hashed as polynomials of them.
BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64)
BYTES[ord("A") : ord("Z") + 1] = BYTES[ord("a") : ord("z") + 1]
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD ** i and its inverse, for i below n, modulo 2 ** 64."""
    global _POWERS
    if len(_POWERS[0]) < n:
        inverse = pow(int(ODD), -1, 1 << 64)
        _POWERS = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1 << 16), x, np.uint64))]) for x in (ODD, np.uint64(inverse)))
    return _POWERS


_POWERS: tuple[np.ndarray, np.ndarray] = (np.ones(0, np.uint64), np.ones(0, np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, ASCII capitals as small letters; number of words of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    separator = SEPARATOR[data]
    begins = np.flatnonzero(~separator & np.concatenate([[True], separator[:-1]]))
    ends = np.flatnonzero(separator & np.concatenate([[False], ~separator[:-1]]))
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[data] * up[: len(data)])])
    hashed = mixed((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))
    stops = np.cumsum([len(t) + 1 for t in texts])
    return hashed, np.diff(np.searchsorted(begins, stops), prepend=0)


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """For each text, its distinct shingles as ascending 64-bit hashes: runs of `width` words, or all words if fewer.

    A text without words has none.
    """
    hashed, counts = word_hashes(texts)
    n = len(hashed)
    rolled = np.zeros(n, np.uint64)
    for i in range(width):
        rolled[: max(0, n - i)] = mixed(rolled[: max(0, n - i)] * ODD + hashed[i:])
    out, at = [], 0
    for count in counts.tolist():
        if count >= width:
            out.append(np.unique(rolled[at : at + count - width + 1]))
        elif count:
            whole = np.array([count], np.uint64)
            for i in range(at, at + count):
                whole = mixed(whole * ODD + hashed[i : i + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=16).digest()
