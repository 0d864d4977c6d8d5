"""Leading eigenpairs of a symmetric matrix by spectrum slicing."""

from __future__ import annotations

import numpy as np

SEED, ROUNDS = 11, 30


def tridiagonal(matrix: np.ndarray) -> tuple[list[float], list[float]]:
    """The diagonal, and the squares beside it, of a tridiagonal matrix with the same eigenvalues, by reflections."""
    rest, diagonal, beside = matrix.copy(), [], []
    while len(rest) > 1:
        diagonal.append(float(rest[0, 0]))
        column = rest[1:, 0].copy()
        length = float(np.linalg.norm(column))
        beside.append(length**2)
        rest = rest[1:, 1:]
        column[0] += np.copysign(length, column[0])
        size = float(column @ column)
        if size > 0:
            mirrored = rest @ column * (2 / size)
            mirrored -= column * (column @ mirrored / size)
            rest = rest - np.outer(column, mirrored) - np.outer(mirrored, column)
    return [*diagonal, float(rest[0, 0])], [0.0, *beside]


def eigenvalues_above(diagonal: list[float], beside: list[float], shift: float) -> int:
    """How many eigenvalues exceed the shift: the positive entries of D in the LDLᵀ factors of the shifted matrix.

    A pivot of zero becomes a tiny negative one, as if the shift were a little higher; in tridiagonal form that needs no
    exchange of rows and moves no eigenvalue by more than rounding.
    """
    tiny = np.finfo(float).tiny * max(1.0, max(beside))
    above, pivot = 0, 1.0
    for a, b in zip(diagonal, beside, strict=True):
        pivot = a - shift - b / pivot
        if abs(pivot) < tiny:
            pivot = -tiny
        above += pivot > 0
    return above


def _refined(matrix: np.ndarray, start: float, earlier: list[np.ndarray], draw: np.random.Generator) -> tuple[float, np.ndarray]:
    """An eigenpair near start, by one step of inverse iteration and then Rayleigh quotients, clear of earlier vectors."""
    identity, scale = np.eye(len(matrix)), np.abs(matrix).max()
    vector, value, residual = draw.normal(size=len(matrix)), start, np.inf

    def cleared(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for e in earlier:
                x = x - e * (e @ x)
        return x / np.linalg.norm(x)

    vector = cleared(vector)
    for step in range(ROUNDS):
        try:
            solved = np.linalg.solve(matrix - value * identity, vector)
        except np.linalg.LinAlgError:
            solved = np.linalg.solve(matrix - (value + 4 * np.finfo(float).eps * scale) * identity, vector)
        peak = float(np.abs(solved).max())
        if not 0 < peak < np.inf:
            break
        after = cleared(solved / peak)
        quotient = float(after @ matrix @ after)
        left = float(np.linalg.norm(matrix @ after - quotient * after))
        if left >= residual and step > 1:
            break
        vector, value, residual = after, quotient if step else (quotient if left < abs(quotient - start) else start), left
    return float(vector @ matrix @ vector), vector


def leading_eigenpairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The count largest eigenvalues of a positive semidefinite matrix, falling, and their unit vectors as rows.

    The k-th is first isolated: bisection halves an interval until inertia counts say that it holds the k-th eigenvalue
    and no other, or until it is as narrow as rounding. Rayleigh quotient iteration then converges from the interval's
    middle. What it found is the k-th if counts just below and just above it are k or more and less than k; if not, the
    interval is halved further. Equal eigenvalues get some orthogonal vectors of their space.
    """
    matrix = (matrix + matrix.T) / 2
    draw = np.random.default_rng(SEED)
    size = float(np.abs(matrix).sum(1).max())
    least = 8 * len(matrix) * np.finfo(float).eps * size
    if size == 0:
        return np.zeros(min(count, len(matrix))), np.eye(len(matrix))[:count]
    form, counts = tridiagonal(matrix), {}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = eigenvalues_above(*form, shift)
        return counts[shift]

    values, vectors = [], []
    for k in range(1, min(count, len(matrix)) + 1):
        known = sorted(counts)
        low = max((s for s in known if counts[s] >= k), default=-size - least)
        high = min((s for s in known if counts[s] < k), default=size + least)
        while True:
            while (above(low) > k or above(high) < k - 1) and high - low > least:
                middle = (low + high) / 2
                low, high = (middle, high) if above(middle) >= k else (low, middle)
            value, vector = _refined(matrix, (low + high) / 2, vectors, draw)
            slack = max(least, 2 * float(np.linalg.norm(matrix @ vector - value * vector)))
            if slack <= 1e-9 * size and above(value - slack) >= k > above(value + slack) or high - low <= least:
                break
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) >= k else (low, middle)
        values.append(value)
        vectors.append(vector)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.array(vectors).reshape(len(values), len(matrix))[order]
