"""Eigendecompositions that grow by one vector at a time.

A ``Spectrum`` holds the number and mean of some vectors and the eigenvalues and eigenvectors of their
scatter, the sum of ``(x - mean)(x - mean)'``. A vector changes the scatter by a matrix of rank one, and
with known eigenvectors the new eigenvalues are the roots of a secular equation ``1 + rho * sum(z_j^2 /
(d_j - t)) = 0``, one between each two old eigenvalues. Directions the vector doesn't touch, and all but
one direction of equal eigenvalues, are deflated: they stay as they are. The weights ``z`` are computed
anew from the roots found (Gu and Eisenstat, 1994), so that eigenvectors stay orthogonal to rounding.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps
_ROUNDS = 60


class Spectrum:
    def __init__(self, dimension: int):
        self.n = 0
        self.mean = np.zeros(dimension)
        self.values = np.zeros(dimension)  # ascending
        self.vectors = np.eye(dimension)  # columns

    @classmethod
    def of(cls, n: int, mean, values, vectors) -> Spectrum:
        out = cls(len(mean))
        out.n, out.mean, out.values = int(n), np.array(mean, float), np.array(values, float)
        out.vectors = np.array(vectors, float).reshape(len(mean), len(mean))
        return out

    def add(self, x: np.ndarray) -> None:
        """One more vector: its distance from the mean is a centred update of rank one."""
        off = x - self.mean
        self.update(self.n / (self.n + 1), off)
        self.n += 1
        self.mean = self.mean + off / self.n

    def merge(self, other: Spectrum) -> None:
        """The vectors of another spectrum: one update for each of its eigenvectors, one for the means."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            self.update(value, vector)
        off = other.mean - self.mean
        total = self.n + other.n
        self.update(self.n * other.n / total, off)
        self.mean = self.mean + off * (other.n / total)
        self.n = total

    def update(self, rho: float, x: np.ndarray) -> None:
        """The decomposition of the scatter plus ``rho * x x'``, ``rho`` not negative."""
        weight = self.vectors.T @ x
        size = np.sqrt(weight @ weight)
        if rho <= 0 or size == 0:
            return
        z, rho = weight / size, rho * size * size
        self._part_equals(z, rho)
        touched = np.flatnonzero(np.abs(z) * rho > _EPS * max(self.values[-1], rho) / 8)
        if not len(touched):
            return
        roots, turned = solve(self.values[touched], z[touched], rho)
        self.values[touched] = roots
        self.vectors[:, touched] = self.vectors[:, touched] @ turned
        order = np.argsort(self.values, kind="stable")
        self.values, self.vectors = self.values[order], self.vectors[:, order]

    def _part_equals(self, z: np.ndarray, rho: float) -> None:
        """In each run of equal eigenvalues, turn the eigenvectors so that one of them takes all weight."""
        near = np.diff(self.values) <= 4 * _EPS * max(self.values[-1], rho)
        if not near.any():
            return
        edges = np.flatnonzero(np.diff(np.concatenate([[0], near.astype(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), (edges[1::2] + 1).tolist(), strict=True):
            part = z[a:b]
            length = np.sqrt(part @ part)
            if length == 0:
                continue
            mirror = part.copy()
            mirror[-1] += np.copysign(length, part[-1])
            mirror /= np.sqrt(mirror @ mirror)
            run = self.vectors[:, a:b]
            self.vectors[:, a:b] = run - 2 * np.outer(run @ mirror, mirror)
            last = -np.copysign(length, part[-1])
            z[a:b] = 0
            z[b - 1] = last


def solve(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and eigenvectors of ``diag(d) + rho z z'``.

    ``d`` is ascending without equal entries, ``z`` has no zeros. Each root is held as its distance from
    the nearer of the poles beside it. A step takes the root of a rational curve that has both poles; a step
    out of the bracket is replaced by a bisection.
    """
    k = len(d)
    squares = rho * z * z
    if k == 1:
        return d + squares, np.ones((1, 1))
    right = np.append(d[1:], d[-1] + squares.sum())
    gap = right - d
    at_middle = 1 + (squares / (d - (d + gap / 2)[:, None])).sum(1)
    from_left = at_middle >= 0
    from_left[-1] = True
    origin = np.where(from_left, d, right)
    poles = d - origin[:, None]
    low = np.where(from_left, 0.0, -gap / 2)
    high = np.where(from_left, gap / 2, 0.0)
    if at_middle[-1] < 0:
        low[-1], high[-1] = gap[-1] / 2, gap[-1]
    else:
        high[-1] = gap[-1] / 2
    t = (low + high) / 2
    before = np.tri(k)
    ones = np.ones(k)
    row = np.arange(k)
    after = np.minimum(row + 1, k - 1)
    for _ in range(_ROUNDS):
        off = poles - t[:, None]
        inverse = 1 / off
        term = squares * inverse
        slope = term * inverse
        value = 1 + term @ ones
        done = np.abs(value) <= 16 * _EPS * (1 + np.abs(term) @ ones)
        narrow = high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high))
        if (done | narrow).all():
            break
        high = np.where(value > 0, t, high)
        low = np.where(value <= 0, t, low)
        whole = slope @ ones
        first = (slope * before) @ ones
        x, y = off[row, row], off[row, after]
        # of the last root, both poles are to the left
        x[-1], y[-1] = off[-1, -2], off[-1, -1]
        first[-1] = whole[-1] - slope[-1, -1]
        a = (x + y) * value - x * y * whole
        b = x * y * value
        c = value - x * first - y * (whole - first)
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(all="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = (a[-1] + root[-1]) / (2 * c[-1]) if a[-1] >= 0 else 2 * b[-1] / (a[-1] - root[-1])
            moved = t + step
        fine = np.isfinite(moved) & (moved > low) & (moved < high)
        t = np.where(done, t, np.where(fine, moved, (low + high) / 2))
    off = poles - t[:, None]  # [i, j]: d_j - root_i
    apart = d - d[:, None]  # [i, j]: d_j - d_i
    # the weights for which the roots found are exact: each root over the pole that it is nearer to d_j than
    ratio = off / np.where(before > 0, np.vstack([apart[1:], np.full(k, -1.0)]), apart)
    exact = np.copysign(np.sqrt(np.abs(ratio.prod(0))), z)
    turned = exact / off
    turned /= np.sqrt((turned * turned).sum(1))[:, None]
    return origin + t, turned.T
