"""Natural cubic spline basis as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

GRID_POINTS = 400


@dataclass(frozen=True)
class NaturalSpline:
    """K inner knots give K + 1 functions that are 0 at the lower boundary and
    linear beyond both boundaries.

    Each is a linear combination of x and the cubes of (x - knot)+; `weights`
    has a row per such term. The combination also makes the functions
    orthonormal on a grid, as the plain cubes are nearly dependent. Any
    invertible change of basis leaves fitted curves and intervals as they are.
    """

    knots: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]

    @property
    def size(self) -> int:
        return len(self.weights[0])

    def columns(self, x: Column) -> list[Column]:
        lower = self.knots[0]
        shifted = x - F.lit(lower)
        cubes = []
        for knot in self.knots:
            above = F.greatest(x - F.lit(knot), F.lit(0.0))
            cubes.append(above * above * above)
        terms = [shifted, *cubes]
        return [
            sum((F.lit(w) * t for w, t in zip(weights[1:], terms[1:])), F.lit(weights[0]) * terms[0])
            for weights in zip(*self.weights)
        ]

    def values(self, x: np.ndarray) -> np.ndarray:
        return _terms(np.asarray(x, dtype=float), np.array(self.knots)) @ np.array(self.weights)


def _terms(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(knots) + 1))
    out[:, 0] = x - knots[0]
    above = np.maximum(x[:, None] - knots[None, :], 0.0)
    # Products: a power of arrays is an order slower.
    out[:, 1:] = above * above * above
    return out


@lru_cache(maxsize=None)
def natural_spline(inner: tuple[float, ...], lower: float, upper: float) -> NaturalSpline:
    knots = np.array([lower, *inner, upper])
    n_inner, last = len(inner), len(knots) - 1
    plain = np.zeros((len(knots) + 1, n_inner + 1))
    plain[0, 0] = 1.0
    closing = 1.0 / (knots[last] - knots[last - 1])
    for k in range(n_inner):
        slope = 1.0 / (knots[last] - knots[k])
        plain[1 + k, 1 + k] += slope
        plain[last, 1 + k] -= closing
        plain[1 + last, 1 + k] += closing - slope
    grid = _terms(np.linspace(lower, upper, GRID_POINTS), knots) @ plain
    triangle = np.linalg.qr(grid / np.sqrt(GRID_POINTS), mode="r")
    weights = plain @ np.linalg.inv(triangle)
    return NaturalSpline(tuple(knots.tolist()), tuple(map(tuple, weights.tolist())))


def ns_basis(x: str | Column, inner: tuple[float, ...], boundary: tuple[float, float]) -> Column:
    """The basis of a column as array<double>."""
    x = F.col(x) if isinstance(x, str) else x
    return F.array(*natural_spline(tuple(inner), *boundary).columns(x))
