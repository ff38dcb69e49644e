"""Small dense linear programmes, by the two-phase simplex method."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPS = 1e-10


class Infeasible(ValueError):
    """No point satisfies the constraints."""


class Unbounded(ValueError):
    """The objective falls without end."""


@dataclass
class Solution:
    x: np.ndarray
    value: float
    #: Columns of the optimal basis, and the prices of the equations: value = prices @ b.
    basis: np.ndarray
    prices: np.ndarray


def _pivots(table: np.ndarray, basis: np.ndarray, allowed: int) -> None:
    """Pivot until no reduced cost of the first ``allowed`` columns is negative. The last row holds reduced costs, the last column b.

    The steepest column goes in; after many steps the first (Bland's rule), which can't cycle."""
    for step in range(50 * (table.shape[0] + table.shape[1])):
        costs = table[-1, :allowed]
        falling = np.flatnonzero(costs < -EPS)
        if not len(falling):
            return
        enter = int(falling[0] if step > 10 * table.shape[0] else falling[np.argmin(costs[falling])])
        column = table[:-1, enter]
        rows = np.flatnonzero(column > EPS)
        if not len(rows):
            raise Unbounded
        ratio = table[rows, -1] / column[rows]
        ties = rows[ratio <= ratio.min() + 1e-12]
        leave = int(ties[np.argmin(basis[ties])])
        table[leave] /= table[leave, enter]
        others = np.arange(len(table)) != leave
        table[others] -= np.outer(table[others, enter], table[leave])
        basis[leave] = enter
    raise ValueError("the simplex method didn't end")


def minimise(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> Solution:
    """min c x subject to a x = b, x >= 0."""
    a, b, c = np.array(a, float), np.array(b, float), np.asarray(c, float)
    sign = np.where(b < 0, -1.0, 1.0)
    a, b = a * sign[:, None], b * sign
    m, n = a.shape
    table = np.zeros((m + 1, n + m + 1))
    table[:m, :n], table[:m, n : n + m], table[:m, -1] = a, np.eye(m), b
    table[-1] = -table[:m].sum(axis=0)
    table[-1, n : n + m] = 0
    basis = np.arange(n, n + m)
    _pivots(table, basis, n)
    if table[-1, -1] < -1e-8 * max(1.0, np.abs(b).max(initial=0.0)):
        raise Infeasible
    for row in np.flatnonzero(basis >= n):  # artificial columns left at zero give way where anything can replace them
        column = np.flatnonzero(np.abs(table[row, :n]) > 1e-9)
        if len(column):
            table[row] /= table[row, column[0]]
            others = np.arange(m + 1) != row
            table[others] -= np.outer(table[others, column[0]], table[row])
            basis[row] = column[0]
    full = np.concatenate([c, np.zeros(m)])
    table[-1] = np.concatenate([full, [0.0]]) - full[basis] @ table[:m]
    _pivots(table, basis, n)
    x = np.zeros(n + m)
    x[basis] = table[:m, -1]
    # an artificial column's reduced cost is the negative of its equation's price
    return Solution(x[:n], float(c @ x[:n]), basis.copy(), -table[-1, n : n + m] * sign)
