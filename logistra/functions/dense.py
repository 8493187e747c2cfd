"""Numpy routines over a stack of square matrices, shape (k, d, d).

Spark hands one Arrow batch of keyed matrices to each call. All of them rest on
one elimination, so a matrix is singular by the same test at every width: a
pivot that is exactly 0. A NaN or infinite cell stays within its own matrix.
"""

from __future__ import annotations

import numpy as np


def upper_triangle(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eliminate below the diagonal without scaling rows; columns may follow the square.

    Rows move only where the pivot is exactly 0: the first lower row with a
    non-zero cell becomes the pivot row and the rows above it shift down by
    one. Returns the triangles and the sign of the moves (0: no pivot found).
    """
    u = np.array(stack, dtype=np.float64)
    k, d = u.shape[0], u.shape[1]
    sign = np.ones(k, dtype=np.int32)
    for col in range(d - 1):
        for m in np.flatnonzero(u[:, col, col] == 0):
            usable = np.flatnonzero(u[m, col:, col])
            if usable.size == 0:
                sign[m] = 0
            else:
                shift = int(usable[0])
                u[m, col : col + shift + 1] = np.roll(u[m, col : col + shift + 1], 1, axis=0)
                sign[m] *= (-1) ** shift
        pivot = u[:, col, col]
        usable = pivot != 0
        safe = np.where(usable, pivot, 1.0)
        with np.errstate(all="ignore"):
            factor = np.where(usable[:, None], u[:, col + 1 :, col] / safe[:, None], 0.0)
            u[:, col + 1 :, col:] -= factor[:, :, None] * u[:, None, col, col:]
        u[usable, col + 1 :, col] = 0.0
    return u, sign


def pivots(triangle: np.ndarray) -> np.ndarray:
    return np.diagonal(triangle, axis1=1, axis2=2)


def determinant(stack: np.ndarray) -> np.ndarray:
    return signed_determinant(stack)[0]


def signed_determinant(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Determinants, their signs and the logarithms of their sizes.

    Sign and logarithm come from the pivots, so they neither over- nor underflow.
    """
    u, moves = upper_triangle(stack)
    p = pivots(u)
    with np.errstate(all="ignore"):
        # Plus 0.0: a singular matrix has sign 0.0, never -0.0.
        sign = np.prod(np.sign(p), axis=1) * moves + 0.0
        log_abs = np.where(sign == 0, -np.inf, np.log(np.abs(p)).sum(axis=1))
        return np.where(sign == 0, 0.0, np.prod(p, axis=1) * moves), sign, log_abs


def adjugate(stack: np.ndarray) -> np.ndarray:
    """Transposed cofactors, also for singular matrices, from one elimination each.

    Rows and columns are exchanged so that the largest remaining cell is the next pivot,
    which leaves the smallest pivot u for the end: P A Q = L U with U = [[U1, b], [0, u]].
    The adjugate is then +-det(U1) Q [[u U1^-1, -U1^-1 b], [0, 1]] L^-1 P. Nothing is
    divided by u, so the same formula holds for rank d, where it is det * inverse, for rank
    d - 1, where it is the product of both null vectors, and close to it; at lower
    ranks det(U1) is 0. Its error, relative to its largest cell, is that of solving with U1 and L
    in double precision, and thus follows the second smallest pivot, not the smallest.
    A matrix with a NaN or infinite cell has its minors eliminated one by one, since
    cofactors that leave the cell out are finite.
    """
    finite = np.isfinite(stack).all(axis=(1, 2))
    if not finite.all():
        out = np.empty(stack.shape)
        out[finite] = adjugate(stack[finite])
        for m in np.flatnonzero(~finite):
            out[m] = _adjugate_by_minors(stack[m])
        return out
    k, d = stack.shape[0], stack.shape[1]
    u, rows, columns, sign = _complete_triangle(stack)
    p = pivots(u)
    lower = np.tril(u, -1) + np.eye(d)
    low_rank = (p[:, :-1] == 0).any(axis=1)
    safe = np.where(p == 0, 1.0, p)
    # [[u U1^-1, -U1^-1 b], [0, 1]], solved from the last row of U1 upwards.
    middle = np.zeros((k, d, d))
    middle[:, -1, -1] = 1.0
    with np.errstate(all="ignore"):
        for i in reversed(range(d - 1)):
            middle[:, i, i] = p[:, -1]
            middle[:, i, -1] = -u[:, i, -1]
            known = (u[:, i, None, i + 1 : d - 1] @ middle[:, i + 1 : d - 1])[:, 0]
            middle[:, i] = (middle[:, i] - known) / safe[:, i, None]
        # middle * L^-1, column by column from the last.
        for j in reversed(range(d - 1)):
            middle[:, :, j] -= (middle[:, :, j + 1 :] @ lower[:, j + 1 :, j, None])[:, :, 0]
        scale, exponent = _product(p[:, :-1])
        out = np.ldexp(middle * (scale * sign)[:, None, None], exponent[:, None, None])
    out[low_rank] = 0.0
    # Undo the exchanges: row r of the result belongs to column columns[r] of the matrix.
    placed = np.empty_like(out)
    at = np.arange(k)[:, None, None]
    placed[at, columns[:, :, None], rows[:, None, :]] = out
    return placed + 0.0


def _adjugate_by_minors(matrix: np.ndarray) -> np.ndarray:
    d = len(matrix)
    out = np.empty((d, d))
    others = np.array([[c for c in range(d) if c != j] for j in range(d)], dtype=int).reshape(d, -1)
    for i in range(d):
        # Minors without row i, for each column left out.
        minors = matrix[others[i]][:, others].transpose(1, 0, 2)
        out[:, i] = determinant(minors) * (-1.0) ** (i + np.arange(d))
    return out


def _complete_triangle(stack: np.ndarray) -> tuple[np.ndarray, ...]:
    """L below and U above the diagonal of the exchanged matrices, the orders, and the sign."""
    u = np.array(stack, dtype=np.float64)
    k, d = u.shape[0], u.shape[1]
    at = np.arange(k)
    rows, columns = (np.tile(np.arange(d), (k, 1)) for _ in range(2))
    sign = np.ones(k)
    for c in range(d - 1):
        size = np.abs(u[:, c:, c:]).reshape(k, -1)
        best = np.argmax(size, axis=1)
        i, j = c + best // (d - c), c + best % (d - c)
        u[at, c], u[at, i] = u[at, i], u[at, c]
        rows[at, c], rows[at, i] = rows[at, i], rows[at, c]
        u[at, :, c], u[at, :, j] = u[at, :, j], u[at, :, c]
        columns[at, c], columns[at, j] = columns[at, j], columns[at, c]
        sign *= np.where(i == c, 1.0, -1.0) * np.where(j == c, 1.0, -1.0)
        pivot = u[:, c, c]
        with np.errstate(all="ignore"):
            factor = np.where(pivot[:, None] != 0, u[:, c + 1 :, c] / pivot[:, None], 0.0)
            u[:, c + 1 :, c + 1 :] -= factor[:, :, None] * u[:, None, c, c + 1 :]
        u[:, c + 1 :, c] = factor
    return u, rows, columns, sign


def _product(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of the rows as fraction and power of two, which neither over- nor underflow."""
    fraction, exponent = np.ones(len(values)), np.zeros(len(values), dtype=np.int64)
    for column in values.T:
        fraction, power = np.frexp(fraction * np.frexp(column)[0])
        exponent += power + np.frexp(column)[1]
    return fraction, exponent


def solved(stack: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Solutions X of A X = B for stacks (k, d, d) and (k, d, m), singular flags, and pivots.

    A singular matrix gets zeros.
    """
    d = stack.shape[1]
    u, moves = upper_triangle(np.concatenate([stack, right], axis=2))
    p = pivots(u[:, :, :d])
    singular = (moves == 0) | (p == 0).any(axis=1)
    x = u[:, :, d:]
    with np.errstate(all="ignore"):
        for i in reversed(range(d)):
            known = (u[:, i, None, i + 1 : d] @ x[:, i + 1 :])[:, 0]
            x[:, i] = (x[:, i] - known) / np.where(singular, 1.0, p[:, i])[:, None]
    x[singular] = 0.0
    return x, singular, p


def inverse(stack: np.ndarray, limit: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Inverses and singular flags; a singular matrix gets an all-zero inverse.

    With a ``limit`` so does a matrix whose one-norm condition number is not below or at it.
    """
    x, singular, _ = solved(stack, np.broadcast_to(np.eye(stack.shape[1]), stack.shape))
    if limit is not None:
        with np.errstate(all="ignore"):
            condition = _one_norm(stack) * _one_norm(x)
            singular |= ~(condition <= limit)
        x[singular] = 0.0
    return x + 0.0, singular


def _one_norm(stack: np.ndarray) -> np.ndarray:
    """Largest sum of a column's absolute cells."""
    return np.abs(stack).sum(axis=1).max(axis=1)


def newton_update(
    hessian: np.ndarray, gradient: np.ndarray, tolerance: float
) -> tuple[np.ndarray, np.ndarray]:
    """Solve H u = g for stacks (k, d, d) and (k, d); zero where H is singular.

    A pivot that is not above its share of the diagonal cell, NaN included,
    makes H singular.
    """
    cells = np.abs(pivots(hessian))
    update, singular, p = solved(hessian, gradient[:, :, None])
    with np.errstate(all="ignore"):
        singular |= ~(np.abs(p) > tolerance * cells).all(axis=1)
    update = update[:, :, 0]
    update[singular] = 0.0
    return update, singular
