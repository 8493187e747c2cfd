"""SQL text of the logistic model's expressions, for ``selectExpr`` and ``expr``."""

from __future__ import annotations

import math
from collections.abc import Sequence

from logistra.constants import NAN_FILL


def name(column: str) -> str:
    """A quoted column name."""
    return "`" + column.replace("`", "``") + "`"


def number(value: float) -> str:
    """A double literal."""
    value = float(value)
    if math.isfinite(value):
        return f"({value!r}D)"
    text = "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"
    return f"double('{text}')"


def or_fail(value: str, message: str) -> str:
    """``value``, or a failed task where it is null."""
    return f"coalesce({value}, raise_error('{message}'))"


def nan_guard(value: str, fill: float = NAN_FILL) -> str:
    """``value``, or ``fill`` where it is NaN."""
    return f"nanvl({value}, {number(fill)})"


def linear(features: Sequence[str], weights: Sequence[str]) -> str:
    """Sum of w_j * x_j, from left to right."""
    return " + ".join(f"{x} * {w}" for x, w in zip(features, weights, strict=True))


def margin(phi: str, weights: str | Sequence[float]) -> str:
    """Sum of w_j * phi_j for an array column and either an array column of
    weights or a list. The task fails if the lengths differ or a cell is null.
    """
    phi = name(phi)
    if isinstance(weights, str):
        w = name(weights)
        same = f"size({phi}) = size({w})"
        terms = f"zip_with({phi}, {w}, (x, y) -> x * y)"
        total = f"aggregate({terms}, 0D, (total, term) -> total + term)"
    else:
        same = f"size({phi}) = {len(weights)}"
        cells = [f"get({phi}, {j})" for j in range(len(weights))]
        total = linear(cells, [number(w) for w in weights]) or "0D"
    return or_fail(f"if({same}, {total}, null)", "feature and weight vectors differ in length")


def sigmoid(m: str) -> str:
    """1 / (1 + e^-m). An infinite exponential gives 0; the divisor is never 0."""
    return f"1D / (1D + exp(-({m})))"


def curvature(p: str) -> str:
    return f"{p} * (1D - {p})"


def gradient_cell(x: str, residual: str) -> str:
    """x * residual; a NaN residual replaces the whole gradient of the row."""
    return f"if(isnan({residual}), {number(NAN_FILL)}, {x} * {residual})"


def hessian_cell(xi: str, xj: str, c: str) -> str:
    return nan_guard(f"{xi} * {xj} * {c}")
