"""Sums without rounding: the same bits however the rows are dealt and merged.

A double is a whole number of 53 bits times a power of two. Written in digits of BITS
bits on one fixed grid, doubles are added digit by digit, and sums of digits are whole
numbers that a double holds exactly, so that the order of additions makes no
difference. Only the last step rounds, once, to the nearest double. Digits travel
as arrays, a row per key and digit, through the same sums as all other arrays. Each
slice of rows hands on digits below 2**BITS, so 2**33 slices are added exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logistra.constants import SLICE_BYTES, WIDE_LIMIT
from logistra.functions import logistic
from logistra.operators.matrix import ddl
from logistra.operators.moments import Cell, feature_arrays, packed
from logistra.operators.sums import ARRAY, CELLS, Out, array_sums, cells_of, groups, summable
from logistra.operators.vectors import key_list

BITS = 20
# The smallest double is 2**-1074, and a mantissa of 53 bits reaches 52 below it.
LOWEST = -1140
DIGIT = "_digit"
# Rows that count instead of adding: known cells, and those that no digits express.
KNOWN, NANS, HIGH, LOW = -1, -2, -3, -4
# Values of a slice: their digits, indices and parts take some 16 doubles each.
SLICE = SLICE_BYTES // (16 * 8)


def exact_vector_sum(df: DataFrame, key: str | Sequence[str] | None = None, phi: str = "phi") -> DataFrame:
    """``(key, i, v)``: sum of the vectors of each key, each cell the nearest double to the true sum.

    Nulls add nothing; a cell that is null in all of a key's vectors is null. A NaN, or
    infinities of both signs, give NaN. Keys are of whole, text, boolean, date or
    decimal types.
    """
    keys = key_list(key)
    if not summable([df.schema[k].dataType for k in keys]):
        raise ValueError("keys of this type are not summed exactly")
    rows = df.select(*keys, F.col(phi).cast(ARRAY).alias(CELLS), F.lit(0).alias(DIGIT))

    def digits(batch: pa.RecordBatch) -> Iterator[tuple]:
        order, starts, found = groups(batch, keys)
        values, known, sizes = cells_of(batch.column(CELLS).take(pa.array(order)))
        group = np.repeat(np.arange(len(found)), np.diff(np.append(starts, len(order))))
        step = max(1, SLICE // max(1, values.shape[1]))
        for a in range(0, len(order), step):
            first, last = group[a], group[min(a + step, len(order)) - 1]
            part = slice(a, a + step)
            local = group[part] - first
            longest = np.zeros(last - first + 1, dtype=np.int64)
            np.maximum.at(longest, local, sizes[part])
            yield from _digits(found[first : last + 1], local, values[part], known[part], longest)

    return _rounded(array_sums(rows, [*keys, DIGIT], cells=digits, out=Out(None, ["i", "v"])), keys)


def exact_system(
    df: DataFrame, d: int, weights: Sequence[float], cells: Sequence[Cell], tree: bool = False
) -> DataFrame:
    """``(i, j, v)``: the wanted cells of [H | g] at ``weights``, each rounded once.

    Every row's terms are doubles that depend on the row alone; their sum is exact. Rows with
    a NaN residual have no gradient, rows with a feature or curvature that is not finite no
    Hessian. No rows give none.
    """
    at_i, at_j = np.array(cells, dtype=np.int32).reshape(-1, 2).T
    narrow = d <= WIDE_LIMIT
    literals = ", ".join(logistic.number(w) for w in weights)
    rows = packed(df, d).selectExpr("*", f"CAST(array({literals}) AS array<double>) AS w", f"0 AS {DIGIT}")
    rows = rows.selectExpr("*", f"{logistic.margin('phi', weights if narrow else 'w')} AS margin")
    # Spark's exponential gives the same bits everywhere.
    rows = rows.selectExpr("phi", "t", "n", DIGIT, f"{logistic.sigmoid('margin')} AS p")
    rows = rows.selectExpr("*", f"{logistic.curvature('p')} AS curv")
    step = max(1, SLICE // max(1, len(cells)))

    def digits(batch: pa.RecordBatch) -> Iterator[tuple]:
        x, t, n = feature_arrays(batch, d)
        p, curv = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("p", "curv"))
        for a in range(0, len(x), step):
            b = slice(a, a + step)
            terms, known = _terms(x[b], (p[b] - t[b]) * n[b], curv[b] * n[b], at_i, at_j)
            yield from _digits([()], np.zeros(len(terms), dtype=np.int64), terms, known, np.array([len(cells)]))

    sums = _rounded(array_sums(rows, [DIGIT], cells=digits, tree=tree, out=Out(None, ["i", "v"])), [])
    place = ", ".join(f"struct({i} AS i, {j} AS j)" for i, j in cells)
    named = sums.selectExpr(f"get(array({place}), i) AS place", "coalesce(v, 0D) AS v")
    return named.select("place.i", "place.j", "v")


def _terms(
    x: np.ndarray, resid: np.ndarray, curv: np.ndarray, at_i: np.ndarray, at_j: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The wanted cells of every row, and which of them count."""
    d = x.shape[1]
    of_gradient = at_j == d
    with np.errstate(over="ignore", invalid="ignore"):
        side = np.where(of_gradient, resid[:, None], x[:, np.minimum(at_j, d - 1)] * curv[:, None])
        terms = x[:, at_i] * side
    finite = np.isfinite(x).all(axis=1) & np.isfinite(curv)
    return terms, np.where(of_gradient, ~np.isnan(resid)[:, None], finite[:, None])


def _digits(
    keys: list[tuple], group: np.ndarray, values: np.ndarray, known: np.ndarray, sizes: np.ndarray
) -> Iterator[tuple]:
    """The sums of each group as digits, as ``Running.add`` takes them."""
    count, width = len(keys), values.shape[1]

    def told(digit: int, sums: np.ndarray) -> tuple:
        some = np.flatnonzero(sums.any(axis=1) | (digit == KNOWN))
        rows = [(*keys[k], digit) for k in some]
        return rows, sums[some], np.ones((len(some), width), dtype=bool), sizes[some]

    def counts(which: np.ndarray) -> np.ndarray:
        out = np.zeros((count, width))
        np.add.at(out, group, which)
        return out

    yield told(KNOWN, counts(known))
    finite = known & np.isfinite(values)
    if not (finite == known).all():
        for digit, which in ((NANS, np.isnan(values)), (HIGH, values == np.inf), (LOW, values == -np.inf)):
            yield told(digit, counts(which & known))
    rows, cols = np.nonzero(finite & (values != 0))
    if not len(rows):
        return
    fraction, exponent = np.frexp(values[rows, cols])
    sign, whole = np.sign(fraction), np.ldexp(np.abs(fraction), 53).astype(np.int64)
    place, shift = np.divmod(exponent.astype(np.int64) - 53 - LOWEST, BITS)
    low = int(place.min())
    # Four digits hold a shifted mantissa, two more what is carried over.
    span = int(place.max()) - low + 6
    at = (group[rows] * width + cols) * span + place - low
    sums, mask, before = np.zeros(count * width * span), (1 << BITS) - 1, 0
    for k in range(4):
        piece = ((whole >> (k * BITS)) & mask) << shift if k < 3 else np.zeros_like(whole)
        sums += np.bincount(at + k, weights=sign * ((piece & mask) + before), minlength=sums.size)
        before = piece >> BITS
    sums = sums.reshape(count, width, span)
    for k in range(span):
        if k + 1 < span:
            carry = np.floor(sums[:, :, k] / (1 << BITS))
            sums[:, :, k] -= carry * (1 << BITS)
            sums[:, :, k + 1] += carry
        if sums[:, :, k].any():
            yield told(low + k, sums[:, :, k])


def nearest(digits: Sequence[int], sums: Sequence[float]) -> float | None:
    """The nearest double to a sum in digits; null if it counts no known cell."""
    seen = dict(zip(digits, sums, strict=True))
    if not seen.get(KNOWN):
        return None
    high, low = seen.get(HIGH), seen.get(LOW)
    if seen.get(NANS) or (high and low):
        return float("nan")
    if high or low:
        return float("inf") if high else float("-inf")
    total = sum(int(v) << (BITS * k) for k, v in seen.items() if k >= 0)
    try:
        return total / (1 << -LOWEST)
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")


def _rounded(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, i, v)`` from rows per digit: at most some 110 of each cell meet."""
    quoted = [logistic.name(key) for key in keys]
    gathered = sums.groupBy(*quoted, "i").agg(F.collect_list(F.struct(DIGIT, "v")).alias(CELLS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(CELLS)
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            digits, values = (c.to_pylist() for c in lists.flatten().flatten())
            out = [nearest(digits[a:b], values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            columns = [batch.column(c) for c in [*keys, "i"]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.float64())], names=[*keys, "i", "v"])

    return gathered.mapInArrow(run, ", ".join([*ddl(sums, keys), "i int", "v double"]))
