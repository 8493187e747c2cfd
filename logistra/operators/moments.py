"""Gradient and Hessian sums over a vector table.

Both belong to the linear system H u = g of one Newton step, so they are
summed in one pass as the upper triangle of the augmented matrix [H | g]: the
cell (i, j) with j < d is a Hessian cell and (i, d) is gradient cell i.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logistra.constants import GRADIENT_BINS, RUNNING_BYTES, SLICE_BYTES, TREE_BINS, WIDE_LIMIT
from logistra.functions import logistic
from logistra.operators.scoring import row_gradient, row_hessian_coo
from logistra.operators.sums import Out, array_sums, groups
from logistra.operators.vectors import key_list, vector_to_indexed

Cell = tuple[int, int]


def gradient_cells(d: int) -> list[Cell]:
    return [(i, d) for i in range(d)]


def hessian_cells(d: int) -> list[Cell]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def strategy_for(d: int) -> str:
    return "wide" if d <= WIDE_LIMIT else "blas"


def design(df: DataFrame, d: int, keep: Sequence[str] = ()) -> DataFrame:
    """Checked scalar columns ``(*keep, x0.., t, n)``; ``n`` is the row's multiplicity."""
    xs = [f"x{i}" for i in range(d)]
    clash = {*keep} & {*xs, *[f"w{i}" for i in range(d)], "phi", "t", "n"}
    if clash:
        raise ValueError(f"rename the key columns {sorted(clash)}")
    cells = [f"if(size(phi) = {d}, get(phi, {i}), null)" for i in range(d)]
    features = [f"{logistic.or_fail(c, bad_row(d))} AS {x}" for c, x in zip(cells, xs)]
    return df.selectExpr(*_present(keep, d), *features, *_present(["t"], d), multiplicity(df))


def bad_row(d: int) -> str:
    return f"row has a null, or a feature vector not of length {d}"


def _present(columns: Sequence[str], d: int) -> list[str]:
    names = [logistic.name(column) for column in columns]
    return [f"{logistic.or_fail(column, bad_row(d))} AS {column}" for column in names]


def multiplicity(df: DataFrame) -> str:
    """The row's multiplicity; null, NaN, negative and infinite ones fail the job."""
    if "n" not in df.columns:
        return "1D AS n"
    counted = "CAST(n AS double) >= 0D AND CAST(n AS double) < double('Infinity')"
    return f"{logistic.or_fail(f'if({counted}, CAST(n AS double), null)', 'multiplicity is no count')} AS n"


def cell_sums(
    rows: DataFrame,
    d: int,
    weights: Sequence[float] | Sequence[str],
    cells: Sequence[Cell],
    keys: Sequence[str] = (),
    tree: bool = False,
) -> DataFrame:
    """``(*keys, a_i_j ..)`` per group from a ``design`` table.

    ``weights`` are numbers, or columns that are constant per key and come
    back with the sums. All sums start on the map side; a hot key or group of
    copies costs each task one partial row. ``tree`` puts a level of TREE_BINS
    sums before the single last one.
    """
    carried = [w for w in weights if isinstance(w, str)]
    kept = [*[logistic.name(column) for column in keys], *carried]
    xs = [f"x{i}" for i in range(d)]
    w = [value if isinstance(value, str) else logistic.number(value) for value in weights]
    p = logistic.sigmoid(logistic.linear(xs, w))
    scored = rows.selectExpr(
        *kept, *xs, "n", f"{p} AS p", "p - t AS resid", f"{logistic.curvature('p')} AS curv"
    )
    sums = [F.expr(f"first({column}) AS {column}") for column in carried]
    for i, j in cells:
        if j == d:
            cell = logistic.gradient_cell(xs[i], "resid")
        else:
            cell = logistic.hessian_cell(xs[i], xs[j], "curv")
        sums.append(F.expr(f"sum(n * {cell}) AS a_{i}_{j}"))
    if keys:
        return scored.groupBy(*keys).agg(*sums)
    if tree:
        bins = scored.groupBy(F.expr(f"spark_partition_id() % {TREE_BINS}")).agg(*sums)
        return bins.agg(*[F.expr(f"sum(a_{i}_{j}) AS a_{i}_{j}") for i, j in cells])
    return scored.agg(*sums)


def as_cells(sums: DataFrame, cells: Sequence[Cell], keys: Sequence[str] = ()) -> DataFrame:
    """``cell_sums`` columns to ``(*keys, i, j, v)`` rows; no rows sum to 0."""
    rows = ", ".join(f"struct({i} AS i, {j} AS j, coalesce(a_{i}_{j}, 0D) AS v)" for i, j in cells)
    return sums.selectExpr(*[logistic.name(key) for key in keys], f"inline_outer(array({rows}))")


def packed(df: DataFrame, d: int, keep: Sequence[str] = ()) -> DataFrame:
    """Checked ``(*keep, phi, t, n)`` rows for the matrix strategy."""
    phi = logistic.or_fail(f"if(size(phi) = {d}, phi, null)", bad_row(d))
    return df.selectExpr(*_present(keep, d), f"{phi} AS phi", *_present(["t"], d), multiplicity(df))


def matrix_sums(
    rows: DataFrame, d: int, weights: Sequence[float], cells: Sequence[Cell]
) -> DataFrame:
    """``(i, j, v)`` sums from ``packed`` rows; no rows give none."""
    return matrix_arrays(rows, d, weights, cells, out=Out(cells, ["i", "j", "v"]))


def matrix_arrays(
    rows: DataFrame,
    d: int,
    weights: Sequence[float],
    cells: Sequence[Cell],
    tree: bool = False,
    out: Out | None = None,
) -> DataFrame:
    """The wanted cells as ``array_sums``, one matrix product per Arrow batch.

    Every task sends its sums as one array. Without Hessian cells no Hessian is
    multiplied.
    """
    at_i, at_j = np.array(cells, dtype=np.int32).reshape(-1, 2).T
    wants_hessian = bool((at_j < d).any())
    w = np.asarray(weights, dtype=np.float64)
    known, sizes = np.ones((1, len(cells)), dtype=bool), np.array([len(cells)])

    def systems(batch: pa.RecordBatch) -> Iterator[tuple]:
        x, t, n = feature_arrays(batch, d)
        system = system_of(x, t, n, x @ w, wants_hessian)
        yield [()], system[None, at_i, at_j], known, sizes

    return array_sums(rows, [], cells=systems, tree=tree, out=out)


def feature_arrays(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = batch.column("phi").flatten()
    if values.null_count:
        raise ValueError("feature vector has a null cell")
    x = values.to_numpy(zero_copy_only=False).reshape(-1, d)
    t = batch.column("t").to_numpy(zero_copy_only=False)
    n = batch.column("n").to_numpy(zero_copy_only=False)
    return x, t, n


def system_of(
    x: np.ndarray, t: np.ndarray, n: np.ndarray, margin: np.ndarray, wants_hessian: bool = True
) -> np.ndarray:
    """[H | g] of a block of rows, shape (d, d + 1); H is 0 if it is not wanted.

    A guarded cell counts as the smallest double, which vanishes in a sum, so
    guarded rows are left out.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        p = 1.0 / (1.0 + np.exp(-margin))
        resid = p - t
        hessian = np.zeros((x.shape[1], x.shape[1]))
        if wants_hessian:
            curv = p * (1.0 - p) * n
            finite = np.isfinite(x).all(axis=1) & np.isfinite(curv)
            xh = x if finite.all() else np.where(finite[:, None], x, 0.0)
            hessian = xh.T @ (xh * np.where(finite, curv, 0.0)[:, None])
        known = ~np.isnan(resid)
        xg = x if known.all() else np.where(known[:, None], x, 0.0)
        gradient = xg.T @ np.where(known, resid * n, 0.0)
    return np.column_stack([hessian, gradient])


def newton_system(
    df: DataFrame,
    d: int,
    weights: Sequence[float],
    cells: Sequence[Cell] | None = None,
    strategy: str = "auto",
) -> DataFrame:
    """``(i, j, v)``: the wanted cells of [H | g] at ``weights``.

    ``wide`` sums built-in expressions, ``blas`` multiplies Arrow batches,
    ``long`` explodes every row into cells, ``exact`` adds without rounding, to
    the same bits in any order; ``auto`` picks one of the first two by width.
    """
    weights = [float(w) for w in weights]
    if len(weights) != d:
        raise ValueError(f"{len(weights)} weights for {d} features")
    cells = hessian_cells(d) + gradient_cells(d) if cells is None else list(cells)
    strategy = strategy_for(d) if strategy == "auto" else strategy
    if strategy == "wide":
        return as_cells(cell_sums(design(df, d), d, weights, cells), cells)
    if strategy == "blas":
        return matrix_sums(packed(df, d), d, weights, cells)
    if strategy == "long":
        return _exploded_system(df, d, weights, cells)
    if strategy == "exact":
        from logistra.operators.exact import exact_system

        return exact_system(df, d, weights, cells)
    raise ValueError(f"unknown strategy {strategy!r}")


def _exploded_system(
    df: DataFrame, d: int, weights: Sequence[float], cells: Sequence[Cell]
) -> DataFrame:
    g = vector_to_indexed(row_gradient(df, weights), phi="grad")
    h = row_hessian_coo(df, weights).filter("i <= j").select("i", "j", F.col("h").alias("v"))
    both = g.select("i", F.lit(d).alias("j"), "v").unionByName(h)
    wanted = both.filter(" or ".join(f"(i = {i} and j = {j})" for i, j in cells))
    return wanted.groupBy("i", "j").agg(F.sum("v").alias("v"))


def gradient(
    df: DataFrame, weights: Sequence[float], strategy: str = "auto"
) -> DataFrame:
    """``(i, g)``: sum over all rows of (p - t) phi_i."""
    d = len(weights)
    system = newton_system(df, d, weights, gradient_cells(d), strategy)
    return system.select("i", F.col("v").alias("g"))


def hessian(df: DataFrame, weights: Sequence[float], strategy: str = "auto") -> DataFrame:
    """``(i, j, h)``: sum over all rows of p(1-p) phi_i phi_j, all d^2 cells.

    The upper triangle is summed and mirrored afterwards.
    """
    d = len(weights)
    system = newton_system(df, d, weights, hessian_cells(d), strategy)
    return mirror(system.withColumnRenamed("v", "h"), "h")


def mirror(upper: DataFrame, value: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """The full symmetric matrix from the cells with i <= j."""
    cell, swapped = f"struct(i, j, {value})", f"struct(j AS i, i AS j, {value})"
    cells = f"if(i = j, array({cell}), array({cell}, {swapped}))"
    return upper.selectExpr(*[logistic.name(key) for key in keys], f"inline_outer({cells})")


def gradient_binned(
    df: DataFrame, weights: Sequence[float], bin_column: str, n: int = GRADIENT_BINS
) -> DataFrame:
    """``(bin, i, g)``: partial gradients of ``n`` bins of a whole-number column.

    ``bins_total`` adds them up to ``gradient``.
    """
    d = len(weights)
    cells = gradient_cells(d)
    bins = df.withColumn("bin", F.pmod(bin_column, F.lit(n)).cast("int"))
    sums = cell_sums(design(bins, d, ["bin"]), d, weights, cells, ["bin"])
    return as_cells(sums, cells, ["bin"]).select("bin", "i", F.col("v").alias("g"))


def bins_total(binned: DataFrame) -> DataFrame:
    return binned.groupBy("i").agg(F.sum("g").alias("g"))


def system_by(
    df: DataFrame, key: str | Sequence[str], weights: Sequence[float], cells: Sequence[Cell]
) -> DataFrame:
    """``(key, i, j, v)``: the wanted cells of [H | g] of every key."""
    keys, d = key_list(key), len(weights)
    if strategy_for(d) == "wide":
        return as_cells(cell_sums(design(df, d, keys), d, weights, cells, keys), cells, keys)
    places = [logistic.name(k) for k in keys]
    margin = logistic.linear([f"get(phi, {i})" for i in range(d)], [logistic.number(w) for w in weights])
    rows = packed(df, d, keys).selectExpr(*places, "phi", "t", "n", f"{margin} AS margin")
    return keyed_arrays(rows, keys, d, cells, Out(cells, ["i", "j", "v"]))


def keyed_arrays(
    rows: DataFrame, keys: Sequence[str], d: int, cells: Sequence[Cell], out: Out | None = None
) -> DataFrame:
    """The wanted cells of [H | g] of every key as ``array_sums``.

    ``rows`` are ``(key, phi, t, n, margin)`` in any order. Few keys in a batch are
    one matrix product each; many are summed together, one run of sorted rows
    per key. A task adds up its batches and sends one array per key. Guards as in
    ``system_of``.
    """
    # Runs whose systems are in memory at a time.
    step = max(1, SLICE_BYTES // (8 * d * (d + 1)))

    def systems(batch: pa.RecordBatch) -> Iterator[tuple]:
        order, starts, found = groups(batch, keys)
        margin = batch.column("margin").to_numpy(zero_copy_only=False)
        x, t, n, margin = (v[order] for v in (*feature_arrays(batch, d), margin))
        ends = np.append(starts, len(order))
        for a in range(0, len(starts), step):
            b = min(a + step, len(starts))
            run = slice(ends[a], ends[b])
            sums = _segment_cells(x[run], t[run], n[run], margin[run], starts[a:b] - ends[a], cells)
            yield found[a:b], sums, np.ones(sums.shape, dtype=bool), np.full(b - a, len(cells))

    return array_sums(rows, keys, cells=systems, out=out, gather=RUNNING_BYTES // 2)


def _segment_cells(x, t, n, margin, starts, cells: Sequence[Cell]) -> np.ndarray:
    """The cells of [H | g] of each run of rows, shape (runs, cells)."""
    d, runs = x.shape[1], len(starts)
    if runs <= d:
        at_i, at_j = np.array(cells, dtype=np.int32).reshape(-1, 2).T
        wants_hessian = bool((at_j < d).any())
        edges = [*starts, len(x)]
        return np.stack(
            [
                system_of(x[a:b], t[a:b], n[a:b], margin[a:b], wants_hessian)[at_i, at_j]
                for a, b in zip(edges[:-1], edges[1:], strict=True)
            ]
        )
    out = np.empty((len(cells), runs))
    run = np.repeat(np.arange(runs), np.diff(starts, append=len(x)))
    x = np.ascontiguousarray(x.T)
    with np.errstate(over="ignore", invalid="ignore"):
        p = 1.0 / (1.0 + np.exp(-margin))
        resid, curv = p - t, p * (1.0 - p) * n
        known, finite = ~np.isnan(resid), np.isfinite(x).all(axis=0) & np.isfinite(curv)
        xg, xh = (x if kept.all() else np.where(kept, x, 0.0) for kept in (known, finite))
        resid, curv = np.where(known, resid * n, 0.0), np.where(finite, curv, 0.0)
        left = None
        for at, (i, j) in enumerate(cells):
            if j == d:
                terms = xg[i] * resid
            else:
                left, scaled = (left, scaled) if left == i else (i, xh[i] * curv)
                terms = scaled * xh[j]
            out[at] = np.bincount(run, weights=terms, minlength=runs)
    return np.ascontiguousarray(out.T)


def gradient_by(df: DataFrame, key: str | Sequence[str], weights: Sequence[float]) -> DataFrame:
    """``(key, i, v)``: one gradient per key."""
    keys = key_list(key)
    return system_by(df, keys, weights, gradient_cells(len(weights))).select(*keys, "i", "v")


def hessian_by(df: DataFrame, key: str | Sequence[str], weights: Sequence[float]) -> DataFrame:
    """``(key, i, j, v)``: one full Hessian per key."""
    keys = key_list(key)
    return mirror(system_by(df, keys, weights, hessian_cells(len(weights))), "v", keys)
