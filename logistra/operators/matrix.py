"""Jobs over a table of matrices ``(key, i, j, v)``, one matrix per key.

Without a key the table holds a single matrix. The cells of a matrix are
gathered, and Arrow batches of matrices are eliminated together, in the same way
at every width.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logistra.constants import SLICE_BYTES
from logistra.functions import dense
from logistra.functions.logistic import name
from logistra.operators.validate import checked
from logistra.operators.vectors import key_list, unique_cells, vector_to_indexed

Key = str | Sequence[str] | None


def coo_to_dense(matrix: DataFrame, d: int, key: Key = None) -> DataFrame:
    """``(key, m)`` with the d x d cells in row order.

    The job fails unless every key has each of its d^2 cells exactly once.
    """
    keys = key_list(key)
    outside = f"cell outside a {d} x {d} matrix"
    places = {c: checked(F.col(c), F.col(c).between(0, d - 1), outside) for c in ("i", "j")}
    cells = unique_cells(matrix.withColumns(places), [*keys, "i", "j"], "v")
    gathered = cells.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("i", "j", "v"))).alias("cells")
    )
    whole = F.size("cells") == d * d
    m = F.transform("cells", lambda cell: cell["v"])
    m = checked(m, whole, f"matrix has fewer than {d * d} cells")
    return gathered.select(*keys, m.alias("m"))


def dense_to_coo(table: DataFrame, d: int, keep: Sequence[str] = (), cells: str = "m") -> DataFrame:
    """``(*keep, i, j, v)`` from d x d cells in row order."""
    places = vector_to_indexed(table, keep, cells, "place")
    return places.selectExpr(
        *[name(column) for column in keep],
        f"CAST(place DIV {d} AS int) AS i",
        f"CAST(place % {d} AS int) AS j",
        "v",
    )


def transpose(matrix: DataFrame, key: Key = None) -> DataFrame:
    """Rows and columns swapped; rectangular matrices too."""
    return matrix.select(*key_list(key), F.col("j").alias("i"), F.col("i").alias("j"), "v")


def upper_triangle(matrix: DataFrame, d: int, key: Key = None) -> DataFrame:
    """``(key, i, j, v, sign)``: Gaussian elimination without scaling.

    Rows move only where a pivot is exactly 0; ``sign`` is that of the moves,
    or 0 where no pivot was found.
    """
    keys = key_list(key)

    def run(stack: np.ndarray) -> list[np.ndarray]:
        return list(dense.upper_triangle(stack))

    done = _stacked(coo_to_dense(matrix, d, key), d, keys, run, "m array<double>, sign int")
    return dense_to_coo(done, d, [*keys, "sign"]).select(*keys, "i", "j", "v", "sign")


def determinant(matrix: DataFrame, d: int, key: Key = None) -> DataFrame:
    """``(key, det, sign, log_abs_det)``.

    ``det`` overflows for large matrices; ``sign`` and ``log_abs_det`` do not.
    """
    keys = key_list(key)
    outputs = "det double, sign double, log_abs_det double"
    done = _stacked(
        coo_to_dense(matrix, d, key), d, keys, lambda stack: list(dense.signed_determinant(stack)), outputs
    )
    log_abs = "if(log_abs_det = double('-Infinity'), null, log_abs_det) AS log_abs_det"
    return done.selectExpr(*_quoted(keys), "det", "sign", log_abs)


def adjugate(matrix: DataFrame, d: int, key: Key = None) -> DataFrame:
    """``(key, i, j, v)``: transposed cofactors; singular matrices have one too."""
    keys = key_list(key)
    table = coo_to_dense(matrix, d, key)
    done = _stacked(table, d, keys, lambda stack: [dense.adjugate(stack)], "m array<double>")
    return dense_to_coo(done, d, keys)


def inverse(
    matrix: DataFrame, d: int, key: Key = None, condition_limit: float | None = None
) -> DataFrame:
    """``(key, i, j, v, singular)``: determinant exactly 0 gives all zeros.

    With ``condition_limit`` so does a matrix whose condition number, the product of
    the one-norms of matrix and inverse, is above it. A number c leaves about 16 - log10(c)
    correct digits, so 1e13 keeps three; matrices of NaN or infinite cells have no number and are flagged.
    """
    keys = key_list(key)
    table = coo_to_dense(matrix, d, key)
    outputs = "m array<double>, singular boolean"

    def run(stack: np.ndarray) -> list[np.ndarray]:
        return list(dense.inverse(stack, condition_limit))

    done = _stacked(table, d, keys, run, outputs)
    return dense_to_coo(done, d, [*keys, "singular"]).select(*keys, "i", "j", "v", "singular")


def matvec(matrix: DataFrame, x: DataFrame, key: Key = None) -> DataFrame:
    """``(key, i, v)``: sum over j of M_ij x_j, for ``x`` as ``(key, i, v)``.

    The join is left to the optimizer, which broadcasts ``x`` only while it is
    small. A missing x_j fails the job.
    """
    keys = key_list(key)
    side = x.select(*keys, F.col("i").alias("j"), F.col("v").alias("x"))
    joined = matrix.join(side, [*keys, "j"], "left")
    term = F.col("v") * checked(F.col("x"), F.lit(True), "vector is too short")
    return joined.groupBy(*keys, "i").agg(F.sum(term).alias("v"))


def _quoted(keys: Sequence[str]) -> list[str]:
    return [name(key) for key in keys]


def _stacked(
    table: DataFrame,
    d: int,
    keys: Sequence[str],
    run: Callable[[np.ndarray], list[np.ndarray]],
    outputs: str,
) -> DataFrame:
    """Apply ``run`` to slices of the matrices of each Arrow batch, keeping the keys."""
    names = [*keys, *[field.split()[0] for field in outputs.split(", ")]]
    # Some eight copies of a slice are in memory while it is worked on.
    step = max(1, SLICE_BYTES // (8 * 8 * d * d))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in source:
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                values = batch.column("m").flatten().to_numpy(zero_copy_only=False)
                results = run(values.reshape(-1, d, d))
                arrays = [batch.column(key) for key in keys] + [as_arrow(r) for r in results]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return table.select(*keys, "m").mapInArrow(batches, ", ".join([*ddl(table, keys), outputs]))


def ddl(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The schema text of some columns."""
    return [f"{name(column)} {df.schema[column].dataType.simpleString()}" for column in columns]


def as_arrow(values: np.ndarray) -> pa.Array:
    """One value or one list of values per matrix."""
    if values.ndim == 1:
        return pa.array(values)
    flat = values.reshape(values.shape[0], -1)
    offsets = np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))
