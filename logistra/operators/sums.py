"""Sums of arrays by key, as arrays from the first row to the last.

Every task keeps one running sum per key and sends a row for each, not a row for
each cell. When the sums outgrow a budget of bytes they are sent early and begun anew. The
rows that arrive are sorted by key and added up run by run, so a key takes the
memory of one array however many tasks send it. Large arrays travel in parts, and
a table read by very many tasks has a middle level of partial sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    IntegralType,
    StringType,
    StructField,
    StructType,
)

from logistra.constants import PART_CELLS, RUNNING_BYTES, TREE_BINS
from logistra.functions.logistic import name

# Columns of the partial sums beside the keys.
CELLS, PART, BIN = "_cells", "_part", "_bin"
ARRAY = ArrayType(DoubleType())
# A cell of a running sum and whether it is known.
CELL_BYTES = 9


class Running:
    """A running sum per key. Keys are tuples; values are rows of cells, unknown ones null."""

    def __init__(self, budget: int = RUNNING_BYTES):
        self.budget = budget
        self.clear()

    def clear(self) -> None:
        self.slots: dict[tuple, int] = {}
        self.sums = np.zeros((0, 0))
        self.known = np.zeros((0, 0), dtype=bool)
        self.sizes = np.zeros(0, dtype=np.int64)

    def add(self, keys: list[tuple], values: np.ndarray, known: np.ndarray, sizes: np.ndarray) -> None:
        """One row of ``values`` and ``known`` per key; ``sizes`` are the arrays' lengths."""
        at = np.array([self.slots.setdefault(k, len(self.slots)) for k in keys], dtype=np.int64)
        self._grow(len(self.slots), values.shape[1])
        with np.errstate(invalid="ignore", over="ignore"):
            self.sums[at, : values.shape[1]] += values
        self.known[at, : values.shape[1]] |= known
        self.sizes[at] = np.maximum(self.sizes[at], sizes)

    def _grow(self, rows: int, width: int) -> None:
        have = self.sums.shape
        if rows <= have[0] and width <= have[1]:
            return
        shape = (max(rows, 2 * have[0]) if rows > have[0] else have[0], max(width, have[1]))
        sums, known = np.zeros(shape), np.zeros(shape, dtype=bool)
        sums[: have[0], : have[1]], known[: have[0], : have[1]] = self.sums, self.known
        self.sums, self.known = sums, known
        self.sizes = np.concatenate([self.sizes, np.zeros(shape[0] - have[0], dtype=np.int64)])

    def full(self) -> bool:
        return self.sums.size * CELL_BYTES > self.budget

    def take(self, keep: tuple | None = None) -> tuple[list[tuple], tuple[np.ndarray, ...]]:
        """Keys and (sums, known, sizes), which are then gone; the key ``keep`` stays."""
        keys = [key for key in self.slots if key != keep]
        rows = np.array([self.slots[key] for key in keys], dtype=np.int64)
        taken = self.sums[rows], self.known[rows], self.sizes[rows]
        rest = None
        if keep in self.slots:
            at = [self.slots[keep]]
            rest = self.sums[at], self.known[at], self.sizes[at]
        self.clear()
        if rest is not None:
            self.add([keep], *rest)
        return keys, taken


class Out:
    """A row per cell: keys, where the cell is, and its value.

    ``places`` has the numbers of every cell, by default its index alone; ``names``
    are those of the numbers and of the value.
    """

    def __init__(self, places: Sequence[Sequence[int]] | None, names: Sequence[str]):
        self.names = list(names)
        shape = (-1, len(names) - 1)
        self.table = None if places is None else np.asarray(places, dtype=np.int32).reshape(shape)

    def schema(self, fields: list[StructField]) -> StructType:
        numbers = [StructField(n, IntegerType()) for n in self.names[:-1]]
        return StructType([*fields, *numbers, StructField(self.names[-1], DoubleType())])

    def rows(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = batch.num_columns - 2
        cells, part = batch.column(keys + 1), batch.column(keys).to_numpy(zero_copy_only=False)
        sizes = cells.value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + part[row] * PART_CELLS
        numbers = [at] if self.table is None else list(self.table[at].T)
        columns = [batch.column(key).take(pa.array(row)) for key in range(keys)]
        columns += [pa.array(n.astype(np.int32)) for n in numbers]
        names = [*batch.schema.names[:keys], *self.names]
        return pa.RecordBatch.from_arrays([*columns, cells.flatten()], names=names)


def groups(batch: pa.RecordBatch, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Rows ordered by key, where each key's run starts, and the keys; nulls are equal."""
    if len(keys) == 1:
        # The codes of one column are its groups already, in the order of their first rows.
        coded = batch.column(keys[0]).dictionary_encode()
        found = coded.dictionary.to_pylist() + [None] * bool(coded.null_count)
        group = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
        order = np.argsort(group, kind="stable")
        return order, np.searchsorted(group[order], np.arange(len(found))), [(key,) for key in found]
    group = np.zeros(batch.num_rows, dtype=np.int64)
    first = np.zeros(1, dtype=np.int64)
    for key in keys:
        coded = batch.column(key).dictionary_encode()
        part = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
        _, first, group = np.unique(
            group * (batch.num_rows + 1) + part, return_index=True, return_inverse=True
        )
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(len(first)))
    columns = [batch.column(key).take(pa.array(first)).to_pylist() for key in keys]
    return order, starts, list(zip(*columns, strict=True)) if keys else [()]


def cells_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, which are known, and lengths of a column of arrays; shorter rows end in zeros."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return values.reshape(len(sizes), width), known.reshape(len(sizes), width), sizes
    inside = np.arange(width) < sizes[:, None]
    full, sure = np.zeros(inside.shape), np.zeros(inside.shape, dtype=bool)
    full[inside], sure[inside] = values, known
    return full, sure, sizes


def _arrays(batch: pa.RecordBatch, keys: Sequence[str], column: str) -> Iterator[tuple]:
    """Sums of the arrays of each key of a batch, as ``Running.add`` takes them."""
    order, starts, found = groups(batch, keys)
    values, known, sizes = cells_of(batch.column(column).take(pa.array(order)))
    with np.errstate(invalid="ignore", over="ignore"):
        sums = np.add.reduceat(values, starts, axis=0)
    yield found, sums, np.logical_or.reduceat(known, starts, axis=0), np.maximum.reduceat(sizes, starts)


def array_sums(
    rows: DataFrame,
    keys: Sequence[str],
    column: str = "",
    tree: bool = False,
    cells: Callable[[pa.RecordBatch], Iterator[tuple]] | None = None,
    out: Out | None = None,
    budget: int = RUNNING_BYTES,
    gather: int = 0,
) -> DataFrame:
    """``(*keys, PART, CELLS)``: the sum of the arrays in ``column`` of each key, cell by cell.

    Part p of a sum holds its cells from p * PART_CELLS on. A cell that is null
    everywhere is null; the longest array gives the length. ``cells`` replaces
    ``column``: from a batch of ``rows`` it yields keys, their sums, which cells
    are known, and lengths. ``tree`` adds a level of TREE_BINS sums per key. With
    ``out`` a row per cell is returned instead. Batches are put together up to ``gather``
    bytes first, so that a key comes up once for several of its rows.
    """
    schema = StructType(
        [*[rows.schema[key] for key in keys], StructField(PART, IntegerType()), StructField(CELLS, ARRAY)]
    )
    source = cells or (lambda batch: _arrays(batch, keys, column))
    sums = rows.mapInArrow(_partial_sums(keys, source, budget, gather), schema)
    if tree:
        salted = sums.withColumn(BIN, F.spark_partition_id() % TREE_BINS)
        sums = _merged(salted, [*keys, PART, BIN], schema, budget)
    return _merged(sums, [*keys, PART], schema, budget, out)


def whole_arrays(sums: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """``(*keys, CELLS)`` from ``array_sums`` whose arrays have ``size`` cells; parts are put together."""
    if size <= PART_CELLS:
        return sums.drop(PART)
    parts = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(PART, CELLS))).alias(CELLS))
    return parts.withColumn(CELLS, F.flatten(F.transform(CELLS, lambda part: part[CELLS])))


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches with rows, put together until they have ``size`` bytes."""
    held, held_bytes = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            held_bytes += batch.nbytes
        if held and held_bytes >= size:
            yield held[0] if len(held) == 1 else pa.concat_batches(held)
            held, held_bytes = [], 0
    if held:
        yield pa.concat_batches(held)


def _partial_sums(keys: Sequence[str], source, budget: int, gather: int = 0):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, types = Running(budget), None
        for batch in gathered(batches, gather):
            types = types or [batch.schema.field(key).type for key in keys]
            for part in source(batch):
                running.add(*part)
                if running.full():
                    yield from _parts(running, keys, types)
        if running.slots:
            yield from _parts(running, keys, types)

    return run


def _parts(running: Running, keys: Sequence[str], types: list) -> Iterator[pa.RecordBatch]:
    """The sums cut into parts, one batch for each part."""
    found, (sums, known, sizes) = running.take()
    for part in range(max(1, -(-int(sizes.max(initial=0)) // PART_CELLS))):
        first = part * PART_CELLS
        rows = np.flatnonzero((sizes > first) | (part == 0))
        left = np.minimum(sizes[rows] - first, PART_CELLS)
        cells = sums[rows, first : first + PART_CELLS], known[rows, first : first + PART_CELLS]
        columns = [pa.array([found[r][c] for r in rows], types[c]) for c in range(len(keys))]
        columns.append(pa.array(np.full(len(rows), part, dtype=np.int32)))
        yield pa.RecordBatch.from_arrays([*columns, _lists(*cells, left)], names=[*keys, PART, CELLS])


def _lists(sums: np.ndarray, known: np.ndarray, sizes: np.ndarray) -> pa.Array:
    inside = np.arange(sums.shape[1]) < sizes[:, None]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(sums[inside], mask=~known[inside]))


def _merged(
    partial: DataFrame,
    places: Sequence[str],
    schema: StructType,
    budget: int,
    out: Out | None = None,
) -> DataFrame:
    """Partial sums brought together by ``places`` and added up, run by run of sorted rows."""
    quoted = [name(place) for place in places]
    kept = len(schema) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, types = Running(budget), None

        def rows(keep: tuple | None = None) -> pa.RecordBatch:
            found, cells = running.take(keep)
            columns = [pa.array([key[c] for key in found], types[c]) for c in range(kept)]
            batch = pa.RecordBatch.from_arrays([*columns, _lists(*cells)], names=schema.names)
            return out.rows(batch) if out else batch

        for batch in batches:
            if batch.num_rows == 0:
                continue
            types = types or [batch.schema.field(place).type for place in places]
            for part in _arrays(batch, places, CELLS):
                running.add(*part)
            if running.full():
                # All but the last key are complete, since the rows are sorted.
                last = batch.num_rows - 1
                yield rows(tuple(batch.column(place)[last].as_py() for place in places))
        if running.slots:
            yield rows()

    together = partial.repartition(*quoted).sortWithinPartitions(*quoted)
    return together.mapInArrow(run, out.schema(schema.fields[: kept - 1]) if out else schema)


def summable(types: Sequence[DataType]) -> bool:
    """Whether keys of these types are equal in Python exactly where they are in Spark."""
    exact = (IntegralType, StringType, BooleanType, DateType, DecimalType, BinaryType)
    return all(isinstance(t, exact) for t in types)
