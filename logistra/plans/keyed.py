"""Newton training of one model per key, all keys in the same pass.

Every step sums [H | g] per key, solves each key's system and writes the new
weights as a table in the shared folder, which cuts the lineage and is the
next step's input. The rows are not shuffled again in a step:

* while the weights fit the broadcast limit they go to the rows, and only
  partial sums are shuffled;
* beyond it the rows are laid out once by key and salt, where a key with many
  rows gets several salts, and each step shuffles only the weights there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from logistra.constants import (
    BROADCAST_LIMIT,
    ITERATIONS,
    PIVOT_TOLERANCE,
    ROWS_PER_SALT,
    RUNNING_BYTES,
)
from logistra.functions import dense
from logistra.functions.logistic import linear, name, number
from logistra.operators.matrix import as_arrow, ddl
from logistra.operators.moments import (
    cell_sums,
    design,
    gradient_cells,
    hessian_cells,
    keyed_arrays,
    packed,
    strategy_for,
)
from logistra.operators.sums import CELL_BYTES, CELLS, whole_arrays
from logistra.operators.validate import checked
from logistra.operators.vectors import key_list
from logistra.plans.journal import Journal, digest
from logistra.plans.layout import Shape, Stored, measure
from logistra.storage import new_table_path

SALT = "_salt"
# More hot keys than this are not singled out; the salts grow instead.
HOT_KEYS = 1_000_000


def newton_train_by(
    df: DataFrame,
    key: str | Sequence[str],
    d: int,
    iterations: int = ITERATIONS,
    init: DataFrame | None = None,
    history: bool = False,
    collapse: str = "auto",
    persist: bool = False,
    tolerance: float = PIVOT_TOLERANCE,
    broadcast_limit: int = BROADCAST_LIMIT,
    rows_per_salt: int = ROWS_PER_SALT,
    journal: str | None = None,
) -> DataFrame:
    """``(key, i, w, singular)`` after exactly ``iterations`` steps per key.

    Training starts from 0, or from ``init``, a ``(key, i, w)`` table whose
    missing keys start from 0. With ``history`` every step is returned, with
    ``iteration`` 1, 2, ... A key with a singular Hessian keeps its weights
    and is flagged. Keys must not be null. ``collapse`` and ``persist`` work as
    in ``newton_train``. The weights of every step stay in
    the shared folder, since the result is read from there; with ``journal`` they are kept
    in that folder, and a run that broke off goes on behind its last finished step.
    """
    if iterations < 1:
        raise ValueError("training needs at least one iteration")
    spark = df.sparkSession
    names = key_list(key)
    taken = {"iteration", "i", "w", "singular", "phi", "t", "n"}
    taken |= {f"{c}{i}" for c in "xw" for i in range(d)}
    if taken & {*names}:
        raise ValueError(f"rename the key columns {sorted(taken & {*names})}")
    # Keys have names of their own inside, so that no inner column clashes.
    inner = {column: f"_key{i}" for i, column in enumerate(names)}
    keyed_rows = df.withColumnsRenamed(inner)
    settings = {"keys": names, "d": d, "start": digest(init), "tolerance": tolerance}
    log = Journal(spark, journal or new_table_path(spark, "weights"), settings)
    done = min(log.finished(), iterations)
    keys = [*inner.values()]
    if done < iterations:
        data = _Rows(keyed_rows, keys, d, collapse, persist, broadcast_limit, rows_per_salt)
        try:
            _run(data, log, done, init, inner, iterations, tolerance)
        finally:
            data.close()
    kept = ["iteration", *keys] if history else keys
    steps = log.history(iterations) if history else log.read(iterations)
    weights = ", ".join(f"struct({i} AS i, w{i} AS w)" for i in range(d))
    out = steps.selectExpr(*[name(n) for n in kept], "singular", f"inline_outer(array({weights}))")
    outer = {place: column for column, place in inner.items()}
    return out.select(*kept, "i", "w", "singular").withColumnsRenamed(outer)


def _run(data, log: Journal, done: int, init, inner, iterations, tolerance) -> None:
    """The steps behind the ``done`` first ones, each committed to the journal."""
    d = data.d
    if done:
        state = log.read(done)
    else:
        state = None if init is None else _wide_model(init.withColumnsRenamed(inner), data.keys, d)
    for iteration in range(done + 1, iterations + 1):
        # The first weights may cover few keys; from the second step on the
        # table has one row per key and keeps its size.
        if state is not None and iteration <= max(2, done + 1):
            data.choose_join(state)
        if strategy_for(d) == "wide":
            solved = solve_systems(data.systems(state), data.keys, d, tolerance)
        else:
            solved = solve_stacked(data.stacked_systems(state), data.keys, d, tolerance)
        state = log.write(iteration, solved)


def _wide_model(model: DataFrame, keys: Sequence[str], d: int) -> DataFrame:
    """``(key, i, w)`` rows as ``(key, w0 ..)``; a missing or extra index fails."""
    weights = [F.expr(f"max(if(i = {i}, w, null)) AS w{i}") for i in range(d)]
    table = model.groupBy(*keys).agg(F.count("*").alias("cells"), *weights)
    message = f"a model does not have exactly {d} weights"
    whole = F.col("cells") == d
    found = [checked(F.col(f"w{i}"), whole, message).alias(f"w{i}") for i in range(d)]
    return table.select(*keys, *found)


class _Rows:
    """The training rows, and the sums over them per key."""

    def __init__(
        self,
        df: DataFrame,
        keys: list[str],
        d: int,
        collapse: str,
        persist: bool,
        broadcast_limit: int,
        rows_per_salt: int,
    ):
        self.keys, self.d = keys, d
        self.broadcast_limit, self.rows_per_salt = broadcast_limit, rows_per_salt
        self.laid_out = self.salted = False
        self.hot: DataFrame | None = None
        self.fits = True
        if strategy_for(d) == "wide":
            rows, columns = design(df, d, keys), [*keys, *[f"x{i}" for i in range(d)], "t"]
        else:
            rows, columns = packed(df, d, keys), [*keys, "phi", "t"]
        self.stored = Stored(rows, columns, collapse, persist, keys)

    def close(self) -> None:
        self.stored.close()
        if self.hot is not None:
            self.hot.unpersist()

    def systems(self, state: DataFrame | None) -> DataFrame:
        """``(key, w0 .., a_i_j ..)``: the cells of [H | g] of every key."""
        d, keys = self.d, self.keys
        cells = hessian_cells(d) + gradient_cells(d)
        names = [f"w{i}" for i in range(d)]
        if state is None:
            sums = cell_sums(self.stored.rows, d, [0.0] * d, cells, keys)
            return sums.selectExpr(*[f"0D AS {w}" for w in names], "*")
        joined = self._with_state(state)
        if SALT not in joined.columns:
            return cell_sums(joined, d, names, cells, keys)
        partial = cell_sums(joined, d, names, cells, [*keys, SALT])
        firsts = [F.expr(f"first({w}) AS {w}") for w in names]
        return partial.groupBy(*keys).agg(
            *firsts, *[F.expr(f"sum(a_{i}_{j}) AS a_{i}_{j}") for i, j in cells]
        )

    def stacked_systems(self, state: DataFrame | None) -> DataFrame:
        """``(key, cells, w)``: cells of [H | g] and weights of every key as arrays.

        Every task sends one array per key that it read.
        """
        if state is None and self._sums_outgrow_rows(self._shape().keys):
            self._lay_out()
        keys = [name(key) for key in self.keys]
        rows, weights = self.stored.rows, ["0D"] * self.d
        if state is not None:
            rows, weights = self._with_state(state), [f"w{i}" for i in range(self.d)]
        # Zeros are multiplied too: 0 * NaN is what the guard looks for.
        margin = linear([f"get(phi, {i})" for i in range(self.d)], weights)
        rows = rows.selectExpr(*keys, "phi", "t", "n", f"{margin} AS margin")
        wanted = gradient_cells(self.d) + hessian_cells(self.d)
        sums = keyed_arrays(rows, self.keys, self.d, wanted)
        gathered = whole_arrays(sums, self.keys, len(wanted)).withColumnRenamed(CELLS, "cells")
        if state is not None:
            weights = self._weights(state)
            gathered = gathered.join(
                F.broadcast(weights) if self.fits else weights, self.keys, "left"
            )
        olds = ", ".join("0D" if state is None else f"coalesce(w{i}, 0D)" for i in range(self.d))
        return gathered.selectExpr(*keys, "cells", f"array({olds}) AS w")

    def _weights(self, state: DataFrame) -> DataFrame:
        return state.select(*self.keys, *[f"w{i}" for i in range(self.d)])

    def choose_join(self, state: DataFrame) -> None:
        """Broadcast weights as large as these, or bring them to rows laid out by key.

        Rows are laid out as well where summing them in the tasks that read them
        does not make them fewer: then every step would send more than the rows.
        """
        self.fits = _table_bytes(state, self.keys, self.d) <= self.broadcast_limit
        if not self.fits or self._sums_outgrow_rows(state.count()):
            self._lay_out()

    def _shape(self) -> Shape:
        if self.stored.shape is None:
            self.stored.shape = measure(self.stored.rows, self.keys, self.keys)
        return self.stored.shape

    def _sums_outgrow_rows(self, keys: int) -> bool:
        """Whether one step's partial sums may hold more numbers than all rows.

        A task that reads more keys than its running sums hold sends them again and again.
        """
        if self.laid_out:
            return False
        shape, cells = self._shape(), self.d * (self.d + 3) // 2
        partial = min(shape.rows, keys * shape.tasks)
        if strategy_for(self.d) != "wide" and shape.pairs * cells * CELL_BYTES > RUNNING_BYTES * max(1, shape.tasks):
            partial = shape.rows
        return partial * (cells + self.d) > shape.rows * (self.d + 2)

    def _with_state(self, state: DataFrame) -> DataFrame:
        """Rows with the weights of their key; a key without weights has zeros."""
        weights = self._weights(state)
        if self.fits:
            joined = self.stored.rows.join(F.broadcast(weights), self.keys, "left")
        elif not self.salted:
            joined = self.stored.rows.join(weights.hint("merge"), self.keys, "left")
        else:
            salts = F.explode(F.expr("sequence(0, coalesce(salts, 1) - 1)"))
            copies = weights.join(F.broadcast(self.hot), self.keys, "left")
            copies = copies.withColumn(SALT, salts).drop("salts").hint("merge")
            joined = self.stored.rows.join(copies, [*self.keys, SALT], "left")
        names = [f"w{i}" for i in range(self.d)]
        others = [name(column) for column in joined.columns if column not in names]
        return joined.selectExpr(*others, *[f"coalesce({w}, 0D) AS {w}" for w in names])

    def _lay_out(self) -> None:
        """Rows by key, sorted; by key and salt if a key has many rows.

        The salt is the number of the task that read the row, so it stays the
        same when a lost task runs again. At most HOT_KEYS keys have more than
        ``per_salt`` rows, which bounds the broadcast side.
        """
        if self.laid_out:
            return
        rows, count = self.stored.rows, self.stored.count()
        per_salt = max(self.rows_per_salt, count // HOT_KEYS)
        sizes = rows.groupBy(*self.keys).agg(F.count("*").alias("size"))
        hot = sizes.filter(F.col("size") > per_salt)
        salts = F.ceil(F.col("size") / per_salt).cast("int").alias("salts")
        self.hot = hot.select(*self.keys, salts).persist(StorageLevel.MEMORY_AND_DISK)
        self.salted = not self.hot.isEmpty()
        places = [*self.keys, SALT] if self.salted else self.keys
        if self.salted:
            rows = rows.join(F.broadcast(self.hot), self.keys, "left").withColumn(
                SALT, F.expr("pmod(spark_partition_id(), coalesce(salts, 1))")
            ).drop("salts")
        configured = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        partitions = max(configured, math.ceil(count / per_salt))
        # Stored and counted here: a step sees that its rows are in place only
        # once the layout exists.
        self.stored.replace(
            rows.repartition(partitions, *places).sortWithinPartitions(*places)
        )
        self.laid_out = True


def _table_bytes(state: DataFrame, keys: Sequence[str], d: int) -> int:
    text = " + ".join(f"octet_length(CAST({name(key)} AS string))" for key in keys)
    return state.agg(F.sum(F.expr(f"{text} + {8 * d + 64}")).alias("bytes")).first()["bytes"] or 0


def solve_systems(
    systems: DataFrame, keys: Sequence[str], d: int, tolerance: float
) -> DataFrame:
    """``(key, w0 .., singular)``: weights after one step, in built-in expressions.

    The symmetric system is eliminated one column at a time and solved
    backwards. ``e2_i_j`` is cell (i, j) after two columns; each alias builds
    on earlier ones, so all stages are one projection.
    """
    stages = [f"a_{i}_{j} AS e0_{i}_{j}" for i in range(d) for j in range(i, d + 1)]
    for k in range(d - 1):
        for i in range(k + 1, d):
            factor = f"try_divide(e{k}_{k}_{i}, e{k}_{k}_{k})"
            for j in range(i, d + 1):
                stages.append(f"e{k}_{i}_{j} - {factor} * e{k}_{k}_{j} AS e{k + 1}_{i}_{j}")
    for i in reversed(range(d)):
        known = "".join(f" - e{i}_{i}_{j} * u{j}" for j in range(i + 1, d))
        stages.append(f"try_divide(e{i}_{i}_{d}{known}, e{i}_{i}_{i}) AS u{i}")
    share = number(tolerance)
    regular = " AND ".join(
        f"coalesce(abs(e{i}_{i}_{i}) > {share} * abs(a_{i}_{i}), false)" for i in range(d)
    )
    quoted = [name(key) for key in keys]
    olds = [f"w{i}" for i in range(d)]
    solved = systems.selectExpr(*quoted, *olds, *stages, f"NOT ({regular}) AS singular")
    news = [f"if(singular, w{i}, w{i} - u{i}) AS w{i}" for i in range(d)]
    return solved.selectExpr(*quoted, *news, "singular")


def solve_stacked(
    systems: DataFrame, keys: Sequence[str], d: int, tolerance: float
) -> DataFrame:
    """``(key, w0 .., singular)`` from the arrays of ``stacked_systems``."""
    at_i, at_j = np.array(hessian_cells(d)).T

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows == 0:
                continue
            w = batch.column("w").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            cells = batch.column("cells").flatten().to_numpy(zero_copy_only=False)
            cells = cells.reshape(batch.num_rows, -1)
            h = np.empty((batch.num_rows, d, d))
            h[:, at_i, at_j] = cells[:, d:]
            h[:, at_j, at_i] = cells[:, d:]
            update, singular = dense.newton_update(h, cells[:, :d], tolerance)
            columns = [batch.column(key) for key in keys]
            columns += [as_arrow(w - update), pa.array(singular)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "w", "singular"])

    schema = ", ".join([*ddl(systems, keys), "w array<double>, singular boolean"])
    solved = systems.mapInArrow(run, schema)
    weights = [f"w[{i}] AS w{i}" for i in range(d)]
    return solved.selectExpr(*[name(key) for key in keys], *weights, "singular")
