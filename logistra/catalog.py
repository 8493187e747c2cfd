"""The queries: every operator over whole tables, one scalar per output row.

Sums differ in their last bits with the order of the rows, so values are
rounded here and in the SQL they are checked against.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logistra.operators import exact, matrix, moments, scoring, tiles, validate, vectors
from logistra.plans import features, keyed, newton
from logistra.sources import model, text
from logistra.storage import new_table_path

Query = Callable[[SparkSession, str], DataFrame]

WEIGHTS = [-0.5, 0.1, 0.2]
ZEROS = [0.0, 0.0, 0.0]
LINE_KEY = ["l_orderkey", "l_linenumber"]
SUPPLIER = "l_suppkey"
# Cells of a large matrix that one task makes.
TASK_CELLS = 4_000_000


def rounded(value: str | Column, digits: int = 6) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    # Adding 0.0 turns -0.0 into 0.0.
    return F.round(value, digits) + F.lit(0.0)


def event_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The event vectors as text lines, target last."""
    rows = features.events(spark, folder)
    cells = F.concat(F.col("phi"), F.array("t")).cast("array<string>")
    return rows.select("event_id", F.concat_ws(" ", cells).alias("value"))


def ragged_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Event lines with one to seven features."""
    event = features.table(spark, folder, "events")
    cells = "transform(sequence(1, 1 + CAST(event_id % 7 AS int)), k -> value * k)"
    cells = f"CAST(array_append({cells}, CAST(user_id % 2 AS double)) AS array<string>)"
    return event.selectExpr("event_id", f"concat_ws(' ', {cells}) AS value")


# Sources and sinks


def load_labelled(spark: SparkSession, folder: str) -> DataFrame:
    rows = text.parse_labelled(event_lines(spark, folder), keep=["event_id"])
    cells = vectors.vector_to_indexed(rows, ["event_id", "t"])
    return cells.select("event_id", "i", rounded("v").alias("v"), "t")


def load_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = text.parse_vectors(event_lines(spark, folder), keep=["event_id"])
    cells = vectors.vector_to_indexed(rows, ["event_id"])
    return cells.select("event_id", "i", rounded("v").alias("v"))


def matrix_coo(spark: SparkSession, folder: str) -> DataFrame:
    cells = text.load_matrix_coo(event_lines(spark, folder), "event_id")
    return cells.select("i", "j", rounded("v").alias("v"))


def embedding_cells(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.vector_to_indexed(features.embeddings(spark, folder), ["vec_id"])


def vector_to_indexed(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_cells(spark, folder).select("vec_id", "i", rounded("v").alias("v"))


def indexed_to_dense(spark: SparkSession, folder: str) -> DataFrame:
    dense = vectors.indexed_to_dense(embedding_cells(spark, folder), "vec_id")
    cells = vectors.vector_to_indexed(dense.withColumn("d", F.size("phi")), ["vec_id", "d"])
    return cells.select("vec_id", "d", "i", rounded("v").alias("v"))


def model_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = new_table_path(spark, "model")
    model.save_model(newton.newton_train(features.line(spark, folder), 3, history=True), path)
    return steps(model.load_history(spark, path))


def written_lines(spark: SparkSession, folder: str, lines: DataFrame) -> str:
    """Path of the lines' text files: several, in the order of the events."""
    path = new_table_path(spark, "lines")
    parts = lines.repartitionByRange(4, "event_id").sortWithinPartitions("event_id")
    parts.select("value").write.text(path)
    return path


def text_labelled(spark: SparkSession, folder: str) -> DataFrame:
    rows = text.load_labelled(spark, written_lines(spark, folder, event_lines(spark, folder)))
    cells = vectors.vector_to_indexed(rows, ["row_id", "t"])
    return cells.select("i", rounded("v").alias("v"), "t")


def text_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = text.load_vectors(spark, written_lines(spark, folder, event_lines(spark, folder)))
    cells = vectors.vector_to_indexed(rows, ["row_id"])
    return cells.select("i", rounded("v").alias("v"))


def text_matrix(spark: SparkSession, folder: str) -> DataFrame:
    cells = text.load_matrix(spark, written_lines(spark, folder, event_lines(spark, folder)))
    return cells.select("i", "j", rounded("v").alias("v"))


def text_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh line has a word where a number should be."""
    lines = event_lines(spark, folder).withColumn(
        "value", F.expr("if(event_id % 7 = 0, concat('x', event_id, ' ', value), value)")
    )
    _, rejects = text.load_labelled(spark, written_lines(spark, folder, lines), on_error="reject")
    return rejects.select(F.substring_index("line", " ", 1).alias("word"))


def model_replace(spark: SparkSession, folder: str) -> DataFrame:
    """Six steps stored, then three: the load gives step 3."""
    path = new_table_path(spark, "model")
    for count in (6, 3):
        model.save_model(newton.newton_train(features.line(spark, folder), 3, count, history=True), path)
    return steps(model.load_model(spark, path))


# Checks


def dim_rejects(spark: SparkSession, folder: str) -> DataFrame:
    rows = text.parse_labelled(ragged_lines(spark, folder), keep=["event_id"])
    _, rejects = validate.check_dims(rows, 3, on_error="reject")
    return rejects.select("event_id", F.size("phi").alias("arity"))


def nan_guard(spark: SparkSession, folder: str) -> DataFrame:
    values = features.table(spark, folder, "events").selectExpr(
        "event_id", "if(event_id % 11 = 0, double('NaN'), value) AS v"
    )
    return validate.guard_cells(values).select("event_id", "v", "replaced")


def nan_guard_count(spark: SparkSession, folder: str) -> DataFrame:
    values = features.table(spark, folder, "events").selectExpr(
        "if(event_id % 11 = 0, double('NaN'), value) AS v"
    )
    return validate.replaced_count(validate.guard_cells(values))


def explode_array(spark: SparkSession, folder: str) -> DataFrame:
    rows = features.table(spark, folder, "events").selectExpr(
        "event_type", "CAST(sequence(0L, user_id % 10) AS array<double>) AS vals"
    )
    return vectors.explode_array(rows, "event_type", "vals")


# Row-wise jobs


def scored(column: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = scoring.score(features.line(spark, folder), WEIGHTS)
        return rows.select(*LINE_KEY, rounded(column).alias(column))

    return query


def with_weights(spark: SparkSession, folder: str) -> DataFrame:
    weights = newton.model_frame(spark, WEIGHTS)
    rows = scoring.score(scoring.with_weights(features.line(spark, folder), weights), "w")
    return rows.select(*LINE_KEY, F.size("w").alias("d"), rounded("margin").alias("margin"))


def row_gradient(spark: SparkSession, folder: str) -> DataFrame:
    rows = scoring.row_gradient(features.line(spark, folder), WEIGHTS)
    cells = vectors.vector_to_indexed(rows, LINE_KEY, "grad")
    return cells.select(*LINE_KEY, "i", rounded("v").alias("v"))


def row_curvature(spark: SparkSession, folder: str) -> DataFrame:
    rows = scoring.row_curvature(features.line(spark, folder), WEIGHTS)
    return rows.select(*LINE_KEY, rounded("h").alias("h"))


def row_hessian_coo(spark: SparkSession, folder: str) -> DataFrame:
    cells = scoring.row_hessian_coo(features.line(spark, folder), WEIGHTS, LINE_KEY)
    return cells.select(*LINE_KEY, "i", "j", rounded("h").alias("h"))


def row_hessian_dense(spark: SparkSession, folder: str) -> DataFrame:
    rows = scoring.row_hessian_dense(features.line(spark, folder), WEIGHTS)
    flat = rows.select(*LINE_KEY, F.flatten("hessian").alias("m"))
    cells = matrix.dense_to_coo(flat, 3, LINE_KEY)
    return cells.select(*LINE_KEY, "i", "j", rounded("v").alias("h"))


def row_gradient_element(spark: SparkSession, folder: str) -> DataFrame:
    """Element guard: a NaN feature costs the row its own gradient cell alone where w is 0."""
    rows = features.line(spark, folder).withColumn(
        "t", F.expr("if(l_linenumber = 7, double('NaN'), t)")
    )
    cells = vectors.vector_to_indexed(
        scoring.row_gradient(rows, WEIGHTS, guard="element"), LINE_KEY, "grad"
    )
    return cells.select(*LINE_KEY, "i", rounded("v").alias("v"))


# Sums


def vector_sum(spark: SparkSession, folder: str) -> DataFrame:
    sums = vectors.vector_sum(features.embeddings(spark, folder), "label")
    return sums.select("label", "i", rounded("v").alias("v"))


def exact_vector_sum(spark: SparkSession, folder: str) -> DataFrame:
    sums = exact.exact_vector_sum(features.embeddings(spark, folder), "label")
    return sums.select("label", "i", rounded("v").alias("v"))


def exact_sum_cancelling(spark: SparkSession, folder: str) -> DataFrame:
    """Prices beside the same prices times 1e25 and -1e25, which leave no digit to plain sums."""
    prices = features.table(spark, folder, "lineitem").selectExpr(
        "l_suppkey", "l_extendedprice AS p", "l_extendedprice * 1e25D AS much"
    )
    rows = prices.selectExpr("l_suppkey", "explode(array(array(much, p), array(p, -much), array(-much, much))) AS phi")
    sums = exact.exact_vector_sum(rows, "l_suppkey")
    return sums.select("l_suppkey", "i", rounded("v", 4).alias("v"))


def sum_by_key(spark: SparkSession, folder: str) -> DataFrame:
    sums = vectors.sum_by_key(features.table(spark, folder, "events"), "event_type", "value")
    return sums.select("event_type", rounded("total", 4).alias("total"))


def sum_by_key_int(spark: SparkSession, folder: str) -> DataFrame:
    events = features.table(spark, folder, "events").selectExpr(
        "event_type", "CAST(user_id AS int) AS user_id"
    )
    return vectors.sum_by_key(events, "event_type", "user_id")


def gradient_of(table: Callable, weights: list[float]) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        sums = moments.gradient(table(spark, folder), weights)
        return sums.select("i", rounded("g").alias("g"))

    return query


def hessian_of(table: Callable, weights: list[float]) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        sums = moments.hessian(table(spark, folder), weights)
        return sums.select("i", "j", rounded("h").alias("h"))

    return query


def gradient_binned(spark: SparkSession, folder: str) -> DataFrame:
    sums = moments.gradient_binned(features.line(spark, folder), WEIGHTS, "l_orderkey")
    return sums.select("bin", "i", rounded("g").alias("g"))


def gradient_bins_total(spark: SparkSession, folder: str) -> DataFrame:
    sums = moments.gradient_binned(features.line(spark, folder), WEIGHTS, "l_orderkey")
    return moments.bins_total(sums).select("i", rounded("g").alias("g"))


def gradient_by_key_products(spark: SparkSession, folder: str) -> DataFrame:
    sums = moments.gradient_by(features.line_products(spark, folder), SUPPLIER, [0.05] * 10)
    return sums.select(SUPPLIER, "i", rounded("v").alias("v"))


def hessian_by_key_products(spark: SparkSession, folder: str) -> DataFrame:
    sums = moments.hessian_by(features.line_products(spark, folder), SUPPLIER, [0.05] * 10)
    return sums.select(SUPPLIER, "i", "j", rounded("v").alias("v"))


# Tables of matrices with exact elimination: one per supplier, some singular,
# some scaled by 2^400 or 2^-400, rows 0 and 1 swapped for odd suppliers


def exact_matrices(spark: SparkSession, folder: str, d: int, scaled: bool = False) -> DataFrame:
    scale = "CASE s_suppkey % 5 WHEN 0 THEN pow(2D, 400) WHEN 1 THEN pow(2D, -400) ELSE 1D END"
    a, b, c = "s_suppkey % 7", "s_nationkey % 5", "s_suppkey % 11"
    rows = [["1", a, b], ["0", "2", c], ["0", "0", "if(s_suppkey % 3 = 0, 0, 4)"]]
    rows = [row + ["0"] * (d - 3) for row in rows]
    rows += [["0"] * i + [str(2 ** (i - 2))] + ["0"] * (d - i - 1) for i in range(3, d)]
    cells = ", ".join(
        f"struct({i} AS i, {j} AS j, CAST({x} AS double) AS v)"
        for i, row in enumerate(rows)
        for j, x in enumerate(row)
    )
    table = features.table(spark, folder, "supplier").selectExpr(
        "s_suppkey", f"{scale if scaled else '1D'} AS scale", f"inline(array({cells}))"
    )
    swapped = "CASE WHEN s_suppkey % 2 = 1 AND i < 2 THEN 1 - i ELSE i END AS i"
    return table.selectExpr("s_suppkey", swapped, "j", "v * scale AS v")


def transpose_swapped(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.transpose(exact_matrices(spark, folder, 3), "s_suppkey")


def upper_triangle_swapped(spark: SparkSession, folder: str) -> DataFrame:
    cells = matrix.upper_triangle(exact_matrices(spark, folder, 3), 3, "s_suppkey")
    return cells.select("s_suppkey", "i", "j", rounded("v").alias("v"), "sign")


def determinant_singular(d: int) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        table = matrix.determinant(exact_matrices(spark, folder, d, scaled=True), d, "s_suppkey")
        return table.select("s_suppkey", "sign", rounded("log_abs_det").alias("log_abs_det"))

    return query


def adjugate_singular(d: int) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        cells = matrix.adjugate(exact_matrices(spark, folder, d), d, "s_suppkey")
        return cells.select("s_suppkey", "i", "j", rounded("v").alias("v"))

    return query


def star_matrices(spark: SparkSession, folder: str) -> DataFrame:
    """16 x 16 of rank 15: per return flag, the Laplacian of a star with mean quantities as weights."""
    edges = (
        features.table(spark, folder, "lineitem")
        .groupBy("l_returnflag", F.expr("CAST(1 + l_orderkey % 15 AS int) AS leaf"))
        .agg(F.avg(F.col("l_quantity") / 25).alias("w"))
    )
    own = "struct(leaf AS i, leaf AS j, w AS v), struct(0 AS i, 0 AS j, w AS v)"
    sides = "struct(0 AS i, leaf AS j, -w AS v), struct(leaf AS i, 0 AS j, -w AS v)"
    filled = edges.selectExpr("l_returnflag", f"inline(array({own}, {sides}))")
    zeros = (
        edges.select("l_returnflag")
        .distinct()
        .selectExpr("l_returnflag", "explode(sequence(0, 255)) AS place")
        .selectExpr("l_returnflag", "CAST(place DIV 16 AS int) AS i", "CAST(place % 16 AS int) AS j", "0D AS v")
    )
    return filled.union(zeros).groupBy("l_returnflag", "i", "j").agg(F.sum("v").alias("v"))


def adjugate_singular_large(spark: SparkSession, folder: str) -> DataFrame:
    cells = matrix.adjugate(star_matrices(spark, folder), 16, "l_returnflag")
    return cells.select("l_returnflag", "i", "j", rounded("v").alias("v"))


def inverse_condition(spark: SparkSession, folder: str) -> DataFrame:
    """[[1, 1], [0, g]] with g from 1 to 2^-50 has the condition number 2 (1 + g) / g."""
    cells = "struct(0 AS i, 0 AS j, 1D AS v), struct(0 AS i, 1 AS j, 1D AS v), "
    cells += "struct(1 AS i, 0 AS j, 0D AS v), struct(1 AS i, 1 AS j, pow(2D, -(s_suppkey % 51)) AS v)"
    table = features.table(spark, folder, "supplier").selectExpr("s_suppkey", f"inline(array({cells}))")
    return matrix.inverse(table, 2, "s_suppkey", condition_limit=1e9)


def inverse_singular(d: int) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        cells = matrix.inverse(exact_matrices(spark, folder, d, scaled=True), d, "s_suppkey")
        back = "CASE s_suppkey % 5 WHEN 0 THEN pow(2D, 400) WHEN 1 THEN pow(2D, -400) ELSE 1D END"
        return cells.select("s_suppkey", "i", "j", rounded(F.expr(f"v * {back}")).alias("v"), "singular")

    return query


# Tables of matrices: one Hessian per supplier, 3 x 3 or 5 x 5


def hessians(spark: SparkSession, folder: str, d: int) -> DataFrame:
    table = features.line if d == 3 else features.line_wide
    return moments.hessian_by(table(spark, folder), SUPPLIER, [0.0] * d)


def coo_to_dense(spark: SparkSession, folder: str) -> DataFrame:
    dense = matrix.coo_to_dense(hessians(spark, folder, 3), 3, SUPPLIER)
    cells = vectors.vector_to_indexed(dense, [SUPPLIER], "m", "place")
    return cells.select(SUPPLIER, "place", rounded("v").alias("v"))


def transpose(spark: SparkSession, folder: str) -> DataFrame:
    swapped = matrix.transpose(hessians(spark, folder, 3), SUPPLIER)
    return swapped.select(SUPPLIER, "i", "j", rounded("v").alias("v"))


def transpose_rectangular(spark: SparkSession, folder: str) -> DataFrame:
    cells = embedding_cells(spark, folder).select(
        F.col("vec_id").alias("i"), F.col("i").alias("j"), "v"
    )
    return matrix.transpose(cells).select("i", "j", rounded("v").alias("v"))


def upper_triangle(d: int) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        cells = matrix.upper_triangle(hessians(spark, folder, d), d, SUPPLIER)
        return cells.select(SUPPLIER, "i", "j", rounded("v").alias("v"), "sign")

    return query


def determinant(d: int) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        table = matrix.determinant(hessians(spark, folder, d), d, SUPPLIER)
        return table.select(
            SUPPLIER, rounded("det", 3).alias("det"), "sign", rounded("log_abs_det").alias("log_abs_det")
        )

    return query


def adjugate_digits(d: int) -> int:
    """Narrow cofactors are decimal fractions of up to 8 digits; fewer would be ties."""
    return 8 if d == 3 else 3


def adjugate(d: int) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        cells = matrix.adjugate(hessians(spark, folder, d), d, SUPPLIER)
        return cells.select(SUPPLIER, "i", "j", rounded("v", adjugate_digits(d)).alias("v"))

    return query


def inverse(d: int) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        cells = matrix.inverse(hessians(spark, folder, d), d, SUPPLIER)
        return cells.select(SUPPLIER, "i", "j", rounded("v").alias("v"), "singular")

    return query


def supplier_tiles(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """One matrix with a row and a column per supplier: diagonal plus rank one, rows reversed."""
    supplier = features.table(spark, folder, "supplier")
    d = supplier.count()
    # A supplier becomes a row of d cells, so few suppliers are a task's work.
    spread = supplier.repartition(max(1, d * d // TASK_CELLS))
    rows = spread.selectExpr(
        "s_suppkey AS i", "s_acctbal / 10000 AS u", f"explode(sequence(0, {d - 1})) AS j"
    )
    diagonal = "if(i = j, 1D + i % 7, 0D)"
    cells = rows.selectExpr(f"CAST({d - 1} - i AS int) AS i", "j", f"{diagonal} + u * (((7 * j) % 11 - 5) / 11D) AS v")
    return cells, d


def determinant_tiled(spark: SparkSession, folder: str) -> DataFrame:
    cells, d = supplier_tiles(spark, folder)
    found = tiles.determinant(cells, d, size=64)
    return found.select("sign", rounded("log_abs_det").alias("log_abs_det"))


def inverse_tiled(spark: SparkSession, folder: str) -> DataFrame:
    cells, d = supplier_tiles(spark, folder)
    return tiles.inverse(cells, d, size=64).select("i", "j", rounded("v").alias("v"), "singular")


def matvec(spark: SparkSession, folder: str) -> DataFrame:
    wanted = moments.hessian_cells(3) + moments.gradient_cells(3)
    both = moments.system_by(features.line(spark, folder), SUPPLIER, ZEROS, wanted)
    inverses = matrix.inverse(moments.mirror(both.where("j < 3"), "v", [SUPPLIER]), 3, SUPPLIER)
    gradients = both.where("j = 3").drop("j")
    product = matrix.matvec(inverses, gradients, SUPPLIER)
    return product.select(SUPPLIER, "i", rounded("v").alias("v"))


def vector_subtract(spark: SparkSession, folder: str) -> DataFrame:
    rows = features.line(spark, folder)
    at_zero = moments.gradient_by(rows, SUPPLIER, ZEROS)
    at_weights = moments.gradient_by(rows, SUPPLIER, WEIGHTS)
    change = vectors.vector_subtract(at_zero, at_weights, SUPPLIER)
    return change.select(SUPPLIER, "i", rounded("v").alias("v"))


# Training


def newton_step(spark: SparkSession, folder: str) -> DataFrame:
    step = newton.newton_step(features.line(spark, folder), WEIGHTS)
    values = [rounded(c).alias(c) for c in ["w_old", "g", "update", "w_new"]]
    return step.select("i", *values, "singular")


def steps(trained: DataFrame) -> DataFrame:
    others = [c for c in trained.columns if c not in ("w", "singular")]
    return trained.select(*others, rounded("w").alias("w"), "singular")


def train(table: Callable, d: int, persist: bool = False, strategy: str = "auto") -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return steps(newton.newton_train(table(spark, folder), d, persist=persist, strategy=strategy))

    return query


def newton_history(spark: SparkSession, folder: str) -> DataFrame:
    return steps(newton.newton_train(features.line(spark, folder), 3, history=True))


def newton_resume(spark: SparkSession, folder: str) -> DataFrame:
    rows = features.line(spark, folder)
    path = new_table_path(spark, "model")
    model.save_model(newton.newton_train(rows, 3, iterations=3), path)
    stored = model.load_model(spark, path)
    return steps(newton.newton_train(rows, 3, iterations=3, init=stored))


def newton_journal(spark: SparkSession, folder: str) -> DataFrame:
    """Three steps, and a second run that goes on behind them."""
    rows, path = features.line(spark, folder), new_table_path(spark, "journal")
    newton.newton_train(rows, 3, iterations=3, journal=path)
    return steps(newton.newton_train(rows, 3, history=True, journal=path))


def newton_by_key_journal(table: Callable, d: int) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows, path = table(spark, folder), new_table_path(spark, "journal")
        keyed.newton_train_by(rows, SUPPLIER, d, iterations=3, journal=path)
        return steps(keyed.newton_train_by(rows, SUPPLIER, d, journal=path))

    return query


def newton_observed(spark: SparkSession, folder: str) -> DataFrame:
    """Rejected and guarded rows, counted by the pass of the first step itself."""
    damaged = "CASE l_linenumber WHEN 7 THEN transform(phi, x -> double('NaN')) WHEN 6 THEN slice(phi, 1, 2) ELSE phi END"
    rows = features.line(spark, folder).withColumn("phi", F.expr(damaged))
    fit, counts = validate.observe_rows(rows, 3)
    newton.newton_train(fit, 3, iterations=1, collapse="never")
    found = counts.get
    return spark.createDataFrame(
        [(found["rows"], found["rejected"], found["guarded"])], "rows long, rejected long, guarded long"
    )


def newton_by_key(table: Callable, d: int, history: bool = False) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return steps(keyed.newton_train_by(table(spark, folder), SUPPLIER, d, history=history))

    return query


def newton_by_key_nan(table: Callable, d: int) -> Query:
    """Rows with a NaN feature add nothing to their key's sums."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        damaged = "if(l_linenumber = 7, transform(phi, x -> double('NaN')), phi)"
        rows = table(spark, folder, ["l_linenumber"]).withColumn("phi", F.expr(damaged))
        return steps(keyed.newton_train_by(rows, SUPPLIER, d))

    return query


def newton_by_part(spark: SparkSession, folder: str) -> DataFrame:
    """The first step of one model per part: many keys, few lines each."""
    features_of_line = [F.lit(1.0), F.col("l_quantity") / 50, F.col("l_discount") * 10]
    rows = features.vector_table(
        features.table(spark, folder, "lineitem"), features_of_line, F.col("l_returnflag") == "R", ["l_partkey"]
    )
    return steps(keyed.newton_train_by(rows, "l_partkey", 3, iterations=1, collapse="never"))


QUERIES: dict[str, Query] = {
    "load_labelled": load_labelled,
    "load_vectors": load_vectors,
    "matrix_coo": matrix_coo,
    "indexed_to_dense": indexed_to_dense,
    "vector_to_indexed": vector_to_indexed,
    "text_labelled": text_labelled,
    "text_vectors": text_vectors,
    "text_matrix": text_matrix,
    "text_rejects": text_rejects,
    "model_roundtrip": model_roundtrip,
    "model_replace": model_replace,
    "dim_rejects": dim_rejects,
    "nan_guard": nan_guard,
    "nan_guard_count": nan_guard_count,
    "newton_observed": newton_observed,
    "newton_journal": newton_journal,
    "newton_by_key_journal": newton_by_key_journal(features.line_wide, 5),
    "adjugate_singular_large": adjugate_singular_large,
    "inverse_condition": inverse_condition,
    "explode_array": explode_array,
    "score_margin": scored("margin"),
    "score_prob": scored("p"),
    "score_resid": scored("resid"),
    "score_curv": scored("curv"),
    "with_weights": with_weights,
    "row_gradient": row_gradient,
    "row_gradient_element": row_gradient_element,
    "row_curvature": row_curvature,
    "row_hessian_coo": row_hessian_coo,
    "row_hessian_dense": row_hessian_dense,
    "vector_sum": vector_sum,
    "exact_vector_sum": exact_vector_sum,
    "exact_sum_cancelling": exact_sum_cancelling,
    "sum_by_key": sum_by_key,
    "sum_by_key_int": sum_by_key_int,
    "gradient": gradient_of(features.line, WEIGHTS),
    "gradient_zero": gradient_of(features.line, ZEROS),
    "gradient_embeddings": gradient_of(features.embeddings, [0.01] * 64),
    "gradient_binned": gradient_binned,
    "gradient_bins_total": gradient_bins_total,
    "hessian": hessian_of(features.line, WEIGHTS),
    "hessian_zero": hessian_of(features.line, ZEROS),
    "hessian_embeddings": hessian_of(features.embeddings, [0.01] * 64),
    "gradient_by_key_products": gradient_by_key_products,
    "hessian_by_key_products": hessian_by_key_products,
    "transpose_swapped": transpose_swapped,
    "upper_triangle_swapped": upper_triangle_swapped,
    "determinant_singular": determinant_singular(3),
    "determinant_singular_wide": determinant_singular(5),
    "adjugate_singular": adjugate_singular(3),
    "adjugate_singular_wide": adjugate_singular(5),
    "inverse_singular": inverse_singular(3),
    "inverse_singular_wide": inverse_singular(5),
    "coo_to_dense": coo_to_dense,
    "transpose": transpose,
    "transpose_rectangular": transpose_rectangular,
    "upper_triangle": upper_triangle(3),
    "upper_triangle_wide": upper_triangle(5),
    "determinant": determinant(3),
    "determinant_wide": determinant(5),
    "adjugate": adjugate(3),
    "adjugate_wide": adjugate(5),
    "inverse": inverse(3),
    "inverse_wide": inverse(5),
    "determinant_tiled": determinant_tiled,
    "inverse_tiled": inverse_tiled,
    "matvec": matvec,
    "vector_subtract": vector_subtract,
    "newton_step": newton_step,
    "newton_train": train(features.line, 3),
    "newton_train_wide": train(features.line_wide, 5),
    "newton_train_products": train(features.line_products, 10),
    "newton_train_events": train(features.events, 3),
    "newton_train_orders": train(features.orders, 3),
    "newton_train_documents": train(features.documents, 3, persist=True),
    "newton_train_embeddings": train(features.embeddings, 64),
    "newton_train_exact": train(features.line, 3, strategy="exact"),
    "newton_history": newton_history,
    "newton_resume": newton_resume,
    "newton_by_key": newton_by_key(features.line, 3),
    "newton_by_key_history": newton_by_key(features.line, 3, history=True),
    "newton_by_key_wide": newton_by_key(features.line_wide, 5),
    "newton_by_key_products": newton_by_key(features.line_products, 10),
    "newton_by_part": newton_by_part,
    "newton_by_key_nan": newton_by_key_nan(features.line_wide, 5),
    "newton_by_key_nan_products": newton_by_key_nan(features.line_products, 10),
}
