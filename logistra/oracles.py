"""SQL for DuckDB that computes what each query computes, its own way.

Matrices are nested lists, linear systems are eliminated with list lambdas,
and training unrolls its steps into common table expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

SUPPLIER = "l_suppkey"
LINE_KEY = "l_orderkey, l_linenumber"
WEIGHTS = [-0.5, 0.1, 0.2]
ZEROS = [0.0, 0.0, 0.0]

LINE = """
SELECT l_orderkey, l_linenumber, l_suppkey,
       [1.0, l_quantity / 50, l_discount * 10]::DOUBLE[] AS phi,
       (l_returnflag = 'R')::INT::DOUBLE AS t
FROM lineitem"""
LINE_WIDE = """
SELECT l_suppkey,
       [1.0, l_quantity / 50, l_discount * 10, l_tax * 10, l_extendedprice / 100000]::DOUBLE[]
         AS phi,
       (l_returnflag = 'R')::INT::DOUBLE AS t
FROM lineitem"""
LINE_PRODUCTS = """
SELECT l_suppkey, t,
       [1.0, q, d, x, q * q, d * d, x * x, q * d, q * x, d * x]::DOUBLE[] AS phi
FROM (SELECT l_suppkey, l_quantity / 50 AS q, l_discount * 10 AS d, l_tax * 10 AS x,
             (l_returnflag = 'R')::INT::DOUBLE AS t
      FROM lineitem)"""
EVENTS = """
SELECT event_id, [1.0, value / 100, (event_type = 'error')::INT]::DOUBLE[] AS phi,
       (user_id % 2)::DOUBLE AS t
FROM events"""
ORDERS = """
SELECT o_orderkey,
       [1.0, o_totalprice / 100000, (o_orderpriority = '1-URGENT')::INT]::DOUBLE[] AS phi,
       (o_orderstatus = 'F')::INT::DOUBLE AS t
FROM orders"""
DOCUMENTS = """
SELECT d.doc_id, [1.0, ln(1 + n_chars), (lang = 'en')::INT]::DOUBLE[] AS phi,
       quality::DOUBLE AS t
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""
EMBEDDINGS = """
SELECT vec_id, label, embedding::DOUBLE[] AS phi, (label = 0)::INT::DOUBLE AS t
FROM embeddings"""


def rounded(value: str, digits: int = 6) -> str:
    return f"CASE WHEN round({value}, {digits}) = 0 THEN 0.0 ELSE round({value}, {digits}) END"


def vector(weights: Sequence[float]) -> str:
    return "[" + ", ".join(repr(float(w)) for w in weights) + "]::DOUBLE[]"


def scored(table: str, weights: Sequence[float]) -> str:
    """Rows with margin, p, resid and curv."""
    return f"""
SELECT *, p - t AS resid, p * (1 - p) AS curv FROM (
  SELECT *, 1 / (1 + exp(-margin)) AS p FROM (
    SELECT *, list_dot_product(phi, {vector(weights)}) AS margin FROM ({table})))"""


def cells(source: str, array: str, keep: str, d: int, value: str = "v", digits: int = 6) -> str:
    """One row per array cell."""
    return f"""
SELECT {keep}, i::INT AS i, {rounded(f'{array}[i + 1]', digits)} AS {value}
FROM ({source}), range({d}) AS r(i)"""


def system(rows: str, d: int, key: str | None = None) -> str:
    """One augmented matrix [H | g] as nested lists, from rows with resid and curv."""
    keyed = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    if d <= 10:
        lists = ", ".join(
            "["
            + ", ".join(f"sum(curv * phi[{i}] * phi[{j}])" for j in range(1, d + 1))
            + f", sum(resid * phi[{i}])]"
            for i in range(1, d + 1)
        )
        return f"SELECT {keyed}[{lists}] AS m FROM {rows} {group}"
    return f"""
SELECT list(line ORDER BY i) AS m FROM (
  SELECT i, list(v ORDER BY j) AS line FROM (
    SELECT i, j, sum(CASE WHEN j = {d} THEN resid * phi[i + 1]
                          ELSE curv * phi[i + 1] * phi[j + 1] END) AS v
    FROM {rows}, range({d}) AS a(i), range({d + 1}) AS b(j) GROUP BY i, j)
  GROUP BY i)"""


def reduced(m: str, d: int) -> str:
    """Gauss-Jordan elimination of a nested list with at least d columns."""
    return f"""list_reduce(range(0, {d}), lambda acc, k: list_transform(acc, lambda line, r:
      CASE WHEN r - 1 = k THEN list_transform(line, lambda x: x / line[k + 1])
           ELSE list_transform(line, lambda x, c:
             x - line[k + 1] * acc[k + 1][c] / acc[k + 1][k + 1]) END), {m})"""


def triangle(m: str, d: int) -> str:
    """Forward elimination only, rows unscaled."""
    return f"""list_reduce(range(0, {d - 1}), lambda acc, k: list_transform(acc, lambda line, r:
      CASE WHEN r - 1 <= k THEN line
           ELSE list_transform(line, lambda x, c: CASE WHEN c - 1 <= k THEN 0.0
             ELSE x - line[k + 1] / acc[k + 1][k + 1] * acc[k + 1][c] END) END), {m})"""


def training(table: str, d: int, steps: int = 6, key: str | None = None) -> str:
    """CTEs ft, w0 .. w<steps>; each w holds the key and one list of weights."""
    on = f"USING ({key})" if key else "ON TRUE"
    keyed = f"{key}, " if key else ""
    start = f"SELECT DISTINCT {key}, " if key else "SELECT "
    source = " FROM ft" if key else ""
    parts = [
        f"ft AS MATERIALIZED ({table})",
        f"w0 AS MATERIALIZED ({start}{vector([0.0] * d)} AS w{source})",
    ]
    for k in range(1, steps + 1):
        parts.append(
            f"""s{k} AS MATERIALIZED (
  SELECT {keyed}phi, p - t AS resid, p * (1 - p) AS curv FROM (
    SELECT {keyed}phi, t, 1 / (1 + exp(-list_dot_product(phi, w))) AS p
    FROM ft JOIN w{k - 1} {on}))"""
        )
        parts.append(f"m{k} AS MATERIALIZED ({system(f's{k}', d, key)})")
        parts.append(
            f"""w{k} AS MATERIALIZED (
  SELECT {keyed}list_transform(range(0, {d}), lambda i: w[i + 1] - u[i + 1][{d + 1}]) AS w
  FROM (SELECT *, {reduced('m', d)} AS u FROM m{k} JOIN w{k - 1} {on}))"""
        )
    return "WITH " + ",\n".join(parts)


def trained(table: str, d: int, key: str | None = None) -> str:
    keyed = f"{key}, " if key else ""
    return f"""{training(table, d, 6, key)}
SELECT {keyed}i::INT AS i, {rounded('w[i + 1]')} AS w, FALSE AS singular
FROM w6, range({d}) AS r(i)"""


def history(table: str, d: int, key: str | None = None) -> str:
    keyed = f"{key}, " if key else ""
    union = " UNION ALL ".join(f"SELECT {k} AS iteration, {keyed}w FROM w{k}" for k in range(1, 7))
    return f"""{training(table, d, 6, key)}
SELECT iteration::INT AS iteration, {keyed}i::INT AS i, {rounded('w[i + 1]')} AS w,
       FALSE AS singular
FROM ({union}), range({d}) AS r(i)"""


def gradient(table: str, weights: Sequence[float]) -> str:
    d = len(weights)
    total = rounded("sum(resid * phi[i + 1])")
    rows = scored(table, weights)
    return f"SELECT i::INT AS i, {total} AS g FROM ({rows}), range({d}) AS r(i) GROUP BY i"


def hessian(table: str, weights: Sequence[float]) -> str:
    d = len(weights)
    return f"""
SELECT i::INT AS i, j::INT AS j, {rounded('sum(curv * phi[i + 1] * phi[j + 1])')} AS h
FROM ({scored(table, weights)}), range({d}) AS a(i), range({d}) AS b(j) GROUP BY i, j"""


def supplier_matrices(d: int) -> str:
    """(l_suppkey, m): one augmented matrix [H | g] per supplier at weights 0."""
    rows = scored(LINE if d == 3 else LINE_WIDE, [0.0] * d)
    return system(f"({rows})", d, SUPPLIER)


def hessian_only(d: int) -> str:
    return f"list_transform(m, lambda line: line[1:{d}])"


def with_identity(d: int) -> str:
    return f"""list_transform(m, lambda line, r: list_concat(line[1:{d}],
      list_transform(range(1, {d + 1}), lambda c: (c = r)::INT::DOUBLE)))"""


def supplier_cells(d: int, matrix: str, cell: str, extra: str = "", digits: int = 6) -> str:
    """One row per supplier and cell of ``matrix``, bound to the name x."""
    return f"""
SELECT {SUPPLIER}, i::INT AS i, j::INT AS j, {rounded(cell, digits)} AS v{extra}
FROM (SELECT {SUPPLIER}, m, {matrix} AS x FROM ({supplier_matrices(d)})),
     range({d}) AS a(i), range({d}) AS b(j)"""


def diagonal(matrix: str, d: int) -> str:
    return " * ".join(f"({matrix})[{k}][{k}]" for k in range(1, d + 1))


# One matrix D + u v', whose inverse and determinant are known, with its rows reversed.
TILED = """
WITH s AS (SELECT s_suppkey AS i, s_acctbal / 10000 AS u, 1.0::DOUBLE + s_suppkey % 7 AS d,
                  ((7 * s_suppkey) % 11 - 5) / 11.0::DOUBLE AS v FROM supplier),
     f AS (SELECT count(*) AS n, 1 + sum(u * v / d) AS c, sum(ln(d)) AS logs FROM s)"""


def determinants(d: int) -> str:
    return f"""
SELECT {SUPPLIER}, {rounded('det', 3)} AS det, sign(det)::DOUBLE AS sign,
       {rounded('ln(abs(det))')} AS log_abs_det
FROM (SELECT {SUPPLIER}, {diagonal('u', d)} AS det
      FROM (SELECT {SUPPLIER}, {triangle(hessian_only(d), d)} AS u
            FROM ({supplier_matrices(d)})))"""


def adjugates(d: int) -> str:
    """The inverse times the determinant; no supplier's matrix is singular."""
    cell = rounded(f"x[i + 1][j + {d + 1}] * det", 8 if d == 3 else 3)
    return f"""
SELECT {SUPPLIER}, i::INT AS i, j::INT AS j, {cell} AS v
FROM (SELECT {SUPPLIER}, x, {diagonal('u', d)} AS det FROM (
        SELECT {SUPPLIER}, {reduced(with_identity(d), d)} AS x,
               {triangle(hessian_only(d), d)} AS u
        FROM ({supplier_matrices(d)}))),
     range({d}) AS a(i), range({d}) AS b(j)"""


LINES = f"""
SELECT event_id,
       concat_ws(' ', phi[1]::VARCHAR, phi[2]::VARCHAR, phi[3]::VARCHAR, t::VARCHAR) AS line
FROM ({EVENTS})"""
NUMBERS = f"""
SELECT event_id, list_transform(string_split(line, ' '), lambda s: s::DOUBLE) AS numbers
FROM ({LINES})"""
INJECTED = """
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE ELSE value END AS v FROM events"""


def score_query(column: str) -> str:
    return f"SELECT {LINE_KEY}, {rounded(column)} AS {column} FROM ({scored(LINE, WEIGHTS)})"


def row_hessian() -> str:
    return f"""
SELECT {LINE_KEY}, i::INT AS i, j::INT AS j,
       {rounded('phi[i + 1] * phi[j + 1] * curv')} AS h
FROM ({scored(LINE, WEIGHTS)}), range(3) AS a(i), range(3) AS b(j)"""


def step() -> str:
    w = vector(WEIGHTS)
    rows = scored(LINE, WEIGHTS)
    return f"""
SELECT i::INT AS i, {rounded(f'({w})[i + 1]')} AS w_old, {rounded('m[i + 1][4]')} AS g,
       {rounded('u[i + 1][4]')} AS update, {rounded(f'({w})[i + 1] - u[i + 1][4]')} AS w_new,
       FALSE AS singular
FROM (SELECT m, {reduced('m', 3)} AS u FROM ({system(f'({rows})', 3)})), range(3) AS r(i)"""


def supplier_gradient(weights: Sequence[float]) -> str:
    return f"""
SELECT {SUPPLIER}, i, sum(resid * phi[i + 1]) AS v
FROM ({scored(LINE, weights)}), range(3) AS r(i) GROUP BY {SUPPLIER}, i"""


NOT_SEVEN = " WHERE l_linenumber <> 7"

# The matrices of ``exact_matrices``, as numbers a, b, c, e of
# [[1, a, b], [0, 2, c], [0, 0, e]], followed by 2 and 4 on the diagonal in wide ones.
EXACT = """
SELECT s_suppkey, (s_suppkey % 2 = 1) AS swapped, (s_suppkey % 7)::DOUBLE AS a,
       (s_nationkey % 5)::DOUBLE AS b, (s_suppkey % 11)::DOUBLE AS c,
       (CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 4 END)::DOUBLE AS e,
       CASE s_suppkey % 5 WHEN 0 THEN 400 WHEN 1 THEN -400 ELSE 0 END AS power
FROM supplier"""


def exact_cells(d: int, cells: dict[tuple[int, int], str], swap: str, extra: str = "") -> str:
    """Rows of a d x d matrix given by its non-zero cells; ``swap`` is i or j."""
    value = "CASE " + " ".join(
        f"WHEN r = {i} AND k = {j} THEN {v}" for (i, j), v in cells.items()
    )
    place = {"i": "r", "j": "k"}[swap]
    exchanged = f"CASE WHEN swapped AND {place} < 2 THEN 1 - {place} ELSE {place} END"
    i, j = (exchanged, "k") if swap == "i" else ("r", exchanged)
    return f"""
SELECT s_suppkey, ({i})::INT AS i, ({j})::INT AS j, {rounded(f'({value} ELSE 0.0::DOUBLE END)')} AS v{extra}
FROM ({EXACT}), range({d}) AS x(r), range({d}) AS y(k)"""


TRIANGLE = {(0, 0): "1.0", (0, 1): "a", (0, 2): "b", (1, 1): "2.0", (1, 2): "c", (2, 2): "e"}


def exact_adjugate(d: int) -> str:
    """adj(P T) = adj(T) adj(P): columns 0 and 1 swapped and all cells negated."""
    wide = "8 * " if d == 5 else ""
    sign = "(CASE WHEN swapped THEN -1 ELSE 1 END)"
    cells = {
        (0, 0): "2 * e", (0, 1): "-a * e", (0, 2): "(a * c - 2 * b)",
        (1, 1): "e", (1, 2): "-c", (2, 2): "2",
    }
    out = {place: f"{sign} * {wide}({v})" for place, v in cells.items()}
    if d == 5:
        out |= {(3, 3): f"{sign} * 4 * 2 * e", (4, 4): f"{sign} * 2 * 2 * e"}
    return exact_cells(d, out, "j")


def exact_inverse(d: int) -> str:
    cells = {
        (0, 0): "1.0", (0, 1): "-a / 2", (0, 2): "(a * c / 2 - b) / e",
        (1, 1): "0.5", (1, 2): "-c / (2 * e)", (2, 2): "1 / e",
    }
    if d == 5:
        cells |= {(3, 3): "0.5", (4, 4): "0.25"}
    regular = {place: f"CASE WHEN e = 0 THEN 0 ELSE {v} END" for place, v in cells.items()}
    return exact_cells(d, regular, "j", ", e = 0 AS singular")


def exact_determinant(d: int) -> str:
    size = "2 * e * 8" if d == 5 else "2 * e"
    return f"""
SELECT s_suppkey, (CASE WHEN e = 0 THEN 0 WHEN swapped THEN -1 ELSE 1 END)::DOUBLE AS sign,
       CASE WHEN e > 0 THEN {rounded(f'ln({size}) + {d} * power * ln(2)')} END AS log_abs_det
FROM ({EXACT})"""


def first_step_by_part() -> str:
    """At weights 0 all curvatures are 1/4: H is singular where X'X is, by its three pivots."""
    rows = scored(LINE.replace("l_suppkey", "l_partkey"), ZEROS)
    share = "1e-13"
    return f"""
WITH m AS MATERIALIZED ({system(f'({rows})', 3, 'l_partkey')}),
pivots AS MATERIALIZED (
  SELECT l_partkey, m, {triangle('m', 3)} AS u FROM m),
regular AS MATERIALIZED (
  SELECT l_partkey, m, coalesce(abs(m[1][1]) > 0 AND abs(u[2][2]) > {share} * abs(m[2][2])
         AND abs(u[3][3]) > {share} * abs(m[3][3]), FALSE) AS ok FROM pivots)
SELECT l_partkey, i::INT AS i, CASE WHEN ok THEN {rounded('-x[i + 1][4]')} ELSE 0.0 END AS w,
       NOT ok AS singular
FROM (SELECT l_partkey, ok, {reduced('m', 3)} AS x FROM regular), range(3) AS r(i)"""


ORACLES: dict[str, str] = {
    "text_labelled": f"""
SELECT i::INT AS i, {rounded('numbers[i + 1]')} AS v, numbers[4] AS t
FROM ({NUMBERS}), range(3) AS r(i)""",
    "text_vectors": f"""
SELECT i::INT AS i, {rounded('numbers[i + 1]')} AS v FROM ({NUMBERS}), range(4) AS r(i)""",
    "text_matrix": f"""
SELECT n AS i, j::INT AS j, {rounded('numbers[j + 1]')} AS v
FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS n, numbers FROM ({NUMBERS})),
     range(3) AS r(j)""",
    "text_rejects": "SELECT 'x' || event_id::VARCHAR AS word FROM events WHERE event_id % 7 = 0",
    "model_replace": f"""{training(LINE, 3, 3)}
SELECT i::INT AS i, {rounded('w[i + 1]')} AS w, FALSE AS singular FROM w3, range(3) AS r(i)""",
    "row_gradient_element": f"""
SELECT {LINE_KEY}, i::INT AS i,
       CASE WHEN l_linenumber = 7 THEN 0.0 ELSE {rounded('resid * phi[i + 1]')} END AS v
FROM ({scored(LINE, WEIGHTS)}), range(3) AS r(i)""",
    "gradient_by_key_products": f"""
SELECT {SUPPLIER}, i::INT AS i, {rounded('sum(resid * phi[i + 1])')} AS v
FROM ({scored(LINE_PRODUCTS, [0.05] * 10)}), range(10) AS r(i) GROUP BY {SUPPLIER}, i""",
    "hessian_by_key_products": f"""
SELECT {SUPPLIER}, i::INT AS i, j::INT AS j, {rounded('sum(curv * phi[i + 1] * phi[j + 1])')} AS v
FROM ({scored(LINE_PRODUCTS, [0.05] * 10)}), range(10) AS a(i), range(10) AS b(j)
GROUP BY {SUPPLIER}, i, j""",
    "transpose_swapped": f"SELECT s_suppkey, j AS i, i AS j, v FROM ({exact_cells(3, TRIANGLE, 'i')})",
    "upper_triangle_swapped": f"""
SELECT s_suppkey, r::INT AS i, k::INT AS j, {rounded('v')} AS v,
       (CASE WHEN swapped THEN -1 ELSE 1 END)::INT AS sign
FROM (SELECT *, CASE {' '.join(f'WHEN r = {i} AND k = {j} THEN {v}' for (i, j), v in TRIANGLE.items())}
             ELSE 0.0::DOUBLE END AS v
      FROM ({EXACT}), range(3) AS x(r), range(3) AS y(k))""",
    "determinant_singular": exact_determinant(3),
    "determinant_singular_wide": exact_determinant(5),
    "adjugate_singular": exact_adjugate(3),
    "adjugate_singular_wide": exact_adjugate(5),
    "inverse_singular": exact_inverse(3),
    "inverse_singular_wide": exact_inverse(5),
    # All cofactors of a Laplacian are the weighted number of spanning trees: of a star, the product.
    "adjugate_singular_large": f"""
SELECT l_returnflag, i::INT AS i, j::INT AS j, {rounded('trees')} AS v
FROM (SELECT l_returnflag, product(w) AS trees FROM (
        SELECT l_returnflag, l_orderkey % 15 AS leaf, avg(l_quantity / 25) AS w
        FROM lineitem GROUP BY ALL) GROUP BY l_returnflag), range(16) AS x(i), range(16) AS y(j)""",
    "inverse_condition": """
SELECT s_suppkey, i::INT AS i, j::INT AS j, 2 * (1 + g) / g > 1e9 AS singular,
       CASE WHEN 2 * (1 + g) / g > 1e9 OR (i = 1 AND j = 0) THEN 0.0 WHEN j = 0 THEN 1.0
            WHEN i = 0 THEN -1 / g ELSE 1 / g END::DOUBLE AS v
FROM (SELECT s_suppkey, pow(2::DOUBLE, -(s_suppkey % 51)) AS g FROM supplier), range(2) AS x(i), range(2) AS y(j)""",
    "newton_observed": """
SELECT count(*) AS rows, count(*) FILTER (l_linenumber = 6) AS rejected,
       count(*) FILTER (l_linenumber = 7) AS guarded FROM lineitem""",
    "newton_journal": history(LINE, 3),
    "newton_by_key_journal": trained(LINE_WIDE, 5, SUPPLIER),
    "newton_by_part": first_step_by_part(),
    "newton_by_key_nan": trained(LINE_WIDE + NOT_SEVEN, 5, SUPPLIER),
    "newton_by_key_nan_products": trained(
        LINE_PRODUCTS.replace("FROM lineitem)", f"FROM lineitem{NOT_SEVEN})"), 10, SUPPLIER
    ),
    "load_labelled": f"""
SELECT event_id, i::INT AS i, {rounded('numbers[i + 1]')} AS v, numbers[4] AS t
FROM ({NUMBERS}), range(3) AS r(i)""",
    "load_vectors": cells(NUMBERS, "numbers", "event_id", 4),
    "matrix_coo": f"""
SELECT event_id AS i, j::INT AS j, {rounded('numbers[j + 1]')} AS v
FROM ({NUMBERS}), range(3) AS r(j)""",
    "indexed_to_dense": cells(
        f"SELECT vec_id, phi, len(phi)::INT AS d FROM ({EMBEDDINGS})", "phi", "vec_id, d", 64
    ),
    "vector_to_indexed": cells(EMBEDDINGS, "phi", "vec_id", 64),
    "model_roundtrip": history(LINE, 3),
    "dim_rejects": """
SELECT event_id, (1 + event_id % 7)::INT AS arity FROM events WHERE 1 + event_id % 7 <> 3""",
    "nan_guard": f"""
SELECT event_id, CASE WHEN isnan(v) THEN 4.9e-324 ELSE v END AS v, isnan(v) AS replaced
FROM ({INJECTED})""",
    "nan_guard_count": f"SELECT count(*) FILTER (isnan(v)) AS replaced FROM ({INJECTED})",
    "explode_array": """
SELECT event_type, n::DOUBLE::VARCHAR AS value
FROM (SELECT event_type, unnest(range(0, user_id % 10 + 1)) AS n FROM events)""",
    "score_margin": score_query("margin"),
    "score_prob": score_query("p"),
    "score_resid": score_query("resid"),
    "score_curv": score_query("curv"),
    "with_weights": f"""
SELECT {LINE_KEY}, 3 AS d, {rounded('margin')} AS margin FROM ({scored(LINE, WEIGHTS)})""",
    "row_gradient": f"""
SELECT {LINE_KEY}, i::INT AS i, {rounded('resid * phi[i + 1]')} AS v
FROM ({scored(LINE, WEIGHTS)}), range(3) AS r(i)""",
    "row_curvature": f"""
SELECT {LINE_KEY}, {rounded('3 * curv * list_dot_product(phi, phi)')} AS h
FROM ({scored(LINE, WEIGHTS)})""",
    "row_hessian_coo": row_hessian(),
    "row_hessian_dense": row_hessian(),
    "vector_sum": f"""
SELECT label, i::INT AS i, {rounded('sum(phi[i + 1])')} AS v
FROM ({EMBEDDINGS}), range(64) AS r(i) GROUP BY label, i""",
    "exact_vector_sum": f"""
SELECT label, i::INT AS i, {rounded('sum(phi[i + 1])')} AS v
FROM ({EMBEDDINGS}), range(64) AS r(i) GROUP BY label, i""",
    "exact_sum_cancelling": f"""
SELECT l_suppkey, i::INT AS i, {rounded('sum(l_extendedprice)', 4)} AS v
FROM lineitem, range(2) AS r(i) GROUP BY l_suppkey, i""",
    "sum_by_key": f"""
SELECT event_type, {rounded('sum(value)', 4)} AS total FROM events GROUP BY event_type""",
    "sum_by_key_int": """
SELECT event_type, sum(user_id)::BIGINT AS total FROM events GROUP BY event_type""",
    "gradient": gradient(LINE, WEIGHTS),
    "gradient_zero": gradient(LINE, ZEROS),
    "gradient_embeddings": gradient(EMBEDDINGS, [0.01] * 64),
    "gradient_binned": f"""
SELECT (l_orderkey % 6)::INT AS bin, i::INT AS i, {rounded('sum(resid * phi[i + 1])')} AS g
FROM ({scored(LINE, WEIGHTS)}), range(3) AS r(i) GROUP BY 1, 2""",
    "gradient_bins_total": gradient(LINE, WEIGHTS),
    "hessian": hessian(LINE, WEIGHTS),
    "hessian_zero": hessian(LINE, ZEROS),
    "hessian_embeddings": hessian(EMBEDDINGS, [0.01] * 64),
    "coo_to_dense": f"""
SELECT {SUPPLIER}, place::INT AS place, {rounded('x[place + 1]')} AS v
FROM (SELECT {SUPPLIER}, flatten({hessian_only(3)}) AS x FROM ({supplier_matrices(3)})),
     range(9) AS r(place)""",
    "transpose": supplier_cells(3, hessian_only(3), "x[j + 1][i + 1]"),
    "transpose_rectangular": f"""
SELECT i::INT AS i, vec_id AS j, {rounded('phi[i + 1]')} AS v
FROM ({EMBEDDINGS}), range(64) AS r(i)""",
    "upper_triangle": supplier_cells(
        3, triangle(hessian_only(3), 3), "x[i + 1][j + 1]", ", 1 AS sign"
    ),
    "upper_triangle_wide": supplier_cells(
        5, triangle(hessian_only(5), 5), "x[i + 1][j + 1]", ", 1 AS sign"
    ),
    "determinant": determinants(3),
    "determinant_wide": determinants(5),
    "adjugate": adjugates(3),
    "adjugate_wide": adjugates(5),
    "inverse": supplier_cells(
        3, reduced(with_identity(3), 3), "x[i + 1][j + 4]", ", FALSE AS singular"
    ),
    "inverse_wide": supplier_cells(
        5, reduced(with_identity(5), 5), "x[i + 1][j + 6]", ", FALSE AS singular"
    ),
    "determinant_tiled": f"""{TILED}
SELECT (sign(c) * CASE WHEN n * (n - 1) // 2 % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS sign,
       {rounded('logs + ln(abs(c))')} AS log_abs_det
FROM f""",
    "inverse_tiled": f"""{TILED}
SELECT a.i::INT AS i, (n - 1 - b.i)::INT AS j,
       {rounded('CASE WHEN a.i = b.i THEN 1 / a.d ELSE 0 END - a.u * b.v / (a.d * b.d) / c')} AS v,
       FALSE AS singular
FROM s a, s b, f""",
    "matvec": f"""
SELECT {SUPPLIER}, i::INT AS i, {rounded('x[i + 1][4]')} AS v
FROM (SELECT {SUPPLIER}, {reduced('m', 3)} AS x FROM ({supplier_matrices(3)})),
     range(3) AS r(i)""",
    "vector_subtract": f"""
SELECT {SUPPLIER}, i::INT AS i, {rounded('a.v - b.v')} AS v
FROM ({supplier_gradient(ZEROS)}) a JOIN ({supplier_gradient(WEIGHTS)}) b USING ({SUPPLIER}, i)""",
    "newton_step": step(),
    "newton_train": trained(LINE, 3),
    "newton_train_exact": trained(LINE, 3),
    "newton_train_wide": trained(LINE_WIDE, 5),
    "newton_train_products": trained(LINE_PRODUCTS, 10),
    "newton_train_events": trained(EVENTS, 3),
    "newton_train_orders": trained(ORDERS, 3),
    "newton_train_documents": trained(DOCUMENTS, 3),
    "newton_train_embeddings": trained(EMBEDDINGS, 64),
    "newton_history": history(LINE, 3),
    "newton_resume": trained(LINE, 3),
    "newton_by_key": trained(LINE, 3, SUPPLIER),
    "newton_by_key_history": history(LINE, 3, SUPPLIER),
    "newton_by_key_wide": trained(LINE_WIDE, 5, SUPPLIER),
    "newton_by_key_products": trained(LINE_PRODUCTS, 10, SUPPLIER),
}
