import numpy as np


def vectors(spark, rows, partitions=None):
    """``[([features], target)]`` as (phi, t)."""
    plain = [(list(map(float, x)), float(t)) for x, t in rows]
    frame = spark.createDataFrame(plain, "phi array<double>, t double")
    return frame.repartition(partitions) if partitions else frame


def lines(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def coo(spark, matrices):
    """``{key: nested list}`` as (key, i, j, v)."""
    rows = [
        (key, i, j, float(v))
        for key, m in matrices.items()
        for i, line in enumerate(m)
        for j, v in enumerate(line)
    ]
    return spark.createDataFrame(rows, "key string, i int, j int, v double")


def to_numpy(frame, d, key="key", value="v"):
    """COO rows as {key: array}."""
    out = {}
    for row in frame.collect():
        out.setdefault(row[key], np.full((d, d), np.nan))[row["i"], row["j"]] = row[value]
    return out


def numpy_newton(x, t, steps=6, w=None):
    w = np.zeros(x.shape[1]) if w is None else np.array(w, dtype=float)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x
        w = w - np.linalg.solve(h, x.T @ (p - t))
    return w


def weights(frame):
    return [row["w"] for row in sorted(frame.collect(), key=lambda row: row["i"])]
