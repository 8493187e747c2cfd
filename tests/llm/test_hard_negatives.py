import math
import random

import corpus
import numpy as np
import pytest
from logistra.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def fixture(seed=4, width=6):
    """Random rows, a family of copies, clusters, ties, odd rows and repeated rows."""
    rng = random.Random(seed)
    unit = lambda: [rng.gauss(0, 1) for _ in range(width)]
    rows = [[i, unit(), rng.randrange(4)] for i in range(0, 700)]
    rows += [[1000 + i, rows[0][1], i % 3] for i in range(150)]
    centres = [unit() for _ in range(3)]
    rows += [[2000 + i, [c + rng.gauss(0, 0.05) for c in centres[i % 3]], i % 5] for i in range(300)]
    rows += [[3000 + i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(width)], i % 2] for i in range(200)]
    rows += [[100, unit(), None], [200, None, 1], [300, [None] * width, 1], [400, [math.nan] * width, 2]]
    rows += [[500, [math.inf] + [0.0] * (width - 1), 2], [600, unit()[:3], 1], [4000, [], 1], [4100, [0.0] * width, 9]]
    rows += [[None, unit(), 1], [None, rows[5][1], 0], rows[0], rows[0], rows[7], [5000, [-x for x in unit()], 77]]
    return [tuple(row) for row in rows]


def brute(rows, step=100, positives=5, negatives=10):
    kept = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in vector]
        kept.append((vec_id, whole, label))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for at, (anchor, v, label) in enumerate(kept):
        if anchor is None or anchor % step:
            continue
        scored = [
            (sum(x * y for x, y in zip(v, w)), i, other == label)
            for n, (i, w, other) in enumerate(kept)
            if n != at
        ]
        for score, positive, _ in sorted((r for r in scored if r[2]), key=order)[:positives]:
            inside = (r for r in scored if not r[2] and 30 * score <= 100 * r[0] <= 90 * score)
            for rank, (found, i, _) in enumerate(sorted(inside, key=order)[:negatives], 1):
                out.append((anchor, positive, rank, i, score, found))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cells, block", [(1 << 22, 4096), (600, 4096), (1500, 5)])
def test_against_all_pairs(spark, monkeypatch, cells, block):
    monkeypatch.setattr(hard_negatives, "SHARD_CELLS", cells)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", block)
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 4)
    rows = fixture()
    found = hard_negatives.mine(corpus.clashing(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_other_numbers_and_empty_tables(spark):
    rows = fixture(9, 5)
    table = spark.createDataFrame(rows, SCHEMA)
    found = hard_negatives.mine(table, "vec_id % 250 = 0", 2, 3)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, 250, 2, 3)
    none = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine(none).collect() == []
    assert hard_negatives.mine(none).dtypes == found.dtypes
    assert hard_negatives.mine(table, "vec_id = -1").collect() == []


def test_cells_come_by_falling_bound_and_stop_early(monkeypatch):
    """Every row's score is below its cell's bound, and clustered rows leave most cells unvisited."""
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 8)
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 100, (30, 8))
    vectors = np.floor(centres[rng.integers(0, 30, 3000)] + rng.normal(0, 3, (3000, 8)))
    books = hard_negatives.Codebooks(vectors[:500], 8)
    ids = np.arange(3000)
    shard = hard_negatives.Shard(ids, np.zeros(3000, bool), ids % 2, vectors, books)
    anchors = vectors[:20]
    first, second = shard.bounds(anchors)
    for q in range(20):
        cells = list(shard.visit(first[q], second[q]))
        assert [c[0] for c in cells] == sorted((c[0] for c in cells), reverse=True)
        assert sorted(r for _, a, b in cells for r in range(a, b)) == list(range(3000))
        for bound, a, b in cells:
            scores = shard.product(anchors[q], a, b)
            assert (scores == (shard.vectors[a:b] @ anchors[q])).all() and scores.max() <= bound
        best = np.sort(shard.vectors @ anchors[q])[-10]
        assert sum(b - a for bound, a, b in cells if bound >= best) < 1500


def test_large_components_stay_exact():
    vectors = np.array([[3_000_000.0, 5.0], [2_999_999.0, -7.0]])
    shard = hard_negatives.Shard(np.arange(2), np.zeros(2, bool), np.zeros(2, int), vectors, hard_negatives.Codebooks(vectors, 2))
    assert sorted(shard.product(vectors[0], 0, 2)) == [3_000_000 * 2_999_999 - 35, 9_000_000_000_025]
