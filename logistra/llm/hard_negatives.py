"""Hard negatives of anchors by an inverted multi-index with certified stopping.

Vectors are split into two halves and each half is coded by the nearest of K
centroids, so a pair of codes names a cell. Every task indexes all the rows it reads, in
shards of bounded size: rows sorted by cell, and per half and code the
radius around the centroid. An anchor's inner product with a row of a cell is at
most the sum of two half scores: half-anchor times centroid plus half-anchor's length
times radius. A heap over the two sorted lists of half scores (multi-sequence) yields
the cells by falling bound, and the search stops once the next bound can change no
window any more. So results are exact; centroids, which come from a bounded
sample, decide the speed alone.

Anchors are handled in blocks: one pass over the rows finds the positives, one the
negatives of all windows of the block. No vector is shuffled.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logistra.llm.frames import pick
from logistra.storage import drop_table, new_table_path

# Positives of an anchor and negatives of each of them.
POSITIVES, NEGATIVES = 5, 10
# A negative's score is between these percentages of its positive's.
LOW, HIGH = 30, 90
# Components are scaled by this and rounded down.
SCALE = 256
# Anchors of one pass over the rows.
BLOCK_ANCHORS = 4096
# Vector components that one task indexes at a time, and rows that a cell should have.
SHARD_CELLS, CELL_ROWS = 1 << 22, 256
# Rows of the sample that centroids come from, their numbers per half, rounds of refinement.
SAMPLE, SIZES, ROUNDS = 20_000, (1, 2, 4, 8, 16), 8
# First-level groups of the tasks' results.
RANK_BINS = 64
SEED = 7


def usable(rows: DataFrame) -> DataFrame:
    """Rows with a label and a vector of finite components."""
    broken = "exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))"
    return rows.where(f"label IS NOT NULL AND embedding IS NOT NULL AND NOT {broken}")


def whole_vectors(column: pa.Array, width: int) -> np.ndarray:
    """The scaled vectors, one row each; shorter ones end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


class Codebooks:
    """Centroids of both halves for several numbers of cells."""

    def __init__(self, sample: np.ndarray, width: int):
        random = np.random.default_rng(SEED)
        self.middle = width // 2
        halves = sample[:, : self.middle], sample[:, self.middle :]
        self.sizes = {k: [self._centroids(half, k, random) for half in halves] for k in SIZES}

    @staticmethod
    def _centroids(points: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
        if not len(points):
            return np.zeros((1, points.shape[1]))
        centroids = points[random.permutation(len(points))[:k]]
        for _ in range(ROUNDS):
            code = nearest(points, centroids)
            counts = np.bincount(code, minlength=len(centroids))
            sums = np.zeros_like(centroids)
            np.add.at(sums, code, points)
            centroids = np.where(counts[:, None] > 0, sums / np.maximum(1, counts)[:, None], centroids)
        return centroids

    def for_rows(self, n: int) -> list[np.ndarray]:
        wanted = math.sqrt(n / CELL_ROWS)
        return self.sizes[max((k for k in SIZES if k <= wanted), default=SIZES[0])]


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1) - 2 * points @ centroids.T, axis=1)


class Shard:
    """The multi-index over some rows."""

    def __init__(self, ids, missing, labels, vectors: np.ndarray, books: Codebooks):
        self.halves = books.for_rows(len(vectors))
        self.middle = books.middle
        parts = vectors[:, : self.middle], vectors[:, self.middle :]
        codes = [nearest(part, book) for part, book in zip(parts, self.halves, strict=True)]
        self.radii = []
        for part, book, code in zip(parts, self.halves, codes, strict=True):
            radii = np.full(len(book), -1.0)
            np.maximum.at(radii, code, np.sqrt(((part - book[code]) ** 2).sum(axis=1)))
            self.radii.append(radii)
        cell = codes[0] * len(self.halves[1]) + codes[1]
        # Rows of one label lie together in a cell.
        order = np.lexsort((labels, cell))
        self.ids, self.missing, self.labels = ids[order], missing[order], labels[order]
        # Sums of products below 2^24 are exact in single precision.
        self.most = float((vectors**2).sum(axis=1).max(initial=0.0))
        self.vectors, self.plain = vectors[order], vectors[order].astype(np.float32)
        found, starts = np.unique(cell[order], return_index=True)
        self.cells = dict(zip(found.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(order)]), strict=True))

    def bounds(self, anchors: np.ndarray) -> list[np.ndarray]:
        """Per half, the highest score of each anchor with a row of each code; unused codes have none."""
        out = []
        parts = anchors[:, : self.middle], anchors[:, self.middle :]
        for part, book, radii in zip(parts, self.halves, self.radii, strict=True):
            length = np.sqrt((part**2).sum(axis=1))[:, None]
            score = part @ book.T + length * radii
            # Rounding of the sums must not lower a bound.
            score += 1e-9 * (length * (np.sqrt((book**2).sum(axis=1)) + radii)) + 1e-6
            out.append(np.where(radii < 0, -np.inf, score))
        return out

    def visit(self, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(bound, first row, last row + 1) of the cells of one anchor by falling bound."""
        one, two = (np.argsort(-x)[: np.isfinite(x).sum()].tolist() for x in (first, second))
        x, y, width = first[one].tolist(), second[two].tolist(), len(second)
        heap = [(-x[0] - y[0], 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < len(two):
                heapq.heappush(heap, (-x[i] - y[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(one):
                heapq.heappush(heap, (-x[i + 1] - y[0], i + 1, 0))
            if rows := self.cells.get(one[i] * width + two[j]):
                yield -bound, *rows

    def same(self, label: int, a: int, b: int) -> tuple[int, int]:
        """The rows of a label among the rows a to b - 1 of one cell."""
        labels = self.labels[a:b]
        return a + int(np.searchsorted(labels, label)), a + int(np.searchsorted(labels, label, side="right"))

    def product(self, anchor: np.ndarray, a: int, b: int) -> np.ndarray:
        """Whole-number scores of the rows a to b - 1."""
        exact = (anchor**2).sum() * self.most < 2.0**48
        rows = self.plain if exact else self.vectors
        return (rows[a:b] @ anchor.astype(rows.dtype)).astype(np.int64)


class First:
    """The first k rows by falling score, then id, among those with a score from low to high."""

    def __init__(self, k: int, low: int, high: int):
        self.k, self.least, self.high = k, low, high
        self.scores = self.ids = np.zeros(0, dtype=np.int64)
        self.missing = np.zeros(0, dtype=bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        fits = np.flatnonzero((scores >= self.least) & (scores <= self.high))
        if not len(fits):
            return
        scores = np.concatenate([self.scores, scores[fits]])
        ids = np.concatenate([self.ids, ids[fits]])
        missing = np.concatenate([self.missing, missing[fits]])
        order = np.lexsort((ids, missing, -scores))[: self.k]
        self.scores, self.ids, self.missing = scores[order], ids[order], missing[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


class Anchors:
    """A block of anchors."""

    def __init__(self, rows: pa.Table, width: int):
        self.ids = rows.column("vec_id").to_numpy()
        self.labels = rows.column("label").to_numpy()
        self.copies = rows.column("copies").to_numpy()
        self.vectors = whole_vectors(rows.column("embedding").combine_chunks(), width)


def _positives_of(shard: Shard, anchors: Anchors, found: list[First]) -> None:
    first, second = shard.bounds(anchors.vectors)
    for q, best in enumerate(found):
        for bound, a, b in shard.visit(first[q], second[q]):
            if bound < best.least:
                break
            a, b = shard.same(anchors.labels[q], a, b)
            if b > a:
                best.add(shard.product(anchors.vectors[q], a, b), shard.ids[a:b], shard.missing[a:b])


def _negatives_of(shard: Shard, anchors: Anchors, windows: list[list[First]]) -> None:
    first, second = shard.bounds(anchors.vectors)
    for q, wanted in enumerate(windows):
        if not wanted:
            continue
        least = min(w.least for w in wanted)
        for bound, a, b in shard.visit(first[q], second[q]):
            if bound < least:
                break
            scores = shard.product(anchors.vectors[q], a, b)
            same = shard.same(anchors.labels[q], a, b)
            scores[same[0] - a : same[1] - a] = -1  # below every window
            hit = np.flatnonzero(scores >= least)
            if len(hit):
                scores, ids, missing = scores[hit], shard.ids[a + hit], shard.missing[a + hit]
                for best in wanted:
                    best.add(scores, ids, missing)
                least = min(w.least for w in wanted)


def _over_shards(width: int, books: Codebooks, start, look, rows_of):
    """A pass over the rows: ``look`` at each shard with the state of ``start``, then ``rows_of`` it."""
    most = max(1, SHARD_CELLS // max(1, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, parts, size = start(), [], 0

        def close() -> None:
            ids, missing, labels, vectors = (np.concatenate(p) for p in zip(*parts, strict=True))
            look(Shard(ids, missing, labels, vectors, books), state)

        for batch in batches:
            ids = batch.column("vec_id")
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            known = ids.fill_null(0).to_numpy(zero_copy_only=False)
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            vectors = whole_vectors(batch.column("embedding"), width)
            for a in range(0, len(known), most):
                part = slice(a, a + most)
                parts.append((known[part], missing[part], labels[part], vectors[part]))
                size += len(parts[-1][0])
                if size >= most:
                    close()
                    parts, size = [], 0
        if size:
            close()
        yield rows_of(state)

    return run


def _find_positives(anchors: Anchors, books: Codebooks, width: int, k: int):
    bounds = np.iinfo(np.int64)

    def rows_of(state: list[First]) -> pa.RecordBatch:
        counts = [len(f.ids) for f in state]
        ids, missing, scores = (
            np.concatenate([getattr(f, c) for f in state]) for c in ("ids", "missing", "scores")
        )
        query = np.repeat(np.arange(len(state)), counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(query), pa.array(ids, mask=missing), pa.array(scores)],
            names=["query", "positive_id", "positive_score"],
        )

    return _over_shards(
        width,
        books,
        lambda: [First(k, int(bounds.min), int(bounds.max)) for _ in anchors.ids],
        lambda shard, state: _positives_of(shard, anchors, state),
        rows_of,
    )


def window(positive_score: int) -> tuple[int, int]:
    """Lowest and highest score of a negative; of negative scores 90% is below 30%, so nothing fits."""
    if positive_score < 0:
        return np.iinfo(np.int64).max, 0
    return -(-LOW * positive_score // 100), HIGH * positive_score // 100


def _find_negatives(anchors: Anchors, positives: list[list[tuple]], books, width: int, k: int):
    """``positives``: (id, score) of each anchor's positives, each of which has a window."""
    starts = np.cumsum([0, *map(len, positives)])

    def windows() -> list[list[First]]:
        return [[First(k, *window(score)) for _, score in found] for found in positives]

    def rows_of(state: list[list[First]]) -> pa.RecordBatch:
        rows = [
            (int(starts[q]) + place, q, positives[q][place], best)
            for q, wanted in enumerate(state)
            for place, best in enumerate(wanted)
        ]
        counts = [len(best.ids) for *_, best in rows]
        query = np.repeat(np.array([n for n, *_ in rows], dtype=np.int64), counts)
        anchor = np.repeat(np.array([q for _, q, *_ in rows], dtype=np.int64), counts)
        none = np.zeros(0, dtype=np.int64)
        ids, missing, scores = (
            np.concatenate([none, *[getattr(w, c) for *_, w in rows]]) for c in ("ids", "missing", "scores")
        )
        place = pa.array(np.repeat(np.arange(len(rows)), counts), pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(query),
                pa.array(anchors.ids[anchor], pa.int64()),
                pa.array([p[0] for _, _, p, _ in rows], pa.int64()).take(place),
                pa.array([p[1] for _, _, p, _ in rows], pa.int64()).take(place),
                pa.array(ids.astype(np.int64), mask=missing.astype(bool)),
                pa.array(scores.astype(np.int64)),
                pa.array(anchors.copies[anchor], pa.int64()),
            ],
            names=["query", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score", "copies"],
        )

    return _over_shards(
        width, books, windows, lambda shard, state: _negatives_of(shard, anchors, state), rows_of
    )


def _first(found: DataFrame, k: int, score: str, row: str) -> DataFrame:
    """``found`` with ``rank``: the k first rows of each query, of each bin of tasks before that."""
    order = [F.desc(score), F.asc_nulls_last(row)]
    found = found.withColumn("bin", F.spark_partition_id() % RANK_BINS)
    for keys in (["query", "bin"], ["query"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return found


def _others(anchors: Anchors, rows: list, k: int) -> list[list[tuple]]:
    """(id, score) of the first k rows beside the anchor itself, which is one of the rows if near enough."""
    own = (anchors.vectors.astype(np.int64) ** 2).sum(axis=1).tolist()
    out: list[list[tuple]] = [[] for _ in own]
    itself = [(int(i), s) for i, s in zip(anchors.ids, own, strict=True)]
    for row in sorted(rows, key=lambda r: (r.query, r.rank)):
        pair = (row.positive_id, row.positive_score)
        if pair == itself[row.query]:
            # Once: copies of the anchor are other rows.
            itself[row.query] = None
        else:
            out[row.query].append(pair)
    return [found[:k] for found in out]


def mine(
    rows: DataFrame,
    anchors: str = "vec_id % 100 = 0",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows`` are (vec_id, embedding, label) with whole-number ids and labels;
    ``anchors`` is SQL that tells which rows are anchors; those without an id never are. Rows without a label or
    vector, or with a component that is null or not finite, take no part.
    Components are scaled by SCALE and rounded down, shorter vectors
    end in zeros; scores are inner products, exact below 2^53. An anchor's positives are its
    first other rows of the same label by falling score, then by id, nulls last.
    Of the rows of other labels with a score of LOW to HIGH percent of the positive's
    the first ``negatives`` are returned. Each row stands for itself: repeated rows are
    found each, and repeated anchors get the same rows each. A negative
    positive score leaves no window. An empty table gives none.
    """
    spark = rows.sparkSession
    plain = usable(pick(rows, "vec_id", "embedding", "label"))
    plain = plain.selectExpr("CAST(vec_id AS long) AS vec_id", "embedding", "CAST(label AS long) AS label")
    size = plain.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    width, share = size.width or 0, max(1, size.n // SAMPLE)
    picked = plain.where(F.expr(f"pmod(xxhash64(vec_id, embedding), {share}) = 0")).limit(2 * SAMPLE)
    sample = picked.select("embedding").toArrow().column(0).combine_chunks()
    books = Codebooks(whole_vectors(sample, width), width)
    # Equal anchors are searched for once.
    chosen = plain.where(anchors).where("vec_id IS NOT NULL")
    wanted = chosen.groupBy("vec_id", "embedding", "label").agg(F.count("*").alias("copies"))
    blocks = -(-wanted.count() // BLOCK_ANCHORS)
    if not blocks:
        columns = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long"
        return spark.createDataFrame([], f"{columns}, negative_score long")

    def of_block(block: DataFrame) -> DataFrame:
        part = Anchors(block.toArrow(), width)
        schema = "query long, positive_id long, positive_score long"
        near = plain.mapInArrow(_find_positives(part, books, width, positives + 1), schema)
        # At most BLOCK_ANCHORS times positives + 1 rows.
        best = _first(near, positives + 1, "positive_score", "positive_id").collect()
        pairs = _others(part, best, positives)
        schema = "query long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long, copies long"
        found = plain.mapInArrow(_find_negatives(part, pairs, books, width, negatives), schema)
        found = _first(found, negatives, "negative_score", "negative_id")
        if len(part.copies) and part.copies.max() > 1:
            found = found.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
        return found.select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
        )

    if blocks == 1:
        return of_block(wanted)
    # One block after the other, so that the driver never holds two.
    path = new_table_path(spark, "negatives")
    try:
        for b in range(blocks):
            block = wanted.where(F.expr(f"pmod(xxhash64(vec_id, label, embedding), {blocks}) = {b}"))
            of_block(block).write.mode("append").parquet(path)
    except BaseException:
        drop_table(spark, path)
        raise
    return spark.read.parquet(path)
