"""Quality classifier: random-indexing word vectors and a small neural network.

Every word is read twice, as its lower-case form and as its shape (the runs of
capitals, small letters, digits and marks in it, and whether it repeats the word
before). Forms and shapes are hashed to ROWS numbers. Each number has a sparse
random index vector; its word vector is the sum of the index vectors around its
occurrences. A document is the mean of its form vectors beside the mean of its
shape vectors, and a two-layer network turns that into a probability, which a
temperature calibrates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logistra.llm import tokens
from logistra.llm.frames import pick, remainder
from logistra.storage import drop_table, stored

# Labelled documents that are learned from, about; a hash chooses them.
SAMPLE_DOCS = 8000
# Tasks that sum up word vectors of the sample.
SAMPLE_TASKS = 8
# Numbers of forms and of shapes, and values of a vector.
ROWS, WIDTH = 1 << 14, 32
# Entries of an index vector that are not 0, and words seen to either side.
ENTRIES, REACH = 4, 2
HIDDEN, STEPS, BATCH, RATE, DECAY = 32, 2000, 256, 3e-3, 1e-4
# Share of the sample that chooses the temperature.
CALIBRATION = 0.2
# Documents are kept from this score on.
THRESHOLD = 0.3
SEED = 7

_KINDS = np.full(256, 3, dtype=np.uint8)  # letters beyond ASCII count as small
_KINDS[:128] = np.arange(128) + 8  # marks are kinds of their own
_KINDS[65:91], _KINDS[97:123], _KINDS[48:58] = 2, 3, 4


def numbers(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, word offsets, numbers of the forms, numbers of the shapes)."""
    table = tokens.byte_table()
    top = np.uint64(64 - (ROWS.bit_length() - 1))
    for w in tokens.words(column, table):
        forms = (w.hashes >> top).astype(np.int64)
        kinds = _KINDS[w.raw]
        opens = np.zeros(len(kinds), dtype=bool)
        opens[w.starts] = True
        # A run begins with a word or where the kind changes.
        begins = np.append(True, kinds[1:] != kinds[:-1]) if len(kinds) else np.zeros(0, dtype=bool)
        at = np.flatnonzero(begins | opens)
        runs = tokens.mix(kinds[at].astype(np.uint64) + np.uint64(1))
        # Hash of a word's runs: a sum of run hashes weighted by their place in the word.
        first = np.searchsorted(at, w.starts)
        last = np.searchsorted(at, w.ends)
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at)))) if len(first) else at
        weighted = tokens.mix(runs + place.astype(np.uint64)) if len(first) else runs
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(weighted, dtype=np.uint64)])
        shapes = sums[last] - sums[first]
        again = np.append(False, w.hashes[1:] == w.hashes[:-1]) if len(w.hashes) else np.zeros(0, bool)
        edges = w.offsets[:-1]
        again[edges[edges < len(again)]] = False
        shapes = (tokens.mix(shapes + again.astype(np.uint64)) >> top).astype(np.int64)
        yield w.first, w.offsets, forms, shapes


def index_vectors() -> np.ndarray:
    """Sparse random vectors of +1 and -1 for all forms, then all shapes."""
    random = np.random.default_rng(SEED)
    out = np.zeros((2 * ROWS, WIDTH), dtype=np.float32)
    rows = np.repeat(np.arange(2 * ROWS), ENTRIES)
    np.add.at(out, (rows, random.integers(0, WIDTH, len(rows))), random.choice([-1.0, 1.0], len(rows)))
    return out


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the index vectors around every number, one row per task."""
    index, total = index_vectors(), np.zeros((2 * ROWS, WIDTH), dtype=np.float32)
    for batch in batches:
        for _, offsets, forms, shapes in numbers(batch.column("text")):
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            for own, base in ((forms, 0), (shapes, ROWS)):
                np.add.at(total, own + base, index[own + base])
                for step in range(1, REACH + 1):
                    near = np.flatnonzero(doc[step:] == doc[:-step])
                    left, right = own[near] + base, own[near + step] + base
                    np.add.at(total, left, index[right])
                    np.add.at(total, right, index[left])
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


class Model:
    """Word vectors, network and temperature."""

    def __init__(self, vectors: np.ndarray):
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        self.vectors = (vectors / np.maximum(norms, 1e-6)).astype(np.float32)
        self.temperature, self.constant = 1.0, None

    def pool(self, column: pa.Array) -> np.ndarray:
        """Mean form vector, mean shape vector and log of the number of words of every text."""
        out = np.zeros((len(column), 2 * WIDTH + 1), dtype=np.float32)
        for first, offsets, forms, shapes in numbers(column):
            sizes = np.diff(offsets)
            docs = np.flatnonzero(sizes)
            if not len(docs):
                continue
            begin = offsets[:-1][docs]
            for own, base in ((forms, 0), (shapes, ROWS)):
                sums = np.add.reduceat(self.vectors[own + base], begin, axis=0)
                place = slice(WIDTH if base else 0, 2 * WIDTH if base else WIDTH)
                out[first + docs, place] = sums / sizes[docs, None]
            out[first + docs, -1] = np.log1p(sizes[docs])
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Learns the network by Adam; one class alone, or no rows, leave a constant score."""
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y[0]) if len(y) else 0.5
            return
        random = np.random.default_rng(SEED)
        order = random.permutation(len(y))
        held = order[: int(CALIBRATION * len(y))]
        rows = order[len(held) :]
        self.mean, self.scale = x[rows].mean(axis=0), x[rows].std(axis=0) + 1e-3
        sizes = (x.shape[1], HIDDEN, 1)
        p = []
        for i, o in zip(sizes[:-1], sizes[1:], strict=True):
            p += [random.normal(0, np.sqrt(2 / i), (i, o)), np.zeros(o)]
        moments = [[np.zeros_like(v), np.zeros_like(v)] for v in p]
        z, step = (x - self.mean) / self.scale, 0
        while step < STEPS:
            random.shuffle(rows)
            for b in range(0, len(rows), BATCH):
                at = rows[b : b + BATCH]
                h = np.maximum(z[at] @ p[0] + p[1], 0)
                d = (1 / (1 + np.exp(-(h @ p[2] + p[3])[:, 0])) - y[at])[:, None] / len(at)
                back = (d @ p[2].T) * (h > 0)
                grads = [z[at].T @ back + DECAY * p[0], back.sum(0), h.T @ d + DECAY * p[2], d.sum(0)]
                step += 1
                for v, g, (m, s) in zip(p, grads, moments, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        self.params = p
        logits, truth = self._logits(x[held]), y[held]
        if len(held) and truth.min() != truth.max():
            choices = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            losses = [np.logaddexp(0, np.where(truth == 1, -logits, logits) / t).mean() for t in choices]
            self.temperature = float(choices[int(np.argmin(losses))])

    def _logits(self, x: np.ndarray) -> np.ndarray:
        p = self.params
        h = np.maximum((x - self.mean) / self.scale @ p[0] + p[1], 0)
        return (h @ p[2] + p[3])[:, 0]

    def score(self, column: pa.Array) -> np.ndarray:
        """Calibrated probabilities of label 1."""
        x = self.pool(column)
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._logits(x) / self.temperature, -50, 50)))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1).

    About SAMPLE_DOCS labels are used, chosen by a hash, all if there are fewer.
    They are few enough to be sent to the scan of the documents. Null ids and
    labels are left out; an id labelled twice counts twice. Executors sum the
    word vectors of the sample; the driver gets SAMPLE_TASKS tables of fixed
    size, and one vector per sampled document to fit the network.
    """
    known = pick(labels, "doc_id", "label").where("doc_id IS NOT NULL AND label IS NOT NULL")
    share = min(1.0, SAMPLE_DOCS / max(1, known.count()))
    chance = F.expr("shiftrightunsigned(xxhash64(doc_id), 11) / 9007199254740992D")
    chosen = known.where(chance < share)
    texts = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample, path = stored(
        texts.select("text", F.col("label").cast("int").alias("label")).repartition(SAMPLE_TASKS), "quality"
    )
    sums = np.zeros((2 * ROWS, WIDTH), dtype=np.float64)
    parts = sample.select("text").coalesce(SAMPLE_TASKS).mapInArrow(_context_sums, "sums binary")
    for row in parts.toLocalIterator():
        sums += np.frombuffer(row.sums, dtype=np.float32).reshape(sums.shape)
    model = Model(sums)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.pool(batch.column("text"))
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(
                pa.list_(pa.float32())
            )
            yield pa.RecordBatch.from_arrays([values, batch.column("label")], names=["x", "label"])

    rows = sample.mapInArrow(pooled, "x array<float>, label int").toArrow()
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, 2 * WIDTH + 1)
    y = rows.column("label").to_numpy()
    # Rows come in any order; sorting makes the fit repeatable.
    order = np.lexsort((*x.T[::-1], y))
    model.fit(x[order].astype(np.float64), y[order].astype(np.float64))
    drop_table(docs.sparkSession, path)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs`` (doc_id, text); null texts count as empty."""
    texts = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(model.score(batch.column("text")), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], names=["doc_id", "score"])

    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {id_type}, score double")


def good_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a score of at least THRESHOLD, with all their columns.

    Null and empty texts are scored as empty ones; equal texts stay or go together, repeated
    rows each; a score of exactly THRESHOLD stays; an empty table gives none.
    """
    lower = [c.lower() for c in docs.columns]
    place = docs.columns.index("text") if "text" in docs.columns else lower.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column(place)) >= THRESHOLD))

    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """Scores of all of ``docs`` by a model of the labels outside one fold of a hash of the id.

    ``(doc_id, held_out, score, predicted)``, a row per row. A null id is of fold 0; null
    and empty texts are scored as empty; equal texts get equal scores; a score of
    exactly THRESHOLD is predicted 1; an empty table gives none.
    """
    known = pick(labels, "doc_id", "quality").withColumnRenamed("quality", "label")
    model = train(docs, known.where(remainder(F.col("doc_id"), folds) != held_out))
    return score(docs, model).select(
        "doc_id",
        (remainder(F.col("doc_id"), folds) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
