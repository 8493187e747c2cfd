"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts up to ORDER bytes with the counts of
what followed, held as sorted arrays of its own, so languages share no room. A byte is coded in
the longest context that the tree keeps; one that never followed there costs an
escape and is coded in the next shorter context, at last as one of 256 bytes. The
counts stay frozen while a text is scored, so its code length is a sum over its runs of
ORDER + 1 bytes, and the language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logistra.llm import tokens
from logistra.llm.frames import pick, remainder

# Bytes of the longest context.
ORDER = 3
# Documents of each language that are learned from, about; a hash chooses them.
SAMPLE_DOCS = 1500
# Runs of a language that are learned, most frequent first: the size of its tree.
MOST_RUNS = 300_000
# A context is kept if the language has seen it so often.
LEAST_COUNT = 4
# Most languages: their trees are sent to every task, a few megabytes each.
LANGUAGES = 1000


def training_runs(texts: DataFrame) -> DataFrame:
    """``(lang, run, n)``: runs of ORDER + 1 bytes in ``texts`` (lang, text), texts preceded by spaces."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            raw, bounds = tokens.buffers(batch.column("text"))
            for lang in set(langs):
                rows = np.flatnonzero(langs == lang)
                padded = [np.full(ORDER, 32, dtype=np.uint8)]
                runs = []
                for r in rows:
                    text = np.concatenate([*padded, raw[bounds[r] : bounds[r + 1]]]).astype(np.int64)
                    runs.append(((text[:-3] << 24) | (text[1:-2] << 16) | (text[2:-1] << 8) | text[3:]))
                found, n = np.unique(np.concatenate(runs), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n)],
                    names=["lang", "run", "n"],
                )

    counted = texts.mapInArrow(count, "lang string, run long, n long")
    return counted.groupBy("lang", "run").agg(F.sum("n").alias("n"))


def _distinct(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(codes, return_inverse=True)
    return found, np.bincount(where, weights=n, minlength=len(found))


class Tree:
    """The contexts of one language, by length: contexts, escapes, codes and their bits."""

    def __init__(self, run: np.ndarray, n: np.ndarray):
        """Byte runs as numbers, and how often each occurs."""
        self.levels: list[tuple[np.ndarray, ...]] = []
        for k in range(ORDER + 1):
            # A code is a context of k bytes and the byte behind it.
            codes, counts = _distinct(run & ((1 << 8 * (k + 1)) - 1), n)
            contexts, totals = _distinct(codes >> 8, counts)
            kinds = np.bincount(np.searchsorted(contexts, codes >> 8), minlength=len(contexts))
            kept = totals >= (LEAST_COUNT if k else 1)
            of = np.searchsorted(contexts, codes >> 8)
            bits = -np.log2(counts / (totals + kinds)[of])
            escapes = -np.log2(kinds / (totals + kinds))
            self.levels.append(
                (
                    contexts[kept].astype(np.uint32),
                    escapes[kept].astype(np.float32),
                    codes[kept[of]].astype(np.uint32),
                    bits[kept[of]].astype(np.float32),
                )
            )

    def bits(self, runs: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each run of ORDER + 1 bytes."""
        cost = np.zeros(len(runs), dtype=np.float64)
        left = np.arange(len(runs))
        for k in reversed(range(ORDER + 1)):
            contexts, escapes, codes, bits = self.levels[k]
            code = runs[left] & np.uint32((1 << 8 * (k + 1)) - 1)
            place, hit = _places(codes, code)
            cost[left[hit]] += bits[place[hit]]
            left, context = left[~hit], code[~hit] >> np.uint32(8)
            place, known = _places(contexts, context)
            cost[left[known]] += escapes[place[known]]
        cost[left] += 8.0
        return cost


def _places(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value is among the sorted ones, and whether it is there."""
    if not len(values):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    place = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return place, values[place] == wanted


class Model:
    """A context tree for each language."""

    def __init__(self, runs: dict[str, tuple[np.ndarray, np.ndarray]]):
        """``runs``: byte runs and their counts of each language."""
        self.langs = sorted(runs)
        self.trees = [Tree(*runs[lang]) for lang in self.langs]

    def code_lengths(self, column: pa.Array) -> np.ndarray:
        """Bits of every text under every language.

        Bytes are read in pieces of tokens.CHUNK, across texts and within long ones; the
        distinct runs of a piece are looked up once per language.
        """
        raw, bounds = tokens.buffers(column)
        out = np.zeros((len(bounds) - 1, len(self.langs)))
        for first in range(int(bounds[0]), int(bounds[-1]), tokens.CHUNK):
            end = min(first + tokens.CHUNK, int(bounds[-1]))
            found, where = np.unique(_runs(raw, bounds, first, end), return_inverse=True)
            # Texts with bytes in the piece, and where in it each begins.
            docs = np.arange(
                np.searchsorted(bounds, first, side="right") - 1, np.searchsorted(bounds, end, side="left")
            )
            docs = docs[np.minimum(bounds[docs + 1], end) > np.maximum(bounds[docs], first)]
            begin = np.maximum(bounds[docs], first) - first
            for lang, tree in enumerate(self.trees):
                out[docs, lang] += np.add.reduceat(tree.bits(found)[where], begin)
        return out


def _runs(raw: np.ndarray, bounds: np.ndarray, first: int, end: int) -> np.ndarray:
    """The run that every byte from ``first`` to ``end`` - 1 ends; spaces precede a text."""
    out = raw[first:end].astype(np.uint32)
    starts = bounds[np.searchsorted(bounds, first - ORDER, side="left") : np.searchsorted(bounds, end)]
    for back in range(1, ORDER + 1):
        before = np.full(end - first, 32, dtype=np.uint32)
        if (have := max(first, back)) < end:
            before[have - first :] = raw[have - back : end - back]
        for step in range(back):
            at = starts + step - first
            before[at[(at >= 0) & (at < end - first)]] = 32
        out |= before << np.uint32(8 * back)
    return out


def train(docs: DataFrame) -> Model | None:
    """A model of the languages of ``docs`` (text, lang); null without any labelled text.

    About SAMPLE_DOCS documents of each language are used, chosen by a hash, all
    of them if there are fewer. Their whole texts are counted by the executors;
    the driver gets the MOST_RUNS most frequent runs of each language, so a rare one keeps
    its own. More than LANGUAGES languages are refused.
    """
    known = pick(docs, "doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return None
    share = F.create_map(
        *[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, SAMPLE_DOCS / n))]
    )
    chance = F.expr("shiftrightunsigned(xxhash64(doc_id, text), 11) / 9007199254740992D")
    sample = known.where(chance < share[F.col("lang")]).select("lang", F.lower("text").alias("text"))
    runs: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "run"))
    counted = training_runs(sample).withColumn("rank", rank).where(F.col("rank") <= MOST_RUNS)
    rows = counted.drop("rank").toArrow()
    langs = np.array(rows.column("lang").to_pylist(), dtype=object)
    for lang in sorted(set(langs)):
        own = langs == lang
        runs[lang] = tuple(rows.column(c).to_numpy()[own] for c in ("run", "n"))
    return Model(runs) if runs else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row of ``docs`` (doc_id, text).

    ``score`` is the probability of the chosen language if all were equally
    likely before. A null text, one without a letter, and every text without a
    model are ``und`` with score 0. Of equal code lengths the first language in
    order of its name wins.
    """
    texts = pick(docs, "doc_id", "text").select(
        "doc_id",
        F.lower("text").alias("text"),
        F.expr(r"coalesce(text RLIKE r'\p{L}', false)").alias("letters"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            langs, scores = np.full(n, "und", dtype=object), np.zeros(n)
            if model is not None and n:
                bits = model.code_lengths(batch.column("text"))
                best = bits.argmin(axis=1)
                shares = np.exp2(bits.min(axis=1, keepdims=True) - bits)
                ok = batch.column("letters").to_numpy(zero_copy_only=False)
                langs[ok] = np.array(model.langs, dtype=object)[best[ok]]
                scores[ok] = (1 / shares.sum(axis=1))[ok]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)],
                names=["doc_id", "lang_pred", "score"],
            )

    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """Predictions for all of ``docs`` by a model of those outside one fold of a hash of the id.

    ``(doc_id, held_out, lang_pred, score)``, a row per row. A null id is of fold 0; rows
    without text or language teach nothing; equal texts get equal predictions; an empty
    table gives none. Very long texts are read piece by piece.
    """
    labelled = pick(docs, "doc_id", "text", "lang")
    model = train(labelled.where(remainder(F.col("doc_id"), folds) != held_out))
    fold = (remainder(F.col("doc_id"), folds) == held_out).alias("held_out")
    return predict(docs, model).select("doc_id", fold, "lang_pred", "score")
