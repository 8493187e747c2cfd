"""Ranked lexical search by NRA over impact-sorted lists.

A first pass counts documents, terms and the documents that hold each term of the
items. In a second pass every task cuts its documents into segments of bounded size and
builds, for the items' terms, lists of postings sorted by falling impact. An item
reads its lists from the top, never at random. A document's lower score is what has
been read of it, its upper score adds the next impacts of the lists in which
it was not yet seen. Reading stops once no unseen document and no document outside can reach
the item's best ones, and the scores of those are final. The best scores so far are
carried from segment to segment, so most segments are left after few reads. The
tasks return the best documents of each item, which are ranked in two levels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logistra.llm import tokens
from logistra.llm.frames import pick
from logistra.storage import drop_table, new_table_path

# Documents returned for each item.
BEST = 50
# Rows and characters of the items of one pass; more make more passes.
BLOCK_ITEMS, BLOCK_CHARS = 4096, 8_000_000
# Words after which a segment is closed; one longer document is a segment of its own.
SEGMENT_WORDS = 4_000_000
# Documents times terms of the longest item after which it is closed.
SEGMENT_CELLS = 1 << 26
# First-level groups of the tasks' results of one item.
RANK_BINS = 64
# Codes under which the first pass counts documents and terms.
DOCUMENTS, TERMS = -1, -2
# Fixed values of the score: length share, scale of a term's frequency, its weight.
FLAT, SLOPE, SCALE, FREQUENCY, LENGTH = 50, 50, 1_000_000_000, 1000, 20


class Items:
    """Distinct terms of a block of items, as hashes, and each item's terms by number."""

    def __init__(self, rows: pa.Table):
        self.ids = rows.column("item_id").combine_chunks()
        words = [
            np.unique(w.hashes[i:j])
            for w in tokens.words(rows.column("text").combine_chunks(), _letters())
            for i, j in zip(w.offsets[:-1], w.offsets[1:], strict=True)
        ]
        self.terms = np.unique(np.concatenate([*words, np.zeros(0, dtype=np.uint64)]))
        self.lists = [np.searchsorted(self.terms, w) for w in words]

    def known(self) -> np.ndarray:
        """Which top bits of a hash some term has."""
        known = np.zeros(1 << 20, dtype=bool)
        known[self.terms >> np.uint64(44)] = True
        return known

    def occurrences(self, w: tokens.Words, known: np.ndarray) -> tuple[np.ndarray, ...]:
        """(documents, terms, frequencies) of the terms in a chunk of documents."""
        at = np.flatnonzero(known[w.hashes >> np.uint64(44)])
        found = w.hashes[at]
        term = np.searchsorted(self.terms, found)
        hit = self.terms[np.minimum(term, len(self.terms) - 1)] == found if len(self.terms) else term < 0
        at, term = at[hit], term[hit]
        doc = np.searchsorted(w.offsets, at, side="right") - 1
        size = max(1, len(self.terms))
        places, tf = np.unique(doc * size + term, return_counts=True)
        return places // size, places % size, tf


def _letters() -> np.ndarray:
    """Bytes of terms: letters, digits and whatever is no ASCII; A-Z in lower case."""
    return tokens.byte_table(letters_only=True)


def _count(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = _letters(), items.known()
        holding = np.zeros(len(items.terms), dtype=np.int64)
        documents = words = 0
        for batch in batches:
            for w in tokens.words(batch.column("text"), table):
                _, term, _ = items.occurrences(w, known)
                holding += np.bincount(term, minlength=len(holding))
                documents += int(np.count_nonzero(np.diff(w.offsets)))
                words += len(w.hashes)
        held = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*held.tolist(), DOCUMENTS, TERMS], pa.int64()),
                pa.array([*holding[held].tolist(), documents, words], pa.int64()),
            ],
            names=["code", "n"],
        )

    return run


class Scoring:
    """Weights of the terms and the impact of a posting, in whole numbers."""

    def __init__(self, items: Items, counts: dict[int, int]):
        self.documents, self.words = counts.get(DOCUMENTS, 0), counts.get(TERMS, 0)
        self.weights = np.zeros(len(items.terms), dtype=np.int64)
        for term, df in counts.items():
            if term >= 0:
                ratio = (2 * self.documents + 2) / (2 * df + 1)
                self.weights[term] = math.floor(1000 * math.log(ratio))

    def impacts(self, term: np.ndarray, tf: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Impact of each posting in a document of so many terms."""
        if SLOPE * int(sizes.max(initial=0)) * self.documents < 1 << 63:
            share = SLOPE * sizes * self.documents // max(1, self.words)
        else:
            share = [SLOPE * n * self.documents // self.words for n in sizes.tolist()]
        length = FLAT + np.asarray(share, dtype=np.int64)
        return self.weights[term] * (SCALE * tf // (FREQUENCY * tf + LENGTH * length))


class Segment:
    """Impact-sorted lists of the items' terms over some documents."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        order = np.lexsort((doc, -impact, term))
        # Negated, the impacts rise, as a binary search wants them.
        self.docs, self.falls = doc[order], -impact[order]
        self.bounds = np.searchsorted(term[order], np.arange(terms + 1))

    def lists(self, terms: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for a, b in zip(self.bounds[terms], self.bounds[terms + 1], strict=True):
            if b > a and self.falls[a] < 0:
                out.append((self.docs[a:b], self.falls[a:b]))
        return out


def best_of(
    lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, carried: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores): final scores of every document that may be among the k best.

    ``lists`` hold (documents, negated impacts, rising); ``carried`` are the best
    scores elsewhere. Documents that tie with the k-th best score are among them.
    """
    lower = np.zeros(size, dtype=np.int64)
    if not lists:
        return lower[:0], lower[:0]
    place = [0] * len(lists)
    seen = np.zeros((len(lists), size), dtype=bool)
    bounds = np.array([-falls[0] for _, falls in lists], dtype=np.int64)
    level = int(bounds.max())
    # Documents still of interest; all, until no unseen one can reach the best.
    alive = None
    while True:
        for t, (docs, falls) in enumerate(lists):
            if bounds[t] < level:
                continue
            end = place[t] + int(np.searchsorted(falls[place[t] :], -level, side="right"))
            read = docs[place[t] : end]
            lower[read] -= falls[place[t] : end]
            seen[t, read] = True
            place[t], bounds[t] = end, -falls[end] if end < len(falls) else 0
        rest = int(bounds.sum())
        score = lower if alive is None else lower[alive]
        held = np.concatenate([carried, score[score > 0]])
        least = int(np.partition(held, len(held) - k)[len(held) - k]) if len(held) >= k else 1
        if alive is None and rest < least:
            alive = np.flatnonzero(lower)
        if alive is not None:
            alive = alive[lower[alive] + rest >= least]
            open_ = bounds @ ~seen[:, alive]
            keep = lower[alive] + open_ >= least
            alive, open_ = alive[keep], open_[keep]
            if not open_.any():
                return alive, lower[alive]
            # Lists in which all of them were seen need no further reads.
            bounds[seen[:, alive].all(axis=1)] = 0
        level = min(level // 2, int(bounds.max()))


class _Best:
    """The best documents of each item so far, best first."""

    def __init__(self, items: Items, k: int):
        self.k = k
        self.rows: list[list[tuple]] = [[] for _ in items.lists]

    def carried(self, item: int) -> np.ndarray:
        return np.array([-row[0] for row in self.rows[item]], dtype=np.int64)

    def add(self, item: int, ids: list, scores: list[int]) -> None:
        rows = [(-s, i is None, i) for s, i in zip(scores, ids, strict=True)]
        # Null ids come last; two of them are never compared.
        self.rows[item] = sorted(self.rows[item] + rows, key=lambda r: r if r[2] is not None else r[:2])[: self.k]


def _search(items: Items, scoring: Scoring, k: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known, best = _letters(), items.known(), _Best(items, k)
        parts: list[tuple] = []
        ids: list[pa.Array] = []
        docs = words = 0
        most = SEGMENT_CELLS // max(1, *map(len, items.lists), 1)

        def close() -> None:
            doc, term, impact = (np.concatenate(p) for p in zip(*parts, strict=True))
            segment = Segment(doc, term, impact, len(items.terms))
            names = pa.concat_arrays(ids)
            for item, terms in enumerate(items.lists):
                found, scores = best_of(segment.lists(terms), docs, k, best.carried(item))
                if len(found):
                    best.add(item, names.take(pa.array(found)).to_pylist(), scores.tolist())

        for batch in batches:
            for w in tokens.words(batch.column("text"), table):
                sizes = np.diff(w.offsets)
                doc, term, tf = items.occurrences(w, known)
                parts.append((doc + docs, term, scoring.impacts(term, tf, sizes[doc])))
                ids.append(batch.column("doc_id").slice(w.first, len(sizes)))
                docs, words = docs + len(sizes), words + len(w.hashes)
                if words >= SEGMENT_WORDS or docs >= most:
                    close()
                    parts, ids, docs, words = [], [], 0, 0
        if parts:
            close()
        rows = [(item, r[2], -r[0]) for item, found in enumerate(best.rows) for r in found]
        query, doc, score = zip(*rows, strict=True) if rows else ((),) * 3
        place = pa.array(query, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [place, items.ids.take(place), pa.array(doc, id_type), pa.array(score, pa.int64())],
            names=["query", "item_id", "doc_id", "score"],
        )

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query: of each bin of tasks first, then of those."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    binned = found.withColumn("bin", F.spark_partition_id() % RANK_BINS)
    for keys in (["query", "bin"], ["query"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        binned = binned.withColumn("rank", rank).where(F.col("rank") <= k)
    return binned.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best ``docs`` (doc_id, text) of each of ``items`` (item_id, text).

    Only scores above 0 count; higher ones come first, equal ones by ascending
    doc_id, nulls last. Every row of either table stands for itself: copies of a
    document are ranked each, copies of an item get the same rows each. Null and
    empty texts have no terms and are never found, or find nothing. Terms are
    told apart by 64-bit hashes.
    """
    if k < 1:
        raise ValueError("a search returns at least one document")
    texts = pick(docs, "doc_id", "text")
    wanted = pick(items, "item_id", "text").where("text IS NOT NULL")
    id_types = [f.schema[c].dataType.simpleString() for f, c in ((texts, "doc_id"), (wanted, "item_id"))]
    schema = f"query long, item_id {id_types[1]}, doc_id {id_types[0]}, score long"
    size = wanted.select(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-size[0] // BLOCK_ITEMS), -(-size[1] // BLOCK_CHARS))
    arrow_type = texts.select("doc_id").limit(0).toArrow().schema.field("doc_id").type

    def ranked(block: DataFrame) -> DataFrame:
        # A row count and a length bound what reaches the driver and the tasks.
        part = Items(block.toArrow())
        counted = texts.select("text").mapInArrow(_count(part), "code long, n long")
        counts = {r.code: r.n for r in counted.groupBy("code").agg(F.sum("n").alias("n")).collect()}
        return _ranked(texts.mapInArrow(_search(part, Scoring(part, counts), k, arrow_type), schema), k)

    if blocks == 1:
        return ranked(wanted)
    # One block after the other, so that the driver never holds two.
    path = new_table_path(docs.sparkSession, "ranked")
    try:
        for b in range(blocks):
            block = wanted.where(F.expr(f"pmod(xxhash64(item_id, text), {blocks}) = {b}"))
            ranked(block).write.mode("append").parquet(path)
    except BaseException:
        drop_table(docs.sparkSession, path)
        raise
    return docs.sparkSession.read.parquet(path)
