"""Language-model scores by cross-entropy difference.

Two bigram models with one vocabulary, all words of the corpus, are counted over
it: the target model over the documents of a chosen subset, the background model
over all. The background counts are scaled to the target's number of words, so
that both models are smoothed alike. A document's score is the mean over its
words of target loss minus background loss: negative for texts like the target.

Documents are stored in blocks, as numbers of the block's words. A block sends its
words and bigrams, once each, to the buckets of the words before; a bucket sums
them over all blocks and answers every block in the order in which it was asked.
So a bigram is shuffled once for a block that has it, and comes back as two
numbers. The bigrams of a frequent word are dealt over several buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logistra.llm import tokens
from logistra.llm.frames import pick
from logistra.llm.packed import joined, lengths, packed, plain, unpack
from logistra.storage import stored

# Words of the shared vocabulary, if it is to be bounded: the most frequent ones,
# all others are one word. None: every word of the corpus.
VOCABULARY: int | None = None
# Words, and documents, of a block, or of the last text of it if that is longer.
HELD_WORDS = 1 << 21
# Most ids of the target that are broadcast: 8 bytes each.
BROADCAST_ROWS = 1_000_000
# Words of the corpus for each bucket, where the shuffle has not more partitions.
BUCKET_WORDS = 1 << 21
# A word that is at least this part of a block is reported by it, and as many of the most
# frequent ones are known to all tasks, which name them by number. The bigrams after such a
# word are dealt over a bucket for each HOT_PAIRS of them. The choice changes no result.
HOT_WORDS, HOT_PAIRS = 1 << 13, 1 << 18

# Columns of a block's row: its documents, the low halves of its words, the place of the word
# before a first one, and the words of the texts as places. The high halves are beside them,
# so that only those who need whole words read them.
BLOCK = ["block", "ids", "sizes", "chosen", "low", "start", "at"]
# What a block sends to a bucket: words, bigrams that each begins, counts of each as a second
# word, the second words of the bigrams (numbers of known words from 1; of others 0, and their
# hashes), and the bigrams' counts; in all and in the target.
ASKED = ["bucket", "block", "words", "followers", "single", "target_single", "seconds", "others", "n", "target_n"]
# What it gets back: the different second words of the bucket; of each word the bigrams it
# begins, their kinds in the target, and in the background as the words of those of expected
# count below 1 and the number of the others, and its counts as a second word, over all
# blocks; and the bigrams' counts in the other blocks.
WORD_FACTS = ["total", "target_total", "target_kinds", "rare", "kinds", "single", "target_single"]
ANSWERED = ["block", "bucket", "distinct", *WORD_FACTS, "n", "target_n"]


def vocabulary(texts: DataFrame) -> np.ndarray | None:
    """Hashes of the VOCABULARY most frequent words of ``texts`` (text), ascending; ties by hash."""
    if VOCABULARY is None:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokens.byte_table()
        for batch in batches:
            for w in tokens.words(batch.column("text"), table):
                found = np.unique(w.hashes.view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["word", "n"])

    counted = texts.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    return np.sort(np.array([r.word for r in top], dtype=np.int64))


def blocks(texts: DataFrame, vocab: np.ndarray | None) -> DataFrame:
    """``texts`` (doc_id, text, is_target) in blocks: a row of BLOCK, and its frequent words, for each.

    Words are hashes, the most frequent first; those that are not in ``vocab``,
    where there is one, are 0.
    """

    def block(number: int, held: list[tuple]) -> pa.RecordBatch:
        ids = pa.concat_arrays([part[0] for part in held])
        sizes, chosen, hashes = (np.concatenate(c) for c in list(zip(*held, strict=True))[1:])
        words, where, n = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(words), dtype=np.int64)
        rank[order] = np.arange(len(words))
        frequent = order[n[order] * HOT_WORDS >= len(hashes)]
        ranked = words[order] if (words == 0).any() else np.append(words[order], 0)
        start = int(np.flatnonzero(ranked == 0)[0])
        halves = ranked.view(np.uint64).astype(np.uint32), (ranked.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
        known = [
            packed(sizes, np.array([0, len(sizes)])),
            packed(chosen, np.array([0, len(chosen)])),
            plain(halves[0], np.array([0, len(ranked)])),
            pa.array([start]),
            packed(rank[where], np.array([0, len(hashes)])),
            plain(halves[1], np.array([0, len(ranked)])),
        ]
        lists = [pa.array(c) for c in (words[frequent], n[frequent])]
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.ListArray.from_arrays([0, len(ids)], ids), *known]
            + [pa.array([len(hashes)]), pa.array([int(np.dot(sizes, chosen))])]
            + [pa.ListArray.from_arrays([0, len(c)], c) for c in lists],
            names=[*BLOCK, "high", "size", "target_size", "frequent", "times"],
        )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokens.byte_table()
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0
        for batch in batches:
            chosen = batch.column("is_target").to_numpy(zero_copy_only=False).astype(np.int64)
            for w in tokens.words(batch.column("text"), table):
                sizes, hashes = np.diff(w.offsets), w.hashes.view(np.int64)
                if vocab is not None:
                    hashes = np.where(np.isin(hashes, vocab), hashes, 0)
                ids = batch.column("doc_id").slice(w.first, len(sizes))
                held.append((ids, sizes, chosen[w.first : w.first + len(sizes)], hashes))
                size += len(sizes) + len(hashes)
                if size >= HELD_WORDS:
                    yield block(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield block(number, held)

    id_type = texts.schema["doc_id"].dataType.simpleString()
    schema = f"block long, ids array<{id_type}>, sizes binary, chosen binary, low binary, start long, at binary"
    schema += ", high binary, size long, target_size long, frequent array<long>, times array<long>"
    return texts.mapInArrow(split, schema)


def pair_codes(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """One hash of two words."""
    mixed = tokens.mix(before.view(np.uint64) + np.uint64(1))
    return tokens.mix(mixed + words.view(np.uint64)).view(np.int64)


class Dealing(NamedTuple):
    """How bigrams are dealt to buckets."""

    buckets: int
    known: np.ndarray  # frequent words, the most frequent first
    parts: np.ndarray  # buckets over which the bigrams after each, and words of its low half, are dealt


def _numbers(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place from 1 of each value among ``keys``, 0 where it is none of them."""
    if not len(keys):
        return np.zeros(len(values), dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    place = order[np.minimum(np.searchsorted(keys, values, sorter=order), len(keys) - 1)]
    return np.where(keys[place] == values, place + 1, 0)


class Bigrams(NamedTuple):
    """The bigrams of a block by bucket and word before; words are their places in the block."""

    sizes: np.ndarray  # words of each document
    single: np.ndarray  # counts as a second word
    target_single: np.ndarray
    at: np.ndarray  # for each word of the texts, the place of the bigram that it ends
    entries: np.ndarray  # words before, once for every bucket
    first: np.ndarray  # whether this is the bucket that counts the word itself
    followers: np.ndarray  # bigrams of each entry
    entry_cuts: np.ndarray  # entries of each bucket
    seconds: np.ndarray
    n: np.ndarray
    target_n: np.ndarray
    cuts: np.ndarray  # bigrams of each bucket


def _bigrams(block: dict, dealing: Dealing) -> Bigrams:
    """Of a row of BLOCK; the buckets follow from the low halves of the words."""
    sizes, chosen, second = (unpack(block[c]) for c in ("sizes", "chosen", "at"))
    low = np.frombuffer(block["low"], dtype=np.uint32)
    many = len(low)
    mine = np.repeat(chosen, sizes)
    single, target_single = np.bincount(second, minlength=many), np.bincount(second[mine > 0], minlength=many)
    before = np.append(0, second[:-1])[: len(second)]
    starts = np.cumsum(sizes) - sizes
    before[starts[sizes > 0]] = block["start"]

    codes, where, n = np.unique(before * many + second, return_inverse=True, return_counts=True)
    target_n = np.bincount(where[mine > 0], minlength=len(codes))
    before, second = codes // many, codes % many
    parts = np.append(1, dealing.parts)[_numbers(dealing.known.view(np.uint64).astype(np.uint32), low)]
    mixed = tokens.mix(low.astype(np.uint64) + np.uint64(2))
    home = (mixed % np.uint64(dealing.buckets)).astype(np.int64)
    part = (mixed[second] >> np.uint64(20)) % parts[before].astype(np.uint64)
    bucket = (home[before] + part.astype(np.int64)) % dealing.buckets
    order = np.argsort(bucket, kind="stable")
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))

    entries = np.repeat(np.arange(many), parts)
    part = np.arange(len(entries)) - np.repeat(np.cumsum(parts) - parts, parts)
    entry_bucket = (home[entries] + part) % dealing.buckets
    by = np.argsort(entry_bucket, kind="stable")
    entries, part, entry_bucket = entries[by], part[by], entry_bucket[by]
    bucket, before = bucket[order], before[order]
    bounds = np.searchsorted(bucket * many + before, entry_bucket * many + entries)
    every = np.arange(dealing.buckets + 1)
    return Bigrams(
        sizes, single, target_single, back[where], entries, part == 0,
        np.diff(bounds, append=len(before)), np.searchsorted(entry_bucket, every),
        second[order], n[order], target_n[order], np.searchsorted(bucket, every),
    )


def _ask(dealing: Dealing) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of ASKED of each block with words, one for every bucket."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                b = _bigrams(block, dealing)
                if len(b.at):
                    low, high = (np.frombuffer(block[c], dtype=np.uint32) for c in ("low", "high"))
                    words = (high.astype(np.uint64) << np.uint64(32) | low).view(np.int64)
                    seconds = _numbers(dealing.known, words)[b.seconds]
                    others = np.append(0, np.cumsum(seconds == 0))[b.cuts]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.arange(dealing.buckets)),
                            pa.array(np.full(dealing.buckets, block["block"])),
                            plain(words[b.entries], b.entry_cuts),
                            packed(b.followers, b.entry_cuts),
                            packed(np.where(b.first, b.single[b.entries], 0), b.entry_cuts),
                            packed(np.where(b.first, b.target_single[b.entries], 0), b.entry_cuts),
                            packed(seconds, b.cuts),
                            plain(words[b.seconds[seconds == 0]], others),
                            packed(b.n, b.cuts),
                            packed(b.target_n, b.cuts),
                        ],
                        names=ASKED,
                    )

    return ask


def _sums(where: np.ndarray, values: np.ndarray, many: int) -> np.ndarray:
    return np.bincount(where, weights=values, minlength=many).astype(np.int64)


def _answer(dealing: Dealing, scale: float) -> Callable[[pa.Table], pa.Table]:
    """Rows of ANSWERED for the rows of ASKED of a bucket."""

    def answer(asked: pa.Table) -> pa.Table:
        entry_cuts, cuts = (np.append(0, np.cumsum(lengths(asked[c]))) for c in ("followers", "seconds"))
        words, entry = np.unique(np.frombuffer(joined(asked["words"]), dtype=np.int64), return_inverse=True)
        before = np.repeat(entry, unpack(joined(asked["followers"])))
        numbers = unpack(joined(asked["seconds"]))
        seconds = np.append(0, dealing.known)[numbers]
        seconds[numbers == 0] = np.frombuffer(joined(asked["others"]), dtype=np.int64)
        codes, at, where = np.unique(pair_codes(words[before], seconds), return_index=True, return_inverse=True)
        before, many = before[at], len(words)
        own = [unpack(joined(asked[c])) for c in ("n", "target_n")]
        n, target_n = (_sums(where, x, len(codes)) for x in own)
        rare = n * scale < 1
        facts = [
            _sums(before, n, many),
            _sums(before, target_n, many),
            _sums(before, target_n > 0, many),
            _sums(before, np.where(rare, n, 0), many),
            _sums(before, ~rare, many),
            *(_sums(entry, unpack(joined(asked[c])), many) for c in ("single", "target_single")),
        ]
        distinct = int((facts[5] > 0).sum())
        return pa.table(
            [
                asked["block"],
                asked["bucket"],
                pa.array(np.full(len(asked), distinct)),
                *(packed(x[entry], entry_cuts) for x in facts),
                *(packed(x[where] - mine, cuts) for x, mine in zip((n, target_n), own, strict=True)),
            ],
            names=ANSWERED,
        )

    return answer


def _score(dealing: Dealing, scale: float, chosen: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores of the documents of a block by its rows of ANSWERED.

    Witten-Bell: a first word's counts are joined by as many draws from the
    word's own frequency (plus one) as it has kinds of followers. Counts may be
    fractions; a bigram of expected count below 1 is that part of a kind.
    """

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        b = _bigrams({c: block[c][0].as_py() for c in BLOCK[2:]}, dealing)
        answers = answers.sort_by("bucket")
        fact = {c: _sums(b.entries, unpack(joined(answers[c])), len(b.single)) for c in WORD_FACTS if len(b.at)}
        n = {c: getattr(b, c) + unpack(joined(answers[c])) for c in ("n", "target_n")}
        singles = float(chosen + max(1, sum(answers["distinct"].to_pylist())))
        before = np.repeat(b.entries, b.followers)
        docs = np.flatnonzero(b.sizes)
        starts = (np.cumsum(b.sizes) - b.sizes)[docs]
        out = []
        for counts, total, kinds, single in (
            ("target_n", "target_total", lambda: fact["target_kinds"] + 1.0, "target_single"),
            ("n", "total", lambda: fact["rare"] * scale + fact["kinds"] + 1.0, "single"),
        ):
            losses = np.zeros(len(b.sizes))
            if len(b.at):
                by = 1.0 if counts == "target_n" else scale
                first = kinds()[before]
                draws = first * (fact[single] * by + 1.0)[b.seconds] / singles
                bits = -np.log2((n[counts] * by + draws) / ((fact[total] * by)[before] + first))
                # As single precision, in which models are kept.
                losses[docs] = np.add.reduceat(bits.astype(np.float32).astype(np.float64)[b.at], starts)
                losses[docs] /= b.sizes[docs]
            out.append(pa.array(losses, mask=b.sizes == 0))
        ids = block["ids"].combine_chunks().flatten()
        return pa.table([ids, pa.array(b.sizes), *out], names=["doc_id", "n_words", "target_loss", "background_loss"])

    return score


def score(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """``(doc_id, n_words, target_loss, background_loss, difference)`` of every row of ``docs``.

    ``docs`` has doc_id and text, ``target_ids`` the doc_id of the target's
    documents; null ids are none. Words are lower-cased (A-Z) runs without white
    space. Losses are bits per word. Texts without words, and null texts, have
    n_words 0 and null losses. Without any target both models know nothing but
    the vocabulary's size on the target side. All counts are over all rows and
    all words; the driver gets the at most HOT_WORDS most frequent words.
    """
    spark = docs.sparkSession
    texts = pick(docs, "doc_id", "text")
    ids = pick(target_ids, "doc_id").where("doc_id IS NOT NULL").distinct()
    ids = ids.select("doc_id", F.lit(True).alias("is_target"))
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    marked = texts.join(ids, "doc_id", "left").select(
        "doc_id", "text", F.coalesce("is_target", F.lit(False)).alias("is_target")
    )
    # Rows are large: the writer is to look at its pages after each.
    held, _ = stored(blocks(marked, vocabulary(texts)), "blocks", **{
        "compression": "zstd", "parquet.enable.dictionary": "false",
        "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1",
    })
    every, chosen = held.selectExpr("coalesce(sum(size), 0)", "coalesce(sum(target_size), 0)").first()
    scale = chosen / max(1, every)
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-every // BUCKET_WORDS))
    known = held.selectExpr("inline(arrays_zip(frequent, times))").groupBy("frequent").agg(F.sum("times").alias("n"))
    known = known.orderBy(F.desc("n"), "frequent").limit(HOT_WORDS).toArrow()
    parts = np.minimum(-(-known["n"].to_numpy() // HOT_PAIRS), buckets)
    dealing = Dealing(buckets, known["frequent"].to_numpy(), parts)

    names = {"bucket": "long", "block": "long", "distinct": "long"}
    asked = held.select(*[c for c in BLOCK if c != "ids"], "high").mapInArrow(
        _ask(dealing), ", ".join(f"{c} {names.get(c, 'binary')}" for c in ASKED)
    )
    answers = asked.groupBy("bucket").applyInArrow(
        _answer(dealing, scale), ", ".join(f"{c} {names.get(c, 'binary')}" for c in ANSWERED)
    )
    id_type = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, target_loss double, background_loss double"
    rows = held.select(*BLOCK).groupBy("block").cogroup(answers.groupBy("block"))
    scored = rows.applyInArrow(_score(dealing, scale, chosen), schema)
    return scored.withColumn("difference", F.col("target_loss") - F.col("background_loss"))
