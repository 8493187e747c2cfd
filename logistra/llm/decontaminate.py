"""Benchmark decontamination by CGK embedding, bit-sampling LSH and edit distance.

The unit is the word, lower-cased and stripped of punctuation; in scripts without
spaces between words it is the character. From every word
of a document a random walk writes its embedding: step j copies the word under
it and then moves on by 0 or 1 words, as a random function of j and of that word
says. Walks over texts of small edit distance soon run in step again, so their
embeddings have a small Hamming distance. Several samples of a few coordinates
of several walks are looked up among the samples of the benchmark items; a hit
is verified by the exact edit distance.

Walks are out of step for a while after every edit, so a sample of a long item
rarely survives the most edits that count. Long items are therefore searched by
overlapping windows of bounded length: each is a trial of its own, and edits are
spread unevenly over them, so the chance of a hit rises with an item's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logistra.llm import tokens
from logistra.llm.frames import pick
from logistra.storage import drop_table, new_table_path, stored

# Items of fewer words are too short for walks; two of their pieces are looked up.
LEAST_WORDS = 8
# Items of more words are searched by windows of so many words, one every so many.
WHOLE_WORDS, WINDOW, STRIDE = 15, 14, 7
# Characters that are words of their own, and punctuation that they come with.
UNSPACED = "".join(
    rf"\p{{Is{script}}}"
    for script in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan")
)
UNSPACED_MARKS = r"[\x{3000}\x{0F0B}-\x{0F14}]|[\p{IsPunctuation}&&[\x{3001}-\x{303F}\x{FF00}-\x{FF65}]]"
# Most edits of words, as a share of the item's words.
EDITS = 0.2
# Walks, samples of each walk and size class, coordinates of a sample, and their distance.
WALKS, SAMPLES, COORDINATES, GAP = 5, 12, 4, 2
# Windows of one size class differ by less than this factor; samples reach
# over the smallest window of the class.
CLASS_RATIO = 1.5
# Entries of a table of known keys, for each key.
SPARSE = 8
# Items and characters of one pass over the documents; more make more passes. An
# index takes about 100 bytes a character.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 1_000_000
# Steps after which walks that met are merged.
MERGES = {1, 2, 4, 8, 12, 20, 32, 50, 80, 128, 200, 320, 512}

SEED = 20240917


def join_keys(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """32-bit keys of a sample with one more coordinate; the top bits are well mixed."""
    return (keys + words) * np.uint32(0x9E3779B1)


def short(words: np.ndarray) -> np.ndarray:
    """Word hashes as the walks use them."""
    return (words >> np.uint64(32)).astype(np.uint32)


class Sample:
    """Coordinates of one walk and the windows that each prefix of them leaves."""

    def __init__(self, steps: np.ndarray, symbols: np.ndarray, windows: np.ndarray):
        """``symbols``: a row of words at ``steps`` for each of ``windows``."""
        self.steps = steps
        bits = max(8, int(SPARSE * len(windows)).bit_length())
        self.shift = np.uint32(32 - min(bits, 24))
        keys = symbols[:, 0]
        self.seen = []
        for j in range(len(steps)):
            keys = join_keys(keys, symbols[:, j]) if j else keys
            known = np.zeros((1 << 32) >> int(self.shift), dtype=bool)
            known[keys >> self.shift] = True
            self.seen.append(known)
        order = np.argsort(keys, kind="stable")
        self.keys, self.windows = keys[order], windows[order].astype(np.int32)

    def may_hit(self, depth: int, keys: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.seen[depth][keys >> self.shift])

    def hits(self, keys, walks, starts) -> np.ndarray:
        """(window, first start, last start) rows of the walks whose key is a window's."""
        low, high = (np.searchsorted(self.keys, keys, side=x) for x in ("left", "right"))
        n = high - low
        walk = np.repeat(walks, n)
        place = np.arange(len(walk)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return np.column_stack([self.windows[place], starts[walk], starts[walk + 1] - 1])


class Index:
    """The samples of all items, by walk."""

    def __init__(self, ids: pa.Array, texts: pa.Array):
        table = tokens.byte_table(letters_only=True)
        words = [
            w.hashes[i:j]
            for w in tokens.words(texts, table)
            for i, j in zip(w.offsets[:-1], w.offsets[1:], strict=True)
        ]
        kept = [i for i, w in enumerate(words) if len(w)]
        self.ids, self.words = ids.take(pa.array(kept, pa.int64())), [words[i] for i in kept]
        random = np.random.default_rng(SEED)
        # A row per window: item, first word, words.
        cut = [
            (item, a, b - a)
            for item, w in enumerate(self.words)
            if len(w) >= LEAST_WORDS
            for a, b in _windows(len(w))
        ]
        windows = np.array(cut, dtype=np.int64).reshape(-1, 3)
        self.items, self.places, sizes = windows.T
        classes = np.floor(np.log(sizes / LEAST_WORDS) / np.log(CLASS_RATIO) + 1e-9).astype(int)
        self.most = int(sizes.max(initial=0))
        self.walks: list[tuple[np.ndarray, list[Sample]]] = []
        for _ in range(WALKS):
            multipliers = random.integers(1, 1 << 63, 2 * self.most + 1, dtype=np.uint64)
            multipliers = (multipliers >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
            samples = []
            for c in np.unique(classes):
                chosen = np.flatnonzero(classes == c)
                smallest = int(sizes[chosen].min())
                symbols = self._embed(chosen, sizes[chosen], multipliers)
                for _ in range(SAMPLES):
                    steps = _coordinates(smallest, random)
                    samples.append(Sample(steps, symbols[:, steps], chosen))
            self.walks.append((multipliers, samples))
        self.pieces = self._pieces()

    def _pieces(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(words, hashes, items, places in the items) of the pieces of short items, by length.

        Of two halves a leak of up to one edit holds one unchanged; without edits
        the item is one piece.
        """
        cut: dict[int, list[tuple[int, int, int]]] = {}
        for item, words in enumerate(self.words):
            if len(words) >= LEAST_WORDS:
                continue
            parts = int(EDITS * len(words)) + 1
            ends = [len(words) * j // parts for j in range(parts + 1)]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                cut.setdefault(b - a, []).append((int(tokens.shingles(words[a:b], b - a)[0]), item, a))
        out = []
        for size, pieces in sorted(cut.items()):
            keys, items, places = zip(*sorted(pieces), strict=True)
            out.append((size, np.array(keys, dtype=np.uint64), np.array(items), np.array(places)))
        return out

    def unchanged(self, w: tokens.Words) -> np.ndarray:
        """(document, item, start) rows where a document of the chunk may hold a short item.

        A piece of the item is there, and of its other words all but as many as edits
        count are at their places or next to them, so a common piece alone is none.
        """
        found = [np.zeros((0, 3), dtype=np.int64)]
        padded = np.concatenate([np.zeros(LEAST_WORDS, dtype=np.uint64), w.hashes])
        padded = np.concatenate([padded, np.zeros(2 * LEAST_WORDS, dtype=np.uint64)])
        for size, keys, items, places in self.pieces:
            if len(w.hashes) < size:
                continue
            runs = tokens.shingles(w.hashes, size)
            low, high = (np.searchsorted(keys, runs, side=x) for x in ("left", "right"))
            at = np.flatnonzero(high > low)
            docs = np.searchsorted(w.offsets, at, side="right") - 1
            inside = at + size <= w.offsets[docs + 1]
            at, docs = at[inside], docs[inside]
            n = high[at] - low[at]
            hit = np.repeat(np.arange(len(at)), n)
            piece = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + low[at][hit]
            start = at[hit] - places[piece]
            for item in np.unique(items[piece]):
                words = self.words[item]
                mine = np.flatnonzero(items[piece] == item)
                missing = np.zeros(len(mine), dtype=np.int64)
                for j, word in enumerate(words):
                    near = padded[start[mine, None] + (j + LEAST_WORDS) + np.array([-1, 0, 1])]
                    missing += ~(near == word).any(axis=1)
                mine = mine[missing <= int(EDITS * len(words))]
                first = np.maximum(w.offsets[docs[hit[mine]]], start[mine])
                found.append(np.column_stack([docs[hit[mine]], np.full(len(mine), item), first]))
        return np.unique(np.concatenate(found), axis=0)

    def _embed(self, chosen: np.ndarray, sizes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
        """A row of the embedding for each of the chosen windows; zeros follow its last word."""
        text = np.zeros((len(chosen), int(sizes.max()) + 1), dtype=np.uint32)
        for row, window in enumerate(chosen):
            words, a = self.words[self.items[window]], self.places[window]
            text[row, : sizes[row]] = short(words[a : a + sizes[row]])
        out = np.zeros((len(chosen), len(multipliers)), dtype=np.uint32)
        rows, place = np.arange(len(chosen)), np.zeros(len(chosen), dtype=np.int64)
        for j, m in enumerate(multipliers):
            out[:, j] = text[rows, place]
            place = np.minimum(place + ((out[:, j] * m) >> np.uint32(31)), sizes)
        return out

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """(item, first, last) rows: starts of the item, beyond the text's ends too, after hits of a window."""
        found = [np.zeros((0, 3), dtype=np.int64)]
        text = np.concatenate([short(words), np.zeros(2 * self.most + 2, dtype=np.uint32)])
        for multipliers, samples in self.walks if self.most else ():
            found += self._walk(text, len(words), multipliers, samples)
        rows = np.unique(np.concatenate(found), axis=0)
        return np.column_stack([self.items[rows[:, 0]], self.places[rows[:, 0]], rows[:, 1:]])

    @staticmethod
    def _walk(text, n, multipliers, samples) -> list[np.ndarray]:
        place = np.arange(n)  # word under each walk, ascending
        start = np.arange(n)  # first start of the walks merged into each
        opening: dict[int, list[int]] = {}
        for s, sample in enumerate(samples):
            opening.setdefault(int(sample.steps[0]), []).append(s)
        # Of each sample begun: walks at its first step, the same walks now, keys so far.
        running: dict[int, list] = {}
        starts: dict[int, np.ndarray] = {}
        found: list[np.ndarray] = []
        last = max(int(sample.steps[-1]) for sample in samples)
        for j in range(last + 1):
            under = text[place]
            if j in opening:
                starts[j] = np.append(start, n)
                for s in opening[j]:
                    hit = samples[s].may_hit(0, under)
                    running[s] = [hit, hit, under[hit], 1]
            for s in list(running):
                sample, (origin, at, keys, depth) = samples[s], running[s]
                if depth < COORDINATES and sample.steps[depth] == j:
                    keys = join_keys(keys, under[at])
                    ok = sample.may_hit(depth, keys)
                    running[s] = [origin[ok], at[ok], keys[ok], depth + 1]
                    if depth + 1 == COORDINATES:
                        found.append(sample.hits(keys[ok], origin[ok], starts[int(sample.steps[0])]))
                        del running[s]
            place = place + ((under * multipliers[j]) >> np.uint32(31))
            if j + 1 in MERGES and len(place):
                keep = np.append(True, place[1:] != place[:-1])
                to = np.cumsum(keep) - 1
                place, start = place[keep], start[keep]
                for state in running.values():
                    state[1] = to[state[1]]
        return found

    def verify(self, words: np.ndarray, item: int, first: int, last: int) -> tuple[int, int] | None:
        """Edit distance of the best place near the starts and its last word, if near enough."""
        pattern = self.words[item]
        n = len(pattern)
        most = int(EDITS * n)
        low = max(0, first - most)
        region = words[low : max(0, last + n + most)]
        present = set(region.tolist())
        if sum(word in present for word in pattern.tolist()) < n - most:
            return None
        steps = np.arange(len(region) + 1)
        row = np.zeros(len(region) + 1, dtype=np.int64)
        for i, word in enumerate(pattern):
            new = np.empty_like(row)
            new[0] = i + 1
            new[1:] = np.minimum(row[:-1] + (region != word), row[1:] + 1)
            row = np.minimum.accumulate(new - steps) + steps
        best = int(np.argmin(row))
        return (int(row[best]), low + best - 1) if row[best] <= most else None

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, distance, last word) of the best place of each item in each text."""
        table = tokens.byte_table(letters_only=True)
        if not self.words:
            return
        for w in tokens.words(column, table):
            near: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for item, offset, first, last in self.candidates(w.hashes).tolist():
                # A merged walk can start in several documents.
                d = int(np.searchsorted(w.offsets, first, side="right")) - 1
                while d < len(w.offsets) - 1 and w.offsets[d] <= last:
                    if w.offsets[d + 1] > w.offsets[d]:
                        a, b = max(first, w.offsets[d]), min(last, w.offsets[d + 1] - 1)
                        near.setdefault((d, item), []).append((a - offset, b - offset))
                    d += 1
            for d, item, start in self.unchanged(w).tolist():
                near.setdefault((d, item), []).append((start, start))
            for (d, item), places in near.items():
                words, base = w.hashes[w.offsets[d] : w.offsets[d + 1]], int(w.offsets[d])
                found = [
                    hit
                    for first, last in _merged(places, len(self.words[item]))
                    if (hit := self.verify(words, item, first - base, last - base))
                ]
                if found:
                    yield w.first + d, item, *min(found)


def _coordinates(smallest: int, random: np.random.Generator) -> np.ndarray:
    """Steps of a sample of windows of at least so many words.

    A walk of j steps has passed about j / 2 words; the first steps, before walks
    have merged, tell least. Steps keep GAP apart, since neighbours mostly see the same
    word; the shortest windows leave no room for that.
    """
    first, last = smallest // 3, int(1.6 * smallest)
    more = GAP - 1 if smallest >= 12 else 0
    steps = np.arange(first, last - (COORDINATES - 1) * more)
    return np.sort(random.choice(steps, COORDINATES, replace=False)) + more * np.arange(COORDINATES)


def _windows(n: int) -> list[tuple[int, int]]:
    """First and last word + 1 of the windows of an item of n words."""
    if n <= WHOLE_WORDS:
        return [(0, n)]
    return [(a, a + WINDOW) for a in [*range(0, n - WINDOW, STRIDE), n - WINDOW]]


def _merged(places: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """Places as few ranges: one that begins near the last joins it."""
    out: list[list[int]] = []
    for first, last in sorted(places):
        if out and first <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(int(a), int(b)) for a, b in out]


def units(text: Column | str) -> Column:
    """``text`` in lower case, with spaces around the characters that are words of their own."""
    lower = F.lower(text)
    spaced = F.regexp_replace(lower, f"([{UNSPACED}])", " $1 ")
    # Texts of ASCII alone have none.
    return F.when(F.length(lower) == F.octet_length(lower), lower).otherwise(
        F.regexp_replace(spaced, UNSPACED_MARKS, " ")
    )


def blocks(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """``benchmark`` (item_id, text) and the number of blocks of bounded size that it is cut into."""
    items = pick(benchmark, "item_id", "text").where("text IS NOT NULL").withColumn("text", units("text"))
    size = items.select(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    return items, max(1, -(-size[0] // BLOCK_ITEMS), -(-size[1] // BLOCK_CHARS))


def index_of(items: DataFrame, block: int, of: int) -> Index:
    """The index of one block, whose items alone reach the driver."""
    rows = items.where(F.expr(f"pmod(xxhash64(item_id, text), {of}) = {block}")) if of > 1 else items
    rows = rows.orderBy("item_id", "text").toArrow()
    return Index(rows.column("item_id").combine_chunks(), rows.column("text").combine_chunks())


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, words, distance, last_word)`` of every item found in a document.

    An item of n words is found where some run of the text's words is at most
    floor(EDITS * n) edits of words away; of several places the nearest, then
    the first, counts; so items of one to four words are found unchanged alone.
    Characters of scripts without spaces count as words. Null, empty and wordless
    texts match nothing. Equal rows give equal rows. Items of fewer than
    LEAST_WORDS words are found for certain, longer ones as far as their walks
    hit. A benchmark of several blocks makes a pass over the documents for each, one
    after the other, and the rows of each are written to the shared folder.
    """
    texts = pick(docs, "doc_id", "text").withColumn("text", units("text"))
    ids = [pick(f, c).schema[c].dataType for f, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    schema = (
        f"doc_id {ids[0].simpleString()}, item_id {ids[1].simpleString()},"
        " words long, distance long, last_word long"
    )
    items, n = blocks(benchmark)
    if n == 1:
        return texts.mapInArrow(_match_rows(index_of(items, 0, 1)), schema)
    path = new_table_path(docs.sparkSession, "leaks")
    for b in range(n):
        found = texts.mapInArrow(_match_rows(index_of(items, b, n)), schema)
        found.write.mode("append").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _match_rows(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = list(index.matches(batch.column("text")))
            rows, items, distances, ends = zip(*hits, strict=True) if hits else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    index.ids.take(pa.array(items, pa.int64())),
                    pa.array([len(index.words[i]) for i in items], pa.int64()),
                    pa.array(distances, pa.int64()),
                    pa.array(ends, pa.int64()),
                ],
                names=["doc_id", "item_id", "words", "distance", "last_word"],
            )

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in whose text ``find_leaks`` finds no item, with all their columns.

    Rows with null, empty or wordless texts stay; repeated rows stay or go together;
    an empty benchmark keeps all. After each block but the last what is left is
    written to the shared folder.
    """
    names, place = docs.columns, _place(docs, "text")
    plain, path = docs.toDF(*[f"c{i}" for i in range(len(names))]), None
    items, n = blocks(benchmark)
    for b in range(n):

        def keep(batches, index=index_of(items, b, n)):
            for batch in batches:
                hit = np.zeros(batch.num_rows, dtype=bool)
                hit[[row for row, *_ in index.matches(batch.column("lowered"))]] = True
                yield batch.filter(pa.array(~hit)).select(list(range(batch.num_columns - 1)))

        plain = plain.withColumn("lowered", units(f"c{place}")).mapInArrow(keep, plain.schema)
        if b + 1 < n:
            before = path
            plain, path = stored(plain, "unleaked")
            if before:
                drop_table(docs.sparkSession, before)
    return plain.toDF(*names)


def _place(df: DataFrame, name: str) -> int:
    lower = [c.lower() for c in df.columns]
    return df.columns.index(name) if name in df.columns else lower.index(name)
