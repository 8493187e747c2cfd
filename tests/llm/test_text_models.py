"""Language, quality, language-model scores and tokens."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus
from logistra.llm import language_id, lm_score, quality, tokens
from logistra.llm.frames import remainder
from pyspark.sql import functions as F


def test_words_and_shingles():
    texts = [row[1] for row in corpus.rows()] + ["\x00 a\x00", " x", "y "]
    seen = {}
    for w in tokens.words(pa.array(texts, pa.string()), tokens.byte_table()):
        for d in range(len(w.offsets) - 1):
            mine = w.hashes[w.offsets[d] : w.offsets[d + 1]]
            want = corpus.words(texts[w.first + d])
            assert len(mine) == len(want)
            for word, h in zip(want, mine.tolist()):
                assert seen.setdefault(word, h) == h
            found = len(set(tokens.shingles(mine, 3).tolist()))
            assert found == len(corpus.shingles(texts[w.first + d], 3))
    assert len(set(seen.values())) == len(seen)


def test_long_text_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = " ".join(corpus.prose(rng, 50) for _ in range(40)) + " " + "x" * 5000 + "\t" + corpus.prose(rng, 300)
    column = pa.array(["a b", text, "", text + " "])
    whole = [w.hashes.tolist() for w in tokens.words(column, tokens.byte_table())]
    monkeypatch.setattr(tokens, "CHUNK", 1000)
    pieces = list(tokens.words(column, tokens.byte_table()))
    assert sum((w.hashes.tolist() for w in pieces), []) == sum(whole, [])
    for w in pieces:
        found = [bytes(w.raw[a:b]).decode() for a, b in zip(w.starts, w.ends)]
        docs = [column[w.first + d].as_py() for d in range(len(w.offsets) - 1)]
        assert found == [word for d in docs for word in d.split()]
        assert w.offsets[-1] == len(found)


def lingual(n=120):
    rng = random.Random(2)
    sounds = {"aa": "ka lo mi tu", "bb": "schl arf und gro", "cc": "ção não mé lha"}
    out = []
    for i in range(n):
        lang = rng.choice(sorted(sounds))
        parts = sounds[lang].split()
        text = " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(25))
        out.append((i, text if i % 5 else text.upper(), lang if i % 11 else None, "s", 0))
    return out + [(n, None, "aa", "s", 0), (n + 1, "12 34 !!", "aa", "s", 0), (n + 2, "", "bb", "s", 0),
                  (None, "kalo mitu", None, None, None), out[1]]


def test_languages(spark):
    table = lingual()
    got = language_id.identify(corpus.clashing(corpus.frame(spark, table))).collect()
    assert len(got) == len(table)
    truth = {row[0]: row for row in table}
    for r in got:
        _, text, lang, _, _ = truth[r.doc_id]
        assert 0 <= r.score <= 1
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif lang:
            assert r.lang_pred == lang


def test_code_length_is_that_of_the_context_tree():
    texts = ["abab abba", "aab", "b" * 9]
    runs = []
    for t in texts:
        raw = ("   " + t).encode()
        runs += [int.from_bytes(raw[i : i + 4], "big") for i in range(len(raw) - 3)]
    values, n = np.unique(runs, return_counts=True)
    model = language_id.Model({"x": (values, n)})
    table = {}
    for run, count in zip(values.tolist(), n.tolist()):
        b = run.to_bytes(4, "big")
        for k in range(4):
            table.setdefault(b[3 - k : 3], Counter())[b[3]] += count

    def bits(history, byte):
        cost = 0.0
        for k in range(3, -1, -1):
            seen = table.get(history[3 - k :])
            if not seen or (k and sum(seen.values()) < language_id.LEAST_COUNT):
                continue
            total, kinds = sum(seen.values()), len(seen)
            if byte in seen:
                return cost - math.log2(seen[byte] / (total + kinds))
            cost -= math.log2(kinds / (total + kinds))
        return cost + 8

    for text in ["abba", "ba ab", "zzz", ""]:
        raw = ("   " + text).encode()
        want = sum(bits(raw[i : i + 3], raw[i + 3]) for i in range(len(text)))
        assert model.code_lengths(pa.array([text]))[0, 0] == pytest.approx(want, abs=1e-4)


def test_pieces_change_no_code_length(monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choices("abc é中", k=rng.randrange(0, 60))) for _ in range(40)] + ["", None, "x" * 500]
    raw = [("   " + (t or "")).encode() for t in texts]
    runs = [int.from_bytes(r[i : i + 4], "big") for r in raw for i in range(len(r) - 3)]
    model = language_id.Model({"x": np.unique(runs, return_counts=True), "y": (np.array([5]), np.array([9]))})
    column = pa.array(["skipped", *texts])[1:]
    whole = model.code_lengths(column)
    alone = np.concatenate([model.code_lengths(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, alone, atol=1e-3)
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(language_id.tokens, "CHUNK", size)
        assert np.allclose(whole, model.code_lengths(column), atol=1e-3)


def test_rare_languages_keep_their_runs(spark, monkeypatch):
    """One of forty languages has a few short texts, amid languages of thousands of runs."""
    monkeypatch.setattr(language_id, "MOST_RUNS", 60)
    rng = random.Random(9)
    table, n = [], 0
    for lang in range(40):
        sounds = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöüßéèçñ中文日本кириллица", k=3)) for _ in range(6)]
        for _ in range(2 if lang == 7 else 12):
            text = " ".join(rng.choice(sounds) for _ in range(15 if lang == 7 else 60))
            table.append((n, text, f"l{lang:02}", "s", 0))
            n += 1
    model = language_id.train(corpus.frame(spark, table))
    assert len(model.langs) == 40
    got = {r.doc_id: r.lang_pred for r in language_id.predict(corpus.frame(spark, table), model).collect()}
    assert sum(got[i] == lang for i, _, lang, *_ in table) >= 0.97 * n
    assert all(got[i] == lang for i, _, lang, *_ in table if lang == "l07")


def test_a_long_text_takes_little_memory():
    import tracemalloc

    runs = {f"l{i}": np.unique(np.random.default_rng(i).integers(0, 1 << 32, 2000), return_counts=True) for i in range(40)}
    model = language_id.Model(runs)
    column = pa.array(["the quick brown fox " * 400_000])
    tracemalloc.start()
    model.code_lengths(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000


def graded(n=400):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        text = corpus.prose(rng, rng.randrange(1, 60))
        if not good:
            text = text.upper().replace(" ", "!! ") + "!!"
        docs.append((i, text, "en", "s", 0))
        labels.append((i, int(good), 0))
    docs += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), docs[2], (None, "x", "en", "s", 0)]
    labels += [(n, None, None), (None, 1, 0), labels[3]]
    return docs, labels


def test_quality(spark):
    docs, labels = graded()
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(corpus.clashing(corpus.frame(spark, docs)), corpus.clashing(said)).collect()
    assert len(got) == len(docs)
    truth = dict((i, q) for i, q, _ in labels)
    judged = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and truth.get(r.doc_id) is not None]
    assert len(judged) > 50 and sum(a == b for a, b in judged) >= 0.97 * len(judged)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


@pytest.mark.parametrize("label, score", [([], 0.5), ([(1, 1, 0)], 1.0), ([(1, 0, 0)], 0.0)])
def test_quality_without_two_classes(spark, label, score):
    said = spark.createDataFrame(label, "doc_id long, quality int, toxic int")
    docs = corpus.frame(spark, [(1, "a b", "en", "s", 3), (2, None, None, None, None)])
    model = quality.train(docs, said.withColumnRenamed("quality", "label"))
    assert {r.score for r in quality.score(docs, model).collect()} == {score}
    assert quality.good_documents(docs, model).count() == (2 if score >= 0.3 else 0)


def test_empty_tables(spark):
    none = spark.createDataFrame([], corpus.SCHEMA)
    said = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert language_id.identify(none).collect() == []
    assert quality.classify(none, said).collect() == []
    assert lm_score.score(none, said).collect() == []


def test_folds(spark):
    import zlib

    ids = spark.createDataFrame([(i,) for i in [0, 1, 77, -5, None]], "doc_id long")
    got = {r.doc_id: r.m for r in ids.select("doc_id", remainder(F.col("doc_id"), 5).alias("m")).collect()}
    assert got == {i: 0 if i is None else zlib.crc32(str(i).encode()) % 5 for i in got}


def test_lm_score(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "VOCABULARY", 50)
    monkeypatch.setattr(lm_score, "HELD_WORDS", 1000)
    table = corpus.rows()
    target = {row[0] for row in table[::3] if row[0] is not None}
    ids = spark.createDataFrame([(i,) for i in [*target, *target, None]], "doc_id long")
    got = lm_score.score(corpus.clashing(corpus.frame(spark, table)), ids).collect()
    lists = [corpus.words(row[1]) for row in table]
    counts = Counter(w for ws in lists for w in ws)
    hashes = {w: int(h) for x in tokens.words(pa.array([" ".join(counts)]), tokens.byte_table())
              for w, h in zip(counts, x.hashes.view("int64"))}
    vocab = set(sorted(counts, key=lambda w: (-counts[w], hashes[w]))[:50])

    def bigrams(ws):
        known = [w if w in vocab else "" for w in ws]
        return list(zip(["", *known], known))

    every, chosen = Counter(), Counter()
    for row, ws in zip(table, lists):
        every.update(bigrams(ws))
        if row[0] in target:
            chosen.update(bigrams(ws))

    def model(seen, f):
        total, kinds, single = Counter(), Counter(), Counter()
        for (u, w), n in seen.items():
            total[u] += n * f
            kinds[u] += min(1, n * f)
            single[w] += n * f
        size = sum(single.values()) + 51
        return lambda u, w: -math.log2(
            (seen[u, w] * f + (kinds[u] + 1) * (single[w] + 1) / size) / (total[u] + kinds[u] + 1)
        )

    models = model(chosen, 1.0), model(every, sum(chosen.values()) / sum(every.values()))
    want = Counter()
    for row, ws in zip(table, lists):
        loss = [sum(m(*b) for b in bigrams(ws)) / len(ws) if ws else None for m in models]
        want[row[0], len(ws), *(x if x is None else round(x, 3) for x in loss)] += 1
    found = Counter(
        (r.doc_id, r.n_words, *(x if x is None else round(x, 3) for x in (r.target_loss, r.background_loss)))
        for r in got
    )
    assert sum((want - found).values()) <= 2  # rounding at a half
    assert all(r.difference is None or abs(r.difference - r.target_loss + r.background_loss) < 1e-9 for r in got)


def test_lm_score_tells_all_words_apart(spark, monkeypatch):
    """Words far behind 2,047 more frequent ones, by lookup and by join alike."""
    many = " ".join(f"w{i}" for i in range(2100))
    table = [(i, many, "en", "s", 0) for i in range(3)]
    table += [(10, "ka lo ka lo mi", "xx", "s", 0), (11, "lo mi ka lo", "xx", "s", 0),
              (20, "schl arf schl arf gro", "yy", "s", 0), (21, None, "yy", "s", 0), (10, "ka lo ka lo mi", "xx", "s", 0)]
    ids = spark.createDataFrame([(10,), (0,)], "doc_id long")

    def scores():
        found = lm_score.score(corpus.frame(spark, table), ids).collect()
        return sorted(
            (r.doc_id, r.n_words, *(round(x, 4) for x in (r.target_loss, r.background_loss) if x is not None))
            for r in found
        )

    looked_up = scores()
    by_id = {r[0]: r for r in looked_up}
    lists = [corpus.words(row[1]) for row in table]
    pairs = [list(zip(["", *ws], ws)) for ws in lists]
    seen = Counter(b for row, bs in zip(table, pairs) if row[0] in (0, 10) for b in bs)
    size = sum(seen.values()) + len({w for ws in lists for w in ws})

    def bits(u, w):
        kinds = sum(a == u for a, _ in seen) + 1
        single = (sum(n for (_, b), n in seen.items() if b == w) + 1) / size
        return -math.log2((seen[u, w] + kinds * single) / (sum(n for (a, _), n in seen.items() if a == u) + kinds))

    for row, bs in zip(table, pairs):
        if row[0] in (10, 11, 20):
            assert by_id[row[0]][2] == pytest.approx(sum(bits(*b) for b in bs) / len(bs), abs=1e-3)
    monkeypatch.setattr(lm_score, "HOT_PAIRS", 1)
    monkeypatch.setattr(lm_score, "HOT_WORDS", 4)
    assert scores() == looked_up and len(looked_up) == len(table)


def new_bytes(spark, job):
    """Bytes of the files that ``job`` leaves in Spark's local folders and in the shared one."""
    from pathlib import Path

    from logistra.storage import shared_dir

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [Path(d.getPath()) for d in blocks.localDirs()]
    folders.append(Path(shared_dir(spark).removeprefix("file:")))
    files = lambda: {f: f.stat().st_size for d in folders for f in d.rglob("*") if f.is_file()}
    before = files()
    job()
    return sum(size for f, size in files().items() if f not in before)


def test_lm_score_disk(spark):
    """Nearly every bigram occurs once; each was stored and shuffled several times."""
    rng = random.Random(3)
    known = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(30_000)]
    texts = [" ".join(known[int(30_000 * rng.random() ** 3)] for _ in range(500)) for _ in range(1000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(0, 1000, 3)], "doc_id long")
    took = new_bytes(spark, lambda: lm_score.score(docs, ids).write.format("noop").mode("overwrite").save())
    assert took <= 4 * sum(map(len, texts))


def test_lm_score_of_any_blocks_and_buckets(spark, monkeypatch):
    """One block or many, few buckets or many, frequent words dealt over several: one result."""
    table = corpus.rows()
    ids = spark.createDataFrame([(row[0],) for row in table[::3]], "doc_id long")

    def scores():
        found = lm_score.score(corpus.frame(spark, table), ids).collect()
        return Counter((r.doc_id, r.n_words, *(x if x is None else round(x, 5) for x in r[2:])) for r in found)

    whole = scores()
    monkeypatch.setattr(lm_score, "HELD_WORDS", 500)
    monkeypatch.setattr(lm_score, "BUCKET_WORDS", 1 << 10)
    monkeypatch.setattr(lm_score, "HOT_PAIRS", 20)
    assert sum((whole - scores()).values()) <= 2  # rounding at a half
    monkeypatch.setattr(lm_score, "HOT_WORDS", 1)
    assert sum((whole - scores()).values()) <= 2


def test_packed():
    from logistra.llm import packed

    values = np.array([0, 1, 127, 128, 0, 16383, 16384, 1 << 40, (1 << 62) + 5])
    cuts = np.array([0, 0, 4, 9])
    rows = pa.chunked_array([packed.packed(values, cuts)])
    assert [packed.unpack(r).tolist() for r in rows.to_pylist()] == [[], [0, 1, 127, 128], values[4:].tolist()]
    assert packed.lengths(rows).tolist() == [0, 4, 5]
    assert packed.unpack(packed.joined(rows)).tolist() == values.tolist()
