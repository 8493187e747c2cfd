import math
import random
import re

import corpus
import numpy as np
import pytest
from logistra.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k):
    """(item_id, rank, doc_id, score) rows by scoring every document."""
    found = [(row[0], terms(row[1])) for row in docs]
    documents, words = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    out = []
    for item_id, text in items:
        wanted = set(terms(text))
        df = {t: sum(t in set(doc) for _, doc in found) for t in wanted}
        scored = []
        for doc_id, doc in found:
            if not (held := wanted & set(doc)):
                continue
            m = 100 - 50 + (50 * len(doc) * documents) // words
            score = 0
            for t in held:
                w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))
                tf = doc.count(t)
                score += w * ((1000000000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, none, doc_id) in enumerate(sorted(scored)[:k], 1):
            out.append((item_id, rank, None if none else doc_id, -score))
    return sorted(out, key=repr)


def fixture():
    rng = random.Random(11)
    docs = corpus.rows()
    # Ties: equal texts under many ids, and words that nearly all documents hold.
    docs += [(5000 + i, "tied words W1 w2, w3", "en", "a", 1) for i in range(70)]
    docs += [(6000 + i, "w1 w2 " * rng.randrange(1, 5) + "w4_w5 É", "en", "a", 1) for i in range(60)]
    items = [(i, corpus.prose(rng, rng.randrange(1, 60))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "... --"), (33, "unheard"), (34, "tied"), (35, "É w1 w1 w1"), (None, "w7 w8")]
    items += [items[0], (0, "w9 another text of the same id")]
    return docs, items


@pytest.mark.parametrize("words, block", [(4_000_000, 4096), (500, 4096), (500, 7)])
def test_against_every_document(spark, monkeypatch, words, block):
    monkeypatch.setattr(ranked_search, "SEGMENT_WORDS", words)
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", block)
    docs, items = fixture()
    table = corpus.clashing(spark.createDataFrame(items, "item_id long, text string").repartition(3))
    found = ranked_search.search(corpus.clashing(corpus.frame(spark, docs)), table)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, items, 50)


def test_few_best_and_other_ids(spark):
    docs, items = fixture()
    named = [(None if row[0] is None else f"{row[0]:06}", *row[1:]) for row in docs]
    table = corpus.frame(spark, named, corpus.SCHEMA.replace("doc_id long", "doc_id string"))
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in items[:5]], "item_id string, text string")
    got = sorted((r.item_id, r.rank, r.doc_id, r.score) for r in ranked_search.search(table, queries, 3).collect())
    want = brute(docs, items[:5], 3)
    assert got == sorted((f"q{i}", rank, f"{doc:06}", score) for i, rank, doc, score in want)
    with pytest.raises(ValueError, match="at least one"):
        ranked_search.search(table, queries, 0)


def test_empty_tables(spark):
    none = spark.createDataFrame([], corpus.SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert ranked_search.search(none, items).collect() == []
    assert ranked_search.search(none, some).collect() == []
    assert ranked_search.search(corpus.frame(spark), items).collect() == []


def test_reads_stop_early_and_lose_nothing():
    """Lists with steps, ties and long tails: every document at or above the k-th score is found."""
    rng = np.random.default_rng(5)
    for trial in range(200):
        size, k = int(rng.integers(1, 300)), int(rng.integers(1, 30))
        lists, full = [], np.zeros(size, dtype=np.int64)
        for _ in range(rng.integers(0, 9)):
            docs = rng.choice(size, int(rng.integers(1, size + 1)), replace=False)
            impacts = rng.integers(1, [3, 1000, 10**12][trial % 3], len(docs))
            order = np.argsort(-impacts, kind="stable")
            lists.append((docs[order], -impacts[order]))
            full[docs] += impacts
        carried = np.sort(rng.integers(1, 5, rng.integers(0, k + 1)))[::-1]
        docs, scores = ranked_search.best_of(lists, size, k, carried)
        assert (full[docs] == scores).all()
        held = np.sort(np.concatenate([carried, full[full > 0]]))[::-1]
        least = held[k - 1] if len(held) >= k else 1
        assert set(np.flatnonzero(full >= least)) <= set(docs.tolist())
