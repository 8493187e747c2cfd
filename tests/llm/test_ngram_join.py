from collections import Counter

import pytest

import corpus
from logistra.llm import ngram_join
from logistra.llm.ngram_join import Rule


def brute(table, k, num):
    """(size, smallest id of the component) of every row, by comparing all pairs of sets."""
    sets = [corpus.shingles(row[1], k) for row in table]
    kinds = sorted({s for s in sets if s}, key=lambda s: sorted(map(str, s)))
    parent = list(range(len(kinds)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(kinds):
        for j in range(i):
            inter = len(a & kinds[j])
            if 100 * inter >= num * len(a | kinds[j]):
                parent[find(i)] = find(j)
    root = {s: find(i) for i, s in enumerate(kinds)}
    smallest = {}
    for row, s in zip(table, sets):
        if s and row[0] is not None:
            smallest[root[s]] = min(smallest.get(root[s], row[0]), row[0])
    component = [smallest.get(root[s]) if s else row[0] for row, s in zip(table, sets)]
    return sets, component, [smallest.get(r) for r in set(root.values())]


@pytest.mark.parametrize("k, num, spare", [(3, 90, 0.5), (5, 80, 0.25), (2, 50, 1.0)])
@pytest.mark.parametrize("bucket", [32, 4])
def test_components(spark, monkeypatch, k, num, spare, bucket):
    monkeypatch.setattr(ngram_join, "SMALL_BUCKET", bucket)
    monkeypatch.setattr(ngram_join, "LEFT_TOKENS", 500 if bucket == 4 else 400_000)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0 if bucket == 4 else 1_000_000)
    table = corpus.rows()
    sets, component, _ = brute(table, k, num)
    rule = Rule(k, num, 100, spare)
    got = ngram_join.join_components(corpus.clashing(corpus.frame(spark, table)), rule).collect()
    want = Counter((row[0], len(s), c) for row, s, c in zip(table, sets, component))
    assert Counter(map(tuple, got)) == want


def test_one_of_each(spark):
    table = corpus.rows()
    rule = Rule(3, 90, 100)
    sets, _, smallest = brute(table, 3, 90)
    kept = ngram_join.one_of_each(corpus.frame(spark, table), rule)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = kept.collect()
    empty = [row for row, s in zip(table, sets) if not s]
    assert Counter(map(tuple, (r for r in rows if not corpus.words(r.text)))) == Counter(empty)
    assert sorted(r.doc_id for r in rows if corpus.words(r.text)) == sorted(smallest)


def test_empty_table(spark):
    none = spark.createDataFrame([], corpus.SCHEMA)
    assert ngram_join.join_components(none).collect() == []
    assert ngram_join.one_of_each(none).collect() == []
