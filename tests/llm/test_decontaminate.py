import random

import corpus
import pyarrow as pa
import pytest
from logistra.llm import decontaminate


def distance(pattern, text):
    """Least number of word edits between the pattern and a run of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def fixture():
    rng = random.Random(9)
    items = [(i, corpus.prose(rng, rng.randrange(8, 60))) for i in range(40)]
    items += [(40, None), (41, ""), (42, "too short"), (43, items[0][1])]
    docs = []
    for n in range(300):
        body = corpus.prose(rng, rng.randrange(0, 200)).split(" ")
        if n % 2:
            _, text = items[rng.randrange(40)]
            size = len(text.split())
            leak = corpus.edited(rng, text, rng.randrange(0, size // 10 + 1))
            at = rng.randrange(len(body) + 1)
            body[at:at] = [leak.upper() if n % 4 == 1 else leak.replace(" ", ", ")]
        docs.append((n, " ".join(body), "en", "a", 0))
    docs += [(300, None, None, None, None), (301, "", "en", "a", 0), docs[1], docs[1]]
    docs.append((None, items[3][1], "en", "a", 0))
    return docs, items


def brute(docs, items):
    out = set()
    for doc in docs:
        text = (doc[1] or "").lower().replace(",", "").split()
        for item, passage in items:
            pattern = (passage or "").split()
            if len(pattern) >= 8 and (d := distance(pattern, text)) <= int(0.2 * len(pattern)):
                out.add((doc[0], item, d))
    return out


def test_finds_what_edit_distance_finds(spark):
    docs, items = fixture()
    benchmark = corpus.clashing(spark.createDataFrame(items, "item_id long, text string"))
    found = decontaminate.find_leaks(corpus.clashing(corpus.frame(spark, docs)), benchmark).collect()
    got, want = {(r.doc_id, r.item_id, r.distance) for r in found}, brute(docs, items)
    assert got <= want
    assert len(got) >= 0.97 * len(want)
    exact = {x for x in want if x[2] == 0}
    assert exact <= got
    assert sum(r.doc_id == 1 for r in found) == 3 * len({x for x in got if x[0] == 1})


def test_rows_without_leaks_stay_whole(spark, monkeypatch):
    docs, items = fixture()
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 10)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.without_leaks(corpus.frame(spark, docs), benchmark).collect()
    leaking = {x[0] for x in brute(docs, items)}
    clean = [d for d in docs if d[0] not in leaking]
    assert {tuple(r) for r in kept} >= set(clean)
    assert len(kept) <= len(clean) + 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], corpus.SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    docs = corpus.frame(spark)
    assert decontaminate.find_leaks(none, items).collect() == []
    assert decontaminate.find_leaks(docs, items).collect() == []
    assert decontaminate.without_leaks(docs, items).count() == docs.count()


def changed(rng, words, edits):
    """As many words replaced, put in or taken out."""
    out = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        out[at : at + (kind != 1)] = [] if kind == 2 else [rng.choice(corpus.VOCABULARY)]
    return out


def leaks(size, n, seed):
    """Items, and a text for each with as many random edits as count, amid other words."""
    rng = random.Random(seed)
    items = [corpus.prose(rng, size).split() for _ in range(n)]
    edits = int(0.2 * size)
    docs = [
        corpus.prose(rng, 50) + " " + " ".join(changed(rng, i, edits)) + " " + corpus.prose(rng, 30)
        for i in items
    ]
    # A leak may begin a text and follow on another.
    docs += [" ".join(changed(rng, i, edits)) for i in items]
    return decontaminate.Index(pa.array(range(n)), pa.array([" ".join(i) for i in items])), docs


@pytest.mark.parametrize("size", [8, 10, 12, 14, 17, 20, 30, 60, 120, 300, 600])
def test_walks_find_leaks_of_the_most_edits(size):
    """By the walks alone: items of so many words have no pieces."""
    n = min(200, 6000 // size)
    index, docs = leaks(size, n, size)
    assert index.pieces == []
    found = {(row, item) for row, item, *_ in index.matches(pa.array(docs, pa.string()))}
    own = {(row, row % n) for row in range(2 * n)}
    # Few words are near to other items too.
    assert len(found & own) >= (0.97 if size < 20 else 0.99) * len(own)
    if size >= 20:
        assert found <= own


@pytest.mark.parametrize("size", [5, 6, 7])
def test_pieces_find_all_leaks_of_short_items(size):
    index, docs = leaks(size, 100, size)
    assert len(index.items) == 0
    found = {(row, item) for row, item, *_ in index.matches(pa.array(docs, pa.string()))}
    assert {(row, row % 100) for row in range(200)} <= found


def test_common_pieces_are_no_candidates():
    """Of thousands of places of a frequent pair only those that may be a leak are verified."""
    index = decontaminate.Index(pa.array([1]), pa.array(["of the old red house"]))
    text = " ".join(f"of the word{i}" for i in range(5000)) + " of the old red mouse"
    (w,) = decontaminate.tokens.words(pa.array([text]), decontaminate.tokens.byte_table(letters_only=True))
    assert len(index.unchanged(w)) == 1
    assert [(r[0], r[1], r[2]) for r in index.matches(pa.array([text]))] == [(0, 0, 1)]


def test_index_stays_small():
    import pickle

    rng = random.Random(2)
    items = [corpus.prose(rng, rng.randrange(8, 690)) for _ in range(48)]
    index = decontaminate.Index(pa.array(range(48)), pa.array(items))
    assert len(pickle.dumps(index)) < 150 * sum(map(len, items))


def test_ids_of_any_type_and_blocks(spark, monkeypatch):
    docs, items = fixture()
    want = {(f"d{d}" if d is not None else None, f"i{i}", x) for d, i, x in brute(docs, items)}
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 10)
    named = [(None if d[0] is None else f"d{d[0]}", *d[1:]) for d in docs]
    table = corpus.frame(spark, named, corpus.SCHEMA.replace("doc_id long", "doc_id string"))
    benchmark = spark.createDataFrame([(f"i{i}", t) for i, t in items], "item_id string, text string")
    found = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.find_leaks(table, benchmark).collect()}
    assert {x for x in found if x[1] != "i42"} == want


def test_finds_short_items_and_scripts_without_spaces(spark):
    items = [
        (1, "Seven"), (2, "blue moon rising"), (3, "who wrote the old book"), (4, "the first of all the kings"),
        (5, "中华人民共和国成立于一九四九年十月一日。"), (6, "東京は日本の首都です"), (7, "กรุงเทพมหานครเป็นเมืองหลวง"), (8, "。、"),
    ]
    docs = [
        "one two seven, eight", "a Blue moon, rising here", "a blue sky rising here", "now who wrote an old book then",
        "who wrote this old novel", "x the first of the kings", "他说中华人民共和国成立於一九四九年十月一日,是",
        "昔、大阪は日本の大都市です", "昔、東京は日本の首府です。", "วันนี้กรุงเทพมหานครเป็นเมืองหลวงของ", "北京。、",
    ]
    want = {(0, 1, 0), (1, 2, 0), (3, 3, 1), (5, 4, 1), (6, 5, 1), (8, 6, 1), (9, 7, 0)}
    table = [(i, text, "en", "a", 0) for i, text in enumerate(docs)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(corpus.frame(spark, table), benchmark).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in found} == want
    kept = decontaminate.without_leaks(corpus.frame(spark, table), benchmark).collect()
    assert {r.doc_id for r in kept} == set(range(len(docs))) - {d for d, *_ in want}
    alone = decontaminate.find_leaks(corpus.frame(spark, table), benchmark.where("item_id = 1")).collect()
    assert [(r.doc_id, r.words, r.last_word) for r in alone] == [(0, 1, 2)]
