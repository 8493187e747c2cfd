"""Small corpora with every odd case: nulls, empty and long texts, copies, repeated rows."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
VOCABULARY = [f"w{i}" for i in range(400)]


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text, k):
    w = words(text)
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(rng, text, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
    return " ".join(w)


def rows(seed=5):
    """Families of copies and near copies, a passage that many share, and odd rows."""
    rng = random.Random(seed)
    out, passage = [], prose(rng, 60)
    family = prose(rng, 120)
    for k in range(50):
        out.append(edited(rng, family, rng.randrange(5)))
    for k in range(45):
        out.append(prose(rng, rng.randrange(5, 90)) + "\n" + passage)
    for k in range(60):
        base = prose(rng, rng.randrange(1, 150))
        out += [base] * rng.choice([1, 1, 2, 3])
        out.append(edited(rng, base, 1))
    out += ["", "  \t\n ", "one", "one", "One two", "one two", "a b c", "A B C", None, None]
    out.append(prose(rng, 30_000))
    out.append("é ñ ü " * 20)
    rng.shuffle(out)
    ids = list(range(10, 10 + 3 * len(out), 3))
    table = [
        (i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), len(t or ""))
        for i, t in zip(ids, out)
    ]
    # Repeated rows, one id with two texts, and rows without an id.
    table += [table[0], table[0], table[3]]
    table.append((table[5][0], "another text of the same id " + prose(rng, 40), "en", "a", 1))
    table += [(None, family, "en", "a", 1), (None, None, None, None, None)]
    return table


def frame(spark, table=None, schema=SCHEMA):
    return spark.createDataFrame(rows() if table is None else table, schema).repartition(5)


def clashing(df):
    """With extra columns whose names differ by case alone or are used inside."""
    from pyspark.sql import functions as F

    extra = ["TEXT", "size", "cid", "token", "n", "Doc_Id", "position", "features", "w", "label"]
    return df.select("*", *[F.lit(1).alias(c) for c in extra])
