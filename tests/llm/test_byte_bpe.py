import base64
import hashlib
import random
import struct

import corpus
import public_tokenizers
import pytest
import tiktoken
from logistra.llm import byte_bpe
from logistra.llm.queries import op13_byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [
    None, "", " ", "\n\n  \t x", "don't we'll I'D", "<|endoftext|>", "a\x00b\x01", "é ñ ü ß 中文 日本語 😀👩‍👩‍👧", "  two  spaces ",
    "x" * 3000, "1234567890" * 50, "▁▁ Ġa", "   　  z", "é", "﻿bom", " line",
]


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(PATH, public_tokenizers.PATTERN)


def reference(path=PATH):
    lines = open(path, "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    letters = "abcdeABC  \n\t.,;'0123éßñ中の😀́"
    made = ["".join(rng.choices(letters, k=rng.randrange(300))) for _ in range(300)]
    return ODD + made + [corpus.prose(rng, 40_000), "the " * 200_000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_ids_are_those_of_tiktoken(spark, name):
    path, rows = public_tokenizers.path(name), texts()
    codec, own = byte_bpe.Codec(path, public_tokenizers.PATTERN), reference(path)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    encoded = byte_bpe.encode(corpus.clashing(docs), codec)
    got = {r.doc_id: r for r in byte_bpe.decode(encoded, codec).collect()}
    arrays = {r.doc_id: r.ids for r in byte_bpe.unpacked(encoded).collect()}
    assert len(got) == len(arrays) == len(rows)
    for i, text in enumerate(rows):
        want = own.encode_ordinary(text or "")
        assert arrays[i] == want
        assert list(struct.unpack(f"<{len(want)}I", got[i].ids)) == want
        assert (got[i].n_tokens, bytes(got[i].decoded)) == (len(want), (text or "").encode())


def test_query(spark, tmp_path):
    corpus.frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    own, want = reference(), []
    for doc_id, text, *_ in corpus.rows():
        ids = own.encode_ordinary(text or "")
        packed, raw = struct.pack(f"<{len(ids)}I", *ids), (text or "").encode()
        want.append((doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(raw).hexdigest()))
    got = op13_byte_bpe(spark, str(tmp_path))
    assert got.dtypes == [
        ("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")
    ]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_empty_table_and_strange_ids(spark, codec):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert byte_bpe.decode(byte_bpe.encode(none, codec), codec).collect() == []
    named = spark.createDataFrame([("a", "x y"), (None, None)], "doc_id string, text string")
    rows = byte_bpe.decode(byte_bpe.encode(named, codec), codec).collect()
    assert {(r.doc_id, bytes(r.decoded)) for r in rows} == {("a", b"x y"), (None, b"")}
    packed = spark.sql("SELECT CAST(NULL AS binary) AS ids, 1 AS decoded_from")
    assert [bytes(r.decoded) for r in byte_bpe.decode(packed, codec).collect()] == [b""]


def test_tokens_that_no_merge_reaches(tmp_path):
    """A pre-token of the vocabulary is one token, as in the library."""
    lines = [bytes([b]) for b in range(256)] + [b"ab", b"abcd", b"xyz"]
    path = tmp_path / "small.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % (3 * i) for i, t in enumerate(lines)))
    own, codec = reference(path), byte_bpe.Codec(str(path), public_tokenizers.PATTERN)
    encoder = codec.encoder()
    for text in ("abcd", "xyz", "abcde xyz abab", "xyzx"):
        ids = own.encode_ordinary(text)
        assert encoder.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_incomplete_vocabularies_are_refused(tmp_path):
    path = tmp_path / "broken.tiktoken"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="every byte"):
        byte_bpe.load_ranks(str(path))
