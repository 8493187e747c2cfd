"""Byte-level BPE through sentencepiece, encoding and decoding.

A tiktoken vocabulary (a base64 token and its rank per line) is written out as a
serialised sentencepiece BPE model, without training: every byte becomes one
printable character, the piece of a token is the string of its bytes' characters
and its score is the negative rank, so the merge of lowest rank is always the
best one. The model's normaliser changes nothing. Texts are cut into pre-tokens
by the vocabulary's pattern and each is encoded on its own; ids are decoded
by the inverse of the byte map.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from logistra.llm import tokens
from logistra.llm.frames import pick

# Ids are stored as little-endian unsigned 32-bit integers.
ID_BYTES = 4
# Pre-tokens whose ids a task remembers, and bytes of a pre-token worth it.
REMEMBERED, SHORT = 1 << 18, 64
# Pre-tokens of one text, or ids, that are worked on at a time.
RUN = 1 << 17
# Fixed values of sentencepiece's model format: message ModelProto has pieces (1),
# trainer (2) and normaliser (3); a piece has text (1), score (2) and type (3).
NORMAL, UNKNOWN, BPE = 1, 2, 2


def byte_characters() -> list[str]:
    """One printable character per byte: printable Latin-1 stands for itself, the rest follows 255."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks; a vocabulary without all single bytes is refused."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path} does not hold every byte")
    if len({*ranks.values()}) != len(ranks):
        raise ValueError(f"{path} repeats a rank")
    return ranks


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _float(field: int, value: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model: piece k is the token of the k-th lowest rank, the last one unknown."""
    characters = byte_characters()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _bytes(1, _bytes(1, text.encode()) + _float(2, score) + _number(3, kind))

    ordered = sorted(ranks, key=ranks.__getitem__)
    pieces = [piece("".join(characters[b] for b in t), -ranks[t], NORMAL) for t in ordered]
    # No token maps to a space, since the space byte has another character.
    pieces.append(piece(" ", 0.0, UNKNOWN))
    trainer = _number(3, BPE) + _number(40, len(ordered))
    # No rules, no space in front, no spaces removed, none replaced.
    normaliser = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normaliser)


class Codec:
    """What a task needs of a vocabulary: model and pattern; pickled as the model's bytes."""

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.pattern = pattern
        self.model = serialised_model(ranks)
        self.ids = np.array(sorted(ranks.values()), dtype=np.uint32)

    def table(self) -> list[bytes]:
        """The bytes of every piece, by the inverse of the byte map."""
        import sentencepiece

        back = {c: b for b, c in enumerate(byte_characters())}
        model = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        return [bytes(back[c] for c in model.id_to_piece(k)) for k in range(len(self.ids))]

    def encoder(self) -> _Encoder:
        return _Encoder(self)


class _Encoder(dict):
    """Pre-token to the packed ids of its tokens; short ones are remembered."""

    def __init__(self, codec: Codec):
        import regex
        import sentencepiece

        super().__init__()
        self.find = regex.compile(codec.pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=codec.model)
        self.ids = codec.ids.astype("<u4")
        self.characters = {b: c for b, c in enumerate(byte_characters())}
        self.whole = {token: k for k, token in enumerate(codec.table())}

    def __missing__(self, pre_token: str) -> bytes:
        raw = pre_token.encode()
        # A pre-token that is a token is that token, whether merges lead to it or not.
        k = self.whole.get(raw)
        pieces = [k] if k is not None else self.model.encode(raw.decode("latin-1").translate(self.characters))
        packed = self.ids[pieces].tobytes()
        if len(raw) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[pre_token] = packed
        return packed

    def encode(self, text: str) -> bytes:
        if len(text) <= RUN:
            return b"".join(map(self.__getitem__, self.find.findall(text)))
        found, parts = (m.group() for m in self.find.finditer(text)), []
        while part := b"".join(map(self.__getitem__, islice(found, RUN))):
            parts.append(part)
        return b"".join(parts)


def encode(docs: DataFrame, codec: Codec) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every row of ``docs`` (doc_id, text).

    ``ids`` are packed as little-endian unsigned 32-bit integers, as token files for
    training hold them. Null and empty texts have no tokens; white space and
    any characters are kept, and strings of special tokens are ordinary
    text. Equal rows give equal rows. A text is read run by run, so beside
    the text and its ids a task holds little.
    """
    texts = pick(docs, "doc_id", "text")
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec.encoder()
        for batch in batches:
            raw, bounds = tokens.buffers(batch.column("text"))
            for first, last in tokens.chunks(bounds):
                packed = [
                    encoder.encode(raw[a:b].tobytes().decode("utf-8", "replace"))
                    for a, b in zip(bounds[first:last], bounds[first + 1 : last + 1], strict=True)
                ]
                counts = [len(p) // ID_BYTES for p in packed]
                ids = batch.column("doc_id").slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(counts, pa.int64()), pa.array(packed, pa.binary())],
                    names=["doc_id", "n_tokens", "ids"],
                )

    return texts.mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids binary")


def decode(encoded: DataFrame, codec: Codec) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes that packed ``ids`` stand for.

    Null ids decode to nothing; an id that the vocabulary does not hold fails the task. The
    bytes of an encoded text are the text's.
    """
    names = encoded.columns
    place = names.index("ids")
    plain = encoded.toDF(*[f"c{i}" for i in range(len(names))])
    schema = StructType([*plain.schema.fields, StructField("decoded", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = dict(zip(codec.ids.tolist(), codec.table(), strict=True)).__getitem__
        for batch in batches:
            packed = batch.column(place).cast(pa.large_binary()).fill_null(b"")
            sizes = np.array([len(p.as_buffer()) for p in packed], dtype=np.int64)
            for first, last in tokens.chunks(np.concatenate([[0], np.cumsum(sizes)])):
                texts = []
                for value in packed.slice(first, last - first):
                    ids = np.frombuffer(value.as_buffer(), dtype="<u4")
                    runs = [
                        b"".join(map(words, ids[at : at + RUN].tolist()))
                        for at in range(0, len(ids), RUN)
                    ]
                    texts.append(b"".join(runs))
                columns = [c.slice(first, last - first) for c in batch.columns]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(texts, pa.binary())], names=schema.names
                )

    return plain.mapInArrow(run, schema).toDF(*names, "decoded")


def unpacked(encoded: DataFrame) -> DataFrame:
    """``encoded`` with ``ids`` as an array of numbers instead of packed bytes."""
    names = encoded.columns
    place = names.index("ids")
    fields = [f"`{n}` {encoded.schema[n].dataType.simpleString()}" for n in names]
    fields[place] = "`ids` array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [
                None if p is None else np.frombuffer(p, dtype="<u4").astype(np.int64)
                for p in batch.column(place).to_pylist()
            ]
            columns = list(batch.columns)
            columns[place] = pa.array(values, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return encoded.mapInArrow(run, ", ".join(fields))
