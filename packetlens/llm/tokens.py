"""Encoding with a public byte-level BPE vocabulary through a sentencepiece model.

The model is written directly from the vocabulary: every token becomes a piece (its bytes
mapped to printable characters), scored by its negative rank, without any normalisation.
Texts are cut into pre-tokens first; each distinct pre-token is encoded once per worker.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections import ChainMap
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("PACKETLENS_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
#: fixed value: the public pre-tokenisation pattern of the byte-level vocabularies
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: the same for texts without any other characters, for the faster matcher (whose \s has U+001C to U+001F too)
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"
#: Distinct pre-tokens remembered per Python worker before the memory is emptied.
CACHE_SIZE = 400_000
#: Pre-tokens longer than this are not remembered.
CACHE_LENGTH = 64


def byte_characters() -> list[str]:
    """One printable character per byte: itself where printable, else from U+0100 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value) -> bytes:
    """One protobuf field: bytes, float or integer."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def serialize_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ``i`` is the token of rank ``i``.

    The unknown piece that the format asks for takes the first free id and can never be
    produced, as every single byte is a piece.
    """
    shown = byte_characters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        text = "".join(shown[b] for b in token).encode()
        out += _field(1, _field(1, text) + _field(2, float(-rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    trainer += _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, bytes(trainer)) + _field(3, bytes(normalizer)))


def load_vocabulary(path: str) -> list[bytes]:
    """Tokens in order of rank from a ``.tiktoken`` file."""
    with open(path, "rb") as handle:
        return parse_vocabulary(handle.read())


def parse_vocabulary(data: bytes) -> list[bytes]:
    pairs = [line.split() for line in data.splitlines() if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Encoder:
    """Encodes and decodes texts; one per Python worker and vocabulary."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str | None = None, data: bytes | None = None):
        import regex
        import sentencepiece

        self.tokens = load_vocabulary(path) if data is None else parse_vocabulary(data)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialize_model(self.tokens))
        self.cut = regex.compile(PATTERN).findall
        self.cut_ascii = re.compile(ASCII_PATTERN).findall
        self.table = dict(enumerate(byte_characters()))
        self.known: dict[str, list[int]] = {}

    @classmethod
    def get(cls, shipped) -> Encoder:
        """The encoder of a shipped vocabulary (see :func:`ship`), made once per worker."""
        name, content = shipped
        if name not in cls._loaded:
            cls._loaded[name] = cls(data=content.value)
        return cls._loaded[name]

    def _mapped(self, words: Iterable[str]) -> list[list[int]]:
        shown = [w.encode("utf-8", "replace").decode("latin-1").translate(self.table) for w in words]
        return self.model.encode(shown, num_threads=1)

    def encode_many(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of each text; NULL and '' give an empty list."""
        cut = [(self.cut_ascii if t.isascii() else self.cut)(t) if t else [] for t in texts]
        if len(self.known) > CACHE_SIZE:
            self.known.clear()
        known = self.known
        new = list({w for words in cut for w in words if w not in known})
        fresh = dict(zip(new, self._mapped(new)))
        known.update((w, ids) for w, ids in fresh.items() if len(w) <= CACHE_LENGTH)
        get = ChainMap(known, fresh).__getitem__ if any(len(w) > CACHE_LENGTH for w in new) else known.__getitem__
        return [list(chain.from_iterable(map(get, words))) for words in cut]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of a list of ids (inverse of :meth:`encode`)."""
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


def vocabulary_path(name: str = BYTE_BPE_50K, directory: str | None = None) -> str:
    return os.path.join(directory or TOKENIZER_DIR, name)


def ship(spark: SparkSession, path: str | None = None) -> tuple:
    """A vocabulary file (1 MB or so), read by the driver and sent to the executors, which need
    no file of their own; with a digest as its name."""
    with open(path or vocabulary_path(), "rb") as handle:
        data = handle.read()
    return hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)


def encode_texts(df: DataFrame, *, text: str, keep: list[str], path: str | None = None, ids: str = "ids") -> DataFrame:
    """``keep`` and the token ids of ``text`` (array<int>), without special tokens.

    NULL and empty texts give an empty list.  A narrow step: no shuffle, one Arrow batch at a
    time, columns other than ``keep`` and ``text`` are never read.
    """
    shipped = ship(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder.get(shipped)
        for batch in batches:
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            texts = batch.column(batch.num_columns - 1)
            for at in range(0, batch.num_rows, 1000):
                lists = coder.encode_many(texts[at : at + 1000].to_pylist())
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*[c[at : at + 1000] for c in kept], column], [*keep, ids])

    types = dict(df.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keep], f"`{ids}` array<int>"])
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)


def count_tokens(df: DataFrame, *, text: str, keep: list[str], path: str | None = None, name: str = "n_tokens") -> DataFrame:
    """``keep`` and the number of tokens of ``text``; NULL and empty texts have none."""
    shipped = ship(df.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Encoder.get(shipped)
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                sizes = [len(ids) for ids in coder.encode_many(part.iloc[:, -1].tolist())]
                yield part.iloc[:, :-1].assign(**{name: np.array(sizes, np.int64)})

    types = dict(df.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keep], f"`{name}` long"])
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string")).mapInPandas(run, schema)


def decode_ids(df: DataFrame, *, ids: str, keep: list[str], path: str | None = None, name: str = "text") -> DataFrame:
    """``keep`` and the text of a list of token ids, the inverse of :func:`encode_texts` (whose
    NULL texts come back empty); NULL lists give NULL."""
    shipped = ship(df.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Encoder.get(shipped)
        for pdf in batches:
            yield pdf.iloc[:, :-1].assign(**{name: [None if x is None else coder.decode(x) for x in pdf.iloc[:, -1]]})

    types = dict(df.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keep], f"`{name}` string"])
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`")).mapInPandas(run, schema)
