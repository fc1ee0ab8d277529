"""Token ids of whole texts by the tokenizers library, for use inside Spark tasks on Arrow batches."""

from __future__ import annotations

import json
import os
from functools import lru_cache, partial
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import in_batches

#: Encoded space-led chunks that a worker process keeps, about 120 bytes each.
CACHE = 300_000
#: Documents of one output batch.
ROWS = 2000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Whole(Exception):
    """The text has white space that a cut at single spaces would tear apart."""


#: Marks that the pre-tokenizer parts from the letters before them.
_MARKS = ".,!?;:%$#&*|)"


def _byte_letters() -> list[int]:
    """The printable characters that byte-level vocabularies write the 256 bytes as, by their public rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [b if b in plain else next(others) for b in range(256)]


class _Chunks(dict):
    """Ids of `lead + chunk` as little-endian unsigned 32-bit integers, encoded when first met."""

    def __init__(self, encoder: Encoder, lead: str, bare: _Chunks | None = None):
        super().__init__()
        self.encoder, self.lead, self.bare = encoder, lead, self if bare is None else bare

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha():
            ids = self.encoder.word(self.lead + chunk)
        elif not chunk or chunk[-1].isspace() or (self.lead and chunk[0].isspace()):
            raise _Whole
        elif (core := chunk.rstrip(_MARKS)) != chunk and core.isalpha():
            known = core in self
            ids = self[core] + self.bare[chunk[len(core) :]]
            if not known:  # a rare word; it is enough to keep its letters
                return ids
        elif "\n" in chunk and all(parts := chunk.split("\n")) and not any(p[0].isspace() for p in parts[1:]):
            return self[parts[0]] + b"".join([self.encoder.line + self.bare[p] for p in parts[1:]])
        else:
            ids = self.encoder.whole(self.lead + chunk)
        if len(self) < CACHE:
            self[chunk] = ids
        return ids


class Encoder:
    """`ids(text)`: what the tokenizers library gives for the text without special tokens added.

    A byte-level pre-tokenizer never joins two words across a space: a single space goes to the word
    behind it. So a text cut before each single space has the ids of its chunks, a chunk that of its
    letters, marks and lines, and each is encoded once per worker, letters by the library's merge model
    alone. Texts with other runs of white space around spaces are encoded as a whole, as are all texts
    where the file asks for another pre-tokenizer, a normaliser or added tokens without a bracket."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.by_chunk = (
            not spec.get("normalizer")
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
            and all(t["content"][:1] == "<" for t in spec["added_tokens"])
        )
        self.model, self.letters = self.library.model, _byte_letters()
        self.space = chr(self.letters[32])
        if self.by_chunk:
            self.line = self.whole("\n")
            self.first = _Chunks(self, "")
            self.rest = _Chunks(self, " ", self.first)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        """Ids of letters with at most a space before them, which the pre-tokenizer keeps together."""
        if word.isascii():  # of these only the space is written as another character
            found = self.model.tokenize(word.replace(" ", self.space))
        else:
            found = self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
        return pack(f"<{len(found)}I", *[t.id for t in found])

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.by_chunk:
            head, *chunks = text.split(" ")
            try:
                return self.first[head] + b"".join(map(self.rest.__getitem__, chunks))
            except _Whole:
                pass
        return self.whole(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(batches, path: str, capacity: int, end_id: int):
    encode, end = encoder(path).ids, np.array([end_id], dtype="<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    rows: list[tuple] = []
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = encode(text.as_py()) + end
            n, at, piece = len(ids) // 4, 0, 0
            while at < n:
                length = (n - at) % capacity or capacity
                rows.append((doc, piece, at, length, ids[4 * at : 4 * (at + length)]))
                at, piece = at + length, piece + 1
            if len(rows) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and the end id, in pieces of at most `capacity`.

    ids holds little-endian unsigned 32-bit integers. Only the first piece of a longer document is shorter.
    Null and empty texts have the end id alone; repeated rows and null ids stay; other columns are not read."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = partial(_pieces, path=path or default_path(), capacity=capacity, end_id=end_id)
    return in_batches(narrow, cut, "doc_id long, piece int, start long, length long, ids binary")
