"""SentencePiece encoding and decoding by a forward pass over shared prefixes.

The distinct marked words of a batch are sorted, which puts them in the order of a depth-first walk of
their trie; the forward states of a prefix are kept while the walk is below it, so words that begin alike
share the work of their beginning. A prefix's state is its best score and the last piece of the path that
has it. For a unigram model every piece may follow every other. For a byte-pair model a piece may follow
another only if the two stay apart when they are merged alone: paths of such pieces, and no others, are
what merges leave, so any other step scores minus infinity, and the best path is the library's."""

from __future__ import annotations

import heapq
import re
import zlib
from functools import cached_property, lru_cache, partial
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import in_batches, stage
from .tables import read

MARK = "▁"
#: Words and neighbour pairs that a worker keeps; documents whose new words are encoded together.
CACHE, PAIRS, ROWS = 300_000, 300_000, 1000
_NONE = (0, float("-inf"))
_UNIT = re.compile(f"{MARK}+[^{MARK}]*")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """Pieces, scores and kinds of a SentencePiece model file with identity normalisation and byte fallback."""

    def __init__(self, pieces: dict[str, tuple[int, float]], merges: bool, byte_ids: list[int], size: int, unknown: int = 0):
        self.pieces, self.merges, self.byte_ids, self.unknown = pieces, merges, byte_ids, unknown
        self.text = [b""] * size
        for piece, (i, _) in pieces.items():
            self.text[i] = piece.replace(MARK, " ").encode()
        for b, i in enumerate(byte_ids):
            self.text[i] = bytes([b])
        self.text[unknown] = " ⁇ ".encode()
        self.lowest = min(s for _, s in pieces.values()) - 10
        self.apart: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}

    @cached_property
    def back(self) -> dict:
        """Pieces by their characters from the last to the first; under "" the piece itself."""
        root: dict = {}
        for piece in self.pieces:
            node = root
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = piece
        return root

    @classmethod
    def load(cls, path: str) -> Model:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        with open(path, "rb") as file:
            spec = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        norm, model = spec.normalizer_spec, SentencePieceProcessor(model_file=path)
        if norm.precompiled_charsmap or norm.normalization_rule_tsv or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only models that leave texts as they are but for a leading mark are supported")
        n = model.get_piece_size()
        usual = [i for i in range(n) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in usual}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("pieces that go on into a next word are not supported")
        return cls(pieces, spec.trainer_spec.model_type == 2, [i for i in range(n) if model.is_byte(i)], n, model.unk_id())

    def merged(self, text: str) -> list[str]:
        """What merging the best-scored neighbours first, leftmost of equals, leaves of single characters."""
        if len(text) <= 24:
            parts = list(text)
            while len(parts) > 1:
                found = [self.pieces.get(a + b, _NONE)[1] for a, b in zip(parts, parts[1:])]
                best = max(found)
                if best == _NONE[1]:
                    break
                i = found.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            return parts
        parts, after = list(text), list(range(1, len(text) + 1))
        before, queue = list(range(-1, len(text) - 1)), []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (found := self.pieces.get(parts[i] + parts[j])):
                heapq.heappush(queue, (-found[1], i, j, len(parts[i]), len(parts[j])))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, m, n = heapq.heappop(queue)
            if len(parts[i]) != m or len(parts[j]) != n or after[i] != j:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i], i), offer(i, after[i])
        return [p for p in parts if p]

    def _stay(self, left: str, right: str) -> bool:
        found = self.apart.get((left, right))
        if found is None:
            if len(self.apart) > PAIRS:
                self.apart.clear()
            whole = left + right  # a piece would be merged at last
            found = self.apart[left, right] = whole not in self.pieces and self.merged(whole) == [left, right]
        return found

    def _forward(self, word: str, end: int, states: list[tuple[int, str, float]]) -> tuple[int, str, float]:
        """State of word[:end]: where its last piece begins, that piece, and the prefix's best score; -1 if no path leads there."""
        pieces, node, begin = self.pieces, self.back, end
        best = (-1, "", float("-inf"))
        while begin:
            node = node.get(word[begin - 1])
            begin -= 1
            alone = begin == end - 1 and (node is None or "" not in node)  # a character that is no piece stands alone
            if alone or node is not None and "" in node:
                piece = word[begin] if alone else node[""]
                before, last, score = states[begin]
                if before >= 0:
                    score += self.lowest if alone else pieces[piece][1]
                    if score > best[2] and (not begin or not self.merges or self._stay(last, piece)):
                        best = (begin, piece, score)
                        if self.merges:  # merges leave one path, so no other step scores above minus infinity
                            break
            if node is None:
                break
        return best

    def encode_words(self, words) -> dict[str, list[str]]:
        """Pieces of each distinct word, which begins with its mark, by a depth-first walk over their trie."""
        out, last, forward = {}, "", self._forward
        states: list[tuple[int, str, float]] = [(0, "", 0.0)]
        for word in sorted(words):
            shared = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                states.append(forward(word, end, states))
            at, found = len(word), []
            while at > 0 and states[at][0] >= 0:
                found.append(states[at][1])
                at = states[at][0]
            out[word] = found[::-1] if at == 0 else self.merged(word)
            last = word
        return out

    def ids(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            known = self.pieces.get(p)
            if known:
                out.append(known[0])
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers. New words of all texts are encoded together."""
        split = []
        for text in texts:
            words = (text or "").split(" ") if text else []
            if "" in words or (text and MARK in text):
                units = _UNIT.findall(MARK + text.replace(" ", MARK))
                words = [u[1:] for u in units]  # further marks stay in front of their word
            split.append(words)
        if len(self.words) > CACHE:
            self.words.clear()
        new: set[str] = set()
        for words in split:
            new.update(w for w in words if w not in self.words)
        plain = {MARK + w for w in new if not w.startswith(MARK)}
        found = self.encode_words(plain)
        for w in new:
            # several marks before a word: merges prefer the word, so this run of them is merged as a whole
            ids = self.ids(found[MARK + w] if MARK + w in plain else self._marked(MARK + w))
            self.words[w] = pack(f"<{len(ids)}I", *ids)
        return [b"".join(map(self.words.__getitem__, words)) for words in split]

    def _marked(self, unit: str) -> list[str]:
        return self.merged(unit) if self.merges else self.encode_words([unit])[unit]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces and bytes in a row, invalid bytes replaced, without the leading mark's space."""
        raw = b"".join(map(self.text.__getitem__, ids.tolist()))
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model.load(path)


def _encoded(batches, path: str):
    model = load(path)
    for batch in batches:
        last = batch.num_columns - 1
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            ids = model.encode(part.column(last).to_pylist())
            ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays([*part.columns[:last], lists], names=[*part.schema.names[:last], "ids"])


def _lists(column):
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _decoded(batches, path: str):
    model = load(path)
    for batch in batches:
        last = batch.num_columns - 1
        texts = [model.decode(x) for x in _lists(batch.column(last))]
        crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in _lists(batch.column(last))]
        columns = [*batch.columns, pa.array(texts, pa.string()), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "decoded", "ids_crc32"])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): SentencePiece ids of every whole text, without begin or end; none for null and empty texts.

    Repeated rows and null doc_ids stay; an empty table gives no rows; other columns are not read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_batches(rows, partial(_encoded, path=path or default_path()), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded, ids_crc32): the text of non-null ids, and the crc32 of ids as unsigned 32-bit integers."""
    apply = partial(_decoded, path=path or default_path())
    return in_batches(encoded.select("doc_id", "ids"), apply, "doc_id long, ids array<int>, decoded string, ids_crc32 long")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    # staged, so that a task has one Python worker with its model at a time
    found = decode(stage(encode(read(spark, sf_dir, "documents")), "pieces"))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256")
    )
