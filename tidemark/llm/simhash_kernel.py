"""Per-document SimHash arithmetic, used inside Spark tasks on Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash

#: Shingles hashed at a time, so that one very long text needs bounded memory.
CHUNK = 1 << 16


def word_spans(text: str | None) -> tuple[bytes, list[int], list[int]]:
    """A-Z lower-cased words ([^\\x20\\x09-\\x0D]+) joined by one space, with each word's start and end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return b"", [], []
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return b" ".join(words), starts.tolist(), ends.tolist()


def shingle_hashes(spans: tuple[bytes, list[int], list[int]], width: int):
    """XXH64 (seed 42) of each `width`-word shingle of `word_spans`, repeats included, as big-endian bytes in chunks.

    Fewer words than `width`: the whole sequence is the one shingle; no word: nothing."""
    joined, starts, ends = spans
    if not starts:
        return
    ends = ends[width - 1 :] or ends[-1:]
    digest = xxhash.xxh64_digest
    for i in range(0, len(ends), CHUNK):
        yield b"".join([digest(joined[s:e], 42) for s, e in zip(starts[i : i + CHUNK], ends[i : i + CHUNK])])


def simhash(blocks) -> int:
    """64-bit SimHash of shingle hashes: a bit is set if it is set in over half of them; without any, 0."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for block in blocks:
        bits = np.unpackbits(np.frombuffer(block, dtype=np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(bits)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big") if n else 0


def fingerprint(text: str | None, width: int) -> int:
    """SimHash of a text's `width`-word shingles."""
    return simhash(shingle_hashes(word_spans(text), width))


def fingerprint_batches(batches, width: int):
    """Arrow batches whose last column is the text: the other columns and `fp` as a signed long."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        fps = np.array([fingerprint(t.as_py(), width) for t in texts], dtype=np.uint64).view(np.int64)
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(fps)], names=[*batch.schema.names[:-1], "fp"])


#: Minima a band, and bands: two texts of similarity s share a band with probability 1 - (1 - s^5)^20, 0.9996 at 0.8.
ROWS, BANDS = 5, 20
_RANDOM = np.random.RandomState(20)
_MIX = _RANDOM.randint(1, 2**63 - 1, size=ROWS * BANDS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RANDOM.randint(0, 2**63 - 1, size=ROWS * BANDS, dtype=np.int64).astype(np.uint64)


def distinct_hashes(blocks) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    blocks = [np.unique(np.frombuffer(b, ">u8").astype(np.uint64)) for b in blocks]
    return np.unique(np.concatenate(blocks)) if blocks else np.empty(0, np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    return distinct_hashes(shingle_hashes(word_spans(text), width))


def band_keys(shingles: np.ndarray) -> list[int]:
    """One key a band from minima of ROWS hash functions each; none without shingles."""
    if not len(shingles):
        return []
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        least = np.minimum(least, ((shingles[i : i + 2048, None] ^ _XOR) * _MIX).min(axis=0))
    raw = least.tobytes()
    keys = [xxhash.xxh64_intdigest(raw[i : i + 8 * ROWS], i) for i in range(0, len(raw), 8 * ROWS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def signature_batches(batches, width: int):
    """(doc_id, text) to (doc_id, digest, fp, bands). digest: of the lower-cased words, equal for texts that share all."""
    for batch in batches:
        rows = []
        for text in batch.column(1):
            spans = word_spans(text.as_py())
            digest = hashlib.blake2b(spans[0], digest_size=16).digest()
            blocks = list(shingle_hashes(spans, width))  # hashed once for both; 8 bytes a shingle
            fp = simhash(blocks)
            rows.append((digest, fp - (fp >> 63 << 64), band_keys(distinct_hashes(blocks))))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.list_(pa.int64())))]
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "digest", "fp", "bands"])


def set_batches(batches, width: int):
    """(id, text) to (id, shingles): the sorted distinct 64-bit hashes as bytes."""
    for batch in batches:
        sets = [shingle_set(t.as_py(), width).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])


#: Bits of the narrowest sketch: the parity of the shingles that fall on each, so sketches differ in no more bits than sets in members.
SKETCH = 2048


def sketch_bits(size: int) -> int:
    """Bits of the sketch of so many shingles, a power of two that is not below it: two unrelated sets of a size n then differ in
    about n / 2 bits, more than twice what alike ones may."""
    return max(SKETCH, 1 << max(0, size - 1).bit_length())


def sketch_batches(batches, width: int):
    """(id, text) to (id, size, sketch) of the sets of `set_batches`."""
    for batch in batches:
        sizes, sketches = [], []
        for t in batch.column(1):
            own = shingle_set(t.as_py(), width)
            bits = sketch_bits(len(own))
            odd = np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
            sizes.append(len(own))
            sketches.append(np.packbits(odd.astype(np.uint8)).tobytes())
        columns = [batch.column(0), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "size", "sketch"])


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches, a row each, as they are at a smaller width: parities of bits that fall together."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def crossing(table: pa.Table, similarity: float, nearest: bool) -> pa.Table:
    """(a, b): pairs of different components among a block of a band, or between two, whose sets may be alike.

    Sets x and y of Jaccard similarity s differ in (x + y) (1 - s) / (1 + s) members, and the smaller has s of
    the larger; sketches that differ in more bits rule a pair out and no pair is lost. Sketches of two widths are compared
    at the narrower one. Memory: the block's sketches."""
    table = table.combine_chunks()
    lo, hi, block, ids, component, size = (table.column(c).to_numpy() for c in ("lo", "hi", "block", "id", "component", "size"))
    sketches = table.column("sketch").to_pylist()
    words = np.array([len(x) // 8 for x in sketches], np.int64)
    order = {int(w): np.flatnonzero(words == w) for w in np.unique(words)}
    raw = {w: np.frombuffer(b"".join(sketches[i] for i in own), np.uint64).reshape(len(own), w) for w, own in order.items()}
    place = np.empty(len(ids), np.int64)
    for own in order.values():
        place[own] = np.arange(len(own))
    one, share = len(ids) == 0 or lo[0] == hi[0], (1 - similarity) / (1 + similarity)
    a, b = [], []
    for p in np.flatnonzero(block == lo):
        q = np.arange(p + 1, len(ids)) if one else np.flatnonzero(block == hi)
        small, large = np.minimum(size[q], size[p]), np.maximum(size[q], size[p])
        q = q[(component[q] != component[p]) & (small + 1e-6 >= similarity * large)]
        if not len(q):
            continue
        bits, own = np.empty(len(q), np.int64), raw[int(words[p])][place[p]][None, :]
        for w in np.unique(words[q]).tolist():
            at, least = np.flatnonzero(words[q] == w), min(w, int(words[p]))
            both = folded(raw[w][place[q[at]]], least) ^ folded(own, least)
            bits[at] = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
        may = bits <= share * (size[q].astype(np.int64) + size[p]) + 1e-6
        q, bits = q[may], bits[may]
        if nearest and len(q) > 1:
            q = q[np.argsort(bits, kind="stable")]
            q = q[np.unique(component[q], return_index=True)[1]]
        a.append(np.full(len(q), ids[p])), b.append(ids[q])
    none = [np.empty(0, np.int64)]
    return pa.table({"a": np.concatenate(a or none), "b": np.concatenate(b or none)})


def jaccard_batches(batches):
    """(a, b, their shingles) to (a, b, similarity)."""
    for batch in batches:
        found = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            found.append(both / max(1, len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["a", "b", "similarity"]
        )
