"""Each operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import itertools
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import brown, embeddings, fingerprint, langid, packing, pieces, quality, simhash, token_files, tokens, urls
from tidemark.llm.components import connected_components
from tidemark.llm.staging import new_path, stage

LONG = "lorem ipsum dolor " * 20_000
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs"), (2, None), (3, ""), (4, " \n\t "), (5, "one"),
    (6, "The quick brown fox jumps over the lazy dog and RUNS"), (7, LONG), (7, LONG), (None, "no id"), (8, "x" * 100_000),
    (9, "the quick brown fox jumps over the lazy dog and hides"), (10, "zwei  Leerzeichen\u00a0hier 😀 ▁ <|endoftext|>"),
]
EXTRA = "doc_id long, text string, fp long, score double, row string, ids string, length string, held_out string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, 0.5, "r", "i", "l", "h", ["en", "de", None][n % 3]) for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, EXTRA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EXTRA)


def brute_simhash(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_of_odd_texts(docs, none):
    got = simhash.simhash_components(docs).collect()
    assert len(got) == len(TEXTS)
    want = {(i, brute_simhash(t)) for i, t in TEXTS}
    assert {(r.doc_id, r.fp % 2**64) for r in got} == want
    by = {r.doc_id: r.component_id for r in got}
    assert by[2] == by[3] == by[4] == 2 and by[1] == by[6] == 1
    assert simhash.simhash_components(none).count() == 0


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("limit", [4096, 3])
def test_links_lose_no_component_crowded_or_not(spark, limit):
    rng = np.random.RandomState(3)
    fps = set()
    for base in (int(rng.randint(2**62)), 0, 2**64 - 1):
        for _ in range(250):
            x = base
            for b in rng.choice(64, rng.randint(0, 6), replace=False):
                x ^= 1 << int(b)
            fps.add(x - 2**64 if x >= 2**63 else x)
    fps = sorted(fps)
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 3, limit).collect()]
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 3
    assert all(near(a, b) for a, b in got)
    assert components(got, fps) == components([p for p in itertools.combinations(fps, 2) if near(*p)], fps)


def test_components_of_chains_stars_loops_and_nulls(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3), (100, 101), (-5, 60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, -5: -5, 60: -5}
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_near_duplicates_by_brute_force(spark):
    rng = np.random.RandomState(1)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [words[i] for i in rng.randint(0, 400, 120)]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randint(120)] = words[rng.randint(400)]
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, "short"), (903, "SHORT"), (None, "short"), (902, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))

    def shingles(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    own = {i: shingles(t) for i, t in rows if i is not None}
    alike = [
        (a, b) for a, b in itertools.combinations(sorted(own), 2)
        if own[a] == own[b] or len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])
    ]
    want = components(alike, own)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_components(docs).collect()}
    assert got == want
    kept = simhash.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert kept.where("doc_id is null").count() == 1 and kept.columns == docs.columns
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_crowded_bands_by_brute_force(spark, monkeypatch):
    """Texts that share a template at 0.757, in pairs at 0.827, and long chains of single edits."""
    monkeypatch.setattr(simhash, "MEMBERS", 100)
    rng, rows = np.random.RandomState(5), []
    template, word = [f"t{i}" for i in range(104)], lambda n: [f"w{i}" for i in rng.randint(0, 10**6, n)]
    for _ in range(600):
        tail = word(16)
        rows += [template + tail, template + tail[:9] + word(7)]
    for _ in range(2):
        text = word(120)
        for _ in range(150):
            text = list(text)
            text[rng.randint(120)] = word(1)[0]
            rows.append(text)
    rows = [(int(i), " ".join(t)) for i, t in zip(rng.permutation(len(rows)), rows)]
    own = {i: {" ".join(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    alike = [(a, b) for a, b in itertools.combinations(own, 2) if len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_components(docs).collect()}
    assert got == components(alike, own)


def whole_ids(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_path())
    return [library.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def test_packing_of_odd_texts(docs, none):
    want = whole_ids([t for _, t in TEXTS])
    rows = packing.pack_documents(docs, capacity=64).collect()
    assert sum(r.length for r in rows) == sum(map(len, want))
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    cut = [(i, len(x) - s if s == 0 else s, crc(x[s:e])) for (i, _), x in zip(TEXTS, want) for s, e in spans_of(len(x), 64)]
    assert sorted(c[2] for c in cut) == sorted(r.ids_crc32 for r in rows)
    assert packing.pack_documents(none).count() == 0


def spans_of(n, capacity):
    first = n % capacity or capacity
    return [(0, first)] + [(s, s + capacity) for s in range(first, n, capacity)]


def test_plan_is_item_by_item_best_fit():
    rng = np.random.RandomState(0)
    for _ in range(150):
        capacity = int(rng.choice([5, 12, 30]))
        counts = {int(rng.randint(1, capacity + 1)): int(rng.randint(0, 20)) for _ in range(8)}
        bins = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fits = [b for b in range(len(bins)) if bins[b] >= length]
                if fits:
                    bins[min(fits, key=lambda b: bins[b])] -= length
                else:
                    bins.append(capacity - length)
        used = {}
        for length, rank, n, first, _ in packing.best_fit_plan(counts, capacity):
            for i in range(n):
                used[first + i] = used.get(first + i, 0) + length
        assert sorted(capacity - u for u in used.values()) == sorted(bins)
    with pytest.raises(ValueError):
        packing.best_fit_plan({9: 1}, 8)


def test_token_files_round_trip(spark, docs, none):
    out = new_path(spark, "test-tokens")
    token_files.write_tokens(docs, out)
    got = token_files.read_tokens(spark, out).collect()
    assert sorted((r.doc_id or 0, tuple(r.ids)) for r in got) == sorted((i or 0, tuple(x)) for (i, _), x in zip(TEXTS, whole_ids([t for _, t in TEXTS])))
    assert [r.doc_id for r in token_files.read_tokens(spark, out, ["doc_id"], (5, 6)).orderBy("doc_id").collect()] == [5, 6]
    base = {r.shard: r.base for r in token_files.shard_bases(spark, out).collect()}
    starts = sorted((base[r.shard] + r.shard_start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    empty = new_path(spark, "test-tokens")
    token_files.write_tokens(none, empty)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_encoder_equals_the_library_on_odd_white_space():
    rng = np.random.RandomState(1)
    parts = ["a", "b", " ", "  ", "The", "n't", "'s", "'", "\n", "\n\n", "\t", "é", "☃", "漢", "1", "23", ".", ",", "!!", "<|endoftext|>", "\u00a0", "\u3000", "😀", "|", "*", "\r\n"]
    texts = ["".join(parts[i] for i in rng.randint(0, len(parts), rng.randint(0, 14))) for _ in range(5000)]
    encode = tokens.encoder(tokens.default_path()).ids
    for text, ids in zip(texts, whole_ids(texts)):
        assert encode(text) == np.array(ids[:-1], "<u4").tobytes(), text


def test_sentencepiece_equals_the_library(docs, none):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=pieces.default_path())
    got = pieces.decode(pieces.encode(docs)).collect()
    want = sorted((i or 0, tuple(library.encode(t or "")), (t or "").replace("▁", " ")) for i, t in TEXTS)
    assert sorted((r.doc_id or 0, tuple(r.ids), r.decoded) for r in got) == want
    assert pieces.encode(none).count() == 0
    rng = np.random.RandomState(2)
    letters = list("ab  thein\n\té☃▁漢 ﬁ!.,0😀T'")
    texts = ["".join(letters[i] for i in rng.randint(0, len(letters), rng.randint(0, 40))) for _ in range(5000)] + [" " * 100]
    for text, ids in zip(texts, pieces.load(pieces.default_path()).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text), text


def test_unigram_forward_pass_by_brute_force():
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "▁a": -2.2, "ab": -2.1, "▁ab": -6.0, "ba": -2.4, "aba": -4.0}
    model = pieces.Model({p: (i + 1, s) for i, (p, s) in enumerate(scores.items())}, False, [], 20)
    words = ["▁" + "".join(w) for n in range(6) for w in itertools.product("ab", repeat=n)]

    def best(word):
        if not word:
            return 0.0
        return max((best(word[: -len(p)]) + s for p, s in scores.items() if word.endswith(p)), default=-1e9)

    for word, found in model.encode_words(words).items():
        assert "".join(found) == word and sum(scores[p] for p in found) == pytest.approx(best(word))


def test_embeddings_by_brute_force_and_odd_vectors(spark):
    rng = np.random.RandomState(4)
    base = rng.randn(40, 16)
    rows = [(i, (base[i % 40] + rng.randn(16) * 0.15).tolist()) for i in range(400)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [None] + [1.0] * 15), (1004, [1.0]), (1005, []), (5, rows[5][1]), (None, rows[0][1])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("list", F.lit(1)).withColumn("code", F.lit("c"))
    got = {r.vec_id: r for r in embeddings.near_duplicate_vectors(table).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    assert sum(got[i].n_links for i in range(400)) >= 0.9 * (near.sum() - 400)
    assert all(got[i].n_links <= near[i].sum() - 1 for i in range(400))
    want = components([(a, b) for a, b in zip(*np.nonzero(near))], range(400))
    assert np.mean([got[i].component_id == want[i] for i in range(400)]) > 0.97
    assert all(got[i].n_links == 0 and got[i].kept for i in range(1000, 1006)) and len(got) == 406
    assert embeddings.near_duplicate_vectors(table.limit(0)).count() == 0


@pytest.mark.parametrize("dims, rank, wide", [(32, 32, 256), (32, 8, 256), (32, 4, 16), (128, 8, 16)])
def test_embedding_recall_over_many_lists(spark, monkeypatch, dims, rank, wide):
    monkeypatch.setattr(embeddings, "LIST", 40), monkeypatch.setattr(embeddings, "WIDE", wide)
    rng, n, c = np.random.RandomState(rank), 1000, 0.955
    basis = np.linalg.qr(rng.randn(dims, rank))[0]
    a, d = rng.randn(n, rank), rng.randn(n, rank)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    d -= (d * a).sum(1, keepdims=True) * a
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * d]) @ basis.T  # each vector has a partner just within reach
    table = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    made = []
    monkeypatch.setattr(embeddings, "fit", lambda *f, _fit=embeddings.fit: made.append(_fit(*f, a_list=40)) or made[-1])
    want = (x @ x.T >= 0.95).sum(axis=1) - 1
    for exact in (False, True):
        got = [r.n_links for r in embeddings.near_duplicate_vectors(table, exact=exact).orderBy("vec_id").collect()]
        assert sum(got) >= (1.0 if exact else 0.99) * want.sum() and all(g <= w for g, w in zip(got, want))
        assert len(made[-1].centre) >= 40 and len(made[-1].top) == -(-50 // wide)


def test_copies_of_vectors_count_without_pairs(spark):
    rows = [(i, [1.0, 0.0, 2.0]) for i in range(500)] + [(500, [1.0, 0.01, 2.0]), (501, [0.0, 1.0, 0.0]), (502, [1e200, 0.0, 2e200])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i] == (501, 0) for i in [*range(501), 502]) and got[501] == (0, 501)


def test_embedding_blocks_give_the_same_links(spark, monkeypatch):
    rng = np.random.RandomState(6)
    centre = rng.randn(16)
    rows = [(i, (centre + rng.randn(16) * 0.1).tolist()) for i in range(150)] + [(200, [1.0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = sorted(embeddings.near_duplicate_vectors(table).collect())
    monkeypatch.setattr(embeddings, "BLOCK", 20)
    assert sorted(embeddings.near_duplicate_vectors(table).collect()) == whole


def test_embedding_rounds_bound_what_is_shuffled_and_leave_the_links(spark, monkeypatch):
    rng = np.random.RandomState(7)
    x = rng.randn(600, 8)
    x[300:] = x[:300] + rng.randn(300, 8) * 0.25
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(embeddings, "fit", lambda *f, _fit=embeddings.fit: _fit(*f, a_list=20))
    monkeypatch.setattr(embeddings, "ROUND_BYTES", 0), monkeypatch.setattr(embeddings, "BLOCK", 100)
    rounds, deal = [], embeddings.Cells.deal
    monkeypatch.setattr(embeddings.Cells, "deal", lambda self, queries, most: rounds.append((deal(self, queries, most), self, queries, most)) or rounds[-1][0])
    got = [r.n_links for r in embeddings.near_duplicate_vectors(table, exact=True).orderBy("vec_id").collect()]
    assert got == ((unit @ unit.T >= 0.95).sum(1) - 1).tolist() and max(got) > 1
    (number, cells, queries, most), rows = rounds[0], np.zeros(rounds[0][0])
    np.add.at(rows, cells.round, cells.members * cells.qs + queries * cells.ms)
    assert number > 1 and most == 2 * len(x) and rows.max() <= most
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_one_product_with_decoded_members_keeps_all_within_the_radius_and_few_others():
    rng = np.random.RandomState(8)
    x = embeddings.unit_rows(rng.randn(6000, 32))
    x[3000:] = embeddings.unit_rows(x[:3000] + rng.randn(3000, 32) * 0.05)
    index = embeddings.Index(x, 20, 0.95)
    own, codes, error = index.coded(x)
    for at in range(20):
        held = np.flatnonzero(own == at)
        decoded, least = index.decoded(at, codes[held], error[held])
        assert decoded.dtype == least.dtype == np.float32
        kept = x.astype(np.float32) @ decoded.T >= least
        assert kept[x @ x[held].T >= 0.95].all() and kept.mean() < 0.2
    assert embeddings.Cells(np.full(9, 1000), 10**6, 4096).most == embeddings.BLOCK_BYTES // (8 * 4096) < embeddings.BLOCK


def test_embeddings_of_every_length_link_whatever_nulls_and_empties_outnumber(spark):
    rows = [(i, None) for i in range(9)] + [(i, []) for i in range(10, 19)]
    rows += [(20, [1.0, 2.0]), (21, [1.0, 2.0]), (22, [2.0, -1.0])] + [(30, [1.0, 0.0, 3.0]), (31, [1.0, 0.0, 3.0])]
    got = {r.vec_id: r for r in embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert len(got) == len(rows)
    assert {i: (r.n_links, r.component_id) for i, r in got.items() if r.n_links} == {20: (1, 20), 21: (1, 20), 30: (1, 30), 31: (1, 30)}


def test_sketches_recover_every_difference(spark, docs, none):
    import re
    from collections import Counter

    got = fingerprint.fingerprint_edits(docs.where("doc_id is not null")).collect()
    rows = sorted([(i, t or "") for i, t in TEXTS if i is not None], key=lambda r: (-r[0], r[1]))
    units = lambda t: set(Counter(re.findall(r"[^\n]{1,256}\n?|\n", t)).items())
    want = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        near = [len(units(t) & u) / len(units(t) | u) if units(t) | u else 1.0 for u in (units(edited), units(after))]
        want.append((i, len(t), *near))
    mine = sorted((r.doc_id, r.n_chars, r.near_edited, r.near_next) for r in got)
    assert np.allclose(np.array(mine), np.array(sorted(want)))
    prints = {}
    for r in got:
        prints.setdefault(r.fingerprint, set()).add(dict(rows)[r.doc_id])
    assert all(len(v) == 1 for v in prints.values())
    assert fingerprint.fingerprint_edits(docs).count() == len(TEXTS)
    assert fingerprint.fingerprint_edits(none).count() == 0


def read_print(text):
    """Digests of a fingerprint's text, by peeling its table in plain Python."""
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    width, cells = text.split(":")
    table = {}
    for cell in filter(None, cells.split(",")):
        c, n, k, h = (int(x, 16) for x in cell.split("."))
        table[c] = [signed(n), k, h]
    return int(width, 16), table


def peel(width, table, places, check):
    table, found = {c: list(v) for c, v in table.items()}, []
    while pure := next(((v[1], v[0]) for v in table.values() if abs(v[0]) == 1 and v[2] == check[v[1]]), None):
        k, n = pure
        found.append(k)
        for j, p in enumerate(places[k]):
            v = table[j * width + (p & (width - 1))]
            v[0], v[1], v[2] = v[0] - n, v[1] ^ k, v[2] ^ check[k]
    return set(found), any(v != [0, 0, 0] for v in table.values())


def test_differences_are_recovered_by_subtraction(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    how = fingerprint.fingerprint_edits(docs).select("differing.how", F.col("differing_next.how").alias("next")).collect()
    share = lambda c: sum(r[c] != "apart" for r in how) / len(how)
    assert share("how") >= 0.95 and share("next") >= 0.95


def test_likeness_follows_from_the_two_printed_fingerprints(spark):
    rng = np.random.RandomState(5)
    lines = [f"line {i} {rng.randint(10**6)}" for i in range(400)]
    texts = ["\n".join(rng.choice(lines, n)) for n in (1, 3, 9, 30, 90, 300, 299)] + [""]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprint.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    every = {k for r in got.values() for k in [*r.differing.found, *r.differing_next.found]}
    of = spark.createDataFrame([(k,) for k in every], "k long").selectExpr("k", "xxhash64(k) h", "transform(sequence(0, 2), j -> xxhash64(k, j)) p").collect()
    u = lambda x: x % 2**64
    check, places = {u(r.k): u(r.h) for r in of}, {u(r.k): r.p for r in of}

    class Known(dict):
        def __missing__(self, key):
            return None

    for i, r in got.items():
        after = got[i - 1] if i else got[max(got)]
        sets = []
        for x in (r.fingerprint, after.fingerprint):
            width, table = read_print(x)
            found, left = peel(width, table, places, Known(check))
            assert sum(v[0] for v in table.values()) % 3 == 0
            sets.append((found, left, sum(v[0] for v in table.values()) // 3))
        (a, a_left, n_a), (b, b_left, n_b) = sets
        if not (a_left or b_left):  # all digests are among those that some text differs in
            assert len(a) == n_a and len(b) == n_b
            assert r.near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
            assert {u(k) for k in r.differing_next.found} == a ^ b


def test_sketches_of_very_different_sizes_peel(spark):
    a, b = [xxhash.xxh64_intdigest(str(i)) - 2**63 for i in range(900)], [xxhash.xxh64_intdigest(str(i)) - 2**63 for i in range(300, 1000)]
    pairs = spark.createDataFrame([(1, a, b), (2, a, a), (3, [], b), (4, b[:3], a), (5, [], [])], "uid long, a array<long>, b array<long>")
    made = pairs.withColumns({"one": F.expr(fingerprint.sketch_of("a")), "two": F.expr(fingerprint.sketch_of("b"))})
    got = {r.uid: set(r.d) for r in fingerprint.difference(made, "one", "two", "how").select("uid", F.col("how.found").alias("d")).collect()}
    assert got == {1: set(a) ^ set(b), 2: set(), 3: set(b), 4: set(a) ^ set(b[:3]), 5: set()}


def test_fingerprint_of_a_text_of_many_lines(spark):
    many = "\n".join(f"line {i * 7919 % 30011}" for i in range(20_000))
    got = {r.doc_id: r for r in fingerprint.fingerprint_edits(spark.createDataFrame([(1, many), (2, many + "\nmore")], "doc_id long, text string")).collect()}
    assert got[1].near_next == got[2].near_next == pytest.approx(19_999 / 20_002)  # the last line ends in a line feed in one of them


def test_brown_scores(spark, docs, none):
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id") % 3 == 0, F.lit(True)).alias("held_out"))
    got = brown.class_scores(rows).collect()
    seen = {}
    for i, t in TEXTS:
        if i is not None and i % 3:
            for w in [*(t or "").encode().lower().split(), None]:
                seen[w] = seen.get(w, 0) + 1
    n, v = sum(seen.values()), len(seen)
    want = sorted(
        (i or 0, len(w), sum(x in seen for x in w), round(float(sum(np.log10((seen.get(x, 0) + 1) / (n + v + 1)) for x in w)), 5))
        for i, w in ((i, [*(t or "").encode().lower().split(), None]) for i, t in TEXTS)
    )
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert all(r.train_tokens == n and np.isfinite(r.score) and r.score <= 0 for r in got)
    assert brown.class_scores(rows.limit(0)).count() == 0
    untrained = brown.class_scores(rows.withColumn("held_out", F.lit(True))).collect()
    assert len(untrained) == len(TEXTS) and all(r.n_known == 0 for r in untrained)


def plain_brown(train, texts, longest, clustered, counted):
    """Scores by the definition: plain loops over words, for small texts."""
    words = [[*t.encode().lower().split(), None] for t in train]
    n_of = {}
    for t in words:
        for w in t:
            n_of[w] = n_of.get(w, 0) + 1
    frequent = sorted((w for w in n_of if w is not None and len(w) <= longest), key=lambda w: (-n_of[w], w))
    classes = {None: brown.END_CLASS}
    of = lambda w: classes.get(w, brown.REST_CLASS)
    top = frequent[:clustered]
    place = {None: 0, **{w: i + 2 for i, w in enumerate(top)}}
    pairs = np.zeros((len(top) + 2, len(top) + 2))
    for t in words:
        for a, b in zip([None, *t], t):
            pairs[place.get(a, 1), place.get(b, 1)] += 1
    classes |= dict(zip(top, brown.exchange(pairs, brown.CLASSES, fixed=2).tolist()))

    def fitted(those):
        grid = np.zeros((brown.K, brown.K))
        beside = {w: [] for w in those}
        for t in words:
            for a, b in zip([None, *t], t):
                grid[of(a), of(b)] += 1
                if a in beside:
                    beside[a].append(brown.K + of(b))
                if b in beside:
                    beside[b].append(of(a))
        table = brown.fit_table(grid)
        return {w: int(sum(table[k] for k in ks).argmax()) for w, ks in beside.items()}

    classes |= fitted(frequent[clustered:counted])
    classes |= fitted([w for w in n_of if w not in classes])
    grid = np.zeros((brown.K, brown.K))
    half = lambda w: [of(w), brown.REST_CLASS if w is not None and n_of[w] == 1 else of(w)]
    for t in words:
        for a, b in zip([None, *t], t):
            for x in half(a):
                for y in half(b):
                    grid[x, y] += 0.25
    tokens, types, share = np.zeros(brown.K), np.zeros(brown.K), np.zeros(brown.K)
    for w, n in n_of.items():
        tokens[of(w)] += n
        types[of(w)] += 1
        for x in half(w):
            share[x] += n / 2
    types[brown.REST_CLASS] = 1
    share = np.where(types > 0, share + 1, 0)
    share /= share.sum()
    out = []
    for t in texts:
        score, before = 0.0, brown.END_CLASS
        for w in [*t.encode().lower().split(), None]:
            c = of(w)
            score += np.log10((grid[before, c] + brown.MU * share[c]) / (grid[before].sum() + brown.MU))
            if c < brown.CLASSES:
                score += np.log10((n_of[w] + 1) / (tokens[c] + types[c]))
            before = c
        out.append(score)
    return out


def test_brown_scores_by_plain_loops(spark, monkeypatch):
    rng = np.random.RandomState(2)
    words = [("w" if i % 3 else "longword") + str(i) for i in range(60)]
    chance = 1 / np.arange(1, 61)
    texts = [" ".join(rng.choice(words, rng.randint(0, 40), p=chance / chance.sum())) + rng.choice(["", " new", f" once{i}"]) for i in range(80)]
    held = [i % 4 == 0 for i in range(80)]
    table = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(zip(texts, held))], "doc_id long, text string, held_out boolean")
    monkeypatch.setattr(brown, "LONGEST", 6), monkeypatch.setattr(brown, "CLUSTERED", 8), monkeypatch.setattr(brown, "COUNTED", 14)
    got = [r.score for r in brown.class_scores(table).orderBy("doc_id").collect()]
    want = plain_brown([t for t, h in zip(texts, held) if not h], texts, 6, 8, 14)
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_exchange_finds_planted_classes_and_never_lowers_its_measure():
    rng = np.random.RandomState(0)
    of, pairs = np.arange(30) % 3, np.zeros((30, 30))
    c = 0
    for _ in range(30_000):
        w = rng.choice(np.flatnonzero(of == c))
        c = (c + 1) % 3 if rng.rand() < 0.9 else rng.randint(3)
        pairs[w, rng.choice(np.flatnonzero(of == c))] += 1
    shuffled = rng.permutation(30)
    found = brown.exchange(pairs[np.ix_(shuffled, shuffled)], 3)
    assert len({(a, b) for a, b in zip(found, of[shuffled])}) == 3

    def measure(classes):
        g = np.eye(3)[classes].T @ pairs @ np.eye(3)[classes]
        f = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
        return f(g) - f(g.sum(0)) - f(g.sum(1))

    start = np.arange(30) % 3
    rng.shuffle(start)
    before = [measure(brown.exchange(pairs, 3, p)) for p in range(4)]
    assert all(b >= a - 1e-6 for a, b in zip(before, before[1:]))


def test_brown_class_model_sums_to_one_over_next_words(spark):
    text = " ".join(np.random.RandomState(1).choice(["a", "b", "c", "d"], 300))
    rows = [(0, text, False)] + [(i, w, True) for i, w in enumerate(["", "a", "b", "c", "d", "zzz"], 1)]
    got = {r.doc_id: r for r in brown.class_scores(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    # p(first word) = p(word, end) / p(end | word); the end after any word is the same class here, so sums stay below 1
    assert sum(10 ** got[i].score for i in range(1, 7)) <= 1


def test_quality_learns_and_scores_odd_texts(spark, docs, none):
    good = [(i, f"plain words number {i} in a row", 1) for i in range(100)]
    bad = [(100 + i, f"BUY!! NOW!! {i} CHEAP!! PILLS!!", 0) for i in range(60)]
    labelled = spark.createDataFrame([*good, *bad, (999, None, 1), (998, "x", None)], "doc_id long, text string, label int")
    weights = quality.train(labelled)
    got = {r.doc_id: r.score for r in quality.score(labelled, weights, ["doc_id"]).collect()}
    assert min(got[i] for i, _, _ in good) > 0.5 > 0.3 > max(got[i] for i, _, _ in bad)
    scored = quality.score(docs, weights, ["doc_id"]).collect()
    assert len(scored) == len(TEXTS) and all(0 <= r.score <= 1 for r in scored)
    labels = labelled.select("doc_id", F.col("label").alias("quality"))
    kept = quality.quality_filter(docs, labels)
    assert kept.columns == docs.columns and quality.quality_filter(none, labels).count() == 0
    untrained = quality.train(labelled.limit(0))
    assert {r.score for r in quality.score(docs, untrained, ["doc_id"]).collect()} == {0.5}


def plain_ftrl(rows):
    """Follow-the-regularised-leader with plain dictionaries, one coordinate after the other."""
    z, n, w = {}, {}, lambda i: 0.0 if abs(z.get(i, 0.0)) <= quality.L1 else -(z[i] - np.sign(z[i]) * quality.L1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)
    for _ in range(quality.EPOCHS):
        for x, label in rows:
            now = {i: w(i) for i in x}
            p = 1 / (1 + np.exp(-sum(now[i] * v for i, v in x.items())))
            for i, v in x.items():
                g, old = (p - label) * v, n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / quality.ALPHA * now[i]
                n[i] = old + g * g
    return {i: w(i) for i in z}


@pytest.mark.parametrize("part", [1 << 20, 7])
def test_quality_weights_and_scores_by_plain_loops(spark, monkeypatch, part):
    monkeypatch.setattr(quality, "PART", part)
    rng = np.random.RandomState(8)
    rows = [(i, " ".join(rng.choice(["Good", "text", "BUY", "now!!", "x1", "x1"], rng.randint(1, 12))), i % 2) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, label int")
    order = {r.doc_id: r.o for r in table.select("doc_id", F.xxhash64("doc_id", F.lit("quality sample")).alias("o")).collect()}

    def grams(text):
        blocks = [np.concatenate(f) for f in zip(*quality.features(text))]
        out = {-1: 1.0}
        for f in blocks:
            for i in f.tolist():
                out[i] = out.get(i, 0.0) + quality.SCALE / len(f)
        return out

    assert all(len(np.concatenate(f)) == len(t.split()) - k for _, t, _ in rows for f, k in zip(zip(*quality.features(t)), (0, 1, 0, 1)))
    want = plain_ftrl([(grams(t), y) for i, t, y in sorted(rows, key=lambda r: order[r[0]])])
    weights = quality.train(table)
    got = np.frombuffer(weights, "<f4")
    assert all(abs(got[i + 1] - v) < 1e-4 for i, v in want.items()) and np.count_nonzero(got) == sum(abs(v) > 0 for v in want.values())
    scores = {r.doc_id: r.score for r in quality.score(table, weights, ["doc_id"]).collect()}
    for i, t, _ in rows:
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-sum(want.get(k, 0.0) * v for k, v in grams(t).items()))), abs=1e-4)


def test_letters_are_letters_only(spark):
    table = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("uno dos tres", "es"), ("one two three", "en")])], "doc_id long, text string, lang string")
    model = langid.learn(table)
    odd = spark.createDataFrame([(1, "½ ² ①"), (2, "Ⅷ 12 _ -"), (3, "uno½"), (4, "\u0301 ́")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, model, ["doc_id"]).collect()}
    assert got[1] == got[2] == got[4] == ("und", 0.0) and got[3] == ("es", 1.0)


def test_two_hundred_languages_and_rare_ones(spark):
    word = lambda i: "".join(chr(97 + (i * 7 + k * 3) % 26) for k in range(4)) + chr(97 + i % 26) + chr(97 + i // 26)
    rows = [(i, " ".join([word(i)] * 6), f"l{i:03d}") for i in range(200)]
    rows += [(1000 + k, "дом кот мир", "zz") for k in range(300)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=20)
    assert len(model.langs) == 201
    got = langid.identify(spark.createDataFrame(rows[:200], "doc_id long, text string, lang string"), model, ["doc_id", "lang"]).collect()
    assert all(r.lang_pred == r.lang for r in got)


def test_language_of_texts_by_plain_search(spark):
    rng = np.random.RandomState(4)
    own = {"aa": ["kala", "kalo", "moki", "taka"], "bb": ["brush", "strum", "kalb", "glim"], "cc": ["дом", "кот", "моки"]}
    rows = [(i, " ".join(rng.choice(own[x], 5)), x) for i, x in enumerate(["aa", "bb", "cc"] * 6)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [" ".join(rng.choice([*own["aa"], *own["bb"], *own["cc"], "77", "x", "brushkala"], rng.randint(1, 7))) for _ in range(40)]
    got = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, ["doc_id"]).orderBy("doc_id").collect()

    def grams(word):
        raw = b"^" + word.encode() + b"$"
        return langid.trigrams([word])[0][: len(raw) - 2]

    counts, scripts = np.full((langid.BUCKETS, 3), 0.5), {}
    for _, text, x in rows:
        for w in text.split():
            np.add.at(counts[:, model.langs.index(x)], grams(w), 1)
            scripts.setdefault(langid.script_of(w), set()).add(model.langs.index(x))
    table = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    for r, text in zip(got, texts):
        words = [langid.letters(w) for w in text.split()]
        costs = []
        for w in words:
            fits = scripts.get(langid.script_of(w), {0, 1, 2})
            s = table[grams(w)].sum(axis=0)
            best = max(s[c] for c in fits)
            costs.append([max(s[c] - best, -langid.CLIP) if c in fits else -langid.CLIP for c in range(3)] if w else [0.0] * 3)
        value = lambda p: sum(c[x] for c, x in zip(costs, p)) - langid.SWITCH * sum(a != b for a, b in zip(p, p[1:]))
        best = max(map(value, itertools.product(range(3), repeat=len(words))))
        labels = [model.langs.index(s.lang) for s in r.spans for _ in range(s.words)]
        if not any(words):
            assert (r.lang_pred, r.score, r.spans) == ("und", 0.0, [])
            continue
        assert value(labels) == pytest.approx(best, abs=1e-3)
        sizes = [sum(len(w) for w, x in zip(words, labels) if x == c) for c in range(3)]
        assert r.lang_pred == model.langs[int(np.argmax(sizes))] and r.score == pytest.approx(max(sizes) / sum(sizes))


def test_language_spans_and_odd_texts(spark, docs, none):
    de = "der hund und die katze gehen nicht in das haus weil es regnet"
    en = "the dog and the cat do not go into the house because it rains"
    ru = "собака и кошка не идут в дом"
    table = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([(de, "de"), (en, "en"), (ru, "ru")] * 5)], "doc_id long, text string, lang string")
    model = langid.learn(table)
    assert model.langs == ["de", "en", "ru"] and model.scripts["cyrillic"].tolist() == [False, False, True]
    mixed = spark.createDataFrame([(1, f"{de} {en} {ru}"), (2, "123 !?"), (3, None), (4, en)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(mixed, model, ["doc_id"]).collect()}
    assert [s.lang for s in got[1].spans] == ["de", "en", "ru"] and sum(s.words for s in got[1].spans) == len(f"{de} {en} {ru}".split())
    assert got[2].lang_pred == got[3].lang_pred == "und" and got[4].lang_pred == "en" and got[4].score == 1
    assert langid.identify(docs, model, ["doc_id"]).count() == len(TEXTS)
    assert langid.language_filter(docs).columns == docs.columns and langid.language_filter(none).count() == 0


def test_viterbi_by_brute_force():
    rng = np.random.RandomState(0)
    for _ in range(60):
        n = rng.randint(1, 6)
        e = rng.randn(n, 3)
        cost = lambda p: sum(e[i, x] for i, x in enumerate(p)) - sum(p[i] != p[i + 1] for i in range(n - 1))
        best = max(itertools.product(range(3), repeat=n), key=cost)
        assert tuple(langid.viterbi(e, np.array([n]), np.arange(n)[:, None], 1.0)[0]) == best


def test_url_verdicts_of_odd_urls(spark):
    rows = [
        (1, "https://Blog.Example.com/en/9?x"), (2, "http://example.com/en/71"), (3, None), (4, "no scheme"), (5, "x://badexample.com/en/7#f"),
        (6, "https://a.example.net?/de/"), (7, "https://a.example.net/de/8"), (7, "https://a.example.net/de/8"), (None, "https://net/de/1"), (8, "http://" + "a." * 5000 + "org/es/"), (9, "://"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit("clash"))
    rules = spark.createDataFrame([*urls.RULES, (None, "x/"), ("block", None)], "verdict string, rule string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (6, None)], "page_id long, good int")
    got = urls.url_verdicts(pages, rules, labels).collect()
    seen = sorted(((r.page_id or 0), r.host[-12:], r.path, r.rule or "-", r.verdict) for r in got)
    assert len(got) == len(rows)
    by = {s[0]: s[1:] for s in seen}
    assert by[1] == (".example.com", "/en/9", "com/en/", "block") and by[2][2:] == ("example.com/en/7", "allow")
    assert by[3][:3] == by[4][:3] == ("", "", "-") and by[5][2:] == ("com/en/", "block") and by[6][1:3] == ("", "-")
    assert by[7][2:] == ("example.net/de/8", "block") and by[0] == ("net", "/de/1", "net/de/", "allow") and by[8][2:] == ("org/es/", "block")
    assert urls.url_verdicts(pages.limit(0), rules, labels).count() == 0
    assert urls.url_verdicts(pages, rules.limit(0), labels.limit(0)).where("rule is not null").count() == 0


def test_bad_hosts_are_blocked_only_with_evidence(spark):
    pages = [(i, f"http://{'bad' if i < 40 else 'new' if i == 40 else 'good'}.a.com/{i}") for i in range(100)]
    labels = [(i, int(i > 40)) for i in range(100)]
    out = urls.url_verdicts(
        spark.createDataFrame(pages, "page_id long, url string"),
        spark.createDataFrame([], "verdict string, rule string"),
        spark.createDataFrame(labels, "page_id long, good int"),
    )
    got = {r.host: r.verdict for r in out.collect()}
    assert got == {"bad.a.com": "block", "new.a.com": "allow", "good.a.com": "allow"}
