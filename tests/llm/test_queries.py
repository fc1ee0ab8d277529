"""The registered queries themselves, on the smallest tables, against what their contracts say."""

import zlib

import numpy as np
import pandas as pd
import pytest

from tidemark.llm.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
WANT = {
    "op1_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op3_pack": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op4_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op5_embeddings": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op6_fingerprint": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op7_brown": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op8_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_urls": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op10_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
}


@pytest.fixture(scope="module")
def found(spark):
    frames = {n: QUERIES[n](spark, SF) for n in WANT}
    return {n: (dict(f.dtypes), f.toPandas()) for n, f in frames.items()}


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")


@pytest.mark.parametrize("name", WANT)
def test_names_and_types(found, name):
    assert WANT[name].items() <= found[name][0].items()


@pytest.mark.parametrize("name, part, held", [("op7_brown", 7, 2), ("op8_quality", 5, 0), ("op10_langid", 5, 0)])
def test_folds(found, documents, name, part, held):
    rows = found[name][1]
    assert sorted(rows.doc_id) == sorted(documents.index)
    assert all(h == (zlib.crc32(str(i).encode()) % part == held) for i, h in zip(rows.doc_id, rows.held_out))


def test_scores_are_in_range_and_better_than_the_base(found):
    brown, quality, lang = (found[n][1] for n in ("op7_brown", "op8_quality", "op10_langid"))
    held = brown[brown.held_out]
    assert held.score.sum() > held.base_score.sum() and (brown.score <= 0).all() and brown.train_tokens.nunique() == 1
    assert quality.score.between(0, 1).all() and (quality.predicted == (quality.score >= 0.3)).all()
    assert lang.score.between(0, 1).all()


def test_held_out_quality_and_language(found, documents):
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    rows = found["op8_quality"][1].merge(labels, on="doc_id")
    rows = rows[rows.held_out & rows.quality.notna()]
    assert (rows.predicted == rows.quality).mean() > 0.8
    rows = found["op10_langid"][1].merge(documents.reset_index()[["doc_id", "lang", "text"]], on="doc_id")
    rows = rows[rows.held_out & rows.lang.notna() & rows.text.fillna("").str.contains("[A-Za-z]")]
    assert (rows.lang_pred == rows.lang).mean() > 0.9


def test_sequences_and_files_hold_every_token_once(found):
    packed, files = found["op3_pack"][1], found["op4_token_files"][1].sort_values("doc_id")
    assert packed.groupby("doc_id").length.sum().equals(files.set_index("doc_id").n_tokens.rename("length"))
    assert (files.start.to_numpy() == np.concatenate(([0], files.n_tokens.cumsum()[:-1]))).all()
    for _, s in packed.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.concatenate(([0], s.length.cumsum()[:-1]))).all() and s.length.sum() <= 2048
    cut = packed[packed.groupby("doc_id").piece.transform("max") > 0]
    assert (cut[cut.piece > 0].length == 2048).all() and (packed.groupby("doc_id").length.sum()[cut.doc_id] > 2048).all()


def test_fingerprints_and_components(found, documents):
    prints = found["op6_fingerprint"][1].set_index("doc_id")
    texts = documents.text.fillna("")
    assert (prints.n_chars == texts.map(len)[prints.index]).all() and prints.near_next.between(0, 1).all()
    assert texts.groupby(prints.fingerprint).nunique().max() == 1
    near = found["op1_simhash"][1].set_index("doc_id")
    assert near.fingerprint.str.fullmatch("[0-9a-f]{16}").all() and (near.component_id <= near.index).all()
    for _, g in near.groupby(texts):
        assert g.component_id.nunique() == 1
    vectors = found["op5_embeddings"][1]
    assert (vectors.kept == (vectors.vec_id == vectors.component_id)).all()


def test_explicit_rules(found):
    rows = found["op9_urls"][1]
    assert set(rows.verdict) <= {"allow", "block"}
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert all(rules[r] == v for r, v in zip(rows.rule, rows.verdict) if r is not None)
