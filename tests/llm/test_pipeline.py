"""The pipeline's stages against brute force on a small fixture: what goes, what stays, and what is packed."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidemark.llm.staging import stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, SF), f"test-{name}")
        found.append(docs)
    return found


def test_stages_keep_columns_and_only_drop_rows(spark, outputs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for out in outputs[:3]:
        assert out.columns == docs.columns and out.exceptAll(docs).count() == 0
        docs = out


def test_quality_stage_keeps_good_documents(spark, outputs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = outputs[0].select("doc_id").withColumn("kept", F.lit(True))
    x = labels.join(kept, "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(False)).cast("int")).alias("share"))
    share = {r.quality: r.share for r in x.collect()}
    assert share[1] > 0.95 and share[0] < 0.3


def test_language_stage_keeps_texts_with_letters(outputs):
    assert outputs[1].count() >= 0.98 * outputs[0].count()


def test_near_duplicate_stage_is_brute_force(outputs):
    own = {r.doc_id: r.text for r in outputs[1].collect()}

    def shingles(t):
        w = t.encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = {i: shingles(t) for i, t in own.items()}, {i: i for i in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(own):
        for b in sorted(own):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in outputs[2].collect()) == sorted({find(i) for i in own})


def test_packing_stage_packs_every_document_once(outputs):
    rows = outputs[3].collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in outputs[2].collect()}
    filled = {}
    for r in rows:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= 2048 and len(filled) <= 1.02 * sum(filled.values()) / 2048 + 1


def test_run_gives_the_last_stage(spark, outputs):
    got = corpus_pipeline.run(spark, SF)
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(got.select(*keys).collect()) == sorted(outputs[3].select(*keys).collect())
