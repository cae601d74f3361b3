"""The registered queries and the pipeline on the smallest tables."""

from __future__ import annotations

import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestore.llm import decontaminate, mixing, substring, toxicity
from lodestore.llm import queries as Q
from tests.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "op1_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op2_mixing_sources": {"doc_id", "size", "source_size", "target", "taken"},
    "op3_url_filter": {"page_id", "host", "path", "rule", "verdict"},
    "op4_lm_scoring": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op5_simhash_near_dedup": {"doc_id", "fingerprint", "component_id"},
    "op6_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op7_token_counts": {"doc_id", "n_tokens"},
    "op9_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op10_document_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
}


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_matches_duckdb(spark, name):
    got, want = compare(spark, connect(SF), Q.QUERIES[name], Q.ORACLE[name], SF)
    assert got == want


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, name):
    df = Q.QUERIES[name](spark, SF)
    key = "page_id" if "page_id" in df.columns else "doc_id"
    table = "pages" if key == "page_id" else "documents"
    assert set(df.columns) >= COLUMNS[name]
    rows = df.collect()
    ids = [r[key] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()]
    assert sorted(r[key] for r in rows) == sorted(ids)
    folds = {"op1_toxicity": (3, 1), "op4_lm_scoring": (7, 2)}.get(name)
    if folds:
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds[0] == folds[1]) for r in rows)


def test_decontamination_query(spark):
    rows = Q.op8_benchmark_decontamination(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    norm = lambda t: decontaminate.normal(t.encode())
    exact = {(d, i) for d, t in docs.items() for i, b in items.items() if norm(b) in norm(t)}
    assert exact <= {(r.doc_id, r.item_id) for r in rows}
    assert all(r.distance <= len(norm(items[r.item_id])) // 10 for r in rows)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    kept, tables = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialise(stage(spark, kept, SF), name.replace(" ", "-"))
        assert kept.schema == docs.schema
        tables.append({r.doc_id: r for r in kept.collect()})
    toxic, single, stripped, clean = tables
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    grammar = toxicity.learn(docs, labels.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"))
    assert set(toxic) == {i for i, r in before.items() if grammar.score(r.text) < 0.7}
    texts = Counter(r.text for r in toxic.values())
    assert set(single) < set(toxic) and {single[i].text for i in single} <= set(texts) and len({r.text for r in single.values()}) == len(single)
    first = {}
    for i in sorted(single):
        w = single[i].text.encode().split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    assert set(stripped) == set(single)
    for i, r in stripped.items():
        w = single[i].text.encode().split()
        at = [k for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i]
        gone = substring.removed(len(w), np.array(at, int), 13)
        assert r.text.encode().split() == [x for x, y in zip(w, gone) if not y]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    matcher = decontaminate.Matcher([(k, decontaminate.normal(t.encode())) for k, t in enumerate(items)], 0.1)
    assert set(clean) == {i for i, r in stripped.items() if not matcher.find(decontaminate.normal(r.text.encode()))}
    mixed = corpus_pipeline.run(spark, SF).collect()
    again = mixing.mix(kept).collect()
    assert sorted(map(str, mixed)) == sorted(map(str, again)) and {r.doc_id for r in mixed} == set(clean)
