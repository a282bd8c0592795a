"""Registered queries of the llm package: SQL oracles, contracts and the pipeline."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oracle_check import compare, duck
from tidemark.llm import minhash, mixing, toxicity
from tidemark.llm.catalog import LLM_ORACLES, LLM_QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_oracle(spark, con, name):
    assert compare(LLM_QUERIES[name](spark, SF), con, LLM_ORACLES[name]) == ""


def test_every_operator_has_its_query():
    assert {n.split("_")[0] for n in LLM_QUERIES} == {"pipeline", *(f"op{i}" for i in range(1, 14))}


def test_secret_digests(spark):
    documents = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in LLM_QUERIES["op8_secret_scan"](spark, SF).collect():
        text = documents[r.doc_id]
        spans = [("assign", m) for m in re.finditer(
            r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)
            if len(m[2]) >= 6]
        spans += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        count = Counter(k for k, _ in spans)
        spans.sort(key=lambda x: (x[1].start(), ["assign", "access", "hex"].index(x[0])))
        digest = hashlib.sha256(",".join(f"{k}:{m.start()}:{m.end()}" for k, m in spans).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (
            count["assign"], count["access"], count["hex"], digest)


def test_pipeline_stages_take_effect(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").withColumn("rows", F.lit(1)).cache()
    kept, ids = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SF)
        if name != "token_records":
            assert out.columns == documents.columns
        ids[name] = Counter(r.doc_id for r in out.select("doc_id").collect())
        if name == "toxicity":
            labels = spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
            want = toxicity.toxicity_scores(kept, labels).where("score < 0.7")
        elif name == "near_duplicates":
            want = minhash.near_duplicates(kept, words=5).where("kept")
            sets = {r.doc_id: frozenset(minhash.shingles((r.text or "").encode(), 5).tolist()) for r in kept.collect()}
            left = sorted(ids[name])
            assert not any(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
                           for a in left for b in left if a < b and sets[a] and sets[b])
        elif name == "decontamination":
            items = [minhash.shingles(r.text.encode(), 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            texts = {r.doc_id: set(minhash.shingles((r.text or "").encode(), 5).tolist()) for r in kept.collect()}
            want = None
            clean = {i for i, s in texts.items()
                     if not any(len(s & set(x.tolist())) >= 0.9 * len(x) for x in items)}
            assert set(ids[name]) <= clean and len(ids[name]) > 0.8 * len(clean)
        elif name == "mixing":
            want = mixing.mixed_copies(kept).withColumn("n", F.explode(F.sequence(F.lit(1), "copies"))).where("copies > 0")
        else:
            want = kept
        if want is not None:
            assert ids[name] == Counter(r.doc_id for r in want.select("doc_id").collect())
        kept = out
    assert len(ids["toxicity"]) > len(ids["near_duplicates"]) >= len(ids["decontamination"])
    run = corpus_pipeline.run(spark, SF)
    assert Counter(r.doc_id for r in run.collect()) == ids["token_records"]
