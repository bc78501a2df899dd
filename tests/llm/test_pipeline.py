import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from chromaframe.llm import toxicity

from .test_chosen_path import brute as near_groups
from .test_content_sort import brute as exact_groups


def test_run_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    model = toxicity.fit(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if scores[r.doc_id] < toxicity.THRESHOLD}
    keep = exact_groups(rows.items())
    rows = {i: t for i, t in rows.items() if keep[i][0] == i}
    groups = near_groups(rows.items(), words=5)
    rows = {i: t for i, t in rows.items() if groups[i][1] == i}
    rows = {i: t for i, t in rows.items() if not any(b in t for b in bench)}

    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {p.doc_id for p in pieces} == set(rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for p in pieces:
        ids = np.array([*tokenizer.encode(rows[p.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert 0 < docs.count()
