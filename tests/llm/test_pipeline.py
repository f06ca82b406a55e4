"""The corpus pipeline against brute force, and the registered queries."""

import zlib

import numpy as np

import __spark_entry__
import corpus_pipeline
from stratamesh.llm import packing, pii

from .test_corpus_operators import brute_components
from .test_text_operators import brute_hits


def test_stages_match_brute_force(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, items = docs.columns, [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    model = None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        if name == "PII":
            model = pii.model_of(docs)
        out = stage(spark, docs, data)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == columns
            after = {r.doc_id: r.text for r in out.collect()}
        if name == "language ID":
            assert len(after) > 0.97 * len(before)
        elif name == "n-gram Jaccard join":
            rows = list(before.items())
            assert set(after) == {c for i, _, c in brute_components(rows, 5, 80) if c == i}
        elif name == "benchmark decontamination":
            hits = {i: brute_hits(t, items) for i, t in before.items() if i % 5 == 0}
            assert {i for i in hits if i in after} == {i for i, (n, h, _) in hits.items() if not (h and 20 * h >= n)}
        elif name == "PII":
            for i, t in before.items():
                spans = pii.spans(t, model)[1]
                assert (after[i] == t) == (not spans) and not pii.base_spans(after[i])
        else:
            rows = out.toPandas()
            encode = packing.encoder()
            total = 0
            for i, t in before.items():
                ids = np.frombuffer(encode(t), dtype="<u4")
                total += len(ids)
                first = rows[(rows.doc_id == i) & (rows.piece == 0)].iloc[0]
                assert first.ids_crc32 == zlib.crc32(ids[:4096].tobytes())
            assert rows.length.sum() == total and rows.sequence_id.nunique() <= 1.02 * total / 4096 + 1
        docs = out


def test_one_query_for_each_operator():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
