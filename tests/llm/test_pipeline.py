"""The pipeline and the registered queries against brute force on the smallest tables."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests_llm_hand import cut_by_hand, hand_components, hand_fingerprint, lines_by_hand
from tidelog.llm import queries, toxicity

SF = "/root/testdata/sf0.001"
tokenizers = pytest.importorskip("tokenizers")


def test_run_by_hand(spark, vocabulary, lowered, words):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    of = toxicity.train(docs, labels).scorer()
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if of(r.text) < corpus_pipeline.TOXIC]
    assert 0 < len(rows) < docs.count()
    rows = [(k, t) for k, _, _, t in lines_by_hand(rows, lowered)]
    least = hand_components([hand_fingerprint(t, lowered) for _, t in rows], [k for k, _ in rows])
    rows = [(k, t) for (k, t), c in zip(rows, least, strict=True) if k == c]
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = [(k, new) for k, t in rows if (new := cut_by_hand(t, items, words)) is not None]
    lib = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = sorted((k, tuple(lib.encode(t or "", add_special_tokens=False).ids), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in rows)
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in got.collect()) == want
    assert got.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_stages_keep_columns_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x y z", "en", "s", 5), (2, "", "en", "s", 0)], docs.schema)
    for rows in (docs.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, SF)
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
            assert out.count() == (0 if rows is not odd else 2 if name.startswith("SimHash") else 4), name
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() == (0 if rows is not odd else 4)


def test_queries_return_all_rows(spark):
    of = queries.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in of) == list(range(1, 11))
    docs, pages = spark.read.parquet(f"{SF}/documents.parquet").count(), spark.read.parquet(f"{SF}/pages.parquet").count()
    columns = {
        "op1": "doc_id start n_tokens ids_crc32", "op2": "doc_id n_lines n_dropped kept_sha256", "op3": "doc_id n_tokens ids_sha256 decoded_sha256", "op4": "page_id text", "op5": "query_id rank vec_id score",
        "op6": "doc_id size text_crc32 law shard slot grown_shard", "op7": "doc_id n_words n_hit n_items items_sha256 contaminated", "op8": "doc_id held_out score predicted", "op9": "doc_id fingerprint component_id", "op10": "page_id payload_bytes payload_digest record_type refers_to",
    }
    for name, f in of.items():
        got = f(spark, SF)
        assert got.columns == columns[name.split("_")[0]].split(), name
        if not name.startswith("op5"):
            assert got.count() == (pages if name.split("_")[0] in ("op4", "op10") else docs), name
