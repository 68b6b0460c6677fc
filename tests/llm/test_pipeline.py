import re

import public_tokenizers
from tests.llm.test_join import naive
from tests.llm.test_texts import naive_contamination
from tokenizers import Tokenizer

import corpus_pipeline
from sieveline.llm import secret_scans


def test_stages_do_what_brute_force_does(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = corpus_pipeline.language(spark, docs, sf)
    rows = [(r.doc_id, r.text) for r in first.collect()]
    assert {d for d, _ in rows} <= {r.doc_id for r in docs.collect()} and len(rows) > 0.95 * docs.count()
    assert first.columns == docs.columns

    second = corpus_pipeline.near_duplicates(spark, docs, sf)
    expected = naive([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in second.collect()} == {d for d in expected if expected[d] == d}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    third = corpus_pipeline.benchmark(spark, docs, sf)
    some = [r for r in docs.collect() if len(r.text) < 3000]
    bad = {r.doc_id for r in some if naive_contamination(r.text, items)[-1]}
    assert {r.doc_id for r in third.collect()} & {r.doc_id for r in some} == {r.doc_id for r in some} - bad

    fourth = {r.doc_id: r.text for r in corpus_pipeline.secrets(spark, docs, sf).collect()}
    for r in docs.collect():
        assert fourth[r.doc_id] == secret_scans.redact(r.text) and not secret_scans.find_secrets(fourth[r.doc_id])[0]


def test_run_packs_what_the_stages_keep(spark, sf):
    found = corpus_pipeline.run(spark, sf).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    total = {}
    for r in found:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    for d, n in total.items():
        if not re.search("password|secret|token|AKIA|[0-9a-f]{24}", texts[d], re.IGNORECASE):
            assert n == len(tokenizer.encode(texts[d], add_special_tokens=False).ids) + 1
    assert 0 < len(total) < len(texts)
