"""The pipeline against its stages' own definitions, one by one."""

import hashlib
import re

import public_tokenizers
import tiktoken
from test_decontamination import plain as hits
from test_near_duplicates import plain as groups

import corpus_pipeline
from tallyforge.llm import byte_bpe, pii, toxicity


def test_stages(spark):
    sf = "/root/testdata/sf0.01"  # the smallest tables with labels enough
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, sf)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "toxicity":
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            bad = {r.doc_id for r in toxicity.scored(spark.createDataFrame(list(before.values())), labels).where("predicted = 1").collect()}
            assert bad and set(after) == set(before) - bad
        elif name == "near_duplicates":
            assert set(after) == {d for d, _, _, kept in groups([(d, r.text) for d, r in before.items()], 80) if kept}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(after) == {d for d, *_, hit in hits([(d, r.text) for d, r in before.items()], items) if not hit}
        else:
            assert set(after) == set(before)
            assert all(after[d].text == pii.redact(r.text) and after[d].n_chars == len(after[d].text) for d, r in before.items())
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()}
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.codec(path, public_tokenizers.PATTERN).whole, special_tokens={})
    assert set(last) == set(after)
    for d, r in after.items():
        ids = library.encode_ordinary(r.text)
        assert (last[d].n_tokens, last[d].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == sorted(tuple(r) for r in last.values())


def test_odd_rows_pass_through(spark, sf):
    odd = [(1, None, None, None, None), (2, "", "en", None, 0), (3, "a b c d e f g", "en", "s", 13), (4, "A b c d e f g", "en", "s", 13), (None, "lone row", "en", "s", 8)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted((r.doc_id or 0 for r in docs.collect())) == [0, 1, 2, 3]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0 and re
