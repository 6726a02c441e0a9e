import hashlib

import public_tokenizers
from conftest import SF
from test_whole_pipeline import kept as similar_kept

import corpus_pipeline
from lectern.llm import bpe, mixing, secrets, toxicity


def test_stages_equal_brute_force(spark):
    """Each stage against plain Python on its own input; the last against the tokenizer."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        before = docs.collect()
        if name == "toxicity":
            scorer = toxicity.Scorer(toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet")))
            want = {r.doc_id for r, s in zip(before, scorer([r.text for r in before]), strict=True) if s < 0.5}
            assert {r.doc_id for r in rows} == want and len(want) >= 0.8 * len(before)
        elif name == "simhash":
            assert sorted(r.doc_id for r in rows) == similar_kept([(r.doc_id, r.text) for r in before])
        elif name == "secrets":
            assert {r.doc_id: r.text for r in rows} == {r.doc_id: secrets.masked(r.text) for r in before}
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "mixing":
            plan = {r.doc.doc_id: r.copies for r in mixing.plan_mix(docs).collect()}
            assert sorted(r.doc_id for r in rows) == sorted(i for i, n in plan.items() for _ in range(n))
        else:
            codec = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
            texts = {r.doc_id: r.text for r in before}
            assert len(rows) == len(before) and all(r.n_tokens == len(codec.encode(texts[r.doc_id])) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(rows, out.schema)
        kept[name] = len(rows)
    assert corpus_pipeline.run(spark, SF).count() == kept["bpe"]
