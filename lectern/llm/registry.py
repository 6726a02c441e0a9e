"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

import corpus_pipeline
from lectern.llm import (
    queries_bpe,
    queries_embeddings,
    queries_fingerprint,
    queries_mixing,
    queries_pii,
    queries_repeats,
    queries_secrets,
    queries_simhash,
    queries_toxicity,
    queries_warc,
)

_modules = [queries_toxicity, queries_pii, queries_mixing, queries_simhash, queries_bpe, queries_fingerprint, queries_secrets, queries_warc, queries_embeddings, queries_repeats]

QUERIES = {"pipeline": corpus_pipeline.run} | {name: query for m in _modules for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _modules for name, sql in m.ORACLE_SQL.items()}
