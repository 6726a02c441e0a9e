"""Query of the BPE operator.  SQL cannot express it; tests hold it against the tiktoken library."""

import public_tokenizers

from lectern.llm.bpe import round_trip


def op5_bpe(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op5_bpe": op5_bpe}
ORACLE_SQL: dict = {}
