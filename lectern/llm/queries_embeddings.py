"""Query and SQL of the embedding near-duplicates."""

from lectern.llm.embedding_dups import near_duplicates


def op9_embeddings(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op9_embeddings": op9_embeddings}
ORACLE_SQL: dict = {}
