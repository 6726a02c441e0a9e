"""Query of the toxicity scores."""

from lectern.llm.toxicity import score, train


def op1_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLE_SQL: dict = {}
