"""Query of the repeated passages."""

from lectern.llm.repeats import repeated_passages


def op10_repeats(spark, sf_dir):
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_repeats": op10_repeats}
ORACLE_SQL: dict = {}
