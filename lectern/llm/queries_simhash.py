"""Query of the SimHash operator.  Brute force in the tests takes the place of SQL."""

from pyspark.sql import functions as F

from lectern.llm.simhash import near_duplicates


def op4_simhash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
ORACLE_SQL: dict = {}
