"""Query of the fingerprints.  The hash is not one SQL engines share; tests hold it against brute force."""

from pyspark.sql import functions as F

from lectern.llm.fingerprint import containment, edited_documents, likeness, printed


def op6_fingerprint(spark, sf_dir):
    docs = edited_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    own, edited = F.col("sketch"), F.col("edited_sketch")
    least, edited_least = F.col("sketch_least"), F.col("edited_sketch_least")
    return docs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        printed(own, least).alias("fingerprint"), printed(edited, edited_least).alias("edited_fingerprint"),
        likeness(own, edited, least, edited_least).alias("near_edited"), likeness(own, F.col("next_sketch"), least, F.col("next_sketch_least")).alias("near_next"),
        containment(own, edited, least).alias("contained_in_edited"),
    )


QUERIES = {"op6_fingerprint": op6_fingerprint}
ORACLE_SQL: dict = {}
