"""Query and SQL of the mixing operator."""

from pyspark.sql import functions as F

from lectern.llm.mixing import plan_mix


def op3_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return plan_mix(docs).select(
        F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


QUERIES = {"op3_mixing": op3_mixing}

PLANNED_SQL = r"""
measured AS (
  SELECT doc_id, text, lang, source, n_chars,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM {docs}
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM measured GROUP BY source
), weighted AS (
  SELECT source, source_size, 2 * source_size AS cap,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM sizes
), leveled AS (
  SELECT *,
         (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
           - coalesce(sum(cap) OVER earlier, 0)::DOUBLE)
         / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0))::DOUBLE AS unit
  FROM weighted
  WINDOW earlier AS (ORDER BY cap::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, cap::DOUBLE / weight::DOUBLE <= unit AS capped FROM leveled
), targeted AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap::DOUBLE
              ELSE weight::DOUBLE * (SELECT max(unit) FROM marked WHERE NOT capped) END AS target
  FROM marked
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size::DOUBLE, 2.0) ELSE 0.0 END AS rate FROM targeted
), planned AS (
  SELECT m.*, r.source_size, r.target, r.rate,
         floor(r.rate)::BIGINT + CASE WHEN
           ('0x' || substr(md5('17' || chr(31) || coalesce(m.doc_id::VARCHAR, 'null') || chr(31) || coalesce(m.text, '')), 1, 13))::BIGINT::DOUBLE
             / 4503599627370496.0::DOUBLE < r.rate - floor(r.rate)
           THEN 1 ELSE 0 END AS copies
  FROM measured m JOIN rated r ON m.source IS NOT DISTINCT FROM r.source
)"""

ORACLE_SQL = {
    "op3_mixing": "WITH " + PLANNED_SQL.replace("{docs}", "documents") + """
SELECT doc_id, size, source_size, target, copies * size AS taken FROM planned"""
}
