"""Query and SQL of the archive round trip."""

from lectern.llm.warc import round_trip


def op8_warc(spark, sf_dir):
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op8_warc": op8_warc}

ORACLE_SQL = {
    "op8_warc": """
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT payload_digest, min(page_id) AS first_id FROM payloads WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_id IS NOT NULL AND f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM payloads p LEFT JOIN firsts f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100"""
}
