"""Query op13: bytes of strings of 50 that also begin in a document with a smaller id."""

from pyspark.sql import functions as F

from fieldloom.llm.suffix_dedup import without_repeats
from fieldloom.session import table


def op13_suffix_dedup(spark, sf_dir):
    size = lambda r: r["end"] - r["start"]
    return without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + size(r)).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {"op13_suffix_dedup": op13_suffix_dedup}

#: All strings of 50 bytes, as hexadecimal digits, with the smallest document of each.
ORACLES = {
    "op13_suffix_dedup": """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(n - 49)) AS i FROM d WHERE n >= 50 AND doc_id IS NOT NULL)),
m AS (SELECT s, min(doc_id) AS top FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 50, true) AS fresh FROM w JOIN m USING (s) WHERE doc_id > top),
s AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM (SELECT r, i, sum(fresh::INT) OVER (PARTITION BY r ORDER BY i) AS k FROM g) GROUP BY r, k),
p AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM s),
k AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS tail, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM p JOIN d USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head || substr(h, 2 * tail + 1), h))) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""
}
