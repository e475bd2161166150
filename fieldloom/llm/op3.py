"""Query op3: documents in 24 contiguous shards of nearly equal bytes."""

from pyspark.sql import functions as F

from fieldloom.llm.sharding import shard_by_bytes
from fieldloom.session import table


def op3_sharding(spark, sf_dir):
    placed = shard_by_bytes(table(spark, sf_dir, "documents"), 24)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op3_sharding": op3_sharding}

#: CRC-32 of the UTF-8 bytes by the usual byte table, which a recursion-free list expression builds.
ORACLES = {
    "op3_sharding": """
WITH bits AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(strlen(text), 0) + 8 AS size FROM documents),
c AS (SELECT doc_id, size, CASE WHEN t = '' THEN 0 ELSE xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(strlen(t)), lambda i: ('0x' || hex(encode(t))[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) END AS text_crc32 FROM d, bits),
s AS (SELECT *, sum(size) OVER w - size AS before, sum(size) OVER () AS whole FROM c
  WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, least(23, (before * 24) // whole)::INT AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  NULL::INT AS grown_shard FROM p"""
}
