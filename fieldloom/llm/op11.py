"""Query op11: 40 clusters of the embeddings by bit-plane popcounts, five rounds."""

import hashlib

from pyspark.sql import functions as F

from fieldloom.llm.bitplane_clusters import clusters
from fieldloom.session import table

K, ROUNDS, SCALE, DIM = 40, 5, 256, 64


def start_key(vec_id):
    return F.sha2(F.concat(F.lit("2:"), vec_id.cast("string")), 256)


def op11_bitplane_clusters(spark, sf_dir):
    found, centroids = clusters(table(spark, sf_dir, "embeddings"), start_key, k=K, rounds=ROUNDS, scale=SCALE, dim=DIM)
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = found.agg(F.sum("distance").alias("inertia"))
    each = sums.join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster").crossJoin(F.broadcast(whole))
    return found.join(F.broadcast(each), "cluster").select(  # 40 rows
        F.col("id").cast("long").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


QUERIES = {"op11_bitplane_clusters": op11_bitplane_clusters}


def _round(n: int) -> str:
    """Assignment to the centroids c<n> and, for all but the last, the centroids c<n+1>."""
    sql = f"""
a{n} AS MATERIALIZED (SELECT r, vec_id, v, c.cluster, d FROM (SELECT r, vec_id, v, unnest(near) AS b FROM (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, [min(struct_pack(d := list_inner_product(v, v) - 2 * list_inner_product(v, c.m) + list_inner_product(c.m, c.m), cluster := c.cluster))] AS near
  FROM k CROSS JOIN c{n} AS c GROUP BY r)), LATERAL (SELECT b.cluster AS cluster, b.d::BIGINT AS d) AS c)"""
    if n < ROUNDS:
        sql += f""",
s{n} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v)::BIGINT AS x, unnest(range({DIM})) AS i FROM a{n}) GROUP BY ALL),
c{n + 1} AS MATERIALIZED (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i)::DOUBLE[] AS m FROM s{n} GROUP BY cluster
  UNION ALL SELECT * FROM c{n} WHERE cluster NOT IN (SELECT cluster FROM s{n}))"""
    return sql


ORACLES = {
    "op11_bitplane_clusters": f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1)::INT AS cluster, v AS m
  FROM k WHERE vec_id IS NOT NULL ORDER BY sha256('2:' || vec_id), v LIMIT {K}),
{",".join(_round(n) for n in range(ROUNDS + 1))},
f AS (SELECT cluster, sha256(array_to_string(list_transform(m, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM c{ROUNDS})
SELECT vec_id, cluster, d AS distance, sum(d) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN f USING (cluster)"""
}
