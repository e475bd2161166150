"""The projection index against the exact search."""

import numpy as np

from fieldloom.operators.catalog import ProjectionIndex, top_k_similar
from fieldloom.session import table


def rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id) for r in df.collect())


def test_clustered_vectors_are_found_in_their_buckets(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 5
    data = np.vstack([c + rng.normal(size=(25, 16)) * 0.05 for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(2000, None)], "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 20 = 0 and embedding is not null")
    index = ProjectionIndex(df)
    assert index.recall(queries, 3) >= 0.9
    found = index.search(queries, 3)
    assert found.groupBy("exact").count().where("not exact").first()["count"] > 100
    want = {(q, v) for q, _, v in rows(top_k_similar(df, queries, 3))}
    got = {(q, v) for q, _, v in rows(found)}
    assert len(got & want) >= 0.9 * len(want)
    pairs = index.candidates(queries).count()
    assert pairs < 0.3 * queries.count() * df.count()  # buckets, not all vectors


def test_narrow_buckets_fall_back_to_the_exact_search(spark):
    vectors = table(spark, "/root/testdata/sf0.001", "embeddings")
    queries = vectors.where("vec_id % 50 = 0")
    index = ProjectionIndex(vectors, width=1e-6, tables=2)
    assert index.recall(queries, 3) < 0.9
    assert rows(index.search(queries, 3)) == rows(top_k_similar(vectors, queries, 3))
    assert ProjectionIndex(vectors.limit(0)).near(queries.limit(0)).collect() == []


def test_exact_search_equals_a_plain_one(spark):
    rng = np.random.default_rng(9)
    data = np.round(rng.normal(size=(300, 4)), 1)  # many ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    d = np.sqrt(((data[:, None] - data[None]) ** 2).sum(-1))
    want = sorted((q, k + 1, int(v)) for q in range(0, 300, 7) for k, v in enumerate(np.lexsort((np.arange(300), d[q]))[:5]))
    assert rows(top_k_similar(df, df.where("vec_id % 7 = 0"), 5, block=16)) == want
