"""Catalogue search, pairing of files, profiles, GeoJSON and layer files, text retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.session import cut
from fieldloom.sources.geojson import read_geojson  # noqa: F401

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def write_geojson(df: DataFrame, path: str, ring: str = "ring") -> None:
    """One polygon feature a line, all other columns as properties."""
    rest = F.struct(*[c for c in df.columns if c != ring])
    coordinates = F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates"))
    df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), rest.alias("properties"), geometry.alias("geometry"))).alias("value")).write.mode("overwrite").text(path)


def write_layer(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    kind = "orc" if path.endswith(".orc") else "json" if path.endswith((".json", ".jsonl")) else "parquet"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).format(kind).save(path)


def read_layer(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    kind = "orc" if path.endswith(".orc") else "json" if path.endswith((".json", ".jsonl")) else "parquet"
    reader = spark.read.format(kind)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def vector_profile(df: DataFrame, kind: str) -> DataFrame:
    """Per kind: rows and bounds."""
    return df.groupBy(kind).agg(F.count("*").alias("n"), F.min("x0").alias("minx"), F.min("y0").alias("miny"), F.max("x1").alias("maxx"), F.max("y1").alias("maxy"))


def layer_profile(df: DataFrame, key: str, kind: str, sample: int = 3) -> DataFrame:
    """(section, name, value) rows: number of rows, rows of each geometry kind, fields, bounds, first rows by key."""
    def rows(section: str, part: DataFrame, name, value) -> DataFrame:
        return part.select(F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("string").alias("value"))

    bounds = df.agg(F.min("x0").alias("minx"), F.min("y0").alias("miny"), F.max("x1").alias("maxx"), F.max("y1").alias("maxy"), F.count("*").alias("n"))
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in ("minx", "miny", "maxx", "maxy")]))
    fields = df.sparkSession.createDataFrame(list(enumerate(df.columns)), "at int, name string")
    parts = [
        rows("count", bounds, F.lit("rows"), F.col("n")),
        rows("geometry", df.groupBy(kind).count(), F.col(kind), F.col("count")),
        rows("field", fields, F.col("name"), F.col("at")),
        rows("bounds", bounds.select(sides.alias("s")), F.col("s.k"), F.col("s.v")),
        rows("sample", df.select(key, kind).orderBy(key).limit(sample), F.col(key), F.col(kind)),
    ]
    return reduce(DataFrame.unionByName, parts)


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: min, max, mean, nulls, in one pass."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("e")).select("e.*")
    return long.groupBy("name").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), (F.count("*") - F.count("value")).alias("nulls"))


def catalog_search(items: DataFrame, collection: str, box: tuple[float, float, float, float], start: str, end: str, where: str = "true", max_items: int = 100) -> DataFrame:
    """Items of a collection that meet the box and lie in [start, end], the first by date and id."""
    x0, y0, x1, y1 = box
    meet = (F.col("minx") <= x1) & (F.col("maxx") >= x0) & (F.col("miny") <= y1) & (F.col("maxy") >= y0)
    inside = F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return items.where((F.col("collection") == collection) & meet & inside).where(where).orderBy("dt", "id").limit(max_items)


def best_item_per_area(items: DataFrame, area: list[str]) -> DataFrame:
    """The item with the least cloud of each area; missing cloud counts as 100, ties go to the smaller id."""
    w = W.partitionBy(*area).orderBy(F.coalesce("cloud", F.lit(100.0)), "id")
    return items.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def month_range(day: Column) -> tuple[Column, Column]:
    """First day of the month and first day of the next."""
    first = F.trunc(day, "MM")
    return first, F.add_months(first, 1)


def resolve_asset(assets: Column, base: str) -> Column:
    """The first non-empty href among data, image, tif, tiff, default, else of the first asset; relative ones get a base."""
    named = [F.nullif(assets[k]["href"], F.lit("")) for k in ("data", "image", "tif", "tiff", "default")]
    href = F.coalesce(*named, F.get(F.transform(F.map_values(assets), lambda a: a["href"]), 0))
    return F.when(href.rlike("^[a-z]+://") | href.startswith("/"), href).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), href))


def item_bbox(bbox: Column, ring: Column) -> Column:
    """The box field, else min and max of the first ring."""
    axis = lambda c: F.transform(ring, lambda p: p[c])
    own = F.array(F.array_min(axis("x")), F.array_min(axis("y")), F.array_max(axis("x")), F.array_max(axis("y")))
    return F.coalesce(bbox, F.when(F.size(ring) > 0, own))


def pair_check(images: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(key, missing): keys that one side lacks."""
    a, b = images.select(key, F.lit(1).alias("a")).distinct(), labels.select(key, F.lit(1).alias("b")).distinct()
    both = a.join(b, key, "full_outer").where("a is null or b is null")
    return both.select(key, F.when(F.col("a").isNull(), "image").otherwise("label").alias("missing"))


def pair_counts(images: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """One row: images, labels, paired, and whether the counts are equal and above 0."""
    a, b = images.select(key, F.lit(1).alias("a")).distinct(), labels.select(key, F.lit(1).alias("b")).distinct()
    counts = a.join(b, key, "full_outer").agg(F.count("a").alias("images"), F.count("b").alias("labels"), F.count(F.col("a") + F.col("b")).alias("paired"))
    return counts.withColumn("ok", (F.col("images") == F.col("labels")) & (F.col("images") > 0))


def pair_dates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Files of date A with the first file of date B whose name begins alike: (stem, file_a, file_b)."""
    stem = F.regexp_replace("name", "_[AB].*$", "")
    first = b.groupBy(stem.alias("stem")).agg(F.min("name").alias("file_b"))
    return a.select(stem.alias("stem"), F.col("name").alias("file_a")).join(first, "stem")


def _vector_blocks(vectors: DataFrame, rows: int, prefix: str) -> DataFrame:
    """Vectors packed in blocks of at most ``rows``: (<prefix>ids, <prefix>matrix) as little-endian bytes."""
    import numpy as np
    import pyarrow as pa

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                matrix = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype("<f8")
                ids = part.column("vec_id").to_numpy().astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()]) for x in (ids, matrix)], [f"{prefix}ids", f"{prefix}matrix"])

    slim = vectors.where("embedding is not null and vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return slim.mapInArrow(pack, f"{prefix}ids binary, {prefix}matrix binary")


def _nearest_of(batches, k: int):
    """(query_id, vec_id, distance) of the ``k`` nearest vectors of each query in every pair of blocks."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for ids, matrix, names, asked in zip(*(batch.column(c) for c in ("ids", "matrix", "q_ids", "q_matrix"))):
            ids, names = np.frombuffer(ids.as_buffer(), "<i8"), np.frombuffer(names.as_buffer(), "<i8")
            x, q = np.frombuffer(matrix.as_buffer(), "<f8").reshape(len(ids), -1), np.frombuffer(asked.as_buffer(), "<f8").reshape(len(names), -1)
            n = min(k, len(ids))
            rough = (q * q).sum(1)[:, None] - 2 * (q @ x.T) + (x * x).sum(1)[None]
            slack = 1e-9 * ((q * q).sum(1)[:, None] + (x * x).sum(1).max(initial=0.0)) + 1e-300
            last = np.partition(rough, n - 1, axis=1)[:, n - 1 : n]
            row, col = np.nonzero(rough <= last + slack)  # every vector that may be among the nearest, measured anew
            d = np.sqrt(((x[col] - q[row]) ** 2).sum(1))
            order = np.lexsort((ids[col], d, row))
            row, col, d = row[order], col[order], d[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < n
            yield pa.RecordBatch.from_arrays([pa.array(names[row[keep]]), pa.array(ids[col[keep]]), pa.array(d[keep])], ["query_id", "vec_id", "distance"])


_NEAR = "query_id long, vec_id long, distance double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def top_k_similar(vectors: DataFrame, queries: DataFrame, k: int = 3, block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, distance): nearest stored vectors of each query by Euclidean distance, exact.

    Blocks of the stated queries meet blocks of the vectors, each pair in one step; ties go to the smaller id. Queries
    with the same id and vector count once. Null ids and vectors take no part; all vectors have one length.
    """
    asked = _vector_blocks(queries.select("vec_id", "embedding").distinct(), block, "q_")
    pairs = _vector_blocks(vectors, 4 * block, "").join(asked, how="cross")  # blocks of a stated query set with blocks of all rows
    return _ranked(pairs.mapInArrow(lambda batches: _nearest_of(batches, k), _NEAR), k)


class ProjectionIndex:
    """Euclidean nearest neighbours by bucketed random projections: several tables, each of a few projections in a bucket.

    Vectors that are near fall into one bucket of some table with a high chance; a query reads its buckets and those next
    to them (one step of the projection that is nearest to a border, for each), and the union is measured exactly. ``recall`` of a
    sample of queries against the exact search tells whether the widths suit the data; ``search`` answers queries whose
    buckets hold too few candidates, or all if ``recall`` is below ``target``, by the exact search.
    """

    def __init__(self, vectors: DataFrame, width: float | None = None, tables: int = 8, projections: int = 3, seed: int = 7):
        import numpy as np

        self.vectors = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        first = self.vectors.select(F.size("embedding").alias("n")).first()
        rng = np.random.default_rng(seed)
        self.tables, self.projections, self.dim = tables, projections, first["n"] if first else 0
        self.lines = rng.normal(size=(tables, projections, self.dim))
        self.shift = rng.uniform(size=(tables, projections))
        self.width = width or self._spread()
        self.index = cut(self._keys(self.vectors, probes=0))

    def _spread(self) -> float:
        """A bucket's width: half of the standard deviation of a projection."""
        if not self.dim:
            return 1.0
        dims = [F.stddev_pop(F.col("embedding")[d]) for d in range(self.dim)]
        each = self.vectors.agg(*[x.alias(f"d{i}") for i, x in enumerate(dims)]).first()
        return max(sum((v or 0.0) ** 2 for v in each) ** 0.5 / 2, 1e-9)

    def _keys(self, df: DataFrame, probes: int) -> DataFrame:
        """(vec_id, embedding, bucket) of each table, and of ``probes`` further buckets across the nearest borders."""
        import numpy as np
        import pyarrow as pa

        lines, shift, width, dim = self.lines, self.shift, self.width, self.dim

        def run(batches):
            for batch in batches:
                x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
                for t in range(len(lines)):
                    place = x @ lines[t].T / width + shift[t]
                    cell = np.floor(place).astype(np.int64)
                    found = [cell]
                    inside = place - cell
                    near = np.argsort(np.minimum(inside, 1 - inside), axis=1)
                    for p in range(min(probes, lines.shape[1])):
                        other, axis = cell.copy(), near[:, p]
                        rows = np.arange(len(cell))
                        other[rows, axis] += np.where(inside[rows, axis] < 0.5, -1, 1)
                        found.append(other)
                    for cells in found:
                        key = np.full(len(cells), t, np.uint64)
                        for column in cells.T:
                            key = (key ^ column.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                            key ^= key >> np.uint64(29)
                        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64))], ["vec_id", "embedding", "bucket"])

        return df.mapInArrow(run, "vec_id long, embedding array<double>, bucket long")

    def candidates(self, queries: DataFrame, probes: int = 2) -> DataFrame:
        """(query_id, q, vec_id, embedding): vectors in a query's buckets, each once."""
        asked = self._keys(queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null").distinct(), probes)
        asked = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "bucket")
        ids = asked.select("query_id", "bucket").join(self.index.select("vec_id", "bucket"), "bucket").select("query_id", "vec_id").distinct()
        whole = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("q")).dropDuplicates(["query_id"])
        return ids.join(whole, "query_id").join(self.vectors, "vec_id")

    def near(self, queries: DataFrame, k: int = 3, probes: int = 2) -> DataFrame:
        """(query_id, rank, vec_id, distance) among the candidates only."""
        apart = F.sqrt(F.aggregate(F.zip_with("q", "embedding", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
        return _ranked(self.candidates(queries, probes).select("query_id", "vec_id", apart.alias("distance")), k)

    def recall(self, queries: DataFrame, k: int = 3, probes: int = 2) -> float:
        """Share of the exact ``k`` nearest of the queries that the buckets hold."""
        want = top_k_similar(self.vectors, queries, k)
        got = self.near(queries, k, probes).select("query_id", "vec_id")
        both = want.join(got.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left").agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits")).first()
        return both["hits"] / both["n"] if both["n"] else 1.0

    def search(self, queries: DataFrame, k: int = 3, probes: int = 2, target: float = 0.9, sample: int = 64) -> DataFrame:
        """(query_id, rank, vec_id, distance, exact): the nearest by buckets, or exact where these don't do.

        The recall of ``sample`` queries decides between the ways; queries with fewer than ``k`` candidates are always exact.
        """
        some = queries.orderBy(F.xxhash64("vec_id")).limit(sample)
        if self.recall(some, k, probes) < target:
            return top_k_similar(self.vectors, queries, k).withColumn("exact", F.lit(True))
        found = cut(self.near(queries, k, probes))
        enough = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n")).where(F.col("n") >= k).select("vec_id")
        short = queries.join(enough, "vec_id", "left_anti")
        fast = found.join(enough.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").withColumn("exact", F.lit(False))
        return fast.unionByName(top_k_similar(self.vectors, short, k).withColumn("exact", F.lit(True)))


def chunk_fixed(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk_no, text): plain chunks of ``size`` characters that overlap."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.char_length("text") - overlap - 1, F.lit(0)), F.lit(step))
    cut = docs.where("text is not null").select("doc_id", "text", F.posexplode(starts).alias("chunk_no", "at"))
    return cut.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.substring("text", F.col("at") + 1, F.lit(size)).alias("text"))


def index_vectors(df: DataFrame, name: str, buckets: int, key: str = "vec_id") -> None:
    """Store vectors (or chunks) as a table bucketed and sorted by their key: later joins on the key don't shuffle it."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)
