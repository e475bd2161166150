"""Query op12: periodic runs of words in all documents, a tenth of which are given periods first."""

from pyspark.sql import functions as F

from fieldloom.llm.word_runs import periodic_runs
from fieldloom.session import table

BLANKS = r"[\x20\x09-\x0D]+"


def planted(docs):
    """``docs`` with the text of every document whose crc32 of the id ends in 0 made periodic from a word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", BLANKS), lambda x: x != "")
    parts = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n = F.size("w")
    parts = parts.withColumn("n", n).withColumn("a", F.expr("CASE WHEN n > 0 THEN CAST(g % n AS INT) END"))
    parts = parts.withColumn("p", F.expr("CAST(1 + (n - a) DIV (3 + g % 8) AS INT)"))
    again = F.expr("concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), CAST(ceil((n - a) / p) AS INT))), 1, n - a))")
    return parts.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir):
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    best = F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    found = found.withColumn("best", F.get(best, F.lit(0)))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    length, period = -F.col("best.shorter"), F.col("best.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}

#: Pairs of equal words at each distance, gathered into stretches; a stretch inside one of a smaller period isn't a run.
ORACLES = {
    "op12_periodic_runs": """
WITH bits AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(doc_id::VARCHAR)), lambda i: ord((doc_id::VARCHAR)[i + 1])::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, bits),
e AS (SELECT r, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN planted THEN g % n END AS a, CASE WHEN planted THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM e),
t AS MATERIALIZED (SELECT r, i, n, w[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM f)),
q AS (SELECT x.r, x.i, y.i - x.i AS q FROM t AS x JOIN t AS y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT r, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM q) GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
u AS MATERIALIZED (SELECT * FROM s WHERE NOT EXISTS (FROM s AS z WHERE z.r = s.r AND z.q < s.q AND z.s <= s.s AND z.s + z.len >= s.s + s.len)),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM u),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS body FROM t ANTI JOIN gone USING (r, i) GROUP BY r),
b AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
  min(struct_pack(a := -len, b := s, c := q)) AS best FROM u GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.b AS start, -best.a AS length, best.c AS period, -best.a * 1000 // best.c AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (r) LEFT JOIN kept USING (r)"""
}
