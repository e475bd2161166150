"""Evaluation, catalogue, detection and retrieval queries with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import catalog as c
from fieldloom.operators import evaluate as e
from fieldloom.functions.shapes import chunk_text
from fieldloom.sources.fixtures import cte, layer
from fieldloom.streaming import detections as t
from fieldloom.streaming import stateful
from fieldloom.session import table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def rounded(df, names, n=6):
    return df.select(*[F.round(x, n).alias(x) if x in names else x for x in df.columns])


# Evaluation.

MATRIX = cte("classes") + """, m AS (SELECT t AS truth, p AS pred, count(row) AS n FROM range(4) a(t) CROSS JOIN range(4) b(p) LEFT JOIN classes c ON c.truth = t AND c.pred = p GROUP BY ALL),
s AS (SELECT t AS class, (SELECT sum(n) FROM m WHERE truth = t) AS support, (SELECT sum(n) FROM m WHERE pred = t) AS predicted, (SELECT sum(n) FROM m WHERE truth = t AND pred = t) AS tp FROM range(4) a(t)),
k AS (SELECT class, support::BIGINT AS support, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
CASE WHEN support + predicted - tp = 0 THEN 0 ELSE tp / (support + predicted - tp) END AS iou, CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * tp / (support + predicted) END AS dice FROM s)"""
METRICS = ("precision", "recall", "iou", "dice")


def matrix(spark, d):
    return e.confusion_matrix(layer(spark, d, "classes"), 4)


query("confusion_matrix", MATRIX + " SELECT truth, pred, n FROM m")(matrix)
query("class_metrics", MATRIX + " SELECT class, support, " + ", ".join(f"round({x}, 6) AS {x}" for x in METRICS) + " FROM k")(lambda spark, d: rounded(e.class_metrics(matrix(spark, d)), METRICS))
query("mean_metrics", MATRIX + " SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(avg(iou) FILTER (WHERE support > 0), 6) AS miou, round(avg(dice) FILTER (WHERE support > 0), 6) AS mdice FROM k")(
    lambda spark, d: rounded(e.mean_metrics(e.class_metrics(matrix(spark, d))), ("accuracy", "miou", "mdice"))
)
query("classification_report", MATRIX + """, r AS (SELECT class::VARCHAR AS class, precision, recall, dice AS f1, support FROM k)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r
UNION ALL SELECT 'macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM r""")(
    lambda spark, d: rounded(e.classification_report(matrix(spark, d)), ("precision", "recall", "f1"))
)

FOUR = "count(*) FILTER (WHERE {t} = 1 AND {p} = 1)::DOUBLE AS tp, count(*) FILTER (WHERE {t} = 0 AND {p} = 1)::DOUBLE AS fp, count(*) FILTER (WHERE {t} = 1 AND {p} = 0)::DOUBLE AS fn, count(*) FILTER (WHERE {t} = 0 AND {p} = 0)::DOUBLE AS tn"
BINARY = """, r AS (SELECT *, tp + fp + fn + tn AS n, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM c), q AS (SELECT *, (tp + tn) / n AS a, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS pe FROM r)
SELECT tp, fp, fn, tn, round(a, 4) AS oa, round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / greatest(p + r, 1e-8), 4) AS f1, round(tp / greatest(tp + fp + fn, 1), 4) AS iou,
round((a - pe) / greatest(1 - pe, 1e-8), 4) AS kappa, round((tp + fn) / n, 4) AS truth_share, round((tp + fp) / n, 4) AS pred_share FROM q"""
query("binary_change_metrics", "WITH c AS (SELECT " + FOUR.format(t="toxic", p="quality") + " FROM labels)" + BINARY)(lambda spark, d: e.binary_change_metrics(table(spark, d, "labels"), "toxic", "quality"))
query("mask_change_metrics", cte("mask") + ", c AS (SELECT " + FOUR.format(t="v", p="w") + " FROM mask)" + BINARY)(lambda spark, d: e.binary_change_metrics(layer(spark, d, "mask"), "v", "w"))

QUALITY = cte("mask") + ", c AS (SELECT row // 10 AS sample, " + FOUR.format(t="v", p="w") + """ FROM mask GROUP BY 1),
p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END AS re, CASE WHEN tp + fp + fn = 0 THEN 1 ELSE tp / (tp + fp + fn) END AS io FROM c),
q AS (SELECT sample, io AS iou, CASE WHEN 2 * tp + fp + fn = 0 THEN 1 ELSE 2 * tp / (2 * tp + fp + fn) END AS dice, pr AS precision, re AS recall, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f1,
(tp + tn) / (tp + fp + fn + tn) AS accuracy, CASE WHEN tp + fn > 0 THEN abs(fp - fn) / (tp + fn) WHEN tp + fp > 0 THEN 'inf'::DOUBLE ELSE 0 END AS area_error,
CASE WHEN io >= 0.9 THEN 'A' WHEN io >= 0.75 THEN 'B' WHEN io >= 0.5 THEN 'C' ELSE 'D' END AS grade FROM p)"""
SIX = ("iou", "dice", "precision", "recall", "f1", "accuracy")


def quality(spark, d):
    return e.mask_quality(layer(spark, d, "mask").selectExpr("row div 10 AS sample", "v", "w"), "sample", "v", "w")


query("mask_quality", QUALITY + " SELECT sample, " + ", ".join(f"round({x}, 6) AS {x}" for x in (*SIX, "area_error")) + ", grade FROM q")(lambda spark, d: rounded(quality(spark, d), (*SIX, "area_error")))
query("batch_quality", QUALITY + " SELECT count(*) AS n, " + ", ".join(f"round(avg({x}), 6) AS {x}_mean, round(stddev_pop({x}), 6) AS {x}_std" for x in SIX) + " FROM q")(
    lambda spark, d: rounded(e.batch_quality(quality(spark, d)), [f"{x}_{y}" for x in SIX for y in ("mean", "std")])
)
query("change_stats", cte("mask") + """ SELECT count(*) AS total, count(*) FILTER (WHERE v <> w) AS changed, count(*) FILTER (WHERE v = w) AS unchanged, round(100 * avg((v <> w)::INT), 2) AS percent,
round(avg((row * 7 + col) % 100 / 100.0::DOUBLE) FILTER (WHERE v <> w), 6) AS mean_probability, max((row * 7 + col) % 100 / 100.0::DOUBLE) FILTER (WHERE v <> w) AS max_probability FROM mask""")(
    lambda spark, d: rounded(e.change_stats(layer(spark, d, "mask"), F.expr("v <> w"), F.expr("(row * 7 + col) % 100 / 100.0D")), ("mean_probability",))
)
query("class_distribution", cte("samples") + ", x AS (SELECT class, CASE WHEN id % 20 < 14 THEN 'train' WHEN id % 20 < 17 THEN 'val' ELSE 'test' END AS split FROM samples) SELECT split, class, count(*) AS n FROM x GROUP BY ROLLUP (split, class)")(
    lambda spark, d: layer(spark, d, "samples").selectExpr("class", "CASE WHEN id % 20 < 14 THEN 'train' WHEN id % 20 < 17 THEN 'val' ELSE 'test' END AS split").rollup("split", "class").agg(F.count("*").alias("n"))
)
query("manifest_class_pixels", cte("classes") + " SELECT row // 10 AS id, " + ", ".join(f"count(*) FILTER (WHERE truth = {k}) AS class_{k}" for k in range(4)) + " FROM classes GROUP BY 1")(
    lambda spark, d: layer(spark, d, "classes").groupBy(F.expr("row div 10").alias("id")).pivot("truth", list(range(4))).count().na.fill(0).select("id", *[F.col(str(k)).alias(f"class_{k}") for k in range(4)])
)

RUNS = """WITH runs AS (SELECT l_orderkey % 50 AS image, l_returnflag AS method, l_linestatus AS model, sum(l_quantity)::DOUBLE AS count, round(sum(l_extendedprice)::DOUBLE, 2) AS total_area,
CASE WHEN (l_orderkey % 50) % 9 = 4 THEN 'failed' ELSE 'ok' END AS status FROM lineitem GROUP BY ALL)"""


def runs(spark, d):
    return table(spark, d, "lineitem").groupBy(F.expr("l_orderkey % 50").alias("image"), F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("model"), F.expr("CASE WHEN (l_orderkey % 50) % 9 = 4 THEN 'failed' ELSE 'ok' END").alias("status")).agg(
        F.sum("l_quantity").cast("double").alias("count"), F.round(F.sum("l_extendedprice").cast("double"), 2).alias("total_area")
    )


query("best_run", RUNS + " SELECT image, method, model, count, total_area FROM runs WHERE status = 'ok' AND count > 0 QUALIFY row_number() OVER (PARTITION BY image ORDER BY (method = 'R') DESC, count DESC, total_area DESC, method, model) = 1")(
    lambda spark, d: e.best_run(runs(spark, d), "R").select("image", "method", "model", "count", "total_area")
)
query("run_index", RUNS + """ SELECT i AS image, coalesce(string_agg(DISTINCT method, '|' ORDER BY method), '') AS methods, coalesce(string_agg(DISTINCT model, '|' ORDER BY model), '') AS models, max(count) FILTER (WHERE status = 'ok') AS best,
CASE WHEN count(method) = 0 THEN 'skipped' WHEN bool_or(status = 'ok') THEN 'ok' ELSE 'failed' END AS status FROM (SELECT DISTINCT l_orderkey % 51 AS i FROM lineitem) k LEFT JOIN runs ON image = i GROUP BY i""")(
    lambda spark, d: e.run_index(table(spark, d, "lineitem").select(F.expr("l_orderkey % 51").alias("image")).distinct(), runs(spark, d))  # image 50 has no runs
)
query("layer_summary", RUNS + " SELECT method, model, count(*) AS n, round(sum(total_area), 1) AS total_area, round(avg(total_area), 1) AS mean_area FROM runs GROUP BY ALL")(
    lambda spark, d: runs(spark, d).groupBy("method", "model").agg(F.count("*").alias("n"), F.round(F.sum("total_area"), 1).alias("total_area"), F.round(F.avg("total_area"), 1).alias("mean_area"))
)
query("top_k_predictions", cte("classes") + ", p AS (SELECT row AS image, pred AS class, count(*) AS n FROM classes GROUP BY ALL) SELECT image, class, n, row_number() OVER (PARTITION BY image ORDER BY n DESC, class) AS rank FROM p QUALIFY rank <= 3")(
    lambda spark, d: e.top_k(layer(spark, d, "classes").groupBy(F.col("row").alias("image"), F.col("pred").alias("class")).agg(F.count("*").alias("n")), ["image"], "n", "class", 3)
)
query("top_k_winner", cte("classes") + """, n AS (SELECT row AS image, pred AS class, count(*) AS n FROM classes GROUP BY ALL), p AS (SELECT image, class, round(n / sum(n) OVER (PARTITION BY image), 9) AS prob FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY prob DESC, class) AS rank FROM p)
SELECT image, class, prob, rank, first_value(class) OVER w AS winner, round(first_value(prob) OVER w, 6) AS confidence FROM k WINDOW w AS (PARTITION BY image ORDER BY rank) QUALIFY rank <= 5""")(
    lambda spark, d: e.top_k_predictions(
        layer(spark, d, "classes").groupBy(F.col("row").alias("image"), F.col("pred").alias("class")).agg(F.count("*").alias("n")).selectExpr("image", "class", "round(n / sum(n) OVER (PARTITION BY image), 9) AS prob"),
        "image", "class", "prob", 5,
    )
)
query("model_speed_summary", RUNS + """, m AS (SELECT method || model AS model, round(avg(count) / 40, 4) AS fps, round(avg(total_area) / 100000, 4) AS per_frame FROM runs GROUP BY 1)
SELECT model, fps, per_frame, rank() OVER (ORDER BY fps DESC) = 1 AS fastest, rank() OVER (ORDER BY per_frame DESC) = 1 AS most FROM m""")(
    lambda spark, d: runs(spark, d).groupBy(F.concat("method", "model").alias("model")).agg(F.round(F.avg("count") / 40, 4).alias("fps"), F.round(F.avg("total_area") / 100000, 4).alias("per_frame")).selectExpr(
        "*", "rank() OVER (ORDER BY fps DESC) = 1 AS fastest", "rank() OVER (ORDER BY per_frame DESC) = 1 AS most"  # one row a model
    )
)
query("model_speed_ranking", RUNS + """, m AS (SELECT method || model AS model, count(*) AS runs, round(avg(count) / 40, 4) AS fps FROM runs GROUP BY 1)
SELECT model, runs, fps, CASE WHEN fps > 40 THEN 'excellent' WHEN fps > 25 THEN 'good' WHEN fps > 15 THEN 'fair' ELSE 'slow' END AS rating, rank() OVER (ORDER BY fps DESC) AS rank FROM m""")(
    lambda spark, d: runs(spark, d).groupBy(F.concat("method", "model").alias("model")).agg(F.count("*").alias("runs"), F.round(F.avg("count") / 40, 4).alias("fps")).selectExpr(
        "*", "CASE WHEN fps > 40 THEN 'excellent' WHEN fps > 25 THEN 'good' WHEN fps > 15 THEN 'fair' ELSE 'slow' END AS rating", "cast(rank() OVER (ORDER BY fps DESC) AS bigint) AS rank"
    )
)
query("choropleth_class", "SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN 'none' ELSE (least(greatest(floor(c_acctbal::DOUBLE / 5000 * 5), 0), 4))::INT::VARCHAR END AS ramp FROM customer")(
    lambda spark, d: table(spark, d, "customer").selectExpr("c_custkey", "CASE WHEN c_acctbal IS NULL THEN 'none' ELSE cast(int(least(greatest(floor(cast(c_acctbal AS double) / 5000 * 5), 0), 4)) AS string) END AS ramp")
)


ORDERED = "row_number() OVER (PARTITION BY {by} ORDER BY md5('42:' || id::VARCHAR), id) AS pos, count(*) OVER (PARTITION BY {by}) AS n"


@query("split_stratified", cte("samples") + f""", o AS (SELECT id, class, {ORDERED.format(by="class")} FROM samples)
SELECT id, class, CASE WHEN pos <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN pos <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM o""")
def split_stratified(spark, d):
    return e.split_stratified(layer(spark, d, "samples"), "id", "class")


@query("split_holdout", cte("samples") + f""", o AS (SELECT id, class, {ORDERED.format(by="1")} FROM samples)
SELECT id, class, CASE WHEN pos <= greatest(1, round(n * 0.2::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM o""")
def split_holdout(spark, d):
    return e.split_holdout(layer(spark, d, "samples"), "id", 0.2)


ISSUES = cte("boxes") + """, i AS (SELECT fid, 'Sliver' AS error_type, 'LOW' AS severity, true AS auto_fixable FROM boxes WHERE (x1 - x0) * (y1 - y0) < 30
UNION ALL SELECT fid, 'Wide', 'HIGH', false FROM boxes WHERE x1 - x0 > 3 * (y1 - y0))"""


@query("issue_report", ISSUES + " SELECT error_type, severity, count(*) AS n, round(avg(auto_fixable::INT), 6) AS fixable FROM i GROUP BY GROUPING SETS ((error_type), (severity), ())")
def issue_report(spark, d):
    b = layer(spark, d, "boxes")
    one = b.where("(x1 - x0) * (y1 - y0) < 30").selectExpr("fid", "'Sliver' AS error_type", "'LOW' AS severity", "true AS auto_fixable")
    two = b.where("x1 - x0 > 3 * (y1 - y0)").selectExpr("fid", "'Wide' AS error_type", "'HIGH' AS severity", "false AS auto_fixable")
    return rounded(e.issue_report(one.unionByName(two)), ("fixable",))


# Catalogue and profiles.

query("catalog_search", cte("items") + " SELECT id, dt, cloud FROM items WHERE collection = 'O' AND minx <= 60 AND maxx >= 20 AND miny <= 30 AND maxy >= 5 AND dt BETWEEN '1996-01-01' AND '1997-12-31' AND cloud < 40 ORDER BY dt, id LIMIT 50")(
    lambda spark, d: c.catalog_search(layer(spark, d, "items"), "O", (20, 5, 60, 30), "1996-01-01", "1997-12-31", "cloud < 40", 50).select("id", "dt", "cloud")
)
query("best_item_per_area", cte("items") + " SELECT minx, miny, id, cloud FROM items QUALIFY row_number() OVER (PARTITION BY minx, miny ORDER BY coalesce(cloud, 100), id) = 1")(
    lambda spark, d: c.best_item_per_area(layer(spark, d, "items"), ["minx", "miny"]).select("minx", "miny", "id", "cloud")
)
query("month_range", cte("items") + " SELECT id, date_trunc('month', dt)::DATE AS first, (date_trunc('month', dt) + INTERVAL 1 MONTH)::DATE AS next FROM items")(
    lambda spark, d: layer(spark, d, "items").select("id", c.month_range(F.col("dt"))[0].alias("first"), c.month_range(F.col("dt"))[1].alias("next"))
)
query("resolve_asset", cte("items") + " SELECT id, CASE WHEN id % 3 = 0 THEN 'https://x/' || id WHEN id % 3 = 1 THEN 'base/' || id || '.tif' ELSE 'base/first' END AS href FROM items")(
    lambda spark, d: layer(spark, d, "items").selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN map('data', named_struct('href', concat('https://x/', id))) WHEN id % 3 = 1 THEN map('tif', named_struct('href', concat(id, '.tif'))) ELSE map('other', named_struct('href', 'first')) END AS assets"
    ).select("id", c.resolve_asset(F.col("assets"), "base").alias("href"))
)
query("item_bbox", cte("items") + " SELECT id, minx AS a, miny AS b, maxx AS c, maxy AS d FROM items")(
    lambda spark, d: layer(spark, d, "items").selectExpr("id", "CASE WHEN id % 2 = 0 THEN array(minx, miny, maxx, maxy) END AS bbox", "array(named_struct('x', minx, 'y', maxy), named_struct('x', maxx, 'y', miny)) AS ring").select("id", c.item_bbox(F.col("bbox"), F.col("ring")).alias("b")).selectExpr("id", "b[0] AS a", "b[1] AS b", "b[2] AS c", "b[3] AS d")
)
query("pair_check", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'image' ELSE 'label' END AS missing FROM documents WHERE (doc_id % 7 = 0) <> (doc_id % 5 = 0)")(
    lambda spark, d: c.pair_check(table(spark, d, "documents").where("doc_id % 7 <> 0"), table(spark, d, "documents").where("doc_id % 5 <> 0"), "doc_id")
)
query("pair_counts", """WITH p AS (SELECT doc_id % 7 <> 0 AS a, doc_id % 5 <> 0 AS b FROM documents)
SELECT count(*) FILTER (a) AS images, count(*) FILTER (b) AS labels, count(*) FILTER (a AND b) AS paired, count(*) FILTER (a) = count(*) FILTER (b) AND count(*) FILTER (a) > 0 AS ok FROM p""")(
    lambda spark, d: c.pair_counts(table(spark, d, "documents").where("doc_id % 7 <> 0"), table(spark, d, "documents").where("doc_id % 5 <> 0"), "doc_id")
)
query("pair_dates", "WITH f AS (SELECT o_orderkey % 97 AS k, o_orderkey FROM orders), b AS (SELECT 't' || k AS stem, min('t' || k || '_B' || o_orderkey) AS file_b FROM f WHERE o_orderkey % 3 = 0 GROUP BY 1) SELECT 't' || k AS stem, 't' || k || '_A' || o_orderkey AS file_a, file_b FROM f JOIN b ON b.stem = 't' || k WHERE o_orderkey % 3 = 1")(
    lambda spark, d: c.pair_dates(table(spark, d, "orders").where("o_orderkey % 3 = 1").selectExpr("concat('t', o_orderkey % 97, '_A', o_orderkey) AS name"), table(spark, d, "orders").where("o_orderkey % 3 = 0").selectExpr("concat('t', o_orderkey % 97, '_B', o_orderkey) AS name"))
)
query("vector_profile", cte("boxes") + " SELECT p_brand, count(*) AS n, min(x0) AS minx, min(y0) AS miny, max(x1) AS maxx, max(y1) AS maxy FROM boxes GROUP BY p_brand")(lambda spark, d: c.vector_profile(layer(spark, d, "boxes"), "p_brand"))
query("layer_profile", cte("boxes") + """, b AS (SELECT *, CASE WHEN x1 - x0 > y1 - y0 THEN 'wide' ELSE 'tall' END AS kind FROM boxes)
SELECT 'count' AS section, 'rows' AS name, count(*)::VARCHAR AS value FROM b UNION ALL SELECT 'geometry', kind, count(*)::VARCHAR FROM b GROUP BY kind
UNION ALL SELECT 'field', name, pos::VARCHAR FROM (VALUES ('fid', 0), ('x0', 1), ('y0', 2), ('x1', 3), ('y1', 4), ('p_brand', 5), ('p_type', 6), ('kind', 7)) f(name, pos)
UNION ALL SELECT 'bounds', 'minx', min(x0)::VARCHAR FROM b UNION ALL SELECT 'bounds', 'miny', min(y0)::VARCHAR FROM b UNION ALL SELECT 'bounds', 'maxx', max(x1)::VARCHAR FROM b UNION ALL SELECT 'bounds', 'maxy', max(y1)::VARCHAR FROM b
UNION ALL SELECT 'sample', fid::VARCHAR, kind FROM (SELECT * FROM b ORDER BY fid LIMIT 3)""")(
    lambda spark, d: c.layer_profile(layer(spark, d, "boxes").withColumn("kind", F.expr("if(x1 - x0 > y1 - y0, 'wide', 'tall')")), "fid", "kind")
)
query("numeric_profile", cte("items") + " SELECT name, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, count(*) - count(value) AS nulls FROM (SELECT 'minx' AS name, minx AS value FROM items UNION ALL SELECT 'miny', miny FROM items UNION ALL SELECT 'cloud', cloud FROM items) GROUP BY name")(
    lambda spark, d: rounded(c.numeric_profile(layer(spark, d, "items"), ["minx", "miny", "cloud"]), ("mean",))
)

# Detections.

DET = """WITH r AS (SELECT *, user_id % 8 AS camera, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) - 1 AS frame FROM events),
det AS (SELECT camera, frame, epoch_ms((1704067200 + 2 * frame) * 1000) AS ts, 1704067200 + 2 * frame AS sec, user_id AS track_id, CASE event_type WHEN 'click' THEN 'person' WHEN 'view' THEN 'car' WHEN 'purchase' THEN 'truck' WHEN 'signup' THEN 'bus' ELSE 'other' END AS class_name,
  (event_id % 100) / 100.0::DOUBLE AS confidence, CASE WHEN user_id % 3 = 0 THEN 100 + user_id % 50 ELSE (event_id * 37) % 1800 END AS x1, CASE WHEN user_id % 3 = 0 THEN 200 + user_id % 50 ELSE (event_id * 53) % 1000 END AS y1 FROM r)"""


def det(spark, d):
    return t.detections(table(spark, d, "events"))


query("target_class_filter", DET + " SELECT camera, frame, class_name FROM det WHERE class_name IN ('person', 'car') AND confidence >= 0.5")(lambda spark, d: t.target_class_filter(det(spark, d), ["person", "car"], 0.5).select("camera", "frame", "class_name"))
query("zone_label", DET + """, k AS (SELECT camera, frame, floor((x1 + x1 + 40) / 2) AS cx, floor((y1 + y1 + 60) / 2) AS cy FROM det)
SELECT camera, frame, CASE WHEN cx < 576 THEN 'left' WHEN cx > 1344 THEN 'right' ELSE 'center' END || CASE WHEN cy < 324 THEN '_top' WHEN cy > 756 THEN '_bottom' ELSE '' END AS zone FROM k""")(
    lambda spark, d: det(spark, d).select("camera", "frame", t.zone_label().alias("zone"))
)
query("class_counts_by_window", DET + """ SELECT camera, strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) FILTER (WHERE class_name = 'person') AS persons, count(*) FILTER (WHERE class_name IN ('car', 'truck', 'bus')) AS vehicles, count(*) AS n FROM det GROUP BY ALL""")(
    lambda spark, d: t.class_counts_by_window(det(spark, d), "5 minutes").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))
)
query("running_totals", DET + """ SELECT camera, frame, sum((class_name = 'person')::INT) OVER w::BIGINT AS persons, sum((class_name IN ('car', 'truck', 'bus'))::INT) OVER w::BIGINT AS vehicles, count(*) OVER w AS "all" FROM det WINDOW w AS (PARTITION BY camera ORDER BY frame)""".replace(" OVER w::BIGINT", " OVER w"))(
    lambda spark, d: t.running_totals(det(spark, d))
)
query("distinct_tracks", DET + " SELECT camera, count(DISTINCT track_id) AS tracks FROM det GROUP BY camera")(lambda spark, d: det(spark, d).groupBy("camera").agg(F.countDistinct("track_id").alias("tracks")))
query("event_clips", DET.replace("WITH r", "WITH RECURSIVE r") + """, f AS (SELECT camera, frame, sec, sum(n) OVER (PARTITION BY camera ORDER BY frame) AS run FROM (SELECT camera, frame, sec, CASE WHEN frame - lag(frame) OVER (PARTITION BY camera ORDER BY frame) = 1 THEN 0 ELSE 1 END AS n FROM det WHERE confidence >= 0.3)),
g AS (SELECT *, row_number() OVER (PARTITION BY camera, run ORDER BY frame) AS k FROM f),
c AS (SELECT camera, run, k, frame, sec AS start, 0 AS clip, false AS done FROM g WHERE k = 1
  UNION ALL SELECT g.camera, g.run, g.k, g.frame, CASE WHEN c.done THEN g.sec ELSE c.start END, c.clip + c.done::INT, NOT c.done AND g.sec - c.start > 10 FROM c JOIN g ON g.camera = c.camera AND g.run = c.run AND g.k = c.k + 1)
SELECT camera, run::BIGINT AS run, clip::BIGINT AS clip, min(frame) AS first, max(frame) AS last, count(*) AS frames FROM c GROUP BY ALL""")(lambda spark, d: t.event_clips(det(spark, d).where("confidence >= 0.3")))
query("fps_30", DET + " SELECT camera, frame, 30.0::DOUBLE / (sec - lag(sec) OVER (PARTITION BY camera ORDER BY frame)) AS fps FROM det WHERE frame % 30 = 0")(lambda spark, d: t.fps_30(det(spark, d)))
query("detection_report", DET + " SELECT camera, class_name, count(*) AS n FROM det GROUP BY ROLLUP (camera, class_name)")(lambda spark, d: det(spark, d).rollup("camera", "class_name").agg(F.count("*").alias("n")))
query("keyframes", cte("frames") + " SELECT a.camera, a.frame, round(avg(abs(a.grey - b.grey)), 6) AS change FROM frames a JOIN frames b ON a.camera = b.camera AND a.frame = b.frame + 1 AND a.row = b.row AND a.col = b.col GROUP BY ALL HAVING avg(abs(a.grey - b.grey)) > 30")(
    lambda spark, d: rounded(t.keyframes(layer(spark, d, "frames")), ("change",))
)
query("stream_health", cte("stream_log") + """ SELECT stream_id, (floor(epoch(max(ts))) - floor(epoch(min(ts))))::BIGINT AS uptime, sum(bytes)::BIGINT AS bytes, count(*) FILTER (WHERE kind = 'error') AS errors, count(*) FILTER (WHERE kind = 'reconnect') AS reconnects FROM stream_log GROUP BY ROLLUP (stream_id)""")(
    lambda spark, d: t.stream_health(layer(spark, d, "stream_log"))
)
query("dwell_alerts", DET + """, p AS (SELECT *, sec - first(sec) OVER w AS seconds, sum(step) OVER w AS path FROM (SELECT *, coalesce(sqrt((x1 - lag(x1) OVER w) ** 2 / 1920.0::DOUBLE ** 2 + (y1 - lag(y1) OVER w) ** 2 / 1080.0::DOUBLE ** 2), 0) AS step FROM det WINDOW w AS (PARTITION BY camera, track_id ORDER BY frame)) WINDOW w AS (PARTITION BY camera, track_id ORDER BY frame)),
q AS MATERIALIZED (SELECT * FROM p WHERE path <= 0.05::DOUBLE AND seconds >= CASE class_name WHEN 'person' THEN 30 WHEN 'other' THEN 9999 ELSE 600 END),
a AS (WITH RECURSIVE u AS (SELECT camera, track_id, min(sec) AS sec FROM q GROUP BY ALL UNION ALL SELECT u.camera, u.track_id, (SELECT min(q.sec) FROM q WHERE q.camera = u.camera AND q.track_id = u.track_id AND q.sec >= u.sec + 60) FROM u WHERE u.sec IS NOT NULL) SELECT * FROM u WHERE sec IS NOT NULL)
SELECT camera, track_id, frame, class_name, seconds::DOUBLE AS seconds, round(path, 6) AS path FROM a JOIN q USING (camera, track_id, sec)""")(lambda spark, d: t.dwell_alerts(det(spark, d)).select("camera", "track_id", ((F.unix_timestamp("ts") - 1704067200) / 2).cast("long").alias("frame"), "class_name", "seconds", F.round("path", 6).alias("path")))
query("dedupe_saves", DET + """, p AS (SELECT camera, track_id, frame, row_number() OVER (PARTITION BY camera, track_id ORDER BY frame) AS k FROM det WHERE class_name = 'person'),
s AS (WITH RECURSIVE w AS (SELECT camera, track_id, frame FROM p WHERE k = 1 UNION ALL SELECT w.camera, w.track_id, (SELECT min(p.frame) FROM p WHERE p.camera = w.camera AND p.track_id = w.track_id AND p.frame >= w.frame + 30) FROM w WHERE w.frame IS NOT NULL) SELECT * FROM w WHERE frame IS NOT NULL)
SELECT camera, track_id, frame FROM s""")(lambda spark, d: t.dedupe_saves(det(spark, d).where("class_name = 'person'")))
query("track_objects")(lambda spark, d: stateful.track_objects(det(spark, d)))  # tests hold it against one tracker for each camera
query("error_growth", cte("stream_log") + """, c AS (SELECT stream_id, time_bucket(INTERVAL 10 MINUTE, ts) AS start, count(*) FILTER (WHERE kind = 'error') AS errors FROM stream_log GROUP BY ALL)
SELECT stream_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, errors, before FROM (SELECT *, lag(errors) OVER (PARTITION BY stream_id ORDER BY start) AS before FROM c) WHERE errors > before""")(
    lambda spark, d: stateful.error_growth(layer(spark, d, "stream_log").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))
)

# Retrieval.

query("chunk_fixed", """WITH d AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 51, 0) + 1, 450)) AS a FROM documents WHERE text IS NOT NULL)
SELECT doc_id, a // 450 AS chunk_no, substring(text, a::INT + 1, 500) AS text FROM d""")(lambda spark, d: c.chunk_fixed(table(spark, d, "documents")))
query("chunk_text")(lambda spark, d: table(spark, d, "documents").select("doc_id", F.posexplode(chunk_text(F.col("text"))).alias("chunk_no", "text")))
query("top_k_similar", """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_distance(e, embedding::DOUBLE[]), 9), vec_id) AS rank, vec_id, round(list_distance(e, embedding::DOUBLE[]), 6) AS distance FROM q, embeddings QUALIFY rank <= 3""")(
    lambda spark, d: rounded(c.top_k_similar(table(spark, d, "embeddings"), table(spark, d, "embeddings").where("vec_id % 50 = 0")), ("distance",))
)
query("source_preview", "SELECT doc_id, substring(text, 1, 100) AS preview FROM documents")(lambda spark, d: table(spark, d, "documents").select("doc_id", F.substring("text", 1, 100).alias("preview")))
