"""Evaluation of masks and classes, reports, rankings and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def confusion_matrix(df: DataFrame, classes: int, ignore: int = 255, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(truth, pred, n) of all class pairs, zeros included; ignored and out-of-range values go."""
    valid = df.where((F.col(truth) != ignore) & (F.col(pred) != ignore) & F.col(truth).between(0, classes - 1) & F.col(pred).between(0, classes - 1))
    counts = valid.groupBy(F.col(truth).cast("long").alias("truth"), F.col(pred).cast("long").alias("pred")).agg(F.count("*").alias("n"))
    names = df.sparkSession.range(classes * classes).select(F.floor(F.col("id") / classes).alias("truth"), (F.col("id") % classes).alias("pred"))
    return names.join(counts, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Per class: support, precision, recall, iou, dice (0 where a divisor is 0)."""
    rows = matrix.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    cols = matrix.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    m = rows.join(cols, "class")
    tp, s, p = F.col("tp"), F.col("support"), F.col("predicted")
    return m.select(
        "class", "support", _ratio(tp, p).alias("precision"), _ratio(tp, s).alias("recall"), _ratio(tp, s + p - tp).alias("iou"), _ratio(2 * tp, s + p).alias("dice")
    )


def mean_metrics(per_class: DataFrame) -> DataFrame:
    """accuracy, mean IoU and Dice over the classes with support."""
    seen = F.col("support") > 0
    return per_class.agg(
        _ratio(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("accuracy"),
        F.avg(F.when(seen, F.col("iou"))).alias("miou"),
        F.avg(F.when(seen, F.col("dice"))).alias("mdice"),
    )


def classification_report(matrix: DataFrame) -> DataFrame:
    """A row for each class and one for the macro average: precision, recall, f1, support."""
    per = class_metrics(matrix).select(F.col("class").cast("string").alias("class"), "precision", "recall", F.col("dice").alias("f1"), "support")
    macro = per.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support")).select(F.lit("macro").alias("class"), "precision", "recall", "f1", "support")
    return per.unionByName(macro)


def _four(truth: Column, pred: Column) -> list[Column]:
    pairs = {"tp": (1, 1), "fp": (0, 1), "fn": (1, 0), "tn": (0, 0)}
    return [F.sum(F.when((truth == t) & (pred == p), 1).otherwise(0)).alias(n) for n, (t, p) in pairs.items()]


def binary_change_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Counts, accuracy, precision, recall, F1, IoU, kappa and change shares; divisors are at least 1 (4 decimals)."""
    c = df.agg(*_four(F.col(truth), F.col(pred)))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    n = F.greatest(tp + fp + fn + tn, F.lit(1.0))
    least = lambda x: F.greatest(x, F.lit(1.0))
    p, r, oa = tp / least(tp + fp), tp / least(tp + fn), (tp + tn) / n
    pe = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    out = {
        "oa": oa, "precision": p, "recall": r, "f1": 2 * p * r / F.greatest(p + r, F.lit(1e-8)), "iou": tp / least(tp + fp + fn),
        "kappa": (oa - pe) / F.greatest(1 - pe, F.lit(1e-8)), "truth_share": (tp + fn) / n, "pred_share": (tp + fp) / n,
    }
    return c.select("tp", "fp", "fn", "tn", *[F.round(e, 4).alias(k) for k, e in out.items()])


def mask_quality(df: DataFrame, sample: str, truth: str, pred: str) -> DataFrame:
    """Per sample: IoU, Dice, precision, recall, F1, accuracy (1 in empty cases), area error and grade."""
    c = df.groupBy(sample).agg(*_four(F.col(truth), F.col(pred)))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p, r = _ratio(tp, tp + fp, 1.0), _ratio(tp, tp + fn, 1.0)
    iou = _ratio(tp, tp + fp + fn, 1.0)
    error = F.when(tp + fn > 0, F.abs(fp - fn) / (tp + fn)).when(tp + fp > 0, F.lit(float("inf"))).otherwise(0.0)
    grade = F.when(iou >= 0.9, "A").when(iou >= 0.75, "B").when(iou >= 0.5, "C").otherwise("D")
    return c.select(
        sample, iou.alias("iou"), _ratio(2 * tp, 2 * tp + fp + fn, 1.0).alias("dice"), p.alias("precision"), r.alias("recall"),
        _ratio(2 * p * r, p + r).alias("f1"), _ratio(tp + tn, tp + fp + fn + tn, 1.0).alias("accuracy"), error.alias("area_error"), grade.alias("grade"),
    )


def batch_quality(quality: DataFrame) -> DataFrame:
    """Mean and population deviation of the metrics over samples."""
    names = ["iou", "dice", "precision", "recall", "f1", "accuracy"]
    return quality.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in names], *[F.stddev_pop(c).alias(f"{c}_std") for c in names])


def change_stats(df: DataFrame, changed: Column, probability: Column) -> DataFrame:
    return df.agg(
        F.count("*").alias("total"), F.sum(F.when(changed, 1).otherwise(0)).alias("changed"), F.sum(F.when(changed, 0).otherwise(1)).alias("unchanged"),
        F.round(100 * F.avg(F.when(changed, 1.0).otherwise(0.0)), 2).alias("percent"), F.avg(F.when(changed, probability)).alias("mean_probability"),
        F.max(F.when(changed, probability)).alias("max_probability"),
    )


def issue_report(issues: DataFrame) -> DataFrame:
    """Counts by type, by severity and in all, with the share that can be fixed."""
    kinds, severities = F.col("error_type"), F.col("severity")
    fixable = F.avg(F.when(F.col("auto_fixable"), 1.0).otherwise(0.0)).alias("fixable")
    return issues.groupingSets([[kinds], [severities], []], kinds, severities).agg(F.count("*").alias("n"), fixable)


def best_run(runs: DataFrame, preferred: str) -> DataFrame:
    """Of each image's good runs the best: most objects among runs of the preferred method, else of all; then area."""
    w = W.partitionBy("image").orderBy(F.desc(F.col("method") == preferred), F.desc("count"), F.desc("total_area"), "method", "model")
    return runs.where("status = 'ok' and count > 0").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def run_index(images: DataFrame, runs: DataFrame) -> DataFrame:
    """Per image: its methods and models joined by |, best count of good runs, and ok / failed / skipped."""
    got = runs.groupBy("image").agg(
        F.array_join(F.sort_array(F.collect_set("method")), "|").alias("methods"), F.array_join(F.sort_array(F.collect_set("model")), "|").alias("models"),
        F.max(F.when(F.col("status") == "ok", F.col("count"))).alias("best"), F.max(F.when(F.col("status") == "ok", 1).otherwise(0)).alias("good"),
    )
    status = F.when(F.col("good").isNull(), "skipped").when(F.col("good") == 1, "ok").otherwise("failed")
    return images.join(got, "image", "left").select("image", F.coalesce("methods", F.lit("")).alias("methods"), F.coalesce("models", F.lit("")).alias("models"), "best", status.alias("status"))


def top_k(df: DataFrame, keys: list[str], by: str, name: str, k: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.desc(by), name)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def top_k_predictions(df: DataFrame, key: str, name: str, prob: str, k: int = 5) -> DataFrame:
    """The ``k`` most probable classes of each key (ties: smaller name), with the winner and its confidence (6 decimals)."""
    best = W.partitionBy(key).orderBy("rank")
    return top_k(df, [key], prob, name, k).withColumns({"winner": F.first(name).over(best), "confidence": F.round(F.first(prob).over(best), 6)})


def hash_rank(df: DataFrame, key: str, label: str | None = None, seed: int = 42) -> DataFrame:
    """``df`` with _at (1, 2, ... in the order of a hash of the key, in each class of ``label``) and _n, the class's rows.

    Rows are numbered inside 4,096 ranges of the hash, and ranges by the counts before them: no class is one task.
    """
    by = [F.lit(0).alias("_label") if label is None else F.col(label).alias("_label")]
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).withColumn("_range", F.coalesce(F.left("_h", F.lit(3)), F.lit("")))
    counts = hashed.groupBy(*by, F.col("_range").alias("_r")).count()
    of_class = W.partitionBy("_label")  # at most 4,097 rows a class
    before = F.coalesce(F.sum("count").over(of_class.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_label", "_r", before.alias("_before"), F.sum("count").over(of_class).alias("_n"))
    same = hashed["_range"].eqNullSafe(counts["_r"]) & (F.lit(0) if label is None else hashed[label]).eqNullSafe(counts["_label"])
    inside = W.partitionBy(*([] if label is None else [label]), "_range").orderBy("_h", key)
    return hashed.join(counts, same).withColumn("_at", F.col("_before") + F.row_number().over(inside)).drop("_h", "_range", "_r", "_label", "_before")


def split_stratified(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """train / val / test of 70 / 15 / 15 percent of each class, floors first and the rest to test, in hash order."""
    train, val = F.floor(F.col("_n") * 0.7), F.floor(F.col("_n") * 0.15)
    split = F.when(F.col("_at") <= train, "train").when(F.col("_at") <= train + val, "val").otherwise("test")
    return hash_rank(df, key, label, seed).withColumn("split", split).drop("_at", "_n")


def split_holdout(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """val: the max(1, round(n * ratio)) rows of the smallest hash."""
    small = F.col("_at") <= F.greatest(F.lit(1), F.round(F.col("_n") * ratio))
    return hash_rank(df, key, None, seed).withColumn("split", F.when(small, "val").otherwise("train")).drop("_at", "_n")
