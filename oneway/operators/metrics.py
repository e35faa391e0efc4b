"""Evaluation: confusion, precision and recall, order statistics, ranks and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oneway.operators.flows import ratio
from oneway.operators.ranges import positions, range_bucket, running_sum


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision and recall, 1 where undefined, and F1."""
    p = F.coalesce(F.try_divide(tp, tp + fp), F.lit(1.0))
    r = F.coalesce(F.try_divide(tp, tp + fn), F.lit(1.0))
    return {"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))}


def relative_errors(rows: DataFrame, predicted: str, truth: str) -> DataFrame:
    return rows.where(F.col(truth) > 0).withColumn("error", F.abs(F.col(predicted) - F.col(truth)) / F.col(truth))


def summary_stats(rows: DataFrame, value: str, by: str) -> DataFrame:
    """n, mean, population deviation, extremes and the elements at floor(p n) of the sorted values, per group.

    Order statistics are read off running counts of distinct values, which run inside ranges, so no group is ordered in one task.
    """
    values = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("x")).agg(F.count("*").alias("c"))
    base = rows.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    upto = running_sum(values, [by], "x", "c", "upto").join(base.select(by, "n"), by)
    at = lambda p: F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n")))
    q = upto.groupBy(by).agg(*(F.min(F.when(F.col("upto") > at(p), F.col("x"))).alias(name) for name, p in (("median", 0.5), ("p90", 0.9), ("p95", 0.95))))
    return base.join(q, by, "left")


def confusion(rows: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(actual, predicted).agg(F.count("*").alias("n"))


def per_label(rows: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of each label that occurs."""
    cells = confusion(rows, actual, predicted)
    both = cells.select(F.explode(F.array(F.struct(F.col(actual).alias("label"), F.lit("t").alias("k")), F.struct(F.col(predicted).alias("label"), F.lit("p").alias("k")))).alias("x"), "n", (F.col(actual) == F.col(predicted)).alias("hit"))
    sums = both.groupBy("x.label").agg(
        F.coalesce(F.sum(F.when(F.col("hit") & (F.col("x.k") == "t"), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(~F.col("hit") & (F.col("x.k") == "p"), F.col("n"))), F.lit(0)).alias("fp"), F.coalesce(F.sum(F.when(~F.col("hit") & (F.col("x.k") == "t"), F.col("n"))), F.lit(0)).alias("fn"),
    )
    return sums.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")))


def macro(labels: DataFrame) -> DataFrame:
    return labels.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def top_label(alerts: DataFrame, by: str, none: str = "benign") -> DataFrame:
    """The threat of the highest confidence per scenario, the first of equals."""
    return alerts.groupBy(by).agg(F.coalesce(F.max_by("threat", F.struct("confidence", (-F.col("seq")).alias("s"))), F.lit(none)).alias("predicted"))


def matches(alerts: DataFrame, truth: DataFrame, by: str) -> DataFrame:
    """Scenarios with an alert of an expected threat whose key or title contains the target (null: any)."""
    hit = F.array_contains("threats", F.col("threat")) & (F.col("target").isNull() | F.contains("flow_key", F.col("target")) | F.contains("title", F.col("target")))
    return alerts.join(truth, by).withColumn("hit", hit).groupBy(by).agg(F.max("hit").alias("matched"))


def auc(rows: DataFrame, score: str = "score", label: str = "label", tie: str = "id") -> DataFrame:
    """Rank-sum AUC without a tie correction (ties rank in order of ``tie``); 0.5 with one class only.

    Ranks come from counts: rows are ranked inside ranges of score and tie, and offset by the counts of the ranges before, so neither
    many rows nor many rows of one score meet in one task.
    """
    rows = rows.withColumns({"__s": range_bucket(rows, F.col(score)), "__t": range_bucket(rows, F.col(tie))})
    # equal scores are split by ranges of the tie
    cells = rows.groupBy("__s", score, "__t").agg(F.count("*").alias("__c"))
    upto = lambda *by: W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)
    per = cells.groupBy("__s", score).agg(F.sum("__c").alias("__c")).withColumn("__in", F.coalesce(F.sum("__c").over(upto("__s", score)), F.lit(0)))
    sums = per.groupBy("__s").agg(F.sum("__c").alias("__c")).withColumn("__b", F.coalesce(F.sum("__c").over(W.orderBy("__s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    below = per.join(F.broadcast(sums.select("__s", "__b")), "__s").select(score, (F.col("__in") + F.col("__b")).alias("__below"))
    before = cells.withColumn("__ties", F.coalesce(F.sum("__c").over(upto(score, "__t")), F.lit(0))).select(score, "__t", "__ties")
    at = F.row_number().over(W.partitionBy(score, "__t").orderBy(tie))
    ranked = rows.withColumn("__r", at).join(before, [score, "__t"]).join(below, score).withColumn("rank", F.col("__r") + F.col("__ties") + F.col("__below"))
    pos = F.col(label) == 1
    agg = ranked.agg(F.sum(F.when(pos, F.col("rank"))).alias("r"), F.count_if(pos).alias("n1"), F.count_if(~pos).alias("n0"))
    value = F.when((F.col("n1") == 0) | (F.col("n0") == 0), 0.5).otherwise((F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0")))
    return agg.select("n1", "n0", value.alias("auc"))


def at_threshold(rows: DataFrame, threshold: float, score: str = "score", label: str = "label", by: str | None = None) -> DataFrame:
    """Accuracy, precision, recall (0 where undefined), F1 and false-positive rate."""
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    agg = rows.groupBy(*([by] if by else [])).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(1.0)), ratio(tp, tp + fn)
    return agg.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), "fpr": ratio(fp, fp + tn)})


def pr_curve(rows: DataFrame, points: int = 26, score: str = "score", label: str = "label") -> DataFrame:
    """Precision and recall at evenly spaced thresholds between the extreme scores.

    A row adds to the point of its highest threshold; sums from above give every point, so rows are not multiplied by thresholds.
    """
    ends = rows.agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.count_if(F.col(label) == 1).alias("n1"))
    grid = ends.select("lo", "hi", "n1", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("threshold", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    placed = rows.join(F.broadcast(ends.select("lo", "hi")), F.lit(True))
    steps = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (points - 1))
    placed = placed.withColumn("i", F.size(F.filter(steps, lambda t: t <= F.col(score))) - 1)
    sums = placed.groupBy("i").agg(F.count_if(F.col(label) == 1).alias("p"), F.count("*").alias("c"))
    w = W.orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)  # as many rows as points
    rows_ = grid.join(sums, "i", "left").withColumns({"tp": F.coalesce(F.sum("p").over(w), F.lit(0)), "called": F.coalesce(F.sum("c").over(w), F.lit(0))})
    return rows_.select("i", "threshold", F.coalesce(F.try_divide("tp", "called"), F.lit(1.0)).alias("precision"), ratio("tp", "n1").alias("recall"))


def average_precision(curve: DataFrame) -> DataFrame:
    """Sum of precision times the step in recall, by rising recall; the curve has few points."""
    step = F.col("recall") - F.coalesce(F.lag("recall").over(W.orderBy("recall", F.desc("i"))), F.lit(0.0))
    return curve.withColumn("part", F.col("precision") * step).agg(F.sum("part").alias("average_precision"))


def stratified(rows: DataFrame, by: str, train: int, test: int, id: str = "id", seed: int = 1) -> DataFrame:
    """Adds part: train for the first rows of each stratum in seeded hash order, test for the next, null beyond."""
    rows = rows.withColumn("__h", F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(id).cast("string")).cast("binary")))
    rows = positions(rows, [by], ["__h", id], "__r")
    return rows.withColumn("part", F.when(F.col("__r") < train, "train").when(F.col("__r") < train + test, "test")).drop("__r", "__h")


def recall_by(rows: DataFrame, by: str, threshold: float, score: str = "score") -> DataFrame:
    return rows.groupBy(by).agg(F.avg((F.col(score) >= threshold).cast("int")).alias("recall"), F.count("*").alias("n"))


def extremes(rows: DataFrame, by: str, k: int, name: str) -> DataFrame:
    """The k best and k worst rows, ties by name."""
    best = rows.orderBy(F.desc(by), name).limit(k).withColumn("end", F.lit("top"))
    return best.unionByName(rows.orderBy(F.asc(by), name).limit(k).withColumn("end", F.lit("bottom")))


def gate(macro_f1: float, false_alarms: float, auc_: float) -> list[str]:
    """What falls short of the regression floors."""
    checks = (("macro F1", macro_f1 >= 0.90), ("false-alarm rate", false_alarms <= 0.05), ("AUC", auc_ >= 0.93))
    return [name for name, ok in checks if not ok]
