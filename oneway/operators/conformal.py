"""Conformal calibration of scores, per class.  Quantiles are order statistics, not interpolations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oneway.operators.ranges import running_sum


def nonconformity() -> Column:
    return (1 - F.col("score")) * (1 + 0.5 * F.col("uncertainty"))


def fit(samples: DataFrame, alpha: float = 0.1, key: str = "class") -> DataFrame:
    """class, n and threshold = max(0, 1 - q), where q is the ceil((n + 1)(1 - alpha))-th smallest nonconformity (at most the n-th).

    The order statistic is read off running counts of distinct values, which run inside ranges: a class with a third of all samples is
    reduced to its distinct values, and these are never sorted in one task.
    """
    values = samples.groupBy(key, nonconformity().alias("x")).agg(F.count("*").alias("c"))
    total = values.groupBy(key).agg(F.sum("c").alias("n"))
    upto = running_sum(values, [key], "x", "c", "upto")
    k = F.least(F.col("n"), F.greatest(F.lit(1), F.ceil((F.col("n") + 1) * (1 - alpha))))
    q = upto.join(total, key).where(F.col("upto") >= k).groupBy(key, "n").agg(F.min("x").alias("q"))
    return q.select(key, "n", "q", F.greatest(F.lit(0.0), 1 - F.col("q")).alias("threshold"))


def covered(test: DataFrame, fitted: DataFrame, alpha: float = 0.1, key: str = "class") -> DataFrame:
    """Adds covered: score / (1 + u / 2) reaches the class's threshold (1 - alpha for a class never fitted)."""
    rows = test.join(fitted.select(key, "threshold"), key, "left")
    return rows.withColumn("covered", F.col("score") / (1 + 0.5 * F.col("uncertainty")) >= F.coalesce("threshold", F.lit(1 - alpha)))


def p_values(test: DataFrame, samples: DataFrame, key: str = "class") -> DataFrame:
    """Adds p = (#{calibration >= nonconformity} + 1) / (n + 1), 1 - score for a class never fitted.

    Counted by running sums over calibration and test values together, not by comparing all pairs.
    """
    calibration = samples.groupBy(key, nonconformity().alias("x")).agg(F.count("*").alias("c"))
    wanted = test.withColumn("x", nonconformity())
    asked = wanted.select(key, "x").distinct()
    both = calibration.select(key, "x", "c").unionByName(asked.select(key, "x", F.lit(0).cast("long").alias("c")))
    merged = both.groupBy(key, "x").agg(F.sum("c").alias("c"))
    counts = running_sum(merged, [key], "x", "c", "at_least", descending=True)
    total = samples.groupBy(key).agg(F.count("*").alias("n"))
    rows = wanted.join(counts.select(key, "x", "at_least"), [key, "x"]).join(total, key, "left")
    return rows.withColumn("p", F.when(F.col("n").isNull(), 1 - F.col("score")).otherwise((F.col("at_least") + 1) / (F.col("n") + 1))).drop("x")


def coverage(test: DataFrame, fitted: DataFrame, alpha: float = 0.1, key: str = "class") -> DataFrame:
    return covered(test, fitted, alpha, key).groupBy(key).agg(F.count("*").alias("tested"), F.avg(F.col("covered").cast("int")).alias("coverage"))


def split_intervals(errors: DataFrame, splits: int = 200, alphas: tuple[float, ...] = (0.05, 0.1, 0.2)) -> DataFrame:
    """Split-conformal half-widths over seeded random halves of (id, error): mean width and coverage per alpha.

    A split is a hash of (split, id), so any engine can draw the same halves.  Rows are reduced to distinct errors per split before anything is ordered,
    and no row is repeated per alpha.
    """
    rows = errors.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    fit_ = F.conv(F.substring(F.md5(F.concat_ws(":", "split", "id").cast("binary")), 1, 1), 16, 10).cast("int") % 2 == 0
    values = rows.groupBy("split", "error").agg(F.count_if(fit_).alias("c"), F.count_if(~fit_).alias("t"))
    upto = running_sum(values, ["split"], "error", "c", "upto")
    sizes = values.groupBy("split").agg(F.sum("c").alias("n"), F.sum("t").alias("tests"))
    upto = upto.join(F.broadcast(sizes), "split")  # one row per split
    at = lambda a: F.least(F.col("n"), F.greatest(F.lit(1), F.ceil((F.col("n") + 1) * (1 - F.lit(a)))))
    each = sizes.select("split", "tests")
    widths = upto.groupBy("split").agg(*(F.min(F.when((F.col("upto") >= at(a)) & (F.col("c") > 0), F.col("error"))).alias(f"w{i}") for i, a in enumerate(alphas)))
    inside = values.join(F.broadcast(widths), "split").groupBy("split").agg(*(F.sum(F.when(F.col("error") <= F.col(f"w{i}"), F.col("t")).otherwise(0)).alias(f"i{i}") for i in range(len(alphas))))
    per = widths.join(inside, "split").join(each, "split")
    pairs = F.explode(F.array(*(F.struct(F.lit(float(a)).alias("alpha"), F.col(f"w{i}").alias("width"), F.try_divide(F.col(f"i{i}"), F.col("tests")).alias("inside")) for i, a in enumerate(alphas)))).alias("p")
    return per.select(pairs).select("p.*").where("inside is not null").groupBy("alpha").agg(F.avg("inside").alias("coverage"), F.avg("width").alias("half_width"), F.count("*").alias("splits"))
