"""Range buckets with fixed bounds: the same rows always fall in the same bucket, so counts and numbers of separate passes fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets, at most.
PIECES = 128
#: Distinct values that are drawn for each bucket, about.
DRAWN = 16


def range_bucket(rows: DataFrame, value: Column, pieces: int = PIECES) -> Column:
    """The number of the range that a value falls in; ranges rise with the value, nulls come first.

    Bounds are those distinct values that have the smallest hashes: a fair sample of at most ``pieces`` values, which the driver holds.  Values
    are drawn by hash before they are made distinct, so no more than the draw is shuffled.
    """
    seen = rows.select(value.alias("v")).where("v is not null")
    n = seen.agg(F.approx_count_distinct("v").alias("n")).first()["n"]
    if n > 2 * DRAWN * pieces:
        seen = seen.where(F.pmod(F.xxhash64("v"), F.lit(1 << 40)) < (DRAWN * pieces << 40) // n)
    picked = seen.distinct().orderBy(F.xxhash64("v"), "v").limit(pieces)
    bounds = sorted(r["v"] for r in picked.collect())
    if not bounds:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= value)), F.lit(0))


def positions(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the number of each row in its key's order, from 0.  Rows are numbered inside ranges of the first ordering column and offset by
    the counts of the key's ranges before, so a key of any size lies in many tasks."""
    rows = rows.withColumn("__c", range_bucket(rows, F.col(order[0])))
    counts = rows.groupBy(*by, "__c").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy("__c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(c).alias(f"__k_{c}") for c in by), F.col("__c").alias("__kc"), before.alias("__before"))
    on = F.col("__c") == F.col("__kc")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    inside = F.row_number().over(W.partitionBy(*by, "__c").orderBy(*order)) - 1
    return rows.join(counts, on).withColumn(name, inside + F.col("__before")).drop("__c", "__kc", "__before", *(f"__k_{c}" for c in by))


def running_sum(rows: DataFrame, by: list[str], order: str, weight: str, name: str, descending: bool = False) -> DataFrame:
    """Adds the sum of ``weight`` over the rows of a key up to this one in the order of a column that tells its rows apart.  Sums run inside ranges of
    the column and begin with those of the ranges before, so a key of any size is never sorted in one task."""
    rows = rows.withColumn("__c", range_bucket(rows, F.col(order)))
    turned = F.desc if descending else F.asc
    parts = rows.groupBy(*by, "__c").agg(F.sum(weight).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy(turned("__c")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*(F.col(c).alias(f"__k_{c}") for c in by), F.col("__c").alias("__kc"), before.alias("__before"))
    on = F.col("__c") == F.col("__kc")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    inside = F.sum(weight).over(W.partitionBy(*by, "__c").orderBy(turned(order)).rowsBetween(W.unboundedPreceding, 0))
    return rows.join(parts, on).withColumn(name, inside + F.col("__before")).drop("__c", "__kc", "__before", *(f"__k_{c}" for c in by))
