"""Carrying values along ordered keys without gathering a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of a key's rows that one task sorts.
SPAN_S = 3600.0


def last_before(rows: DataFrame, by: list[str], order: Column, bucket: Column, values: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """Adds, under each name, the latest value that is not null among the rows of a key up to this one (before it, if not inclusive).

    Rows meet by key and bucket, a number that rises with the order; what holds at a bucket's begin comes from a pass over the buckets,
    of which each gives one row.  So a key of any size lies in as many tasks as it has buckets.
    """
    rows = rows.withColumns({"__b": bucket, "__o": order, **{f"__v_{n}": v for n, v in values.items()}})
    same = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in by]
    ends = rows.groupBy(*by, "__b").agg(*(F.max_by(F.when(F.col(f"__v_{n}").isNotNull(), F.col(f"__v_{n}")), F.when(F.col(f"__v_{n}").isNotNull(), F.col("__o"))).alias(f"__e_{n}") for n in values))
    w = W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*(F.col(c).alias(f"__k_{c}") for c in by), F.col("__b").alias("__kb"), *(F.last(f"__e_{n}", ignorenulls=True).over(w).alias(f"__c_{n}") for n in values))
    on = F.col("__b").eqNullSafe(F.col("__kb"))
    for s in same:
        on = on & s
    rows = rows.join(ends, on).drop("__kb", *(f"__k_{c}" for c in by))
    inside = W.partitionBy(*by, "__b").orderBy("__o").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    out = {n: F.coalesce(F.last(f"__v_{n}", ignorenulls=True).over(inside), F.col(f"__c_{n}")) for n in values}
    return rows.withColumns(out).drop("__b", "__o", *(f"__v_{n}" for n in values), *(f"__c_{n}" for n in values))
