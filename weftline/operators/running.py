"""Running sums and row numbers over a whole table without passing it through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.stage import staged


def running_sums(df: DataFrame, order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name of `sums`, the sum of its column over all rows before this one in the order (0 at first).

    Rows are dealt to ranges of the order; each range sums its own rows and starts from the totals of the ranges before
    it, which are a row a range. Rows that are equal in the order stay in one range, so the order should be a fine one.
    """
    ranged = staged(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(n) for n, c in sums.items()]).orderBy("_range").collect()
    types = dict(ranged.select(*[F.sum(c).alias(n) for n, c in sums.items()]).dtypes)
    so_far, starts = {n: 0.0 if types[n] == "double" else 0 for n in sums}, []
    for r in totals:
        starts.append((r["_range"], *so_far.values()))
        so_far = {n: so_far[n] + (r[n] or 0) for n in sums}
    if not starts:
        return ranged.drop("_range").select("*", *[F.lit(None).cast(types[n]).alias(n) for n in sums])
    offsets = df.sparkSession.createDataFrame(starts, "_range int, " + ", ".join(f"`_start_{n}` {types[n]}" for n in sums))
    before = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for n, c in sums.items()])
    joined = own.join(F.broadcast(offsets), "_range")
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"_start_{n}")).alias(n) for n in sums])
