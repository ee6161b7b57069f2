"""Sparse matrices as tables of row blocks.

A block is a row of the table: (block, first, offsets, columns, values), the entries of its `rows` rows one after another, those
of row first + k from offsets[k] to offsets[k + 1]. A reader takes the blocks it needs by a filter that reaches the files.
Rows and columns are numbered by the order of their names, in a table of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.running import running_sums
from weftline.sources.stage import staged

#: Rows of a block.
ROWS = 1024


def numbered(names: DataFrame, column: str) -> DataFrame:
    """(name, i): distinct names by their order, from 0; through ranges, not one task."""
    return running_sums(names.select(F.col(column).alias("name")).filter("name is not null").distinct(), ["name"], {"i": F.lit(1)}).select("name", F.col("i").cast("long").alias("i"))


def blocks(entries: DataFrame, index: DataFrame, rows: int = ROWS) -> DataFrame:
    """(block, first, offsets, columns, values) of entries (a, b, value) whose names are in index (name, i); entries of one
    place are added up. Blocks without an entry are left out."""
    # Names are looked up, so that entries pass by without a sort; then they are dealt by block once, in order.
    names = lambda name, place: index.select(F.col("name").alias(name), F.col("i").alias(place)).hint("shuffle_hash")
    at = entries.join(names("b", "j"), "b").join(names("a", "i"), "a")
    dealt = at.select(F.floor(F.col("i") / rows).cast("long").alias("block"), "i", "j", "value").repartitionByRange("block")
    cells = dealt.groupBy("block", "i", "j").agg(F.sum("value").cast("double").alias("v"))
    lines = cells.groupBy("block", "i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("cells"))
    whole = lines.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("i", "cells"))).alias("lines")).withColumn("first", F.col("block") * rows)
    length = F.map_from_entries(F.transform("lines", lambda x: F.struct((x["i"] - F.col("first")).cast("int").alias("k"), F.size(x["cells"]).cast("long").alias("n"))))
    # Within a transform of one value, so that Spark does not make the map anew for each row.
    of_rows = lambda m: F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda k: F.coalesce(F.element_at(m, k), F.lit(0).cast("long")))
    lengths = F.transform(F.array("length"), of_rows)[0]
    none = F.array(F.lit(0).cast("long"))
    offsets = F.aggregate("lengths", none, lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
    flat = F.flatten(F.transform("lines", lambda x: x["cells"]))
    dense = whole.withColumn("length", length).withColumn("lengths", lengths).withColumn("offsets", offsets).withColumn("flat", flat)
    return dense.select("block", "first", "offsets", F.transform("flat", lambda x: x["j"]).alias("columns"), F.transform("flat", lambda x: x["v"]).alias("values"))


def write(entries: DataFrame, path: str, rows: int = ROWS) -> None:
    """Write the entries (a, b, value) of a square matrix, its blocks in order, and the names of its rows and columns."""
    entries = staged(entries.select("a", "b", "value"), "entries")
    names = entries.select(F.col("a").alias("name")).distinct().union(entries.select("b").distinct())
    index = numbered(names, "name")
    index.write.parquet(f"{path}/names")
    index = entries.sparkSession.read.parquet(f"{path}/names")
    blocks(entries, index, rows).sortWithinPartitions("block").write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """(a, b, value) of a written matrix, of the blocks that fulfil a condition on `block` or `first` if one is given."""
    rows = spark.read.parquet(f"{path}/blocks")
    rows = rows if wanted is None else rows.filter(wanted)
    # The row of each entry beside it, so that a block is read in one pass over its entries.
    size = lambda k: (F.get("offsets", k + 1) - F.get("offsets", k)).cast("int")
    row_of = F.flatten(F.transform(F.sequence(F.lit(0), F.size("offsets") - 2), lambda k: F.array_repeat(F.col("first") + k, size(k))))
    cells = rows.select(F.inline(F.arrays_zip(row_of.alias("i"), F.col("columns").alias("j"), F.col("values").alias("value"))).alias("i", "j", "value"))
    names = spark.read.parquet(f"{path}/names")
    named = lambda name, place: names.select(F.col("name").alias(name), F.col("i").alias(place)).hint("shuffle_hash")
    return cells.join(named("a", "i"), "i").join(named("b", "j"), "j").select("a", "b", "value")
