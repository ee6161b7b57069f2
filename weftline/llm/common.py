"""What the training-data operators share: the shared folder, staged tables, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftline.sources.stage import shared_dir, staged

__all__ = ["BLANKS", "fresh_dir", "map_rows", "shared_dir", "staged", "table"]

#: Word separators of the pipeline's own word counts and shingles.
BLANKS = r"\x20\x09-\x0D"


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, columns: list[str], schema: str, build: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """One output row for each input row, by a Python function made once a task from `build`.

    Rows travel as Arrow batches; a batch is worked off in slices so that memory does not follow its size.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = build()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = [row(*x) for x in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)
