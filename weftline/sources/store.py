"""Reading sources and storing batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE_COLUMNS = "from_name from_email to_name to_email cc_name cc_email subject date raw_date_string message_id refs body_text flagged_abuse filename".split()


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def commits(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """An exported commit log, JSON lines or Parquet by its ending; each sha once."""
    rows = spark.read.schema(schema).json(path) if schema else spark.read.parquet(path)
    return rows.dropDuplicates(["sha"])


def messages(spark: SparkSession, path: str) -> DataFrame:
    """A mail table; an error names the columns that are missing."""
    rows = spark.read.parquet(path)
    if missing := [c for c in MESSAGE_COLUMNS if c not in rows.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return rows.select(*MESSAGE_COLUMNS)


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or JSON lines, by the first character that is no blank."""
    head = spark.read.text(path).filter("trim(value) <> ''").limit(1).collect()
    many = bool(head) and head[0][0].lstrip().startswith("[")
    return spark.read.schema(schema).option("multiLine", many).json(path)


def word_lists(spark: SparkSession, path: str) -> DataFrame:
    """(list, term): one term a line (list "any"), or a CSV whose columns are lists."""
    if path.endswith(".csv"):
        wide = spark.read.csv(path, header=True)
        rows = wide.unpivot([], wide.columns, "list", "term")
    else:
        rows = spark.read.text(path).select(F.lit("any").alias("list"), F.col("value").alias("term"))
    return rows.withColumn("term", F.lower(F.trim("term"))).filter("term <> ''").distinct()


def write_batch(rows: DataFrame, root: str, name: str, resource: str, derived: Derived | None = None) -> None:
    """Replace what a resource has in a table and leave all other resources alone. What is derived from the table is out of
    date from then on."""
    if derived:
        derived.invalidate()
    rows.withColumn("resource", F.lit(resource)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("resource").parquet(f"{root}/{name}")


def reset_resource(tables: dict[str, DataFrame], batches: DataFrame, resource: str, prefix: bool = False) -> dict[str, DataFrame]:
    """The tables without the rows of a resource's batches, or with prefix of all whose names begin so. batches: (id, resource)."""
    gone = batches.filter(F.col("resource").startswith(resource) if prefix else F.col("resource") == resource).select(F.col("id").alias("batch_id"))
    return {k: t.join(gone, "batch_id", "left_anti") for k, t in tables.items()}


def computed(rows: DataFrame) -> DataFrame:
    """Derived attributes worth storing: empty maps are not."""
    return rows.filter(F.size("attrs") > 0)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def clear(spark: SparkSession, root: str, name: str, schema: str) -> None:
    """Empty a derived table, so that nothing stale is read after an ingest."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/{name}")


class Derived:
    """Tables that are built together, under `root`: a rebuild writes a version of all of them beside the last one, then
    a pointer to it. Readers follow the greatest pointer, so they see a whole version or the one before, never a part.

    A pointer is a small file named by a number; it is written under another name and renamed, which fails where the
    number is taken: of two rebuilds at once one raises. `invalidate` sets a pointer to nothing. Files are reached through
    Hadoop's interface, so `root` can be wherever Spark writes.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def pointers(self) -> dict[int, str]:
        """Version of each number; "" where it was made invalid."""
        folder = self._path(f"{self.root}/pointers")
        found = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return {int(n): self._content(f"{self.root}/pointers/{n}") for n in found if n.isdigit()}

    def _content(self, path: str) -> str:
        file = self._fs.open(self._path(path))
        try:
            return bytes(file.readAllBytes()).decode()
        finally:
            file.close()

    def _point(self, version: str) -> int:
        number = max(self.pointers(), default=0) + 1
        new = self._path(f"{self.root}/pointers/new-{uuid.uuid4().hex}")
        file = self._fs.create(new, False)
        file.write(bytearray(version.encode()))
        file.close()
        self._context.rename(new, self._path(f"{self.root}/pointers/{number:012d}"), self._none)
        return number

    def publish(self, tables: dict[str, DataFrame]) -> str:
        """Write all tables as a new version and make it the current one."""
        version = uuid.uuid4().hex
        for name, rows in tables.items():
            rows.write.parquet(f"{self.root}/versions/{version}/{name}")
        self._point(version)
        return version

    def invalidate(self) -> None:
        if self.current():
            self._point("")

    def current(self) -> str | None:
        """The current version, "" if an ingest made it invalid, None if there never was one."""
        found = self.pointers()
        return found[max(found)] if found else None

    def read(self, name: str) -> DataFrame:
        if not (version := self.current()):
            raise LookupError(f"{name}: to be built" if version is None else f"{name}: out of date, to be rebuilt")
        return self.spark.read.parquet(f"{self.root}/versions/{version}/{name}")

    def drop_old(self, keep: int = 2) -> None:
        """Delete the versions that are none of the last `keep` valid pointers', and what failed rebuilds left. Not while
        a rebuild is running: its tables have no pointer yet."""
        found = self.pointers()
        wanted = [found[n] for n in sorted(found, reverse=True) if found[n]][:keep]
        folder = self._path(f"{self.root}/versions")
        for f in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if f.getPath().getName() not in wanted:
                self._fs.delete(f.getPath(), True)
