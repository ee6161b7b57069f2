"""A corpus pipeline: rate, drop near duplicates, mix sources, pack.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again for the next.
All stages but the last return the columns of documents.

Defined cases, in every stage: null or empty texts are rated as one empty passage, link with nothing, have no words to
mix and pack as the separator alone; null ids and sources stay; repeated rows are rated alike, and one of them stays;
rows of one id with different texts are documents of their own; an empty table gives an empty table; other columns
are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import mixing, ngram_join, packing, quality
from weftline.llm.common import staged, table


def rate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels"), held_out_remainder=None))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shared shingles, the one with the smallest doc_id (a null one last). Documents without a
    word link with nothing and stay. Rows that repeat an id and its text are one document, of which any one row stays.

    A document's key is a 64-bit hash of its id and text, so rows of one id with different texts are judged apart.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64("doc_id", "text").alias("key"))
    found = ngram_join.near_duplicates(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"))
    groups = staged(found.groupBy(F.col("doc_id").alias("key")).agg(F.first("component_id").alias("group"), F.count("*").alias("n")), "pipeline-groups")
    # Documents that stand alone need no look; of the others, ids decide which stays.
    several = groups.groupBy("group").agg(F.count("*").alias("m")).filter("m > 1").select("group")
    linked = staged(groups.join(several, "group").select("key", "group").join(rows.select("key", F.col("doc.doc_id").alias("doc_id")), "key"), "pipeline-linked")
    first = linked.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("key"))
    lost = staged(linked.select("key").distinct().join(first, "key", "left_anti"), "pipeline-lost")
    again = staged(groups.filter("n > 1").select("key"), "pipeline-again")
    kept = rows.join(lost, "key", "left_anti")
    once = kept.join(again, "key", "left_anti").unionByName(kept.join(again, "key", "left_semi").dropDuplicates(["key"]))
    return once.select(*[F.col(f"doc.`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.emit(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece and its place in a sequence."""
    return packing.pack_documents(docs)


STAGES = [("quality classifier", rate), ("n-gram Jaccard join", one_of_each), ("mixing sources", mix_sources), ("best-fit packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{k}")
    return docs


