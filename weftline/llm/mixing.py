"""Mixing sources to target weights.

Tokens are summed for each source, each source gets a repetition rate, and each document is emitted
floor(rate) times plus one Bernoulli copy with the fraction as its probability. The draw is a hash of the
seed and the document's id, so reruns and retried tasks agree. DataFrame functions only.

Defined cases: a null or empty text has size 0 and takes 0 words; a null source is a source of its own and
sorts last; repeated rows draw alike; a null doc_id draws by its text; an empty table gives an empty table.
Other columns of the input stay in `emit`, whatever their names; `mix` replaces those named like its results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.running import running_sums

from .common import BLANKS, staged

#: Bits of the draw, taken from the front of an MD5.
DRAW = 32


def n_words(text: Column) -> Column:
    """Runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{BLANKS}]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size), stored.

    The shares are a water level: a source gets level * weight, or `most` times its size where that is less.
    Sorted by the level at which each source fills up, the full ones come first, and running sums give the
    level. The sums run over ranges of sources, so their number has no bound.
    """
    # Stored, since dealing rows to ranges reads them twice, and each time would count the words of all texts again.
    by_source = staged(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sums")
    pick = F.array(*[F.lit(float(w)) for w in weights])
    ranked = running_sums(by_source, [F.col("source").asc_nulls_last()], {"_at": F.lit(1)})
    rows = ranked.withColumn("_w", F.element_at(pick, (F.col("_at") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_full", F.col("_cap") / F.col("_w"))
    rows = staged(running_sums(rows, ["_full", "_at"], {"_caps": F.col("_cap"), "_ws": F.col("_w")}), "source-levels")
    size, weight = rows.agg(F.sum("source_size").cast("double"), F.sum("_w")).first()
    rows = rows.withColumn("_level", (F.lit(size or 0.0) - F.col("_caps")) / (F.lit(weight or 0.0) - F.col("_ws")))
    first_open = rows.filter("_full > _level").agg(F.min(F.struct("_full", "_at", "_level"))).first()[0]
    target = F.col("_cap") if first_open is None else F.least(F.col("_cap"), F.lit(first_open["_level"]) * F.col("_w"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    return staged(rows.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate")), "source-shares")


def draw(seed: int, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the document alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, DRAW // 4), 16, 10).cast("long") / F.lit(float(2**DRAW))


def measured(docs: DataFrame, seed: int) -> DataFrame:
    """(doc struct, source, size, draw): the input's columns apart, so that no name can clash."""
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    return docs.select(doc, F.col("source").alias("source"), n_words(F.col("text")).alias("size"), draw(seed, F.col("doc_id"), F.col("text")).alias("draw"))


def drawn(sized: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """(doc struct, size, source_size, target, rate, copies) from measured rows."""
    # The shares are a stored table of a row a source: Spark sends it to the tasks where its files are small, and
    # shuffles, with AQE splitting the hot sources, where not.
    shares = targets(sized.select("source", "size"), weights, most).withColumnRenamed("source", "of")
    joined = sized.join(shares, sized["source"].eqNullSafe(shares["of"]), "left")
    whole = F.floor("rate")
    copies = F.least(whole + (F.col("draw") < F.col("rate") - whole).cast("long"), F.lit(int(most)))
    return joined.select("doc", "size", "source_size", "target", "rate", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, seed: int = 20, keep: list[str] | None = None) -> DataFrame:
    """The documents with size, source_size, target, rate and copies (how often the mix takes each), which replace columns
    of these names.

    With `keep`, only these columns of the documents stay. Their texts are then read once: sizes and draws are stored beside
    the kept columns, and the shares and the result both come from that narrow table.
    """
    added = ["size", "source_size", "target", "rate", "copies"]
    sized = measured(docs, seed)
    names = docs.columns if keep is None else keep
    if keep is not None:
        kept = F.struct(*[F.col(f"doc.`{c}`") for c in keep]).alias("doc")
        sized = staged(sized.select(kept, "source", "size", "draw"), "source-sizes")
    return drawn(sized, weights, most).select(*[F.col(f"doc.`{c}`") for c in names if c not in added], *added)


def emit(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, seed: int = 20) -> DataFrame:
    """The mixed corpus itself: each document as many times as it is taken, with its own columns, whatever their names."""
    taken = drawn(measured(docs, seed), weights, most).filter("copies > 0")
    return taken.select("doc", F.explode(F.expr("sequence(1L, copies)"))).select(*[F.col(f"doc.`{c}`") for c in docs.columns])


def op5(spark, sf_dir):
    from .common import table

    return mix(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS pos FROM s),
c AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST(pos % 3 + 1 AS INT)] AS w, source_size * 3.0::DOUBLE AS cap FROM w),
f AS (SELECT *, cap / w AS fullness FROM c),
l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY fullness, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY fullness, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
o AS (SELECT *, (SELECT arg_min(level, pos) FROM (SELECT level, row_number() OVER (ORDER BY fullness, pos) AS pos FROM l WHERE fullness > level)) AS water FROM l),
t AS (SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * w) END AS target FROM o),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM t)
SELECT d.doc_id, d.size, r.source_size, r.target,
  d.size * CAST(least(floor(r.rate) + CAST((CAST(('0x' || substr(md5('20:' || coalesce(CAST(d.doc_id AS VARCHAR), d.text, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)
    < r.rate - floor(r.rate) AS INT), 3) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
