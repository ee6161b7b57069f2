"""What is known of single entities and edges: attributes, labels, members of groups, contributing rows.

Attributes are maps from a key to JSON text, as the ingests make them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attr(attrs: Column, key: str) -> Column:
    """The text of an attribute: strings without their quotes, other values as JSON, null where it is missing or null."""
    value = F.concat(F.lit('{"v":'), F.try_element_at(attrs, F.lit(key)), F.lit("}"))
    return F.get_json_object(value, "$.v")


def is_text(attrs: Column, key: str) -> Column:
    """Whether an attribute is a JSON string; null where it is missing or null."""
    value = F.try_element_at(attrs, F.lit(key))
    return F.when(value != "null", value.startswith('"'))


def is_set(attrs: Column, key: str) -> Column:
    """Whether an attribute is there and is neither null, false, zero nor empty."""
    value = F.try_element_at(attrs, F.lit(key))
    return F.coalesce(~value.rlike(r'^\s*(null|false|""|\[\s*\]|\{\s*\}|-?0+(\.0*)?)\s*$'), F.lit(False))


def keys_by_type(entity: DataFrame, sources: DataFrame) -> DataFrame:
    """(type, key, n): the attribute names of the entities of each type, and how many have each.
    entity: (id, type), sources: (owner, attrs)."""
    keys = sources.select(F.col("owner").alias("id"), F.explode(F.map_keys("attrs")).alias("key")).distinct()
    return keys.join(entity.select("id", "type"), "id").groupBy("type", "key").agg(F.count("*").alias("n"))


def prefix_total(attrs: Column, prefix: str) -> Column:
    """The sum of the numbers among the attributes whose name starts with the prefix; 0 without any."""
    named = F.map_filter(attrs, lambda k, v: k.startswith(prefix))
    return F.aggregate(F.map_values(named), F.lit(0.0), lambda s, v: s + F.coalesce(v.try_cast("double"), F.lit(0.0)))


def prefix_totals(rows: DataFrame, prefix: str, parts: tuple[str, ...] = ("body", "quote", "sign")) -> DataFrame:
    """The rows with a column for each part: the sum of its attributes, named prefix + part, or that with "_" and more."""
    named = lambda p: F.map_filter("attrs", lambda k, v: (k == prefix + p) | k.startswith(prefix + p + "_"))
    return rows.withColumns({p: prefix_total(named(p), prefix) for p in parts})


def label(id: Column, kind: Column, name: Column) -> Column:
    """How an entity is shown; a missing name is shown as none."""
    return F.concat(F.lit("<"), id.cast("string"), F.lit(": "), kind, F.lit(" "), F.coalesce(name, F.lit("none")), F.lit(">"))


def edge_label(id: Column, kind: Column, time: Column, src: Column, dst: Column) -> Column:
    """How an edge is shown, with its day and its ends' labels; without a time it has no day."""
    day = F.concat(F.lit("@"), F.date_format(time, "yyyy-MM-dd"))
    return F.concat(F.lit("<"), id.cast("string"), F.lit(": ("), kind, F.lit(")"), F.coalesce(day, F.lit("")), F.lit(", "), src, F.lit(", "), dst, F.lit(">"))


def labels(ids: DataFrame, fused: DataFrame) -> DataFrame:
    """(id, label): the label of each asked entity, null where there is none. fused: (id, type, name)."""
    shown = fused.select("id", label(F.col("id"), F.col("type"), F.col("name")).alias("label"))
    return ids.select("id").distinct().join(shown, "id", "left")


def labelled_edges(obs: DataFrame, fused: DataFrame) -> DataFrame:
    """(id, label) of edges; an end that is no entity is shown as its number."""
    shown = fused.select("id", label(F.col("id"), F.col("type"), F.col("name")).alias("label"))
    src, dst = (shown.select(F.col("id").alias(f"{e}_id"), F.col("label").alias(e)) for e in ("src", "dst"))
    rows = obs.select("id", "type", "time", "src_id", "dst_id").join(src, "src_id", "left").join(dst, "dst_id", "left")
    end = lambda e: F.coalesce(e, F.col(f"{e}_id").cast("string"))
    return rows.select("id", edge_label(F.col("id"), F.col("type"), F.col("time"), end("src"), end("dst")).alias("label"))


def lookup(ids: DataFrame, fused: DataFrame, fusion: DataFrame, entity: DataFrame, batches: DataFrame) -> DataFrame:
    """(id, label, member_id, comment, batch_id, resource): each asked group with its members, the reason of each and the
    batch it came with, a row a member, so that no group is gathered; an unknown id is one row of nulls.
    batches: (batch_id, resource)."""
    members = fusion.select(F.col("id_lowest").alias("id"), F.col("id_other").alias("member_id"), "comment")
    home = entity.select(F.col("id").alias("member_id"), "batch_id").join(batches, "batch_id")
    return labels(ids, fused).join(members.join(home, "member_id", "left"), "id", "left").select("id", "label", "member_id", "comment", "batch_id", "resource")


def contributors(ids: DataFrame, sources: DataFrame, fusion: DataFrame | None = None) -> DataFrame:
    """(id, owner, src_id, attrs): the rows whose attributes are merged into each asked entity, or without a fusion into
    each asked edge; the greater src_id wins. sources: (owner, src_id, attrs)."""
    asked = ids.select("id").distinct()
    members = asked.withColumn("owner", F.col("id")) if fusion is None else asked.join(fusion.select(F.col("id_lowest").alias("id"), F.col("id_other").alias("owner")), "id")
    return members.join(sources, "owner").select("id", "owner", "src_id", "attrs")


def edges_between(obs: DataFrame, entity: DataFrame, src_type: str, dst_type: str, kind: str | None = None) -> DataFrame:
    """The edges (of a kind) from entities of one type to entities of another."""
    kept = obs if kind is None else obs.filter(F.col("type") == kind)
    ends = lambda c, t: entity.filter(F.col("type") == t).select(F.col("id").alias(c))
    return kept.join(ends("src_id", src_type), "src_id", "left_semi").join(ends("dst_id", dst_type), "dst_id", "left_semi")
