"""Temporal-graph operators: DataFrames in, DataFrames out, for many starting points at once.

Observations are (id, type, time, src_id, dst_id, ...). All traversal goes over `incidence`, the undirected form with
one row for each end of an edge, so that "either end" is an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.stage import staged

from .components import components

__all__ = ["adjacency", "collaborators", "commits_via_requests", "adjacent_events", "components", "edges_in_window", "entities_in_window", "incidence", "neighbours", "obs_hops", "path", "pool", "search", "summarise_neighbours"]


def incidence(obs: DataFrame) -> DataFrame:
    """(id, other_id, obs_id, type, time, dir): each edge from both ends; a self loop once. Edges are read once for both."""
    end = lambda a, b, dir: F.struct(F.col(a).alias("id"), F.col(b).alias("other_id"), F.lit(dir).alias("dir"))
    out, back = end("src_id", "dst_id", "out"), end("dst_id", "src_id", "in")
    ends = F.explode(F.when(F.col("src_id") != F.col("dst_id"), F.array(out, back)).otherwise(F.array(out))).alias("e")
    return obs.select(F.col("id").alias("obs_id"), "type", "time", ends).select("e.id", "e.other_id", "obs_id", "type", "time", "e.dir")


def in_range(time: Column, start=None, end=None, closed: bool = False) -> Column:
    """start <= time < end, or <= end if closed; a bound that is None is open. Bounds are columns or literals."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (time >= start)
    if end is not None:
        keep = keep & ((time <= end) if closed else (time < end))
    return keep


def _bounded(inc: DataFrame, t_min, t_max) -> DataFrame:
    lit = lambda x: x if x is None or isinstance(x, Column) else F.lit(x).cast("timestamp_ntz")
    return inc.filter(in_range(F.col("time"), lit(t_min), lit(t_max)))


def obs_hops(seeds: DataFrame, inc: DataFrame, k: int, t_min=None, t_max=None, sample: int = 0, salt: int = 0, by: Column | None = None) -> DataFrame:
    """(seed, [by,] obs_id, hop): the edges within k hops of each seed in [t_min, t_max), each with the hop that finds it first.

    seeds: (seed), or (seed, start, end) for a window of its own. Nodes are expanded once a seed; an edge between two
    explored nodes still counts. sample: at most so many edges of a node and hop, by a salted hash, so that a repeated
    task draws alike. by: a column of the edges (their year, say): a traversal for each of its values. k = 0 is empty.
    """
    keys = _keys(seeds, by)
    return _steps(seeds, inc, k, t_min, t_max, sample, salt, by=by).groupBy("seed", *keys, "obs_id").agg(F.min("hop").alias("hop"))


def _keys(seeds: DataFrame, by: Column | None) -> list[str]:
    return [c for c in ("start", "end") if c in seeds.columns] + ([] if by is None else ["by"])


def _steps(seeds: DataFrame, inc: DataFrame, k: int, t_min=None, t_max=None, sample: int = 0, salt: int = 0, among: DataFrame | None = None, by: Column | None = None, whole: bool = False) -> DataFrame:
    """(seed, [by,] id, other_id, obs_id, hop): each edge as often as a hop meets it, from the end that it is met at. among: (id)
    to which the last hop, if not the first, goes; what it meets besides is left out. whole: with time and dir of the edges; each hop
    then deals only edges between the least and the greatest id that it can start from, and leaves out those back to the seed."""
    windows, keys = _keys(seeds, None), _keys(seeds, by)
    frontier = seeds.select("seed", *windows, F.col("seed").alias("id")).distinct()
    edges = _bounded(inc, t_min, t_max)
    if by is not None:
        edges = edges.withColumn("by", by).filter("by is not null")
    found = explored = None
    reach = span(seeds, "seed") if whole else None
    for hop in range(1, k + 1):
        last = among is not None and not sample and hop == k > 1
        # Spark takes windows spread over few ids for few rows: what it would broadcast grows with the seeds.
        at = frontier.hint("merge") if windows else frontier
        if whole:
            met = edges.filter(F.col("id").between(*reach))
            reach = span(met, "other_id") if hop < k else None
        else:
            met = edges
        step = at.join(edges.join(among.select(F.col("id").alias("other_id")), "other_id", "left_semi") if last else met, ["id", "by"] if by is not None and hop > 1 else "id")
        if windows:
            step = step.filter(in_range(F.col("time"), *[F.col(c) if c in windows else None for c in ("start", "end")]))
        if sample:
            drawn = Window.partitionBy("seed", *keys, "id").orderBy(F.md5(F.concat_ws(":", F.lit(f"{salt}:{hop}"), "id", "obs_id").cast("binary")), "obs_id")
            step = step.withColumn("_rank", F.row_number().over(drawn)).filter(F.col("_rank") <= sample)
        if whole and hop > 1:
            # All edges of the seed are found by the first hop.
            step = step.filter("not (other_id <=> seed)")
        new = step.select("seed", *keys, "id", "other_id", "obs_id", F.lit(hop).alias("hop"), *(["time", "dir"] if whole else []))
        found = new if found is None else found.unionByName(new)
        if hop < k:
            # The seed itself is explored from the first hop on.
            frontier = step.filter("other_id <> seed").select("seed", *keys, F.col("other_id").alias("id")).distinct()
            if hop >= 2:
                frontier = staged(frontier.join(explored.hint("merge"), ["seed", *keys, "id"], "left_anti"), "hop-frontier")
            explored = frontier if explored is None else explored.unionByName(frontier)
    if found is None:
        none = seeds.select("seed", *windows, F.col("seed").alias("id"), F.col("seed").alias("other_id"), F.col("seed").alias("obs_id"), F.lit(0).alias("hop")).limit(0)
        return none if by is None else none.join(edges.select("by").limit(0))
    return found


def span(df: DataFrame, column: str) -> tuple[int, int]:
    """The least and the greatest of a column, (0, -1) where there is none."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    return (0, -1) if low is None else (low, high)


def neighbours(seeds: DataFrame, inc: DataFrame, k: int, t_min=None, t_max=None, return_self: bool = False, among: DataFrame | None = None, by: Column | None = None, **sampling) -> DataFrame:
    """(seed, [by,] id, hop): ends of the edges within k hops, with the least hop. The seed itself only if return_self, and only
    where it has an edge in the window. With among, (id), only those: hubs are then not spread out in the last hop. by: as
    for `obs_hops`."""
    keys = _keys(seeds, by)
    # From the second hop on, an edge is met from a node that the hop before has brought: only its other end can be new.
    ends = F.explode(F.when(F.col("hop") == 1, F.array("id", "other_id")).otherwise(F.array("other_id"))).alias("id")
    ends = _steps(seeds, inc, k, t_min, t_max, among=among, by=by, **sampling).select("seed", *keys, ends, "hop")
    if among is not None:
        ends = ends.join(among.select("id"), "id", "left_semi")
    met = ends.groupBy("seed", *keys, "id").agg(F.min("hop").alias("hop"))
    return met if return_self else met.filter("id <> seed")


def entities_in_window(obs: DataFrame, start: str, end: str) -> DataFrame:
    """(id): ends of the edges in the closed window."""
    kept = obs.filter(F.col("time").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    return kept.select(F.explode(F.array("src_id", "dst_id")).alias("id")).distinct()


def edges_in_window(ids: DataFrame, obs: DataFrame, start: str, end: str) -> DataFrame:
    """(id, obs_id, other_id, dir, time) in the closed window; a self loop is listed as source and as destination."""
    kept = obs.filter(F.col("time").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    out = kept.select(F.col("src_id").alias("id"), F.col("id").alias("obs_id"), F.col("dst_id").alias("other_id"), F.lit("out").alias("dir"), "time")
    back = kept.select(F.col("dst_id").alias("id"), F.col("id").alias("obs_id"), F.col("src_id").alias("other_id"), F.lit("in").alias("dir"), "time")
    return out.unionByName(back).join(ids.select("id").distinct(), "id", "left_semi")


def adjacent_events(ids: DataFrame, inc: DataFrame, t0: str, t1: str) -> DataFrame:
    """(id, prev_obs, next_obs): the last edge strictly before t0 and the first strictly after t1; ties: the greater id
    before, the smaller after."""
    low, high = F.lit(t0).cast("timestamp_ntz"), F.lit(t1).cast("timestamp_ntz")
    near = inc.join(ids.select("id").distinct(), "id", "left_semi").filter((F.col("time") < low) | (F.col("time") > high))
    at = F.struct("time", "obs_id")
    ends = near.groupBy("id").agg(F.max(F.when(F.col("time") < low, at)).alias("p"), F.min(F.when(F.col("time") > high, at)).alias("n"))
    return ids.select("id").distinct().join(ends, "id", "left").select("id", F.col("p.obs_id").alias("prev_obs"), F.col("n.obs_id").alias("next_obs"))


def path(start: DataFrame, inc: DataFrame, entity: DataFrame, steps: list[tuple], by: Column | None = None, dedupe: bool = True) -> DataFrame:
    """(start, [by,] id): ends of the typed paths. A step is (dir, edge types or None, node type or None); dir "out", "in"
    or None for either. by: a column of the edges (their year, say) that all edges of a path must share.

    Duplicates go between the steps, so a hub multiplies nothing twice.
    """
    kinds = entity.select(F.col("id").alias("other_id"), F.col("type").alias("_kind"))
    keys = [] if by is None else ["by"]
    edges = inc if by is None else inc.withColumn("by", by)
    at = start.select(F.col("id").alias("start"), "id")
    for n, (direction, types, kind) in enumerate(steps):
        e = edges
        if direction:
            e = e.filter(F.col("dir") == direction)
        if types:
            e = e.filter(F.col("type").isin(*types))
        e = e.select("id", "other_id", *keys)
        if dedupe:
            e = e.distinct()
        if kind:
            e = e.join(kinds.filter(F.col("_kind") == kind).select("other_id"), "other_id", "left_semi")
        at = at.join(e, ["id", *(keys if n else [])]).select("start", *keys, F.col("other_id").alias("id"))
        if dedupe:
            at = at.distinct()
    return at


def summarise_neighbours(inc: DataFrame, cap: int = 5) -> DataFrame:
    """(id, type, n_others, first, last) of the edge types by which a node meets more than `cap` others."""
    groups = inc.groupBy("id", "type").agg(F.count_distinct("other_id").alias("n_others"), F.min("time").alias("first"), F.max("time").alias("last"))
    return groups.filter(F.col("n_others") > cap)


def adjacency(seeds: DataFrame, inc: DataFrame, k: int, t_min=None, t_max=None) -> DataFrame:
    """(seed, i, j): index pairs of each seed's k-hop subgraph, symmetric and with self loops. Index 0 is the seed, the
    others follow by the hop and edge that first bring them."""
    hops = obs_hops(seeds, inc, k, t_min, t_max)
    edges = hops.join(inc.filter("dir = 'out'").select("obs_id", F.col("id").alias("src"), F.col("other_id").alias("dst")), "obs_id")
    ends = edges.select("seed", "hop", "obs_id", F.explode(F.array("src", "dst")).alias("id"))
    nodes = ends.groupBy("seed", "id").agg(F.min(F.struct("hop", "obs_id")).alias("at"))
    order = Window.partitionBy("seed").orderBy((F.col("id") != F.col("seed")).cast("int"), "at", "id")
    index = nodes.withColumn("i", F.row_number().over(order) - 1).select("seed", "id", "i")
    one = edges.join(index.withColumnsRenamed({"id": "src"}), ["seed", "src"]).join(index.withColumnsRenamed({"id": "dst", "i": "j"}), ["seed", "dst"])
    pairs = one.select("seed", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p"))
    loops = index.select("seed", F.struct("i", F.col("i").alias("j")).alias("p"))
    return pairs.union(loops).distinct().select("seed", "p.i", "p.j")


def pool(features: DataFrame, inc: DataFrame, how: str = "mean", self_loops: bool = True) -> DataFrame:
    """(id, at, value): each position of the vectors of a node's distinct neighbours (and itself), averaged or maximal.
    features: (id, vector array)."""
    pairs = inc.select("id", "other_id").distinct()
    if self_loops:
        pairs = pairs.unionByName(features.select("id", F.col("id").alias("other_id"))).distinct()
    values = features.select(F.col("id").alias("other_id"), F.posexplode("vector").alias("at", "value"))
    fold = F.avg if how == "mean" else F.max
    return pairs.join(values, "other_id").groupBy("id", "at").agg(fold("value").alias("value"))


def search(named: DataFrame, pattern: str, limit: int = 10, column: str = "cached_names", entity_id: int | None = None) -> DataFrame:
    """The entity with the id (first), and those of whose names, a line each, one matches the pattern; `limit` in all."""
    hit = F.coalesce(F.col("id") == F.lit(entity_id), F.lit(False))
    line = F.col(column).rlike("(?im)" + pattern)
    return named.filter(hit | line).withColumn("by_id", hit).orderBy(F.desc("by_id"), "id").limit(limit)


def collaborators(obs: DataFrame) -> DataFrame:
    """(work, person): who created a work, and who sent a message that refers to it."""
    made = obs.filter("type = 'created'").select(F.col("dst_id").alias("work"), F.col("src_id").alias("person"))
    refers = obs.filter("type = 'message_ref'").select(F.col("src_id").alias("message"), F.col("dst_id").alias("work"))
    sent = obs.filter("type = 'message_from'").select(F.col("dst_id").alias("message"), F.col("src_id").alias("person"))
    return made.union(refers.join(sent, "message").select("work", "person")).distinct()


def commits_via_requests(obs: DataFrame) -> DataFrame:
    """(person, commit): commits a person created, and those attached to a pull request that the person created."""
    made = obs.filter("type = 'created'").select(F.col("src_id").alias("person"), F.col("dst_id").alias("thing"))
    attached = obs.filter("type = 'attached_to'").select(F.col("src_id").alias("commit"), F.col("dst_id").alias("thing"))
    return made.select("person", F.col("thing").alias("commit")).union(made.join(attached, "thing").select("person", "commit")).distinct()
