"""Training samples of a person's surroundings: a subgraph of the time before a pivot, and what the person does after it.

A sample is a person and a window (start, pivot, end). All samples are taken at once: edges within k hops of each person in
its own window are found together, those before the pivot make the input graph, the person's own works before and
from the pivot make the target. Nodes are numbered by first appearance: the person is 0, the others follow by hop and
edge, destinations before sources. Rows a node and rows a pair are the results; `as_arrays` folds them for a
trainer, a sample a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.stage import staged

from . import graph, targets

KEYS = ["seed", "start", "end"]


def draw_of(*parts: Column) -> Column:
    """A number below 2^32 that depends on the parts alone: the front of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def busy(inc: DataFrame, persons: DataFrame, least_degree: int = 100) -> DataFrame:
    """(id, degree, first, last): persons with as many ends of edges at least, and the times of their first and last one."""
    # Ends are counted before the join, so that it sorts a row a busy node, not one an end.
    ends = inc.groupBy("id").agg(F.count("*").alias("degree"), F.min("time").alias("first"), F.max("time").alias("last")).filter(F.col("degree") >= least_degree)
    return ends.join(persons.select("id").distinct(), "id", "left_semi")


def random_windows(inc: DataFrame, persons: DataFrame, draws: int, days: int, least_degree: int = 100, salt: int = 0) -> DataFrame:
    """(id, draw, start, pivot, end): `draws` windows of `days` before and after a pivot for every busy person.

    A pivot lies between the person's first and last edge, both at the nearest second (the even one of two), at the part of
    that span that a hash of salt, person and draw gives: the same windows in every run and engine, however the rows are dealt.
    """
    low, high = (F.rint(targets.seconds(F.col(c))).cast("long") for c in ("first", "last"))
    each = busy(inc, persons, least_degree).select("id", low.alias("low"), high.alias("high"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    pivot = F.col("low") + F.shiftright((F.col("high") - F.col("low") + 1) * draw_of(F.lit(salt), F.col("id"), F.col("draw")), 32)
    at = lambda seconds: F.timestamp_seconds(seconds).cast("timestamp_ntz")
    placed = each.select("id", F.col("draw").cast("long").alias("draw"), pivot.alias("_pivot"))
    return placed.select("id", "draw", at(F.col("_pivot") - days * 86400).alias("start"), at("_pivot").alias("pivot"), at(F.col("_pivot") + days * 86400).alias("end"))


def sample_edges(obs: DataFrame, windows: DataFrame, k: int, kind: str = "created") -> DataFrame:
    """`dealt_edges`, stored."""
    return staged(dealt_edges(obs, windows, k, kind), "sample-edges")


def dealt_edges(obs: DataFrame, windows: DataFrame, k: int, kind: str = "created") -> DataFrame:
    """(seed, start, end, pivot, hop, obs_id, src, dst, time): the edges within k hops of every person who has an edge of a kind
    between start and pivot of its window, in that window. windows: (id, start, pivot, end).

    Rows are dealt by sample, once: what follows a sample at a time (nodes, pairs, arrays) deals them no second time."""
    inc = graph.incidence(obs)
    wanted = targets.window_samples(obs, windows, kind).select("id", "start")
    seeds = windows.select(F.col("id").alias("seed"), "start", "end", "pivot").join(wanted.withColumnRenamed("id", "seed"), ["seed", "start"], "left_semi").distinct()
    seeds = staged(seeds, "sample-windows")
    # Hops bring the ends and times of their edges along, so that edges are not looked up again.
    found = graph._steps(seeds.select(*KEYS), inc, k, whole=True)
    out = F.col("dir") == "out"
    ends = [F.when(out, F.col("id")).otherwise(F.col("other_id")).alias("src"), F.when(out, F.col("other_id")).otherwise(F.col("id")).alias("dst")]
    each = found.select(*KEYS, "obs_id", "hop", *ends, "time").repartition(*KEYS).groupBy(*KEYS, "obs_id", "src", "dst", "time").agg(F.min("hop").alias("hop"))
    return each.join(seeds, KEYS)


def seed_first(column: str) -> Column:
    return F.when(F.col(column) == F.col("seed"), 0).otherwise(1)


def sample_nodes(edges: DataFrame, entity: DataFrame, terms: DataFrame, types: list[str]) -> DataFrame:
    """(seed, start, end, i, id, type, root, terms): the nodes of every input graph, in order. type: the place in `types` (-1:
    none of them), root: 1 for the person and -1 for others, terms: a node's counted terms, 0 where it has none.

    edges as `sample_edges` gives them; entity: (id, type); terms: (id, terms).
    """
    before = edges.filter("time < pivot")
    ends = before.select(*KEYS, F.explode(F.array(F.struct(F.col("dst").alias("id"), F.struct("hop", "obs_id", F.lit(0).alias("side")).alias("at")), F.struct(F.col("src").alias("id"), F.struct("hop", "obs_id", F.lit(1).alias("side")).alias("at")))).alias("e"))
    first = ends.groupBy(*KEYS, F.col("e.id").alias("id")).agg(F.min("e.at").alias("at"))
    order = Window.partitionBy(*KEYS).orderBy(seed_first("id"), "at")
    numbered = first.withColumn("i", (F.row_number().over(order) - 1).cast("long"))
    place = F.lit(-1)
    for n, name in enumerate(types):
        place = F.when(F.col("type") == name, n).otherwise(place)
    typed = numbered.join(entity.select("id", "type"), "id", "left").join(terms.select("id", "terms"), "id", "left")
    return typed.select(*KEYS, "i", "id", place.cast("long").alias("type"), F.when(F.col("id") == F.col("seed"), 1).otherwise(-1).cast("long").alias("root"), F.coalesce(F.col("terms").cast("double"), F.lit(0.0)).alias("terms"))


def sample_pairs(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(seed, start, end, i, j): the input graphs' pairs of node numbers, both ways, with a loop at every node. The numbers are those
    of `sample_nodes`, made within the sample: nodes are taken for the callers' sake and not read."""
    before = edges.filter("time < pivot")
    end = lambda c, side: F.struct(F.col(c).alias("id"), F.lit(side).alias("side"))
    ends = before.select(*KEYS, "hop", "obs_id", "src", "dst", F.explode(F.array(end("dst", 0), end("src", 1))).alias("e"))
    first = F.min(F.struct("hop", "obs_id", "e.side")).over(Window.partitionBy(*KEYS, "e.id"))
    order = Window.partitionBy(*KEYS).orderBy(seed_first("e.id"), "first", "e.id")
    placed = ends.withColumn("first", first).withColumn("n", (F.dense_rank().over(order) - 1).cast("long"))
    at = lambda side: F.max(F.when(F.col("e.side") == side, F.col("n")))
    one = placed.groupBy(*KEYS, "obs_id", "src", "dst").agg(at(1).alias("i"), at(0).alias("j"))
    pair = lambda a, b: F.struct(F.col(a).alias("i"), F.col(b).alias("j"))
    # An end that is null is a node, and no pair's.
    loops, both = (pair("i", "i"), pair("j", "j")), (pair("i", "j"), pair("j", "i"))
    each = F.when(F.col("src").isNull() | F.col("dst").isNull(), F.array(*loops)).otherwise(F.array(*loops, *both))
    return one.select(*KEYS, F.explode(each).alias("p")).select(*KEYS, "p.i", "p.j").distinct()


def sample_targets(edges: DataFrame, entity: DataFrame, work: str = "git_commit", beta: float = 0.1) -> DataFrame:
    """(seed, start, end, n_in, n_out, target, weight): a person's own edges to works before and from the pivot, by how much
    fewer they become (0: not fewer), and the sample's weight."""
    own = edges.filter("src = seed").join(entity.filter(F.col("type") == work).select(F.col("id").alias("dst")), "dst", "left_semi")
    counts = own.groupBy(*KEYS).agg(F.count_if(F.col("time") < F.col("pivot")).alias("n_in"), F.count_if(F.col("time") >= F.col("pivot")).alias("n_out"))
    target = F.least(F.lit(0.0), (beta + F.col("n_out")) / (beta + F.col("n_in")) - 1)
    return counts.select(*KEYS, "n_in", "n_out", target.alias("target"), (1 + F.col("n_in")).alias("weight"))


def as_arrays(nodes: DataFrame, pairs: DataFrame, goals: DataFrame) -> DataFrame:
    """A row a sample: n_nodes, types, root, terms (arrays by node number), i and j (arrays of pairs in order) and its target.
    A value holds one whole sample, so its hops and window should be chosen for what a trainer takes."""
    in_order = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    of = lambda column, field: F.transform(column, lambda x: x[field]).alias(field)
    a = nodes.groupBy(*KEYS).agg(F.count("*").alias("n_nodes"), in_order("i", "type", "root", "terms").alias("n")).select(*KEYS, "n_nodes", *[of("n", f) for f in ("type", "root", "terms")])
    b = pairs.groupBy(*KEYS).agg(in_order("i", "j").alias("p")).select(*KEYS, of("p", "i"), of("p", "j"))
    return a.join(b, KEYS).join(goals, KEYS)


def whole_samples(edges: DataFrame, entity: DataFrame, terms: DataFrame, types: list[str], work: str = "git_commit", beta: float = 0.1) -> DataFrame:
    """What `as_arrays` gives of nodes, pairs and targets, from edges as `dealt_edges` gives them: a sample's nodes and the works of
    its person are looked up together, and only they are dealt again."""
    edges = edges.filter("time < pivot or src = seed")
    before, own = F.col("time") < F.col("pivot"), F.col("src") == F.col("seed")
    end = lambda c, side, mine: F.struct(F.col(c).alias("id"), F.when(before, F.struct("hop", "obs_id", F.lit(side).alias("side"))).alias("at"), mine.alias("own"))
    ends = edges.select(*KEYS, before.alias("before"), F.explode(F.array(end("dst", 0, own), end("src", 1, F.lit(False)))).alias("e"))
    met = ends.groupBy(*KEYS, F.col("e.id").alias("id")).agg(F.min("e.at").alias("at"), F.count_if(F.col("e.own") & F.col("before")).alias("n_in"), F.count_if(F.col("e.own") & ~F.col("before")).alias("n_out"))
    order = Window.partitionBy(*KEYS).orderBy(F.col("at").isNull(), seed_first("id"), "at")
    numbered = met.withColumn("i", F.when(F.col("at").isNotNull(), (F.row_number().over(order) - 1).cast("long"))).filter("i is not null or n_out > 0")
    typed = numbered.select(*KEYS, "i", "id", "n_in", "n_out").join(entity.select("id", "type"), "id", "left").join(terms.select("id", "terms"), "id", "left")
    place = F.lit(-1)
    for n, name in enumerate(types):
        place = F.when(F.col("type") == name, n).otherwise(place)
    root = F.when(F.col("id") == F.col("seed"), 1).otherwise(-1).cast("long")
    node = F.when(F.col("i").isNotNull(), F.struct("i", place.cast("long").alias("type"), root.alias("root"), F.coalesce(F.col("terms").cast("double"), F.lit(0.0)).alias("terms")))
    mine = lambda c: F.sum(F.when(F.col("type") == work, F.col(c)).otherwise(0))
    of = lambda column, field: F.transform(column, lambda x: x[field]).alias(field)
    a = typed.select(*KEYS, node.alias("n"), "type", "n_in", "n_out").groupBy(*KEYS).agg(F.array_sort(F.collect_list("n")).alias("n"), mine("n_in").alias("n_in"), mine("n_out").alias("n_out")).filter("n_in + n_out > 0 and size(n) > 0")
    b = sample_pairs(edges).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("p"))
    target = F.least(F.lit(0.0), (beta + F.col("n_out")) / (beta + F.col("n_in")) - 1)
    goals = ["n_in", "n_out", target.alias("target"), (1 + F.col("n_in")).alias("weight")]
    nodes = [F.size("n").cast("long").alias("n_nodes"), *[of("n", f) for f in ("type", "root", "terms")]]
    return a.join(b, KEYS).select(*KEYS, *nodes, of("p", "i"), of("p", "j"), *goals)
