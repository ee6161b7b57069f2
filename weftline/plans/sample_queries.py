"""Queries of training samples and of the grids of tree ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import grids, samples, targets
from weftline.sources.stage import staged

from . import fixture, graph_queries
from .fixture import with_tables

QUERIES: dict = {}
SQL: dict = {}

TYPES = ["git_commit", "file", "message", "person"]
DAYS, FIRST, LAST = 730, "1995-01-01", "2001-07-31"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def terms(spark, d):
    return fixture.table(spark, d, "part").select((F.lit(fixture.PART) + F.col("p_partkey")).cast("long").alias("id"), F.col("p_size").alias("terms"))


def edges(spark, d):
    """Two hops around every customer with an order before the pivot of a window of two years."""
    windows = targets.sweep(fixture.persons(spark, d), FIRST, LAST, DAYS)
    return samples.dealt_edges(graph_queries.obs(spark, d), windows, 2)


def nodes(spark, d, found):
    return samples.sample_nodes(found, fixture.entities(spark, d).select("id", "type"), terms(spark, d), TYPES)


def day(df):
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd"))


_samples = f"""{with_tables('entity', 'person', 'incidence')},
s AS (SELECT unnest(generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{LAST}', INTERVAL {DAYS} DAY)) AS start),
w AS (SELECT DISTINCT p.id AS seed, s.start, s.start + INTERVAL {DAYS // 2} DAY AS mid, s.start + INTERVAL {DAYS} DAY AS "end" FROM person p, s
  WHERE EXISTS (SELECT 1 FROM observation o WHERE o.type = 'created' AND o.src_id = p.id AND o.time >= s.start AND o.time < s.start + INTERVAL {DAYS // 2} DAY)),
h1 AS (SELECT DISTINCT seed, start, mid, "end", i.obs_id, i.other_id FROM w JOIN incidence i ON i.id = w.seed AND i.time >= start AND i.time < "end"),
h2 AS (SELECT DISTINCT h.seed, h.start, h.mid, h."end", i.obs_id FROM (SELECT DISTINCT seed, start, mid, "end", other_id FROM h1 WHERE other_id <> seed) h
  JOIN incidence i ON i.id = h.other_id AND i.time >= h.start AND i.time < h."end"),
e AS (SELECT x.seed, x.start, x.mid, x.hop, o.id AS obs_id, o.src_id AS src, o.dst_id AS dst, o.time FROM
  (SELECT seed, start, mid, obs_id, min(hop) AS hop FROM (SELECT seed, start, mid, obs_id, 1 AS hop FROM h1 UNION ALL SELECT seed, start, mid, obs_id, 2 FROM h2) GROUP BY ALL) x JOIN observation o ON o.id = x.obs_id),
a AS (SELECT * FROM e WHERE time < mid),
f AS (SELECT seed, start, id, min((hop, obs_id, side)) AS place FROM (SELECT seed, start, dst AS id, hop, obs_id, 0 AS side FROM a UNION ALL SELECT seed, start, src, hop, obs_id, 1 FROM a) GROUP BY ALL),
n AS (SELECT seed, start, id, row_number() OVER (PARTITION BY seed, start ORDER BY CASE WHEN id = seed THEN 0 ELSE 1 END, place) - 1 AS i FROM f),
g AS (SELECT n.seed, n.start, n.i, n.id, coalesce(list_position({TYPES}, entity.type), 0) - 1 AS type, CASE WHEN n.id = n.seed THEN 1 ELSE -1 END AS root, coalesce(p_size, 0)::DOUBLE AS terms
  FROM n LEFT JOIN entity ON entity.id = n.id LEFT JOIN part ON 5000000000000 + p_partkey = n.id),
q AS (SELECT a.seed, a.start, x.i AS i, y.i AS j FROM a JOIN n x ON x.seed = a.seed AND x.start = a.start AND x.id = a.src JOIN n y ON y.seed = a.seed AND y.start = a.start AND y.id = a.dst),
z AS (SELECT seed, start, i, j FROM q UNION SELECT seed, start, j, i FROM q UNION SELECT seed, start, i, i FROM n),
t AS (SELECT e.seed, e.start, count(*) FILTER (time < mid) AS n_in, count(*) FILTER (time >= mid) AS n_out FROM e JOIN entity ON entity.id = e.dst AND entity.type = 'git_commit' WHERE e.src = e.seed GROUP BY ALL)"""


@query(f"{_samples} SELECT seed, strftime(start, '%Y-%m-%d') AS start, i, id, type::BIGINT AS type, root::BIGINT AS root, terms FROM g")
def sample_nodes(spark, d):
    return day(nodes(spark, d, edges(spark, d))).drop("end")


@query(f"{_samples} SELECT seed, strftime(start, '%Y-%m-%d') AS start, i, j FROM z")
def sample_pairs(spark, d):
    return day(samples.sample_pairs(edges(spark, d))).drop("end")


@query(f"""{_samples},
b AS (SELECT seed, start, count(*) AS n_nodes, string_agg(type, ',' ORDER BY i) AS type, string_agg(root, ',' ORDER BY i) AS root, string_agg(terms::BIGINT, ',' ORDER BY i) AS terms FROM g GROUP BY ALL),
c AS (SELECT seed, start, string_agg(i, ',' ORDER BY i, j) AS i, string_agg(j, ',' ORDER BY i, j) AS j FROM z GROUP BY ALL)
SELECT b.seed, strftime(b.start, '%Y-%m-%d') AS start, n_nodes, type, root, terms, c.i, c.j, n_in, n_out, round(least(0, (0.1 + n_out) / (0.1 + n_in) - 1), 9) AS target, 1 + n_in AS weight
FROM b JOIN c ON c.seed = b.seed AND c.start = b.start JOIN t ON t.seed = b.seed AND t.start = b.start""")
def sample_graphs(spark, d):
    rows = samples.whole_samples(edges(spark, d), fixture.entities(spark, d).select("id", "type"), terms(spark, d), TYPES)
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), ",")
    return day(rows).drop("end").withColumns({c: listed(c) for c in ("type", "root", "terms", "i", "j")}).withColumn("target", F.round("target", 9))


DRAWS, HALF = 20, 365
_windows = f"""{with_tables('entity', 'incidence')},
b AS (SELECT i.id, count(*) AS degree, epoch(min(time))::BIGINT AS low, epoch(max(time))::BIGINT AS high FROM incidence i JOIN entity e ON e.id = i.id AND e.type = 'person' GROUP BY i.id HAVING count(*) >= 100),
r AS (SELECT id, draw, low + (((high - low + 1) * CAST('0x' || substr(md5('0:' || id || ':' || draw), 1, 8) AS BIGINT)) >> 32) AS mid FROM b, unnest(range({DRAWS})) AS u(draw)),
w AS (SELECT id, draw, make_timestamp((mid - {HALF * 86400}) * 1000000) AS start, make_timestamp(mid * 1000000) AS mid, make_timestamp((mid + {HALF * 86400}) * 1000000) AS "end" FROM r)"""


def random_spans(spark, d):
    return samples.random_windows(graph_queries.inc(spark, d), graph_queries.people(spark, d), DRAWS, HALF)


@query(f"""{_windows} SELECT id, draw, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, strftime(mid, '%Y-%m-%d %H:%M:%S') AS "pivot", strftime("end", '%Y-%m-%d %H:%M:%S') AS "end" FROM w""")
def random_windows(spark, d):
    return random_spans(spark, d).withColumns({c: graph_queries.stamp(c) for c in ("start", "pivot", "end")})


@query(f"""{_windows},
c AS (SELECT w.id, w.draw, count(*) FILTER (o.time < w.mid) AS n_in, count(*) FILTER (o.time >= w.mid) AS n_out FROM w JOIN observation o ON o.src_id = w.id AND o.type = 'committed' AND o.time >= w.start AND o.time < w."end" GROUP BY ALL)
SELECT id, draw, n_in, n_out, round(least(0, (0.1 + n_out) / (0.1 + n_in) - 1), 9) AS target, 1 + n_in AS weight,
  CASE WHEN h < 90 THEN 'train' WHEN h < 95 THEN 'validate' ELSE 'test' END AS part FROM (SELECT *, CAST('0x' || substr(md5('0:' || id), 1, 8) AS BIGINT) % 100 AS h FROM c WHERE n_in > 0)""")
def random_window_samples(spark, d):
    rows = targets.window_samples(graph_queries.obs(spark, d), random_spans(spark, d), "committed")
    return targets.split(rows, "id", {"train": 90, "validate": 5, "test": 5}).select("id", "draw", "n_in", "n_out", F.round("target", 9).alias("target"), "weight", "part")


# --- grids

GRID_FEATURES = [f"hop{h}_size_{k}" for h in (1, 2) for k in range(4)]


def person_features(spark, d):
    """(id, hop1_size_0, .., hop2_size_3, target, part): sums of sizes around each customer, by the logarithm of what it spends."""
    part = fixture.table(spark, d, "part").select((F.lit(fixture.PART) + F.col("p_partkey")).cast("long").alias("id"), F.col("p_size").cast("long").alias("value"))
    order = fixture.table(spark, d, "orders").select((F.lit(fixture.ORDER) + F.col("o_orderkey")).cast("long").alias("id"), F.length("o_orderpriority").cast("long").alias("value"))
    attrs = part.unionByName(order).withColumn("key", F.concat(F.lit("size_"), F.col("value") % 4))
    sums = targets.neighbour_sums(graph_queries.customers(spark, d), graph_queries.inc(spark, d), attrs)
    wide = sums.withColumn("name", F.concat(F.lit("hop"), "hop", F.lit("_"), "key")).groupBy("id").pivot("name", GRID_FEATURES).agg(F.sum("total")).fillna(0, GRID_FEATURES)
    spent = fixture.table(spark, d, "orders").groupBy((F.lit(fixture.CUSTOMER) + F.col("o_custkey")).cast("long").alias("id")).agg(F.log10(1 + F.sum("o_totalprice")).alias("target"))
    return staged(targets.split(wide.join(spent, "id"), "id", {"train": 80, "test": 20}), "person-features")


def importance(spark, d, kind):
    rows = grids.fit_grid(person_features(spark, d), "id", GRID_FEATURES, "target", kind)
    return grids.with_means(staged(rows, f"{kind}-grid"), GRID_FEATURES)


@query()
def gbt_importance(spark, d):
    """All 432 settings of boosting, and the means of importances over all and over the best tenth."""
    return importance(spark, d, "gbt")


@query()
def forest_importance(spark, d):
    """All 144 settings of forests."""
    return importance(spark, d, "forest")
