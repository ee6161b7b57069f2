"""Graph operators on small graphs with answers by hand, and against a plain search."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import components, graph, running, targets
from weftline.plans import reports

DAY0 = dt.datetime(2020, 1, 1)


def observations(spark, edges, kind="t"):
    rows = [(i, kind, DAY0 + dt.timedelta(days=day), s, d) for i, s, d, day in edges]
    return spark.createDataFrame(rows, "id long, type string, time timestamp_ntz, src_id long, dst_id long")


def hops(spark, edges, seed, k, **kw):
    inc = graph.incidence(observations(spark, edges))
    seeds = spark.createDataFrame([(seed,)], "seed long")
    return {r["obs_id"]: r["hop"] for r in graph.obs_hops(seeds, inc, k, **kw).collect()}


A, B, C, D = 1, 2, 3, 4
PATH = [(1, A, B, 1), (2, B, C, 2), (3, C, D, 3)]


def test_path(spark):
    assert hops(spark, PATH, A, 0) == {}
    assert hops(spark, PATH, A, 1) == {1: 1}
    assert hops(spark, PATH, A, 2) == {1: 1, 2: 2}
    assert hops(spark, PATH, A, 3) == {1: 1, 2: 2, 3: 3}
    assert hops(spark, PATH, A, 2, t_min="2020-01-02", t_max="2020-01-03") == {1: 1}


def test_cycle_with_chord(spark):
    edges = [(1, A, B, 1), (2, B, C, 1), (3, C, A, 1), (4, B, A, 1)]
    assert set(hops(spark, edges, A, 1)) == {1, 3, 4}
    assert set(hops(spark, edges, A, 2)) == {1, 2, 3, 4}


def test_self_loop_and_parallel_edges(spark):
    inc = graph.incidence(observations(spark, [(1, A, A, 1), (2, A, B, 1)]))
    assert inc.filter("id = 1").count() == 2
    assert set(hops(spark, [(1, A, B, 1), (2, A, B, 1)], A, 1)) == {1, 2}
    near = graph.neighbours(spark.createDataFrame([(A,)], "seed long"), graph.incidence(observations(spark, [(1, A, B, 1), (2, A, B, 1)])), 1)
    assert [(r["id"], r["hop"]) for r in near.collect()] == [(B, 1)]


def test_windows_of_their_own(spark):
    inc = graph.incidence(observations(spark, PATH))
    seeds = spark.createDataFrame([(A, DAY0, DAY0 + dt.timedelta(days=2)), (B, DAY0 + dt.timedelta(days=2), DAY0 + dt.timedelta(days=9))], "seed long, start timestamp_ntz, end timestamp_ntz")
    got = {(r["seed"], r["obs_id"]) for r in graph.obs_hops(seeds, inc, 3).collect()}
    assert got == {(A, 1), (B, 2), (B, 3)}


def test_a_traversal_for_each_year_equals_windows_of_years(spark):
    r = random.Random(7)
    inc = graph.incidence(observations(spark, [(i, r.randint(1, 9), r.randint(1, 9), r.choice([3, 200, 370, 500, 800])) for i in range(40)]))
    seeds = spark.createDataFrame([(1,), (2,), (3,)], "seed long")
    spans = spark.createDataFrame([(k, dt.datetime(y, 1, 1), dt.datetime(y + 1, 1, 1)) for k in (1, 2, 3) for y in (2020, 2021, 2022)], "seed long, start timestamp_ntz, end timestamp_ntz")
    for k in (1, 2, 3):
        want = {(r["seed"], r["start"].year, r["obs_id"], r["hop"]) for r in graph.obs_hops(spans, inc, k).collect()}
        assert want == {tuple(r) for r in graph.obs_hops(seeds, inc, k, by=F.year("time")).select("seed", "by", "obs_id", "hop").collect()}
        want = {(r["seed"], r["start"].year, r["id"], r["hop"]) for r in graph.neighbours(spans, inc, k, return_self=True).collect()}
        assert want == {tuple(r) for r in graph.neighbours(seeds, inc, k, return_self=True, by=F.year("time")).select("seed", "by", "id", "hop").collect()}


def test_windows_spread_over_seeds_are_not_broadcast(spark):
    inc = graph.incidence(observations(spark, PATH))
    windows = spark.createDataFrame([(k,) for k in range(50)], "id long")
    spans = targets.sweep(windows, "2020-01-01", "2021-01-01", 30).select(F.col("id").alias("seed"), "start", "end")
    plan = graph.obs_hops(spans, inc, 2)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_hops_against_search(spark, seed):
    r = random.Random(seed)
    edges = [(i, r.randrange(25), r.randrange(25), 1) for i in range(40)]
    for k in (1, 2, 3):
        want, frontier, seen = {}, {0}, {0}
        for hop in range(1, k + 1):
            new = [e for e in edges if e[1] in frontier or e[2] in frontier]
            for e in new:
                want.setdefault(e[0], hop)
            frontier = {x for e in new for x in e[1:3]} - seen
            seen |= frontier
        assert hops(spark, edges, 0, k) == want


def test_sampling_is_bounded_and_repeats(spark):
    edges = [(i, A, 10 + i, 1) for i in range(30)]
    one, two = hops(spark, edges, A, 1, sample=5), hops(spark, edges, A, 1, sample=5)
    assert len(one) == 5 and one == two and hops(spark, edges, A, 1, sample=5, salt=1) != one


@pytest.mark.parametrize(("seed", "limit"), [(3, 500_000), (4, 500_000), (4, 0)])
def test_components(spark, seed, limit, monkeypatch):
    monkeypatch.setattr(components, "FOREST_NODES", limit)
    r = random.Random(seed)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 900 + i) for i in range(80)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for x, y in edges:
        a, b = top(x), top(y)
        up[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (7, 7), (None, 3)], "a long, b long").repartition(7)
    got = {x["id"]: x["label"] for x in graph.components(df, spark.createDataFrame([(2000,)], "id long")).collect()}
    assert got == {x: top(x) for x in up} | {2000: 2000, 7: top(7)}
    assert graph.components(df.limit(0)).count() == 0


@pytest.mark.parametrize(("kind", "steps"), [("pairs", 0), ("hubs", 0), ("random", 0), ("climbing", 1)])
def test_components_take_star_steps_only_where_rounds_leave_most_edges(spark, monkeypatch, kind, steps):
    r = random.Random(5)
    edges = {
        "pairs": [(2 * i, 2 * i + 1) for i in range(400)], "hubs": [(h, h + k) for h in (1000, 2000, 3000) for k in range(1, 200)] + [(1000, 2000), (5000, 3000)],
        "random": [(r.randrange(900), r.randrange(900)) for _ in range(600)], "climbing": [(i, i + 1) for i in range(300)],
    }[kind]
    plain, taken = components._stars, []
    monkeypatch.setattr(components, "FOREST_NODES", 40)
    monkeypatch.setattr(components, "_stars", lambda work: taken.append(1) or plain(work))
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for x, y in edges:
        a, b = top(x), top(y)
        up[max(a, b)] = min(a, b)
    # Dealt out, so that tasks join up little by themselves.
    df = spark.createDataFrame(edges, "a long, b long").repartition(40)
    rows = graph.components(df, spark.createDataFrame([(9999,), (edges[0][0],)], "id long")).collect()
    assert sorted((x["id"], x["label"]) for x in rows) == sorted((x, top(x)) for x in [*up, 9999]) and len(taken) == steps


def test_adjacent_events(spark):
    inc = graph.incidence(observations(spark, [(1, A, B, 1), (2, A, C, 1), (3, A, B, 9), (4, D, A, 8)]))
    r = graph.adjacent_events(spark.createDataFrame([(A,), (9,)], "id long"), inc, "2020-01-03", "2020-01-04").collect()
    assert {(x["id"], x["prev_obs"], x["next_obs"]) for x in r} == {(A, 2, 4), (9, None, None)}


def test_gaps(spark):
    inc = graph.incidence(observations(spark, [(1, A, B, 0), (2, A, B, 10), (3, A, B, 200), (4, A, B, 383.5)])).filter("id = 1")
    got = targets.gaps(inc, 183).orderBy("start").collect()
    assert [(x["start"], x["end"], x["days"]) for x in got] == [(DAY0 + dt.timedelta(days=10), DAY0 + dt.timedelta(days=200), 190), (DAY0 + dt.timedelta(days=200), DAY0 + dt.timedelta(days=383.5), 183)]
    lists = {x["id"]: len(x["gaps"]) for x in targets.gap_ranges(inc, spark.createDataFrame([(A,), (C,)], "id long"), 183).collect()}
    assert lists == {A: 2, C: 0}


def test_disengagement(spark):
    wide = spark.createDataFrame([(1, 4, 2, 0), (2, 0, 0, 5), (3, 1, 1, 1)], "id int, y2000 long, y2001 long, y2002 long")
    assert {r["id"]: round(r["target"], 6) for r in targets.disengagement(wide, 2000).collect()} == {1: round(2 / 3, 6), 2: 0.0, 3: 0.0}


def test_adjacency_and_pooling(spark):
    inc = graph.incidence(observations(spark, [(1, A, B, 1), (2, B, C, 1)]))
    pairs = {(r["i"], r["j"]) for r in graph.adjacency(spark.createDataFrame([(A,)], "seed long"), inc, 2).collect()}
    assert pairs == {(0, 0), (1, 1), (2, 2), (0, 1), (1, 0), (1, 2), (2, 1)}
    features = spark.createDataFrame([(A, [1.0]), (B, [3.0]), (C, [8.0])], "id long, vector array<double>")
    mean = {r["id"]: r["value"] for r in graph.pool(features, inc).collect()}
    assert mean == {A: 2.0, B: 4.0, C: 5.5}
    assert {r["id"]: r["value"] for r in graph.pool(features, inc, "max", self_loops=False).collect()} == {A: 3.0, B: 8.0, C: 3.0}


def test_months_of_a_span(spark):
    got = spark.range(1).select(F.explode(targets.months(F.lit("2020-09-15").cast("date"), F.lit("2021-01-02").cast("date"))).alias("m")).select(F.concat_ws("-", F.year("m"), F.month("m"))).collect()
    assert [r[0] for r in got] == ["2020-9", "2020-10", "2020-11", "2020-12", "2021-1"]


def test_window_samples(spark):
    obs = observations(spark, [(1, A, B, 1), (2, A, B, 5), (3, A, B, 6), (4, C, B, 6)], "created")
    windows = spark.createDataFrame([(x, DAY0, DAY0 + dt.timedelta(days=4), DAY0 + dt.timedelta(days=8)) for x in (A, C)], "id long, start timestamp_ntz, pivot timestamp_ntz, end timestamp_ntz")
    rows = targets.window_samples(obs, windows).collect()
    assert [(r["id"], r["n_in"], r["n_out"], r["target"], r["weight"]) for r in rows] == [(A, 1, 2, 0.0, 2)]


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_running_sums(spark, n):
    df = spark.range(n).selectExpr("pmod(xxhash64(id), 1000003) as k", "id as v")
    rows = sorted((r["k"], r["v"], r["at"], r["s"]) for r in running.running_sums(df, ["k", "v"], {"at": F.lit(1), "s": F.col("v") * 0.5}).collect())
    total = 0.0
    for at, (_, v, place, s) in enumerate(rows):
        assert (place, s) == (at, total)
        total += v * 0.5
    assert len(rows) == n


@pytest.mark.parametrize("k", [1, 2, 3])
@pytest.mark.parametrize("return_self", [False, True])
def test_neighbours_among_some(spark, k, return_self):
    r = random.Random(k)
    rows = [(i, r.randint(1, 12), r.randint(1, 12)) for i in range(14)]
    obs = spark.createDataFrame([(i, "t", dt.datetime(2020, 1, 1), a, b) for i, a, b in rows], "id long, type string, time timestamp_ntz, src_id long, dst_id long")
    seeds, some = spark.createDataFrame([(n,) for n in range(1, 13)], "seed long"), spark.createDataFrame([(n,) for n in (2, 3, 7, 7, 11)], "id long")
    inc = graph.incidence(obs)
    want = sorted(tuple(x) for x in graph.neighbours(seeds, inc, k, return_self=return_self).collect() if x["id"] in (2, 3, 7, 11))
    assert want and sorted(tuple(x) for x in graph.neighbours(seeds, inc, k, return_self=return_self, among=some).collect()) == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_degrees_are_counted_before_they_are_joined(spark):
    from weftline.plans import graph_queries

    # as for tables too large to be broadcast; where they are not, Spark moves the join below the counts by itself
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = graph_queries.degrees(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert -1 < plan.find("LeftSemi") < plan.find("Aggregate [id")


@pytest.mark.parametrize("case", ["plain", "shared ids"])
def test_contributor_detail_yearly_equals_a_plain_search(spark, case):
    r = random.Random(7)
    # loops, parallel edges, edges between neighbours of a person, ids that several edges share, ids and ends that are null
    edges = [(k, r.randrange(14), r.randrange(14), r.choice([5, 50, 400, 420, 800])) for k in range(60)] + [(90, 3, 3, 5), (91, None, 4, 5), (92, 3, None, 5)]
    if case == "shared ids":
        edges += [(k, r.randrange(14), r.randrange(14), r.choice([5, 400, 2000])) for k in range(0, 12)] + [(None, 2, 3, 5), (95, 1, 5, 50), (95, 1, 5, 50)]
    people, kinds = [0, 1, 2, 3, 9], {i: "abc"[i % 3] for i in range(13)}
    want = {}
    for year in (2020, 2021):
        within = [e for e in edges if (DAY0 + dt.timedelta(days=e[3])).year == year]
        for seed in people:
            near = {seed} | {x for e in within if seed in e[1:3] for x in e[1:3]}
            ids = {e[0] for e in within if (near - {None}) & set(e[1:3])} - {None}
            for i, s, d, _ in edges:
                if i in ids and s in kinds and d in kinds:
                    key = seed, year, f"{kinds[s]} -> {kinds[d]}"
                    want[key] = want.get(key, 0) + 1
    persons, typed = spark.createDataFrame([(i,) for i in people], "id long"), spark.createDataFrame(list(kinds.items()), "id long, type string")
    got = reports.contributor_detail_yearly(persons, graph.incidence(observations(spark, edges)), typed, range(2020, 2022))
    rows = got.collect()
    assert {(x.seed, x.year, x.kind_pair): x.n for x in rows} == want and len(rows) == len(want) > 20


def test_contributor_detail_yearly_lists_no_edge_a_person(spark):
    inc = graph.incidence(observations(spark, [(1, 1, 10, 5), (2, 2, 10, 5), (3, 10, 20, 6), (4, 10, 21, 400)]))
    persons, kinds = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, "p"), (2, "p"), (10, "w"), (20, "f"), (21, "f")], "id long, type string")
    got = reports.contributor_detail_yearly(persons, inc, kinds, range(2020, 2022))
    assert "obs_id" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1, 2020, "p -> w", 2), (1, 2020, "w -> f", 1), (2, 2020, "p -> w", 2), (2, 2020, "w -> f", 1)]
