"""Grids of trees, samples, scorers, densities and stored matrices against plain versions."""

import datetime as dt
import hashlib
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.operators import graph, grids, samples, scorers, targets
from weftline.plans import reports
from weftline.sources import matrix

T = dt.datetime


# --- grids


@pytest.mark.parametrize("seed", range(6))
def test_first_split_is_the_best_one(seed):
    r = np.random.default_rng(seed)
    bins, y = r.integers(0, grids.BINS, (60, 3)), r.normal(size=60)
    weight, least = r.integers(0, 3, 60).astype(float), 6
    tree = grids.Tree(bins, y, weight, 1, least, 3, r)
    found = {}
    for f in range(3):
        for bound in range(grids.BINS):
            low, high = bins[:, f] <= bound, bins[:, f] > bound
            n = weight[low].sum(), weight[high].sum()
            if min(n) >= least // 2:
                mean = lambda rows: np.average(y[rows], weights=weight[rows])
                whole = np.average(y, weights=weight)
                found[f, bound] = (weight * (y - whole) ** 2).sum() - sum((weight[s] * (y[s] - mean(s)) ** 2).sum() for s in (low, high))
    feature, bound = (int(x[0]) for x in tree.splits[0])
    assert math.isclose(found[feature, bound], max(found.values()), rel_tol=1e-9) and math.isclose(tree.gains.sum(), max(found.values()), rel_tol=1e-9)
    assert np.array_equal(tree.leaf, tree.leaves(bins)) and np.array_equal(tree.leaf, (bins[:, feature] > bound).astype(int))


def test_leaf_medians():
    r = np.random.default_rng(3)
    leaf, v = r.integers(0, 5, 200), r.normal(size=200)
    leaf[leaf == 3] = 2
    got = grids.leaf_medians(leaf, v, 6)
    assert [got[k] for k in (0, 1, 2, 4)] == [np.median(v[leaf == k]) for k in (0, 1, 2, 4)] and got[3] == got[5] == 0


@pytest.mark.parametrize("kind", ["gbt", "forest"])
def test_counts_of_trees_are_read_off_one_fit(kind):
    r = np.random.default_rng(0)
    x = r.integers(0, 32, (400, 4))
    y = x[:, 0] * 0.1 + (x[:, 1] > 10) * 2 + r.normal(0, 0.2, 400)
    setting = {"learning_rate": 0.1, "min_samples_split": 6, "max_depth": 3, "max_features": 2}
    train, test = (x[:300], y[:300]), (x[300:], y[300:])
    several = list(grids.fit(kind, setting, train, test, [5, 20, 60]))
    for k, loss, importance in several:
        ((_, own, alone),) = grids.fit(kind, setting, train, test, [k])
        assert own == loss and np.array_equal(alone, importance) and math.isclose(importance.sum(), 1)
    naive = np.abs(test[1] - np.median(train[1])).mean()
    assert several[-1][1] < 0.5 * naive and several[-1][2][:2].sum() > 0.6


def people_table(spark, n=600):
    r = np.random.default_rng(1)
    rows = [(i, float(a), float(b), float(2 * a + (b > 3)), "train" if i % 5 else "test") for i, (a, b) in enumerate(r.integers(0, 9, (n, 2)))]
    return spark.createDataFrame(rows, "id long, f1 double, f2 double, target double, part string")


def test_grid_beats_the_naive_prediction(spark):
    small = {"n_estimators": [10, 40], "learning_rate": [0.3, 0.1], "min_samples_split": [2, 20], "max_depth": [2, 3], "max_features": [1, 16]}
    df = people_table(spark)
    got = grids.fit_grid(df, "id", ["f1", "f2"], "target", "gbt", small).collect()
    assert len(got) == 32 and sorted(map(tuple, got)) == sorted(map(tuple, grids.fit_grid(df.repartition(7), "id", ["f1", "f2"], "target", "gbt", small).collect()))
    y = {p: [r.target for r in df.filter(f"part = '{p}'").collect()] for p in ("train", "test")}
    naive = np.abs(np.array(y["test"]) - np.median(y["train"])).mean()
    assert min(r.loss for r in got) < 0.1 * naive and all(math.isclose(r.f1 + r.f2, 1) for r in got)
    grid = spark.createDataFrame(got)
    rows = {r.label: r for r in grids.with_means(grid, ["f1", "f2"]).filter("label <> 'setting'").collect()}
    best = sorted(got, key=lambda r: r.loss)[: len(got) // 10 + 1]
    assert math.isclose(rows["top_10pc_mean"].f1, np.mean([r.f1 for r in best])) and math.isclose(rows["mean"].f1, np.mean([r.f1 for r in got]))
    assert grids.fit_grid(df.limit(0), "id", ["f1", "f2"], "target", "forest", {k: v for k, v in small.items() if k != "learning_rate"}).count() == 0


def test_whole_grids_have_every_setting():
    assert [math.prod(map(len, g.values())) for g in (grids.BOOSTING, grids.FOREST)] == [432, 144]


@pytest.mark.parametrize("kind", ["gbt", "forest"])
def test_fits_see_every_row(spark, kind):
    n = 12_000
    one = {"n_estimators": [1], "learning_rate": [1.0], "min_samples_split": [2], "max_depth": [1], "max_features": [1]}
    keep = one if kind == "gbt" else {k: v for k, v in one.items() if k != "learning_rate"}
    df = spark.range(n).select("id", F.lit(0.0).alias("f1"), F.when(F.col("id") % 7 == 0, F.col("id") * 1.0).otherwise(1.0).alias("target"), F.when(F.col("id") < n // 2, "train").otherwise("test").alias("part"))
    ((loss,),) = grids.fit_grid(df, "id", ["f1"], "target", kind, keep).select("loss").collect()
    # one leaf: its value is the median (or near the mean) of all training rows, and the loss is over all test rows
    y = np.array([k if k % 7 == 0 else 1.0 for k in range(n)])
    plain = np.abs(y[n // 2 :] - 1).mean()
    assert math.isclose(loss, plain, rel_tol=1e-9) if kind == "gbt" else math.isclose(loss, np.abs(y[n // 2 :] - y[: n // 2].mean()).mean(), rel_tol=0.02)


def test_quantiles_are_exact(spark):
    r = np.random.default_rng(8)
    x = np.stack([r.integers(0, 9, 70_001), r.permutation(70_001)], 1)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in x], "a long, b long")
    rank = [-(-len(x) * c // grids.BINS) - 1 for c in range(1, grids.BINS)]
    assert grids.quantiles(df.repartition(5), ["a", "b"]) == {f: sorted({float(np.sort(x[:, k])[i]) for i in rank}) for k, f in enumerate("ab")}


@pytest.mark.parametrize("n", [300, grids.PAIRED + 77])
def test_counts_of_signs_and_of_two_features_give_the_same_trees(n):
    r = np.random.default_rng(n)
    bins, y, weight = r.integers(0, grids.BINS, (n, 3)), r.integers(-1, 2, n), r.integers(0, 2, n)
    trees = [grids.Tree(bins, y.astype(float), weight.astype(float), 3, 6, 2, np.random.default_rng(1), signs=s) for s in (False, True)]
    assert all(np.array_equal(a, b) for s, t in zip(trees[0].splits, trees[1].splits, strict=True) for a, b in zip(s, t, strict=True))
    assert np.array_equal(trees[0].leaf, trees[1].leaf) and np.array_equal(trees[0].leaf, trees[0].leaves(bins)) and np.allclose(trees[0].gains, trees[1].gains)
    kept = weight > 0
    low = bins[kept, trees[0].splits[0][0][0]] <= trees[0].splits[0][1][0]
    part = lambda s: y[kept][s].sum() ** 2 / s.sum()
    assert math.isclose(trees[0].level_gains[0].sum(), part(low) + part(~low) - part(np.ones(len(low), bool)), rel_tol=1e-9)


def test_depths_of_a_forest_are_one_fit():
    r = np.random.default_rng(0)
    x, y = r.integers(0, 32, (500, 4)), r.normal(size=500)
    setting, parts = {"min_samples_split": 6, "max_features": 2}, ((x[:400], y[:400]), (x[400:], y[400:]))
    for d, k, loss, importance in grids.fit_depths("forest", setting, [2, 3, 5], *parts, [4, 9]):
        ((_, own, alone),) = grids.fit("forest", setting | {"max_depth": d}, *parts, [k])
        assert math.isclose(own, loss, rel_tol=1e-9) and np.allclose(alone, importance)


# --- samples


def edges(spark):
    rows = [(1, "created", T(2020, 1, 5), 10, 100), (2, "modified", T(2020, 1, 6), 100, 200), (3, "modified", T(2020, 3, 1), 100, 201), (4, "created", T(2020, 3, 2), 10, 101), (5, "created", T(2020, 1, 7), 11, 101), (6, "modified", T(2020, 1, 8), 100, 100), (7, "created", T(2021, 1, 1), 10, 102)]
    return spark.createDataFrame([(i, 1, *r) for i, *r in rows], "id long, batch_id long, type string, time timestamp_ntz, src_id long, dst_id long")


def test_sample_graphs(spark):
    obs = edges(spark)
    entity = spark.createDataFrame([(10, "person"), (11, "person"), (100, "git_commit"), (101, "git_commit"), (200, "file"), (201, None)], "id long, type string")
    terms = spark.createDataFrame([(200, 3.0), (201, 9.0)], "id long, terms double")
    windows = spark.createDataFrame([(10, T(2020, 1, 1), T(2020, 2, 1), T(2020, 4, 1)), (10, T(2020, 2, 1), T(2020, 2, 15), T(2020, 4, 1)), (12, T(2020, 1, 1), T(2020, 2, 1), T(2020, 4, 1))], "id long, start timestamp_ntz, pivot timestamp_ntz, end timestamp_ntz")
    found = samples.sample_edges(obs, windows, 2)
    assert sorted(r.obs_id for r in found.collect()) == [1, 2, 3, 4, 5, 6]
    nodes = samples.staged(samples.sample_nodes(found, entity, terms, ["git_commit", "file"]), "n")
    # 11 and 101 come by an edge before the pivot that the second hop meets at 101, which an edge after the pivot led to
    assert [(r.i, r.id, r.type, r.root, r.terms) for r in nodes.orderBy("i").collect()] == [(0, 10, -1, 1, 0.0), (1, 100, 0, -1, 0.0), (2, 200, 1, -1, 3.0), (3, 101, 0, -1, 0.0), (4, 11, -1, -1, 0.0)]
    pairs = samples.sample_pairs(found, nodes)
    want = {(k, k) for k in range(5)} | {(0, 1), (1, 0), (1, 2), (2, 1), (3, 4), (4, 3)}
    assert {(r.i, r.j) for r in pairs.collect()} == want and pairs.count() == len(want)
    (row,) = samples.as_arrays(nodes, pairs, samples.sample_targets(found, entity)).collect()
    assert (row.n_nodes, row.type, row.root, row.terms, row.n_in, row.n_out, row.target, row.weight) == (5, [-1, 0, 1, 0, -1], [1, -1, -1, -1, -1], [0.0, 0.0, 3.0, 0.0, 0.0], 1, 1, 0.0, 2)
    assert list(zip(row.i, row.j, strict=True)) == sorted(want)
    assert samples.sample_edges(obs, windows.limit(0), 2).count() == 0


def test_sample_edges_bring_their_ends_along(spark, monkeypatch):
    plans, plain = {}, samples.staged
    monkeypatch.setattr(samples, "staged", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and plain(df, name))
    windows = spark.createDataFrame([(10, T(2020, 1, 1), T(2020, 2, 1), T(2020, 4, 1))], "id long, start timestamp_ntz, pivot timestamp_ntz, end timestamp_ntz")
    assert samples.sample_edges(edges(spark), windows, 2).count() == 6
    assert not [x for x in plans["sample-edges"].split("\n") if "Join [obs_id" in x]


def some_graph(spark):
    r = np.random.default_rng(11)
    rows = [(k, 1, ("created", "modified")[int(r.integers(2))], T(2020, 1, 1) + dt.timedelta(days=int(r.integers(120))), int(a), int(b)) for k, (a, b) in enumerate(r.integers(0, 25, (90, 2)))]
    obs = spark.createDataFrame(rows, "id long, batch_id long, type string, time timestamp_ntz, src_id long, dst_id long")
    windows = [(i, T(2020, m, 1), T(2020, m, 15), T(2020, m + 1, 10)) for i in range(0, 12) for m in (1, 2)]
    return rows, obs, windows, spark.createDataFrame(windows, "id long, start timestamp_ntz, pivot timestamp_ntz, end timestamp_ntz")


@pytest.mark.parametrize("k", [1, 2, 3])
def test_sample_edges_equal_a_plain_search(spark, k):
    rows, obs, windows, df = some_graph(spark)
    want = set()
    for i, start, pivot, end in windows:
        within = [r for r in rows if start <= r[3] < end]
        if any(r[2] == "created" and r[4] == i and r[3] < pivot for r in within):
            near, hops = {i}, {}
            for hop in range(1, k + 1):
                met = [r for r in within if r[4] in near or r[5] in near]
                for r in met:
                    hops.setdefault(r[0], hop)
                near = near | {x for r in met for x in r[4:]}
            want |= {(i, start, h, o) for o, h in hops.items()}
    assert {(r.seed, r.start, r.hop, r.obs_id) for r in samples.dealt_edges(obs, df, k).collect()} == want and len(want) > 10


def test_whole_samples_equal_their_parts_and_are_dealt_once(spark):
    _, obs, _, windows = some_graph(spark)
    entity = spark.createDataFrame([(i, ("git_commit", "file", "git_commit", None, "git_commit")[i % 5]) for i in range(24)], "id long, type string")
    terms = spark.createDataFrame([(i, float(i)) for i in range(0, 25, 3)], "id long, terms double")
    found = samples.dealt_edges(obs, windows, 2)
    stored = samples.staged(found, "e")
    nodes = samples.staged(samples.sample_nodes(stored, entity, terms, ["git_commit", "file"]), "n")
    pairs = samples.sample_pairs(found)
    of_nodes = nodes.select("seed", "start", "i", "id")
    joined = stored.filter("time < pivot").join(of_nodes.withColumnsRenamed({"id": "src"}), ["seed", "start", "src"]).join(of_nodes.withColumnsRenamed({"id": "dst", "i": "j"}), ["seed", "start", "dst"])
    want = {(r.seed, r.start, *p) for r in joined.collect() for p in ((r.i, r.j), (r.j, r.i))} | {(r.seed, r.start, r.i, r.i) for r in nodes.collect()}
    got = [(r.seed, r.start, r.i, r.j) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want) > 50
    whole = samples.whole_samples(found, entity, terms, ["git_commit", "file"])
    parts = samples.as_arrays(nodes, samples.sample_pairs(stored), samples.sample_targets(stored, entity))
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.select(whole.columns).collect())) and whole.count() > 3
    # what is found is dealt by sample once; the arrays read the same rows twice and deal nodes again, after their types are known
    dealt = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].split("\n") if "Exchange hashpartitioning(seed" in x]
    assert [x for x in dealt(pairs) if "obs_id" in x.split("]")[0] or ", i#" in x] == [] and len([x for x in dealt(pairs) if "REPARTITION_BY_COL" in x]) == 1
    whole.collect()
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") >= 1


def test_ends_that_are_null_are_nodes_without_pairs(spark):
    rows = [(1, 1, "created", T(2020, 1, 5), 10, 100), (2, 1, "modified", T(2020, 1, 6), 100, None)]
    obs = spark.createDataFrame(rows, "id long, batch_id long, type string, time timestamp_ntz, src_id long, dst_id long")
    windows = spark.createDataFrame([(10, T(2020, 1, 1), T(2020, 2, 1), T(2020, 4, 1))], "id long, start timestamp_ntz, pivot timestamp_ntz, end timestamp_ntz")
    entity, terms = spark.createDataFrame([(10, "person"), (100, "git_commit")], "id long, type string"), spark.createDataFrame([(9, 1.0)], "id long, terms double")
    found = samples.dealt_edges(obs, windows, 2)
    assert [(r.i, r.id) for r in samples.sample_nodes(found, entity, terms, ["git_commit"]).orderBy("i").collect()] == [(0, 10), (1, 100), (2, None)]
    assert sorted((r.i, r.j) for r in samples.sample_pairs(found).collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)]
    ((n, n_in),) = samples.whole_samples(found, entity, terms, ["git_commit"]).select("n_nodes", "n_in").collect()
    assert (n, n_in) == (3, 1)


def test_hops_deal_only_edges_that_they_can_start_from(spark):
    rows = [(k, 1, "created", T(2020, 1, 2), 10 + k % 3, 100 + k) for k in range(9)] + [(20 + k, 1, "modified", T(2020, 1, 3), 100 + k, 900 + k) for k in range(9)]
    inc = graph.incidence(spark.createDataFrame(rows, "id long, batch_id long, type string, time timestamp_ntz, src_id long, dst_id long"))
    seeds = spark.createDataFrame([(10, T(2020, 1, 1), T(2020, 2, 1))], "seed long, start timestamp_ntz, end timestamp_ntz")
    found = graph._steps(seeds, inc, 2, whole=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all(x in plan for x in (">= 10)", "<= 10)", ">= 100)", "<= 106)"))
    assert sorted((r.hop, r.obs_id) for r in found.collect()) == [(1, 0), (1, 3), (1, 6), (2, 20), (2, 23), (2, 26)]


def test_random_windows_are_the_same_again(spark):
    start = T(2020, 1, 1)
    rows = [(k, 1, "created", start + dt.timedelta(hours=k), 1 + (k % 3 == 0), 1000 + k) for k in range(400)]
    inc = graph.incidence(spark.createDataFrame(rows, "id long, batch_id long, type string, time timestamp_ntz, src_id long, dst_id long"))
    persons = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    got = sorted(map(tuple, samples.random_windows(inc, persons, 50, 2, 200).collect()))
    assert got == sorted(map(tuple, samples.random_windows(inc.repartition(5), persons, 50, 2, 200).collect()))
    low, high = start + dt.timedelta(hours=1), start + dt.timedelta(hours=398)
    assert len(got) == 50 and {g[0] for g in got} == {1} and all(low <= g[3] <= high and g[4] - g[3] == g[3] - g[2] == dt.timedelta(days=2) for g in got)
    for i, draw, _, pivot, _ in got[:5]:
        h = int(hashlib.md5(f"0:{i}:{draw}".encode()).hexdigest()[:8], 16)
        assert pivot == low + dt.timedelta(seconds=(int((high - low).total_seconds()) + 1) * h >> 32)
    assert samples.random_windows(inc, persons, 50, 2, 10_000).count() == 0


def test_random_windows_round_the_ends_of_a_span_as_their_sql_does(spark):
    def pivots(low_micros, high_micros):
        low, high = T(2020, 1, 1) + dt.timedelta(microseconds=low_micros), T(2020, 3, 1) + dt.timedelta(microseconds=high_micros)
        rows = [(k, 1, "created", t, 1, 1000 + k) for k, t in enumerate((low, high))]
        inc = graph.incidence(spark.createDataFrame(rows, "id long, batch_id long, type string, time timestamp_ntz, src_id long, dst_id long"))
        return sorted(map(tuple, samples.random_windows(inc, spark.createDataFrame([(1,)], "id long"), 9, 2, 2).collect()))

    assert pivots(700_000, 900_000) == pivots(1_000_000, 1_000_000) != pivots(0, 0)
    assert pivots(500_000, 1_500_000) == pivots(0, 2_000_000)


def test_windows_that_start_together_are_counted_each(spark):
    obs = edges(spark)
    windows = spark.createDataFrame([(10, k, T(2020, 1, 1), T(2020, 2, 1), T(2020, 4, 1)) for k in range(2)], "id long, draw long, start timestamp_ntz, pivot timestamp_ntz, end timestamp_ntz")
    counts = targets.window_samples(obs, windows)
    assert sorted((r.draw, r.n_in, r.n_out) for r in counts.collect()) == [(0, 1, 1), (1, 1, 1)]
    assert "SortMergeJoin" not in counts._jdf.queryExecution().executedPlan().toString()


# --- scorers


def test_batches_are_full_whatever_comes_in():
    parts = [pa.RecordBatch.from_pydict({"id": list(range(a, b))}) for a, b in ((0, 3), (3, 3), (3, 300), (300, 301))]
    got = [t.column(0).to_pylist() for t in scorers.in_batches(iter(parts), 128)]
    assert [len(x) for x in got] == [128, 128, 45] and sum(got, []) == list(range(301))
    assert list(scorers.in_batches(iter([]), 4)) == []


def test_scores_equal_text_by_text(spark):
    texts = [f"the {'a' * k} end\n> quoted aaaa\nCheers\nAaron" for k in range(300)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    make = lambda: scorers.LetterModel({"a": (0.02, -0.1, 0.3), "e": (1.0, 0.5, -2.0)}, (0.1, 0.2, 0.3))
    got = {r.id: (*r.classification, r.regression) for r in scorers.score_bodies(df, make).collect()}
    assert len(got) == len(texts)
    bodies = {r.id: r.b or "" for r in df.select("id", scorers.body(df.text).alias("b")).collect()}
    model = make()
    for i, b in bodies.items():
        pair, single = model([b])
        assert "quoted" not in b and "Aaron" not in b
        assert np.allclose(got[i], [*scorers.softmax(pair)[0], scorers.sigmoid(single)[0]], atol=1e-12)
    assert np.allclose(scorers.sigmoid(np.array([-800.0, 0, 800])), [0, 0.5, 1]) and np.allclose(scorers.softmax(np.array([[1e4, -1e4]])), [[1, 0]])


def test_heads_are_fitted_on_other_rows(spark):
    rows = [(k, f"{'awful rot' if k % 2 else 'fine work'} number {k % 7}\n> awful rot", k % 2) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, text string, toxic long")
    df = df.withColumn("body", scorers.body(df.text))
    got = {r.id: r for r in scorers.train_heads(df.filter("id < 100"))(df.drop("toxic")).collect()}
    assert len(got) == 200
    assert all((got[k].classification[1] > 0.5) == (got[k].regression > 0.5) == bool(k % 2) for k in range(100, 200))


# --- densities and matrices


def test_density_equals_plain_sums(spark):
    r = np.random.default_rng(5)
    start, days = dt.date(2000, 1, 1), 3000
    touched = [(int(p), int(f), T(2000, 1, 1) + dt.timedelta(days=int(x))) for p, f, x in zip(r.integers(0, 4, 300), r.integers(0, 40, 300), r.integers(-50, days + 50, 300), strict=True)]
    end = (start + dt.timedelta(days=days)).isoformat()
    df = spark.createDataFrame(touched, "person long, file long, time timestamp_ntz")
    found = reports.density(df, "2000-01-01", end)
    kernel = reports.Kernel("2000-01-01", end)
    per = defaultdict(lambda: np.zeros(101))
    for p, f, t in touched:
        at = math.floor((t - T(2000, 1, 1)).days / days * 100 + 0.5)
        if 0 <= at <= 100:
            per[p, f] += [kernel.heights[abs(at - k)] for k in range(101)]
    want = defaultdict(lambda: np.zeros(101))
    for (p, _), curve in per.items():
        want[p] += np.minimum(curve, 1)
    got = defaultdict(lambda: np.zeros(101))
    for row in found.collect():
        got[row.person][row["at"]] = row.density
    assert got.keys() == want.keys() and all(np.allclose(got[p], want[p]) for p in want)
    for row in reports.density_index(found).collect():
        assert math.isclose(row.most, want[row.person].max()) and math.isclose(row.last, want[row.person][100], abs_tol=1e-12)


def test_joint_density_splits_good_and_bad(spark):
    members = spark.createDataFrame([(1, "x"), (2, "x"), (1, "y"), (1, "z"), (3, "z"), (1, "x")], "person long, project string")
    projects = spark.createDataFrame([("x", T(2001, 1, 1), True), ("y", T(2003, 1, 1), False), ("z", None, True)], "project string, time timestamp_ntz, good boolean")
    got = {(r.a, r.b): r for r in reports.joint_density(members, projects, "2000-01-01", "2010-01-01", least_share=0.4).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (2, 1), (3, 1)} and (got[1, 1].n, got[1, 1].n_good) == (3, 2)
    own, kernel = got[1, 1], reports.Kernel("2000-01-01", "2010-01-01")
    assert math.isclose(sum(own.curve) - sum(own.good), sum(kernel.heights[abs(30 - k)] for k in range(101)))
    assert all(s is None or math.isclose(s, c / o) for s, c, o in zip(got[2, 1].share, got[2, 1].curve, got[2, 2].curve, strict=True)) and sum(got[3, 1].curve) == 0


def test_joint_density_totals_are_sums_of_curves(spark):
    r = np.random.default_rng(4)
    members = spark.createDataFrame([(int(a), f"p{b}") for a, b in zip(r.integers(0, 12, 150), r.integers(0, 60, 150), strict=True)], "person long, project string")
    projects = spark.createDataFrame([(f"p{k}", T(1999, 6, 1) + dt.timedelta(days=70 * k), k % 3 == 0) for k in range(60)], "project string, time timestamp_ntz, good boolean")
    rows = reports.joint_density(members, projects, "2000-01-01", "2010-01-01", least_share=0)
    got = rows.collect()
    assert len({(x.a, x.b) for x in got}) == len(got) > 100 and any(x.a != x.b and x.n == 1 for x in got) and any(x.a != x.b and x.n > 2 for x in got)
    for x in got:
        assert math.isclose(x.total, sum(x.curve), abs_tol=1e-9) and math.isclose(x.total_good, sum(x.good), abs_tol=1e-9)
        best = max((s for s in x.share if s is not None), default=None) if sum(x.curve) else None
        assert x.most == best or math.isclose(x.most, best)
    # rows of pairs are dealt once, by a
    plan = rows.select("a", "b", "most")._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning(a" in x and ", b#" in x]


def test_matrix_entries_are_dealt_once_and_read_in_one_pass(spark, tmp_path):
    entries = spark.createDataFrame([("x", "y", 1.0), ("y", "z", 2.0)], "a string, b string, value double")
    index = spark.createDataFrame([("x", 0), ("y", 1), ("z", 2)], "name string, i long")
    plan = matrix.blocks(entries, index)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning(block") == 1 and "Exchange hashpartitioning(i#" not in plan and "Exchange hashpartitioning(block" not in plan
    matrix.write(entries, str(tmp_path / "m"))
    assert "slice(" not in matrix.read(spark, str(tmp_path / "m"))._jdf.queryExecution().executedPlan().toString()


def test_matrix_round_trip(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = [(f"n{a}", f"n{b}", float(v)) for a, b, v in zip(r.integers(0, 60, 300), r.integers(0, 60, 300), r.integers(1, 9, 300), strict=True)]
    want = defaultdict(float)
    for a, b, v in rows:
        want[a, b] += v
    matrix.write(spark.createDataFrame(rows, "a string, b string, value double"), str(tmp_path / "m"), rows=16)
    assert {(x.a, x.b): x.value for x in matrix.read(spark, str(tmp_path / "m")).collect()} == want
    names = sorted({x for k in want for x in k})
    part = {(x.a, x.b): x.value for x in matrix.read(spark, str(tmp_path / "m"), matrix.F.col("block") == 1).collect()}
    assert part == {k: v for k, v in want.items() if k[0] in names[16:32]}
    blocks = spark.read.parquet(str(tmp_path / "m/blocks")).collect()
    assert all(len(b.offsets) == 17 and b.offsets[-1] == len(b.columns) == len(b["values"]) for b in blocks)
