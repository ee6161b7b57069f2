"""Grids of tree ensembles: every setting fitted, losses and feature importances side by side.

Features are binned once, by exact quantiles over all rows, and every fit sees every row: the training part as bytes of bins
and a target, the test part in the same way, some 16 bytes a row for each task. Settings that differ only in the number of
trees are one fit, read off after each of their counts; forests that differ only in depth are one fit too, as the trees of
the lesser depth are the first levels of the deeper ones. A setting that tries more features than there are tries
all of them. The fits are dealt to tasks. Draws come from a generator seeded by what fits share, so a repeated task gives the same trees.

Boosting is by absolute loss: a tree is grown on the signs of the residuals, its leaves are moved by the medians of
theirs. A forest averages trees on bootstrap samples. Trees grow by levels over histograms of bins, counted for two features
at once and `CHUNK` rows at a time, so that a task holds little more than its rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.stage import staged

#: The whole grids: trees, rate (of boosting), least rows to split, depth, features tried at a split.
BOOSTING = {"n_estimators": [100, 300, 1000], "learning_rate": [0.1, 0.03, 0.01], "min_samples_split": [2, 6, 20, 50], "max_depth": [2, 3, 4, 5], "max_features": [4, 8, 16]}
FOREST = {k: v for k, v in BOOSTING.items() if k != "learning_rate"}
#: Bins of a feature, part of the rows a boosted tree sees, rows counted at a time, rows from which two features are counted at once.
BINS, SUBSAMPLE, CHUNK, PAIRED = 32, 0.9, 1 << 16, 50_000


class Bins:
    """Rows of bins as bytes, and codes of two features each, from whose histograms those of both follow; of one where rows are so
    few that the cells of two would outnumber them."""

    def __init__(self, rows: np.ndarray):
        self.rows = np.ascontiguousarray(rows, np.uint8)
        n, self.features = self.rows.shape
        wide = self.rows.astype(np.uint16)
        self.width = BINS**2 if n >= PAIRED else BINS
        paired = lambda f: wide[:, f] * BINS + (wide[:, f + 1] if f + 1 < self.features else 0)
        self.codes = [np.ascontiguousarray(paired(f)) for f in range(0, self.features, 2)] if n >= PAIRED else list(wide.T.copy())
        self.flat, self.starts = self.rows.ravel(), np.arange(0, min(n, CHUNK) * self.features, self.features)

    def __len__(self) -> int:
        return len(self.rows)

    def step(self, at: np.ndarray, low: int, feature: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The children that rows from `low` on come to."""
        flat = self.flat[low * self.features : (low + len(at)) * self.features]
        return 2 * at + (flat[self.starts[: len(at)] + feature[at]] > bound[at])

    def sums(self, cell: np.ndarray, low: int, cells: int, weights: tuple[np.ndarray, ...] | None) -> list[np.ndarray]:
        """(codes, cells * width) of rows from `low` on: how many, or the sum of each of the weights."""
        found: list[list[np.ndarray]] = [[] for _ in weights or [None]]
        base = cell * self.width
        for codes in self.codes:
            at = base + codes[low : low + len(cell)]
            for k, w in enumerate(weights or [None]):
                found[k].append(np.bincount(at, w, cells * self.width))
        return [np.stack(f) for f in found]

    def single(self, sums: np.ndarray, cells: int) -> np.ndarray:
        """(cells, features, BINS) from what `sums` gives."""
        if self.width == BINS:
            return sums.reshape(-1, cells, BINS).transpose(1, 0, 2)
        both = sums.reshape(-1, cells, BINS, BINS)
        return np.stack([both.sum(3), both.sum(2)], 1).reshape(-1, cells, BINS)[: self.features].transpose(1, 0, 2)


class Tree:
    """A regression tree over bins, level by level: node k has children 2k + 1 and 2k + 2. Rows of weight 0 are led to their
    leaves and count nowhere. signs: y is -1, 0 or 1 and weight 0 or 1, so that one count gives both sums."""

    def __init__(self, bins: np.ndarray | Bins, y: np.ndarray, weight: np.ndarray, depth: int, least_split: int, tried: int, rng: np.random.Generator, signs: bool = False):
        bins = bins if isinstance(bins, Bins) else Bins(bins)
        n, self.features = len(bins), bins.features
        self.depth, self.level_gains = depth, np.zeros((depth, self.features))
        self.splits: list[tuple[np.ndarray, np.ndarray]] = []
        least_leaf, at = max(1, least_split // 2), np.zeros(n, np.uint8 if depth <= 8 else np.int64)
        kind = np.where(weight > 0, y + 1, 3).astype(np.uint8) if signs else None
        for level in range(depth):
            nodes = 1 << level
            cells = nodes * 4 if signs else nodes
            all_sums: list[np.ndarray] = []
            for low in range(0, n, CHUNK):
                some, w = at[low : low + CHUNK].astype(np.int64), weight[low : low + CHUNK]
                if level:
                    some = bins.step(some, low, *self.splits[-1])
                    at[low : low + CHUNK] = some
                new = bins.sums(some * 4 + kind[low : low + CHUNK], low, cells, None) if signs else bins.sums(some, low, cells, (w, w * y[low : low + CHUNK]))
                all_sums = [a + b for a, b in zip(all_sums, new, strict=True)] if all_sums else new
            found = [bins.single(x, cells).astype(float).cumsum(2) for x in all_sums]
            if signs:
                less, none, more = (found[0][k::4] for k in range(3))
                found = [less + none + more, more - less]
            count, total = found
            n_all, s_all = count[:, :1, -1:], total[:, :1, -1:]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = total**2 / count + (s_all - total) ** 2 / (n_all - count) - s_all**2 / n_all
            allowed = (count >= least_leaf) & (n_all - count >= least_leaf) & (n_all >= least_split)
            if tried < self.features:
                allowed &= (rng.random((nodes, self.features)).argsort(1) < tried)[:, :, None]
            gain = np.where(allowed, gain, 0).reshape(nodes, -1)
            best = gain.argmax(1)
            most = gain[np.arange(nodes), best]
            grows = most > 1e-12
            feature, bound = np.where(grows, best // BINS, 0), np.where(grows, best % BINS, BINS)
            np.add.at(self.level_gains[level], feature[grows], most[grows])
            self.splits.append((feature, bound))
        for low in range(0, n, CHUNK):
            at[low : low + CHUNK] = bins.step(at[low : low + CHUNK].astype(np.int64), low, *self.splits[-1])
        self.leaf = at

    @property
    def gains(self) -> np.ndarray:
        return self.level_gains.sum(0)

    def leaves(self, bins: np.ndarray | Bins) -> np.ndarray:
        bins = bins if isinstance(bins, Bins) else Bins(bins)
        found = np.empty(len(bins), self.leaf.dtype)
        for low in range(0, len(bins), CHUNK):
            at = np.zeros(min(CHUNK, len(bins) - low), np.int64)
            for feature, bound in self.splits:
                at = bins.step(at, low, feature, bound)
            found[low : low + CHUNK] = at
        return found

    def importance(self, depth: int | None = None) -> np.ndarray:
        """Of the whole tree or of its first levels."""
        gains = self.level_gains[:depth].sum(0)
        return gains / total if (total := gains.sum()) > 0 else gains


def leaf_medians(leaf: np.ndarray, values: np.ndarray, leaves: int) -> np.ndarray:
    order = np.argsort(leaf.astype(np.uint16), kind="stable")
    ends = np.searchsorted(leaf[order], np.arange(leaves + 1))
    ordered, found = values[order], np.zeros(leaves)
    for k, (low, high) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if n := high - low:
            middle = np.partition(ordered[low:high], sorted({(n - 1) // 2, n // 2}))
            found[k] = (middle[(n - 1) // 2] + middle[n // 2]) / 2
    return found


def fit(kind: str, setting: dict, train: tuple[np.ndarray, np.ndarray], test: tuple[np.ndarray, np.ndarray], counts: list[int]) -> Iterator[tuple[int, float, np.ndarray]]:
    """(trees, absolute loss on test, importances) after each of `counts` trees."""
    for _, k, loss, importance in fit_depths(kind, setting, [setting["max_depth"]], train, test, counts):
        yield k, loss, importance


def fit_depths(kind: str, setting: dict, depths: list[int], train: tuple, test: tuple, counts: list[int]) -> Iterator[tuple[int, int, float, np.ndarray]]:
    """(depth, trees, absolute loss on test, importances) for each of the depths, of which boosting takes one."""
    (x, y), (x_test, y_test) = ((b if isinstance(b, Bins) else Bins(b), y) for b, y in (train, test))
    boosting, deepest = kind == "gbt", max(depths)
    seed_of = {n: min(v, x.features) if n == "max_features" else v for n, v in setting.items() if boosting or n != "max_depth"}
    seed = zlib.crc32(repr((kind, sorted(seed_of.items()))).encode())
    grown = {"depth": deepest, "least_split": setting["min_samples_split"], "tried": min(setting["max_features"], x.features)}
    start = float(np.median(y)) if boosting else 0.0
    now, then = np.full(len(y) if boosting else 0, start), {d: np.full(len(y_test), start) for d in depths}
    importance = {d: np.zeros(x.features) for d in depths}
    for k in range(1, max(counts) + 1):
        rng = np.random.default_rng((seed, k))
        if boosting:
            weight = np.ones(len(y), bool)
            weight[rng.choice(len(y), len(y) - max(1, int(SUBSAMPLE * len(y))), replace=False, shuffle=False)] = False
            residual = y - now
            tree = Tree(x, np.sign(residual), weight, rng=rng, signs=True, **grown)
            values = {deepest: setting["learning_rate"] * leaf_medians(tree.leaf[weight], residual[weight], 1 << deepest)}
            now += values[deepest][tree.leaf]
        else:
            weight = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
            tree = Tree(x, y, weight, rng=rng, **grown)
            sums = [np.bincount(tree.leaf, w, 1 << deepest) for w in (weight * y, weight)]
            with np.errstate(divide="ignore", invalid="ignore"):
                values = {d: np.nan_to_num(np.divide(*[w.reshape(1 << d, -1).sum(1) for w in sums])) for d in depths}
        leaves = tree.leaves(x_test)
        for d in depths:
            then[d] += values[d][leaves >> (deepest - d)]
            importance[d] += tree.importance(d)
        if k in counts:
            for d in depths:
                loss = float(np.mean(np.abs(y_test - (then[d] if boosting else then[d] / k))))
                yield d, k, loss, importance[d] / max(importance[d].sum(), 1e-300)


def quantiles(df: DataFrame, features: list[str]) -> dict[str, list[float]]:
    """The edges between a feature's bins: its exact quantiles over all rows, each once. Values are counted before they are put
    in order, so a task sorts a row a value of one feature."""
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f).cast("double").alias("v")) for k, f in enumerate(features)])).alias("e")
    counts = df.select(values).select("e.*").groupBy("k", "v").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.select("k", "v", "n", F.sum("n").over(upto).alias("last"), F.sum("n").over(Window.partitionBy("k")).alias("all"))
    # The value at rank ceil(all * c / BINS) for each cut c, in whole numbers.
    rank = lambda c: F.expr(f"(all * {c} + {BINS - 1}) div {BINS}")
    hit = F.exists(F.array(*[rank(c) for c in range(1, BINS)]), lambda r: (r > F.col("last") - F.col("n")) & (r <= F.col("last")))
    found: dict[str, list[float]] = {f: [] for f in features}
    for row in ranked.filter(hit).select("k", "v").collect():
        found[features[row.k]].append(row.v)
    return {f: sorted(v) for f, v in found.items()}


def binned(df: DataFrame, features: list[str]) -> DataFrame:
    """df with each feature as its bin, 0 to BINS - 1, between quantiles over all rows."""
    edges = quantiles(df, features)
    bin_of = lambda f: F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges[f]]), lambda e: e < F.col(f))) if edges[f] else F.lit(0)
    return df.withColumns({f: bin_of(f).cast("byte") for f in features})


def fit_grid(df: DataFrame, key: str, features: list[str], y: str, kind: str = "gbt", grid: dict[str, list] | None = None) -> DataFrame:
    """A row a setting of the whole grid: its values, loss on all rows of part = 'test', and an importance a feature; fitted on
    all rows of part = 'train'. Rows with a null among features or target are left out."""
    grid = grid or (BOOSTING if kind == "gbt" else FOREST)
    names = [n for n in grid if n != "n_estimators"]
    whole = staged(df.select(key, F.col(y).cast("double").alias(y), "part", *features).dropna(), "grid-rows")
    rows = binned(whole, features)

    def all_of(part: str) -> tuple[np.ndarray, np.ndarray]:
        kept = rows.filter(F.col("part") == part).orderBy(F.xxhash64(key), key, y, *features).select(y, *features).toArrow()
        return np.stack([kept.column(f).to_numpy().astype(np.uint8) for f in features], 1).reshape(-1, len(features)), kept.column(y).to_numpy()

    spark = df.sparkSession
    data = spark.sparkContext.broadcast((all_of("train"), all_of("test")))
    # One fit for settings that differ in trees, in features tried beyond those there are, and in forests in depth.
    capped: dict[int, list[int]] = {}
    for m in grid["max_features"]:
        capped.setdefault(min(m, len(features)), []).append(m)
    together = [[d] for d in grid["max_depth"]] if kind == "gbt" else [list(grid["max_depth"])]
    others = [n for n in names if n not in ("max_depth", "max_features")]
    fits = list(product(*(grid[n] for n in others), sorted(capped, reverse=True), together))
    # the deepest first, so that the last tasks are short ones
    fits.sort(key=lambda s: -max(s[-1]))
    kinds = {n: "double" if isinstance(grid[n][0], float) else "long" for n in names}
    schema = "n_estimators long, " + ", ".join(f"{n} {kinds[n]}" for n in names) + ", loss double, " + ", ".join(f"`{f}` double" for f in features)
    dealt = spark.createDataFrame([(k,) for k in range(len(fits))], "place long").repartitionByRange(len(fits), "place")
    counts = sorted(grid["n_estimators"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place in (p for batch in batches for p in batch.column("place").to_pylist()):
            train, test = ((Bins(x), y) for x, y in data.value)
            if not len(train[1]) or not len(test[1]):
                continue
            *values, tried, depths = fits[place]
            setting = dict(zip(others, values, strict=True)) | {"max_features": tried, "max_depth": max(depths)}
            found = []
            for d, k, loss, importance in fit_depths(kind, setting, depths, train, test, counts):
                for m in capped[tried]:
                    own = setting | {"max_depth": d, "max_features": m}
                    found.append((k, *[own[n] for n in names], loss, *importance.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["n_estimators", *names, "loss", *features])

    return dealt.mapInArrow(run, schema)


def with_means(grid: DataFrame, features: list[str]) -> DataFrame:
    """The grid with a label, and two rows more: importances as means over all settings ('mean') and over the tenth of
    them with the least loss, one at least ('top_10pc_mean')."""
    settings = [c for c in grid.columns if c not in features and c != "loss"]
    # as many rows as the grid has settings
    ranked = grid.withColumn("_place", F.row_number().over(Window.orderBy("loss", *settings))).withColumn("_n", F.count("*").over(Window.partitionBy()))
    top = F.col("_place") <= F.floor(F.col("_n") * 0.1) + 1
    mean = lambda label, keep: ranked.filter(keep).agg(*[F.avg(f"`{f}`").alias(f) for f in features]).withColumn("label", F.lit(label))
    own = grid.withColumn("label", F.lit("setting"))
    return own.unionByName(mean("top_10pc_mean", top), allowMissingColumns=True).unionByName(mean("mean", F.lit(True)), allowMissingColumns=True)
