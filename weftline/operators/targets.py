"""Targets and features per person: gaps, activity, disengagement, neighbourhood sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph

DAY = 86_400


def seconds(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp")) / F.lit(1_000_000)


def gaps(inc: DataFrame, days: float) -> DataFrame:
    """(id, start, end, days): pauses of `days` whole days or more between a node's consecutive events."""
    before = Window.partitionBy("id").orderBy("time", "obs_id")
    rows = inc.select("id", F.lag("time").over(before).alias("start"), F.col("time").alias("end"))
    length = F.floor((seconds(F.col("end")) - seconds(F.col("start"))) / DAY)
    return rows.filter("start is not null").withColumn("days", length).filter(F.col("days") >= days)


def gap_ranges(inc: DataFrame, persons: DataFrame, days: float) -> DataFrame:
    """(id, gaps array<struct<start, end>>); persons without a pause keep an empty array."""
    rows = gaps(inc, days).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gaps"))
    none = F.array().cast("array<struct<start:timestamp_ntz,end:timestamp_ntz>>")
    return persons.select("id").join(rows, "id", "left").withColumn("gaps", F.coalesce("gaps", none))


def _by_year(rows: DataFrame, persons: DataFrame, years: range, value: Column, name: str) -> DataFrame:
    wide = rows.groupBy("id").pivot("year", list(years)).agg(value)
    return persons.select("id").join(wide, "id", "left").select("id", *[F.coalesce(F.col(str(y)), F.lit(0)).cast("long").alias(f"{name}{y}") for y in years])


def gaps_yearly(inc: DataFrame, persons: DataFrame, years: range, days: float) -> DataFrame:
    """Pauses by the year they start in, a column a year; other years count nowhere."""
    return _by_year(gaps(inc, days).withColumn("year", F.year("start")), persons, years, F.count("start"), "y")


def activity_yearly(inc: DataFrame, persons: DataFrame, years: range) -> DataFrame:
    """Edges at either end by year, a column a year. inc lists an edge once at each id (see `graph.incidence`), so rows are
    counted, not distinct edges."""
    return _by_year(inc.withColumn("year", F.year("time")), persons, years, F.count("obs_id"), "y")


def gaps_target(wide: DataFrame, year: int) -> DataFrame:
    """(id, target): pauses of the two following years."""
    return wide.select("id", (F.col(f"y{year + 1}") + F.col(f"y{year + 2}")).alias("target"))


def disengagement(wide: DataFrame, year: int) -> DataFrame:
    """(id, target): 1 - next / prev, with prev the mean of this and the next year and next that of the two years after
    this one; 0 where prev is 0 or next is greater."""
    prev = (F.col(f"y{year}") + F.col(f"y{year + 1}")) / 2
    after = (F.col(f"y{year + 1}") + F.col(f"y{year + 2}")) / 2
    return wide.select("id", F.when((prev == 0) | (after > prev), 0.0).otherwise(1 - after / prev).alias("target"))


def breach_total(sources: DataFrame, key: str, fusion: DataFrame | None = None) -> DataFrame:
    """(id, total): sum of an attribute over all rows of a person; persons without the attribute are left out. With fusion,
    (id_other, id_lowest), over all rows of the persons that are one."""
    if fusion is not None:
        one = fusion.select(F.col("id_other").alias("owner"), "id_lowest")
        sources = sources.join(one, "owner").withColumn("owner", F.col("id_lowest")).drop("id_lowest")
    has = sources.withColumn("_v", F.col("attrs")[key].cast("double")).filter("_v is not null")
    return has.groupBy(F.col("owner").alias("id")).agg(F.sum("_v").alias("total"))


def months(start: Column, end: Column) -> Column:
    """First days of the months from start to end."""
    return F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))


def activity_monthly(inc: DataFrame, persons: DataFrame, start: str, end: str) -> DataFrame:
    """(id, month, n): edges by month for every month of the span, 0 where there is none; month without leading zero."""
    spine = persons.select("id").distinct().withColumn("m", F.explode(months(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    counts = inc.groupBy("id", F.trunc("time", "MM").alias("m")).agg(F.count_distinct("obs_id").alias("n"))
    return spine.join(counts, ["id", "m"], "left").select("id", F.concat_ws("-", F.year("m"), F.month("m")).alias("month"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def top_monthly(inc: DataFrame, persons: DataFrame, top: int, start: str, end: str) -> DataFrame:
    """(id, month, n) of the `top` persons with the most edges; the smaller id of equals."""
    most = inc.join(persons.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(top)
    return activity_monthly(inc.join(most.select("id"), "id", "left_semi"), most, start, end)


def active_dates(inc: DataFrame) -> DataFrame:
    """(id, day): the days on which a node has an edge."""
    return inc.select("id", F.to_date("time").alias("day")).distinct()


def neighbour_sums(persons: DataFrame, inc: DataFrame, attrs: DataFrame, hops: tuple[int, ...] = (1, 2), t_min=None, t_max=None) -> DataFrame:
    """(id, hop, key, total): for each person and hop distance k, the sum over the entities within k hops, itself
    included. attrs: (id, key, value)."""
    # One traversal to the farthest: whoever is met at a hop is within that and all later ones.
    near = graph.neighbours(persons.select(F.col("id").alias("seed")), inc, max(hops), t_min, t_max, return_self=True, among=attrs)
    within = [(k, F.col("hop") <= k) for k in hops]
    sums = near.join(attrs, "id").groupBy(F.col("seed").alias("id"), "key").agg(*[F.sum(F.when(w, F.col("value"))).alias(f"_sum{k}") for k, w in within], *[F.count_if(w).alias(f"_n{k}") for k, w in within])
    rows = F.array(*[F.struct(F.lit(k).alias("hop"), F.col(f"_sum{k}").alias("total"), F.col(f"_n{k}").alias("n")) for k in hops])
    return sums.select("id", "key", F.explode(rows).alias("_row")).filter("_row.n > 0").select("id", "_row.hop", "key", "_row.total")


def neighbour_lists(persons: DataFrame, inc: DataFrame, scores: DataFrame, k: int = 2, t_min=None, t_max=None) -> DataFrame:
    """(id, [start, end,] scores array<double>): scores of the texts within k hops, rounded to 4 places, in ascending order;
    persons without a score are left out. persons: (id), or (id, start, end) for windows of their own."""
    windows = [c for c in ("start", "end") if c in persons.columns]
    near = graph.neighbours(persons.select(F.col("id").alias("seed"), *windows), inc, k, t_min, t_max, among=scores)
    got = near.join(scores, "id").groupBy(F.col("seed").alias("id"), *windows).agg(F.array_sort(F.collect_list(F.round("score", 4))).alias("scores"))
    return got


def ragged_features(inc: DataFrame, features: DataFrame) -> DataFrame:
    """(id, own array<double>, around array<array<double>>): log10(1 + x) of a node's features and of those of its
    neighbours, without itself, in order of their ids."""
    log = lambda c: F.transform(c, lambda x: F.log10(1 + x))
    pairs = inc.filter("id <> other_id").select("id", "other_id").distinct()
    other = features.select(F.col("id").alias("other_id"), log("vector").alias("v"))
    around = pairs.join(other, "other_id").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("other_id", "v"))), lambda x: x["v"]).alias("around"))
    return features.select("id", log("vector").alias("own")).join(around, "id", "left")


def sweep(persons: DataFrame, start: str, end: str, days: int) -> DataFrame:
    """(id, start, pivot, end): windows of `days` days one after another over the span, for every person."""
    at = F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.make_dt_interval(F.lit(days)))).alias("start")
    half, whole = F.make_dt_interval(F.lit(days // 2)), F.make_dt_interval(F.lit(days))
    return persons.select("id", at).select("id", "start", (F.col("start") + half).alias("pivot"), (F.col("start") + whole).alias("end"))


def window_samples(obs: DataFrame, windows: DataFrame, kind: str = "created") -> DataFrame:
    """(id, start, [more,] n_in, n_out, target, weight): a person's edges of a kind before and from the pivot of each of its windows.

    Samples need an edge before the pivot. target = min(0, (0.1 + out) / (0.1 + in) - 1), weight = 1 + in.
    windows: (id, start, pivot, end[, more]), half-open; what more they have (the number of a draw, say) tells windows apart.
    """
    more = [c for c in windows.columns if c not in ("id", "start", "pivot", "end")]
    mine = obs.filter(F.col("type") == kind).select(F.col("src_id").alias("id"), "time")
    # A person has few windows, whatever its edges, so windows are looked up and edges pass by without a sort.
    met = mine.join(windows.hint("shuffle_hash"), "id").filter(in_window())
    counted = met.groupBy("id", "start", *more).agg(F.count_if(F.col("time") < F.col("pivot")).alias("n_in"), F.count_if(F.col("time") >= F.col("pivot")).alias("n_out")).filter("n_in > 0")
    target = F.least(F.lit(0.0), (0.1 + F.col("n_out")) / (0.1 + F.col("n_in")) - 1)
    return counted.select("id", "start", *more, "n_in", "n_out", target.alias("target"), (1 + F.col("n_in")).alias("weight"))


def in_window() -> Column:
    return (F.col("time") >= F.col("start")) & (F.col("time") < F.col("end"))


def split(df: DataFrame, key: str, parts: dict[str, int], salt: int = 0) -> DataFrame:
    """df with a column `part`: a name drawn by a hash of the key, in proportion to its hundredths."""
    digest = F.md5(F.concat_ws(":", F.lit(str(salt)), F.col(key).cast("string")).cast("binary"))
    draw, low, part = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100, 0, F.lit(None).cast("string")
    for name, size in parts.items():
        part = F.when((draw >= low) & (draw < low + size), name).otherwise(part)
        low += size
    return df.withColumn("part", part)


def feature_matrix(sums: DataFrame, target: DataFrame, keys: list[str], hop: int = 2, train_percent: int = 80) -> DataFrame:
    """(id, a column a key, target, part): neighbourhood sums of a hop distance, wide, without rows that are all zero, with
    the target joined and scaled by the training rows' range. part: by a hash of the id."""
    from weftline.functions.numbers import min_max

    wide = sums.filter(F.col("hop") == hop).groupBy("id").pivot("key", keys).agg(F.sum("total"))
    wide = wide.select("id", *[F.coalesce(F.col(k), F.lit(0)).cast("double").alias(k) for k in keys])
    kept = wide.filter(F.exists(F.array(*keys), lambda x: x != 0)).join(target.select("id", "target"), "id")
    parts = split(kept, "id", {"train": train_percent, "test": 100 - train_percent})
    return min_max(parts, keys, parts.filter("part = 'train'"))


def score_against(lists: DataFrame, target: DataFrame, percent: float = 10, cap: float | None = None, log: bool = False, default: float | None = None) -> DataFrame:
    """(id, score, target): mean of the top percent of each person's scores beside a target, capped and as log10(1 + x) if
    asked. With a default, persons of the target without scores have it as theirs. lists: (id, scores)."""
    from weftline.functions.numbers import top_n_pct_mean

    y = F.col("target").cast("double")
    if cap is not None:
        y = F.least(y, F.lit(float(cap)))
    if log:
        y = F.log10(1 + y)
    score = top_n_pct_mean(F.col("scores"), percent)
    if default is not None:
        score = F.coalesce(score, F.lit(float(default)))
    return target.select("id", "target").join(lists, "id", "inner" if default is None else "left").select("id", score.alias("score"), y.alias("target"))


def work_stats(works: DataFrame, inc: DataFrame, values: DataFrame, hops: tuple[int, ...] = (1, 2), top_percent: float = 10) -> DataFrame:
    """(id, hop, n_texts, n_words, total, per_text, per_word, top): of the texts within k hops of a work, the counted terms
    per text and per word and the mean of the highest shares; null where there is no text. values: (id, terms, words)."""
    from weftline.functions.numbers import top_n_pct_mean

    near = graph.neighbours(works.select(F.col("id").alias("seed")), inc, max(hops), among=values).select("seed", "id", "hop")
    # One traversal: whoever is met at a hop is within that and all later ones.
    rows = near.join(values, "id").withColumn("share", F.col("terms") / F.expr("nullif(words, 0)"))
    rows = rows.withColumn("hop", F.explode(F.filter(F.array(*[F.lit(k) for k in hops]), lambda k: k >= F.col("hop"))))
    out = rows.groupBy(F.col("seed").alias("id"), "hop").agg(F.count("*").alias("n_texts"), F.sum("words").alias("n_words"), F.sum("terms").alias("total"), top_n_pct_mean(F.collect_list("share"), top_percent).alias("top"))
    return out.withColumn("per_text", F.col("total") / F.col("n_texts")).withColumn("per_word", F.col("total") / F.expr("nullif(n_words, 0)"))
