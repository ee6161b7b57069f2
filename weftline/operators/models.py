"""Regressions, baselines, tree grids and a text scorer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import HashingTF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_part(key: Column, trial: Column, parts: int = 10) -> Column:
    """0 .. parts - 1 by the front of an MD5 of trial and key: the same in every engine."""
    digest = F.md5(F.concat_ws(":", trial.cast("string"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % parts


def ols_trials(df: DataFrame, key: str, x: str, y: str, trials: int, test_parts: int = 2) -> DataFrame:
    """(trial, n_train, slope, intercept, r2_train, r2_test, corr): least squares of y on x over random splits, all trials in
    one job. Every row goes to every trial; sums of a trial are aggregated before the shuffle."""
    rows = df.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null")
    each = rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("test", hash_part(F.col(key), F.col("trial")) < test_parts)
    side = lambda c, test: F.when(F.col("test") == F.lit(test), c)
    sums = each.groupBy("trial").agg(
        F.count(side(F.lit(1), False)).alias("n_train"), F.regr_slope(side(F.col("y"), False), side(F.col("x"), False)).alias("slope"), F.regr_intercept(side(F.col("y"), False), side(F.col("x"), False)).alias("intercept"),
        F.regr_r2(side(F.col("y"), False), side(F.col("x"), False)).alias("r2_train"), F.corr(side(F.col("x"), False), side(F.col("y"), False)).alias("corr"), F.count(side(F.lit(1), True)).alias("m"),
        *[F.sum(side(e, True)).alias(n) for n, e in {"sx": F.col("x"), "sy": F.col("y"), "sxx": F.col("x") * F.col("x"), "sxy": F.col("x") * F.col("y"), "syy": F.col("y") * F.col("y")}.items()],
    )
    # 1 - SSE / SST on the held-out side, with the line of the other side.
    sse = F.expr("syy - 2 * slope * sxy - 2 * intercept * sy + slope * slope * sxx + 2 * slope * intercept * sx + m * intercept * intercept")
    return sums.select("trial", "n_train", "slope", "intercept", "r2_train", (1 - sse / F.expr("nullif(syy - sy * sy / m, 0)")).alias("r2_test"), "corr")


def naive_baseline(df: DataFrame, y: str, loss: str = "L1", weight: str | None = None) -> DataFrame:
    """(constant, loss): the best constant prediction, the lower median for L1 and the (weighted) mean for L2."""
    w = F.col(weight) if weight else F.lit(1.0)
    if loss == "L1":
        best = df.agg(F.percentile_disc(0.5, F.col(y)).alias("constant")) if hasattr(F, "percentile_disc") else df.agg(F.expr(f"percentile_disc(0.5) within group (order by {y})").alias("constant"))
        error = F.abs(F.col(y) - F.col("constant"))
    else:
        best = df.agg((F.sum(F.col(y) * w) / F.sum(w)).alias("constant"))
        error = (F.col(y) - F.col("constant")) ** 2
    return df.join(F.broadcast(best)).groupBy("constant").agg((F.sum(error * w) / F.sum(w)).alias("loss"))


def improvement(loss: Column, naive: Column) -> Column:
    """Percent by which a loss beats the naive one."""
    return 100 * (naive - loss) / naive


def tree_grid(df: DataFrame, features: list[str], y: str, kind: str = "gbt", grid: list[dict] | None = None, part: str = "part") -> DataFrame:
    """(config, loss, feature, importance): trees for each setting of the grid, fitted on part = 'train', with the absolute
    loss on part = 'test'. A driver loop over settings; each fit is a distributed job."""
    spark = df.sparkSession
    ready = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df.withColumn(y, F.col(y).cast("double"))).select("features", y, part).persist()
    train, test = ready.filter(F.col(part) == "train"), ready.filter(F.col(part) == "test")
    measure = RegressionEvaluator(labelCol=y, metricName="mae")
    rows = []
    for setting in grid or [{}]:
        base = {"labelCol": y, "featuresCol": "features", "seed": 0}
        model = (GBTRegressor(lossType="absolute", **base, **setting) if kind == "gbt" else RandomForestRegressor(**base, **setting)).fit(train)
        loss = float(measure.evaluate(model.transform(test)))
        rows += [(str(sorted(setting.items())), loss, f, float(v)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)]
    ready.unpersist()
    return spark.createDataFrame(rows, "config string, loss double, feature string, importance double").orderBy("loss", "config", "feature")


def train_scorer(texts: DataFrame, label: str = "toxic", buckets: int = 1 << 14) -> Callable[[DataFrame], DataFrame]:
    """A scorer of texts: word hashes and logistic regression, fitted on rows (text, label)."""
    cut = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\W+")
    tf = HashingTF(inputCol="_words", outputCol="features", numFeatures=buckets, binary=True)
    prepare = lambda df: tf.transform(cut.transform(df.withColumn("_text", F.coalesce("text", F.lit("")))))
    model = LogisticRegression(featuresCol="features", labelCol=label, maxIter=20, regParam=1e-3).fit(prepare(texts.filter(F.col(label).isNotNull())))

    def score(df: DataFrame) -> DataFrame:
        """df with p_toxic."""
        out = model.transform(prepare(df)).withColumn("p_toxic", vector_to_array("probability")[1])
        return out.select(*df.columns, "p_toxic")

    return score


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(x, y).alias("corr"), F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"))
