"""Supervised models and folds on DataFrames, by ``pyspark.ml``."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, Imputer, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Model kinds; boosted trees stand for the named boosting libraries.
CLASSIFIERS = {
    "logistic_l2": lambda **k: LogisticRegression(elasticNetParam=0.0, regParam=0.01, **k),
    "logistic_l1": lambda **k: LogisticRegression(elasticNetParam=1.0, regParam=0.01, **k),
    "logistic_elastic": lambda **k: LogisticRegression(elasticNetParam=0.5, regParam=0.01, **k),
    "forest": lambda **k: RandomForestClassifier(numTrees=20, maxDepth=4, seed=7, **k),
    "boosted": lambda **k: GBTClassifier(maxIter=10, maxDepth=3, seed=7, **k),
}
REGRESSORS = {
    "ols": lambda **k: LinearRegression(**k),
    "ridge": lambda **k: LinearRegression(elasticNetParam=0.0, regParam=0.1, **k),
    "elastic": lambda **k: LinearRegression(elasticNetParam=0.5, regParam=0.01, **k),
    "forest": lambda **k: RandomForestRegressor(numTrees=20, maxDepth=4, seed=7, **k),
    "boosted": lambda **k: GBTRegressor(maxIter=10, maxDepth=3, seed=7, **k),
}


def preprocessing(features: list[str], robust: bool = True) -> list:
    """Median imputation and scaling, to be fitted on training rows."""
    filled = [f"{c}__f" for c in features]
    scaler = RobustScaler(inputCol="__raw", outputCol="x", withCentering=True) if robust else StandardScaler(inputCol="__raw", outputCol="x", withMean=True)
    return [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="__raw"), scaler]


def fit(train: DataFrame, features: list[str], label: str, kind: str, task: str, weight: str | None = None):
    """A fitted pipeline of preprocessing and model; ``constant`` predicts the training mean."""
    if kind == "constant":
        return train.agg(F.avg(label)).first()[0]
    more = {"weightCol": weight} if weight else {}
    model = (CLASSIFIERS if task == "classification" else REGRESSORS)[kind](featuresCol="x", labelCol=label, **more)
    return Pipeline(stages=[*preprocessing(features), model]).fit(train)


def predict(model, rows: DataFrame, task: str, name: str = "p") -> DataFrame:
    if isinstance(model, float):
        return rows.withColumn(name, F.lit(model))
    out = model.transform(rows)
    value = vector_to_array("probability")[1] if task == "classification" else F.col("prediction")
    return out.select(*[F.col(c) for c in rows.columns], value.alias(name))


def calibrate(rows: DataFrame, p: str, y: str, method: str, min_rows: int = 20_000):
    """A fitted map of probabilities, or None where there is none to fit."""
    known = rows.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    if method == "none" or known.count() < min_rows:
        return None
    if method == "isotonic":
        stage = IsotonicRegression(featuresCol="__p", labelCol=y)
        return Pipeline(stages=[VectorAssembler(inputCols=[p], outputCol="__p"), stage]).fit(known)
    odds = known.withColumn("__o", F.ln(F.col(p) / (1 - F.col(p))))
    return Pipeline(stages=[VectorAssembler(inputCols=["__o"], outputCol="__p"), LogisticRegression(featuresCol="__p", labelCol=y)]).fit(odds)


def time_decay(age, half_life: float):
    """Row weight 2^(-age / half-life)."""
    return F.pow(F.lit(0.5), age / half_life)


def run_fold(df: DataFrame, index: str, fold: dict, features: list[str], label: str, kind: str, task: str) -> DataFrame:
    """Fit on a fold's training rows and score its evaluation rows."""
    train = df.where((F.col(index) >= fold["fit_start"]) & (F.col(index) < fold["fit_end"]) & F.col(label).isNotNull())
    rows = df.where((F.col(index) >= fold["eval_start"]) & (F.col(index) < fold["eval_end"]))
    return predict(fit(train, features, label, kind, task), rows, task).withColumn("fold", F.lit(fold["fold"]))


def kmeans_states(df: DataFrame, features: list[str], k: int, seed: int = 7) -> DataFrame:
    """States by k-means, numbered by the mean of the first feature."""
    m = Pipeline(stages=[*preprocessing(features, False), KMeans(k=k, seed=seed, featuresCol="x", predictionCol="__s")]).fit(df)
    centres = [c[0] for c in m.stages[-1].clusterCenters()]
    order = sorted(range(k), key=lambda j: centres[j])
    names = F.create_map(*[F.lit(v) for j in range(k) for v in (j, order.index(j))])
    return m.transform(df).select(*df.columns, names[F.col("__s")].alias("state"))


def mixture_states(df: DataFrame, features: list[str], k: int, seed: int = 7) -> DataFrame:
    """Posterior state probabilities of a full-covariance mixture."""
    m = Pipeline(stages=[*preprocessing(features, False), GaussianMixture(k=k, seed=seed, featuresCol="x", predictionCol="state", probabilityCol="__pr")]).fit(df)
    return m.transform(df).select(*df.columns, "state", vector_to_array("__pr").alias("posterior"))


def principal_components(train: DataFrame, rows: DataFrame, features: list[str], k: int) -> DataFrame:
    """Components fitted on training rows."""
    m = Pipeline(stages=[*preprocessing(features, False), PCA(k=k, inputCol="x", outputCol="__pc")]).fit(train)
    return m.transform(rows).select(*rows.columns, *[vector_to_array("__pc")[j].alias(f"pc_{j + 1}") for j in range(k)])


def leakage_check(df: DataFrame, features: list[str], target: str, most: float = 0.9) -> DataFrame:
    """Rank correlation of every feature with the target; one above ``most`` is suspect. Values are taken as doubles. All
    columns are ranked in one pass over long rows: a join a column would repeat the plan of ``df`` in each of them."""
    from tidemark.functions import scalar as S
    from tidemark.operators.ordering import counts_below

    cell = lambda c: F.struct(F.lit(c).alias("__col"), F.col(c).cast("double").alias("__x"))
    counts = df.select(F.explode(F.array(*map(cell, dict.fromkeys([*features, target])))).alias("s")).select("s.*").where("__x IS NOT NULL").groupBy("__col", "__x").agg(F.count("*").alias("__c"))
    score = (F.col("__below") + (F.col("__c") + 1) / 2.0 - 0.5) / F.col("__n")
    ranks = counts_below(counts, ["__col"], "__x", "__c").select("__col", "__x", score.alias("u"))
    pairs = df.select(F.col(target).cast("double").alias("y"), F.explode(F.array(*map(cell, features))).alias("s")).select("y", "s.*").where("y IS NOT NULL AND __x IS NOT NULL")
    ranked = pairs.join(ranks.withColumnRenamed("u", "u_f"), ["__col", "__x"])
    both = ranked.join(ranks.where(F.col("__col") == target).select(F.col("__x").alias("y"), F.col("u").alias("u_y")), "y")
    found = both.groupBy(F.col("__col").alias("feature")).agg(S.corr("u_f", "u_y").alias("rank_corr"))
    named = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, features))).alias("feature"))
    return named.join(found, "feature", "left").withColumn("suspect", F.abs("rank_corr") > most)


def stack(train: DataFrame, rows: DataFrame, constituents: list[str], label: str, task: str = "classification") -> DataFrame:
    """A meta-model on constituents' earlier out-of-sample predictions."""
    return predict(fit(train, constituents, label, "logistic_l2" if task == "classification" else "ridge", task), rows, task, "stacked")


def derive_target(raw, kind: str, spread=None, sigma=None, floor: float = 1e-12):
    """A target made of a raw outcome: as it is, its sign, beyond the spread, in units of volatility, or its log."""
    if kind == "raw":
        return raw
    if kind == "sign":
        return F.when(raw.isNotNull(), (raw > 0).cast("double"))
    if kind == "beyond_spread":
        return F.when(raw.isNotNull(), (F.abs(raw) > spread).cast("double"))
    if kind == "scaled":
        return F.try_divide(raw, sigma)
    if kind == "log":
        return F.when(raw.isNotNull(), F.ln(F.greatest(raw, F.lit(floor))))
    raise ValueError(f"no target {kind!r}")
