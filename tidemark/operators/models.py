"""Models on Spark ML: walk-forward scores, calibration, batch scoring."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clean import finite
from tidemark.operators import boosting
from tidemark.operators.crosssection import top_k
from tidemark.operators.evaluation import ndcg
from tidemark.operators.trees import ForestModel, extra_trees, lambda_mart


def prepare(features: Sequence[str]) -> list:
    filled = [f"_i_{f}" for f in features]
    return [Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]


def estimator(kind: str, target: str, weight: str | None, seed: int = 42, rounds: int = 150, step: float = 0.05, depth: int = 5, iterations: int = 1_000) -> Estimator:
    """logistic, boosted or pointwise (boosted regression on grades); ``trees`` and ``ranker`` are in :mod:`tidemark.operators.trees`.

    ``rounds``: boosting rounds of ``step``, ``depth`` deep; ``iterations``: of the logistic fit at most.
    """
    common = {"featuresCol": "features", "labelCol": target} | ({"weightCol": weight} if weight else {})
    if kind == "logistic":
        return LogisticRegression(maxIter=iterations, regParam=0.01, **common)
    if kind == "boosted":
        return GBTClassifier(maxIter=rounds, stepSize=step, maxDepth=depth, seed=seed, **common)
    if kind == "pointwise":
        return GBTRegressor(maxIter=rounds, stepSize=step, maxDepth=depth, seed=seed, **common)
    raise ValueError(f"unknown model kind {kind!r}")


def balanced_weight(df: DataFrame, target: str, weight: str, out: str = "class_weight") -> DataFrame:
    """Sample weight times n / (2 * class count)."""
    c = df.groupBy(target).agg(F.count(F.lit(1)).alias("_c"))
    n = c.agg(F.sum("_c").alias("_n"))
    c = c.join(F.broadcast(n)).select(target, (F.col("_n") / (2.0 * F.col("_c"))).alias("_w"))  # one-row aggregate
    return df.join(F.broadcast(c), target).withColumn(out, F.col(weight) * F.col("_w")).drop("_w")  # one row per class


def fit(df: DataFrame, features: Sequence[str], kind: str, target: str, weight: str | None = None, **options) -> PipelineModel | ForestModel:
    """Classifiers balance the two classes by the rows they are fit on, so no other row's label reaches a model."""
    if weight and kind != "pointwise":
        df, weight = balanced_weight(df, target, weight, "_balanced"), "_balanced"
    if kind == "trees":
        prepared = Pipeline(stages=prepare(features)).fit(df)
        rows = prepared.transform(df).select(vector_to_array("features").alias("_x"), F.col(target).alias("_y"), (F.col(weight) if weight else F.lit(1.0)).alias("_w"))
        return ForestModel(prepared, extra_trees(rows, "_x", "_y", "_w", **options))
    return Pipeline(stages=[*prepare(features), estimator(kind, target, weight, **options)]).fit(df)


def score(model: PipelineModel, df: DataFrame, required: Sequence[str], out: str = "probability_up") -> DataFrame:
    """Batch scores with a schema check; classifiers give the positive probability and a 0/1 call at 0.5."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"scoring frame lacks {', '.join(missing)}")
    s = model.transform(df)
    value = vector_to_array("probability")[1] if "probability" in s.columns else F.col("prediction")
    return s.withColumn("_v", value).select(*df.columns, F.col("_v").alias(out), (F.col("_v") >= 0.5).cast("int").alias("prediction"))


SCOPES = ("walk_forward", "ticker_holdout")
MISSING = -1e30  # below every cut of a ranker: a missing value goes left


def out_of_fold(rows: DataFrame, features: Sequence[str], kind: str, target: str, folds: Sequence[int], weight: str | None = None,
                holdout: str | None = None, group: str | None = None, ident: str | None = None, **options) -> DataFrame:
    """Scores of every fold's test rows, with ``audit_scope``: by a model of all purged training rows (walk_forward), and the test
    rows of the ``holdout`` flag once more by a model that never saw their tickers (ticker_holdout).

    ``rows`` carries fold and role (see splits.causal_rows); a handful of folds.  A ranker needs ``group`` and ``ident``; all its models are
    grown side by side, and so are boosted classifiers over few features.
    """
    scopes = SCOPES if holdout else SCOPES[:1]
    train, test = rows.where("role = 'train'"), rows.where("role = 'test'")
    seen = {SCOPES[0]: F.lit(True), SCOPES[1]: ~F.col(holdout) if holdout else F.lit(False)}
    judged = {SCOPES[0]: F.lit(True), SCOPES[1]: F.col(holdout) if holdout else F.lit(False)}
    if kind == "boosted" and boosting.fits(features):
        return _boosted(train, test, features, target, scopes, seen, judged, weight, options)
    if kind == "ranker":
        return _ranked(train, test, features, target, scopes, seen, judged, weight, group, ident, options)
    parts = []
    for k in folds:
        for scope in scopes:
            model = fit(train.where((F.col("fold") == k) & seen[scope]), features, kind, target, weight, **options)
            parts.append(score(model, test.where((F.col("fold") == k) & judged[scope]), features).withColumn("audit_scope", F.lit(scope)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _by_scope(df: DataFrame, which: dict, scopes: Sequence[str]) -> DataFrame:
    """The rows of every model, one below the other, with its name."""
    name = lambda scope: F.concat_ws("/", F.col("fold").cast("string"), F.lit(scope))
    parts = [df.where(which[s]).withColumns({"_model": name(s), "audit_scope": F.lit(s)}) for s in scopes]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _boosted(train, test, features, target, scopes, seen, judged, weight, options) -> DataFrame:
    made = boosting.boosted(_by_scope(train, seen, scopes), "_model", features, target, weight, **options)
    p = boosting.probability(train.sparkSession, made, F.col("_model"), [F.col(f) for f in features])
    asked = _by_scope(test, judged, scopes).withColumn("probability_up", p)
    return asked.withColumn("prediction", (F.col("probability_up") >= 0.5).cast("int")).drop("_model")


def _ranked(train, test, features, target, scopes, seen, judged, weight, group, ident, options) -> DataFrame:
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(MISSING)) for f in features])
    learn = _by_scope(train, seen, scopes).withColumn("_x", x)
    rankers = lambda_mart(learn.withColumn("_w", F.col(weight) if weight else F.lit(1.0)), "_model", group, ident, "_x", target, "_w", **options)
    asked = _by_scope(test, judged, scopes).withColumn("_x", x)
    sent = train.sparkSession.sparkContext.broadcast(rankers)  # rounds x nodes numbers a model

    def predict(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for model, values in frames:
            out = pd.Series(0.0, index=model.index)
            for m, at in model.groupby(model).groups.items():
                out[at] = sent.value[m].predict(np.stack(values[at].to_numpy()))
            yield out

    p = F.pandas_udf(predict, "double")("_model", "_x")
    return asked.withColumn("probability_up", p).withColumn("prediction", (F.col("probability_up") >= 0.5).cast("int")).drop("_model", "_x")


def final_fit(rows: DataFrame, features: Sequence[str], kind: str, target: str, weight: str | None, label_available: str, as_of: Column, **options):
    """The model to go live with: fit on all rows, of any fold, whose label was known at ``as_of``."""
    return fit(rows.where(F.col(target).isNotNull() & (F.col(label_available) <= as_of)), features, kind, target, weight, **options)


def ranking_metrics(scored: DataFrame, keys: Sequence[str], group: str, ident: str, opportunity: str, grade: str, ret: str, k: int) -> DataFrame:
    """Per ``keys``: rows, tickers (``ident``), groups of two rows or more, and over these the means of NDCG@k, of the top-k rows' mean
    ``ret`` and of their share above zero.  Rows without grade or score do not take part."""
    base = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(ident).alias("tickers"))
    valid = scored.where(F.col(grade).isNotNull() & F.col(opportunity).isNotNull())
    full = ndcg(valid, [*keys, group], opportunity, grade, k).where("rows >= 2").select(*keys, group, "ndcg")
    best = top_k(valid, [*keys, group], [F.desc(opportunity), F.col(ident)], k).groupBy(*keys, group).agg(
        F.avg(ret).alias("_ret"), F.avg((F.col(ret) > 0).cast("double")).alias("_up"))
    per_scope = full.join(best, [*keys, group]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("ranking_groups"), F.avg("ndcg").alias("mean_ndcg_at_k"), F.avg("_ret").alias("mean_top_k_excess_return"), F.avg("_up").alias("mean_top_k_positive_rate"))
    return base.join(per_scope, list(keys), "left")


def sigmoid(train: DataFrame, probability: str, target: str) -> PipelineModel:
    """Fit on the rows with a finite score and a target."""
    known = train.where(finite(probability).isNotNull() & F.col(target).isNotNull())
    return Pipeline(stages=[VectorAssembler(inputCols=[probability], outputCol="features", handleInvalid="keep"),
                            LogisticRegression(featuresCol="features", labelCol=target, probabilityCol="_pr", rawPredictionCol="_rw", predictionCol="_pd")]).fit(known)


def apply_sigmoid(model: PipelineModel, df: DataFrame, out: str = "calibrated") -> DataFrame:
    """Every row stays; without a score (null or NaN) there is no calibrated one."""
    return model.transform(df).withColumn(out, F.nanvl(vector_to_array("_pr")[1], F.lit(None).cast("double"))).drop("features", "_pr", "_rw", "_pd")
