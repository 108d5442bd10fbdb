"""Models on Spark ML: components by explained variance, forests of stumps, importances, logistic regression, stump entropy, grids."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def components(train: DataFrame, features: Sequence[str], explained: float = 0.95) -> tuple[PipelineModel, int]:
    """A fitted pipeline from features to `pca`: standard scores, and the fewest components that explain so much of the variance."""
    scaled = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True)]).fit(train)
    ready = scaled.transform(train)
    all_ = PCA(k=len(features), inputCol="_scaled", outputCol="pca").fit(ready)
    k = int(np.searchsorted(np.cumsum(all_.explainedVariance.toArray()), min(explained, 1 - 1e-9)) + 1)
    k = min(k, len(features))
    return PipelineModel(stages=[*scaled.stages, PCA(k=k, inputCol="_scaled", outputCol="pca").fit(ready)]), k


def forest(train: DataFrame, features: Sequence[str], label: str = "y", weight: str | None = "wt", trees: int = 500, leaf: float = 0.3, seed: int = 1, depth: int = 1) -> PipelineModel:
    """A forest of stumps, one feature each, with leaves of at least that share of the rows."""
    least = max(1, math.ceil(leaf * train.count()))
    model = RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=least, featureSubsetStrategy="1", seed=seed)
    if weight:
        model = model.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), model]).fit(train)


def impurity_importance(model: PipelineModel, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """feature -> mean and error of its importance over the trees that use it, the means summing to 1."""
    per = np.stack([t.featureImportances.toArray() for t in model.stages[-1].trees])
    per = np.where(per == 0, np.nan, per)
    used = ~np.isnan(per).all(axis=0)
    mean = np.array([np.nanmean(per[:, j]) if used[j] else 0.0 for j in range(per.shape[1])])
    error = np.array([np.nanstd(per[:, j], ddof=1) / math.sqrt(len(per)) if used[j] and np.isfinite(per[:, j]).sum() > 1 else 0.0 for j in range(per.shape[1])])
    total = mean.sum() or 1.0
    return {f: (float(m / total), float(e / total)) for f, m, e in zip(features, mean, error)}


def used_features(model: PipelineModel, features: Sequence[str]) -> list[str]:
    """The features a second fit is to use: those that some tree splits on."""
    return [f for f, (m, _) in impurity_importance(model, features).items() if m > 0]


def boosted(train: DataFrame, features: Sequence[str], label: str = "y", weight: str | None = "wt", rounds: int = 20, depth: int = 3, rate: float = 0.3, seed: int = 1) -> PipelineModel:
    """Gradient-boosted trees on all features."""
    model = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed)
    if weight:
        model = model.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), model]).fit(train)


def gain_importance(model: PipelineModel, features: Sequence[str]) -> dict[str, float]:
    """feature -> its share of the gain of all splits of a boosted model's trees, each tree counted by its weight; largest first."""
    gains = model.stages[-1].featureImportances.toArray()
    return dict(sorted(zip(features, map(float, gains)), key=lambda x: (-x[1], x[0])))


class PurgedCrossValidator(CrossValidator):
    """Spark ML's cross-validation, grid, parallelism and all, on folds with purged training sets: fold k is tested on the rows whose `fold` is k and trained on those whose `trains` holds k (folds.fold_columns). Rows are not repeated by fold."""

    def _kFold(self, dataset: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
        return [(dataset.where(F.array_contains("trains", k)), dataset.where(F.col("fold") == k)) for k in range(self.getNumFolds())]


def purged_scores(rows: DataFrame, features: Sequence[str], cs: Sequence[float], folds: int, label: str = "y", weight: str = "wt", metric: str = "logLoss", parallelism: int = 4) -> tuple[CrossValidatorModel, list[tuple[float, float, float]]]:
    """rows(features, label, weight, fold, trains) -> the fitted validator, and (c, mean, deviation of the score over folds) for every regularisation of logistic regressions: the grid and folds are fitted side by side. Log loss comes with a minus sign."""
    total = float(rows.agg(F.sum(weight)).first()[0] or 1.0)
    ready = VectorAssembler(inputCols=list(features), outputCol="_x").transform(rows)
    model = LogisticRegression(featuresCol="_x", labelCol=label, weightCol=weight, standardization=False)
    grid = [{model.regParam: 1.0 / (c * total)} for c in cs]
    score = MulticlassClassificationEvaluator(labelCol=label, metricName=metric, weightCol=weight)
    cv = PurgedCrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=score, numFolds=folds, parallelism=parallelism)
    fitted = cv.fit(ready)
    sign = -1.0 if metric == "logLoss" else 1.0
    return fitted, [(float(c), sign * m, s) for c, m, s in zip(cs, fitted.avgMetrics, fitted.stdMetrics)]


def logistic(train: DataFrame, features: Sequence[str], label: str = "y", weight: str | None = "wt", c: float = 1.0) -> PipelineModel:
    """L2 logistic regression with regularisation 1 / (c * sum of weights), features as they are."""
    total = train.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0] or 1.0
    model = LogisticRegression(featuresCol="_x", labelCol=label, regParam=1.0 / (c * float(total)), standardization=False)
    if weight:
        model = model.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), model]).fit(train)


def probabilities(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with p, the probability of label 1."""
    out = model.transform(df).withColumn("p", vector_to_array("probability")[1])
    return out.select(*df.columns, "p")


def cross_score(folds: DataFrame, fit: Callable[[DataFrame], PipelineModel], label: str = "y", weight: str | None = "wt", metric: str = "logLoss", folds_col: str = "fold", role: str = "role") -> dict[int, float]:
    """fold -> score on its test rows of a model fitted on its train rows. folds has a row for each (fold, row, role): few folds, so the driver loops over them."""
    out = {}
    for fold in sorted(r[0] for r in folds.select(folds_col).distinct().collect()):
        part = folds.where(F.col(folds_col) == fold)
        scored = fit(part.where(F.col(role) == "train")).transform(part.where(F.col(role) == "test"))
        e = MulticlassClassificationEvaluator(labelCol=label, metricName=metric)
        score = (e.setWeightCol(weight) if weight else e).evaluate(scored)
        out[int(fold)] = -score if metric == "logLoss" else score
    return out


def permuted(df: DataFrame, feature: str, seed: int = 1, blocks: int = 64) -> DataFrame:
    """df with the feature's values dealt anew among the rows of each of `blocks` hashed blocks, so no task orders all rows."""
    row = F.to_json(F.struct(*df.columns))  # hashes of the row, not random numbers, so that both sides of the join agree after a lost task
    h = lambda k: F.xxhash64(row, F.lit(seed * 3 + k))
    b = df.withColumn("_b", F.pmod(h(0), F.lit(blocks))).withColumn("_r", h(1)).withColumn("_q", h(2))
    b = b.withColumn("_k", F.row_number().over(Window.partitionBy("_b").orderBy("_r", *df.columns)))
    other = b.select("_b", F.row_number().over(Window.partitionBy("_b").orderBy("_q", *df.columns)).alias("_k"), F.col(feature).alias("_v"))
    return b.drop(feature).join(other, ["_b", "_k"]).withColumnRenamed("_v", feature).select(*df.columns)


def permutation_importance(train: DataFrame, test: DataFrame, fit: Callable[[DataFrame], PipelineModel], features: Sequence[str], label: str = "y", weight: str | None = "wt", seed: int = 1) -> dict[str, float]:
    """feature -> how much of the log loss on test rows is lost when it is permuted: (permuted - plain) / permuted."""
    model = fit(train)
    e = MulticlassClassificationEvaluator(labelCol=label, metricName="logLoss")
    e = e.setWeightCol(weight) if weight else e
    plain = e.evaluate(model.transform(test))
    return {f: 1 - plain / e.evaluate(model.transform(permuted(test, f, seed))) for f in features}


def single_importance(train: DataFrame, test: DataFrame, fit: Callable[[DataFrame, list[str]], PipelineModel], features: Sequence[str], label: str = "y", metric: str = "accuracy") -> dict[str, float]:
    """feature -> score on test rows of a model of that feature alone."""
    e = MulticlassClassificationEvaluator(labelCol=label, metricName=metric)
    return {f: e.evaluate(fit(train, [f]).transform(test)) for f in features}


def entropy_decrease(df: DataFrame, feature: str, label: str = "y", weight: str | None = "wt", depth: int = 1, leaf: float = 0.1) -> float:
    """The decrease of entropy, summed over the nodes of a tree of one feature, each weighted within its own node."""
    ready = VectorAssembler(inputCols=[feature], outputCol="_x").transform(df)
    t = DecisionTreeClassifier(featuresCol="_x", labelCol=label, impurity="entropy", maxDepth=depth, minInstancesPerNode=max(1, math.ceil(leaf * df.count())))
    model = (t.setWeightCol(weight) if weight else t).fit(ready)

    def walk(node) -> float:
        if node.numDescendants() == 0:
            return 0.0
        return float(node.gain()) + walk(node.leftChild()) + walk(node.rightChild())

    return walk(model._call_java("rootNode"))


def best_of_grid(results: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """The row of the highest score for each key: grids are keys of one plan, so no parameter is a job of its own."""
    return results.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in results.columns if c not in keys]), F.col(score)).alias("_best")).select(*keys, "_best.*")
