"""Outcome models: grouped folds, out-of-fold scores, expected values and ablation."""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchline.session import bounded_tasks


def fold_of(group: Column, folds: int, seed: int = 0) -> Column:
    """The fold of a row: all rows of a group share it, whatever the partitions."""
    return F.pmod(F.xxhash64(F.lit(seed), group), F.lit(folds)).cast("int")


def fit(df: DataFrame, features: list[str], label: str, rounds: int = 20) -> PipelineModel:
    """A multinomial model of an integer label from numeric features; rows with a null feature are skipped."""
    stages = [
        VectorAssembler(inputCols=features, outputCol="_features_raw", handleInvalid="skip"),
        StandardScaler(inputCol="_features_raw", outputCol="_features", withMean=True),
        LogisticRegression(featuresCol="_features", labelCol=label, family="multinomial", maxIter=rounds, regParam=1e-4, probabilityCol="_p"),
    ]
    return Pipeline(stages=stages).fit(df.select(*features, F.col(label).cast("double").alias(label)).where(F.col(label).isNotNull()))


def score(model: PipelineModel, df: DataFrame, name: str = "p") -> DataFrame:
    """``df`` with ``name``, the array of class probabilities."""
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("_p").alias(name))


def out_of_fold(df: DataFrame, group: str, features: list[str], label: str, folds: int, rounds: int = 20, name: str = "p") -> DataFrame:
    """Each row scored by the model that has not seen its group.

    ``folds`` fits over the whole frame; each row is scored once, under a
    filter on its fold.
    """
    placed = df.withColumn("fold", fold_of(F.col(group), folds))
    parts = [score(fit(placed.where(F.col("fold") != k), features, label, rounds), placed.where(F.col("fold") == k), name) for k in range(folds)]
    return reduce(DataFrame.unionByName, parts)


def expected_value(p: str, worth: list[float]) -> Column:
    """Mean worth of the classes under the probabilities ``p``."""
    terms = F.zip_with(p, F.array(*(F.lit(float(w)) for w in worth)), lambda a, b: a * b)
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def metrics(scored: DataFrame, label: str, by: list[str], p: str = "p") -> DataFrame:
    """``n, accuracy, log_loss, brier`` for each value of ``by`` in one pass."""
    truth = F.get(p, F.col(label).cast("int"))
    hit = F.array_position(p, F.array_max(p)) - 1 == F.col(label)
    squares = F.aggregate(F.transform(p, lambda x, i: F.pow(x - (i == F.col(label)).cast("double"), F.lit(2))), F.lit(0.0), lambda a, x: a + x)
    return scored.groupBy(*by).agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("accuracy"), F.avg(-F.ln(F.greatest(truth, F.lit(1e-15)))).alias("log_loss"), F.avg(squares).alias("brier"))


def ablation(model: PipelineModel, df: DataFrame, parts: dict[str, list[str]], worth: list[float]) -> DataFrame:
    """``df`` with ``value`` and, for each named part, what the value loses when its features are zero."""
    keys = df.columns
    out = score(model, df).select(*keys, expected_value("p", worth).alias("value"))
    for part, columns in parts.items():
        # the features ride along under another name while the model reads zeros
        held = out.select(*out.columns, *(F.col(c).alias(f"_held_{c}") for c in columns)).withColumns({c: F.lit(0.0) for c in columns})
        gone = score(model, held).withColumn(part, F.col("value") - expected_value("p", worth))
        out = gone.select(*(F.col(f"_held_{c}").alias(c) if c in columns else F.col(c) for c in out.columns), part)
    return out


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def fit_boosted(df: DataFrame, features: list[str], label: str, classes: int, rounds: int = 10, depth: int = 4, step: float = 0.2, seed: int = 7) -> list[PipelineModel]:
    """Boosted trees for ``classes`` integer labels: one model of each class against the rest.

    Rows with a null feature or label are skipped.  The fit holds its rows in
    memory and reads them anew for each tree, so it takes them in small parts.
    """
    rows = df.select(*features, F.col(label).alias("_y")).where(F.col("_y").isNotNull())
    gather = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip")
    trees = lambda k: GBTClassifier(featuresCol="_features", labelCol=f"_is_{k}", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed).setProbabilityCol("_p").setRawPredictionCol("_raw").setPredictionCol("_said")
    with bounded_tasks(df.sparkSession):
        return [Pipeline(stages=[gather, trees(k)]).fit(rows.withColumn(f"_is_{k}", (F.col("_y") == k).cast("double"))) for k in range(classes)]


def score_boosted(models: list[PipelineModel], df: DataFrame, name: str = "p") -> DataFrame:
    """``df`` with ``name``, the class probabilities: each model's own, scaled to sum to 1."""
    out = df
    for k, m in enumerate(models):
        out = m.transform(out).select(*out.columns, F.get(vector_to_array("_p"), 1).alias(f"_class_{k}"))
    every = [F.col(f"_class_{k}") for k in range(len(models))]
    total = sum(every[1:], every[0])
    return out.select(*df.columns, F.array(*(c / total for c in every)).alias(name))


def stacked(df: DataFrame, group: str, features: list[str], margin_class: str, label: str, folds: int, rounds: int = 20) -> DataFrame:
    """Two layers: out-of-fold scores of ``margin_class`` become features of the model of ``label``, scored out of fold again."""
    first = out_of_fold(df, group, features, margin_class, folds, rounds, "_margin").drop("fold")
    classes = F.array_size("_margin")
    first = first.withColumn("margin_expected", F.aggregate(F.transform("_margin", lambda p, i: p * i), F.lit(0.0), lambda a, x: a + x) / F.greatest(classes - 1, F.lit(1)))
    return out_of_fold(first.drop("_margin"), group, [*features, "margin_expected"], label, folds, rounds)


def random_search(space: dict[str, tuple[float, float]], loss: Callable[[dict[str, float]], float], tries: int, seed: int = 7) -> tuple[dict[str, float], float]:
    """The best of ``tries`` settings drawn evenly from ``space`` (name: low, high); ``loss`` runs on the cluster."""
    draw = random.Random(seed)
    tried = [{k: draw.uniform(*span) for k, span in sorted(space.items())} for _ in range(tries)]
    return min(((s, loss(s)) for s in tried), key=lambda x: x[1])


def nelder_mead(loss: Callable[[list[float]], float], start: list[float], size: float = 0.1, steps: int = 60, tolerance: float = 1e-6) -> tuple[list[float], float]:
    """Downhill simplex from ``start``; each call of ``loss`` is a job over all rows, so few are made."""
    points = [list(start)] + [[x + (size * (abs(x) or 1.0) if i == j else 0.0) for j, x in enumerate(start)] for i in range(len(start))]
    held = sorted(((loss(p), p) for p in points), key=lambda x: x[0])
    for _ in range(steps):
        if held[-1][0] - held[0][0] < tolerance:
            break
        middle = [sum(p[j] for _, p in held[:-1]) / len(start) for j in range(len(start))]
        along = lambda t: [m + t * (m - w) for m, w in zip(middle, held[-1][1])]  # noqa: E731, B023
        mirrored = (loss(along(1.0)), along(1.0))
        if mirrored[0] < held[0][0]:
            far = (loss(along(2.0)), along(2.0))
            held[-1] = min(mirrored, far, key=lambda x: x[0])
        elif mirrored[0] < held[-2][0]:
            held[-1] = mirrored
        else:
            near = (loss(along(-0.5)), along(-0.5))
            if near[0] < held[-1][0]:
                held[-1] = near
            else:
                best = held[0][1]
                held = [held[0], *((loss(q), q) for q in ([(a + b) / 2 for a, b in zip(p, best)] for _, p in held[1:]))]
        held.sort(key=lambda x: x[0])
    return held[0][1], held[0][0]


def best_setting(df: DataFrame, segment: str, grid: DataFrame, loss: Column) -> DataFrame:
    """For each ``segment`` the row of ``grid`` with the least mean of ``loss`` over the segment's rows, and that mean.

    ``grid`` is a table of settings, small by nature and sent to every task;
    ``loss`` reads columns of both.  Ties go to the setting that orders first.
    """
    each = df.join(F.broadcast(grid), F.lit(True)).groupBy(segment, *grid.columns).agg(F.avg(loss).alias("loss"))
    best = F.min(F.struct(F.round("loss", 9).alias("l"), *grid.columns)).alias("b")
    return each.groupBy(segment).agg(best).select(segment, *(F.col(f"b.{c}").alias(c) for c in grid.columns), F.col("b.l").alias("loss"))
