"""Boosted trees of several classes, fitted together.

One round adds a tree for each class along the softmax gradient.  Rows are
binned once; a level of all classes' trees is one pass over the rows, in which
each task sums gradients into a histogram by class, node, feature and bin, and
one aggregate over these cells.  Where many rows have the same bins and class
they are one row with their number, which changes no sum.  What reaches the driver is the histogram: its
size is classes x nodes x features x bins, whatever the rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from pitchline.session import cut, discard, spread

#: Gradients are summed as integers of this unit: exact, so that a task that runs again changes nothing.
UNIT = 2.0**-20


@dataclass(frozen=True)
class Softmax:
    """A fitted model.  A tree is a heap of nodes: the feature asked (-1: all go left), the last bin that
    goes left and whether missing values do; ``leaf`` holds what a row that ends there adds to its class."""

    features: list[str]
    edges: list[list[float]]
    prior: list[float]
    rounds: list[dict[str, list]]

    def first(self, rounds: int) -> Softmax:
        """The model as it was after so many rounds."""
        return Softmax(self.features, self.edges, self.prior, self.rounds[:rounds])


def _bins(columns: list[np.ndarray], edges: list[list[float]]) -> np.ndarray:
    """Bin numbers, a row for each row: 0 is missing, else one more than the edges below the value."""
    out = np.empty((len(columns[0]), len(edges)), dtype=np.int16)
    for j, (x, e) in enumerate(zip(columns, edges)):
        out[:, j] = np.where(np.isnan(x), 0, 1 + np.searchsorted(np.asarray(e, dtype=float), x))
    return out


def _walk(tree: dict[str, list], bins: np.ndarray, levels: int) -> np.ndarray:
    """For each row and class the node of level ``levels`` that the row comes to, from 0."""
    feature, upto, missing = (np.asarray(tree[c]) for c in ("feature", "upto", "missing"))
    rows, classes = len(bins), len(feature)
    at, k, r = np.zeros((rows, classes), dtype=np.int64), np.arange(classes), np.arange(rows)[:, None]
    for level in range(levels):
        node = at + (2**level - 1)
        f = feature[k, node]
        b = bins[r, np.maximum(f, 0)]
        left = (f < 0) | np.where(b == 0, missing[k, node] == 1, b <= upto[k, node])
        at = 2 * at + ~left
    return at


def _shares(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _read(batch: pa.RecordBatch, column: str, width: int, kind) -> np.ndarray:
    """An array column, all of the same length, as a matrix."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())


def _added(tree: dict[str, list], bins: np.ndarray, depth: int) -> np.ndarray:
    leaf = np.asarray(tree["leaf"])
    return leaf[np.arange(len(leaf)), _walk(tree, bins, depth)]


def _histogram(rows: DataFrame, tree: dict[str, list], level: int, classes: int, features: int, bins: int) -> np.ndarray:
    """Sums of gradients and of their slopes: class, node of the level, feature, bin."""
    nodes = 2**level
    shape = (classes, nodes, features, bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, h = np.zeros(shape), np.zeros(shape)
        for b in batches:
            x = _read(b, "_b", features, np.int64)
            p = _shares(_read(b, "_f", classes, float))
            at = _walk(tree, x, level)
            n = b.column("_n").to_numpy(zero_copy_only=False)[:, None]
            slope = n * np.rint(2 * p * (1 - p) / UNIT)
            p[np.arange(len(p)), b.column("_y").to_numpy(zero_copy_only=False)] -= 1
            grad = n * np.rint(p / UNIT)
            for k in range(classes):
                for f in range(features):
                    cell = at[:, k] * bins + x[:, f]
                    g[k, :, f] += np.bincount(cell, grad[:, k], nodes * bins).reshape(nodes, bins)
                    h[k, :, f] += np.bincount(cell, slope[:, k], nodes * bins).reshape(nodes, bins)
        held = np.flatnonzero((g != 0) | (h != 0))
        yield pa.RecordBatch.from_pydict({"cell": held, "g": g.ravel()[held].astype(np.int64), "h": h.ravel()[held].astype(np.int64)})

    sums = rows.mapInArrow(run, "cell long, g long, h long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
    out = np.zeros((2, math.prod(shape)))
    cells = sums["cell"].to_numpy(dtype=np.int64)
    out[0, cells], out[1, cells] = sums["g"] * UNIT, sums["h"] * UNIT
    return out.reshape(2, *shape)


def _split(sums: np.ndarray, penalty: float, least: float) -> tuple[np.ndarray, ...]:
    """Of each class and node the best feature, last bin to the left and side of missing values, and both halves' sums."""
    missing, known = sums[..., :1], sums[..., 1:].cumsum(axis=-1)
    every = known[..., -1:] + missing
    left = np.stack([known, known + missing], axis=4)  # missing values go right, then left; the last cut has all known ones
    right = every[..., None] - left
    worth = lambda s: s[0] ** 2 / (s[1] + penalty)
    gain = worth(left) + worth(right) - worth(every[..., None])
    gain = np.where((left[1] >= least) & (right[1] >= least), gain, -1.0)
    classes, nodes, _, _, bins = gain.shape
    flat = gain.reshape(classes, nodes, -1)
    best = flat.argmax(axis=-1)
    good = np.take_along_axis(flat, best[..., None], -1)[..., 0] > 1e-9
    halves = [np.take_along_axis(s.reshape(2, classes, nodes, -1), best[None, ..., None], -1)[..., 0] for s in (left, right)]
    whole = every[:, :, :, 0, 0]
    halves = [np.where(good, halves[0], whole), np.where(good, halves[1], 0.0)]
    feature, rest = np.divmod(best, 2 * bins)
    return np.where(good, feature, -1), rest % bins + 1, rest // bins, halves


def fit_softmax(df: DataFrame, features: list[str], label: str, classes: int, rounds: int = 50, depth: int = 4, step: float = 0.15, bins: int = 32, penalty: float = 1.0, least: float = 1.0, edges: list[list[float]] | None = None) -> Softmax:
    """Trees for the integer labels 0 to ``classes`` - 1, all classes of a round together.

    A row without a label is skipped; a missing feature (null or NaN) goes to
    the side of a split that fits better.  ``least`` is the least sum of slopes
    of a node, ``penalty`` draws leaves to 0.  ``edges`` are the cuts of each
    feature, approximate quantiles where none are given; with given ones the
    model does not depend on how rows are dealt.  Equal gains go to the first
    feature and cut.  Classes that no row has keep a share near 0.  A round
    takes ``depth`` passes and one that writes the rows' new scores.
    """
    if not 1 < bins < 2**15:
        raise ValueError("bins: 2 to 32767")
    rows = df.select(F.array(*(F.col(c).cast("double") for c in features)).alias("_x"), F.col(label).cast("int").alias("_y")).where(F.col("_y").between(0, classes - 1))
    raw = cut(spread(rows))
    if edges is None:
        numbers = raw.select(*(F.get("_x", j).alias(f"x{j}") for j in range(len(features))))
        edges = numbers.approxQuantile(numbers.columns, [i / bins for i in range(1, bins)], 1 / (8 * bins))
    edges = [sorted(set(e)) for e in edges]
    counts = {r["_y"]: r["n"] for r in raw.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = [math.log(max(counts.get(k, 0), 1e-3) / max(total, 1)) for k in range(classes)]
    width = max((len(e) for e in edges), default=0) + 2
    kinds = pa.schema([("_y", pa.int32()), ("_b", pa.list_(pa.int16())), ("_n", pa.int64()), ("_f", pa.list_(pa.float64()))])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _bins(list(_read(b, "_x", len(edges), float).T), edges)
            yield pa.RecordBatch.from_arrays([b.column("_y"), _lists(x)], names=["_y", "_b"])

    schema = "_y int, _b array<short>, _n long, _f array<double>"
    placed = cut(raw.mapInArrow(binned, "_y int, _b array<short>"))
    discard(raw)
    if total and placed.agg(F.approx_count_distinct(F.xxhash64("_y", "_b"))).first()[0] < total / 2:
        counted = spread(placed.groupBy("_y", "_b").agg(F.count("*").alias("_n")))
    else:
        counted = placed.withColumn("_n", F.lit(1).cast("long"))
    held, trees = cut(counted.withColumn("_f", F.array(*(F.lit(p) for p in prior)))), []
    discard(placed)
    for _ in range(rounds if total else 0):
        inner = 2**depth - 1
        tree = {"feature": np.full((classes, inner), -1), "upto": np.zeros((classes, inner), dtype=int), "missing": np.zeros((classes, inner), dtype=int)}
        for level in range(depth):
            feature, upto, missing, halves = _split(_histogram(held, tree, level, classes, len(features), width), penalty, least)
            here = slice(2**level - 1, 2 ** (level + 1) - 1)
            tree["feature"][:, here], tree["upto"][:, here], tree["missing"][:, here] = feature, upto, missing
        sums = np.stack(halves, axis=-1).reshape(2, classes, -1)  # left and right of each node in turn
        tree["leaf"] = -step * sums[0] / (sums[1] + penalty)
        tree = {c: v.tolist() for c, v in tree.items()}
        trees.append(tree)

        def moved(batches: Iterator[pa.RecordBatch], tree=tree) -> Iterator[pa.RecordBatch]:
            for b in batches:
                scores = _read(b, "_f", classes, float) + _added(tree, _read(b, "_b", len(edges), np.int64), depth)
                yield pa.RecordBatch.from_arrays([b.column("_y"), b.column("_b"), b.column("_n"), _lists(scores)], schema=kinds)

        if len(trees) < rounds:
            before, held = held, cut(held.mapInArrow(moved, schema))
            discard(before)
    discard(held)
    return Softmax(list(features), edges, prior, trees)


def _scores(model: Softmax, columns: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The rows' scores before the first round and after each."""
    bins = _bins(columns, model.edges).astype(np.int64)
    at = np.tile(np.asarray(model.prior), (len(bins), 1))
    yield at
    for tree in model.rounds:
        at = at + _added(tree, bins, len(tree["leaf"][0]).bit_length() - 1)
        yield at


def score_softmax(model: Softmax, df: DataFrame, name: str = "p") -> DataFrame:
    """``df`` with ``name``, the array of class probabilities; every row gets one, whatever features it lacks."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def p(x: pd.DataFrame) -> pd.Series:
        for at in _scores(model, [x[c].to_numpy(dtype=float) for c in x.columns]):
            last = at
        return pd.Series(list(_shares(last)))

    return df.withColumn(name, p(F.struct(*(F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(model.features)))))


def round_losses(model: Softmax, df: DataFrame, label: str) -> DataFrame:
    """``round, n, log_loss`` on labelled rows after each number of rounds: one pass shows where to stop."""
    classes = len(model.prior)
    rows = df.select(*(F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(model.features)), F.col(label).cast("int").alias("_y")).where(F.col("_y").between(0, classes - 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, loss = 0, np.zeros(len(model.rounds) + 1)
        for b in batches:
            y, n = b["_y"].to_numpy(), n + len(b)
            for i, at in enumerate(_scores(model, [b[f"x{j}"].to_numpy(dtype=float) for j in range(len(model.features))])):
                loss[i] -= np.log(np.maximum(_shares(at)[np.arange(len(y)), y], 1e-15)).sum()
        yield pd.DataFrame({"round": range(len(loss)), "n": n, "loss": loss})

    return rows.mapInPandas(run, "round int, n long, loss double").groupBy("round").agg(F.sum("n").alias("n"), F.try_divide(F.sum("loss"), F.sum("n")).alias("log_loss"))


def save_softmax(model: Softmax, spark: SparkSession, path: str) -> None:
    spark.createDataFrame([(json.dumps(asdict(model)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_softmax(spark: SparkSession, path: str) -> Softmax:
    return Softmax(**json.loads(spark.read.option("wholetext", "true").text(path).first()[0]))
