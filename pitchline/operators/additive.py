"""Additive models: a smooth curve of each column and an effect of each venue.

A curve is a sum of cubic splines on even knots, held smooth by a penalty on
second differences.  A pass over the rows leaves weighted normal equations by
fold, summed in the tasks, and one vector for each venue and fold; the venues'
effects are eliminated from these (so the system that the driver solves has
the size of the curves, whatever the venues), and the penalties are chosen by
cross-validation on the same sums, without another pass over the rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchline.session import cut, discard, spread

#: Sums of so many venues and folds a task holds before it gives them out.
HELD = 1 << 17

#: Smoothing penalties tried where the caller names none.
PENALTIES = tuple(10.0**i for i in range(-3, 6))


@dataclass(frozen=True)
class Curve:
    """A column, its range, in how many parts it is cut, the splines' weights and their means over the rows."""

    column: str
    low: float
    high: float
    parts: int
    weights: list[float]
    means: list[float]
    penalty: float


@dataclass(frozen=True)
class Additive:
    """A fitted model; ``effects`` has ``venue, effect, weight`` and is a table, as venues may be many."""

    curves: list[Curve]
    level: float
    logistic: bool
    effects: DataFrame


def _basis(x: np.ndarray, low: float, high: float, parts: int) -> np.ndarray:
    """The ``parts`` + 3 splines at each value; values outside the range count as its ends, missing ones have none."""
    known = ~np.isnan(x)
    t = np.clip((np.where(known, x, low) - low) / (high - low or 1.0), 0, 1) * parts
    j = np.minimum(np.floor(t).astype(int), parts - 1)
    u, out = t - j, np.zeros((len(x), parts + 3))
    for i, w in enumerate(((1 - u) ** 3, 3 * u**3 - 6 * u**2 + 4, -3 * u**3 + 3 * u**2 + 3 * u + 1, u**3)):
        out[np.arange(len(x)), j + i] = w / 6
    return out * known[:, None]


def curve_value(c: Curve) -> Column:
    """What the curve adds at a row, 0 on average; 0 where the column is null or not a number."""
    mean = float(np.dot(c.weights, c.means))

    @F.pandas_udf("double")
    def value(x: pd.Series) -> pd.Series:
        x = x.to_numpy(dtype=float)
        return pd.Series(np.where(np.isnan(x), 0.0, _basis(x, c.low, c.high, c.parts) @ np.asarray(c.weights) - mean))

    return value(F.col(c.column).cast("double"))


def _total(parts: DataFrame, by: list[str]) -> DataFrame:
    """Arrays ``s`` added place by place: ``by, at, s``."""
    return parts.select(*by, F.posexplode("s").alias("at", "x")).groupBy(*by, "at").agg(F.sum("x").alias("s"))


def _arrays(total: DataFrame, key: str, size: int) -> dict[int, np.ndarray]:
    out: dict[int, np.ndarray] = {}
    for k, at, s in total.select(key, "at", "s").toPandas().itertuples(index=False):
        out.setdefault(int(k), np.zeros(size))[at] = s
    return out


def _solve(m: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Weights from augmented normal equations; directions that no row tells apart stay 0."""
    return np.linalg.lstsq(m[:-1, :-1] + penalty, m[:-1, -1], rcond=1e-11)[0]


def fit_additive(df: DataFrame, columns: dict[str, int], label: str, venue: str | None = None, logistic: bool = False, group: str | None = None, folds: int = 4, shrink: float = 10.0, penalties: tuple[float, ...] = PENALTIES, steps: int = 25, tolerance: float = 1e-7) -> Additive:
    """A curve of each of ``columns`` (name: parts) and an effect of each ``venue`` for a number, or a chance if ``logistic``.

    Rows without a label are skipped; a missing column adds nothing, null
    venues are a venue, one that was not seen has no effect.  ``shrink`` draws
    a venue's effect to 0 as so many rows would.  Rows of a ``group`` share a
    fold (none: equal rows do).  Penalties are chosen together first, then
    curve by curve, by the error on rows left out; a tie goes to the smoother.
    Logistic models take reweighted steps, each with penalties of its own, at
    most ``steps``, until the weights move by less than ``tolerance``.
    """
    names = list(columns)
    numbers = F.array(*(F.col(c).cast("double") for c in names))
    place = F.col(venue).cast("string") if venue else F.lit(None).cast("string")
    fold = F.pmod(F.xxhash64(F.col(group) if group else F.struct(numbers, F.col(label))), F.lit(folds)).cast("int")
    rows = df.where(F.col(label).isNotNull()).select(numbers.alias("_x"), F.col(label).cast("double").alias("_y"), place.alias("_v"), fold.alias("_k"))
    held = cut(spread(rows))
    at = lambda j: F.nanvl(F.get("_x", j), F.lit(None).cast("double"))
    span = held.agg(*(f(at(j)).alias(f"{n}{j}") for j in range(len(names)) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    spans = [(span[f"lo{j}"] or 0.0, span[f"hi{j}"] or 0.0, columns[c]) for j, c in enumerate(names)]
    ends = np.cumsum([1] + [p + 3 for *_, p in spans])
    size = int(ends[-1]) + 1  # level, splines, label

    def raw(b: pa.RecordBatch) -> list[np.ndarray]:
        x = b.column("_x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(spans))
        return [_basis(x[:, j], *s) for j, s in enumerate(spans)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size)
        for b in batches:
            if b.num_rows:
                sums[1:-1] += np.concatenate([r.sum(axis=0) for r in raw(b)])
        yield pa.RecordBatch.from_pydict({"k": pa.array([0], pa.int32()), "s": [sums.tolist()]})

    sums = _arrays(_total(held.mapInArrow(counted, "k int, s array<double>"), ["k"]), "k", size).get(0, np.zeros(size))
    # the splines of a row add up to 1, so their sum over a curve is its number of rows
    means = [sums[a:b] / (sums[a:b].sum() or 1.0) for a, b in zip(ends, ends[1:])]

    def bend(strength: list[float]) -> np.ndarray:
        out = np.zeros((size - 1, size - 1))
        for (a, b), p in zip(zip(ends, ends[1:]), strength):
            d = np.diff(np.eye(b - a), 2, axis=0)
            out[a:b, a:b] = p * d.T @ d
        return out

    def equations(beta: np.ndarray | None, effects: DataFrame | None) -> DataFrame:
        """``venue, fold, s``: sums of a venue; with fold + ``folds``, the matrix of a fold."""

        def given(place: dict[str | None, int], sums: np.ndarray) -> pa.RecordBatch:
            kept = np.flatnonzero(sums[: len(place) * folds].any(axis=1))
            values = pa.array(sums[kept].ravel())
            lists = pa.ListArray.from_arrays(np.arange(len(kept) + 1, dtype=np.int32) * size, values)
            return pa.RecordBatch.from_arrays([pa.array(list(place), pa.string()).take(pa.array(kept // folds)), pa.array(kept % folds, pa.int32()), lists], names=["venue", "fold", "s"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = np.zeros((folds, size, size))
            place, sums = {}, np.zeros((0, size))  # of each venue its number, and a row for each of its folds
            for b in batches:
                if not b.num_rows:
                    continue
                y, k = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_k"))
                a = np.concatenate([np.ones((len(y), 1)), *((r - m) * (r.sum(axis=1, keepdims=True) > 0.5) for r, m in zip(raw(b), means)), y[:, None]], axis=1)
                w = np.ones(len(y))
                if logistic:
                    e = np.log((y + 0.5) / (1.5 - y)) if beta is None else a[:, :-1] @ beta + b.column("_e").to_numpy(zero_copy_only=False)
                    p = 1 / (1 + np.exp(-np.clip(e, -30, 30)))
                    w = np.maximum(p * (1 - p), 1e-9)
                    a[:, -1] = e + (y - p) / w
                for f in range(folds):
                    mine = k == f
                    whole[f] += a[mine].T @ (a[mine] * w[mine, None])
                v = b.column("_v").dictionary_encode(null_encoding="encode")
                number = np.array([place.setdefault(x, len(place)) for x in v.dictionary.to_pylist()])
                if len(place) * folds > len(sums):
                    sums = np.concatenate([sums, np.zeros((max(len(place) * folds, 2 * len(sums)) - len(sums), size))])
                code = number[v.indices.to_numpy(zero_copy_only=False)] * folds + k
                order = np.argsort(code, kind="stable")
                first = np.flatnonzero(np.diff(code[order], prepend=-1))
                sums[code[order][first]] += np.add.reduceat((a * w[:, None])[order], first, axis=0)
                if len(place) * folds > HELD:
                    yield given(place, sums)
                    place, sums = {}, np.zeros((0, size))
            if place:
                yield given(place, sums)
            yield pa.RecordBatch.from_pydict({"venue": pa.array([None] * folds, pa.string()), "fold": pa.array(range(folds, 2 * folds), pa.int32()), "s": whole.reshape(folds, -1).tolist()})

        rows = held if effects is None else held.join(effects.select(F.col("venue").alias("_j"), F.col("effect").alias("_e")), F.col("_v").eqNullSafe(F.col("_j")), "left").withColumn("_e", F.coalesce("_e", F.lit(0.0)))
        return cut(rows.mapInArrow(run, "venue string, fold int, s array<double>"))

    def by_venue(parts: DataFrame) -> DataFrame:
        """``venue, every, f0, f1, ...``: the sums of a venue, whole and by fold."""
        of = lambda where: F.array(*(F.coalesce(F.sum(F.when(where, F.get("s", i))), F.lit(0.0)) for i in range(size)))
        each = parts.where(F.col("fold") < folds).groupBy("venue", "fold").agg(of(F.lit(True)).alias("s"))
        return cut(each.groupBy("venue").agg(F.collect_list(F.struct("fold", "s")).alias("folds")))  # a place for each fold

    def apart(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Sums of each venue: whole, and by fold."""
        each = np.zeros((len(b), folds, size))
        for i, parts in enumerate(b["folds"]):
            for f in parts:
                each[i, f["fold"]] = f["s"]
        return each.sum(axis=1), each

    def eliminated(venues: DataFrame) -> dict[int, np.ndarray]:
        """What the venues' effects take from the equations: of all rows (``folds``), and with each fold left out."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((folds + 1, size, size))
            for b in batches:
                every, each = apart(b)
                for f in range(folds + 1):
                    s = every - each[:, f] if f < folds else every
                    out[f] += s.T @ (s / (s[:, :1] + shrink))
            yield pd.DataFrame({"fold": range(folds + 1), "s": out.reshape(folds + 1, -1).tolist()})

        return {f: m.reshape(size, size) for f, m in _arrays(_total(venues.mapInPandas(run, "fold int, s array<double>"), ["fold"]), "fold", size * size).items()}

    def errors(venues: DataFrame | None, tried: dict[tuple[int, int], np.ndarray], whole: dict[int, np.ndarray]) -> np.ndarray:
        """The squared error of each candidate on the rows left out, effects of their venues included."""
        out = np.zeros(1 + max(c for c, _ in tried))
        for (c, f), beta in tried.items():
            z = np.append(-beta, 1.0)
            out[c] += z @ whole[f] @ z
        if venues is not None:

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                part = np.zeros(len(out))
                for b in batches:
                    every, each = apart(b)
                    for (c, f), beta in tried.items():
                        z, s = np.append(-beta, 1.0), every - each[:, f]
                        effect = (s @ z) / (s[:, 0] + shrink)
                        part[c] += (effect**2 * each[:, f, 0] - 2 * effect * (each[:, f] @ z)).sum()
                yield pd.DataFrame({"k": [0], "s": [part.tolist()]})

            out += _arrays(_total(venues.mapInPandas(run, "k int, s array<double>"), ["k"]), "k", len(out)).get(0, 0.0)
        return out

    beta, strength, effects = None, [max(penalties)] * len(names), None
    for _ in range(steps if logistic else 1):
        parts = equations(beta, effects)
        whole = {f - folds: m.reshape(size, size) for f, m in _arrays(_total(parts.where(F.col("fold") >= folds), ["fold"]), "fold", size * size).items()}
        whole = {f: whole.get(f, np.zeros((size, size))) for f in range(folds)}
        every = sum(whole.values())
        venues = by_venue(parts) if venue else None
        taken = eliminated(venues) if venue else {}
        less = lambda f: taken.get(f, 0.0)  # noqa: B023, E731
        candidates = sorted(penalties, reverse=True)

        def best(options: list[list[float]], whole=whole, every=every, venues=venues, less=less) -> list[float]:
            if len(options) == 1:
                return options[0]
            tried = {(c, f): _solve(every - whole[f] - less(f), bend(o)) for c, o in enumerate(options) for f in range(folds)}
            return options[int(np.argmin(np.round(errors(venues, tried, whole), 9)))]

        strength = best([[p] * len(names) for p in candidates])
        for j in range(len(names) if len(names) > 1 else 0):
            strength = best([strength[:j] + [p] + strength[j + 1 :] for p in candidates])
        before, beta = beta, _solve(every - less(folds), bend(strength))
        old = effects
        if venue:
            z = F.array(*(F.lit(float(x)) for x in (*-beta, 1.0)))
            total = F.aggregate("folds", F.array_repeat(F.lit(0.0), size), lambda acc, x: F.zip_with(acc, x["s"], lambda a, b: a + b))
            found = venues.select("venue", total.alias("_s"))
            effects = cut(found.select("venue", (F.aggregate(F.zip_with("_s", z, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x) / (F.get("_s", 0) + shrink)).alias("effect"), F.get("_s", 0).alias("weight")))
            discard(venues)
        discard(parts)
        if old is not None:
            discard(old)
        if before is not None and np.abs(beta - before).max() < tolerance:
            break
    discard(held)
    if effects is None:
        effects = df.sparkSession.createDataFrame([], "venue string, effect double, weight double")
    curves = [Curve(c, float(lo), float(hi), p, beta[a:b].tolist(), m.tolist(), s) for c, (lo, hi, p), a, b, m, s in zip(names, spans, ends, ends[1:], means, strength)]
    return Additive(curves, float(beta[0]), logistic, effects)


def score_additive(model: Additive, df: DataFrame, venue: str | None = None, name: str = "expected") -> DataFrame:
    """``df`` with ``name``, the expected value or chance; a row whose ``venue`` was not seen counts as an average one."""
    value = sum((curve_value(c) for c in model.curves), F.lit(model.level))
    if venue:
        effects = model.effects.select(F.col("venue").alias("_venue"), F.col("effect").alias("_effect"))
        df = df.withColumns({"_value": value}).join(effects, F.col(venue).cast("string").eqNullSafe(F.col("_venue")), "left")
        value = F.col("_value") + F.coalesce("_effect", F.lit(0.0))
    return df.withColumn(name, 1 / (1 + F.exp(-value)) if model.logistic else value).drop("_value", "_venue", "_effect")


def save_additive(model: Additive, spark: SparkSession, path: str) -> None:
    text = json.dumps({"curves": [asdict(c) for c in model.curves], "level": model.level, "logistic": model.logistic})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")
    model.effects.write.mode("overwrite").parquet(f"{path}/effects")


def load_additive(spark: SparkSession, path: str) -> Additive:
    held = json.loads(spark.read.option("wholetext", "true").text(f"{path}/model").first()[0])
    return Additive([Curve(**c) for c in held["curves"]], held["level"], held["logistic"], spark.read.parquet(f"{path}/effects"))
