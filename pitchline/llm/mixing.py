"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies.  Whole
copies are taken as they are; the fractions are rounded by pairs: mass moves
between two fractional documents, weighted by their sizes so that the source's
expected words stay the same, until one of them is integral.  A block of
documents leaves at most one fraction; the fractions of the blocks meet in a
reduction tree, and the last one of a source is rounded by a draw.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchline.llm.common import n_words, unused
from pitchline.session import cut

BLOCK, FAN_IN = 2048, 64
_EPS = 1e-12
_ROW = "doc_id long, lost boolean, _key long, _extra long, size long, rank int, block long, whole long, p double, open boolean"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(source, rank, docs, source_size, target)`` from ``(source, size)`` rows.

    Sources by code point, null last, take the weights in turn and share
    ``share`` times all words.  A target stops at ``cap`` times its source's
    words and the excess goes to the rest by weight until none is above: the
    level is found in one ordered pass over the per-source totals, by the
    order in which sources fill up.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(by_name) - 1)
    per = per.withColumn("w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("limit", F.col("source_size") * F.lit(float(cap))).withColumn("fills_at", F.col("limit") / F.col("w"))
    fill = Window.orderBy("fills_at", "rank")
    every = Window.orderBy("fills_at", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    # the first source that the level does not fill sets the level for all after it
    per = per.withColumn("at", F.min(F.when(F.col("level") < F.col("fills_at"), F.struct("fills_at", "rank", "level"))).over(every))
    full = F.col("at").isNull() | (F.struct("fills_at", "rank") < F.struct(F.col("at.fills_at"), F.col("at.rank")))
    return per.select("source", "rank", "docs", "source_size", F.when(full, F.col("limit")).otherwise(F.col("w") * F.col("at.level")).alias("target"))


def _round_block(p: np.ndarray, size: np.ndarray, draw, last: bool) -> np.ndarray:
    """Probabilities after pairing; at most one stays fractional, none if ``last``."""
    p, held = p.copy(), -1
    for i in range(len(p)):
        if size[i] == 0:
            p[i] = 0.0
        if not _EPS < p[i] < 1 - _EPS:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        ratio = size[i] / size[held]
        up, down = min(1 - p[i], p[held] / ratio), min(p[i], (1 - p[held]) / ratio)
        move = up if draw() * (up + down) < down else -down
        p[i] += move
        p[held] -= move * ratio
        for j in (held, i):
            if not _EPS < p[j] < 1 - _EPS:
                p[j] = round(p[j])
        held = held if 0 < p[held] < 1 else i if 0 < p[i] < 1 else -1
    if last and held >= 0:
        p[held] = float(draw() < p[held])
    return p


def _rounder(seed: int, last: bool, level: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_extra", "lost", "doc_id", "size", "whole", "_key"], kind="stable").reset_index(drop=True)
        draw = np.random.default_rng([seed, level, int(rows["rank"][0]), int(rows["block"][0])]).random
        p = _round_block(rows["p"].to_numpy(float), rows["size"].to_numpy(float), draw, last)
        rows["open"] = (p > 0) & (p < 1)
        rows["whole"] += np.where(rows["open"], 0, p).astype("int64")
        rows["p"] = np.where(rows["open"], p, 0.0)
        return rows

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)``, a row for each input row.

    ``taken`` is ``copies * size`` and copies never exceed ``cap`` rounded up
    to a whole number.  A source's taken words differ from its target by less
    than one document.  The draws depend on the seed, the source's rank and
    the block only, and blocks on the ids and the row count, so reruns agree.
    Null texts have size 0 and are never taken; a null source is a source;
    repeated ids are rounded as rows of their own; rows without an id are dealt
    by their text; no rows give no rows.
    """
    return _mixed(docs, id_col, source_col, text_col, weights, share, cap, seed, block).drop("_key")


def _row_key(text_col: str, source_col: str):
    """64 bits of a row's text and source, which tell apart rows that share an id or have none."""
    t, s = F.col(text_col), F.col(source_col)
    return F.xxhash64(t, t.isNull(), s, s.isNull())


def _mixed(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """The rows of ``mix`` with ``_key``, each row's key beside its id."""
    sizes = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), _row_key(text_col, source_col).alias("_key")))
    targets = cut(source_targets(sizes, weights, share, cap))
    most = targets.agg(F.max("docs")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    n_blocks = F.ceil(F.col("docs") / F.lit(block)).cast("long")
    rows = sizes.withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_n", F.col("source").isNull())
    key = targets.select(F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_n"), "rank", "docs", "source_size", "target")
    rows = rows.join(key, ["_s", "_n"]).withColumn("rate", rate).withColumn("_extra", F.xxhash64(F.coalesce("doc_id", "_key"), F.lit(seed)))
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("lost"), "_key", "_extra", "size", "rank", F.pmod("_extra", n_blocks).alias("block"), F.floor("rate").cast("long").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"), F.lit(True).alias("open"))
    levels = max(0, math.ceil(math.log(max(1, math.ceil(most / block)), FAN_IN) - 1e-9))
    done = []
    for level in range(levels + 1):
        last = level == levels
        after = cut(rows.groupBy("rank", "block").applyInPandas(_rounder(seed, last, level), _ROW))
        done.append(after.where(~F.col("open")))
        rows = after.where("open").withColumn("block", F.floor(F.col("block") / FAN_IN).cast("long"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    named = targets.select("rank", "source", "source_size", "target")
    return out.join(named, "rank").select(F.when(~F.col("lost"), F.col("doc_id")).alias("doc_id"), "_key", "source", "size", "source_size", "target", F.col("whole").alias("copies"), (F.col("whole") * F.col("size")).alias("taken"))


def resample(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (0, 1 or 2 times).

    Every row keeps its own count, also rows that share an id or have none:
    rows are matched by id, text and source, and rows equal in all three, which
    may stand for each other, by a number among them.
    """
    key, row, nth, times, copy = unused(docs, "_key", "_row", "_nth", "_copies", "_copy")
    counts = _mixed(docs, id_col, source_col, text_col, **kw).select(F.col("doc_id").alias("d"), F.col("_key").alias("t"), F.xxhash64("doc_id", "_key").alias("r"), F.col("copies").cast("int").alias("c"))
    counts = counts.withColumn("n", F.row_number().over(Window.partitionBy("r", "d", "t").orderBy(F.desc("c")))).where("c > 0")
    counts = counts.select(*(F.col(c).alias(f"_mix_{c}_{key}") for c in ("d", "t", "r", "n")), F.col("c").alias(times))
    d, t, r, n, _ = (F.col(c) for c in counts.columns)
    own = F.col(id_col).cast("long")
    rows = docs.withColumn(key, _row_key(text_col, source_col)).withColumn(row, F.xxhash64(own, F.col(key)))
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(row, own, key).orderBy(key)))
    out = rows.join(counts, (F.col(row) == r) & (F.col(nth) == n) & (F.col(key) == t) & own.eqNullSafe(d))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(F.col(f"`{c}`") for c in docs.columns))
