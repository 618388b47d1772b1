"""Who-faced-whom edges, degree centrality and bipartite PageRank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchline.session import bounded_tasks, cut, discard


def edges(facts: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    return facts.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"), F.sum(weight).alias("w"))


def degree_centrality(e: DataFrame, alpha: float = 0.5, side: str = "a", geometric: bool = False) -> DataFrame:
    """``<side>, degree, score``: own degree blended with the mean degree of opponents.

    ``geometric`` weighs the two as powers, which marks down few opponents more.
    """
    other = "b" if side == "a" else "a"
    of_other = e.groupBy(other).agg(F.count("*").alias("_deg"))
    rows = e.join(of_other, other).groupBy(side).agg(F.count("*").alias("degree"), F.avg("_deg").alias("_o"))
    blend = F.pow("degree", F.lit(1 - alpha)) * F.pow("_o", F.lit(alpha)) if geometric else (1 - alpha) * F.col("degree") + alpha * F.col("_o")
    return rows.select(side, "degree", blend.alias("score"))


def degree_snapshots(facts: DataFrame, a: str, b: str, period: Column) -> DataFrame:
    """``a, period, degree``: distinct opponents up to and including each period that brought a new one.

    An opponent counts from the first meeting on, so one aggregate finds what a
    prefix for every snapshot would count again.
    """
    first = facts.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.min(period).alias("period"))
    new = first.groupBy("a", "period").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("a").orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return new.select("a", "period", F.sum("_n").over(w).alias("degree"))


def _steps(e: DataFrame, start_a: float, start_b: float, base_a: float, base_b: float, damping: float, steps: int, normalize: bool, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Jacobi steps over edges ``a, b, wa, wb``: wa carries b's rank to a, wb a's to b.

    Both sides read the step before; a step writes one table of both sides,
    and what it replaces is deleted.
    """
    sides = lambda ra, rb: ra.select(F.lit(True).alias("left"), F.col("a").alias("v"), "r").unionByName(rb.select(F.lit(False).alias("left"), F.col("b").alias("v"), "r"))
    now = cut(sides(e.select("a").distinct().withColumn("r", F.lit(start_a)), e.select("b").distinct().withColumn("r", F.lit(start_b))))
    for _ in range(steps):
        of = lambda left, name: now.where("left" if left else "not left").select(F.col("v").alias(name), "r")
        ra = e.join(of(False, "b"), "b").groupBy("a").agg((F.lit(base_a) + damping * F.sum(F.col("wa") * F.col("r"))).alias("r"))
        rb = e.join(of(True, "a"), "a").groupBy("b").agg((F.lit(base_b) + damping * F.sum(F.col("wb") * F.col("r"))).alias("r"))
        after = sides(ra, rb)
        if normalize:
            raw = cut(after)
            total = dict(raw.groupBy("left").agg(F.sum("r")).collect())  # two rows
            after = cut(raw.withColumn("r", F.col("r") / F.when(F.col("left"), total.get(True, 1.0)).otherwise(total.get(False, 1.0))))
            discard(raw)
        else:
            after = cut(after)
        moved = None
        if tolerance > 0:
            moved = after.join(now.withColumnRenamed("r", "_was"), ["left", "v"]).agg(F.max(F.abs(F.col("r") - F.col("_was")))).first()[0]
        discard(now)
        now = after
        if moved is not None and moved < tolerance:
            break
    return now.where("left").select(F.col("v").alias("a"), F.col("r").alias("rank")), now.where("not left").select(F.col("v").alias("b"), F.col("r").alias("rank"))


def pagerank(e: DataFrame, steps: int, damping: float = 0.85) -> DataFrame:
    """``a, rank`` after a fixed number of steps over the bipartite edges ``a, b, n``: a node gives its rank in shares of n."""
    of_a, of_b = e.groupBy("a").agg(F.sum("n").alias("ta")), e.groupBy("b").agg(F.sum("n").alias("tb"))
    weighted = cut(e.join(of_a, "a").join(of_b, "b").select("a", "b", (F.col("n") / F.col("tb")).alias("wa"), (F.col("n") / F.col("ta")).alias("wb")))
    na, nb = weighted.agg(F.countDistinct("a"), F.countDistinct("b")).first()
    ranked, _ = _steps(weighted, 1 / max(na, 1), 1 / max(nb, 1), (1 - damping) / max(na, 1), (1 - damping) / max(nb, 1), damping, steps, False, 0.0)
    return ranked


def performance_pagerank(e: DataFrame, damping: float = 0.85, steps: int = 100, tolerance: float = 1e-6, wicket_weight: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Ranks of both sides of edges ``a, b, n, performance, wickets``: (``a, rank``), (``b, rank``).

    A batter's rank is the mean rank of the bowlers faced, by balls, of which
    0.3 is weighed by performance (0 to 1); a bowler's the mean rank of the
    batters, 0.3 of it weighed by economy and wickets a ball.  Each side sums
    to 1 after every step; steps end when no rank moves by ``tolerance``.
    """
    of_a, of_b = e.groupBy("a").agg(F.sum("n").alias("ta")), e.groupBy("b").agg(F.sum("n").alias("tb"))
    wa = F.try_divide(F.col("n") * (0.7 + 0.3 * (0.5 + F.col("performance"))), F.col("ta"))
    wb = F.try_divide(F.col("n") * (0.7 + 0.3 * (1.5 - F.col("performance") + wicket_weight * F.coalesce("wickets", F.lit(0.0)))), F.col("tb"))
    weighted = cut(e.join(of_a, "a").join(of_b, "b").select("a", "b", wa.alias("wa"), wb.alias("wb")))
    na, nb = weighted.agg(F.countDistinct("a"), F.countDistinct("b")).first()
    return _steps(weighted, 1 / max(na, 1), 1 / max(nb, 1), (1 - damping) / max(na, 1), (1 - damping) / max(nb, 1), damping, steps, True, tolerance)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that an edge names.

    ``component`` is the smallest node reachable.  Each round turns every
    node's neighbourhood into a star around its smallest member, first over
    the larger neighbours, then over the smaller ones; stars are stable, and
    O(log^2 n) rounds reach them.  Minima are aggregated before the join back,
    so that a hub with many neighbours is combined on the map side and the
    join can be split.  Tasks are bounded by rows: more edges are more tasks,
    not larger ones.  Loops, repeated and reversed edges are harmless; edges
    with a null end are ignored; an empty table gives no rows.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    spark = edges.sparkSession
    with bounded_tasks(spark):
        now = cut(edges.where("_a is not null and _b is not null and u > v").select("u", "v"))  # the first round drops what repeats
    seen = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        with bounded_tasks(spark, 2 * state[0]):
            after = cut(small.select("e.u", "e.v").where("u > v").distinct())
        discard(now)
        now = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    with bounded_tasks(spark, state[0]):
        out = cut(stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    discard(now)
    return out
