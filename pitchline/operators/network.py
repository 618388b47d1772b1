"""Standing in the network of meetings: ranks by component, snapshots with opponents' degrees, and what ratings take from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchline.operators.graph import connected_components
from pitchline.session import cut

# The step's factor at low and high percentiles, its middle and steepness; points of rating a percentile.
FACTOR_LEAST, FACTOR_MOST, FACTOR_MIDDLE, FACTOR_STEEPNESS = 0.5, 1.5, 50.0, 0.08
POINTS = 6.0


def step_factor(percentile: Column) -> Column:
    """What a rating's step is multiplied with, by the opponent's percentile; 1 where it is not known."""
    factor = FACTOR_LEAST + (FACTOR_MOST - FACTOR_LEAST) / (1 + F.exp(-FACTOR_STEEPNESS * (percentile - FACTOR_MIDDLE)))
    return F.coalesce(factor, F.lit(1.0))


def implied_rating(percentile: Column, start: float = 1400.0) -> Column:
    """The rating that a percentile stands for: where newcomers of a league with that mean start, and what ratings are drawn to."""
    implied = start + (F.greatest(F.lit(0.0), F.least(F.lit(100.0), percentile)) - 50) * POINTS
    return F.when(percentile.isNull(), F.lit(float(start))).otherwise(implied)


def components(e: DataFrame) -> DataFrame:
    """``side, v, component, size`` of both sides of the edges ``a, b``; a name on one side is not the same name on the other."""
    named = e.select(F.concat(F.lit("a"), F.col("a").cast("string")).alias("a"), F.concat(F.lit("b"), F.col("b").cast("string")).alias("b"))
    found = connected_components(named)
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    return found.join(sizes, "component").select(F.substring("node", 1, 1).alias("side"), F.expr("substring(node, 2)").alias("v"), "component", "size")


def rank_by_component(ranks: DataFrame, e: DataFrame, side: str = "a", exponent: float = 0.5) -> DataFrame:
    """``<side>, rank, size, normalized`` of ``ranks`` (``<side>, rank``): the rank times (size of the component /
    largest size) ^ ``exponent``, so that a small island's champions do not rank with those of the main field."""
    placed = cut(components(e))
    most = placed.agg(F.max("size").alias("_most"))  # one row
    mine = placed.where(F.col("side") == side).select(F.col("v").alias("_v"), "size").crossJoin(F.broadcast(most))
    rows = ranks.join(mine, F.col(side).cast("string") == F.col("_v"))
    return rows.select(side, "rank", "size", (F.col("rank") * F.pow(F.col("size") / F.col("_most"), F.lit(exponent))).alias("normalized"))


def league_standing(members: DataFrame, league: str, entity: str, percentiles: DataFrame, least: int = 10) -> DataFrame:
    """``league, members, standing``: the mean percentile of the distinct entities of each league with ``least`` of them or more.

    ``percentiles`` is ``entity, pct``; members without one count for none.
    """
    known = members.select(league, entity).distinct().join(percentiles, entity)
    return known.groupBy(league).agg(F.count("*").alias("members"), F.avg("pct").alias("standing")).where(F.col("members") >= least)


def neighbour_snapshots(facts: DataFrame, a: str, b: str, period: Column, alpha: float = 0.8) -> DataFrame:
    """``a, period, degree, opponents_degree, score`` after each period that changed one of them.

    ``degree`` counts the distinct opponents met so far, ``opponents_degree``
    is the mean of how many each of them has met so far, and ``score`` blends
    the two by ``alpha``.  A meeting brings its opponent's degree of that
    period, and later growth of an opponent comes along its first meetings as
    a change: sums of changes replace a recount for each snapshot.  What is
    shuffled is a row for each meeting with its opponent's later changes in two
    arrays, not a row for each of them; they are laid out where they are summed.
    """
    first = cut(facts.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.min(period).alias("t")).where("t is not null"))
    # periods by number, which is short: they are few, as many as there are changes of one opponent at most
    periods = first.select("t").distinct().agg(F.array_sort(F.collect_list("t")).alias("_periods"))
    numbers = periods.select(F.posexplode("_periods").alias("_at", "t"))
    first = first.join(F.broadcast(numbers), "t").select("a", "b", "_at")
    grown = first.groupBy("b", F.col("_at").alias("_g")).agg(F.count("*").cast("int").alias("_by")).groupBy("b").agg(F.array_sort(F.collect_list(F.struct("_g", "_by"))).alias("_x"))
    grown = grown.select("b", F.col("_x._g").alias("_g"), F.col("_x._by").alias("_by"))
    # at its meeting an opponent has its degree so far, and each later change comes alone
    k = F.array_position("_g", F.col("_at")).cast("int")
    along = first.join(grown, "b").withColumn("_k", k)
    upto = F.aggregate(F.slice("_by", 1, F.col("_k")), F.lit(0), lambda x, y: x + y)
    along = along.select("a", "_at", F.slice("_g", F.col("_k"), F.size("_g")).alias("_g"), F.concat(F.array(upto), F.slice("_by", F.col("_k") + 1, F.size("_by"))).alias("_by"))
    along = along.repartition("a").select("a", "_at", F.explode(F.arrays_zip("_g", "_by")).alias("x"))
    along = along.groupBy("a", F.col("x._g").alias("_g")).agg(F.sum("x._by").alias("_s"), F.sum((F.col("x._g") == F.col("_at")).cast("long")).alias("_n"))
    along = along.join(F.broadcast(numbers.select(F.col("_at").alias("_g"), F.col("t").alias("period"))), "_g")
    w = Window.partitionBy("a").orderBy("_g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = along.select("a", "period", F.sum("_n").over(w).alias("degree"), (F.sum("_s").over(w) / F.sum("_n").over(w)).alias("opponents_degree"))
    return out.withColumn("score", (1 - alpha) * F.col("degree") + alpha * F.col("opponents_degree"))
