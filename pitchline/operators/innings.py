"""Ball-by-ball state of an innings: what stands, what is left, what is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def innings_totals(balls: DataFrame, match: str, innings: str, runs: str, wicket: str) -> DataFrame:
    """``match, innings, total, wickets, balls`` of each innings."""
    return balls.groupBy(match, innings).agg(F.sum(runs).alias("total"), F.sum(wicket).cast("long").alias("wickets"), F.count("*").alias("balls"))


def ball_state(balls: DataFrame, match: str, innings: str, order: list[str], runs: str, wicket: str, max_balls: int, chasing: int = 2) -> DataFrame:
    """``balls`` with the state before each ball and the pressure of a chase.

    ``bowled, score, down`` are balls, runs and wickets before the ball,
    ``balls_left`` and ``in_hand`` what remains of ``max_balls`` and ten
    wickets, ``run_rate`` the rate so far (null at the start).  In innings
    ``chasing``, ``target`` is one more than the innings before it made,
    ``needed`` the runs still to make (not below 0), ``asked_rate`` the rate
    that takes and ``pressure`` that rate over the rate so far; null elsewhere,
    where no innings came before, or where no ball is left.
    One shuffle by match serves the running sums and the totals.
    """
    over = Window.partitionBy(match, innings).orderBy(*order)
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    out = balls.withColumn("bowled", (F.row_number().over(over) - 1).cast("long"))
    out = out.withColumn("score", F.coalesce(F.sum(runs).over(before), F.lit(0)).cast("double")).withColumn("down", F.coalesce(F.sum(wicket).over(before), F.lit(0)).cast("long"))
    out = out.withColumn("balls_left", F.greatest(F.lit(max_balls) - F.col("bowled"), F.lit(0))).withColumn("in_hand", F.greatest(F.lit(10) - F.col("down"), F.lit(0)))
    first = F.sum(F.when(F.col(innings) == chasing - 1, F.col(runs))).over(Window.partitionBy(match))
    out = out.withColumn("run_rate", F.try_divide(F.col("score") * 6, F.col("bowled"))).withColumn("target", F.when(F.col(innings) == chasing, first + 1))
    out = out.withColumn("needed", F.greatest(F.col("target") - F.col("score"), F.when(F.col("target").isNotNull(), 0.0)))
    out = out.withColumn("asked_rate", F.try_divide(F.col("needed") * 6, F.col("balls_left")))
    return out.withColumn("pressure", F.try_divide("asked_rate", "run_rate"))


def high_chase(innings: Column, needed: Column, balls_left: Column, rate: float = 10.0) -> Column:
    """Whether a side batting last needs more than ``rate`` an over; false where that is not known."""
    return F.coalesce(innings.isin(2, 4) & (balls_left > 0) & (needed * 6 > balls_left * rate), F.lit(False))


def by_season(df: DataFrame, day: str, test_share: float) -> DataFrame:
    """``df`` with ``part``: the latest seasons (years) that hold ``test_share`` of the rows or more are for testing."""
    season = F.year(day)
    per = df.groupBy(season.alias("_season")).agg(F.count("*").alias("_n"))
    later = Window.orderBy(F.desc("_season"))  # a row for each season
    per = per.withColumn("_after", F.sum("_n").over(later) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    per = per.select("_season", F.when(F.col("_after") < F.col("_all") * test_share, "test").otherwise("train").alias("part"))
    return df.withColumn("_s", season).join(F.broadcast(per), F.col("_s").eqNullSafe(F.col("_season"))).drop("_s", "_season")


def pivoted_totals(totals: DataFrame, match: str, innings: str, total: str, most: int = 4) -> DataFrame:
    """``match, total_1 .. total_<most>, lead``: an innings' totals side by side, 0 where it was not played;
    ``lead`` is what the side batting first is ahead by."""
    wide = totals.groupBy(match).agg(*(F.coalesce(F.sum(F.when(F.col(innings) == i, F.col(total))), F.lit(0)).cast("double").alias(f"total_{i}") for i in range(1, most + 1)))
    signs = [F.col(f"total_{i}") if i % 2 else -F.col(f"total_{i}") for i in range(1, most + 1)]
    return wide.withColumn("lead", sum(signs[1:], signs[0]))


def chase_rows(balls: DataFrame, match: str, innings: str, order: list[str], runs: str, wicket: str, max_balls: int, chasing: int = 2) -> DataFrame:
    """The balls of chases with their state and ``won``, whether the target was reached in the end; rates unknown yet are 0."""
    state = ball_state(balls, match, innings, order, runs, wicket, max_balls, chasing).where((F.col(innings) == chasing) & F.col("target").isNotNull())
    made = F.sum(runs).over(Window.partitionBy(match))
    return state.withColumn("won", (made >= F.col("target")).cast("int")).fillna(0.0, ["run_rate", "asked_rate", "pressure"])
