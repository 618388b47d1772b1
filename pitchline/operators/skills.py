"""Coupled skills of batter, bowler and venue, for runs and wickets, against baselines of leagues."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchline.operators.levels import level_scan
from pitchline.operators.ratings import _typed


def league_baselines(balls: DataFrame, league: str, day: str, value: str, blend: float = 5000.0) -> DataFrame:
    """``balls`` with ``baseline``: the league's mean of ``value`` on days strictly before, drawn to the mean of all rows.

    The league weighs n / (n + ``blend``) with n rows behind it; a league that
    is null, empty or new has the mean of all rows.  Days are summed first, so
    a league's window has a row for each day and not for each ball.
    """
    known = F.coalesce(F.col(league) != "", F.lit(False))
    days = balls.where(known).groupBy(F.col(league).alias("_l"), F.col(day).alias("_d")).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    before = Window.partitionBy("_l").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    upto = days.select("_l", "_d", F.sum("_s").over(before).alias("_ps"), F.sum("_n").over(before).alias("_pn"))
    every = balls.agg(F.avg(value).alias("_all"))  # one row
    rows = balls.join(upto, (F.col(league) == F.col("_l")) & (F.col(day) == F.col("_d")), "left").crossJoin(F.broadcast(every))
    weight = F.col("_pn") / (F.col("_pn") + F.lit(float(blend)))
    mixed = weight * F.col("_ps") / F.col("_pn") + (1 - weight) * F.col("_all")
    return rows.withColumn("baseline", F.when(F.col("_pn") > 0, mixed).otherwise(F.col("_all"))).select(*balls.columns, "baseline")


@dataclass(frozen=True)
class SkillRules:
    """Fixed values for the short format: shares of batter, bowler, venue and session in an update; steps
    (most, least, half-life in balls); decay a ball; bounds of players and venues."""

    run_shares: tuple[float, ...] = (0.55, 0.30, 0.03, 0.12)
    wicket_shares: tuple[float, ...] = (0.45, 0.25, 0.06, 0.24)
    run_step: tuple[float, float, float] = (0.05, 0.01, 300.0)
    wicket_step: tuple[float, float, float] = (0.04, 0.008, 350.0)
    venue_step: tuple[float, float, float] = (0.002, 0.2, 10000.0)
    session_step: tuple[float, float, float] = (0.05, 0.01, 150.0)
    decay: tuple[float, ...] = (0.0005, 0.0005, 0.0001, 0.001)
    run_bounds: tuple[float, ...] = (0.5, 0.5, 0.3, 0.3)
    wicket_bounds: tuple[float, ...] = (0.05, 0.05, 0.03, 0.03)


SKILLS = ("batter", "bowler", "venue", "session")


def skill_scan(balls: DataFrame, pool: str, order: list[str], match: str, batter: str, bowler: str, venue: str, runs: str, wicket: str, wicket_rate: float, baseline: str = "baseline", rules: SkillRules = SkillRules()) -> DataFrame:
    """The skills before each ball of batter, bowler, venue and session, and the runs and the wicket they lead to expect.

    The eight states of a ball are coupled: each side's expectation reads all
    four, and what came of the ball beyond it moves all four.  A state first
    decays towards 0, then moves by its step times its share of the surprise,
    and stays in its bounds.  A bowler's run skill is what is conceded less; all
    wicket skills add to the chance of a wicket.  Runs start from the column
    ``baseline``, wickets from ``wicket_rate``; shares weigh runs in the
    expectation too, wickets in the update only.  A player's step shrinks with
    the balls behind, a venue's to a fifth; the session starts anew with each
    match.  One ordered pass for each ``pool`` (a format and gender); a task
    holds the skills of its pool, not its balls, and balls that share no
    state are taken together.
    """
    kind = balls.schema[pool].dataType.simpleString()
    keys = f"{pool} {kind}, {match} long, {batter} long, {bowler} long, {venue} long"
    told = [f"{s}_{d}_before double" for d in ("run", "wicket") for s in SKILLS]
    schema = ", ".join([keys, *told, "expected_runs double", "expected_wicket double"])
    shrink = lambda step, n: step[1] + (step[0] - step[1]) * np.exp(-n / step[2])
    run_weigh = (np.array(rules.run_shares) * (1, -1, 1, 1))[:, None]
    # state, row, skill: for runs and for wickets
    shares = np.stack([run_weigh, np.array(rules.wicket_shares)[:, None]], axis=2)
    high = np.stack([np.array(rules.run_bounds)[:, None], np.array(rules.wicket_bounds)[:, None]], axis=2)
    stays = 1 - np.array(rules.decay)[:, None, None]

    def play(skill, ids, bounds, behind, _, values):
        scored, fell, base = values
        size = np.empty((*ids.shape, 2))
        for d, own in enumerate((rules.run_step, rules.wicket_step)):
            size[:2, :, d] = shrink(own, behind[:2])
        size[2] = np.maximum(rules.venue_step[0] * rules.venue_step[1], rules.venue_step[0] * np.exp(-behind[2] / rules.venue_step[2]))[:, None]
        size[3] = shrink(rules.session_step, behind[3])[:, None]
        size *= shares
        seen, held, told = np.stack([scored, fell], axis=1), np.empty((*ids.shape, 2)), np.empty((len(base), 2))
        for a, b in zip(bounds, bounds[1:]):
            i = ids[:, a:b]
            v = skill[i]
            held[:, a:b] = v
            e = told[a:b]
            e[:, 0] = np.minimum(6.0, np.maximum(0.0, base[a:b] + np.add.reduce(v[:, :, 0] * run_weigh, axis=0)))
            e[:, 1] = np.minimum(0.5, np.maximum(0.001, wicket_rate + np.add.reduce(v[:, :, 1], axis=0)))
            v *= stays
            v += size[:, a:b] * (seen[a:b] - e)
            skill[i] = np.minimum(np.maximum(v, -high, out=v), high, out=v)
        return *held[:, :, 0], *held[:, :, 1], told[:, 0], told[:, 1]

    balls = _typed(balls, match, batter, bowler, venue)
    return level_scan(balls, pool, order, [batter, bowler, venue], [runs, wicket, baseline], play, schema, np.zeros(2), match, kept=(pool, match, batter, bowler, venue))


def wicket_rate(balls: DataFrame, wicket: Column) -> float:
    """The share of balls with a wicket; 0 without balls."""
    return balls.agg(F.avg(wicket.cast("double"))).first()[0] or 0.0
