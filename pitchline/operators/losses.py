"""Losses of ball-by-ball ratings under many settings in one pass.

A rating is an array with a place for each setting, and balls that share no
entity are rated together, so a few array operations serve many balls and settings.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchline.operators.levels import level_scan

#: Settings that one pass rates: more would make its states large, fewer its array operations small.
SIDE_BY_SIDE = 8


@dataclass(frozen=True)
class Setting:
    """Steps (most, least, half-life in balls) of players, venues and sessions, shares, which are scaled to
    sum to 1, and the scale: runs for 100 points, or the points of one unit of the logit."""

    player: tuple[float, float, float]
    venue: tuple[float, float, float]
    session: tuple[float, float, float]
    batter_share: float
    bowler_share: float
    session_share: float
    venue_share: float
    scale: float


def setting_losses(balls: DataFrame, league: str, order: list[str], match: str, batter: str, bowler: str, venue: str, baseline: str, outcome: str, settings: list[Setting], wickets: bool = False, start: float = 1400.0) -> DataFrame:
    """``setting, n, loss``: the mean loss of what the ratings expect of each ball, for each of ``settings`` by number.

    Runs are expected as the baseline plus what the ratings say, between 0.01
    and 6, and lose as under Poisson, expected - runs * ln(expected).  With
    ``wickets`` the ratings move the baseline, a chance, on the logit scale,
    the chance stays between 0.001 and 0.999, and the loss is logarithmic; a
    batter's rating is then worth survival.  A session starts anew with each
    match.  A ball without outcome or baseline is left out; null players and
    venues are entities of their own.  Leagues are rated apart, each in the
    order of ``order`` and for eight settings by one task, which holds the
    ratings, not the balls, and rates balls together that share no entity.
    """
    if not settings:
        raise ValueError("no settings")
    known = balls.where(F.col(baseline).isNotNull() & F.col(outcome).isNotNull())
    at = np.array([[*s.player, *s.venue, *s.session, *astuple(s)[3:]] for s in settings], dtype=float).T
    parts = [at[:, i : i + SIDE_BY_SIDE] for i in range(0, len(settings), SIDE_BY_SIDE)]
    out = None
    for i, part in enumerate(parts):
        play, fresh = _play(part, i * SIDE_BY_SIDE, wickets, start)
        told = level_scan(known, league, order, [batter, bowler, venue], [baseline, outcome], play, "setting int, n long, loss double", fresh, match)
        out = told if out is None else out.unionByName(told)
    return out.groupBy("setting").agg(F.sum("n").alias("n"), F.try_divide(F.sum("loss"), F.sum("n")).alias("loss"))


def _play(at: np.ndarray, first: int, wickets: bool, start: float):
    """What a level does to the ratings, for the settings that are the columns of ``at``, numbered from ``first``."""
    steps = np.stack([at[0:3], at[0:3], at[3:6], at[6:9]])[:, :, None, :]  # kind, (most, least, half), row, setting
    shares = at[9:13] / at[9:13].sum(axis=0)
    scale = 1 / at[13] if wickets else at[13] / 100
    sides = np.array((-1.0, 1.0, 1.0, 1.0) if wickets else (1.0, -1.0, 1.0, 1.0))[:, None]
    weigh = (sides * shares[[0, 1, 3, 2]] * scale)[:, None, :]

    def play(state, ids, bounds, behind, _, values):
        base, y = (v[:, None] for v in values)
        fade = np.exp(-behind[:, :, None] / steps[:, 2])
        size = steps[:, 1] + (steps[:, 0] - steps[:, 1]) * fade
        size[3] = np.maximum(steps[3, 0] * fade[3], steps[3, 1])
        size *= sides[:, :, None]
        if wickets:
            base = np.clip(base, 0.001, 0.999)
            base = np.log(base / (1 - base))
        expected = np.empty((len(y), at.shape[1]))
        for a, b in zip(bounds, bounds[1:]):
            i = ids[:, a:b]
            v = state[i]
            e = np.add.reduce((v - start) * weigh, axis=0)
            e += base[a:b]
            if wickets:
                np.negative(e, out=e)
                np.exp(e, out=e)
                e += 1
                np.reciprocal(e, out=e)
                np.minimum(np.maximum(e, 0.001, out=e), 0.999, out=e)
            else:
                np.minimum(np.maximum(e, 0.01, out=e), 6.0, out=e)
            expected[a:b] = e
            v += size[:, a:b] * (y[a:b] - e)
            state[i] = v
        loss = -np.where(y != 0, np.log(expected), np.log1p(-expected)) if wickets else expected - y * np.log(expected)
        return np.arange(first, first + at.shape[1], dtype=np.int32), np.full(at.shape[1], len(y)), loss.sum(axis=0)

    return play, np.full(at.shape[1], float(start))
