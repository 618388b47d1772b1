"""Scalar formulas as Columns: native expressions, safe at zero and null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(x: Column, per: Column, scale: float = 1.0) -> Column:
    """x / per * scale; null where there is nothing to divide by."""
    return F.try_divide(x * scale, per)


def expected_score(mine: Column, theirs: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (theirs - mine) / 400))


def overs_to_balls(overs: Column) -> Column:
    """Whole overs and balls, as in 4.3: four overs and three balls; a ball count above 6 is 6."""
    whole = F.floor(overs)
    return (whole * 6 + F.least(F.round((overs - whole) * 10), F.lit(6))).cast("long")


def phase(over: Column, cuts: tuple[int, int] = (6, 16)) -> Column:
    return F.when(over < cuts[0], "powerplay").when(over < cuts[1], "middle").otherwise("death")


def projection(score: Column, balls: Column, wickets: Column, max_balls: int, start: float, a: float, b: float, z: float, y: float) -> Column:
    """Projected total from what is left of the resources."""
    left = F.pow(balls / max_balls, F.lit(z)) * F.pow(wickets / 10, F.lit(y))
    return score + a * start * left + b * score * F.try_divide(left, 1 - left)


def margin_of_victory(margin: Column, gap: Column) -> Column:
    return F.greatest(F.lit(0.5), F.least(F.lit(2.5), F.pow(F.abs(margin) + 5, F.lit(0.7)) / F.greatest(F.lit(1.0), 10 + 0.004 * gap)))


def clamp(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def combined_difference(batter: Column, bowler: Column, venue: Column, session: Column, weights: tuple[float, float, float, float], base: float = 1400.0) -> Column:
    """Weighted rating points in the batter's favour."""
    wb, wo, wp, ws = weights
    return wb * (batter - base) + wo * (base - bowler) + wp * (venue - base) + ws * (session - base)


def expected_runs(baseline: Column, difference: Column, runs_per_100: float) -> Column:
    return clamp(baseline + difference * runs_per_100 / 100, 0.0, 6.0)


def expected_wicket(base_rate: Column, difference: Column, divisor: float) -> Column:
    """The base rate moved on the logit scale by a difference in the batter's favour."""
    p = clamp(base_rate, 0.001, 0.999)
    return clamp(1 / (1 + F.exp(-(F.ln(p / (1 - p)) - difference / divisor))), 0.001, 0.5)


def normalized_margin(margin: Column, scale: float) -> Column:
    return F.tanh(margin / scale)


def resource(balls: Column, wickets: Column, max_balls: int, z: float, y: float, limited: bool = True) -> Column:
    """Share of an innings' resources left, 0 to 1: none without wickets, or without balls in limited overs."""
    b, w = F.greatest(F.lit(0), balls), clamp(wickets.cast("double"), 0.0, 10.0)
    left = F.pow(b / max_balls, F.lit(z)) * F.pow(w / 10, F.lit(y))
    none = (w == 0) | (b == 0) if limited else w == 0
    return F.when(none, 0.0).otherwise(clamp(left, 0.0, 1.0))


def logistic_multiplier(difference: Column, sensitivity: float, most: float) -> Column:
    """A factor around 1 that a rating difference moves towards ``most`` or as far below 1."""
    return 1 + (most - 1) * F.tanh(difference / sensitivity)


def poisson_loss(actual: Column, expected: Column) -> Column:
    """The part of the negative Poisson log-likelihood that depends on the expectation."""
    mean = F.greatest(expected, F.lit(1e-9))
    return mean - actual * F.ln(mean)


def log_loss(actual: Column, p: Column) -> Column:
    q = clamp(p, 1e-9, 1 - 1e-9)
    return -(actual * F.ln(q) + (1 - actual) * F.ln(1 - q))


def event_tier(name: Column, tiers: dict[int, list[str]], otherwise: int = 3) -> Column:
    """The first tier one of whose names the event's holds, letter case aside; null events have the last resort's."""
    out = F.lit(otherwise)
    for tier in sorted(tiers, reverse=True):
        out = F.when(F.coalesce(F.lower(name).rlike("|".join(rf"\Q{x.lower()}\E" for x in tiers[tier])), F.lit(False)), tier).otherwise(out)
    return out


def uniform(seed: int, *key: Column) -> Column:
    """A draw in [0, 1) that depends on the key only, not on partitions."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11) / float(1 << 53)
