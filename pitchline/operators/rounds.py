"""Pair ratings in conflict-free rounds.

A match waits for the match before it of either side and for nothing else.
Matches whose sides have both played all that comes before form a round: no
two of them share a side, so a round is one join with the ratings and one
update of them, whatever the number of leagues.  There are as many rounds as
the longest chain of matches that wait for each other, which grows with the
matches of a side and not with the number of sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchline.session import cut, discard

#: Matches are stored by the first round that could hold them, in bands of so many rounds.
BAND = 8


def _schedule(matches: DataFrame, order: list[str], home: str, away: str, keep: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The kept columns by ``_m``, and ``_m``, what rating needs and how many matches each side has behind it, stored by bands."""
    rows = cut(matches.where(F.col(home) != F.col(away)).select(*keep, *(F.col(c).alias(f"_o{k}") for k, c in enumerate(order)), F.col(home).alias("_h"), F.col(away).alias("_a"), F.monotonically_increasing_id().alias("_m")))
    by = [*(f"_o{k}" for k in range(len(order))), "_m"]
    sides = rows.select(*by, F.explode(F.array(F.struct(F.col("_h").alias("e"), F.lit(0).alias("s")), F.struct(F.col("_a").alias("e"), F.lit(1).alias("s")))).alias("x")).select(*by, "x.*")
    placed = sides.withColumn("_n", F.row_number().over(Window.partitionBy("e").orderBy(*by)) - 1)
    both = placed.groupBy("_m").agg(F.max(F.when(F.col("s") == 0, F.col("_n"))).alias("_nh"), F.max(F.when(F.col("s") == 1, F.col("_n"))).alias("_na"))
    # no match comes before the round that its busier side has matches behind it
    plan = rows.drop("_row", *by[:-1]).join(both, "_m").withColumn("_low", F.greatest("_nh", "_na"))
    return rows.select("_m", "_row"), cut(plan.withColumn("_band", F.floor(F.col("_low") / BAND).cast("int")), ("_band",))


def rated_rounds(
    matches: DataFrame, order: list[str], home: str, away: str, score: str, step: Callable[[Column], Column] = lambda n: F.lit(20.0), start: float = 1400.0, edge: float = 0.0,
    starts: DataFrame | None = None, pull: float = 0.0, factor_home: str | None = None, factor_away: str | None = None, mean: float | None = None, share: float = 0.5,
) -> DataFrame:
    """``matches`` with ``home_before, away_before, home_change, away_change`` and ``round``.

    In the order of ``order`` (ties in any order that holds for both sides) a
    match moves each side by its step times what the score, 0 to 1, was above
    the expectation, which is logistic in the difference of the ratings plus
    ``edge``.  ``step`` gives the step from the number of matches behind a
    side, and ``factor_home`` and ``factor_away`` are columns that scale it, as
    by the opponent's standing; null scales by 1.

    ``starts`` is ``(entity, start)``: where a side starts and, with ``pull``,
    what it is drawn to by that share of the gap in each match; others start
    at ``start``.  With ``mean`` the mean of all sides is moved towards it by
    ``share`` of the drift after each round: one offset, not a write to every
    rating.  Matches of a side against itself, with a null side or a null score
    are left out.
    """
    kept = [c for c in matches.columns if c not in ("home_before", "away_before", "home_change", "away_change", "round")]
    known = matches.where(F.col(score).isNotNull())
    factor = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(1.0)) if c else F.lit(1.0)
    rows, plan = _schedule(known, order, home, away, [F.struct(*kept).alias("_row"), F.col(score).cast("double").alias("_s"), factor(factor_home).alias("_fh"), factor(factor_away).alias("_fa")])
    left = plan.count()
    sides = plan.select(F.explode(F.array("_h", "_a")).alias("e")).groupBy("e").agg(F.count("*").alias("_all"))
    if starts is not None:
        sides = sides.join(starts.select(F.col("entity").alias("e"), F.col("start").cast("double").alias("_start")), "e", "left")
    now = cut(sides.select("e", "_all", F.coalesce(F.col("_start") if starts is not None else F.lit(None), F.lit(float(start))).alias("base")).withColumns({"n": F.lit(0).cast("long"), "r": F.col("base")}))
    total, count = now.agg(F.sum("r"), F.count("*")).first()
    offset, out, k = 0.0, None, 0
    slim = [c for c in plan.columns if c not in ("_low", "_band")]
    waiting = plan.limit(0).select(slim)
    while left:
        own = lambda name: now.select(F.col("e").alias(f"_{name}"), F.col("n").alias(f"_n{name}"), (F.col("r") + F.lit(offset)).alias(f"_r{name}"), F.col("base").alias(f"_b{name}"))  # noqa: B023, E731
        # a match comes in at its first possible round, and only what is not ready then goes on to the next
        asked = waiting.unionByName(plan.where((F.col("_band") == k // BAND) & (F.col("_low") == k)).select(slim))
        ready = asked.join(own("h"), ["_h", "_nh"], "left").join(own("a"), ["_a", "_na"], "left")
        p = 1 / (1 + F.pow(F.lit(10.0), (F.col("_ra") - F.col("_rh") - edge) / 400))
        gain = F.col("_s") - p
        drawn = lambda name: pull * (F.col(f"_b{name}") - F.col(f"_r{name}"))
        ready = ready.select(*slim, F.col("_rh").alias("home_before"), F.col("_ra").alias("away_before"), (step(F.col("_nh")) * F.col("_fh") * gain + drawn("h")).alias("home_change"), (-step(F.col("_na")) * F.col("_fa") * gain + drawn("a")).alias("away_change"))
        tried = cut(ready)
        done = tried.where("home_before is not null and away_before is not null").select("_m", "_h", "_a", "home_before", "away_before", "home_change", "away_change")
        waiting = tried.where("home_before is null or away_before is null").select(slim)
        moved = done.select(F.explode(F.array(F.struct(F.col("_h").alias("e"), F.col("home_change").alias("c")), F.struct(F.col("_a").alias("e"), F.col("away_change").alias("c")))).alias("x")).select("x.*")
        # a side without further matches is read no more
        after = cut(now.join(moved, "e", "left").select("e", "_all", "base", (F.col("n") + F.col("c").isNotNull().cast("long")).alias("n"), (F.col("r") + F.coalesce("c", F.lit(0.0))).alias("r")).where("n < _all"))
        discard(now)
        now = after
        rated, change = done.agg(F.count("*"), F.sum(F.col("home_change") + F.col("away_change"))).first()
        left -= rated
        total += change
        if mean is not None:
            offset -= share * (total / count + offset - mean)
        told = done.select("_m", "home_before", "away_before", "home_change", "away_change", F.lit(k).alias("round"))
        out = told if out is None else out.unionByName(told)
        k += 1
        if k % 16 == 0:  # the plan of the union stays short
            out = cut(out)
    discard(now)
    discard(plan)
    if out is None:
        none = F.lit(None).cast("double")
        return matches.limit(0).select(*kept, *(none.alias(c) for c in ("home_before", "away_before", "home_change", "away_change")), F.lit(0).alias("round"))
    return rows.join(out, "_m").select("_row.*", "home_before", "away_before", "home_change", "away_change", "round")
