"""Monte Carlo by keyed draws: a draw depends on seed, key and ball, never on partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchline.functions import formulas as fx

#: Runs of the outcomes after the first, which is a wicket.
OUTCOMES = (0, 0, 1, 2, 3, 4, 6)


def innings(df: DataFrame, key: str, weights: str, sims: int, balls: int, seed: int, wickets: int = 10) -> DataFrame:
    """``key, mean_runs, sd_runs, mean_wickets`` of ``sims`` simulated innings.

    ``weights`` holds seven weights: a wicket, then 0, 1, 2, 3, 4 and 6 runs;
    they need not add up to one, and an innings without any weight scores
    nothing.  An innings is folded ball by ball within its row and ends with
    the last wicket, so only the summary is shuffled.
    """
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    running = F.aggregate(weights, F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x)))
    rows = df.select(key, F.explode(F.sequence(F.lit(1), F.lit(sims))).alias("_sim"), running.alias("_upto"), total.alias("_total"))
    worth = F.array(*(F.lit(x) for x in OUTCOMES))

    def ball(s, i):
        at = F.size(F.filter("_upto", lambda x: x <= fx.uniform(seed, F.col(key), F.col("_sim"), i) * F.col("_total")))
        live = (s["w"] < wickets) & (F.col("_total") > 0)
        return F.struct((s["r"] + F.when(live, F.coalesce(F.get(worth, at), F.lit(0))).otherwise(0)).alias("r"), (s["w"] + F.when(live & (at == 0), 1).otherwise(0)).alias("w"))

    start = F.struct(F.lit(0).alias("r"), F.lit(0).alias("w"))
    played = rows.select(key, F.aggregate(F.sequence(F.lit(1), F.lit(balls)), start, ball).alias("e"))
    return played.groupBy(key).agg(F.avg("e.r").alias("mean_runs"), F.stddev_samp("e.r").alias("sd_runs"), F.avg("e.w").alias("mean_wickets"))
