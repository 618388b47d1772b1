"""Ordered-window operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from pitchline.session import cut


def full_rolling_sum(value: Column, w: WindowSpec, n: int) -> Column:
    """Sum of the last n rows; 0 until n rows are there."""
    return F.when(F.row_number().over(w) >= n, F.sum(value).over(w.rowsBetween(-(n - 1), 0))).otherwise(F.lit(0))


def running_before(value: Column, w: WindowSpec) -> Column:
    """Average of all earlier rows, the current one excluded."""
    return F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, -1))


def global_running_sum(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows up to this one in the order of
    ``by``, which must be unique, and ``_all``, the sum over the whole frame.

    A window without partitions would put every row in one task.  Rows are
    dealt by range instead and summed inside their range; what lies before a
    range comes from one total for each range, a table as long as the number
    of partitions.  An empty frame gives no rows.
    """
    ranged = cut(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_t"))
    steps = Window.orderBy("_part")  # a row for each partition
    before = totals.select("_part", (F.sum("_t").over(steps) - F.col("_t")).alias("_before"), F.sum("_t").over(Window.partitionBy()).alias("_all"))
    inside = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn(name, F.sum(value).over(inside)).join(F.broadcast(before), "_part")
    return placed.withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def average_rank_percent(df: DataFrame, by: str, name: str = "pct") -> DataFrame:
    """100 * average rank / rows; ties share the mean of their ranks.

    Ranks are taken over the distinct values and their counts, so a frame with
    many rows for each value is aggregated before it is ordered.  A row without
    a value keeps its place in the frame, has no rank and counts for none.
    """
    placed = global_running_sum(df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("_n")), [by], "_n", "_upto")
    placed = placed.select(by, ((F.col("_upto") - (F.col("_n") - 1) / 2) / F.col("_all") * 100).alias(name))
    return df.join(placed, by, "left")


def global_ntile(df: DataFrame, by: list[str], k: int, name: str = "tile") -> DataFrame:
    """``df`` with the bucket 1..k of each row in the order of ``by``, which must be unique."""
    placed = global_running_sum(df.withColumn("_one", F.lit(1).cast("long")), by, "_one", "_rn")
    i = F.col("_rn") - 1
    small, longer = F.floor(F.col("_all") / k), F.col("_all") % k
    inside_long = longer * (small + 1)
    tile = F.when(i < inside_long, F.floor(i / (small + 1))).otherwise(longer + F.floor((i - inside_long) / F.greatest(small, F.lit(1))))
    return placed.withColumn(name, (tile + 1).cast("long")).drop("_rn", "_all", "_one")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an aggregate, not a sort."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*")


def prior_mean(df: DataFrame, key: str, day: str, tie: str, value: Column, n: int, name: str) -> DataFrame:
    """``df`` with the mean of the key's last ``n`` rows on days strictly before the row's day.

    Rows of the same day never see each other, so a plain row frame would leak.
    Prefix sums are looked up by position instead: an equi-join, no range join.
    Null values count for nothing, as in AVG; null where no value came before.
    """
    order = Window.partitionBy(key).orderBy(day, tie)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("_rn", F.row_number().over(order)).withColumn("_cum", F.struct(F.coalesce(F.sum(value).over(upto), F.lit(0)).cast("double").alias("s"), F.count(value).over(upto).alias("n")))
    same_day = Window.partitionBy(key, day)
    rows = rows.withColumn("_upto", F.min("_rn").over(same_day) - 1)
    sums = rows.select(F.col(key).alias("_k"), F.col("_rn").alias("_at"), F.col("_cum").alias("_s"))
    hi, lo = sums.select("_k", "_at", F.col("_s").alias("_hi")), sums.select("_k", "_at", F.col("_s").alias("_lo"))
    out = rows.join(hi, F.col(key).eqNullSafe(hi["_k"]) & (F.col("_upto") == hi["_at"]), "left").drop("_k", "_at")
    out = out.join(lo, F.col(key).eqNullSafe(lo["_k"]) & (F.col("_upto") - n == lo["_at"]), "left").drop("_k", "_at")
    mean = F.try_divide(F.col("_hi.s") - F.coalesce("_lo.s", F.lit(0)), F.col("_hi.n") - F.coalesce("_lo.n", F.lit(0)))
    return out.withColumn(name, mean).drop("_rn", "_cum", "_upto", "_hi", "_lo")


def exact_percentiles(df: DataFrame, by: str | None, value: str, at: dict[str, float]) -> DataFrame:
    """One row for each group with the interpolated percentiles ``at`` (name: share) of ``value``.

    Values are counted and put in one order over the whole frame by range, and
    each percentile is picked by its rank: no task holds a group's values.
    Null values are left out; groups without a value have no row.
    """
    group = F.lit(0) if by is None else F.col(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(group.alias("_g"), F.col(value).alias("_x")).agg(F.count("*").alias("_n"))
    placed = cut(global_running_sum(counts, ["_g", "_x"], "_n", "_upto").drop("_all"))
    groups = placed.groupBy("_g").agg(F.sum("_n").alias("_m"), F.min(F.col("_upto") - F.col("_n")).alias("_before"))
    same = F.col("_g").eqNullSafe(F.col("_h"))
    rows = placed.join(groups.withColumnRenamed("_g", "_h"), same).withColumn("_hi", F.col("_upto") - F.col("_before") - 1).withColumn("_lo", F.col("_hi") - F.col("_n") + 1)

    def pick(share: float) -> Column:
        pos = F.lit(share) * (F.col("_m") - 1)
        here = lambda k: F.max(F.when((F.col("_lo") <= k) & (k <= F.col("_hi")), F.col("_x")))
        low, high = here(F.floor(pos)), here(F.ceil(pos))
        return low + (high - low) * F.max(pos - F.floor(pos))

    out = rows.groupBy("_g").agg(*(pick(share).alias(name) for name, share in at.items()))
    return out.drop("_g") if by is None else out.withColumnRenamed("_g", by)


def standings(df: DataFrame, league: str, team: str, points: Column, wins: Column) -> DataFrame:
    """``league, team, points, wins, position``: a table by points, then wins, then name."""
    table = df.groupBy(league, team).agg(F.sum(points).alias("points"), F.sum(wins).alias("wins"))
    return table.withColumn("position", F.row_number().over(Window.partitionBy(league).orderBy(F.desc("points"), F.desc("wins"), team)).cast("long"))
