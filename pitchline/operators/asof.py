"""As-of and interval joins without range-join strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchline.session import cut, has_hot_key


def asof_before(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: Column, name: str) -> DataFrame:
    """``left`` with ``name``: the right value that is latest strictly before each row.

    Both sides are laid on one time line per key and the last right row is
    carried forward: one shuffle and one sort.  Where a key has more rows than
    a task should order, the line is dealt by ranges of key and time instead:
    inside a range the last right row is carried forward as before, and the
    last one of a key's earlier ranges, a row for each key and range, is
    carried into the next.  At equal times left rows
    come first, which makes the bound strict; of right rows at one time the
    largest value counts, null the least.  Null keys match nothing, right rows
    without a time are left out, and a null value of the latest row stays null.
    """
    marks = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull())
    marks = marks.select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).alias("_l"), F.struct(value.alias("v")).alias("_v"))
    lines = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).alias("_v"))
    by_time = F.col("_t"), F.col("_side"), F.col("_v").asc_nulls_first()
    upto = Window.unboundedPreceding, Window.currentRow
    both = lines.unionByName(marks)
    if not has_hot_key(both, "_k"):
        w = Window.partitionBy("_k").orderBy(*by_time).rowsBetween(*upto)
        return both.withColumn(name, F.last("_v", ignorenulls=True).over(w)["v"]).where("_side = 0").select("_l.*", name)
    # rows of one key and time may be many too: they are dealt on by a number that changes nothing for the left ones
    laid = both.withColumn("_salt", F.when(F.col("_side") == 0, F.monotonically_increasing_id()))
    placed = cut(laid.repartitionByRange("_k", "_t", "_side", "_v", "_salt").withColumn("_part", F.spark_partition_id()))
    last = placed.where("_side = 1").groupBy("_k", "_part").agg(F.max_by("_v", F.struct("_t", "_v")).alias("_e"))
    parts = placed.select("_k", "_part").distinct().join(last, ["_k", "_part"], "left")
    earlier = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("_c", F.last("_e", ignorenulls=True).over(earlier)).where("_c is not null").select(F.col("_k").alias("_ck"), F.col("_part").alias("_cp"), "_c")
    w = Window.partitionBy("_part", "_k").orderBy(*by_time).rowsBetween(*upto)
    rows = placed.withColumn("_here", F.last("_v", ignorenulls=True).over(w)).where("_side = 0")
    # a key begins in one range, so as many rows are carried as there are ranges
    rows = rows.join(carried, (F.col("_k") == F.col("_ck")) & (F.col("_part") == F.col("_cp")), "left")
    return rows.withColumn(name, F.coalesce("_here", "_c")["v"]).select("_l.*", name)


def interval_join(points: DataFrame, spans: DataFrame, key: list[str], day: str, first: str, days: int) -> DataFrame:
    """Points with the spans that hold their day: spans are laid out by day, so the join is an equi-join."""
    spans = spans if days > 0 else spans.where(F.lit(False))
    laid = spans.withColumn("_day", F.explode(F.sequence(F.col(first), F.date_add(F.col(first), max(days, 1) - 1))))
    return points.join(laid, [points[k] == laid[k] for k in key] + [points[day] == laid["_day"]]).drop("_day")
