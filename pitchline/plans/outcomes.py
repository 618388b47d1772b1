"""Registered queries of outcome models, of losses over many settings, of state that takes rows in order and of landed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchline.operators import additive, losses, models, skills, trees
from pitchline.plans.coupled import _balls
from pitchline.sources.landed import Field, Layout, extracted, parsed
from pitchline.sources.tables import table
from pitchline.streaming import ordered

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


#: Where the seven bands of a unit price begin, above the first.
BANDS = (600.0, 1000.0, 1500.0, 2500.0, 4500.0, 10000.0)


@query()
def q_softmax_outcome(spark: SparkSession, d: str) -> DataFrame:
    """Joint trees of seven classes: the band of a line's unit price from price and quantity, which the trees
    have to divide, among columns that say nothing.  A fifth of the orders is not fitted on; every line is scored."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    band = sum((unit >= b).cast("int") for b in BANDS)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", band.alias("band"), (models.fold_of(F.col("l_orderkey"), 5) == 0).alias("held_out"))
    model = trees.fit_softmax(rows.where("not held_out"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "band", 7, rounds=6, depth=4, step=0.5)
    return models.metrics(trees.score_softmax(model, rows), "band", ["held_out"])


@query()
def q_rating_losses(spark: SparkSession, d: str) -> DataFrame:
    """Losses of ball-by-ball ratings, for runs and for wickets, under settings of steps and shares in one pass each."""
    balls = skills.league_baselines(_balls(spark, d), "league", "l_shipdate", "runs")
    rate = skills.wicket_rate(balls, F.col("wicket"))
    balls = balls.withColumn("hit", F.col("wicket").cast("double")).withColumn("rate", F.lit(float(rate)))
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]

    def under(outcome: str, base: str, scale: float, wickets: bool) -> DataFrame:
        grid = [losses.Setting((most, 4.0, 500.0), (6.0, 1.0, 4000.0), (12.0, 2.0, 150.0), share, 0.35, 0.15, 0.1, scale) for most in (8.0, 16.0, 24.0, 32.0) for share in (0.3, 0.45, 0.6)]
        out = losses.setting_losses(balls, "pool", order, "l_orderkey", "batter", "bowler", "venue", base, outcome, grid, wickets)
        return out.select(F.lit(outcome).alias("outcome"), "*")

    return under("runs", "baseline", 0.8, False).unionByName(under("hit", "rate", 400.0, True))


@query()
def q_additive_price(spark: SparkSession, d: str) -> DataFrame:
    """A smooth curve of the logarithm of a line's unit price over quantity and day, with an effect of each supplier;
    for each quantity the mean and what the model expects."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", F.unix_date(F.to_date("l_shipdate")).cast("double").alias("day"), F.ln(F.col("l_extendedprice") / F.col("l_quantity")).alias("y"))
    model = additive.fit_additive(rows, {"l_quantity": 12, "day": 8}, "y", "l_suppkey", group="l_orderkey")
    scored = additive.score_additive(model, rows, "l_suppkey")
    return scored.groupBy("l_quantity").agg(F.count("*").alias("n"), F.avg("y").alias("seen"), F.avg("expected").alias("expected"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, value, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events),
f AS (SELECT user_id, event_id, ms, value, n, 50.0::DOUBLE AS before, 50 + 0.1 * (value - 50) AS after FROM e WHERE n = 1
      UNION ALL SELECT e.user_id, e.event_id, e.ms, e.value, e.n, f.after, f.after + 0.1 * (e.value - f.after) FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, event_id, n, round(before, 6) AS before, round(after, 6) AS after FROM f WHERE ms <= (SELECT max(epoch_ms(ts)) FROM events) - 86400000
""")
def q_ordered_levels(spark: SparkSession, d: str) -> DataFrame:
    """The level of each user before and after each event, from a stream whose files may come in any order; the last day still waits."""
    out = ordered.ordered_run(spark, d, "user_id", "ts", "event_id", "value", lambda level, n, value: level + 0.1 * (value - level), 50.0, only="events.parquet", late="1 day")
    return out.select("user_id", "event_id", "n", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


#: Where the lines of an order stand in the two versions of its document.
LINES = Layout(("$.items", "$.lines"), {"order_id": Field("bigint", ("$.order.id", "$.orderId"), True, True), "line": Field("int", ("$.lineNumber", "$.no"), True), "quantity": Field("double", ("$.quantity", "$.qty"))})


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS place FROM lineitem)
SELECT l_orderkey AS landed, place::INTEGER AS place, l_orderkey AS order_id, l_linenumber AS line, CASE WHEN l_quantity < 45 OR l_orderkey % 2 = 0 THEN l_quantity END AS quantity, CASE WHEN l_quantity >= 45 AND l_orderkey % 2 = 1 THEN 'quantity is not double' END AS reason FROM l WHERE l_orderkey % 97 <> 0
UNION ALL SELECT DISTINCT l_orderkey, NULL::INTEGER, NULL::BIGINT, NULL::INTEGER, NULL::DOUBLE, 'not JSON' FROM l WHERE l_orderkey % 97 = 0
""")
def q_landed_documents(spark: SparkSession, d: str) -> DataFrame:
    """The lines of all orders, read back from documents of two versions: the later one says "many" for large
    quantities, and some documents break off; what cannot be read has a reason."""
    # dealt by number: reading documents is work for all cores, however few bytes the lines are
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q")))).alias("x"))
    old = F.to_json(F.struct(F.col("l_orderkey").alias("orderId"), F.transform("x", lambda r: F.struct(r["n"].alias("no"), r["q"].alias("qty"))).alias("lines")))
    said = lambda q: F.when(q < 45, q.cast("string")).otherwise("many")
    new = F.to_json(F.struct(F.struct(F.col("l_orderkey").alias("id")).alias("order"), F.transform("x", lambda r: F.struct(r["n"].alias("lineNumber"), said(r["q"]).alias("quantity"))).alias("items")))
    text = F.when(F.col("l_orderkey") % 2 == 0, old).otherwise(new)
    text = F.when(F.col("l_orderkey") % 97 == 0, F.left(text, F.length(text) - 1)).otherwise(text)
    return extracted(parsed(rows.select(F.col("l_orderkey").alias("landed"), text.alias("text")), "text"), LINES, ["landed"])
