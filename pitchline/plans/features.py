"""Registered queries of series, features, losses and table changes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchline.functions import formulas as fx
from pitchline.operators import asof, graph, innings, models, ratings, windows
from pitchline.sources import tables
from pitchline.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_SERIES = "s AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


@query(f"WITH RECURSIVE {_SERIES}, r AS (SELECT event_id, user_id, i, 10.0::DOUBLE AS b, 0.9::DOUBLE * 10 + 0.1::DOUBLE * coalesce(value, 0) AS a FROM s WHERE i = 1 UNION ALL SELECT s.event_id, s.user_id, s.i, r.a, 0.9::DOUBLE * r.a + 0.1::DOUBLE * coalesce(s.value, 0) FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1) SELECT event_id, i - 1 AS seen, round(b, 6) AS before, round(a, 6) AS after FROM r")
def q_ema_series(spark: SparkSession, d: str) -> DataFrame:
    """The average before and after every event."""
    out = ratings.ema_series(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"], "value", lambda i: F.lit(0.1), 10.0)
    return out.select("event_id", F.col("seen").cast("long").alias("seen"), F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


@query(f"WITH RECURSIVE {_SERIES}, k AS (SELECT *, 0.02::DOUBLE + 0.28::DOUBLE * exp(-(i - 1) / 50.0) AS a FROM s), r AS (SELECT event_id, user_id, i, 0.0::DOUBLE AS b, a * value AS e FROM k WHERE i = 1 UNION ALL SELECT k.event_id, k.user_id, k.i, r.e, (1 - k.a) * r.e + k.a * k.value FROM r JOIN k ON k.user_id = r.user_id AND k.i = r.i + 1) SELECT event_id, round(b, 6) AS before, round(e, 6) AS after FROM r")
def q_skill_series(spark: SparkSession, d: str) -> DataFrame:
    """A step that shrinks with the events seen."""
    out = ratings.ema_series(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"], "value", lambda i: 0.02 + 0.28 * F.exp(-i / 50.0), 0.0)
    return out.select("event_id", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


@query()
def q_wicket_elo(spark: SparkSession, d: str) -> DataFrame:
    """Wicket ratings of parts against suppliers in orders; every league is one ordered pass."""
    balls = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("league"), "l_orderkey", "l_linenumber", F.col("l_partkey").alias("batter"), F.col("l_suppkey").alias("bowler"), (F.col("l_suppkey") % 20).alias("venue"), (F.col("l_quantity") > 45).cast("double").alias("wicket"), fx.phase(F.col("l_linenumber") * 3).alias("phase"), (F.col("l_suppkey") % 4 + 1).alias("tier"))
    return ratings.wicket_scan(balls, "league", ["l_orderkey", "l_linenumber", "batter", "bowler"], "l_orderkey", "batter", "bowler", "venue", "wicket", phase="phase", tier="tier")


_NULLED = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS k, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS t, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS v"


@query(f"WITH o AS (SELECT {_NULLED} FROM orders), m AS (SELECT k, t, max(v) AS v FROM o WHERE k IS NOT NULL AND t IS NOT NULL GROUP BY ALL), e AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END AS k, ts FROM events) SELECT event_id, (SELECT v FROM m WHERE m.k = e.k AND m.t < e.ts ORDER BY t DESC LIMIT 1) AS last_price FROM e")
def q_asof_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Keys, times and values that are null now and then."""
    n = F.col("o_orderkey")
    o = table(spark, d, "orders").select(F.when(n % 7 != 0, F.col("o_custkey")).alias("k"), F.when(n % 11 != 0, F.col("o_orderdate")).alias("t"), F.when(n % 5 != 0, F.col("o_totalprice")).alias("v"))
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 13 != 0, F.col("user_id")).alias("k"), "ts")
    return asof.asof_before(e, o, "k", "ts", "t", F.col("v"), "last_price").select("event_id", "last_price")


@query("WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE floor(o_totalprice / 1000) END AS x FROM orders), r AS (SELECT o_orderkey, (rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2) / count(*) OVER () * 100 AS p FROM v WHERE x IS NOT NULL) SELECT o_orderkey, round(p, 6) AS pct FROM v LEFT JOIN r USING (o_orderkey)")
def q_avg_rank_nulls(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.floor(F.col("o_totalprice") / 1000)).alias("x"))
    return windows.average_rank_percent(v, "x").select("o_orderkey", F.round("pct", 6).alias("pct"))


@query("WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders), m AS (SELECT *, min(rn) OVER (PARTITION BY o_custkey, o_orderdate) - 1 AS upto FROM o) SELECT m.o_orderkey, round(avg(p.v), 4) AS prior FROM m LEFT JOIN o p ON p.o_custkey = m.o_custkey AND p.rn BETWEEN m.upto - 4 AND m.upto GROUP BY 1")
def q_history_form_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the five orders before the day, those without a price left out."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("v"))
    return windows.prior_mean(o, "o_custkey", "o_orderdate", "o_orderkey", F.col("v"), 5, "prior").select("o_orderkey", F.round("prior", 4).alias("prior"))


@query("WITH e AS (SELECT l_suppkey AS a, l_partkey AS b, count(*) AS n FROM lineitem GROUP BY ALL), d AS (SELECT a, count(*) AS n FROM e GROUP BY 1) SELECT b, count(*) AS degree, round(pow(count(*), 0.2) * pow(avg(d.n), 0.8), 6) AS score FROM e JOIN d USING (a) GROUP BY 1")
def q_degree_geometric(spark: SparkSession, d: str) -> DataFrame:
    e = graph.edges(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", "l_quantity")
    return graph.degree_centrality(e, 0.8, "b", geometric=True).select("b", "degree", F.round("score", 6).alias("score"))


_RANKS = """WITH e AS (SELECT l_suppkey AS a, l_partkey AS b, count(*) AS n, avg(l_quantity) / 50 AS p, avg((l_returnflag = 'R')::INT) AS w FROM lineitem GROUP BY ALL),
x AS (SELECT a, b, n * (0.7 + 0.3 * (0.5 + p)) / sum(n) OVER (PARTITION BY a) AS wa, n * (0.7 + 0.3 * (1.5 - p + 0.3 * w)) / sum(n) OVER (PARTITION BY b) AS wb FROM e),
c AS (SELECT count(DISTINCT a) AS na, count(DISTINCT b) AS nb FROM e),
a1 AS (SELECT a, r / sum(r) OVER () AS r FROM (SELECT a, 0.15 / any_value(na) + 0.85 * sum(wa / nb) AS r FROM x, c GROUP BY 1)),
b1 AS (SELECT b, r / sum(r) OVER () AS r FROM (SELECT b, 0.15 / any_value(nb) + 0.85 * sum(wb / na) AS r FROM x, c GROUP BY 1)),
a2 AS (SELECT a, 0.15 / any_value(na) + 0.85 * sum(wa * r) AS r FROM x JOIN b1 USING (b), c GROUP BY 1),
b2 AS (SELECT b, 0.15 / any_value(nb) + 0.85 * sum(wb * r) AS r FROM x JOIN a1 USING (a), c GROUP BY 1)
SELECT 'batter' AS role, a AS id, round(r / sum(r) OVER (), 8) AS rank FROM a2 UNION ALL SELECT 'bowler', b, round(r / sum(r) OVER (), 8) FROM b2"""


@query(_RANKS)
def q_performance_pagerank(spark: SparkSession, d: str) -> DataFrame:
    """Two normalised steps, weighed by performance, economy and wickets."""
    e = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.count("*").alias("n"), (F.avg("l_quantity") / 50).alias("performance"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("wickets"))
    a, b = graph.performance_pagerank(e, steps=2, tolerance=0.0)
    row = lambda x, k, role: x.select(F.lit(role).alias("role"), F.col(k).alias("id"), F.round("rank", 8).alias("rank"))
    return row(a, "a", "batter").unionByName(row(b, "b", "bowler"))


_BALLS = "b AS (SELECT user_id, event_id, value, (event_type = 'error')::INT AS w, (value < 5 AND event_type <> 'error')::INT AS dot, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"


@query(f"WITH {_BALLS}, o AS (SELECT user_id, (rn - 1) // 6 AS ov, sum(value) AS r, sum(w) AS w FROM b GROUP BY ALL), oo AS (SELECT user_id, ov, CASE WHEN ov >= 2 THEN sum(r) OVER x ELSE 0 END AS r3, CASE WHEN ov >= 2 THEN sum(w) OVER x ELSE 0 END AS w3 FROM o WINDOW x AS (PARTITION BY user_id ORDER BY ov ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT event_id, round(CASE WHEN rn >= 12 THEN sum(value) OVER y ELSE 0 END, 4) AS runs_last_12, (CASE WHEN rn >= 12 THEN sum(dot) OVER y ELSE 0 END)::BIGINT AS dots_last_12, (CASE WHEN rn >= 12 THEN sum(w) OVER y ELSE 0 END)::BIGINT AS wickets_last_12, round(r3, 4) AS runs_last_3_overs, w3::BIGINT AS wickets_last_3_overs, round(r3 / 3, 4) AS rr_last_3_overs FROM b JOIN oo ON oo.user_id = b.user_id AND oo.ov = (b.rn - 1) // 6 WINDOW y AS (PARTITION BY b.user_id ORDER BY rn ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def q_rolling_features(spark: SparkSession, d: str) -> DataFrame:
    """Runs, dot balls and wickets of the last balls and of the last overs; 0 until the window is full."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    b = table(spark, d, "events").select("user_id", "event_id", "ts", "value", (F.col("event_type") == "error").cast("int").alias("w"), ((F.col("value") < 5) & (F.col("event_type") != "error")).cast("int").alias("dot"))
    last = lambda c: windows.full_rolling_sum(F.col(c), w, 12)
    b = b.select("*", last("value").alias("r12"), last("dot").alias("d12"), last("w").alias("w12"), F.floor((F.row_number().over(w) - 1) / 6).alias("ov"))
    overs = Window.partitionBy("user_id").orderBy("ov")
    o = b.groupBy("user_id", "ov").agg(F.sum("value").alias("r"), F.sum("w").alias("ow"))
    o = o.select("user_id", "ov", windows.full_rolling_sum(F.col("r"), overs, 3).alias("r3"), windows.full_rolling_sum(F.col("ow"), overs, 3).alias("w3"))
    return b.join(o, ["user_id", "ov"]).select("event_id", F.round("r12", 4).alias("runs_last_12"), F.col("d12").cast("long").alias("dots_last_12"), F.col("w12").cast("long").alias("wickets_last_12"), F.round("r3", 4).alias("runs_last_3_overs"), F.col("w3").cast("long").alias("wickets_last_3_overs"), F.round(F.col("r3") / 3, 4).alias("rr_last_3_overs"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN w = 0 OR b = 0 THEN 0 ELSE least(1, greatest(0, pow(b / 30.0, 0.85) * pow(w / 10.0, 1.1))) END, 6) AS left_over FROM (SELECT *, greatest(0, l_quantity - 10) AS b, least(10, greatest(0, 2 * l_linenumber - 3)) AS w FROM lineitem)")
def q_projection_resource(spark: SparkSession, d: str) -> DataFrame:
    left = fx.resource(F.col("l_quantity") - 10, 2 * F.col("l_linenumber") - 3, 30, 0.85, 1.1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(left, 6).alias("left_over"))


@query("WITH p AS (SELECT o_orderpriority, o_totalprice / 100000 AS y, greatest(0.1, o_custkey % 40 / 10.0) AS m, least(0.99, greatest(0.01, o_totalprice / 400000)) AS p, (o_orderstatus = 'F')::INT AS won, o_orderkey % 5 + 1 AS w FROM orders) SELECT o_orderpriority, round(avg(abs(y - m)), 6) AS mae, round(avg(m - y * ln(m)), 6) AS poisson, round(sum(w * -(won * ln(p) + (1 - won) * ln(1 - p))) / sum(w), 6) AS log_loss FROM p GROUP BY 1")
def q_losses(spark: SparkSession, d: str) -> DataFrame:
    """Absolute error, Poisson loss and weighted log-loss by group."""
    rows = table(spark, d, "orders").select("o_orderpriority", (F.col("o_totalprice") / 100000).alias("y"), F.greatest(F.lit(0.1), F.col("o_custkey") % 40 / 10).alias("m"), F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("o_totalprice") / 400000)).alias("p"), (F.col("o_orderstatus") == "F").cast("int").alias("won"), (F.col("o_orderkey") % 5 + 1).alias("w"))
    loss = fx.log_loss(F.col("won"), F.col("p"))
    return rows.groupBy("o_orderpriority").agg(F.round(F.avg(F.abs(F.col("y") - F.col("m"))), 6).alias("mae"), F.round(F.avg(fx.poisson_loss(F.col("y"), F.col("m"))), 6).alias("poisson"), F.round(F.sum(F.col("w") * loss) / F.sum("w"), 6).alias("log_loss"))


@query("SELECT l_returnflag, " + ", ".join(f"count(*) FILTER (l_linestatus = '{s}') AS n_{s}, round(sum(l_quantity) FILTER (l_linestatus = '{s}'), 2) AS runs_{s}" for s in "FO") + " FROM lineitem GROUP BY 1")
def q_pivot_values(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("runs"))
    return wide.select("l_returnflag", *(c for s in "FO" for c in (F.coalesce(f"{s}_n", F.lit(0)).alias(f"n_{s}"), F.col(f"{s}_runs").alias(f"runs_{s}"))))


@query("WITH u AS (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount FROM lineitem) ON l_quantity, l_extendedprice, l_discount INTO NAME metric VALUE v) SELECT metric, round(quantile_cont(v, 0.1), 4) AS p10, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.99), 4) AS p99 FROM u GROUP BY 1")
def q_percentiles_by_metric(spark: SparkSession, d: str) -> DataFrame:
    long = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount").unpivot([], ["l_quantity", "l_extendedprice", "l_discount"], "metric", "v")
    out = windows.exact_percentiles(long, "metric", "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99})
    return out.select("metric", *(F.round(c, 4).alias(c) for c in ("p10", "p50", "p99")))


@query("SELECT o_custkey % 50 AS club, round(stddev_samp(o_totalprice), 4) AS sd, round(median(o_totalprice), 4) AS middle FROM orders GROUP BY 1 HAVING count(*) >= 25")
def q_spread_min_group(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("club"), "o_totalprice")
    big = rows.groupBy("club").agg(F.count("*").alias("n"), F.round(F.stddev_samp("o_totalprice"), 4).alias("sd")).where("n >= 25").drop("n")
    return big.join(windows.exact_percentiles(rows, "club", "o_totalprice", {"middle": 0.5}), "club").select("club", "sd", F.round("middle", 4).alias("middle"))


@query("SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY points DESC, wins DESC, c_custkey) AS position FROM (SELECT n_regionkey, c_custkey, count(*) FILTER (o_orderstatus = 'F') * 2 + count(*) FILTER (o_orderstatus = 'P') AS points, count(*) FILTER (o_orderstatus = 'F') AS wins FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)")
def q_standings(spark: SparkSession, d: str) -> DataFrame:
    home = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey")
    played = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus").join(home, "c_custkey")
    status = F.col("o_orderstatus")
    return windows.standings(played, "n_regionkey", "c_custkey", F.when(status == "F", 2).when(status == "P", 1).otherwise(0), (status == "F").cast("int"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 50")
def q_seeded_order(spark: SparkSession, d: str) -> DataFrame:
    """A draw of rows that a seed fixes, whatever the partitions."""
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").orderBy(F.md5(F.concat(F.lit("7:"), F.col("o_orderkey").cast("string"))), "o_orderkey").limit(50)


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 6 MONTH GROUP BY 1")
def q_recent_months(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate")
    last = o.agg((F.max("o_orderdate") - F.expr("INTERVAL '6' MONTH")).alias("cut"))  # one row
    return o.join(F.broadcast(last), F.col("o_orderdate") >= F.col("cut")).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, count(*) AS n, CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' ELSE '?' END AS short, string_agg(event_id || '=' || printf('%.2f', value), ',' ORDER BY event_id) AS pairs FROM events GROUP BY 1, 2")
def q_nested(spark: SparkSession, d: str) -> DataFrame:
    """Map lookup, zipped arrays and lists of structs."""
    short = F.create_map(F.lit("click"), F.lit("c"), F.lit("view"), F.lit("v"))
    rows = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("x"))
    zipped = F.arrays_zip(F.col("x.event_id").alias("i"), F.col("x.value").alias("v"))
    return rows.select("user_id", "event_type", "n", F.coalesce(F.try_element_at(short, F.col("event_type")), F.lit("?")).alias("short"), F.array_join(F.transform(zipped, lambda z: F.concat(z["i"].cast("string"), F.lit("="), F.format_string("%.2f", z["v"]))), ",").alias("pairs"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'economy|promo') THEN 1 WHEN lower(p_type) LIKE '%standard%' THEN 2 ELSE 3 END AS tier FROM part")
def q_event_tiers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", fx.event_tier(F.col("p_type"), {1: ["Economy", "Promo"], 2: ["Standard"]}).alias("tier"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND lower(o_orderpriority) LIKE '%high%' AND o_totalprice >= 50000")
def q_where_given(spark: SparkSession, d: str) -> DataFrame:
    """Conditions that are given, and some that are not."""
    out = tables.where_given(table(spark, d, "orders"), equals={"o_orderstatus": ["F", "O"], "o_custkey": None}, contains={"o_orderpriority": "High"}, since={"o_totalprice": 50000}, until={"o_orderdate": None})
    return out.select("o_orderkey", "o_custkey")


_CHANGES = "ch AS (SELECT c_custkey, max(o_totalprice) AS c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY 1)"


@query(f"WITH {_CHANGES} SELECT c.c_custkey, c.c_name, coalesce(ch.c_acctbal, c.c_acctbal) AS c_acctbal FROM customer c LEFT JOIN ch USING (c_custkey)")
def q_update_from(spark: SparkSession, d: str) -> DataFrame:
    changes = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return tables.update_from(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), changes, ["c_custkey"], ["c_acctbal"])


_TWO = "b AS (SELECT o_orderkey // 2 AS k, max(o_totalprice) AS v, 1 AS version FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1), i AS (SELECT o_orderkey // 2 AS k, min(o_totalprice) AS v, 2 AS version FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)"


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 2).alias("k"), "o_orderkey", "o_totalprice")
    base = o.where("o_orderkey % 3 <> 0").groupBy("k").agg(F.max("o_totalprice").alias("v")).withColumn("version", F.lit(1))
    return base, o.where("o_orderkey % 3 = 0").groupBy("k").agg(F.min("o_totalprice").alias("v")).withColumn("version", F.lit(2))


@query(f"WITH {_TWO} SELECT k, arg_max(v, version) AS v, max(version) AS version FROM (SELECT * FROM b UNION ALL SELECT * FROM i) GROUP BY 1")
def q_upsert(spark: SparkSession, d: str) -> DataFrame:
    return tables.latest_wins(*_two(spark, d), ["k"], ["version"])


@query(f"WITH {_TWO} SELECT * FROM b UNION ALL SELECT * FROM i WHERE k NOT IN (SELECT k FROM b)")
def q_insert_new(spark: SparkSession, d: str) -> DataFrame:
    return tables.insert_new(*_two(spark, d), ["k"])


@query(f"WITH {_TWO} SELECT * FROM b WHERE k NOT IN (SELECT k FROM i)")
def q_delete_keys(spark: SparkSession, d: str) -> DataFrame:
    base, gone = _two(spark, d)
    return tables.delete_keys(base, gone, ["k"])


@query("WITH p AS (SELECT o_orderkey, o_orderdate, o_totalprice > 150000 AS said, o_orderstatus = 'F' AS was FROM orders WHERE o_orderstatus <> 'P') SELECT year(o_orderdate)::INT AS year, count(*) AS n, count(*) FILTER (said = was) AS right_ones, round(avg((said = was)::INT), 6) AS accuracy FROM p GROUP BY 1")
def q_prediction_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Predictions against what came, by year; undecided ones wait."""
    p = table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderdate", ((F.col("o_totalprice") > 150000) == (F.col("o_orderstatus") == "F")).alias("ok"))
    return p.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.count_if("ok").alias("right_ones"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("accuracy"))


@query("SELECT (SELECT count(*) FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_custkey IS NULL AND o_custkey IS NOT NULL) AS orders_without_customer, (SELECT count(*) FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey WHERE o_custkey IS NULL) AS customers_without_order, (SELECT count(*) FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey IS NULL) AS lines_without_order, (SELECT count(*) FROM labels LEFT JOIN documents USING (doc_id) WHERE documents.doc_id IS NULL) AS labels_without_document")
def q_foreign_keys(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose key names nothing, for each reference."""

    def lost(rows: str, key: str, other: str, other_key: str, name: str) -> DataFrame:
        named = table(spark, d, other).select(F.col(other_key).alias("_o"))
        return table(spark, d, rows).select(F.col(key).alias("_k")).where("_k is not null").join(named, F.col("_k") == F.col("_o"), "left_anti").agg(F.count("*").alias(name))

    none = lost("customer", "c_custkey", "orders", "o_custkey", "customers_without_order")
    one, two, three = lost("orders", "o_custkey", "customer", "c_custkey", "orders_without_customer"), lost("lineitem", "l_orderkey", "orders", "o_orderkey", "lines_without_order"), lost("labels", "doc_id", "documents", "doc_id", "labels_without_document")
    return one.join(F.broadcast(two), F.lit(True)).join(F.broadcast(three), F.lit(True)).join(F.broadcast(none), F.lit(True))  # one row each


_PLAY = "p AS (SELECT event_id, user_id AS m, 1 + event_id % 2 AS i, ts, floor(value / 4)::BIGINT AS r, (event_type = 'error')::INT AS w FROM events), s AS (SELECT *, row_number() OVER o - 1 AS bowled, coalesce(sum(r) OVER (PARTITION BY m, i ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS score, coalesce(sum(w) OVER (PARTITION BY m, i ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS down, sum(r) FILTER (i = 1) OVER (PARTITION BY m) + 1 AS t FROM p WINDOW o AS (PARTITION BY m, i ORDER BY ts, event_id)), k AS (SELECT *, greatest(120 - bowled, 0) AS balls_left, greatest(10 - down, 0) AS in_hand, CASE WHEN i = 2 THEN t END AS target, CASE WHEN i = 2 THEN greatest(t - score, 0) END AS needed FROM s)"


def _play(spark: SparkSession, d: str) -> DataFrame:
    """Events as two innings of each user."""
    e = table(spark, d, "events")
    return e.select("event_id", F.col("user_id").alias("m"), (1 + F.col("event_id") % 2).alias("i"), "ts", F.floor(F.col("value") / 4).alias("r"), (F.col("event_type") == "error").cast("int").alias("w"))


@query(f"WITH {_PLAY} SELECT event_id, bowled, score, down, balls_left, in_hand, round(score * 6 / nullif(bowled, 0), 6) AS run_rate, target::BIGINT AS target, needed, round(needed * 6 / nullif(balls_left, 0), 6) AS asked_rate, coalesce(i IN (2, 4) AND balls_left > 0 AND needed * 6 > balls_left * 10, false) AS high_chase FROM k")
def q_ball_state(spark: SparkSession, d: str) -> DataFrame:
    """The state before each ball and what a chase asks for."""
    out = innings.ball_state(_play(spark, d), "m", "i", ["ts", "event_id"], "r", "w", 120)
    chase = innings.high_chase(F.col("i"), F.col("needed"), F.col("balls_left"))
    return out.select("event_id", "bowled", "score", "down", "balls_left", "in_hand", F.round("run_rate", 6).alias("run_rate"), F.col("target").cast("long").alias("target"), "needed", F.round("asked_rate", 6).alias("asked_rate"), chase.alias("high_chase"))


@query("WITH s AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT y, sum(n) OVER (ORDER BY y DESC) - n AS later, sum(n) OVER () AS every FROM s) SELECT o_orderkey, CASE WHEN later < every * 0.25 THEN 'test' ELSE 'train' END AS part FROM orders JOIN p ON year(o_orderdate) = y")
def q_season_split(spark: SparkSession, d: str) -> DataFrame:
    return innings.by_season(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 0.25).select("o_orderkey", "part")


@query("WITH g AS (SELECT a / 4.0 AS a, b / 4.0 AS b FROM range(1, 6) t(a), range(0, 5) u(b)), e AS (SELECT l_returnflag, a, b, avg(pow(l_extendedprice / 1000 - a * l_quantity - b * l_linenumber, 2)) AS e FROM lineitem, g GROUP BY ALL) SELECT l_returnflag, a, b, round(e, 9) AS loss FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY round(e, 9), a, b) AS rn FROM e) WHERE rn = 1")
def q_projection_fit(spark: SparkSession, d: str) -> DataFrame:
    """The best of a grid of parameters for each segment."""
    grid = spark.range(1, 6).select((F.col("id") / 4.0).alias("a")).crossJoin(spark.range(0, 5).select((F.col("id") / 4.0).alias("b")))  # 25 rows
    loss = F.pow(F.col("l_extendedprice") / 1000 - F.col("a") * F.col("l_quantity") - F.col("b") * F.col("l_linenumber"), F.lit(2))
    return models.best_setting(table(spark, d, "lineitem"), "l_returnflag", grid, loss)


@query()
def q_elo_losses(spark: SparkSession, d: str) -> DataFrame:
    """Log-loss of pair ratings over all orders under a grid of steps and home edges."""
    m = table(spark, d, "orders").select("o_orderdate", "o_orderkey", F.col("o_custkey").alias("home"), (-1 - F.col("o_custkey") % 7).alias("away"), (F.col("o_totalprice") > 100000).cast("double").alias("won"))
    return ratings.elo_losses(m, ["o_orderdate", "o_orderkey"], "home", "away", "won", [(k, e) for k in (8, 16, 24, 32) for e in (0, 40)])


@query()
def q_boosted_outcome(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees for the return flag of a line, scored on every line."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", F.unix_date(F.to_date("l_shipdate")).cast("double").alias("day"), F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("flag"))
    features = ["l_quantity", "l_extendedprice", "l_discount", "day"]
    scored = models.score_boosted(models.fit_boosted(rows, features, "flag", 3, rounds=3, depth=3), rows)
    return models.metrics(scored, "flag", ["flag"])


@query("SELECT l_orderkey, " + ", ".join(f"coalesce(sum(l_quantity) FILTER (l_linenumber = {i}), 0)::DOUBLE AS total_{i}" for i in range(1, 5)) + ", (" + " ".join(f"{'+' if i % 2 else '-'} coalesce(sum(l_quantity) FILTER (l_linenumber = {i}), 0)" for i in range(1, 5)) + ")::DOUBLE AS lead FROM lineitem GROUP BY 1")
def q_innings_pivot(spark: SparkSession, d: str) -> DataFrame:
    return innings.pivoted_totals(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity")


@query()
def q_chase_model(spark: SparkSession, d: str) -> DataFrame:
    """Chances of a chase at every ball, each match scored by a model that has not seen it."""
    rows = innings.chase_rows(_play(spark, d), "m", "i", ["ts", "event_id"], "r", "w", 120)
    scored = models.out_of_fold(rows, "m", ["needed", "balls_left", "in_hand", "run_rate", "asked_rate"], "won", 2, rounds=10)
    return models.metrics(scored, "won", ["fold"])


@query()
def q_test_match_model(spark: SparkSession, d: str) -> DataFrame:
    """Win, loss and draw of matches of up to four innings, with the venue's shrunk rate of draws."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 30).alias("venue"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("result"))
    at = o.groupBy("venue").agg(F.count_if(F.col("result") == 2).alias("x"), F.count("*").alias("n"))
    prior = at.agg((F.sum("x") / F.sum("n")).alias("prior"))  # one row
    at = at.join(F.broadcast(prior), F.lit(True)).select("venue", ((F.col("x") + 20 * F.col("prior")) / (F.col("n") + 20)).alias("draws"))
    wide = innings.pivoted_totals(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity").withColumnRenamed("l_orderkey", "o_orderkey")
    scored = models.out_of_fold(o.join(wide, "o_orderkey").join(at, "venue"), "o_orderkey", ["total_1", "total_2", "total_3", "total_4", "lead", "draws"], "result", 2, rounds=10)
    return models.metrics(scored, "result", ["fold"])
