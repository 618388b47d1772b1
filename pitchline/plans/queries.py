"""Registered queries of the analytics operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchline.functions import formulas as fx
from pitchline.operators import asof, graph, ratings, windows
from pitchline.sources.tables import new_rows, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority ILIKE '%urgent%' AND o_totalprice BETWEEN 1000 AND 200000 AND o_custkey NOT IN (5) ")
def q_filter_conjunction(spark: SparkSession, d: str) -> DataFrame:
    keep = [F.col("o_orderstatus") == "F", F.col("o_orderpriority").ilike("%urgent%"), F.col("o_totalprice").between(1000, 200000), ~F.col("o_custkey").isin(5)]
    out = table(spark, d, "orders")
    for k in keep:
        out = out.where(k)
    return out.select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT l_suppkey, s_name, count(*) AS balls, sum(l_quantity)::DOUBLE AS runs, count(*) FILTER (l_returnflag = 'R') AS outs, round(sum(l_quantity) / nullif(count(*) FILTER (l_returnflag = 'R'), 0), 4) AS average FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL HAVING count(*) >= 20")
def q_entity_stats(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("balls"), F.sum("l_quantity").alias("runs"), F.count_if(F.col("l_returnflag") == "R").alias("outs")).where("balls >= 20")
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return per.join(names, "l_suppkey", "left").select("l_suppkey", "s_name", "balls", "runs", "outs", F.round(fx.rate(F.col("runs"), F.nullif(F.col("outs"), F.lit(0))), 4).alias("average"))


@query("SELECT l_suppkey, l_partkey, count(*) AS n, sum(l_quantity)::DOUBLE AS runs, coalesce(round(avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 4), 0) AS avg_returned FROM lineitem GROUP BY ALL")
def q_matchup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("runs"), F.coalesce(F.round(F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))), 4), F.lit(0.0)).alias("avg_returned"))


@query("SELECT l_suppkey, count(DISTINCT l_orderkey) AS orders, count(DISTINCT (l_partkey, l_linenumber)) AS slots FROM lineitem GROUP BY 1")
def q_team_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_partkey", "l_linenumber").alias("slots"))


@query("WITH i AS (SELECT l_orderkey, l_linestatus, sum(l_quantity) AS t FROM lineitem GROUP BY ALL) SELECT l_linestatus, count(*) AS innings, round(avg(t), 4) AS mean_total, max(t)::DOUBLE AS best FROM i GROUP BY 1")
def q_venue_two_level(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.sum("l_quantity").alias("t")).groupBy("l_linestatus").agg(F.count("*").alias("innings"), F.round(F.avg("t"), 4).alias("mean_total"), F.max("t").alias("best"))


@query("SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderdate DESC, o_orderkey DESC) AS form FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 5 GROUP BY 1")
def q_form_string(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    top = table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    ordered = F.array_sort(F.collect_list(F.struct("rn", "o_orderstatus")))
    return top.groupBy("o_custkey").agg(F.array_join(F.transform(ordered, lambda x: x["o_orderstatus"]), "").alias("form"))


@query("SELECT n_regionkey, s.n AS suppliers, c.n AS customers FROM (SELECT n_regionkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) s FULL JOIN (SELECT n_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) c USING (n_regionkey)")
def q_full(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    per = lambda t, k, name: table(spark, d, t).join(n, F.col(k) == n.n_nationkey).groupBy("n_regionkey").agg(F.count("*").alias(name))
    return per("supplier", "s_nationkey", "suppliers").join(per("customer", "c_nationkey", "customers"), "n_regionkey", "full")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def q_semi(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_totalprice > 100000")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def q_incremental_anti(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return new_rows(table(spark, d, "customer").select("c_custkey"), known, "c_custkey")


@query("SELECT l_orderkey, l_linenumber, coalesce((SELECT sum(p.l_quantity) FROM lineitem p WHERE p.l_orderkey = l.l_orderkey AND p.l_linenumber < l.l_linenumber), 0)::DOUBLE AS before FROM lineitem l")
def q_theta_prior_sum(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(Window.unboundedPreceding, -1)
    return lines.select("l_orderkey", "l_linenumber", F.coalesce(F.sum("l_quantity").over(w), F.lit(0.0)).alias("before"))


@query("SELECT event_id, (SELECT max(o_totalprice) FROM orders o WHERE o_custkey = user_id AND o_orderdate = (SELECT max(o_orderdate) FROM orders p WHERE p.o_custkey = user_id AND p.o_orderdate < ts)) AS last_price FROM events")
def q_asof_latest(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", F.col("user_id").alias("k"), "ts")
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate", "o_totalprice")
    return asof.asof_before(events, orders, "k", "ts", "o_orderdate", F.col("o_totalprice"), "last_price").select("event_id", "last_price")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def q_latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return windows.latest(table(spark, d, "events").select("user_id", "event_id", "value", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS prior_avg FROM orders")
def q_running_excl_current(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.round(windows.running_before(F.col("o_totalprice"), w), 6).alias("prior_avg"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN row_number() OVER w >= 3 THEN sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) ELSE 0 END::DOUBLE AS last3 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)")
def q_rolling_full(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", windows.full_rolling_sum(F.col("l_quantity"), w, 3).alias("last3"))


@query("SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS diff FROM events")
def q_lag_diff(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("diff"))


@query("SELECT c_custkey, round((rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2) / count(*) OVER () * 100, 6) AS pct FROM customer")
def q_avg_rank_pct(spark: SparkSession, d: str) -> DataFrame:
    return windows.average_rank_percent(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey").select("c_custkey", F.round("pct", 6).alias("pct"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
def q_topk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(20)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def q_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events")
def q_intersect_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, d, "events").select("user_id"))


@query("SELECT p_partkey, lower(replace(p_name, ' ', '_')) || '_' || p_size AS team_id, CASE WHEN p_size < 6 THEN 'powerplay' WHEN p_size < 16 THEN 'middle' ELSE 'death' END AS phase, (p_size // 10 * 6 + least(p_size % 10, 6))::BIGINT AS balls FROM part")
def q_scalar_library(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.concat_ws("_", F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))), size.cast("string")).alias("team_id"), fx.phase(size).alias("phase"), fx.overs_to_balls(size / 10).alias("balls"))


@query("WITH RECURSIVE s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), r AS (SELECT user_id, i, 0.9 * 10.0::DOUBLE + 0.1::DOUBLE * value AS ema FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.i, 0.9::DOUBLE * r.ema + 0.1::DOUBLE * s.value FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1) SELECT user_id, max(i) AS n, round(arg_max(ema, i), 6) AS ema FROM r GROUP BY 1")
def q_ema_fold(spark: SparkSession, d: str) -> DataFrame:
    out = ratings.ema_fold(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 0.1, 10.0)
    return out.select("user_id", "n", F.round("ema", 6).alias("ema"))


@query()
def q_elo_pair(spark: SparkSession, d: str) -> DataFrame:
    """Coupled ratings of customers and their order's priority class, by status."""
    m = table(spark, d, "orders").select("o_orderstatus", "o_orderdate", "o_orderkey", F.col("o_custkey").alias("home"), (-F.crc32("o_orderpriority")).cast("long").alias("away"), (F.col("o_totalprice") > 100000).cast("double").alias("won"))
    return ratings.elo_scan(m, "o_orderstatus", ["o_orderdate", "o_orderkey"], "home", "away", "won")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity + 0.8 * 50 * r + 0.3 * l_quantity * r / nullif(1 - r, 0), 4) AS projected FROM (SELECT *, pow((l_linenumber + 1) / 10.0, 1.2) * pow(0.5, 0.7) AS r FROM lineitem)")
def q_projection(spark: SparkSession, d: str) -> DataFrame:
    p = fx.projection(F.col("l_quantity"), F.col("l_linenumber") + 1, F.lit(5.0), 10, 50.0, 0.8, 0.3, 1.2, 0.7)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(p, 4).alias("projected"))


@query("SELECT o_orderkey, round(greatest(0.5, least(2.5, pow(abs(o_totalprice / 1000) + 5, 0.7) / greatest(1.0, 10 + 0.004 * o_custkey))), 6) AS g, round(1 / (1 + pow(10.0, (1400 - o_totalprice / 100) / 400)), 6) AS e FROM orders")
def q_mov(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.round(fx.margin_of_victory(price / 1000, F.col("o_custkey")), 6).alias("g"), F.round(fx.expected_score(price / 100, F.lit(1400.0)), 6).alias("e"))


@query("SELECT l_returnflag, round(quantile_cont(l_quantity, 0.25), 4) AS p25, round(quantile_cont(l_quantity, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(stddev_samp(l_quantity), 4) AS sd, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def q_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    long = rows.unpivot(["l_returnflag"], ["l_quantity", "l_extendedprice"], "metric", "v").select(F.struct("l_returnflag", "metric").alias("g"), "v")
    every = windows.exact_percentiles(long, "g", "v", {"p25": 0.25, "p50": 0.5, "p90": 0.9}).select("g.*", "p25", "p50", "p90")
    of = lambda c, metric: F.max(F.when(F.col("metric") == metric, F.col(c))).alias(c)
    both = every.groupBy("l_returnflag").agg(of("p25", "l_quantity"), of("p50", "l_quantity"), of("p90", "l_extendedprice"))
    rest = rows.groupBy("l_returnflag").agg(F.round(F.stddev_samp("l_quantity"), 4).alias("sd"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))
    return rest.join(both, "l_returnflag").select("l_returnflag", *(F.round(c, 4).alias(c) for c in ("p25", "p50", "p90")), "sd", "r")


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1")
def q_pivot_wide(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count()
    return wide.select("l_returnflag", F.coalesce("F", F.lit(0)).cast("long").alias("f"), F.coalesce("O", F.lit(0)).cast("long").alias("o"))


@query("WITH p AS (SELECT avg((l_returnflag = 'R')::INT) AS prior FROM lineitem) SELECT l_suppkey, round((count(*) FILTER (l_returnflag = 'R') + 10 * prior) / (count(*) + 10), 6) AS shrunk FROM lineitem, p GROUP BY l_suppkey, prior")
def q_shrunk_rate(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("x"), F.count("*").alias("n"))
    prior = per.agg((F.sum("x") / F.sum("n")).alias("prior"))  # one row
    return per.join(F.broadcast(prior), F.lit(True)).select("l_suppkey", F.round((F.col("x") + 10 * F.col("prior")) / (F.col("n") + 10), 6).alias("shrunk"))


@query("WITH p AS (SELECT quality, toxic, least(greatest(n_chars / 10000.0, 0.001), 0.999) AS p FROM labels JOIN documents USING (doc_id)) SELECT count(*) AS n, round(sqrt(avg(pow(p - quality, 2))), 6) AS rmse, round(-avg(quality * ln(p) + (1 - quality) * ln(1 - p)), 6) AS log_loss, round(avg(pow(p - quality, 2)), 6) AS brier, round(avg(((p >= 0.5) = (quality = 1))::INT), 6) AS accuracy FROM p")
def q_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = rows.withColumn("p", F.least(F.greatest(F.col("n_chars") / 10000.0, F.lit(0.001)), F.lit(0.999)))
    q, p = F.col("quality"), F.col("p")
    return rows.agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.pow(p - q, F.lit(2)))), 6).alias("rmse"), F.round(-F.avg(q * F.ln(p) + (1 - q) * F.ln(1 - p)), 6).alias("log_loss"), F.round(F.avg(F.pow(p - q, F.lit(2))), 6).alias("brier"), F.round(F.avg(((p >= 0.5) == (q == 1)).cast("int")), 6).alias("accuracy"))


@query("WITH e AS (SELECT l_suppkey AS a, l_partkey AS b FROM lineitem GROUP BY ALL), d AS (SELECT b, count(*) AS n FROM e GROUP BY 1) SELECT a, count(*) AS degree, round(0.5 * count(*) + 0.5 * avg(n), 6) AS score FROM e JOIN d USING (b) GROUP BY 1")
def q_degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    e = graph.edges(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", "l_quantity")
    return graph.degree_centrality(e).select("a", "degree", F.round("score", 6).alias("score"))


@query("WITH e AS (SELECT l_suppkey AS a, l_partkey AS b, count(*) AS n FROM lineitem GROUP BY ALL), pa AS (SELECT a, b, n / sum(n) OVER (PARTITION BY b) AS p FROM e), pb AS (SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS p FROM e), c AS (SELECT count(DISTINCT a) AS na, count(DISTINCT b) AS nb FROM e), b1 AS (SELECT b, 0.15 / any_value(nb) + 0.85 * sum(p / na) AS r FROM pb, c GROUP BY b) SELECT a, round(0.15 / any_value(na) + 0.85 * sum(p * r), 8) AS rank FROM pa JOIN b1 USING (b), c GROUP BY a")
def q_pagerank_k(spark: SparkSession, d: str) -> DataFrame:
    e = graph.edges(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", "l_quantity")
    return graph.pagerank(e, 2).select("a", F.round("rank", 8).alias("rank"))


@query("SELECT vec_id, round(list_dot_product(list_transform(embedding, lambda x: abs(x)::DOUBLE), list_transform(range(len(embedding)), lambda i: [0, 0, 1, 2, 3, 4, 6, 1][i % 8 + 1]::DOUBLE)) / list_sum(list_transform(embedding, lambda x: abs(x)::DOUBLE)), 6) AS expected FROM embeddings")
def q_probs_expected(spark: SparkSession, d: str) -> DataFrame:
    """The mean worth of classes whose weights are a vector's entries."""
    worth = F.array(*(F.lit(float(x)) for x in (0, 0, 1, 2, 3, 4, 6, 1)))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    weights = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    worths = F.transform("embedding", lambda x, i: F.abs(x.cast("double")) * F.get(worth, i % 8))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.try_divide(total(worths), total(weights)), 6).alias("expected"))


@query("SELECT entity, role, round(sum(credit), 4) AS credit FROM (SELECT l_suppkey AS entity, 'bowler' AS role, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS credit FROM lineitem UNION ALL SELECT l_partkey, 'batter', CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END FROM lineitem) GROUP BY ALL")
def q_credit(spark: SparkSession, d: str) -> DataFrame:
    sign = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    roles = F.explode(F.array(F.struct(F.col("l_suppkey").alias("entity"), F.lit("bowler").alias("role"), sign.alias("credit")), F.struct(F.col("l_partkey").alias("entity"), F.lit("batter").alias("role"), (-sign).alias("credit"))))
    return table(spark, d, "lineitem").select(roles.alias("r")).groupBy("r.entity", "r.role").agg(F.round(F.sum("r.credit"), 4).alias("credit"))


@query("SELECT event_type, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1")
def q_json_flatten(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.from_json("props", "k long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(parsed["k"]).alias("k"))


@query("SELECT count(*) AS n, count(*) FILTER (l_quantity IS NULL) AS nulls, count(*) FILTER (l_discount NOT BETWEEN 0 AND 1) AS out_of_range, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS duplicate_keys FROM lineitem")
def q_quality_checks(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity").isNull()).alias("nulls"), F.count_if(~F.col("l_discount").between(0, 1)).alias("bad"))
    return keys.agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.sum("bad").alias("out_of_range"), F.count_if(F.col("n") > 1).alias("duplicate_keys"))


@query()
def q_season_sim(spark: SparkSession, d: str) -> DataFrame:
    """Wins of each customer in 20 simulated seasons of its orders."""
    p = F.least(F.col("o_totalprice") / 300000, F.lit(0.95))
    played = table(spark, d, "orders").withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(20))))
    won = (fx.uniform(42, F.col("sim"), F.col("o_orderkey")) < p).cast("int")
    return played.groupBy("o_custkey", "sim").agg(F.sum(won).alias("wins")).groupBy("o_custkey").agg(F.avg("wins").alias("mean_wins"), F.max("wins").alias("most_wins"))
