"""Further registered queries: joins, sets, history, ranks, formulas, ratings, graph and attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchline.functions import formulas as fx
from pitchline.operators import asof, graph, models, ratings, simulate, teams, windows
from pitchline.sources.tables import table
from pitchline.streaming import ingest

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (1, 3)")
def q_country_in_lookup(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "nation").where(F.col("n_regionkey").isin(1, 3))
    return table(spark, d, "supplier").join(named, F.col("s_nationkey") == named.n_nationkey).select("s_suppkey", "n_name")


@query("SELECT least(c_nationkey, s_nationkey) AS first, greatest(c_nationkey, s_nationkey) AS second, count(*) AS meetings, count(*) FILTER (l_returnflag = 'R' AND c_nationkey <= s_nationkey) AS first_wins FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def q_head_to_head(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    home = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), "c_nationkey")
    away = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    met = lines.join(away, "l_suppkey").join(home, "l_orderkey")
    pair = [F.least("c_nationkey", "s_nationkey").alias("first"), F.greatest("c_nationkey", "s_nationkey").alias("second")]
    return met.groupBy(*pair).agg(F.count("*").alias("meetings"), F.count_if((F.col("l_returnflag") == "R") & (F.col("c_nationkey") <= F.col("s_nationkey"))).alias("first_wins"))


@query("SELECT o_orderkey, CASE WHEN regexp_matches(lower(o_orderpriority), 'urgent|high') THEN 'knockout' WHEN o_orderstatus = 'P' THEN 'no result' ELSE 'league' END AS stage FROM orders WHERE o_totalprice IS NULL OR NOT o_totalprice > 150000")
def q_outcome_flags(spark: SparkSession, d: str) -> DataFrame:
    stage = F.when(F.lower("o_orderpriority").rlike("urgent|high"), "knockout").when(F.col("o_orderstatus") == "P", "no result").otherwise("league")
    return table(spark, d, "orders").where(F.col("o_totalprice").isNull() | ~(F.col("o_totalprice") > 150000)).select("o_orderkey", stage.alias("stage"))


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
def q_inner(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_acctbal > 0")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == c.c_custkey).select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, h.n_name AS home, a.n_name AS away FROM customer LEFT JOIN nation h ON h.n_nationkey = c_nationkey LEFT JOIN nation a ON a.n_nationkey = c_custkey % 30")
def q_left_twice(spark: SparkSession, d: str) -> DataFrame:
    role = lambda k, name: table(spark, d, "nation").select(F.col("n_nationkey").alias(k), F.col("n_name").alias(name))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("h"), (F.col("c_custkey") % 30).alias("a"))
    return c.join(role("h", "home"), "h", "left").join(role("a", "away"), "a", "left").select("c_custkey", "home", "away")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.05)")
def q_anti(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_discount > 0.05").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_anti")


@query("SELECT o_orderkey, v AS previous FROM orders o ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_totalprice) AS v FROM orders GROUP BY ALL) p ON o.o_custkey = p.o_custkey AND o.o_orderdate > p.o_orderdate")
def q_asof_batch(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), "o_totalprice")
    return asof.asof_before(o.select("o_orderkey", "k", "at"), o, "k", "at", "at", F.col("o_totalprice"), "previous").select("o_orderkey", "previous")


@query("WITH s AS (SELECT DISTINCT o_orderpriority AS p, date_trunc('month', o_orderdate)::DATE AS first FROM orders) SELECT p, first, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM s JOIN orders ON o_orderpriority = p AND o_orderdate::DATE BETWEEN first AND first + 9 GROUP BY ALL")
def q_interval_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.to_date("o_orderdate").alias("day"), "o_totalprice")
    spans = o.select(F.col("p"), F.trunc("day", "month").alias("first")).distinct()
    met = asof.interval_join(o.alias("o"), spans, ["p"], "day", "first", 10)
    return met.groupBy(F.col("o.p").alias("p"), "first").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("WITH j AS (SELECT o.o_orderkey, (p.o_totalprice > 100000)::INT AS w, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY p.o_orderdate DESC, p.o_orderkey DESC) AS rn FROM orders o LEFT JOIN orders p ON p.o_custkey = o.o_custkey AND p.o_orderdate < o.o_orderdate) SELECT o_orderkey, round(avg(w), 6) AS form FROM j WHERE rn <= 5 GROUP BY 1")
def q_history_form(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", (F.col("o_totalprice") > 100000).cast("int").alias("won"))
    return windows.prior_mean(o, "o_custkey", "o_orderdate", "o_orderkey", F.col("won"), 5, "form").select("o_orderkey", F.round("form", 6).alias("form"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, count(*) OVER w AS meetings, coalesce(sum(l_quantity) OVER w, 0)::DOUBLE AS runs FROM lineitem WINDOW w AS (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate::DATE RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)")
def q_history_h2h(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey", "l_partkey").orderBy(F.unix_date(F.to_date("l_shipdate"))).rangeBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.count("*").over(w).alias("meetings"), F.coalesce(F.sum("l_quantity").over(w), F.lit(0.0)).alias("runs"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS a, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS b FROM events) WHERE a = 1 OR b = 1")
def q_two_row_numbers(spark: SparkSession, d: str) -> DataFrame:
    a = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    b = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id"))
    return table(spark, d, "events").withColumns({"a": a, "b": b}).where("a = 1 or b = 1").select("event_id", "user_id", "event_type")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events")
def q_cumulative(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("total"), F.row_number().over(w).cast("long").alias("nth"))


@query("SELECT o_orderkey, date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate)::INT AS rest_days FROM orders")
def q_shift_days(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).alias("rest_days"))


@query("WITH r AS (SELECT c_custkey, (rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2) / count(*) OVER () * 100 AS pct FROM customer) SELECT c_custkey, CASE WHEN pct >= 90 THEN 'elite' WHEN pct >= 60 THEN 'strong' WHEN pct >= 30 THEN 'average' ELSE 'developing' END AS tier FROM r")
def q_tiers(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("pct")
    tier = F.when(p >= 90, "elite").when(p >= 60, "strong").when(p >= 30, "average").otherwise("developing")
    return windows.average_rank_percent(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey").select("c_custkey", tier.alias("tier"))


@query("SELECT c_custkey, ntile(5) OVER (ORDER BY c_acctbal, c_custkey) AS tile FROM customer")
def q_ntile(spark: SparkSession, d: str) -> DataFrame:
    return windows.global_ntile(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], 5).select("c_custkey", "tile")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 3")
def q_topk_tie(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", F.row_number().over(w).alias("rn")).where("rn <= 3").drop("rn")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def q_offset(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)


@query("SELECT s_nationkey AS k, 'supplier' AS role, count(*) AS n FROM supplier GROUP BY 1 UNION ALL SELECT c_nationkey, 'customer', count(*) FROM customer GROUP BY 1")
def q_union_all_role(spark: SparkSession, d: str) -> DataFrame:
    per = lambda t, k: table(spark, d, t).groupBy(F.col(k).alias("k")).agg(F.lit(t).alias("role"), F.count("*").alias("n"))
    return per("supplier", "s_nationkey").unionByName(per("customer", "c_nationkey"))


@query("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def q_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT user_id FROM events")
def q_except_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "events").select("user_id"))


@query("SELECT p_partkey, regexp_extract(t, '^(.*)_([^_]+)_([^_]+)$', 1) AS team, regexp_extract(t, '^(.*)_([^_]+)_([^_]+)$', 2) AS gender, regexp_extract(t, '^(.*)_([^_]+)_([^_]+)$', 3) AS format FROM (SELECT p_partkey, lower(replace(p_name, ' ', '_')) || CASE WHEN p_size % 2 = 0 THEN '_male_t20' ELSE '_female_odi' END AS t FROM part)")
def q_parse_team_id(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers are read from the right: names may hold underscores themselves."""
    made = F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))), F.when(F.col("p_size") % 2 == 0, "_male_t20").otherwise("_female_odi"))
    return table(spark, d, "part").select("p_partkey", made.alias("t")).select("p_partkey", *(F.regexp_extract("t", "^(.*)_([^_]+)_([^_]+)$", i).alias(n) for i, n in ((1, "team"), (2, "gender"), (3, "format"))))


@query("WITH u AS (SELECT 'o_orderstatus' AS attribute, o_orderstatus AS v FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders), c AS (SELECT attribute, v, count(*) AS n FROM u GROUP BY ALL) SELECT attribute, v AS modal, n FROM (SELECT *, row_number() OVER (PARTITION BY attribute ORDER BY n DESC, v DESC) AS rn FROM c) WHERE rn = 1")
def q_unpivot_mode(spark: SparkSession, d: str) -> DataFrame:
    long = table(spark, d, "orders").unpivot([], ["o_orderstatus", "o_orderpriority"], "attribute", "v")
    return long.groupBy("attribute", "v").agg(F.count("*").alias("n")).groupBy("attribute").agg(F.max_by("v", F.struct("n", "v")).alias("modal"), F.max("n").alias("n"))


@query("WITH s AS (SELECT DISTINCT s_nationkey AS k, l_partkey AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), z AS (SELECT k, count(*) AS n FROM s GROUP BY 1) SELECT a.k AS a, b.k AS b, round(count(*) / (any_value(za.n) + any_value(zb.n) - count(*)), 6) AS jaccard FROM s a JOIN s b ON a.v = b.v AND a.k < b.k JOIN z za ON za.k = a.k JOIN z zb ON zb.k = b.k GROUP BY ALL")
def q_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of the nations' sets of parts; a part meets at most the 25 nations."""
    nation = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("k"))
    s = table(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("v")).join(nation, "l_suppkey").select("k", "v").distinct()
    size = s.groupBy("k").agg(F.count("*").alias("n"))
    common = s.withColumnRenamed("k", "a").join(s.withColumnRenamed("k", "b"), "v").where("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    out = common.join(size.select(F.col("k").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("k").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", F.round(F.col("c") / (F.col("na") + F.col("nb") - F.col("c")), 6).alias("jaccard"))


@query("WITH m AS (SELECT c_nationkey AS k, date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT a.k AS a, b.k AS b, count(*) AS months, round(corr(a.x, b.x), 6) AS r FROM m a JOIN m b ON a.m = b.m AND a.k < b.k GROUP BY ALL HAVING count(*) >= 5")
def q_correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("k"))
    m = table(spark, d, "orders").join(c, "o_custkey").groupBy("k", F.date_trunc("month", "o_orderdate").alias("m")).agg(F.sum("o_totalprice").alias("x"))
    a, b = m.select("m", F.col("k").alias("a"), F.col("x").alias("xa")), m.select("m", F.col("k").alias("b"), F.col("x").alias("xb"))
    return a.join(b, "m").where("a < b").groupBy("a", "b").agg(F.count("*").alias("months"), F.round(F.corr("xa", "xb"), 6).alias("r")).where("months >= 5")


@query("WITH RECURSIVE s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), a AS (SELECT *, 0.02 + 0.18 * exp(-i / 10) AS g FROM s), r AS (SELECT user_id, i, (1 - g) * 10 + g * value AS e FROM a WHERE i = 0 UNION ALL SELECT a.user_id, a.i, (1 - g) * r.e + g * a.value FROM r JOIN a ON a.user_id = r.user_id AND a.i = r.i + 1) SELECT user_id, count(*) AS n, round(arg_max(e, i), 6) AS ema FROM r GROUP BY 1")
def q_adaptive_alpha(spark: SparkSession, d: str) -> DataFrame:
    out = ratings.adaptive_ema(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 0.2, 0.02, 10.0, 10.0)
    return out.select("user_id", "n", F.round("ema", 6).alias("ema"))


@query("WITH RECURSIVE s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), r AS (SELECT user_id, i, greatest(-20, least(20, 0.9 * 0 + (value - 100) * 0.05))::DOUBLE AS e FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.i, greatest(-20, least(20, 0.9 * r.e + (s.value - 100) * 0.05))::DOUBLE FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1) SELECT user_id, count(*) AS n, round(arg_max(e, i), 6) AS level FROM r GROUP BY 1")
def q_skill_decay(spark: SparkSession, d: str) -> DataFrame:
    out = ratings.bounded_fold(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.lit(0.9), (F.col("value") - 100) * 0.05, -20.0, 20.0, 0.0)
    return out.select("user_id", "n", F.round("level", 6).alias("level"))


@query("SELECT o_orderkey, round(tanh((o_totalprice - 100000) / 1000 / 150), 6) AS margin FROM orders")
def q_margin(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.round(fx.normalized_margin((F.col("o_totalprice") - 100000) / 1000, 150.0), 6).alias("margin"))


_DIFF = "(0.4 * (1300 + 4 * l_quantity - 1400) + 0.3 * (1400 - (1350 + l_suppkey % 100)) + 0.2 * (1400 + l_tax * 100 - 1400) + 0.1 * (1400 - l_discount * 100 - 1400))"


@query(f"SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round(greatest(0, least(6, 1.3 + {_DIFF} * 0.8 / 100)), 6) AS runs, round(greatest(0.001, least(0.5, 1 / (1 + exp(-(ln(0.05 / 0.95) - {_DIFF} / 400))))), 6) AS wicket FROM lineitem")
def q_expected_outcome(spark: SparkSession, d: str) -> DataFrame:
    diff = fx.combined_difference(1300 + 4 * F.col("l_quantity"), 1350 + F.col("l_suppkey") % 100, 1400 + F.col("l_tax") * 100, 1400 - F.col("l_discount") * 100, (0.4, 0.3, 0.2, 0.1))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.round(fx.expected_runs(F.lit(1.3), diff, 0.8), 6).alias("runs"), F.round(fx.expected_wicket(F.lit(0.05), diff, 400.0), 6).alias("wicket"))


_GRID = [(a, b) for a in (900.0, 1000.0, 1100.0, 1200.0) for b in (0.0, 500.0, 1000.0)]


@query(f"WITH g AS (SELECT unnest([{', '.join(str(a) for a, _ in _GRID)}]) AS slope, unnest([{', '.join(str(b) for _, b in _GRID)}]) AS base) SELECT slope::DOUBLE AS slope, base::DOUBLE AS base, round(sqrt(avg(pow(l_extendedprice - base - slope * l_quantity, 2))), 4) AS rmse FROM lineitem, g GROUP BY ALL")
def q_grid_search(spark: SparkSession, d: str) -> DataFrame:
    """Every setting's error in one pass: a sum for each, not a copy of the rows for each."""
    errors = F.array(*(F.struct(F.lit(a).alias("slope"), F.lit(b).alias("base"), F.sqrt(F.avg(F.pow(F.col("l_extendedprice") - b - a * F.col("l_quantity"), F.lit(2)))).alias("rmse")) for a, b in _GRID))
    return table(spark, d, "lineitem").agg(errors.alias("e")).select(F.inline("e")).select("slope", "base", F.round("rmse", 4).alias("rmse"))


@query("SELECT year(o_orderdate) AS year, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def q_year_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("WITH p AS (SELECT quality, least(n_chars / 4000.0, 1) AS p FROM labels JOIN documents USING (doc_id)) SELECT least(floor(p * 5), 4)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(quality), 6) AS actual FROM p GROUP BY 1")
def q_calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("p", F.least(F.col("n_chars") / 4000.0, F.lit(1.0)))
    return rows.groupBy(F.least(F.floor(F.col("p") * 5), F.lit(4)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("predicted"), F.round(F.avg("quality"), 6).alias("actual"))


@query("WITH p AS (SELECT quality, n_chars / 4000.0 AS p, ntile(5) OVER (ORDER BY n_chars, doc_id) AS tile FROM labels JOIN documents USING (doc_id)) SELECT tile, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(quality), 6) AS actual FROM p GROUP BY 1")
def q_quintile_calibration(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    tiled = windows.global_ntile(rows, ["n_chars", "doc_id"], 5)
    return tiled.groupBy("tile").agg(F.count("*").alias("n"), F.round(F.avg(F.col("n_chars") / 4000.0), 6).alias("predicted"), F.round(F.avg("quality"), 6).alias("actual"))


@query("WITH e AS (SELECT l_suppkey AS a, l_partkey AS b, count(*) AS n FROM lineitem GROUP BY ALL) SELECT a, round(sum(n * p_retailprice) / sum(n), 4) AS faced FROM e LEFT JOIN part ON b = p_partkey GROUP BY 1")
def q_weighted_opponent(spark: SparkSession, d: str) -> DataFrame:
    e = graph.edges(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", "l_quantity")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("b"), "p_retailprice")
    return e.join(part, "b", "left").groupBy("a").agg(F.round(F.try_divide(F.sum(F.col("n") * F.col("p_retailprice")), F.sum("n")), 4).alias("faced"))


@query("WITH RECURSIVE e AS (SELECT c_custkey AS a, -1 - c_nationkey AS b FROM customer UNION SELECT 1000000000 + s_suppkey, -1 - s_nationkey FROM supplier), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a) SELECT node, min(seen) AS component FROM r GROUP BY 1")
def q_components(spark: SparkSession, d: str) -> DataFrame:
    """Customers, suppliers and what connects them."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("a"), (F.lit(-1).cast("long") - F.col("c_nationkey")).alias("b"))
    s = table(spark, d, "supplier").select((F.lit(1000000000) + F.col("s_suppkey")).alias("a"), (F.lit(-1).cast("long") - F.col("s_nationkey")).alias("b"))
    return graph.connected_components(c.unionByName(s))


@query()
def q_components_all(spark: SparkSession, d: str) -> DataFrame:
    """The components of all lines, which recursive SQL cannot bear; a test holds them against brute force."""
    return graph.connected_components(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), (-1 - F.col("l_partkey")).alias("b")))


_VALUE = "CASE WHEN l_returnflag = 'R' THEN -l_discount ELSE l_tax END"


@query(f"WITH v AS (SELECT l_orderkey, l_partkey, l_suppkey, {_VALUE} AS w FROM lineitem) SELECT l_orderkey, l_partkey AS player, 'batter' AS role, round(sum(w), 6) AS wpa, round(max(abs(w)), 6) AS biggest FROM v GROUP BY 1, 2 UNION ALL SELECT l_orderkey, l_suppkey, 'bowler', round(sum(-w), 6), round(max(abs(w)), 6) FROM v GROUP BY 1, 2")
def q_wpa_match(spark: SparkSession, d: str) -> DataFrame:
    return _credits(spark, d).groupBy("l_orderkey", "player", "role").agg(F.round(F.sum("w"), 6).alias("wpa"), F.round(F.max(F.abs("w")), 6).alias("biggest"))


def _credits(spark: SparkSession, d: str) -> DataFrame:
    """Each ball twice: the batter gains what the bowler loses."""
    v = F.when(F.col("l_returnflag") == "R", -F.col("l_discount")).otherwise(F.col("l_tax"))
    roles = F.array(F.struct(F.col("l_partkey").alias("player"), F.lit("batter").alias("role"), v.alias("w")), F.struct(F.col("l_suppkey").alias("player"), F.lit("bowler").alias("role"), (-v).alias("w")))
    return table(spark, d, "lineitem").select("l_orderkey", F.inline(roles))


@query(f"WITH v AS (SELECT l_orderkey, l_partkey, l_suppkey, {_VALUE} AS w FROM lineitem), c AS (SELECT l_orderkey, l_partkey AS player, 'batter' AS role, w FROM v UNION ALL SELECT l_orderkey, l_suppkey, 'bowler', -w FROM v) SELECT player, role, count(*) AS balls, count(DISTINCT l_orderkey) AS matches, round(sum(w), 6) + 0.0 AS wpa, round(avg((w > 0)::INT) * 100, 4) AS pct_positive, count(*) FILTER (abs(w) >= 0.08) AS clutch, round(sum(w) / count(DISTINCT l_orderkey), 10) + 0.0 AS per_match FROM c GROUP BY ALL")
def q_career_wpa(spark: SparkSession, d: str) -> DataFrame:
    """Summed by match first, so that the distinct count needs no second expansion."""
    match = _credits(spark, d).groupBy("l_orderkey", "player", "role").agg(F.count("*").alias("balls"), F.sum("w").alias("w"), F.count_if(F.col("w") > 0).alias("up"), F.count_if(F.abs("w") >= 0.08).alias("clutch"))
    return match.groupBy("player", "role").agg(F.sum("balls").alias("balls"), F.count("*").alias("matches"), (F.round(F.sum("w"), 6) + 0.0).alias("wpa"), F.round(F.sum("up") / F.sum("balls") * 100, 4).alias("pct_positive"), F.sum("clutch").alias("clutch"), (F.round(F.sum("w") / F.count("*"), 10) + 0.0).alias("per_match"))


@query("WITH p AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY 1), j AS (SELECT c_custkey, spent FROM customer LEFT JOIN p ON c_custkey = o_custkey) SELECT c_custkey, round(coalesce(spent, (SELECT median(spent) FROM j)), 4) AS spent FROM j")
def q_impute_median(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"))
    j = table(spark, d, "customer").select("c_custkey").join(p, "c_custkey", "left")
    middle = windows.exact_percentiles(j, None, "spent", {"middle": 0.5})  # one row
    return j.join(F.broadcast(middle), F.lit(True)).select("c_custkey", F.round(F.coalesce("spent", "middle"), 4).alias("spent"))


@query("SELECT count(*) FILTER (o_orderdate >= TIMESTAMP '2000-01-01') AS fresh, count(*) FILTER (o_orderdate < TIMESTAMP '2000-01-01') AS known, count(*) FILTER (o_orderdate >= TIMESTAMP '2000-01-01') > 0 AS run_step FROM orders")
def q_pipeline_delta(spark: SparkSession, d: str) -> DataFrame:
    fresh = F.count_if(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    known = F.count_if(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    return table(spark, d, "orders").agg(fresh.alias("fresh"), known.alias("known"), (fresh > 0).alias("run_step"))


@query()
def q_playoff_sim(spark: SparkSession, d: str) -> DataFrame:
    """Titles of the four best customers of each nation in 200 simulated brackets.

    First and second meet for a place in the final, third and fourth for the
    right to play the loser; draws depend on the simulation and the tie only.
    """
    points = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("points"))
    seeded = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(points, "c_custkey")
    nth = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("points"), "c_custkey"))
    four = seeded.withColumn("nth", nth).where("nth <= 4").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("nth", "c_custkey", "points"))).alias("t")).where(F.size("t") == 4)
    sims = four.withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(200))))

    def beats(name: str, a: str, b: str) -> dict:
        up = fx.uniform(7, F.lit(name), F.col("c_nationkey"), F.col("sim")) < F.try_divide(F.col(a)["points"], F.col(a)["points"] + F.col(b)["points"])
        return {f"{name}_w": F.when(up, F.col(a)).otherwise(F.col(b)), f"{name}_l": F.when(up, F.col(b)).otherwise(F.col(a))}

    sims = sims.withColumns({f"t{i}": F.get("t", i) for i in range(4)})
    for name, a, b in (("q1", "t0", "t1"), ("elim", "t2", "t3"), ("q2", "q1_l", "elim_w"), ("final", "q1_w", "q2_w")):
        sims = sims.withColumns(beats(name, a, b))
    return sims.groupBy("c_nationkey", F.col("final_w")["c_custkey"].alias("c_custkey")).agg(F.count("*").alias("titles"))


@query()
def q_three_way_elo(spark: SparkSession, d: str) -> DataFrame:
    """Batter, bowler and venue ratings before each ball, by line status and flag."""
    balls = table(spark, d, "lineitem").select(F.concat("l_linestatus", "l_returnflag").alias("league"), "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_partkey").alias("batter"), F.col("l_suppkey").alias("bowler"), (F.col("l_orderkey") % 20).alias("venue"), F.least(F.floor(F.col("l_quantity") / 8), F.lit(6)).cast("double").alias("runs"))
    return ratings.three_way_scan(balls, "league", ["l_shipdate", "l_orderkey", "l_linenumber", "batter", "bowler"], "l_orderkey", "batter", "bowler", "venue", "runs")


@query()
def q_innings_sim(spark: SparkSession, d: str) -> DataFrame:
    """Twenty innings of 60 balls from each vector's entries, every seventh of which weighs one outcome."""
    weight = lambda k: F.aggregate(F.filter("embedding", lambda x, i: i % 7 == k), F.lit(0.001), lambda a, x: a + F.abs(x.cast("double")))
    weights = F.array(*(weight(k) for k in range(7)))
    p = table(spark, d, "embeddings").select("vec_id", weights.alias("p"))
    return simulate.innings(p, "vec_id", "p", sims=20, balls=60, seed=11)


@query("SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files, counted in tumbling windows."""
    return ingest.window_totals(spark, d, "ts", "event_type", "value", "6 hours", only="events.parquet").select("event_type", "start", "n", F.round("total", 4).alias("total"))


@query()
def q_outcome_model(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold quality of a three-class outcome model; folds keep an order's lines together."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", F.unix_date(F.to_date("l_shipdate")).cast("double").alias("day"), F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("l_returnflag")).cast("double").alias("flag"))
    rows = rows.withColumn("flag", F.col("flag") - 1)
    scored = models.out_of_fold(rows, "l_orderkey", ["l_quantity", "l_discount", "l_tax", "day"], "flag", 3, rounds=10)
    return models.metrics(scored, "flag", ["fold"]).select("fold", "n", *(F.round(c, 4).alias(c) for c in ("accuracy", "log_loss", "brier")))


@query("WITH f AS (SELECT l_suppkey AS a, l_partkey AS b, min(date_trunc('week', l_shipdate))::DATE AS period FROM lineitem GROUP BY 1, 2), n AS (SELECT a, period, count(*) AS n FROM f GROUP BY ALL) SELECT a, period, (sum(n) OVER (PARTITION BY a ORDER BY period))::BIGINT AS degree FROM n")
def q_centrality_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Weeks start on Monday."""
    return graph.degree_snapshots(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", F.date_trunc("week", "l_shipdate").cast("date"))


@query("SELECT l_suppkey, l_partkey, count(*) AS n, sum(l_quantity)::DOUBLE AS w FROM lineitem GROUP BY ALL")
def q_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", "l_quantity").select(F.col("a").alias("l_suppkey"), F.col("b").alias("l_partkey"), "n", "w")


@query("SELECT count(*) AS balls, sum(l_quantity)::DOUBLE AS runs, count(*) FILTER (l_returnflag = 'R') AS outs FROM lineitem WHERE l_suppkey = 3")
def q_entity_stats_single(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_suppkey = 3").agg(F.count("*").alias("balls"), F.sum("l_quantity").alias("runs"), F.count_if(F.col("l_returnflag") == "R").alias("outs"))


@query("SELECT p_partkey, CASE WHEN lower(trim(p_type)) IN ('economy', 'standard') THEN 't20' WHEN lower(trim(p_type)) IN ('promo', 'small') THEN 'odi' ELSE 'test' END AS format FROM part")
def q_format_alias(spark: SparkSession, d: str) -> DataFrame:
    kind = F.lower(F.trim("p_type"))
    return table(spark, d, "part").select("p_partkey", F.when(kind.isin("economy", "standard"), "t20").when(kind.isin("promo", "small"), "odi").otherwise("test").alias("format"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_quantity / 6)::BIGINT AS overs, (l_quantity % 6)::BIGINT AS balls FROM lineitem")
def q_overs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(F.col("l_quantity") / 6).cast("long").alias("overs"), (F.col("l_quantity") % 6).cast("long").alias("balls"))


def _meetings(spark: SparkSession, d: str) -> DataFrame:
    """Orders as matches of forty teams: the customer's side at home, a fifth without a winner."""
    home = F.col("o_custkey") % 40
    away = (home + 1 + F.col("o_orderkey") % 39) % 40
    chased = F.col("o_orderkey") % 3 == 0
    winner = F.when(F.col("o_orderkey") % 5 != 4, F.when(F.col("o_totalprice") > 150000, home).otherwise(away))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("match_id"), F.to_date("o_orderdate").alias("day"), home.alias("home"), away.alias("away"), F.col("o_orderpriority").alias("venue"), winner.alias("winner"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("first_total"), chased.alias("chased"))


_MEETINGS = """m AS (SELECT o_orderkey AS match_id, o_orderdate::DATE AS day, o_custkey % 40 AS home, (o_custkey % 40 + 1 + o_orderkey % 39) % 40 AS away, o_orderpriority AS venue,
  CASE WHEN o_orderkey % 5 <> 4 THEN CASE WHEN o_totalprice > 150000 THEN o_custkey % 40 ELSE (o_custkey % 40 + 1 + o_orderkey % 39) % 40 END END AS winner, floor(o_totalprice / 1000) AS first_total, o_orderkey % 3 = 0 AS chased FROM orders)"""


@query(f"""WITH {_MEETINGS},
s AS (SELECT match_id, day, winner, 'home' AS side, home AS team FROM m UNION ALL SELECT match_id, day, winner, 'away', away FROM m),
r AS (SELECT a.match_id, a.side, (b.winner = a.team)::INT AS won, row_number() OVER (PARTITION BY a.match_id, a.side ORDER BY b.day DESC, b.match_id DESC, b.side DESC) AS rn FROM s a JOIN s b ON a.team = b.team AND b.day < a.day AND b.winner IS NOT NULL),
f AS (SELECT match_id, avg(won) FILTER (side = 'home') AS home_form, avg(won) FILTER (side = 'away') AS away_form FROM r WHERE rn <= 5 GROUP BY 1),
h AS (SELECT a.match_id, count(b.winner) AS n, count(*) FILTER (b.winner = a.home) AS w FROM m a JOIN m b ON least(a.home, a.away) = least(b.home, b.away) AND greatest(a.home, a.away) = greatest(b.home, b.away) AND b.day < a.day GROUP BY 1),
p AS (SELECT venue, day, count(winner) AS n, sum(first_total) FILTER (winner IS NOT NULL) AS t, count(*) FILTER (winner IS NOT NULL AND chased) AS c FROM m GROUP BY ALL),
v AS (SELECT venue, day, sum(n) OVER w AS n, sum(t) OVER w AS t, sum(c) OVER w AS c FROM p WINDOW w AS (PARTITION BY venue ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT m.match_id, round(home_form, 6) AS home_form, round(away_form, 6) AS away_form, coalesce(h.n, 0)::BIGINT AS h2h_total, coalesce(h.w, 0)::BIGINT AS h2h_wins, coalesce(v.n, 0)::BIGINT AS venue_n,
  CASE WHEN v.n >= 5 THEN round(v.t / v.n, 4) END AS venue_score, CASE WHEN v.n >= 5 THEN round(v.c / v.n, 6) END AS venue_chased
FROM m LEFT JOIN f USING (match_id) LEFT JOIN h USING (match_id) LEFT JOIN v ON v.venue = m.venue AND v.day = m.day""")
def q_pre_match_features(spark: SparkSession, d: str) -> DataFrame:
    """Form, head-to-head and venue history strictly before each match's day."""
    known = teams.pre_match(_meetings(spark, d))
    return known.select("match_id", F.round("home_form", 6).alias("home_form"), F.round("away_form", 6).alias("away_form"), F.col("h2h_total").cast("long").alias("h2h_total"), F.col("h2h_wins").cast("long").alias("h2h_wins"), F.col("venue_n").cast("long").alias("venue_n"), F.round("venue_score", 4).alias("venue_score"), F.round("venue_chased", 6).alias("venue_chased"))


@query()
def q_team_elo(spark: SparkSession, d: str) -> DataFrame:
    """Team ratings with margins, tiers, home edge and seasons, a league for each order status."""
    m = _meetings(spark, d)
    status = table(spark, d, "orders").select(F.col("o_orderkey").alias("match_id"), F.col("o_orderstatus").alias("league"))
    m = m.join(status, "match_id").withColumns({
        "result": F.when(F.col("winner").isNull(), 0.5).when(F.col("winner") == F.col("home"), 1.0).otherwise(0.0), "margin": F.col("first_total") % 60,
        "tier": (F.col("home") % 4 + 1).cast("int"), "edge": F.when(F.col("match_id") % 4 == 0, 0).otherwise(1), "season": F.year("day"),
    })
    return teams.team_scan(m, "league", ["day", "match_id"], "home", "away", "result", "margin", "tier", "edge", "season", teams.TeamRules(season_keep=0.85))


@query(f"""WITH {_MEETINGS},
r AS (SELECT winner, CASE WHEN winner = home THEN away ELSE home END AS loser, first_total / 1000 AS delta FROM m WHERE winner IS NOT NULL),
net AS (SELECT team, sum(d) AS net FROM (SELECT winner AS team, delta AS d FROM r UNION ALL SELECT loser, -delta FROM r) GROUP BY 1),
t AS (SELECT DISTINCT team FROM (SELECT home AS team FROM m UNION ALL SELECT away FROM m)),
a AS (SELECT home AS team, away AS other, count(*) / sum(count(*)) OVER (PARTITION BY home) AS likeness FROM m GROUP BY 1, 2),
s AS (SELECT other AS team, sum(net * likeness) AS moved FROM a JOIN net USING (team) GROUP BY 1)
SELECT team, round(1500 + 0.15 * coalesce(moved, 0), 4) AS elo FROM t LEFT JOIN s USING (team)""")
def q_propagation(spark: SparkSession, d: str) -> DataFrame:
    """Results spread to the teams a winner or loser plays at home most."""
    m = _meetings(spark, d)
    results = m.where("winner is not null").select("winner", F.when(F.col("winner") == F.col("home"), F.col("away")).otherwise(F.col("home")).alias("loser"), (F.col("first_total") / 1000).alias("delta"))
    rated = m.select(F.explode(F.array("home", "away")).alias("team")).distinct().withColumn("elo", F.lit(1500.0))
    met = m.groupBy(F.col("home").alias("team"), F.col("away").alias("other")).agg(F.count("*").alias("n"))
    alike = met.withColumn("likeness", F.col("n") / F.sum("n").over(Window.partitionBy("team")))
    return teams.propagate(rated, results, alike).select("team", F.round("elo", 4).alias("elo"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate AND l_quantity >= 45)")
def q_exists(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_quantity >= 45").select("l_orderkey", "l_shipdate")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return o.join(lines, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate")), "left_semi").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity < 6 THEN 'powerplay' WHEN l_quantity < 16 THEN 'middle' ELSE 'death' END AS phase FROM lineitem")
def q_phase(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fx.phase(F.col("l_quantity")).alias("phase"))


@query("SELECT p_partkey, regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g') || '_' || lower(p_type) AS team_id FROM part")
def q_team_id(spark: SparkSession, d: str) -> DataFrame:
    name = F.regexp_replace(F.lower(F.trim("p_name")), "[^a-z0-9]+", "_")
    return table(spark, d, "part").select("p_partkey", F.concat(name, F.lit("_"), F.lower("p_type")).alias("team_id"))


@query("WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(0.999, greatest(0.001, l_discount)) AS p, (l_quantity - 25) * 10 AS diff FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(0.5, greatest(0.001, 1 / (1 + exp(-(ln(p / (1 - p)) - diff / 200))))), 6) AS wicket FROM w")
def q_expected_wicket(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(fx.expected_wicket(F.col("l_discount"), (F.col("l_quantity") - 25) * 10, 200.0), 6).alias("wicket"))
