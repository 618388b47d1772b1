"""Registered queries of coupled ratings, skills and the network of meetings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchline.operators import graph, network, rosters, rounds, skills, windows
from pitchline.session import cut
from pitchline.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _season_matches(spark: SparkSession, d: str) -> DataFrame:
    """Each two consecutive orders of a priority and week meet; the higher price wins."""
    w = Window.partitionBy("o_orderpriority", "week").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, d, "orders").select("o_orderpriority", F.trunc("o_orderdate", "week").alias("week"), "o_orderdate", "o_orderkey", "o_custkey", "o_totalprice")
    rows = rows.withColumn("n", F.row_number().over(w) - 1).withColumn("pair", F.floor(F.col("n") / 2))
    of = lambda k, c: F.max(F.when(F.col("n") % 2 == k, F.col(c)))
    both = rows.groupBy("o_orderpriority", "week", "pair").agg(F.year("week").alias("season"), of(1, "o_orderdate").alias("day"), of(1, "o_orderkey").alias("match"), of(0, "o_custkey").alias("h"), of(1, "o_custkey").alias("a"), (of(0, "o_totalprice") > of(1, "o_totalprice")).cast("double").alias("won"))
    side = lambda c: F.col("season").cast("long") * 1_000_000_000 + F.col(c)
    return both.where("match is not null").select("season", "day", "match", side("h").alias("home"), side("a").alias("away"), "won")


@query("""
WITH RECURSIVE o AS (SELECT o_orderpriority, date_trunc('week', o_orderdate) AS week, year(week) AS season, o_orderdate, o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority, date_trunc('week', o_orderdate) ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders),
m AS (SELECT x.season, y.o_orderdate AS day, y.o_orderkey AS match, x.season::BIGINT * 1000000000 + x.o_custkey AS home, x.season::BIGINT * 1000000000 + y.o_custkey AS away, (x.o_totalprice > y.o_totalprice)::INT::DOUBLE AS won
  FROM o x JOIN o y ON x.o_orderpriority = y.o_orderpriority AND x.week = y.week AND x.n % 2 = 0 AND y.n = x.n + 1 WHERE x.o_custkey <> y.o_custkey),
sides AS (SELECT match, e, s, row_number() OVER (PARTITION BY e ORDER BY day, match) - 1 AS n FROM (SELECT day, match, home AS e, 0 AS s FROM m UNION ALL SELECT day, match, away, 1 FROM m)),
plan AS MATERIALIZED (SELECT m.*, h.n AS nh, a.n AS na FROM m JOIN sides h ON h.match = m.match AND h.s = 0 JOIN sides a ON a.match = m.match AND a.s = 1),
st AS (SELECT e, 0 AS n, 1400.0::DOUBLE AS r, 0 AS k, NULL::BIGINT AS match, NULL::DOUBLE AS before, NULL::DOUBLE AS change, 0 AS s FROM (SELECT DISTINCT e FROM sides)
  UNION ALL
  SELECT x.e, x.n + (c.match IS NOT NULL)::INT, x.r + coalesce(c.change, 0), x.k + 1, c.match, c.before, c.change, c.s FROM st x LEFT JOIN (
    SELECT plan.match AS match, unnest([home, away]) AS e, unnest([h.r, a.r]) AS before, unnest([0, 1]) AS s,
      unnest([(20 + 20 * exp(-nh / 5.0)) * (won - 1 / (1 + pow(10.0, (a.r - h.r) / 400))), -(20 + 20 * exp(-na / 5.0)) * (won - 1 / (1 + pow(10.0, (a.r - h.r) / 400)))]) AS change
    FROM plan JOIN st h ON h.e = home AND h.n = nh JOIN st a ON a.e = away AND a.n = na) c ON c.e = x.e
  WHERE (SELECT sum(n) FROM st) < 2 * (SELECT count(*) FROM plan))
SELECT p.season, p.match, p.home, p.away, (h.k - 1)::BIGINT AS round, round(h.before, 6) AS home_before, round(a.before, 6) AS away_before, round(h.change, 6) AS home_change, round(a.change, 6) AS away_change
FROM plan p JOIN st h ON h.match = p.match AND h.s = 0 JOIN st a ON a.match = p.match AND a.s = 1
""")
def q_elo_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Ratings of customers within a season, in conflict-free rounds, with a step that shrinks."""
    rated = rounds.rated_rounds(_season_matches(spark, d), ["day", "match"], "home", "away", "won", step=lambda n: 20 + 20 * F.exp(-n / 5.0))
    return rated.select("season", "match", "home", "away", F.col("round").cast("long").alias("round"), *(F.round(c, 6).alias(c) for c in ("home_before", "away_before", "home_change", "away_change")))


def _balls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("pool"), F.col("l_returnflag").alias("league"), "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_partkey").alias("batter"), F.col("l_suppkey").alias("bowler"),
        (F.col("l_orderkey") % 20).alias("venue"), F.least(F.floor(F.col("l_quantity") / 8), F.lit(6)).cast("double").alias("runs"), (F.col("l_discount") >= 0.095).alias("wicket"),
    )


@query("""
WITH b AS (SELECT l_returnflag AS league, l_shipdate AS day, l_orderkey, l_linenumber, least(floor(l_quantity / 8), 6)::DOUBLE AS runs FROM lineitem),
t AS (SELECT league, day, sum(runs) AS s, count(*) AS n FROM b GROUP BY ALL),
p AS (SELECT league, day, sum(s) OVER w AS s, sum(n) OVER w AS n FROM t WINDOW w AS (PARTITION BY league ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT avg(runs) AS a FROM b)
SELECT l_orderkey, l_linenumber, round(CASE WHEN n > 0 THEN n / (n + 5000.0) * (s / n) + (1 - n / (n + 5000.0)) * a ELSE a END, 6) AS baseline FROM b JOIN p USING (league, day), g
""")
def q_league_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The mean runs of a league before each day, drawn to the mean of all."""
    return skills.league_baselines(_balls(spark, d), "league", "l_shipdate", "runs").select("l_orderkey", "l_linenumber", F.round("baseline", 6).alias("baseline"))


@query()
def q_three_way_skill(spark: SparkSession, d: str) -> DataFrame:
    """Coupled skills before each ball, for runs and wickets, against the league's baseline."""
    balls = _balls(spark, d)
    rate = skills.wicket_rate(balls, F.col("wicket"))
    balls = skills.league_baselines(balls, "league", "l_shipdate", "runs")
    return skills.skill_scan(balls, "pool", ["l_shipdate", "l_orderkey", "l_linenumber"], "l_orderkey", "batter", "bowler", "venue", "runs", "wicket", rate)


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Edges of customers and the suppliers of their nation: a graph of several components."""
    t = lambda n: table(spark, d, n)
    rows = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.where("c_nationkey = s_nationkey").select(F.col("o_custkey").alias("cust"), F.col("l_suppkey").alias("supp"), F.lit(1).alias("one"))
    return cut(graph.edges(rows, "cust", "supp", "one"))  # ranks and components read them many times


_ISLANDS = """
WITH RECURSIVE e AS (SELECT o_custkey AS a, l_suppkey AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey = s_nationkey GROUP BY ALL),
pa AS (SELECT a, b, n / sum(n) OVER (PARTITION BY b) AS p FROM e), pb AS (SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS p FROM e),
c AS (SELECT count(DISTINCT a) AS na, count(DISTINCT b) AS nb FROM e), b1 AS (SELECT b, 0.15 / any_value(nb) + 0.85 * sum(p / na) AS r FROM pb, c GROUP BY b),
ranks AS (SELECT a, 0.15 / any_value(na) + 0.85 * sum(p * r) AS rank FROM pa JOIN b1 USING (b), c GROUP BY a),
link AS (SELECT 'a' || a AS u, 'b' || b AS v FROM e UNION ALL SELECT 'b' || b, 'a' || a FROM e),
reach AS (SELECT u AS node, u AS label FROM link UNION SELECT v, label FROM reach JOIN link ON node = u WHERE label < v),
comp AS (SELECT node, min(label) AS component FROM reach GROUP BY node), size AS (SELECT component, count(*) AS size FROM comp GROUP BY component),
"""


@query(_ISLANDS + """done AS (SELECT a, rank, size, rank * sqrt(size / (SELECT max(size) FROM size)) AS normalized FROM ranks JOIN comp ON node = 'a' || a JOIN size USING (component))
SELECT a, round(rank, 9) AS rank, size, round(normalized, 9) AS normalized FROM done""")
def q_component_rank(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of customers among suppliers of their nation, marked down by the size of their component."""
    e = _neighbours(spark, d)
    out = network.rank_by_component(graph.pagerank(e, 2), e)
    return out.select("a", F.round("rank", 9).alias("rank"), "size", F.round("normalized", 9).alias("normalized"))


@query(_ISLANDS + """done AS (SELECT a, rank * sqrt(size / (SELECT max(size) FROM size)) AS normalized FROM ranks JOIN comp ON node = 'a' || a JOIN size USING (component)),
pct AS (SELECT a, (rank() OVER (ORDER BY round(normalized, 9)) + (count(*) OVER (PARTITION BY round(normalized, 9)) - 1) / 2.0) / count(*) OVER () * 100 AS pct FROM done),
l AS (SELECT c_nationkey, count(*) AS members, avg(pct) AS standing FROM pct JOIN customer ON a = c_custkey GROUP BY ALL HAVING count(*) >= 10)
SELECT c_nationkey, members, round(standing, 6) AS standing, round(1400 + (greatest(0, least(100, standing)) - 50) * 6, 6) AS start, round(0.5 + 1 / (1 + exp(-0.08 * (standing - 50))), 6) AS factor FROM l""")
def q_league_start(spark: SparkSession, d: str) -> DataFrame:
    """Where newcomers of each nation start and how much a win against it moves, by its members' percentiles."""
    e = _neighbours(spark, d)
    ranked = network.rank_by_component(graph.pagerank(e, 2), e).select("a", F.round("normalized", 9).alias("normalized"))
    pct = windows.average_rank_percent(ranked, "normalized", "pct").select(F.col("a").alias("c_custkey"), "pct")
    out = network.league_standing(table(spark, d, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", pct)
    return out.select("c_nationkey", "members", F.round("standing", 6).alias("standing"), F.round(network.implied_rating(F.col("standing")), 6).alias("start"), F.round(network.step_factor(F.col("standing")), 6).alias("factor"))


@query("""
WITH f AS (SELECT l_partkey AS a, l_suppkey AS b, min(date_trunc('month', l_shipdate))::DATE AS t FROM lineitem GROUP BY ALL),
grown AS (SELECT DISTINCT b, t FROM f), seen AS (SELECT DISTINCT f.a, g.t AS period FROM f JOIN grown g ON g.b = f.b AND g.t >= f.t),
deg AS (SELECT p.t AS period, f.b, count(*) AS deg FROM (SELECT DISTINCT t FROM f) p JOIN f ON f.t <= p.t GROUP BY ALL)
SELECT a, period, count(*) AS degree, round(avg(deg), 6) AS opponents_degree, round(0.2 * count(*) + 0.8 * avg(deg), 6) AS score
FROM seen JOIN f USING (a) JOIN deg USING (b, period) WHERE f.t <= period GROUP BY a, period
""")
def q_neighbour_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Monthly degrees of parts and of the suppliers they have met, by changes alone."""
    out = network.neighbour_snapshots(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", F.trunc("l_shipdate", "month"))
    return out.select("a", "period", "degree", F.round("opponents_degree", 6).alias("opponents_degree"), F.round("score", 6).alias("score"))


@query("""
WITH a AS (SELECT DISTINCT l_suppkey AS team, l_orderkey AS match, o_orderdate AS day, l_partkey AS player FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT DISTINCT team, match, day FROM a),
s AS (SELECT l_partkey AS player, o_orderdate AS day, avg(l_quantity) AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
last AS (SELECT x.team, x.match, x.day, y.match AS past FROM m x JOIN m y ON x.team = y.team AND y.day < x.day QUALIFY row_number() OVER (PARTITION BY x.team, x.match ORDER BY y.day DESC, y.match DESC) <= 12),
p AS (SELECT last.team, last.match, last.day, player, count(*) AS n FROM last JOIN a ON a.team = last.team AND a.match = last.past GROUP BY ALL),
xi AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY team, match ORDER BY n DESC, player) <= 11),
r AS (SELECT xi.team, xi.match, rating FROM xi ASOF LEFT JOIN s ON xi.player = s.player AND xi.day > s.day)
SELECT match, team, count(*) AS players, count(rating) AS known, round(avg(coalesce(rating, 25)), 6) AS roster_rating FROM r GROUP BY ALL
""")
def q_roster_rating(spark: SparkSession, d: str) -> DataFrame:
    """Before each order, the mean level of the eleven parts a supplier has delivered most in its last twelve."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity").join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = cut(rows.drop("o_orderkey"))  # read three times
    sides = rows.select(F.col("l_orderkey").alias("match"), F.col("l_suppkey").alias("team"), F.col("o_orderdate").alias("day"), F.col("l_partkey").alias("player"))
    series = rows.groupBy(F.col("l_partkey").alias("player"), F.col("o_orderdate").alias("day")).agg(F.avg("l_quantity").alias("rating"))
    out = rosters.rated_rosters(sides, sides, series, n=12, start=25.0)
    return out.withColumn("roster_rating", F.round("roster_rating", 6))
