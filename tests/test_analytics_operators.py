"""Operators against small examples worked out by plain loops."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from pitchline.operators import graph, models, ratings, simulate, teams, windows
from pitchline.plans import lookups
from pitchline.sources import matches, sinks
from pitchline.streaming import ingest

DATA = "/root/testdata/sf0.001"


def series(spark, seed=3, keys=3, n=40):
    rng = random.Random(seed)
    return spark.createDataFrame([(k, i, rng.gauss(0, 30)) for k in range(keys) for i in range(n)], "k long, i long, x double").repartition(5)


def test_bounded_fold_is_a_loop_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(ratings, "BLOCK", 7)
    df = series(spark)
    got = {r.k: (r.n, r.level) for r in ratings.bounded_fold(df, "k", ["i"], F.lit(0.9), F.col("x"), -20.0, 20.0, 5.0).collect()}
    for k in range(3):
        level = 5.0
        for r in sorted(df.where(F.col("k") == k).collect(), key=lambda r: r.i):
            level = max(-20.0, min(20.0, 0.9 * level + r.x))
        assert got[k] == (40, pytest.approx(level))


def test_bounded_fold_may_forget(spark):
    df = spark.createDataFrame([(1, 1, 3.0), (1, 2, 4.0)], "k long, i long, x double")
    assert ratings.bounded_fold(df, "k", ["i"], F.lit(0.0), F.col("x"), -9.0, 9.0, 1.0).first().level == 4.0


def test_global_ntile_and_running_sum(spark):
    df = spark.range(23).select((F.col("id") * 7 % 23).alias("v")).repartition(6)
    got = {r.v: r.tile for r in windows.global_ntile(df, ["v"], 5).collect()}
    sizes = [5, 5, 5, 4, 4]
    assert got == {v: t for v, t in zip(range(23), [i + 1 for i, s in enumerate(sizes) for _ in range(s)])}
    assert windows.global_ntile(df.where("v < 0"), ["v"], 5).count() == 0
    assert sorted(r.tile for r in windows.global_ntile(df.where("v < 3"), ["v"], 5).collect()) == [1, 2, 3]


def test_prior_mean_does_not_see_the_same_day(spark):
    df = spark.createDataFrame([("a", 1, 1, 1), ("a", 1, 2, 0), ("a", 2, 3, 1), ("a", 3, 4, 1)], "k string, day int, id int, won int")
    got = {r.id: r.form for r in windows.prior_mean(df, "k", "day", "id", F.col("won"), 2, "form").collect()}
    assert got == {1: None, 2: None, 3: 0.5, 4: 0.5}


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(e).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}
    assert graph.connected_components(e.where("a < 0")).count() == 0


def test_components_of_more_edges_are_more_tasks(spark, monkeypatch):
    from pitchline import session

    monkeypatch.setattr(session, "TASK_ROWS", 2000)
    monkeypatch.setattr(session, "TASK_BYTES", 1 << 14)
    most = []  # rows of a task that wrote

    def cut(df):
        out = session.cut(df)
        most.append(out.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(graph, "cut", cut)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    e = spark.range(20000).select(F.col("id").alias("a"), (-1 - F.col("id") % 4000).alias("b"))
    with session.setting(spark, "spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k"):
        out = graph.connected_components(e)
    assert out.count() == 24000 and out.where("component != -1 - pmod(if(node < 0, -1 - node, node), 4000)").count() == 0
    assert max(most[1:-1]) < 4000  # the first and the last cut shuffle nothing
    assert spark.conf.get("spark.sql.shuffle.partitions") == partitions


def test_three_way_ratings(spark):
    balls = spark.createDataFrame([("x", 1, i, 10, 20, 5, 6.0) for i in range(3)] + [("y", 2, 0, 10, 20, 5, 0.0)], "league string, m long, i long, bat long, bowl long, v long, runs double")
    rows = ratings.three_way_scan(balls, "league", ["m", "i"], "m", "bat", "bowl", "v", "runs").collect()
    x = [r for r in rows if r.league == "x"]
    assert [r.batter_before for r in x] == sorted(r.batter_before for r in x) and x[0].batter_before == 1400.0
    assert x[2].bowler_before < x[1].bowler_before < 1400.0
    assert x[1].batter_before == pytest.approx(1400 + 24 * 0.45 * (6 - 1.3))
    y = [r for r in rows if r.league == "y"][0]
    assert y.batter_before == 1400.0 and y.expected == 1.3


def test_three_way_means_tiers_and_absence(spark):
    balls = spark.createDataFrame([(1, m, 10 * m + i, 10 + i, 20, 5, 6.0, d, t) for m, d, t in ((1, "2020-01-01", 1), (2, "2020-01-02", 4), (3, "2021-06-01", 1)) for i in range(2)], "league long, m long, at long, bat long, bowl long, v long, runs double, day string, tier int")
    args = ("league", ["at"], "m", "bat", "bowl", "v", "runs")
    plain = ratings.three_way_scan(balls, *args).orderBy("m", "bat").collect()
    tiers = ratings.three_way_scan(balls, *args, tier="tier").orderBy("m", "bat").collect()
    assert tiers[2].batter_before == plain[2].batter_before and tiers[4].batter_before < plain[4].batter_before
    pulled = ratings.three_way_scan(balls, *args, mean=1400.0).orderBy("m", "bat").collect()
    # after the first match half of the batters' mean drift goes from each of them
    means = [(r[2].batter_before + r[3].batter_before) / 2 - 1400 for r in (pulled, plain)]
    assert 0 < means[0] < means[1]
    gone = ratings.three_way_scan(balls, *args, day="day", fade_to=1500.0).orderBy("m", "bat").collect()
    days = 516
    assert gone[2].batter_before == plain[2].batter_before
    assert gone[4].batter_before == pytest.approx(1500 + (plain[4].batter_before - 1500) * math.exp(-days / 500))


def test_team_ratings_against_a_loop(spark):
    rng, rules = random.Random(5), teams.TeamRules(season_keep=0.8)
    rows = [(1, i, a, b, rng.choice([1.0, 0.5, 0.0]), rng.choice([None, 0.0, 12.0, 60.0]), rng.randint(1, 4), rng.choice([-1, 0, 1]), i // 10) for i in range(40) for a, b in [rng.sample(range(6), 2)]]
    d = spark.createDataFrame(rows, "league long, i long, h long, a long, result double, margin double, tier int, edge int, season long")
    got = teams.team_scan(d, "league", ["i"], "h", "a", "result", "margin", "tier", "edge", "season", rules).collect()
    elo, played, tier, season = {}, {}, {}, 0
    for r, (_, _, h, a, s, m, t, e, year) in zip(got, rows):
        if year != season:  # every rating moves at once here
            elo = {k: rules.base + 0.8 * (v - rules.base) for k, v in elo.items()}
            season = year
        for k in (h, a):
            elo.setdefault(k, rules.start(t)), played.setdefault(k, 0), tier.setdefault(k, t)
        x = 1 / (1 + 10 ** ((elo[a] - elo[h] - 50 * e) / 400))
        w = min(1 + 0.5 * abs(round(tier[h]) - round(tier[a])), 2.5)
        if m and s != 0.5:
            win, lose = (h, a) if s == 1 else (a, h)
            w *= max(0.5, min(2.5, (m + 5) ** 0.7 / max(1, 10 + 0.004 * (elo[win] - elo[lose]))))
        assert (r.home_before, r.away_before) == pytest.approx((elo[h], elo[a]))
        for k, sign in ((h, 1), (a, -1)):
            elo[k] += sign * (16 + 16 * math.exp(-played[k] / 30)) * w * (s - x)
            played[k] += 1
            tier[k] = 0.8 * tier[k] + 0.2 * t
        assert (r.home_after, r.away_after) == pytest.approx((elo[h], elo[a]))


def test_lookups(spark):
    who = spark.createDataFrame([("p1", "Ann Lee"), ("p2", "Bo Leeds"), ("p3", "Cy 100%")], "player_id string, player_name string")
    assert [r.player_id for r in lookups.search(who, "player_name", "LEE").collect()] == ["p1", "p2"]
    assert [r.player_id for r in lookups.search(who, "player_name", "%").collect()] == ["p3"]
    assert lookups.find(who, "player_id", "player_name", "leeds").first().player_id == "p2" and lookups.find(who, "player_id", "player_name", "p1").first().player_id == "p1"
    rows = [("m", 1, "p1", "p2", 4, 4, 0, 0, 0, 0, True, False, False, None, None), ("m", 1, "p1", "p2", 0, 1, 1, 0, 0, 0, False, False, False, None, None), ("m", 1, "p1", "p2", 0, 0, 0, 0, 0, 0, False, False, True, "bowled", "p1"), ("m", 1, "p3", "p2", 0, 0, 0, 0, 0, 0, False, False, True, "run out", "p3")]
    balls = spark.createDataFrame(rows, "match_id string, innings int, batter_id string, bowler_id string, runs_batter int, runs_total int, wides int, noballs int, byes int, legbyes int, is_four boolean, is_six boolean, is_wicket boolean, wicket_kind string, player_out_id string")
    got = {r.player_id: r for r in lookups.analyze_players(balls, who, "p1", "bo leeds").collect()}
    assert sorted(got) == ["p1", "p2"] and (got["p1"].bat_balls, got["p1"].bat_runs, got["p1"].bat_outs, got["p1"].bat_strike_rate) == (2, 4, 1, 200.0)
    assert (got["p2"].bowl_balls, got["p2"].bowl_runs, got["p2"].bowl_wickets) == (3, 5, 1) and got["p2"].bat_runs is None
    best = [(r.role, r.place, r.player_id, r.value) for r in lookups.analyze_matches(balls, 1).collect()]
    assert sorted(best) == [("batting", 1, "p1", 4), ("bowling", 1, "p2", 1)]
    p = spark.range(1).select(lookups.predict(F.lit(1500.0), F.lit(1550.0)).alias("p")).first().p
    assert p.win_probability == 0.5 and p.margin == 0
    with pytest.raises(ValueError):
        lookups.valid_format("t10")


def test_innings_simulation(spark):
    p = spark.createDataFrame([(1, [0.0] * 6 + [1.0]), (2, [1.0] + [0.0] * 6), (3, [0.0] * 7)], "k long, p array<double>")
    got = {r.k: (r.mean_runs, r.mean_wickets) for r in simulate.innings(p, "k", "p", 5, 12, 1).collect()}
    assert got == {1: (72.0, 0.0), 2: (0.0, 10.0), 3: (0.0, 0.0)}


def test_match_documents(spark, tmp_path):
    ball = lambda b, x=0, **k: {"batter": "A", "bowler": "B", "non_striker": "C", "runs": {"batter": b, "extras": x, "total": b + x}, **k}
    doc = {
        "info": {"dates": ["2024-05-01"], "teams": ["Red Sox", "Blue"], "match_type": "T20", "gender": "male", "outcome": {"winner": "Blue", "by": {"wickets": 3}}, "players": {"Red Sox": ["A", "C"], "Blue": ["B"]}, "registry": {"people": {"A": "id-a", "B": "id-b"}}},
        "innings": [{"team": "Red Sox", "overs": [{"over": 0, "deliveries": [ball(4), ball(4, 1, extras={"noballs": 1}), ball(0, wickets=[{"player_out": "A", "kind": "caught", "fielders": [{"name": "F"}]}])]}]}, {"team": "Blue"}],
    }
    (tmp_path / "77.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "78.json").write_text("{broken")
    raw = matches.read_matches(spark, str(tmp_path))
    m = matches.matches(raw).collect()
    assert [(r.match_id, r.win_by, r.win_margin, r.match_type) for r in m] == [("77", "wickets", 3, "t20")]
    d = matches.deliveries(raw).orderBy("ball").collect()
    assert [(r.delivery_id, r.is_four, r.total_runs, r.wickets_fallen) for r in d] == [("77_Red_Sox_1_000_01", True, 4, 0), ("77_Red_Sox_1_000_02", False, 9, 0), ("77_Red_Sox_1_000_03", False, 9, 1)]
    assert {r.bowling_team for r in d} == {"Blue"} and d[2].player_out_id == "id-a" and d[2].fielder1 == "F" and d[0].non_striker_id == "C"
    assert {(r.player_id, r.player_name) for r in matches.players(raw).collect()} == {("id-a", "A"), ("id-b", "B"), ("C", "C")}
    assert matches.innings_totals(matches.deliveries(raw)).first().total_overs == pytest.approx(0.3)


def test_sinks(spark, tmp_path):
    out = str(tmp_path / "t")
    sinks.export(spark.range(10).select("id", (F.col("id") % 2).alias("g")), out, ["g"])
    sinks.replace_partitions(spark.createDataFrame([(99, 1)], "id long, g long"), out, ["g"])
    assert {r.g: (r.rows, r.files) for r in sinks.manifest(spark, out, ["g"]).collect()}[1] == (1, 1)
    assert spark.read.parquet(out).count() == 6
    (tmp_path / "m.csv").write_text("alias,name\nx,X\n")
    assert sinks.lookup_csv(spark, str(tmp_path / "m.csv"), "alias string, name string").collect()[0].name == "X"


def test_incremental_stream(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    df = series(spark, n=10)
    df.where("i < 6").write.parquet(src)
    ingest.load_new(spark, src, ["k", "i"], out, state, df.schema)
    df.where("i >= 4").write.mode("append").parquet(src)
    ingest.load_new(spark, src, ["k", "i"], out, state, df.schema)
    assert spark.read.parquet(out).count() == 30


def test_stream_average_equals_batch(spark, tmp_path):
    src, df, seen = str(tmp_path / "in"), series(spark, n=12), {}
    df.where("i < 5").coalesce(1).write.parquet(src)
    for last in (False, True):
        ema = ingest.running_ema(ingest.files(spark, src, df.schema), "k", ["i"], "x", 0.1, 10.0)
        save = lambda b, _: seen.update({r.k: (r.n, r.ema) for r in b.collect()})
        ema.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        if not last:
            df.where("i >= 5").coalesce(1).write.mode("append").parquet(src)
    want = {r.k: (r.n, pytest.approx(r.ema)) for r in ratings.ema_fold(df, "k", ["i"], "x", 0.1, 10.0).collect()}
    assert seen == want


def test_outcome_model(spark):
    rng = random.Random(5)
    rows = [(g, rng.gauss(0, 1), rng.gauss(0, 1)) for g in range(60) for _ in range(10)]
    df = spark.createDataFrame([(g, x, z, float((x > 0) + (x > 0.8))) for g, x, z in rows], "g long, x double, z double, y double")
    scored = models.out_of_fold(df, "g", ["x", "z"], "y", 3)
    assert scored.count() == len(rows) and scored.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()
    m = models.metrics(scored, "y", []).first()
    assert m.n == len(rows) and m.accuracy > 0.9 and m.log_loss < 0.4
    model = models.fit(df, ["x", "z"], "y")
    parts = models.ablation(model, df, {"by_x": ["x"], "by_z": ["z"]}, [0, 1, 2]).agg(F.avg(F.abs("by_x")).alias("x"), F.avg(F.abs("by_z")).alias("z"), F.count("*").alias("n")).first()
    assert parts.x > 5 * parts.z and parts.n == len(rows)


def test_components_query_takes_every_line(spark, tmp_path):
    from pitchline.plans import relational

    rows = [(i * 7 % 40, i * 11 % 90, float(i % 50), "RAN"[i % 3]) for i in range(70)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    label = {n: n for o, p, *_ in rows for n in (o, -1 - p)}
    for _ in label:
        for o, p, *_ in rows:
            label[o] = label[-1 - p] = min(label[o], label[-1 - p])
    got = {r.node: r.component for r in relational.QUERIES["q_components_all"](spark, str(tmp_path)).collect()}
    assert got == label
