"""Series, ratings, percentiles and table changes against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchline.operators import asof, graph, innings, models, ratings, windows
from pitchline.sources import matches, sinks, tables
from pitchline.streaming import ingest


def test_series_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 5, 2000)
    d = spark.createDataFrame([(int(i % 2 == 0), i, float(v)) for i, v in enumerate(x)], "k long, t long, v double")
    for step in (lambda i: F.lit(0.5), lambda i: 0.01 + 0.6 * F.exp(-i / 30)):
        out = ratings.ema_series(d, "k", ["t"], "v", step, 3.0).orderBy("t").collect()
        state = {0: (3.0, 0), 1: (3.0, 0)}
        for r in out:
            level, n = state[r.k]
            a = 0.5 if step(F.lit(0))._jc.toString() == "0.5" else 0.01 + 0.6 * math.exp(-n / 30)
            assert r.seen == n and abs(r.before - level) < 1e-9
            state[r.k] = ((1 - a) * level + a * r.v, n + 1)
            assert abs(r.after - state[r.k][0]) < 1e-9


def test_wicket_ratings_by_hand(spark):
    balls = spark.createDataFrame([("t", 1, i, 1, 2, 3, w, "death", 1) for i, w in enumerate((0.0, 1.0, 0.0))], "league string, m long, at long, x long, y long, v long, w double, phase string, tier long")
    rows = ratings.wicket_scan(balls, "league", ["m", "at"], "m", "x", "y", "v", "w", phase="phase", tier="tier").orderBy("batter_before").collect()
    rows = sorted(rows, key=lambda r: (r.batter_before != 1400.0, r.batter_before))
    first = next(r for r in rows if r.batter_before == 1400.0)
    assert abs(first.expected - 0.05) < 1e-12 and abs(first.surprise + 0.05) < 1e-12
    second = next(r for r in rows if abs(r.batter_before - (1400 + 12 * 1.2 * 1.2 * 0.05)) < 1e-9)
    assert abs(second.bowler_before - (1400 - 12 * 1.2 * 1.2 * 0.05)) < 1e-9 and abs(second.venue_before - (1400 - 6.15 * 0.05)) < 1e-9 and second.surprise > 0
    assert min(r.batter_before for r in rows) < 1400 < max(r.bowler_before for r in rows)


def test_percentiles_of_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(None if g == 2 else int(g), None if v == 3 else float(v)) for g, v in zip(rng.integers(0, 3, 400), rng.integers(0, 30, 400))]
    out = {r.g: r for r in windows.exact_percentiles(spark.createDataFrame(rows, "g long, v double"), "g", "v", {"a": 0.1, "b": 0.5, "c": 1.0}).collect()}
    for g in {g for g, _ in rows}:
        values = [v for k, v in rows if k == g and v is not None]
        assert np.allclose([out[g].a, out[g].b, out[g].c], np.percentile(values, [10, 50, 100]))
    assert windows.exact_percentiles(spark.createDataFrame([], "g long, v double"), "g", "v", {"a": 0.5}).count() == 0


def test_null_rules(spark):
    left = spark.createDataFrame([(None, 5), (1, None), (1, 9)], "k long, t long")
    right = spark.createDataFrame([(None, 1, 7), (1, None, 8), (1, 2, 3), (1, 4, None)], "k long, t long, v long")
    assert [(r.k, r.t, r.v) for r in asof.asof_before(left, right, "k", "t", "t", right.v, "v").orderBy("k", "t").collect()] == [(None, 5, None), (1, None, None), (1, 9, None)]
    ranked = windows.average_rank_percent(spark.createDataFrame([(1, 5.0), (2, None), (3, 5.0), (4, 9.0)], "id long, x double"), "x")
    assert {r.id: r.pct and round(r.pct, 4) for r in ranked.collect()} == {1: 50.0, 2: None, 3: 50.0, 4: 100.0}
    rows = spark.createDataFrame([(1, 1, 1, 1.0), (1, 2, 2, None), (1, 3, 3, 5.0)], "k long, day long, tie long, x double")
    assert [r.m for r in windows.prior_mean(rows, "k", "day", "tie", F.col("x"), 5, "m").orderBy("day").collect()] == [None, 1.0, 1.0]


def test_pagerank_ends_when_it_rests(spark):
    e = spark.createDataFrame([(a, b, 1 + a * b % 3, 0.1 * (a + b) % 1, 0.05) for a in range(6) for b in range(10, 15)], "a long, b long, n long, performance double, wickets double")
    a, b = graph.performance_pagerank(e, steps=60, tolerance=1e-9)
    again, _ = graph.performance_pagerank(e, steps=3, tolerance=0.0)
    for side in (a, b, again):
        assert abs(sum(r.rank for r in side.collect()) - 1) < 1e-9


def test_where_given_and_changes(spark):
    d = spark.createDataFrame([(1, "a"), (2, "B%"), (3, None)], "k long, v string")
    assert tables.where_given(d, equals={"k": []}).count() == 0 and tables.where_given(d, equals={"k": [1, 3]}, contains={"v": None}).count() == 2
    assert [r.k for r in tables.where_given(d, contains={"v": "b%"}).collect()] == [2] and tables.where_given(d).count() == 3
    changes = spark.createDataFrame([(2, None), (9, "new"), (9, "twice")], "k long, v string")
    assert {r.k: r.v for r in tables.update_from(d, changes.limit(1), ["k"], ["v"]).collect()} == {1: "a", 2: None, 3: None}
    assert sorted(r.k for r in tables.insert_new(d, changes, ["k"]).collect()) == [1, 2, 3, 9]
    assert sorted(r.k for r in tables.delete_keys(d, changes, ["k"]).collect()) == [1, 3]


def test_match_files(spark, tmp_path):
    one = spark.createDataFrame([(1, "x")], "id long, team string")
    one.coalesce(1).write.parquet(str(tmp_path / "matches_t20_male.parquet"))
    one.select("id").coalesce(1).write.parquet(str(tmp_path / "matches_odi_female.parquet"))
    out = tables.match_files(spark, str(tmp_path), ["t20", "odi", "test"], ["male", "female"]).collect()
    assert sorted((r.format, r.gender, r.team or "") for r in out) == [("odi", "female", ""), ("t20", "male", "x")]
    with pytest.raises(FileNotFoundError):
        tables.match_files(spark, str(tmp_path), ["test"], ["male"])


def test_boosted_models_beat_the_prior_and_survive_saving(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (600, 2))
    y = np.where(x[:, 0] > 0.5, 0, np.where(x[:, 1] > 0, 1, 2))
    d = spark.createDataFrame([(i % 40, float(a), float(b), int(k)) for i, ((a, b), k) in enumerate(zip(x, y))], "g long, a double, b double, k int")
    scored = models.score_boosted(models.fit_boosted(d, ["a", "b"], "k", 3, rounds=5, depth=3), d)
    told = models.metrics(scored.withColumn("one", F.lit(1)), "k", ["one"]).first()
    share = np.bincount(y) / len(y)
    assert told.accuracy > 0.9 and told.log_loss < 0.7 * -(share * np.log(share)).sum()
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in scored.limit(20).collect())
    plain = models.fit(d, ["a", "b"], "k")
    models.save(plain, str(tmp_path / "m"))
    again = models.score(models.load(str(tmp_path / "m")), d).select("p").collect()
    assert again == models.score(plain, d).select("p").collect()
    both = models.stacked(d.withColumn("won", (F.col("k") == 0).cast("int")), "g", ["a", "b"], "k", "won", 3)
    assert both.count() == 600 and models.metrics(both.withColumn("one", F.lit(1)), "won", ["one"]).first().accuracy > 0.85


def test_searches_find_the_least():
    bowl = lambda p: (p[0] - 2) ** 2 + 3 * (p[1] + 1) ** 2
    at, value = models.nelder_mead(bowl, [0.5, 0.5], 0.4, 200, 1e-12)
    assert value < 1e-6 and abs(at[0] - 2) < 1e-2 and abs(at[1] + 1) < 1e-2
    best, value = models.random_search({"x": (0.0, 4.0), "y": (-3.0, 1.0)}, lambda s: bowl([s["x"], s["y"]]), 300)
    assert value < 0.3 and set(best) == {"x", "y"}


def test_elo_losses_by_hand(spark):
    m = spark.createDataFrame([(1, 1, 2, 1.0), (2, 1, 2, 1.0)], "at long, h long, a long, won double")
    out = {(r.k, r.edge): r.log_loss for r in ratings.elo_losses(m, ["at"], "h", "a", "won", [(20, 0), (20, 100)]).collect()}
    second = 1 / (1 + 10 ** (-20 / 400))
    assert abs(out[20, 0] - (math.log(2) - math.log(second)) / 2) < 1e-12 and out[20, 100] < out[20, 0]


def test_state_of_an_innings(spark):
    balls = spark.createDataFrame([(1, 1, 1, 4, 0), (1, 1, 2, 2, 1), (1, 2, 1, 6, 0), (1, 2, 2, 1, 0), (2, 2, 1, 1, 0)], "m long, i long, n long, r long, w long")
    out = {(r.m, r.i, r.n): r for r in innings.ball_state(balls, "m", "i", ["n"], "r", "w", 2).collect()}
    assert (out[1, 1, 2].score, out[1, 1, 2].down, out[1, 1, 2].balls_left, out[1, 1, 2].target) == (4.0, 0, 1, None)
    assert (out[1, 2, 1].target, out[1, 2, 1].needed, out[1, 2, 2].needed, out[1, 2, 2].asked_rate) == (7, 7.0, 1.0, 6.0)
    assert out[2, 2, 1].target is None and out[2, 2, 1].needed is None


def test_loads_each_key_once(spark, tmp_path):
    here, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    for run, ids in enumerate([[1, 2, 2], [2, 3], []]):
        if ids:
            spark.createDataFrame([(i, run) for i in ids], "id long, run long").coalesce(1).write.mode("append").parquet(here)
        ingest.load_new(spark, here, ["id"], out, at)
    assert sorted((r.id, r.run) for r in spark.read.parquet(out).collect()) == [(1, 0), (2, 0), (3, 1)]


def test_sessions_end_after_a_gap(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:{m:02d}:00", 1.0) for m in (0, 3, 20, 22)] + [("b", "2024-03-01 00:00:00", 5.0)]
    spark.createDataFrame(rows, "k string, t string, v double").select("k", F.to_timestamp_ntz("t").alias("t"), "v").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = ingest.session_totals(spark, str(tmp_path / "in"), "t", "k", "v", "10 minutes", home=str(tmp_path / "home")).collect()
    assert sorted((r.k, r.n, r.total) for r in out if r.k == "a") in ([], [("a", 2, 2.0), ("a", 2, 2.0)])


def test_weather_and_aliases(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"latitude": 1.5, "longitude": 2.0, "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [3.5, null], "precipitation": [0.1]}}')
    rows = matches.hourly_weather(spark, str(tmp_path / "w.json")).orderBy("at").collect()
    assert [(r.temperature_2m, r.precipitation, r.cloud_cover) for r in rows] == [(3.5, 0.1, None), (None, None, None)] and rows[1].at.hour == 1
    d = spark.createDataFrame([("MCG",), ("Lord's",), (None,)], "venue string")
    aliases = spark.createDataFrame([("MCG", "Melbourne Cricket Ground")], "alias string, canonical string")
    assert sorted(r.venue or "" for r in matches.with_canonical(d, "venue", aliases).collect()) == ["", "Lord's", "Melbourne Cricket Ground"]


def test_sinks_of_rows_and_manifests(spark, tmp_path):
    import pyarrow as pa

    for k in (1, 2):
        sinks.append_arrow(spark, pa.table({"id": [k, k + 10], "day": ["a", "b"]}), str(tmp_path / "t"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2, 11, 12]
    sinks.export(spark.read.parquet(str(tmp_path / "t")), str(tmp_path / "e"), ["day"])
    sinks.write_manifest(spark, str(tmp_path / "e"), ["day"], str(tmp_path / "m"))
    assert {r.day: r.rows for r in spark.read.json(str(tmp_path / "m")).collect()} == {"a": 2, "b": 2}
    d = tables.with_added(spark.range(1), {"id": "int", "note": "string"})
    assert d.dtypes == [("id", "bigint"), ("note", "string")]


def test_chases_know_how_they_end(spark):
    balls = spark.createDataFrame([(m, i, n, r, 0) for m, rs in ((1, ((3, 3), (4, 4))), (2, ((6, 6), (1, 1)))) for i, x in enumerate(rs, 1) for n, r in enumerate(x)], "m long, i long, n long, r long, w long")
    out = innings.chase_rows(balls, "m", "i", ["n"], "r", "w", 2).collect()
    assert sorted((r.m, r.n, r.won) for r in out) == [(1, 0, 1), (1, 1, 1), (2, 0, 0), (2, 1, 0)] and all(r.run_rate is not None for r in out)


def test_boosted_fits_take_rows_in_small_parts(spark, tmp_path, monkeypatch):
    from pitchline import session

    class Seen:
        def __init__(self, stages):
            pass

        def fit(self, df):
            return df.rdd.getNumPartitions()

    rows = spark.range(0, 20000, 1, 1).select(F.col("id").cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("k"))
    rows.write.parquet(f"{tmp_path}/rows")
    monkeypatch.setattr(models, "Pipeline", Seen)
    monkeypatch.setattr(session, "TASK_BYTES", 1 << 12)
    before = spark.read.parquet(f"{tmp_path}/rows").rdd.getNumPartitions()
    assert min(models.fit_boosted(spark.read.parquet(f"{tmp_path}/rows"), ["a"], "k", 2)) > 4 * before
