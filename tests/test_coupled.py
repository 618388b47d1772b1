"""Rounds, coupled skills and the network of meetings against plain loops."""

import math
import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from pitchline import session
from pitchline.operators import network, ratings, rounds, skills


def near(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) < 1e-9 * max(1, abs(a)))


@pytest.fixture(scope="module")
def matches(spark):
    rng = random.Random(4)
    rows = []
    for i in range(72):
        h, a = rng.sample(range(30), 2) if i % 3 else rng.sample(range(4), 2)  # four sides play more often
        rows.append(("x", i // 4, i, h, a, rng.choice([0.0, 0.5, 1.0]), rng.choice([None, 0.5, 1.5])))
    return spark.createDataFrame(rows, "league string, day int, id int, home long, away long, score double, weight double").cache()


def test_rounds_equal_the_ordered_scan(matches):
    got = {r.id: r for r in rounds.rated_rounds(matches, ["day", "id"], "home", "away", "score").collect()}
    by = {(r.home, r.away, round(r.home_before, 9), round(r.away_before, 9), round(r.change, 9)) for r in ratings.elo_scan(matches, "league", ["day", "id"], "home", "away", "score").collect()}
    assert len(got) == matches.count()
    assert {(r.home, r.away, round(r.home_before, 9), round(r.away_before, 9), round(r.home_change, 9)) for r in got.values()} == by
    seen = defaultdict(set)
    for r in got.values():
        assert not {r.home, r.away} & seen[r.round]  # no side twice in a round
        seen[r.round] |= {r.home, r.away}


def test_rounds_with_starts_pull_factors_and_means(spark, matches):
    starts = spark.createDataFrame([(k, 1300.0 + 10 * k) for k in range(20)], "entity long, start double")
    out = rounds.rated_rounds(matches, ["day", "id"], "home", "away", "score", step=lambda n: 10 + 30 * F.exp(-n / 7), edge=30.0, starts=starts, pull=0.01, factor_home="weight", mean=1450.0, share=0.25).collect()
    base = {k: 1300.0 + 10 * k if k < 20 else 1400.0 for r in out for k in (r.home, r.away)}
    rating, n, offset = dict(base), defaultdict(int), 0.0
    by_round = defaultdict(list)
    for r in out:
        by_round[r.round].append(r)
    for k in sorted(by_round):
        for r in by_round[k]:
            rh, ra = rating[r.home] + offset, rating[r.away] + offset
            assert near(r.home_before, rh) and near(r.away_before, ra)
            gain = r.score - 1 / (1 + 10 ** ((ra - rh - 30) / 400))
            step = lambda c: 10 + 30 * math.exp(-n[c] / 7)  # noqa: B023, E731
            ch = step(r.home) * (1.0 if r.weight is None else r.weight) * gain + 0.01 * (base[r.home] - rh)
            ca = -step(r.away) * gain + 0.01 * (base[r.away] - ra)
            assert near(r.home_change, ch) and near(r.away_change, ca)
            rating[r.home] += ch
            rating[r.away] += ca
            n[r.home], n[r.away] = n[r.home] + 1, n[r.away] + 1
        offset -= 0.25 * (sum(rating.values()) / len(rating) + offset - 1450.0)
    # a side's matches keep their order over the rounds
    for side in base:
        mine = sorted((r.round, (r.day, r.id)) for r in out if side in (r.home, r.away))
        assert [k for _, k in mine] == sorted(k for _, k in mine)


def test_rounds_of_odd_rows(spark):
    schema = "id int, home long, away long, score double, round string"
    rows = [(1, 1, 1, 1.0, "x"), (2, None, 1, 1.0, "x"), (3, 1, 2, None, "x"), (4, 1, 2, 1.0, "x"), (4, 1, 2, 1.0, "x")]
    got = rounds.rated_rounds(spark.createDataFrame(rows, schema), ["id"], "home", "away", "score").collect()
    assert sorted((r.id, r.round, r.home_before) for r in got) == [(4, 0, 1400.0), (4, 1, 1410.0)]
    none = rounds.rated_rounds(spark.createDataFrame([], schema), ["id"], "home", "away", "score")
    assert none.count() == 0 and set(none.columns) == {"id", "home", "away", "score", "home_before", "away_before", "home_change", "away_change", "round"}


@pytest.fixture(scope="module")
def balls(spark):
    rng = random.Random(6)
    day = date(2020, 1, 1)
    rows = [("p" if i % 2 else "q", rng.choice(["a", "b", "", None]), day + timedelta(days=i // 40), i // 20, i, rng.randrange(6), rng.randrange(5), i // 20 % 3, float(rng.choice([0, 0, 1, 4, 6])), rng.random() < 0.1) for i in range(400)]
    return spark.createDataFrame(rows, "pool string, league string, day date, m long, i long, bat long, bowl long, v long, runs double, out boolean").cache()


def test_league_baselines_against_a_loop(balls):
    got = {r.i: r for r in skills.league_baselines(balls, "league", "day", "runs", 50.0).collect()}
    rows = list(got.values())
    every = sum(r.runs for r in rows) / len(rows)
    for r in rows:
        before = [x.runs for x in rows if r.league and x.league == r.league and x.day < r.day]
        w = len(before) / (len(before) + 50)
        assert near(r.baseline, w * sum(before) / len(before) + (1 - w) * every if before else every)


def test_skills_against_a_loop(balls):
    rules = skills.SkillRules(run_step=(0.9, 0.4, 20.0), wicket_step=(0.5, 0.2, 20.0), run_bounds=(0.5, 0.4, 0.05, 0.1))
    rated = skills.skill_scan(skills.league_baselines(balls, "league", "day", "runs"), "pool", ["i"], "m", "bat", "bowl", "v", "runs", "out", 0.05, rules=rules)
    base = {r.i: r for r in skills.league_baselines(balls, "league", "day", "runs").collect()}
    want = {}
    for pool in "pq":
        s, n, last = {}, defaultdict(int), None
        for i in sorted(k for k, r in base.items() if r.pool == pool):
            r = base[i]
            if r.m != last:
                last = r.m
                s["s"], n["s"] = [0.0, 0.0], 0
            keys = (("b", r.bat), ("w", r.bowl), ("v", r.v), "s")
            run, wk = ([s.setdefault(k, [0.0, 0.0])[d] for k in keys] for d in (0, 1))
            e = min(6, max(0, r.baseline + 0.55 * run[0] - 0.3 * run[1] + 0.03 * run[2] + 0.12 * run[3]))
            c = min(0.5, max(0.001, 0.05 + sum(wk)))
            want[pool, r.m, r.bat, r.bowl, r.v, *(round(x, 9) for x in (*run, *wk, e, c))] = 1
            balls_of = [n[k] for k in keys]
            for k, who in enumerate(keys):
                for d, (gap, shares, (most, least, half), bounds) in enumerate(((r.runs - e, rules.run_shares, rules.run_step, rules.run_bounds), (r.out - c, rules.wicket_shares, rules.wicket_step, rules.wicket_bounds))):
                    size = [least + (most - least) * math.exp(-balls_of[k] / half)] * 2 + [0.002 * max(0.2, math.exp(-balls_of[2] / 10000)), 0.01 + 0.04 * math.exp(-balls_of[3] / 150)]
                    value = s[who][d] * (1 - (0.0005, 0.0005, 0.0001, 0.001)[k]) + (-1 if (k, d) == (1, 0) else 1) * size[k] * gap * shares[k]
                    s[who][d] = min(bounds[k], max(-bounds[k], value))
            for who in keys:
                n[who] += 1
    got = {(r.pool, r.m, r.bat, r.bowl, r.v, *(round(x, 9) for x in list(r)[5:])): 1 for r in rated.collect()}
    assert got == want and len(rated.columns) == 15
    assert skills.wicket_rate(balls.limit(0), F.col("out")) == 0.0


def test_rank_by_component(spark):
    e = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 2), (7, 9), (8, 10), (8, 9)], "a long, b long")
    ranks = spark.createDataFrame([(k, 0.1) for k in (1, 2, 3, 7, 8)], "a long, rank double")
    got = {r.a: (r.size, round(r.normalized, 6)) for r in network.rank_by_component(ranks, e).collect()}
    assert got == {1: (5, 0.1), 2: (5, 0.1), 3: (5, 0.1), 7: (4, round(0.1 * 0.8**0.5, 6)), 8: (4, round(0.1 * 0.8**0.5, 6))}


def test_what_ratings_take_from_the_network(spark):
    d = spark.createDataFrame([(0.0,), (50.0,), (100.0,), (None,), (140.0,)], "p double")
    got = d.select(network.step_factor(F.col("p")).alias("f"), network.implied_rating(F.col("p")).alias("r")).collect()
    assert [round(x.f, 4) for x in got[:4]] == [round(0.5 + 1 / (1 + math.exp(4)), 4), 1.0, round(0.5 + 1 / (1 + math.exp(-4)), 4), 1.0]
    assert [x.r for x in got] == [1100.0, 1400.0, 1700.0, 1400.0, 1700.0]
    members = spark.createDataFrame([("x", k) for k in range(12)] + [("x", 1), ("y", 1), (None, 3)], "l string, e long")
    pct = spark.createDataFrame([(k, 5.0 * k) for k in range(11)], "e long, pct double")
    assert [tuple(r) for r in network.league_standing(members, "l", "e", pct).collect()] == [("x", 11, 25.0)]


def test_neighbour_snapshots_equal_the_recount(spark):
    rng = random.Random(2)
    facts = [(rng.randrange(8), rng.randrange(10), rng.randrange(12)) for _ in range(120)] + [(None, 1, 1), (1, None, 2), (1, 2, None)]
    got = {(r.a, r.period): r for r in network.neighbour_snapshots(spark.createDataFrame(facts, "a int, b int, t int"), "a", "b", F.col("t")).collect()}
    known = [f for f in facts if None not in f]
    last = {}
    for t in range(12):
        met, of = defaultdict(set), defaultdict(set)
        for a, b, at in known:
            if at <= t:
                met[a].add(b)
                of[b].add(a)
        for a, bs in met.items():
            now = len(bs), sum(len(of[b]) for b in bs) / len(bs)
            if (a, t) in got:
                r = got[a, t]
                assert r.degree == now[0] and near(r.opponents_degree, now[1]) and near(r.score, 0.2 * now[0] + 0.8 * now[1])
            else:
                assert last.get(a) == now
            last[a] = now


def test_as_of_with_a_hot_key(spark, monkeypatch):
    from pitchline.operators.asof import asof_before

    rng = random.Random(9)
    key = lambda: 1 if rng.random() < 0.6 else rng.choice([2, 3, None])
    left = [(i, key(), rng.choice([None, *range(50)]) if i % 9 == 0 else rng.randrange(50)) for i in range(1500)]
    right = [(key(), rng.choice([None, rng.randrange(50)]), rng.choice([None, rng.randrange(9)])) for _ in range(150)] + [(1, 3, None)]
    a, b = spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, t int, x int")
    for parts, bound in (("1", 0), ("13", 0), ("4", 1 << 20)):
        monkeypatch.setattr(session, "HOT_ROWS", bound)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.id: r.x for r in asof_before(a, b, "k", "t", "t", F.col("x"), "x").collect()}
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        for i, k, t in left:
            before = [(u, x is not None, x or 0) for kk, u, x in right if kk == k and k is not None and u is not None and t is not None and u < t]
            best = max(before, default=(0, False, 0))
            assert got[i] == (best[2] if best[1] else None), (i, k, t)


def test_rosters_against_a_loop(spark):
    from pitchline.operators import rosters

    rng = random.Random(3)
    matches = [(m, t, rng.randrange(12)) for m in range(40) for t in rng.sample(range(3), 2)]
    played = [(m, t, p) for m, t, _ in matches for p in rng.sample(range(9), 5)]
    day = {(m, t): d for m, t, d in matches}
    ms, ps = spark.createDataFrame([*matches, matches[0], (None, 1, 3), (99, 1, None)], "match int, team int, day int"), spark.createDataFrame([*played, played[0], (3, 1, None)], "match int, team int, player int")
    series = [(p, d, float(rng.randrange(100))) for p in range(8) for d in range(12) if rng.random() < 0.4]
    squads = rosters.likely_rosters(ms, ps, n=3, size=4)
    got, rated = defaultdict(list), {}
    for r in squads.collect():
        got[r.match, r.team].append((-r.appearances, r.player))
    for r in rosters.roster_ratings(squads, spark.createDataFrame(series, "player int, day int, rating double"), 50.0).collect():
        rated[r.match, r.team] = (r.players, r.known, r.roster_rating)
    for (m, t), d in day.items():
        past = sorted(((e, k) for (k, u), e in day.items() if u == t and e < d), reverse=True)[:3]
        n = defaultdict(int)
        for _, k in past:
            for p in {p for mm, tt, p in played if (mm, tt) == (k, t)}:
                n[p] += 1
        want = sorted((-c, p) for p, c in n.items())[:4]
        assert sorted(got[m, t]) == want
        if want:
            latest = [max(((e, x) for q, e, x in series if q == p and e < d), default=None) for _, p in want]
            mean = sum(50.0 if x is None else x[1] for x in latest) / len(want)
            assert rated[m, t][:2] == (len(want), sum(x is not None for x in latest)) and near(rated[m, t][2], mean)


@pytest.mark.parametrize("parts, bound", [("11", 0), ("4", 1 << 20)])
def test_series_of_a_hot_key(spark, monkeypatch, parts, bound):
    monkeypatch.setattr(session, "HOT_ROWS", bound)
    rng = random.Random(12)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice([None, *(float(x) for x in range(9))])) for i in range(2500)]
    d = spark.createDataFrame(rows, "i int, k int, x double").repartition(3)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    steps = {"small": lambda n: F.lit(0.05), "large": lambda n: F.lit(0.97), "shrinking": lambda n: 0.1 + 0.8 * F.exp(-n / 40.0)}
    plain = {"small": lambda n: 0.05, "large": lambda n: 0.97, "shrinking": lambda n: 0.1 + 0.8 * math.exp(-n / 40.0)}
    series = {name: ratings.ema_series(d, "k", ["i"], "x", f, 3.0).collect() for name, f in steps.items()}
    bounded = {r.k: (r.n, r.level) for r in ratings.bounded_fold(d.withColumn("x", F.coalesce("x", F.lit(0.0))), "k", ["i"], F.lit(0.9), F.col("x") - 4, -5.0, 6.0, 1.0).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", held)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for name, got in series.items():
        by = {r.i: r for r in got}
        assert len(by) == len(rows) == len(got)
        level, n = defaultdict(lambda: 3.0), defaultdict(int)
        for i, k, x in rows:
            a = plain[name](n[k])
            after = (1 - a) * level[k] + a * (x or 0.0)
            assert by[i].seen == n[k] and near(by[i].before, level[k]) and near(by[i].after, after), (name, i)
            level[k], n[k] = after, n[k] + 1
    for k in (1, 2, None):
        level = 1.0
        mine = [x or 0.0 for _, kk, x in rows if kk == k]
        for x in mine:
            level = min(6.0, max(-5.0, 0.9 * level + x - 4))
        assert bounded[k][0] == len(mine) and near(bounded[k][1], level)


def test_rated_rosters_equal_rosters_then_ratings(spark):
    """Repeated days, players without ratings, ratings that are null, long gaps, matches without players."""
    from pitchline.operators import rosters

    rng = random.Random(21)
    matches = [(m, t, d) for m in range(160) for d in [rng.choice((m // 3, m // 3 * 40))] for t in rng.sample(range(5), 2)]
    played = [(m, t, p) for m, t, _ in matches if rng.random() < 0.9 for p in rng.sample(range(30), rng.randrange(1, 7))]
    series = [(p, d, rng.choice([None, 1400.0 + rng.random()])) for p in range(25) for d in rng.sample(range(2200), 40)]
    frames = spark.createDataFrame(matches, "match int, team int, day int"), spark.createDataFrame(played, "match int, team int, player int"), spark.createDataFrame(series, "player int, day int, rating double")
    for n, size in ((1, 11), (4, 5), (12, 3)):
        want = rosters.roster_ratings(rosters.likely_rosters(*frames[:2], n, size), frames[2], 50.0).collect()
        got = rosters.rated_rosters(*frames, n, size, 50.0).collect()
        rounded = lambda rows: sorted((r.match, r.team, r.players, r.known, round(r.roster_rating, 9)) for r in rows)
        assert rounded(got) == rounded(want) and want


def test_meetings_are_joined_once_for_ranks_and_components(spark, tmp_path):
    from pitchline.plans import coupled

    for name, rows, schema in (
        ("lineitem", [(1, 5), (1, 6), (2, 5), (2, 5)], "l_orderkey long, l_suppkey long"),
        ("orders", [(1, 7), (2, 8)], "o_orderkey long, o_custkey long"),
        ("customer", [(7, 0), (8, 0)], "c_custkey long, c_nationkey int"),
        ("supplier", [(5, 0), (6, 1)], "s_suppkey long, s_nationkey int"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    e = coupled._neighbours(spark, str(tmp_path))
    assert "Join" not in e._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.a, r.b, r.n) for r in e.collect()} == {(7, 5, 1), (8, 5, 2)}
