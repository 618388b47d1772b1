"""Joint trees, losses of many settings, additive models and ordered state against plain loops."""

import math
import random

import numpy as np
import pytest

from pitchline.operators import additive, losses, models, trees


@pytest.fixture(scope="module")
def planted(spark):
    """Seven classes by two features and their product; a third feature says nothing, some values are missing."""
    rng = random.Random(11)
    rows = []
    for i in range(3000):
        a, b, c = rng.random(), rng.random(), rng.random()
        y = min(6, int(7 * (a if b < 0.5 else 1 - a)))
        if rng.random() < 0.1:
            y = rng.randrange(7)
        rows.append((i, a, None if rng.random() < 0.05 else b, c, y))
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y int").repartition(4).cache()


def _one_round(rows, edges, classes, depth, step, penalty, least):
    """One round of trees, every split tried in turn: the scores of each row."""
    n = len(rows)
    share = [sum(r[-1] == k for r in rows) / n for k in range(classes)]
    out = np.zeros((n, classes))
    for k in range(classes):
        g = [round((share[k] - (r[-1] == k)) * 2**20) / 2**20 for r in rows]
        h = [round(2 * share[k] * (1 - share[k]) * 2**20) / 2**20] * n
        worth = lambda ids: sum(g[i] for i in ids) ** 2 / (sum(h[i] for i in ids) + penalty)  # noqa: B023, E731

        def grow(ids, left):
            best, halves = 1e-9, None
            if left:
                for f in range(len(edges)):
                    for missing in (False, True):
                        for e in [*edges[f], math.inf]:
                            lo = [i for i in ids if (missing if rows[i][f] is None else rows[i][f] <= e)]
                            hi = [i for i in ids if i not in set(lo)]
                            if min(sum(h[i] for i in lo), sum(h[i] for i in hi)) < least:  # noqa: B023
                                continue
                            gain = worth(lo) + worth(hi) - worth(ids)  # noqa: B023
                            if gain > best + 1e-9:
                                best, halves = gain, (lo, hi)
            if halves:
                for half in halves:
                    grow(half, left - 1)
            else:
                for i in ids:
                    out[i, k] = math.log(share[k]) - step * sum(g[j] for j in ids) / (sum(h[j] for j in ids) + penalty)  # noqa: B023

        grow(list(range(n)), depth)
    return out


def test_a_round_equals_trying_every_split(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(6)]), rng.randrange(5), rng.randrange(3)) for _ in range(120)]
    df = spark.createDataFrame([(i, None if a is None else float(a), float(b), y) for i, (a, b, y) in enumerate(rows)], "id int, a double, b double, y int").repartition(3)
    model = trees.fit_softmax(df, ["a", "b"], "y", 3, rounds=1, depth=2, step=0.3, bins=16)
    want = _one_round(rows, model.edges, 3, 2, 0.3, 1.0, 1.0)
    want = np.exp(want) / np.exp(want).sum(axis=1, keepdims=True)
    got = {r.id: r.p for r in trees.score_softmax(model, df).collect()}
    assert len(got) == 120
    assert max(np.abs(np.array(got[i]) - want[i]).max() for i in got) < 1e-5


def test_joint_trees_learn_and_survive_saving(spark, planted, tmp_path):
    train, rest = planted.where("id % 3 > 0"), planted.where("id % 3 = 0")
    model = trees.fit_softmax(train, ["a", "b", "c"], "y", 7, rounds=8, depth=3, step=0.4)
    loss = {r["round"]: (r.n, r.log_loss) for r in trees.round_losses(model, rest, "y").collect()}
    assert sorted(loss) == list(range(9)) and loss[8][0] == rest.count()
    assert loss[8][1] < loss[4][1] < loss[0][1]
    joint = models.metrics(trees.score_softmax(model, rest), "y", []).first()
    assert math.isclose(joint.log_loss, loss[8][1], rel_tol=1e-9)
    assert joint.accuracy > 0.6
    trees.save_softmax(model, spark, str(tmp_path / "m"))
    again = trees.load_softmax(spark, str(tmp_path / "m"))
    assert again == model
    assert trees.fit_softmax(train.repartition(7), ["a", "b", "c"], "y", 7, rounds=2, depth=3, step=0.4, edges=model.edges) == model.first(2)


def test_trees_of_few_rows(spark):
    schema = "a double, y int"
    nothing = trees.fit_softmax(spark.createDataFrame([], schema), ["a"], "y", 2, rounds=2, depth=2)
    assert nothing.rounds == []
    lone = trees.fit_softmax(spark.createDataFrame([(None, 1), (1.0, None)], schema), ["a"], "y", 2, rounds=2, depth=2)
    p = trees.score_softmax(lone, spark.createDataFrame([(None, 0), (float("nan"), 0), (5.0, 0)], schema)).collect()
    assert len(p) == 3 and all(r.p[1] > 0.99 for r in p)


def _loop_losses(balls, s, wickets):
    """One setting, one ball at a time."""
    total = s.batter_share + s.bowler_share + s.session_share + s.venue_share
    w = {"bat": s.batter_share / total, "bowl": s.bowler_share / total, "at": s.venue_share / total, "now": s.session_share / total}
    state, n, loss = {}, 0, 0.0
    for lg, m, x, y, v, base, hit in balls:
        st = state.setdefault(lg, {"m": None})
        if st["m"] != m:
            st["m"], st["now"], st["seen"] = m, 1400.0, 0
        rate = {"bat": st.get(("x", x), (1400.0, 0)), "bowl": st.get(("y", y), (1400.0, 0)), "at": st.get(("v", v), (1400.0, 0))}
        gap = {k: r - 1400 for k, (r, _) in rate.items()} | {"now": st["now"] - 1400}
        if wickets:
            p = min(0.999, max(0.001, base))
            z = math.log(p / (1 - p)) + (-w["bat"] * gap["bat"] + w["bowl"] * gap["bowl"] + w["at"] * gap["at"] + w["now"] * gap["now"]) / s.scale
            e = min(0.999, max(0.001, 1 / (1 + math.exp(-z))))
            loss -= math.log(e) if hit else math.log(1 - e)
        else:
            e = base + (w["bat"] * gap["bat"] - w["bowl"] * gap["bowl"] + w["at"] * gap["at"] + w["now"] * gap["now"]) * s.scale / 100
            e = min(6.0, max(0.01, e))
            loss += e - hit * math.log(e)
        d = hit - e
        size = lambda t, k: t[1] + (t[0] - t[1]) * math.exp(-k / t[2])
        sign = -1 if wickets else 1
        for name, key, t, side in (("bat", ("x", x), s.player, sign), ("bowl", ("y", y), s.player, -sign), ("at", ("v", v), s.venue, 1)):
            r, k = rate[name]
            st[key] = (r + side * size(t, k) * d, k + 1)
        st["now"] += max(s.session[0] * math.exp(-st["seen"] / s.session[2]), s.session[1]) * d
        st["seen"] += 1
        n += 1
    return n, loss / n


@pytest.mark.parametrize("wickets", [False, True])
def test_losses_of_settings_are_those_of_single_runs(spark, wickets):
    rng = random.Random(8)
    balls = [(rng.choice(["p", "q", None]), i // 10, rng.choice([None, 1, 2, 3]), rng.randrange(4), rng.choice(["u", "v"]), rng.choice([None, 0.1, 0.3]) if wickets else rng.choice([None, 1.2, 1.5]), rng.choice([None, 0, 1]) if wickets else rng.choice([0, 1, 4, 6]), i) for i in range(400)]
    balls = [(*b[:5], b[5], None if b[6] is None else float(b[6]), b[7]) for b in balls]
    df = spark.createDataFrame(balls, "league string, match int, bat int, bowl int, venue string, base double, hit double, at int").repartition(5)
    settings = [losses.Setting((rng.uniform(10, 40), 4.0, 60.0), (8.0, 1.0, 200.0), (12.0, 3.0, 30.0), rng.uniform(0.3, 1), 0.3, 0.2, 0.1, 200.0 if wickets else 1.5) for _ in range(5)]
    got = {r.setting: (r.n, r.loss) for r in losses.setting_losses(df, "league", ["at"], "match", "bat", "bowl", "venue", "base", "hit", settings, wickets).collect()}
    known = [b[:7] for b in balls if b[5] is not None and b[6] is not None]
    assert sorted(got) == list(range(5))
    for i, s in enumerate(settings):
        n, loss = _loop_losses(known, s, wickets)
        assert got[i][0] == n and math.isclose(got[i][1], loss, rel_tol=1e-9)
    with pytest.raises(ValueError):
        losses.setting_losses(df, "league", ["at"], "match", "bat", "bowl", "venue", "base", "hit", [])


def _dense(rows, model, shrink, logistic):
    """The same curves and effects by one dense system over all rows and venues."""
    from pitchline.operators.additive import _basis

    blocks, penalty, at = [np.ones((len(rows), 1))], [], 1
    for j, c in enumerate(model.curves):
        x = np.array([np.nan if r[j] is None else r[j] for r in rows], dtype=float)
        b = _basis(x, c.low, c.high, c.parts)
        known = ~np.isnan(x)
        blocks.append((b - b[known].mean(axis=0)) * known[:, None])
        d = np.diff(np.eye(c.parts + 3), 2, axis=0)
        penalty.append((at, c.penalty * d.T @ d))
        at += c.parts + 3
    places = sorted({str(r[-2]) for r in rows})
    blocks.append(np.array([[float(str(r[-2]) == v) for v in places] for r in rows]))
    x, y = np.concatenate(blocks, axis=1), np.array([r[-1] for r in rows], dtype=float)
    s = np.zeros((x.shape[1],) * 2)
    for a, m in penalty:
        s[a : a + len(m), a : a + len(m)] = m
    s[at:, at:] = shrink * np.eye(len(places))
    w, z, beta = np.ones(len(y)), y, None
    for _ in range(60 if logistic else 1):
        if logistic:
            e = np.zeros(len(y)) if beta is None else x @ beta
            p = 1 / (1 + np.exp(-e))
            w, z = p * (1 - p), e + (y - p) / (p * (1 - p))
        beta = np.linalg.lstsq(x.T @ (x * w[:, None]) + s, x.T @ (w * z), rcond=1e-12)[0]
    e = x @ beta
    return 1 / (1 + np.exp(-e)) if logistic else e


@pytest.mark.parametrize("logistic", [False, True])
def test_additive_model_equals_a_dense_solve(spark, tmp_path, logistic):
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        a, b, v = rng.random() * 4, rng.gauss(0, 1), rng.choice(["x", "y", "z", None])
        e = math.sin(a) + 0.3 * b + {"x": 0.5, "y": -0.5, "z": 0.2, None: 0.0}[v]
        y = float(rng.random() < 1 / (1 + math.exp(-e))) if logistic else e + rng.gauss(0, 0.1)
        rows.append((None if rng.random() < 0.05 else a, None if rng.random() < 0.05 else b, v, y))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a double, b double, v string, y double").repartition(3)
    model = additive.fit_additive(df, {"a": 6, "b": 4}, "y", "v", logistic, "id", shrink=3.0, penalties=(2.0,), tolerance=1e-9)
    additive.save_additive(model, spark, str(tmp_path / "m"))
    got = {r.id: r.expected for r in additive.score_additive(additive.load_additive(spark, str(tmp_path / "m")), df, "v").collect()}
    want = _dense(rows, model, 3.0, logistic)
    assert len(got) == 400 and max(abs(got[i] - want[i]) for i in got) < 1e-6


def test_additive_model_finds_a_planted_curve(spark):
    rng = random.Random(6)
    truth = lambda a, v: math.sin(2 * math.pi * a) + (v - 5) / 10
    rows = [(i, a := rng.random(), b := rng.random(), v := int(i % 3 and rng.randrange(10)), truth(a, v) + rng.gauss(0, 0.3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, a double, b double, v int, y double")
    model = additive.fit_additive(df, {"a": 12, "b": 12}, "y", "v", group="id", penalties=(1e-2, 1.0, 1e2, 1e5))
    assert model.curves[0].penalty < model.curves[1].penalty  # the column that says nothing is held straight
    scored = additive.score_additive(model, df, "v").collect()
    assert sum((r.expected - truth(r.a, r.v)) ** 2 for r in scored) / 3000 < 0.005
    new = additive.score_additive(model, spark.createDataFrame([(None, float("nan"), 77), (0.25, 0.5, None)], "a double, b double, v int"), "v").collect()
    assert abs(new[0].expected - model.level) < 1e-9 and abs(new[1].expected - model.level - 1) < 0.5
    assert model.effects.agg({"weight": "sum"}).first()[0] == 3000


def test_equal_rows_are_fitted_as_one(spark, monkeypatch):
    from pyspark.sql import functions as F

    sizes, plain = [], trees._histogram

    def seen(rows, *a):
        sizes.append((rows.count(), rows.agg(F.sum("_n")).first()[0]))
        return plain(rows, *a)

    monkeypatch.setattr(trees, "_histogram", seen)
    rows = spark.range(600).select((F.col("id") % 6).cast("double").alias("x"), (F.col("id") % 3).cast("int").alias("k"))
    fit = lambda d: trees.fit_softmax(d, ["x"], "k", 3, rounds=2, depth=2, edges=[[0.5, 1.5, 2.5, 3.5, 4.5]])
    model = fit(rows)
    assert sizes == [(6, 600)] * 4
    monkeypatch.setattr(trees.F, "approx_count_distinct", lambda c: F.lit(10**9))
    assert fit(rows) == model and sizes[4:] == [(600, 600)] * 4


def test_a_task_sums_a_venue_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    sizes, plain = [], additive.cut

    def seen(df):
        out = plain(df)
        if "venue" in out.columns and "fold" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(additive, "cut", seen)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    rows = spark.range(0, 2000, 1, 4).select(F.col("id"), (F.col("id") % 3).alias("v"), (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    try:
        model = additive.fit_additive(rows, {"x": 3}, "y", "v", group="id")
        assert sizes[0] <= 4 * (3 * 4 + 4)  # four tasks, three venues, four folds and their matrices; not again for each batch
        monkeypatch.setattr(additive, "HELD", 1)
        again = additive.fit_additive(rows, {"x": 3}, "y", "v", group="id")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sizes[1] > sizes[0] and np.allclose(again.curves[0].weights, model.curves[0].weights)
