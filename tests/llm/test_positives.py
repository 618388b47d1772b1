"""The classifier: its features and risk against plain loops, its accuracy on held-out rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from pitchline.llm import positives, queries

TEXTS = ["", None, " \n\t ", "One word", "a a a b", "É é | x!!\u0085y", "9" * 300 + " tail"]


def rows_of(texts):
    return positives.Rows(*positives.features([None if t is None else t.encode() for t in texts]))


def test_features_against_plain_loops():
    got = rows_of(TEXTS)
    alone = [rows_of([t]) for t in TEXTS]
    for k, t in enumerate(TEXTS):
        span = slice(got.bounds[k], got.bounds[k + 1])
        assert got.at[span].tolist() == alone[k].at.tolist() and got.x[span].tolist() == alone[k].x.tolist()
        at, x = got.at[span], got.x[span]
        words = (t or "").encode().split()
        in_words = (at < positives._TRIPLES).nonzero()[0]
        same = Counter(w.lower() for w in words)  # bytes: A-Z alone
        assert sorted(np.round(x[in_words], 5)) == pytest.approx(sorted(math.sqrt(n / len(words)) for n in same.values()), abs=1e-5)
        kind = [0, *positives._CLASS[np.frombuffer((t or "").encode(), np.uint8)].tolist(), 0]
        triples = Counter((a * positives._KINDS + b) * positives._KINDS + c + positives._TRIPLES for a, b, c in zip(kind, kind[1:], kind[2:]))
        mine = {int(p): v for p, v in zip(at, x) if positives._TRIPLES <= p < positives._SHAPES}
        assert mine == pytest.approx({p: math.sqrt(n / (len(kind) - 2)) for p, n in triples.items()}, abs=1e-5)
        assert (at >= positives._SHAPES).sum() == 4 and at.max(initial=0) < positives.DIMS


def test_weighted_sums_against_loops():
    r = rows_of(TEXTS)
    w = np.random.default_rng(1).normal(size=positives.DIMS + 1)
    spans = [range(a, b) for a, b in zip(r.bounds, r.bounds[1:])]
    assert r.score(w).tolist() == pytest.approx([sum(r.x[k] * w[r.at[k]] for k in s) + w[-1] for s in spans])
    g = np.arange(len(TEXTS)) - 2.5
    want = np.zeros(positives.DIMS + 1)
    for s, v in zip(spans, g):
        want[-1] += v
        for k in s:
            want[r.at[k]] += v * r.x[k]
    assert r.back(g).tolist() == pytest.approx(want.tolist())
    some = r.take(np.array([4, 0, 4]))
    assert some.score(w).tolist() == pytest.approx(r.score(w)[[4, 0, 4]].tolist())


def test_steps_go_down_the_risk():
    good, any_ = rows_of(["fine text here", "more fine text"]), rows_of(["fine words text", "B@D $$$ %%%", "B@D &&& ***"])

    def risk(w, prior=0.4):
        l = lambda z: np.logaddexp(0, -z).mean()  # noqa: E731, E741
        return prior * l(good.score(w)) + max(0.0, l(-any_.score(w)) - prior * l(-good.score(w)))

    w = positives.fit_risk(good, any_, 0.4, steps=1, rate=1e-3, decay=0)
    start = np.zeros(positives.DIMS + 1)
    slope = -w / 1e-3  # of the risk at zero
    for k in (*np.flatnonzero(slope)[:20], positives.DIMS):
        up, down = start.copy(), start.copy()
        up[k], down[k] = 1e-5, -1e-5
        assert (risk(up) - risk(down)) / 2e-5 == pytest.approx(slope[k], abs=1e-4)
    assert risk(positives.fit_risk(good, any_, 0.4)) < 0.5 * risk(start)


def test_prior_of_planted_scores():
    rng = np.random.default_rng(2)
    for prior in (0.2, 0.5, 0.9):
        any_ = np.concatenate((rng.normal(3, 1, int(20000 * prior)), rng.normal(-3, 1, int(20000 * (1 - prior)))))
        assert prior - 0.04 < positives.best_bin_prior(rng.normal(3, 1, 10000), any_) < prior


def made(n, rng):
    words = ["the", "of", "and", "river", "stone", "light", "house", "green", "walks", "slowly"]
    for k in range(n):
        w = [words[x] for x in rng.integers(0, len(words), int(rng.integers(20, 80)))]
        bad = k % 4 == 0
        kind = k // 4 % 3
        if bad:
            w = [x.upper() + "!!" for x in w] if kind == 0 else [x + "$$" for x in w] if kind == 1 else [w[0]] * len(w)
        yield k + 1, " ".join(w), int(not bad)


def test_query_on_held_out_rows(spark, tmp_path):
    rows = list(made(3000, np.random.default_rng(9)))
    d = [(k, t) for k, t, _ in rows] + [(None, "x"), (5000, None), (5001, ""), (7, rows[6][1])]
    spark.createDataFrame(d, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, y) for k, _, y in rows if k % 2] + [(None, 1), (9999, 1), (3, 0), (11, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op13_quality_classifier(spark, str(tmp_path)).collect()
    again = queries.op13_quality_classifier(spark, str(tmp_path)).collect()
    key = lambda r: (r.doc_id or 0, r.score)
    assert sorted(got, key=key) == sorted(again, key=key) and len(got) == len(d)
    good = {k: y for k, _, y in rows}
    tested = [r for r in got if r.held_out and r.doc_id in good]
    assert {r.doc_id for r in tested} == {k for k in good if zlib.crc32(str(k).encode()) % 5 == 0}
    assert sum(r.predicted == good[r.doc_id] for r in tested) > 0.97 * len(tested)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    for d, t in ((docs, none), (docs.limit(0), none), (docs, docs)):
        assert [r.score for r in positives.score(docs, positives.fit(d, t)).collect()] == [0.5]
    held = docs.select("doc_id", "text", positives.F.lit(3).alias("Score"), positives.F.array("doc_id").alias("_text"))
    assert positives.score(held, positives.fit(docs, none)).columns == ["doc_id", "_text", "score"] and positives.score(held.limit(0), positives.fit(docs, none)).count() == 0
