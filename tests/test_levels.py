"""Passes by levels against loops over the rows."""

import random

import numpy as np

from pitchline.operators import levels, ratings


def test_numbers_hold_many_keys_and_texts():
    rng = np.random.default_rng(5)
    for keys in (rng.integers(-(2**63), 2**63 - 1, 50_000), rng.integers(0, 3000, 50_000), np.array([f"k{i % 701}" for i in range(50_000)], dtype=object)):
        numbers, seen, at = levels.Numbers(), {}, 7
        for lo in range(0, 50_000, 9999):
            got, new = numbers.of(keys[lo : lo + 9999], at)
            at += new
            for k, n in zip(keys[lo : lo + 9999].tolist(), got.tolist()):
                assert seen.setdefault(k, n) == n
        assert sorted(seen.values()) == list(range(7, at))


def test_no_two_rows_of_a_level_share_an_entity():
    rng = np.random.default_rng(6)
    ids = np.stack([rng.integers(0, 50, 2000), 100 + rng.integers(0, 9, 2000)])
    by, bounds, last, behind = levels.levelled(ids)
    level = np.empty(2000, int)
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        level[by[a:b]] = i
        assert all(len(set(k[by[a:b]].tolist())) == b - a for k in ids)
    for k in range(2):
        for j in range(2000):
            before = [x for x in range(j) if ids[k, x] == ids[k, j]]
            assert behind[k, j] == len(before) and last[k, j] == (before[-1] if before else -1)
            assert all(level[x] < level[j] for x in before)


def test_three_ways_in_levels_equal_one_by_one(spark):
    """More rows than a piece holds, matches across pieces, null players, long absences."""
    rng = random.Random(8)
    rows = [("ab"[i % 3 == 0], i // 7, i, rng.choice([None, *range(40)]), rng.randrange(12), rng.randrange(4), float(rng.randrange(7)), i // 90 + 200 * (i > 15_000)) for i in range(30_000)]
    balls = spark.createDataFrame(rows, "league string, m int, i int, bat int, bowl int, v int, runs double, d int").selectExpr("*", "date_add(date'2020-01-01', d) as day").repartition(3)
    got = {}
    for r in ratings.three_way_scan(balls, "league", ["i"], "m", "bat", "bowl", "v", "runs", day="day").collect():
        got.setdefault((r.league, r.m, r.bat, r.bowl, r.v), []).append((r.batter_before, r.bowler_before, r.venue_before, r.session_before, r.expected))
    want = {}
    for lg in "ab":
        books, match = [ratings._Book(1400.0, 1500.0) for _ in range(3)], None
        for _, m, _, x, y, v, runs, d in (r for r in rows if r[0] == lg):
            if m != match:
                match, session = m, ratings._Book(1400.0, 1500.0)
            entries = list(zip((*books, session), (x, y, v, v), ratings.SHARES, (1, -1, 1, 1)))
            now = [b.read(k, d) for b, k, _, _ in entries]
            expected = min(6.0, max(0.0, 1.3 + sum(w * s * (r - 1400) for (_, _, w, s), (r, _) in zip(entries, now)) * 0.008))
            for (b, k, w, s), (r, n) in zip(entries, now):
                b.write(k, r + (4 + 20 * np.exp(-n / 500)) * w * s * (runs - expected), n + 1, d)
            want.setdefault((lg, m, x, y, v), []).append((*(r for r, _ in now), expected))
    assert got.keys() == want.keys()
    for k, rows in want.items():
        assert np.allclose(sorted(rows), sorted(got[k]), atol=1e-9)
