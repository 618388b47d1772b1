"""Periodic runs against a scan of every period."""

import hashlib
import random
import time

import numpy as np
import pytest

from pitchline.llm import queries, runs


def brute(w, least=runs.LEAST):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def drawn(rng):
    n, kinds = rng.choice([0, 1, 2, 5, 11, 12, 13, 30, 80, 200]), rng.choice([1, 2, 3, 5, 40])
    t = [rng.randrange(kinds) for _ in range(n)]
    if n and rng.random() < 0.5:
        a = rng.randrange(n)
        p = 1 + rng.randrange((n - a) // 3 + 1)
        t = [t[a + (i - a) % p] if i >= a else t[i] for i in range(n)]
    return t


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_runs_against_every_period(monkeypatch, chunk):
    monkeypatch.setattr(runs, "CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(150):
        texts = [drawn(rng) for _ in range(rng.randint(0, 6))]
        got = runs.find(np.array([x for t in texts for x in t], np.int64), [len(t) for t in texts])
        assert list(zip(*(x.tolist() for x in got))) == [(d, *r) for d, t in enumerate(texts) for r in sorted(brute(t), key=lambda r: (r[0], r[2]))]


def test_extensions_against_plain_comparison():
    rng = np.random.default_rng(3)
    for kinds in (1, 2, 3, 20):
        w = np.concatenate(([kinds], rng.integers(0, kinds, 90), rng.integers(0, kinds, 9).repeat(5), [kinds + 1]))
        levels = runs.grammar(w, 2)
        i, j = (x.ravel() for x in np.triu_indices(len(w) - 1, 1))
        i, j = i[i > 0], j[i > 0]
        want = [next(k for k in range(len(w)) if w[a + k] != w[b + k]) for a, b in zip(i, j)]
        assert runs.common_extensions(levels, i, j).tolist() == want
        assert len(levels[-1].symbols) < 8


def test_grammar_spells_the_text():
    w = np.array([5, 1, 1, 1, 2, 1, 2, 1, 2, 3, 3, 6])
    levels = runs.grammar(w, 2)

    def spell(k, i):
        x = levels[k]
        return [int(x.symbols[i])] if k == 0 else [s for c in range(x.first[i], np.append(x.first, len(levels[k - 1].symbols))[i + 1]) for s in spell(k - 1, c)]

    for k, x in enumerate(levels):
        assert [s for i in range(len(x.symbols)) for s in spell(k, i)] == w.tolist()
        by = {}
        for i, s in enumerate(x.symbols):
            assert by.setdefault(int(s), spell(k, i)) == spell(k, i)


def test_one_word_over_and_over_and_long_texts():
    n = 100_000
    began = time.perf_counter()
    assert [x.tolist() for x in runs.find(np.zeros(n, np.int64), [n])] == [[0], [0], [n], [1]]
    rng = np.random.default_rng(5)
    w = np.tile(rng.integers(0, 1000, 30_000), 3)[:-7]
    assert [x.tolist() for x in runs.find(w, [len(w)])] == [[0], [0], [len(w)], [30_000]]
    assert time.perf_counter() - began < 60


def test_texts_with_nulls_repeats_and_clashing_names(spark):
    line = "a b c " * 5 + "x"
    rows = [(2**60 + 1, None, 1), (None, "", 2), (3, " \t\n\x0b\x0c\r", 3), (4, line, 4), (4, line, 4), (5, "é é\u0085" + " z" * 12, 5)]
    d = spark.createDataFrame(rows, "id long, text string, runs int").withColumnRenamed("id", "_n")
    got = sorted(((r["_n"] or 0, r.n_words, [tuple(x) for x in r.runs], bytes(r.collapsed).decode()) for r in runs.find_runs(d).collect()))
    assert got == sorted([(2**60 + 1, 0, [], ""), (0, 0, [], ""), (3, 0, [], ""), *[(4, 16, [(0, 15, 3)], "a b c x")] * 2, (5, 13, [(1, 12, 1)], "é é\u0085 z")])
    assert runs.find_runs(d.limit(0)).count() == 0


def test_query_against_plain_python(spark, tmp_path):
    import zlib

    rng = random.Random(8)
    rows = [(k, " ".join("abcdefgh"[x % 8] for x in drawn(rng)) if k % 9 else None) for k in range(1, 160)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert any(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows)
    for k, t in rows:
        w, h = (t or "").split(), zlib.crc32(str(k).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        found = sorted(brute(w), key=lambda r: (r[0], r[2]))
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in found)]
        r = got[k]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in found)) and r.collapsed_sha256 == sha(" ".join(kept))
