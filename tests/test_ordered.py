"""Ordered state across batches, documents that drift."""

import math
import random
from datetime import datetime, timedelta

import pytest

from pitchline.streaming import ordered


def _loop(rows, until):
    """Averages of each key in order, up to a time."""
    held, out = {}, {}
    for key, at, tie, value in sorted(rows, key=lambda r: (r[1], r[2])):
        if at <= until:
            n, level = held.get(key, (0, 10.0))
            held[key] = (n + 1, level + (value - level) / (n + 2))
            out[key, at, tie] = (n + 1, level, held[key][1])
    return out


@pytest.mark.parametrize("per_batch", [1, 3])
def test_files_in_any_order_give_the_ordered_pass(spark, tmp_path, per_batch):
    rng = random.Random(per_batch)
    began = datetime(2024, 3, 1)
    rows = [(rng.choice(["a", "b", "c"]), began + timedelta(minutes=rng.randrange(0, 600, 10)), i, float(rng.randrange(50))) for i in range(60)]
    schema = "k string, at timestamp_ntz, id long, x double"
    shuffled = rng.sample(rows, len(rows))
    shuffled[7:7] = [(None, began, 900, 1.0), ("a", None, 901, 1.0), ("a", began, 902, None), shuffled[2]]
    source, home = str(tmp_path / "in"), str(tmp_path / "home")
    step = lambda level, n, value: level + (value - level) / (n + 2)
    run = lambda: ordered.ordered_run(spark, source, "k", "at", "id", "x", step, 10.0, late="2 days", home=home, per_batch=per_batch).collect()
    for i in range(0, 32, 16):
        spark.createDataFrame(shuffled[i : i + 16], schema).coalesce(1).write.mode("append").parquet(source)
    assert run() == []  # within the watermark all rows wait
    for i in range(32, len(shuffled), 16):
        spark.createDataFrame(shuffled[i : i + 16], schema).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([("z", began + timedelta(days=9), 999, 1.0)], schema).write.mode("append").parquet(source)
    got = {(r.k, r["at"], r.id): (r.n, r.before, r.after) for r in run()}
    want = _loop(rows, began + timedelta(days=7))
    assert got.keys() == want.keys()
    assert all(g[0] == w[0] and math.isclose(g[1], w[1]) and math.isclose(g[2], w[2]) for g, w in ((got[k], want[k]) for k in got))


def test_state_is_asked_by_batch_not_by_row(monkeypatch):
    import pandas as pd

    calls = []

    class State:
        def __init__(self):
            self.held = []

        def __getattr__(self, name):
            def call(*x):
                calls.append(name)
                if name == "appendList":
                    self.held += x[0]
                elif name in ("put", "clear"):
                    self.held = list(x[0]) if x else []
                elif name == "update":
                    self.held = x[0]
                elif name == "exists":
                    return bool(self.held)
                elif name == "get":
                    return self.held

            return call

    class Handle:
        getMapState = getListState = getValueState = lambda self, *a: State()
        registerTimer = deleteTimer = lambda self, at: None

    class Watermark:
        getCurrentWatermarkInMs = lambda self: 700

    monkeypatch.setattr(ordered, "PART_ROWS", 64, raising=False)
    p = ordered._InOrder(0.0, lambda level, n, value: level + value)
    p.init(Handle())
    batch = pd.DataFrame({"_key": 1, "_at": 0, "_tie": range(1000), "_value": 1.0, "_ms": range(999, -1, -1)})
    list(p.handleInputRows((1,), iter([batch, batch.assign(_value=2.0)]), None))
    out = pd.concat(p.handleExpiredTimer((1,), Watermark(), None))
    assert len(calls) < 12
    assert out["_ms"].tolist() == list(range(701)) and out["n"].tolist() == list(range(1, 702)) and out["after"].iloc[-1] == 2.0 * 701
