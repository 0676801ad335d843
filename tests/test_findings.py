"""Rows on which registered queries once differed from their SQL, and kernels whose memory once grew with a batch."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa

from timbral.functions import batches, signal
from timbral.operators import rooms
from timbral.plans.catalog import ORACLES, QUERIES


def against_sql(spark, tmp_path, name, streams):
    """A query's rows and its SQL's over events of some users' values in order."""
    start = datetime(2024, 1, 1)
    rows = [(1000 * u + i, start + timedelta(seconds=i), u, "view", v, "{}") for u, x in streams.items() for i, v in enumerate(x)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    return sorted(map(tuple, got.collect())), sorted(con.execute(f"select {', '.join(got.columns)} from ({ORACLES[name]})").fetchall())


def test_locus_equation_between_equal_steps(spark, tmp_path):
    """Steps 87.91 and 87.91000000000001 around a quantile, which lies on the upper one in SQL."""
    streams = {
        0: [50.0, 137.91, 18.15, 88.26, 176.17, 88.26, 0.35, 88.26, 0.35, 88.26, 0.35, 106.8, 123.49],
        1: [50.0, 132.05, 90.88, 49.71, 8.54, 111.82, 152.99, 194.16, 235.33, 276.5, 317.67, 103.91, 150.78, 191.95, 29.17, 93.12, 54.19, 17.54],
        2: [50.0, 137.91, 50.0, 10.62, 98.53, 8.98, 96.89, 8.98, 25.29, 113.2, 81.04, 168.95, 64.43, 152.34, 240.25, 153.13],
    }
    got, want = against_sql(spark, tmp_path, "locus_equation", streams)
    assert len(got) == 3 and got == want


def test_reverberation_time_of_streams_that_end_in_silence(spark, tmp_path):
    """Where nothing is left after a sample the level is minus infinity, not unknown."""
    streams = {0: [5.0, 4.0, 3.0, 0.0], 1: [0.0, 0.0], 2: [9.0], 3: [1.0, 300.0, 2.0, 1.0, 0.0, 0.0], 4: [0.0, 7.0, 7.0]}
    got, want = against_sql(spark, tmp_path, "reverberation_time", streams)
    assert got == want and (0, 2, 2) in got


def test_kernels_see_bounded_work():
    """However many signals a batch holds, a kernel sees some of them; each result comes to its own row."""
    seen = []

    def work(x):
        seen.append(x.size)
        return {"n": x[:, 0], "y": x, "z": np.stack([x, -x], axis=1), "o": [[None, float(v)] for v in x[:, 0]]}

    rng = np.random.default_rng(5)
    rows = [None if i % 97 == 5 else [] if i % 89 == 3 else [float(i), *rng.normal(size=rng.integers(1, 40))] for i in range(3000)]
    rows[7] = [7.0, float("nan"), None, *[1.0] * 20000]
    got = batches.on_signals(work, n="double", y="doubles", z="matrix", o="doubles").func(pa.array(rows)).to_pylist()
    assert max(n for n in seen if n != 20003) <= 1 << 14
    for i, (x, r) in enumerate(zip(rows, got, strict=True)):
        want = None if not x else [0.0 if v is None or v != v else v for v in x]
        assert r == (want and {"n": float(i), "y": want, "z": [want, [-v for v in want]], "o": [None, float(i)]})

    sizes = []
    frames = pd.Series([None if i % 50 == 1 else np.full(32, float(i)) for i in range(3000)])
    found = signal._per_frame(lambda x: (sizes.append(len(x)), x[:, :2])[1]).func(frames)
    assert max(sizes) <= 512 and all((y is None) if x is None else y.tolist() == [i, i] for i, (x, y) in enumerate(zip(frames, found, strict=True)))


def test_a_sweep_in_a_room_is_taken_back_in_one_step():
    rng, tone = np.random.default_rng(6), rooms.sweep(512, 1.0, 7999.0, 16000)
    heard = pa.array([list(rng.normal(size=n)) for n in (3, 40, 40, 7)])
    apart = rooms.sweep_response(tone).func(rooms.played(tone).func(heard).field("y")).to_pylist()
    for a, b in zip(rooms.swept(tone).func(heard).to_pylist(), apart, strict=True):
        assert np.allclose(a["h"], b["h"], atol=1e-12)


def test_noise_groups_rows_in_parts_of_bounded_size(spark, monkeypatch):
    """A task's groups do not grow with the table, and updates are not sorted by client."""
    from timbral.plans import updates

    path = "/root/testdata/sf0.001"
    want = {tuple(r)[:2]: r.noisy for r in updates.gaussian_gradients(spark, path).collect()}
    monkeypatch.setattr(updates, "TASK_ROWS", 100)
    found = updates.gaussian_gradients(spark, path)
    plan = found._jdf.queryExecution().executedPlan().toString()
    parts = -(-spark.read.parquet(f"{path}/lineitem.parquet").count() // 100)
    assert f", {parts})" in plan and "SortMergeJoin" not in plan
    got = {tuple(r)[:2]: r.noisy for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-5 for k in want)
