"""Updates with error feedback, streams that restart, waveform chunks and sessions that expire."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbral.operators import compression
from timbral.sources.chunks import WaveformChunks
from timbral.streaming import sessions

UPDATES = "round int, client int, param int, place long, value double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def made_updates(rounds=3):
    rng = np.random.default_rng(3)
    rows = [(r, c, p, k, float(np.round(rng.normal(), 3))) for r in range(rounds) for c in (1, 2) for p in (0, 1) for k in range(25) if rng.random() < 0.8]
    return [*rows, (0, 3, 0, 4, None), (1, 3, 0, 9, 2.0), (0, 4, 0, 0, 0.0)]


def plain_rounds(rows, method, share=0.1, bits=8):
    """Each round by loops: {(client, param, place): (sum of values, sum sent, residual)} and all sent."""
    state, sent_of = {}, {}
    for r in sorted({x[0] for x in rows}):
        for g in sorted({x[1:3] for x in rows}):
            own = {x[3]: x[4] or 0.0 for x in rows if x[0] == r and x[1:3] == g}
            old = {k[2]: v for k, v in state.items() if k[:2] == g}
            if not own and not old:
                continue
            places = sorted({*own, *old})
            value = {k: round(own.get(k, 0.0) + (old[k][2] if k in old else 0.0), 9) for k in places}
            if method == "topk":
                keep = set(sorted(places, key=lambda k: (-abs(value[k]), k))[: max(1, int(len(places) * share))])
                sent = {k: value[k] if k in keep else 0.0 for k in places}
            else:
                step = max(map(abs, value.values())) / (2 ** (bits - 1) - 1) or 1.0
                sent = {k: round(value[k] / step) * step for k in places}
            for k in places:
                a, b, _ = old.get(k, (0.0, 0.0, 0.0))
                state[(*g, k)] = (a + own.get(k, 0.0), b + sent[k], value[k] - sent[k])
                sent_of[(r, *g, k)] = sent[k]
    return state, sent_of


@pytest.mark.parametrize("method", ["topk", "quantize"])
def test_rounds_with_feedback(spark, method):
    rows = made_updates()
    found = compression.compress_rounds(spark.createDataFrame(rows, UPDATES), [0, 1, 2], method=method).collect()
    want, _ = plain_rounds(rows, method)
    assert {(r.client, r.param, r.place) for r in found} == set(want)
    for r in found:
        assert (r.plain, r.sent, r.residual) == pytest.approx(want[(r.client, r.param, r.place)], abs=1e-7)
        assert abs(r.plain - r.sent - r.residual) < 1e-7
    first = compression.compress_round(spark.createDataFrame([x for x in rows if x[0] == 0], UPDATES), method=method)
    back = {(r.client, r.param, r.place): r.value for r in compression.decompress(compression.message(first, method), method).collect()}
    for r in first.collect():
        assert abs(back.pop((r.client, r.param, r.place)) - r.sent) < 1e-9
    assert not any(back.values())  # places without an update, below the size, of topk
    with pytest.raises(ValueError):
        compression.compress_round(first, method="other")


@pytest.mark.parametrize("method", ["topk", "quantize"])
def test_feedback_stream_goes_on_after_a_restart(spark, tmp_path, method):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows, seen = made_updates(), []
    try:
        for part in (0, 1, 2):  # each round in a run of its own: state must come back from the checkpoint
            spark.createDataFrame([x for x in rows if x[0] == part], UPDATES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = compression.error_feedback_stream(spark.readStream.schema(UPDATES).parquet(f"{tmp_path}/in"), method)
            q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{tmp_path}/ck").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    seen = spark.read.parquet(f"{tmp_path}/out").collect()
    state, sent = plain_rounds(rows, method)
    got = {(r["round"], r.client, r.param, r.place): r.sent for r in seen}
    assert len(got) == len(seen)
    for k, v in got.items():
        assert abs(sent[k] - v) < 1e-7
    assert {k: v for k, v in sent.items() if abs(v) > 1e-12}.keys() <= got.keys()


def wave_rows(spark, names, n):
    rows = [(f"{x}.wav", 16000, [float(v) for v in np.sin(np.arange(n + k) / 7) * 0.5]) for k, x in enumerate(names)]
    return spark.createDataFrame(rows, "file string, sr int, samples array<double>"), {f: s for f, _, s in rows}


def joined(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.file, r.chunk)):
        out.setdefault(r.file, []).extend(r.samples)
    return out


def test_chunks_as_a_table(spark, tmp_path):
    spark.dataSource.register(WaveformChunks)
    folder = f"{tmp_path}/waves"
    table, plain = wave_rows(spark, ["a", "b", "c"], 5000)
    odd = spark.createDataFrame([("none", 8000, None), ("loud.wav", 8000, [2.0, None, -2.0])], table.schema)
    table.union(odd).repartition(3).write.format("waveform_chunks").mode("append").save(folder)
    assert sorted(os.listdir(folder)) == ["a.wav", "b.wav", "c.wav", "loud.wav", "none.wav"]
    with open(f"{folder}/broken.wav", "wb") as f:
        f.write(b"no waveform")
    rows = spark.read.format("waveform_chunks").option("chunk", 1024).load(folder).collect()
    assert [r.chunk for r in sorted(rows, key=lambda r: (r.file, r.chunk)) if r.file == "a.wav"] == [0, 1, 2, 3, 4] and "broken.wav" not in joined(rows)
    for f, s in plain.items():
        assert np.abs(np.array(joined(rows)[f]) - s).max() < 1e-4
    assert np.allclose(joined(rows)["loud.wav"], [1, 0, -1], atol=1e-4)
    table.limit(1).write.format("waveform_chunks").mode("overwrite").save(folder)
    assert len(os.listdir(folder)) == 1
    with pytest.raises(Exception, match="share"):
        spark.read.format("waveform_chunks").load("s3://bucket/x").collect()


def test_chunk_stream_restarts(spark, tmp_path):
    """Nothing is lost and nothing read twice, over a stop between files and a failure within a batch."""
    spark.dataSource.register(WaveformChunks)
    folder, out, check = f"{tmp_path}/waves", f"{tmp_path}/out", f"{tmp_path}/ck"
    plain = {}
    for k, names in enumerate((["a", "b"], ["c"], ["d", "e"])):
        table, own = wave_rows(spark, names, 3000 + 100 * k)
        plain |= own
        table.write.format("waveform_chunks").mode("append").save(folder)
        chunks = spark.readStream.format("waveform_chunks").option("chunk", 1000).load(folder)
        if k == 1:  # a batch that fails after it was planned

            def broken(batch, number):
                raise RuntimeError("lost")

            q = chunks.writeStream.foreachBatch(broken).option("checkpointLocation", check).start()
            with pytest.raises(Exception, match="lost"):
                q.processAllAvailable()
        append = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)
        q = chunks.writeStream.foreachBatch(append).option("checkpointLocation", check).start()
        q.processAllAvailable()
        q.stop()
    rows = spark.read.parquet(out).collect()
    assert len({(r.file, r.chunk) for r in rows}) == len(rows) and set(joined(rows)) == set(plain)
    assert all(len(joined(rows)[f]) == len(s) and np.abs(np.array(joined(rows)[f]) - s).max() < 1e-4 for f, s in plain.items())


def test_stream_of_files_is_written(spark, tmp_path):
    spark.dataSource.register(WaveformChunks)
    table, plain = wave_rows(spark, ["x", "y"], 2000)
    table.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    q = stream.writeStream.format("waveform_chunks").option("checkpointLocation", f"{tmp_path}/ck").option("path", f"{tmp_path}/out").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(os.listdir(f"{tmp_path}/out")) == ["x.wav", "y.wav"]
    rows = spark.read.format("waveform_chunks").load(f"{tmp_path}/out").collect()
    assert all(np.abs(np.array(joined(rows)[f]) - s).max() < 1e-4 for f, s in plain.items())


def test_sessions_expire_from_their_start(spark, tmp_path):
    """An attempt every 50 seconds does not keep a session alive; an ended one is told once."""
    start = dt.datetime(2024, 1, 1)
    at = lambda s: start + dt.timedelta(seconds=s)
    batches = [
        [("slow", 1, False, at(0)), ("good", 1, False, at(0)), ("quiet", 1, False, at(5))],
        [("slow", 2, False, at(50)), ("good", 2, True, at(60))],
        [("slow", 3, False, at(100)), ("other", 1, False, at(100))],
        [("slow", 4, True, at(150)), ("good", 3, False, at(110))],
        [("other", 2, True, at(200)), ("later", 1, False, at(400))],
        [("later", 2, False, at(401))],
    ]
    schema = "session string, seq int, ok boolean, ts timestamp"
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = sessions.session_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), retries=5)
        keep = lambda batch, number: seen.extend(map(tuple, batch.collect()))
        q = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    states = {}
    for s, state, n in seen:
        states.setdefault(s, []).append((state, n))
    assert states["slow"] == [("pending", 1), ("pending", 2), ("pending", 3), ("expired", 3)]
    assert states["good"] == [("pending", 1), ("verified", 2)]
    assert states["quiet"] == [("pending", 1), ("expired", 1)] and states["other"] == [("pending", 1), ("verified", 2)]
