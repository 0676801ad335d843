"""Operators on edge cases: empty input, ties, nulls, silence, single rows; streams and files."""

import json
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbral.functions import signal as S
from timbral.functions import text as T
from timbral.functions import vectors as V
from timbral.operators import evaluation, learning, monitoring, sequence, transcripts, verification
from timbral.sources import wav
from timbral.streaming import sessions



def tones(spark):
    return S.tone(spark, [("a", 200.0, 0.5, 8000), ("b", 400.0, 0.5, 8000), ("c", 150.0, 0.3, 6000), ("quiet", 300.0, 0.0, 4000)])


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0], [3.0, 4.0]), (2, [0.0, 0.0], [1.0, 0.0]), (3, [1.0, float("nan")], [1.0, 1.0])], "id int, a array<double>, b array<double>")
    got = {r.id: r for r in rows.select("id", V.cosine(F.col("a"), F.col("b")).alias("c"), V.unit(F.col("a")).alias("u"), V.has_nan_or_inf(F.col("a")).alias("bad")).collect()}
    assert got[1].c == pytest.approx(1) and got[1].u == pytest.approx([0.6, 0.8])
    assert got[2].c is None and got[2].u is None
    assert [got[i].bad for i in (1, 2, 3)] == [False, False, True]
    peaks = spark.createDataFrame([([0.5, -1.0],), ([0.01, -0.05],), ([2.0, 4.0],)], "a array<double>").select(V.peak_normalized(F.col("a")).alias("p")).collect()
    assert peaks[0].p == [0.5, -1.0] and peaks[1].p == pytest.approx([0.2, -1.0]) and peaks[2].p == pytest.approx([0.5, 1.0])


def test_text(spark):
    rows = spark.createDataFrame([("tide", "diet"), ("", ""), (None, "x")], "a string, b string")
    got = [r.r for r in rows.select(T.sequence_ratio("a", "b").alias("r")).collect()]
    assert got[:2] == [0.25, 1.0] and got[2] is None
    digits = spark.createDataFrame([("1234",), ("123456",), ("1234567",)], "d string")
    assert [r.s for r in digits.select(T.spoken_digits(F.col("d")).alias("s")).collect()] == ["1 2 3 4", "123 456", "123 456 7"]
    words = spark.createDataFrame([(1, "  Go on. Now!  Then"), (2, "   ")], "id int, t string")
    found = transcripts.annotate(words, ["id"], "t", F.lit(4.0)).collect()
    assert len(found) == 1 and [len(s.words) for s in found[0].sentences] == [2, 1, 1]


def test_roc_and_eer(spark):
    rng = random.Random(0)
    rows = [(round(rng.gauss(1 if g else 0, 1), 1), g) for g in [True, False] * 300] + [(None, True)]
    table = spark.createDataFrame(rows, "score double, genuine boolean")
    curve = {r.threshold: r for r in evaluation.roc(table).collect()}
    for t, r in curve.items():
        assert r.tp == sum(g for s, g in rows if s is not None and s >= t) and r.fp == sum(not g for s, g in rows if s is not None and s >= t)
    eer = evaluation.equal_error_rate(evaluation.roc(table)).first()
    assert eer.eer == pytest.approx(min((abs(1 - r.tpr - r.fpr), (1 - r.tpr + r.fpr) / 2) for r in curve.values())[1])
    assert evaluation.roc(table.limit(0)).count() == 0
    assert evaluation.roc(table.where("genuine")).where("fpr is not null").count() == 0


def test_monitoring(spark):
    rows = spark.createDataFrame([("a", i, 1.0 if i < 9 else 2.0) for i in range(10)] + [("b", i, 1.0) for i in range(3)] + [("c", i, float("nan")) for i in range(9)], "k string, t int, v double")
    got = {r.k: r.drift for r in monitoring.drift(rows, ["k"], ["t"], "v").collect()}
    assert got == {"a": True, "b": False, "c": False}
    none = spark.createDataFrame([], "metric string, value double, trained_at timestamp")
    now = spark.sql("select 'accuracy' metric, 0.5D value, timestamp '2024-02-01' now")
    assert monitoring.should_retrain(none, now).first().retrain
    last = spark.sql("select 'accuracy' metric, 0.6D value, timestamp '2024-01-01' trained_at")
    assert monitoring.should_retrain(last, now).first().retrain
    assert not monitoring.should_retrain(last.withColumn("trained_at", F.expr("timestamp '2024-01-30'")), now).first().retrain


def test_sequence(spark):
    flags = [0, 0, 1, 1, 0, 0, 0, 1, 1, 1, 1, 0, 1]
    rows = spark.createDataFrame([("u", i, bool(f)) for i, f in enumerate(flags)], "u string, i int, f boolean")
    assert sorted((r.start, r.end) for r in sequence.segments(rows, ["u"], "f", 2).collect()) == [(2, 4), (7, 11)]
    samples = spark.createDataFrame([("u", i, float(i)) for i in range(10)] + [("short", 0, 1.0)], "u string, i int, x double")
    frames = {(r.u, r.frame): r.x for r in sequence.framed(samples, ["u"], "x", 4, 3).collect()}
    assert frames == {("u", 0): [0, 1, 2, 3], ("u", 1): [3, 4, 5, 6], ("u", 2): [6, 7, 8, 9]}
    silent = spark.createDataFrame([("z", i, 0.0) for i in range(8)], "u string, i int, e double")
    assert not sequence.energy_vad(silent, ["u"], "e").where("speech").count()


def test_learning(spark):
    rows = spark.createDataFrame([(i, "a" if i < 90 else "b" if i < 99 else None) for i in range(100)], "id int, g string")
    got = {r.group_key: r.allocation for r in learning.diversity_allocation(rows, ["g"], 20).collect()}
    assert got == {"g:a": 14, "g:b": 3, "g:unknown": 1}
    assert learning.diverse_sample(rows, "id", ["g"], 20).count() == 18
    updates = spark.createDataFrame([(1, 0, 3.0), (1, 1, 4.0), (2, 0, 0.0)], "c int, i int, v double")
    assert {(r.c, r.i): r.clipped for r in learning.clip_norm(updates, "c", "v", 1.0).collect()} == pytest.approx({(1, 0): 0.6, (1, 1): 0.8, (2, 0): 0.0})
    assert [r.code for r in learning.quantize(updates, ["c"], "v").orderBy("c", "i").collect()] == [95, 127, 0]
    assert spark.range(1).select(learning.gaussian_sigma(1.0, 0.5, 1e-5)).first()[0] == pytest.approx(9.6896, abs=1e-3)
    shares = learning.secret_shares(updates, "v", 3, 1)
    assert shares.count() == 9 and {r.c: r.value for r in learning.reconstruct(shares, ["c"], 3).collect()} == pytest.approx({1: 7.0, 2: 0.0})
    one = verification.profile_covariance(spark.createDataFrame([(1, "s", [1.0, 2.0])], "id int, s string, v array<double>"), "id", "s", "v", 2)
    assert all(r.cov is None for r in one.collect())


def test_kernels(spark):
    frames = sequence.framed(tones(spark), ["utt_id"], "x", 800, 400)
    f0 = frames.select("utt_id", F.get(S.pitch(16000)(F.col("x")), F.lit(0)).alias("f")).groupBy("utt_id").agg(F.median("f").alias("f")).collect()
    assert {r.utt_id: r.f for r in f0 if r.utt_id != "quiet"} == pytest.approx({"a": 200.0, "b": 400.0, "c": 150.0}, rel=0.02)
    spectra = frames.where("utt_id = 'b'").select(S.magnitude_spectrum(1024)(F.col("x")).alias("m")).select(S.centroid(F.col("m"), 16000 / 1024).alias("c")).collect()
    assert all(380 < r.c < 900 for r in spectra)
    x = np.zeros(2000)
    rng = np.random.default_rng(0)
    for i in range(2, 2000):
        x[i] = 1.3 * x[i - 1] - 0.8 * x[i - 2] + rng.normal()
    fit = spark.createDataFrame([(x.tolist(),), ([0.0] * 50,)], "x array<double>").select(S.lpc(2)(F.col("x")).alias("a")).collect()
    assert fit[0].a == pytest.approx([1, -1.3, 0.8], abs=0.08) and fit[1].a == [1, 0, 0]
    rebuilt = S.overlap_add(sequence.framed(tones(spark).where("utt_id = 'c'"), ["utt_id"], "x", 512, 128).select("utt_id", "frame", S.complex_spectrum(512)(F.col("x")).alias("z")), ["utt_id"], 512, 128)
    both = rebuilt.join(tones(spark).where("utt_id = 'c'").withColumnRenamed("x", "y"), ["utt_id", "i"]).where("i between 512 and 5000")
    assert both.agg(F.max(F.abs(F.col("x") - F.col("y")))).first()[0] < 1e-9

    def brute(a, b):
        d = np.full((len(a) + 1, len(b) + 1), np.inf)
        d[0, 0] = 0
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1, j + 1] = abs(a[i] - b[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
        return d[-1, -1]

    pairs = [(rng.normal(size=n).tolist(), rng.normal(size=m).tolist()) for n, m in ((1, 1), (5, 9), (20, 3), (30, 31))]
    got = spark.createDataFrame([*pairs, ([], [1.0]), (None, [1.0])], "a array<double>, b array<double>").select(S.dtw_distance("a", "b").alias("d")).collect()
    assert [r.d for r in got[:4]] == pytest.approx([brute(a, b) for a, b in pairs]) and got[4].d is None and got[5].d is None


def test_files(spark, tmp_path):
    x = 0.5 * np.sin(2 * np.pi * 440 * np.arange(8000) / 16000)
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.wav").write_bytes(wav.encode_wav(x, 16000))
    (tmp_path / "in" / "sub" / "b.c.wav").write_bytes(wav.encode_wav(x, 8000))
    (tmp_path / "in" / "bad.wav").write_bytes(b"RIFFnothing")
    with wave.open(str(tmp_path / "in" / "wide.wav"), "wb") as f:
        f.setparams((2, 3, 16000, 0, "NONE", ""))
        f.writeframes(bytes([0, 0, 64, 0, 0, 192]) * 10)
    (tmp_path / "in" / "sub" / "b.c.metadata.json").write_text(json.dumps({"participant_id": "p1", "quality_score": 20.5}))
    flat = {r.path.rsplit("/", 1)[1]: r for r in wav.read_waveforms(spark, f"{tmp_path}/in", target_sr=16000).collect()}
    assert set(flat) == {"a.wav", "wide.wav"} and np.allclose(flat["a.wav"].samples, x, atol=1e-4)
    assert flat["wide.wav"].channels == 2 and np.allclose(flat["wide.wav"].samples, 0)
    got = {r.file_name: r for r in wav.scan_catalog(spark, f"{tmp_path}/in").collect()}
    assert (got["b.c.wav"].participant_id, got["b.c.wav"].quality_score, got["b.c.wav"].has_transcript, got["b.c.wav"].duration) == ("p1", 20.5, False, 1.0)
    assert got["a.wav"].participant_id == "unknown"
    for day, n in ((1, 1), (2, 5)):
        wav.append_profiles(spark.createDataFrame([("a", f"2024-01-0{day}", n), ("a_b", "2024-01-09", 9)], "speaker_id string, created_at string, n int"), f"{tmp_path}/profiles")
    assert {r.speaker_id: r.n for r in wav.latest_profiles(spark, f"{tmp_path}/profiles").collect()} == {"a": 5, "a_b": 9}


def test_streams(spark, tmp_path):
    rows = [("s1", 1, False), ("s1", 2, True), ("s1", 3, False), *[("s2", i, False) for i in range(6)], ("s3", 1, False)]
    timed = "session string, seq int, ok boolean, ts timestamp"
    spark.createDataFrame(rows, "session string, seq int, ok boolean").withColumn("ts", F.timestamp_seconds(F.col("seq"))).coalesce(1).write.parquet(f"{tmp_path}/timed")
    stream = spark.readStream.schema(timed).parquet(f"{tmp_path}/timed")
    seen = []
    q = sessions.session_stream(stream).writeStream.outputMode("update").foreachBatch(lambda batch, number: seen.extend(batch.collect())).trigger(once=True).option("checkpointLocation", f"{tmp_path}/ck").start()
    q.awaitTermination(60)
    q.stop()
    assert {r.session: (r.state, r.attempts) for r in seen} == {"s1": ("verified", 2), "s2": ("failed", 4), "s3": ("pending", 1)}
    batch = transcripts.session_states(spark.createDataFrame(rows, "session string, seq int, ok boolean"), "session", ["seq"], F.col("ok"))
    assert {r.session: (r.state, r.attempts) for r in batch.collect()} == {"s1": ("verified", 2), "s2": ("failed", 4), "s3": ("pending", 1)}

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("device"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("x"))
    events.coalesce(1).write.parquet(f"{tmp_path}/samples")
    live = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/samples")
    q = sessions.windowed_levels(live, "2 days", "1 day", "1 day").writeStream.outputMode("update").format("memory").queryName("levels").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck2").start()
    q.awaitTermination(60)
    q.stop()
    key = lambda t: sorted((r.device, r.start, r.n, round(r.rms, 6)) for r in t.collect())
    assert key(spark.table("levels")) == key(sessions.windowed_levels(events, "2 days", "1 day"))
