"""Inertial states: propagation, corrections, reasons, and stream and table."""

import numpy as np
import pandas as pd
import pytest

from terraweave.streaming import inertial as N
from terraweave.streaming.odometry import rotation


def test_a_still_sensor_stays_and_grows_less_sure():
    s = N.Inertial()
    still = (np.zeros(3), np.zeros(3)), (np.array([0, 0, 9.81]), np.array([0, 0, 9.81]))
    before = np.trace(s.cov)
    for _ in range(100):
        s = N.propagate(s, 0.01, *still)
    assert np.allclose(s.p, 0) and np.allclose(s.v, 0) and (np.linalg.eigvalsh(s.cov) > 0).all()
    assert np.trace(s.cov) > before and abs(s.t - 1.0) < 1e-9


def test_the_covariance_is_that_of_many_disturbed_starts():
    rng = np.random.default_rng(0)
    s = N.Inertial(r=rotation(np.array([0.3, -0.2, 0.5])), v=np.array([1.0, 0, 0]), cov=np.diag(np.repeat([1e-3, 1e-3, 1e-3, 1e-4, 1e-3, 1e-3], 3) ** 2))
    gyro, accel = (np.array([0.2, 0.1, -0.1]), np.array([0.3, 0.0, -0.1])), (np.array([0.5, 0.1, 9.8]), np.array([0.4, 0.2, 9.9]))

    def moved(start):
        for _ in range(5):
            start = N.propagate(start, 0.05, gyro, accel, (0, 0, 0, 0))
        return start

    end, errors = moved(s), []
    for x in rng.multivariate_normal(np.zeros(18), s.cov, 4000):
        e = moved(s.moved(x))
        errors.append(np.concatenate([N.rotation_vector(end.r.T @ e.r), e.p - end.p, e.v - end.v, e.bg - end.bg, e.ba - end.ba, e.g - end.g]))
    measured, size = np.cov(np.array(errors).T), np.sqrt(np.outer(np.diag(end.cov), np.diag(end.cov)))
    assert np.abs((measured - end.cov) / size).max() < 0.08


def room(rng, n=300):
    p = rng.uniform(-3, 3, (n, 3))
    return p, np.eye(3)[rng.integers(0, 3, n)]


def test_a_correction_is_found_and_makes_the_state_surer():
    p, n = room(np.random.default_rng(2))
    shift, turn = np.array([0.02, -0.01, 0.015]), rotation(np.array([0.01, -0.02, 0.005]))
    found, report = N.update(N.Inertial(), p, p @ turn.T + shift, n)
    assert report.accepted and report.reason == "accepted" and report.pose_rank == 6 and report.last_rms < report.first_rms
    assert np.allclose(found.p, shift, atol=2e-3) and np.allclose(found.r, turn, atol=2e-3)
    assert np.trace(found.cov[N.POS, N.POS]) < np.trace(N.Inertial().cov[N.POS, N.POS])
    p[:20] += 1.0  # outliers weigh less
    outlying, _ = N.update(N.Inertial(), p, np.concatenate([p[:20] - 1.0, p[20:]]) @ turn.T + shift, n)
    assert np.allclose(outlying.p, shift, atol=2e-2)


@pytest.mark.parametrize("case", ["few", "flat", "far"])
def test_reasons(case):
    p, n = room(np.random.default_rng(3))
    if case == "few":
        p, n, at, why = p[:3], n[:3], p[:3], "too few observations"
    elif case == "flat":
        n, at, why = np.tile([0.0, 0, 1], (len(p), 1)), p, "degenerate geometry"
    else:
        at, why = p + 50.0, "no step within bounds"
    prior = N.Inertial()
    found, report = N.update(prior, p, at, n, limits=N.Limits(rounds=40))
    assert found is prior and not report.accepted and report.reason == why


def test_samples_are_interpolated_and_never_extrapolated():
    t = np.arange(0, 1.01, 0.05)
    samples = np.column_stack([t, np.zeros((len(t), 3)), np.tile([1.0, 0, 9.81], (len(t), 1))])
    s = N.through(N.Inertial(t=0.02), samples, 0.93)
    assert abs(s.t - 0.93) < 1e-12 and np.allclose(s.v, [0.91, 0, 0]) and np.allclose(s.p, [0.91**2 / 2, 0, 0])
    for end, kept in ((1.2, samples), (0.9, np.delete(samples, slice(5, 9), 0))):
        with pytest.raises(ValueError, match="cover"):
            N.through(N.Inertial(t=0.02), kept, end)


def recording(number, rng):
    rows = [(number, k * 0.05, 0, 0, k, *rng.normal(0, 1e-3, 3), *(rng.normal(0, 1e-2, 3) + [0, 0, 9.81]), 0.0, 0.0, 0.0, 0.0) for k in range(42)]
    for f in range(1, 8):
        p, n = room(rng, 200 if f != 4 else 5)
        rows += [(number, f * 0.27, 1, f, k, *p[k], *(p[k] + rng.normal(0, 0.005, 3)), *n[k], 9e-4) for k in range(len(p))]
    return rows


def test_stream_and_table_have_the_same_states(spark, tmp_path):
    frame = pd.DataFrame([r for k in (1, 2) for r in recording(k, np.random.default_rng(k))], columns=N.ROWS)
    whole = spark.createDataFrame(frame)
    src = tmp_path / "in"
    src.mkdir()
    for part, (a, b) in enumerate([(-1, 0.6), (0.6, 1.3), (1.3, 9)]):
        frame[(frame.t > a) & (frame.t <= b)].to_parquet(src / f"{part}.parquet")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    read = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = N.stream(read).writeStream.format("memory").queryName("states").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert q.awaitTermination(180)
    want = sorted(map(tuple, N.table(whole).collect()))
    assert sorted(map(tuple, spark.table("states").collect())) == want and len(want) == 14
    assert [r[3] for r in want if r[1] == 4] == ["too few observations"] * 2 and sum(r[4] for r in want) == 12
    f, out = N.Filter(), []
    for r in [frame[frame.recording == 1].sort_values(N._ORDER[1:])[N._NUMBERS].to_numpy(float)]:
        out = list(f.rows(1, r, last=True))
    assert out == [r for r in want if r[0] == 1]
