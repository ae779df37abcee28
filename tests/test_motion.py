"""Motion features, augmentation, smoothing and percentiles against plain loops."""

import numpy as np
import pytest

from strideframe.operators import features, segments, sequence, skeleton

N = 22


def heading(pose):
    across = pose[2] - pose[1] + pose[17] - pose[16]
    forward = np.cross([0, 1, 0], across)
    return forward / np.linalg.norm(forward)


def turned(points, forward):
    """Points after the turn about y that takes forward to +z."""
    c, s = forward[2], -forward[0]
    return points @ np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]]).T


def loop_features(clip, rotations, standing):
    clip = clip - [clip[0, 0, 0], clip[:, :, 1].min(), clip[0, 0, 2]]
    clip = turned(clip, heading(clip[0]))
    rows = []
    for k in range(len(clip) - 1):
        now, after, step = heading(clip[k]), heading(clip[k + 1]), clip[k + 1] - clip[k]
        angle = np.arctan2(-after[0], after[2]) / 2 - np.arctan2(-now[0], now[2]) / 2
        x, _, z = turned(step[0], after)
        local = turned(clip[k] - [clip[k, 0, 0], 0, clip[k, 0, 2]], now)
        feet = [float((step[j] ** 2).sum() < standing) for j in (7, 10, 8, 11)]
        rows.append(np.concatenate([[np.arcsin(np.sin(angle)), x, z, clip[k, 0, 1]], local[1:].ravel(), rotations[k], turned(step, now).ravel(), feet]))
    return np.array(rows), clip


def walk(seed, length):
    """A body that moves and turns a little from frame to frame."""
    rng = np.random.default_rng(seed)
    body, out = rng.normal(size=(N, 3)), []
    for k in range(length):
        a = 0.2 * k
        around = np.array([[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]])
        out.append((body + 0.01 * rng.normal(size=(N, 3))) @ around.T + [0.1 * k, 2, 0.05 * k * k])
    return np.array(out)


@pytest.fixture(scope="module")
def clips(spark):
    made = {"a": walk(1, 9), "b": walk(2, 6), "single": walk(3, 1)}
    turns = {c: np.random.default_rng(9).normal(size=(len(v), 126)) for c, v in made.items()}
    rows = [(c, k, v[k].ravel().tolist(), turns[c][k].tolist(), "other") for c, v in made.items() for k in range(len(v))]
    rows += [("a", None, made["a"][0].ravel().tolist(), None, "no number"), ("b", 99, None, None, "no joints"), ("b", 98, [1.0, 2.0], None, "short")]
    df = spark.createDataFrame(rows, "clip string, frame long, joints array<double>, rotations array<double>, values string")
    return made, turns, df.repartition(3)


def test_motion_features_equal_a_loop(clips):
    made, turns, df = clips
    found = features.motion_features(df, standing=0.02).collect()
    assert {r["clip"] for r in found} == {"a", "b"}
    for c in ("a", "b"):
        rows = sorted((r["frame"], r["values"]) for r in found if r["clip"] == c)
        want, _ = loop_features(made[c], turns[c], 0.02)
        assert [k for k, _ in rows] == list(range(len(want))) and want.shape[1] == 263
        np.testing.assert_allclose([v for _, v in rows], want, atol=1e-9)
    assert features.motion_features(df.limit(0)).count() == 0


def test_recovered_joints_are_the_placed_clip(clips):
    made, turns, df = clips
    found = features.recovered(features.motion_features(df)).where("clip = 'a'").orderBy("frame").collect()
    _, placed = loop_features(made["a"], turns["a"], 0.002)
    np.testing.assert_allclose([r["joints"] for r in found], placed[:-1].reshape(len(found), -1), atol=1e-8)


def test_frames_without_heading_or_rotations_are_null(spark):
    flat = [[0.0] * 66, [1.0] * 66]
    df = spark.createDataFrame([("c", k, j, [0.0] * 126) for k, j in enumerate(flat)], "clip string, frame long, joints array<double>, rotations array<double>")
    assert [r["values"] for r in features.motion_features(df).collect()] == [None]
    pose = walk(4, 2).reshape(2, -1).tolist()
    df = spark.createDataFrame([("c", k, j, None) for k, j in enumerate(pose)], "clip string, frame long, joints array<double>, rotations array<double>")
    assert [r["values"] for r in features.motion_features(df).collect()] == [None]


def test_augmented_clips_equal_a_loop(spark):
    rng = np.random.default_rng(5)
    sources = {"x/MPI_Limits/1": rng.normal(size=(3000, N, 3)), "humanact12/2": rng.normal(size=(30, N, 3)), "other/3": rng.normal(size=(50, N, 3))}
    index = [("x/MPI_Limits/1", "p", 500, 1200), ("x/MPI_Limits/1", "q", 0, 9), ("humanact12/2", "r", 3, 4), ("other/3", "s", 20, 900), ("other/3", "t", 5, 5), ("absent", "u", 0, 9), (None, "v", 0, 9)]
    frames = spark.createDataFrame([(s, k, v[k].ravel().tolist()) for s, v in sources.items() for k in range(len(v))], "source string, frame long, joints array<double>")
    out = features.augmented(frames, spark.createDataFrame(index, "source string, name string, start long, end long")).collect()
    swap = np.arange(N)
    for a, b in skeleton.BODY_PAIRS:
        swap[a], swap[b] = b, a
    want = {}
    for s, name, start, end in index:
        if s not in sources:
            continue
        clip = sources[s]
        if "humanact12" not in s:
            clip = clip[40 if "MPI_Limits" in s else 0 :][2 * start : 2 * end] * [-1, 1, 1]
        for k in range(len(clip)):
            want[name, k], want["M" + name, k] = clip[k], clip[k][swap] * [-1, 1, 1]
    assert len(out) == len(want)
    assert all(np.allclose(r["joints"], want[r["clip"], r["frame"]].ravel()) for r in out)


def test_polynomial_equals_fits_of_windows(spark):
    rng = np.random.default_rng(6)
    curves = {"a": rng.normal(size=9), "b": rng.normal(size=23)}
    df = spark.createDataFrame([(c, k, float(x)) for c, v in curves.items() for k, x in enumerate(v)], "curve string, frame long, v double")
    for r in sequence.polynomial_smooth(df, "v", window=9, order=3).collect():
        y = curves[r["curve"]]
        low = min(max(r["frame"] - 4, 0), len(y) - 9)
        fit = np.polynomial.Polynomial.fit(np.arange(9), y[low : low + 9], 3)
        assert abs(r["smooth"] - fit(r["frame"] - low)) < 1e-9
    with pytest.raises(Exception, match="fewer than the window"):
        sequence.polynomial_smooth(df, "v", window=11).collect()
    assert sequence.polynomial_smooth(df.limit(0), "v").count() == 0


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_percentile_is_exact(spark, share):
    rng = np.random.default_rng(7)
    for values in ([3.0], [1.0, 2.0], rng.integers(0, 5, 400).astype(float).tolist(), rng.normal(size=5000).tolist(), rng.normal(size=20001).tolist()):
        rows = spark.createDataFrame([(x,) for x in [*values, None]], "x double")
        assert abs(sequence.exact_percentile(rows, "x", share).first()["limit"] - np.quantile(values, share)) < 1e-12
    assert sequence.exact_percentile(spark.createDataFrame([], "x double"), "x", share).first()["limit"] is None


def test_runs_at_several_thresholds_equal_single_runs(spark):
    rng = np.random.default_rng(8)
    pairs = spark.createDataFrame([(v, k, float(rng.integers(0, 5)), 0.0, 0.5) for v in range(6) for k in range(20)], "video long, pair_idx long, dx double, dy double, confidence double")
    videos = spark.createDataFrame([(v, 215, 10.0) for v in range(6)], "video long, frames_number long, fps double")
    shifts = (2.5, 4.5)
    single = [segments.steady_segments(pairs, videos, 10, x, 0.2, 1.0) for x in shifts]
    runs = segments.steady_runs(pairs, videos, shifts, frames=10, min_confidence=0.2, min_seconds=1.0)
    want = {(r["video"], k, r["start"], r["end"], r["seg_idx"]) for k, rows in enumerate(single) for r in rows.collect()}
    assert {tuple(r) for r in runs.select("video", "run", "start", "end", "seg_idx").collect()} == want and want
    ends = lambda run, v: sorted((i, s, e) for u, k, s, e, i in want if (u, k) == (v, run))
    for r in segments.compare_runs(runs).collect():
        a, b = ends(0, r["video"]), ends(1, r["video"])
        assert (r["n_a"], r["n_b"]) == (len(a), len(b))
        if len(a) == len(b):
            d = [abs(x - y) for p, q in zip(a, b, strict=True) for x, y in zip(p[1:], q[1:], strict=True)]
            assert (r["mean_distance"], r["std_distance"]) == pytest.approx((np.mean(d), np.std(d)))
        else:
            assert np.isnan(r["mean_distance"])
