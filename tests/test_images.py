"""Frames, masks and registration against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.operators import images, masks, registration

SPAN = "video string, frame long, height int, width int, channels int, pixels binary"


def test_polygon_spans_fill_what_crossing_counts_fill(spark):
    rng = np.random.default_rng(0)
    shapes = []
    for k in range(60):
        scale = 1.0 if k % 2 else 0.5
        shapes.append([np.round(rng.integers(-6, 30, (int(rng.integers(3, 7)), 2)) * scale, 2) for _ in range(int(rng.integers(0, 4)))])
    shapes += [[np.array([[2, 2], [9, 2], [15, 2]])], [np.array([[1.0, 1.0], [5.0, 5.0]])]]
    rows = [(k, [[(float(x), float(y)) for x, y in p] for p in s]) for k, s in enumerate(shapes)] + [(99, None)]
    df = spark.createDataFrame(rows, "k int, polygons array<array<struct<x: double, y: double>>>")
    spans = masks.polygon_spans(F.col("polygons"), F.lit(18), F.lit(23))
    found = df.select("k", spans.alias("spans"), masks.united(spans).alias("united"), masks.area(spans).alias("area")).collect()
    for r in found:
        want = registration.polygons((18, 23), [p for p in shapes[r["k"]] if len(p) > 2]) if r["k"] != 99 else np.zeros((18, 23))
        assert (images.filled_mask([s.asDict() for s in r["spans"]], 18, 23) == want).all()
        counted = np.zeros((18, 23))
        for s in r["united"]:
            counted[s["top"] : s["bottom"] + 1, s["low"] : s["high"] + 1] += 1
        assert (counted == want).all() and r["area"] == want.sum()
    assert sum(r["area"] > 0 for r in found) > 40


def test_box_spans_keep_to_the_image(spark):
    boxes = [[-3, -2, 4, 1], [3, 0, 30, 5], [20, 20, 30, 30], [5, 5, 4, 6], [4, 1, 4, 9]]
    df = spark.createDataFrame([(1, boxes), (2, None), (3, [])], "k int, boxes array<array<int>>")
    spans = masks.box_spans(F.col("boxes"), F.lit(8), F.lit(10))
    found = {r["k"]: r for r in df.select("k", spans.alias("s"), masks.area(spans).alias("n")).collect()}
    want = registration.rectangles((8, 10), [tuple(b) for b in boxes if b[0] <= b[2] and b[1] <= b[3]])
    assert (images.filled_mask([s.asDict() for s in found[1]["s"]], 8, 10) == want).all() and found[1]["n"] == want.sum()
    assert found[2]["s"] == [] and found[3]["n"] == 0


def test_resizing():
    rng = np.random.default_rng(1)
    image = rng.uniform(size=(12, 20, 3))
    assert images.resized(image, 12, 20) is image
    assert images.resized(image, 4, 5, area=True) == pytest.approx(image.reshape(4, 3, 5, 4, 3).mean(axis=(1, 3)))
    assert images.resized(image[..., 0], 4, 5, area=True) == pytest.approx(image[..., 0].reshape(4, 3, 5, 4).mean(axis=(1, 3)))
    ramp = np.arange(8.0)[None, :] * np.ones((3, 1))
    assert images.resized(ramp, 3, 16)[0] == pytest.approx(np.clip((np.arange(16) + 0.5) / 2 - 0.5, 0, 7))
    assert images.resampling(7, 5, True).sum(axis=1) == pytest.approx(np.ones(5))
    assert images.scaled(1080, 1920, 512) == (288, 512) and images.scaled(9, 7, None) == (9, 7)


@pytest.mark.parametrize("compat", [True, False])
@pytest.mark.parametrize("shape", [(16, 16), (9, 12), (7, 15)])
def test_half_spectra_give_the_pairs_of_whole_ones(shape, compat):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, shape).astype(float)
    stack = np.stack([np.roll(base, (k, 2 * k), (0, 1)) + rng.normal(size=shape) for k in range(6)] + [np.zeros(shape)] * 2)
    whole = [registration.spectrum(x, compat) for x in stack]
    want = [registration.correlate(a, b, compat) for a, b in zip(whole, whole[1:])]
    first, last = images.correlated(stack[:3], None, compat)
    rest, _ = images.correlated(stack[3:], last, compat)
    for (dx, dy, c), (wx, wy, wc) in zip(first + rest, want, strict=True):
        assert c == pytest.approx(wc, abs=1e-9)
        if wc > 1e-6:
            assert (dx, dy) == (wx, wy)


def plain_pairs(video, covers, size, most):
    """pairs of one video's frames by a loop over whole batches."""
    out, before = [], None
    for b in range(-(-len(video) // size)):
        image = np.floor(np.mean(video[b * size : (b + 1) * size], axis=0))
        height, width = registration_size(image.shape, most)
        seen = np.floor(images.resized(image, height, width) + 0.5) if most else image
        for spans in covers.get(b, []):
            mask = np.zeros(image.shape[:2])
            for top, bottom, low, high in spans:
                mask[top : bottom + 1, low : high + 1] = 1
            seen = registration.blend(seen, images.resized(mask, height, width)) if spans else seen
        now = registration.spectrum(np.floor(seen.mean(axis=2) + 1e-9))
        if before is not None:
            out.append((b - 1, *registration.correlate(before, now)))
        before = now
    return out


def registration_size(shape, most):
    k = most / max(shape[:2]) if most else 1
    return (int(shape[0] * k + 0.5), int(shape[1] * k + 0.5)) if most else shape[:2]


@pytest.mark.parametrize(("most", "pixels", "span"), [(None, 1 << 21, 64), (50, 5000, 3)])
def test_frames_in_pairs_out(spark, monkeypatch, most, pixels, span):
    monkeypatch.setattr(images, "PIXELS", pixels)
    monkeypatch.setattr(images, "SPAN", span)
    rng = np.random.default_rng(3)
    videos = {}
    for name, n, shape in (("a", 47, (48, 80, 3)), ("b", 9, (12, 12, 1)), ("c", 3, (18, 30, 3)), ("d", 32, (31, 16, 3))):
        base = rng.integers(0, 256, shape)
        videos[name] = [np.roll(base, (k // 4) % 5, axis=1).astype(np.uint8) for k in range(n)]
    covers = {"a": {0: [[(2, 5, 3, 9)], []], 3: [[], [(0, 9, 10, 20), (4, 17, 12, 25)]], 4: [[(1, 1, 1, 1)], [(3, 9, 3, 9)]]}}
    rows = [(v, k, *x.shape, x.tobytes()) for v, xs in videos.items() for k, x in enumerate(xs)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(r[0], int(r[1]), *map(int, r[2:5]), r[5]) for r in rows], SPAN).repartition(3)
    listed = [(v, b, *([dict(zip(("top", "bottom", "low", "high"), s)) for s in layer] for layer in layers)) for v, bs in covers.items() for b, layers in bs.items()]
    masks_ = spark.createDataFrame(listed, f"video string, batch long, text {masks.SPANS}, persons {masks.SPANS}")
    found = sorted(tuple(r) for r in images.register_frames(df, masks_, size=4, most=most).collect())
    want = sorted((v, *p) for v, xs in videos.items() for p in plain_pairs(xs, covers.get(v, {}), 4, most))
    assert [r[:4] for r in found] == [r[:4] for r in want] and len(found) == 11 + 2 + 7
    assert [r[4] for r in found] == pytest.approx([r[4] for r in want], abs=1e-8)
    assert images.register_frames(df.limit(0), size=4).count() == 0
    means = {(r["video"], r["batch"]): r for r in images.batch_images(df, 4).collect()}
    assert len(means) == 12 + 3 + 1 + 8
    for (v, b), r in means.items():
        some = np.stack(videos[v][4 * b : 4 * b + 4])
        assert r["n_frames"] == len(some) and r["pixels"] == some.mean(axis=0).astype(np.uint8).tobytes()


def test_frames_of_one_batch_share_a_shape(spark):
    df = spark.createDataFrame([("v", 0, 2, 2, 1, b"1234"), ("v", 1, 1, 2, 1, b"12")], SPAN).repartition(2)
    with pytest.raises(Exception, match="differ in shape"):
        images.batch_images(df, 5).collect()
