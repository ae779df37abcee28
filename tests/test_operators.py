import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.functions import geometry as g
from strideframe.functions import text
from strideframe.operators import features, ingest, manifests, numbering, pca, plugins, prompts, registration, sequence, skeleton, tracks
from strideframe.sources import readers, sinks


def test_tokens_fold_ascii_only(spark):
    df = spark.createDataFrame([("SQUAT day",), ("Приседания",), (None,), ("50% off_x",), ("a\\b",)], "title string")
    hit = lambda t: [r[0] for r in df.where(text.has_token(F.col("title"), t)).collect()]
    assert hit("squat") == ["SQUAT day"]
    assert hit("приседания") == []
    assert hit("0_ off") == ["50% off_x"]
    assert hit("a\\b") == ["a\\b"]


def test_prompt(spark):
    document = json.dumps({"and_tokens": ["deep"], "or_tokens": ["squat", ""], "and_not_tokens": ["jump"], "video_options": {"minimum_duration": 10, "maximum_duration": 20}})
    rows = [("deep squat", 10), ("Deep Squat", 15), ("deep jump squat", 15), ("squat", 15), (None, 15), ("deep squat", 20)]
    df = spark.createDataFrame(rows, "title string, duration long")
    found = prompts.select_videos(df, prompts.Prompt.from_json(document)).collect()
    assert [tuple(r) for r in found] == [("Deep Squat", 15)]


def test_fan_out_keeps_tokens_without_hits(spark):
    df = spark.createDataFrame([("back squat", "x", 1.9, 3.0), ("squat jump", "y", 0.0, 2.5)], "title string, video_id string, start_time double, end_time double")
    counts = {r["token"]: r["n_chapters"] for r in prompts.token_counts(df, ["squat", "jump", "none"]).collect()}
    assert counts == {"squat": 2, "jump": 1, "none": 0, None: 3}
    links = {r["token"]: [r["link"]] for r in prompts.links_from_prompt(df, prompts.Prompt(or_tokens=["jump"])).collect()}
    assert links == {"jump": ["https://youtu.be/y?start=0&end=2"]}


def test_names(spark):
    row = spark.createDataFrame([("https://x/watch?v=abcdefghijk&t=5", 123456, "a.b.mp4", "17.jpg", "30000/1001")], "url string, n long, name string, image string, rate string").select(
        text.id_from_url(F.col("url")).alias("id"), text.zero_pad(F.col("n")).alias("pad"), text.zero_pad(F.lit(7)).alias("seven"), text.stem(F.col("name")).alias("stem"),
        text.short_stem(F.col("name")).alias("short"), text.frame_number(F.col("image")).alias("frame"), text.frame_rate(F.col("rate")).alias("rate"), text.frame_rate(F.lit("1/0")).alias("bad"),
    ).first()
    assert tuple(row)[:6] == ("abcdefghijk", "123456", "00007", "a.b", "a", 17)
    assert abs(row["rate"] - 29.97) < 0.01 and row["bad"] is None


def test_ingest(spark):
    new = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "id string, at long")
    kept = ingest.new_rows(ingest.first_wins(new, "id", "at"), spark.createDataFrame([("c",)], "id string"), "id")
    assert sorted(map(tuple, kept.collect())) == [("a", 1), ("b", 3)]
    assert sorted(map(tuple, ingest.last_wins(new, "id", "at").collect()))[0] == ("a", 2)
    checked = ingest.check_reference(new, spark.createDataFrame([("a",)], "key string"), "id", "key")
    assert checked.accepted.count() == 2 and {r["reason"] for r in checked.rejected.collect()} == {"no parent"}
    videos = spark.createDataFrame([("v", [("intro", 0, 5)])], "id string, chapters array<struct<title:string,start_time:int,end_time:int>>")
    assert tuple(ingest.unfold_chapters(videos).first()) == (1, "intro", 0.0, 5.0, "youtube", "v")


def test_tracks(spark):
    rows = [("v", 1, f) for f in range(2, 122)] + [("v", 2, f) for f in [0, 200, *range(50, 150)]]
    df = spark.createDataFrame(rows, "video string, track int, frame long")
    assert [r["track"] for r in tracks.stable(tracks.extents(df), 100).collect()] == [1]
    pair = spark.createDataFrame([("v", 1, f) for f in range(100)] + [("v", 2, f) for f in range(96, 106)] + [("w", 3, 0)], "video string, track int, frame long")
    found = {(r["track"], r["other"]): r["overlap"] for r in tracks.overlaps(pair).collect()}
    assert found == {(1, 2): 0.04, (2, 1): 0.4}
    assert sorted(r["track"] for r in tracks.single_person(pair).collect()) == [1, 3]
    scored = spark.createDataFrame([("v", 1, 0, 17.0), ("v", 1, 3, 17.0)], "video string, track int, frame long, c double")
    assert tracks.credibility(scored, F.col("c")).first()["credibility"] == 0.5
    ids = lambda *t: spark.createDataFrame([("v", x) for x in t], "video string, track int")
    assert sorted(r["track"] for r in tracks.vote(ids(1, 2), ids(2, 3), ids(3)).collect()) == [2, 3]


def skeletons(spark, arrays):
    return spark.createDataFrame([(c, k, a.reshape(-1).tolist()) for k, (c, a) in enumerate(arrays)], "clip string, frame long, joints array<double>")


def test_heights_and_alignment(spark):
    straight = np.zeros((17, 3))
    for k, y in ((7, 1), (8, 2), (10, 3), (1, 0), (2, -1), (3, -2), (4, 0), (5, -1), (6, -2)):
        straight[k] = (1 if k in (4, 5, 6) else -1 if k in (1, 2, 3) else 0, y, 0)
    assert skeletons(spark, [("a", straight)]).select(skeleton.height(F.col("joints"))).first()[0] == 5.0
    rng = np.random.default_rng(0)
    df = skeletons(spark, [(c, rng.normal(size=(17, 3))) for c in "aabbc"])
    for average in (True, False):
        after = skeleton.height_statistics(skeleton.align_heights(df, in_average=average)).first()
        assert after["std_height"] < 1e-9


def test_root_frame_and_rotations(spark):
    j = np.zeros((17, 3))
    j[4], j[1], j[7] = (1, 0, 0), (0, 0, 0), (0.6, 0.8, 0)
    df = skeletons(spark, [("a", j)])
    axes = df.select(*[c for a in skeleton.root_frame(F.col("joints")) for c in a]).first()
    np.testing.assert_allclose(axes, [1, 0, 0, 0, -0.8, 0, 0, 0, 0.8], atol=1e-12)
    good = np.array(df.select(*[c for a in skeleton.root_frame(F.col("joints"), orthonormal=True) for c in a]).first()).reshape(3, 3)
    np.testing.assert_allclose(good @ good.T, np.eye(3), atol=1e-12)
    assert np.linalg.det(good) > 0.999
    rng = np.random.default_rng(1)
    cloud = skeletons(spark, [("a", rng.normal(size=(22, 3)))])
    twice = skeleton.mirrored(skeleton.mirrored(F.col("joints"), skeleton.BODY_PAIRS, 22), skeleton.BODY_PAIRS, 22)
    a, b = cloud.select("joints", twice).first()
    np.testing.assert_allclose(a, b)
    v, w = (x / np.linalg.norm(x) for x in rng.normal(size=(2, 3)))
    turned = spark.range(1).select(*g.rotate(g.shortest_rotation(g.vector(*map(float, v)), g.vector(*map(float, w))), g.vector(*map(float, v)))).first()
    np.testing.assert_allclose(turned, w, atol=1e-9)
    q = g.quaternion_between(g.vector(*map(float, v)), g.vector(*map(float, w)))
    np.testing.assert_allclose(spark.range(1).select(*g.quaternion_rotate(q, g.vector(*map(float, v)))).first(), w, atol=1e-9)
    np.testing.assert_allclose(spark.range(1).select(*g.quaternion_multiply(q, g.quaternion_inverse(q))).first(), [1, 0, 0, 0], atol=1e-9)


def test_component(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 4)) * [5, 1, 1, 1] + 3
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "frame long, values array<double>")
    got = np.array([r["score"] for r in pca.fit_component(df).transform(df).orderBy("frame").collect()])
    _, _, vt = np.linalg.svd(x - x.mean(0))
    want = (x - x.mean(0)) @ vt[0]
    assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-8
    with pytest.raises(NotImplementedError):
        pca.fit_component(df, neutral=np.zeros(4))


def test_smoothing(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(size=60)
    df = spark.createDataFrame([("c", k, float(v)) for k, v in enumerate(y)] + [("s", k, float(k)) for k in range(4)], "curve string, frame long, v double")
    found = lambda rows: np.array([r["smooth"] for r in rows.where("curve = 'c'").orderBy("frame").collect()])
    w = np.array(sequence.gaussian_weights())
    np.testing.assert_allclose(found(sequence.gaussian_smooth(df, "v")), np.convolve(np.pad(y, 9, mode="symmetric"), w, mode="valid"), atol=1e-9)
    padded = np.pad(y, 15)
    np.testing.assert_allclose(found(sequence.median_filter(df, "v")), [np.median(padded[k : k + 31]) for k in range(60)], atol=1e-12)
    line = spark.createDataFrame([("c", k, 2.0 * k + 0.5 * k * k) for k in range(70)], "curve string, frame long, v double")
    np.testing.assert_allclose(found(sequence.polynomial_smooth(line, "v")), [2.0 * k + 0.5 * k * k for k in range(70)], atol=1e-6)
    with pytest.raises(ValueError):
        sequence.lag_difference(df, "v", 1.5)


def test_registration(spark):
    assert [registration.wrap(k, 64) for k in (62, 4, 63)] == [1, 4, 0]
    assert [registration.wrap(k, 64, compat=False) for k in (62, 4, 63)] == [-2, 4, -1]
    rng = np.random.default_rng(5)
    image = rng.random((32, 32))
    moved = np.roll(image, (2, 4), axis=(0, 1))
    rows = [("v", k, 32, 32, x.reshape(-1).tolist()) for k, x in enumerate((moved, image))]
    df = spark.createDataFrame(rows, "video string, batch long, height int, width int, pixels array<double>")
    found = registration.register(df, compat=False).first()
    assert (found["dx"], found["dy"]) == (4, 2) and found["confidence"] > 0.2
    assert registration.register(df.where("batch = 0")).count() == 0
    assert registration.rectangles((3, 3), [(1, 1, 5, 5)]).sum() == 4
    assert registration.polygons((6, 6), [np.array([[1, 1], [4, 1], [4, 4], [1, 4]])]).sum() == 9


def test_contains_join(spark):
    texts = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again and again"), (2, "short"), (3, None)], "t long, text string")
    parts = spark.createDataFrame([(1, "brown fox jumps over the lazy dog again"), (2, "or"), (3, "lazy dog"), (4, ""), (5, "ort"), (6, None)], "p long, part string")
    found = manifests.contains_join(texts, parts, "t", "text", "p", "part")
    assert sorted(map(tuple, found.collect())) == [(1, 1), (1, 3), (2, 2), (2, 5)]


def test_routes_and_counts(spark):
    files = spark.createDataFrame([("a_nonsteady_1.mp4",), ("a_steady_1.mp4",), ("b.mp4",)], "name string")
    assert [r["bucket"] for r in manifests.route(files, "steady_non_steady").orderBy("name").collect()] == ["nonsteady", "steady", None]
    with pytest.raises(ValueError):
        manifests.route(files, "none")
    train, valid = spark.createDataFrame([("a",), ("a",)], "label string"), spark.createDataFrame([("b",)], "label string")
    assert {tuple(r) for r in manifests.class_counts(train, valid, ["a", "b", "c"]).collect()} == {("a", 2), ("b", 1), ("c", 0)}


def test_recovery_inverts_velocities(spark):
    rows = [("c", k, 0.0, 1.0, 2.0, 5.0) for k in range(4)]
    df = spark.createDataFrame(rows, "clip string, frame long, rv double, vx double, vz double, y double")
    last = features.recover_root(df).orderBy(F.desc("frame")).first()
    assert (last["root_x"], last["root_y"], last["root_z"]) == (3.0, 5.0, 6.0)


def test_readers(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(12.0).reshape(2, 2, 3))
    found = readers.array_rows(readers.read_arrays(spark, str(tmp_path))).orderBy("frame").collect()
    assert [r["joints"] for r in found] == [[0, 1, 2, 3, 4, 5], [6, 7, 8, 9, 10, 11]]
    lines = spark.createDataFrame(list(enumerate(["https://v/1", "  00:00:10 - 00:01:00 = squat", "  00:00:10 - 00:01:00 = squat", "  00:02:00 - 00:01:00 = bad", "", "https://v/2", "  1:00:00 - 1:00:01 = jump"])), "ordinal long, value string")
    assert sorted(map(tuple, readers.annotations(lines).collect())) == [("https://v/1", 10.0, 60.0, "squat"), ("https://v/2", 3600.0, 3601.0, "jump")]
    with pytest.raises(ValueError):
        readers.read_yaml("a: [")


def test_models_are_filed_with_their_schema(spark):
    @plugins.model("pose", "still", "video string, frame long, joints array<double>, mark int")
    class Still:
        def __init__(self, mark):
            self.mark = mark

        def __call__(self, frames):
            return frames[["video", "frame"]].assign(joints=[[float(k)] for k in frames["frame"]], mark=self.mark)

    assert plugins.names("pose") == ["still"] and plugins.names("tracker") == []
    frames = spark.createDataFrame([("v", 1), ("v", 2)], "video string, frame long")
    assert sorted(tuple(r) for r in plugins.apply_model(frames, "pose", "still", mark=7).collect()) == [("v", 1, [1.0], 7), ("v", 2, [2.0], 7)]
    with pytest.raises(ValueError, match="there are"):
        plugins.apply_model(frames, "pose", "unknown")
    with pytest.raises(ValueError, match="lacks"):
        plugins.model("tracker", "half", "video string, frame long")
    with pytest.raises(ValueError):
        plugins.check_size("huge")


def test_clips_are_stacked_and_cut_apart(spark, monkeypatch):
    monkeypatch.setattr(numbering, "SAMPLE", 2)
    monkeypatch.setattr(numbering, "BLOCK", 7)
    rng = np.random.default_rng(9)
    clips = {f"same prefix {k:03d}": int(rng.integers(1, 30)) for k in range(70)}
    rows = [(c, f, f * 1.5) for c, n in clips.items() for f in range(n)]
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([rows[k] for k in order], "clip string, frame long, value double").repartition(6)
    stacked, index = numbering.stack_clips(df)
    assert [tuple(r) for r in stacked.orderBy("row").select("clip", "frame", "value", "row").collect()] == [(*r, k) for k, r in enumerate(sorted(rows))]
    apart = numbering.cut_apart(stacked.select("row", "value"), index)
    assert sorted((r["clip"], r["frame"], r["value"]) for r in apart.collect()) == sorted(rows)
    assert numbering.stack_clips(df.limit(0))[0].count() == 0


def test_chapters_are_numbered_over_all_videos(spark):
    rows = [(f"{p}{k:02d}", None if k % 5 == 4 else [(f"t{j}", j, j + 1) for j in range(k % 4)]) for p in ("aa", "ab", "b") for k in range(12)]
    rows.append(("hot", [(f"t{j}", j, j + 1) for j in range(500)]))
    videos = spark.createDataFrame(rows, "id string, chapters array<struct<title: string, start_time: int, end_time: int>>").repartition(5)
    found = [(r["chapter_id"], r["video_id"], r["title"]) for r in ingest.unfold_chapters(videos, 7).orderBy("chapter_id").collect()]
    want = [(i, t[0]) for i, c in sorted(rows) for t in c or []]
    assert found == [(7 + n, i, t) for n, (i, t) in enumerate(want)]


def test_annotations_keep_to_their_document(spark):
    lines = [("a", 1, "https://v/1"), ("a", 2, "00:00:01 - 00:00:05 = x"), ("b", 1, "00:00:02 - 00:00:03 = y"), ("b", 2, "https://v/2"), ("b", 3, "00:00:04 - 00:00:09 = z")]
    found = readers.annotations(spark.createDataFrame(lines, "document string, ordinal int, value string"), document="document").collect()
    assert {(r["url"], r["label"]) for r in found} == {("https://v/1", "x"), (None, "y"), ("https://v/2", "z")}


def test_short_parts_are_found(spark):
    texts = [(1, "abcdefghij"), (2, "xyz"), (3, ""), (4, "aXbc")]
    parts = [(k, p) for k, p in enumerate(("a", "bc", "cde", "efgh", "defghi", "cdefghij", "zz", "Xbc", ""))]
    found = manifests.contains_join(spark.createDataFrame(texts, "t int, text string"), spark.createDataFrame(parts, "p int, part string"), "t", "text", "p", "part")
    assert {tuple(r) for r in found.collect()} == {(t, k) for t, x in texts for k, p in parts if p and p in x}
    assert manifests.contains_join(spark.createDataFrame(texts, "t int, text string"), spark.createDataFrame([], "p int, part string"), "t", "text", "p", "part").count() == 0


def test_long_videos_are_registered_in_spans(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(16, 16))
    images = [("v", k, 16, 16, np.roll(base, k * (k + 1) // 2 % 5, axis=1).reshape(-1).tolist()) for k in range(23)]
    df = spark.createDataFrame(images, "video string, batch int, height int, width int, pixels array<double>")
    whole = sorted(map(tuple, registration.register(df).collect()))
    monkeypatch.setattr(registration, "SPAN", 4)
    assert len(whole) == 22 and sorted(map(tuple, registration.register(df).collect())) == whole


def test_masks_fade_images(spark):
    image = np.arange(400.0).reshape(20, 20)
    rows = [("plain", 20, 20, image.reshape(-1).tolist(), None), ("boxed", 20, 20, image.reshape(-1).tolist(), [[4, 4, 9, 9], [8, 8, 15, 15]])]
    df = spark.createDataFrame(rows, "name string, height int, width int, pixels array<double>, boxes array<array<int>>")
    found = {r["name"]: np.asarray(r["pixels"]).reshape(20, 20) for r in registration.masked(df, kernel=3, sigma=1.0).collect()}
    mask = registration.unite_masks([registration.rectangles((20, 20), [(4, 4, 9, 9)]), registration.rectangles((20, 20), [(8, 8, 15, 15)])])
    assert (found["plain"] == image).all() and found["boxed"] == pytest.approx(registration.blend(image, mask, 3, 1.0))
    assert found["boxed"][8, 8] == pytest.approx(image.mean()) and found["boxed"][0, 0] == 0
    assert registration.covered(df.where("name = 'boxed'")).first()["covered"] == int(mask.sum())


def test_writers_and_readers(spark, tmp_path):
    rows = spark.createDataFrame([("a__steady_", "s1", 1), ("b", "s2", 2)], "name string, label string, n int")
    sinks.write_by_class(rows, str(tmp_path / "classes"))
    assert {(r["name"], r["n"], r["label"]) for r in readers.class_table(spark, str(tmp_path / "classes")).collect()} == {("a__steady_", "1", "s1"), ("b", "2", "s2")}
    for write, read in ((sinks.write_stage, spark.read.parquet), (sinks.write_documents, spark.read.json), (sinks.write_buckets, spark.read.parquet)):
        path = str(tmp_path / write.__name__)
        write(rows.withColumn("bucket", F.lit("k")), path)
        assert read(path).count() == 2
    sinks.append(rows, str(tmp_path / "table"))
    sinks.append(rows, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 4
    segments_ = spark.createDataFrame([("v", 0, 3)], "video string, start int, end int")
    for name in ("steady", "other", "steady"):
        sinks.write_segments(segments_, str(tmp_path / "segments"), name)
    assert {r["filter_name"] for r in spark.read.parquet(str(tmp_path / "segments")).collect()} == {"steady", "other"}
    (tmp_path / "sheets").mkdir()
    (tmp_path / "sheets" / "chan.csv").write_text("name,url\nx,https://youtu.be/abcdefghijk&t=4\ny,short\n")
    sheet = readers.url_sheets(spark, str(tmp_path / "sheets")).collect()
    assert [(r["channel_id"], r["video_id"]) for r in sheet] == [("@chan", "abcdefghijk")]
    (tmp_path / "one.json").write_text('{"a": 1,\n "b": "x"}')
    assert readers.json_documents(spark, str(tmp_path / "one.json")).first()["b"] == "x" and readers.prompt_of('{"a": 1}') == {"a": 1}
    listed = readers.list_files(spark, str(tmp_path), [".csv"], recursive=True).collect()
    assert "chan" in {r["stem"] for r in listed} and all(r["extension"] == ".csv" and r["size"] > 0 for r in listed)
