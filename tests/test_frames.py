"""Uncompressed frames, measures of them, content hashes, uploads, table functions and progress."""

import hashlib
import math

import numpy as np
import pytest
from gatelight.functions import tables
from gatelight.operators import crop, folds, kernels
from gatelight.sources import frames, store
from gatelight.streaming import progress
from pyspark.sql import functions as F


def film(path, pictures, space="444", fps="10:1", broken=()):
    """Write grey-scale or Y/U/V pictures (three planes each) as a film."""
    h, w = pictures[0][0].shape
    with open(path, "wb") as f:
        f.write(f"YUV4MPEG2 W{w} H{h} F{fps} Ip A1:1 C{space}\n".encode())
        for k, planes in enumerate(pictures):
            f.write(b"BROKE\n" if k in broken else b"FRAME\n")
            for p in planes:
                f.write(p.astype(np.uint8).tobytes())


def scene(rng, w=64, h=48):
    return [rng.integers(16, 236, (h, w)), *(np.full((h, w), rng.integers(40, 216)) for _ in range(2))]


@pytest.fixture
def source(spark):
    frames.register(spark)
    return lambda path, **o: spark.read.format("raw_frames").options(**o).load(str(path))


def test_frames_of_a_film(source, tmp_path):
    rng = np.random.default_rng(1)
    pictures = [scene(rng) for _ in range(30)]
    film(tmp_path / "a.y4m", pictures)
    film(tmp_path / "b.y4m", [[p[0]] for p in pictures[:5]], space="mono", fps="30000:1001")
    (tmp_path / "note.txt").write_text("no film")
    picture = rng.integers(0, 256, (7, 5, 3)).astype(np.uint8)
    (tmp_path / "c.ppm").write_bytes(b"P6\n# made by hand\n5 7\n255\n" + picture.tobytes())
    rows = {(r.path.rsplit("/", 1)[1], r.frame): r for r in source(tmp_path, rangeBytes=100_000).collect()}
    assert {k: sum(name == k for name, _ in rows) for k in ("a.y4m", "b.y4m", "c.ppm")} == {"a.y4m": 30, "b.y4m": 5, "c.ppm": 1}
    assert bytes(rows["c.ppm", 0].rgb) == picture.tobytes() and rows["b.y4m", 3].t == pytest.approx(3 * 1001 / 30000)
    y, u, v = (p.astype(float) for p in pictures[4])
    red = np.clip(np.rint((y - 16) * 255 / 219 + 1.402 * 255 / 224 * (v - 128)), 0, 255)
    got = np.frombuffer(rows["a.y4m", 4].rgb, np.uint8).reshape(48, 64, 3)
    assert (got[..., 0] == red).all() and rows["a.y4m", 4].t == 0.4
    assert source(tmp_path, rangeBytes=100_000).rdd.getNumPartitions() > 3
    assert sorted(r.frame for r in source(tmp_path / "a.y4m", stride=7).collect()) == [0, 7, 14, 21, 28]
    assert sorted(r.frame for r in source(tmp_path / "a.y4m", fps=4).collect()) == list(range(0, 30, 2))
    (tmp_path / "none").mkdir()
    assert source(tmp_path / "none").count() == 0


def test_chroma_at_half_size(source, tmp_path):
    rng = np.random.default_rng(3)
    y, u, v = rng.integers(16, 236, (5, 7)), rng.integers(60, 200, (3, 4)), rng.integers(60, 200, (3, 4))
    film(tmp_path / "odd.y4m", [[y, u, v]], space="420jpeg")
    got = np.frombuffer(source(tmp_path / "odd.y4m").first().rgb, np.uint8).reshape(5, 7, 3)
    for j, i in ((0, 0), (4, 6), (3, 2)):
        luma = (y[j, i] - 16) * 255 / 219
        assert got[j, i, 2] == min(255, max(0, round(luma + 1.772 * 255 / 224 * (u[j // 2, i // 2] - 128))))
    film(tmp_path / "deep.y4m", [[y, u, v]], space="420p10")
    with pytest.raises(Exception, match="8-bit"):
        source(tmp_path / "deep.y4m").collect()


def test_what_is_not_asked_for_is_not_read(source, tmp_path):
    """Frames before the tenth are broken: a query that reads one of them fails."""
    rng = np.random.default_rng(2)
    film(tmp_path / "a.y4m", [scene(rng) for _ in range(20)], broken=range(1, 10))
    read = lambda **o: sorted(r.frame for r in source(tmp_path / "a.y4m", **o).collect())
    assert read(first=10, last=13) == [10, 11, 12] and read(start=1.6) == [16, 17, 18, 19] and read(stride=10) == [0, 10]
    assert read(start=1.0, seconds=0.35) == [10, 11, 12, 13] and read(first=11, stride=4) == [12, 16] and read(start=5) == [] and read(last=1) == [0]
    every = source(tmp_path / "a.y4m", first=10)
    assert every.filter("frame >= 15").count() == 5 and every.count() == 10 and every.filter("t > 1.75").union(every).count() == 12
    with pytest.raises(Exception, match="not where it should be"):
        read()


def test_cuts_of_a_film_from_its_pixels(spark, source, tmp_path):
    rng = np.random.default_rng(5)
    pictures = []
    for _ in range(3):
        base = scene(rng)
        pictures += [[np.clip(base[0] + rng.integers(-2, 3, base[0].shape), 16, 235), *base[1:]] for _ in range(12)]
    film(tmp_path / "cuts.y4m", pictures)
    facts = kernels.measured(source(tmp_path / "cuts.y4m"))
    found = {r.frame: r["corr"] for r in kernels.frame_correlations(facts).collect()}
    assert found[0] is None and all(found[k] > 0.95 for k in range(1, 36) if k % 12) and max(found[12], found[24]) < 0.7
    steps = kernels.frame_correlations(facts).select(F.col("path").alias("clip_id"), F.col("frame").alias("i"), "corr")
    assert [r.i for r in folds.shot_state(steps, "clip_id", "corr").filter("is_cut").orderBy("i").collect()] == [12, 24]


def test_measures_of_frames():
    rng = np.random.default_rng(6)
    rgb = rng.integers(60, 256, (40, 60, 3)).astype(np.uint8)
    boxed = rgb.copy()
    boxed[:5] = boxed[-3:] = 4
    boxed[:, :6] = 4
    assert kernels.letterbox(rgb) == 0 and kernels.letterbox(np.zeros_like(rgb)) == 0
    assert kernels.letterbox(boxed) == pytest.approx((8 * 60 + 6 * 40 - 8 * 6) / 2400)
    textured = rgb.copy()
    textured[:5] = rng.integers(0, 40, (5, 60, 3))
    assert kernels.letterbox(textured) == 0  # dark, but not flat
    x = np.floor(rgb @ np.array([0.299, 0.587, 0.114]) + 0.5)
    laplace = [[x[abs(j - 1), i] + x[j + 1 if j < 39 else 38, i] + x[j, abs(i - 1)] + x[j, i + 1 if i < 59 else 58] - 4 * x[j, i] for i in range(60)] for j in range(40)]
    assert kernels.sharpness(rgb) == pytest.approx(np.var(laplace))
    small = kernels.averaged(rgb.astype(float), 30, 20)
    assert small.shape == (20, 30, 3) and np.allclose(small, rgb.reshape(20, 2, 30, 2, 3).mean(axis=(1, 3)))
    flat = np.full((90, 160, 3), (255, 0, 0), np.uint8)
    assert kernels.histogram(flat).argmax() == 31 and kernels.histogram(flat).max() == 1  # hue 0, saturation 255
    a, b = rng.random((4, 50)), rng.random((4, 50))
    assert np.allclose(kernels.correlation(a, b), [np.corrcoef(p, q)[0, 1] for p, q in zip(a, b)]) and kernels.correlation(np.ones((1, 5)), b[:1, :5]) == 1


def test_saliency_stands_where_something_stands_out():
    rgb = np.full((120, 200, 3), 90, np.uint8)
    rgb[30:50, 140:165] = np.random.default_rng(1).integers(0, 256, (20, 25, 3))
    found = kernels.saliency(rgb)
    j, i = np.unravel_index(found.argmax(), found.shape)
    assert found.shape == (120, 200) and found.min() == 0 and found.max() == 1 and 25 <= j <= 55 and 135 <= i <= 170
    assert kernels.saliency(np.zeros((700, 900, 3), np.uint8)).shape == (249, 320)
    assert 0 <= kernels.saliency(np.full((9, 9, 3), 7, np.uint8)).min()  # nothing stands out, but nothing breaks


def test_saliency_feeds_the_crop(spark, source, tmp_path):
    y = np.full((120, 200), 90)
    y[40:60, 150:170] = np.random.default_rng(4).integers(16, 236, (20, 20))
    film(tmp_path / "s.y4m", [[y]], space="mono")
    maps = kernels.saliency_maps(source(tmp_path / "s.y4m")).withColumnRenamed("frame", "frame_id")
    far = spark.createDataFrame([(0, 1, 0.1, 2.0, 50.0, 4.0, 52.0)], "frame_id int, face_no int, conf double, x1 double, y1 double, x2 double, y2 double")
    plain, seen = (crop.solve(far, 200, 120, 0.5, steps=9, scales=1, saliency=m).first() for m in (None, maps.select("frame_id", "rows")))
    assert seen.score > plain.score - 1 and seen.x >= plain.x


def test_hash_of_any_length(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"x" * 100_003)
    (tmp_path / "b.jpg").write_bytes(b"b")
    with open(tmp_path / "big.mov", "wb") as f:
        f.truncate((1 << 31) + 77)  # more than one value of a row can hold
    found = {r.path.rsplit("/", 1)[1]: r for r in store.content_hashes(spark, str(tmp_path), files_per_task=1).collect()}
    want = hashlib.sha256()
    for _ in range(1 << 8):
        want.update(bytes(1 << 23))
    want.update(bytes(77))
    assert found["big.mov"].sha256 == want.hexdigest() and found["big.mov"].size_bytes == (1 << 31) + 77 and found["big.mov"].kind == "video"
    assert found["a.mp4"].sha256 == hashlib.sha256(b"x" * 100_003).hexdigest() and found["b.jpg"].sha256 == hashlib.sha256(b"b").hexdigest()


def test_uploads_are_taken_in_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda name, body: (tmp_path / "in" / name).write_bytes(body)
    run = lambda: store.ingest(store.uploads(spark, str(tmp_path / "in")), str(tmp_path / "assets"), str(tmp_path / "ck")).awaitTermination(120)
    held = lambda: sorted((r.sha256, r.kind) for r in spark.read.parquet(str(tmp_path / "assets")).select("sha256", "kind").collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    put("one.jpg", b"1"), put("same.jpg", b"1"), put("two.mp4", b"2"), put("note.txt", b"3")
    run()
    assert held() == sorted([(sha(b"1"), "image"), (sha(b"2"), "video")])
    put("again.png", b"1"), put("three.png", b"three")  # after a restart
    run()
    run()
    assert held() == sorted([(sha(b"1"), "image"), (sha(b"2"), "video"), (sha(b"three"), "image")])


def test_table_functions_equal_the_operators(spark):
    tables.register(spark)
    media = spark.createDataFrame([(1, 4000, 4000), (2, 600, 600), (3, 1920, 1080), (4, 1080, 1920), (5, 9000, 700), (6, None, 5)], "id long, width int, height int")
    lateral = spark.sql("select id, t.division, t.x, t.y, t.w, t.h from {media} m, lateral frame_tiles(m.width, m.height) t", media=media)
    assert sorted(lateral.collect()) == sorted(crop.tiles(media.filter("width is not null"), "id").collect()) and lateral.count() > 50
    sizes = spark.sql("select id, s.* from {media} m, lateral crop_sizes(m.width, m.height, 0.5625D, 0.6D, 4) s where id = 3", media=media)
    assert [tuple(r)[2:] for r in sizes.orderBy("size_no").collect()] == crop.sizes(1920, 1080, 0.5625, 0.6, 4)


def test_progress_rows(spark, tmp_path):
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = progress.ProgressLog()
    spark.streams.addListener(log)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        seen = progress.observed(stream, "watched", odd=F.count_if(F.col("id") % 2 == 1))
        query = seen.writeStream.queryName("counted").format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        import time

        for _ in range(100):
            if len(log.rows) >= 3:
                break
            time.sleep(0.1)
        rows = log.table(spark).filter("input_rows > 0").orderBy("batch").collect()
    finally:
        spark.streams.removeListener(log)
    assert [(r["query"], r.batch, r.input_rows, r.metrics["watched.rows"], r.metrics["watched.odd"]) for r in rows] == [("counted", k, 10, "10", "5") for k in range(3)]
    assert all(r.seconds >= 0 and r["at"] is not None for r in rows) and math.isfinite(rows[0].seconds)
