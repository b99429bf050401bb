import ipaddress
import random
import datetime as dt
import io
import math
import struct
import wave

import pytest
from gatelight.functions import network, sql
from gatelight.operators import store
from gatelight.plans import spec
from gatelight.sources import media, pcm
from gatelight.streaming import audit, leases, shots
from pyspark.sql import functions as F


@pytest.mark.parametrize("xff, hops, ip, forwarded", [
    (None, 1, "10.0.0.9", False), ("1.2.3.4", 0, "10.0.0.9", False), ("1.2.3.4", 1, "1.2.3.4", True), ("6.6.6.6, 1.2.3.4", 1, "1.2.3.4", True),
    ("6.6.6.6, 1.2.3.4", 2, "6.6.6.6", True), ("1.2.3.4", 3, "1.2.3.4", True), ("1.2.3.4:5123", 1, "1.2.3.4", True), ("[2001:db8::1]:443", 1, "2001:db8::1", True),
    ("2001:db8::1", 1, "2001:db8::1", True), ("not-an-ip, <script>", 2, "10.0.0.9", False), ("", 1, "10.0.0.9", False), ("999.1.1.1", 1, "10.0.0.9", False), ("junk, 1.2.3.4", 2, "1.2.3.4", True),
])
def test_client_ip(spark, xff, hops, ip, forwarded):
    df = spark.createDataFrame([("10.0.0.9", xff)], "peer string, xff string")
    assert tuple(df.select(network.client_ip(F.col("peer"), network.hops(F.col("xff")), hops).alias("c")).first().c) == (ip, forwarded)


def test_addresses_equal_the_standard_library(spark):
    rng = random.Random(31)
    texts = ["2001:DB8:0::1", "256.1.1.1", "1:2:3", "12:30:45", "::ffff:300.1.1.1", "::", "::1", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", ":1", "1:", "fe80::1%eth0", "fe80::1%", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.4", "01.2.3.4", "1.2.3", "", "%", "::%a%b", "1.2.3.4%x"]
    for _ in range(600):
        groups = [rng.choice(["0", "0", "00", "1", "ab", "FFFF", "0a0b", "12345", "g"][: 7 + (rng.random() < 0.1) * 2]) for _ in range(rng.choice([8, 8, 8, rng.randrange(1, 10)]))]
        text = ":".join(groups)
        if rng.random() < 0.5:
            at = rng.randrange(len(groups) + 1)
            text = ":".join(groups[:at]) + "::" + ":".join(groups[at + rng.randrange(3) :])
        texts.append(text)

    def want(text):
        try:
            return str(ipaddress.ip_address(text))
        except ValueError:
            return None

    df = spark.createDataFrame([(t,) for t in texts], "v string")
    found = {r.v: r.c for r in df.select("v", network.address(F.col("v")).alias("c")).collect()}
    assert {t: c for t, c in found.items() if c != want(t)} == {}
    assert len(df.select(network.user_agent(F.lit("x" * 900)).alias("a")).first().a) == 400


SHEET = """
defaults: {image: {min_sharpness: 45, unknown: 3}}
render_sets: {image: [wide]}
profiles:
  - {id: wide, ratio: "16:9", kind: image, width: 1920, height: 1080, overrides: {min_sharpness: 60}}
  - {id: reel, ratio: "9:16", kind: video, width: 1080, height: 1920, safe_zones: {action: [0.05, 0.14, 0.95, 0.84]}}
"""


def test_spec(spark, tmp_path):
    path = tmp_path / "sheet.yaml"
    path.write_text(SHEET)
    sheet = spec.load(str(path))
    assert spec.load(str(path)) is sheet
    own = spec.settings(sheet, sheet["profiles"][0], "image")
    assert own["min_sharpness"] == 60 and "unknown" not in own
    assert spec.profiles_of(sheet, "image") == ["wide"] and spec.profiles_of(sheet, "video") == ["reel"]
    assert {r.profile_id: r.min_sharpness for r in spec.profile_table(spark, sheet).collect()} == {"wide": 60.0, "reel": 6.0}
    path.write_text(SHEET.replace("[wide]", "[gone]").replace("height: 1080", "height: 900").replace("id: reel", "id: wide").replace("0.84]", "1.84]"))
    with pytest.raises(spec.SpecError) as error:
        spec.load(str(path))
    assert str(error.value).count(";") == 3


def test_probe_and_samples(spark):
    text = '{"format": {"duration": "12.5", "bit_rate": "8000000", "size": "1000"}, "streams": [{"codec_type": "audio", "codec_name": "aac", "channels": 2, "sample_rate": "48000"}, {"codec_type": "video", "codec_name": "h264", "width": 1080, "height": 1920, "pix_fmt": "yuv420p", "avg_frame_rate": "0/0", "r_frame_rate": "30000/1001"}]}'
    r = media.probed(spark.createDataFrame([(1, text), (2, "no json"), (3, None)], "id long, probe string"), "probe").orderBy("id").collect()
    assert (r[0].width, r[0].video_codec, r[0].audio_channels, r[0].duration_s, r[0].bitrate_kbps) == (1080, "h264", 2, 12.5, 8000.0) and r[0].fps == pytest.approx(29.97, abs=0.01)
    assert r[1].width is None and r[2].fps is None
    line = "  Duration: 00:01:02.50, start: 0.0, bitrate: 900 kb/s\n  Stream #0:0: Video: h264 (High), yuv420p, 1280x720, 25 fps"
    assert tuple(spark.range(1).select(media.stderr_probed(F.lit(line)).alias("p")).first().p) == (62.5, 1280, 720, 25.0, 900.0)
    kinds = spark.createDataFrame([("a/b.JPG",), ("c.mov",), ("d.txt",), ("e",)], "p string").select(media.kind_of(F.col("p")).alias("k")).collect()
    assert [x.k for x in kinds] == ["image", "video", None, None]
    counts = spark.createDataFrame([(0,), (1,), (10,), (1000,)], "n int").select(media.sample_indices(F.col("n")).alias("s")).collect()
    assert [len(x.s) for x in counts] == [0, 1, 9, 24] and counts[3].s[0] == 20 and counts[3].s[-1] == 998
    frames = spark.range(20).select(F.col("id").alias("i"), F.lit(25.0).alias("fps"))
    assert [x.i for x in media.strided(frames, "i", F.col("fps"), 10.0).collect()] == list(range(0, 20, 2))


def test_wav(spark, tmp_path):
    rate = 8000
    raw = b"".join(struct.pack("<hh", v, v) for v in (int(20000 * math.sin(i / 3)) if i > rate else 0 for i in range(2 * rate)))
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setparams((2, 2, rate, 0, "NONE", ""))
        w.writeframes(raw)
    x, hz = media.wav_samples((tmp_path / "a.wav").read_bytes())
    assert hz == rate and len(x) == 2 * rate and abs(x).max() == pytest.approx(20000 / 32768, abs=0.01)
    rows = media.audio_energy(spark, str(tmp_path), 10).orderBy("i").collect()
    assert rows[2].energy == 0 and rows[-1].energy > 0.8
    found = media.files(spark, str(tmp_path)).first()
    assert found.size_bytes == (tmp_path / "a.wav").stat().st_size and len(found.sha256) == 64
    assert io.BytesIO(b"").read() == b""


def test_pcm_source_reads_files_in_slices(spark, tmp_path):
    rate = 8000
    for name, seconds in (("a", 5), ("b", 1)):
        raw = b"".join(struct.pack("<hh", v, v // 2) for v in (int(15000 * math.sin(i / 3) * (i % 4000 > 1500)) for i in range(seconds * rate)))
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setparams((2, 2, rate, 0, "NONE", ""))
            w.writeframes(raw)
    pcm.register(spark)
    read = lambda **o: spark.read.format("pcm_energy").options(fps=10, **o).load(str(tmp_path))
    plain = {(r.path.rsplit("/", 1)[1], r.i): (r.t, r.energy) for r in media.audio_energy(spark, str(tmp_path), 10).collect()}
    sliced = read(sliceBytes=20_000)
    assert sliced.rdd.getNumPartitions() > 4
    found = {(r.path.rsplit("/", 1)[1], r.i): (r.t, r.energy) for r in sliced.collect()}
    assert found.keys() == plain.keys() and all(found[k] == pytest.approx(plain[k]) for k in plain)
    window = sorted(r.i for r in read(start=1.05, seconds=1).collect() if r.path.endswith("a.wav"))
    assert window == [i for (f, i), (t, _) in sorted(plain.items()) if f == "a.wav" and 1.05 <= t < 2.05]
    (tmp_path / "none").mkdir()
    assert spark.read.format("pcm_energy").load(str(tmp_path / "none")).count() == 0


def test_box_functions_of_empty_and_null_boxes(spark):
    sql.register(spark)
    row = spark.sql("""select box_iou(e, e) as a, box_contained(e, f) as b, box_iou(null, f) as c, box_area(named_struct('x1', 4D, 'y1', 4D, 'x2', 1D, 'y2', 9D)) as d, box_pad(f, 0.5D) as p, box_iou(f, g) as i
      from (select named_struct('x1', 1D, 'y1', 1D, 'x2', 1D, 'y2', 5D) as e, named_struct('x1', 0D, 'y1', 0D, 'x2', 2D, 'y2', 2D) as f, named_struct('x1', 1D, 'y1', 0D, 'x2', 3D, 'y2', 2D) as g)""").first()
    assert (row.a, row.b, row.c, row.d) == (0, 0, 0, 0) and tuple(row.p) == (-1, -1, 3, 3) and row.i == pytest.approx(1 / 3)


def test_jobs_go_to_the_handler_of_their_kind(spark):
    jobs = spark.createDataFrame([(1, "render"), (2, "purge"), (3, "unheard"), (4, None)], "job_id long, job_type string")
    mark = lambda status: lambda b: b.withColumn("status", F.lit(status))
    done = audit.dispatch({"render": mark("rendered"), "purge": mark("purged")})(jobs)
    assert {tuple(r) for r in done.collect()} == {(1, "rendered"), (2, "purged"), (3, "failed"), (4, "failed")}


def test_jobs_for_unknown_assets_are_rejected(spark):
    jobs = spark.createDataFrame([(1, 7), (2, 8), (3, None), (4, 7)], "job_id long, asset_id long")
    assets = spark.createDataFrame([(7,), (7,), (None,)], "asset_id long")
    assert {(r.job_id, r.status) for r in store.submit(jobs, assets).collect()} == {(1, "queued"), (2, "rejected"), (3, "rejected"), (4, "queued")}


def test_store_edges(spark):
    events = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 9)), (3, dt.datetime(2024, 1, 10))], "id long, at timestamp_ntz")
    kept, purged = store.retention(events, dt.datetime(2024, 1, 11), 2)
    assert sorted(r.id for r in kept.collect()) == [2, 3] and purged.first().purged == 1
    assert store.retention(events, dt.datetime(2024, 1, 11), 0)[0].count() == 3
    rows = spark.createDataFrame([(1, "p", 1, 5), (1, "p", 2, 5), (1, "q", 3, 1)], "asset_id long, profile_id string, variant_id long, at long")
    assert sorted(r.variant_id for r in store.upsert_latest(rows, ["asset_id", "profile_id"], "at", "variant_id").collect()) == [2, 3]


def test_audit_stream_equals_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), f"a{i % 2}", "failure" if i % 3 else "success") for i in range(240)]
    df = spark.createDataFrame(rows, "id long, at timestamp, action string, outcome string")
    df.repartitionByRange(4, "at").sortWithinPartitions("at").write.parquet(str(tmp_path / "in"))
    stream = audit.rolling_counts(audit.audit_stream(spark, str(tmp_path / "in"), df.schema))
    audit.append_once(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    closed = {tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()}
    whole = {tuple(r) for r in audit.rolling_counts(df).collect()}
    assert closed and closed <= whole and len(whole - closed) <= 6


def test_jobs_run_once_and_dead_letters(spark, tmp_path):
    spark.createDataFrame([(1, 1), (1, 1), (2, 3), (3, 4), (3, 1)], "job_id long, attempt int").coalesce(1).write.parquet(str(tmp_path / "jobs"))
    jobs = spark.readStream.schema("job_id long, attempt int").parquet(str(tmp_path / "jobs"))
    audit.consume_jobs(jobs, lambda b: b.withColumn("status", F.lit("succeeded")), str(tmp_path / "done"), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "done")).select("job_id", "status").collect()) == [(1, "succeeded"), (2, "succeeded"), (3, "dead")]


def plain_queue(events, moved_to, lease=100):
    """Outputs of a queue that sees ``events`` (job, event, second) in order of time, with the clock at ``moved_to`` in the end."""
    jobs, out = {}, []

    def deliver(job, now):
        if jobs[job]["tries"] == 3:
            jobs[job]["state"] = "dead"
            out.append((job, "dead", 3, now))
        else:
            jobs[job] |= {"tries": jobs[job]["tries"] + 1, "due": now + lease}
            out.append((job, "deliver", jobs[job]["tries"], now))

    for job, event, now in [*sorted(events, key=lambda e: e[2]), (None, None, moved_to)]:
        while lapsed := [(j["due"], k) for k, j in jobs.items() if j["state"] == "leased" and j["due"] < now]:
            due, k = min(lapsed)
            deliver(k, due)
        if event == "submit" and job not in jobs:
            jobs[job] = {"state": "leased", "tries": 0}
            deliver(job, now)
        elif job in jobs and jobs[job]["state"] == "leased":
            if event == "ack":
                jobs[job]["state"] = "done"
                out.append((job, "done", jobs[job]["tries"], now))
            elif event == "nack":
                deliver(job, now)
            elif event == "extend":
                jobs[job]["due"] = now + lease
    return sorted(out)


def test_leases_lapse_and_come_back_across_restarts(spark, tmp_path):
    """Each run stops and starts the stream again: attempts are the queue's own count, a job is dead after three, one that is done is never run again."""
    start, events, clock = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc), [], 0
    feeds = [
        [("a", "submit", 0), ("b", "submit", 1), ("c", "submit", 2), ("c", "submit", 3)],
        [("a", "ack", 50), ("b", "extend", 60), ("tick1", "submit", 130)],  # c lapses
        [("c", "nack", 135), ("a", "submit", 140), ("tick1", "ack", 150), ("tick2", "submit", 170)],  # b lapses
        [("b", "ack", 180), ("b", "nack", 181), ("nobody", "ack", 182), ("tick2", "ack", 190), ("tick3", "submit", 400)],  # c lapses for good
        [("c", "submit", 410), ("tick3", "ack", 420), ("tick4", "submit", 500)],
    ]
    for k, feed in enumerate(feeds):
        rows = [(j, e, start + dt.timedelta(seconds=s), j) for j, e, s in feed] + [(None, "submit", start, None), ("x", "ack", None, None)]
        spark.createDataFrame(rows, "job_id string, event string, at timestamp, payload string").coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        stream = spark.readStream.schema("job_id string, event string, at timestamp, payload string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
        handle = lambda batch: batch.select("job_id", F.concat(F.lit("ran "), "payload").alias("status"))
        leases.work(leases.deliveries(stream, lease_s=100), handle, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(180)
        events, clock = events + feed, max(s for _, _, s in feed)
    found = sorted((r.job_id, "deliver" if r.status.startswith("ran ") else r.status, r.attempt, round((r.at.timestamp() - start.timestamp()))) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = plain_queue(events, clock)
    assert found == want
    assert [x[1:3] for x in found if x[0] == "c"] == [("dead", 3), ("deliver", 1), ("deliver", 2), ("deliver", 3)]
    assert [x[1:3] for x in found if x[0] == "a"] == [("deliver", 1), ("done", 1)]


def test_a_lease_of_a_job_without_state():
    assert leases.on_event(None, "ack", 5, None, 100) == (None, None) and leases.on_timer(None, 5, 100) == (None, None)
    held, _ = leases.on_event(None, "submit", 5, "p", 100)
    assert leases.on_timer(held, 104, 100) == (held, None)  # a timer of an earlier lease
    ended, _ = leases.on_event(held, "ack", 9, None, 100)
    assert leases.on_event(ended, "nack", 10, None, 100) == (ended, None) and leases.on_timer(ended, ended[2], 100) == (None, None)


def test_shot_stream(spark, tmp_path):
    values = [None, *[0.99] * 9, 0.3, *[0.98] * 5]
    rows = [(c, i, v) for c in (1, 2) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "clip_id long, i int, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "frames"))
    stream = shots.shot_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "frames")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(180)
    found = {(r.clip_id, r.i): r.shot_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {(c, i): int(i >= 10) for c in (1, 2) for i in range(len(values))}
