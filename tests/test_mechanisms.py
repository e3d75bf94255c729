"""Queue, metadata cache and camera metadata: restarts, batches, untouched files, broken bytes."""

import os
import random

from pyspark.sql import functions as F

from prismata.sources import cache, exif
from prismata.streaming import queue

LEASE = 100


def replay(events):
    state, out = {}, {}
    for e, k, t, action in sorted(events, key=lambda r: (r[2], r[0])):
        status, since = state.get(k, (None, 0))
        outcome, freed, status, since = queue.judge(status, since, action, t * 1_000_000, LEASE * 1_000_000)
        state[k] = (status, since)
        out[e] = (outcome, freed)
    return out


def test_judge():
    s = 1_000_000
    assert queue.judge(None, 0, "request", 5 * s, 10 * s) == ("accepted", "new", "queued", 5 * s)
    assert queue.judge("queued", 5 * s, "request", 14 * s, 10 * s) == ("refused", None, "queued", 5 * s)
    assert queue.judge("queued", 5 * s, "request", 15 * s, 10 * s) == ("accepted", "timeout", "queued", 15 * s)
    assert queue.judge("queued", 5 * s, "start", 6 * s, 10 * s) == ("started", None, "running", 6 * s)
    assert queue.judge("running", 6 * s, "start", 7 * s, 10 * s)[0] == "ignored" and queue.judge("running", 6 * s, "done", 7 * s, 10 * s) == ("done", None, "done", 7 * s)
    assert queue.judge("done", 7 * s, "request", 8 * s, 10 * s) == ("accepted", "done", "queued", 8 * s) and queue.judge("running", 6 * s, "done", 16 * s, 10 * s)[0] == "ignored"


def test_queue_in_batches_and_after_a_restart(spark, tmp_path):
    """One file a batch, half of them before a restart: the same rows as a replay in order; nothing comes twice."""
    rng = random.Random(4)
    events = [(e, rng.randrange(6), 1000 + 3 * e, rng.choice(["request", "request", "start", "done"])) for e in range(240)] + [(900, None, 1005, "request")]
    rows = [(e, k, t, a) for e, k, t, a in events]
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "event_id long, key long, ts timestamp, action string"

    def put(part):
        spark.createDataFrame(part, "event_id long, key long, t long, action string").select("event_id", "key", F.timestamp_seconds("t").alias("ts"), "action").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        queue.run_queue(spark, stream, sink, checkpoint, LEASE)

    for k in range(4):
        put(rows[60 * k : 60 * k + 60] + (rows[240:] if k == 3 else []))
        if k % 2:
            run()
    run()  # nothing new
    got = spark.read.parquet(sink).collect()
    want = replay([r for r in rows if r[1] is not None])
    assert len(got) == len(want) and {r.event_id: (r.outcome, r.freed_by) for r in got} == want
    assert {o for o, _ in want.values()} == {"accepted", "refused", "started", "done", "ignored"} and "timeout" in {f for _, f in want.values()}


def test_cache_rewrites_only_dirty_folders(spark, tmp_path):
    asked = []

    def extract(rows):
        asked.append(sorted(r.path for r in rows.select("path").collect()))
        return rows.withColumn("size", F.length("path"))

    def files(rows):
        return spark.createDataFrame(rows, "path string, folder string, mtime long")

    def written():
        return {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(tmp_path / "c" / "rows") for f in names if f.endswith(".parquet")}

    store = cache.MetadataCache(spark, f"file://{tmp_path}/c")
    assert store.read() is None and store.generation() == 0
    first = [("a/1", "a", 1), ("a/2", "a", 1), ("b/1", "b", 1), ("c/1", "c", 1)]
    assert store.hits(files(first)).count() == 0 and store.refresh(files(first), extract) == 1
    cold = written()
    assert store.refresh(files(first), extract) == 1 and written() == cold  # warm: nothing is extracted or written
    second = [("a/1", "a", 2), ("a/2", "a", 1), ("b/1", "b", 1), ("d/1", "d", 5)]  # a changed, c gone, d new
    assert sorted((r.path, r.size) for r in store.hits(files(second)).collect()) == [("a/2", 3), ("b/1", 3)]
    assert store.refresh(files(second), extract) == 2
    assert asked == [["a/1", "a/2", "b/1", "c/1"], ["a/1", "d/1"]]
    assert {f: t for f, t in written().items() if f in cold} == cold  # files of the first generation as they were
    rows = sorted((r.path, r.mtime, r.generation) for r in store.read().collect())
    assert rows == [("a/1", 2, 2), ("a/2", 1, 2), ("b/1", 1, 1), ("d/1", 5, 2)]
    moved = [("a/1", "a", 2), ("a/2", "b", 1), ("b/1", "b", 1), ("d/1", "d", 5)]  # a file changes its folder
    assert store.refresh(files(moved), extract) == 3 and sorted((r.path, r.folder) for r in store.read().collect()) == [("a/1", "a"), ("a/2", "b"), ("b/1", "b"), ("d/1", "d")]
    assert store.vacuum() == [1] and store.read().count() == 4


def test_a_refresh_that_dies_is_not_read_and_two_at_once_do_not_mix(spark, tmp_path):
    import pytest

    store = cache.MetadataCache(spark, f"file://{tmp_path}/c")
    rows = spark.createDataFrame([("a/1", "a", 1)], "path string, folder string, mtime long")
    store.refresh(rows, lambda r: r.withColumn("v", F.lit(1)))
    later = rows.withColumn("mtime", F.lit(2).cast("bigint"))
    with pytest.raises(Exception):
        store.refresh(later, lambda r: r.withColumn("v", F.raise_error(F.lit("broken file")).cast("int")))
    assert [(x.mtime, x.v) for x in store.read().collect()] == [(1, 1)]

    def overtaken(r):
        cache.MetadataCache(spark, f"file://{tmp_path}/c").refresh(later, lambda q: q.withColumn("v", F.lit(7)))
        return r.withColumn("v", F.lit(8))

    with pytest.raises(RuntimeError):
        store.refresh(later, overtaken)


def tiff(little, fields, extra=b""):
    """A structure with one directory. fields: tag, type, count, value bytes."""
    order = "little" if little else "big"
    at, rest, head, tail = 8, 8 + 2 + 12 * len(fields) + 4, len(fields).to_bytes(2, order), b""
    for tag, kind, count, value in fields:
        head += tag.to_bytes(2, order) + kind.to_bytes(2, order) + count.to_bytes(4, order)
        if len(value) <= 4:
            head += value.ljust(4, b"\0")
        else:
            head += (rest + len(tail)).to_bytes(4, order)
            tail += value
    return (b"II*\0" if little else b"MM\0*") + at.to_bytes(4, order) + head + bytes(4) + tail + extra


def test_exif_fields_and_broken_bytes(spark):
    ratio = lambda little, *xs: b"".join(x.to_bytes(4, "little" if little else "big") for x in xs)
    good = {o: tiff(o, [(0x010F, 2, 6, b"Lumo \0"), (0x0110, 2, 3, b"X1\0"), (0x829A, 5, 1, ratio(o, 3, 2)), (0x829D, 5, 1, ratio(o, 28, 10)), (0x8827, 3, 1, (400).to_bytes(2, "little" if o else "big")), (0x920A, 5, 1, ratio(o, 50, 0))]) for o in (True, False)}
    loop = tiff(True, [(0x010F, 2, 3, b"Me\0"), (exif.CAMERA, 4, 1, (8).to_bytes(4, "little"))])  # a camera directory that is the main one
    far = tiff(False, [(0x010F, 2, 900, b"x" * 5)])  # a value longer than the file
    odd = tiff(True, [(0x010F, 2, 4, b"\0abc"), (0x829A, 3, 1, b"\1\0"), (0x9999, 77, 3, b"zzz"), (0x829D, 5, 0, b"")])
    rows = [(1, good[True]), (2, good[False]), (3, b"\xff\xd8\xff\xe1\0\0Exif\0\0" + good[True]), (4, loop), (5, far), (6, odd), (7, b""), (8, None), (9, b"II*\0\xff\xff\xff\xff"), (10, b"II*"), (11, b"\xff\xd8no structure"), (12, good[True][:25]), (13, os.urandom(200))]
    by = {r.id: r for r in exif.metadata(spark.createDataFrame(rows, "id int, content binary")).collect()}
    for i in (1, 2, 3):
        assert (by[i].Make, by[i].Model, by[i].ExposureTime, by[i].FNumber, by[i].ISOSpeed, by[i].FocalLength) == ("Lumo", "X1", "1.5 s", "f/2.8", "400", None), i
    assert by[4].Make == "Me" and by[5].Make is None and by[6].Make is None and by[6].ExposureTime is None and by[6].FNumber is None
    assert all(by[i].Make is None and by[i].FNumber is None for i in range(7, 14)) and len(by) == 13


def test_matching_needs_a_clear_best_and_consensus_needs_fifteen(spark):
    import numpy as np

    from prismata.operators import matching

    rng = np.random.default_rng(6)
    words = rng.integers(-(1 << 62), 1 << 62, (40, 4)).tolist()
    place = rng.integers(0, 1000, (40, 2)).tolist()
    h = np.array([[1.02, 0.05, 20.0], [-0.04, 0.98, -7.0], [1e-5, 2e-5, 1.0]])
    rows = []
    for i in range(40):
        x, y = place[i]
        u, v, z = h @ [x, y, 1]
        u, v = (u / z, v / z) if i % 5 else (u / z + 300 + 40 * i, v / z - 90)
        rows += [(0, i, float(x), float(y), words[i]), (1, i, float(u), float(v), words[i])]
        if i < 12:
            rows.append((2, i, float(x), float(y), words[i]))  # too few to agree
    rows += [(3, 0, 0.0, 0.0, words[0]), (3, 1, 1.0, 1.0, words[0])]  # two equal features: none is clearly best
    features = spark.createDataFrame(rows, "image long, i long, x double, y double, words array<long>")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (0, 9)], "a long, b long")
    found = matching.match_features(features, pairs).collect()
    assert sorted((r.i, r.j) for r in found if r.b == 1) == [(i, i) for i in range(40)] and not [r for r in found if r.b == 3]
    old, matching.SLICE = matching.SLICE, 7
    try:
        assert sorted(matching.match_features(features, pairs).collect()) == sorted(found)
    finally:
        matching.SLICE = old
    got = matching.consensus(matching.match_features(features, pairs)).collect()
    assert [(r.a, r.b, r.matches, r.inliers) for r in got] == [(0, 1, 40, 32)]
    assert np.allclose(np.array(got[0].map).reshape(3, 3), h, atol=1e-6)


def brute_stencils(image, strength):
    """Denoising by loops over a whole image."""
    import numpy as np

    from prismata.operators import tiles

    def smooth(p, gap):
        n, m = p.shape
        rows = sum(t * p[:, np.clip(np.arange(m) + k * gap, 0, m - 1)] for k, t in zip(range(-2, 3), tiles.TAPS))
        return sum(t * rows[np.clip(np.arange(n) + k * gap, 0, n - 1)] for k, t in zip(range(-2, 3), tiles.TAPS))

    out = []
    for plane, weights in zip(np.tensordot(tiles.TO_YCC, image, 1), (tiles.LUMA, tiles.CHROMA, tiles.CHROMA)):
        now, kept = plane, 0
        for level, w in enumerate(weights):
            s = smooth(now, 1 << level)
            kept, now = kept + (now - s) * (1 - min(1, strength * w)), s
        out.append(kept + now)
    return np.maximum(np.tensordot(tiles.FROM_YCC, np.stack(out), 1), 0)


def test_tiles_of_any_size_give_the_whole_image(spark):
    import numpy as np

    from prismata.operators import tiles

    rng = np.random.default_rng(1)
    images = {1: rng.random((3, 23, 31)), 2: rng.random((3, 1, 40)), 3: rng.random((3, 5, 5))}
    px = spark.createDataFrame([(i, x, y, *map(float, a[:, y, x])) for i, a in images.items() for y in range(a.shape[1]) for x in range(a.shape[2])], "id long, x int, y int, r double, g double, b double")
    for size in (4, 8, 64):  # reaches of sixteen pixels cross several tiles
        cut = tiles.to_tiles(px, "r", "g", "b", size=size)
        rows = tiles.to_pixels(tiles.wavelet_denoise(cut, 0.9, size), "r", "g", "b", size=size).collect()
        for i, a in images.items():
            got = np.zeros_like(a)
            for r in rows:
                if r.id == i:
                    got[:, r.y, r.x] = r.r, r.g, r.b
            assert np.allclose(got, brute_stencils(a, 0.9), atol=1e-12), (i, size)
    assert tiles.to_tiles(px.filter("false"), "r").count() == 0


def test_hot_pixels_and_demosaicing(spark):
    from prismata.operators import tiles

    flat = [(1, x, y, 100.0 + 10 * (x % 2 + y % 2)) for x in range(8) for y in range(8)]
    flat = [(i, x, y, 4000.0 if (x, y) == (3, 4) else 0.0 if (x, y) == (0, 0) else v) for i, x, y, v in flat]
    px = spark.createDataFrame(flat + [(2, x, 0, 9.0 * x) for x in range(4)], "id long, x int, y int, v double")
    mended = {(r.id, r.x, r.y): r.v for r in tiles.to_pixels(tiles.mend_pixels(tiles.to_tiles(px, "v", size=4), 0.02, 4000.0, 4), "v", size=4).collect()}
    assert mended[1, 3, 4] == 110.0 and mended[1, 0, 0] == 0.0 and mended[1, 5, 5] == 120.0 and mended[2, 3, 0] == 27.0
    rgb = {(r.x, r.y): (r.r, r.g, r.b) for r in tiles.to_pixels(tiles.demosaic(tiles.to_tiles(px.filter("id = 1"), "v", size=4), size=4), "r", "g", "b", size=4).collect()}
    assert rgb[6, 6] == (100.0, 110.0, 120.0) and rgb[5, 5] == (100.0, 110.0, 120.0) and rgb[5, 6] == (110.0, 110.0, 110.0)


def test_file_sink_writes_all_or_nothing_and_each_file_once(spark, tmp_path):
    import pytest

    from prismata.sources.sink import FileSink

    spark.dataSource.register(FileSink)
    target = tmp_path / "out"
    files = lambda: {os.path.relpath(os.path.join(d, f), target): open(os.path.join(d, f)).read() for d, _, names in os.walk(target) for f in names}
    rows = spark.createDataFrame([(f"a/{i % 3}/f{i}.xmp", f"text {i}") for i in range(20)], "path string, content string").repartition(4)
    rows.write.format("files").mode("append").save(str(target))
    want = {f"a/{i % 3}/f{i}.xmp": f"text {i}" for i in range(20)}
    assert files() == want
    broken = rows.select(F.concat(F.lit("new/"), "path").alias("path"), F.when(F.col("path").endswith("f7.xmp"), F.raise_error(F.lit("lost"))).otherwise(F.col("content")).alias("content"))
    outside = spark.createDataFrame([("../x", "y"), ("fine", "z")], "path string, content string").repartition(2)
    for bad in (broken, outside):
        with pytest.raises(Exception):
            bad.write.format("files").mode("append").save(str(target))
        assert files() == want and not [d for d in os.listdir(target) if d.startswith(".staging")]
    spark.createDataFrame([("a/0/f0.xmp", "changed"), ("b", None)], "path string, content string").write.format("files").mode("append").save(f"file://{target}")
    assert files() == want | {"a/0/f0.xmp": "changed", "b": ""}
    spark.createDataFrame([(bytearray(b"\x00\x01"), "raw")], "content binary, path string").write.format("files").mode("overwrite").save(str(target))
    assert list(files()) == ["raw"]


def test_a_task_that_runs_again_leaves_its_files_once(tmp_path):
    """Two attempts of one task: only the folder whose message reaches the commit counts."""
    from unittest import mock

    from pyspark.sql.types import StringType, StructField, StructType

    from prismata.sources.sink import FileWriter

    writer = FileWriter(str(tmp_path), StructType([StructField("path", StringType()), StructField("content", StringType())]), False)
    done = []
    for attempt, rows in ((1, [("a", "old"), ("left over", "x")]), (2, [("a", "new")])):
        with mock.patch("pyspark.TaskContext.get", return_value=mock.Mock(partitionId=lambda: 0, taskAttemptId=lambda a=attempt: a)):
            done.append(writer.write(iter(rows)))
    writer.commit([done[1], None])
    assert sorted(os.listdir(tmp_path)) == ["a"] and (tmp_path / "a").read_text() == "new"


def test_preset_conversion(spark):
    from prismata.sources import presets

    texts = spark.createDataFrame([("a", '<x crs:Tint="+200" crs:Sharpness="-3" crs:Dehaze="1e1" crs:Vibrance=" 5" crs:Clarity2012="inf" crs:Temperature="0" crs:Whites2012="1" crs:Whites2012="++2"/>'), ("b", '<x crs:Temperature="5500"/>'), ("c", None), ("d", "")], "path string, value string")
    got = {(r.path, r.target): r.value for r in presets.adjustments(texts).collect()}
    assert got == {("a", "tint"): 100.0, ("a", "sharpness"): 0.0, ("a", "dehaze"): 10.0, ("a", "whites"): 2.0, ("b", "temperature"): 0.0}
    assert sorted((r.attribute, r.raw) for r in presets.unread(texts).collect()) == [("Clarity2012", "inf"), ("Vibrance", " 5")]
    assert len(presets.targets()) == len({t for _, t, *_ in presets.targets()}) == 67


def test_warp_against_a_loop_over_the_image(spark):
    import numpy as np

    from prismata.operators import tiles

    rng = np.random.default_rng(9)
    image = rng.random((2, 19, 26))
    px = spark.createDataFrame([(5, x, y, *map(float, image[:, y, x])) for y in range(19) for x in range(26)], "id long, x int, y int, a double, b double")
    for params in ({"rotate": 30.0}, {"vertical": 40.0, "horizontal": -60.0, "scale": 80.0}, {"scale": 10.0}, {"scale": 0.0}):
        matrix = tiles.warp_matrix(19, 26, **params)
        back = np.linalg.inv(matrix) if abs(np.linalg.det(matrix)) > 1e-12 else np.eye(3)
        want = np.zeros_like(image)
        for y in range(19):
            for x in range(26):
                u, v, z = back @ [x, y, 1.0]
                u, v = u / z, v / z
                if 0 <= u < 25 and 0 <= v < 18:
                    i, j, p, q = int(u), int(v), u - int(u), v - int(v)
                    want[:, y, x] = image[:, j, i] * (1 - p) * (1 - q) + image[:, j, i + 1] * p * (1 - q) + image[:, j + 1, i] * (1 - p) * q + image[:, j + 1, i + 1] * p * q
        got = np.zeros_like(image)
        for r in tiles.to_pixels(tiles.warp(tiles.to_tiles(px, "a", "b", size=8), 2, 8, **params), "a", "b", size=8).collect():
            got[:, r.y, r.x] = r.a, r.b
        assert np.allclose(got, want, atol=1e-9), params
    turned = {(r.x, r.y): r.a for r in tiles.turned(px, 1).collect()}
    assert all(turned[x, y] == v for (y, x), v in np.ndenumerate(np.rot90(image[0], -1)))
    whole = tiles.cropped(px, 40.0, 0.0, 5.0, 5.0)
    assert whole.count() == 19 * 26 and tiles.cropped(px, 20.0, 10.0, 100.0, 3.0).count() == 6 * 3
