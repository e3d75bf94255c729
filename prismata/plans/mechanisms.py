"""Queries that run as streams, keep tables of their own or read bytes: leased queue, metadata cache, camera metadata, tiles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from prismata.functions import keys
from prismata.plans.registry import ORACLES, file_query, query
from prismata.plans.standin import catalog
from prismata.session import materialize, shared_dir
from prismata.sources import cache, exif, files, presets
from prismata.streaming import jobs, queue

LEASE = 12 * 3600


@file_query("n6_leased_queue")
def n6(spark, sf_dir):
    """Events as requests for their user's work, its start and its end, judged as a stream that runs until nothing is new."""
    tables = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    action = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "purchase", "done").otherwise("request")
    place = f"{shared_dir(spark)}/queue-{uuid.uuid4().hex}"
    queue.run_queue(spark, tables.select("event_id", F.col("user_id").alias("key"), "ts", action.alias("action")), f"{place}/rows", f"{place}/checkpoint", LEASE)
    return spark.read.parquet(f"{place}/rows").select("event_id", "key", "action", "outcome", "freed_by")


# the state machine, one event of each key a step
ORACLES["n6_leased_queue"] = f"""WITH RECURSIVE e AS (SELECT event_id, user_id AS key, epoch_us(ts) AS t, CASE event_type WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'done' ELSE 'request' END AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT key, 0::BIGINT AS rn, NULL::BIGINT AS event_id, NULL::VARCHAR AS action, NULL::VARCHAR AS outcome, NULL::VARCHAR AS freed_by, NULL::VARCHAR AS status, 0::BIGINT AS since FROM (SELECT DISTINCT key FROM e)
UNION ALL SELECT key, rn, event_id, action, outcome, CASE WHEN outcome = 'accepted' THEN coalesce(now, 'new') END, CASE outcome WHEN 'accepted' THEN 'queued' WHEN 'started' THEN 'running' WHEN 'done' THEN 'done' ELSE now END, CASE WHEN outcome IN ('accepted', 'started', 'done') THEN t ELSE since END
FROM (SELECT *, CASE WHEN action = 'request' THEN CASE WHEN now IN ('queued', 'running') THEN 'refused' ELSE 'accepted' END WHEN action = 'start' AND now = 'queued' THEN 'started' WHEN action = 'done' AND now IN ('queued', 'running') THEN 'done' ELSE 'ignored' END AS outcome
FROM (SELECT e.key, e.rn, e.event_id, e.action, e.t, r.since, CASE WHEN r.status IN ('queued', 'running') AND e.t >= r.since + {LEASE * 1_000_000} THEN 'timeout' ELSE r.status END AS now FROM r JOIN e ON e.key = r.key AND e.rn = r.rn + 1) a) b)
SELECT event_id, key, action, outcome, freed_by FROM r WHERE rn > 0"""


@file_query("s8_metadata_cache", ("images", "metadata"), """SELECT i.id, i.folder_id AS folder, CASE WHEN i.folder_id % 2 = 0 AND i.id % 5 = 0 THEN i.modified_at + 60 ELSE i.modified_at END AS mtime, m.camera_make, m.iso, CASE WHEN i.folder_id % 2 = 0 THEN 2 ELSE 1 END AS generation
FROM images i LEFT JOIN metadata m ON m.image_id = i.id WHERE NOT (i.folder_id % 4 = 0 AND i.id % 7 = 0)""")
def s8(spark, sf_dir):
    """A cold run, then one after files of the even folders have changed and some have gone; and a warm one, which writes nothing."""
    images, known = catalog(spark, sf_dir, "images", "metadata")
    scan = images.select(F.col("id").cast("string").alias("path"), F.col("folder_id").alias("folder"), F.col("modified_at").alias("mtime"))
    later = scan.filter("NOT (folder % 4 = 0 AND CAST(path AS BIGINT) % 7 = 0)").withColumn("mtime", F.when((F.col("folder") % 2 == 0) & (F.col("path").cast("bigint") % 5 == 0), F.col("mtime") + 60).otherwise(F.col("mtime")))
    fields = known.select(F.col("image_id").cast("string").alias("path"), "camera_make", "iso")
    extract = lambda rows: rows.join(fields, "path", "left")
    store = cache.MetadataCache(spark, f"{shared_dir(spark)}/metadata-{uuid.uuid4().hex}")
    for state in (scan, later, later):
        store.refresh(state, extract)
    return store.read().select(F.col("path").cast("bigint").alias("id"), "folder", "mtime", "camera_make", "iso", "generation")


def camera_bytes(orders):
    """(id, content): files whose structure is built from orders, in both byte orders; every 13th has a directory that lies beyond its end, every 17th is cut short, every 19th is a JPEG."""
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    little = i % 2 == 0
    pack = lambda x, size=4: exif.packed(x, size, little)
    text = lambda x, size: F.rpad(F.hex(F.encode(x, "ISO-8859-1")), 2 * size, "0")
    ratio = lambda a, b: F.concat(pack(a), pack(b))
    day = text(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"), 20)
    time = F.when(i % 3 == 0, ratio(1, 30 * (1 + c % 9))).when(i % 3 == 1, ratio(10 * (1 + c % 4), 200)).otherwise(ratio(2 + c % 5, 2))
    lens = F.concat(ratio(24 + c % 10, 1), ratio(70, 1), ratio(28, 10), ratio(28, 10))
    camera = [(0x829A, 5, 1, 8, time), (0x829D, 5, 1, 8, ratio(14 + c % 200, 10)), (0x8827, 3, 1, 2, pack(100 * (1 + c % 20), 2)), (0x9003, 2, 20, 20, day), (0x9201, 10, 1, 8, ratio((1 << 32) - 50 - c % 9, 10)), (0x920A, 5, 1, 8, ratio(24 + c % 100, 1)), (0xA432, 5, 4, 32, lens)]
    main = lambda at: exif.directory([(0x010F, 2, 6, 6, text(F.lit("Lumo "), 6)), (0x0110, 2, 24, 24, text(F.col("o_orderpriority"), 24)), (exif.CAMERA, 4, 1, 4, at)], 8, little)
    here = main(pack(0))[1]
    tiff = F.concat(F.when(little, "49492A00").otherwise("4D4D002A"), pack(8), main(F.when(i % 13 == 0, pack(900_000)).otherwise(pack(here)))[0], exif.directory(camera, here, little)[0])
    digits = F.when(i % 17 == 0, F.substring(tiff, 1, 60)).when(i % 19 == 0, F.concat(F.lit("FFD8FFE10000457869660000"), tiff)).otherwise(tiff)
    return orders.select(i.alias("id"), F.unhex(digits).alias("content"))


@query("s7_camera_metadata", ("orders",), """, o AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderdate AS d, o_orderpriority AS p, o_orderkey % 17 = 0 AS cut, o_orderkey % 17 = 0 OR o_orderkey % 13 = 0 AS lost FROM orders)
SELECT id, CASE WHEN NOT cut THEN 'Lumo' END AS "Make", CASE WHEN NOT cut THEN p END AS "Model",
CASE WHEN NOT lost THEN CASE id % 3 WHEN 0 THEN '1/' || 30 * (1 + c % 9) || ' s' WHEN 1 THEN '1/' || CAST(round(200.0 / (10 * (1 + c % 4))) AS BIGINT) || ' s' ELSE CASE WHEN c % 5 % 2 = 0 THEN CAST(1 + c % 5 // 2 AS VARCHAR) ELSE (1 + c % 5 // 2) || '.5' END || ' s' END END AS "ExposureTime",
CASE WHEN NOT lost THEN 'f/' || (14 + c % 200) // 10 || CASE WHEN (14 + c % 200) % 10 > 0 THEN '.' || (14 + c % 200) % 10 ELSE '' END END AS "FNumber", CASE WHEN NOT lost THEN CAST(100 * (1 + c % 20) AS VARCHAR) END AS "PhotographicSensitivity",
CASE WHEN NOT lost THEN '-5' || CASE WHEN c % 9 > 0 THEN '.' || c % 9 ELSE '' END END AS "ShutterSpeedValue", CASE WHEN NOT lost THEN CAST(24 + c % 100 AS VARCHAR) END AS "FocalLength", CASE WHEN NOT lost THEN strftime(d, '%Y-%m-%d %H:%M:%S') END AS "DateTimeOriginal", CASE WHEN NOT lost THEN (24 + c % 10) || '-70 mm, f/2.8' END AS "LensSpecification" FROM o""")
def _(orders):
    found = exif.metadata(materialize(camera_bytes(orders), "camera-files"))
    return found.select("id", "Make", "Model", "ExposureTime", "FNumber", "PhotographicSensitivity", "ShutterSpeedValue", "FocalLength", "DateTimeOriginal", "LensSpecification")


def preset_texts(part):
    """(path, value): foreign presets made of parts; every 6th has a broken number, every 7th gives an attribute twice, every 10th is no preset."""
    i, n = F.col("p_partkey"), F.col("p_size")
    s = lambda c: c.cast("string")
    attribute = lambda name, value: F.concat(F.lit(f' crs:{name}="'), value, F.lit('"'))
    point = lambda x, y: F.concat(F.lit("<rdf:li>"), s(x), F.lit(", "), s(y), F.lit("</rdf:li>"))
    body = F.concat(
        F.lit("<rdf:Description"),
        attribute("Exposure2012", F.concat(F.lit("+"), s(n % 5), F.lit(".5"))),
        F.when(i % 7 == 0, attribute("Contrast2012", F.lit("1"))).otherwise(""),
        attribute("Contrast2012", F.when(i % 6 == 0, "soft").otherwise(s(n - 25))),
        attribute("Shadows2012", s(n * 2)),
        attribute("Sharpness", s(n * 4)),
        attribute("Temperature", s(2000 + n * 100)),
        F.when(i % 2 == 0, attribute("AsShotTemperature", s(4000 + n * 10))).otherwise(""),
        attribute("HueAdjustmentOrange", s(n)),
        attribute("ColorGradeBlending", s(n)),
        attribute("NobodyKnows", s(n)),
        F.lit(">\n<crs:Name>\n<rdf:Alt><rdf:li xml:lang=\"x\"> Look "), s(n), F.lit(" </rdf:li></rdf:Alt>\n</crs:Name>"),
        F.lit("<crs:ToneCurvePV2012>\n <rdf:Seq>"), point(F.lit(0), n), point(n, n + 40), point(F.lit(255), F.lit(250)), F.lit("</rdf:Seq>\n</crs:ToneCurvePV2012></rdf:Description>"),
    )
    return part.select(s(i).alias("path"), F.when(i % 10 == 0, "no preset").otherwise(body).alias("value"))


_PRESETS = ", p AS (SELECT CAST(p_partkey AS VARCHAR) AS path, p_partkey AS i, p_size AS n FROM part WHERE p_partkey % 10 <> 0)"


@query("s15_converted_presets", ("part",), f"""{_PRESETS}, t AS (SELECT path, i, n, 1000000.0 / CASE WHEN i % 2 = 0 THEN 4000 + n * 10 ELSE 5500 END - 1000000.0 / (2000 + n * 100) AS mired FROM p),
v AS (SELECT path, 'exposure' AS target, n % 5 + 0.5 AS value FROM t UNION ALL SELECT path, 'contrast', n - 25 FROM t WHERE i % 6 <> 0 UNION ALL SELECT path, 'shadows', least(100, n * 3.0) FROM t UNION ALL SELECT path, 'sharpness', least(100, n * 4 / 1.5) FROM t UNION ALL SELECT path, 'temperature', greatest(-100, least(100, mired / 1.5)) FROM t
UNION ALL SELECT path, 'hsl.oranges.hue', n * 0.75 FROM t UNION ALL SELECT path, 'colorGrading.blending', n FROM t) SELECT path, target, round(CAST(value AS DOUBLE), 6) AS value FROM v""")
def _(part):
    return presets.adjustments(preset_texts(part)).select("path", "target", F.round("value", 6).alias("value"))


@query("s15_curves_names_failures", ("part",), f"""{_PRESETS}, c AS (SELECT path, unnest([0, 1, 2]) AS place, unnest([0, n, 255]) AS x, unnest([n, n + 40, 250]) AS y FROM p)
SELECT path, 'curve ' || place || ' ' || x || ' ' || CASE WHEN y > x AND x < 64 THEN CAST(round(x + (y - x) * (0.8 + 0.2 * x / 64)) AS INT) ELSE y END AS what FROM c UNION ALL SELECT path, 'name Look ' || n FROM p UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'name Imported Preset' FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT path, 'unread Contrast2012 soft' FROM p WHERE i % 6 = 0""")
def _(part):
    texts = preset_texts(part)
    points = presets.curves(texts).select("path", F.concat_ws(" ", F.lit("curve"), "place", "x", "y").alias("what"))
    named = presets.names(texts).select("path", F.concat_ws(" ", F.lit("name"), "name").alias("what"))
    return points.unionByName(named).unionByName(presets.unread(texts).select("path", F.concat_ws(" ", F.lit("unread"), "attribute", "raw").alias("what")))


@query("s13_lut_tables", ("part",), """, l AS (SELECT p_partkey // 10 AS path, p_partkey % 10 AS k, p_size AS n FROM part) SELECT CAST(path AS VARCHAR) AS path, 2 AS size, row_number() OVER (PARTITION BY path ORDER BY k) - 1 AS i, round(n / 100.0, 6) AS r, round(k / 10.0, 6) AS g, -0.5::DOUBLE AS b FROM l WHERE k > 2 AND path IN (SELECT path FROM l WHERE k = 1)""")
def _(part):
    """Tables as lines of text, ten parts each: a comment, a size, a title, then entries."""
    k = F.col("p_partkey") % 10
    entry = F.concat_ws(" ", (F.col("p_size") / 100).cast("string"), (k / 10).cast("string"), F.lit("-0.5"))
    text = F.when(k == 0, "# made of parts").when(k == 1, "LUT_3D_SIZE 2").when(k == 2, 'TITLE "x"').otherwise(entry)
    lines = part.select(F.floor(F.col("p_partkey") / 10).cast("string").alias("path"), k.alias("line_number"), text.alias("value"))
    found = files.parse_cube(lines).filter("size IS NOT NULL")
    return found.select("path", "size", F.col("i").cast("bigint").alias("i"), *[F.round(c, 6).alias(c) for c in "rgb"])


@file_query("s14_lens_database", ("part",), """SELECT p_brand AS maker, p_type || ' ' || p_partkey AS model, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_size * k AS DOUBLE) END AS focal, CASE WHEN p_partkey % 3 > 0 THEN round(p_size / 1000.0 * k, 6) END AS a FROM part, (SELECT unnest([1.0, 2.0]) AS k) WHERE p_partkey % 3 > 0 OR k = 1""")
def s14(spark, sf_dir):
    """A lens database as XML files, written of parts and read again; a third of the lenses have no calibration."""
    (part,) = catalog(spark, sf_dir, "part")
    s = lambda c: c.cast("string")
    entry = lambda k: F.concat(F.lit('<distortion model="ptlens" focal="'), s(F.col("p_size") * k), F.lit('" a="'), s(F.col("p_size") / 1000 * k), F.lit('" b="0.5" c="-1"/>'))
    calibrated = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("<calibration>"), entry(1), entry(2), F.lit("</calibration>"))).otherwise("")
    text = F.concat(F.lit("<lens><maker>"), "p_brand", F.lit("</maker><model>"), "p_type", F.lit(" "), s(F.col("p_partkey")), F.lit("</model><mount>M</mount><cropfactor>1.5</cropfactor>"), calibrated, F.lit("</lens>"))
    place = f"{shared_dir(spark)}/lenses-{uuid.uuid4().hex}"
    block = part.select(F.floor(F.col("p_partkey") / 50).alias("file"), text.alias("lens")).groupBy("file").agg(F.concat(F.lit("<lensdatabase>"), F.array_join(F.collect_list("lens"), ""), F.lit("</lensdatabase>")).alias("value"))
    block.select("value").write.option("maxRecordsPerFile", 1).text(place)  # fifty lenses a file
    return files.read_lenses(spark, place).select("maker", "model", "focal", F.round("a", 6).alias("a"))


@file_query("n4_incremental_batches", ("orders",), """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 > 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS value, CASE WHEN o_orderkey % 10 = 0 THEN 'no picture' END AS error FROM orders""")
def n4(spark, sf_dir):
    """Orders that come in three parts, each processed by a run of its own, the last run finding nothing; items that fail are rows with an error."""
    (orders,) = catalog(spark, sf_dir, "orders")
    place = f"{shared_dir(spark)}/incremental-{uuid.uuid4().hex}"
    rows = orders.select(F.col("o_orderkey").alias("id"), "o_totalprice")
    fine = F.col("id") % 10 > 0
    step = lambda batch: batch.select("id", F.when(fine, F.floor("o_totalprice").cast("bigint")).alias("value"), F.when(~fine, "no picture").alias("error"))
    for part in (0, 1, 2, None):
        if part is not None:
            rows.filter(F.col("id") % 3 == part).write.mode("append").parquet(f"{place}/in")
        jobs.run_incrementally(spark, f"{place}/in", rows.schema, f"{place}/out", f"{place}/checkpoint", step)
    return spark.read.parquet(f"{place}/out").select("id", "value", "error")


@query("s4_upserted_images", ("images",), """, n AS (SELECT id + CASE WHEN id % 3 = 0 THEN 1000000 ELSE 0 END AS id, CASE WHEN id % 4 > 0 THEN 'new/' || relative_path END AS relative_path, modified_at + 5 AS modified_at FROM images WHERE id % 2 = 0)
SELECT coalesce(n.id, i.id) AS id, coalesce(n.relative_path, i.relative_path) AS relative_path, coalesce(n.modified_at, i.modified_at) AS modified_at FROM images i FULL JOIN n ON n.id = i.id""")
def _(images):
    """A scan finds half of the images again, some under new ids, a quarter of them without a path."""
    i = F.col("id")
    old = images.select("id", "relative_path", "modified_at")
    new = images.filter(i % 2 == 0).select((i + F.when(i % 3 == 0, 1_000_000).otherwise(0)).alias("id"), F.when(i % 4 > 0, F.concat(F.lit("new/"), "relative_path")).alias("relative_path"), (F.col("modified_at") + 5).alias("modified_at"))
    return files.upsert(old, new, "id")


@query("x7_cache_keys", ("events",), """, e AS (SELECT event_id AS id, event_id % 5 AS k, user_id AS u FROM events), g AS (SELECT *, CASE WHEN k > 0 THEN 'steps=' || k || '|' ELSE '' END || 'transformRotate=' || u || CASE WHEN k = 2 THEN '|lensModel="L"' ELSE '' END AS geometry, CASE WHEN k = 3 THEN 'blur|lensBlurAmount=' || u ELSE 'sharp' END AS blur FROM e)
SELECT id, sha256(geometry) AS geometry, sha256(sha256(geometry) || '|' || blur) AS thumbnail, sha256('path=/p/' || u || '|exposure=' || k || CASE WHEN k = 3 THEN '|lensBlurAmount=' || u || '|lensBlurEnabled=true' ELSE '' END) AS visual FROM g""")
def _(events):
    i, k, u = F.col("event_id"), F.col("event_id") % 5, F.col("user_id").cast("string")
    s = k.cast("string")
    text = F.concat(F.lit('{"transformRotate": '), u, F.lit(', "exposure": '), s, F.lit(', "rotation": 1.5'), F.when(k > 0, F.concat(F.lit(', "orientationSteps": '), s)).otherwise(""), F.when(k == 2, ', "lensModel": "L"').otherwise(""), F.when(k == 3, F.concat(F.lit(', "lensBlurEnabled": true, "lensBlurAmount": '), u)).otherwise(""), F.lit("}"))
    v = events.select(i.alias("id"), F.concat(F.lit("/p/"), u).alias("path"), F.parse_json(text).alias("v"))
    return v.select("id", keys.geometry_key("v").alias("geometry"), keys.thumbnail_key("v").alias("thumbnail"), keys.visual_key(F.col("path"), "v").alias("visual"))
