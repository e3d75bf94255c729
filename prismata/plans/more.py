"""Further queries: tag scores, geometry, review logs, scalar functions, sources and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismata.functions import parse
from prismata.operators import catalog as C
from prismata.operators import grouping, raster, review, scoring, similarity
from prismata.plans.registry import BASE, GROUPED, PIXELS, POSE, VIEW, _flat, _pixels, query
from prismata.sources import files
from prismata.streaming import jobs


@query("g4_logical_captures", BASE, f"{GROUPED} SELECT coalesce(group_id, CAST(id AS VARCHAR)) AS capture, arg_min(id, (CASE WHEN is_raw THEN 0 ELSE 1 END, id)) AS representative, count(*) AS backing FROM grouped GROUP BY 1")
def _(*views):
    g = grouping.sibling_groups(C.base_view(*views)).withColumn("capture", F.coalesce("group_id", F.col("id").cast("string")))
    return g.groupBy("capture").agg(F.min_by("id", F.struct(F.when(F.col("is_raw"), 0).otherwise(1), "id")).alias("representative"), F.count("*").alias("backing"))


@query("g6_blurry_outside_groups", BASE, f"{GROUPED} SELECT id, CAST(id % 200 AS DOUBLE) AS sharpness FROM grouped WHERE group_id IS NULL AND id % 200 < 100")
def _(*views):
    g = grouping.sibling_groups(C.base_view(*views)).withColumn("sharpness", (F.col("id") % 200).cast("double"))
    return grouping.blurry(g, g.filter("group_id IS NOT NULL")).select("id", "sharpness")


@query("g9_model_thresholds", ("embeddings",), """, p AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
SELECT src, dst, round(s, 6) AS similarity FROM p WHERE s >= CASE src % 3 WHEN 0 THEN 0.45 WHEN 1 THEN 0.42 END""")
def _(embeddings):
    pairs = similarity.similar_pairs(embeddings, embeddings, "vec_id", "embedding", min(s for s, _ in similarity.THRESHOLDS.values()), True)
    models = embeddings.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 == 0, "sface").when(F.col("vec_id") % 3 == 1, "arcface").otherwise("unknown").alias("model_id"))
    return similarity.over_threshold(pairs, models).select("src", "dst", F.round("similarity", 6).alias("similarity"))


@query("g10_verified_duplicates", ("embeddings",), """, m AS (SELECT vec_id AS id, vec_id - vec_id % 5 AS representative, label FROM embeddings)
SELECT m.id, m.representative FROM m LEFT JOIN embeddings a ON a.vec_id = m.id AND m.label <> 3 LEFT JOIN embeddings b ON b.vec_id = m.representative WHERE a.vec_id IS NULL OR round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.1""")
def _(embeddings):
    members = embeddings.select(F.col("vec_id").alias("id"), (F.col("vec_id") - F.col("vec_id") % 5).alias("representative"))
    known = embeddings.select(F.col("vec_id").alias("id"), F.when(F.col("label") != 3, F.col("embedding")).alias("a"))  # label 3 stands for images without a vector
    pairs = members.join(known, "id").join(embeddings.select(F.col("vec_id").alias("representative"), F.col("embedding").alias("b")), "representative")
    scored = pairs.filter("a IS NOT NULL").select("id", "representative", F.round(parse.dot(F.col("a"), F.col("b")), 6).alias("similarity"))
    return similarity.drop_unlike_members(members, scored, 0.1).select("id", "representative")


@query("g11_box_overlap", ("faces",), """, b AS (SELECT id, image_id, bbox_x AS x, bbox_y AS y, 0.3 AS w, 0.3 AS h FROM faces), p AS (SELECT a.id AS a, b.id AS b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i FROM b a JOIN b ON a.image_id = b.image_id AND a.id < b.id)
SELECT a, b, round(i / (0.18 - i), 6) AS iou FROM p WHERE i / (0.18 - i) > 0.3""")
def _(faces):
    box = faces.select("id", "image_id", F.struct(F.col("bbox_x").alias("x"), F.col("bbox_y").alias("y"), F.lit(0.3).alias("w"), F.lit(0.3).alias("h")).alias("p"))
    pairs = box.select(F.col("id").alias("a"), "image_id", "p").join(box.select(F.col("id").alias("b"), "image_id", F.col("p").alias("q")), "image_id").filter("a < b")
    return pairs.withColumn("iou", similarity.iou("p", "q")).filter("iou > 0.3").select("a", "b", F.round("iou", 6).alias("iou"))


LOGITS = "logits AS (SELECT vec_id AS id, [10 * x FOR x IN embedding] AS logits FROM embeddings), each AS (SELECT id, unnest(logits)::DOUBLE AS x, unnest(range(0, 64)) AS pos FROM logits)"


def _logits(embeddings):
    return embeddings.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: (x * F.lit(10).cast("float")).cast("double")).alias("logits"))


def _labels(spark):
    return spark.range(64).select(F.col("id").cast("int").alias("pos"), F.concat(F.lit("tag"), "id").alias("tag"), (F.lit(0.5) + F.col("id") / 200).alias("threshold"))


@query("g12_sigmoid_tags", ("embeddings",), f", {LOGITS}, s AS (SELECT id, 'tag' || pos AS tag, 1 / (1 + exp(-greatest(-30, least(30, x)))) AS score, 0.5 + pos / 200 AS t FROM each), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, tag) AS rn FROM s WHERE score > t) SELECT id, tag, round(score, 6) AS score FROM r WHERE rn <= 3")
def _(embeddings):
    return similarity.sigmoid_tags(_logits(embeddings), _labels(embeddings.sparkSession), 3)


@query("g13_g14_softmax_tags", ("embeddings",), f""", {LOGITS}, t AS (SELECT id, 'tag' || pos AS tag, exp(x - max(x) OVER w) / sum(exp(x)) OVER w * exp(max(x) OVER w) AS score FROM each WINDOW w AS (PARTITION BY id)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, tag) AS rn FROM t WHERE score > 0.03), b AS (SELECT id, tag, round(score, 6) AS score FROM r WHERE rn <= 4),
up AS (SELECT * FROM (VALUES ('tag1', 'tag2'), ('tag2', 'bird'), ('tag1', 'bird'), ('bird', 'animal'), ('tag2', 'animal'), ('tag1', 'animal'), ('tag9', 'tag4')) v(child, parent))
SELECT id, tag, max(score) AS score FROM (SELECT * FROM b UNION ALL SELECT id, parent, 0.0 FROM b JOIN up ON b.tag = up.child) GROUP BY 1, 2""")
def _(embeddings):
    # a tag's list names all that stands above it, as the lists of the original do
    listed = {"tag1": ["tag2", "bird", "animal"], "tag2": ["bird", "animal"], "bird": ["animal"], "tag9": ["tag4"]}
    parents = embeddings.sparkSession.createDataFrame([(child, up) for child, ups in listed.items() for up in ups], "child string, parent string")
    return similarity.softmax_tags(_logits(embeddings), _labels(embeddings.sparkSession), parents, 0.03, 4)


@query("g19_g20_cull_plan", BASE, f"""{GROUPED}, q AS (SELECT g.id, g.group_id, i.relative_path AS path, round((g.id % 97) / 97.0, 4) AS quality, CAST(g.id % 300 AS DOUBLE) AS sharpness, CASE WHEN g.id % 4 <> 0 THEN (g.id % 21) / 20.0 END AS frontal,
CASE g.id % 5 WHEN 0 THEN 0.7 WHEN 1 THEN 0.3 WHEN 2 THEN 0.29 END AS p, CASE WHEN g.id % 6 = 1 THEN (g.id % 11) / 10.0 END AS composition, CASE WHEN g.id % 2 = 0 THEN -1.5 END AS bias, 3.0 AS weight FROM grouped g JOIN images i ON i.id = g.id),
j AS (SELECT *, greatest(-0.2, least(0.04, CASE WHEN frontal IS NULL THEN 0 ELSE greatest(-0.04, least(0.04, (frontal - 0.5) * 0.08)) END + CASE WHEN p >= 0.7 OR p IS NULL THEN 0 WHEN p >= 0.3 THEN -0.05 ELSE -0.15 END)) AS adjustment FROM q),
k AS (SELECT *, CASE WHEN adjustment = 0 THEN quality ELSE greatest(0, least(1, quality + adjustment)) END AS own FROM j),
x AS (SELECT *, CASE WHEN bias IS NULL THEN own ELSE own * 0.8 + 0.2 / (1 + exp(-(bias + weight * own))) END AS score FROM k),
r AS (SELECT *, CASE WHEN group_id IS NOT NULL THEN first_value(id) OVER w END AS rep, CASE WHEN group_id IS NOT NULL THEN first_value(path) OVER w END AS rep_path FROM x WINDOW w AS (PARTITION BY group_id ORDER BY round(score, 9) DESC, id)),
v AS (SELECT *, CASE WHEN id <> rep THEN 'duplicate_of:' || rep_path WHEN group_id IS NULL AND sharpness < 100 THEN 'blurry' WHEN group_id IS NOT NULL THEN 'best_in_group' ELSE 'unique' END AS reason FROM r)
SELECT id, round(score, 6) AS score, reason, CASE WHEN reason IN ('unique', 'best_in_group') THEN 'keep' ELSE 'reject' END AS verdict,
concat_ws(' ', CASE WHEN reason LIKE 'dup%' THEN 'duplicate:reject' END, CASE WHEN reason = 'blurry' THEN 'sharpness:reject' END, CASE WHEN reason IN ('unique', 'best_in_group') THEN 'technical_quality:context' ELSE 'technical_quality:supporting' END,
CASE WHEN composition IS NOT NULL THEN 'subject_geometry:context' END, CASE WHEN bias IS NOT NULL THEN 'personalization:context' END, CASE WHEN adjustment <> 0 THEN 'face_pose_adjustment:context' END,
CASE WHEN p >= 0.7 THEN 'eye_state:context' WHEN p >= 0.3 THEN 'eye_state:supporting' WHEN p IS NOT NULL THEN 'eye_state:reject' END) AS factors FROM v""")
def _(*views):
    i = F.col("id")
    paths = views[0].select("id", F.col("relative_path").alias("path"))
    g = grouping.sibling_groups(C.base_view(*views)).select("id", F.col("group_id").alias("group_root"), F.round((i % 97) / 97.0, 4).alias("quality"), (i % 300).cast("double").alias("sharpness")).join(paths, "id")
    eyes = scoring.eye_state(F.when(i % 5 == 0, 0.7).when(i % 5 == 1, 0.3).when(i % 5 == 2, 0.29))
    adjustment = scoring.subject_adjustment(F.when(i % 4 != 0, (i % 21) / 20.0), eyes)
    rows = g.select("*", adjustment.alias("adjustment"), eyes.alias("eyes"), F.when(i % 6 == 1, (i % 11) / 10.0).alias("composition"), F.when(i % 2 == 0, -1.5).alias("bias"), F.lit(3.0).alias("weight"))
    return scoring.cull_plan(rows).select("id", F.round("score", 6).alias("score"), "reason", "verdict", F.array_join(F.transform("factors", lambda f: F.concat_ws(":", f["id"], f["impact"])), " ").alias("factors"))


@query("g22_pose", ("faces",), f"{POSE} SELECT id, person_id, round(frontal, 6) AS frontal, round(roll, 6) AS roll FROM w")
def _(faces):
    c = F.col
    pose = scoring.pose((c("right_eye_x"), c("right_eye_y")), (c("left_eye_x"), c("left_eye_y")), c("nose_x"))
    return faces.select("id", "person_id", pose.alias("p")).select("id", "person_id", F.round("p.frontal", 6).alias("frontal"), F.round("p.roll", 6).alias("roll"))


@query("x13_eye_states", ("lineitem",), "SELECT CASE WHEN p >= 0.7 THEN 'open' WHEN p >= 0.3 THEN 'semi-closed' ELSE 'closed' END AS eyes, count(*) AS n FROM (SELECT l_quantity / 50 AS p FROM lineitem) GROUP BY 1")
def _(lineitem):
    return lineitem.groupBy(scoring.eye_state(F.col("l_quantity") / 50).alias("eyes")).agg(F.count("*").alias("n"))


LOG = """, log AS (SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS seq, l_partkey AS id, CASE WHEN l_tax > 0.04 THEN 'accepted' ELSE 'rejected' END AS decision, l_linenumber % 2 = 0 AS batch FROM lineitem)"""


@query("m3_reviews", ("part", "lineitem"), f"""{LOG}, s AS (SELECT id, arg_max(decision, seq) AS d FROM log WHERE NOT batch GROUP BY 1), b AS (SELECT id, arg_min(decision, seq) AS d FROM log WHERE batch GROUP BY 1)
SELECT p_partkey AS id, coalesce(s.d, CASE WHEN p_size % 2 = 0 THEN b.d END, CASE WHEN p_size % 2 = 0 THEN 'suggested' ELSE 'accepted' END) AS review_state FROM part LEFT JOIN s ON s.id = p_partkey LEFT JOIN b ON b.id = p_partkey""")
def _(part, lineitem):
    items = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "suggested").otherwise("accepted").alias("review_state"))
    log = lineitem.select((F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_partkey").alias("id"), F.when(F.col("l_tax") > 0.04, "accepted").otherwise("rejected").alias("decision"), (F.col("l_linenumber") % 2 == 0).alias("batch"))
    return review.reviewed(items, log)


@query("m5_merged_people", ("supplier",), "SELECT s_suppkey AS id, CASE WHEN s_suppkey > 8 THEN (s_suppkey - 1) % 8 + 1 ELSE s_suppkey END AS root FROM supplier")
def _(supplier):
    return review.merged_people(supplier.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") > 8, F.col("s_suppkey") - 8).alias("merged_into")))


@query("m6_a10_cull_sessions", ("lineitem",), """, o AS (SELECT l_orderkey AS id, arg_max(CASE WHEN l_returnflag = 'A' THEN 'reject' ELSE 'keep' END, l_partkey * 10 + l_linenumber) AS s FROM lineitem WHERE l_linenumber > 1 GROUP BY 1)
SELECT l_suppkey AS session_id, count(*) AS total_count, count(*) FILTER (coalesce(o.s, 'keep') = 'reject') AS rejected_count FROM lineitem l LEFT JOIN o ON o.id = l.l_orderkey WHERE l_linenumber = 1 GROUP BY 1""")
def _(lineitem):
    decisions = lineitem.filter("l_linenumber = 1").select(F.col("l_suppkey").alias("session_id"), F.col("l_orderkey").alias("id"), F.lit("keep").alias("final_status"))
    overrides = lineitem.filter("l_linenumber > 1").select((F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "A", "reject").otherwise("keep").alias("next_status"))
    return review.cull_sessions(review.cull_decisions(decisions, overrides))


@query("m7_moved_paths", ("images",), "SELECT id, CASE WHEN id % 9 = 0 THEN 'archive/' || relative_path ELSE relative_path END AS path FROM images")
def _(images):
    rows = images.select("id", F.col("relative_path").alias("path"))
    moves = rows.filter("id % 9 = 0").select("path", F.concat(F.lit("archive/"), "path").alias("target")).distinct()
    return review.moved(rows, moves).select("id", "path")


CACHE = ", cache AS (SELECT id AS image_id, CASE WHEN id % 3 = 0 THEN modified_at - 1 ELSE modified_at END AS image_modified_at, CASE WHEN id % 4 = 0 THEN 'v2' ELSE 'v3' END AS feature_set_version, (id % 89) / 89.0 AS quality_score FROM images)"


@query("m12_q35_cache_hits", ("images",), f"{CACHE} SELECT c.image_id, round(c.quality_score, 6) AS quality_score FROM cache c JOIN images i ON i.id = c.image_id AND i.modified_at = c.image_modified_at WHERE c.feature_set_version = 'v3'")
def _(images):
    i = F.col("id")
    cache = images.select(i.alias("image_id"), F.when(i % 3 == 0, F.col("modified_at") - 1).otherwise(F.col("modified_at")).alias("image_modified_at"), F.when(i % 4 == 0, "v2").otherwise("v3").alias("feature_set_version"), ((i % 89) / 89.0).alias("quality_score"))
    return review.cache_hits(cache, images, "v3").select("image_id", F.round("quality_score", 6).alias("quality_score"))


@query("m1_m2_replacements", ("ai_tags",), "SELECT id, image_id, model_revision FROM (SELECT *, id % 3 AS seq, max(id % 3) OVER (PARTITION BY image_id, model_id, model_revision) AS last FROM ai_tags) WHERE seq = last")
def _(ai_tags):
    """A run replaces the rows of its own image, model and revision; what older revisions found stays."""
    runs = ai_tags.withColumn("seq", F.col("id") % 3)
    return review.present_rows(runs, "image_id", "model_id", "model_revision").select("id", "image_id", "model_revision")


@query("u4_u5_tag_sets", ("image_tags",), ", t AS (SELECT image_id, list_sort(list(DISTINCT name)) AS t FROM image_tags GROUP BY 1) SELECT image_id, len(list_filter(list_distinct(list_append(t, 'new')), x -> x <> 'Brand#11')) AS n FROM t".replace("x -> x", "lambda x: x"))
def _(image_tags):
    tags = image_tags.groupBy("image_id").agg(F.collect_set("name").alias("t"))
    return tags.select("image_id", F.size(review.with_tags(F.col("t"), F.array(F.lit("new")), F.array(F.lit("Brand#11")))).cast("bigint").alias("n"))


@query("x7_x8_x15_digests", ("images",), "SELECT id, sha256(concat_ws('|', relative_path, CAST(modified_at AS VARCHAR))) AS key, base64(encode(file_name)) AS name64 FROM images")
def _(images):
    return images.select("id", F.sha2(F.concat_ws("|", "relative_path", F.col("modified_at").cast("string")), 256).alias("key"), F.base64(F.encode("file_name", "UTF-8")).alias("name64"))


@query("x11_iso_heuristics", ("metadata",), "SELECT image_id, CASE WHEN iso >= 1600 THEN 'lmmse' WHEN iso >= 800 THEN 'igv' WHEN iso IS NOT NULL THEN 'amaze' END AS method, CASE WHEN iso IS NOT NULL THEN round(greatest(0, least(1, (iso - 100) / 6300)), 6) END AS strength FROM metadata")
def _(metadata):
    return metadata.select("image_id", parse.demosaic_for_iso(F.col("iso")).alias("method"), F.round(parse.denoise_for_iso(F.col("iso")), 6).alias("strength"))


@query("x14_normalized", ("embeddings",), "SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6))[pos] AS x, pos FROM embeddings, (SELECT unnest(range(1, 65)) AS pos)")
def _(embeddings):
    return embeddings.select("vec_id", F.posexplode(parse.normalized(F.col("embedding"))).alias("pos", "x")).select("vec_id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


# Fixed values of the oracle: the formats as they are listed for users.
LISTED_RAW = "dng pro ari crw cr2 cr3 bay raw erf raf 3fr fff iiq kdc k25 dcs dcr mos rwl mef mrw nef nrw orf rw2 pef ptx srw x3f arw srf sr2"
LISTED_OTHER = "jpg jpeg png gif bmp tiff tif webp jxl exr hdr tga ico dds qoi ff pnm pbm pgm ppm pam"
UNKNOWN = "txt xmp mov"
_every = "string_split('" + " ".join((LISTED_RAW, LISTED_OTHER, UNKNOWN)) + "', ' ')"
_count = len(" ".join((LISTED_RAW, LISTED_OTHER, UNKNOWN)).split())


@query("s3_formats", ("part",), f"""SELECT p_partkey AS id, list_contains(string_split('{LISTED_RAW}', ' '), e) AS raw, NOT list_contains(string_split('{UNKNOWN}', ' '), e) AS supported FROM (SELECT p_partkey, {_every}[CAST(p_partkey % {_count} AS INT) + 1] AS e FROM part)""")
def _(part):
    kinds = F.array(*[F.lit(x) for x in " ".join((LISTED_RAW, LISTED_OTHER, UNKNOWN)).split()])
    name = part.select("p_partkey", F.element_at(kinds, (F.col("p_partkey") % _count).cast("int") + 1).alias("e"))
    path = F.concat(F.lit("/a.b/x."), F.when(F.col("p_partkey") % 2 == 0, F.upper("e")).otherwise(F.col("e")))
    return name.select(F.col("p_partkey").alias("id"), files.is_raw(path).alias("raw"), files.is_supported(path).alias("supported"))


@query("s9_s10_xmp_round_trip", (*BASE, "image_tags"), f", {VIEW}, t AS (SELECT image_id AS id, list_sort(list(DISTINCT name)) AS t FROM image_tags GROUP BY 1) SELECT id, rating, coalesce(color_label, '') AS label, array_to_string(coalesce(t, []), ',') AS tags FROM view_ LEFT JOIN t USING (id)")
def _(images, roots, versions, metadata, image_tags):
    tags = image_tags.groupBy(F.col("image_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("t"))
    rows = C.base_view(images, roots, versions, metadata).join(tags, "id", "left")
    read = rows.select("id", files.parse_xmp(files.xmp_packet(F.col("rating"), F.col("color_label"), F.coalesce("t", F.array().cast("array<string>")))).alias("x"))
    return read.select("id", "x.rating", F.coalesce("x.label", F.lit("")).alias("label"), F.array_join("x.tags", ",").alias("tags"))


@query("s5_missing_marks", ("images",), "SELECT id, CASE WHEN id % 4 = 0 THEN 'present' WHEN root_id = 2 THEN 'missing' ELSE status END AS status FROM images")
def _(images):
    return files.mark_missing(images, images.filter("id % 4 = 0").select("id"), F.col("root_id") == 2, "id").select("id", "status")


@query("s18_export_plan", ("images",), "SELECT id, regexp_replace(relative_path, '\\.[^./]*$', '') || '.jpg' AS target, CAST(greatest(round((id % 4000 + 1) * least(1.0, 1000.0 / greatest(id % 4000 + 1, 1500))), 1) AS INT) AS w, CAST(greatest(round(1500 * least(1.0, 1000.0 / greatest(id % 4000 + 1, 1500))), 1) AS INT) AS h FROM images")
def _(images):
    rows = images.select("id", F.concat(F.lit("/base/"), "relative_path").alias("path"), (F.col("id") % 4000 + 1).alias("width"), F.lit(1500).cast("bigint").alias("height"))
    return files.export_plan(rows, "/base", 1000)


@query("n3_recovery", ("job_log",), ", s AS (SELECT job_id, arg_max(state, seq) AS state FROM job_log GROUP BY 1) SELECT job_id, 'failed' AS state FROM s WHERE state IN ('running', 'paused', 'cancelling')")
def _(job_log):
    return jobs.recover(jobs.job_states(job_log), 0).select("job_id", "state")


@query("k2_linear_light", ("lineitem",), "SELECT l_orderkey * 10 + l_linenumber AS id, round(CASE WHEN l_discount <= 0.04045 THEN l_discount / 12.92 ELSE pow((l_discount + 0.055) / 1.055, 2.4) END, 6) AS linear FROM lineitem")
def _(lineitem):
    return lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.round(raster.srgb_to_linear(F.col("l_discount")), 6).alias("linear"))


@query("k5_mask_algebra", ("lineitem",), f", p AS ({PIXELS}) SELECT id, x, y, least(greatest(greatest(r, g) - b, 0), 200) AS mask FROM p")
def _(lineitem):
    p = _pixels(lineitem)
    added = raster.combine_masks(F.col("r"), F.col("g"), "add")
    return p.select("id", "x", "y", raster.combine_masks(raster.combine_masks(added, F.col("b"), "subtract"), F.lit(200), "intersect").alias("mask"))


@query("a16_clipping", ("lineitem",), f", p AS ({PIXELS}), l AS (SELECT id, (218 * r + 732 * g + 74 * b) >> 10 AS v FROM p WHERE (y * 7 + x - 1) % 2 = 0) SELECT id, round(count(*) FILTER (v < 5) / count(*), 6) AS dark, round(count(*) FILTER (v >= 250) / count(*), 6) AS bright FROM l WHERE v BETWEEN 0 AND 255 GROUP BY 1")
def _(lineitem):
    return raster.clipping(raster.histogram(_flat(lineitem), 7)).select("id", F.round("dark", 6).alias("dark"), F.round("bright", 6).alias("bright"))
