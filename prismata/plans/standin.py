"""A media catalog laid over the test tables: the views below, in SQL that Spark and DuckDB both run.

orders are images, customers' nations their folders, regions their roots, parts their
tags, line items their faces and machine tags, suppliers the people, events the job log.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: View -> (tables and views that it reads, SQL). EPOCH(x) stands for the seconds of a timestamp.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "roots": (("region",), "SELECT r_regionkey AS id, concat('/', lower(r_name)) AS absolute_path, CASE WHEN r_regionkey % 2 = 0 THEN r_name END AS label FROM region"),
    "folders": (("nation",), "SELECT n_nationkey AS id, n_regionkey AS root_id, lower(n_name) AS relative_path FROM nation"),
    "images": (
        ("orders", "customer", "nation"),
        """SELECT o_orderkey AS id, n_regionkey AS root_id, n_nationkey AS folder_id,
           concat('IMG_', CAST(o_orderkey - o_orderkey % 3 AS VARCHAR(20)), CASE o_orderkey % 3 WHEN 0 THEN '.ARW' WHEN 1 THEN '.JPG' ELSE '.xmp.jpg' END) AS file_name,
           concat(lower(n_name), '/c', CAST(o_custkey % 4 AS VARCHAR(20)), '/IMG_', CAST(o_orderkey - o_orderkey % 3 AS VARCHAR(20)), CASE o_orderkey % 3 WHEN 0 THEN '.ARW' WHEN 1 THEN '.JPG' ELSE '.xmp.jpg' END) AS relative_path,
           EPOCH(o_orderdate) AS modified_at, o_orderkey % 3 = 0 AS is_raw, CASE WHEN o_orderkey % 29 = 0 THEN 'missing' ELSE 'present' END AS status
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "versions": (
        ("orders",),
        """SELECT o_orderkey AS image_id, '' AS copy_id, CAST(o_orderkey % 6 AS INT) AS rating, o_orderkey % 4 = 0 AS is_edited, CASE o_orderkey % 5 WHEN 0 THEN 'red' WHEN 1 THEN 'green' WHEN 2 THEN 'Blue' END AS color_label FROM orders
           UNION ALL SELECT o_orderkey, 'vc1', CAST(o_orderkey % 4 AS INT), true, 'purple' FROM orders WHERE o_orderkey % 10 = 0""",
    ),
    "metadata": (
        ("orders", "customer"),
        """SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 3 <> 1 THEN EPOCH(o_orderdate) + 86400 END AS date_taken, CAST(year(o_orderdate) AS INT) AS year, c_mktsegment AS camera_make, o_orderpriority AS camera_model,
           CASE WHEN o_orderkey % 11 <> 0 THEN concat('Lens ', o_orderpriority) END AS lens, CASE WHEN o_orderkey % 5 <> 0 THEN 100 * (1 + o_custkey % 20) END AS iso, o_totalprice / 50000 AS aperture, c_name AS title,
           CASE WHEN o_orderkey % 9 <> 0 THEN concat('1/', CAST(30 * (1 + o_custkey % 9) AS VARCHAR(20)), CASE o_custkey % 3 WHEN 0 THEN ' s' ELSE '' END) END AS shutter_speed, CASE WHEN o_orderkey % 4 <> 1 THEN CAST(24 + o_custkey % 100 AS DOUBLE) END AS focal_length,
           CASE o_custkey % 3 WHEN 0 THEN 'Lumo' WHEN 1 THEN 'Argent' END AS lens_make
           FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 7 <> 0""",
    ),
    "image_tags": (("lineitem", "part"), "SELECT DISTINCT l_orderkey AS image_id, p_brand AS name, CASE WHEN p_size % 3 = 0 THEN 'person' ELSE 'user' END AS kind FROM lineitem JOIN part ON l_partkey = p_partkey"),
    "ai_tags": (
        ("lineitem", "part"),
        """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS image_id, p_type AS name, 'clip' AS model_id, CASE WHEN l_linenumber < 5 THEN 'r1' ELSE 'r2' END AS model_revision, 1 - l_discount AS confidence,
           CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'accepted' ELSE 'suggested' END AS review_state FROM lineitem JOIN part ON l_partkey = p_partkey""",
    ),
    "people": (("supplier",), "SELECT s_suppkey AS id, s_name AS display_name, CASE WHEN s_suppkey % 13 = 0 THEN 'merged' ELSE 'active' END AS state, CASE WHEN s_suppkey % 13 = 0 THEN s_suppkey + 1 END AS merged_into FROM supplier"),
    "faces": (
        ("lineitem",),
        """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS image_id, CASE WHEN l_returnflag <> 'N' THEN l_suppkey END AS person_id, CASE l_returnflag WHEN 'R' THEN 'confirmed' WHEN 'A' THEN 'rejected' ELSE 'unreviewed' END AS review_state,
           1 - l_discount AS confidence, l_tax * 10 AS bbox_x, l_discount * 10 AS bbox_y, 0.02 * l_linenumber AS bbox_width, 0.01 * l_quantity AS bbox_height, l_suppkey % 40 AS cluster_id,
           CASE WHEN l_partkey % 2 = 0 THEN 'sface' ELSE 'arcface' END AS model_pack_id, CASE WHEN l_partkey % 3 <> 0 THEN l_partkey END AS embedding_id,
           CASE WHEN l_partkey % 5 <> 0 THEN 10 * l_linenumber + l_quantity END AS left_eye_x, 10 * l_linenumber AS right_eye_x, 100 * l_tax AS left_eye_y, 50 * l_discount AS right_eye_y, 10 * l_linenumber + l_quantity * l_discount * 8 AS nose_x,
           CASE WHEN l_suppkey % 4 <> 0 THEN l_tax * 12 END AS sharpness FROM lineitem""",
    ),
    "clusters": (("lineitem",), "SELECT id, max(CASE WHEN n = 1 THEN face END) AS representative_face_id, CASE WHEN id % 4 = 0 THEN 'accepted' ELSE 'unreviewed' END AS state FROM (SELECT l_suppkey % 40 AS id, l_orderkey * 10 + l_linenumber AS face, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) f GROUP BY id"),
    "cluster_state": (("supplier",), "SELECT s_suppkey AS cluster_id, CASE s_suppkey % 4 WHEN 0 THEN 'accepted' ELSE 'unreviewed' END AS state, CAST(s_nationkey AS BIGINT) AS updated_at FROM supplier"),
    "species": (
        ("lineitem", "part"),
        """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS image_id, p_name AS scientific_name, CASE WHEN p_size % 2 = 0 THEN p_type END AS common_name, 'species' AS taxon_rank, 1 - l_discount * 5 AS confidence, 'bioclip' AS model_id,
           CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'accepted' ELSE 'suggested' END AS review_state, l_linenumber % 2 = 0 AS is_ambiguous FROM lineitem JOIN part ON l_partkey = p_partkey""",
    ),
    "derivatives": (("orders",), "SELECT o_orderkey AS id, o_custkey AS source_image_id, CASE o_orderkey % 4 WHEN 0 THEN 'denoise' WHEN 1 THEN 'upscale' WHEN 2 THEN 'deblur' ELSE 'export' END AS operation_kind, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS state, EPOCH(o_orderdate) AS created_at FROM orders"),
    "cull_sessions": (("supplier",), "SELECT s_suppkey AS id, CAST(s_nationkey % 5 AS BIGINT) AS root_id, concat('/scope/', s_name) AS scope_path, CASE s_suppkey % 2 WHEN 0 THEN 'planned' ELSE 'applied' END AS state, CAST(floor(s_acctbal) AS BIGINT) AS updated_at FROM supplier"),
    "cull_decisions": (
        ("lineitem",),
        """SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS session_id, l_orderkey AS image_id, concat('/p/', CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20))) AS representative_path, CASE l_returnflag WHEN 'R' THEN 'reject' ELSE 'keep' END AS proposed_status,
           CASE l_linestatus WHEN 'F' THEN CASE l_returnflag WHEN 'R' THEN 'reject' ELSE 'keep' END ELSE 'pending' END AS final_status, l_quantity / 50 AS quality_score, concat('[{"id": "blur", "impact": "', CASE l_returnflag WHEN 'R' THEN 'reject' ELSE 'context' END, '"}]') AS factors_json FROM lineitem""",
    ),
    "cull_events": (("orders",), "SELECT o_orderkey AS id, o_orderkey * 10 + 1 + o_custkey % 7 AS decision_id, CASE o_orderstatus WHEN 'F' THEN 'keep' ELSE 'reject' END AS next_status, CASE WHEN o_orderkey % 5 = 0 THEN 'system' ELSE 'user' END AS source FROM orders"),
    "album_tree": (("part",), "SELECT p_partkey AS id, CASE WHEN p_partkey >= 10 THEN CAST(floor(p_partkey / 10) AS BIGINT) END AS parent_id, CASE WHEN p_partkey < 200 THEN 'group' ELSE 'album' END AS kind, concat(p_name, ' ', p_brand) AS name FROM part"),
    "album_paths": (("images",), "SELECT concat('album', CAST(id % 7 AS VARCHAR(20))) AS album, concat(CAST(root_id AS VARCHAR(20)), '/', relative_path, CASE WHEN id % 11 = 0 THEN '?vc=c1' ELSE '' END) AS path FROM images"),
    "analysis": (
        ("orders",),
        """SELECT o_orderkey AS image_id, 'tags' AS analysis_kind, EPOCH(o_orderdate) AS image_modified_at, 'completed' AS state FROM orders WHERE o_orderkey % 3 = 0
           UNION ALL SELECT o_orderkey, 'tags', EPOCH(o_orderdate) - 5, 'completed' FROM orders WHERE o_orderkey % 7 = 1
           UNION ALL SELECT o_orderkey, 'tags', EPOCH(o_orderdate), 'failed' FROM orders WHERE o_orderkey % 5 = 0""",
    ),
    "job_log": (("events",), "SELECT event_id AS seq, user_id AS job_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'paused' WHEN 'error' THEN 'failed' ELSE 'completed' END AS state, EPOCH(ts) AS at, value FROM events"),
}


def _needs(names) -> tuple[list[str], set[str]]:
    """Views in the order of their use, and the tables below them."""
    views, tables = [], set()
    for name in names:
        if name in VIEWS:
            below, more = _needs(VIEWS[name][0])
            views += [v for v in [*below, name] if v not in views]
            tables |= more
        else:
            tables.add(name)
    return views, tables


def catalog(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named views (or tables) as lazy DataFrames."""
    known: dict[str, DataFrame] = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _needs(names)[1]}
    for v in _needs(names)[0]:
        reads, text = VIEWS[v]
        text = re.sub(r"EPOCH\((\w+)\)", r"unix_timestamp(\1)", text.replace("{", "{{").replace("}", "}}"))
        for t in reads:
            text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
        known[v] = spark.sql(text, **{t: known[t] for t in reads})
    return [known[n] for n in names]


def sql(names: tuple[str, ...], body: str) -> str:
    """DuckDB SQL over the named views; body may begin with further named queries (", x AS (...)")."""
    ctes = ",\n".join(f"{v} AS ({re.sub(r'EPOCH\((\w+)\)', r'CAST(floor(epoch(\1)) AS BIGINT)', VIEWS[v][1])})" for v in _needs(names)[0])
    return f"WITH {ctes}\n{body}" if ctes else f"WITH {body[2:]}" if body.startswith(", ") else body
