"""One query for each operator of the catalog engine, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from prismata.functions import parse
from prismata.operators import catalog as C
from prismata.operators import components, dsl, facets, grouping, raster, scoring, similarity
from prismata.plans.standin import catalog, sql
from prismata.sources import files
from prismata.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: tuple[str, ...] = (), oracle: str | None = None):
    """Register a function of the named views' DataFrames; oracle is SQL over the same views."""

    def keep(build):
        QUERIES[name] = lambda spark, sf_dir: build(*catalog(spark, sf_dir, *views))
        if oracle:
            ORACLES[name] = sql(views, oracle)
        return build

    return keep


def file_query(name: str, views: tuple[str, ...] = (), oracle: str | None = None):
    """Register a function of (spark, sf_dir), for queries that read the tables as a stream or write on the way; oracle is SQL over the views."""

    def keep(build):
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = sql(views, oracle)
        return build

    return keep


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


BASE = ("images", "roots", "versions", "metadata")
VIEW = """view_ AS (SELECT i.id, i.root_id, i.folder_id, i.file_name, i.relative_path, i.modified_at, i.is_raw, r.absolute_path, v.rating, v.is_edited, v.color_label,
 m.date_taken, m.year, m.camera_make, m.camera_model, m.lens, m.lens_make, m.iso, m.aperture, m.shutter_speed, m.focal_length, m.title, coalesce(m.date_taken, i.modified_at) AS date
 FROM images i JOIN roots r ON i.root_id = r.id JOIN versions v ON v.image_id = i.id AND v.copy_id = '' LEFT JOIN metadata m ON m.image_id = i.id WHERE i.status = 'present')"""
PEOPLE = """person_images AS (SELECT image_id, name FROM image_tags WHERE kind = 'person' UNION ALL SELECT f.image_id, p.display_name FROM faces f JOIN people p ON f.person_id = p.id WHERE f.review_state = 'confirmed' AND p.state = 'active')"""


@query("f1_base_view", BASE, f", {VIEW} SELECT id, absolute_path, relative_path, rating, color_label, coalesce(date_taken, -1) AS date_taken, lens FROM view_")
def _(images, roots, versions, metadata):
    return C.base_view(images, roots, versions, metadata).select("id", "absolute_path", "relative_path", "rating", "color_label", F.coalesce("date_taken", F.lit(-1)).alias("date_taken"), "lens")


SEARCH = (*BASE, "image_tags", "ai_tags", "faces", "people")
HIT = "EXISTS (SELECT 1 FROM {t} t WHERE t.image_id = view_.id AND {w} contains(lower(t.name), '{n}'))"


def _search(q):
    def run(images, roots, versions, metadata, image_tags, ai_tags, faces, people):
        found = C.search(C.base_view(images, roots, versions, metadata), q, image_tags, ai_tags, C.person_images(image_tags, faces, people))
        return found.select("id", "relative_path", "date", "rating")

    return run


def _search_query(name: str, q: C.CatalogQuery, where: str, limit: str = "") -> None:
    query(name, SEARCH, f", {VIEW}, {PEOPLE} SELECT id, relative_path, date, rating FROM view_ WHERE {where} {limit}")(_search(q))


_search_query(
    "q2_structured_search",
    C.CatalogQuery(min_rating=1, is_raw=True, camera="urgent", tags=["brand#1", "brand#3"], exclude_ai_tags=["economy"], date_from=820454400, limit=500),
    "rating >= 1 AND is_raw AND contains(lower(concat_ws(' ', camera_make, camera_model)), 'urgent') AND date >= 820454400 AND "
    + " AND ".join([HIT.format(t="image_tags", w="", n="brand#1"), HIT.format(t="image_tags", w="", n="brand#3"), "NOT " + HIT.format(t="ai_tags", w="t.review_state <> 'rejected' AND", n="economy")]),
    "ORDER BY date DESC, lower(relative_path), id LIMIT 500",
)
_search_query("f3_equality_and_range", C.CatalogQuery(root_id=2, year=1995, is_edited=False, color="BLUE"), "root_id = 2 AND year = 1995 AND NOT is_edited AND lower(color_label) = 'blue'")
_search_query("f4_substring", C.CatalogQuery(text="AutoMobile", lens="high"), r"contains(lower(coalesce(lens, '')), 'high') AND contains(lower(concat_ws(chr(10), file_name, relative_path, title, camera_make, camera_model, lens, color_label)), 'automobile')")
_search_query("f5_folder_scope", C.CatalogQuery(folder="nation_3", recursive=True), "starts_with(relative_path, 'nation_3/')")
_search_query("f5_folder_direct", C.CatalogQuery(folder="nation_3/c1", recursive=False), "regexp_replace(relative_path, '/?[^/]*$', '') = 'nation_3/c1'")
_search_query("f6_any_tag", C.CatalogQuery(tags=["brand#11", "brand#52"], tag_mode="OR"), "(" + " OR ".join(HIT.format(t="image_tags", w="", n=n) for n in ("brand#11", "brand#52")) + ")")
_search_query("f7_exclusions", C.CatalogQuery(people=["supplier#00000000"], exclude_tags=["brand#2"], exclude_people=["brand#4"]), " AND ".join([HIT.format(t="person_images", w="", n="supplier#00000000"), "NOT " + HIT.format(t="image_tags", w="", n="brand#2"), "NOT " + HIT.format(t="person_images", w="", n="brand#4")]))


@query("f8_list_filter", BASE, f", {VIEW} SELECT id FROM view_ WHERE rating >= 3 AND NOT is_raw AND (color_label IN ('green', 'blue') OR color_label IS NULL)")
def _(images, roots, versions, metadata):
    return C.base_view(images, roots, versions, metadata).filter(dsl.list_filter(3, "not", "all", ("green", "blue", "none"))).select("id")


TAGGED = ", tagged AS (SELECT image_id AS id, list(name) AS tags FROM image_tags GROUP BY 1)"


def _tagged(images, roots, versions, metadata, image_tags):
    tags = image_tags.groupBy(F.col("image_id").alias("id")).agg(F.collect_list("name").alias("tags"))
    return C.base_view(images, roots, versions, metadata).join(tags, "id", "left")


SECONDS = "coalesce(1.0 / CAST(regexp_extract(shutter_speed, '1/([0-9]+)', 1) AS DOUBLE), 0)"
TERMS = {
    "f9_mini_language": (["iso <= 200", "lens: low", "Brand#1"], "AND", "", "coalesce(iso, 0) <= 200 AND contains(lower(concat(coalesce(lens, ''), ' ', coalesce(lens_make, ''))), 'low') AND {tag:brand#1}"),
    "f9_mini_language_or": (["rating:=5", "iso > 700"], "OR", "IMG_1", "(coalesce(rating, 0) = 5 OR coalesce(iso, 0) > 700) AND (contains(lower(file_name), 'img_1') OR {tag:img_1})"),
    "f9_no_operator": (["iso 400", "camera:HOUSEHOLD"], "AND", "", "coalesce(iso, 0) = 400 AND contains(lower(concat(coalesce(camera_make, ''), ' ', coalesce(camera_model, ''))), 'household')"),
    "f9_shutter_and_focal": (["s >= 1/90", "mm < 60", "model urgent"], "AND", "", f"{SECONDS} >= 1.0 / 90 AND coalesce(focal_length, 0) < 60 AND contains(lower(concat(coalesce(camera_make, ''), ' ', coalesce(camera_model, ''))), 'urgent')"),
    "f9_colors_and_odd_terms": (["color:Red", "lens > low", "focal 50"], "OR", "", "contains(coalesce(color_label, ''), 'red')"),
}


for _name, (_terms, _mode, _free, _where) in TERMS.items():
    _where = re.sub(r"\{tag:([^}]*)\}", r"len(list_filter(coalesce(tags, []), lambda t: contains(replace(lower(t), 'user:', ''), '\1'))) > 0", _where)
    query(_name, (*BASE, "image_tags"), f", {VIEW}{TAGGED} SELECT id FROM view_ LEFT JOIN tagged USING (id) WHERE {_where}")(lambda *v, t=_terms, m=_mode, x=_free: _tagged(*v).filter(dsl.query(t, m, x)).select("id"))


GROUPED = f""", {VIEW}, keyed AS (SELECT *, concat_ws('/', CAST(root_id AS VARCHAR), regexp_replace(relative_path, '/?[^/]*$', ''), regexp_replace(file_name, '\\.[^.]*$', '')) AS k FROM view_),
grouped AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY k) >= 2 THEN k END AS group_id FROM keyed)"""


@query("f10_group_aware_search", BASE, f"{GROUPED} SELECT id FROM grouped WHERE (group_id IN (SELECT group_id FROM grouped WHERE rating = 5 AND group_id IS NOT NULL)) OR (group_id IS NULL AND rating = 5)")
def _(*views):
    return dsl.group_aware(grouping.sibling_groups(C.base_view(*views)), F.col("rating") == 5).select("id")


@query("g1_sibling_groups", BASE, f"{GROUPED} SELECT id, group_id FROM grouped")
def _(*views):
    return grouping.sibling_groups(C.base_view(*views)).select("id", "group_id")


@query("g1_sibling_groups_same_time", BASE, f"{GROUPED} SELECT id, CASE WHEN count(*) OVER w >= 2 AND count(date_taken) OVER w = count(*) OVER w AND min(date_taken) OVER w = max(date_taken) OVER w THEN k END AS group_id FROM grouped WINDOW w AS (PARTITION BY k)")
def _(*views):
    return grouping.sibling_groups(C.base_view(*views), same_time=True).select("id", "group_id")


for _prefer, _rank in (("raw", "CASE WHEN is_raw THEN 0 ELSE 1 END"), ("jpeg", "CASE WHEN is_raw THEN 1 ELSE 0 END")):
    query(f"g2_collapse_groups_{_prefer}", BASE, f"""{GROUPED}, e AS (SELECT group_id, id, upper(regexp_extract(file_name, '\\.([^./]+)$', 1)) AS ext, row_number() OVER (PARTITION BY group_id ORDER BY {_rank}, lower(file_name), id) AS rn FROM grouped WHERE group_id IS NOT NULL)
	SELECT group_id, max(CASE WHEN rn = 1 THEN id END) AS primary_id, count(*) AS members, string_agg(DISTINCT ext, '+' ORDER BY ext) AS badge FROM e GROUP BY 1""")(lambda *v, p=_prefer: grouping.collapse(grouping.sibling_groups(C.base_view(*v)), p))


@query("g1_unedited_originals", BASE, ", all_ AS (SELECT i.id, i.root_id, i.relative_path, i.file_name, v.copy_id, v.is_edited, CASE WHEN v.copy_id = '' AND NOT v.is_edited THEN concat_ws('/', CAST(i.root_id AS VARCHAR), regexp_replace(i.relative_path, '/?[^/]*$', ''), regexp_replace(i.file_name, '\\.[^.]*$', '')) END AS k FROM images i JOIN versions v ON v.image_id = i.id) SELECT id, copy_id, CASE WHEN k IS NOT NULL AND count(*) OVER (PARTITION BY k) >= 2 THEN k END AS group_id FROM all_")
def _(images, roots, versions, metadata):
    rows = images.join(versions.withColumnRenamed("image_id", "id"), "id").withColumn("is_virtual_copy", F.col("copy_id") != "")
    return grouping.sibling_groups(rows, edited_too=False).select("id", "copy_id", "group_id")


@query("g3_expand_selection", BASE, f"{GROUPED} SELECT id FROM grouped WHERE group_id IN (SELECT group_id FROM grouped WHERE rating = 3 AND is_raw) UNION SELECT id FROM grouped WHERE rating = 3 AND is_raw")
def _(*views):
    g = grouping.sibling_groups(C.base_view(*views))
    return grouping.expand_selection(g, g.filter("rating = 3 AND is_raw"))


ORDERS = {
    "date_taken": ("coalesce(date_taken, -9223372036854775808) {d}, modified_at {d}", True), "iso": ("coalesce(iso, 0) {d}", True), "shutter_speed": (SECONDS + " {d}", False), "aperture": ("coalesce(aperture, 0) {d}", False),
    "focal_length": ("coalesce(focal_length, 0) {d}", True), "date": ("modified_at {d}", True), "rating": ("coalesce(rating, 0) {d}", False), "edited": ("CAST(is_edited AS INT) {d}", True), "name": ("lower(file_name) {d}", True),
}
for _key, (_own, _down) in ORDERS.items():
    _tie = "" if _key == "name" else "lower(file_name) ASC, "
    query(f"o2_list_sort_{_key}", BASE, f", {VIEW} SELECT id, folder_id, row_number() OVER (PARTITION BY folder_id ORDER BY {_own.format(d='DESC' if _down else 'ASC')}, {_tie}id) AS place FROM view_")(
        lambda *v, k=_key, d=_down: C.base_view(*v).withColumn("place", F.row_number().over(Window.partitionBy("folder_id").orderBy(*dsl.list_order(k, d))).cast("bigint")).select("id", "folder_id", "place")
    )


PRESENT = "(SELECT id FROM images WHERE status = 'present')"
METRICS = ("images", "versions", "ai_tags", "analysis", "cull_sessions", "cull_events")


@query("a1_q3_metrics", METRICS, f""", st AS (SELECT i.id, coalesce(bool_or(a.state = 'completed'), false) AS done, coalesce(bool_or(a.state = 'failed'), false) AS failed FROM images i LEFT JOIN analysis a ON a.image_id = i.id AND a.image_modified_at = i.modified_at AND a.analysis_kind = 'tags' WHERE i.status = 'present' GROUP BY 1)
SELECT (SELECT count(*) FROM images WHERE status = 'present') AS total, (SELECT count(*) FROM images WHERE status = 'missing') AS missing, (SELECT count(*) FROM versions WHERE copy_id = '' AND is_edited AND image_id IN {PRESENT}) AS edited, (SELECT count(*) FROM versions WHERE copy_id = '' AND rating > 0 AND image_id IN {PRESENT}) AS rated,
(SELECT count(*) FROM ai_tags WHERE review_state = 'suggested') AS tags_suggested, (SELECT count(*) FROM ai_tags WHERE review_state = 'accepted') AS tags_accepted, (SELECT count(*) FROM st WHERE done) AS analysed, (SELECT count(*) FROM st WHERE NOT done) AS pending, (SELECT count(*) FROM st WHERE failed AND NOT done) AS failed,
(SELECT count(*) FROM cull_sessions) AS sessions, (SELECT count(*) FROM cull_events) AS overrides""")
def _(*tables):
    return facets.metrics(*tables)


FACETS = {
    "cameras": ("metadata", "trim(coalesce(camera_make, '') || ' ' || coalesce(camera_model, ''))", 50, None, "", lambda m: m.withColumn("v", facets.camera())),
    "lenses": ("metadata", "lens", 50, None, "", lambda m: m.withColumn("v", F.col("lens"))),
    "years": ("metadata", "CAST(year AS VARCHAR)", None, None, "", lambda m: m.withColumn("v", F.col("year"))),
    "ratings": ("versions", "CAST(rating AS VARCHAR)", None, None, "", lambda v: v.withColumn("v", F.col("rating"))),
    "tags": ("image_tags", "name", 75, None, "AND kind <> 'person'", lambda t: t.filter("kind != 'person'").withColumn("v", F.col("name"))),
    "ai_tags": ("ai_tags", "name", 75, "image_id", "AND review_state <> 'rejected'", lambda t: t.filter("review_state != 'rejected'").withColumn("v", F.col("name"))),
}


for _name, (_table, _value, _limit, _distinct, _more, _rows) in FACETS.items():
    _n = f"count(DISTINCT {_distinct})" if _distinct else "count(*)"
    query(f"a2_facet_{_name}", ("images", _table), f"SELECT {_value} AS value, {_n} AS count FROM {_table} WHERE image_id IN {PRESENT} AND coalesce({_value}, '') <> '' {_more} GROUP BY 1" + (f" ORDER BY 2 DESC, lower(value), value LIMIT {_limit}" if _limit else ""))(
        lambda images, t, r=_rows, n=_limit, d=_distinct: facets.facet(facets.of_present(r(t), images), "v", n, d)
    )


@query("a3_facet_people", ("images", "image_tags", "faces", "people"), f", {PEOPLE} SELECT name AS value, count(DISTINCT image_id) AS count FROM person_images WHERE image_id IN {PRESENT} GROUP BY 1 ORDER BY 2 DESC, lower(value), value LIMIT 75")
def _(images, image_tags, faces, people):
    return facets.facet(facets.of_present(C.person_images(image_tags, faces, people), images), "name", 75, "image_id")


@query("a4_missing_by_root", ("roots", "images"), "SELECT r.id, r.absolute_path, count(i.id) AS images, coalesce(sum(CASE WHEN i.status = 'missing' THEN 1 ELSE 0 END), 0)::BIGINT AS missing FROM roots r LEFT JOIN images i ON i.root_id = r.id GROUP BY 1, 2")
def _(roots, images):
    n = images.groupBy(F.col("root_id").alias("id")).agg(F.count("*").alias("images"), F.count_if(F.col("status") == "missing").alias("missing"))
    return roots.join(n, "id", "left").select("id", "absolute_path", F.coalesce("images", F.lit(0)).alias("images"), F.coalesce("missing", F.lit(0)).alias("missing"))


STATE = """, s AS (SELECT i.id, i.root_id, i.relative_path, coalesce(bool_or(a.state = 'completed'), false) AS done, coalesce(bool_or(a.state = 'failed'), false) AS failed
FROM images i LEFT JOIN analysis a ON a.image_id = i.id AND a.image_modified_at = i.modified_at AND a.analysis_kind = 'tags' WHERE i.status = 'present' GROUP BY 1, 2, 3)"""


@query("q4_analysis_status", ("images", "analysis"), f"{STATE} SELECT count(*) AS images, count(*) FILTER (done) AS analysed, count(*) FILTER (NOT done) AS pending, count(*) FILTER (failed AND NOT done) AS failed FROM s")
def _(images, analysis):
    return facets.analysis_status(images, analysis, "tags")


@query("a5_a6_folder_coverage", ("images", "analysis"), f"""{STATE}, f AS (SELECT string_split(concat_ws('/', CAST(root_id AS VARCHAR), regexp_replace(relative_path, '/?[^/]*$', '')), '/') AS p, done, failed AND NOT done AS failed FROM s),
e AS (SELECT array_to_string(p[1:n], '/') AS folder, done, failed FROM (SELECT p, done, failed, unnest(range(1, len(p) + 1)) AS n FROM f))
SELECT folder, count(*) AS total, count(*) FILTER (done) AS done, count(*) FILTER (failed) AS failed, greatest(count(*) - count(*) FILTER (done) - count(*) FILTER (failed), 0) AS pending FROM e GROUP BY 1""")
def _(images, analysis):
    return facets.coverage(images, analysis, "tags")


@query("q5_root_list", ("roots", "images"), "SELECT r.id, coalesce(r.label, r.absolute_path) AS name, count(i.id) AS images FROM roots r LEFT JOIN images i ON i.root_id = r.id AND i.status = 'present' GROUP BY 1, 2")
def _(roots, images):
    n = images.filter("status = 'present'").groupBy(F.col("root_id").alias("id")).agg(F.count("*").alias("images"))
    return roots.join(n, "id", "left").select("id", F.coalesce("label", "absolute_path").alias("name"), F.coalesce("images", F.lit(0)).alias("images")).orderBy(F.lower("name"))


@query("q8_people_list", ("people", "faces"), """, best AS (SELECT person_id, max(id) AS cover FROM faces WHERE review_state = 'confirmed' AND person_id % 4 > 0 GROUP BY 1), n AS (SELECT person_id, count(*) AS confirmed FROM faces WHERE review_state = 'confirmed' GROUP BY 1)
SELECT p.id, p.display_name, p.state, coalesce(n.confirmed, 0) AS confirmed, b.cover, any_value(c.image_id) AS cover_image FROM people p LEFT JOIN n ON n.person_id = p.id LEFT JOIN best b ON b.person_id = p.id LEFT JOIN faces c ON c.id = b.cover AND c.person_id = p.id WHERE p.state = 'active' GROUP BY p.id, p.display_name, p.state, n.confirmed, b.cover""")
def _(people, faces):
    """Active people with their confirmed faces and the face that stands for them; a person without a cover is listed too."""
    confirmed = faces.filter("review_state = 'confirmed'")
    n = confirmed.groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("confirmed"))
    chosen = confirmed.filter("person_id % 4 > 0").groupBy(F.col("person_id").alias("id")).agg(F.max("id").alias("cover"))
    shown = faces.select(F.col("person_id").alias("id"), F.col("id").alias("cover"), F.col("image_id").alias("cover_image")).distinct()
    rows = people.filter("state = 'active'").join(n, "id", "left").join(chosen, "id", "left").join(shown, ["id", "cover"], "left")
    return rows.select("id", "display_name", "state", F.coalesce("confirmed", F.lit(0)).alias("confirmed"), "cover", "cover_image").orderBy(F.desc("confirmed"), F.lower("display_name"))


@query("q10_people_autocomplete", ("people", "faces"), "SELECT p.id, p.display_name, count(f.id) AS confirmed FROM people p LEFT JOIN faces f ON f.person_id = p.id AND f.review_state = 'confirmed' WHERE p.state = 'active' AND contains(lower(p.display_name), 'supplier#00000001') GROUP BY 1, 2 ORDER BY CASE WHEN lower(p.display_name) = 'supplier#00000001' THEN 0 ELSE 1 END, 3 DESC, 2 LIMIT 25")
def _(people, faces):
    found = people.filter("state = 'active'").filter(C.has(F.col("display_name"), "Supplier#00000001"))
    n = faces.filter("review_state = 'confirmed'").groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("confirmed"))
    rows = found.join(n, "id", "left").select("id", "display_name", F.coalesce("confirmed", F.lit(0)).alias("confirmed"))
    return rows.orderBy(F.when(F.lower("display_name") == "supplier#00000001", 0).otherwise(1), F.desc("confirmed"), "display_name").limit(25)


@query("q11_person_images", ("faces", "images"), "SELECT DISTINCT i.id, i.relative_path, f.confidence FROM faces f JOIN images i ON f.image_id = i.id WHERE f.person_id = 3 AND f.review_state = 'confirmed'")
def _(faces, images):
    return faces.filter("person_id = 3 AND review_state = 'confirmed'").join(images.select(F.col("id").alias("image_id"), "relative_path"), "image_id").select(F.col("image_id").alias("id"), "relative_path", "confidence").distinct()


@query("q14_distinct_unreviewed_faces", ("faces", "images"), """, p AS (SELECT f.id, f.image_id, f.confidence, row_number() OVER (PARTITION BY i.folder_id, split_part(i.file_name, '.', 1), round(f.bbox_x, 2), round(f.bbox_y, 2) ORDER BY f.confidence DESC, f.id) AS rn
FROM faces f JOIN images i ON f.image_id = i.id AND i.status = 'present' WHERE f.review_state = 'unreviewed') SELECT id, image_id, confidence FROM p WHERE rn = 1""")
def _(faces, images):
    return C.distinct_faces(faces, images).select("id", "image_id", "confidence")


@query("q15_unreviewed_clusters", ("clusters", "faces", "images", "roots"), """SELECT c.id AS cluster_id, count(m.id) AS members, c.representative_face_id AS representative, r.absolute_path || '/' || i.relative_path AS path FROM clusters c JOIN faces m ON m.cluster_id = c.id
JOIN faces f ON f.id = c.representative_face_id JOIN images i ON i.id = f.image_id JOIN roots r ON r.id = i.root_id WHERE c.state = 'unreviewed' GROUP BY 1, 3, 4 ORDER BY 2 DESC, 1""")
def _(clusters, faces, images, roots):
    """Clusters by their own state, with the path of their stored representative; one whose face is gone is not listed."""
    open_ = clusters.filter("state = 'unreviewed'").select(F.col("id").alias("cluster_id"), F.col("representative_face_id").alias("representative"))
    members = faces.groupBy("cluster_id").agg(F.count("*").alias("members"))
    shown = faces.select(F.col("id").alias("representative"), F.col("image_id")).join(open_, "representative").join(images.select(F.col("id").alias("image_id"), "root_id", "relative_path"), "image_id")
    named = shown.join(roots.select(F.col("id").alias("root_id"), "absolute_path"), "root_id").select("cluster_id", "representative", F.concat_ws("/", "absolute_path", "relative_path").alias("path"))
    return named.join(members, "cluster_id").orderBy(F.desc("members"), "cluster_id")


@query("q16_face_status", ("faces", "clusters"), "SELECT count(*) AS detected, count(embedding_id) AS embedded, count(*) FILTER (review_state = 'confirmed') AS confirmed, (SELECT count(*) FROM clusters WHERE state = 'unreviewed') AS unknown_clusters FROM faces")
def _(faces, clusters):
    counts = faces.agg(F.count("*").alias("detected"), F.count("embedding_id").alias("embedded"), F.count_if(F.col("review_state") == "confirmed").alias("confirmed"))
    return counts.join(clusters.agg(F.count_if(F.col("state") == "unreviewed").alias("unknown_clusters")))  # two single rows


SUGGESTED = "SELECT t.id, t.image_id, t.name, t.confidence FROM ai_tags t JOIN images i ON t.image_id = i.id WHERE t.review_state = 'suggested' AND i.status = 'present'"


@query("q18_suggested_tags", ("ai_tags", "images"), SUGGESTED + " ORDER BY confidence DESC, t.id LIMIT 500")
def _(ai_tags, images):
    return ai_tags.filter("review_state = 'suggested'").join(images.filter("status = 'present'").select(F.col("id").alias("image_id")), "image_id", "left_semi").select("id", "image_id", "name", "confidence").orderBy(F.desc("confidence"), "id").limit(500)


@query("q19_export_suggestions", ("ai_tags", "images"), SUGGESTED)
def _(ai_tags, images):
    return ai_tags.filter("review_state = 'suggested'").join(images.filter("status = 'present'").select(F.col("id").alias("image_id")), "image_id", "left_semi").select("id", "image_id", "name", "confidence")


@query("q20_top_tags", ("ai_tags",), "SELECT name AS value, count(DISTINCT image_id) AS count FROM ai_tags WHERE review_state <> 'rejected' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def _(ai_tags):
    return facets.facet(ai_tags.filter("review_state != 'rejected'"), "name", 50, "image_id")


@query("q21_tag_states", ("ai_tags",), "SELECT review_state, count(*) AS n FROM ai_tags GROUP BY 1")
def _(ai_tags):
    return ai_tags.groupBy("review_state").agg(F.count("*").alias("n"))


@query("q23_provenance", (*BASE, "ai_tags", "faces", "species", "analysis"), """, t AS (SELECT image_id, string_agg(name || ':' || review_state || ':' || model_id, ',' ORDER BY confidence DESC, id, name, review_state) AS t FROM ai_tags GROUP BY 1), f AS (SELECT image_id, string_agg(id || ':' || review_state, ',' ORDER BY confidence DESC, id, person_id NULLS FIRST, bbox_x, bbox_y, bbox_width, bbox_height, review_state) AS f FROM faces GROUP BY 1),
s AS (SELECT image_id, string_agg(scientific_name || ':' || review_state, ',' ORDER BY CASE review_state WHEN 'accepted' THEN 0 WHEN 'suggested' THEN 1 ELSE 2 END, confidence DESC, id, scientific_name) AS s FROM species GROUP BY 1), e AS (SELECT image_id, string_agg('failed at ' || image_modified_at, ',' ORDER BY image_modified_at) AS e FROM analysis WHERE state = 'failed' GROUP BY 1)
SELECT i.id, r.absolute_path || '/' || i.relative_path AS path, CASE WHEN camera_make IS NULL THEN camera_model WHEN camera_model IS NULL THEN camera_make ELSE camera_make || ' ' || camera_model END AS camera, m.lens, m.year, coalesce(v.rating, 0) AS rating, coalesce(t, '') AS ai_tags, coalesce(f, '') AS faces, coalesce(s, '') AS species, coalesce(e, '') AS errors
FROM images i JOIN roots r ON r.id = i.root_id LEFT JOIN metadata m ON m.image_id = i.id LEFT JOIN versions v ON v.image_id = i.id AND v.copy_id = '' LEFT JOIN t ON t.image_id = i.id LEFT JOIN f ON f.image_id = i.id LEFT JOIN s ON s.image_id = i.id LEFT JOIN e ON e.image_id = i.id""")
def _(images, roots, versions, metadata, ai_tags, faces, species, analysis):
    errors = analysis.filter("state = 'failed'").select("image_id", F.concat(F.lit("failed at "), F.col("image_modified_at").cast("string")).alias("message"))
    joined = lambda c, *fields: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[x[f] for f in fields])), ",").alias(c)
    rows = C.provenance(images, roots, versions, metadata, ai_tags, faces, species, errors)
    return rows.select("id", "path", "camera", "lens", "year", "rating", joined("ai_tags", "name", "review_state", "model_id"), joined("faces", "id", "review_state"), joined("species", "scientific_name", "review_state"), F.array_join("errors", ",").alias("errors"))


@query("j4_q30_pending", ("images", "analysis"), "SELECT id FROM images i WHERE status = 'present' AND NOT EXISTS (SELECT 1 FROM analysis a WHERE a.image_id = i.id AND a.image_modified_at = i.modified_at AND a.state = 'completed' AND a.analysis_kind = 'tags')")
def _(images, analysis):
    return C.pending(images, analysis, "tags").select("id")


@query("q32_face_scan_candidates", ("images", "analysis", "faces"), """, done AS (SELECT image_id FROM analysis WHERE state = 'completed' UNION SELECT image_id FROM faces WHERE image_id % 3 > 0), left_ AS (SELECT *, lower(regexp_replace(file_name, '\\.[^.]*$', '')) AS stem FROM images WHERE status = 'present' AND id NOT IN (SELECT image_id FROM done)),
p AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY folder_id, stem) AS n FROM left_ WINDOW w AS (PARTITION BY folder_id, stem ORDER BY CASE WHEN lower(file_name) LIKE '%.jpg' OR lower(file_name) LIKE '%.jpeg' THEN 0 ELSE 1 END, is_raw, id)) SELECT id, n - 1 AS companions FROM p WHERE rn = 1""")
def _(images, analysis, faces):
    """Faces of two thirds of the images only, as nearly every image of the test tables has some."""
    return C.face_scan_candidates(images.filter("status = 'present'"), analysis.filter("state = 'completed'"), faces.filter("image_id % 3 > 0")).select("id", F.size("companions").cast("bigint").alias("companions"))


@query("j6_companion_faces", ("faces", "images"), """, p AS (SELECT f.id, f.image_id, f.bbox_x, f.bbox_y, i.folder_id, split_part(i.file_name, '.', 1) AS stem FROM faces f JOIN images i ON f.image_id = i.id)
SELECT a.id AS face_id, b.id AS companion_id FROM p a JOIN p b ON a.folder_id = b.folder_id AND a.stem = b.stem AND a.image_id <> b.image_id AND abs(a.bbox_x - b.bbox_x) < 0.05 AND abs(a.bbox_y - b.bbox_y) < 0.05""")
def _(faces, images):
    return C.companions(faces, images)


@query("f17_prefix_resolution", ("images", "roots"), "SELECT '/' || CASE root_id WHEN 0 THEN 'africa' WHEN 1 THEN 'america' WHEN 2 THEN 'asia' WHEN 3 THEN 'europe' ELSE 'nowhere' END || '/' || relative_path AS path, root_id, relative_path AS relative FROM images WHERE root_id < 4")
def _(images, roots):
    names = F.when(F.col("root_id") == 0, "africa").when(F.col("root_id") == 1, "america").when(F.col("root_id") == 2, "asia").when(F.col("root_id") == 3, "europe").otherwise("nowhere")
    paths = images.select(F.concat(F.lit("/"), names, F.lit("/"), "relative_path").alias("path"), "id")
    return C.resolve_roots(paths.select("path").distinct(), roots).join(paths, "path").select("path", "root_id", "relative")


@query("u2_processed_ids", ("analysis", "faces"), "SELECT image_id FROM analysis WHERE state = 'completed' UNION SELECT image_id FROM faces")
def _(analysis, faces):
    return analysis.filter("state = 'completed'").select("image_id").union(faces.select("image_id")).distinct()


@query("x1_tag_kinds", ("image_tags",), "SELECT DISTINCT kind || ':' || name AS tag, name, kind FROM image_tags UNION SELECT DISTINCT name, name, 'ai' FROM image_tags")
def _(image_tags):
    tags = image_tags.select(F.concat_ws(":", "kind", "name").alias("tag")).union(image_tags.select("name")).distinct()
    return tags.select("tag", parse.tag_kind(F.col("tag")).alias("k")).select("tag", "k.name", "k.kind")


@query("x2_dates", ("orders",), "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN -1 ELSE CAST(floor(epoch(o_orderdate)) AS BIGINT) END AS taken FROM orders")
def _(orders):
    form = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.lit("unknown"))
    return orders.select("o_orderkey", F.coalesce(parse.parse_date(form), F.lit(-1)).alias("taken"))


@query("x3_x4_batch_rename", ("images",), """SELECT id, regexp_replace(file_name, '\\.[^.]*$', '') || '_' || lpad(CAST(row_number() OVER (PARTITION BY folder_id ORDER BY modified_at, id) AS VARCHAR), CAST(length(CAST(count(*) OVER (PARTITION BY folder_id) AS VARCHAR)) AS INT), '0') || '_' || strftime(to_timestamp(modified_at) AT TIME ZONE 'UTC', '%Y-%m') AS name FROM images""")
def _(images):
    w = Window.partitionBy("folder_id")
    seq = F.row_number().over(w.orderBy("modified_at", "id"))
    return images.select("id", "file_name", seq.alias("n"), F.count("*").over(w).alias("t"), F.timestamp_seconds("modified_at").alias("ts")).select("id", parse.file_name_from_template("{original_filename}_{sequence}_{YYYY}-{MM}", F.col("file_name"), F.col("n"), F.col("t"), F.col("ts")).alias("name"))


@query("n1_job_states", ("job_log",), " SELECT job_id, arg_max(state, seq) AS state, min(\"at\") AS created_at, max(\"at\") AS updated_at, count(*) AS events FROM job_log GROUP BY 1")
def _(job_log):
    return jobs.job_states(job_log).drop("completed_at")


@query("n5_latest_wins", ("job_log",), "SELECT job_id, state, arg_max(seq, seq) AS seq, arg_max(value, seq) AS value FROM job_log GROUP BY 1, 2")
def _(job_log):
    return grouping.latest(job_log.select("job_id", "state", "seq", "value"), "job_id", "state").select("job_id", "state", "seq", "value")


@query("q25_job_list", ("job_log",), "SELECT job_id, arg_max(state, seq) AS state, max(\"at\") AS updated_at FROM job_log GROUP BY 1 ORDER BY CASE WHEN arg_max(state, seq) IN ('running', 'paused', 'cancelling') THEN 0 ELSE 1 END, 3 DESC, 1 LIMIT 100")
def _(job_log):
    return jobs.job_list(jobs.job_states(job_log)).select("job_id", "state", "updated_at")


@query("s6_sidecars", ("events",), """SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 6 ELSE 0 END AS rating, CASE WHEN event_id % 4 < 2 THEN 2 ELSE 0 END AS tags, event_id % 4 = 3 AS broken, CASE WHEN event_id % 4 = 0 THEN value ELSE 0 END AS exposure FROM events""")
def _(events):
    rating = F.from_json("props", "k BIGINT")["k"] % 6
    plain = F.concat(F.lit('{"version": 1, "rating": '), rating.cast("string"))
    kinds = F.when(F.col("event_id") % 4 == 0, F.concat(plain, F.lit(', "tags": ["user:a", "b"], "adjustments": {"exposure": '), F.col("value").cast("string"), F.lit("}}"))).when(F.col("event_id") % 4 == 1, F.concat(plain, F.lit(', "tags": ["user:a", "b"], "adjustments": {}}')))
    text = kinds.when(F.col("event_id") % 4 == 2, F.concat(plain, F.lit("}"))).otherwise(F.lit("{broken"))
    rows = files.parse_sidecars(events.select(F.col("event_id").cast("string").alias("path"), text.alias("text")))
    return rows.select(F.col("path").cast("bigint").alias("event_id"), F.col("rating").cast("bigint").alias("rating"), F.size("tags").alias("tags"), "broken", files.adjustment("adjustments", "exposure").alias("exposure"))


DOT = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"


@query("j7_cosine_pairs", ("embeddings",), f"SELECT a.vec_id AS src, b.vec_id AS dst, {DOT} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35")
def _(embeddings):
    return similarity.similar_pairs(embeddings, embeddings, "vec_id", "embedding", 0.35, True).select("src", "dst", F.round("similarity", 6).alias("similarity"))


@query("g7_components", ("embeddings",))
def _(embeddings):
    edges = similarity.similar_pairs(embeddings, embeddings, "vec_id", "embedding", 0.38, True)
    return components.components_with_singletons(embeddings.select(F.col("vec_id").alias("node")), edges, 2)


ORACLES["g7_components"] = """WITH RECURSIVE e AS (SELECT a.vec_id AS s, b.vec_id AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.38),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT e.d, r.root FROM r JOIN e ON e.s = r.node),
c AS (SELECT node, min(root) AS component FROM r GROUP BY 1) SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM c QUALIFY size >= 2"""


@query("g8_medoids", ("embeddings",))
def _(embeddings):
    edges = similarity.connecting_pairs(embeddings, "vec_id", "embedding", 0.38)
    members = components.components_with_singletons(embeddings.select(F.col("vec_id").alias("node")), edges, 2)
    return components.medoids(members, embeddings.select(F.col("vec_id").alias("node"), F.col("embedding").alias("v"))).withColumn("mean_similarity", F.round("mean_similarity", 6))


ORACLES["g8_medoids"] = ORACLES["g7_components"].replace(" SELECT node, component, count(*) OVER", ", g AS (SELECT node, component, count(*) OVER").rstrip() + f""")
SELECT component, medoid, mean_similarity FROM (SELECT g.component, g.node AS medoid, round(avg(CASE WHEN g.node = h.node THEN 1.0 ELSE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END), 6) AS mean_similarity,
row_number() OVER (PARTITION BY g.component ORDER BY round(avg(CASE WHEN g.node = h.node THEN 1.0 ELSE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END), 9) DESC, g.node) AS rn
FROM g JOIN g h ON g.component = h.component JOIN embeddings a ON a.vec_id = g.node JOIN embeddings b ON b.vec_id = h.node GROUP BY 1, 2) WHERE rn = 1"""


@query("j8_best_exemplar", ("embeddings",), f"""SELECT id, arg_max(label, similarity) AS person, max(similarity) AS similarity FROM (SELECT a.vec_id AS id, b.label, max({DOT}) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 1 AND b.vec_id % 2 = 0
WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3 GROUP BY 1, 2) GROUP BY 1""")
def _(embeddings):
    named = embeddings.select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("person"))
    return similarity.best_exemplar(named.filter("id % 2 = 1"), named.filter("id % 2 = 0"), 0.3)


@query("j10_g15_nearest_label", ("embeddings",))
def _(embeddings):
    labels = embeddings.filter("vec_id % 25 = 0").select(F.concat(F.lit("t"), "vec_id").alias("label"), "embedding")
    return similarity.confident_label(similarity.nearest_labels(embeddings.filter("vec_id % 25 != 0").select(F.col("vec_id").alias("id"), "embedding"), labels), 0.2, 0.04)


ORACLES["j10_g15_nearest_label"] = f"""WITH s AS (SELECT a.vec_id AS id, 't' || b.vec_id AS label, {DOT} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 25 <> 0 AND b.vec_id % 25 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, label) AS rn FROM s)
SELECT a.id, a.label, a.similarity, coalesce(round(a.similarity - b.similarity, 6) < 0.04, false) AS is_ambiguous FROM k a LEFT JOIN k b ON a.id = b.id AND b.rn = 2 WHERE a.rn = 1 AND a.similarity >= 0.2"""


@query("g5_ordered_near_duplicates", ("embeddings",))
def _(embeddings):
    rows = embeddings.select(F.col("label").cast("string").alias("scope"), F.col("vec_id").alias("id"), F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("path"), F.array(similarity.sign_hash(F.col("embedding"))).alias("words"), F.element_at("embedding", 1).cast("double").alias("quality"))
    return grouping.ordered_near_duplicates(rows, 22)


PIXELS = "SELECT l_orderkey % 20 AS id, l_orderkey AS y, l_linenumber AS x, CAST(l_quantity * 5 AS INT) AS r, CAST(l_discount * 2000 AS INT) AS g, CAST(l_tax * 3000 AS INT) AS b FROM lineitem"


def _pixels(lineitem):
    return lineitem.selectExpr("l_orderkey % 20 AS id", "l_orderkey AS y", "l_linenumber AS x", "CAST(l_quantity * 5 AS INT) AS r", "CAST(l_discount * 2000 AS INT) AS g", "CAST(l_tax * 3000 AS INT) AS b")


def _flat(lineitem):
    """Pixels as an image of rows of seven, numbered from 0."""
    return _pixels(lineitem).withColumn("x", F.col("x") - 1)


HIST = f""", p AS ({PIXELS}), h AS (SELECT id, channel, bin, count(*) AS n FROM (SELECT id, unnest(['r', 'g', 'b', 'luma']) AS channel, unnest([r, g, b, (218 * r + 732 * g + 74 * b) >> 10]) AS bin FROM p WHERE (y * 7 + x - 1) % 2 = 0) GROUP BY 1, 2, 3)"""


@query("a11_histogram", ("lineitem",), f"{HIST} SELECT id, channel, bin, n FROM h WHERE n > 0")
def _(lineitem):
    return raster.histogram(_flat(lineitem), 7).filter("n > 0").select("id", "channel", "bin", "n")


@query("a11_histogram_shown", ("lineitem",), f"""{HIST}, e AS (SELECT id, channel, bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT id FROM p) CROSS JOIN (SELECT unnest(['r', 'g', 'b', 'luma']) AS channel) CROSS JOIN (SELECT unnest(range(256)) AS bin) LEFT JOIN h USING (id, channel, bin)),
t AS (SELECT k, exp(-k * k / 8.0) / sum(exp(-k * k / 8.0)) OVER () AS w FROM (SELECT unnest(range(-6, 7)) AS k)), s AS (SELECT a.id, a.channel, a.bin, sum(t.w * b.n) AS s FROM e a CROSS JOIN t JOIN e b ON b.id = a.id AND b.channel = a.channel AND b.bin = greatest(0, least(255, a.bin + t.k)) GROUP BY 1, 2, 3),
m AS (SELECT id, channel, list(s ORDER BY s)[253] AS top FROM s GROUP BY 1, 2) SELECT id, channel, bin, round(CASE WHEN top > 0.000001 THEN least(1, s / top) ELSE 0 END, 6) AS v FROM s JOIN m USING (id, channel)""")
def _(lineitem):
    return raster.scaled(raster.smoothed(raster.histogram(_flat(lineitem), 7))).select("id", "channel", F.col("bin").cast("bigint").alias("bin"), F.round("v", 6).alias("v"))


@query("a13_percentiles", ("lineitem",), f"{HIST}, c AS (SELECT id, channel, bin, sum(n) OVER (PARTITION BY id, channel ORDER BY bin) AS c, sum(n) OVER (PARTITION BY id, channel) AS t FROM h) SELECT id, channel, min(CASE WHEN c >= 0.01 * t THEN bin END) AS p1, min(CASE WHEN c >= 0.5 * t THEN bin END) AS p50, min(CASE WHEN c >= 0.99 * t THEN bin END) AS p99 FROM c GROUP BY 1, 2")
def _(lineitem):
    return raster.percentile_bins(raster.histogram(_flat(lineitem), 7), 0.01, 0.5, 0.99)


@query("a12_waveform", ("lineitem",), f", p AS ({PIXELS}) SELECT id, CAST(floor(x * 256 / 8) AS INT) AS \"column\", (218 * r + 732 * g + 74 * b) >> 10 AS level, count(*) AS n FROM p GROUP BY 1, 2, 3")
def _(lineitem):
    return raster.waveform(_pixels(lineitem), 8)


@query("a14_dominant_colors", ("lineitem",), f""", p AS ({PIXELS}), q AS (SELECT id, r, g, b, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS d FROM p),
c AS (SELECT id, CASE WHEN hi = 0 THEN 0 ELSE CAST(d AS DOUBLE) / hi END AS s, hi / 255.0 AS v, CASE WHEN d = 0 THEN 0 WHEN hi = r THEN (CASE WHEN g < b THEN 360 ELSE 0 END) + 60.0 * (g - b) / d WHEN hi = g THEN 120 + 60.0 * (b - r) / d ELSE 240 + 60.0 * (r - g) / d END AS h FROM q),
n AS (SELECT id, CASE WHEN v < 0.2 THEN 'black' WHEN s < 0.1 AND v > 0.8 THEN 'white' WHEN s < 0.1 THEN 'gray' WHEN (h < 45 OR h >= 340) AND v < 0.6 AND s < 0.7 THEN 'brown' WHEN h < 20 OR h >= 340 THEN 'red' WHEN h < 45 THEN 'orange' WHEN h < 70 THEN 'yellow' WHEN h < 160 THEN 'green' WHEN h < 260 THEN 'blue' ELSE 'purple' END AS color FROM c),
k AS (SELECT id, color, count(*) AS n, color IN ('black', 'white', 'gray') AS plain FROM n GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY plain, n DESC, color) AS rn, bool_and(plain) OVER (PARTITION BY id) AS drab FROM k)
SELECT id, color, n FROM o WHERE (NOT plain AND rn <= 2) OR (drab AND rn = 1)""")
def _(lineitem):
    return raster.dominant_colors(_pixels(lineitem))


_UNIT = "least(log10({x} + 1) / 3.5, 1)"


@query("g16_quality_score", ("lineitem",), f"""SELECT l_orderkey * 10 + l_linenumber AS id, round(CASE WHEN l_linenumber % 2 = 0 THEN 0.38 * {_UNIT.format(x='l_quantity')} + 0.32 * {_UNIT.format(x='l_extendedprice')} + 0.22 * greatest(0, 1 - 5 * l_tax - 5 * l_discount) + 0.08 * l_discount
ELSE (0.38 * {_UNIT.format(x='l_quantity')} + 0.32 * {_UNIT.format(x='l_extendedprice')} + 0.22 * greatest(0, 1 - 5 * l_tax - 5 * l_discount)) / 0.92 END, 6) AS quality FROM lineitem""")
def _(lineitem):
    composition = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount"))
    return lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.round(scoring.quality(F.col("l_quantity"), F.col("l_extendedprice"), scoring.exposure_score(F.col("l_tax"), F.col("l_discount")), composition), 6).alias("quality"))


@query("g21_q29_preference_ranker", ("cull_events", "cull_decisions"))
def _(cull_events, cull_decisions):
    return scoring.fit_ranker(scoring.ranker_examples(cull_events, cull_decisions)).withColumns({"bias": F.round("bias", 6), "weight": F.round("weight", 6)})


POSE = """, z AS (SELECT id, person_id, review_state, confidence, bbox_width, bbox_height, sharpness, sqrt((left_eye_x - right_eye_x) * (left_eye_x - right_eye_x) + (left_eye_y - right_eye_y) * (left_eye_y - right_eye_y)) AS apart, nose_x - (left_eye_x + right_eye_x) / 2 AS off, left_eye_y - right_eye_y AS dy, left_eye_x - right_eye_x AS dx FROM faces),
w AS (SELECT *, CASE WHEN apart > 0.00000011920929 THEN greatest(0, 1 - 1.35 * least(abs(off) / apart, 1)) END AS frontal, CASE WHEN apart > 0.00000011920929 THEN abs(degrees(atan2(dy, dx))) END AS roll FROM z),
scored AS (SELECT id, person_id, review_state, confidence, frontal, round(0.48 * coalesce(frontal, 0.12) + 0.14 * least(1, greatest(0, 1 - coalesce(roll, 45) / 35)) + 0.18 * coalesce(sharpness, 0.15) + 0.12 * least(1, greatest(0, sqrt(bbox_width * bbox_height) / 0.2)) + 0.08 * least(1, greatest(0, confidence)), 6) AS score FROM w)"""
MANUAL = "(SELECT person_id, max(id) AS face_id FROM faces WHERE person_id % 3 = 0 AND (review_state = 'confirmed' OR person_id % 2 = 0) GROUP BY 1)"


def _scored(faces):
    c = F.col
    pose = scoring.pose((c("right_eye_x"), c("right_eye_y")), (c("left_eye_x"), c("left_eye_y")), c("nose_x"))
    return faces.withColumn("pose", pose).select("id", "person_id", "review_state", "confidence", c("pose.frontal").alias("frontal"), F.round(scoring.cover_score(c("pose.frontal"), c("pose.roll"), c("sharpness"), c("bbox_width"), c("bbox_height"), c("confidence")), 6).alias("score"))


@query("g23_cover_choice", ("faces",), f"""{POSE}, best AS (SELECT person_id, arg_min(id, (-score, id)) AS face_id FROM scored WHERE review_state = 'confirmed' GROUP BY 1), manual AS (SELECT m.person_id, m.face_id FROM {MANUAL} m WHERE EXISTS (SELECT 1 FROM faces f WHERE f.id = m.face_id AND f.person_id = m.person_id AND f.review_state = 'confirmed'))
SELECT person_id, coalesce(m.face_id, b.face_id) AS face_id FROM best b LEFT JOIN manual m USING (person_id)""")
def _(faces):
    manual = faces.filter("person_id % 3 = 0 AND (review_state = 'confirmed' OR person_id % 2 = 0)").groupBy("person_id").agg(F.max("id").alias("face_id"))
    return scoring.covers(_scored(faces), manual)


from prismata.plans import kernels, mechanisms, more, pixels, workflow  # noqa: E402, F401  (register further queries)
