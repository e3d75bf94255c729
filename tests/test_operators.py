"""Behaviour that the test tables cannot show: nulls, ties, order dependence, parsing."""

import numpy as np
from pyspark.sql import functions as F

from prismata.functions import parse
from prismata.operators import catalog as C
from prismata.operators import dsl, grouping, raster, review, scoring, similarity
from prismata.operators.components import connected_components, medoids
from prismata.sources import files


def got(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_parse_number_and_dates(spark):
    df = spark.createDataFrame([("f/2.8",), ("50 mm",), ("1/250 s",), ("3/0",), ("100",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(parse.parse_number(F.col("t"))).collect()] == [2.8, 50.0, 0.004, None, 100.0, None, None]
    d = spark.createDataFrame([("2024:01:02 03:04:05",), ("2024-01-02T03:04:05.25",), ("2024/01/02",), (None,)], "t string")
    assert [r[0] for r in d.select(parse.parse_date(F.col("t"))).collect()] == [1704164645, 1704164645, None, None]


def test_paths_and_tags(spark):
    df = spark.createDataFrame([("/a/b.jpg?vc=v1", "user: Bird"), ("/a/b.jpg", "bird")], "p string, t string")
    rows = df.select(parse.virtual_path(F.col("p")).alias("v"), parse.tag_kind(F.col("t")).alias("k")).collect()
    assert [tuple(r.v) for r in rows] == [("/a/b.jpg", "v1"), ("/a/b.jpg", "")]
    assert [tuple(r.k) for r in rows] == [("Bird", "user"), ("bird", "ai")]


def test_mini_language_treats_missing_numbers_as_zero(spark):
    df = spark.createDataFrame([(1, None, ["Bird"], "a.jpg"), (2, 400, None, "b.jpg")], "id int, iso int, tags array<string>, file_name string")
    assert [r.id for r in df.filter(dsl.query(["iso<=100"])).collect()] == [1]
    assert [r.id for r in df.filter(dsl.query(["bird", "iso > 300"], "OR")).orderBy("id").collect()] == [1, 2]
    assert df.filter(dsl.query(["iso = x"])).count() == 0
    assert dsl.number("x2") is None and dsl.number("2.8mm") == 2.8
    assert dsl.seconds("1/250s") == 0.004 and dsl.seconds("1/0") == 0 and dsl.seconds("0.5 s") == 0.5 and dsl.seconds("x") == 0


def test_list_order_breaks_ties_by_rising_name(spark):
    df = spark.createDataFrame([(1, 5, "b"), (2, 5, "A"), (3, 1, "c")], "id int, rating int, file_name string")
    assert [r.id for r in df.orderBy(*dsl.list_order("rating", True)).collect()] == [2, 1, 3]
    assert [r.id for r in df.orderBy(*dsl.list_order("name", True)).collect()] == [3, 1, 2]


def test_search_text_is_literal(spark):
    df = spark.createDataFrame([("100%_x",), ("100 x",), (None,)], "t string")
    assert df.filter(C.has(F.col("t"), "%_X")).count() == 1


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "src long, dst long")
    parts = dict(connected_components(e).collect())
    assert parts == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert connected_components(e.filter("false")).count() == 0
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "node long, component long")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0])], "node long, v array<double>")
    assert [(r.component, r.medoid, round(r.mean_similarity, 6)) for r in medoids(members, vectors).collect()] == [(1, 2, 0.8)]


def test_near_duplicate_grouping_depends_on_order(spark):
    rows = lambda a, b, c: spark.createDataFrame([("s", 1, a, [0b0000], 0.1), ("s", 2, b, [0b0011], 0.9), ("s", 3, c, [0b1111], 0.5)], "scope string, id long, path string, words array<long>, quality double")
    chain = grouping.ordered_near_duplicates(rows("a", "b", "c"), 2)
    assert got(chain.select("id", "group_root", "representative"), "id") == [(1, 1, 2), (2, 1, 2), (3, 1, 2)]
    # 3 comes before 2, which only reaches what comes after it
    broken = grouping.ordered_near_duplicates(rows("a", "c", "b"), 2)
    assert got(broken.select("id"), "id") == [(1,), (2,)]


def test_similar_pairs_against_numpy(spark):
    v = np.random.default_rng(1).normal(size=(50, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    old, similarity.BLOCK = similarity.BLOCK, 16
    try:
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None), (98, [1.0])], "id long, e array<double>")
        ours = {(r.src, r.dst) for r in similarity.similar_pairs(df.filter("id < 98 OR id = 99"), df, "id", "e", 0.5, True).collect()}
    finally:
        similarity.BLOCK = old
    s = v @ v.T
    assert ours == {(i, j) for i in range(50) for j in range(i + 1, 50) if s[i, j] >= 0.5}


def test_ranker(spark):
    few = spark.createDataFrame([(i, 0.5, 1) for i in range(10)], "seq long, quality double, keep int")
    assert scoring.fit_ranker(few).count() == 0
    many = spark.createDataFrame([(i, 0.9 if i % 2 else 0.1, i % 2) for i in range(200)], "seq long, quality double, keep int")
    m = scoring.fit_ranker(many).first()
    assert m.examples == 200 and m.weight > 0
    b, w = 0.0, 1.0
    for _ in range(80):
        for i in range(199, -1, -1):
            x = 0.9 if i % 2 else 0.1
            e = i % 2 - 1 / (1 + np.exp(-(b + w * x)))
            b, w = b + 0.08 * e, w + 0.08 * (e * x - 0.01 * w)
    assert abs(m.bias - b) < 1e-9 and abs(m.weight - w) < 1e-9
    events = spark.createDataFrame([(i, i % 50, "keep" if i % 3 else "reject", "user" if i % 2 else "system") for i in range(9000)], "id long, decision_id long, next_status string, source string")
    decisions = spark.createDataFrame([(i, i / 50) for i in range(50)], "id long, quality_score double")
    rows = scoring.ranker_examples(events, decisions).collect()
    assert len(rows) == 4500 and max(r.seq for r in rows) == 8999 and all(r.keep == (r.seq % 3 > 0) for r in rows)
    scored = {r.quality: r.personal for r in scoring.rank(many.select("quality").distinct(), scoring.fit_ranker(many)).collect()}
    assert scored[0.9] > 0.5 > scored[0.1]


def test_raster(spark):
    px = [(1, x, y, 200, 200, 200) for x in range(4) for y in range(4)] + [(2, x, y, 255 * (x % 2), 0, 0) for x in range(4) for y in range(4)]
    df = spark.createDataFrame(px, "id int, x int, y int, r int, g int, b int")
    hist = raster.histogram(df, 4)
    assert hist.count() == 2 * 4 * 256 and hist.filter("id = 1 AND channel = 'luma' AND n > 0").select("bin", "n").collect()[0] == (200, 8)
    assert got(raster.laplacian_variance(df), "id")[0] == (1, 0.0)
    assert got(raster.dominant_colors(df).select("id", "color"), "id") == [(1, "gray"), (2, "red")]
    s = raster.smoothed(hist).filter("id = 1 AND channel = 'r'").agg(F.sum("s")).first()[0]
    assert abs(s - 8) < 1e-6


def test_review_log(spark):
    items = spark.createDataFrame([(1, "suggested"), (2, "accepted"), (3, "suggested")], "id long, review_state string")
    log = spark.createDataFrame([(1, 1, "accepted", True), (2, 2, "rejected", True), (3, 3, "rejected", False), (4, 3, "accepted", False)], "seq long, id long, decision string, batch boolean")
    assert got(review.reviewed(items, log), "id") == [(1, "accepted"), (2, "accepted"), (3, "accepted")]
    people = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3)], "id long, merged_into long")
    assert got(review.merged_people(people), "id") == [(1, 1), (2, 1), (3, 1), (4, 1)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.ARW").write_bytes(b"x")
    (tmp_path / ".b.jpg").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"x")
    assert [(r.file_name, r.size, r.is_raw) for r in files.scan_directory(spark, str(tmp_path)).collect()] == [("a.ARW", 1, True)]
    text = spark.createDataFrame([("p", '{"version":1,"rating":3,"adjustments":{"exposure":150},"tags":["a"]}'), ("q", "{broken"), ("r", None)], "path string, text string")
    rows = {r.path: r for r in files.parse_sidecars(text).select("path", "rating", "broken", files.adjustment("adjustments", "exposure", scale=100.0).alias("e")).collect()}
    assert (rows["p"].rating, rows["p"].e, rows["q"].broken, rows["r"].broken) == (3, 1.5, True, False)
    packet = spark.range(1).select(files.parse_xmp(files.xmp_packet(F.lit(4), F.lit("Red"), F.array(F.lit("x"), F.lit("y")))).alias("x")).first().x
    assert (packet.rating, packet.label, packet.tags) == (4, "Red", ["x", "y"])
    entries = spark.createDataFrame([("m", 10.0, 0.0, 0.0, 1.0), ("m", 20.0, 1.0, 0.0, 3.0)], "model string, focal double, a double, b double, c double")
    wanted = spark.createDataFrame([(1, "m", 15.0), (2, "m", 5.0), (3, "m", 99.0)], "id long, model string, focal double")
    assert got(files.interpolate_lens(wanted, entries), "id") == [(1, 0.5, 0.0, 2.0), (2, 0.0, 0.0, 1.0), (3, 1.0, 0.0, 3.0)]


def test_upsert_and_missing(spark):
    old = spark.createDataFrame([(1, "a", "present"), (2, "b", "present")], "id long, v string, status string")
    new = spark.createDataFrame([(2, "B", None), (3, "c", "present")], "id long, v string, status string")
    assert got(files.upsert(old, new, "id"), "id") == [(1, "a", "present"), (2, "B", "present"), (3, "c", "present")]
    assert got(files.mark_missing(old, new, F.lit(True), "id"), "id") == [(1, "a", "missing"), (2, "b", "present")]


def test_incremental_run(spark, tmp_path):
    from prismata.streaming.jobs import run_incrementally

    src, sink, ck = (str(tmp_path / x) for x in ("src", "sink", "ck"))
    step = lambda df: df.withColumn("error", F.lit(None).cast("string"))
    for part in ([(1,), (2,)], [(3,)]):
        spark.createDataFrame(part, "id long").coalesce(1).write.mode("append").parquet(src)
        run_incrementally(spark, src, "id long", sink, ck, step)
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == [1, 2, 3]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_thresholds_from_both_sides(spark):
    """Fixed values, each looked at on both sides."""
    v = lambda x: F.lit(x).cast("double")
    states = one(spark, *[scoring.eye_state(v(x)).alias(f"s{i}") for i, x in enumerate((0.7, 0.69999, 0.3, 0.29999, None))])
    assert tuple(states) == ("open", "semi-closed", "semi-closed", "closed", None)
    change = lambda f, e: one(spark, scoring.subject_adjustment(v(f), F.lit(e).cast("string")).alias("x")).x
    assert [round(change(f, e), 6) for f, e in ((1.0, "open"), (0.0, None), (0.75, "open"), (None, "closed"), (0.0, "closed"), (None, None), (0.5, "semi-closed"))] == [0.04, -0.04, 0.02, -0.15, -0.19, 0.0, -0.05]
    pose = lambda r, l, n: one(spark, scoring.pose((v(r[0]), v(r[1])), (v(l[0]), v(l[1])), v(n)).alias("p")).p
    assert tuple(pose((0, 0), (10, 0), 5)) == (1.0, 0.0) and pose((1, 1), (1, 1), 1) is None
    turned = pose((0, 0), (3, -4), 2.5)
    assert round(turned.frontal, 6) == 0.73 and round(turned.roll, 6) == 53.130102
    assert pose((0, 0), (10, 0), 99).frontal == 0.0
    cover = lambda *x: round(one(spark, scoring.cover_score(*map(v, x)).alias("c")).c, 6)
    assert cover(1, 0, 1, 0.2, 0.2, 1) == 1.0 and cover(1, 35, 1, 0.2, 0.2, 1) == 0.86 and cover(1, 17.5, 1, 0.1, 0.1, 1) == round(0.48 + 0.07 + 0.18 + 0.06 + 0.08, 6)
    assert cover(None, None, None, 0, 0, 0) == round(0.12 * 0.48 + 0.15 * 0.18, 6)
    quality = lambda s, f, e, c: round(one(spark, scoring.quality(v(s), v(f), v(e), v(c)).alias("q")).q, 6)
    assert quality(10**3.5 - 1, 10**3.5 - 1, 1, 1) == 1.0 and quality(10**1.75 - 1, 0, 0, None) == round(0.19 / 0.92, 6)
    iso = lambda x: tuple(one(spark, parse.demosaic_for_iso(F.lit(x).cast("int")).alias("m"), F.round(parse.denoise_for_iso(F.lit(x).cast("int")), 6).alias("s")))
    assert [iso(x)[0] for x in (799, 800, 1599, 1600, None)] == ["amaze", "igv", "igv", "lmmse", None]
    assert [iso(x)[1] for x in (50, 100, 3250, 6400, 12800)] == [0.0, 0.0, 0.5, 1.0, 1.0]


def test_color_names_from_both_sides(spark):
    name = lambda r, g, b: one(spark, raster.hue_name(F.lit(r), F.lit(g), F.lit(b)).alias("n")).n
    assert name(50, 50, 50) == "black" and name(51, 51, 51) == "gray" and name(204, 204, 204) == "gray" and name(205, 205, 205) == "white"
    assert name(255, 84, 0) == "red" and name(255, 86, 0) == "orange" and name(255, 190, 0) == "orange" and name(255, 192, 0) == "yellow"
    assert name(214, 255, 0) == "yellow" and name(212, 255, 0) == "green" and name(0, 255, 169) == "green" and name(0, 255, 171) == "blue"
    assert name(84, 0, 255) == "blue" and name(86, 0, 255) == "purple" and name(255, 0, 86) == "purple" and name(255, 0, 84) == "red"
    assert name(150, 60, 60) == "brown" and name(153, 61, 61) == "red" and name(150, 44, 44) == "red" and name(0, 150, 60) == "green"


def test_tags_strictly_over_their_threshold(spark):
    logits = spark.createDataFrame([(1, [0.0, 40.0, -40.0])], "id long, logits array<double>")
    labels = spark.createDataFrame([(0, "a", 0.5), (1, "b", 0.99), (2, "c", 0.0)], "pos int, tag string, threshold double")
    assert [(r.tag, r.score) for r in similarity.sigmoid_tags(logits, labels).collect()] == [("b", 1.0), ("c", 0.0)]
    parents = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    tags = spark.createDataFrame([(1, "a", 0.9)], "id long, tag string, score double")
    assert got(similarity.with_parents(tags, parents), "tag") == [(1, "a", 0.9), (1, "b", 0.0)]  # not c, the parent's parent


def test_near_duplicate_grouping_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(1 << 62), 1 << 62, 6)
    rows = []
    for i in range(90):
        h = int(base[i % 6])
        for bit in rng.integers(0, 62, rng.integers(0, 4)).tolist():
            h ^= 1 << bit
        rows.append((str(i % 2), i, f"p{int(rng.integers(0, 60)):03d}", [h], float(rng.integers(0, 5))))
    df = spark.createDataFrame(rows, "scope string, id long, path string, words array<long>, quality double")
    want = set()
    for scope in ("0", "1"):
        own = sorted((r for r in rows if r[0] == scope), key=lambda r: (r[2], r[1]))
        free = [True] * len(own)
        for i in range(len(own)):
            if not free[i]:
                continue
            free[i], members = False, [i]
            for j in members:
                for k in range(j + 1, len(own)):
                    if free[k] and ((own[j][3][0] ^ own[k][3][0]) & ((1 << 64) - 1)).bit_count() <= 4:
                        free[k] = False
                        members.append(k)
            if len(members) > 1:
                best = max(members, key=lambda m: (own[m][4], -members.index(m)))
                want |= {(scope, own[m][1], own[i][1], own[best][1]) for m in members}
    assert {tuple(r) for r in grouping.ordered_near_duplicates(df, 4).collect()} == want and want
    old, similarity.BLOCK = similarity.BLOCK, 7
    try:
        pairs = {(r.src, r.dst) for r in similarity.hamming_pairs(df, 4, 7).collect()}
    finally:
        similarity.BLOCK = old
    assert pairs == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and ((a[3][0] ^ b[3][0]) & ((1 << 64) - 1)).bit_count() <= 4}


def test_stitching_order(spark):
    edges = spark.createDataFrame([(1, 0, 1, 50), (1, 1, 2, 90), (1, 0, 2, 10), (1, 2, 3, 30), (2, 5, 6, 1)], "set long, src long, dst long, inliers long")
    rows = grouping.stitching_order(edges).collect()
    assert sorted((r.place, r.node) for r in rows if r.set == 1) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert sorted((r.place, r.node) for r in rows if r.set == 2) == [(0, 5), (1, 6)]


def test_stored_queries():
    q = C.CatalogQuery.of_json('{"minRating": 3, "person": "A", "excludedTags": ["x"], "what": 1, "isRaw": null}')
    assert (q.min_rating, q.people, q.exclude_tags, q.is_raw) == (3, ["A"], ["x"], None)
    s = C.CatalogQuery(root_id=1, rating=6, year=2101, date_from=9, date_to=3, people=["Ann and Bo, Cy & Di"], tags=[" a ", "", "x" * 99], tag_mode="x", text=" ", limit=1).sanitized()
    assert (s.root_id, s.rating, s.year, s.date_from, s.date_to, s.text, s.tag_mode, s.limit) == (None, None, None, 3, 9, None, "AND", 20_000)
    assert s.people == ["Ann", "Bo", "Cy", "Di"] and s.tags == ["a", "x" * 80]


def test_merge_loops_are_an_error(spark):
    import pytest

    with pytest.raises(ValueError):
        review.merged_people(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, merged_into long"), 5)


def test_fuzzy_score():
    assert files.fuzzy_score("Lumo 50mm", "zzz") == 0 and files.fuzzy_score("abc", "") == 0
    assert files.fuzzy_score("Lumo 50mm", "50mm") > files.fuzzy_score("Lumo 5x0xmxm", "50mm") > 0


def test_present_and_broken_luts(spark, tmp_path):
    (tmp_path / "t.cube").write_text("# a\nTITLE x\nLUT_3D_SIZE 2\n" + "\n".join(f"{r} {g} {b}" for b in (0, 1) for g in (0, 1) for r in (0, 1)))
    lines = spark.read.text(str(tmp_path / "t.cube")).withColumn("line_number", F.monotonically_increasing_id()).select(F.lit("t").alias("path"), "line_number", "value")
    lut = files.parse_cube(lines)
    assert lut.count() == 8 and lut.select("size").distinct().collect()[0][0] == 2
    px = spark.createDataFrame([(0.25, 0.5, 1.0), (0.0, 0.0, 0.0), (2.0, -1.0, 0.3)], "r double, g double, b double")
    got_ = sorted(tuple(round(x, 6) for x in r.lut) for r in raster.apply_lut(px, lut).collect())
    assert got_ == [(0.0, 0.0, 0.0), (0.25, 0.5, 1.0), (1.0, 0.0, 0.3)]
