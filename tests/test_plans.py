"""Plans at scale: no list in one task, no table computed twice, block pairs only between cells that can reach each other."""

import numpy as np
from pyspark.sql import functions as F

from prismata import session
from prismata.operators import catalog, components, grouping, matching, similarity, workflow
from prismata.plans import registry

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_without_a_window_over_the_whole_list(spark):
    rows = spark.createDataFrame([(i, f"n{(i * 7919) % 1000:03}") for i in range(1000)], "id long, name string").repartition(5)
    got = grouping.numbered(rows, "name", F.desc("id"))
    assert "Window" not in plan(got)
    assert [r.id for r in got.orderBy("place").collect()] == [r.id for r in rows.orderBy("name", F.desc("id")).collect()] and sorted(r.place for r in got.collect()) == list(range(1, 1001))
    assert grouping.numbered(rows.filter("false"), "name").count() == 0
    for name in ("q1_catalog_list", "o8_album_tree"):
        assert "Window" not in plan(registry.queries()[name](spark, DATA)), name


def test_a_small_side_runs_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    side = spark.range(50).mapInArrow(seen, "id long")
    assert spark.range(1000).join(session.small_side(side), "id").count() == 50 and ran.value == 50
    wide = session.materialize(spark.range(300).select("id", F.sha2(F.col("id").cast("string"), 512).alias("t")), "wide")
    assert "Broadcast" in plan(wide.join(session.small_side(wide.select("id")), "id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "Broadcast" not in plan(wide.join(session.small_side(wide, size=1000), "id")) and "Broadcast" not in plan(wide.join(session.small_side(wide, rows=10), "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_block_pairs_only_between_cells_in_reach(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = np.eye(8) * 3
    rows = [(i, (centres[i % 8] + 0.05 * rng.standard_normal(8)).tolist()) for i in range(400)] + [(900 + i, [1.0] * 3) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    monkeypatch.setattr(similarity, "BLOCK", 16)
    pairs = {(r.src, r.dst) for r in similarity.similar_pairs(df, df, "id", "v", 7.0, True).collect()}
    want = {(a, b) for a, x in rows for b, y in rows if a < b and len(x) == len(y) and float(np.dot(x, y)) >= 7.0}
    assert pairs == want and len(want) > 5000
    pivots = [c.tolist() for c in centres]
    cells = spark.createDataFrame([(8, k, 0.3) for k in range(8)] + [(3, 0, float("inf"))], "dim int, cell int, reach double")
    left = {(r.dim, r.cell, r.other) for r in similarity._cell_pairs(cells, cells, pivots, 7.0).collect()}
    assert left == {(8, k, k) for k in range(8)} | {(3, 0, 0)}


def test_cleared_faces(spark):
    faces = spark.createDataFrame([(1,), (5,), (9,)], "seq long")
    clears = spark.createDataFrame([(3,), (5,)], "seq long")
    assert [r.seq for r in workflow.cleared_faces(faces, clears).collect()] == [9]
    assert workflow.cleared_faces(faces, clears.filter("false")).count() == 3


def test_a_sanitized_query_lists_every_row(spark, monkeypatch):
    monkeypatch.setattr(catalog, "MAX_ROWS", 5)
    rows = registry.queries()["f13_sanitized_query"](spark, DATA)
    assert rows.count() == rows.distinct().count() == 96


def test_decisions_of_one_time_do_not_depend_on_the_order_of_rows(spark):
    faces = spark.createDataFrame([(1, 10, None, "unreviewed", 0.2, 0.2), (2, 11, None, "unreviewed", 0.2, 0.2), (3, 11, None, "unreviewed", 0.21, 0.2)], "id long, image_id long, person_id long, review_state string, bbox_x double, bbox_y double")
    images = spark.createDataFrame([(10, 1, "a.ARW"), (11, 1, "a.JPG")], "id long, folder_id long, file_name string")
    people = spark.createDataFrame([(7, "active")], "id long, state string")
    log = [(5, 1, 7, "confirmed"), (5, 2, None, "rejected"), (4, 3, None, "rejected")]
    for rows in (log, log[::-1]):
        decisions = spark.createDataFrame(rows, "seq long, face_id long, person_id long, review_state string").coalesce(1)
        got = {r.id: (r.person_id, r.review_state) for r in workflow.reviewed_faces(faces, decisions, images, people).collect()}
        assert got == {1: (None, "rejected"), 2: (None, "rejected"), 3: (7, "confirmed")}


def crowd(spark, n=400):
    """Vectors of two lengths, some apart from all others, and their pairs over 0.5."""
    rng = np.random.default_rng(8)
    rows = [(7 * i, rng.standard_normal(6 if i % 9 else 4).tolist()) for i in range(n)]
    rows = [(i, (np.array(v) / np.linalg.norm(v) * (1 if i % 4 else 0.8)).tolist()) for i, v in rows]
    want = {(a, b): float(np.dot(x, y)) for a, x in rows for b, y in rows if a < b and len(x) == len(y) and np.dot(x, y) >= 0.5}
    return spark.createDataFrame(rows, "id long, v array<double>"), want


def test_dense_blocks_meet_without_a_shuffle_for_each_pair(spark, monkeypatch):
    df, want = crowd(spark)
    monkeypatch.setattr(similarity, "BLOCK", 16)
    monkeypatch.setattr(similarity, "PRODUCTS", 50)
    found = similarity.similar_pairs(df, df, "id", "v", 0.5, True)
    assert "CartesianProduct" in plan(found) and "Exchange" not in plan(found)
    assert {(r.src, r.dst): round(r.similarity, 9) for r in found.collect()} == {k: round(s, 9) for k, s in want.items()}
    left, right = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    both = similarity.similar_pairs(left, right, "id", "v", 0.5, False)
    assert "CartesianProduct" in plan(both)
    assert {(r.src, r.dst) for r in both.collect()} == {(a, b) if a % 2 == 0 else (b, a) for a, b in want if (a + b) % 2}


def test_connecting_pairs_have_the_components_of_all_pairs(spark, monkeypatch):
    df, want = crowd(spark)
    monkeypatch.setattr(similarity, "BLOCK", 16)
    monkeypatch.setattr(similarity, "PRODUCTS", 50)
    edges = similarity.connecting_pairs(df, "id", "v", 0.5)
    roots = {n: n for pair in want for n in pair}
    for _ in range(40):
        for a, b in want:
            roots[a] = roots[b] = min(roots[a], roots[b])
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == roots and edges.count() < len(want) / 2
    monkeypatch.setattr(similarity, "BLOCK", 4096)
    one = similarity.connecting_pairs(df, "id", "v", 0.5)
    assert {r.node: r.component for r in components.connected_components(one).collect()} == roots and one.count() == len(roots) - len(set(roots.values()))


def test_links_of_a_set_are_cut_to_a_forest_before_they_meet(spark, monkeypatch):
    df, want = crowd(spark)
    links = [(a % 5, a, b, int(np.floor(s * 100))) for (a, b), s in want.items() if a % 5 == b % 5]
    everything = spark.createDataFrame(links, "set long, src long, dst long, inliers long")
    order = lambda e: sorted((r.set, r.place, r.node) for r in grouping.stitching_order(e).collect())
    for block, held, most in ((16, 30, 40), (4096, 1 << 20, 1 << 20)):
        monkeypatch.setattr(similarity, "BLOCK", block)
        monkeypatch.setattr(similarity, "PRODUCTS", 50)
        monkeypatch.setattr(similarity, "HELD", held)
        some = similarity.strongest_links(df, "id", "v", 0.5, F.col("id") % 5, 100)
        kept = components.spanning_forest(some, most).select(F.col("scope").alias("set"), "src", "dst", F.col("weight").alias("inliers"))
        assert some.count() < len(links) and kept.count() < 400 and order(kept) == order(everything)


def test_consensus_scores_slices_of_the_matches(spark, monkeypatch):
    rng = np.random.default_rng(4)
    at = rng.integers(0, 500, (90, 2)).astype(float)
    moved = at + [30.0, -12.0] + np.where(np.arange(90)[:, None] % 4 == 0, rng.integers(20, 90, (90, 2)), 0)
    rows = [(a, a + 1, i, i, *at[i].tolist(), *moved[i].tolist()) for a, n in ((0, 90), (2, 40), (4, 3)) for i in range(n)]
    matches = spark.createDataFrame(rows, "a long, b long, i long, j long, x1 double, y1 double, x2 double, y2 double")
    whole = sorted(matching.consensus(matches, 200).collect())
    monkeypatch.setattr(matching, "SLICE", 7)
    monkeypatch.setattr(matching, "SCORED", 50)
    got = matching.consensus(matches.repartition(3), 200)
    assert sorted(got.collect()) == whole and [(r.a, r.matches, r.inliers) for r in whole] == [(0, 90, 67), (2, 40, 30)]
    maps = np.array([r.map for r in whole])
    assert np.allclose(maps.reshape(-1, 3, 3), [[1, 0, 30], [0, 1, -12], [0, 0, 1]], atol=1e-6)
    points = np.hstack([at, moved])
    by_hand = [[(abs(z := h[6] * x + h[7] * y + h[8]) >= 1e-8) and (u - (h[0] * x + h[1] * y + h[2]) / z) ** 2 + (v - (h[3] * x + h[4] * y + h[5]) / z) ** 2 < 25 for x, y, u, v in points] for h in maps]
    assert matching.inliers_of(maps, points, 5.0).tolist() == [sum(r) for r in by_hand]
    assert not [s for s in plan(got).split("\n") if "MapInArrow" in s and "all#" in s]
