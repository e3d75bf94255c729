"""Connected components over an edge table, and medoids of the resulting groups.

Rounds of large-star and small-star (Kiveris et al., "Connected Components in MapReduce and
Beyond"): every node links its neighbours to the smallest node around it. The edge table is
rewritten to shared storage each round, so the lineage stays short and survives lost
executors; minima are pre-aggregated, so a node with a third of all edges is no bottleneck
(its join is split by adaptive skew handling). The number of rounds grows with the
logarithm of the longest path. Nothing but two sums a round reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismata.functions.parse import dot
from prismata.session import drop_materialized, materialize, small_side


def join_all(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join in comp (the smallest place of each place's component) the components of places a[k] and b[k]."""
    while True:
        u, v = comp[a], comp[b]
        open_ = u != v
        if not open_.any():
            return
        a, b, u, v = a[open_], b[open_], u[open_], v[open_]
        np.minimum.at(comp, np.maximum(u, v), np.minimum(u, v))
        while (comp[comp] != comp).any():
            comp[:] = comp[comp]


def forest_of(src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges of the spanning forest of the largest weights (ties: the smaller src, then dst), in this order: what Kruskal's walk takes, by rounds in which each component takes its best edge."""
    order = np.lexsort((dst, src, -weight))
    src, dst, weight = src[order], dst[order], weight[order]
    nodes, code = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b, left = code[: len(src)], code[len(src) :], np.arange(len(src))
    comp, taken = np.arange(len(nodes)), np.zeros(len(src), bool)
    while True:
        left = left[comp[a[left]] != comp[b[left]]]
        if not len(left):
            return src[taken], dst[taken], weight[taken]
        best = np.full(len(nodes), len(src))
        np.minimum.at(best, comp[a[left]], left)
        np.minimum.at(best, comp[b[left]], left)
        chosen = np.unique(best[best < len(src)])
        taken[chosen] = True
        join_all(comp, a[chosen], b[chosen])


def spanning_forest(links: DataFrame, most: int = 1 << 20) -> DataFrame:
    """links (scope, src, dst, weight) without those that are in no spanning forest of the largest weights (ties: the smaller src, then dst): what remains of a scope is at most `most` rows, or about as many as its nodes.

    A scope is dealt out, each part keeps its own forest, and again until that no longer helps: no task holds more than about `most` rows.
    """
    now, before = materialize(links, "links"), None
    schema = "scope bigint, src bigint, dst bigint, weight bigint"

    def reduced(table: pa.Table) -> pa.Table:
        src, dst, weight = forest_of(*(table.column(c).to_numpy() for c in ("src", "dst", "weight")))
        return pa.table({"scope": pa.array(np.full(len(src), table.column("scope")[0].as_py(), np.int64)), "src": src, "dst": dst, "weight": weight})

    while True:
        sizes = now.groupBy("scope").agg(F.count("*").alias("n"))
        rows = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        if rows[1] <= most or before is not None and rows[0] > 0.8 * before:
            return now
        before = rows[0]
        parts = small_side(sizes.select("scope", F.ceil(F.col("n") / most).cast("int").alias("parts")))
        dealt = now.join(parts, "scope").withColumn("part", F.pmod(F.xxhash64("src", "dst"), "parts"))
        step = materialize(dealt.select("scope", "src", "dst", "weight", "part").groupBy("scope", "part").applyInArrow(reduced, schema), "links")
        drop_materialized(links.sparkSession, now)
        now = step


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them. Edges are (larger u, smaller v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    linked = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionAll(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """(node, component) for each node of an edge; component is the smallest node reachable.

    edges: src and dst of any ordered type; nulls, loops, repeats and either direction are
    allowed. An empty table gives an empty result. rows: about how many edges there are, for
    the files of the first table; a round never adds edges, so later ones know.
    """
    spark = edges.sparkSession
    start = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src != dst")
    now = materialize(start.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "components", rows)
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        step = materialize(_small_star(_large_star(now).distinct()).filter("u != v").distinct(), "components", state[0])
        drop_materialized(spark, now)
        now = step
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))


def components_with_singletons(nodes: DataFrame, edges: DataFrame, min_size: int = 1) -> DataFrame:
    """(node, component, size) of all nodes; groups below min_size are left out."""
    found = connected_components(edges)
    every = nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    sizes = every.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") >= min_size)
    return every.join(sizes, "component").select("node", "component", "size")


def medoids(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """(component, medoid, mean_similarity): the member with the largest mean inner product with its group, its own counted as 1.

    members: node, component. vectors: node, v (of one length). No pair is made: the products
    with all members add up to the product with the sum of their vectors. Ties go to the
    smaller node.
    """
    rows = members.join(vectors, "node").select("component", "node", "v")
    places = rows.select("component", F.posexplode("v").alias("i", "x")).groupBy("component", "i").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    total = places.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("s"), F.max("n").alias("n"))
    mean = (dot(F.col("v"), F.col("s")) - dot(F.col("v"), F.col("v")) + 1.0) / F.col("n")
    best = rows.join(small_side(total), "component").select("component", "node", F.round(mean, 9).alias("mean")).groupBy("component").agg(F.max(F.struct("mean", (-F.col("node")).alias("k"))).alias("b"))
    return best.select("component", (-F.col("b.k")).alias("medoid"), F.col("b.mean").alias("mean_similarity"))
