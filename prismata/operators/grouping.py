"""Sibling groups, badges and near-duplicate groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismata.functions.parse import extension, stem_before_last_dot
from prismata.operators import similarity
from prismata.session import materialize


def sibling_groups(rows: DataFrame, same_time: bool = False, edited_too: bool = True) -> DataFrame:
    """rows with group_id: files of one folder and stem (its case counts), two or more; null for others.

    Virtual copies (is_virtual_copy, if rows have it) are in no group, nor are edited files
    unless edited_too. same_time: all members must have one known time of capture.
    """
    folder = F.regexp_replace("relative_path", r"/?[^/]*$", "")
    fit = ~F.coalesce("is_virtual_copy", F.lit(False)) if "is_virtual_copy" in rows.columns else F.lit(True)
    fit = fit if edited_too else fit & ~F.coalesce("is_edited", F.lit(False))
    keyed = rows.withColumn("key", F.when(fit, F.concat_ws("/", F.col("root_id").cast("string"), folder, stem_before_last_dot(F.col("file_name")))))
    known = [F.count("*").alias("n")] + ([F.count("date_taken").alias("k"), F.min("date_taken").alias("lo"), F.max("date_taken").alias("hi")] if same_time else [])
    sizes = keyed.filter("key IS NOT NULL").groupBy("key").agg(*known).filter("n >= 2" + (" AND k = n AND lo = hi" if same_time else "")).select("key", F.col("key").alias("group_id"))
    return keyed.join(sizes, "key", "left").drop("key")


def collapse(grouped: DataFrame, prefer: str = "raw") -> DataFrame:
    """One row a group: the preferred member (raw, jpeg: any that is not raw, or else the first), the number of members and the badge of their formats."""
    kind = extension(F.col("file_name"))
    rank = {"raw": F.when(F.col("is_raw"), 0).otherwise(1), "jpeg": F.when(F.col("is_raw"), 1).otherwise(0)}.get(prefer, F.lit(0))
    label = F.when(kind == "", "FILE").otherwise(F.upper(kind))
    rows = grouped.filter("group_id IS NOT NULL").select("group_id", "id", label.alias("ext"), F.struct(rank.alias("r"), F.lower("file_name").alias("f"), "id").alias("o"))
    return rows.groupBy("group_id").agg(F.min("o").alias("o"), F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_set("ext")), "+").alias("badge")).select("group_id", F.col("o.id").alias("primary_id"), "members", "badge")


def expand_selection(grouped: DataFrame, selected: DataFrame) -> DataFrame:
    """(id): the selected rows and all members of their groups."""
    groups = grouped.join(selected.select("id"), "id", "left_semi").select("group_id").filter("group_id IS NOT NULL").distinct()
    return grouped.join(groups, "group_id", "left_semi").select("id").union(selected.select("id")).distinct()


def ordered_near_duplicates(rows: DataFrame, threshold: int = 28) -> DataFrame:
    """(scope, id, group_root, representative): order-dependent grouping of hashes within each scope.

    In order of path, each free item opens a group and takes, breadth first, free items that
    come after the one being expanded and differ from it in at most threshold bits; the
    representative has the best quality (ties: the first). rows: scope, id, path, words
    (array of 64-bit hash words), quality. The comparison of all pairs is blocked
    (similarity.hamming_pairs); only the order of the found pairs is followed in one task a
    scope, which is as large as the duplicates in it.
    """
    pairs = materialize(similarity.hamming_pairs(rows, threshold), "near-hashes")
    linked = pairs.select("scope", F.explode(F.array("src", "dst")).alias("id")).distinct()
    items = rows.select("scope", "id", "path", "quality").join(linked, ["scope", "id"])

    def run(key: tuple, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["path", "id"], kind="stable").reset_index(drop=True)
        at = {v: i for i, v in enumerate(own["id"].tolist())}
        after: list[list[int]] = [[] for _ in at]
        for a, b in zip(links["src"].map(at).tolist(), links["dst"].map(at).tolist()):
            after[min(a, b)].append(max(a, b))
        free, out, quality, ids = [True] * len(at), [], own["quality"].tolist(), own["id"].tolist()
        for i in range(len(at)):
            if not free[i]:
                continue
            free[i], members = False, [i]
            for j in members:  # grows while it is read
                got = [k for k in sorted(after[j]) if free[k]]
                for k in got:
                    free[k] = False
                members += got
            if len(members) > 1:
                best = max(members, key=lambda m: (quality[m], -members.index(m)))
                out += [(key[0], ids[m], ids[i], ids[best]) for m in members]
        return pd.DataFrame(out, columns=["scope", "id", "group_root", "representative"])

    both = items.groupBy("scope").cogroup(pairs.select("scope", "src", "dst").groupBy("scope"))
    return both.applyInPandas(run, "scope string, id bigint, group_root bigint, representative bigint")


def blurry(rows: DataFrame, grouped: DataFrame, least: float = 100.0) -> DataFrame:
    """Rows outside every group with a sharpness below least, softest first."""
    return rows.join(grouped.select("id"), "id", "left_anti").filter(F.col("sharpness") < least).orderBy("sharpness", "id")


def latest(log: DataFrame, *keys: str, order: str = "seq") -> DataFrame:
    """The last row of each key of an append-only log (N1, N5, M-rows): pre-aggregated, no window."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def top_per_group(rows: DataFrame, group: str, k: int, *order) -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rn") <= k)


def numbered(rows: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """rows with their place from 1 in the order of all of them: sorted by ranges, numbered within each, and moved on by what the ranges before hold (one number a partition)."""
    number = F.monotonically_increasing_id()  # the partition, and the row in it
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", number)
    held = materialize(ranged, "numbered").withColumn("_part", F.shiftright("_n", 33)).withColumn("_n", F.col("_n").bitwiseAND((1 << 33) - 1))
    counts = sorted((r["_part"], r["n"]) for r in held.groupBy("_part").agg(F.count("*").alias("n")).collect())  # as many as partitions
    offsets = [(part, sum(n for _, n in counts[:k])) for k, (part, _) in enumerate(counts)]
    before = rows.sparkSession.createDataFrame(offsets, "_part bigint, _before bigint")
    return held.join(F.broadcast(before), "_part").withColumn(name, (F.col("_n") + F.col("_before") + 1).cast("bigint")).drop("_n", "_part", "_before")


def stitching_order(edges: DataFrame) -> DataFrame:
    """(set, place, node): the images of each set in the order of stitching: a spanning tree of the strongest links, walked breadth first from the first image with the fewest links. edges: set, src, dst, inliers.

    A set is one panorama; the edges of a set meet in one task. Of a set that falls apart only the part of the start is walked.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict[int, int] = {}

        def find(i: int) -> int:
            while parent.setdefault(i, i) != i:
                parent[i] = i = parent[parent[i]]
            return i

        near: dict[int, list[int]] = {}
        for a, b in pdf.sort_values(["inliers", "src", "dst"], ascending=[False, True, True])[["src", "dst"]].itertuples(index=False, name=None):
            if find(a) != find(b):
                parent[find(a)] = find(b)
                near.setdefault(a, []).append(b)
                near.setdefault(b, []).append(a)
        order = [min(near, key=lambda i: (len(near[i]), i))] if near else []
        seen = set(order)
        for i in order:  # grows while it is read
            fresh = [j for j in near[i] if j not in seen]
            seen.update(fresh)
            order += fresh
        return pd.DataFrame({"set": [key[0]] * len(order), "place": range(len(order)), "node": order}).astype({"place": "int64", "node": "int64"})

    return edges.groupBy("set").applyInPandas(run, "set bigint, place bigint, node bigint")
