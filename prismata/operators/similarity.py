"""Vector and hash similarity joins, labels and tag scores.

All-pairs joins are blocked: vectors near one pivot stand in blocks of about BLOCK, each a
row of flat numbers; a pair of blocks whose centres and radii rule out the threshold is
never made, every other is multiplied in a task by strips, and only pairs over the threshold
leave it. No pair of rows is materialised, and a task holds two blocks and a strip. Who needs
only the components of the pairs, or a spanning forest, takes connecting_pairs or strongest_links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismata.functions.parse import dot
from prismata.operators import components
from prismata.session import materialize, small_side

#: Vectors of a block, and hashes of one.
BLOCK, HASHES = 8192, 2048
#: Products of a strip that are held at once, and links that a task gathers before it reduces them.
PRODUCTS, HELD = 1 << 20, 1 << 19
#: Pairs of blocks for each block, up to which pairs fetch their blocks by joins.
MEETS = 2
#: Most pivots by which vectors are sorted into blocks.
PIVOTS = 256
#: Model -> (least similarity to suggest, least similarity to cluster).
THRESHOLDS = {"sface": (0.45, 0.48), "arcface": (0.42, 0.48)}


def _pivots(vectors: DataFrame, n: int) -> list[list[float]]:
    """n vectors (those of the smallest hashes), at most PIVOTS: they decide which blocks there are, not the result."""
    if n <= 1:
        return []
    size = vectors.agg(F.mode(F.size("v"))).first()[0]
    taken = vectors.filter(F.size("v") == size).orderBy(F.xxhash64("id"), "id").limit(n).select("v").collect()
    return [r["v"] for r in taken]


def _plain(df: DataFrame, key: str, vector: str, scope: Column | None = None) -> DataFrame:
    """(id, scope, v): v keeps floats, which double precision holds, and casts the rest to double."""
    v = F.col(vector) if df.schema[vector].dataType.simpleString() == "array<float>" else F.transform(vector, lambda x: x.cast("double"))
    return df.select(F.col(key).cast("bigint").alias("id"), (F.lit(0) if scope is None else scope).cast("bigint").alias("scope"), v.alias("v")).filter("v IS NOT NULL AND id IS NOT NULL AND scope IS NOT NULL")


def _blocks(vectors: DataFrame, pivots: list[list[float]], least: float | None = None) -> DataFrame:
    """(dim, scope, cell, block, ids, flat, labels, centre, radius, reach): vectors by nearest pivot (the cell), cut by hash into blocks; vectors of different lengths or scopes never meet.

    ids, flat and labels are the bytes of arrays. reach: the largest distance from the pivot, infinite without one. labels: with
    least, the smallest id that pairs of at least that product within the block connect each row to.
    """

    @F.pandas_udf("int")
    def nearest(v):
        import pandas as pd

        p = np.array(pivots)
        own = [np.asarray(x, float) for x in v]
        if p.size and all(len(x) == p.shape[1] for x in own):
            return pd.Series(((p * p).sum(1)[None, :] - 2 * np.array(own).reshape(len(own), -1) @ p.T).argmin(1))
        return pd.Series([int(((p - x) ** 2).sum(1).argmin()) if p.size and len(x) == p.shape[1] else 0 for x in own])

    keys = ("dim", "scope", "cell")
    placed = vectors.withColumn("cell", nearest("v") if pivots else F.lit(0)).withColumn("dim", F.size("v"))
    cut = F.pmod(F.xxhash64("id"), F.col("parts"))
    parts = small_side(placed.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("bigint").alias("parts")))
    keyed = placed.join(parts, [*keys]).withColumn("block", F.concat_ws("-", "cell", cut))
    rows = keyed.groupBy(*keys, "block").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    flat = rows.select(*keys, "block", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("flat"))

    def measure(batches):
        for batch in batches:
            named, made = batch.schema.names, {k: [] for k in ("ids", "flat", "labels", "centre", "radius", "reach")}
            for row, (dim, cell) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                ids, kept = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in (4, 5))
                x = kept.reshape(len(ids), dim).astype(float)
                labels = np.zeros(0, np.int64)
                if least is not None:
                    comp = np.arange(len(ids))
                    _connect(x, x, comp, comp.copy(), comp.copy(), least)
                    first = np.full(len(ids), np.iinfo(np.int64).max)
                    np.minimum.at(first, comp, ids)
                    labels = first[comp]
                known = bool(pivots) and len(pivots[cell]) == dim
                about = (ids.tobytes(), kept.tobytes(), labels.tobytes(), x.mean(0), float(np.sqrt(((x - x.mean(0)) ** 2).sum(1)).max(initial=0)), float(np.sqrt(((x - pivots[cell]) ** 2).sum(1)).max(initial=0)) if known else float("inf"))
                for k, value in zip(made, about):
                    made[k].append(value)
            kinds = (pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(v, t) for v, t in zip(made.values(), kinds))], names=[*named[:4], *made])

    return flat.mapInArrow(measure, "dim int, scope bigint, cell int, block string, ids binary, flat binary, labels binary, centre array<double>, radius double, reach double")


def _cell_pairs(a: DataFrame, b: DataFrame, pivots: list[list[float]], threshold: float | None) -> DataFrame:
    """(dim, cell, other): cells of a and b that can reach the threshold, by their pivots and reaches. At most PIVOTS cells a length; their pairs are made, those of their blocks only where a pair is left."""
    named = a.sparkSession.createDataFrame([(k, [float(x) for x in p]) for k, p in enumerate(pivots)], "cell int, p array<double>")
    cells = lambda df: df.groupBy("dim", "cell").agg(F.max("reach").alias("reach")).join(F.broadcast(named), "cell", "left")
    x, y = cells(a), cells(b).select("dim", F.col("cell").alias("other"), F.col("reach").alias("far"), F.col("p").alias("q"))
    pairs = x.join(y, "dim")
    if threshold is None:
        return pairs.select("dim", "cell", "other")
    size = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    most = dot(F.col("p"), F.col("q")) + size("p") * F.col("far") + size("q") * F.col("reach") + F.col("reach") * F.col("far")
    unknown = F.col("p").isNull() | F.col("q").isNull() | (F.col("reach") == float("inf")) | (F.col("far") == float("inf"))
    return pairs.filter(unknown | (most >= threshold - 1e-9)).select("dim", "cell", "other")


def _block_pairs(left: DataFrame, right: DataFrame | None, key: str, vector: str, threshold: float | None, scope: Column | None = None, labelled: bool = False) -> tuple[DataFrame, DataFrame, tuple[np.dtype, np.dtype]]:
    """Pairs of blocks (dim, scope, i, j, a, x, la, b, y, lb) that can reach the threshold, the blocks of left, and the kinds of numbers in x and y. right None: left with itself.

    Where a block meets few others, pairs fetch their blocks by joins. Where it meets many, joins would write each block
    once for each pair, the square of the input; there each task reads the files of two parts of the blocks and nothing is shuffled.
    """
    same = right is None
    n = -(-left.count() // BLOCK)
    one, two = _plain(left, key, vector, scope), None if same else _plain(right, key, vector, scope)
    pivots = _pivots(one, min(n, PIVOTS))
    written = (lambda df: materialize(df, "vector-blocks")) if n > 1 or labelled else (lambda df: df)  # one block is made as fast as it is read
    a = written(_blocks(one, pivots, threshold if labelled else None))
    b = a if same else written(_blocks(two, pivots))
    kinds = tuple(np.dtype("f4" if df.schema["v"].dataType.simpleString() == "array<float>" else "f8") for df in (one, one if same else two))
    about = lambda df, p, c: df.select("dim", "scope", F.col("cell").alias(c), F.col("block").alias(p), F.col("centre").alias(f"{p}c"), F.col("radius").alias(f"{p}r"))
    size = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    most = dot(F.col("ic"), F.col("jc")) + size("ic") * F.col("jr") + size("jc") * F.col("ir") + F.col("ir") * F.col("jr")
    fits = (F.col("i") < F.col("j") if labelled else F.col("i") <= F.col("j")) if same else F.lit(True)
    fits = fits if threshold is None else fits & (most >= threshold - 1e-9)
    if n > 1:
        reachable = small_side(_cell_pairs(a, b, pivots, threshold))
        pairs = about(a, "i", "cell").join(reachable, ["dim", "cell"]).join(about(b, "j", "other"), ["dim", "scope", "other"])
    else:  # one block
        pairs = about(a, "i", "cell").join(about(b, "j", "other"), ["dim", "scope"])
    pairs = pairs.filter(fits).select("dim", "scope", "i", "j")
    names = ["dim", "scope", "i", "j", "a", "x", "la", "b", "y", "lb"]
    first = a.select("dim", "scope", F.col("block").alias("i"), F.col("ids").alias("a"), F.col("flat").alias("x"), F.col("labels").alias("la"), F.col("centre").alias("ic"), F.col("radius").alias("ir"))
    second = b.select("dim", "scope", F.col("block").alias("j"), F.col("ids").alias("b"), F.col("flat").alias("y"), F.col("labels").alias("lb"), F.col("centre").alias("jc"), F.col("radius").alias("jr"))
    if n > 1 and pairs.count() > MEETS * (a.count() + (0 if same else b.count())):
        second = second.select(F.col("dim").alias("d"), F.col("scope").alias("s"), "j", "b", "y", "lb", "jc", "jr")
        return first.hint("shuffle_replicate_nl").join(second, (F.col("dim") == F.col("d")) & (F.col("scope") == F.col("s")) & fits).select(*names), a, kinds
    return pairs.join(first, ["dim", "scope", "i"]).join(second, ["dim", "scope", "j"]).select(*names), a, kinds


def _each_pair(batches, kinds):
    """(scope, whether a block meets itself, ids, rows, labels of the one block, and of the other) of each pair of blocks."""
    for batch in batches:
        for row in range(batch.num_rows):
            dim, scope, i, j = (batch.column(k)[row].as_py() for k in range(4))
            raw = [batch.column(k)[row].as_buffer() for k in range(4, 10)]
            ia, la, ib, lb = (np.frombuffer(raw[k], np.int64) for k in (0, 2, 3, 5))
            x, y = (np.frombuffer(raw[k], kind).astype(float).reshape(len(ids), dim) for k, kind, ids in ((1, kinds[0], ia), (4, kinds[1], ib)))
            yield scope, i == j, ia, x, la, ib, y, lb


def _strips(x: np.ndarray, y: np.ndarray):
    """Slices of rows of x whose products with all of y are few enough to hold."""
    step = max(1, PRODUCTS // max(len(y), 1))
    return (slice(k, k + step) for k in range(0, len(x), step))


def _product(left: DataFrame, right: DataFrame | None, key: str, vector: str, threshold: float | None, keep) -> DataFrame:
    """Rows (src, dst, similarity) that keep() takes from the products of the rows of each pair of blocks that can reach the threshold. right None: left with itself."""
    same = right is None
    joined, _, kinds = _block_pairs(left, right, key, vector, threshold)

    def run(batches):
        for _, own, ia, x, _, ib, y, _ in _each_pair(batches, kinds):
            for part in _strips(x, y):
                s = x[part] @ y.T
                p, q = keep(s, ia[part], ib, same and own)
                src, dst = ia[part][p], ib[q]
                if same:
                    src, dst = np.minimum(src, dst), np.maximum(src, dst)
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(s[p, q])], names=["src", "dst", "similarity"])

    return joined.mapInArrow(run, "src bigint, dst bigint, similarity double")


def _connect(x: np.ndarray, y: np.ndarray, comp: np.ndarray, at: np.ndarray, to: np.ndarray, least: float) -> None:
    """Join in comp what pairs of rows of x and y with a product of at least least connect; at and to are the places of the rows in comp. Products of two rows of the component that most of y is in are not made."""
    for part in _strips(x, y):
        most = np.bincount(comp[to]).argmax()
        inside, outside = comp[at[part]] == most, np.flatnonzero(comp[to] != most)
        for rows, columns in ((np.flatnonzero(~inside), np.arange(len(y))), (np.flatnonzero(inside), outside)):
            if len(rows) and len(columns):
                p, q = np.nonzero(x[part][rows] @ y[columns].T >= least)
                components.join_all(comp, at[part][rows[p]], to[columns[q]])


def connecting_pairs(rows: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """(src, dst): edges with the components of all pairs of rows with an inner product of at least threshold (similar_pairs), of which they are at most as many as rows and, for each pair of blocks, as rows in the two.

    Each block is reduced to its components when it is made; a pair of blocks gives edges between those only, and what
    is known to be connected is not compared. An edge stands for a path, not for a pair over the threshold.
    """
    joined, blocks, kinds = _block_pairs(rows, None, key, vector, threshold, labelled=True)

    def inside(batches):
        for batch in batches:
            for ids, labels in zip(batch.column(0), batch.column(1)):
                ids, labels = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(labels.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(labels[ids != labels]), pa.array(ids[ids != labels])], names=["src", "dst"])

    def between(batches):
        for _, _, _, x, la, _, y, lb in _each_pair(batches, kinds):
            labels, code = np.unique(np.concatenate([la, lb]), return_inverse=True)
            comp = np.arange(len(labels))
            _connect(x, y, comp, code[: len(la)], code[len(la) :], threshold)
            moved = np.flatnonzero(comp != np.arange(len(comp)))
            yield pa.RecordBatch.from_arrays([pa.array(labels[comp[moved]]), pa.array(labels[moved])], names=["src", "dst"])

    return blocks.select("ids", "labels").mapInArrow(inside, "src bigint, dst bigint").unionAll(joined.mapInArrow(between, "src bigint, dst bigint"))


def strongest_links(rows: DataFrame, key: str, vector: str, threshold: float, scope: Column, scale: int) -> DataFrame:
    """(scope, src, dst, weight): of the pairs of each scope with an inner product of at least threshold those that can be in its spanning forest of the largest weights (ties: the smaller src, then dst); weight: the product times scale, rounded down.

    A pair that closes a circle of better ones is in no such forest, so each task passes on the forest of what it has seen.
    """
    joined, _, kinds = _block_pairs(rows, None, key, vector, threshold, scope)
    names = ["scope", "src", "dst", "weight"]

    def run(batches):
        seen: dict[int, list[tuple[np.ndarray, ...]]] = {}
        sizes: dict[int, tuple[int, int]] = {}  # rows held, and rows at which they are reduced
        for scope, own, ia, x, _, ib, y, _ in _each_pair(batches, kinds):
            for part in _strips(x, y):
                s = x[part] @ y.T
                p, q = np.nonzero(s >= threshold)
                a, b, w = ia[part][p], ib[q], np.floor(s[p, q] * scale).astype(np.int64)
                ok = a < b if own else np.ones(len(a), bool)
                seen.setdefault(scope, []).append((np.minimum(a, b)[ok], np.maximum(a, b)[ok], w[ok]))
                held, most = sizes.get(scope, (0, HELD))
                sizes[scope] = (held + int(ok.sum()), most)
                if sizes[scope][0] > most:
                    seen[scope] = [components.forest_of(*map(np.concatenate, zip(*seen[scope])))]
                    sizes[scope] = (len(seen[scope][0][0]), max(HELD, 2 * len(seen[scope][0][0])))
        for scope in list(seen):
            src, dst, weight = components.forest_of(*map(np.concatenate, zip(*seen.pop(scope))))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(src), scope, np.int64)), pa.array(src), pa.array(dst), pa.array(weight)], names=names)

    return joined.mapInArrow(run, "scope bigint, src bigint, dst bigint, weight bigint")


def similar_pairs(left: DataFrame, right: DataFrame, key: str, vector: str, threshold: float, same: bool) -> DataFrame:
    """(src, dst, similarity): pairs with an inner product of at least threshold; same: each unordered pair of left once. Nulls match nothing."""

    def keep(s, ia, ib, own):
        p, q = np.nonzero(s >= threshold)
        if own:
            up = ia[p] < ib[q]
            p, q = p[up], q[up]
        return p, q

    return _product(left, None if same else right, key, vector, threshold, keep)


def hamming_pairs(rows: DataFrame, threshold: int, block: int = HASHES) -> DataFrame:
    """(scope, src, dst, bits): all pairs of one scope whose hashes differ in at most threshold bits (exact). rows: scope, id, words (array of 64-bit words).

    A scope is dealt into blocks; each pair of blocks is compared in a task of its own, so no task holds a scope.
    """
    parts = small_side(rows.groupBy("scope").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")))
    placed = rows.select("scope", "id", "words").join(parts, "scope").withColumn("own", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    spread = placed.select("scope", "id", "words", "own", other).select("scope", "id", "words", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def run(table: pa.Table) -> pa.Table:
        ids, own = table.column("id").to_numpy(), table.column("own").to_numpy()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        words = [np.asarray(x, np.int64).view(np.uint64) for x in table.column("words").to_pylist()]
        src, dst, bits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        h = np.array(words, np.uint64).reshape(len(words), -1)
        first, second = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        for i in first.tolist():
            d = np.bitwise_count(h[second] ^ h[i]).sum(1)
            ok = (d <= threshold) & (ids[second] > ids[i] if lo == hi else True)
            src.append(np.full(int(ok.sum()), ids[i]))
            dst.append(ids[second][ok])
            bits.append(d[ok].astype(np.int64))
        a, b = np.concatenate(src), np.concatenate(dst)
        return pa.table({"scope": [table.column("scope")[0].as_py()] * len(a), "src": np.minimum(a, b), "dst": np.maximum(a, b), "bits": np.concatenate(bits)}, schema=pa.schema([("scope", table.schema.field("scope").type), ("src", pa.int64()), ("dst", pa.int64()), ("bits", pa.int64())]))

    return spread.groupBy("scope", "lo", "hi").applyInArrow(run, f"scope {rows.schema['scope'].dataType.simpleString()}, src bigint, dst bigint, bits bigint")


def best_exemplar(candidates: DataFrame, exemplars: DataFrame, threshold: float) -> DataFrame:
    """(id, person, similarity): each candidate's most similar person, by the best of the person's exemplars. exemplars: id, embedding, person."""
    pairs = similar_pairs(candidates.select("id", "embedding"), exemplars.select("id", "embedding"), "id", "embedding", threshold, False)
    named = pairs.join(exemplars.select(F.col("id").alias("dst"), "person"), "dst").groupBy("src", "person").agg(F.max(F.round("similarity", 6)).alias("similarity"))
    best = named.groupBy(F.col("src").alias("id")).agg(F.max(F.struct("similarity", (-F.col("person")).alias("k"))).alias("b"))
    return best.select("id", (-F.col("b.k")).alias("person"), F.col("b.similarity").alias("similarity"))


def nearest_labels(queries: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """(id, label, similarity, rank): the k most similar labels of each row (ties: the first by name). labels: label, embedding.

    A blocked product: each block of labels gives its best k of a row (by rounded similarity), the best of all blocks remain.
    """
    numbered = labels.select("label", "embedding").withColumn("id", F.row_number().over(Window.orderBy("label")).cast("bigint")) if _few(labels) else labels.withColumn("id", F.xxhash64("label"))

    def keep(s, ia, ib, own):
        r = np.round(s, 6)
        if r.shape[1] <= k:
            return np.nonzero(np.ones_like(r, bool))
        least = np.partition(r, r.shape[1] - k, axis=1)[:, -k][:, None]
        return np.nonzero(r >= least)  # ties with the last one too

    scored = _product(queries.select("id", "embedding"), numbered.select("id", "embedding"), "id", "embedding", None, keep)
    named = scored.join(small_side(numbered.select(F.col("id").alias("dst"), "label")), "dst").select(F.col("src").alias("id"), "label", F.round("similarity", 6).alias("similarity"))
    return named.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "label"))).filter(F.col("rank") <= k)


def _few(labels: DataFrame) -> bool:
    return labels.limit(BLOCK + 1).count() <= BLOCK


def confident_label(ranked: DataFrame, least: float = 0.35, margin: float = 0.04) -> DataFrame:
    """(id, label, similarity, is_ambiguous): the best label if it reaches least; ambiguous if the next other label is within margin."""
    two = ranked.filter("rank <= 2").groupBy("id").agg(F.min_by("label", "rank").alias("label"), F.max("similarity").alias("similarity"), F.min(F.when(F.col("rank") == 2, F.col("similarity"))).alias("second"))
    return two.filter(F.col("similarity") >= least).select("id", "label", "similarity", F.coalesce(F.round(F.col("similarity") - F.col("second"), 6) < margin, F.lit(False)).alias("is_ambiguous"))


def sign_hash(vector: Column) -> Column:
    """The signs of the first 64 components as one 64-bit word."""
    bits = F.transform(F.slice(vector, 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def sigmoid_tags(logits: DataFrame, labels: DataFrame, top: int = 10) -> DataFrame:
    """(id, tag, score): sigmoid of each logit (clamped to 30), strictly over its label's threshold, best first. labels: pos, tag, threshold."""
    each = logits.select("id", F.posexplode("logits").alias("pos", "x")).join(small_side(labels), "pos")
    scored = each.select("id", "tag", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("x")))))).alias("score"), "threshold").filter("score > threshold")
    return scored.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "tag"))).filter(F.col("rn") <= top).select("id", "tag", F.round("score", 6).alias("score"))


def with_parents(tags: DataFrame, parents: DataFrame) -> DataFrame:
    """tags (id, tag, score) with their parents at score 0 where absent: the parents that parents (child, parent) lists for a tag, not those above them."""
    listed = parents.select(F.col("child").alias("tag"), F.col("parent").alias("up")).distinct()
    added = tags.join(listed, "tag").select("id", F.col("up").alias("tag"), F.lit(0.0).alias("score"))
    return tags.unionByName(added).groupBy("id", "tag").agg(F.max("score").alias("score"))


def softmax_tags(logits: DataFrame, labels: DataFrame, parents: DataFrame, least: float = 0.005, top: int = 10) -> DataFrame:
    """(id, tag, score): softmax over least, the top ones, and their listed parents at score 0 where absent."""
    whole = logits.withColumn("m", F.array_max("logits")).withColumn("t", F.aggregate("logits", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("m"))))
    each = whole.select("id", "m", "t", F.posexplode("logits").alias("pos", "x"))
    scored = each.join(small_side(labels.select("pos", "tag")), "pos").select("id", "tag", (F.exp(F.col("x") - F.col("m")) / F.col("t")).alias("score")).filter(F.col("score") > least)
    best = scored.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "tag"))).filter(F.col("rn") <= top).select("id", "tag", F.round("score", 6).alias("score"))
    return with_parents(best, parents)


def over_threshold(pairs: DataFrame, models: DataFrame, use: str = "suggest") -> DataFrame:
    """pairs (with similarity and model_id) that reach their model's own threshold to suggest or to cluster; models without one are left out. models: id, model_id of the src rows."""
    least = F.lit(None).cast("double")
    for name, (suggest, cluster) in THRESHOLDS.items():
        least = F.when(F.col("model_id") == name, suggest if use == "suggest" else cluster).otherwise(least)
    return pairs.join(models.select(F.col("id").alias("src"), "model_id"), "src").filter(F.col("similarity") >= least)


def iou(a: str, b: str) -> Column:
    """Overlap of two boxes (structs x, y, w, h) over their union."""
    c = lambda s, f: F.col(f"{s}.{f}")
    side = lambda p, s: F.greatest(F.lit(0.0), F.least(c(a, p) + c(a, s), c(b, p) + c(b, s)) - F.greatest(c(a, p), c(b, p)))
    inside = side("x", "w") * side("y", "h")
    return F.coalesce(F.try_divide(inside, c(a, "w") * c(a, "h") + c(b, "w") * c(b, "h") - inside), F.lit(0.0))


def drop_unlike_members(groups: DataFrame, similarity: DataFrame, least: float = 0.75) -> DataFrame:
    """Members of duplicate groups, without those whose similarity to the representative is known and below least."""
    return groups.join(similarity, ["id", "representative"], "left").filter(F.col("similarity").isNull() | (F.col("similarity") >= least))
