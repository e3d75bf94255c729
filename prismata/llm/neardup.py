"""Near-duplicates by word shingles: SimHash links, what fingerprints cannot reach, and an exact check on whole shingle sets.

A document is the set of its SHINGLE-word shingles, seen as a bitmap over their 64-bit
hashes. The bitmap is embedded as the bit counts of its segments (powers of two, about
LOAD bits each); the Manhattan distance of two embeddings never exceeds the number of
differing bits, and a similarity (Jaccard) of at least s allows (1 - s) / (1 + s) of the
bits of both to differ. The steps:

1. Equal word sequences are one node, named by a 128-bit hash, whatever the number of copies.
2. Each set has a SimHash fingerprint; fingerprints within RADIUS bits meet on the grid of
   segment popcounts of the SimHash operator, which bounds and then verifies their distance.
   Links whose sets the embeddings do not rule out stay; what they connect is a class.
3. At s = 0.8 about ten bits of a fingerprint differ, so further pairs are sought between
   classes, never within one. Each set gives its first n - ceil(s * n) + 1 shingles, rare
   ones first (by a sketch of their counts, which decides only the cost). Two sets of
   similarity s always share one, so they meet in its cell; sizes and places prune there.
4. Pairs of a small cell, and all members of a crowded one, are compared on their
   embeddings. A crowd is swept by breadth-first search, in blocks if it is very large, so
   that only a spanning set of its links leaves it; members of a class are reached together.
5. What the links of both kinds connect is compared on the whole shingle sets, by the same kind
   of sweep over verified links, in blocks of about BLOCK shingles; components of verified links are the groups.

Nothing is lost at any step: each keeps all that can be alike, and the last compares all
that is connected, so that a pair within a class needs no further link. Results do not depend
on partitions or the order of rows.

Null texts are empty; texts without words are copies of each other; a text of fewer words
is one shingle. Rows without a doc_id take part like any other and come last in their
group. Repeated rows are copies. Very long texts are sets like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismata.llm import simhash
from prismata.llm.simhash import words_of
from prismata.llm.suffixdedup import Hashes
from prismata.operators.components import connected_components
from prismata.session import materialize, scratch, small_side

SHINGLE, SIMILARITY = 5, 0.8
#: Differing bits of fingerprints that are linked.
RADIUS = 3
#: Shingles in a segment of the embedding, at most.
LOAD = 4
#: Counters of the shingle sketch (a power of two), and the slices in which tasks hand it over.
SKETCH, SLICES = 1 << 22, 64
#: Members of a cell up to which its pairs are compared one by one; members of a block of a larger one.
CROWD, CROWD_BLOCK = 8, 4096
#: Shingles in a block of a component of candidates.
BLOCK = 1 << 21
NULL_ID = -(1 << 63)
#: An odd multiplier for each word of a shingle.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_set(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the shingles of size words, rising."""
    if not words:
        return np.zeros(0, np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    h = Hashes(b"".join(words)).of(np.cumsum(sizes) - sizes, sizes) ^ mix(sizes.astype(np.uint64))
    width = min(size, len(h))
    out = h[: len(h) - width + 1] * PLACES[0]
    for k in range(1, width):
        out += h[k : len(h) - width + 1 + k] * PLACES[k]
    out = np.sort(mix(out + np.uint64(width)))
    return out[np.r_[True, out[1:] != out[:-1]]]


def content(words: list[bytes]) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join(words))


def popcounts(shingles: np.ndarray) -> np.ndarray:
    """The embedding: shingles in each of a power of two of segments, about LOAD in each; capped counts keep the bound."""
    bits = max(0, int(-(-len(shingles) // LOAD) - 1).bit_length()) if len(shingles) else 0
    segment = (shingles >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(shingles), np.int64)
    return np.minimum(np.bincount(segment, minlength=1 << bits), 255).astype(np.uint8)


def folded(pops: np.ndarray) -> np.ndarray:
    """The embedding with half as many segments (rows of a matrix)."""
    return np.minimum(pops[:, ::2].astype(np.uint16) + pops[:, 1::2], 255).astype(np.uint8)


def _texts(docs: DataFrame) -> DataFrame:
    """(k, t, text): the keys of a row, and its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("k"), F.xxhash64(text).alias("t"), text.alias("text"))


def _counters(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SKETCH - 1)).astype(np.int64)  # other bits than those of the segments


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, t, text) -> (k, t, x, n, pop, fp) of each row; then the task's sketch of shingle counts, in slices."""
    import zstandard

    names, total = ["k", "t", "x", "n", "pop", "fp", "slice", "counts"], np.zeros(SKETCH, np.uint32)
    held, size = [], 0
    for batch in batches:
        x, n, pop, fp = [], [], [], []
        for text in batch.column(2):
            words = words_of(text.as_py())
            own = shingle_set(words)
            held.append(_counters(own))
            size += len(own)
            if size > SKETCH // 2:
                np.add.at(total, np.concatenate(held), np.uint32(1))
                held, size = [], 0
            x.append(content(words))
            n.append(len(own))
            pop.append(popcounts(own).tobytes())
            fp.append(simhash.fold(own))
        rows = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary()), pa.array(n, pa.int32()), pa.array(pop, pa.binary()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
    if held:
        np.add.at(total, np.concatenate(held), np.uint32(1))
    if total.any():
        parts = [zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(p.view(np.uint8).reshape(-1, 4).T).tobytes()) for p in np.split(total, SLICES)]
        none = [pa.nulls(SLICES, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=names)


def _add_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, counts) rows of a partition -> the rank of each counter of each slice; one row at a time."""
    import zstandard

    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for which, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1).T
            own = total.setdefault(which, np.zeros(SKETCH // SLICES, np.int64))
            own += np.ascontiguousarray(raw).view("<u4").reshape(-1)
    if total:
        ranks = [np.minimum(np.round(8 * np.log2(total[k] + 1.0)), 255).astype(np.uint8).tobytes() for k in sorted(total)]
        yield pa.RecordBatch.from_arrays([pa.array(sorted(total), pa.int32()), pa.array(ranks, pa.binary())], names=["slice", "ranks"])


def shingle_ranks(measured: DataFrame) -> np.ndarray:
    """How common the shingles of each counter are: any values give right results, true ones keep common shingles out of prefixes."""
    out = np.zeros((SLICES, SKETCH // SLICES), np.uint8)
    parts = measured.filter("slice IS NOT NULL").select("slice", "counts").repartition("slice").mapInArrow(_add_sketches, "slice int, ranks binary")
    for r in parts.collect():  # SLICES rows, SKETCH bytes in all
        out[r["slice"]] = np.frombuffer(bytes(r["ranks"]), np.uint8)
    return out.reshape(-1)


def _prefixes(shared, similarity: float):
    """(k, t, text) -> (key, x, n, place): the prefix of each distinct text of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for batch in batches:
            key, x, n, place, seen = [], [], [], [], set()
            for text in batch.column(2):
                words = words_of(text.as_py())
                own = content(words)
                if own in seen:
                    continue
                seen.add(own)
                shingles = shingle_set(words)
                size = len(shingles)
                if not size:
                    continue
                length = size - int(np.ceil(similarity * size - 1e-9)) + 1
                rank = ranks[_counters(shingles)].astype(np.uint16)
                first = np.argpartition(rank, length - 1)[:length] if length < size else np.arange(size)
                if length < size:  # all below the last rank taken, and of that rank the smallest hashes
                    last = rank[first].max()
                    below, at = np.flatnonzero(rank < last), np.flatnonzero(rank == last)
                    first = np.concatenate([below, at[: length - len(below)]])
                first = first[np.lexsort((first, rank[first]))]
                key.append(shingles[first])
                x += [own] * len(first)
                n.append(np.full(len(first), size, np.int32))
                place.append(np.arange(len(first), dtype=np.int32))
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), pa.array(x, pa.binary()), pa.array(np.concatenate(n)), pa.array(np.concatenate(place))], names=["key", "x", "n", "place"])

    return run


def _may_be_alike(n, m, p, q, similarity: float):
    """Whether sizes n <= m, and places p and q of the shared shingle in the prefixes, allow the similarity."""
    most = np.minimum(p, q) + np.minimum(n - p, m - q)
    return (n >= similarity * m - 1e-6) & (most * (1 + similarity) >= similarity * (n + m) - 1e-6)


def _meet(similarity: float, crowd: int):
    """Sorted (key, n, x, place) rows -> pairs (a, b) of cells of up to crowd members; the members (cell, a, n, place) of larger ones, as they come."""
    names = ["cell", "a", "b", "n", "place"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the present cell, until it is crowded
        now, full, out, last = None, False, [], None
        pairs: set[tuple] = set()

        def close() -> None:
            for i, (n, x, p) in enumerate(held):
                for m, y, q in held[i + 1 :]:
                    if n < similarity * m - 1e-6:
                        break
                    if _may_be_alike(n, m, p, q, similarity):
                        pairs.add((x, y) if x < y else (y, x))

        for batch in batches:
            # a key of one row meets nothing
            key = batch.column(0).to_numpy()
            keys, ns, xs, ps = (c.to_pylist() for c in _shared(batch, key, now).columns)
            for k, n, x, p in zip(keys, ns, xs, ps):
                if k != now:
                    close()
                    held, now, full, last = [], k, False, None
                if x == last:
                    continue
                last = x
                if full:
                    out.append((k, x, None, n, p))
                    continue
                held.append((n, x, p))
                if len(held) > crowd:
                    out += [(k, y, None, m, q) for m, y, q in held]
                    held, full = [], True
            if len(out) + len(pairs) > 20_000:
                yield batch_of(out + [(None, a, b, None, None) for a, b in pairs])
                out, pairs = [], set()
        close()
        if out or pairs:
            yield batch_of(out + [(None, a, b, None, None) for a, b in pairs])

    return run


def _shared(batch: pa.RecordBatch, key: np.ndarray, now) -> pa.RecordBatch:
    """The rows whose key another row of the batch has, and those at the ends, which may go on in another batch."""
    if not len(key):
        return batch
    same = key[1:] == key[:-1]
    keep = np.r_[same, True] | np.r_[True, same]
    return batch.filter(pa.array(keep))


def _alike(pops: np.ndarray, n: np.ndarray, i: int, at: np.ndarray, similarity: float) -> np.ndarray:
    """Of the rows at, those whose embedding is near enough to row i's."""
    a, b = pops[at], pops[i]
    apart = (np.maximum(a, b) - np.minimum(a, b)).sum(1, dtype=np.int64)
    return apart * (1 + similarity) <= (1 - similarity) * (n[at] + n[i]) + 1e-6


def _crowds(similarity: float):
    """The members of a crowded cell (or of two of its blocks) -> links that connect what their embeddings may connect."""

    def run(table: pa.Table) -> pa.Table:
        x, pops = table.column("x").to_pylist(), table.column("pop").to_pylist()
        n, place, own = (table.column(c).to_numpy() for c in ("n", "place", "own"))
        kin = table.column("kin").combine_chunks().dictionary_encode().indices.to_numpy()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        width = np.fromiter(map(len, pops), np.int64, len(pops))
        a, b = [], []
        for size in np.unique(width).tolist():
            at = np.flatnonzero((width == size) | (width == 2 * size))
            exact = width[at] == size
            grid = np.stack([np.frombuffer(pops[j], np.uint8) if w else folded(np.frombuffer(pops[j], np.uint8)[None, :])[0] for j, w in zip(at.tolist(), exact.tolist())])
            sizes, places, blocks, of = n[at].astype(np.int64), place[at].astype(np.int64), own[at], kin[at]
            left = np.arange(len(at))
            while len(left):
                queue, left = [int(left[0])], left[1:]
                while queue and len(left):
                    i = queue.pop()
                    linked = of[left] == of[i]  # by fingerprints, so no link is needed
                    if linked.any():
                        queue += left[linked].tolist()
                        left = left[~linked]
                    low, high = np.minimum(sizes[left], sizes[i]), np.maximum(sizes[left], sizes[i])
                    first = np.where(sizes[left] <= sizes[i], places[left], places[i])
                    second = np.where(sizes[left] <= sizes[i], places[i], places[left])
                    ok = _may_be_alike(low, high, first, second, similarity) & (exact[left] | exact[i])
                    if lo != hi:
                        ok &= blocks[left] != blocks[i]
                    some = np.flatnonzero(ok)
                    some = some[_alike(grid, sizes, i, left[some], similarity)] if len(some) else some
                    if len(some):
                        got = left[some]
                        a += [x[at[i]]] * len(got)
                        b += [x[at[j]] for j in got.tolist()]
                        queue += got.tolist()
                        left = np.delete(left, some)
        return pa.table({"src": pa.array(a, pa.binary()), "dst": pa.array(b, pa.binary())})

    return run


def _near_pairs(similarity: float):
    """(a, b, n, m, pop, other) rows -> the pairs whose embeddings are near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, p, q in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                p, q = np.frombuffer(p, np.uint8)[None, :], np.frombuffer(q, np.uint8)[None, :]
                while p.shape[1] > q.shape[1]:
                    p = folded(p)
                while q.shape[1] > p.shape[1]:
                    q = folded(q)
                apart = int((np.maximum(p, q) - np.minimum(p, q)).sum(dtype=np.int64))
                keep.append(apart * (1 + similarity) <= (1 - similarity) * (n + m) + 1e-6)
            found = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([found.column(0), found.column(1)], names=["src", "dst"])

    return run


def _dealt(rows: DataFrame, group: str, node: str, blocks: DataFrame) -> DataFrame:
    """rows once for each pair of blocks of their group (own, lo, hi): every two members meet in exactly one of them, or in each if they share a block."""
    placed = rows.join(small_side(blocks), group).withColumn("own", F.pmod(F.xxhash64(node), "blocks").cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("blocks", "other")


def _within_bound(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): the pairs (a, b) of different classes whose embeddings are near enough. nodes: x, n, pop, kin."""
    side = lambda c, n, p, k: nodes.select(F.col("x").alias(c), F.col("n").alias(n), F.col("pop").alias(p), F.col("kin").alias(k))
    both = pairs.join(side("a", "n", "pop", "kin"), "a").join(side("b", "m", "other", "kind"), "b").filter("kin != kind")
    return both.select("a", "b", "n", "m", "pop", "other").mapInArrow(_near_pairs(similarity), "src binary, dst binary")


def fingerprint_links(nodes: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(src, dst): links between nodes whose SimHash fingerprints are within radius bits and whose embeddings are near enough. Nodes with one fingerprint are linked with the first of them. nodes: x, n, pop, fp."""
    some, rows = nodes.filter("n > 0"), nodes.count()
    heads = materialize(some.groupBy("fp").agg(F.min("x").alias("head")), "near-prints", rows)
    head = lambda c, x: heads.select(F.col("fp").alias(c), F.col("head").alias(x))
    met = simhash.links(heads.select("fp", F.lit(0).alias("t"), F.col("fp").alias("node")), radius, rows=rows).toDF("p", "q")
    apart = met.join(head("p", "a"), "p").join(head("q", "b"), "q").select("a", "b")
    same = some.select("fp", F.col("x").alias("b")).join(head("fp", "a"), "fp").filter("a != b").select("a", "b")
    return _within_bound(apart.unionByName(same), some.withColumn("kin", F.col("x")), similarity)


def with_kin(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """nodes with the class (kin) that the links found connect them to; a node without links is its own."""
    of = connected_components(found, rows=nodes.count()).select(F.col("node").alias("x"), F.col("component").alias("kin"))
    return nodes.join(of, "x", "left").withColumn("kin", F.coalesce("kin", "x"))


def candidates(texts: DataFrame, measured: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """(src, dst): links between nodes of different classes; whatever has at least this similarity is linked, or joined by a path of links and classes. nodes: x, n, pop, kin."""
    shared = texts.sparkSession.sparkContext.broadcast(shingle_ranks(measured))  # SKETCH bytes
    rows = nodes.count()
    spots = texts.mapInArrow(_prefixes(shared, similarity), "key bigint, x binary, n int, place int")
    sorted_ = spots.repartition("key").sortWithinPartitions("key", "n", "x", "place").select("key", "n", "x", "place")
    met = materialize(sorted_.mapInArrow(_meet(similarity, crowd), "cell bigint, a binary, b binary, n int, place int"), "near-cells", rows)
    pairs = met.filter("cell IS NULL").select("a", "b").distinct()
    few = _within_bound(pairs, nodes, similarity)
    members = met.filter("cell IS NOT NULL").select("cell", F.col("a").alias("x"), "n", "place")
    blocks = materialize(members.groupBy("cell").agg(F.ceil(F.count("*") / CROWD_BLOCK).cast("int").alias("blocks")), "near-crowds", rows)
    dealt = _dealt(members.join(nodes.select("x", "pop", "kin"), "x"), "cell", "x", blocks)
    many = dealt.groupBy("cell", "lo", "hi").applyInArrow(_crowds(similarity), "src binary, dst binary")
    return few.unionByName(many).distinct()


def _sweep(similarity: float):
    """All texts of two blocks of a component -> verified links that connect what all its alike pairs connect."""

    def run(table: pa.Table) -> pa.Table:
        x, at = np.unique(np.array(table.column("x").to_pylist(), object), return_index=True)
        texts = table.column("text").take(pa.array(at))
        sets = [shingle_set(words_of(t.as_py())) for t in texts]
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        distinct, ids, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(n)), n)
        shared = times[ids] > 1  # the others meet nothing
        ids, row = ids[shared], row[shared]
        ends = np.cumsum(np.bincount(row, minlength=len(n)))
        mark = np.zeros(len(distinct), bool)
        unseen, left = np.ones(len(n), bool), len(n)
        near_ids, near_row = ids, row  # of the members that no search has reached yet
        a, b = [], []
        for first in range(len(n)):
            if not unseen[first]:
                continue
            unseen[first], left, queue = False, left - 1, [first]
            while queue and left:
                i = queue.pop()
                own = ids[ends[i - 1] if i else 0 : ends[i]]
                mark[own] = True
                common = np.bincount(near_row[mark[near_ids]], minlength=len(n))
                mark[own] = False
                got = np.flatnonzero(unseen & (common > 0) & (common >= similarity * (n + n[i] - common) - 1e-9))
                if len(got):
                    a += [x[i]] * len(got)
                    b += x[got].tolist()
                    unseen[got] = False
                    left -= len(got)
                    queue += got.tolist()
            if 2 * unseen[near_row].sum() < len(near_row):
                keep = unseen[near_row]
                near_ids, near_row = near_ids[keep], near_row[keep]
        return pa.table({"src": pa.array(a, pa.binary()), "dst": pa.array(b, pa.binary())})

    return run


def verified_links(found: DataFrame, texts: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(src, dst): links that connect what all pairs of at least this similarity connect. found: links of fingerprint_links() and candidates(); nodes: x, n, k, t (of one row that has the text)."""
    rows = nodes.count()
    of = materialize(connected_components(found, rows=rows).withColumnRenamed("node", "x"), "near-parts", rows)
    placed = of.join(nodes.select("x", "n", "k", "t"), "x")
    blocks = materialize(placed.groupBy("component").agg(F.ceil(F.sum(F.col("n").cast("bigint")) / block).cast("int").alias("blocks")), "near-blocks", rows)
    tasks = small_side(materialize(_dealt(placed.select("x", "k", "t", "component"), "component", "x", blocks), "near-tasks", rows))
    return texts.join(tasks, ["k", "t"]).select("component", "lo", "hi", "x", "text").groupBy("component", "lo", "hi").applyInArrow(_sweep(similarity), "src binary, dst binary")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(k, t, least_k, least_t): for each distinct (doc_id, text hash) of docs the first of its group (smallest doc_id, then hash; rows without an id come last)."""
    if not 0 < similarity <= 1:
        raise ValueError("a prefix needs a similarity above 0")
    texts = _texts(docs)
    with scratch(docs.sparkSession) as tables:
        measured = materialize(texts.mapInArrow(_measure, "k bigint, t bigint, x binary, n int, pop binary, fp bigint, slice int, counts binary"), "near-measured")
        rows = measured.filter("slice IS NULL").select("k", "t", "x", "n", "pop", "fp")
        many = rows.count()
        order = F.struct((F.col("k") == NULL_ID).alias("none"), "k", "t")
        nodes = materialize(rows.groupBy("x").agg(F.min(F.struct(order.alias("o"), "n", "pop", "fp")).alias("r")).select("x", "r.o", "r.o.k", "r.o.t", "r.n", "r.pop", "r.fp"), "near-nodes", many)
        found = materialize(fingerprint_links(nodes, similarity), "near-links", many)
        kin = materialize(with_kin(nodes, found), "near-kin", many)
        links = verified_links(found.unionByName(candidates(texts, measured, kin, similarity)), texts, nodes, similarity)
        parts = materialize(connected_components(links, rows=many).withColumnRenamed("node", "x"), "near-groups", many)
        named = nodes.select("x", "o").join(parts, "x", "left").withColumn("component", F.coalesce("component", "x"))
        least = named.groupBy("component").agg(F.min("o").alias("least"))
        of = named.join(least, "component").select("x", F.col("least.k").alias("least_k"), F.col("least.t").alias("least_t"))
        return tables.keep(materialize(rows.select("k", "t", "x").distinct().join(of, "x").select("k", "t", "least_k", "least_t"), "near-classes", many))


def _id(column: str):
    return F.when(F.col(column) != NULL_ID, F.col(column))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) of every row: rows are alike if their words in order are equal or their shingle sets have at least the similarity; component_id is the smallest doc_id of the group (null if no row of it has one)."""
    of = classes(docs, similarity)
    return _texts(docs).select("k", "t").join(of, ["k", "t"]).select(_id("k").alias("doc_id"), _id("least_k").alias("component_id"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row (all its columns) of each group: that of the smallest doc_id; of rows that share it and their text, the one whose columns hash lowest."""
    of = classes(docs, similarity)
    gone = of.filter("k != least_k OR t != least_t").select("k", "t")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("k"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("t"))
    kept = keyed.join(small_side(gone), ["k", "t"], "left_anti")
    again = materialize(keyed.groupBy("k", "t").agg(F.count("*").alias("m")).filter("m > 1").select("k", "t"), "near-again")
    if not again.isEmpty():  # repeated rows: pre-aggregated, so a row that makes up much of the table is no burden
        repeated = small_side(again)
        once = kept.join(repeated, ["k", "t"], "left_semi").groupBy("k", "t").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        kept = kept.join(repeated, ["k", "t"], "left_anti").select("row").unionByName(once.select("row"))
    return kept.select("row.*")
