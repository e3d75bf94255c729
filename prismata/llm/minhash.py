"""MinHash near-dedup: an inverted join over signature coordinates, confirmed on whole shingle sets.

A document is the set of its distinct shingles (64-bit hashes); equal sets are one node,
whatever the number of copies. A signature has COORDINATES minima of independent hash
functions; two sets agree in a coordinate with the probability of their similarity.

1. Prefix merging: a node is posted under the coordinate-value pairs of its signature, rare
   ones first (by a sketch of their counts, which decides only the cost). Two signatures
   that agree in MATCHES coordinates share a pair among the first COORDINATES - MATCHES + 1
   of each, so the others, the longest lists of all, are skipped.
2. Nodes that meet in a list are compared on the rest of their signatures (four bits of each
   coordinate, so nothing that agrees is missed): what agrees in MATCHES coordinates is a candidate. Lists of over CROWD nodes
   are not expanded into pairs, but swept (below).
3. Candidates' components are swept once more, now on the whole shingle sets: only links
   that the sets confirm stay, and their components are the classes.

A sweep (connect()) is a breadth-first search that makes a spanning set of links, not all
pairs. A group that is too large for one task is dealt into slices. Each slice is swept by itself
and with LEADERS nodes of the whole group, which joins the slices' classes; only the nodes
outside the group's largest class then meet the other slices. So rows copied grow with the
group, and with the square of a group only as far as it has no common class.

A pair of the required similarity 0.85 is missed if its signatures agree in under 28 of 64
coordinates: the probability is below 3e-13. (Of two classes joined by many links each
link would have to be missed.) Every confirmed link is exact, but for equal 64-bit hashes of two
different shingles of one pair.

Edge cases: null texts and texts without words are empty sets, linked with nothing; fewer
words than a shingle are one shingle. Repeated rows and shared doc_ids keep their rows. Rows
without a doc_id take part; their class is named by its smallest doc_id, null if it has none (they
are then kept). Very long texts are sets like any other. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismata.llm.neardup import NULL_ID, SKETCH, SLICES, mix, shingle_ranks, shingle_set
from prismata.llm.simhash import words_of
from prismata.operators.components import connected_components
from prismata.session import materialize, scratch

SHINGLE = 3
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 85
COORDINATES, MATCHES = 64, 28
#: Nodes of a list up to which its pairs are compared one by one.
CROWD = 32
#: Nodes of a list, and shingles of a component, that one task sweeps.
LIST_SLICE, SET_SLICE = 4096, 1 << 21
#: Nodes of a sliced group that are swept with each of its slices.
LEADERS = 8
#: Shingles hashed at once.
CHUNK = 4096
_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FLIP, TIMES = _SEEDS[:COORDINATES], _SEEDS[COORDINATES:] | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES 32-bit minima of a set that is not empty."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        h = (shingles[at : at + CHUNK, None] ^ FLIP) * TIMES
        np.minimum(least, (h ^ (h >> np.uint64(29))).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def pairs_of(sig: np.ndarray) -> np.ndarray:
    """The coordinate-value pairs of a signature as numbers."""
    return (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)) | sig.astype(np.uint64)


def briefs(sig: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, two coordinates a byte (rows of a matrix)."""
    low = sig.astype(np.uint8) & 15
    return low[:, ::2] | low[:, 1::2] << 4


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many coordinates the briefs of a (rows) agree with b."""
    apart = a ^ b
    return np.count_nonzero(apart & 15 == 0, axis=1) + np.count_nonzero(apart < 16, axis=1)


def counters(pairs: np.ndarray) -> np.ndarray:
    return (mix(pairs) & np.uint64(SKETCH - 1)).astype(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    """(k, t, text): the keys of a row, and its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("k"), F.xxhash64(text).alias("t"), text.alias("text"))


MEASURED = "k bigint, t bigint, x binary, n bigint, sig binary, slice int, counts binary"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, t, text) -> (k, t, x, n, sig) of each row, x null for an empty set; then the task's sketch of pair counts, in slices."""
    import xxhash
    import zstandard

    names = [c.split()[0] for c in MEASURED.split(", ")]
    total, seen = np.zeros(SKETCH, np.uint32), False
    for batch in batches:
        x, n, sig = [], [], []
        for text in batch.column(2):
            own = shingle_set(words_of(text.as_py()), SHINGLE)
            n.append(len(own))
            if len(own):
                x.append(xxhash.xxh3_128_digest(own.tobytes()))
                sig.append(signature(own))
                total[counters(pairs_of(sig[-1]))] += 1  # one node's counters; that two of them fall together changes little
            else:
                x.append(None)
                sig.append(None)
        seen = seen or any(s is not None for s in sig)
        rows = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary()), pa.array(n, pa.int64()), pa.array([s if s is None else s.tobytes() for s in sig], pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
    if seen:
        parts = [zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(p.view(np.uint8).reshape(-1, 4).T).tobytes()) for p in np.split(total, SLICES)]
        none = [pa.nulls(SLICES, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=names)


def _posts(shared, matches: int):
    """(x, n, sig) -> (key, x, n, brief): the prefix of each signature, and its brief."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, length = shared.value, COORDINATES - matches + 1
        for batch in batches:
            rows = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(rows, COORDINATES)
            pairs = (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)) | sig
            order = ranks[counters(pairs)].astype(np.uint64) << np.uint64(48) | (mix(pairs) >> np.uint64(16))  # one order for all signatures
            first = np.take_along_axis(pairs, np.argsort(order, axis=1)[:, :length], 1)
            brief = pa.array([b.tobytes() for b in briefs(sig)], pa.binary())
            again = pa.array(np.repeat(np.arange(rows), length))
            yield pa.RecordBatch.from_arrays([pa.array(first.reshape(-1).astype(np.int64)), batch.column(0).take(again), batch.column(1).take(again), brief.take(again)], names=["key", "x", "n", "brief"])

    return run


def _sized(n, m):
    """Whether sizes allow the similarity: 100 * the smaller >= PERCENT * the larger."""
    return 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)


def _meet(matches: int, crowd: int):
    """Sorted (key, x, n, brief) -> candidate pairs (a, b) of lists of up to crowd nodes; the members (cell, a, n, brief) of longer ones, as they come."""
    names, types = ["cell", "a", "b", "n", "brief"], (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, full, out = None, False, []
        pairs: set[tuple] = set()

        def close() -> None:
            if len(held) < 2:
                return
            x, n = [r[0] for r in held], np.array([r[1] for r in held])
            brief = np.frombuffer(b"".join(r[2] for r in held), np.uint8).reshape(len(held), -1)
            for i in range(len(held) - 1):
                ok = _sized(n[i + 1 :], n[i]) & (agreeing(brief[i + 1 :], brief[i]) >= matches)
                pairs.update((x[i], x[j]) if x[i] < x[j] else (x[j], x[i]) for j in (np.flatnonzero(ok) + i + 1).tolist())

        for batch in batches:
            key = batch.column(0).to_numpy()
            if not len(key):
                continue
            same = key[1:] == key[:-1]  # a list of one node meets nothing; those at the ends may go on in another batch
            for k, x, n, brief in zip(*(c.to_pylist() for c in batch.filter(pa.array(np.r_[same, True] | np.r_[True, same])).columns)):
                if k != now:
                    close()
                    held, now, full = [], k, False
                if full:
                    out.append((k, x, None, n, brief))
                    continue
                held.append((x, n, brief))
                if len(held) > crowd:
                    out += [(k, y, None, m, b) for y, m, b in held]
                    held, full = [], True
            if len(out) + len(pairs) > 20_000:
                yield batch_of(out + [(None, a, b, None, None) for a, b in pairs])
                out, pairs = [], set()
        close()
        if out or pairs:
            yield batch_of(out + [(None, a, b, None, None) for a, b in pairs])

    return run


class Members:
    """Nodes of a task, in order of x: briefs of their signatures and, for the exact comparison, their shingle sets."""

    def __init__(self, table: pa.Table, matches: int):
        ids = np.array(table.column("x").to_pylist(), object)
        self.x, at = np.unique(ids, return_index=True)
        self.at, self.matches = at, matches
        self.n = table.column("n").to_numpy()[at].astype(np.int64)
        self.brief = np.frombuffer(b"".join(table.column("brief").take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
        self.ids = None
        if "text" in table.column_names:
            sets = [shingle_set(words_of(t.as_py()), SHINGLE) for t in table.column("text").take(pa.array(at))]
            self.starts = np.cumsum([0, *map(len, sets)])
            values, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
            self.mark = np.zeros(len(values), bool)

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that are alike node i."""
        ok = others[_sized(self.n[others], self.n[i])]
        ok = ok[agreeing(self.brief[ok], self.brief[i]) >= self.matches]
        if self.ids is None or not len(ok):
            return ok
        own = self.ids[self.starts[i] : self.starts[i + 1]]
        self.mark[own] = True
        common = np.array([np.count_nonzero(self.mark[self.ids[self.starts[j] : self.starts[j + 1]]]) for j in ok.tolist()])
        self.mark[own] = False
        return ok[100 * common >= PERCENT * (self.n[ok] + self.n[i] - common)]


def _links(a: list, b: list) -> pa.Table:
    return pa.table({"src": pa.array(a, pa.binary()), "dst": pa.array(b, pa.binary())})


def _sweep(matches: int):
    """The members of a slice -> links that connect what its alike pairs connect."""

    def run(table: pa.Table) -> pa.Table:
        m = Members(table, matches)
        left, a, b = np.arange(len(m.x)), [], []
        while len(left):
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                i = queue.pop()
                got = m.near(i, left)
                if len(got):
                    a += [m.x[i]] * len(got)
                    b += m.x[got].tolist()
                    queue += got.tolist()
                    left = np.setdiff1d(left, got, assume_unique=True)
        return _links(a, b)

    return run


def _across(matches: int):
    """Nodes of a slice of the rest (rest) and nodes of a slice of the group, with their classes so far -> links between different classes."""

    def run(table: pa.Table) -> pa.Table:
        m = Members(table, matches)
        rest = np.zeros(len(m.x), bool)
        rest[np.searchsorted(m.x, np.array(table.filter(table.column("rest")).column("x").to_pylist(), object))] = True
        _, of = np.unique(np.array(table.column("class").take(pa.array(m.at)).to_pylist(), object), return_inverse=True)
        a, b = [], []
        for i in np.flatnonzero(rest).tolist():
            while True:
                got = m.near(i, np.flatnonzero(of != of[i]))
                if not len(got):
                    break
                _, first = np.unique(of[got], return_index=True)  # one link for each class
                got = got[first]
                a += [m.x[i]] * len(got)
                b += m.x[got].tolist()
                of[np.isin(of, of[got])] = of[i]
        return _links(a, b)

    return run


LINKS = "src binary, dst binary"


def connect(members: DataFrame, most: int, matches: int, known: DataFrame | None = None, texts: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """(src, dst): links that connect what the alike pairs of each group connect.

    members: grp, x, n, brief, w (its share of a task). most: the sum of w that a task takes.
    known: links found elsewhere, which need not be found again. texts: adds the text to rows
    that have x, for the comparison of whole sets.
    """
    members = materialize(members, "minhash-members")
    sizes = materialize(members.groupBy("grp").agg(F.ceil(F.sum("w") / most).cast("int").alias("slices")), "minhash-slices")
    columns, spot = ["grp", "x", "n", "brief"], F.xxhash64("x", F.lit(1))
    placed = members.join(sizes, "grp").withColumn("s", F.pmod(F.xxhash64("x"), "slices").cast("int"))
    large = placed.filter("slices > 1")
    pick = F.struct(spot.alias("h"), *columns, "slices", F.col("s").alias("home"))
    leaders = large.groupBy("grp", F.pmod(spot, F.lit(LEADERS)).alias("seat")).agg(F.min(pick).alias("p")).select("p.*")
    leaders = leaders.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).filter("s != home")
    tasks = placed.select(*columns, "s").unionByName(leaders.select(*columns, "s"))
    links = materialize(texts(tasks).groupBy("grp", "s").applyInArrow(_sweep(matches), LINKS), "minhash-links")
    if sizes.filter("slices > 1").isEmpty():
        return links
    classes = connected_components(links if known is None else links.unionByName(known)).select(F.col("node").alias("x"), F.col("component").alias("class"))
    classed = materialize(large.select(*columns, "s", "slices", "w").join(classes, "x", "left").withColumn("class", F.coalesce("class", "x")), "minhash-classes")
    counted = classed.groupBy("grp", "class").agg(F.count("*").alias("m"))
    largest = counted.groupBy("grp").agg(F.max(F.struct("m", "class")).alias("most")).select("grp", F.col("most.class").alias("main"))
    rest = classed.join(largest, "grp").filter(F.col("class") != F.col("main"))
    shares = materialize(rest.groupBy("grp").agg(F.ceil(F.sum("w") / most).cast("int").alias("shares")), "minhash-shares")
    every = classed.join(shares, "grp").withColumn("r", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select(*columns, "class", "r", "s", F.lit(False).alias("rest"))
    few = rest.join(shares, "grp").withColumn("r", F.pmod(spot, "shares").cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(*columns, "class", "r", "s", F.lit(True).alias("rest"))
    return links.unionByName(texts(every.unionByName(few)).groupBy("grp", "r", "s").applyInArrow(_across(matches), LINKS))


def candidates(measured: DataFrame, nodes: DataFrame, matches: int = MATCHES, crowd: int = CROWD, most: int = LIST_SLICE) -> DataFrame:
    """(src, dst): links that connect all nodes whose signatures agree in `matches` coordinates. nodes: x, n, sig."""
    shared = nodes.sparkSession.sparkContext.broadcast(shingle_ranks(measured))  # SKETCH bytes
    posts = nodes.select("x", "n", "sig").mapInArrow(_posts(shared, matches), "key bigint, x binary, n bigint, brief binary")
    sorted_ = posts.repartition("key").sortWithinPartitions("key", "x")
    met = materialize(sorted_.mapInArrow(_meet(matches, crowd), "cell bigint, a binary, b binary, n bigint, brief binary"), "minhash-lists")
    few = met.filter("cell IS NULL").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    long = met.filter("cell IS NOT NULL").select(F.col("cell").alias("grp"), F.col("a").alias("x"), "n", "brief", F.lit(1).cast("bigint").alias("w"))
    return few.unionByName(connect(long, most, matches, few)).distinct()


def _brief(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, x, n, sig) -> (grp, x, n, brief)."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(-1, COORDINATES)
        brief = [b.tobytes() for b in briefs(sig)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(brief, pa.binary())], names=["grp", "x", "n", "brief"])


def confirmed(found: DataFrame, texts: DataFrame, nodes: DataFrame, matches: int = MATCHES, most: int = SET_SLICE) -> DataFrame:
    """(src, dst): links that connect what all alike sets connect. found: candidates(); nodes: x, n, sig, k, t (of one row that has the text)."""
    parts = materialize(connected_components(found).select(F.col("component").alias("grp"), F.col("node").alias("x")), "minhash-parts")
    placed = parts.join(nodes.select("x", "n", "sig", "k", "t"), "x")
    keys = placed.select("x", "k", "t")
    # repeated rows give their text once
    whole = materialize(texts.join(keys, ["k", "t"]).groupBy("x").agg(F.first("text").alias("text")), "minhash-texts")
    members = placed.select("grp", "x", "n", "sig").mapInArrow(_brief, "grp binary, x binary, n bigint, brief binary")
    return connect(members.withColumn("w", F.col("n")), most, matches, texts=lambda rows: rows.join(whole, "x"))


def classify(docs: DataFrame, matches: int = MATCHES, crowd: int = CROWD, most: int = LIST_SLICE, most_shingles: int = SET_SLICE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    texts = _texts(docs)
    with scratch(docs.sparkSession) as tables:
        measured = materialize(texts.mapInArrow(_measure, MEASURED), "minhash-measured")
        rows = measured.filter("slice IS NULL").select("k", "t", "x", "n", "sig")
        order = F.struct((F.col("k") == NULL_ID).alias("none"), "k", "t", "n", "sig")
        nodes = rows.filter("x IS NOT NULL").groupBy("x").agg(F.min(order).alias("r")).select("x", "r.k", "r.t", "r.n", "r.sig")
        nodes = materialize(nodes, "minhash-nodes")
        found = materialize(candidates(measured, nodes, matches, crowd, most), "minhash-candidates")
        parts = connected_components(confirmed(found, texts, nodes, matches, most_shingles))
        named = nodes.select("x", "k").join(parts.select(F.col("node").alias("x"), "component"), "x", "left").withColumn("component", F.coalesce("component", "x"))
        named = materialize(named, "minhash-named")
        least = named.groupBy("component").agg(F.min(F.when(F.col("k") != NULL_ID, F.col("k"))).alias("least"))
        of = named.join(least, "component").select("x", "least")
        doc = F.when(F.col("k") != NULL_ID, F.col("k"))
        out = rows.select("k", "x", "n").join(of, "x", "left").select(doc.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("x").isNull(), doc).otherwise(F.col("least")).alias("component_id"))
        return tables.keep(materialize(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())), "minhash"))


def op11_minhash(spark, sf_dir):
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
