"""SimHash near-dedup by segment popcounts.

A fingerprint is embedded as the bit counts of its segments (two bits each). Flipping one
bit moves one coordinate by one, so the Manhattan distance of two embeddings never exceeds
the Hamming distance of the fingerprints. A pair within ``radius`` bits is within
radius // 2 in one of the two halves of the embedding, hence within one for radius 3: each
distinct fingerprint stands in the grid cell of each half, and is shown in the cells one
step up along each coordinate (of two cells one step apart, one is always the upper).
Pairs that meet in a cell pass the Manhattan bound on the whole embedding, and are then
verified exactly.

Equal fingerprints are one node before any join, so groups of exact copies never make
pairs. A crowded cell is not expanded into all pairs either: the cell's members are swept
by breadth-first search over a shrinking list, which gives a spanning set of links with
the same components. The members of a cell beyond CROWDED pass on to finer cells: of a pair
that is within one in a half, at most three bits differ in the other, so in one of its
quarters at most one, and the grid repeats on the quarters. Components come from operators.components (distributed).

Null and empty texts have no words and fingerprint zero, linked like any other. Repeated
rows and repeated doc_ids keep their rows. Rows with a null doc_id keep their row, and are
never the smallest id of a component unless it has no other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismata.operators.components import connected_components
from prismata.session import materialize

UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
#: Members up to which all pairs of a cell are compared at once.
CELL = 64
#: Members beyond which a cell is cut into finer ones.
CROWDED = 1 << 15


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words; bytes.split() splits at exactly the six ASCII white-space bytes."""
    return (text or "").encode().translate(UPPER).split()


def shingle_hashes(text: str | None, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of size words, space-joined (fewer words: the whole sequence; none: nothing)."""
    import xxhash

    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(words) - size])).tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())], np.uint64)


def fold(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):  # bounds the unpacked bits of a very long text
        ones += np.unpackbits(hashes[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, features: Callable[[str | None], list[int]], n: int = 1) -> DataFrame:
    """doc_id and n 64-bit fingerprints (array of bigint) of every row. features: text -> n fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([features(t.as_py()) for t in batch.column(1)], np.uint64).reshape(-1, n)
            lists = pa.ListArray.from_arrays(np.arange(0, n * len(fp) + 1, n, dtype=np.int32), pa.array(fp.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "fps"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fps array<bigint>")


#: Bit positions: segment k holds bits 2k and 2k + 1; half 0 is segments 0 to 15.
EVEN, THREES = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333)


def popcounts(fp: np.ndarray) -> np.ndarray:
    """The embedding: 32 two-bit fields, each the bit count of its segment."""
    return (fp & EVEN) + ((fp >> np.uint64(1)) & EVEN)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of embeddings, field by field: |x - y| of numbers 0 to 2."""
    total = np.zeros(np.broadcast(a, b).shape, np.int64)
    for mask in (THREES, ~THREES & np.uint64(0xFFFFFFFFFFFFFFFF)):
        shift = np.uint64(0 if mask == THREES else 2)
        x, y = (a & mask) >> shift, (b & mask) >> shift
        guard = np.uint64(0x4444444444444444)
        d = (x | guard) - y  # 4 + x - y in each four-bit field, 2 to 6
        low = (~d & guard) >> np.uint64(2)  # 1 where x < y
        diff = d & THREES
        diff = (diff ^ (low * np.uint64(3))) + low  # two's complement where negative
        diff &= np.uint64(0x7777777777777777)
        total += np.bitwise_count(diff & np.uint64(0x1111111111111111)).astype(np.int64) + 2 * np.bitwise_count((diff >> np.uint64(1)) & np.uint64(0x1111111111111111))
    return total


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, table, node) -> (cell, home, fp, node): two home cells each, and every cell one step up."""
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        table = batch.column(1).to_numpy().astype(np.uint64)
        node = batch.column(2).to_numpy()
        emb = popcounts(fp)
        cell, home, own, of = [], [], [], []
        for half in range(2):
            base = (emb >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
            key = base | np.uint64(half << 32) | (table << np.uint64(33))
            cell.append(key)
            home.append(np.ones(len(fp), np.int32))
            own.append(fp)
            of.append(node)
            for k in range(16):
                up = ((base >> np.uint64(2 * k)) & np.uint64(3)) < 2
                cell.append(key[up] + np.uint64(1 << (2 * k)))
                home.append(np.zeros(int(up.sum()), np.int32))
                own.append(fp[up])
                of.append(node[up])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell).view(np.int64)), pa.array(np.concatenate(home)), pa.array(np.concatenate(own).view(np.int64)), pa.array(np.concatenate(of))], names=["cell", "home", "fp", "node"])


def near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """The Manhattan bound first, then the exact distance."""
    ok = manhattan(popcounts(a), popcounts(b)) <= radius
    ok[ok] = np.bitwise_count(np.broadcast_to(a, ok.shape)[ok] ^ np.broadcast_to(b, ok.shape)[ok]) <= radius
    return ok


def _sweep(fp: np.ndarray, home: np.ndarray, node: np.ndarray, radius: int, full: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the near pairs of one cell connect (a pair counts if at each level one of the two is at home)."""
    left = np.arange(len(fp))
    a, b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            ok = near(fp[i], fp[left], radius) & ((home[i] | home[left]) == full)
            got = left[ok]
            if len(got):
                a.append(np.full(len(got), node[i]))
                b.append(node[got])
                queue += got.tolist()
                left = left[~ok]
    empty = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _links(radius: int, crowd: int, full: int, most: int | None):
    """Sorted (cell, home, fp, node) rows -> linked pairs of nodes (a, b); the members (cell, home, fp, node) of cells of more than `most`, as they come."""
    names = ["a", "b", "cell", "home", "fp", "node"]

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        none = [pa.nulls(len(a), t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *none], names=names)

    def members(cell, home, fp, node) -> pa.RecordBatch:
        none = pa.nulls(len(cell), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(cell), pa.array(home.astype(np.int32)), pa.array(fp.view(np.int64)), pa.array(node)], names=names)

    def cells(cell, home, fp, node):
        out_a, out_b = [], []
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sizes = np.diff(np.r_[starts, len(cell)])
        for s, n in zip(starts[sizes > crowd].tolist(), sizes[sizes > crowd].tolist()):
            a, b = _sweep(fp[s : s + n], home[s : s + n], node[s : s + n], radius, full)
            out_a.append(a)
            out_b.append(b)
        keep = np.repeat(sizes <= crowd, sizes) & np.repeat(sizes > 1, sizes)
        cell, home, fp, node = cell[keep], home[keep], fp[keep], node[keep]
        for lag in range(1, crowd):
            at = np.flatnonzero(cell[lag:] == cell[:-lag]) if lag < len(cell) else []
            if not len(at):
                break
            at = at[(home[at] | home[at + lag]) == full]
            ok = near(fp[at], fp[at + lag], radius)
            out_a.append(node[at[ok]])
            out_b.append(node[at[ok] + lag])
        return pairs(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # pieces of the last cell, which may go on
        size, passing = 0, None  # its rows so far; the cell whose members pass on
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy()]
            if passing is not None:
                on = int(np.searchsorted(new[0], passing, "right"))
                if on:
                    yield members(*[x[:on] for x in new])
                    new = [x[on:] for x in new]
                if not len(new[0]):
                    continue
                passing = None
            first = int(np.searchsorted(new[0], new[0][-1]))  # where the batch's last cell begins
            if first or (held and held[0][0][0] != new[0][0]):
                whole = [np.concatenate(x) for x in zip(*held, [x[:first] for x in new])] if held else [x[:first] for x in new]
                if len(whole[0]):
                    yield cells(*whole)
                held, size = [], 0
            held.append([x[first:] for x in new])
            size += len(held[-1][0])
            if most is not None and size > most:
                passing = int(new[0][-1])
                yield members(*[np.concatenate(x) for x in zip(*held)])
                held, size = [], 0
        if held:
            yield cells(*[np.concatenate(x) for x in zip(*held)])

    return run


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of crowded cells -> finer cells: with each quarter of the other half, where again one of two quarters is within one, at home and one step up."""
    for batch in batches:
        cell, home = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        fp, node = batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy()
        other = np.uint64(32) * (np.uint64(1) - ((cell.view(np.uint64) >> np.uint64(32)) & np.uint64(1)))
        emb = popcounts(fp) >> other
        out: list[list[np.ndarray]] = [[], [], [], []]

        def put(key: np.ndarray, at: np.ndarray, flag: int) -> None:
            out[0].append(_mixed(cell[at].view(np.uint64), key))
            out[1].append(home[at] | flag)
            out[2].append(fp[at])
            out[3].append(node[at])

        for q in range(2):
            base = ((emb >> np.uint64(16 * q)) & np.uint64(0xFFFF)) | np.uint64(q << 16)
            put(base, np.arange(len(fp)), 2)
            for k in range(8):
                up = np.flatnonzero(((base >> np.uint64(2 * k)) & np.uint64(3)) < 2)
                put(base[up] + np.uint64(1 << (2 * k)), up, 0)
        key, flags, fps, nodes = (np.concatenate(x) for x in out)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(flags.astype(np.int32)), pa.array(fps.view(np.int64)), pa.array(nodes)], names=["cell", "home", "fp", "node"])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit key of two numbers; what shares it by chance is compared and told apart."""
    x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def links(prints: DataFrame, radius: int = 3, crowd: int = CELL, most: int = CROWDED, rows: int | None = None) -> DataFrame:
    """(a, b): links between nodes whose fingerprints of one table are within radius; in each cell they connect all that are. prints: fp, t, node. rows: about how many there are."""
    if radius > 3:
        raise ValueError("two halves bound a half's distance by one up to radius 3")
    cells, met = "cell bigint, home int, fp bigint, node bigint", "a bigint, b bigint, cell bigint, home int, fp bigint, node bigint"
    dealt = lambda spots: spots.repartition("cell").sortWithinPartitions("cell", "node", "fp", "home")
    spots = prints.select("fp", "t", "node").mapInArrow(_cells, cells)
    first = materialize(dealt(spots).mapInArrow(_links(radius, crowd, 1, most), met), "simhash-cells", rows)
    crowded = first.filter("cell IS NOT NULL").select("cell", "home", "fp", "node")
    finer = dealt(crowded.mapInArrow(_finer, cells)).mapInArrow(_links(radius, crowd, 3, None), met)
    return first.select("a", "b").unionByName(finer.select("a", "b")).filter("a != b").distinct()


def op6_fingerprint(text: str | None) -> list[int]:
    return [fold(shingle_hashes(text, 3))]


def classify(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    prints = materialize(fingerprints(docs, op6_fingerprint).select("doc_id", F.col("fps")[0].alias("fp")), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = materialize(links(nodes.select("fp", F.lit(0).alias("t"), F.col("fp").alias("node")), radius), "simhash-links")
    parts = connected_components(found.withColumnRenamed("a", "src").withColumnRenamed("b", "dst"))
    # of each linked fingerprint's component, the smallest id; lone fingerprints are their own component
    named = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(smallest, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(classes, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def op6_simhash(spark, sf_dir):
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
