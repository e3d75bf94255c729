"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that starts anywhere else go.

Exact, in four steps:

1. Sampling. Each window of LENGTH bytes is named by the smallest hash of its GRAM-byte
   strings. Equal windows have equal names. Consecutive windows with one name are a segment;
   a name of one segment that holds its string once proves the segment's windows unique.
2. Equal segments (name and 128-bit digest of the bytes) are repeated throughout: whole groups of exact
   copies end here, without any comparison, whatever their size.
3. The remaining distinct segments that share a name go together, at most CUT windows
   each. Column-wise multi-document construction, as in BCR (Bauer, Cox, Rosone, "Lightweight
   algorithms for constructing and inverting the BWT of string collections"): each segment
   is read in STEP phases (counted from its name's place, so that each phase is a collection
   of its own), whose symbols are STEP-byte chunks; every round inserts one
   symbol of each string, from the right end, into the suffix order of the collection (the
   transform in its inverse form: first symbol and rank of the rest), which is merged
   sequentially, in a file once it exceeds IN_MEMORY entries. There are at most
   (LENGTH + CUT) / STEP rounds, whatever the length of the documents; full-length
   documents would need one round for each of their bytes over the whole collection.
   Common prefixes are read from the finished order by doubling; a suffix that shares
   LENGTH / STEP symbols with a neighbour is the start of a repeated window.
4. Spans meet by document and are cut out.

Names shared by more than HOT distinct segments are split by the distance from a window to
its name's place in it, which equal windows share.

Null texts are empty; texts shorter than LENGTH lose nothing and have no windows. Rows are
keyed by doc_id and content, so repeated rows and repeated or null doc_ids keep their rows;
equal rows count as occurrences of each other. Other columns are kept by strip().
"""

from __future__ import annotations

import functools
import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismata.session import materialize

LENGTH = 400
STEP = 16
#: Most windows in a segment.
CUT = 368
#: Distinct segments of one name beyond which the name is split, into at most SPLITS parts.
HOT, SPLITS = 2_000, 256
#: Bytes of segments that are ordered together, and entries beyond which the order lives in a file.
BATCH, IN_MEMORY = 2 << 20, 16 << 20
#: Rows that are digested at a time.
DIGESTED = 1_000
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
NULL_ID = -(1 << 63)


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """A 64-bit number for each byte."""
    x = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


@functools.lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(17, int(n).bit_length()))[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Polynomial hashes of the substrings of a text."""

    def __init__(self, text: bytes):
        x = np.frombuffer(text, np.uint8)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_letters()[x] * powers(BASE, len(x)), out=self.sums[1:])

    def of(self, start, size) -> np.ndarray:
        """Hash of the size bytes from each start (arrays or a range)."""
        inverse = powers(INVERSE, len(self.sums))
        return mix((self.sums[start + size] - self.sums[start]) * inverse[start])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * powers(INVERSE, len(self.sums))[:n])


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive values: prefix and suffix minima of blocks."""
    n = len(v) - width + 1
    padded = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    grid = padded.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def gram_size(length: int) -> int:
    return max(length // 4, 8)


def segments(text: bytes, length: int) -> tuple[np.ndarray, ...] | None:
    """(first window, number of windows, name, digest of the bytes, whether the name's string is there twice) of each segment."""
    import xxhash

    if len(text) < length:
        return None
    h, gram = Hashes(text), gram_size(length)
    grams = h.grams(gram)
    name = sliding_min(grams, length - gram + 1)
    starts = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
    sizes = np.diff(np.r_[starts, len(name)])
    pieces = -(-sizes // CUT)
    if pieces.max() > 1:
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        cut = np.repeat(starts, pieces) + within * CUT
        sizes = np.minimum(CUT, np.repeat(starts + sizes, pieces) - cut)
        starts = cut
    digest, ends = xxhash.xxh3_128_digest, (starts + sizes + (length - 1)).tolist()
    content = np.array([digest(text[a:b]) for a, b in zip(starts.tolist(), ends)], object)
    return starts, sizes, name[starts], content, _again(grams, name[starts], starts, sizes + (length - gram))


def _again(grams: np.ndarray, names: np.ndarray, starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Whether each segment holds its name's string more than once: only then can it repeat a window by itself."""
    low = np.uint64(0xFFFF)
    seen = np.zeros(1 << 16, bool)
    seen[(names & low).astype(np.int64)] = True
    places = np.flatnonzero(seen[(grams & low).astype(np.int64)])
    kinds, of = np.unique(np.r_[grams[places], names], return_inverse=True)
    n = len(grams) + 1
    keys = np.sort(of[: len(places)].astype(np.int64) * n + places)
    own = of[len(places) :].astype(np.int64) * n + starts
    return np.searchsorted(keys, own + widths) - np.searchsorted(keys, own) > 1


def _segment_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = []
            for i, t in enumerate(batch.column(2)):
                got = segments(t.as_py().encode(), length)
                if got:
                    found.append((np.full(len(got[0]), ids[i]), np.full(len(got[0]), keys[i]), *got))
            if found:
                k1, k2, s, n, name, content, again = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, s.astype(np.int32), n.astype(np.int32), name.view(np.int64))] + [pa.array(content, pa.binary()), pa.array(again)], names=["k1", "k2", "s", "n", "h", "c", "again"])

    return run


def _cut_rows(length: int):
    """Documents with their open segments -> the bytes of each, by name (and distance, for hot names)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = gram_size(length)
        for batch in batches:
            out: list[tuple] = []
            for k1, k2, text, segs in zip(*(batch.column(i) for i in range(4))):
                raw, k1, k2 = text.as_py().encode(), k1.as_py(), k2.as_py()
                for seg in segs.as_py():
                    s, n, name, parts = seg["s"], seg["n"], seg["h"], seg["parts"]
                    here = raw[s : s + n + length - 1]
                    places = np.flatnonzero(Hashes(here).grams(gram).view(np.int64) == name)
                    place = -1 if seg["again"] else int(places[0])
                    if parts <= 1:
                        out.append((name, k1, k2, s, place, here))
                        continue
                    away = places[np.searchsorted(places, np.arange(n))] - np.arange(n)
                    part = away * parts // (length - gram + 1)
                    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
                    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                        g = int(mix(np.array([name], np.int64).view(np.uint64) ^ np.uint64(part[a] + 1)).view(np.int64)[0])
                        out.append((g, k1, k2, s + a, place - a if place >= 0 else -1, here[a : b + length - 1]))
                if len(out) > 5000:
                    yield _cut_batch(out)
                    out = []
            if out:
                yield _cut_batch(out)

    return run


def _cut_batch(out: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["g", "k1", "k2", "s", "place", "body"])


class Order:
    """The suffix order of a growing collection: first symbol and rank of the rest of each suffix, merged sequentially."""

    def __init__(self, strings: int, folder: str | None):
        # every string's empty suffix comes first, in order of the strings
        self.folder, self.turn = folder, 0
        self.first = np.full(strings, -1, np.int32)
        self.rest = np.arange(strings, dtype=np.int32)
        self.origin = np.arange(strings, dtype=np.int32)  # the string of each suffix
        self.size = np.zeros(strings, np.int16)  # its length in symbols

    def _space(self, n: int, kind) -> np.ndarray:
        if self.folder is None or n <= IN_MEMORY:
            return np.empty(n, kind)
        self.turn += 1
        return np.memmap(tempfile.TemporaryFile(dir=self.folder), kind, "w+", shape=(n,))

    def insert(self, symbol: np.ndarray, rank: np.ndarray, string: np.ndarray, length: int) -> np.ndarray:
        """One round: the suffix that prepends symbol[i] to the suffix at rank[i], for each i; returns the new ranks."""
        by = np.lexsort((rank, symbol))
        symbol, rank, string = symbol[by], rank[by], string[by]
        # where each new suffix stands among the old: by first symbol, then by the rest's rank
        low, high = np.searchsorted(self.first, symbol, "left"), np.searchsorted(self.first, symbol, "right")
        while (open_ := low < high).any():  # binary search by the rest within the symbol's range
            mid = (low + high) >> 1
            less = np.zeros(len(low), bool)
            less[open_] = self.rest[mid[open_]] < rank[open_]
            low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
        at = low + np.arange(len(low))  # ranks after the merge
        n = len(self.first) + len(at)
        shift = np.cumsum(np.bincount(low, minlength=len(self.first) + 1)).astype(np.int32)  # of each old rank
        new = np.zeros(n, bool)
        new[at] = True
        old = ~new
        for name, values in (("first", symbol), ("rest", rank + shift[rank]), ("origin", string), ("size", length)):
            before = getattr(self, name)
            out = self._space(n, before.dtype)
            out[old] = before + shift[before] if name == "rest" else before
            out[at] = values
            setattr(self, name, out)
        back = np.empty(len(at), np.int64)
        back[by] = at
        return back

    def repeated(self, symbols: int) -> np.ndarray:
        """Whether each suffix shares its first symbols with the one before or after it."""
        n = len(self.first)
        rest = self.rest.astype(np.int64)
        rest[self.size == 0] = np.flatnonzero(self.size == 0)
        group, skip, have = np.zeros(n, np.int64), np.arange(n), 0
        block, jump, width = np.cumsum(np.r_[True, self.first[1:] != self.first[:-1]]), rest, 1
        while width <= symbols:
            if symbols & width:  # the next `width` symbols after those already joined
                pair = group * (n + 1) + block[skip]
                group = np.cumsum(np.r_[True, pair[1:] != pair[:-1]])
                skip, have = jump[skip], have + width
            pair = block * (n + 1) + block[jump]
            block = np.cumsum(np.r_[True, pair[1:] != pair[:-1]])
            jump, width = jump[jump], width * 2
        same = (group[1:] == group[:-1]) & (self.size[1:] >= symbols) & (self.size[:-1] >= symbols)
        return np.r_[same, False] | np.r_[False, same]


def _symbols(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for the STEP bytes at each place: equal for equal bytes."""
    import pandas as pd

    words = [np.lib.stride_tricks.sliding_window_view(flat, 8)[starts + 8 * k].copy().view("<u8").reshape(-1) for k in range(STEP // 8)]
    code = pd.factorize(words[0])[0].astype(np.int64)
    for w in words[1:]:
        more = pd.factorize(w)[0].astype(np.int64)
        code = pd.factorize(code * (int(more.max()) + 1) + more)[0].astype(np.int64)
    return code.astype(np.int32)


def _collection(flat: np.ndarray, offset: np.ndarray, sizes: np.ndarray, body: np.ndarray, phase: np.ndarray, length: int, folder: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(body, start) of each repeated window among strings of STEP-byte symbols: string i is body[i] from byte phase[i]."""
    count = np.maximum((sizes[body] - phase) // STEP, 0)  # symbols of each string
    order = Order(len(body), folder)
    rank = np.arange(len(body), dtype=np.int64)
    begins = np.cumsum(count) - count
    inside = np.arange(int(count.sum())) - np.repeat(begins, count)
    symbol = _symbols(flat, np.repeat(offset[body] + phase, count) + STEP * inside)
    for t in range(1, int(count.max(initial=0)) + 1):
        live = np.flatnonzero(count >= t)
        rank[live] = order.insert(symbol[(begins + count - t)[live]], rank[live].astype(np.int32), live.astype(np.int32), t)
    hit = np.flatnonzero(order.repeated(length // STEP))
    string = order.origin[hit]
    return body[string], phase[string] + STEP * (count[string] - order.size[hit])


def repeated_windows(bodies: list[bytes], length: int, places: list[int] | None = None, folder: str | None = None) -> list[np.ndarray]:
    """For each body, the starts of its windows of length bytes that occur elsewhere in the bodies.

    places: where the name of the body's windows stands in it; equal windows are equally far
    from it, so each phase is a collection of its own. -1: unknown, all phases go together.
    """
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    flat = np.frombuffer(b"".join(bodies), np.uint8)
    offset = np.cumsum(sizes) - sizes
    place = np.full(len(bodies), -1, np.int64) if places is None else np.array(places, np.int64)
    aligned, loose = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
    found = [_collection(flat, offset, sizes, aligned, (place[aligned] - k) % STEP, length, folder) for k in range(STEP if len(aligned) else 0)]
    if len(loose):
        found.append(_collection(flat, offset, sizes, np.repeat(loose, STEP), np.tile(np.arange(STEP), len(loose)), length, folder))
    body, start = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in range(2))
    by = np.lexsort((start, body))
    body, start = body[by], start[by]
    cuts = np.searchsorted(body, np.arange(len(bodies) + 1))
    return [start[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _compare(length: int):
    """Sorted (g, k1, k2, s, place, body) rows -> spans (k1, k2, a, b) of repeated windows."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        with tempfile.TemporaryDirectory() as folder:
            found = repeated_windows([x[5] for x in held], length, [x[4] for x in held], folder)
        out: list[tuple] = []
        for (_, k1, k2, s, _, _), starts in zip(held, found):
            if len(starts):
                cuts = np.flatnonzero(np.r_[True, np.diff(starts) > 1])
                out += [(k1, k2, s + int(starts[a]), s + int(starts[b - 1]) + length) for a, b in zip(cuts, np.r_[cuts[1:], len(starts)])]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["k1", "k2", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= BATCH and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield flush(held)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, k1, k2, body): the row as it is, and keys and text beside it, so that no column name can clash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("body"))


def spans(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, spans): for each document with repeated windows, [a, b) byte ranges (they may overlap). keyed: k1, k2, body."""
    if length % STEP:
        raise ValueError(f"length must be a multiple of {STEP}")
    text = keyed.select("k1", "k2", "body")
    every = materialize(text.mapInArrow(_segment_rows(length), "k1 bigint, k2 bigint, s int, n int, h bigint, c binary, again boolean"), "suffix-segments")
    often = every.groupBy("h").agg(F.count("*").alias("m"), F.max("again").alias("again")).filter("m > 1 OR again").select("h")
    shared = materialize(every.join(often, "h", "left_semi"), "suffix-shared")
    kinds = materialize(shared.groupBy("h", "c").agg(F.count("*").alias("m"), F.min(F.struct("k1", "k2", "s", "n")).alias("r"), F.max("again").alias("again")), "suffix-kinds")
    whole = shared.join(kinds.filter("m > 1").select("h", "c"), ["h", "c"], "left_semi").select("k1", "k2", F.col("s").alias("a"), (F.col("s") + F.col("n") + (length - 1)).alias("b"))
    several = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.max("again").alias("again")).filter("kinds > 1 OR again")
    parts = F.least(F.ceil(F.col("kinds") / HOT), F.lit(SPLITS)).cast("int").alias("parts")
    open_ = kinds.drop("again").join(several, "h").select("r.k1", "r.k2", F.struct("r.s", "r.n", "h", "again", parts).alias("seg")).groupBy("k1", "k2").agg(F.collect_list("seg").alias("segs"))
    bodies = text.join(open_, ["k1", "k2"]).select("k1", "k2", "body", "segs").mapInArrow(_cut_rows(length), "g bigint, k1 bigint, k2 bigint, s int, place int, body binary")
    near = bodies.repartition("g").sortWithinPartitions("g").mapInArrow(_compare(length), "k1 bigint, k2 bigint, a int, b int")
    return whole.unionByName(near).groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))


def remains(raw: bytes, found: list) -> tuple[bytes, int, int]:
    """What is left of raw, the bytes removed and the maximal runs removed. found: sorted (a, b)."""
    merged: list[list[int]] = []
    for a, b in found:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    left, end = [], 0
    for a, b in merged:
        left.append(raw[end:a])
        end = b
    left.append(raw[end:])
    return b"".join(left), sum(b - a for a, b in merged), len(merged)


def _pairs(found) -> list:
    return [] if found is None else [(x["a"], x["b"]) for x in found]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])
    for batch in (b.slice(k, DIGESTED) for b in batches for k in range(0, b.num_rows, DIGESTED)):
        ids, texts, found = (batch.column(i).to_pylist() for i in range(3))
        out: dict[str, list] = {"doc_id": ids, "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "text": []}
        for text, own in zip(texts, found):
            raw = (text or "").encode()
            left, removed, runs = remains(raw, _pairs(own))
            rest = left.decode("utf-8", "ignore") if runs else text
            for k, v in (("n_bytes", len(raw)), ("n_removed", removed), ("n_spans", runs), ("kept_sha256", hashlib.sha256(left).hexdigest()), ("text", rest)):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema)


def dedup_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes (of the input), n_removed, n_spans and kept_sha256 of every row, and its text as strip() leaves it."""
    keyed = _keyed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))).select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "k1", "k2", "body")
    joined = keyed.join(spans(keyed, length), ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_digest, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text string")


def strip(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes cut out of text (characters cut in two by a span's edge go); all rows and other columns stay."""

    @F.pandas_udf("string")
    def left(body, found):
        import pandas as pd

        return pd.Series([remains(t.encode(), [] if x is None else [tuple(y.values()) if isinstance(y, dict) else tuple(y) for y in x])[0].decode("utf-8", "ignore") for t, x in zip(body, found)])

    keyed = _keyed(docs)
    joined = keyed.join(spans(keyed, length), ["k1", "k2"], "left")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(left("body", "spans"))
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op2_suffix_dedup(spark, sf_dir):
    return dedup_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
