"""Blocks: pre-aggregation of token streams before any shuffle, and the way back.

A corpus-wide question about tokens (its ids, its count) is asked once for each distinct
token of a block of documents, not once for each occurrence:

* read tasks cut their documents into blocks of bounded size and keep, for each block,
  the distinct keys and each document's sequence of local key numbers;
* the distinct keys go to the part that their hash names (``ask`` rows); a hot key costs
  one entry for each block, however often it occurs;
* each part answers each distinct key once, and sends the answers back in the order in
  which the block asked (``answer`` rows);
* the block's documents and all its answers meet again by block (``assemble``).

A block is named by a digest of its keys and documents, and documents are read from files
(settled()), so a task that runs again after a lost executor makes the same block; a
mismatch fails loudly instead of giving a wrong answer. All payloads are zstd-compressed Arrow-free byte strings: little is shuffled.
Memory in a Python worker is bounded by BLOCK_BYTES of text; one longer document is a
block of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from prismata.session import materialize

#: Bytes of text in a block; the unit of memory of a Python worker.
BLOCK_BYTES = 12 << 20
#: Arrow schema of every row between the steps.
ROW = "block string, part int, kind string, payload binary"
ARROW = pa.schema([("block", pa.string()), ("part", pa.int32()), ("kind", pa.string()), ("payload", pa.binary())])


def pack(*arrays: np.ndarray | bytes, level: int = 3) -> bytes:
    """Arrays and byte strings as one compressed byte string."""
    out = [len(arrays).to_bytes(4, "little")]
    for a in arrays:
        raw, kind = (bytes(a), b"bytes") if isinstance(a, (bytes, bytearray)) else (np.ascontiguousarray(a).tobytes(), a.dtype.str.encode())
        out += [kind.ljust(8), len(raw).to_bytes(8, "little"), raw]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(out))


def unpack(blob: bytes) -> list:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 4
    for _ in range(int.from_bytes(raw[:4], "little")):
        kind, n = raw[at : at + 8].strip().decode(), int.from_bytes(raw[at + 8 : at + 16], "little")
        body = raw[at + 16 : at + 16 + n]
        out.append(body if kind == "bytes" else np.frombuffer(body, kind))
        at += 16 + n
    return out


def pack_planes(values: np.ndarray) -> bytes:
    """Small non-negative integers by byte planes, which compress far better than whole words."""
    v = np.ascontiguousarray(values, dtype="<u4")
    return pack(v.view(np.uint8).reshape(-1, 4).T.copy().reshape(-1))


def unpack_planes(blob: bytes) -> np.ndarray:
    planes = unpack(blob)[0].reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def join_words(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    return b"".join(words), np.fromiter(map(len, words), "<u4", len(words))


def split_words(flat: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths.astype(np.int64)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def key_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def rows(items: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in items], ARROW.field(i).type) for i in range(4)], schema=ARROW)


def blocks_of(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES) -> Iterator[tuple[list, list]]:
    """Lists of (doc_id, text) of about size bytes each; null texts are empty."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            t = t or ""
            if held and held + len(t) > size:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(d)
            texts.append(t)
            held += len(t)
    if ids:
        yield ids, texts


class Block:
    """Documents as sequences of local key numbers. tokens: text -> list of keys (hashable)."""

    def __init__(self, ids: list, texts: list[str], tokens: Callable[[str], list]):
        numbers: dict = {}
        put = numbers.setdefault
        seqs, lengths = [], []
        for t in texts:
            seq = [put(w, len(numbers)) for w in tokens(t)]
            lengths.append(len(seq))
            seqs.append(np.array(seq, dtype="<u4"))
        self.ids = np.array([-1 if d is None else d for d in ids], dtype="<i8")
        self.no_id = np.array([d is None for d in ids], dtype=np.uint8)
        self.lengths = np.array(lengths, dtype="<u4")
        self.seq = np.concatenate(seqs) if seqs else np.zeros(0, "<u4")
        self.keys = list(numbers)

    def payload(self) -> bytes:
        return pack(self.ids, self.no_id, self.lengths, pack_planes(self.seq))

    def name(self, flat: bytes) -> str:
        h = hashlib.blake2b(flat, digest_size=16)
        for a in (self.ids, self.lengths, self.seq):
            h.update(a.tobytes())
        return h.hexdigest()


def open_docs(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, no_id, lengths and seq of Block.payload()."""
    ids, no_id, lengths, seq = unpack(payload)
    return ids, no_id, lengths, unpack_planes(seq)


def parts_of(keys: list[bytes], parts: int) -> list[np.ndarray]:
    """For each part, the numbers of the keys that belong to it, in rising order."""
    import xxhash

    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
    p = (h % np.uint64(parts)).astype(np.int64)
    order = np.argsort(p, kind="stable")
    cuts = np.searchsorted(p[order], np.arange(parts + 1))
    return [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple]:
    """Runs of equal values of a column of sorted rows, as lists of dicts without that column."""
    last, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            k = r[column]
            if held and k != last:
                yield last, held
                held = []
            last = k
            held.append(r)
    if held:
        yield last, held


#: Bytes of text for each part among which the distinct keys are dealt: the unit of memory of a part's task.
PART_BYTES = 64 << 20


def part_count(spark, text_bytes: int) -> int:
    """Parts among which the distinct keys are dealt: they grow with the texts, so a part does not."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes // PART_BYTES))


#: Nodes of a plan that reads files and gives the same rows in the same order whenever it is read.
SETTLED = ("Project", "Filter", "LogicalRelation", "DataSourceV2ScanRelation", "LocalRelation")


def settled(docs: DataFrame, label: str) -> DataFrame:
    """docs as a table that reads the same each time: blocks are made anew in each read, and after a lost executor. What comes from a shuffle or from Python is written first."""
    nodes = [docs._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() not in SETTLED:
            return materialize(docs, label)
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return docs
