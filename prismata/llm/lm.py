"""LM scoring with a weighted backoff automaton.

Model: word unigrams with Witten-Bell smoothing (the seen types' share of mass goes to one
unknown word) and bigrams with a Dirichlet prior of weight PRIOR on the unigrams,

    P(w | h) = (c(h, w) + PRIOR * P(w)) / (c(h) + PRIOR),

over training documents only; every document ends with one end token and starts in a
start state. As an automaton: a state for each known word and the start, an arc for each
such bigram with count > 0, and a failure arc of weight PRIOR / (c(h) + PRIOR) to the root,
which has an arc for each word and one for the unknown word. A document is scored by one
left-to-right traversal that carries the state and adds up log10 weights.

The model is never collected or broadcast: each block of documents asks for the counts of
its own distinct words and word pairs (blocks.py) and gets exactly that part of the
automaton which its texts can reach. Counts cover the whole corpus.

Null and empty texts have one token, the end. Repeated rows are scored, and counted in
training, one by one; a null doc_id trains (its remainder is null, so it is not held out).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismata.llm import blocks as B
from prismata.session import materialize

#: Weight of the unigram distribution in each bigram context, in tokens.
PRIOR = 1000.0
#: Bigrams are arcs only between words that occur this often in training (the start state counts as such a word): all of them.
MIN_COUNT = 1
#: Bytes of text in a block here: its word pairs need more memory than its words.
BLOCK_BYTES = 8 << 20
END = b""  # no word is empty
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def held_out(modulus: int = 7, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def tokens(text: str) -> list[bytes]:
    """Words of the text, A-Z lower-cased, and the end. bytes.split() splits at exactly the six ASCII white-space bytes."""
    return [*text.encode().translate(UPPER).split(), END]


def _block(ids: list, texts: list[str], held: list[bool]) -> tuple[B.Block, np.ndarray, np.ndarray]:
    """The block, whether each document trains, and the training count of each key."""
    block = B.Block(ids, texts, tokens)
    train = ~np.array(held, dtype=bool)
    counts = np.bincount(block.seq, weights=np.repeat(train, block.lengths), minlength=len(block.keys))
    return block, train, counts.astype("<u4")


def _blocks(batches: Iterator[pa.RecordBatch]):
    for ids, texts in B.blocks_of(_marked(batches), BLOCK_BYTES):
        yield [i for i, _ in ids], texts, [h for _, h in ids]


def _marked(batches):
    for b in batches:
        yield _Pairs(b)


class _Pairs:
    """A batch whose first column is (doc_id, held_out)."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch

    def column(self, i: int):
        return self.batch.column(1) if i else self

    def to_pylist(self) -> list:
        return list(zip(self.batch.column(0).to_pylist(), self.batch.column(2).to_pylist()))


def _ask_words(parts: int):
    def run(batches):
        for ids, texts, held in _blocks(batches):
            block, _, counts = _block(ids, texts, held)
            name = block.name(B.join_words(block.keys)[0])
            for part, own in enumerate(B.parts_of(block.keys, parts)):
                if len(own):
                    yield B.rows([(name, part, "ask", B.pack(own.astype("<u4"), *B.join_words([block.keys[i] for i in own]), B.pack_planes(counts[own])))])

    return run


def _count_words(table: pa.Table) -> pa.Table:
    """All asks of a part -> the total of each distinct word, back to each block; and the part's tokens and types."""
    total: dict[bytes, int] = {}
    asks = []
    for row in table.select(["block", "part", "payload"]).to_pylist():
        own, flat, lengths, counts = B.unpack(row["payload"])
        words = B.split_words(flat, lengths)
        for w, c in zip(words, B.unpack_planes(counts).tolist()):
            if c:
                total[w] = total.get(w, 0) + c
        asks.append((row["block"], row["part"], own, words))
    out = [("", asks[0][1], "total", B.pack(np.array([sum(total.values()), len(total)], "<i8")))] if asks else []
    for name, part, own, words in asks:
        out.append((name, part, "answer", B.pack(own, B.pack_planes(np.fromiter((total.get(w, 0) for w in words), "<u4", len(words))))))
    return pa.Table.from_batches([B.rows(out)])


def _docs(batches):
    """One row a block: documents, what trains, and the 64-bit hash of each key."""
    import xxhash

    for ids, texts, held in _blocks(batches):
        block, train, _ = _block(ids, texts, held)
        name = block.name(B.join_words(block.keys)[0])
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, block.keys), "<u8", len(block.keys))
        yield B.rows([(name, len(block.keys), "docs", B.pack(train.astype(np.uint8), hashes, block.payload()))])


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of 64-bit hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


START = np.uint64(0x5DEECE66D1234567)


def _open(table: pa.Table):
    """The documents of a block and the count of each key, from a block's rows."""
    docs, answers, n = None, [], 0
    for row in table.select(["part", "kind", "payload"]).to_pylist():
        if row["kind"] == "docs":
            docs, n = B.unpack(row["payload"]), row["part"]
        else:
            answers.append(B.unpack(row["payload"]))
    if docs is None:
        raise RuntimeError("answers without their block: the input changed between two reads")
    known = np.full(n, -1, np.int64)
    for own, counts in answers:
        known[own] = B.unpack_planes(counts)
    if (known < 0).any():
        raise RuntimeError("a block misses answers: the input changed between two reads")
    train, hashes, payload = docs
    return train.astype(bool), hashes, payload, known


def _pairs(hashes: np.ndarray, known: np.ndarray, seq: np.ndarray, lengths: np.ndarray, least: int):
    """For each token the number of its (state, word) pair (-1: never an arc) and its state (-1: start); the hash of each pair that may be an arc, rising."""
    import pandas as pd

    state = np.empty(len(seq), np.int32)
    state[1:] = seq[:-1]
    state[np.cumsum(lengths)[:-1].astype(np.int64)] = -1
    state[:1] = -1
    often = np.append(known >= least, True)  # the last is the start state
    at = np.full(len(seq), -1, np.int32)
    some = np.flatnonzero(often[seq] & often[state])
    codes, distinct = pd.factorize((state[some].astype(np.int64) + 1) * (len(hashes) + 1) + seq[some])
    before, word = distinct // (len(hashes) + 1) - 1, distinct % (len(hashes) + 1)
    pair = _mix(np.where(before < 0, START, hashes[before]), hashes[word])
    order = np.argsort(pair)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    at[some] = rank[codes]
    return at, state, pair[order]


def _sorted_bytes(values: np.ndarray) -> bytes:
    """Rising 64-bit numbers as byte planes of their differences."""
    return B.pack(np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.copy().reshape(-1))


def _from_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(B.unpack(blob)[0].reshape(8, -1).T).view("<u8").reshape(-1), dtype=np.uint64)


def _carry(least: int):
    """A block with its word counts -> its documents again, with the counts; hashes of words without arcs are blanked."""

    def run(table: pa.Table) -> pa.Table:
        train, hashes, payload, known = _open(table)
        slim = np.where(known >= least, hashes, np.uint64(0))
        return pa.Table.from_batches([B.rows([(table.column("block")[0].as_py(), len(hashes), "docs", B.pack(train.astype(np.uint8), slim, payload, B.pack_planes(known)))])])

    return run


def _ask_pairs(parts: int, least: int):
    """A block with its word counts -> its distinct pairs by part; a part is a range of hashes, so that each part's pairs rise."""

    def run(table: pa.Table) -> pa.Table:
        name = table.column("block")[0].as_py()
        train, hashes, payload, known = _open(table)
        _, _, lengths, seq = B.open_docs(payload)
        at, _, pair = _pairs(hashes, known, seq, lengths, least)
        counted = at[np.repeat(train, lengths) & (at >= 0)]
        counts = np.bincount(counted, minlength=len(pair)).astype("<u4")
        cuts = np.searchsorted(pair, (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64))
        out = [(name, part, "pairs", B.pack(_sorted_bytes(pair[a:b]), B.pack_planes(counts[a:b]))) for part, (a, b) in enumerate(zip([0, *cuts.tolist()], [*cuts.tolist(), len(pair)])) if b > a]
        return pa.Table.from_batches([B.rows(out)])

    return run


def _count_pairs(table: pa.Table) -> pa.Table:
    """All pairs of a part -> the total of each, back to each block, in the order in which it asked."""
    asks = [(r["block"], r["part"], *B.unpack(r["payload"])) for r in table.select(["block", "part", "payload"]).to_pylist()]
    some, weights = [], []
    for _, _, pairs, counts in asks:
        c = B.unpack_planes(counts)
        some.append(_from_sorted(pairs)[c > 0])
        weights.append(c[c > 0])
    flat = np.concatenate(some)
    distinct, at = np.unique(flat, return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(weights), minlength=len(distinct)).astype(np.int64)
    del some, flat, at, weights
    out = []
    for name, part, pairs, _ in asks:
        own = _from_sorted(pairs)
        i = np.minimum(np.searchsorted(distinct, own), max(len(distinct) - 1, 0))
        found = np.where(distinct[i] == own, total[i], 0) if len(distinct) else np.zeros(len(own), np.int64)
        out.append((name, part, "answer", B.pack_planes(found)))
    return pa.Table.from_batches([B.rows(out)])


class Automaton:
    """The part of the weighted backoff automaton that a block can reach.

    known: count of each word; arcs: count of each of the block's (state, word) pairs.
    """

    def __init__(self, known: np.ndarray, tokens_: int, types: int, starts: int, prior: float):
        mass = max(tokens_ + types, 1)
        unigram = np.where(known > 0, known, max(types, 1)) / mass
        self.prior, self.unigram, self.root = prior, unigram, np.log10(unigram)
        self.context = np.append(known, starts).astype(np.float64)  # the last is the start state
        self.fail = np.log10(prior / (self.context + prior))

    def traverse(self, state: np.ndarray, word: np.ndarray, arcs: np.ndarray) -> np.ndarray:
        """The weight that each step adds: its arc's, or the failure arc's and the root arc's. state -1: start."""
        direct = (arcs + self.prior * self.unigram[word]) / (self.context[state] + self.prior)
        return np.where(arcs > 0, np.log10(direct), self.fail[state] + self.root[word])


def _score(tokens_: int, types: int, starts: int, prior: float, least: int):
    """All rows of a block -> one row a document."""

    def run(table: pa.Table) -> pa.Table:
        docs, found = None, []
        for row in table.select(["part", "kind", "payload"]).to_pylist():
            if row["kind"] == "docs":
                docs = B.unpack(row["payload"])
            else:
                found.append((row["part"], row["payload"]))
        if docs is None:
            raise RuntimeError("answers without their block: the input changed between two reads")
        train, hashes, payload, known = docs[0].astype(bool), docs[1], docs[2], B.unpack_planes(docs[3]).astype(np.int64)
        ids, no_id, lengths, seq = B.open_docs(payload)
        at, state, pair = _pairs(hashes, known, seq, lengths, least)
        arcs = np.concatenate([B.unpack_planes(x).astype(np.int64) for _, x in sorted(found)]) if found else np.zeros(0, np.int64)
        if len(arcs) != len(pair):
            raise RuntimeError("a block misses answers: the input changed between two reads")
        steps = Automaton(known, tokens_, types, starts, prior).traverse(state, seq, np.where(at < 0, 0, np.append(arcs, 0)[at]))
        base = np.log10((known + 1) / (tokens_ + types + 1))[seq]
        cuts = (np.cumsum(lengths) - lengths).astype(np.int64)
        add = lambda x: np.add.reduceat(x, cuts)  # noqa: E731  every document has its end token
        return pa.table(
            {
                "doc_id": pa.array(ids, mask=no_id.astype(bool)),
                "held_out": ~train,
                "n_tokens": lengths.astype(np.int64),
                "n_known": add((known > 0).astype(np.int64)[seq]),
                "train_tokens": np.full(len(ids), tokens_, np.int64),
                "base_score": add(base),
                "score": add(steps),
            }
        )

    return run


SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score(docs: DataFrame, out_of_training: Column | None = None, prior: float = PRIOR, least: int = MIN_COUNT) -> DataFrame:
    """log10 probabilities of every row of docs under the model of the rows for which out_of_training is false."""
    spark = docs.sparkSession
    held = held_out() if out_of_training is None else out_of_training
    text = B.settled(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out")), "lm-texts")
    size = text.agg(F.count_if(~F.col("held_out")).alias("starts"), F.sum(F.octet_length("text")).alias("bytes")).first()
    starts, parts = size["starts"], B.part_count(spark, size["bytes"] or 0)
    counted = materialize(text.mapInArrow(_ask_words(parts), B.ROW).groupBy("part").applyInArrow(_count_words, B.ROW), "lm-words")
    n, v = 0, 0
    for r in counted.filter("kind = 'total'").select("payload").toLocalIterator():  # one short row a part, one part a PART_BYTES of text
        a, b = B.unpack(bytes(r[0]))[0].tolist()
        n, v = n + a, v + b
    known = text.mapInArrow(_docs, B.ROW).unionByName(counted.filter("kind = 'answer'")).groupBy("block")
    # both read the one exchange by block
    carried, asked = known.applyInArrow(_carry(least), B.ROW), known.applyInArrow(_ask_pairs(parts, least), B.ROW)
    answers = asked.groupBy("part").applyInArrow(_count_pairs, B.ROW)
    return carried.unionByName(answers).groupBy("block").applyInArrow(_score(n, v, starts, prior, least), SCHEMA)


def op9_lm_score(spark, sf_dir):
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
