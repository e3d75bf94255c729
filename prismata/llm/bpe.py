"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Texts are cut into pre-tokens (one match of the pattern each, with its position); the
distinct pre-tokens of a block of documents travel to the part their hash names, where
each distinct one is encoded once; its ids travel back to the blocks that asked, and the
positions put every document together again. Decoding joins the ids with the table of
token bytes. See blocks.py for the block exchange: occurrences are never shuffled, so a
pre-token that makes up a third of the corpus costs no more than any other.

Null and empty texts have no ids. Repeated rows and null doc_ids are kept as they are.
Columns other than the two named are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismata.llm import blocks as B

#: Encoded pre-tokens that a worker remembers before it starts afresh.
MEMO = 400_000
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.lru_cache(2)
def encoding(path: str):
    """The encoder of a rank file for single pre-tokens, and the bytes of each id."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    # a pre-token is one match already, whatever stood around it
    return tiktoken.Encoding("ranks", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}), table


@functools.lru_cache(2)
def splitter(pattern: str):
    import regex

    return regex.compile(pattern).findall


def _split(kinds: str, pattern: str, parts: int):
    """Documents -> ask rows (distinct pre-tokens by part) or docs rows (local numbers by position)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = splitter(pattern)
        for ids, texts in B.blocks_of(batches):
            block = B.Block(ids, texts, find)
            keys = [k.encode() for k in block.keys]
            flat, _ = B.join_words(keys)
            name = block.name(flat)
            if kinds == "docs":
                yield B.rows([(name, len(keys), "docs", block.payload())])
                continue
            for part, own in enumerate(B.parts_of(keys, parts)):
                if len(own):
                    yield B.rows([(name, part, "ask", B.pack(own.astype("<u4"), *B.join_words([keys[i] for i in own])))])

    return run


def _encode(path: str):
    """Ask rows -> answer rows: each distinct pre-token is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(path)[0].encode_ordinary
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own, flat, lengths = B.unpack(row["payload"])
                answers = []
                for word in B.split_words(flat, lengths):
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= MEMO:
                            known.clear()
                        ids = known[word] = encoder(word.decode())
                    answers.append(ids)
                sizes = np.fromiter(map(len, answers), "<u4", len(answers))
                ids = np.fromiter((i for a in answers for i in a), "<u4", int(sizes.sum()))
                out.append((row["block"], row["part"], "answer", B.pack(own, B.pack_planes(sizes), B.pack_planes(ids))))
            yield B.rows(out)

    return run


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs [start, start + size) of flat, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)
    return flat[at]


def _assemble(path: str, with_ids: bool):
    """All rows of a block -> one row a document: ids in order of position, and the bytes that they decode to."""

    def run(table: pa.Table) -> pa.Table:
        docs, answers, n_keys = None, [], 0
        for row in table.select(["part", "kind", "payload"]).to_pylist():
            if row["kind"] == "docs":
                docs, n_keys = row["payload"], row["part"]
            else:
                answers.append(B.unpack(row["payload"]))
        if docs is None:
            raise RuntimeError("answers without their block: the input changed between two reads")
        ids, no_id, lengths, seq = B.open_docs(docs)
        sizes = np.full(n_keys, -1, np.int64)
        starts = np.zeros(n_keys, np.int64)
        flats, base = [], 0
        for own, size, flat in answers:
            size, flat = B.unpack_planes(size).astype(np.int64), B.unpack_planes(flat)
            sizes[own], starts[own] = size, base + np.cumsum(size) - size
            flats.append(flat)
            base += len(flat)
        if (sizes < 0).any():
            raise RuntimeError("a block misses answers: the input changed between two reads")
        flat = np.concatenate(flats) if flats else np.zeros(0, "<u4")
        token_bytes = encoding(path)[1]
        words = [b"".join([token_bytes[i] for i in flat[a : a + n].tolist()]) for a, n in zip(starts.tolist(), sizes.tolist())]
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] * with_ids))}
        end = 0
        for doc, none, n in zip(ids.tolist(), no_id.tolist(), lengths.tolist()):
            own = seq[end : end + n]
            end += n
            tokens = gather(flat, starts[own], sizes[own]).astype("<u4")
            out["doc_id"].append(None if none else doc)
            out["n_tokens"].append(len(tokens))
            out["ids_sha256"].append(hashlib.sha256(tokens.tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(b"".join([words[i] for i in own.tolist()])).hexdigest())
            if with_ids:
                out["ids"].append(tokens.astype(np.int32))
        return pa.table(out, schema=_schema(with_ids))

    return run


def _schema(with_ids: bool) -> pa.Schema:
    own = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return pa.schema(own + [("ids", pa.list_(pa.int32()))] * with_ids)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded bytes and, if asked for, ids; one row for each row of docs."""
    path, pattern = path or default_path(), pattern or default_pattern()
    text = B.settled(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), "bpe-texts")
    parts = B.part_count(docs.sparkSession, text.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    ask = text.mapInArrow(_split("ask", pattern, parts), B.ROW)
    answer = ask.repartition(parts, "part").mapInArrow(_encode(path), B.ROW)
    own = text.mapInArrow(_split("docs", pattern, parts), B.ROW)
    ddl = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return own.unionByName(answer).groupBy("block").applyInArrow(_assemble(path, with_ids), ddl)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with ids: the ids joined with the token-byte table (a fixed table of the vocabulary's size)."""
    path = path or default_path()

    @F.pandas_udf("string")
    def text(ids):
        table = encoding(path)[1]
        return ids.map(lambda x: None if x is None else b"".join(table[i] for i in x).decode("utf-8", "replace"))

    return encoded.select("doc_id", text("ids").alias("text"))


def op8_bpe(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, with_ids=False)
