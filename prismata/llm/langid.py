"""Language ID with language-bitmask n-gram filters.

Training takes a bounded sample (SAMPLE rows a language, by hash of doc_id) of labelled
rows and counts letter n-grams of each language in Spark. An n-gram belongs to a language
if its share there is at least SHARE of its largest share in any language. All languages'
Bloom filters share one bit-sliced table: the slot of a hash holds one bit for each
language, so one AND over the slots of an n-gram returns every language that contains it.

Prediction sums the bits: the count of a language is corrected for its filter's rate of
false positives, f = fill ** HASHES, by (hits - n * f) / (1 - f); the largest wins, and
its share of all corrected counts is the score. Languages beyond 64 use further words of
the mask.

Null texts and texts without a letter are ``und`` with score 0. Texts whose n-grams no
filter knows get the most frequent language with score 0. Ties go to the language that is
more frequent in training, then to the first by name. If there is no labelled row,
everything is ``und``. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismata.session import materialize

#: Training rows taken of each language (expected; by a hash threshold).
SAMPLE = 2_000
ORDERS = (1, 2, 3, 4)
SHARE = 0.3
#: Slots of the bit-sliced table (a power of two) and hash functions of each filter.
SLOTS = 1 << 20
HASHES = 3
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"


@functools.lru_cache(1)
def letters() -> np.ndarray:
    """For each code point: its lower-case letter, or a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts in one array, every run of other characters one space; and the text of each place."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    # each text stands between spaces, so that no n-gram joins two texts but across a space
    gap = np.array([32], np.uint32)
    c = letters()[np.concatenate([x for r in raw for x in (gap, r)] + [gap])] if raw else gap
    owner = np.append(np.repeat(np.arange(len(raw)), sizes + 1), max(len(raw) - 1, 0))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | (owner[1:] != owner[:-1])
    return c[keep].astype(np.uint64), owner[keep]


def grams(c: np.ndarray, owner: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and owners of the n-grams of one word each (its borders may be their first and last character)."""
    n = len(c) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, order, np.uint64)
    for k in range(order):
        h = (h ^ c[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    ok = owner[:n] == owner[order - 1 :]
    if order == 1:
        ok = ok & (c != 32)
    for k in range(1, order - 1):  # no border inside
        ok = ok & (c[k : k + n] != 32)
    if order == 2:
        ok = ok & ((c[:n] != 32) | (c[1 : n + 1] != 32))
    return h[ok], owner[:n][ok]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> counts of n-gram hashes by language, one row for each of a batch."""
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            c, owner = normal([t for a, t in zip(langs, texts) if a == lang])
            for order in ORDERS:
                h, n = np.unique(grams(c, owner, order)[0], return_counts=True)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64)), pa.array([order] * len(h), pa.int32())], names=["lang", "gram", "n", "ord"])


class Filters:
    """Bit-sliced Bloom filters of all languages."""

    def __init__(self, langs: list[str], slots: int = SLOTS):
        self.langs, self.words = langs, max(1, -(-len(langs) // 64))
        self.table = np.zeros((self.words, slots), np.uint64)

    def _slots(self, h: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(HASHES):
            x = (h ^ np.uint64(0xD6E8FEB86659FD93 * (k + 1) & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
            yield ((x ^ (x >> np.uint64(33))) >> np.uint64(8)) & np.uint64(self.table.shape[1] - 1)

    def add(self, lang: int, h: np.ndarray) -> None:
        for s in self._slots(h):
            np.bitwise_or.at(self.table[lang // 64], s.astype(np.int64), np.uint64(1 << (lang % 64)))

    def look(self, h: np.ndarray) -> np.ndarray:
        """(words, n): for each n-gram the mask of the languages that contain it."""
        out = None
        for s in self._slots(h):
            got = self.table[:, s.astype(np.int64)]
            out = got if out is None else out & got
        return out

    def false_rates(self) -> np.ndarray:
        fill = [np.count_nonzero(self.table[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / self.table.shape[1] for i in range(len(self.langs))]
        return np.array(fill) ** HASHES

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        texts = [t or "" for t in texts]
        c, owner = normal(texts)
        some = np.bincount(owner[c != 32], minlength=len(texts)) > 0
        hits, n = np.zeros((len(self.langs), len(texts))), np.zeros(len(texts))
        for order in ORDERS:
            h, own = grams(c, owner, order)
            n += np.bincount(own, minlength=len(texts))
            masks = self.look(h)
            for i in range(len(self.langs)):
                bit = (masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(bool)
                hits[i] += np.bincount(own[bit], minlength=len(texts))
        f = self.false_rates()[:, None]
        right = np.maximum((hits - n * f) / np.maximum(1 - f, 1e-9), 0)
        if not len(self.langs):
            return ["und"] * len(texts), np.zeros(len(texts))
        best, total = right.argmax(0), right.sum(0)
        score = np.where(some & (total > 0), right.max(0) / np.maximum(total, 1e-12), 0.0)
        return [self.langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist())], np.clip(score, 0, 1)


def held_out(modulus: int = 4, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def _spots(langs: list[str], slots: int):
    """(lang, gram) -> (word, slot, mask): where the filters of the languages hold each n-gram."""
    number = {k: i for i, k in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = Filters(langs, slots)
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for s in shape._slots(batch.column(1).to_numpy().view(np.uint64)):
                mask = (np.uint64(1) << (lang % 64).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((lang // 64).astype(np.int32)), pa.array(s.astype(np.int64)), pa.array(mask)], names=["word", "slot", "mask"])

    return run


def train(docs: DataFrame, sample: int = SAMPLE, slots: int = SLOTS) -> Filters:
    """Filters of the labelled rows of docs (lang, text, doc_id).

    All n-grams of the sample count. The filters are filled in Spark, slot by slot; what reaches
    the driver is a count for each language and the finished table, whose size is fixed.
    """
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    langs = sorted(sizes, key=lambda x: (-sizes[x], x))
    out = Filters(langs, slots)
    if not langs:
        return out
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / sizes[k]))])
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    taken = labelled.filter(chance < share[F.col("lang")]).select("lang", "text")
    counts = materialize(taken.mapInArrow(_count, "lang string, gram bigint, n bigint, ord int").groupBy("gram", "ord", "lang").agg(F.sum("n").alias("n")), "langid-grams")
    total = counts.groupBy("lang", "ord").agg(F.sum("n").alias("all"))
    parts = counts.join(F.broadcast(total), ["lang", "ord"]).withColumn("part", F.col("n") / F.col("all"))  # a row a language and order
    most = parts.groupBy("gram", "ord").agg(F.max("part").alias("most"), F.collect_list(F.struct("lang", "part")).alias("own"))
    held = most.select("gram", F.explode(F.filter("own", lambda x: x["part"] >= SHARE * F.col("most"))).alias("x")).select("x.lang", "gram")
    table = held.mapInArrow(_spots(langs, slots), "word int, slot bigint, mask bigint").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    out.table[table["word"].to_numpy(), table["slot"].to_numpy()] = table["mask"].to_numpy(np.int64).view(np.uint64)
    return out


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; only text is an input of a prediction."""
    held = filters  # its table has SLOTS words: 8 MB for up to 64 languages
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            lang, score = [], []
            for a, b in _pieces(texts):
                p, s = own.predict(texts[a:b])
                lang += p
                score += s.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def _pieces(texts: list, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about size characters each: the bound on a worker's memory."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t or "") > size:
            yield start, i
            start, held = i, 0
        held += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def op1_langid(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out())
    return predict(docs, train(docs.filter(~F.col("held_out"))))
