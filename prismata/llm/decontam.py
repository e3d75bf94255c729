"""Benchmark decontamination by a prefix-filtered set join (DataFrame operations only).

Every benchmark item is cut into windows of WINDOW consecutive words (an item of fewer
words is one window). A window occurs in a document only if all its word shingles do, so
one shingle is a sufficient prefix: the rarest one, by its number of occurrences in the
whole corpus (ties: by the shingle). Only these prefix shingles are joined with the
documents' shingles. The place of the prefix in its window fixes where the window would
start; the positional bound (start >= 0) and the length bound (start + length <= words of
the document) prune; then the words are compared one by one.

Texts are cut into words once; the passes that count and join read the words again from
the shared folder. Words are compared with A-Z lower-cased, as the contract says. The join
itself uses Unicode lower case, which is faster and can only add candidates.

Null and empty texts have no words; items without words have no window. Equal windows of
several items are joined once, and their items looked up at the end. Rows are keyed by doc_id
and a hash of their text, so repeated rows, rows that share a doc_id and rows without one are
judged one by one. The benchmark's windows are broadcast only if their counted number is
small; beyond that both sides are shuffled by shingle, with each occurrence carrying only
the words around it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismata.session import materialize

WINDOW = 10
SHINGLE = 2
#: Windows up to which the benchmark's side of the joins is broadcast (a window has at most WINDOW words).
SMALL = 400_000
#: Runs of characters that part words, before lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NULL_ID = -(1 << 63)


def joined_words(text: Column) -> Column:
    """The words of a text, joined by spaces."""
    return F.btrim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BETWEEN, " "))


def words(text: Column) -> Column:
    s = joined_words(text)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " "))


def _ascii_lower(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def _shingles(rows: DataFrame, k: int, *kept: str) -> DataFrame:
    """(*kept, i, key) of each place of rows with words w: the k words from it; places too near the end are left out."""
    each = rows.select(*kept, "w", F.posexplode("w").alias("i", "x"))
    key = F.xxhash64("x", *[F.get("w", F.col("i") + j) for j in range(1, k)])
    return each.filter(F.col("i") + k <= F.size("w")).select(*kept, "i", key.alias("key"))


def _lowered(s: Column) -> Column:
    """The words of a text of words, Unicode lower-cased; none for an empty text."""
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(F.lower(s), " "))


def windows(items: DataFrame, size: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, window, length, k): the windows of each item as text, their words and the size of their shingles."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(_ascii_lower(F.coalesce(F.col("text"), F.lit("")))).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    each = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, size))).alias("words"))
    return each.select("item_id", F.array_join("words", " ").alias("window"), F.size("words").alias("length")).distinct().withColumn("k", F.least("length", F.lit(shingle)))


def keys(docs: DataFrame) -> list[Column]:
    """The columns that name a row: its doc_id, and a hash of its text."""
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("k1"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("k2")]


def tokenized(docs: DataFrame) -> DataFrame:
    """(k1, k2, s, n) of each row: its words joined by spaces, and their number."""
    cut = docs.select(*keys(docs), joined_words(F.col("text")).alias("s"))
    spaces = F.length("s") - F.length(F.replace("s", F.lit(" "), F.lit("")))
    return materialize(cut.select("k1", "k2", "s", F.when(F.col("s") == "", 0).otherwise(spaces + 1).alias("n")), "decontam-words")


def _prefixes(wins: DataFrame, tokens: DataFrame, k: int, hint) -> DataFrame:
    """(key, place, window, length) of each window with shingles of k words: its rarest shingle in the corpus. Windows with a shingle that never occurs are left out."""
    own = wins.filter(F.col("k") == k).select("window", "length").distinct()
    places = _shingles(own.withColumn("w", _lowered(F.col("window"))), k, "window", "length").withColumnRenamed("i", "place")
    asked = places.select("key").distinct()
    counts = _shingles(tokens.select(_lowered(F.col("s")).alias("w")), k).select("key").join(hint(asked), "key").groupBy("key").agg(F.count("*").alias("n"))
    ranked = places.join(counts, "key", "left").select("window", "length", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "place").alias("r"))
    return ranked.groupBy("window", "length").agg(F.min("r").alias("r")).filter("r.n > 0").select("r.key", "r.place", "window", "length")


def occurrences(tokens: DataFrame, wins: DataFrame, size: int = WINDOW) -> DataFrame:
    """(k1, k2, window, a, b): where each window occurs, as a range of words."""
    kinds = sorted(r["k"] for r in wins.select("k").distinct().collect())  # at most SHINGLE values
    small = wins.limit(SMALL + 1).count() <= SMALL
    hint = F.broadcast if small else (lambda df: df)
    found = None
    for k in kinds:
        prefix = materialize(_prefixes(wins, tokens, k, hint), "decontam-prefixes")
        at = _shingles(tokens.withColumn("w", _lowered(F.col("s"))), k, "k1", "k2", "n", "s")
        low = F.lit(0)
        if not small:  # only the words around an occurrence are shuffled
            low = F.greatest(F.col("i") - size + 1, F.lit(0))
            at = at.select("k1", "k2", "n", "i", "key", low.alias("low"), F.array_join(F.slice(F.split("s", " "), low + 1, F.lit(2 * size)), " ").alias("s"))
            low = F.col("low")
        start = F.col("i") - F.col("place")
        bounded = at.join(hint(prefix), "key").filter((start >= 0) & (start + F.col("length") <= F.col("n")))
        here = F.array_join(F.slice(F.split("s", " "), start - low + 1, F.col("length")), " ")
        got = bounded.filter(_ascii_lower(here) == F.col("window")).select("k1", "k2", "window", start.alias("a"), (start + F.col("length")).alias("b"))
        found = got if found is None else found.unionAll(got)
    return found


def hits(docs: DataFrame, items: DataFrame, size: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """The rows as (k1, k2, n), and (k1, k2, spans, item_ids) of those in which windows occur: the word ranges hit and the items whose windows they are."""
    tokens = tokenized(docs)
    wins = materialize(windows(items, size, shingle), "decontam-windows")
    found = occurrences(tokens, wins, size)
    if found is None:
        none = tokens.filter("false").select("k1", "k2", F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))).alias("spans"), F.array(F.lit("")).alias("item_ids"))
        return tokens.select("k1", "k2", "n"), none
    found = materialize(found, "decontam-found")
    spans = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    whose = found.select("k1", "k2", "window").distinct().join(wins.select("window", "item_id"), "window").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    return tokens.select("k1", "k2", "n"), spans.join(whose, ["k1", "k2"])


def judge(docs: DataFrame, items: DataFrame, size: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    rows, found = hits(docs, items, size, shingle)
    places = F.flatten(F.transform("spans", lambda s: F.sequence(s["a"], s["b"] - 1)))
    digest = found.select("k1", "k2", F.size(F.array_distinct(places)).cast("bigint").alias("hit"), F.size("item_ids").cast("bigint").alias("items"), F.sha2(F.array_join("item_ids", ","), 256).alias("sha"))
    out = rows.join(digest, ["k1", "k2"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return out.select(
        F.when(F.col("k1") != NULL_ID, F.col("k1")).alias("doc_id"), F.col("n").cast("bigint").alias("n_words"), zero("hit").alias("n_hit"), zero("items").alias("n_items"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (zero("hit") > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs (all columns) in which no window of any item occurs."""
    _, bad = hits(docs, items, size, shingle)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *keys(docs))
    return keyed.join(bad.select("k1", "k2"), ["k1", "k2"], "left_anti").select("row.*")


def op7_decontam(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, len(w) AS m, w[i : i + least(len(w), 10) - 1] AS words
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT len(words) AS n FROM win),
grams AS (SELECT doc_id, i, n, w[i : i + n - 1] AS words FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM grams JOIN win USING (words)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
