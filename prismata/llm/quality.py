"""Quality rules: a threshold table compiled into one Spark projection (no user functions).

Nulls and empty texts have no words: every count is 0 and the document is rejected.
Repeated rows are judged one by one; columns beyond doc_id and text are ignored here
and kept by keep_good(). Equal three-word windows are found by their 64-bit XXH64
within one document. Cost is n log n in the words of a document. The stop words are those of four
languages, and a twentieth of the words must be of them: a clean text in any other language is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Common function words of the corpus languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "was", "for", "on", "with", "as", "be", "at", "by", "this", "are", "or", "an", "from",
    "de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "dans", "que", "qui", "est", "pour", "pas", "sur", "au", "par", "avec",
    "el", "y", "los", "se", "del", "las", "por", "con", "no", "su", "para", "es", "al", "lo", "como",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine",
)

#: Name, numerator, denominator, least and most: numerator / denominator must lie within [least, most].
#: Bounds are given in hundredths, so that the comparison is exact in integers.
THRESHOLDS: tuple[tuple[str, str, str, int | None, int | None], ...] = (
    ("words", "n_words", "one", 5_000, None),
    ("word_length", "word_chars", "n_words", 200, 1_500),
    ("symbols", "n_symbols", "n_words", None, 10),
    ("stop_words", "n_stop_words", "n_words", 5, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 50),
    ("repeated_words", "n_repeat_words", "n_words", None, 50),
)

SYMBOLS = "#*$%&|<>"
SPACE = r"\x20\x09-\x0D"


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))


def _repeat_words(paired: Column) -> Column:
    """Words in windows found twice or more, from sorted (hash, position): keep equal neighbours, count the positions covered."""
    same = F.filter(F.arrays_zip(paired.alias("a"), F.slice(paired, 2, F.size(paired)).alias("b")), lambda z: z["a"]["h"] == z["b"]["h"])
    reach = lambda z: F.array(*[z[x]["i"] + k for x in ("a", "b") for k in range(3)])
    return F.size(F.array_distinct(F.flatten(F.transform(same, reach))))


def _grams(words: Column) -> Column:
    """A 64-bit hash of each three-word window: one hash of each word for each place in the window, combined by xor."""
    n = F.size(words) - 2
    place = lambda k: lambda w: F.xxhash64(w, F.lit(k))
    at = [F.slice(F.transform(words, place(k)), k + 1, n) for k in range(3)]
    both = lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    return F.when(n > 0, both(both(at[0], at[1]), at[2])).otherwise(F.array().cast("array<bigint>"))


def measure(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The key column and the counts that the threshold table names, in one narrow pass without a shuffle."""
    text = docs.select(key, F.coalesce(F.col("text"), F.lit("")).alias("t"))
    split = text.select(key, "t", _words(F.col("t")).alias("w"), F.filter(F.split("t", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")).alias("l"))
    stop = [x for w in STOP_WORDS for x in dict.fromkeys((w, w.capitalize(), w.upper()))]
    counted = split.select(
        key,
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", f"[{SYMBOLS}]", ""))).cast("bigint").alias("n_symbols"),
        F.size("l").cast("bigint").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: x.isin(*stop))).cast("bigint").alias("n_stop_words"),
        _grams(F.col("w")).alias("g"),
    )
    # Only documents with an equal pair of windows are sorted; each step is a column of its own, so that none is evaluated twice.
    sort = F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    paired = counted.withColumn("p", F.when(F.size(F.array_distinct("g")) < F.size("g"), sort)).drop("g")
    return paired.withColumn("n_repeat_words", F.when(F.col("p").isNull(), 0).otherwise(_repeat_words(F.col("p"))).cast("bigint")).drop("p")


def compile_rules(thresholds=THRESHOLDS) -> Column:
    """The threshold table as one boolean expression over measure()'s columns, in integer arithmetic."""
    verdict = F.lit(True)
    for _, top, bottom, least, most in thresholds:
        over = F.lit(1) if bottom == "one" else F.col(bottom)
        if least is not None:
            verdict = verdict & (F.col(top) * 100 >= over * least)
        if most is not None:
            verdict = verdict & (F.col(top) * 100 <= over * most)
    return verdict


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def judge(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Counts, base_failed and kept for every row of docs."""
    out = measure(docs).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & compile_rules(thresholds))


def keep_good(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The rows of docs (all columns) that pass the base rules and the table."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    verdict = ~base_failed() & compile_rules(thresholds)
    # a filter would be pushed below the projections and evaluate them anew for each rule; it stops at a column that is not deterministic
    held = measure(whole, "row").select("row", (verdict & (F.spark_partition_id() >= 0)).alias("kept"))
    return held.filter("kept").select("row.*")


def op10_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    stop = ", ".join(f"'{x}'" for w in STOP_WORDS for x in dict.fromkeys((w, w.capitalize(), w.upper())))
    rules = []
    for _, top, bottom, least, most in THRESHOLDS:
        over = "1" if bottom == "one" else bottom
        if least is not None:
            rules.append(f"{top} * 100 >= {over} * {least}")
        if most is not None:
            rules.append(f"{top} * 100 <= {over} * {most}")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i AS i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM r GROUP BY 1),
c AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop_words,
             CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN n USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(rules)} AS kept FROM b
"""
