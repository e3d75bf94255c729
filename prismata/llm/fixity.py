"""Merkle fixity audit of WARC records: where do two replicas of an archive differ?

A record's block is its WARC header and payload; its leaf is the SHA-256 of the block.
Records are ordered by number and stand in shards of FANOUT consecutive numbers; in a
shard each record has a range of offsets. A shard's node is the SHA-256 of its records'
numbers, offset ranges and leaves, in order; every other node that of its children's numbers and
hashes, FANOUT to a node, up to one root. Replicas with equal roots are equal;
else only the children of nodes that differ are compared, level by level, down to the
records of the shards that differ.

Status of a record: ok, corrupt (its leaves differ), moved (the same record at another offset
of its shard), missing (not in the replica) or extra (only in the replica; its offset is -1).
Null urls and payloads are empty. Rows with a null number have no place in the tree: they
are matched by their leaves, each as often as it occurs, and are ok, missing or extra with a null
shard and offset. Equal numbers are ordered by their leaves and compared as one group. Every task sees FANOUT records of a shard at most (more only for
repeated numbers). Empty archives have no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismata.session import materialize

SHIFT = 6
FANOUT = 1 << SHIFT


def block(url: Column, payload: Column) -> Column:
    """The bytes of a response record."""
    body = F.encode(F.coalesce(payload, F.lit("")), "UTF-8")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def leaves(records: DataFrame, number: str, url: str, payload: str) -> DataFrame:
    """(rec, shard, n_bytes, leaf) of each record; rec and shard are null if its number is."""
    own = records.select(F.col(number).cast("bigint").alias("rec"), block(F.col(url), F.col(payload)).alias("b"))
    return own.select("rec", F.shiftright("rec", SHIFT).alias("shard"), F.length("b").cast("bigint").alias("n_bytes"), F.sha2("b", 256).alias("leaf"))


def offsets(records: DataFrame) -> DataFrame:
    """records with the offset of each in its shard."""
    before = Window.partitionBy("shard").orderBy("rec", "leaf").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("start", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)).cast("bigint"))


def _above(root: bool) -> Column:
    return F.lit(0).cast("bigint") if root else F.shiftright("node", SHIFT)


def _node(level: DataFrame, up: Column, *parts: str) -> DataFrame:
    """(node, hash): the SHA-256 of the parts of each node's children, in order."""
    own = level.select(up.alias("node"), F.struct(*parts).alias("x"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: F.concat_ws(":", *[x[p].cast("string") for p in parts])), "\n")
    return own.groupBy("node").agg(F.sha2(text, 256).alias("hash"))


def tree(placed: DataFrame, levels: int) -> list[DataFrame]:
    """Levels of nodes, shards first; the last has the root. Each is written, so none is made twice. placed: offsets()."""
    ranges = placed.withColumn("stop", F.col("start") + F.col("n_bytes"))
    out = [materialize(_node(ranges, F.col("shard"), "rec", "start", "stop", "leaf"), "fixity")]
    for k in range(levels):
        out.append(materialize(_node(out[-1], _above(k == levels - 1), "node", "hash"), "fixity"))
    return out


def height(*replicas: DataFrame) -> int:
    """Levels above the shards, the root included: the last but one has no more than FANOUT + 1 nodes."""
    ends = [r.agg(F.min("shard"), F.max("shard")).first() for r in replicas]
    known = [x for e in ends for x in e if x is not None]
    low, high, n = (min(known), max(known), 1) if known else (0, 0, 1)
    while high - low > FANOUT:
        low, high, n = low >> SHIFT, high >> SHIFT, n + 1
    return n


def differing_shards(a: DataFrame, b: DataFrame) -> DataFrame:
    """(shard): descend from the roots through the nodes that differ. a, b: offsets()."""
    n = height(a, b)
    ta, tb = tree(a, n), tree(b, n)
    found = None
    for k, (la, lb) in enumerate(zip(reversed(ta), reversed(tb))):
        if found is not None:  # only the children of nodes that differ
            la, lb = (x.withColumn("up", _above(k == 1)).join(found, "up", "left_semi").drop("up") for x in (la, lb))
        both = la.join(lb.withColumnRenamed("hash", "other"), "node", "full").filter("NOT (hash <=> other)")
        found = both.select(F.col("node").alias("up"))
    return found.withColumnRenamed("up", "shard")


def _unnumbered(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records without a number, matched by their leaves."""
    count = lambda x, name: x.filter("rec IS NULL").groupBy("leaf", "n_bytes").agg(F.count("*").cast("int").alias(name))
    both = count(a, "own").join(count(b, "other"), ["leaf", "n_bytes"], "full").fillna(0, ["own", "other"]).withColumn("same", F.least("own", "other"))
    kinds = F.concat(F.array_repeat(F.lit("ok"), F.col("same")), F.array_repeat(F.lit("missing"), F.col("own") - F.col("same")), F.array_repeat(F.lit("extra"), F.col("other") - F.col("same")))
    none = F.lit(None).cast("bigint")
    return both.select(none.alias("rec"), none.alias("shard"), none.alias("start"), "n_bytes", "leaf", F.explode(kinds).alias("status"))


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """(rec, shard, start, n_bytes, leaf, status) of every record of the archive a, and of those that only replica b has. a, b: leaves()."""
    every = [materialize(x, "fixity-leaves") for x in (a, b)]
    a, b = (materialize(offsets(x.filter("rec IS NOT NULL")), "fixity-offsets") for x in every)
    bad = materialize(differing_shards(a, b), "fixity-shards")
    by_rec = lambda x, name: x.join(bad, "shard", "left_semi").groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("leaf", "start"))).alias(name))
    compared = by_rec(a, "own").join(by_rec(b, "other"), "rec", "full")
    leaf = lambda c: F.transform(c, lambda x: x["leaf"])
    state = F.when(F.col("other").isNull(), "missing").when(F.col("own").isNull(), "extra").when(leaf("own") != leaf("other"), "corrupt").when(F.col("own") == F.col("other"), "ok").otherwise("moved")
    states = compared.select("rec", state.alias("s")).filter("s != 'ok'")
    known = a.join(states.filter("s != 'extra'"), "rec", "left").select("rec", "shard", "start", "n_bytes", "leaf", F.coalesce("s", F.lit("ok")).alias("status"))
    extra = b.join(states.filter("s = 'extra'"), "rec", "left_semi").select("rec", "shard", F.lit(-1).cast("bigint").alias("start"), "n_bytes", "leaf", F.lit("extra").alias("status"))
    return known.unionByName(extra).unionByName(_unnumbered(*every))


def damaged(pages: DataFrame) -> DataFrame:
    """The replica that the query audits: pages with known damage (a changed byte, lost records, records of another number)."""
    kept = pages.filter("page_id % 101 != 5")
    html = F.when(F.col("page_id") % 97 == 17, F.concat(F.lit("?"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html"))
    added = pages.filter("page_id % 103 = 7").withColumn("page_id", -F.col("page_id") - 1)
    return kept.withColumn("html", html).unionByName(added)


def op5_merkle_fixity(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    a, b = (leaves(x, "page_id", "url", "html") for x in (pages, damaged(pages)))
    return audit(a, b).withColumnRenamed("rec", "page_id").withColumnRenamed("start", "offset")


ORACLE = r"""
WITH r AS (SELECT page_id, url, html FROM pages WHERE page_id % 101 <> 5 AND page_id % 97 <> 17
           UNION ALL SELECT page_id, url, '?' || substr(html, 2) FROM pages WHERE page_id % 101 <> 5 AND page_id % 97 = 17
           UNION ALL SELECT -page_id - 1, url, html FROM pages WHERE page_id % 103 = 7),
enc AS (SELECT page_id, 'a' AS side, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
        UNION ALL SELECT page_id, 'b', coalesce(url, ''), coalesce(html, '') FROM r),
l AS (SELECT page_id, side, CAST(floor(page_id / 64) AS BIGINT) AS shard,
             'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
             || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS b FROM enc),
h AS (SELECT page_id, side, shard, CAST(strlen(b) AS BIGINT) AS n_bytes, sha256(b) AS leaf FROM l),
o AS (SELECT *, CAST(coalesce(sum(n_bytes) OVER (PARTITION BY side, shard ORDER BY page_id, leaf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM h),
a AS (SELECT * FROM o WHERE side = 'a'),
b AS (SELECT * FROM o WHERE side = 'b')
SELECT a.page_id, a.shard, a."offset", a.n_bytes, a.leaf, CASE WHEN b.page_id IS NULL THEN 'missing' WHEN a.leaf <> b.leaf THEN 'corrupt' WHEN a."offset" <> b."offset" THEN 'moved' ELSE 'ok' END AS status
FROM a LEFT JOIN b ON a.page_id = b.page_id
UNION ALL SELECT page_id, shard, -1, n_bytes, leaf, 'extra' FROM b WHERE page_id NOT IN (SELECT page_id FROM a)
"""
