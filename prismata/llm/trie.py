"""Prefix trie of rebuilt conversations, summed up by leaf-peeling message passing.

1. Turns get their place in their conversation, and each prefix of a conversation a name,
   in one global sort: a prefix is named by the sum over its turns of SHA-256(turn) * BASE^place
   modulo a prime of 255 bits. Sums can be continued, so a conversation that fills many
   sorted partitions is no longer group than any other: each partition sums up its own
   part, and what stands before it (one row for each partition and each conversation that
   crosses a border) is added afterwards. Words are summed up the same way.
2. Rebuilding moves a conversation's own turns by up to three places and puts turns of another
   before them: a shift of the sum and one added constant. No text moves again.
3. Equal prefixes meet in one pre-aggregated group: their members' number and smallest id.
   Prefixes with the same members lie on one unbranched path, and the pair (smallest
   member, number of members) names it. A path is one node of the messages below, so
   their rounds follow the nesting of member sets, not the length of conversations; the
   prefixes on a path get their own totals from its end and the words up to them.
4. Leaf peeling: each path holds the number of its children that are not complete. Complete
   paths send their totals (leaves, tokens) to their parents, summed up before they move; a
   path with none left is complete itself, until only the root finishes. Each round is
   written to shared storage and holds what is left.
5. Ids of conversations that end at a node are sorted by ranges, packed into chunks by the
   sorting tasks, and hashed chunk by chunk as a stream: no task holds a node's ids.

Edge cases: rows without a conv_id are left out; turns of one number are ordered by role,
then text; repeated rows are turns of their own. Null and empty roles or texts are the same.
An empty table gives no node. Turns may be of any number and any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismata.session import materialize, scratch

#: Prefix names: a prime, and the multiplier of a place.
PRIME = (1 << 255) - 19
BASE = int.from_bytes(b"a fixed multiplier for each turn", "big") % PRIME
BACK = pow(BASE, -1, PRIME)
#: Turns at most that come from the other conversation; its number is rounded down to this multiple.
HEAD, FAMILY = 3, 20
#: Bytes of a chunk of ids.
CHUNK = 1 << 16
NAME = pa.binary()


def _int(b: bytes) -> int:
    return int.from_bytes(b, "big")


def _bytes(i: int) -> bytes:
    return (i % PRIME).to_bytes(32, "big")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, turn's digest, words) of a partition -> (part, conv_id, i, sum, words so far, words): places and sums within the partition, from 1."""
    from pyspark import TaskContext

    part, conv, i, total, power, so_far = TaskContext.get().partitionId(), None, 0, 0, 1, 0
    for batch in batches:
        rows = []
        for c, digest, words in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if c != conv:
                conv, i, total, power, so_far = c, 0, 0, 1, 0
            i, power, so_far = i + 1, power * BASE % PRIME, so_far + words
            total = (total + _int(digest) * power) % PRIME
            rows.append((c, i, _bytes(total), so_far, words))
        c, at, sums, far, words = zip(*rows) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(c), pa.int32()), pa.array(c, pa.int64()), pa.array(at, pa.int64()), pa.array(sums, NAME), pa.array(far, pa.int64()), pa.array(words, pa.int64())], names=["part", "conv_id", "i", "sum", "far", "words"])


def _before(table: pa.Table) -> pa.Table:
    """(part, conv_id, i, sum, far): what each part adds up to for one conversation -> what stands before each part."""
    n, total, words, out = 0, 0, 0, []
    for r in table.sort_by("part").to_pylist():
        out.append((r["part"], r["conv_id"], n, _bytes(total), words))
        total, n, words = total + _int(r["sum"]) * pow(BASE, n, PRIME), n + r["i"], words + r["far"]
    part, conv, at, sums, far = zip(*out)
    return pa.table({"part": pa.array(part, pa.int32()), "conv_id": pa.array(conv, pa.int64()), "n0": pa.array(at, pa.int64()), "sum0": pa.array(sums, NAME), "far0": pa.array(far, pa.int64())})


def _continued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, i, sum, far, words, n0, sum0, far0) -> (conv_id, i, sum, far, words) over all parts; n0 is null for what begins in its part."""
    for batch in batches:
        i, sums, far = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for k, (n0, s0, f0) in enumerate(zip(*(batch.column(c).to_pylist() for c in (5, 6, 7)))):
            if n0:
                i[k], far[k] = i[k] + n0, far[k] + f0
                sums[k] = _bytes(_int(s0) + _int(sums[k]) * pow(BASE, n0, PRIME))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(i, pa.int64()), pa.array(sums, NAME), pa.array(far, pa.int64()), batch.column(4)], names=["conv_id", "i", "sum", "far", "words"])


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, sum, far, words): each turn's place from 1, the name of the prefix that ends there, its words, and the turn's own."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    # nulls come first; texts are no range keys, as those are sampled to the driver
    sorted_ = turns.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    local = materialize(sorted_.select("conv_id", digest.alias("digest"), words.alias("words")).mapInArrow(_places, "part int, conv_id bigint, i bigint, sum binary, far bigint, words bigint"), "trie-turns")
    ends = local.groupBy("part", "conv_id").agg(F.max(F.struct("i", "sum", "far")).alias("e")).select("part", "conv_id", "e.*")
    crossing = ends.groupBy("conv_id").agg(F.count("*").alias("parts")).filter("parts > 1").select("conv_id")
    # a conversation has one row a part here, and a part two such conversations at most
    before = ends.join(crossing, "conv_id").groupBy("conv_id").applyInArrow(_before, "part int, conv_id bigint, n0 bigint, sum0 binary, far0 bigint")
    found = local.join(F.broadcast(materialize(before, "trie-borders")), ["part", "conv_id"], "left")
    return found.select("conv_id", "i", "sum", "far", "words", "n0", "sum0", "far0").mapInArrow(_continued, "conv_id bigint, i bigint, sum binary, far bigint, words bigint")


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, depth, move, sum, own0, head0, last, far, words) -> (conv_id, depth, name, last, far, words): head0 + BASE^move * (sum - own0)."""
    powers = {-k: pow(BACK, k, PRIME) for k in range(HEAD + 1)}
    for batch in batches:
        names = [_bytes(_int(h) + powers[m] * (_int(s) - _int(o))) for m, s, o, h in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, NAME), *(batch.column(c) for c in (6, 7, 8))], names=["conv_id", "depth", "name", "last", "far", "words"])


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, name, last, far, words): each prefix of each rebuilt conversation, the root included; last: it is the whole. turns: prefixes()."""
    none = F.lit(bytes(32))
    start = F.struct(F.lit(0).cast("bigint").alias("i"), none.alias("sum"), F.lit(0).cast("bigint").alias("far"), F.lit(0).cast("bigint").alias("words"))
    first = [F.max(F.when(F.col("i") == k, F.struct("i", "sum", "far", "words"))).alias(f"t{k}") for k in range(1, HEAD + 1)]
    convs = materialize(turns.groupBy("conv_id").agg(F.max("i").alias("n"), *first).select("conv_id", "n", F.array(start, *(f"t{k}" for k in range(1, HEAD + 1))).alias("t")), "trie-heads")
    donors = convs.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("donor"), F.col("n").alias("dn"), F.col("t").alias("dt"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("bigint")
    plan = convs.withColumn("h", h).withColumn("donor", F.col("conv_id") - F.col("conv_id") % FAMILY).join(donors, "donor", "left")
    plan = plan.withColumn("m", F.least("h", F.coalesce("dn", F.lit(0)))).withColumn("dt", F.coalesce("dt", F.array(start)))
    own = F.expr("t[int(least(h, n))]")
    head = F.expr("dt[int(m)]")
    plan = plan.select("conv_id", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"), own.alias("own0"), head.alias("head0"), F.slice("dt", 1, F.col("m").cast("int") + 1).alias("heads"))
    plan = materialize(plan, "trie-plan")
    heads = plan.select("conv_id", "length", F.explode("heads").alias("p")).select("conv_id", F.col("p.i").alias("depth"), F.col("p.sum").alias("name"), (F.col("p.i") == F.col("length")).alias("last"), "p.far", "p.words")
    rest = turns.join(plan.drop("heads"), "conv_id").filter("i > h").withColumn("depth", F.col("i") - F.col("h") + F.col("m"))
    moved = rest.select("conv_id", "depth", (F.col("m") - F.col("h")).cast("int").alias("move"), "sum", F.col("own0.sum").alias("own0"), F.col("head0.sum").alias("head0"), (F.col("depth") == F.col("length")).alias("last"), (F.col("head0.far") + F.col("far") - F.col("own0.far")).alias("far"), "words")
    shifted = moved.mapInArrow(_shifted, "conv_id bigint, depth bigint, name binary, last boolean, far bigint, words bigint")
    return heads.unionByName(shifted)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (name, conv_id) -> (name, first, chunk): decimal ids, comma-joined, about CHUNK bytes each."""
    import zlib

    name, first, held, size, out = None, None, [], 0, []

    def close() -> None:
        if held:
            out.append((name, first, zlib.compress(b",".join(held))))

    for batch in batches:
        for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if n != name or size > CHUNK:
                close()
                name, first, held, size = n, c, [], 0
            held.append(b"%d" % c)
            size += len(held[-1]) + 1
        if out:
            yield _rows(out, ("name", NAME), ("first", pa.int64()), ("chunk", pa.binary()))
            out = []
    close()
    if out:
        yield _rows(out, ("name", NAME), ("first", pa.int64()), ("chunk", pa.binary()))


def _rows(rows: list[tuple], *columns: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(columns)], names=[c for c, _ in columns])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (name, first, chunk) -> (name, ends): the SHA-256 of all chunks of a name, comma-joined."""
    import hashlib
    import zlib

    name, state, out = None, None, []
    for batch in batches:
        for n, chunk in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if n != name:
                if state:
                    out.append((name, state.hexdigest()))
                name, state = n, hashlib.sha256()
            else:
                state.update(b",")
            state.update(zlib.decompress(chunk))
        if out:
            yield _rows(out, ("name", NAME), ("ends", pa.string()))
            out = []
    if state:
        yield _rows([(name, state.hexdigest())], ("name", NAME), ("ends", pa.string()))


def ends_digests(ends: DataFrame) -> DataFrame:
    """(name, ends): for each name the digest of its ids in rising order. ends: name, conv_id."""
    sorted_ = ends.select("name", "conv_id").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    chunks = sorted_.mapInArrow(_chunks, "name binary, first bigint, chunk binary")
    return chunks.repartition("name").sortWithinPartitions("name", "first").mapInArrow(_hashed, "name binary, ends string")


PATH = ["c", "n"]


def peeled(paths: DataFrame) -> DataFrame:
    """(c, n, leaves, below): leaves below each path (itself, if it has no child), and its children's totals. paths: c, n, pc, pn (of the parent, null for the root), children, own."""
    zero = F.lit(0).cast("bigint")
    left = paths.select(*PATH, "pc", "pn", "own", F.col("children").alias("remaining"), F.when(F.col("children") == 0, 1).otherwise(0).cast("bigint").alias("leaves"), zero.alias("below"))
    now = materialize(left, "trie-peel")
    rounds = [now]
    while not now.filter("remaining > 0").isEmpty():
        done = now.filter("remaining = 0 AND pc IS NOT NULL")
        mail = done.groupBy(F.col("pc").alias("c"), F.col("pn").alias("n")).agg(F.count("*").alias("done"), F.sum("leaves").alias("more"), F.sum(F.col("own") + F.col("below")).alias("tokens"))
        got = now.filter("remaining > 0").join(mail, PATH, "left")
        step = got.select(*PATH, "pc", "pn", "own", (F.col("remaining") - F.coalesce("done", zero)).alias("remaining"), (F.col("leaves") + F.coalesce("more", zero)).alias("leaves"), (F.col("below") + F.coalesce("tokens", zero)).alias("below"))
        now = materialize(step, "trie-peel")
        rounds.append(now)
    return reduce(DataFrame.unionAll, rounds).filter("remaining = 0").select(*PATH, "leaves", "below")


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    with scratch(conversations.sparkSession) as tables:
        members = materialize(rebuilt(materialize(prefixes(conversations), "trie-prefixes")), "trie-members")
        nodes = members.groupBy("name", "depth").agg(F.min("conv_id").alias("c"), F.count("*").alias("n"), F.min("far").alias("far"), F.min("words").alias("words"))
        nodes = materialize(nodes, "trie-nodes")
        ends = ends_digests(members.filter("last"))
        # a path: its top and bottom, and what it saves by itself
        spot = lambda c: F.struct("depth", "name", "far", "words").alias(c)
        paths = nodes.groupBy(*PATH).agg(F.min(spot("x")).alias("top"), F.max(spot("x")).alias("end"))
        paths = materialize(paths.select(*PATH, F.col("top.depth").alias("top"), F.col("end.depth").alias("end"), F.col("end.name").alias("name"), F.col("end.far").alias("far"), ((F.col("n") - 1) * (F.col("end.far") - F.col("top.far") + F.col("top.words"))).alias("own")), "trie-paths")
        # the parent of a path is the path whose end is one above its top, on the same conversation: found by a member of both
        above = members.select("conv_id", "depth", "name").join(paths.select(F.col("c").alias("conv_id"), (F.col("top") - 1).alias("depth"), *PATH), ["conv_id", "depth"])
        ended = paths.select("name", F.col("c").alias("pc"), F.col("n").alias("pn"))
        linked = above.select("name", *PATH).join(ended, "name").select(*PATH, "pc", "pn")
        tree = materialize(paths.select(*PATH, "own").join(linked, PATH, "left"), "trie-tree")
        children = tree.filter("pc IS NOT NULL").groupBy(F.col("pc").alias("c"), F.col("pn").alias("n")).agg(F.count("*").alias("children"))
        tree = tree.join(children, PATH, "left").withColumn("children", F.coalesce("children", F.lit(0).cast("bigint")))
        tree = materialize(tree, "trie-counters")
        totals = peeled(tree)
        empty = F.sha2(F.lit("").cast("binary"), 256)
        known = paths.join(tree.select(*PATH, "pc", "children"), PATH).join(totals, PATH).join(ends, "name", "left")
        known = known.select(*PATH, "top", "end", F.col("far").alias("end_far"), "pc", "children", "leaves", "below", "ends")
        at_end, at_top = F.col("depth") == F.col("end"), F.col("depth") == F.col("top")
        out = nodes.join(known, PATH).select(
            F.col("c").alias("conv_id"),
            "depth",
            F.when(at_top, F.col("pc")).otherwise(F.col("c")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            F.when(at_end, F.col("children")).otherwise(1).cast("bigint").alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            (F.col("below") + (F.col("n") - 1) * (F.col("end_far") - F.col("far") + F.col("words"))).alias("saved_tokens"),
            F.when(at_end, F.coalesce("ends", empty)).otherwise(empty).alias("ends_sha256"),
        )
        return tables.keep(materialize(out, "trie"))


def op12_prefix_trie(spark, sf_dir):
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: CRC-32 of a string of digits, bit by bit.
_CRC = "xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda z: ascii(z)::UBIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda z: 0::UBIGINT)), lambda y, z: xor(y >> 1, (y & 1::UBIGINT) * 3988292384::UBIGINT))))"

ORACLE = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, r, x) AS own, ({_CRC} % 4)::BIGINT AS h FROM turns GROUP BY conv_id
), rebuilt AS (
  SELECT a.conv_id, list_concat(CASE WHEN b.conv_id IS NULL THEN [] ELSE b.own[1:a.h] END, a.own[a.h + 1:]) AS s
  FROM own a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20
), prefixes AS (
  SELECT conv_id, len(s) AS length, d, s[1:d] AS k FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT k, d, min(conv_id) AS c, count(*) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE length = d), '') AS ends
  FROM prefixes GROUP BY k, d
), children AS (
  SELECT k[1:d - 1] AS k, count(*) AS m FROM nodes WHERE d > 0 GROUP BY 1
), counted AS (
  SELECT a.*, coalesce(m, 0) AS m, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * len(regexp_extract_all(a.k[d].x, '[^\x20\x09-\x0D]+')) END AS saved
  FROM nodes a LEFT JOIN children b ON a.k = b.k
), below AS (
  SELECT k[1:j] AS k, sum(saved) AS saved, count(*) FILTER (WHERE m = 0) AS leaves
  FROM (SELECT k, saved, m, unnest(range(d + 1)) AS j FROM counted) GROUP BY 1
)
SELECT a.c AS conv_id, a.d AS depth, p.c AS parent_conv_id, a.n AS n_convs, a.m AS n_children, b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM counted a JOIN below b ON a.k = b.k LEFT JOIN nodes p ON a.d > 0 AND p.k = a.k[1:a.d - 1]
"""
