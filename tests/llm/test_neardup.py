"""Near-duplicates against all pairs of shingle sets: appended, cut and edited copies, crowds, nulls and repeated rows."""

import random

import pytest

from prismata import session
from prismata.llm import neardup, simhash
from prismata.operators import components

UPPER = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    return "".join(UPPER.get(c, c) for c in text or "").translate({ord(c): " " for c in SPACE}).split(" ") if text else []


def shingles(text):
    w = [x for x in words_of(text) if x]
    return tuple(w), {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def groups(rows):
    """For each row the index of the first row of its group, by brute force."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            (wi, a), (wj, b) = sets[i], sets[j]
            if wi == wj or (a and b and len(a & b) * 10 >= 8 * len(a | b)):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def corpus(seed, bases=25, copies=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)] + ["Ünlü", "Straße"]
    passage = [rng.choice(vocabulary) for _ in range(60)]  # shared by many, makes none alike
    texts = []
    for k in range(bases):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 90, 200, 400]))]
        if k % 2:
            at = rng.randrange(len(base))
            base = base[:at] + passage + base[at:]
        texts.append(base)
        for _ in range(rng.randrange(copies)):
            w, kind = list(base), rng.randrange(4)
            if kind == 0:
                w += [rng.choice(vocabulary) for _ in range(rng.randrange(1, len(w) // 3 + 2))]
            elif kind == 1:
                w = w[: max(1, len(w) - rng.randrange(len(w) // 3 + 1))]
            elif kind == 2:
                for _ in range(rng.randrange(1, 5)):
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(w)
    rng.shuffle(texts)
    return [(i, (" " if i % 3 else "\n").join(t).upper() if i % 7 == 0 else " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed, monkeypatch):
    if seed == 2:  # every cell a crowd, in many blocks; every component in many blocks
        monkeypatch.setattr(neardup, "CROWD_BLOCK", 3)
    rows = corpus(seed) + [(10_000, ""), (10_001, None), (10_002, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1 + 2 * seed)
    expected = groups(rows)
    least = {}
    for (i, _), g in zip(rows, expected):
        least[g] = min(least.get(g, i), i)
    if seed == 2:
        texts = neardup._texts(docs)
        monkeypatch.setattr(neardup.candidates, "__defaults__", (0.8, 1))
        monkeypatch.setattr(neardup.verified_links, "__defaults__", (0.8, 300))
        assert texts.count() == len(rows)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: least[g] for (i, _), g in zip(rows, expected)}
    assert len(set(got.values())) < len(got)
    kept = sorted(r.doc_id for r in neardup.keep_one(docs).collect())
    assert kept == sorted(set(got.values()))


def test_nulls_repeats_and_clashing_columns(spark):
    long = " ".join(f"x{i}" for i in range(50_000))
    rows = [(1, "a b c d e f g", "n", 1), (1, "a b c d e f g", "n", 1), (1, "a b c d e f g", "m", 2), (None, "A b c d e f g", "n", 3), (None, "p q r", "n", 4), (None, "p  q r", "n", 5), (2, "p q r", None, 6), (3, long, "n", 7), (4, long + " end", "n", 8), (5, "alone", "n", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, k string, t int")
    found = sorted(neardup.keep_one(docs).collect(), key=lambda r: r.t)
    assert [r.doc_id for r in found if r.doc_id != 1] == [2, 3, 5] and sum(r.doc_id == 1 for r in found) == 1
    assert found == sorted(neardup.keep_one(docs.repartition(5)).collect(), key=lambda r: r.t)
    assert found[0].__fields__ == ["doc_id", "text", "k", "t"]
    empty = docs.limit(0)
    assert neardup.keep_one(empty).count() == 0 and neardup.near_duplicates(empty).count() == 0
    only_null = spark.createDataFrame([(None, "one two"), (None, "one two"), (None, "three")], "doc_id bigint, text string")
    assert sorted(r.text for r in neardup.keep_one(only_null).collect()) == ["one two", "three"]


def test_the_embedding_bounds_the_difference():
    rng = random.Random(5)
    for _ in range(200):
        a = neardup.shingle_set([str(rng.randrange(40)).encode() for _ in range(rng.randrange(1, 900))])
        b = neardup.shingle_set([str(rng.randrange(40)).encode() for _ in range(rng.randrange(1, 900))])
        p, q = (neardup.popcounts(x)[None, :] for x in (a, b))
        while p.shape[1] > q.shape[1]:
            p = neardup.folded(p)
        while q.shape[1] > p.shape[1]:
            q = neardup.folded(q)
        assert abs(p.astype(int) - q.astype(int)).sum() <= len(set(a.tolist()) ^ set(b.tolist()))


def test_fingerprints_link_first_and_the_rest_is_sought_between_classes(spark, monkeypatch):
    """F2 of round 3: the stage had no SimHash step."""
    rows = corpus(3, bases=12) + [(20_000 + i, " ".join(f"c{j}" if j != 11 * i else "other" for j in range(400))) for i in range(1, 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    prints = {i: simhash.fold(neardup.shingle_set(simhash.words_of(t))) for i, t in rows}
    sets = {i: shingles(t)[1] for i, t in rows}
    alike = [(i, j) for i in sets for j in sets if i < j and sets[i] and len(sets[i] & sets[j]) * 10 >= 8 * len(sets[i] | sets[j])]
    reached = {(i, j) for i, j in alike if (prints[i] ^ prints[j]).bit_count() <= neardup.RADIUS}
    assert reached and len(reached) < len(alike)  # some are out of reach of fingerprints
    whole, seen = neardup.candidates, []

    def watched(texts, measured, nodes, *more):
        ids = {neardup.content(simhash.words_of(t)): i for i, t in rows}
        kin = {ids[bytes(r.x)]: bytes(r.kin) for r in nodes.collect()}
        found = whole(texts, measured, nodes, *more)
        seen.append((kin, [(ids[bytes(r.src)], ids[bytes(r.dst)]) for r in found.collect()]))
        return found

    monkeypatch.setattr(neardup, "candidates", watched)
    kept = {r.doc_id for r in neardup.keep_one(docs).collect()}
    (kin, further), = seen
    assert all(kin[i] == kin[j] for i, j in reached if i in kin and j in kin)
    assert further and all(kin[i] != kin[j] for i, j in further)
    expected = groups(rows)
    assert kept == {min(rows[k][0] for k, g in enumerate(expected) if g == own) for own in set(expected)}
    monkeypatch.setattr(neardup, "candidates", lambda texts, measured, nodes, *more: whole(texts, measured, nodes, *more).limit(0))
    alone = {r.doc_id for r in neardup.keep_one(docs).collect()}  # by fingerprints and the exact check
    assert kept < alone < set(sets)


def test_small_tables_are_few_files(spark, monkeypatch):
    """Round 3, pipeline: each table had a file for each partition of a shuffle, and each file started processes beside the executor."""
    written, whole = [], session.materialize

    def watched(df, label, *more):
        out = whole(df, label, *more)
        written.append((label, len(out.inputFiles())))
        return out

    for module in (neardup, simhash, components):
        monkeypatch.setattr(module, "materialize", watched)
    rows = corpus(4, bases=20)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 16)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    expected = groups(rows)
    assert got == {i: min(rows[k][0] for k, g in enumerate(expected) if g == own) for (i, _), own in zip(rows, expected)}
    assert {"near-nodes", "components", "simhash-cells", "near-groups"} <= {label for label, _ in written}
    assert all(files <= 3 for _, files in written), written
    many = 3 * session.ROWS_A_FILE  # larger ones keep their tasks
    assert len(whole(spark.range(many).repartition(8), "wide", many).inputFiles()) == 3
    assert len(whole(spark.range(many).repartition(2), "wide", many).inputFiles()) == len(whole(spark.range(many).repartition(2), "wide").inputFiles()) == 2
