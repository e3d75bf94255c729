"""MinHash near-dedup, conversation trie and whitening: brute force, nulls, empties, repeats, ties, long texts, clashing columns, forced splits."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from prismata.llm import minhash, trie, whiten

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


# MinHash


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def near_groups(rows):
    """(doc_id, n_shingles, component_id, kept) of each row, by comparing all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        known = [x for x in ids[find(i)] if x is not None]
        least = min(known) if known else None
        out.append((d, len(sets[i]), least, least is None or d == least))
    return sorted(out, key=str)


def near_corpus(seed):
    """Groups around shared bases with few or many changes, a large group, chains, and passages that make none alike."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)] + ["Ünlü", "STRASSE", "Straße"]
    passage = [rng.choice(vocabulary) for _ in range(80)]
    texts = ["", None, " \t\n", "one", "ONE", "one two", "a b c", "a b c d", "x " * 3000, "Ä ä Ä"]
    for k in range(20):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 40, 120, 300]))]
        if k % 2:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        texts.append(" ".join(base))
        for _ in range(40 if k == 3 else rng.randrange(5)):
            w = list(base)
            for _ in range(rng.randrange(1, max(2, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w + [rng.choice(vocabulary) for _ in range(rng.randrange(4))]))
    chain = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(12):  # each near the one before, the ends far apart
        chain = chain[12:] + [rng.choice(vocabulary) for _ in range(12)]
        texts.append(" ".join(chain))
    texts += rng.sample(texts, 15)
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(None if k % 37 == 5 else order[k], t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("bounds", [{}, {"crowd": 2, "most": 6, "most_shingles": 1500}], ids=["whole", "split"])
def test_near_groups_against_all_pairs(spark, bounds):
    rows = near_corpus(5)
    docs = spark.createDataFrame([(d, t, b"k", 1) for d, t in rows], "doc_id long, text string, x binary, n int").repartition(5)
    got = sorted((tuple(r) for r in minhash.classify(docs, **bounds).collect()), key=str)
    assert got == near_groups(rows)


def test_near_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(7, "a b c d e f g h"), (7, "a b c d e f g h"), (3, "A b C d e f g h"), (None, "z"), (None, "z"), (4, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash.classify(docs).collect()), key=str)
    assert got == sorted([(7, 6, 3, False), (7, 6, 3, False), (3, 6, 3, True), (None, 1, None, True), (None, 1, None, True), (4, 0, 4, True)], key=str)
    assert minhash.classify(docs.filter("false")).count() == 0


def test_a_large_group_makes_no_pairs(spark):
    """600 texts that differ in one word: rows of the sweeps stay in proportion."""
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(base[: i % 140] + [f"new{i}"] + base[i % 140 + 1 :])) for i in range(600)]
    got = minhash.classify(spark.createDataFrame(rows, "doc_id long, text string"), crowd=4, most=100, most_shingles=20_000)
    assert {r.component_id for r in got.collect()} == {0}
    members = spark.createDataFrame([("g", f"x{i:03}".encode(), 100, bytes([17 * (i % 3)] * 32), 1) for i in range(600)], "grp string, x binary, n long, brief binary, w long")
    links = minhash.connect(members, 100, 28).count()
    assert 597 <= links < 1500


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    a, b = both[:800], both[100:]
    agree = np.mean([(minhash.signature(a + np.uint64(k)) == minhash.signature(b + np.uint64(k))).mean() for k in range(50)])
    assert abs(agree - 700 / 900) < 0.02


def test_briefs_miss_nothing_that_agrees():
    rng = np.random.default_rng(4)
    sig = rng.integers(0, 1 << 32, (50, minhash.COORDINATES)).astype(np.uint32)
    sig[1:, :40] = np.where(rng.random((49, 40)) < 0.5, sig[0, :40], sig[1:, :40])
    brief = minhash.briefs(sig)
    want = ((sig & 15) == (sig[0] & 15)).sum(1)
    assert (minhash.agreeing(brief, brief[0]) == want).all() and (want >= (sig == sig[0]).sum(1)).all() and want[0] == 64


# Trie


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h, donor = zlib.crc32(str(c).encode()) % 4, int(c - np.fmod(c, 20))
        whole[c] = tuple(own.get(donor, [])[:h] + turns[h:])
    nodes = collections.defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    children = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(members) - 1) * words
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(c for c in nodes[k] if whole[c] == k))).encode()).hexdigest()
    return sorted(((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(k)) for k, m in nodes.items()), key=str)


def dialogues(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-25, 130), 10**12 + 7]:
        if c % 9 == 4 or c == 60:
            continue  # absent, some of them those that others begin with
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, None if rng.random() < 0.05 else rng.randrange(t + 2), rng.choice(["user", "assistant", None, ""]), rng.choice(["hi there", "Hi there", "a\tb  c", "", None, "é x"])))
    rows += [(3, 1, "user", "again")] * 3 + [(None, 0, "user", "lost"), (40, 0, "user", "word " * 5000)]
    return rows


@pytest.mark.parametrize("parts", [1, 9])
def test_trie_against_brute_force(spark, parts):
    rows = dialogues(parts)
    table = spark.createDataFrame([(*r, "n", 1) for r in rows], "conv_id long, turn long, role string, text string, name string, depth int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = trie.trie(table.repartition(parts, "turn"))
        names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert sorted((tuple(r) for r in got.select(names).collect()), key=str) == brute_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_of_one_long_and_many_equal_conversations(spark):
    """One conversation fills many sorted partitions, and copies of it make one path, not a round for each turn."""
    long = [(20, t, "user", f"turn {t}") for t in range(400)]
    rows = long + [(40, *r[1:]) for r in long] + [(c, t, "user", f"turn {t}") for c in (60, 80) for t in range(3)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        assert sorted((tuple(r) for r in trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=str) == brute_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.trie(empty).count() == 0


def test_ends_are_hashed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 16)
    ids = [*range(-30, 200, 7), 10**15]
    got = trie.ends_digests(spark.createDataFrame([(n, c) for c in ids for n in (b"a", b"b")], "name binary, conv_id long").repartition(4)).collect()
    assert {(bytes(r.name), r.ends) for r in got} == {(n, hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()) for n in (b"a", b"b")}


# Whitening


def brute_whiten(rows, k=16):
    x = np.array([[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows], object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), object)
    n, sums = len(fit), fit.sum(0)
    centred = ((n * fit - sums) / n).astype(float)
    cov = centred.T @ centred / n
    values, turns = np.linalg.eigh(cov)
    values, turns = values[::-1][:k], turns[:, ::-1][:, :k]
    good = values > 1e-12 * values[0]
    white = ((n * x - sums) / n).astype(float) @ turns[:, good] / np.sqrt(values[good])
    return n, ((n * x - sums) ** 2).sum(1), white, values[good] / np.trace(cov)


def check_whitened(got, rows, k=16):
    n, deviation, white, explained = brute_whiten(rows, k)
    by = collections.defaultdict(dict)
    for r in got:
        by[r.vec_id][r.component] = r
    assert len(got) == len(rows) * white.shape[1]
    for (i, _), dev, w in zip(rows, deviation, white):
        for c in range(1, white.shape[1] + 1):
            r = by[i][c]
            assert r.n == n and int(r.deviation) == dev and abs(r.explained / explained[c - 1] - 1) < 1e-8 and r.identity_error < 1e-8
            assert abs(abs(r.whitened) - abs(w[c - 1])) < 1e-7 * (1 + abs(w[c - 1]))


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, x int, component string").repartition(3)


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(24) * np.linspace(4, 0.5, 24)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # copies count once
    bad = [(2000, None), (2001, [float("nan")] * 24), (2002, [1.0] * 23 + [float("inf")]), (2003, [None] + [1.0] * 23), (2004, [1.0] * 3), (2005, []), (2006, [3e38] * 24)]
    check_whitened(whiten.whiten(table_of(spark, rows + bad)).collect(), rows)


def test_whitening_of_low_rank_and_repeated_eigenvalues(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-9, 9, (5, 20))
    flat = [(i, (rng.integers(-3, 4, 5) @ base / 64).tolist()) for i in range(80)]  # rank five of twenty dimensions
    check_whitened(whiten.whiten(table_of(spark, flat)).collect(), flat)
    cross = [(2 * j + s, [(1 - 2 * s) * 2.0 * (j == d) for d in range(6)]) for j in range(6) for s in range(2)]  # all eigenvalues equal
    got = whiten.whiten(table_of(spark, cross), components=4).collect()
    assert len(got) == 48 and max(r.identity_error for r in got) < 1e-9 and all(abs(r.explained - 1 / 6) < 1e-9 for r in got)


def test_whitening_of_large_numbers_and_of_nothing(spark):
    rows = [(i, [float((i * 37 + d * 11) % 23) * 1e12, float(i % 7), float(d)]) for i, d in ((i, i % 5) for i in range(40))]
    got = whiten.whiten(table_of(spark, rows), components=1).collect()
    n, deviation, _, _ = brute_whiten(rows, 1)
    assert {r.vec_id: int(r.deviation) for r in got} == {i: int(d) for (i, _), d in zip(rows, deviation)} and max(deviation) > 1 << 63
    huge = [(i, [1e15 * (i % 30), 1.0]) for i in range(60)]  # beyond 38 digits
    assert {r.deviation for r in whiten.whiten(table_of(spark, huge), components=1).filter("vec_id % 30 = 0").collect()} == {None}
    for few in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])]):
        assert whiten.whiten(table_of(spark, few)).count() == 0


@pytest.mark.parametrize("d,block", [(40, 4), (40, 16), (7, 16)])
def test_lanczos_by_residuals(d, block):
    rng, seen = np.random.default_rng(d), []
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = np.r_[[9.0, 9.0, 9.0, 5.0], np.linspace(1, 0, d - 4)]
    matrix = turn @ np.diag(values) @ turn.T
    got, vectors = whiten.lanczos(lambda v: (seen.append(v.shape[1]), matrix @ v)[1], d, 3, block)
    assert np.allclose(got, 9, atol=1e-12) and np.allclose(matrix @ vectors, 9 * vectors, atol=1e-11) and np.allclose(vectors.T @ vectors, np.eye(3), atol=1e-12)
    assert sum(seen) <= d
