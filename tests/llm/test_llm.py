"""The operators on small tables: contracts against brute force, and nulls, empties, repeats, ties, long texts and clashing columns."""

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismata.llm import blocks, bpe, decontam, extract, fixity, langid, lm, neardup, quality, simhash, suffixdedup, urlgraph

LONG = "alpha beta gamma " * 3000
TEXTS = ["", None, "one", "a b c a b c", "The cat sat.\nThe cat sat.\n x", "É é Ä", LONG, "a\tb\x0bc\x0cd\re  f", "😀 emoji 😀", "Same text here", "Same text here", "### *** $$$"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 long, body string, w string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", None, 1, "b", "w") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [(None, "no id", None, None, None, None, None, None), (3, "a b c a b c", "en", "s", 1, 1, "b", "w")], SCHEMA).repartition(3)


def every(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_blocks_round_trip():
    a = np.array([0, 5, 1 << 20, 3], "<u4")
    assert (blocks.unpack_planes(blocks.pack_planes(a)) == a).all()
    x, y = blocks.unpack(blocks.pack(b"ab", a))
    assert x == b"ab" and (y == a).all()


def brute_repeats(text):
    w = text.split()
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    return len({p for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for p in range(i, i + 3)})


def test_quality(spark, docs):
    rows = quality.judge(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    by = {r.doc_id: r for r in rows}
    for i, t in every(docs):
        words = (t or "").encode().split()
        assert by[i].n_words == len(words) and by[i].n_repeat_words == brute_repeats(t.replace("\x1c", ""))
        assert by[i].word_chars == sum(len(x.decode()) for x in words)
    assert by[4].n_dup_lines == 1 and by[11].n_symbols == 9 and not by[0].kept and by[0].base_failed
    assert quality.judge(docs.filter("false")).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_suffix_dedup_against_brute_force(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(60)
    texts = [prose(80), passage, prose(30) + passage + prose(20), passage[:150] + prose(9), "ab" * 200, "zz" + "ab" * 150, "", None, "x" * 63, prose(40) * 2]
    texts += [texts[0]] * 5 + [prose(10) + passage[40:] for _ in range(30)]
    df = spark.createDataFrame([(i if i != 5 else None, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string").repartition(4)
    ours = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.dedup_digest(df, 64).collect())
    raws = [(i, (t or "").encode()) for i, t in [(i if i != 5 else -1, t) for i, t in enumerate(texts)] + [(0, texts[0])]]
    count = collections.Counter(x[i : i + 64] for _, x in raws for i in range(len(x) - 63))
    want = []
    for i, x in raws:
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - 63):
            if count[x[k : k + 64]] > 1:
                gone[k : k + 64] = True
        kept = bytes(b for b, g in zip(x, gone) if not g)
        want.append((i, len(x), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert ours == sorted(want)
    left = suffixdedup.strip(df.withColumn("spans", F.lit(1)), 64)
    assert left.columns == ["doc_id", "text", "spans"] and left.count() == len(raws)
    assert suffixdedup.dedup_digest(df.filter("false"), 64).count() == 0


def test_suffix_digest_has_the_text_that_is_left(spark, tmp_path):
    """Repeats of 400 bytes go wherever they stand, one byte less stays; what is left can be read beside its digest."""
    passage = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(400))
    texts = {1: "one-" + passage + " end", 2: "two+" + passage, 3: None, 4: "", 5: "three=" + passage[:399], 6: "é" + "z" * 401 + "é"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in suffixdedup.op2_suffix_dedup(spark, str(tmp_path)).collect()}
    want = texts | {1: "one- end", 2: "two+", 6: "éé"}
    assert {i: r.text for i, r in got.items()} == want
    for i, t in want.items():
        left = (t or "").encode()
        assert got[i].kept_sha256 == hashlib.sha256(left).hexdigest() and got[i].n_bytes - got[i].n_removed == len(left), i
    # the second byte of é and of ĩ is the same: the first alone is left, which the digest has and the text has not
    cut = spark.createDataFrame([(1, "aé" + "k" * 70), (2, "bĩ" + "k" * 70)], "doc_id long, text string")
    assert {(r.doc_id, r.text, r.kept_sha256) for r in suffixdedup.dedup_digest(cut, 64).collect()} == {(1, "a", hashlib.sha256(b"a\xc3").hexdigest()), (2, "b", hashlib.sha256(b"b\xc4").hexdigest())}


def test_suffix_order_in_a_file(tmp_path, monkeypatch):
    monkeypatch.setattr(suffixdedup, "IN_MEMORY", 10)
    bodies = [b"q" * 10 + b"abcdefgh" * 12, b"abcdefgh" * 11, b"r" * 90]
    count = collections.Counter(x[i : i + 64] for x in bodies for i in range(len(x) - 63))
    got = suffixdedup.repeated_windows(bodies, 64, None, str(tmp_path))
    assert [g.tolist() for g in got] == [[i for i in range(len(x) - 63) if count[x[i : i + 64]] > 1] for x in bodies]


def test_bpe_round_trip(spark, docs):
    import public_tokenizers
    import tiktoken

    with open(bpe.default_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in bpe.encode(docs).collect())
    want = []
    for i, t in every(docs):
        ids = e.encode_ordinary(t)
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), tuple(ids)))
    assert ours == sorted(want)
    assert sorted(r.text for r in bpe.decode(bpe.encode(docs)).collect()) == sorted(t for _, t in every(docs))
    assert bpe.encode(docs.filter("false")).count() == 0


def test_lm_against_formula(spark, docs):
    prior, least = 50.0, 2
    rows = [(i, lm.tokens(t)) for i, t in every(docs)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c, b, starts = collections.Counter(), collections.Counter(), 0
    for i, t in rows:
        if not held(i):
            c.update(t)
            b.update(zip([None, *t[:-1]], t))
            starts += 1
    n, v = sum(c.values()), len(c)

    def value(t):
        total, h = 0.0, None
        for w in t:
            p = (c[w] or v) / (n + v)
            ok = c[w] >= least and (h is None or c[h] >= least)
            total += math.log10(((b[h, w] if ok else 0) + prior * p) / ((starts if h is None else c[h]) + prior))
            h = w
        return total

    want = sorted((str(i), held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6), round(value(t), 6)) for i, t in rows)
    ours = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs, prior=prior, least=least).collect())
    assert [x[:5] for x in ours] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in ours], [x[5:] for x in want], atol=1e-5)
    assert lm.score(docs.filter("false")).count() == 0


def test_lm_counts_bigrams_of_rare_words(spark):
    one = spark.createDataFrame([(0, "a b")], "doc_id long, text string")
    assert zlib.crc32(b"0") % 7 != 2  # it trains
    assert abs(lm.score(one).first().score - 3 * math.log10((1 + 1000 / 6) / 1001)) < 1e-6


def test_langid(spark):
    r = random.Random(1)
    bag = {"xx": "ka ko ki ku ke".split(), "yy": "lam lom lim lum".split(), "zz": "ß ü öz äß".split()}
    rows = [(i, " ".join("".join(r.choice(bag[k]) for _ in range(3)) for _ in range(20)), k) for i, k in enumerate(["xx", "yy", "zz"] * 30)]
    rows += [(200, None, "xx"), (201, "123 !!", "xx"), (202, "漢", None), (203, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", langid.held_out())
    out = {x.doc_id: x for x in langid.predict(df, langid.train(df.filter("NOT held_out"))).collect()}
    assert all(out[i].lang_pred == k and 0 <= out[i].score <= 1 for i, _, k in rows[:90])
    assert [out[i].lang_pred for i in (200, 201, 203)] == ["und"] * 3 and out[202].lang_pred in bag and out[202].score == 0
    none = df.filter("false")
    assert langid.predict(none, langid.train(none)).count() == 0
    assert {x.lang_pred for x in langid.predict(df, langid.train(none)).collect()} == {"und"}


def test_bloom_masks():
    f = langid.Filters([f"l{i}" for i in range(70)], 1 << 12)
    h = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    f.add(1, h[:50])
    f.add(69, h[25:75])
    m = f.look(h)
    assert (m[0, :50] >> np.uint64(1) & np.uint64(1)).all() and (m[1, 25:75] >> np.uint64(5) & np.uint64(1)).all()


def components(fps, radius):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("crowd", [4, 64])
def test_simhash_grid_finds_every_link(spark, crowd):
    r = random.Random(7)
    seeds = [r.getrandbits(64) for _ in range(30)]
    fps = list(dict.fromkeys(s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for s in seeds for _ in range(15)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f, 0, i) for i, f in enumerate(signed)], "fp long, t int, node long")
    edges = [(x.a, x.b) for x in simhash.links(df, 3, crowd).collect()]
    assert all(bin(fps[a] ^ fps[b]).count("1") <= 3 for a, b in edges)
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(fps))] == components(fps, 3)


def test_simhash_rows(spark, docs):
    rows = simhash.classify(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[0].fingerprint == "0" * 16 and by[0].component_id == by[1].component_id == 0
    assert by[9].component_id == by[10].component_id == 9
    assert simhash.classify(docs.filter("false")).count() == 0


def test_near_duplicates_by_shingles(spark):
    r = random.Random(5)
    base = [f"w{r.randint(0, 99999)}" for _ in range(300)]
    near, far = list(base), list(base)
    near[100] = near[200] = "edited"
    far[10::30] = ["other"] * len(far[10::30])
    rows = [(5, base), (2, near), (9, base), (7, far), (8, [f"x{i}" for i in range(300)])]
    df = spark.createDataFrame([(i, " ".join(w).upper() if i == 9 else " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = dict(neardup.near_duplicates(df).select("doc_id", "component_id").collect())
    assert got == {5: 2, 2: 2, 9: 2, 7: 7, 8: 8}
    assert sorted(x.doc_id for x in neardup.keep_one(df).collect()) == [2, 7, 8]


def brute_groups(sets, similarity=0.8):
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_near_duplicates_find_appended_and_truncated_copies(spark):
    r = random.Random(11)
    footer, texts = [f"f{i}" for i in range(400)], []
    for _ in range(40):
        w = [f"w{r.randint(0, 99999)}" for _ in range(r.randint(60, 400))]
        k = int(len(w) * r.uniform(0.05, 0.3))
        cut = r.randint(0, len(footer) - k)
        edited = ["edited" if r.random() < 0.02 else x for x in w]
        texts += [w, w + footer[cut : cut + k], w[:-k], w[k:], edited]
    texts = [" ".join(w) for w in texts]
    want = brute_groups([set(simhash.shingle_hashes(t, 5).tolist()) for t in texts])
    got = dict(neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("block", [neardup.BLOCK, 8000])
def test_a_crowd_around_the_threshold_falls_apart_as_its_pairs_do(spark, monkeypatch, block):
    monkeypatch.setattr(neardup.verified_links, "__defaults__", (neardup.SIMILARITY, block))
    r = random.Random(3)
    base = [f"w{r.randint(0, 99999)}" for _ in range(343)]
    texts = [" ".join(f"e{r.randint(0, 99999)}" if r.random() < 0.016 else x for x in base) for _ in range(150)]
    want = brute_groups([set(simhash.shingle_hashes(t, 5).tolist()) for t in texts])
    assert 10 < len(set(want)) < 140
    got = dict(neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [got[i] for i in range(len(texts))] == want


def brute_hits(text, items):
    import re

    low = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in s or ""))
    w, hit, found = low(text), set(), set()
    for item, t in items:
        u = low(t)
        n = min(10, len(u))
        for win in [u[i : i + n] for i in range(len(u) - n + 1)] if u else []:
            for i in range(len(w) - n + 1):
                if w[i : i + n] == win:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("small", [decontam.SMALL, 0])
def test_decontamination(spark, monkeypatch, small):
    monkeypatch.setattr(decontam, "SMALL", small)
    r = random.Random(2)
    prose = lambda n: " ".join(r.choice("alpha BETA gamma delta eps zeta é É".split()) for _ in range(n))
    items = [(1, prose(25)), (2, "Short, item"), (3, "single"), (4, ""), (5, None), (6, prose(10)), (7, "É É")]
    texts = [prose(60), items[0][1], prose(5) + " " + items[5][1] + "!! " + prose(5), "a short item", "SINGLE", "", None, "é é", prose(3) + " " + " ".join(items[0][1].split()[7:19])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "single")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {x.doc_id: x for x in decontam.judge(docs, bench).collect()}
    for i, t in [*enumerate(texts), (None, "single")]:
        n, hit, found = brute_hits(t, items)
        x = out[i]
        assert (x.n_words, x.n_hit, x.n_items, x.contaminated, x.items_sha256) == (n, hit, len(found), hit > 0, hashlib.sha256(",".join(found).encode()).hexdigest()), i
    assert decontam.judge(docs, bench.filter("false")).filter("contaminated").count() == 0
    assert decontam.judge(docs.filter("false"), bench).count() == 0


def test_decontamination_judges_rows_not_ids(spark):
    leak = "one two three four five six seven eight nine ten"
    rows = [(1, leak + " more", "a", 1), (1, "clean words only", "a", 1), (1, leak + " more", "b", 2), (None, leak, "a", 3), (None, "clean too", "a", 3), (2, "word " * 30_000 + leak, "a", 4), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string, n long")
    bench = spark.createDataFrame([(7, leak), (8, leak.upper()), (9, "never seen anywhere")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in decontam.judge(docs, bench).collect())
    assert got == sorted([(1, 11, 10, 2), (1, 3, 0, 0), (1, 11, 10, 2), (0, 10, 10, 2), (0, 2, 0, 0), (2, 30_010, 10, 2), (3, 0, 0, 0)])
    left = decontam.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "", r.k1 or "", r.n or 0) for r in left.collect()) == [(0, "clean too", "a", 3), (1, "clean words only", "a", 1), (3, "", "", 0)]
    assert decontam.drop_contaminated(docs, bench.filter("false")).count() == len(rows)


def test_extraction():
    page = '<header>Site</header><div class="cookie-notice">c</div><article><h1>T &amp; x</h1><p>one<br>two</p><aside>s</aside><p class=ad>buy<p>three<script>var t="</p>";</script></p><form><input><p>f</p></form><section class="comments"><p>c1</p></section></article><footer>f</footer>'
    assert extract.main_text(page) == "T & x\n\none two\n\nthree"
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("<nav>x</nav>") == ""
    assert extract.main_text("a < b <b>x") == "a < b x"
    body = "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(5))
    plain = f"<ul>{'<li>x</li>' * 9}</ul><div>{body}</div><p>y</p><p>y</p><p>y</p><p>y</p>"
    assert [x[-1] for x in extract.main_text(plain).split("\n\n") if x.startswith("word")] == list("01234")
    assert extract.surges(np.array([0, 0, 0, 50, 50, 50, 0, 0, 0]), 80).tolist() == [False, False, True, True, True, True, True, False, False]


def test_surges_equal_a_brute_force_windower():
    r = random.Random(8)
    for _ in range(300):
        w = [r.choice([0, 3, 20, 41, 90]) for _ in range(r.randrange(12))]
        want = [any(sum(w[max(a, 0) : a + 3]) > 80 for a in range(i - 2, i + 1)) for i in range(len(w))]
        assert extract.surges(np.array(w, np.int64)).tolist() == want


def test_extraction_of_undeclared_pages():
    line = lambda k: "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(k))
    menu = "<ul><li>Home</li><li>About us</li></ul>"
    page = f"<div>{menu}<div class=text><h2>Head</h2><p>Short.</p>{line(5)}{'<div class=advert>buy</div>' * 4}{line(4)}<ul><li>a point</li></ul><p>The end.</p></div><div><a href=x>{'linked ' * 40}</a></div></div>"
    blocks = extract.main_text(page).split("\n\n")
    assert blocks[:2] == ["Head", "Short."] and blocks[-2:] == ["a point", "The end."] and len(blocks) == 13
    assert extract.main_text("<div><p>a few</p><p>words</p></div>") == "a few\n\nwords"
    # teasers are declared articles too, but no surge lies in them and they link to something; other short articles stay
    assert extract.main_text(f"<article>{line(3)}<p>end</p></article><article><h2><a href=x>More</a></h2><p>teaser</p></article>").endswith("2\n\nend")
    assert extract.main_text(f"<article>{line(3)}<p>end</p></article><article><p>short</p></article>").endswith("2\n\nend\n\nshort")
    assert extract.main_text("İ<SCRIPT>x</SCRIPT><p>two</p>") == "İ\n\ntwo"


@pytest.mark.parametrize("page", ["<a " * 350_000, "<form>" * 150_000, '<a "' * 250_000, "<div>" * 100_000 + "</section>" * 50_000, "<script>" * 100_000, "<" * 1_000_000])
def test_extraction_takes_linear_time(page):
    import time

    start = time.perf_counter()
    extract.main_text(page)
    assert time.perf_counter() - start < 5


def test_extract_rows(spark):
    page = f"<article><p>{'word ' * 20_000}</p></article>"
    rows = [(1, "u", page, "x", 9), (1, "u", page, "x", 9), (2, None, None, None, None), (None, "v", "<p>x", "y", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    out = extract.extract(pages).collect()
    assert sorted((r.page_id or 0, r.url, r.n_chars) for r in out if r.url) == [(0, "v", 1), (1, "u", 99_999), (1, "u", 99_999)]
    assert [r.text for r in out if r.url is None] == [""] and extract.extract(pages.limit(0)).count() == 0
    assert out[0].__fields__ == ["page_id", "url", "text", "n_chars"]


def test_url_graph(spark):
    link = '<a href="http://Bad.org/x">b</a><a HREF=//good.org>g</a><a href="/own">o</a>'
    rows = [(1, "http://a.com/x", link), (2, "http://Bad.org/en/1?q#f", None), (3, "https://spam.net/es/1", '<a href="http://bad.org/">x</a>'), (4, None, None), (5, "no scheme", ""), (6, "http://www.example.com/en/a", ""), (7, "http://m.example.com/en/a", ""), (8, "http://c.com", ""), (9, "http://link.org/", '<a href="http://spam.net/">x</a>')]
    out = {r.page_id: r for r in urlgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (out[2].host, out[2].path, out[2].rule) == ("bad.org", "/en/1", None)
    assert (out[4].host, out[4].path, out[4].verdict) == ("", "", "allow") and out[5].host == ""
    assert (out[6].rule, out[6].verdict) == ("www.example.com/en/", "allow") and (out[7].rule, out[7].verdict) == ("example.com/en/", "block")
    assert out[8].rule is None and out[8].path == ""
    assert out[9].verdict == "block"  # it links to a blocked host, nothing trusted links to it
    assert urlgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string").filter("false")).count() == 0


def test_trust_reaches_hosts_far_away(spark):
    page = lambda k: f'<a href="http://h{k + 1}.org/">next</a>'
    rows = [(0, "http://a.net/es/1", page(-1))] + [(k + 1, f"http://h{k}.org/", page(k)) for k in range(24)] + [(99, "http://z.com/", '<a href="http://h30.org/">x</a>')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    known = {r.host: r for r in urlgraph.host_verdicts(pages, rules=(("com", "/", "allow"), ("net", "/es/", "block"))).collect()}
    assert known["h30.org"].trust > 0
    chain = {r.host: r for r in urlgraph.host_verdicts(spark.createDataFrame([(k, f"http://h{k}.com/", page(k).replace("org", "com")) for k in range(20)] + [(50, "http://s.net/", page(-1).replace("org", "com"))], "page_id long, url string, html string"), rules=(("net", "/", "allow"),)).collect()}
    assert chain["h15.com"].trust > 0 and chain["h15.com"].verdict == "allow"


def test_crowded_cells_are_cut_finer(spark):
    r = random.Random(21)
    base = [r.getrandbits(64) for _ in range(6)]
    prints = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randrange(5))) for b in base for _ in range(60)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x), 0, signed(x)) for x in prints], "fp long, t int, node long")

    def roots(pairs):
        parent = {signed(x): signed(x) for x in prints}

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in pairs:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return {x: find(x) for x in parent}

    want = roots((signed(x), signed(y)) for x in prints for y in prints if x < y and (x ^ y).bit_count() <= 3)
    for crowd, most in ((64, 1 << 15), (4, 3), (2, 1)):
        found = simhash.links(df, 3, crowd, most).collect()
        assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 3 for r in found)
        assert roots((r.a, r.b) for r in found) == want, (crowd, most)


def test_fingerprints_of_a_whole_table(spark):
    import re

    import xxhash

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.fingerprint for r in simhash.classify(docs).collect()}
    for row in docs.select("doc_id", "text").collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in row.text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        bits = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))
        assert got[row.doc_id] == f"{bits:016x}"


def test_merkle_audit(spark):
    rows = [(i, f"u{i}", "x" * (i % 7), "s", 5) for i in range(500)] + [(7, "u7", "x" * 0, "s", 5), (None, "u", "x", "s", 5), (None, "u", "x", "s", 5), (None, "v", "y" * 100_000, "s", 5), (600, None, None, None, None)]
    a = spark.createDataFrame(rows, "page_id long, url string, html string, leaf string, start long")
    same = lambda x: fixity.leaves(x, "page_id", "url", "html")
    out = fixity.audit(same(a), same(a)).collect()
    assert len(out) == len(rows) and {r.status for r in out} == {"ok"} and sum(r.rec is None for r in out) == 3
    changed = F.when((F.col("page_id") == 100) | (F.col("page_id").isNull() & (F.col("url") == "v")), "?").when(F.col("page_id") == 200, "longer " * 9).otherwise(F.col("html"))
    b = a.filter("page_id IS NULL OR page_id != 300").withColumn("html", changed).union(spark.createDataFrame([(-9, "n", "n", "s", 1)], a.schema))
    found = fixity.audit(same(a), same(b)).filter("status != 'ok'").collect()
    moved = {r.rec for r in found if r.status == "moved"}
    assert {(r.rec, r.status) for r in found if r.status != "moved"} == {(300, "missing"), (100, "corrupt"), (200, "corrupt"), (-9, "extra"), (None, "missing"), (None, "extra")}
    sizes = {i: i % 7 for i in range(500)}
    assert moved == set(range(201, 256)) | set(range(301, 320)) | (set(range(101, 128)) if sizes[100] != 1 else set())
    shards = {r.shard for r in fixity.differing_shards(*(fixity.offsets(same(x).filter("rec IS NOT NULL")) for x in (a, b))).collect()}
    assert shards == {300 // 64, 100 // 64, 200 // 64, -1}
    # a changed offset alone is seen: the records are the same, one stands elsewhere
    twice = a.filter("page_id BETWEEN 64 AND 127")
    other = fixity.offsets(same(twice)).withColumn("start", F.col("start") + F.when(F.col("rec") == 70, 1).otherwise(0))
    assert [r.shard for r in fixity.differing_shards(fixity.offsets(same(twice)), other).collect()] == [1]
    assert fixity.audit(same(a.filter("false")), same(a.filter("false"))).count() == 0


def test_langid_equals_exact_sets(spark):
    """The filters, against Python sets of n-grams without a filter."""
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path).withColumn("held_out", langid.held_out())
    got = {r.doc_id: r for r in langid.predict(docs, langid.train(docs.filter("NOT held_out"))).collect()}
    rows = docs.collect()

    def grams(text):
        plain = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
        out = []
        for word in plain.split():
            for k in langid.ORDERS:
                padded = word if k == 1 else f" {word} "
                out += [(k, padded[i : i + k]) for i in range(len(padded) - k + 1)]
        return out

    counts = collections.defaultdict(lambda: collections.defaultdict(collections.Counter))
    size = collections.Counter()
    for r in rows:
        if not r.held_out and r.lang and r.text is not None:
            size[r.lang] += 1
            for k, g in grams(r.text):
                counts[r.lang][k][g] += 1
    share = {(x, k, g): n / sum(c.values()) for x, by in counts.items() for k, c in by.items() for g, n in c.items()}
    most = collections.defaultdict(float)
    for (x, k, g), p in share.items():
        most[k, g] = max(most[k, g], p)
    held = {key for key, p in share.items() if p >= langid.SHARE * most[key[1:]]}
    order = sorted(size, key=lambda x: (-size[x], x))
    for r in rows:
        own = grams(r.text or "")
        if not own:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        hits = [sum((x, *g) in held for g in own) for x in order]
        best = max(range(len(order)), key=lambda i: (hits[i], -i))
        ranked = sorted(hits, reverse=True)
        if ranked[0] - ranked[1] > 0.01 * len(own):  # nearer ones may turn on a false positive
            assert got[r.doc_id].lang_pred == order[best], r.doc_id
        assert abs(got[r.doc_id].score - max(hits) / max(sum(hits), 1)) < 0.02


def test_langid_repeats_long_texts_and_clashing_columns(spark):
    rows = [(1, "the cat " * 30_000, "en", "x", 0.5), (1, "the cat " * 30_000, "en", "x", 0.5), (2, "le chat noir", "fr", None, None), (None, "le chien", "fr", None, None), (3, None, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double").withColumn("held_out", F.lit(False))
    out = langid.predict(docs, langid.train(docs)).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in out) == [(0, "fr"), (1, "en"), (1, "en"), (2, "fr"), (3, "und")]


def test_lm_probabilities_add_up_to_one():
    text = "a b a c b a a d b c a".split()
    seen = collections.Counter([*text, "end"])
    words = [*seen, "unknown"]
    pairs = collections.Counter(zip([None, *text], [*text, "end"]))
    known = np.array([seen[w] for w in words], np.int64)
    automaton = lm.Automaton(known, sum(seen.values()), len(seen), 1, 7.0)
    for i, h in enumerate([*words, None]):
        if h == "end":
            continue  # nothing follows it
        arcs = np.array([pairs[h, w] for w in words], np.int64)
        state = np.full(len(words), -1 if h is None else i)
        assert abs((10 ** automaton.traverse(state, np.arange(len(words)), arcs)).sum() - 1) < 1e-9, h


def test_blocks_of_settled_texts(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string").write.parquet(path)
    scan = spark.read.parquet(path).filter("doc_id > 0").select("doc_id", "text")
    assert blocks.settled(scan, "x") is scan
    shuffled = scan.repartition(3)
    assert blocks.settled(shuffled, "x") is not shuffled
    assert blocks.part_count(spark, 100 << 30) == 100 * 16
