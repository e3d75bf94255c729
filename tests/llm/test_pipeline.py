"""Each stage on what its predecessor kept, against brute force, on the smallest tables."""

import hashlib
import os
import re

import numpy as np
import pytest

import corpus_pipeline
from prismata import session
from prismata.llm import quality, simhash

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_stages(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, path = docs, str(tmp_path / str(k))
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = (before.toPandas(), docs.toPandas())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
    before, after = seen["simhash near-dedup"]
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text, 5).tolist()) for r in before.itertuples()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    assert set(after.doc_id) == {i for i in ids if find(i) == i}
    before, after = seen["quality rules"]
    assert set(after.doc_id) == {r.doc_id for r in before.itertuples() if good(r.text or "")}
    before, after = seen["suffix-array dedup"]
    raws = {r.doc_id: (r.text or "").encode() for r in before.itertuples()}
    length, count = corpus_pipeline.PASSAGE, {}
    for raw in raws.values():
        for i in range(len(raw) - length + 1):
            count[raw[i : i + length]] = count.get(raw[i : i + length], 0) + 1
    kept = {r.doc_id: r.text for r in after.itertuples()}
    assert set(kept) == set(raws)
    for i, raw in raws.items():
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if count[raw[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        assert kept[i] == bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore"), i
    before, after = seen["benchmark decontamination"]
    items = [words(t) for t in spark.read.parquet(f"{DATA}/benchmark.parquet").toPandas().text]
    windows = {tuple(w[i : i + 10]) for w in items if w for i in range(max(len(w) - 9, 1))}
    sizes = {len(w) for w in windows}
    clean = {r.doc_id for r in before.itertuples() if not any(tuple(w[i : i + n]) in windows for w in [words(r.text)] for n in sizes for i in range(len(w) - n + 1))}
    assert set(after.doc_id) == clean and len(clean) < len(before)
    before, after = seen["byte-level BPE"]
    text = {r.doc_id: r.text or "" for r in before.itertuples()}
    assert len(before) == len(after)
    for r in after.itertuples():
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def good(text):
    """The threshold table, one document at a time."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {g for g in grams if grams.count(g) > 1} if len(set(grams)) < len(grams) else set()
    repeated = len({i + k for i, g in enumerate(grams) if g in again for k in range(3)})
    if len(w) < 50 or 100 * repeated > 50 * len(w):
        return False
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    stop = {x for s in quality.STOP_WORDS for x in (s, s.capitalize(), s.upper())}
    counts = {"one": 1, "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_stop_words": sum(x in stop for x in w), "n_repeat_words": repeated}
    return all((low is None or 100 * counts[top] >= low * counts[bottom]) and (high is None or 100 * counts[top] <= high * counts[bottom]) for _, top, bottom, low, high in quality.THRESHOLDS)


def test_run_is_its_stages_and_leaves_little_behind(spark, tmp_path, monkeypatch):
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "suffix-array dedup", "benchmark decontamination", "byte-level BPE"]
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    out = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, DATA).collect()}
    left = [f for f in os.listdir(tmp_path / "shared") if not f.startswith("bpe")]
    monkeypatch.undo()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert out == {r.doc_id: r.ids_sha256 for r in docs.collect()} and out
    assert len(left) == 1 and left[0].startswith("pipeline-"), left
