"""Edge cases of operators of earlier rounds: repeated and very long pages, clashing columns, very long single texts, other languages."""

import hashlib
import math

from prismata.llm import bpe, lm, quality, urlgraph


def test_url_graph_of_repeated_long_and_clashing_pages(spark):
    long = "<p>" + "filler " * 300_000 + '</p><a href="http://bad.net/es/1">x</a>'
    rows = [(1, "http://far.org/p", long)] * 3 + [(2, "http://bad.net/es/1", None), (3, "http://FAR.org/q", ""), (None, "http://far.org/", "")]
    pages = spark.createDataFrame([(*r, "clash", "allow", 1, "/x") for r in rows], "page_id long, url string, html string, host string, verdict string, rule int, path string")
    out = urlgraph.judge(pages)
    assert sorted(out.columns)[:5] == sorted(["host", "page_id", "path", "rule", "verdict"])[:5]
    got = out.collect()
    assert len(got) == len(rows) and sum(r.page_id == 1 for r in got) == 3
    assert {(r.host, r.verdict) for r in got} == {("far.org", "block"), ("bad.net", "block")}
    assert {r.path for r in got if r.page_id == 1} == {"/p"} and {r.rule for r in got} == {None, "net/es/"}


def test_a_very_long_single_text(spark):
    texts = ["a" * 300_000, "word " * 100_000, "é" * 50_000 + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {r.doc_id: r for r in bpe.encode(docs).collect()}
    for i, t in enumerate(texts):
        assert by[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and by[i].n_tokens > 0
    scored = {r.doc_id: r for r in lm.score(docs).collect()}
    assert scored[1].n_tokens == 100_001 and scored[0].n_tokens == 2 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in scored.values())


def test_other_languages_have_no_stop_words(spark):
    text = " ".join(["Съешь ещё этих мягких французских булок да выпей чаю"] * 9)
    (row,) = quality.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.n_words == 81 and not row.kept
