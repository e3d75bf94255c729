"""The queries of the subpackage: those with SQL against DuckDB, suffix dedup at its real length against brute force."""

import collections
import hashlib
import os

import duckdb
import numpy as np
import pytest

from prismata.llm import registry, suffixdedup

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    theirs = con.sql(registry.oracle_sql()[name])
    ours = registry.queries()[name](spark, DATA)
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    want = sorted(map(repr, theirs.select(*[f'"{c}"' for c in columns]).fetchall()))
    assert sorted(map(repr, map(tuple, ours.select(*columns).collect()))) == want and want


def test_suffix_dedup_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    raws = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    size = suffixdedup.LENGTH
    count = collections.Counter(hashlib.blake2b(x[i : i + size], digest_size=16).digest() for x in raws.values() for i in range(len(x) - size + 1))
    got = {r.doc_id: r for r in registry.queries()["op2_suffix_dedup"](spark, DATA).collect()}
    for i, x in raws.items():
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - size + 1):
            if count[hashlib.blake2b(x[k : k + size], digest_size=16).digest()] > 1:
                gone[k : k + size] = True
        kept = bytes(b for b, g in zip(x, gone) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(x), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()), i


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - {"op12_prefix_trie", "op13_whiten"}))
def test_one_row_each(spark, name):
    """Queries over documents and pages give a row for each of theirs (the audit one more for each record that only the replica has)."""
    out = registry.queries()[name](spark, DATA)
    table = "pages" if name.split("_")[0] in ("op3", "op4", "op5") else "documents"
    n = out.filter("status != 'extra'").count() if name.startswith("op5") else out.count()
    assert n == spark.read.parquet(f"{DATA}/{table}.parquet").count()
