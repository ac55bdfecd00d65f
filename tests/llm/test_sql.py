"""The text queries that SQL can express, against their SQL on the smallest tables; shards against their law."""

import zlib
from collections import Counter

import duckdb
import pytest

from spanlight.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    got, want = QUERIES[name](spark, FOLDER).toPandas(), con.execute(ORACLE_SQL[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda f: sorted(tuple(map(str, r)) for r in f[columns].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_shards(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op10_label_shards"](spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    assert all((r.size, r.text_crc32, r.law) == (len(docs[r.doc_id]) + 1, zlib.crc32(docs[r.doc_id]), "rows") for r in rows)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    groups = {}
    for r in rows:
        groups.setdefault(docs[r.doc_id], Counter())[r.shard] += 1
    linked = [g for g in groups.values() if sum(g.values()) > 1]
    cut = sum((sum(g.values()) ** 2 - sum(n * n for n in g.values())) // 2 for g in linked)
    pairs = sum(sum(g.values()) * (sum(g.values()) - 1) // 2 for g in linked)
    assert cut <= pairs / 10
