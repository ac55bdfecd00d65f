"""The query keeps bigrams seen once."""

import random
import zlib

import pytest
from pyspark.sql import functions as F
from test_katz import brute

from spanlight.llm.katz import katz_scores, op3_katz_backoff


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    return [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(0, 60)))) for i in range(60)] + [(90, None), (91, ""), (92, "never seen before")]


def near(got, want):
    assert {r.doc_id for r in got} == set(want)
    assert all(abs(r.score - want[r.doc_id][4]) < 1e-6 and abs(r.base_score - want[r.doc_id][3]) < 1e-6 for r in got)


def test_query_against_brute_force(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 10 == 0}
    near(op3_katz_backoff(spark, str(tmp_path)).collect(), brute(rows, held, 2, 1))


def test_orders_against_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for order in (2, 3):
        near(katz_scores(docs, F.col("doc_id") % 7 == 3, order, min_count=1).collect(), brute(rows, {d for d, _ in rows if d % 7 == 3}, order, 1))
