"""Mixing sources: rates beyond the range of exp(-rate)."""

import collections
import hashlib
import math

from pyspark.sql import functions as F

from spanlight.llm.mixing import poisson_mix, poisson_quantile


def quantile(u, rate):
    """Smallest k with P(X <= k) > u, each probability by lgamma."""
    k = max(0, math.floor(rate - 15 * math.sqrt(rate)))
    total = math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
    while total <= u:
        k += 1
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
    return k


def test_quantile_of_large_rates(spark):
    cases = [(u, r) for r in (0.3, 5.0, 599.5, 600.5, 800.0, 5_000.0, 200_000.0) for u in (0.0001, 0.03, 0.4999, 0.77, 0.9999)]
    got = spark.createDataFrame(cases, "u double, rate double").select("u", "rate", poisson_quantile(F.col("u"), F.col("rate")).alias("k")).collect()
    assert all(r.k == quantile(r.u, r.rate) for r in got), got


def test_a_rare_source(spark):
    docs = spark.range(9_000).selectExpr("id AS doc_id", "'t' AS text", "CASE WHEN id = 77 THEN NULL ELSE 'many' END AS source")
    rows = poisson_mix(docs, weights={"": 0.25, "many": 0.75}).select("doc_id", "copy", "reps").collect()
    found = [r for r in rows if r.doc_id == 77]
    u = int(hashlib.md5(b"17|77").hexdigest()[:13], 16) / 16**13
    want = quantile(u, 2250.0)
    assert want > 600 and sorted(r.copy for r in found) == list(range(want)) and {r.reps for r in found} == {want}
    assert max(collections.Counter(r.doc_id for r in rows if r.doc_id != 77).values()) < 20
