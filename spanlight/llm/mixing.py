"""Mixing sources to target weights by Poisson replication.

Every document is repeated k times, k being the inverse of the Poisson
distribution with the mean repetition rate of its source at a number in [0, 1)
that is a hash of the document.  Nothing depends on the partitioning or on the
order of rows, so a retried task repeats the same draw.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import documents, shuffle_partitions

#: Up to so many sources the table of rates is broadcast; with more of them the join is an ordinary one.
MAX_BROADCAST_SOURCES = 10_000

#: Hex digits of md5 read as a number; 13 digits fit a double exactly.
_DIGITS = 13

#: Up to this rate the Poisson probabilities are summed from 0, as in the SQL.
_FROM_ZERO = 600.0


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, _DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def poisson_quantile(uniform: Column, rate: Column) -> Column:
    """Smallest k with P(X <= k) > uniform for X Poisson with mean ``rate``.

    Steps through the probabilities until the sum passes ``uniform``.  Up to
    ``_FROM_ZERO`` they begin with exp(-rate) at 0; for a greater rate, where
    that loses its precision, 12 standard deviations below the mean, with
    Stirling's series for the factorial.  What lies below is under 1e-30, far
    less than a step of ``uniform``.  0 where the rate is null or not positive.
    """
    small = rate <= _FROM_ZERO
    below = F.floor(rate - 12 * F.sqrt(rate)).cast("double")
    stirling = below * F.log1p((rate - below) / below) - (rate - below) - F.log(2 * math.pi * below) / 2 - 1 / (12 * below) + 1 / (360 * below * below * below)
    start = F.when(small, F.lit(0)).otherwise(below.cast("int"))
    first = F.when(small, F.exp(-rate)).otherwise(F.exp(stirling))
    steps = F.sequence(start + 1, (F.ceil(rate + 12 * F.sqrt(rate)) + 24).cast("int"))
    state = F.struct(start.alias("k"), first.alias("p"), first.alias("cdf"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * rate / i
        return F.when(s["cdf"] <= uniform, F.struct(i.cast("int").alias("k"), p.alias("p"), (s["cdf"] + p).alias("cdf"))).otherwise(s)

    return F.when(rate > 0, F.aggregate(steps, state, step, lambda s: s["k"])).otherwise(F.lit(0))


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, temperature: float, rate: float, source_col: str) -> DataFrame:
    """(__source, __rate): mean repetitions of a document of each source.

    ``weights`` are target shares of the output by source, those missing get 0;
    without them the share is the source's own to the power ``temperature``.
    Shares are normalised over the sources present.
    """
    counts = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source")).agg(F.count(F.lit(1)).alias("__n"))
    if weights is None:
        share = F.pow(F.col("__n").cast("double"), F.lit(float(temperature)))
    else:
        known = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))]) if weights else F.lit(None).cast("map<string,double>")
        share = F.coalesce(F.element_at(known, F.col("__source")), F.lit(0.0))
    counts = counts.withColumn("__share", share)
    total = counts.agg(F.sum("__n").alias("n"), F.sum("__share").alias("s")).first()
    scale = float(rate) * (total["n"] or 0) / total["s"] if total["s"] else 0.0
    return counts.select("__source", (F.col("__share") * F.lit(scale) / F.col("__n")).alias("__rate"))


def poisson_mix(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5, rate: float = 1.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Columns of ``docs`` and ``copy`` (0..reps-1), ``reps``, ``order_key``; a column that has one of these names is replaced.

    ``rate`` is the size of the output as a multiple of the input.  Rows leave
    in a global shuffle: partitions by a hash of (document, copy), ordered
    within by ``order_key``, another one.

    Null sources are one source, as the empty string.  Null ids draw the same
    number.  Repeated rows draw the same number each.  An empty table, or
    weights that are 0 for all sources present, give no rows.  A source's rate
    has no bound but that of an int.
    """
    rates = source_rates(docs, weights, temperature, rate, source_col)
    key = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    if rates.count() <= MAX_BROADCAST_SOURCES:
        joined = docs.withColumn("__source", key).join(F.broadcast(rates), "__source")
    else:
        salts = 64
        joined = docs.withColumn("__source", key).withColumn("__salt", F.pmod(F.xxhash64(id_col), F.lit(salts))).join(
            rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).cast("long")), ["__source", "__salt"]
        )
    identity = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    drawn = joined.withColumn("__reps", poisson_quantile(hash_uniform(F.lit(str(seed)), identity), F.col("__rate"))).where("__reps > 0")
    copies = drawn.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__reps") - 1)))
    copies = copies.withColumn("__order", F.xxhash64(F.lit(seed), identity, F.col("__copy")))
    parts = shuffle_partitions(docs.sparkSession)
    mixed = copies.repartition(parts, F.xxhash64(F.lit(seed + 1), F.col("__order"))).sortWithinPartitions("__order")
    kept = [F.col(f"`{name}`") for name in docs.columns if name not in ("copy", "reps", "order_key")]
    return mixed.select(*kept, F.col("__copy").alias("copy"), F.col("__reps").alias("reps"), F.col("__order").alias("order_key"))


#: Production settings: shares flattened to the square root of the sources' own, output as large as the input.
TEMPERATURE, RATE, SEED = 0.5, 1.0, 17


def op2_poisson_mix(spark, sf_dir: str) -> DataFrame:
    """Every copy made, with its whole text."""
    return poisson_mix(documents(spark, sf_dir), temperature=TEMPERATURE, rate=RATE, seed=SEED).select("doc_id", "source", "copy", "reps", "text")


def poisson_sql(table: str, columns: str) -> str:
    """DuckDB's form of ``poisson_mix`` with the production settings."""
    return f"""
WITH RECURSIVE counts AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM {table} GROUP BY 1),
rates AS (SELECT s, sqrt(n) * ({RATE} * sum(n) OVER () / sum(sqrt(n)) OVER ()) / n AS rate FROM counts),
terms(s, rate, k, p, cdf) AS (
  SELECT s, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT s, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM terms WHERE k < ceil(rate + 12 * sqrt(rate)) + 24),
tables AS (SELECT s, list(cdf ORDER BY k) AS cdfs FROM terms GROUP BY s),
draws AS (
  SELECT d.*, CAST(len(list_filter(cdfs, lambda c: c <= CAST(concat('0x', substr(md5(concat('{SEED}|', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, {_DIGITS})) AS BIGINT) / {16**_DIGITS}.0)) AS INTEGER) AS reps
  FROM {table} d JOIN tables t ON t.s = coalesce(d.source, ''))
SELECT {columns} FROM (SELECT *, unnest(range(reps)) AS copy_number FROM draws)
"""


OP2_SQL = poisson_sql("documents", "doc_id, source, CAST(copy_number AS INTEGER) AS copy, reps, text")
