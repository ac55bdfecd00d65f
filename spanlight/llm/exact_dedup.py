"""Exact deduplication by progressive refinement, in DataFrame operations only.

Three levels, each working on what the one before left over:

1. *length*: UTF-8 lengths that only one row has are settled;
2. *prefix*: of the other rows, (length, hash of the first characters) that only one row has;
3. *content*: only the rest has its whole text hashed (SHA-256) and grouped.

What level 2 leaves is passed to level 3 as a bitmap with a fixed number of
bits, so that no text is ever shuffled: a row whose bit is clear is unique and
its text is not hashed.  The bitmap can pass a row too many but never one too
few, and level 3 is exact.  Groups are only ever aggregated (with map-side
combine), and their verdict is joined back on the digest, which AQE splits when
one text holds a large share of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import documents, text_or_empty

#: Bits in one value of Spark's bitmap functions.
_BITMAP_BITS = 32768


def _bit_is_set(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte, F.lit(0)).bitwiseAND(F.pow(F.lit(2), F.pmod(position, F.lit(8))).cast("int")) != 0


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, bitmap_blocks: int = 256, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``keep_id``, ``group_size``, ``kept`` and the columns of ``carry``.

    Texts are compared byte by byte as they are; the largest id of a group
    stays.  ``carry`` maps names to expressions over ``docs`` that are evaluated
    in the scan and passed on.  ``bitmap_blocks`` fixes the broadcast at 4 KiB
    a block.

    Null texts equal the empty text.  A null id loses to any other; a group of
    null ids alone keeps them.  A repeated row (same id and text) is the same
    document: its copies share one verdict and count in ``group_size``.  An
    empty table gives no rows.  Other columns of ``docs`` are not read.
    """
    carry = carry or {}
    rows = docs.select(
        F.col(id_col).alias("__id"),
        text_or_empty(text_col).alias("__text"),
        *[expression.alias(f"__carry_{name}") for name, expression in carry.items()],
    ).withColumn("__len", F.octet_length("__text")).withColumn("__prefix", F.xxhash64(F.substring("__text", 1, prefix_chars)))

    by_length = rows.groupBy("__len").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__len")
    by_prefix = rows.select("__len", "__prefix").join(by_length, "__len", "left_semi").groupBy("__len", "__prefix").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")

    slot = F.pmod(F.xxhash64("__len", "__prefix"), F.lit(bitmap_blocks * _BITMAP_BITS))
    block, position = F.floor(slot / _BITMAP_BITS).cast("int"), F.pmod(slot, F.lit(_BITMAP_BITS)).cast("int")
    bitmaps = by_prefix.select(block.alias("__block"), position.cast("long").alias("__position")).groupBy("__block").agg(F.bitmap_construct_agg("__position").alias("__bitmap"))

    marked = (
        rows.withColumn("__block", block)
        .withColumn("__position", position)
        .join(F.broadcast(bitmaps), "__block", "left")
        .withColumn("__open", F.coalesce(_bit_is_set(F.col("__bitmap"), F.col("__position")), F.lit(False)))
        .select("__id", *[f"__carry_{name}" for name in carry], F.when(F.col("__open"), F.sha2("__text", 256)).otherwise(F.concat(F.lit("only "), F.xxhash64("__id", "__len", "__prefix").cast("string"))).alias("__key"), "__open")
    )
    groups = marked.where("__open").groupBy("__key").agg(F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__size")).where("__size > 1")
    return marked.join(groups, "__key", "left").select(
        F.col("__id").alias(id_col),
        F.when(F.col("__size").isNull(), F.col("__id")).otherwise(F.col("__keep")).alias("keep_id"),
        F.coalesce("__size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("__size").isNull(), True).otherwise(F.col("__id").eqNullSafe(F.col("__keep"))).alias("kept"),
        *[F.col(f"__carry_{name}").alias(name) for name in carry],
    )


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return exact_dedup(docs, carry={"text_sha256": F.sha2(text_or_empty("text"), 256)})


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
