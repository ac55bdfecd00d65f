"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked.  Since the members of such a group are
interchangeable, labels are held per (group, cell): a cell is one of ``cells``
hash classes of the ids, so a group of any size has at most that many labelled
rows, and a group larger than a shard can be split.

A round moves cells towards the shard where most of their group is and where
there is still room; the moves into a shard are accepted in hash order until its
quota is used up.  Unlinked documents have no neighbours and fill what is left,
which makes the row counts of the shards equal up to one.  Ranks are two-level
(counts per hash bucket, then within a bucket), so no task sees a whole shard: a
bucket holds about ``RANK_BUCKET_ROWS`` rows, also of the unlinked ones, which
share one label.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut_lineage, documents, text_or_empty

#: Hash buckets in which moves are accepted or refused together.
MOVE_BUCKETS = 4096

#: Rows that one bucket of the two-level ranking should hold.
RANK_BUCKET_ROWS = 20_000

_GROUP = ("__k", "__h", "__crc", "__bytes")


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), (index + 1).cast("int"))


def _loads(state: DataFrame, shards: int) -> list[int]:
    got = {r["__label"]: r["n"] for r in state.groupBy("__label").agg(F.sum("__n").alias("n")).collect()}
    return [got.get(s, 0) for s in range(shards)]


def cut_edges(state: DataFrame) -> int:
    """Pairs of linked documents in different shards."""
    per = state.groupBy(*_GROUP, "__label").agg(F.sum("__n").alias("c"))
    total = per.groupBy(*_GROUP).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s"))
    return int(total.agg(F.sum((F.col("n") * F.col("n") - F.col("s")) / 2)).first()[0] or 0)


def propagate(state: DataFrame, quotas: list[int], rounds: int) -> DataFrame:
    """Rounds of label moves on (group, __cell, __n, __label) under ``quotas`` of documents a label, till nothing moves or ``rounds`` are over.

    A shard that is wished for but can't take the first of its wishes is closed
    from then on, so that groups turn to another that has room.
    """
    shards, closed = len(quotas), set()
    for _ in range(rounds):
        room = [0 if s in closed else q - n for s, (q, n) in enumerate(zip(quotas, _loads(state, shards), strict=True))]
        tally = state.groupBy(*_GROUP, "__label").agg(F.sum("__n").alias("__votes"))
        open_votes = F.when(_pick(room, F.col("__label")) > 0, F.struct(F.col("__votes"), -F.col("__label")))
        best = tally.groupBy(*_GROUP).agg(F.max(open_votes).alias("__best")).where("__best IS NOT NULL")
        here = state.join(tally, [*_GROUP, "__label"]).join(best, list(_GROUP))
        bucket = F.pmod(F.xxhash64(*_GROUP, "__cell"), F.lit(MOVE_BUCKETS)).cast("int")
        wishes = here.where(F.struct(F.col("__votes"), -F.col("__label")) < F.col("__best")).select(*_GROUP, "__cell", "__n", (-F.col("__best.col2")).cast("int").alias("__to"), bucket.alias("__bucket"))
        sums = wishes.groupBy("__to", "__bucket").agg(F.sum("__n").alias("__n"))
        running = F.sum("__n").over(Window.partitionBy("__to").orderBy("__bucket"))
        judged = cut_lineage(sums.withColumn("__granted", running <= _pick(room, F.col("__to"))))
        outcome = {r["__to"]: r["n"] for r in judged.groupBy("__to").agg(F.count_if("__granted").alias("n")).collect()}
        closed |= {s for s, n in outcome.items() if not n}
        if not outcome:
            break
        if any(outcome.values()):
            granted = judged.where("__granted").select("__to", "__bucket")
            moves = wishes.join(F.broadcast(granted), ["__to", "__bucket"]).select(*_GROUP, "__cell", "__to")
            state = cut_lineage(state.join(moves, [*_GROUP, "__cell"], "left").select(*_GROUP, "__cell", "__n", F.coalesce("__to", "__label").alias("__label")))
    return state


def label_shards(docs: DataFrame, shards: int = 16, rounds: int = 10, cells: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in each shard).

    Row counts of the shards differ by one at most.  Null texts equal the empty
    text (size 1, crc32 0).  Null ids and repeated rows are ordinary rows with a
    slot each, of which it is not fixed which row of equals gets which.  An
    empty table gives no rows.
    """
    if shards < 1 or cells % shards:
        raise ValueError("cells is a multiple of shards")
    text = text_or_empty(text_col)
    nodes = cut_lineage(
        docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__k"), F.hash(text).alias("__h"), F.crc32(text.cast("binary")).alias("__crc"), F.octet_length(text).cast("long").alias("__bytes"))
        .withColumn("__mix", F.xxhash64("__id", F.lit("shard")))
        .withColumn("__cell", F.pmod("__mix", F.lit(cells)).cast("int"))
    )
    total = nodes.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    by_cell = nodes.groupBy(*_GROUP, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    linked = by_cell.groupBy(*_GROUP).agg(F.sum("__n").alias("__members")).where("__members > 1").select(*_GROUP)
    state = cut_lineage(by_cell.join(linked, list(_GROUP), "left_semi").withColumn("__label", F.pmod("__cell", F.lit(shards)).cast("int")))
    state = propagate(state, quotas, rounds)

    # Ranks: within (label, bucket) by a window, and before the bucket by a running sum of counts.
    buckets = max(64, math.ceil(total / RANK_BUCKET_ROWS))
    labelled = cut_lineage(
        nodes.join(state.drop("__n"), [*_GROUP, "__cell"], "left")
        .withColumn("__label", F.coalesce("__label", F.lit(shards)))
        .withColumn("__bucket", F.pmod(F.shiftright("__mix", 7), F.lit(buckets)).cast("int"))
    )
    counts = labelled.groupBy("__label", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__label").orderBy("__bucket")) - F.col("__n")
    before = counts.select("__label", "__bucket", before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__label", "__bucket").orderBy("__mix", "__id", "__k")) - 1
    ranked = labelled.withColumn("__inside", inside).join(before, ["__label", "__bucket"]).withColumn("__rank", F.col("__before") + F.col("__inside"))

    got = {r["__label"]: r["n"] for r in counts.groupBy("__label").agg(F.sum("__n").alias("n")).collect()}
    taken = [min(got.get(s, 0), quotas[s]) for s in range(shards)]
    spare, first_spare, first_gap = got.get(shards, 0), [], [0]
    for s in range(shards):
        first_spare.append(spare)
        spare += got.get(s, 0) - taken[s]
        first_gap.append(first_gap[-1] + quotas[s] - taken[s])
    label = F.col("__label")
    fits = (label < shards) & (F.col("__rank") < _pick([*quotas, 0], label))
    spare_rank = F.when(label == shards, F.col("__rank")).otherwise(F.col("__rank") - _pick([*quotas, 0], label) + _pick([*first_spare, 0], label))
    gap = sum(((F.col("__spare") >= F.lit(int(g))).cast("int") for g in first_gap[1:]), F.lit(0))
    return (
        ranked.withColumn("__fits", fits)
        .withColumn("__spare", spare_rank)
        .withColumn("__gap", gap)
        .select(
            F.col("__id").alias(id_col),
            (F.col("__bytes") + 1).alias("size"),
            F.col("__crc").alias("text_crc32"),
            F.when(F.col("__fits"), label).otherwise(F.col("__gap")).cast("int").alias("shard"),
            F.when(F.col("__fits"), F.col("__rank")).otherwise(F.col("__spare") - _pick(first_gap, F.col("__gap")) + _pick([*taken, 0], F.col("__gap"))).cast("long").alias("slot"),
        )
    )


def op10_label_shards(spark, sf_dir: str) -> DataFrame:
    out = label_shards(documents(spark, sf_dir), shards=16)
    return out.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
