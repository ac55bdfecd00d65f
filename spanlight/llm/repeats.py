"""Removal of long repeated substrings by bucket-pointer refinement over sampled suffixes.

A string of ``length`` bytes that occurs twice is found by its buckets:

1. *Initial buckets.*  Of the q-grams in each window of ``length`` bytes the one
   with the least fingerprint is the window's anchor, so equal windows have
   equal anchors at equal places, and there is about one anchor in q/2 bytes.
   Anchors are put in buckets by the q-gram's fingerprint; a bucket of one is
   done.
2. *Refinement.*  A bucket is sorted by the bucket identifier of the whole
   stretch that the windows of an anchor cover.  Where several members share it
   all these windows repeat, and they are done.
3. *Refinement by blocks.*  In buckets with several different stretches that
   leaves open which windows repeat; there an anchor's windows (one stretch of
   each kind stands for all) are cut into blocks by the distance to the anchor,
   and put in buckets by what all windows of a block share.  A bucket of one is
   done.
4. *Refinement by later offsets.*  Each window of the blocks left is put in
   buckets by its own first q-gram and refined by the bucket identifier q bytes
   further on, until the window is covered.  A bucket of several windows repeats.

Identifiers are fingerprints of 64 bits, two for a window; those of blocks have
32 and the q-gram's 64, for they only choose windows for the last step.  Only
anchors, and windows of the last step, are shuffled; texts are joined by document
twice.  A stored table is deleted as soon as the next one is there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import documents, forget, freed, stored

#: Distances from window start to anchor that are looked at together.
BLOCK = 16


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each run of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out, size = values, 1
    while 2 * size <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, length: int, q: int):
    """Anchors of one document: place, q-gram fingerprint, first and last window start that has it; and fingerprints' prefix sums."""
    sums = B.rolling(data)
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 4, sums
    at = np.arange(n - q + 1)
    grams = B.span_hash(sums, at, at + q)
    # the place in the low bits makes the leftmost of equal q-grams the least, in any window alike
    low = np.uint64((1 << int(n).bit_length()) - 1)
    least = _sliding((grams & ~low) | at.astype(np.uint64), length - q + 1, np.minimum) & low  # by window start
    heads = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1])
    place = least[heads].astype(np.int64)
    return (place, grams[place], heads, np.append(heads[1:], len(least)) - 1), sums


def cores(sums: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, length: int):
    """Fingerprints of what all windows of an anchor share, by blocks of BLOCK distances from window start to anchor: the values, and the number for each anchor."""
    low, high = (place - last) // BLOCK, (place - first) // BLOCK
    many = high - low + 1
    ends = np.cumsum(many)
    owner = np.repeat(np.arange(len(place)), many)
    block = np.arange(int(ends[-1]) if len(ends) else 0) - (ends - many)[owner] + low[owner]
    begin = place[owner] - block * BLOCK
    end = begin - BLOCK + 1 + length
    return B.mix64(B.span_hash(sums, begin, end) + block.astype(np.uint64)), many


def _anchor_rows(length: int, q: int):
    def rows(batches):
        for batch in batches:
            for row, stop, data, offsets in B.utf8_chunks(batch, "text"):
                held, shared, counts = [], [], []
                docs = np.asarray(batch.column(0).slice(row, stop - row))
                for k in range(stop - row):
                    (place, gram, first, last), sums = anchors(data[offsets[k] : offsets[k + 1]], length, q)
                    if len(place):
                        stretch = B.mix64(B.span_hash(sums, first, last + length) + (place - first).astype(np.uint64))
                        held.append((np.full(len(place), docs[k]), place, gram.view(np.int64), stretch.view(np.int64), first, last))
                        values, many = cores(sums, place, first, last, length)
                        shared.append((values >> np.uint64(32)).astype(np.uint32).view(np.int32))
                        counts.append(many)
                if held:
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)), pa.array(np.concatenate(shared)))
                    narrow = [np.int64, np.int32, np.int64, np.int64, np.int32, np.int32]
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c).astype(t)) for c, t in zip(zip(*held, strict=True), narrow, strict=True)), lists], ["doc", "place", "gram", "stretch", "first", "last", "cores"])

    return rows


def _window_rows(length: int, q: int):
    """Windows of open anchors, by the identifiers of their q-grams at offsets 0, q, .. and at the end."""

    def rows(batches):
        steps = [*range(0, length - q, q), length - q]
        for batch in batches:
            docs = batch.column(0).to_pylist()
            opens = batch.column(1).to_pylist()
            for row, stop, data, offsets in B.utf8_chunks(batch, "text"):
                for k in range(stop - row):
                    text = data[offsets[k] : offsets[k + 1]]
                    sums = B.rolling(text)
                    begins = np.unique(np.concatenate([np.arange(r["first"], r["last"] + 1) for r in opens[row + k]]))
                    bucket = B.span_hash(sums, begins, begins + q)
                    later = np.zeros(len(begins), np.uint64)
                    for s in steps[1:]:
                        later = B.mix64(later * np.uint64(0x9FB21C651E98DF25) + B.span_hash(sums, begins + s, begins + s + q))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(begins), docs[row + k])), pa.array(begins.astype(np.int32)), pa.array(bucket.view(np.int64)), pa.array(later.view(np.int64))], ["doc", "first", "bucket", "later"])

    return rows


def _cut(length: int):
    def rows(batches):
        for batch in batches:
            spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
            out = []
            for row, stop, data, offsets in B.utf8_chunks(batch, "text"):
                for k in range(stop - row):
                    text = data[offsets[k] : offsets[k + 1]]
                    edge = np.zeros(len(text) + 1, np.int64)
                    for s in spans[row + k] or []:
                        edge[s["first"]] += 1
                        edge[s["last"] + length] -= 1
                    gone = np.cumsum(edge)[:-1] > 0
                    begins = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                    kept = text[~gone].tobytes()
                    out.append((len(text), int(gone.sum()), begins, hashlib.sha256(kept).hexdigest(), kept))
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows


def remove_repeats(docs: DataFrame, length: int = 400, q: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans (runs removed), kept_sha256, kept (the bytes that stay).

    Every byte in a string of ``length`` bytes that also starts at another place
    is removed, in the same document or another, overlaps too.  Null texts are
    empty.  Texts shorter than ``length`` stay as they are.  Repeated rows repeat
    each other.  A text of any length up to 2 GB, the bound of a string in Spark,
    is looked at whole.  Other columns are not read.  An empty table gives no
    rows.
    """
    if not 1 <= q <= length // 2:
        raise ValueError("q is at most half of the length")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("doc", F.xxhash64("id", "text"))
    marks = stored(texts.where(F.octet_length("text") >= length).select("doc", "text").mapInArrow(freed(_anchor_rows(length, q)), "doc long, place int, gram long, stretch long, first int, last int, cores array<int>"))
    shared = stored(marks.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    live = stored(marks.join(shared, "gram", "left_semi"))
    forget(marks, shared)
    kinds = stored(live.groupBy("gram", "stretch").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "place", "first", "last", "cores")).alias("one")))
    done = stored(live.join(kinds.where("n > 1").select("gram", "stretch"), ["gram", "stretch"], "left_semi").select("doc", "first", "last").distinct())
    forget(live)
    several = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("different")).where("different > 1")
    blocks = kinds.join(several, "gram").select("gram", "one.*").select("gram", "doc", "place", "first", "last", F.posexplode("cores").alias("pos", "core"))
    block = F.expr(f"cast((place - last) div {BLOCK} as int) + pos")
    low, high = F.greatest("first", F.col("place") - block * BLOCK - (BLOCK - 1)), F.least("last", F.col("place") - block * BLOCK)
    blocks = stored(blocks.select("doc", F.xxhash64("gram", "core").alias("core"), low.alias("first"), high.alias("last")))
    forget(kinds)
    again = blocks.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core")
    by_doc = stored(blocks.join(again, "core", "left_semi").groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("opens")))
    forget(blocks)
    once = texts.select("doc", "text").join(by_doc, "doc").dropDuplicates(["doc"]).select("doc", "opens", "text")
    windows = stored(once.mapInArrow(freed(_window_rows(length, q)), "doc long, first int, bucket long, later long"))
    forget(by_doc)
    repeated = windows.groupBy("bucket", "later").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = windows.join(repeated, ["bucket", "later"], "left_semi").select("doc", "first", F.col("first").alias("last"))
    spans = stored(done.unionByName(found).groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("spans")))
    forget(done, windows)
    rows = texts.join(spans, "doc", "left").select("id", "spans", "text")
    kind = texts.schema["id"].dataType.simpleString()
    return rows.mapInArrow(freed(_cut(length)), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)


def op6_repeated_substrings(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")


OP6_SQL = """
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(array_slice(b, i + 1, i + 400)) AS h FROM (SELECT doc_id, b, unnest(range(0, n - 399)) AS i FROM t WHERE n >= 400)),
m AS (SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 AS new FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM (SELECT doc_id, i, sum(CAST(coalesce(new, true) AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m) GROUP BY doc_id, k),
edges AS (SELECT doc_id, a AS stop, z AS next FROM runs UNION ALL SELECT doc_id, n, n FROM t),
pieces AS (SELECT doc_id, coalesce(lag(next) OVER (PARTITION BY doc_id ORDER BY stop, next), 0) AS start, stop FROM edges),
kept AS (SELECT doc_id, sha256(unhex(string_agg(CASE WHEN stop > start THEN hex(array_slice(b, start + 1, stop)) ELSE '' END, '' ORDER BY start))) AS kept_sha256 FROM pieces JOIN t USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM t JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id) USING (doc_id)
"""
