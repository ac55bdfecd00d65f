"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff, tables partitioned by fingerprint.

Order k holds for each n-gram of k tokens the discounted chance of its last
token after the others, and for each context the weight that spreads the rest
over the next lower order.  An n-gram of two or more tokens seen less than
``min_count`` times is not kept; its mass goes to the backoff.  What is not
known at order 1 is one further class, which has the discounted mass.  For every
context the chances of all words and of that class add up to 1.

N-grams are named by 64-bit fingerprints.  Documents are packed into blocks of a
bounded size.  A block sends each different n-gram once, with its count, to the
part of the table that the fingerprint belongs to; the part adds up, keeps the
table and sends each block the counts of its n-grams.  One of the blocks that
have an n-gram is its owner and adds it to the sums of its context, which go the
same way; so no n-gram or context has more than one entry for a block, however
frequent it is.  A block then scores its tokens from the highest order down.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import bucket_count, documents, freed, stored, stored_by, trimmed
from .language_id import held_out

#: Counts up to this one are discounted by Good and Turing's formula.
DISCOUNTED = 5
#: Bytes of text in a block (a longer document is one block alone).
BLOCK_BYTES = 4 << 20
#: Ranges of fingerprints that are counted one after the other, so that only one's n-grams are being shuffled.
PASSES = 2

_END, _START = np.uint64(0x8A5CD789635D2DFF), np.uint64(0x121FD2155C472F96)
_STEP = np.uint64(0x9FB21C651E98DF25)

_SENT = "part long, block long, keys binary, n binary, mass binary, lower binary"
_BACK = "kind string, part long, block long, keys binary, n binary, x binary, sums array<long>"


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers in as many bytes as the largest takes; the first byte says how many."""
    most = int(values.max()) if len(values) else 0
    width = max(1, -(-most.bit_length() // 8))
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    width = blob[0]
    out = np.zeros(((len(blob) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    return out.view("<i8").reshape(-1)


def _pack_floats(values: np.ndarray) -> bytes:
    """The different numbers, and places among them."""
    different, place = np.unique(values, return_inverse=True)
    return len(different).to_bytes(8, "little") + different.astype("<f8").tobytes() + _pack(place)


def _unpack_floats(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    return np.frombuffer(blob, "<f8", n, 8)[_unpack(blob[8 + 8 * n :])] if n else np.zeros(0)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending fingerprints by their steps."""
    return keys[:1].tobytes() + _pack(np.diff(keys))


def _unpack_keys(blob: bytes) -> np.ndarray:
    first = np.frombuffer(blob[:8], "<u8")
    return np.cumsum(np.concatenate([first, _unpack(blob[8:]).view(np.uint64)]), dtype=np.uint64) if len(first) else first


def _blocks(batches):
    """Documents packed: the different token fingerprints, ascending, each token's place in them, and where documents end."""
    for batch in batches:
        held, size = [], 0
        for row, stop, data, offsets in B.utf8_chunks(batch, "text"):
            if held and size + len(data) > BLOCK_BYTES:
                yield _packed(batch, held)
                held, size = [], 0
            size += len(data)
            hashes, bounds = B.word_hashes(data, offsets)
            ends = bounds[1:] + np.arange(stop - row)
            line = np.empty(len(hashes) + stop - row, np.uint64)
            is_end = np.zeros(len(line), bool)
            is_end[ends] = True
            line[is_end], line[~is_end] = _END, hashes
            held.append((row, stop, ends, *np.unique(line, return_inverse=True)))
        if held:
            yield _packed(batch, held)


def _packed(batch, held) -> pa.RecordBatch:
    words = np.unique(np.concatenate([h[3] for h in held]))
    place = np.concatenate([np.searchsorted(words, h[3]).astype("<u4")[h[4]] for h in held])
    before = np.cumsum([0, *(len(h[4]) for h in held)])
    ends = np.concatenate([h[2] + n for h, n in zip(held, before, strict=False)])
    row, docs = held[0][0], held[-1][1] - held[0][0]
    lists = [pa.ListArray.from_arrays(pa.array([0, docs], pa.int32()), batch.column(k).slice(row, docs)) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 66], pa.int64()), *lists, *(pa.array([c], pa.binary()) for c in (_pack_keys(words), _pack(place), ends.astype("<i8").tobytes()))], ["block", "ids", "train", "words", "tokens", "ends"])


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return keys // np.uint64((1 << 64) // parts + 1)


class _Block:
    """Tokens of a block: n-gram and context fingerprints by order, from 1 on."""

    def __init__(self, batch, i: int, order: int):
        get = lambda name: batch.column(name)[i].as_py()
        self.block, self.ids = get("block"), batch.column("ids")[i].values
        self.ends = np.frombuffer(get("ends"), "<i8")
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        lengths = self.ends + 1 - self.starts
        self.train_docs = np.array(get("train"), bool)
        self.train = np.repeat(self.train_docs, lengths)
        line = _unpack_keys(get("words"))[_unpack(get("tokens"))]
        place = np.arange(len(line)) - np.repeat(self.starts, lengths)
        before = [line]  # the token k places before; start marks before the first
        for k in range(1, order):
            t = np.full(len(line), _START, np.uint64)
            t[k:] = np.where(place[k:] >= k, line[:-k], _START)
            before.append(t)
        self.grams, self.contexts = [None, B.mix64(line + _STEP)], [None, None]
        for k in range(2, order + 1):
            context = np.zeros(len(line), np.uint64)
            for t in reversed(before[1:k]):
                context = B.mix64(context * _STEP + t)
            self.contexts.append(context)
            self.grams.append(B.mix64(context * _STEP + line + np.uint64(k)))

    def send(self, parts: int, keys: np.ndarray, n: np.ndarray, *more: np.ndarray):
        """Rows for the parts that the ascending ``keys`` belong to."""
        part = _part(keys, parts)
        cuts = np.flatnonzero(np.diff(part)) + 1
        begins, stops = [0, *cuts.tolist()], [*cuts.tolist(), len(keys)]
        spans = list(zip(begins, stops, strict=True)) if len(keys) else []
        begins = begins if len(keys) else []
        floats = [[_pack_floats(m[a:b]) for a, b in spans] for m in more] or [[None] * len(spans)] * 2
        columns = [pa.array(part[begins].astype(np.int64)), pa.array([self.block] * len(spans), pa.int64()), *(pa.array(c, pa.binary()) for c in ([_pack_keys(keys[a:b]) for a, b in spans], [_pack(n[a:b]) for a, b in spans], *floats))]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SENT.split(", ")])

    def read(self, back, model: KatzModel, top: int):
        """Take in what the parts sent, and work out chances up to order ``top``."""
        found = {}
        for r in back.sort_by("part").to_pylist():
            found.setdefault(r["kind"], []).append(r)
        self.n, self.owned, self.p, kept = [None], [None], [None], None
        for k in range(1, top + 1):
            keys, inverse = np.unique(self.grams[k], return_inverse=True)
            n = np.concatenate([_unpack(r["n"]) for r in found[f"n{k}"]])
            self.n.append(n[inverse])
            self.owned.append((keys, np.concatenate([np.unpackbits(np.frombuffer(r["x"], np.uint8), count=len(_unpack(r["n"]))) for r in found[f"n{k}"]]).astype(bool), n, np.unique(self.grams[k], return_index=True)[1]))
            if k == 1:
                own = model.discounted(1, n) / max(model.total, 1)
                kept, chance = own[inverse], np.where(n > 0, own, model.unknown)[inverse]
            elif f"h{k}" in found:
                inverse_h = np.unique(self.contexts[k], return_inverse=True)[1]
                every = np.concatenate([_unpack(r["n"]) for r in found[f"h{k}"]])[inverse_h]
                alpha = np.concatenate([np.frombuffer(r["x"], "<f8") for r in found[f"h{k}"]])[inverse_h]
                use = self.n[k] >= model.min_count
                kept = np.where(use, model.discounted(k, self.n[k]) / np.maximum(every, 1), 0)
                chance = np.where(use, kept, alpha * chance)
        self.kept, self.chance = kept, chance


class KatzModel:
    """Discount factors by order, and the parts of the tables: ``tables[k]`` has the kept n-grams of order k, ``backoff[k]`` the weights of its contexts."""

    def __init__(self, order: int, min_count: int):
        self.order, self.min_count, self.factors, self.tables, self.backoff = order, min_count, {}, {}, {}
        self.total = self.words = 0
        self.unknown = 1.0

    def learn(self, k: int, sums: list[int]) -> None:
        """``sums``: how many n-grams have count 1, 2, .. DISCOUNTED + 1; tokens; different n-grams."""
        self.factors[k] = discounts(dict(enumerate(sums[: DISCOUNTED + 1], 1)))
        if k == 1:
            self.total, self.words = sums[-2:]
            if self.total:
                lost = sum(sums[r - 1] * r * (1 - self.factors[1][r - 1]) for r in range(1, DISCOUNTED + 1))
                self.unknown = max(lost / self.total, 1e-12)

    def plain(self) -> KatzModel:
        """The numbers alone, for the executors."""
        out = KatzModel(self.order, self.min_count)
        out.factors, out.total, out.words, out.unknown = dict(self.factors), self.total, self.words, self.unknown
        return out

    def discounted(self, k: int, n: np.ndarray) -> np.ndarray:
        return n * np.append(np.append(0.0, self.factors[k]), 1.0)[np.minimum(n, DISCOUNTED + 1)]


def discounts(counts_of_counts: dict[int, int]) -> list[float]:
    """Factors for counts 1 to DISCOUNTED by Good and Turing's formula in Katz's form.

    Where the formula leaves (0, 1), which small samples do, the counts of
    counts are smoothed first (Gale and Sampson): by the line that fits their
    logarithms best over the logarithms of the counts, none counting as one
    half, and falling by more than 1.1.  On that line the formula stays in (0, 1).
    """
    n = [counts_of_counts.get(r, 0) for r in range(DISCOUNTED + 2)]
    if all(n[1:]):
        found = _katz_factors(n)
        if found and all(0 < d < 1 for d in found):
            return found
    r = np.arange(1, DISCOUNTED + 2)
    slope = min(float(np.polyfit(np.log(r), np.log(np.maximum(n[1:], 0.5)), 1)[0]), -1.1)
    return _katz_factors([0.0, *(r.astype(float) ** slope).tolist()])


def _katz_factors(n: list) -> list[float] | None:
    tail = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1]
    return [((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) for r in range(1, DISCOUNTED + 1)] if tail < 1 else None


def _send_counts(k: int, order: int, parts: int, turn: int = 0, turns: int = 1):
    """The n-grams of order ``k`` in the parts whose turn it is."""

    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block(batch, i, order)
                grams, train = block.grams[k], block.train
                if turns > 1:
                    now = _part(grams, parts) * np.uint64(turns) // np.uint64(parts) == np.uint64(turn)
                    grams, train = grams[now], train[now]
                keys, inverse = np.unique(grams, return_inverse=True)
                yield block.send(parts, keys, np.bincount(inverse[train], minlength=len(keys)))

    return freed(send)


def _answer(kind: str, table: pa.Table, keys: np.ndarray, sizes: list[int], n: np.ndarray, x: np.ndarray, own: dict) -> pa.Table:
    """A row for each block that asked, in its order of keys, and one for the part's table itself, with block null."""
    cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    rows = [{"kind": kind, "part": p, "block": b, "n": _pack(n[lo:hi]), "x": np.packbits(x[lo:hi]).tobytes() if x.dtype == bool else x[lo:hi].tobytes()} for p, b, lo, hi in zip(table["part"].to_pylist(), table["block"].to_pylist(), cuts, cuts[1:], strict=False)]
    fields = [("kind", pa.string()), ("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("n", pa.binary()), ("x", pa.binary()), ("sums", pa.list_(pa.int64()))]
    return pa.Table.from_pylist([*rows, {"kind": f"table {kind}", "part": table["part"][0].as_py()} | own], pa.schema(fields))


def _add_counts(k: int, min_count: int):
    def add(table: pa.Table) -> pa.Table:
        each = [_unpack_keys(x) for x in table["keys"].to_pylist()]
        keys, first, inverse = np.unique(np.concatenate(each), return_index=True, return_inverse=True)
        n = np.bincount(inverse, np.concatenate([_unpack(x) for x in table["n"].to_pylist()])).astype(np.int64)
        owner = np.zeros(len(inverse), bool)
        owner[first] = True
        kept = n >= (1 if k == 1 else min_count)
        sums = [*np.bincount(np.minimum(n, DISCOUNTED + 2), minlength=DISCOUNTED + 2)[1 : DISCOUNTED + 2].tolist(), int(n.sum()), int((n > 0).sum())]
        return _answer(f"n{k}", table, keys, [len(x) for x in each], n[inverse], owner, {"keys": _pack_keys(keys[kept]), "n": _pack(n[kept]), "sums": sums})

    return add


def _send_contexts(k: int, model: KatzModel, parts: int):
    """For each context of a block, the sums over the n-grams that the block owns: count, discounted mass of the kept ones, and their chances at the order below."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left, 0, model.order)
        block.read(right, model, k - 1)
        lower = block.kept
        block.read(right, model, k)
        _, owned, n, at = block.owned[k]
        use = n >= model.min_count
        contexts, inverse = np.unique(block.contexts[k], return_inverse=True)
        of = inverse[at[owned]]
        add = lambda values: np.bincount(of, values[owned], len(contexts))
        return pa.Table.from_batches([block.send(parts, contexts, add(n).astype(np.int64), add(np.where(use, model.discounted(k, n), 0)), add(np.where(use, lower[at], 0)))])

    return send


def _add_contexts(k: int):
    def add(table: pa.Table) -> pa.Table:
        each = [_unpack_keys(x) for x in table["keys"].to_pylist()]
        keys, inverse = np.unique(np.concatenate(each), return_inverse=True)
        total = lambda parts: np.bincount(inverse, np.concatenate(parts), len(keys))
        every = total([_unpack(x) for x in table["n"].to_pylist()]).astype(np.int64)
        mass, lower = (total([_unpack_floats(x) for x in table[c].to_pylist()]) for c in ("mass", "lower"))
        # a context whose kept n-grams took all would leave nothing to spread; the rounding of sums is cut off at 0
        alpha = np.maximum(1 - mass / np.maximum(every, 1), 1e-12) / np.maximum(1 - lower, 1e-12)
        seen = every > 0
        return _answer(f"h{k}", table, keys, [len(x) for x in each], every[inverse], alpha[inverse], {"keys": _pack_keys(keys[seen]), "n": _pack(every[seen]), "x": alpha[seen].tobytes()})

    return add


def _score(model: KatzModel):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left, 0, model.order)
        block.read(right, model, model.order)
        add = lambda values: np.add.reduceat(values, block.starts)
        n = block.n[1]
        columns = [block.ids, pa.array(block.train_docs), *(pa.array(c) for c in (block.ends + 1 - block.starts, add((n > 0).astype(np.int64)), add(np.log10(n + 0.1)), add(np.log10(block.chance))))]
        return pa.Table.from_arrays(columns, ["id", "train", "n_tokens", "n_known", "base", "score"])

    return score


def fit_katz(blocks: DataFrame, order: int = 2, min_count: int = 2) -> tuple[KatzModel, DataFrame | None]:
    """A model of the packed documents with ``train``, and what its tables answer each block.

    Without any training token all mass is the unknown class's.
    """
    model, parts, back = KatzModel(order, min_count), bucket_count(blocks), None
    for k in range(1, order + 1):
        turns = PASSES if k > 1 else 1
        got = None
        for turn in range(turns):
            sent = blocks.mapInArrow(_send_counts(k, order, parts, turn, turns), _SENT)
            some = stored(sent.groupBy("part").applyInArrow(trimmed(_add_counts(k, min_count)), _BACK))
            got = some if got is None else got.unionByName(some)
        model.tables[k] = got.where("block IS NULL").select("part", "keys", "n")
        rows = got.where("block IS NULL").select(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(DISCOUNTED + 3)]).first()
        model.learn(k, [x or 0 for x in rows])
        back = got.where("block IS NOT NULL") if back is None else back.unionByName(got.where("block IS NOT NULL"))
        if k > 1:
            sent = _cogroup(blocks, back, _send_contexts(k, model.plain(), parts), _SENT)
            got = stored(sent.groupBy("part").applyInArrow(trimmed(_add_contexts(k)), _BACK))
            model.backoff[k] = got.where("block IS NULL").select("part", "keys", "n", "x")
            back = back.unionByName(got.where("block IS NOT NULL"))
    return model, back


def _cogroup(blocks: DataFrame, back: DataFrame, f, schema: str) -> DataFrame:
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(trimmed(f), schema)


def katz_scores(docs: DataFrame, held, order: int = 2, min_count: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``held_out``, n_tokens, n_known, train_tokens, base_score, score; learned from the rows that are not ``held``.

    Null and empty texts are the end token alone.  Each row is a document of its
    own, also where ids are null or repeat.  A text of any length is one
    document of one block.  Other columns are not read.  An empty table gives no
    rows.
    """
    texts = docs.select(F.col(id_col).alias("id"), (~F.coalesce(held, F.lit(False))).alias("train"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    blocks = stored_by(texts.mapInArrow(freed(_blocks), f"block long, ids array<{kind}>, train array<boolean>, words binary, tokens binary, ends binary"), "block")
    model, back = fit_katz(blocks, order, min_count)
    scored = _cogroup(blocks, back, _score(model.plain()), f"id {kind}, train boolean, n_tokens long, n_known long, base double, score double")
    shift = np.log10(model.total + 0.1 * (model.words + 1))
    return scored.select(
        F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(int(model.total)).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(float(shift))).alias("base_score"), "score"
    )


def op3_katz_backoff(spark, sf_dir: str) -> DataFrame:
    """Every bigram seen is kept, also those seen once; logarithms are rounded to 6 places."""
    docs = documents(spark, sf_dir)
    scores = katz_scores(docs.select("doc_id", "text"), held_out("doc_id", 10, 0), min_count=1)
    return scores.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


#: crc32 by its table of 256 steps, tokens, counts, discounts, backoff weights, scores.
OP3_SQL = r"""
WITH RECURSIVE steps AS (SELECT range AS b, range AS c, 0 AS s FROM range(256) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, s + 1 FROM steps WHERE s < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE s = 8),
docs AS (SELECT doc_id, xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) % 10 = 0 AS held_out,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') || [' '] AS ws FROM documents, crc),
tokens AS (SELECT doc_id, held_out, unnest(ws) AS w, unnest(['start '] || ws[:-2]) AS h FROM docs),
unigrams AS (SELECT w, count(*) FILTER (NOT held_out) AS c FROM tokens GROUP BY w),
bigrams AS (SELECT h, w, count(*) FILTER (NOT held_out) AS c FROM tokens GROUP BY h, w),
totals AS (SELECT sum(c) AS n, count(*) FILTER (c > 0) AS v FROM unigrams),
counts AS (SELECT 1 AS k, r, (SELECT count(*) FROM unigrams WHERE c = r) AS n FROM range(1, 7) x(r) UNION ALL SELECT 2, r, (SELECT count(*) FROM bigrams WHERE c = r) FROM range(1, 7) x(r)),
lines AS (SELECT k, list(CAST(n AS DOUBLE) ORDER BY r) AS ns, least(regr_slope(ln(greatest(n, 0.5)), ln(r)), -1.1) AS slope FROM counts GROUP BY k),
factors AS (SELECT k, ns, list_transform([1, 2, 3, 4, 5], lambda r: ((r + 1) * ns[r + 1] / ns[r] / r - 6 * ns[6] / ns[1]) / (1 - 6 * ns[6] / ns[1])) AS plain,
  list_transform([1, 2, 3, 4, 5], lambda r: (pow((r + 1) / r, slope + 1) - pow(6, slope + 1)) / (1 - pow(6, slope + 1))) AS smooth FROM lines),
discounts AS (SELECT k, ns, CASE WHEN list_min(ns) > 0 AND 6 * ns[6] < ns[1] AND list_min(plain) > 0 AND list_max(plain) < 1 THEN plain ELSE smooth END AS d FROM factors),
first AS (SELECT w, c, c * CASE WHEN c BETWEEN 1 AND 5 THEN d[c] ELSE 1 END / n AS p FROM unigrams, totals, discounts WHERE k = 1),
unknown AS (SELECT greatest(list_sum(list_transform([1, 2, 3, 4, 5], lambda r: ns[r] * r * (1 - d[r]))) / n, 1e-12) AS u FROM totals, discounts WHERE k = 1),
second AS (SELECT h, w, c, c * CASE WHEN c BETWEEN 1 AND 5 THEN d[c] ELSE 1 END AS kept FROM bigrams, discounts WHERE k = 2),
contexts AS (SELECT h, sum(s.c) AS every, greatest(1 - sum(kept) / greatest(sum(s.c), 1), 1e-12) / greatest(1 - sum(CASE WHEN s.c > 0 THEN p ELSE 0 END), 1e-12) AS alpha FROM second s JOIN first USING (w) GROUP BY h),
scored AS (SELECT t.doc_id, t.held_out, f.c, CASE WHEN s.c > 0 THEN s.kept / every ELSE alpha * CASE WHEN f.c > 0 THEN p ELSE u END END AS chance FROM tokens t JOIN first f USING (w) JOIN second s ON s.h = t.h AND s.w = t.w JOIN contexts x ON x.h = t.h, unknown)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((c + 0.1) / (n + 0.1 * (v + 1)))), 6) AS base_score, round(sum(log10(chance)), 6) AS score
FROM scored, totals GROUP BY doc_id, held_out
"""
