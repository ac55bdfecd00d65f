"""Language identification by prediction by partial matching.

Per language, a tree of byte contexts of up to ``depth`` bytes holds symbol
counts.  A symbol unseen in a context escapes to the next shorter one (method C:
an escape weighs as much as there are different symbols; symbols seen in the
longer context are excluded), at the root to equal chances.  Statistics are
frozen after training, so each context's code lengths are a fixed row, in
1/1024 bit: the code length of a text is a sum of integers, exact and
independent of the order of summation.

Counts come from a bounded sample of labelled documents, stratified by language,
and are aggregated in Spark; the driver gets all grams of the sample and builds
a sparse table of every context and symbol seen, which is broadcast.  Its size
is that of the sample's different grams, 12 bytes for each and each context.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import documents, freed

#: Labelled documents that a model is fitted on, about; a documented bound on the sample.
SAMPLE_DOCS = 20_000
#: Code lengths are held in fractions of a bit.
UNIT = 1024
#: A gram takes so many bits of a key; the language's number is above them.
_BITS = 40

UNDETERMINED = "und"


def _grams(depth: int):
    def count(batches):
        for batch in batches:
            codes = batch.column(batch.schema.get_field_index("code")).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, stop, data, offsets in B.utf8_chunks(batch, "text"):
                key = np.repeat(codes[row:stop], np.diff(offsets)) << _BITS | _gram(B.lower_ascii(data), offsets, depth)
                key, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["key", "n"])

    return count


def _gram(data: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """Of each byte, itself in the lowest byte, the one before it in the next, and so on."""
    gram = data.astype(np.int64)
    for k, byte in enumerate(_history(data, offsets, depth)):
        gram |= byte.astype(np.int64) << (8 * (k + 1))
    return gram


def _history(data: np.ndarray, offsets: np.ndarray, depth: int) -> list[np.ndarray]:
    """Byte 1, 2, .. depth places before each byte; before the start of a document are line feeds."""
    out = []
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, depth + 1):
        byte = np.full(len(data), 10, np.uint8)
        byte[k:] = data[:-k] if k <= len(data) else data[:0]
        byte[place < k] = 10
        out.append(byte)
    return out


class ContextTrees:
    """Frozen trees of all languages.

    ``levels[k]`` has, for contexts of k bytes, the grams seen and their code
    lengths in bits, and the contexts seen and what an escape from them adds to
    the code length in the next shorter one; each pair with the places where the
    languages begin.  Both are ascending within a language.
    """

    def __init__(self, langs: list[str], size: int, levels: list[tuple], depth: int):
        self.langs, self.size, self.levels, self.depth = langs, size, levels, depth

    @classmethod
    def fit(cls, langs: list[str], keys: np.ndarray, counts: np.ndarray, depth: int) -> ContextTrees:
        """From the counts of keys: the language's number above the gram.  Languages without a gram are left out."""
        present, number = np.unique(keys >> _BITS, return_inverse=True)
        langs, keys = [langs[i] for i in present.tolist()], number.astype(np.int64) << _BITS | keys & ((1 << _BITS) - 1)
        order = np.argsort(keys)
        seen = [(keys[order], counts[order].astype(np.float64))]
        for k in range(depth, 0, -1):  # without the byte farthest back
            shorter, inverse = np.unique(seen[0][0] & ~(255 << (8 * k)), return_inverse=True)
            seen.insert(0, (shorter, np.bincount(inverse, weights=seen[0][1])))
        size = len(np.unique(seen[0][0] & 255)) + 1  # what was never seen is one symbol more
        levels, chance = [], None
        for k, (key, n) in enumerate(seen):
            parent = np.full(len(key), 1 / size) if k == 0 else chance[np.searchsorted(seen[k - 1][0], key & ~(255 << (8 * k)))]
            contexts, first = np.unique(key >> 8, return_index=True)
            total, kinds = np.add.reduceat(n, first), np.diff(np.append(first, len(key)))
            chance = n / np.repeat(total + kinds, kinds)
            escape = kinds / (total + kinds) / (1 - np.add.reduceat(parent, first))
            levels.append((*cls._by_language(key, -np.log2(chance), len(langs), _BITS), *cls._by_language(contexts, -np.log2(escape), len(langs), _BITS - 8)))
        return cls(langs, size, levels, depth)

    @staticmethod
    def _by_language(keys: np.ndarray, bits: np.ndarray, many: int, shift: int) -> tuple[list[int], np.ndarray, np.ndarray]:
        starts = np.searchsorted(keys, np.arange(many + 1, dtype=np.int64) << shift).tolist()
        return starts, keys & ((1 << shift) - 1), bits.astype(np.float32)

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Code length of each gram's symbol after its context, by language, in 1/UNIT bit."""
        out = np.empty((len(self.langs), len(grams)), np.int32)
        for lang in range(len(self.langs)):
            bits, left = np.zeros(len(grams)), np.arange(len(grams))
            for k in range(self.depth, -1, -1):
                starts, keys, cost, begins, contexts, escape = self.levels[k]
                short = grams[left] & ((1 << (8 * (k + 1))) - 1)
                found, at = _find(contexts[begins[lang] : begins[lang + 1]], short >> 8)
                known, within = left[found], short[found]  # the others go on to the next shorter context
                seen, place = _find(keys[starts[lang] : starts[lang + 1]], within)
                bits[known[seen]] += cost[starts[lang] + place[seen]]
                bits[known[~seen]] += escape[begins[lang] + at[found][~seen]]
                going = np.ones(len(left), bool)
                going[np.flatnonzero(found)[seen]] = False
                left = left[going]
            bits[left] += np.log2(self.size)
            out[lang] = np.rint(bits * UNIT)
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each document in each language, in 1/UNIT bit."""
        out = np.zeros((len(offsets) - 1, len(self.langs)), np.int64)
        if not len(data):
            return out
        grams, place = np.unique(_gram(data, offsets, self.depth), return_inverse=True)
        full = np.flatnonzero(np.diff(offsets))
        for k, cost in enumerate(self.costs(grams)):
            out[full, k] = np.add.reduceat(cost[place], offsets[:-1][full], dtype=np.int64)
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each wanted value is among the ascending keys, and its place."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def _rows_each(sizes: list[int], most: int) -> float:
    """The number of rows to take of each class, or all it has, so that ``most`` are taken in all."""
    rest = most
    for k, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - k) > rest:
            return rest / (len(sizes) - k)
        rest -= n
    return float(max(sizes))


def fit_language_model(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", depth: int = 3, sample_docs: int = SAMPLE_DOCS) -> ContextTrees | None:
    """Trees from a sample of about ``sample_docs`` of the rows with a text and a language; None without any.

    Of each language as many rows are taken, or all that it has; which ones, a
    hash of the id says.
    """
    if not 1 <= depth <= 4:
        raise ValueError("depth is 1 to 4")
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = dict(sorted((r[0], r[1]) for r in rows.groupBy("lang").count().collect()))
    if not sizes:
        return None
    langs, each = list(sizes), _rows_each(list(sizes.values()), sample_docs)
    lookup = lambda values: F.element_at(F.create_map(*[F.lit(x) for pair in zip(langs, values, strict=True) for x in pair]), F.col("lang"))
    if sum(sizes.values()) > sample_docs:
        rows = rows.where(F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1 << 30)) < lookup([int(min(1.0, each / n) * (1 << 30)) for n in sizes.values()]))
    counts = rows.select("text", lookup(range(len(langs))).cast("long").alias("code")).mapInArrow(freed(_grams(depth)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    if not got.num_rows:
        return None
    return ContextTrees.fit(langs, got["key"].to_numpy(), got["n"].to_numpy(), depth)


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    sums = np.concatenate([[0], np.cumsum(ascii_letter, dtype=np.int64)])
    found = sums[offsets[1:]] > sums[offsets[:-1]]
    for k in np.flatnonzero(~found & (np.diff(offsets) > 0)).tolist():
        found[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return found


def predict_language(docs: DataFrame, model: ContextTrees | None, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Columns of ``docs``, the predicted language and its share of the probability (a column with one of these names is replaced).

    ``und`` with score 0 where the text is null or has no letter (empty texts
    too), and for all rows without a model.  Equal code lengths go to the
    language first by name.  Repeated rows get equal values.
    """
    names = [n for n in docs.columns if n not in (pred_col, score_col)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names] + [f"`{pred_col}` string", f"`{score_col}` double"])
    trees = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        model = trees.value
        langs = np.array([UNDETERMINED, *(model.langs if model else [])], dtype=object)
        limit = max(1 << 16, B.CHUNK_BYTES * 4 // max(4, len(langs)))
        for batch in batches:
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for row, stop, data, offsets in B.utf8_chunks(batch, text_col, limit):
                known = _has_letter(data, offsets)
                if model and known.any():
                    bits = model.lengths(B.lower_ascii(data), offsets)
                    first = bits.argmin(1)
                    share = 1 / np.exp2(-(bits - bits.min(1, keepdims=True)) / UNIT).sum(1)
                    best[row:stop] = np.where(known, first + 1, 0)
                    score[row:stop] = np.where(known, share, 0)
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs[best], pa.string()), pa.array(score)], [*names, pred_col, score_col])

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(freed(predict), schema)


def held_out(id_col: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves the remainder; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_language_model(docs.where(~held_out("doc_id", 4, 2)))
    scored = predict_language(docs.select("doc_id", "text", held_out("doc_id", 4, 2).alias("held_out")), model)
    return scored.select("doc_id", "held_out", "lang_pred", "score")
