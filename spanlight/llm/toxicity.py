"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text without punctuation at their ends, and the first
four to six bytes of each (stems); all hashed to ``HASHED`` numbers.  On a
bounded, stratified sample of labelled rows the machine gets the terms that tell
the classes apart alone, and of the most frequent terms those of which a pair
does, though its members may say nothing alone.  Over these a second-order
factorization machine is fitted: a weight for each term and a vector whose inner
products weigh pairs.  (A prototype without a selection, with AdaGrad instead of
Adam, over the 77,784 terms of three and more documents, fitted its sample
closely and found at most 26 of 97 held-out toxic documents of sf0.1 after six
epochs in the two settings that were tried; this module finds 85.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import documents, freed
from .language_id import held_out

#: Labelled rows of each class that a model is fitted on, about; a documented bound on the sample.
SAMPLE_PER_CLASS = 8_000
#: Numbers that terms are hashed to.
HASHED = 1 << 20
#: Most terms that are taken because they tell the classes apart alone, by more than ``APART`` standard deviations.
SELECTED = 4_096
APART = 2
#: The most frequent terms of the sample, of which all pairs are looked at: a pair that tells the classes apart by more than ``PAIR_APART`` brings both its terms.
PAIRED = 2_048
PAIR_APART = 6
#: Documents of the sample that a term is in at least.
LEAST_DOCS = 3
FACTORS = 8
STEMS = (4, 5, 6)

_EDGE = np.zeros(256, bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) of each word and stem, in no order and with repetitions."""
    data = B.lower_ascii(data)
    starts, ends, bounds = B.words(data, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    for _ in range(2):
        ends = ends - ((ends > starts) & _EDGE[data[np.maximum(ends - 1, 0)]])
        starts = starts + ((ends > starts) & _EDGE[data[np.minimum(starts, len(data) - 1)]]) if len(data) else starts
    keep = ends > starts
    starts, ends, doc = starts[keep], ends[keep], doc[keep]
    sums = B.rolling(data)
    found = [B.span_hash(sums, starts, ends)]
    docs = [doc]
    for k in STEMS:
        long = ends - starts > k
        found.append(B.mix64(B.span_hash(sums, starts[long], starts[long] + k) + np.uint64(k)))
        docs.append(doc[long])
    return np.concatenate(docs), (np.concatenate(found) >> np.uint64(44)).astype(np.int64)


def _distinct(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(doc * HASHED + term)
    return key // HASHED, key % HASHED


class FactorizationMachine:
    def __init__(self, index: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.index, self.bias, self.weights, self.factors = index, bias, weights, factors

    def margins(self, rows: int, doc: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Log odds of documents 0..rows-1 from (document, selected term number)."""
        out = self.bias + np.bincount(doc, weights=self.weights[term], minlength=rows)
        for f in range(self.factors.shape[1]):
            v = self.factors[term, f]
            out += 0.5 * (np.bincount(doc, weights=v, minlength=rows) ** 2 - np.bincount(doc, weights=v * v, minlength=rows))
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, term = terms(data, offsets)
        number = self.index[term]
        keep = number >= 0
        doc, number = _distinct(doc[keep], number[keep].astype(np.int64))
        return 1 / (1 + np.exp(-np.clip(self.margins(len(offsets) - 1, doc, number), -500, 500)))

    @classmethod
    def fit(cls, index: np.ndarray, rows: int, doc: np.ndarray, term: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> FactorizationMachine:
        """Adam on the whole sample's weighted logistic loss."""
        width = int(index.max()) + 1 if len(index) else 0
        rng = np.random.default_rng(5)
        chance = np.clip((weight * label).sum() / weight.sum(), 1e-4, 1 - 1e-4)
        model = cls(index, float(np.log(chance / (1 - chance))), np.zeros(width), rng.normal(0, 0.05, (width, FACTORS)))
        share = weight / weight.sum()
        moments = [np.zeros(1 + width * (1 + FACTORS)) for _ in range(2)]
        for t in range(1, steps + 1):
            slope = share * (1 / (1 + np.exp(-np.clip(model.margins(rows, doc, term), -30, 30))) - label)
            each = slope[doc]
            gradient = np.empty(1 + width * (1 + FACTORS))
            gradient[0] = slope.sum()
            gradient[1 : 1 + width] = np.bincount(term, weights=each, minlength=width) + decay * model.weights / max(width, 1)
            for f in range(FACTORS):
                v = model.factors[term, f]
                sums = np.bincount(doc, weights=v, minlength=rows)
                gradient[1 + width * (1 + f) : 1 + width * (2 + f)] = np.bincount(term, weights=each * (sums[doc] - v), minlength=width) + decay * model.factors[:, f] / max(width, 1)
            moments[0] = 0.9 * moments[0] + 0.1 * gradient
            moments[1] = 0.99 * moments[1] + 0.01 * gradient * gradient
            step = rate * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.99**t)) + 1e-6)
            model.bias -= float(step[0])
            model.weights = model.weights - step[1 : 1 + width]
            model.factors = model.factors - 0.2 * step[1 + width :].reshape(FACTORS, width).T
        return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> FactorizationMachine:
    """A machine from a stratified sample of the labelled rows; without both classes it scores by their share alone.

    Rows with a null label, and labels without a document, are left out; of an
    id with several labels the greatest counts.  The classes' weights undo the
    stratification.  The sampled ids are a bounded
    table and broadcast; so no text is shuffled.
    """
    named = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), (F.col(label_col) == 1).cast("int").alias("__label")).groupBy("__id").agg(F.max("__label").alias("__label"))
    count = {r[0]: r[1] for r in named.groupBy("__label").count().collect()}
    positive, total = count.get(1, 0), sum(count.values())
    nothing = FactorizationMachine(np.full(HASHED, -1, np.int16), 0.0, np.zeros(0), np.zeros((0, FACTORS)))
    if not total or positive in (0, total):
        nothing.bias = 30.0 if total and positive else -30.0
        return nothing
    part = {k: min(1.0, SAMPLE_PER_CLASS / n) for k, n in count.items()}
    chosen = F.pmod(F.xxhash64("__id", F.lit("toxicity sample")), F.lit(1 << 30)) < F.when(F.col("__label") == 1, int(part[1] * (1 << 30))).otherwise(int(part[0] * (1 << 30)))
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(named.where(chosen)), "__id").select("__text", "__label")

    def by_document(batches):
        for batch in batches:
            label = np.asarray(batch.column(1))
            for row, stop, data, offsets in B.utf8_chunks(batch, "__text"):
                doc, term = _distinct(*terms(data, offsets))
                for k in (0, 1):
                    own = label[row:stop] == k
                    found, n = np.unique(term[own[doc]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n * (k == 0)), pa.array(n * (k == 1))], ["term", "clean", "toxic"])

    sizes = {r[0]: r[1] for r in sample.groupBy("__label").count().collect()}
    if len(sizes) < 2:
        nothing.bias = 30.0 if sizes.get(1) else -30.0
        return nothing
    stats = sample.mapInArrow(freed(by_document), "term long, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    a, b = F.col("toxic") / F.lit(float(sizes[1])), F.col("clean") / F.lit(float(sizes[0]))
    apart = F.abs(a - b) / F.sqrt((F.col("toxic") + 1) / F.lit(float(sizes[1]) ** 2) + (F.col("clean") + 1) / F.lit(float(sizes[0]) ** 2))
    stats = stats.where(f"clean + toxic >= {LEAST_DOCS}").select("term", "clean", "toxic", apart.alias("apart"))
    best = stats.where(f"apart > {APART}").orderBy(F.desc("apart"), "term").limit(SELECTED).toPandas()["term"].to_numpy(np.int64)
    common = stats.orderBy(F.desc(F.col("clean") + F.col("toxic")), "term").limit(PAIRED).toPandas()["term"].to_numpy(np.int64)
    chosen = np.concatenate([best, np.setdiff1d(common, best)])
    index = np.full(HASHED, -1, np.int16)
    index[chosen] = np.arange(len(chosen))
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def selected(batches):
        for batch in batches:
            label = batch.column(1)
            for row, stop, data, offsets in B.utf8_chunks(batch, "__text"):
                doc, term = terms(data, offsets)
                number = shared.value[term]
                doc, number = _distinct(doc[number >= 0], number[number >= 0].astype(np.int64))
                cuts = np.searchsorted(doc, np.arange(stop - row + 1))
                rows = [number[i:j].astype("<i2").tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([label.slice(row, stop - row), pa.array(rows, pa.binary())], ["label", "terms"])

    got = sample.mapInArrow(freed(selected), "label int, terms binary").toArrow().to_pydict()
    rows = sorted(zip(got["label"], got["terms"], strict=True))  # the order of rows isn't fixed, the model is
    label = np.array([r[0] for r in rows], float)
    term = np.frombuffer(b"".join(r[1] for r in rows), "<i2").astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r[1]) // 2 for r in rows])
    rest = term >= len(best)  # the frequent ones that say little alone
    used = np.concatenate([np.arange(len(best)), len(best) + paired_terms(doc[rest], term[rest] - len(best), label, len(chosen) - len(best))])
    number = np.full(len(chosen), -1, np.int64)
    number[used] = np.arange(len(used))
    index = np.full(HASHED, -1, np.int16)
    index[chosen[used]] = np.arange(len(used))
    keep = number[term] >= 0
    weight = np.where(label == 1, 1 / part[1], 1 / part[0])
    return FactorizationMachine.fit(index, len(rows), doc[keep], number[term[keep]], label, weight)


def paired_terms(doc: np.ndarray, term: np.ndarray, label: np.ndarray, width: int) -> np.ndarray:
    """Terms of pairs that occur together in one class far more often than in the other, whatever each does alone."""
    together = []
    for k in (1, 0):
        has = np.zeros((int((label == k).sum()), width), np.float32)
        place = np.cumsum(label == k) - 1
        own = label[doc] == k
        has[place[doc[own]], term[own]] = 1
        together.append((len(has), has.T @ has))
    (n1, a), (n0, b) = together
    far = np.abs(a / n1 - b / n0) > PAIR_APART * np.sqrt((a + 1) / n1**2 + (b + 1) / n0**2)
    np.fill_diagonal(far, False)
    return np.flatnonzero(far.any(1))


def score_toxicity(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Columns of ``docs`` and the score in [0, 1]; a column of that name is replaced.

    Null texts score as the empty text, whose score is the model's prior.
    Whole texts of any length are read; repeated rows get equal scores.  An
    empty table gives no rows.
    """
    names = [n for n in docs.columns if n != score_col]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names] + [f"`{score_col}` double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for row, stop, data, offsets in B.utf8_chunks(batch, text_col):
                out[row:stop] = shared.value.score(data, offsets)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(out)], [*names, score_col])

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(freed(score), schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id", 5, 0))
    model = fit_toxicity(docs, labels)
    scored = score_toxicity(docs.select("doc_id", "text", held_out("doc_id", 5, 0).alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
