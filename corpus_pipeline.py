"""A pipeline over ``documents``: language, exact copies, near copies, mixture, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.llm._spark import forget, stored
from spanlight.llm.byte_bpe import encode_bpe, vocabulary
from spanlight.llm.exact_dedup import exact_dedup
from spanlight.llm.language_id import UNDETERMINED, fit_language_model, held_out, predict_language
from spanlight.llm.mixing import RATE, SEED, TEMPERATURE, poisson_mix
from spanlight.llm.ngram_join import ngram_components

#: Documents whose language has a smaller share of the probability go.
LEAST_SCORE = 0.5
#: States and pieces that a worker keeps while it encodes: fewer than the tokenizer alone, for other stages' operators share the memory.
KEPT_STATES, KEPT_PIECES = 20_000, 100_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; those without a letter, and undecided ones, go."""
    model = fit_language_model(docs.where(~held_out("doc_id", 4, 2)))
    found = predict_language(docs, model, pred_col="__lang", score_col="__score")
    return found.where((F.col("__lang") != UNDETERMINED) & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id."""
    verdicts = exact_dedup(docs, carry={f"__{name}": F.col(name) for name in docs.columns if name != "doc_id"})
    return verdicts.where("kept").select(*[F.col("doc_id") if name == "doc_id" else F.col(f"__{name}").alias(name) for name in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar 5-gram sets the one with the smallest id; a null id comes last, and equal ids go by a hash of the text."""
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    gone = ngram_components(docs.select(key.alias("__key"), "text"), id_col="__key").where("component_id != __key").select("__key").distinct()
    return docs.withColumn("__key", key).join(gone, "__key", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target mixture of sources, in a global shuffle."""
    return poisson_mix(docs, temperature=TEMPERATURE, rate=RATE, seed=SEED).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each copy, with digests of them and of what they decode to."""
    path, pattern = vocabulary()
    decoded = encode_bpe(docs, path, pattern, keep_learned=False, decoded_col="decoded", max_kept=KEPT_STATES, max_pieces=KEPT_PIECES)
    return decoded.select(
        *["doc_id", "lang", "source", "token_ids"],
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [("language ID", language), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing sources", mix), ("byte-level BPE", tokens)]

#: SQL expresses neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each but the last is written to the shared checkpoint folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
