"""The queries of this package over the test tables; where SQL cannot express one, tests hold it against brute force."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowmender.llm import additive, benchmark_leaks, conversation_trie, hyper_language, importance, license_scan, line_crf, packing, secret_scan, set_sketch, subspace_join, suffix_index, word_bpe
from rowmender.llm import oracles
from rowmender.llm.common import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op11_benchmark_decontamination": oracles.LEAKS, "op12_conversation_trie": oracles.TRIE, "op13_importance_resampling": oracles.IMPORTANCE}
CAPACITY = 2048


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text")


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_index.remove_repeats(texts(spark, sf_dir))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), CAPACITY)
    return packing.pack(pieces, CAPACITY)


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = word_bpe.decode(word_bpe.encode(texts(spark, sf_dir), ranks), ranks)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return line_crf.judge(docs, line_crf.train(docs, load(spark, sf_dir, "labels")))


@query
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_sketch.components(texts(spark, sf_dir), set_sketch.SketchSettings(words=4))


@query
def op6_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace_join.near_vectors(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find_licenses(texts(spark, sf_dir))


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = texts(spark, sf_dir), load(spark, sf_dir, "labels")
    held_out = additive.fold("doc_id", 4) == 2
    model = additive.train(docs, labels.filter(~held_out))
    return additive.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = additive.fold("doc_id", 3) == 1
    prototypes = hyper_language.learn(docs.filter(~held_out))
    return hyper_language.identify(docs, prototypes).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return secret_scan.find_secrets(docs, words=secret_scan.corpus_words(docs))


@query
def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_leaks.find_leaks(texts(spark, sf_dir), load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(load(spark, sf_dir, "conversations"))


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.draw(texts(spark, sf_dir), load(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
