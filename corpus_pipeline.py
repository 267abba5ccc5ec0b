"""A corpus pipeline: good documents, one of each near copy, no long repeats, no secrets, packed.

Each stage takes the documents that the stage before kept, from a written table, and returns
documents in the same columns; the last one returns packed pieces. ``ORACLE_SQL`` is None, as
no stage can be written in SQL; a test holds the pipeline against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowmender.llm import additive, packing, secret_scan, set_sketch, suffix_index
from rowmender.llm.common import load, written

CAPACITY = 2048
#: A passage of over 50 words that recurs is cut.
PASSAGE_WORDS = 51
ORACLE_SQL = None


def recounted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars``, where there is one, counted anew."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from all labels."""
    return additive.accepted(docs, additive.train(docs, load(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id; a row of each id stays."""
    kept = set_sketch.components(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    alone = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).join(kept, "doc_id", "left_semi")
    return alone.unionByName(docs.filter("doc_id is null")).select(*[F.col(f"`{c}`") for c in docs.columns])


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of more than 50 words that recur anywhere; texts of which no word is left go."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    rows = docs.select("doc_id", "text", others, F.col("text").isNotNull().alias("had_text"))
    done = suffix_index.remove_repeats(rows, suffix_index.word_settings(PASSAGE_WORDS))
    # whole words are cut, so what stays is valid text
    done = done.withColumn("text", F.when(F.col("had_text"), F.col("kept").cast("string")))
    left = done.filter(F.col("n_removed").eqNullSafe(0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return recounted(left.select(*["text" if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced by a mark; frequent words of the documents count as cheap to guess."""
    return recounted(secret_scan.keep_redacted(docs, words=secret_scan.corpus_words(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in a sequence; the ids come along."""
    pieces = packing.tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, with_ids=True)
    return packing.pack(pieces, CAPACITY)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", long_repeats),
    ("secret scans", secrets),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
