"""The corpus pipeline: documents to encoded, clean text.

STAGES run in order; each takes (spark, docs, sf_dir), works on all documents that the
stage before it kept, and is written as Parquet and read again. All but the last return the
columns of documents.

1 toxicity: documents with predicted = 1 go.
2 near-dedup: of each group of near copies (five-word shingles, similarity 0.8) the document
  with the smallest doc_id stays. Rows that agree in doc_id and text count as one document.
3 substring dedup: words in 35-word runs that stand elsewhere too are cut; a text that loses
  words becomes its kept words joined by one blank, and n_chars follows. No row goes.
4 decontamination: documents that hold a benchmark item go.
5 SentencePiece: doc_id, lang, source, the ids of the best segmentation and its score.

Null texts are kept up to the end and have no ids. Rows with a null doc_id are judged by
their text alone and kept as their own group. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from groundweave.llm.decontaminate import LEAST, find_items
from groundweave.llm.minhash import near_duplicates
from groundweave.llm.pieces import encode_pieces, id_width
from groundweave.llm.registry import small_batches, table
from groundweave.llm.substrings import remove_repeats
from groundweave.llm.toxicity import score_toxicity
from groundweave.session import bounded, cut


def apart(stage):
    """Keep columns beyond those of documents under names that no operator uses while a stage runs."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        safe = {c: c if c in ("doc_id", "text", "lang", "source", "n_chars") else f"__extra_{i}" for i, c in enumerate(docs.columns)}
        done = stage(spark, docs.select(*[F.col(f"`{c}`").alias(safe[c]) for c in docs.columns]), sf_dir)
        return done.select(*[F.col(safe[c]).alias(c) for c in docs.columns])

    return run


@apart
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    return score_toxicity(docs, table(spark, sf_dir, "labels"), learn).where("predicted = 0").select(docs.columns)


@apart
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = near_duplicates(docs, size=5, percent=80)
    key = ["doc_id", "text_hash"]
    keyed = docs.drop("text_hash").withColumn("text_hash", F.xxhash64("text"))
    gone = bounded(judged.where("NOT kept").select(key).distinct())
    repeated = bounded(judged.where("kept AND doc_id IS NOT NULL").groupBy(key).count().where("count > 1").select(key))
    left = keyed.join(gone, key, "left_anti")
    once = left.join(repeated, key, "left_anti").union(left.join(repeated, key, "left_semi").dropDuplicates(["doc_id", "text"]))
    return once.select(docs.columns)


@apart
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(docs, size=35)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    changed = cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars")))
    return changed.withColumn("text", text).select(docs.columns)


@apart
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return find_items(docs, table(spark, sf_dir, "benchmark"), least=LEAST).where(F.size("hits") == 0).select(docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = encode_pieces(docs.select("doc_id", "text", "lang", "source"), model)
    return encoded.select("doc_id", "lang", "source", (F.octet_length("ids") / id_width(model)).cast("long").alias("n_ids"), "ids", F.crc32("ids").alias("ids_crc32"), F.get("scores", F.lit(0)).alias("score"))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None  # compression lengths, MinHash and lattices are beyond SQL; tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
