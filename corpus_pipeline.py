"""A corpus pipeline of five stages over ``documents``; each works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import bpe, decontaminate, language_id, line_dedup, near_dedup
from weirflow.llm.common import small_batches, table, written


def own_columns(docs: DataFrame) -> DataFrame:
    """doc_id, text and the rest of the row beside them, so that no column of the row clashes with an operator's."""
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"))


def row_of(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` from ``own_columns`` of it."""
    return [F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected (no letters, or a tie of two languages) go; the others stay unchanged."""
    small_batches(spark)
    profiles = language_id.train_profiles(docs)
    got = language_id.identify(own_columns(docs), profiles, min_margin=language_id.MIN_MARGIN, keep=("text", "_row"))
    return got.where(~F.col("rejected")).select(*row_of(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; a document of which nothing else is left goes with them. n_chars, if there, follows the text."""
    small_batches(spark)
    got = line_dedup.line_dedup(own_columns(docs))
    emptied = (F.col("n_dropped") > 0) & (F.trim(F.regexp_replace("text", r"[\t-\r ]+", " ")) == "")
    left = got.where(~F.coalesce(emptied, F.lit(False)))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row")["n_chars"])
    return left.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; of rows that repeat it, one.

    Where ids repeat, id and text name the document. Texts without a word are no duplicates; rows that repeat one go.
    """
    small_batches(spark)
    first = near_dedup.near_duplicates(docs, percent=80).where("is_first").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(first["_id"]) & (F.xxhash64(docs["text"]) == first["_hash"])
    return docs.join(first, same, "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; the others stay unchanged."""
    small_batches(spark)
    found = decontaminate.contamination(own_columns(docs), table(spark, sf_dir, "benchmark"), keep=("text", "_row"))
    return found.where(F.size("found") == 0).select(*row_of(docs))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded of every document that stays."""
    small_batches(spark)
    got = bpe.decode(bpe.encode(docs))
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("BPE", token_stage),
]

#: Compression, sketches and alignment can't be expressed in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{k}")
    return docs
