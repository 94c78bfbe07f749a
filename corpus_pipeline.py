"""Five stages from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. A null text counts as empty throughout; a text that loses all its bytes stays, empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import _blocks, exact_dedup, near_dedup, packing, quality, suffix_dedup
from loomspark.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier, trained on these rows and the labels, accepts, each as it is.

    A null text is scored as an empty one; repeated rows are scored alike. Without labels of both classes a row's score
    is the share of label 1, or 0.5: none are accepted without any label. No rows give no rows.
    """
    return quality.keep(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that of the least doc_id. Of several such rows (a repeated id), one stays.

    Null texts are empty; all empty texts are one group; rows without an id stay only in groups without any. No rows give no rows.
    """
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    kept = exact_dedup.groups(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_h"))
    mine = docs.withColumn("_sha", F.sha2(norm.cast("binary"), 256))
    found = mine.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_h")), "left_semi")
    return found.dropDuplicates(["doc_id", "_sha"]).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the least doc_id, with all its rows.

    Null and empty texts and those without a word are alone in their class, as are rows without an id: they stay. No rows give no rows.
    """
    ids = near_dedup.classes(docs).where("kept").select(F.col("doc_id").alias("_kept"))
    return docs.join(ids.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi").select(docs.columns)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeated 200-byte strings cover, and without characters cut in two; n_chars follows.

    Every row stays, a null text as an empty one; repeated rows are texts of their own.
    """
    cut = suffix_dedup.cut_repeats(docs, carry=True, kept="text")
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept")} | {c: F.col("carried").getField(c) for c in docs.columns if c not in ("doc_id", "text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return cut.select(*(columns[c].alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 4096 tokens; null and empty texts are the end token alone, repeated rows are packed each."""
    return packing.packed(docs, tokenizer_path())


STAGES = [("quality classifier", keep_quality), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("suffix-array dedup", cut_passages), ("best-fit packing", pack)]

#: A trained classifier and tokenizer decide the rows, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = _blocks.documents(spark, sf_dir), _blocks.made()
    for _, stage in STAGES[:-1]:
        docs = _blocks.stored(stage(spark, docs, sf_dir))
        _blocks.forget_since(before, docs)  # what the stage itself stored, and its input
    return STAGES[-1][1](spark, docs, sf_dir)
