"""Scenes: texts made of ordered segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text as X


def rows(df: DataFrame, key: str = "rowid", text: str = "text") -> DataFrame:
    """Each row is a scene: (scene_id string, text); null and empty texts are skipped."""
    return df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).cast("string").alias("scene_id"), F.col(text).alias("text"))


def ordered(df: DataFrame, scene: str = "scene_id", pos: str = "pos", text: str = "text") -> DataFrame:
    """(scene_id string, segments array<string>): the texts of a scene in order, null and empty ones skipped.

    One text is one value, so a scene's segments meet in one task; sort and join run there.
    """
    kept = df.where(F.col(text).isNotNull() & (F.col(text) != "") & F.col(scene).isNotNull())
    both = kept.groupBy(F.col(scene).cast("string").alias("scene_id")).agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))).alias("s"))
    return both.select("scene_id", F.transform("s", lambda x: x["t"]).alias("segments"))


def assembled(df: DataFrame, scene: str = "scene_id", pos: str = "pos", text: str = "text") -> DataFrame:
    """(scene_id, text): a scene's segments joined by a blank line."""
    return ordered(df, scene, pos, text).select("scene_id", F.array_join("segments", "\n\n").alias("text"))


def count(df: DataFrame, mode: str = "scene", scene: str = "scene_id", text: str = "text") -> DataFrame:
    """(scenes): rows with a text, or distinct scenes among them."""
    kept = df.where(F.col(text).isNotNull())
    return kept.agg((F.count("*") if mode == "row" else F.countDistinct(scene)).alias("scenes"))


def sizes(df: DataFrame, scene: str = "scene_id", text: str = "text") -> DataFrame:
    """(scene_id, n_segments): segments whose text is not null."""
    return df.where(F.col(text).isNotNull()).groupBy(F.col(scene).cast("string").alias("scene_id")).agg(F.count("*").alias("n_segments"))


def size_distribution(df: DataFrame, scene: str = "scene_id", text: str = "text") -> DataFrame:
    """(n_segments, scenes)."""
    return sizes(df, scene, text).groupBy("n_segments").agg(F.count("*").alias("scenes"))


def candidate_ids(df: DataFrame, least: int | None = None, most: int | None = None, seed: int = 42, scene: str = "scene_id", text: str = "text") -> DataFrame:
    """(scene_id, draw): scenes within the size bounds; ordering by ``draw`` is a shuffle that every engine repeats."""
    s = sizes(df, scene, text)
    if least:
        s = s.where(F.col("n_segments") >= least)
    if most:
        s = s.where(F.col("n_segments") <= most)
    return s.select("scene_id", F.md5(F.concat(F.lit(str(seed)), F.col("scene_id")).cast("binary")).alias("draw"))


def fetched(df: DataFrame, ids: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Segments of the scenes in ids: one semi-join in place of a lookup per scene."""
    keys = ids.select(F.col("scene_id").cast("string").alias("_id")).distinct()
    return df.join(keys, F.col(scene).cast("string") == F.col("_id"), "left_semi")


def with_seams(df: DataFrame, scene: str = "scene_id", pos: str = "pos", text: str = "text") -> DataFrame:
    """(scene_id, text, marked, seam_offsets): the text with and without numbered seams, and where segments begin."""
    return ordered(df, scene, pos, text).select("scene_id", X.marked(F.col("segments"), False).alias("text"), X.marked(F.col("segments"), True).alias("marked"), X.seam_offsets(F.col("segments")).alias("seam_offsets"))
