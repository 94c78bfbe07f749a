"""Tagging scenes as they arrive: each micro-batch tags what the output doesn't hold yet, and appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from loomspark.functions import replies
from loomspark.operators import tagging
from loomspark.sources import readers, writers



def records(scenes: DataFrame, tagger: tagging.Tagger, vocab: dict[str, list[str]]) -> DataFrame:
    """Tag records of scenes (scene_id, text): labels outside the vocabulary dropped, failures marked."""
    got = tagging.tagged(scenes.select(F.col("scene_id").cast("string").alias("scene_id"), "text"), tagger).withColumn("_m", replies.facets("reply"))
    facets = F.create_map(*(x for f, v in vocab.items() if v for x in (F.lit(f), tagging.whitelisted(F.col("_m")[f], v))))
    ok = F.col("_m").isNotNull()
    return got.select("scene_id", "text", ok.alias("parse_ok"), F.when(ok, facets).alias("facets"), F.when(ok, F.coalesce(F.col("_m")["overflow"], F.array().cast("array<string>"))).alias("overflow"))


def run(stream: DataFrame, output: str, checkpoint: str, tagger: tagging.Tagger, vocab: dict[str, list[str]]) -> StreamingQuery:
    """Tag a stream of scenes until its source is used up. The anti-join makes a repeated micro-batch harmless."""

    def batch(df: DataFrame, _n: int) -> None:
        spark = df.sparkSession
        scenes = df.dropDuplicates(["scene_id"])
        try:
            scenes = tagging.todo(scenes, readers.jsonl(spark, output, readers.TAGS, strict=False))
        except AnalysisException:  # nothing written yet
            pass
        writers.append_tags(records(scenes, tagger, vocab), output)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
