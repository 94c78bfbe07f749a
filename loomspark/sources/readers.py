"""Readers of JSON lines, scores, vocabularies, keywords, prompts and run records."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

MANIFEST = "scene_id string, chunk_index int, split string, estimated_tokens int, text string"
TAGS = "scene_id string, text string, parse_ok boolean, facets map<string,array<string>>, overflow array<string>"
DISCOVERY = "scene_id string, n_segments int, text string, parse_ok boolean, situation array<string>, interactions array<string>, appearance array<string>, actions array<string>, setting array<string>, tone array<string>, dynamics array<string>"
RUNS = "run_name string, created string, base_model string, lora struct<r:int>, train_config struct<epochs:double>, corpus struct<train:struct<examples:long>>, metrics struct<train_loss:double>"

#: Keywords where no file gives any.
DEFAULT_KEYWORDS = ["example", "sample", "keyword"]


def jsonl(spark: SparkSession, path: str, schema: str | None = None, strict: bool = True) -> DataFrame:
    """JSON lines. strict: bad lines, lines that aren't objects and empty files raise; else bad lines are skipped."""
    if not strict:
        given = T.StructType.fromDDL(schema) if schema else spark.read.json(path).schema
        kept = T.StructType([f for f in given if f.name != "_corrupt_record"])
        rows = spark.read.schema(T.StructType([*kept, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(path)
        return rows.where("_corrupt_record is null").drop("_corrupt_record")
    lines = spark.read.text(path).where(F.trim("value") != "")
    if not lines.limit(1).count():
        raise ValueError(f"{path}: no records")
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def corpus(spark: SparkSession, train: str, val: str | None) -> DataFrame:
    """(text, split) of the training and validation files of a corpus; a missing or empty file adds no rows."""
    parts = []
    for path, split in ((train, "train"), (val, "val")):
        try:
            rows = jsonl(spark, path, "text string", strict=False) if path else None
        except AnalysisException:  # no such file
            rows = None
        parts.append((rows if rows is not None else spark.createDataFrame([], "text string")).withColumn("split", F.lit(split)))
    return parts[0].unionByName(parts[1])


def segments(spark: SparkSession, url: str, table: str = "segments", scene: str = "scene_id", pos: str = "pos", text: str = "text", **options) -> DataFrame:
    """Segments of a database over JDBC, under the standard names; the projection and null filter run in the database."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return rows.select(F.col(scene).alias("scene_id"), F.col(pos).alias("pos"), F.col(text).alias("text")).where("text is not null")


def scores(spark: SparkSession, path: str) -> DataFrame:
    """(scene_id, score) of an analysis; the last of repeated ids, by file position."""
    rows = spark.read.option("header", True).csv(path).withColumn("_at", F.monotonically_increasing_id())
    return rows.groupBy("scene_id").agg(F.max_by(F.col("score").cast("double"), "_at").alias("score"))


def _lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a small settings file, by Spark's reader, so that any store will do."""
    try:
        whole = spark.read.text(path, wholetext=True).first()
    except AnalysisException:  # no such file
        return []
    return [x.strip() for x in whole[0].splitlines()] if whole else []


def keywords(spark: SparkSession, path: str | None, distinct: bool = False) -> list[str]:
    """Lower-case lines that aren't blank or comments; the defaults where there are none (no defaults with ``distinct``)."""
    found = [x.lower() for x in _lines(spark, path) if x and not x.startswith("#")] if path else []
    if distinct:
        return list(dict.fromkeys(found))
    return found or list(DEFAULT_KEYWORDS)


def vocabulary(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Facet headers in brackets, a label per line up to a comment sign; labels before any header are ignored."""
    out: dict[str, list[str]] = {}
    facet = None
    for line in _lines(spark, path):
        if not line or line.startswith("#"):
            continue
        if m := re.fullmatch(r"\[(\w+)\]", line):
            facet = out.setdefault(m[1], [])
        elif facet is not None and (label := line.partition("#")[0].strip()):
            facet.append(label)
    return out


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """(prompt): blocks between blank lines that aren't comments."""
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "\n\n")).alias("prompt"))
    return blocks.select(F.trim(F.regexp_replace("prompt", r"^\s+|\s+\z", "")).alias("prompt")).where((F.col("prompt") != "") & ~F.col("prompt").startswith("#"))


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs, newest first, with whether they left an adapter and how many checkpoints; those whose record is unreadable or missing keep their name and nulls."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "modificationTime")
    inside = F.regexp_extract("path", "^.*?" + re.escape(folder.rstrip("/").rpartition("/")[2]) + r"/([^/]+)/(.+)$", 2)
    name = F.regexp_extract("path", "^.*?" + re.escape(folder.rstrip("/").rpartition("/")[2]) + r"/([^/]+)/(.+)$", 1)
    each = files.select(name.alias("name"), inside.alias("f"), "modificationTime").where("name <> ''").groupBy("name").agg(F.bool_or(F.col("f").startswith("adapter/")).alias("adapter"), F.countDistinct(F.when(F.col("f").startswith("checkpoints/"), F.split("f", "/")[1])).alias("checkpoints"), F.max("modificationTime").alias("_m"))
    known = run_records(spark, folder) if each.limit(1).count() else None
    if known is None:
        return spark.createDataFrame([], "name string, created string, r int, epochs double, examples long, loss double, modified timestamp, adapter boolean, checkpoints long")
    return each.join(known, "name", "left").select("name", "created", "r", "epochs", "examples", "loss", F.coalesce("modified", "_m").alias("modified"), "adapter", "checkpoints").orderBy(F.desc("modified"), "name")


def run_records(spark: SparkSession, folder: str) -> DataFrame:
    """(name, created, r, epochs, examples, loss, modified) of run records; unreadable ones keep their name and nulls."""
    rows = spark.read.schema(RUNS).option("multiLine", True).json(f"{folder}/*/run.json").select("*", F.col("_metadata.file_modification_time").alias("modified"), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/run\.json$", 1).alias("folder"))
    shown = rows.select(F.col("folder").alias("name"), F.substring(F.replace("created", F.lit("T"), F.lit(" ")), 1, 16).alias("created"), F.col("lora.r").alias("r"), F.col("train_config.epochs").alias("epochs"), F.col("corpus.train.examples").alias("examples"), F.round("metrics.train_loss", 3).alias("loss"), "modified")
    return shown
