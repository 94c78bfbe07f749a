"""Writers of corpora, manifests, analyses and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.config import FACETS


def texts(df: DataFrame, path: str, text: str = "text") -> None:
    """{"text": ...} per line."""
    df.select(F.col(text).alias("text")).write.mode("overwrite").json(path)


def manifest(df: DataFrame, path: str) -> None:
    """Rows of the manifest, a folder per split."""
    df.select("scene_id", "chunk_index", "split", "estimated_tokens", "text").write.mode("overwrite").partitionBy("split").json(path)


def table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """An analysis or chunk list as CSV with a header, or as Parquet."""
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.parquet(path)


def append_tags(df: DataFrame, path: str) -> None:
    """Tag records after those already there."""
    df.write.mode("append").json(path)


def vocabulary(counts: DataFrame, path: str, least: int = 1) -> None:
    """An editable vocabulary: facets in their order, labels by count, each with its count as a comment. One file: a vocabulary is small by nature."""
    place = F.array_position(F.array(*(F.lit(f) for f in FACETS)), F.col("facet"))
    kept = counts.where(F.col("n") >= least).select(place.alias("f"), "facet", F.lit(1).alias("kind"), (-F.col("n")).alias("o"), "label", F.format_string("%s    # %d", "label", "n").alias("value"))
    spark = counts.sparkSession
    heads = spark.createDataFrame([(i + 1, f, 0, 0, "", f"[{f}]") for i, f in enumerate(FACETS)], "f int, facet string, kind int, o long, label string, value string")
    kept.select(F.col("f").cast("int"), "facet", "kind", F.col("o").cast("long"), "label", "value").unionByName(heads).orderBy("f", "kind", "o", "label").select("value").coalesce(1).write.mode("overwrite").text(path)


def statistics_report(stats: DataFrame, histogram: DataFrame | None = None) -> str:
    """corpus_stats() as Markdown, with length_histogram() where given."""
    r = stats.first()
    if r is None:
        return "# Corpus statistics\n\nNo chunks.\n"
    names = [c for c in stats.columns if c != "flags"]
    bins = [] if histogram is None else ["", "## Lengths", *(f"- bin {b['bin']}: {b['n']}" for b in histogram.orderBy("bin").collect())]
    return "\n".join(["# Corpus statistics", "", *(f"- {c}: {r[c]}" for c in names), "", "## Flags", *(f"- {x}" for x in (r["flags"].split(",") if r["flags"] else ["none"])), *bins]) + "\n"
