"""Tags of a closed vocabulary: taggers, whitelists, prompts and their statistics."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.config import FACETS
from loomspark.functions import replies
from loomspark.functions import text as X

#: Keys of a pilot reply.
PILOT_KEYS = ("genre", "tone", "setting", "pov", "pacing", "content_elements", "places", "invented_terms", "coherence_score", "coherence_notes", "broken_junctions")
#: Up to so many labels of a vocabulary are looked for one by one before a label is stripped.
_FEW = 8

Tagger = Callable[[list[str]], list[str]]


def tagged(scenes: DataFrame, tagger: Tagger, retry: bool = True, batch: int = 256, text: str = "text") -> DataFrame:
    """scenes with ``reply``: the tagger's JSON text (null where it doesn't parse), in batches; failed ones once more, with a reminder."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scenes.schema)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch].copy()
                texts = part[text].tolist()
                out = [replies.repaired(r) for r in tagger(texts)]
                failed = [j for j, r in enumerate(out) if r is None] if retry else []
                if failed:
                    again = tagger([texts[j] + "\n\n(Output ONLY the JSON object.)" for j in failed])
                    for j, r in zip(failed, again):
                        out[j] = replies.repaired(r)
                part["reply"] = out
                yield part

    return scenes.mapInPandas(run, schema + ", reply string")


def lexical_tagger(vocab: dict[str, list[str]]) -> Tagger:
    """A tagger for tests: a label applies if all its words are words of the text."""
    import json
    import re

    def run(texts):
        out = []
        for t in texts:
            have = set(re.findall(r"\w+", t.lower()))
            out.append(json.dumps({f: [v for v in vs if set(v.split("_")) <= have] for f, vs in vocab.items()} | {"overflow": []}))
        return out

    return run


def lexical_tags(words: Column, vocab: dict[str, list[str]]) -> Column:
    """The same as an expression: map of facet to labels.

    The words are met with the vocabulary once: the lambda's variable holds what they share, so no
    label scans the text and no facet splits it again.
    """
    labels = list(dict.fromkeys(v for vs in vocab.values() for v in vs))
    needed = list(dict.fromkeys(w for v in labels for w in v.split("_")))

    def tags(found):
        has = lambda v: F.forall(F.array(*(F.lit(w) for w in v.split("_"))), lambda w: F.array_contains(found, w)) if "_" in v else F.array_contains(found, v)
        pairs = [x for f in FACETS for x in (F.lit(f), F.array_compact(F.array(*(F.when(has(v), F.lit(v)) for v in vocab[f]))) if vocab.get(f) else F.array().cast("array<string>"))]
        return F.create_map(*pairs)

    shared = F.array_intersect(words, F.array(*(F.lit(w) for w in needed)) if needed else F.array().cast("array<string>"))
    return F.element_at(F.transform(F.array(shared), tags), 1)


def whitelisted(labels: Column, allowed: list[str]) -> Column:
    """Labels of the vocabulary, compared stripped and in lower case, the first of equal ones as it was written."""
    ok = list(dict.fromkeys(a.strip().lower() for a in allowed))
    low = lambda x: F.lower(X.strip(x))
    # stripping costs most: only different labels get to it, and with a short vocabulary only those that hold one of its labels
    maybe = lambda x: functools.reduce(operator.or_, (F.contains(F.lower(x), F.lit(a)) for a in ok)) if 0 < len(ok) <= _FEW else F.lit(True)
    kept = F.filter(F.array_distinct(F.coalesce(labels, F.array().cast("array<string>"))), lambda x: x.isNotNull() & maybe(x) & (low(x) != "") & low(x).isin(ok))
    lows = F.transform(kept, low)
    return F.filter(kept, lambda x, i: F.array_position(lows, low(x)) == i + 1)


def todo(scenes: DataFrame, done: DataFrame) -> DataFrame:
    """Scenes not in the output yet; failed ones count as done."""
    return scenes.join(done.select(F.col("scene_id").cast("string").alias("_id")), F.col("scene_id").cast("string") == F.col("_id"), "left_anti")


def from_manifest(scenes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Scenes that the manifest names."""
    return scenes.join(manifest.select(F.col("scene_id").cast("string").alias("_id")), F.col("scene_id").cast("string") == F.col("_id"), "left_semi")


def last_tags(records: DataFrame, order: str) -> DataFrame:
    """(scene_id, facets, overflow): the last parsed record of each scene by ``order``."""
    ok = records.where(F.coalesce("parse_ok", F.lit(True)) & F.col("scene_id").isNotNull())
    return ok.groupBy(F.col("scene_id").cast("string").alias("scene_id")).agg(F.max_by(F.struct("facets", "overflow"), order).alias("r")).select("scene_id", "r.facets", "r.overflow")


def labels_of(records: DataFrame, facets: str = "facets") -> DataFrame:
    """(scene_id, facet, label): one row per label of a map of facets."""
    return records.select("scene_id", F.explode(facets).alias("facet", "labels")).select("scene_id", "facet", F.explode("labels").alias("label"))


def vocabulary(records: DataFrame, facets: str = "facets", least: int = 1) -> DataFrame:
    """(facet, label, n): normalised labels of at least two characters by the number of scenes that have them."""
    each = labels_of(records, facets).withColumn("label", X.norm_label("label")).where(F.length("label") >= 2).distinct()
    return each.groupBy("facet", "label").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def top_labels(counts: DataFrame, k: int = 15) -> DataFrame:
    """The k most frequent labels of each facet, with ``rank``; ties by label."""
    w = Window.partitionBy("facet").orderBy(F.desc("n"), "label")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def label_use(records: DataFrame, facets: str = "facets") -> DataFrame:
    """(name, n): uses of facet:label in lower case."""
    return labels_of(records, facets).groupBy(F.concat_ws(":", "facet", F.lower("label")).alias("name")).agg(F.count("*").alias("n"))


def top_overall(counts: DataFrame, k: int = 20) -> DataFrame:
    """The k most used names of label_use() or overflow_use(), with ``rank``; ties by name."""
    name = counts.columns[0]
    best = counts.orderBy(F.desc("n"), name).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), name)))  # k rows


def manifest_label_use(manifest: DataFrame, tags: DataFrame) -> DataFrame:
    """label_use() over the rows of a manifest whose tags make a prompt of their own, each row as often as it stands there."""
    t = tags.select(F.col("scene_id").cast("string").alias("_id"), "facets")
    rows = manifest.where(F.col("split").isin("train", "val")).select(F.col("scene_id").cast("string").alias("scene_id"))
    own = rows.join(t, F.col("scene_id") == F.col("_id")).where(prompt(F.col("facets")) != "Write a scene.")
    return label_use(own)


def as_lists(record: Column) -> Column:
    """A discovery record's JSON as a map of lists: scalars are lists of one."""
    return replies.facets(record)


def overflow_use(records: DataFrame) -> DataFrame:
    """(label, n): overflow labels in lower case, every use."""
    return records.select(F.explode("overflow").alias("label")).groupBy(F.lower("label").alias("label")).agg(F.count("*").alias("n"))


def facet_coverage(records: DataFrame, facets: str = "facets") -> DataFrame:
    """(facet, scenes, share): parsed scenes with at least one label, of all parsed ones."""
    each = [F.count_if(F.size(F.col(facets)[f]) > 0).alias(f) for f in FACETS]
    one = records.agg(F.count("*").alias("_n"), *each)
    pairs = F.explode(F.create_map(*(x for f in FACETS for x in (F.lit(f), F.col(f))))).alias("facet", "scenes")
    return one.select("_n", pairs).select("facet", "scenes", (F.col("scenes") / F.greatest(F.col("_n"), F.lit(1))).alias("share"))


def prompt(facets: Column, overflow: Column | None = None) -> Column:
    """The instruction that a scene's tags make: a line per facet with labels; a plain one without any."""
    shown = lambda a: F.array_join(F.transform(F.filter(a, lambda x: x.isNotNull() & (x != "")), lambda x: X.strip(F.replace(x, F.lit("_"), F.lit(" ")))), ", ")
    lines = [F.when(shown(facets[f]) != "", F.concat(F.lit(f.title() + ": "), shown(facets[f]))) for f in FACETS]
    if overflow is not None:
        lines.append(F.when(shown(overflow) != "", F.concat(F.lit("Other: "), shown(overflow))))
    body = F.concat_ws("\n", *lines)
    return F.when(body == "", F.lit("Write a scene.")).otherwise(F.concat(F.lit("Write a scene with the following elements.\n"), body))


def tagged_corpus(manifest: DataFrame, tags: DataFrame, use_overflow: bool = False) -> DataFrame:
    """(scene_id, chunk_index, split, prompt, completion): every train and val row of the manifest; untagged scenes get the plain prompt."""
    t = tags.select(F.col("scene_id").cast("string").alias("_id"), "facets", *(["overflow"] if use_overflow else []))
    both = manifest.join(t, F.col("scene_id").cast("string") == F.col("_id"), "left").where(F.col("split").isin("train", "val"))
    words = prompt(F.col("facets"), F.col("overflow") if use_overflow else None)
    return both.select("scene_id", "chunk_index", "split", F.when(F.col("_id").isNull(), F.lit("Write a scene.")).otherwise(words).alias("prompt"), F.col("text").alias("completion"))


def classifier_prompt(vocab: dict[str, list[str]]) -> tuple[str, dict]:
    """(lines of allowed labels, JSON schema) for a closed pass; facets without labels are left out."""
    keys = [f for f in FACETS if vocab.get(f)]
    strings = {"type": "array", "items": {"type": "string"}}
    schema = {"type": "object", "properties": {k: strings for k in [*keys, "overflow"]}, "required": [*keys, "overflow"]}
    return "\n".join(f"- {f}: {', '.join(vocab[f])}" for f in keys), schema


def missing_keys(keys: Column) -> Column:
    return F.array_sort(F.array_except(F.array(*(F.lit(k) for k in PILOT_KEYS)), keys))


def controls(texts: DataFrame, n: int, seed: int = 43, max_tokens: int = 3600) -> DataFrame:
    """(pair, text): n splices of two unrelated texts each, shortened to half each where too long. Reads 2 n rows of a seeded shuffle."""
    key = F.md5(F.concat(F.lit(str(seed)), F.col("scene_id").cast("string")).cast("binary"))
    some = texts.withColumn("_d", key).orderBy("_d").limit(2 * n)
    w = Window.partitionBy(F.lit(0)).orderBy("_d")  # 2 n rows
    numbered = some.withColumn("_n", F.row_number().over(w) - 1)
    a = numbered.where("_n % 2 = 0").select(F.expr("_n div 2").alias("pair"), F.col("text").alias("a"))
    b = numbered.where("_n % 2 = 1").select(F.expr("_n div 2").alias("pair"), F.col("text").alias("b"))
    seam, half = F.lit("\n\n⟦J1⟦\n\n"), max_tokens // 2 * 4
    whole = F.concat("a", seam, "b")
    return a.join(b, "pair").select("pair", F.when(X.token_estimate(whole, 4.0, 1) > max_tokens, F.concat(F.substring("a", 1, half), seam, F.substring("b", 1, half))).otherwise(whole).alias("text"))


def pilot_summary(records: DataFrame) -> DataFrame:
    """One row over pilot records: coherence histogram, seam breaks, ungrounded entities, caught controls and missing keys."""
    ok = F.col("parse_ok") & ~F.col("control")
    score, broken = F.col("coherence_score"), F.size(F.coalesce("broken_junctions", F.array().cast("array<int>"))) > 0
    size = lambda c: F.greatest(F.lit(0), F.size(F.coalesce(c, F.array().cast("array<string>"))))
    return records.agg(
        F.count_if(ok).alias("parsed"),
        *(F.count_if(ok & (score == s)).alias(f"score_{s}") for s in (5, 4, 3, 2, 1)),
        F.count_if(ok & ~F.coalesce(score.between(1, 5), F.lit(False))).alias("score_other"),
        F.count_if(ok & (score <= 2) & (score >= 1)).alias("low"),
        F.count_if(ok & (F.col("n_junctions") >= 1)).alias("with_seams"),
        F.count_if(ok & (F.col("n_junctions") >= 1) & broken).alias("broken"),
        F.sum(F.when(ok, size("places") + size("invented_terms")).otherwise(0)).alias("entities"),
        F.sum(F.when(ok, size("entities_unfound")).otherwise(0)).alias("unfound"),
        F.count_if(F.col("control")).alias("controls"),
        F.count_if(F.col("control") & (broken | F.coalesce(score <= 3, F.lit(False)))).alias("caught"),
        F.count_if(ok & (size("missing_schema_keys") > 0)).alias("with_missing_keys"),
    )
