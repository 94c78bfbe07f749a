"""Queries of the engine over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.config import FACETS, Curation
from loomspark.functions import keywords as K
from loomspark.functions import scoring
from loomspark.functions import text as X
from loomspark.operators import dedup, profile, scenes, select, tagging, trainset
from loomspark.operators.split import smart_split
from loomspark.plans import curate
from loomspark.plans.store import spread, stored

#: Words of the test tables that stand in for a keyword list and a vocabulary.
KEYWORDS = ["thble", "thtion", "thing", "ering", "nicht"]
VOCAB = {"situation": ["thing", "thble"], "interactions": ["nicht", "thtion"], "appearance": ["ering", "des"], "actions": ["les", "von"], "setting": ["una", "der"], "tone": ["the", "and"], "dynamics": ["la", "to"]}
CFG = Curation()
WHOLE = CFG.updated(split_enabled=False)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def _profiles(spark, sf_dir) -> DataFrame:
    return profile.profiles(_turns(spark, sf_dir), KEYWORDS, 1, "conv_id", "turn")


def _tags(spark, sf_dir) -> DataFrame:
    d = _heavy(spark, sf_dir)
    return d.select(F.col("doc_id").cast("string").alias("scene_id"), X.words("text").alias("_w")).select("scene_id", X.once(tagging.lexical_tags(F.col("_w"), VOCAB)).alias("facets"))


def _heavy(spark, sf_dir) -> DataFrame:
    """Documents for steps that cost much per row."""
    return spread(_docs(spark, sf_dir).where("text is not null"))


def _scored(spark, sf_dir) -> DataFrame:
    return scoring.with_score(scoring.with_metrics(_heavy(spark, sf_dir), "text", KEYWORDS, CFG), CFG)


def scene_assembly(spark, sf_dir):
    return scenes.assembled(_turns(spark, sf_dir), "conv_id", "turn")


def row_scenes(spark, sf_dir):
    return scenes.rows(_docs(spark, sf_dir), "doc_id")


def scene_count(spark, sf_dir):
    return scenes.count(_turns(spark, sf_dir), "scene", "conv_id")


def segment_count_distribution(spark, sf_dir):
    return scenes.size_distribution(_turns(spark, sf_dir), "conv_id")


def candidate_scenes(spark, sf_dir):
    return scenes.candidate_ids(_turns(spark, sf_dir), least=3, most=6, scene="conv_id")


def seam_offsets(spark, sf_dir):
    s = scenes.with_seams(_turns(spark, sf_dir), "conv_id", "turn")
    return s.select("scene_id", F.posexplode("seam_offsets").alias("seam", "seam_offset"))


def clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.clean("text").alias("text"))


def token_estimate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.token_estimate(X.clean("text")).alias("tokens"))


def text_metrics(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", *scoring.METRICS)


def scene_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "score", *(f"c_{c}" for c in scoring.COMPONENTS))


def analysis_summary(spark, sf_dir):
    return profile.analysis_summary(_scored(spark, sf_dir))


def length_score(spark, sf_dir):
    tok = X.token_estimate(X.clean("text"))
    return _docs(spark, sf_dir).select("doc_id", scoring.length_score(tok, CFG.target_tokens, CFG.min_tokens, CFG.max_tokens).alias("length_score"))


def keyword_hits(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", X.clean("text").alias("t"))
    return d.select("doc_id", K.hits("t", K.pattern(KEYWORDS)).alias("hits"))


def keyword_filter(spark, sf_dir):
    return _docs(spark, sf_dir).where(K.hits("text", K.pattern(KEYWORDS)) >= CFG.min_keyword_hits).select("doc_id")


def length_gate(spark, sf_dir):
    return curate.examples(scenes.rows(_heavy(spark, sf_dir), "doc_id"), KEYWORDS, WHOLE, min_hits=0).select("scene_id", "estimated_tokens", "original_score", "score")


def split_chunks(spark, sf_dir):
    s = scenes.rows(_heavy(spark, sf_dir), "doc_id")
    return smart_split(s, "text", CFG).select("scene_id", "chunk_index", "text")


def exact_dedup(spark, sf_dir):
    return dedup.exact(_docs(spark, sf_dir), "doc_id").select("doc_id")


def _signed(spark, sf_dir):
    d = _scored(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "score")
    narrow = stored(dedup.with_signature(d, "text", CFG).select("id", "score", "signature", dedup.digest().alias("hash")))
    return stored(dedup.exact(narrow, hashed="hash").drop("hash"))


def near_dup_survivors(spark, sf_dir):
    return dedup.near(_signed(spark, sf_dir), cfg=CFG).select("id", "score")


def mmr_select(spark, sf_dir):
    return select.mmr(_signed(spark, sf_dir), cfg=CFG.updated(max_examples=100)).select("id", "score", "pick")


def train_val_split(spark, sf_dir):
    return select.train_val(_docs(spark, sf_dir).select("doc_id"), ["doc_id"], CFG)


def bucket_sample(spark, sf_dir):
    p = _profiles(spark, sf_dir).withColumn("bucket", profile.segment_bucket(F.col("n_segments")))
    return select.sample_each(p, "bucket", ["scene_id"], 5).select("bucket", "scene_id")


def profile_crosstab(spark, sf_dir):
    return profile.crosstab(_profiles(spark, sf_dir))


def segment_coverage(spark, sf_dir):
    return profile.coverage(_profiles(spark, sf_dir))


def token_histogram(spark, sf_dir):
    return profile.token_histogram(_profiles(spark, sf_dir))


def _split_docs(spark, sf_dir):
    return select.train_val(_docs(spark, sf_dir).where("text is not null"), ["doc_id"], CFG)


def corpus_stats(spark, sf_dir):
    return profile.corpus_stats(_split_docs(spark, sf_dir), KEYWORDS, CFG)


def corpus_ttr(spark, sf_dir):
    return profile.type_token_ratio(_docs(spark, sf_dir).where("text is not null"))


def length_histogram(spark, sf_dir):
    return profile.length_histogram(_docs(spark, sf_dir).where("text is not null"), CFG)


def length_percentiles(spark, sf_dir):
    d = _docs(spark, sf_dir).where("text is not null").select(X.token_estimate("text").alias("length"))
    return profile.length_stats(d)


def vocab_candidates(spark, sf_dir):
    return tagging.vocabulary(_tags(spark, sf_dir))


def label_topk(spark, sf_dir):
    return tagging.top_labels(tagging.vocabulary(_tags(spark, sf_dir)), 1)


def label_use(spark, sf_dir):
    return tagging.label_use(_tags(spark, sf_dir))


def facet_coverage(spark, sf_dir):
    return tagging.facet_coverage(_tags(spark, sf_dir))


def closed_tag_whitelist(spark, sf_dir):
    """The words of each text as a tagger's labels: those of the vocabulary stay, the first of equal ones as written."""
    return _heavy(spark, sf_dir).select("doc_id", F.concat_ws("|", tagging.whitelisted(F.split("text", " "), VOCAB["tone"])).alias("labels"))


def resume_todo(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("scene_id"))
    done = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("scene_id"))
    return tagging.todo(d, done)


def tagged_corpus(spark, sf_dir):
    m = _split_docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("scene_id"), F.lit(0).alias("chunk_index"), "split", "text")
    tags = _tags(spark, sf_dir).where(F.col("scene_id").cast("long") % 3 != 0)
    return tagging.tagged_corpus(m, tags).select("scene_id", "split", "prompt", F.md5(F.col("completion").cast("binary")).alias("completion_md5"))


def entity_grounding(spark, sf_dir):
    names = F.array(F.lit(" 'The'"), F.lit("Thble"), F.lit("nowhere"), F.lit('"'))
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.concat_ws("|", X.unfound(names, "text")).alias("unfound"))


def chat_examples(spark, sf_dir):
    t = _turns(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    chats = t.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))
    return trainset.extracted(chats).select("conv_id", F.md5(F.col("prompt_text").cast("binary")).alias("prompt_md5"), F.md5(F.col("target_text").cast("binary")).alias("target_md5"))


def mask_labels(spark, sf_dir):
    """The tables have no instructions: the first 40 characters of a text stand in for one, the whole text is the answer."""
    d = _heavy(spark, sf_dir).select("doc_id", F.substring("text", 1, 40).alias("instruction"), F.col("text").alias("output"))
    rows = trainset.tokenized(trainset.extracted(d), trainset.word_encoder, 2)
    return trainset.fitted(rows, 2048, "drop").select("doc_id", "length", F.size(F.filter("labels", lambda x: x == trainset.IGNORED)).alias("masked"))


def curate_whole(spark, sf_dir):
    """Examples of whole scenes without near-duplicate removal: the part of the flagship that SQL can express."""
    s = curate.examples(scenes.rows(_heavy(spark, sf_dir), "doc_id"), KEYWORDS, WHOLE, min_hits=1)
    # stored, since copies and the split take several passes: else each would measure all texts again
    narrow = stored(s.select(F.col("scene_id").cast("long").alias("id"), "scene_id", "estimated_tokens", "score", dedup.digest().alias("hash")))
    one = stored(dedup.exact(narrow, hashed="hash").select("scene_id", "estimated_tokens", "score"))
    return select.train_val(one, ["scene_id"], WHOLE)


def curate_corpus(spark, sf_dir):
    """The flagship: clean, filter, score, split, drop exact and near copies, and split into train and val."""
    return curate.curate(scenes.rows(_heavy(spark, sf_dir), "doc_id"), KEYWORDS, CFG, min_hits=1)


def fetch_segments(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("scene_id"))
    return scenes.fetched(_turns(spark, sf_dir), ids, "conv_id").select("conv_id", "turn")


def marked_scenes(spark, sf_dir):
    return scenes.with_seams(_turns(spark, sf_dir), "conv_id", "turn").select("scene_id", "marked")


def latest_tags(spark, sf_dir):
    """Turns as tag records of their conversation; those of a length that three divides did not parse."""
    r = _turns(spark, sf_dir).select(F.col("conv_id").alias("scene_id"), "turn", (F.length("text") % 3 != 0).alias("parse_ok"), F.create_map(F.lit("tone"), F.array("role")).alias("facets"), F.array("text").alias("overflow"))
    return tagging.last_tags(r, "turn").select("scene_id", F.col("facets")["tone"][0].alias("tone"), F.col("overflow")[0].alias("overflow"))


def _all(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slugs(spark, sf_dir):
    return _all(spark, sf_dir).select("doc_id", X.slug(F.concat_ws(" / ", F.lit("- Run"), "source", F.concat("lang", F.lit("!")))).alias("slug"))


def version_order(spark, sf_dir):
    v = F.concat_ws(".", F.col("doc_id") % 7, F.concat(F.col("doc_id") % 13, F.lit("rc"), F.col("doc_id") % 3), F.lit("x"), F.lit("9"))
    return _docs(spark, sf_dir).select("doc_id", F.concat_ws(",", F.transform(X.version_parts(v), lambda p: p.cast("string"))).alias("parts"))


def durations(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.duration(F.col("doc_id") * 37).alias("duration"))


def bucket_shares(spark, sf_dir):
    return profile.crosstab(_profiles(spark, sf_dir)).select("bucket", X.percent("n_pass", "n_all").alias("share"))


def pass_counts(spark, sf_dir):
    return profile.pass_counts(_profiles(spark, sf_dir))


def boundary_hits(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", K.hits("text", K.boundary_pattern(KEYWORDS)).alias("hits"))


def keyword_analysis(spark, sf_dir):
    d = _heavy(spark, sf_dir).select("doc_id", X.once(K.analysis("text", KEYWORDS, F.size(X.words("text")))).alias("a"))
    return d.select("doc_id", "a.hits", "a.density", "a.ratio", F.concat_ws("|", "a.matched").alias("matched"))


def given_scores(spark, sf_dir):
    """Examples whose score an analysis gives (here the labels); the others are scored."""
    given = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy(F.col("doc_id").cast("string").alias("scene_id")).agg(F.max("quality").cast("double").alias("score"))
    return curate.examples(scenes.rows(_heavy(spark, sf_dir), "doc_id"), KEYWORDS, WHOLE, scores=given, min_hits=0).select("scene_id", "original_score", "score")


def projected_cost(spark, sf_dir):
    seconds = spark.createDataFrame([(i, i / 4) for i in range(1, 7)], "bucket int, seconds double")
    return profile.projected_cost(_profiles(spark, sf_dir), seconds)


def top_scores(spark, sf_dir):
    """The 50 best documents: the cap of a corpus without diversity."""
    return select.top(_scored(spark, sf_dir).select("doc_id", "score"), 50, "doc_id")


def manifest_scenes(spark, sf_dir):
    manifest = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("scene_id"))
    return tagging.from_manifest(_docs(spark, sf_dir).select(F.col("doc_id").alias("scene_id")), manifest)


def missing_keys(spark, sf_dir):
    keys = F.array_compact(F.array(F.lit("genre"), F.when(F.col("doc_id") % 2 == 0, F.lit("tone")), F.when(F.col("doc_id") % 3 == 0, F.lit("places")), F.lit("other")))
    return _docs(spark, sf_dir).select("doc_id", F.concat_ws("|", tagging.missing_keys(keys)).alias("missing"))


def seeded_sample(spark, sf_dir):
    return select.sample(_docs(spark, sf_dir).select("doc_id"), ["doc_id"], 25)


def sample_rejects(spark, sf_dir):
    """Of a seeded shuffle read until 20 texts with a keyword are found: how many passed and how many did not."""
    return select.rejected_before(_heavy(spark, sf_dir), ["doc_id"], X.once(K.hits("text", K.pattern(KEYWORDS)) >= 1), 20)


def control_pairs(spark, sf_dir):
    texts = _docs(spark, sf_dir).where("text is not null").select(F.col("doc_id").alias("scene_id"), "text")
    return tagging.controls(texts, 10).select(F.col("pair").cast("long").alias("pair"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def pilot_summary(spark, sf_dir):
    """Documents as pilot records, their fields made from ids."""
    i = F.col("doc_id")
    some = lambda k, c: F.when(i % k == 0, F.array(F.lit(c)))
    r = _docs(spark, sf_dir).select((i % 5 != 0).alias("parse_ok"), (i % 7 == 0).alias("control"), F.when(i % 9 != 0, i % 8).cast("int").alias("coherence_score"), (i % 3).alias("n_junctions"), F.when(i % 11 == 0, F.array(F.lit(1))).alias("broken_junctions"), some(2, "a").alias("places"), some(3, "b").alias("invented_terms"), some(4, "c").alias("entities_unfound"), some(13, "tone").alias("missing_schema_keys"))
    return tagging.pilot_summary(r)


def overflow_use(spark, sf_dir):
    return tagging.overflow_use(_all(spark, sf_dir).select(F.array("lang", F.upper("source")).alias("overflow")))


def overflow_top(spark, sf_dir):
    return tagging.top_overall(overflow_use(spark, sf_dir), 15)


def label_top(spark, sf_dir):
    return tagging.top_overall(tagging.label_use(_tags(spark, sf_dir)), 20)


def manifest_label_use(spark, sf_dir):
    return tagging.manifest_label_use(_split_docs(spark, sf_dir).select(F.col("doc_id").alias("scene_id"), "split"), _tags(spark, sf_dir).where(F.col("scene_id").cast("long") % 3 != 0))


def scalar_facets(spark, sf_dir):
    """Documents as tag replies with a scalar, a list, a number and a null facet."""
    reply = F.to_json(F.struct("lang", F.array("source", "lang").alias("setting"), (F.col("doc_id") % 10).alias("score")))
    m = tagging.as_lists(reply)
    return _all(spark, sf_dir).select("doc_id", F.concat_ws("|", m["lang"]).alias("lang"), F.concat_ws("|", m["setting"]).alias("setting"), m["score"].isNull().alias("no_score"))


def _instructions(spark, sf_dir) -> DataFrame:
    d = _heavy(spark, sf_dir)
    return d.select("doc_id", F.when(F.col("doc_id") % 10 != 0, F.concat(F.lit("Write no. "), F.col("doc_id"))).alias("instruction"), F.when(F.col("doc_id") % 15 == 0, F.lit(" x ")).otherwise(F.col("text")).alias("output"))


def validation_counts(spark, sf_dir):
    return trainset.validation(trainset.judged(_instructions(spark, sf_dir), min_chars=5))


def _cut(spark, sf_dir) -> DataFrame:
    return trainset.fitted(trainset.tokenized(trainset.extracted(_instructions(spark, sf_dir)), trainset.word_encoder, 2), 256, "truncate")


def truncated_rows(spark, sf_dir):
    return _cut(spark, sf_dir).select("doc_id", "length", "truncated", F.size("labels").alias("n_labels"))


def padded_batches(spark, sf_dir):
    rows = trainset.padded(_cut(spark, sf_dir).withColumn("batch", F.col("doc_id") % 50), "batch", 0)
    return rows.select("doc_id", F.size("input_ids").alias("width"), F.size("labels").alias("n_labels"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("used"))


MORE = ("fetch_segments", "marked_scenes", "latest_tags", "slugs", "version_order", "durations", "bucket_shares", "pass_counts", "boundary_hits", "keyword_analysis", "given_scores", "projected_cost", "top_scores", "manifest_scenes", "missing_keys", "seeded_sample", "sample_rejects", "control_pairs", "pilot_summary", "overflow_use", "overflow_top", "label_top", "manifest_label_use", "scalar_facets", "validation_counts", "truncated_rows", "padded_batches")
NAMES = ("scene_assembly", "row_scenes", "scene_count", "segment_count_distribution", "candidate_scenes", "seam_offsets", "clean_text", "token_estimate", "text_metrics", "scene_score", "analysis_summary", "length_score", "keyword_hits", "keyword_filter", "length_gate", "split_chunks", "exact_dedup", "near_dup_survivors", "mmr_select", "train_val_split", "bucket_sample", "profile_crosstab", "segment_coverage", "token_histogram", "corpus_stats", "corpus_ttr", "length_histogram", "length_percentiles", "vocab_candidates", "label_topk", "label_use", "facet_coverage", "closed_tag_whitelist", "resume_todo", "tagged_corpus", "entity_grounding", "chat_examples", "mask_labels", "curate_whole", "curate_corpus")


def queries() -> dict:
    return {n: globals()[n] for n in NAMES + MORE}
