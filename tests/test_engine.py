"""Operators against short sequential models."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomspark.config import Curation, load
from loomspark.functions import scoring
from loomspark.operators import dedup, profile, scenes, select, split, tagging, trainset
from loomspark.plans import curate

CFG = Curation()


def test_length_score(spark):
    tok = [0, 1, 200, 800, 1400, 1600, 1800, 1801]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in tok], "t int").select(scoring.length_score(F.col("t"), 1400, 200, 1800)).collect()]
    assert got == pytest.approx([0, 0, 0, 0.5, 1, 0.5, 0, 0.3])


def test_metrics_fixture(spark):
    text = '"Stay here," she said. He left.\n\n— Why?\n\n' + "word " * 350
    row = scoring.with_score(scoring.with_metrics(spark.createDataFrame([(text,), ("",)], "text string"), "text", ["stay", "left"], CFG), CFG).collect()
    m = row[0]
    assert (m.paragraph_count, m.keyword_hits, m.malformed_paragraphs) == (3, 2, 1)
    assert m.dialogue_ratio == pytest.approx((len('"Stay here,"') + len("— Why?")) / m.char_count, abs=1e-4)
    assert row[1].char_count == 0 and row[1].word_count == 0 and 0 <= row[1].score <= 1


def model_near(rows, sim, shares):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[1], r[0])):
        if not any(shares(r[0], k[0]) and sim(r[0], k[0]) >= CFG.near_dup_threshold for k in kept):
            kept.append(r)
    return {r[0] for r in kept}


@pytest.mark.parametrize("last", [0, 20, 10000])
def test_near_is_greedy(spark, last):
    rnd = random.Random(5)
    base = [[f"w{rnd.randrange(500)}" for _ in range(80)] for _ in range(6)]
    rows = []
    for i in range(60):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 3])):
            w[rnd.randrange(len(w))] = f"x{i}"
        rows.append((i, rnd.choice([0.2, 0.5, 0.9]), " ".join(w)))
    rows += [(100, 0.5, ""), (101, 0.7, "!"), (102, 0.1, "a b")]
    df = dedup.with_signature(spark.createDataFrame(rows, "id long, score double, text string"))
    sig = {r.id: r.signature for r in df.collect()}
    sim = lambda a, b: sum(x == y for x, y in zip(sig[a], sig[b])) / 64
    band = {k: {tuple(s[i : i + 4]) for i in range(0, 64, 4)} for k, s in sig.items()}
    got = {r.id for r in dedup.near(df, last=last).collect()}
    assert got == model_near(rows, sim, lambda a, b: bool(band[a] & band[b]))
    assert (100 in got) + (101 in got) == 1


def model_mmr(rows, sig, lam, k):
    sim = lambda a, b: sum(x == y for x, y in zip(sig[a], sig[b])) / 64
    pool = sorted(rows, key=lambda r: (-r[1], r[0]))
    picks = [pool.pop(0)[0]]
    while pool and len(picks) < k:
        v = [lam * r[1] - (1 - lam) * max(sim(r[0], p) for p in picks) for r in pool]
        picks.append(pool.pop(v.index(max(v)))[0])
    return picks


@pytest.mark.parametrize("lam,k,batch", [(0.5, 8, 4), (0.0, 5, 64), (1.0, 5, 2), (0.5, 100, 16)])
def test_mmr(spark, lam, k, batch):
    rnd = random.Random(9)
    rows = [(i, rnd.choice([0.3, 0.6, 0.9]), " ".join(rnd.choice("abcdefgh") for _ in range(12))) for i in range(40)]
    df = dedup.with_signature(spark.createDataFrame(rows, "id long, score double, text string"))
    sig = {r.id: r.signature for r in df.collect()}
    got = [r.id for r in select.mmr(df, cfg=CFG.updated(max_examples=k, diversity_lambda=lam), batch=batch).orderBy("pick").collect()]
    assert got == model_mmr(rows, sig, lam, k)


def est(t):
    return max(1, int(len(t) / 4)) if t else 0


def model_split(text, cfg):
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()
    if est(text) <= cfg.max_tokens:
        return [text]
    pats = list(split.BOUNDARIES.values())

    def ends(t):
        return [x.strip() for x in re.split(r"(?<=[.!?…])(?=\s)", t) if x.strip()]

    def cut(p):
        if est(p) <= cfg.max_tokens:
            return [p]
        for f in [*(lambda t, r=r: [x for x in re.split(r, t) if x and x.strip()] for r in pats), ends, lambda t: [x for x in re.split(r"(?<=,)\s+", t) if x.strip()]]:
            parts = f(p)
            if len(parts) > 1:
                return [a for x in parts for a in cut(x)]
        n = cfg.max_tokens * 4
        return [p[i : i + n] for i in range(0, len(p), n)]

    out, cur, tok = [], "", 0
    for a in cut(text):
        if cur and (tok + est(a) > cfg.max_tokens or tok >= cfg.target_tokens):
            out.append(cur.strip())
            cur, tok = "", 0
        cur, tok = (cur + "\n\n" + a if cur else a), tok + est(a)
    return [c for c in [*out, cur.strip()] if c.strip()]


def test_split(spark):
    cfg, rnd = CFG.updated(target_tokens=14, max_tokens=18, min_tokens=2), random.Random(3)
    parts = ["Chapter 1", "глава два", "***", "---", "\n\n", "\n", "— Hi.", '"So," he said.', "Some words here. More words there, and there, and on", "x" * 100, " ", "word"]
    texts = ["", "short", "y" * 400, "a, " * 60, *("".join(rnd.choice(parts) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randrange(1, 25))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in split.smart_split(df, "text", cfg).orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append(r.text)
    for i, t in enumerate(texts):
        want = model_split(t, cfg)
        assert got.get(i, []) == want, (i, t)


@pytest.mark.parametrize("n", [0, 1, 49, 50, 101])
def test_split_sizes(spark, n):
    df = spark.createDataFrame([(i,) for i in range(n)], "id int")
    got = select.train_val(df, ["id"], CFG)
    assert got.count() == n and got.where("split = 'val'").count() == (max(1, int(n * 0.02)) if n else 0)


def test_nth_least_recurses(spark):
    keys = [f"{i * 2654435761 % 2**32:08x}" for i in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for n in (1, 7, 1500, 3000):
        assert select.nth_least(df, "k", n, step=1, fetch=20) == sorted(keys)[n - 1]
    assert select.nth_least(df, "k", 3001) is None


def test_scenes(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None), (2, 1, ""), (3, 1, " "), (None, 1, "z")], "scene_id int, pos int, text string")
    assert sorted(map(tuple, scenes.assembled(df).collect())) == [("1", "a\n\nb"), ("3", " ")]
    assert scenes.count(df).first()[0] == 3 and scenes.count(df, "row").first()[0] == 5
    assert {r.scene_id for r in profile.profiles(df, None).collect()} == {"1"}


def test_ranked_values(spark):
    df = spark.createDataFrame([("a", v) for v in [5, 1, 9, 1]] + [("b", 4)], "g string, v int")
    got = {r.g: (r.lo, r.p) for r in profile.ranked_values(df, "v", {"lo": F.floor((F.col("n") - 1) / F.lit(2.0)), "p": F.least(F.col("n") - 1, F.floor(F.lit(0.9) * F.col("n")))}, ["g"]).collect()}
    assert got == {"a": (1, 9), "b": (4, 4)}
    assert profile.length_stats(spark.createDataFrame([], "length int")).count() == 0


def test_tagging(spark):
    vocab = {"tone": ["dark night", "warm"], "setting": []}
    df = spark.createDataFrame([("1", ["Warm ", "warm", None, "x", " DARK night"])], "scene_id string, l array<string>")
    assert df.select(tagging.whitelisted(F.col("l"), vocab["tone"])).first()[0] == ["Warm ", " DARK night"]
    allowed, schema = tagging.classifier_prompt(vocab)
    assert allowed == "- tone: dark night, warm" and schema["required"] == ["tone", "overflow"]
    recs = spark.createDataFrame([("1", True, {"tone": ["Warm_Day", "b"]}, ["Odd"], 1), ("1", None, {"tone": ["b c"]}, [], 2), ("2", False, None, None, 3), (None, True, {"tone": ["q"]}, [], 4)], "scene_id string, parse_ok boolean, facets map<string,array<string>>, overflow array<string>, n int")
    last = tagging.last_tags(recs, "n")
    assert [(r.scene_id, r.facets) for r in last.collect()] == [("1", {"tone": ["b c"]})]
    assert [(r.label, r.n) for r in tagging.vocabulary(recs.where("parse_ok is null or parse_ok").where("scene_id is not null")).orderBy("label").collect()] == [("b_c", 1), ("warm_day", 1)]
    got = recs.limit(1).select(tagging.prompt(F.col("facets"), F.col("overflow"))).first()[0]
    assert got == "Write a scene with the following elements.\nTone: Warm Day, b\nOther: Odd"
    m = spark.createDataFrame([("1", 0, "train", "t"), ("9", 0, "val", "u"), ("1", 1, "other", "v")], "scene_id string, chunk_index int, split string, text string")
    assert {(r.scene_id, r.prompt) for r in tagging.tagged_corpus(m, last).collect()} == {("1", "Write a scene with the following elements.\nTone: b c"), ("9", "Write a scene.")}


def test_tagger_retries(spark):
    def once(texts):
        return ['{"tone": ["x"]}' if "ONLY" in t or t == "ok" else "sorry" for t in texts]

    df = spark.createDataFrame([("ok",), ("bad",)], "text string")
    assert {r.reply for r in tagging.tagged(df, once).collect()} == {'{"tone": ["x"]}'}
    assert {r.reply for r in tagging.tagged(df, once, retry=False).collect()} == {'{"tone": ["x"]}', None}


def test_pilot_summary_and_controls(spark):
    schema = "parse_ok boolean, control boolean, coherence_score int, n_junctions int, broken_junctions array<int>, places array<string>, invented_terms array<string>, entities_unfound array<string>, missing_schema_keys array<string>"
    rows = [(True, False, 5, 1, [1], ["a"], ["b"], ["b"], []), (True, False, None, 0, None, None, None, None, ["pov"]), (False, False, None, 0, None, None, None, None, None), (True, True, 3, 1, [], None, None, None, None), (True, True, 5, 1, [], None, None, None, None)]
    r = tagging.pilot_summary(spark.createDataFrame(rows, schema)).first()
    assert (r.parsed, r.score_5, r.score_other, r.with_seams, r.broken, r.entities, r.unfound, r.controls, r.caught, r.with_missing_keys) == (2, 1, 1, 1, 1, 2, 1, 2, 1, 1)
    texts = spark.createDataFrame([(str(i), "t" * 40) for i in range(7)], "scene_id string, text string")
    got = tagging.controls(texts, 2, max_tokens=8).collect()
    assert len(got) == 2 and all(x.text == "t" * 16 + "\n\n⟦J1⟦\n\n" + "t" * 16 for x in got)


def test_trainset(spark):
    d = spark.createDataFrame([("Ask", "more", "Answer"), ("Ask", " ", "Yes"), ("", "", "x"), ("q", None, None)], "instruction string, input string, output string")
    got = trainset.extracted(d)
    assert [tuple(r)[-2:] for r in got.collect()] == [("Ask\n\nmore", "Answer"), ("Ask", "Yes")]
    rows = trainset.tokenized(got, trainset.word_encoder, 2)
    r = rows.first()
    assert r.input_ids[-1] == 2 and r.labels[-2:] == r.input_ids[-2:] and set(r.labels[:-2]) == {-100}
    assert trainset.fitted(rows, 3).count() == 0
    cut = trainset.fitted(rows, 3, "truncate").first()
    assert cut.truncated and cut.length == 3 == len(cut.labels)
    p = trainset.padded(rows.withColumn("b", F.lit(1)), "b", 0).collect()
    assert {len(x.input_ids) for x in p} == {8} and all(sum(x.attention_mask) + x.labels.count(-100) >= 8 for x in p)
    with pytest.raises(ValueError):
        trainset.detect_format(d.select(F.lit(1).alias("z")))


def test_config(tmp_path):
    (tmp_path / "base.json").write_text('{"max_tokens": 1700, "weights": {"keyword": 0.5}}')
    (tmp_path / "own.json").write_text('{"extends": "base.json", "min_tokens": 100}')
    c = load(str(tmp_path / "own.json"))
    assert (c.max_tokens, c.min_tokens, c.weights["keyword"], c.weights["length"]) == (1700, 100, 0.5, 0.25)
    with pytest.raises(KeyError):
        c.updated(nonsense=1)
    with pytest.raises(KeyError):
        c.updated(weights={"nonsense": 1})


def test_flagship(spark):
    body = lambda i: " ".join(f"w{i}x{j % 97}" for j in range(400)) + ". magic sword"
    df = spark.createDataFrame([("1", body(1)), ("2", body(1)), ("3", body(2)), ("4", "short magic sword"), ("5", body(3).replace("magic", "plain"))], "scene_id string, text string")
    got = curate.curate(df, ["magic", "sword"], CFG).collect()
    assert sorted(r.scene_id for r in got) == ["1", "3"] and [r.split for r in got].count("val") == 1
