"""The ten operators and the pipeline against brute force, on a table with every awkward kind of row."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import bpe, exact_dedup, langid, line_dedup, lm, near_dedup, packing, quality, suffix_dedup, topk_search
from loomspark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, k long, block string"


def corpus():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice(["ba", "ke", "li", "mo", "nu", "é", "ßo", "Ta"]) for _ in range(rnd.randrange(1, 4)))
    vocab = [word() for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage, near = prose(70), prose(120).split()
    texts = [None, "", " ", "\n", "a", "\t\x0b x \r\n", "A  b\nc", "A b c", "日本語 テキスト 😀 é", "it's <|endoftext|> ok", "x" * 50000, "Ha " * 3000, prose(9000)]
    texts += [prose(n) for n in (3, 5, 40, 200)]
    texts += ["intro " + passage + " " + prose(30), prose(20) + " " + passage, passage + prose(3)]
    texts += ["Same\tcopy here of text", "Same copy here of text"] * 2 + [prose(60)] * 3
    for i in range(5):
        w = list(near)
        w[i * 20] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [f"  Common LINE \n{prose(12)}\n\nCOMMON line" for _ in range(12)]
    rows = [(i, t, None if i % 9 == 0 else rnd.choice(["xx", "yy"]), "s", None, "clash", 1, 2, "b") for i, t in enumerate(texts)]
    return rows + [rows[20], rows[20], (7, "A b c", "xx", "s", 3, "clash", 1, 2, "b")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_bpe(rows, docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = []
    for d, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tok.decode(ids, skip_special_tokens=False).encode())))
    assert pairs(bpe.round_trip(docs, tokenizer_path()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe.round_trip(none, tokenizer_path()).count() == 0


def test_word_encoder_on_odd_words():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(tokenizer_path()), bpe.encoder(tokenizer_path())
    words = ["", "É", "Straße,", "ﬁ", "İ", "ΑΣ", "don't", "a_b", "...", "x1y2", "<|endoftext|>a", "ö", "ö", "a b", "‘q’", "ÿ!?", "-a", "(b)."]
    ids, n = enc.encode(words)
    assert np.split(ids, np.cumsum(n)[:-1])[0].tolist() == []
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [tok.encode(w, add_special_tokens=False).ids for w in words]


def test_exact(rows, docs, none):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(norm(t), []).append(d)
    want = [(d, min(groups[norm(t)]), len(groups[norm(t)]), d == min(groups[norm(t)]), sha(norm(t).encode())) for d, t, *_ in rows]
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert pairs(exact_dedup.groups(docs), *cols) == sorted(want, key=repr)
    assert exact_dedup.groups(none).count() == 0


def test_golomb():
    rng = np.random.default_rng(1)
    for n, top in ((1, 5), (1, 2**63), (300, 1000), (1000, 2**62)):
        v = np.unique(rng.integers(0, top, n, np.uint64))
        assert (exact_dedup.golomb_decode(exact_dedup.golomb(v)) == v).all()


def lines_want(rows, least=10):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    df = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for d, t, *_ in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if df[key(x)] < least]
        out.append((d, len(ls), len(ls) - len(kept), sha("\n".join(kept).encode())))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 4])
def test_lines(rows, docs, none, batches):
    got = line_dedup.drop_lines(docs, batches=batches)
    assert pairs(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == lines_want(rows)
    assert got.where("n_dropped > 0").count() == 12
    assert line_dedup.drop_lines(none).count() == 0


def test_lines_of_a_repeated_id(spark):
    rows = [(7, f"same\nline {i}") for i in range(10)] + [(8, "same\nsame")] * 2
    got = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert pairs(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == lines_want(rows) and got.where("n_dropped > 0").count() == 12


def test_line_runs(spark):
    """Settled hashes leave later batches; the index holds each other hash's count; runs are sorted and compacted by levels."""
    from loomspark.llm import _blocks as B

    rnd, index, want = random.Random(2), line_dedup.LineRuns(1, min_docs=6), Counter()
    for _ in range(5):
        batch = np.sort(np.array([rnd.randrange(30) for _ in range(40)], np.uint64))
        want.update(int(h) for h in batch)
        blob = B.pack(batch, batch // np.uint64(7), np.ones(40, np.int64), np.zeros(40, np.uint8))
        index.add(spark.createDataFrame([(0, bytearray(blob))], "k long, blob binary"))
    assert [len(level) for level in index.levels] == [1, 0, 1]
    runs = [B.unpack(bytes(r.blob)) for r in index.all().collect()]
    assert all((np.diff(hi.astype(np.int64)) > 0).all() for hi, *_ in runs)
    settled = {int(h) for hi, _, _, s in runs for h in hi[s > 0]}
    assert settled == {h for h, c in want.items() if c >= 6}
    rest = Counter()
    for hi, _, n, _ in runs:
        rest.update(dict(zip(map(int, hi), map(int, n))))
    assert all(rest[h] == c for h, c in want.items() if c < 6)
    assert sum(want[h] - rest[h] for h in settled) > 0  # what the anti-join kept out


@pytest.mark.parametrize("crowd", [4096, 1])
def test_suffixes(rows, docs, none, crowd):
    every = Counter(t.encode()[i : i + 200] for _, t, *_ in rows if t for i in range(len(t.encode()) - 199))
    want = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if every[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        want.append((d, len(b), sum(gone), bytes(b"\0" + gone).count(b"\0\1"), sha(bytes(c for c, g in zip(b, gone) if not g))))
    got = suffix_dedup.cut_repeats(docs, crowd=crowd)
    assert pairs(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    assert suffix_dedup.cut_repeats(none).count() == 0


def test_suffix_array():
    rnd = random.Random(4)
    for t in [b"a", b"\0\0", b"banana\0", b"ab" * 60, b"a" * 150, *(bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 180))) for _ in range(30))]:
        a = np.frombuffer(t, np.uint8)
        got = suffix_dedup.suffix_array(a, suffix_dedup._words8(a))
        pad = lambda i: t[i:].ljust(200, b"\0")
        assert sorted(got.tolist()) == list(range(len(t))) and all(pad(i) <= pad(j) for i, j in zip(got[:-1].tolist(), got[1:].tolist()))


def near_want(rows, threshold=0.8):
    import string

    table = str.maketrans(string.punctuation, " " * len(string.punctuation))
    sets = []
    for d, t, *_ in rows:
        w = re.split("[\x20\x09-\x0d]+", (t or "").lower().translate(table))
        w = [x for x in w if x]
        sets.append((d, Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()))
    df = Counter(k for _, s in sets for k in s)
    idf = {k: 1 + math.log((len(rows) + 1) / v) / math.log(len(rows) + 1) for k, v in df.items()}
    w = [{k: (1 + math.log(c)) * idf[k] for k, c in s.items()} for _, s in sets]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for j, (b, t) in enumerate(sets[:i]):
            both, n = sum(min(w[i][k], w[j][k]) for k in s if k in t), len(s.keys() & t.keys())
            if n and (both >= threshold * (sum(w[i].values()) + sum(w[j].values()) - both) or n >= threshold * len(s.keys() | t.keys())):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return sorted(((d, root(d), d == root(d)) for d, *_ in rows), key=repr)


@pytest.mark.parametrize("small", [256, 2])
def test_near(rows, docs, none, small):
    assert pairs(near_dedup.classes(docs, small=small), "doc_id", "class_id", "kept") == near_want(rows)
    assert near_dedup.classes(none).count() == 0


def test_sampling_estimates_weighted_jaccard():
    rng, s = np.random.default_rng(0), near_dedup.Sampler(2000)
    u = np.unique(rng.integers(0, 2**48, 60, np.uint64))
    a, b = rng.uniform(0.5, 8, len(u)), rng.uniform(0.5, 8, len(u))
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s.draws(u, a) == s.draws(u, b)).mean() - want) < 0.04


def test_packing(rows, docs, none):
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(tokenizer_path()), []
    for d, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(d, k, s, min(512, len(ids) - s), zlib.crc32(ids[s : s + 512].tobytes())) for k, s in enumerate(range(0, len(ids), 512))]
    got = packing.packed(docs, tokenizer_path(), capacity=512).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 512
    assert len(seqs) <= math.ceil(sum(r.length for r in got) / 512) + 2
    assert packing.packed(none, tokenizer_path()).count() == 0


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(3)
    for n in (1, 7, 400):
        lengths, counts = np.unique(rng.integers(1, 101, n), return_counts=True)
        got = Counter()
        for seq, k in packing.plan(lengths, counts, 100):
            assert sum(seq) <= 100 and k > 0
            for v in seq:
                got[v] += k
        assert got == dict(zip(lengths.tolist(), counts.tolist()))


def test_lm(rows, docs, none):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    toks = [(d, [*(w for w in re.split("[\x20\x09-\x0d]+", (t or "").translate(low)) if w), None]) for d, t, *_ in rows]
    c = Counter(w for d, ws in toks if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((d, held(d), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in toks), key=lambda x: (x[0], x[2], x[5]))
    got = sorted((tuple(r) for r in lm.score(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=lambda x: (x[0], x[2], x[5]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert all(g[6] < 0 and math.isfinite(g[6]) for g in got)
    assert lm.score(none).count() == 0


def test_lm_is_a_distribution():
    rng, m = np.random.default_rng(5), lm.fresh_model()
    for k in ("w1", "w2", "b1", "b2"):
        m[k] += rng.normal(0, 1, m[k].shape).astype(np.float32)
    h = np.full(1025, 12345 << 40, np.uint64)
    cells = np.append(np.arange(1024), 0)
    start = np.array([0])
    p = 10 ** lm.class_scores(m, h, cells, start)  # from the fourth token on all histories are equal
    order = np.roll(np.arange(1024), 4)
    q = 10 ** lm.class_scores(m, h[:1024], order, start)
    one = np.where(np.arange(1024) >= 4, p[:1024], 0).sum() + q[np.isin(order, np.arange(4)) & (np.arange(1024) >= 4)].sum()
    assert one + (4 - (np.isin(order, np.arange(4)) & (np.arange(1024) >= 4)).sum()) * 1e-9 <= 1.01 and one > 0.9


def test_lm_beats_its_base(spark, sf_dir):
    r = lm.score(spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_quality(spark, docs, none, sf_dir):
    d = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    labels = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/labels.parquet")
    m = quality.train(d, labels)
    got = quality.score(d, m).join(labels, "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.93
    s = quality.score(docs, m)
    assert s.count() == docs.count() and s.where("score between 0 and 1").count() == docs.count()
    assert quality.keep(docs, m).columns == docs.columns and quality.keep(docs, m).count() == s.where("predicted = 1").count()
    assert quality.score(none, m).count() == 0
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    dirty = spark.createDataFrame([(14, None), (14, 1), (14, 1), (15, 1), (None, 0)], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.train(docs, dirty)).collect()} <= {0.5, 1.0}


def test_dual_coordinate_descent():
    rng = np.random.default_rng(2)
    x = [np.unique(rng.integers(0, 40, 8)).astype(np.int32) for _ in range(80)]
    y = np.array([1.0 if (u < 20).mean() > 0.5 else -1.0 for u in x])
    w = quality.descend(x, y, np.ones(40), np.full(80, 5.0), epochs=500)
    unit = [1 / math.sqrt(len(u)) for u in x]
    value = lambda w: w @ w / 2 + 5 * sum(max(0, 1 - t * w[u].sum() * s) for u, t, s in zip(x, y, unit))
    best = value(w)
    assert all(value(w + rng.normal(0, e, 40)) >= best - 1e-3 for e in (0.3, 0.05, 0.01) for _ in range(30))


def test_language(spark, docs, none, sf_dir):
    d = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    m = langid.train(d)
    got = langid.predict(d, m).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95
    p = langid.predict(docs, m)
    assert p.count() == docs.count() and p.where("score between 0 and 1").count() == docs.count()
    und = {r.doc_id for r in p.where("lang_pred = 'und'").collect()}
    assert und == {0, 1, 2, 3}
    assert langid.train(none) is None and langid.predict(none, m).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_convolution_gradients():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.integers(1, 60, (40, langid.WINDOW)), rng.integers(60, 120, (40, langid.WINDOW))]).astype(np.uint16)
    y = np.repeat([0, 1], 40)
    m = langid.fit(x, y, 2, epochs=60)
    assert (langid.forward(x, m)[0].argmax(axis=1) == y).all()


@pytest.mark.parametrize("rows_,packs", [(16384, 512), (7, 2)])
def test_search(spark, rows_, packs):
    rnd = random.Random(8)
    vec = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(120)] + [(300 + i, [0.5] * 6) for i in range(30)]
    bad = [(500, None), (501, [1.0, None] * 3), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (550, [1.0, 2.0]), (551, [2.0, 1.0]), (None, [1.0] * 6), (650, [])]
    df = spark.createDataFrame([(i, e, 1) for i, e in vec + bad], "vec_id long, embedding array<double>, label int")
    got = pairs(topk_search.top_k(df, block_rows=rows_, query_rows=packs), "query_id", "rank", "vec_id", "score")
    q = {i: [math.floor(256 * x) for x in e] for i, e in vec}
    want = [(550, 1, 551, 512 * 256 * 2)]
    for i in q:
        if i % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i))[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want, key=repr)
    assert topk_search.top_k(df.limit(0)).count() == 0


def test_search_of_large_numbers():
    lists = topk_search.Lists(np.array([[2**40, 1], [2**40, 0], [-(2**40), 5]], np.int64), np.arange(3))
    (r, s, _), = topk_search.nra(lists, np.array([[2**20, 1]]), np.array([9]), 2)
    assert r.tolist() == [0, 1] and s.tolist() == [2**60 + 1, 2**60]


@pytest.mark.parametrize("decay,scale", [(1.0, 256), (0.8, 256), (0.9, 2**22)])
def test_search_stops_early(decay, scale):
    """Bounds keep the exact answer, ties included, and most queries stop before the lists end."""
    rng = np.random.default_rng(4)
    x = np.floor(scale * rng.normal(0, 1, (1500, 24)) * decay ** np.arange(24) / 5).astype(np.int64)
    x[100:140] = x[7]
    lists, early = topk_search.Lists(x, rng.permutation(1500)), []
    ids = lists.ids
    at = np.arange(0, 1500, 50)
    for i, (rows, score, read) in zip(at, topk_search.nra(lists, x[at], ids[at], 5, few=16)):
        dense = x @ x[i]
        want = sorted((j for j in range(1500) if j != i), key=lambda j: (-dense[j], ids[j]))[:5]
        assert rows.tolist() == want and score.tolist() == dense[want].tolist()
        early.append(read < 0.95)
    assert np.mean(early) > 0.9


def test_search_ignores_other_columns(spark):
    rows = [(i, [float(i % 7), 1.0], i, 0.5, i, 1) for i in range(0, 200, 10)] + [(50, [1.0, 1.0], 0, 0.0, 0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score double, query_id int, dim int")
    got = pairs(topk_search.top_k(df), "query_id", "rank", "vec_id", "score")
    assert {r[0] for r in got} == {0, 50, 100, 150} and all(r[0] != r[2] for r in got)


def test_pipeline(spark, rows, docs, none, tmp_path):
    import corpus_pipeline as P

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    sf = str(tmp_path)
    one = spark.read.parquet(sf + "/documents.parquet")
    assert P.keep_quality(spark, one, sf).count() == 0  # without labels the score is 0.5 < 0.7
    two = P.drop_copies(spark, one, sf)
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    least = {}
    for d, t, *_ in rows:
        least[norm(t)] = min(d, least.get(norm(t), d))
    assert two.columns == one.columns and sorted(r.doc_id for r in two.collect()) == sorted(least.values())
    three = P.drop_near_copies(spark, two, sf)
    assert sorted(r.doc_id for r in three.collect()) == sorted(d for d, _, k in near_want([tuple(r) for r in two.collect()]) if k)
    four = P.cut_passages(spark, three, sf)
    cut = {r.doc_id: r.kept for r in suffix_dedup.cut_repeats(three).collect()}
    assert four.columns == one.columns and {r.doc_id: r.text for r in four.collect()} == {d: bytes(k).decode("utf-8", "ignore") for d, k in cut.items()}
    assert all(r.n_chars == len(r.text) and r.score == "clash" for r in four.collect())
    assert {r.doc_id for r in P.pack(spark, four, sf).collect()} == {r.doc_id for r in four.collect()}
    for _, stage in P.STAGES:
        assert stage(spark, none, sf).count() == 0
