"""Near duplicates that a leader or the weights alone would hide."""

import random
from collections import Counter

import numpy as np
import pytest

from loomspark.llm import _blocks as B
from loomspark.llm import near_dedup as N


def least_of(ids, links):
    """The least id of each component, by brute force."""
    label = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def in_one_bucket(spark, texts):
    """Rows of sampled() that all share one bucket, and the classes that all pairs give."""
    import pyarrow as pa

    sets = dict(zip(texts, N.shingles(pa.array(list(texts.values())))))
    df = Counter(k for u, _ in sets.values() for k in u.tolist())
    rows = []
    for i, (u, tf) in sets.items():
        f = np.array([df[k] for k in u.tolist()], np.uint32)
        rows.append((i, True, b"%d" % i, [7], B.pack(np.diff(u, prepend=np.uint64(0)), tf.astype(np.uint32), f)))
    w = {r[0]: N.weighed(r[4], len(rows)) for r in rows}
    links = [(a, b) for a in w for b in w if a < b and max(N.similarities(w[a], w[b])) >= 0.8]
    return spark.createDataFrame(rows, N._ROWS), len(rows), least_of(w, links), links


@pytest.mark.parametrize("small", [2, 5])
@pytest.mark.parametrize("seed", range(3))
def test_near_chains_in_one_large_bucket(spark, small, seed):
    # each text is linked to its neighbours in a chain alone, so A~B, A~L and not B~L for any leader L
    rnd, texts = random.Random(seed), {}
    ids = rnd.sample(range(1000), 36)
    for c in range(3):
        words = [f"w{c}x{k}" for k in range(500)]
        for k in range(12):
            texts[ids.pop()] = " ".join(words[k * 18 : k * 18 + 204])
    table, n, want, links = in_one_bucket(spark, texts)
    assert len(links) == 33 and len(set(want.values())) == 3
    got = {r.doc_id: r.class_id for r in N.grouped(table, n, small=small).collect()}
    assert got == want


def test_near_links_of_plain_sets(spark):
    # a text and its multiples: plain Jaccard near 1, weighted far under 0.8
    rnd, rows, want = random.Random(9), [], {}
    for s in range(24):
        text = " ".join(f"{rnd.randrange(10**6)}s{s}" for _ in range(200))
        for k, times in enumerate((1, 3, 10)):
            rows.append((3 * s + k, " ".join([text] * times)))
            want[3 * s + k] = 3 * s
    got = {r.doc_id: r.class_id for r in N.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_plain_draws_estimate_jaccard():
    rng, s = np.random.default_rng(0), N.Sampler(2000)
    u = np.unique(rng.integers(0, 2**48, 100, np.uint64))
    assert abs((s.plain_draws(u[:80]) == s.plain_draws(u[20:])).mean() - 0.6) < 0.04


def test_near_rounds_of_a_bucket_without_links(spark, monkeypatch):
    # nothing matches: the leaders multiply, so 400 members take a few rounds
    rnd, made, stored = random.Random(3), [], B.stored
    table, n, want, links = in_one_bucket(spark, {i: " ".join(f"{rnd.randrange(10**6)}x{i}" for _ in range(20)) for i in range(400)})
    monkeypatch.setattr(B, "stored", lambda df, *a: made.append(df.columns) or stored(df, *a))
    got = {r.doc_id: r.class_id for r in N.grouped(table, n, small=4).collect()}
    assert not links and got == want
    assert made.count(["lead", "rep", "w", "weighted", "plain"]) <= 6


def test_near_components_in_one_task_and_in_rounds(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(300) - 150, rnd.randrange(300) - 150) for _ in range(160)]
    want = least_of({i for p in pairs for i in p}, pairs)
    links = spark.createDataFrame(pairs, "a long, b long")
    for few in (0, 1000):
        assert {r.id: r.label for r in N.components(links, few).collect()} == want
    assert N.components(links.limit(0)).count() == 0


def test_near_small_bucket_leaves_out_what_is_joined():
    import pyarrow as pa

    u, one = np.arange(10, dtype=np.uint64), np.ones(10, np.uint32)
    f = B.pack(np.diff(u, prepend=np.uint64(0)), one, one)
    t = pa.table({"rep": [1, 2, 3], "part": [1, 1, 3], "features": [f, f, f]})
    assert N._linked(0.8, 3)(t).to_pylist() == [{"a": 1, "b": 3}]
