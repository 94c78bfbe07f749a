"""The quality classifier's counts, ratios and scores against plain Python, and its hinge loss."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from loomspark.llm import quality as Q


def plain_features(t):
    words, last, gaps = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w], {}, []
    for i, w in enumerate(words):
        gaps.append(min(7, 1 + int(math.log2(i - last[w]))) if w in last else 0)
        last[w] = i
    b = t.encode()
    out = {0} | {1 + 8 * x + y for x, y in zip(gaps, gaps[1:])} | {65 + ((x * 8 + y) * 8 + z) * 8 + v for x, y, z, v in zip(gaps, gaps[1:], gaps[2:], gaps[3:])}
    room = Q.SIZE - Q._PAIRS - Q._EXTRA
    out |= {Q._EXTRA + 256 * x + y for x, y in zip(b, b[1:])}
    return sorted(out | {Q._EXTRA + Q._PAIRS + (((x << 16 | y << 8 | z) * 2654435761 & 0xFFFFFFFF) >> 8) % room for x, y, z in zip(b, b[1:], b[2:])})


TEXTS = ["", "a", " a a a b ", "the cat the dog\nthe\tthe", "é ß é", "x " * 40, "one two three four one"]


def test_features():
    assert [u.tolist() for u in Q.features(pa.array(TEXTS))] == [plain_features(t) for t in TEXTS]


def test_counts_ratios_and_scores(spark):
    rnd, rows, labels = random.Random(3), [], []
    for i in range(120):
        good = i % 3 > 0
        rows.append((i, " ".join(rnd.choice(["ba", "ke", "li", "mo"]) if good else rnd.choice(["zz", "zz!", "ba"]) for _ in range(rnd.randrange(3, 30)))))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    m = Q.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    n, size = [Counter(), Counter()], [0, 0]
    for (i, t), (_, y) in zip(rows, labels):
        if zlib.crc32(str(i).encode()) % 4 != 2:
            n[y].update(plain_features(t))
            size[y] += 1
    total = [sum(c.values()) + Q.SIZE for c in n]
    ratio = lambda f: 1.0 if f == 0 else math.log((n[1][f] + 1) / total[1] / ((n[0][f] + 1) / total[0]))
    some = sorted({f for c in n for f in c})
    assert np.allclose(np.sqrt(m["sq"][some]), [abs(ratio(f)) for f in some], rtol=1e-5)
    got = {r.doc_id: r for r in Q.score(docs, m).collect()}
    for i, t in rows:
        u = plain_features(t)
        margin = sum(float(m["v"][f]) for f in u) / math.sqrt(sum(float(m["sq"][f]) for f in u))
        p = 1 / (1 + math.exp(-(m["a"] * margin + m["b"])))
        assert abs(got[i].score - p) < 1e-5 and got[i].predicted == int(got[i].score >= 0.7) and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert sum(got[i].predicted == y for i, y in labels) > 110


def test_hinge_ends_at_its_bounds():
    """Where the classes can't be parted, the dual variables rest at the cost: linear, not squared, loss."""
    x = [np.array([0], np.int32)] * 4
    w = Q.descend(x, np.array([1.0, 1.0, 1.0, -1.0]), np.ones(1), np.full(4, 0.1), epochs=100)
    assert abs(w[0] - 0.2) < 1e-9


def test_marked_keeps_every_listed_id(spark, monkeypatch):
    """All rows of listed ids pass, repeated ones as often as they are there; others pass only where they share a slot."""
    ids = [(i,) for i in range(-500, 4000, 3)] + [(1 << 62,), (7,), (7,)]
    rows = spark.createDataFrame([(i, "x") for i in [*range(-500, 4000), 1 << 62, 7]] + [(None, "n")], "doc_id long, text string")
    listed = {i for i, in ids}
    for bits in (1 << 26, 1 << 15):
        monkeypatch.setattr(Q, "MARKS", bits)
        got = [r[0] for r in Q.marked(rows, spark.createDataFrame(ids, "doc_id long")).collect()]
        assert sorted(i for i in got if i in listed) == sorted([*listed, 7])
        assert len([i for i in got if i not in listed]) <= (5 if bits > 1 << 20 else 400)
    assert not Q.marked(rows, spark.createDataFrame([], "doc_id long")).collect()


def test_descend_keeps_no_copy_of_the_sample():
    import tracemalloc

    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(5000, 2000, replace=False)).astype(np.int32) for _ in range(300)]
    y = np.where(np.arange(300) % 2, 1.0, -1.0)
    tracemalloc.start()
    try:
        Q.descend(rows, y, rng.normal(size=5000), np.ones(300), epochs=2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < sum(r.nbytes for r in rows) / 2
