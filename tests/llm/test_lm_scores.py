"""The language model's scores against plain Python, token by token, from the fitted weights and exact counts."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomspark.llm import lm
from loomspark.llm._words import hash64


def softmax(rows, bias):
    s = [bias[k] + sum(float(r[k]) for r in rows) for k in range(lm.CLASSES)]
    z = sum(math.exp(x) for x in s)
    return [math.exp(x) / z for x in s]


def test_scores(spark):
    import zlib

    rnd = random.Random(1)
    vocab = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choice(vocab[: 5 + i]) for _ in range(rnd.randrange(0, 40)))) for i in range(40)] + [(50, None), (51, "NEW Words é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    m = lm.fitted(docs)
    toks = {d: [*(w for w in re.split("[\x20\x09-\x0d]+", (t or "").lower()) if w), ""] for d, t in rows}
    c = Counter(w for d, ws in toks.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    h = lambda w: hash64(pa.array([w], pa.string()))
    cell = {w: int(m["cells"].of(h(w))[0]) for ws in toks.values() for w in ws}
    n, kinds = defaultdict(int), defaultdict(int)
    for w, k in c.items():
        n[cell[w]] += k
        kinds[cell[w]] += 1
    w1, w2, b1, b2 = (m["weights"][k].astype(np.float64) for k in ("w1", "w2", "b1", "b2"))
    assert np.abs(w1).sum() > 0 and np.abs(w2).sum() > 0
    got = {r.doc_id: r.score for r in lm.score(docs, m).collect()}
    for d, ws in toks.items():
        total, past = 0.0, [0x9E3779B9] * 3
        for w in ws:
            one, two = lm._features(*(np.array([x], np.uint32) for x in past), np.array([cell[w] // lm.CLASSES]))
            p = softmax([w1[int(f[0])] for f in one], b1[0])[cell[w] // lm.CLASSES]
            q = softmax([w2[int(f[0])] for f in two], b2[cell[w] // lm.CLASSES])[cell[w] % lm.CLASSES]
            total += math.log10(p) + math.log10(q) + math.log10((c[w] + 1) / (n[cell[w]] + kinds[cell[w]] + 1))
            past = [int(h(w)[0]) >> 32, *past[:2]]
        assert got[d] == pytest.approx(total, rel=1e-4), d
