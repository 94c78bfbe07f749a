"""The byte network: a naive forward pass, and gradients against differences."""

import numpy as np

from loomspark.llm import langid as L


def model(rng, classes=3):
    f = L.FILTERS * len(L.WIDTHS)
    m = {"emb": rng.normal(0, 0.5, (257, L.DIM)), "conv": rng.normal(0, 0.2, (L._REACH * L.DIM, f)) * L._mask(), "bias": rng.normal(0, 0.1, f), "out": rng.normal(0, 0.3, (f, classes)), "out_bias": rng.normal(0, 0.1, classes)}
    m["emb"][0] = 0
    return {k: v.astype(np.float32) for k, v in m.items()}


def naive(text: bytes, m):
    """Class probabilities of one window by loops over positions and filters."""
    e = [m["emb"][b + 1] for b in text] + [np.zeros(L.DIM)] * (L.WINDOW + L._REACH - len(text))
    pooled = []
    for k in range(L.FILTERS * len(L.WIDTHS)):
        width = L.WIDTHS[k // L.FILTERS]
        w = m["conv"][:, k].reshape(L._REACH, L.DIM)
        pooled.append(max(0.0, m["bias"][k] + max(sum(float(w[j] @ e[i + j]) for j in range(width)) for i in range(L.WINDOW))))
    s = np.array(pooled) @ m["out"] + m["out_bias"]
    s = np.exp(s - s.max())
    return s / s.sum()


def test_forward():
    m, texts = model(np.random.default_rng(1)), [b"hello world", b"x", bytes(range(256))]
    got = L.forward(L.windows(texts)[0], m)[0]
    assert np.allclose(got, [naive(t, m) for t in texts], atol=1e-5)


def test_gradients():
    rng = np.random.default_rng(2)
    m = model(rng)
    x, y = rng.integers(1, 257, (5, L.WINDOW)).astype(np.uint16), np.array([0, 1, 2, 0, 1])
    x[3, 20:] = 0
    loss = lambda: float(-np.log(L.forward(x, m)[0][np.arange(5), y]).mean())
    g = L.gradients(x, y, m)
    for k in ("out", "out_bias", "bias", "conv", "emb"):
        flat, d = m[k].reshape(-1), g[k].reshape(-1)
        for i in np.argsort(-np.abs(d))[:6]:
            old, h = flat[i], 2e-3
            flat[i] = old + h
            up = loss()
            flat[i] = old - h
            diff = (up - loss()) / (2 * h)
            flat[i] = old
            assert abs(diff - d[i]) < 2e-3 + 0.05 * abs(d[i]), (k, i)
