"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded; filters of several widths slide over fixed-length windows of a text; the largest
response of each filter feeds a softmax. All windows of a text are scored, and the text's language
is the one with the highest mean probability, weighted by window length.

The network is fitted on windows (``per_doc`` spread evenly over each text, and one of its first 4 to 63 bytes, so that
short texts are known too) of a bounded sample of labelled texts (``per_lang`` documents of
each language in expectation, chosen by hash, at most twice as many), of every language that has labelled rows. Null
texts and texts without a letter are ``und`` with score 1. Without any labelled text all others are
``und`` with score 0. Repeated rows are predicted each; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import _blocks as B

WINDOW, DIM, FILTERS, WIDTHS = 256, 8, 12, (2, 3, 4, 5)
_REACH = max(WIDTHS)
_ROWS = "doc_id long, held_out boolean, lang_pred string, score double"


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows of byte codes, text of each window, bytes in it). Code 0 is padding, so bytes count from 1."""
    n = np.array([len(t) for t in texts], np.int64)
    per = -(-n // WINDOW)
    owner = np.repeat(np.arange(len(texts)), per)
    out = np.zeros((len(owner), WINDOW), np.uint16)
    first = np.cumsum(per) - per
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
    at = np.repeat(first * WINDOW - (np.cumsum(n) - n), n) + np.arange(len(data))
    out.reshape(-1)[at] = data
    k = np.arange(len(owner)) - first[owner]
    return out, owner, np.minimum(WINDOW, n[owner] - k * WINDOW)


def _mask() -> np.ndarray:
    m = np.zeros((_REACH, DIM, FILTERS * len(WIDTHS)), np.float32)
    for i, w in enumerate(WIDTHS):
        m[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
    return m.reshape(_REACH * DIM, -1)


def _columns(x: np.ndarray, emb: np.ndarray) -> np.ndarray:
    """Each position's reach of embedded bytes: (windows, WINDOW, _REACH * DIM)."""
    e = np.zeros((len(x), WINDOW + _REACH - 1, DIM), np.float32)
    e[:, :WINDOW] = emb[x]
    s = e.strides
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(e, (len(x), WINDOW, _REACH * DIM), (s[0], s[1], s[2])))


def forward(x: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cols = _columns(x, m["emb"])
    z = cols.reshape(-1, cols.shape[2]) @ m["conv"]
    z = z.reshape(len(x), WINDOW, -1)
    pooled = np.maximum(z.max(axis=1) + m["bias"], 0)
    s = pooled @ m["out"] + m["out_bias"]
    s = np.exp(s - s.max(axis=1, keepdims=True))
    return s / s.sum(axis=1, keepdims=True), pooled, z


def gradients(x: np.ndarray, y: np.ndarray, m: dict) -> dict:
    """Gradients of the mean log loss of windows x with classes y. Padding has no embedding to learn."""
    f = m["conv"].shape[1]
    p, pooled, z = forward(x, m)
    d = p.copy()
    d[np.arange(len(x)), y] -= 1
    d /= len(x)
    dp = (d @ m["out"].T) * (pooled > 0)
    where = z.argmax(axis=1)
    cols = _columns(x, m["emb"])[np.arange(len(x))[:, None], where]  # (batch, filters, reach * dim)
    g = {"out": pooled.T @ d, "out_bias": d.sum(axis=0), "bias": dp.sum(axis=0), "conv": np.einsum("bf,bfk->kf", dp, cols) * _mask()}
    back = (dp[:, :, None] * m["conv"].T[None]).reshape(len(x), f, _REACH, DIM)
    place = where[:, :, None] + np.arange(_REACH)
    codes = np.where(place < WINDOW, x[np.arange(len(x))[:, None, None], np.minimum(place, WINDOW - 1)], 0)
    g["emb"] = np.stack([np.bincount(codes.ravel(), back[..., c].ravel(), 257) for c in range(DIM)], axis=1).astype(np.float32)
    g["emb"][0] = 0
    return g


def fit(x: np.ndarray, y: np.ndarray, classes: int, epochs: int = 6, batch: int = 64) -> dict:
    rng, f, mask = np.random.default_rng(3), FILTERS * len(WIDTHS), _mask()
    m = {"emb": rng.normal(0, 0.5, (257, DIM)), "conv": rng.normal(0, 0.2, (_REACH * DIM, f)), "bias": np.zeros(f), "out": rng.normal(0, 0.2, (f, classes)), "out_bias": np.zeros(classes)}
    m = {k: v.astype(np.float32) for k, v in m.items()}
    m["conv"] *= mask
    m["emb"][0] = 0
    first, second, t = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            j = order[i : i + batch]
            g = gradients(x[j], y[j], m)
            t += 1
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                m[k] -= (0.01 * first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return m


def train(docs: DataFrame, per_lang: int = 600, per_doc: int = 3) -> dict | None:
    B.modest(docs.sparkSession)
    rows = docs.where(B.crc_mod("doc_id", 4) != 2).where("lang is not null and text is not null")
    counts = rows.groupBy("lang").count().collect()  # one row a language
    if not counts:
        return None
    langs = sorted(r["lang"] for r in counts)
    share = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, per_lang / r["count"]) * (1 << 20))) for r in counts], "lang string, share int")
    chosen = rows.select("doc_id", "lang", "text").join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.col("share"))

    def cut(it):
        for b in it:
            out = []
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                for k in range(per_doc):  # windows spread over the text, some of them short
                    at = (len(t) - WINDOW) * k // max(1, per_doc - 1)
                    out.append((lang, t[max(0, at) :][:WINDOW]))
                out.append((lang, t[: 4 + len(t) % 60]))
            yield pa.record_batch([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary())], ["lang", "w"])

    got = chosen.select("lang", "text").mapInArrow(cut, "lang string, w binary").limit(2 * per_lang * (per_doc + 1) * len(langs)).collect()
    got = sorted({(r[0], bytes(r[1])) for r in got if r[1]})
    if not got:
        return None
    index = {v: i for i, v in enumerate(langs)}
    m = fit(windows([w for _, w in got])[0], np.array([index[v] for v, _ in got]), len(langs))
    return m | {"langs": langs}


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(it):
        m = sent.value
        for b in it:
            none = b.column(1).is_null()
            for ids, texts, null in _slices(b, none):
                und = np.array(pc.or_(null, pc.invert(pc.match_substring_regex(texts, r"\p{L}"))).to_pylist(), bool)
                if m is None:
                    lang, score = ["und"] * len(ids), und.astype(float)
                else:
                    x, owner, size = windows(texts.cast(pa.binary()).to_pylist())
                    total = np.zeros((len(ids), len(m["langs"])))
                    for i in range(0, len(x), 64):
                        p = forward(x[i : i + 64], m)[0] * size[i : i + 64, None]
                        np.add.at(total, owner[i : i + 64], p)
                    n = np.bincount(owner, size, len(ids))
                    best = total.argmax(axis=1)
                    score = np.where(und, 1.0, np.minimum(1.0, total.max(axis=1) / np.maximum(n, 1)))
                    lang = ["und" if u else m["langs"][k] for u, k in zip(und, best)]
                yield pa.record_batch([ids, pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    def _slices(b, none):
        i = 0
        for ids, texts in B.text_slices(iter([b]), 4 << 20):
            yield ids, texts, none[i : i + len(ids)]
            i += len(ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", (B.crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
