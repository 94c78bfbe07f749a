"""Quality classifier: naive-Bayes support vectors over n-gram indicators.

A text's features are n-gram indicators of two streams: its bytes (pairs, and hashed triples) and the
gaps of its words, which write each word as the distance to its last occurrence (new, 1, 2-3, 4-7 ...; pairs
and runs of four). Class counts of every feature are summed over all labelled training rows; their log
ratios scale the indicators. A linear model of the hinge loss on a bounded sample of those rows (``sample``
rows in expectation, chosen by hash; at most twice as many) is fitted by dual coordinate descent, and its
margin is turned into a probability by a logistic curve fitted on a fifth of the sample kept aside.

Null texts count as empty; empty texts get the score of a text without features. A document with
several labels has their mean, and mean 0.5 counts as 0; null labels are no labels. Without labels
of both classes the score is the share of label 1 (0.5 without any). Repeated rows are scored each;
columns besides doc_id and text are never read for a score. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import _blocks as B
from loomspark.llm._words import word_codes

SIZE = 1 << 18
_PAIRS, _CODES = 1 << 16, 8
_EXTRA = 1 + _CODES**2 + _CODES**4
#: Bits of the map of labelled ids: 8 MB to broadcast, whatever the data.
MARKS = 1 << 26
_SCORE = "doc_id long, held_out boolean, score double, predicted int"


def gaps(codes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each word: 0 if its text has not had it yet, else 1 + log2 of the distance to its last occurrence, 7 at most."""
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((codes, text))
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[order][1:] == codes[order][:-1]) & (text[order][1:] == text[order][:-1])
    out = np.zeros(len(codes), np.int64)
    at = np.flatnonzero(again)
    out[order[at]] = np.minimum(_CODES - 1, 1 + np.log2(order[at] - order[at - 1]).astype(np.int64))
    return out


def features(texts: pa.Array):
    """The distinct features of each text, ascending; the first is on in every text."""
    codes, off, _ = word_codes(texts)
    g = gaps(codes, off)
    two = g[:-1] * _CODES + g[1:]
    four = two[:-2] * _CODES**2 + two[2:]
    on, room = np.zeros(SIZE, bool), SIZE - _PAIRS - _EXTRA
    for i, t in enumerate(texts.cast(pa.binary()).to_pylist()):
        b = np.frombuffer(t, np.uint8).astype(np.uint32)
        on[0] = True
        pair = (b[:-1] << 8) | b[1:]
        on[_EXTRA + pair] = True
        if len(b) > 2:
            triple = ((pair[:-1] << 8) | b[2:]) * np.uint32(2654435761)
            on[_EXTRA + _PAIRS + (triple >> np.uint32(8)) % np.uint32(room)] = True
        a, z = off[i], off[i + 1]
        on[1 + two[a : max(a, z - 1)]] = True
        on[1 + _CODES**2 + four[a : max(a, z - 3)]] = True
        u = np.flatnonzero(on)
        on[u] = False
        yield u.astype(np.int32)


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = 30) -> np.ndarray:
    """Weights of min |w|^2/2 + sum cost * max(0, 1 - y w.x) by dual coordinate descent (0 <= alpha <= cost); x: scaled indicators of unit length."""
    w, alpha = np.zeros(len(scale)), np.zeros(len(rows))
    length = [max(1e-9, float(np.sqrt(x @ x))) for x in (scale[u] for u in rows)]  # the rows themselves, kept as doubles, would be twice the sample
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            u = rows[i]
            x = scale[u] / length[i]
            step = min(max(alpha[i] + 1 - y[i] * float(w[u] @ x), 0.0), cost[i]) - alpha[i]  # x.x is 1
            if step:
                alpha[i] += step
                w[u] += step * y[i] * x
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))), by Newton steps on smoothed targets."""
    n1, n0 = float((y > 0).sum()), float((y <= 0).sum())
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, h = p - t, p * (1 - p) + 1e-9
        g = np.array([d @ margin + 1e-3 * (a - 1), d.sum()])
        m = np.array([[h @ margin**2 + 1e-3, h @ margin], [h @ margin, h.sum()]])
        s = np.linalg.solve(m, g)
        a, b = a - s[0], b - s[1]
        if np.abs(s).max() < 1e-7:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def _margin(u: np.ndarray, v: np.ndarray, sq: np.ndarray) -> float:
    return float(v[u].sum()) / max(1e-9, float(np.sqrt(sq[u].sum())))


def marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id may be in ids: all that are, and of the others a share of at most len(ids) / MARKS.

    The ids become a bitmap of hash slots, MARKS bits in all, against which rows are held where they are
    read: a join by doc_id that follows shuffles few rows without a partner. Ids beyond MARKS only fill the map.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
    bits = ids.groupBy(F.bitmap_bucket_number(slot).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bits"))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.getbit(byte, (at % 8).cast("int")) == 1
    return rows.join(F.broadcast(bits), F.bitmap_bucket_number(slot) == F.col("_bucket")).where(on).select(rows.columns)


def train(docs: DataFrame, labels: DataFrame, sample: int = 10000) -> dict:
    """The model: v (weight of each feature), sq (squared scale), a, b; or a constant p."""
    B.modest(docs.sparkSession)
    known = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(B.crc_mod("doc_id", 4) != 2)
    one = known.groupBy("doc_id").agg((F.avg("quality") > 0.5).alias("y"))
    rows = marked(docs.select(*B.plain_columns()).where(B.crc_mod("doc_id", 4) != 2), known).join(one, "doc_id")

    def made(it):
        for b in it:
            done = 0
            for ids, texts in B.text_slices(iter([b.select(["doc_id", "text"])]), B.BATCH_BYTES):
                yield pa.record_batch([ids, b.column(2).slice(done, len(ids)), pa.array([u.tobytes() for u in features(texts)], pa.binary())], ["doc_id", "y", "f"])
                done += len(ids)

    table = B.stored(rows.select("doc_id", "text", "y").mapInArrow(made, "doc_id long, y boolean, f binary"))

    def count(it):
        n, size = np.zeros((2, SIZE)), np.zeros(2)
        for b in it:
            for y, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n[int(y), np.frombuffer(f, np.int32)] += 1
                size[int(y)] += 1
        yield B.shards_of(np.concatenate([size, n.ravel()]).astype(np.float32), 16)

    sums = np.concatenate(B.total(table.select("y", "f").mapInArrow(count, "shard long, blob binary"), 16))
    n0, n1 = (sums[:2] if len(sums) else (0, 0))
    if not n0 or not n1:
        return {"p": float(n1 / (n0 + n1)) if n0 + n1 else 0.5}
    p, q = 1 + sums[2 + SIZE :], 1 + sums[2 : 2 + SIZE]
    scale = np.log((p / p.sum()) / (q / q.sum()))
    scale[0] = 1.0
    share = min(1.0, sample / (n0 + n1))
    got = table.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("doc_id", "y", "f").limit(2 * sample).collect()
    got.sort(key=lambda r: r[0])
    y = np.array([1.0 if r[1] else -1.0 for r in got])
    x = [np.frombuffer(r[2], np.int32) for r in got]
    aside = np.arange(len(x)) % 5 == 0
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside[:] = True
    fit = np.flatnonzero(~aside) if not aside.all() else np.arange(len(x))
    weight = {s: len(fit) / (2 * max(1, (y[fit] == s).sum())) for s in (1.0, -1.0)}
    w = descend([x[i] for i in fit], y[fit], scale, np.array([weight[s] for s in y[fit]]))
    v, sq = w * scale, scale**2
    a, b = calibrate(np.array([_margin(x[i], v, sq) for i in np.flatnonzero(aside)]), y[aside])
    del got, x
    B.settle(docs.sparkSession)
    return {"v": v.astype(np.float32), "sq": sq.astype(np.float32), "a": a, "b": b}


def probabilities(texts: pa.Array, m: dict) -> np.ndarray:
    if "p" in m:
        return np.full(len(texts), m["p"])
    z = np.array([_margin(u, m["v"], m["sq"]) for u in features(texts)])
    return 1 / (1 + np.exp(-np.clip(m["a"] * z + m["b"], -30, 30)))


def score(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two numbers per hashed feature, whatever the data

    def run(it):
        for ids, texts in B.text_slices(it, B.BATCH_BYTES):
            yield pa.record_batch([ids, pa.array(probabilities(texts, sent.value))], ["doc_id", "score"])

    rows = docs.select(*B.plain_columns()).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", (B.crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, that score() predicts as 1."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(it):
        for b in it:
            texts, done = b.column(at).cast(pa.string()).fill_null(""), 0
            for ids, part in B.text_slices(iter([pa.record_batch([texts, texts], ["i", "t"])]), B.BATCH_BYTES):
                accepted = pa.array(probabilities(part, sent.value) >= threshold)
                yield b.slice(done, len(ids)).filter(accepted)
                done += len(ids)

    B.modest(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
