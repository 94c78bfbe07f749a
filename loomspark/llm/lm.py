"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

Tokens are the words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased, then one end. A word has a
class and a subclass: the most common words are dealt over the 32 x 32 cells by rank, all others by hash. The model is

    P(word | history) = P(class | history) P(subclass | class, history) P(word | cell)

Both softmaxes have hashed features of the history. Of the class: the last word, the last two, and the
second and third last alone (skips). Of the subclass: the last, second last and third last, each with the class. P(word | cell) is (c + 1) / (N_cell + V_cell + 1), c the training count, so
each cell keeps one share for unknown words and a text's probabilities are those of a proper model.

The features share tables of 2**BITS rows, whatever the corpus: only the word counts grow with it.

Counts of all words of all training rows are exact and kept by owner. The softmaxes are trained on
every training row once, in rounds: each task runs AdaGrad steps over its rows of the round from the
common weights, and the tasks' weights are averaged by tokens. Scoring runs in numpy batches that
gather the rows of the weights that a batch's features name.

Null counts as empty: one end token. Rows without a doc_id are not learned from, and their held_out
is null. Repeated rows are learned from and scored each. Other columns are ignored; an empty table
gives no rows. Without training rows N = V = 0.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import _blocks as B
from loomspark.llm._words import fold, hash64, split_by, word_codes

CLASSES, BITS, HEAD = 32, 13, 1024
_ROWS = 1 << BITS
_COUNTS = "k long, words binary, counts binary, tokens long, kinds long"
_SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_CHUNK = 8192
END = ""  # no word is empty


def _is_training(ids: pa.Array) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for i in ids.to_pylist()], bool)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of each token with an end after each text, offsets, distinct words with the end last)."""
    codes, off, words = word_codes(pc.ascii_lower(texts))
    n = len(words)
    stream = np.insert(codes.astype(np.int64), off[1:], n)
    return stream, off + np.arange(len(off)), pa.concat_arrays([words.cast(pa.string()), pa.array([END])])


# --- exact counts ------------------------------------------------------------------------------


def count_words(docs: DataFrame) -> DataFrame:
    """Training counts of all words, one row per owner: words joined by newlines, counts, sums."""
    owners = B.owners_of(docs)
    B.modest(docs.sparkSession)

    def send(it):
        for ids, texts in B.text_slices(it, B.BLOCK_BYTES):
            texts = texts.filter(pa.array(_is_training(ids)))
            if not len(texts):
                continue
            stream, _, words = tokens(texts)
            c = np.bincount(stream, minlength=len(words))
            order, at = split_by(hash64(words) % np.uint64(owners), owners)
            words, c = words.take(pa.array(order)), c[order]
            blobs = [(p, B.pack("\n".join(words[i:j].to_pylist()).encode(), c[i:j])) for p, (i, j) in enumerate(zip(at, at[1:])) if i < j]
            yield pa.record_batch([pa.array([p for p, _ in blobs], pa.int64()), pa.array([b for _, b in blobs], pa.binary())], ["k", "blob"])

    def add(t: pa.Table) -> pa.Table:
        lists = [B.unpack(b) for b in t["blob"].to_pylist()]
        words = pa.chunked_array([pa.array(w.decode().split("\n"), pa.string()) for w, _ in lists]).combine_chunks().dictionary_encode()
        c = np.bincount(words.indices.to_numpy(), np.concatenate([c for _, c in lists])).astype(np.int64)
        return B.table(_COUNTS, [t["k"][0].as_py()], [B.pack("\n".join(words.dictionary.to_pylist()).encode())], [B.pack(c)], [int(c.sum())], [len(c)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return B.stored(rows.mapInArrow(send, "k long, blob binary").repartition(owners, "k").groupBy("k").applyInArrow(add, _COUNTS))


def _opened(words: bytes, counts: bytes) -> tuple[pa.Array, np.ndarray]:
    return pa.array(B.unpack(words)[0].decode().split("\n"), pa.string()), B.unpack(counts)[0]


def common_words(counts: DataFrame, n: int) -> list[str]:
    def top(it):
        for b in it:
            for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words, c = _opened(w, c)
                best = np.lexsort((np.arange(len(c)), -c))[:n]
                yield pa.record_batch([words.take(pa.array(best)), pa.array(c[best])], ["word", "n"])

    rows = counts.select("words", "counts").mapInArrow(top, "word string, n long").orderBy(F.desc("n"), "word").limit(n).collect()
    return [r["word"] for r in rows]


class Cells:
    """Class and subclass of words."""

    def __init__(self, head: list[str]):
        h = hash64(pa.array(head, pa.string()))
        order = np.argsort(h)
        self.hashes, self.rank = h[order], order.astype(np.int64)

    def of(self, h: np.ndarray) -> np.ndarray:
        """CLASSES * class + subclass."""
        hashed = ((h >> np.uint64(7)) % np.uint64(CLASSES * CLASSES)).astype(np.int64)
        if not len(self.hashes):
            return hashed
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        r = self.rank[at]
        return np.where(self.hashes[at] == h, (r % CLASSES) * CLASSES + r // CLASSES % CLASSES, hashed)


def cell_totals(counts: DataFrame, cells: Cells) -> np.ndarray:
    """N + V + 1 of each cell."""

    def run(it):
        out = np.zeros(CLASSES * CLASSES)
        for b in it:
            for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words, c = _opened(w, c)
                out += np.bincount(cells.of(hash64(words)), c + 1.0, CLASSES * CLASSES)
        yield B.shards_of(out, 1)

    got = B.total(counts.select("words", "counts").mapInArrow(run, "shard long, blob binary"), 1)[0]
    return (got if len(got) else np.zeros(CLASSES * CLASSES)) + 1


# --- the softmaxes -----------------------------------------------------------------------------


def histories(h: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Hashes of the last, second last and third last token; a constant before the text."""
    out, last = [], (h >> np.uint64(32)).astype(np.uint32)
    for _ in range(3):
        p = np.empty_like(last)
        p[1:] = last[:-1]
        p[start] = 0x9E3779B9
        out.append(p)
        last = p
    return out


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint32(salt * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    return ((x * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)).astype(np.uint16)


def _features(p1, p2, p3, c1) -> tuple[list[np.ndarray], list[np.ndarray]]:
    c = c1.astype(np.uint32) * np.uint32(0x27D4EB2F)
    return [_mix(p1, 1), _mix(p1 * np.uint32(31) + p2, 2), _mix(p2, 3), _mix(p3, 4)], [_mix(p1 + c, 5), _mix(p2 + c, 6), _mix(p3 + c, 7)]


def fresh_model() -> dict:
    z = lambda *s: np.zeros(s, np.float32)
    return {"w1": z(_ROWS, CLASSES), "w2": z(_ROWS, CLASSES), "b1": z(1, CLASSES), "b2": z(CLASSES, CLASSES), "a1": z(_ROWS), "a2": z(_ROWS), "ab1": z(1), "ab2": z(CLASSES)}


def _softmax(w, ids, bias):
    s = w.take(ids[0], axis=0, mode="clip")
    row = np.empty_like(s)
    for i in ids[1:]:
        s += w.take(i, axis=0, mode="clip", out=row)
    s += bias
    np.exp(np.clip(s, -60, 60, out=s), out=s)  # sums of few small weights: no need to take off the largest
    s /= (s @ np.ones(s.shape[1], s.dtype))[:, None]
    return s


def _step(w: np.ndarray, acc: np.ndarray, ids: np.ndarray, g: np.ndarray, rate: float) -> None:
    """One AdaGrad step for the rows that ids name; each row has one step length."""
    order = np.argsort(ids, kind="stable")
    i = ids[order]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    sums = np.add.reduceat(g.take(order, axis=0, mode="clip"), first, axis=0)
    rows = i[first]
    acc[rows] += np.einsum("ij,ij->i", sums, sums) / np.float32(sums.shape[1])
    sums *= (np.float32(rate) / (np.sqrt(acc[rows]) + np.float32(1e-6)))[:, None]
    w[rows] -= sums


def learn(m: dict, h: np.ndarray, cell: np.ndarray, start: np.ndarray, rate: float = 0.15) -> None:
    p = histories(h, start)
    for i in range(0, len(h), _CHUNK):
        s = slice(i, i + _CHUNK)
        c1, c2 = cell[s] // CLASSES, cell[s] % CLASSES
        one, two = _features(p[0][s], p[1][s], p[2][s], c1)
        at = np.arange(len(c1))
        g = _softmax(m["w1"], one, m["b1"])
        g[at, c1] -= 1
        for f in one:
            _step(m["w1"], m["a1"], f, g, rate)
        total = g.sum(axis=0)
        m["ab1"] += (total * total).mean()
        m["b1"] -= rate * total / (np.sqrt(m["ab1"]) + 1e-6)
        g = _softmax(m["w2"], two, m["b2"][c1])
        g[at, c2] -= 1
        for f in two:
            _step(m["w2"], m["a2"], f, g, rate)
        _step(m["b2"], m["ab2"], c1.astype(np.uint16), g, rate)


def class_scores(m: dict, h: np.ndarray, cell: np.ndarray, start: np.ndarray) -> np.ndarray:
    """log10 P(class, subclass | history) of each token."""
    p, out = histories(h, start), np.empty(len(h))
    for i in range(0, len(h), _CHUNK):
        s = slice(i, i + _CHUNK)
        c1, c2 = cell[s] // CLASSES, cell[s] % CLASSES
        one, two = _features(p[0][s], p[1][s], p[2][s], c1)
        at = np.arange(len(c1))
        out[s] = np.log10(np.maximum(_softmax(m["w1"], one, m["b1"])[at, c1], 1e-30)) + np.log10(np.maximum(_softmax(m["w2"], two, m["b2"][c1])[at, c2], 1e-30))
    return out


def train(docs: DataFrame, cells: Cells, rounds: tuple[int, ...] = (2, 6, 8)) -> dict:
    """Weights after one pass over all training rows, split over rounds in sixteenths by doc_id."""
    spark, model, names, begin = docs.sparkSession, fresh_model(), list(fresh_model()), 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(B.crc_mod("doc_id", 7) != 2)
    for n in rounds:
        part = F.pmod(F.xxhash64("doc_id"), F.lit(sum(rounds)))
        sent = spark.sparkContext.broadcast(model)  # two tables of fixed size

        def run(it, sent=sent):
            m, size = {k: v.copy() for k, v in sent.value.items()}, 0
            for _, texts in B.text_slices(it, B.BLOCK_BYTES):
                stream, off, words = tokens(texts)
                h = hash64(words)
                learn(m, h[stream], cells.of(h)[stream], off[:-1])
                size += len(stream)
            if size:
                yield B.shards_of(np.concatenate([[size], *((m[k].ravel() * size) for k in names)]).astype(np.float32), 16)

        got = np.concatenate(B.total(rows.where((part >= begin) & (part < begin + n)).mapInArrow(run, "shard long, blob binary"), 16))
        begin += n
        if len(got):
            at = 1
            for k in names:
                model[k] = (got[at : at + model[k].size] / got[0]).astype(np.float32).reshape(model[k].shape)
                at += model[k].size
    return model


# --- scores ------------------------------------------------------------------------------------


def fitted(docs: DataFrame) -> dict:
    """The model: word counts (a table), their sums n and v, the words' cells and the cells' sizes, and the weights."""
    counts = count_words(docs)
    n, v = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    cells = Cells(common_words(counts, HEAD))
    return {"counts": counts, "n": n, "v": v, "cells": cells, "sizes": cell_totals(counts, cells), "weights": {k: x for k, x in train(docs, cells).items() if k[0] != "a"}}


def score(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score, score. Without a model one is fitted to the training rows."""
    model = model or fitted(docs)
    counts, n, v, cells, sizes = (model[k] for k in ("counts", "n", "v", "cells", "sizes"))
    sent = docs.sparkSession.sparkContext.broadcast(model["weights"])

    def keys(ids, texts, owners):
        _, _, words = tokens(texts)
        h = hash64(words)
        order, at = split_by(h % np.uint64(owners), owners)
        words = words.take(pa.array(order))
        return [(p, B.pack("\n".join(words[i:j].to_pylist()).encode())) for p, (i, j) in enumerate(zip(at, at[1:])) if i < j], fold(h)

    def answer(asked, facts):
        lists = [B.unpack(b)[0].decode().split("\n") for _, b in asked]
        known, c = _opened(facts["words"][0].as_py(), facts["counts"][0].as_py()) if len(facts) else (pa.array([], pa.string()), np.zeros(0, np.int64))
        at = pc.index_in(pa.chunked_array([pa.array(x, pa.string()) for x in lists]), value_set=known).combine_chunks().fill_null(len(known)).to_numpy()
        got, i = np.append(c, 0)[at], 0
        for (block, _), x in zip(asked, lists):
            yield block, B.pack(got[i : i + len(x)].astype(np.int64))
            i += len(x)

    def finish(doc_ids, texts, answers, owners, _block):
        stream, off, words = tokens(texts)
        h = hash64(words)
        order, at = split_by(h % np.uint64(owners), owners)
        c = np.empty(len(words), np.int64)
        c[order] = np.concatenate([B.unpack(answers[p])[0] for p in range(owners) if at[p] < at[p + 1]])
        cell = cells.of(h)
        plain, inner = np.log10(c + 1.0), np.log10((c + 1.0) / sizes[cell])
        total = lambda x: np.add.reduceat(x, off[:-1]) if len(off) > 1 else np.zeros(0)
        size = np.diff(off)
        full = np.empty(len(size))
        for i in range(0, len(size), 1000):  # a thousand texts at a time
            o = off[i : i + 1001]
            s = stream[o[0] : o[-1]]
            full[i : i + 1000] = np.add.reduceat(class_scores(sent.value, h[s], cell[s], o[:-1] - o[0]) + inner[s], o[:-1] - o[0])
        return B.table(_SCORES, doc_ids, size, total((c > 0)[stream].astype(np.int64)), np.full(len(size), n), total(plain[stream]) - size * np.log10(n + v + 1.0), full)

    rows = B.exchange(docs, keys, answer, finish, _SCORES, facts=counts.select("k", "words", "counts"))
    return rows.select("doc_id", (B.crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
