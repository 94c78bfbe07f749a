"""Exact dedup by a Golomb-coded exchange of fingerprints.

Texts are equal when identical after each run of [\\x20\\x09-\\x0D] became one space. Each block
groups its own equal texts by their bytes and sends the sorted, Golomb-coded fingerprints of its
distinct texts to their owners; an owner returns one bit per fingerprint, set when another block
sent it too. Only texts with a set bit are suspects: they are grouped by their whole bytes
(partial sums before the shuffle), and the smallest doc_id of each group stays.

A text that fills a third of all rows is one suspect row per block. Null counts as empty, and all
empty texts are equal. Repeated rows are copies of each other: a repeated doc_id gives as many
rows, each with kept = true if it is the smallest. Other columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import _blocks as B
from loomspark.llm._words import fold, split_by

_SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_RUN = re.compile(rb" {2,}")
_ROWS = "suspect boolean, doc_id long, keep_id long, group_size long, text_sha256 string, fp long, members array<long>, norm binary"


def normalised(text: bytes) -> bytes:
    t = text.translate(_SPACES)
    return _RUN.sub(b" ", t) if b"  " in t else t


def golomb(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned integers: Rice codes of their differences, quotients and remainders apart."""
    d = np.diff(values, prepend=np.uint64(0))
    b = int(np.log2(max(1.0, float(values[-1]) / len(values) * 0.69))) if len(values) else 0
    q = (d >> np.uint64(b)).astype(np.int64)
    unary = np.zeros(int(q.sum()) + len(q), np.uint8)
    unary[np.cumsum(q + 1) - 1] = 1
    rest = ((d[:, None] >> np.arange(b, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    head = len(values).to_bytes(4, "little") + bytes([b]) + len(unary).to_bytes(4, "little")
    return head + np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def golomb_decode(blob: bytes) -> np.ndarray:
    n, b, bits = int.from_bytes(blob[:4], "little"), blob[4], int.from_bytes(blob[5:9], "little")
    cut = 9 + (bits + 7) // 8
    q = np.diff(np.flatnonzero(np.unpackbits(np.frombuffer(blob[9:cut], np.uint8), count=bits)), prepend=-1) - 1
    rest = np.unpackbits(np.frombuffer(blob[cut:], np.uint8), count=n * b).reshape(n, b).astype(np.uint64)
    r = (rest << np.arange(b, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((q.astype(np.uint64) << np.uint64(b)) + r, dtype=np.uint64)


def _prints(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    norm = [normalised(t) for t in texts.cast(pa.binary()).to_pylist()]
    return norm, np.fromiter((xxhash.xxh3_64_intdigest(t) for t in norm), np.uint64, len(norm))


def _dealt(fp: np.ndarray, owners: int):
    """Distinct fingerprints by owner, each owner's ascending; (distinct, order, bounds)."""
    u = np.unique(fp)
    order, at = split_by(u % np.uint64(owners), owners)
    return u[order], at


def _keys(ids, texts, owners):
    _, fp = _prints(texts)
    u, at = _dealt(fp, owners)
    return [(p, golomb(u[at[p] : at[p + 1]] // np.uint64(owners))) for p in range(owners) if at[p] < at[p + 1]], fold(u)


def _answer(asked):
    lists = [golomb_decode(blob) for _, blob in asked]
    _, back, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    twice, at = n[back] > 1, 0
    for (block, _), x in zip(asked, lists):
        yield block, np.packbits(twice[at : at + len(x)]).tobytes()
        at += len(x)


def _finish(doc_ids, texts, answers, owners, _block):
    norm, fp = _prints(texts)
    u, at = _dealt(fp, owners)
    bits = [np.unpackbits(np.frombuffer(answers[p], np.uint8), count=at[p + 1] - at[p]) for p in range(owners) if at[p] < at[p + 1]]
    elsewhere = set(u[np.concatenate(bits).astype(bool)].tolist()) if bits else set()
    groups: dict[bytes, list[int]] = {}
    for i, t in enumerate(norm):
        groups.setdefault(t, []).append(i)
    seen: set[int] = set()
    for t, rows in groups.items():  # two texts of one fingerprint in one block: both are suspects
        if (f := int(fp[rows[0]])) in seen:
            elsewhere.add(f)
        seen.add(f)
    ids, out = doc_ids.to_pylist(), []
    for t, rows in groups.items():
        mine, sha, f = [ids[i] for i in rows], hashlib.sha256(t).hexdigest(), int(fp[rows[0]])
        least = min((x for x in mine if x is not None), default=None)
        if f in elsewhere:
            out.append((True, least, None, len(rows), sha, int(np.int64(np.uint64(f))), mine, t))
        else:
            out += [(False, x, least, len(rows), sha, None, None, None) for x in mine]
    return B.table(_ROWS, *(zip(*out) if out else [[]] * 8))


def groups(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = B.stored(B.exchange(docs, _keys, _answer, _finish, _ROWS))
    suspects = rows.where("suspect")
    whole = suspects.groupBy("fp", "norm").agg(F.min("doc_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.first("text_sha256").alias("text_sha256"))
    same = suspects.select("fp", "text_sha256", "members").join(whole.drop("norm"), ["fp", "text_sha256"])
    columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
    both = rows.where("not suspect").select(*columns).unionByName(same.select(F.explode("members").alias("doc_id"), *columns[1:]))
    return both.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")
