"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line stripped of [\\x20\\x09-\\x0D] at both ends, with A-Z lower-cased. The index
is dealt to owners by hash; each owner keeps sorted runs of (128-bit key hash, documents, settled), one row of
packed arrays a run. A new batch is merge-joined with its owner's runs: hashes that the runs hold as
settled (in ``min_docs`` documents by then) are anti-joined away, so frequent lines cost nothing in later batches;
the others are added in one sorted run of the batch, settled if the sum over the runs has come to ``min_docs``. When a
level holds ``fanout`` runs they are merged into one run of the next level. No batch rewrites older levels.

Lines whose key has at least ``min_chars`` code points and is settled in the end go
from all documents; the others stay, joined by newlines. Null and empty texts are one empty line,
which stays; every row is a document of its own, also where it repeats another or its doc_id; other columns are
ignored; an empty table gives no rows. A key that is in a third of all lines is one row per block.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import _blocks as B
from loomspark.llm._words import fold, hash128, split_by

SCHEMA = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept string"
_SPACE = " \t\n\v\f\r"


def line_keys(texts: pa.Array, min_chars: int):
    """(lines, document of each line, key code of each line, distinct keys, whether a key counts)."""
    lists = pc.split_pattern(texts, "\n")
    lines, n = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    coded = pc.ascii_lower(pc.utf8_trim(lines, characters=_SPACE)).dictionary_encode()
    keys = coded.dictionary
    return lines, np.repeat(np.arange(len(texts)), n), coded.indices.to_numpy(zero_copy_only=False), keys, pc.utf8_length(keys).to_numpy(zero_copy_only=False) >= min_chars


def _halves(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(hash128(keys)), ">u8").astype(np.uint64).reshape(-1, 2)
    return raw[:, 0], raw[:, 1]


_RUN = "k long, blob binary"


def _merged(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """(hi, lo, docs, settled) of runs and batches, each hash once, sorted."""
    parts = [B.unpack(b) for b in blobs]
    hi, lo, docs, settled = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.uint64) for i in range(4))
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])) if len(hi) else np.empty(0, np.int64)
    if not len(first):
        return hi, lo, docs.astype(np.int64), settled.astype(np.uint8)
    return hi[first], lo[first], np.add.reduceat(docs[order], first), np.maximum.reduceat(settled[order], first)


def _place(run: tuple, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Where a sorted run holds each hash, or -1."""
    at, end = np.searchsorted(run[0], hi), np.searchsorted(run[0], hi, side="right")
    out = np.full(len(hi), -1)
    while len(todo := np.flatnonzero((at < end) & (out < 0))):  # one round, but for equal halves
        hit = run[1][at[todo]] == lo[todo]
        out[todo[hit]] = at[todo[hit]]
        at[todo] += 1
    return out


class LineRuns:
    """The levelled index. Runs are tables in the shared folder, a row of sorted arrays for each owner."""

    def __init__(self, owners: int, min_docs: int = 10, fanout: int = 2):
        self.owners, self.min_docs, self.fanout, self.levels = owners, min_docs, fanout, [[]]

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def all(self) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, self.runs())

    def _by_owner(self, rows: DataFrame, f) -> DataFrame:
        return B.stored(rows.repartition(self.owners, "k").groupBy("k").applyInArrow(f, _RUN))

    def add(self, batch: DataFrame) -> None:
        """batch: (k, blob) of hashes by owner, a hash perhaps several times."""
        least, rows = self.min_docs, batch.select("k", "blob", F.lit(-1).alias("run"))
        for i, r in enumerate(self.runs()):
            rows = rows.unionByName(r.select("k", "blob", F.lit(i).alias("run")))

        def join(t: pa.Table) -> pa.Table:
            k, run, blobs = t["k"][0].as_py(), t["run"].to_pylist(), t["blob"].to_pylist()
            hi, lo, docs, _ = _merged([b for b, r in zip(blobs, run) if r < 0])
            held, done = np.zeros(len(hi), np.int64), np.zeros(len(hi), bool)
            for b, r in zip(blobs, run):
                if r >= 0 and len(hi):
                    older = B.unpack(b)
                    at = _place(older, hi, lo)
                    found = np.flatnonzero(at >= 0)
                    held[found] += older[2][at[found]]
                    done[found] |= older[3][at[found]] > 0
            mine = ~done  # the anti-join
            new = B.pack(hi[mine], lo[mine], docs[mine], (held + docs >= least)[mine].astype(np.uint8))
            return B.table(_RUN, [k] * bool(mine.any()), [new] * bool(mine.any()))

        self.levels[0].append(self._by_owner(rows, join))
        for i in range(64):
            if len(self.levels[i]) < self.fanout:
                break
            if len(self.levels) == i + 1:
                self.levels.append([])
            old = self.levels[i]
            self.levels[i + 1].append(self._by_owner(functools.reduce(DataFrame.unionByName, old), lambda t: B.table(_RUN, [t["k"][0].as_py()], [B.pack(*_merged(t["blob"].to_pylist()))])))
            self.levels[i] = []
            B.forget(*old)


def line_hashes(docs: DataFrame, owners: int, batches: int, min_chars: int) -> DataFrame:
    """(batch, k, blob): distinct key hashes of each block with the number of its documents, by owner."""
    B.modest(docs.sparkSession)

    def run(it):
        seq = TaskContext.get().partitionId()
        for _, texts in B.text_slices(it, B.BLOCK_BYTES):
            _, doc, code, keys, counts = line_keys(texts, min_chars)
            pairs = np.unique(doc * max(1, len(keys)) + code)
            n = np.bincount(pairs % max(1, len(keys)), minlength=len(keys))
            hi, lo = _halves(keys)
            ask = np.flatnonzero(counts)
            order, at = split_by(hi[ask] % np.uint64(owners), owners)
            ask = ask[order]
            parts = [(p, B.pack(hi[a], lo[a], n[a].astype(np.int64), np.zeros(len(a), np.uint8))) for p in range(owners) if len(a := ask[at[p] : at[p + 1]])]
            yield pa.record_batch([pa.array([seq % batches] * len(parts), pa.int32()), pa.array([p for p, _ in parts], pa.int64()), pa.array([b for _, b in parts], pa.binary())], ["batch", "k", "blob"])
            seq += 1

    return docs.select(*B.plain_columns()).mapInArrow(run, "batch int, k long, blob binary")


def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256, kept (the remaining text)."""
    owners = B.owners_of(docs)
    hashes, index = B.stored(line_hashes(docs, owners, batches, min_chars), "batch"), LineRuns(owners, min_docs)
    for b in range(batches):
        index.add(hashes.where(F.col("batch") == b).select("k", "blob"))
    B.forget(hashes)

    def dealt(texts, n):
        lines, doc, code, keys, counts = line_keys(texts, min_chars)
        hi, lo = _halves(keys)
        ask = np.flatnonzero(counts)
        order, at = split_by(hi[ask] % np.uint64(n), n)
        return lines, doc, code, ask[order], at, hi, lo, len(keys)

    def keys(ids, texts, n):
        *_, ask, at, hi, lo, _ = dealt(texts, n)
        return [(p, B.pack(hi[a], lo[a])) for p in range(n) if len(a := ask[at[p] : at[p + 1]])], fold(hi ^ lo)

    def answer(asked, facts):
        runs = _merged(facts["blob"].to_pylist())
        runs = tuple(x[runs[3] > 0] for x in runs)
        for block, blob in asked:
            yield block, np.packbits(_place(runs, *B.unpack(blob)) >= 0).tobytes()

    def finish(doc_ids, texts, answers, n, _block):
        lines, doc, code, ask, at, _, _, size = dealt(texts, n)
        drop = np.zeros(size, bool)
        for p in range(n):
            if len(a := ask[at[p] : at[p + 1]]):
                drop[a] = np.unpackbits(np.frombuffer(answers[p], np.uint8), count=len(a)).astype(bool)
        gone = drop[code]
        n_lines, n_dropped = np.bincount(doc, minlength=len(texts)), np.bincount(doc[gone], minlength=len(texts))
        bounds = np.concatenate([[0], np.cumsum(n_lines - n_dropped)])
        kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), lines.filter(pa.array(~gone))), "\n")
        return B.table(SCHEMA, doc_ids, n_lines, n_dropped, [hashlib.sha256(x).hexdigest() for x in kept.cast(pa.binary()).to_pylist()], kept)

    return B.exchange(docs, keys, answer, finish, SCHEMA, facts=index.all())
