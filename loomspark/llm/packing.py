"""Best-fit packing by patterns: few documents whose lengths together fill a sequence.

1. Texts become ids and an end id, cut into pieces of at most ``capacity`` tokens where longer.
2. The histogram of piece lengths (``capacity`` bins at most, whatever the data) is fitted by
   non-negative least squares over enumerated patterns of up to four lengths that nearly fill a
   sequence. The fitted repeat counts are laid out first, least waste first; what rounding down leaves of
   one passes to the next pattern of the same largest length, so small counts add up rather than vanish. The rest is
   fitted again, until patterns lay out nothing more.
3. What the patterns leave is packed best-fit decreasing by length, whole runs of equal sequences at
   a time, so the plan has few thousand rows, whatever the data.
4. Pieces of a length are numbered: by block, then within the block. The plan maps the number to a
   sequence and an offset. Nothing is gathered by length.

Null and empty texts are the end id alone. Repeated rows are packed each; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm import _blocks as B
from loomspark.llm.bpe import encoded

_PIECES = "unit long, nth long, doc_id long, piece int, start long, length long, ids_crc32 long"
_OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    def rows(doc_ids, batches, block):
        ids_of, out, i = doc_ids.to_pylist(), [], 0
        for ids, ends in batches:
            raw = memoryview(np.insert(ids.astype("<u4"), ends[1:], end_id)).cast("B")
            bounds = ends + np.arange(len(ends))
            for a, z in zip(bounds.tolist(), bounds[1:].tolist()):
                for k, s in enumerate(range(a, z, capacity)):
                    e = min(z, s + capacity)
                    out.append((ids_of[i], k, s - a, e - s, zlib.crc32(raw[4 * s : 4 * e])))
                i += 1
        length = np.array([o[3] for o in out], np.int64)
        order = np.argsort(length, kind="stable")
        nth = np.empty(len(out), np.int64)
        nth[order] = np.arange(len(out)) - np.searchsorted(length[order], length[order])
        return B.table(_PIECES, np.full(len(out), block), nth, *(zip(*out) if out else [[]] * 5))

    return encoded(docs, tokenizer, rows, _PIECES)


def _patterns(lengths: np.ndarray, capacity: int, keep: int = 6, waste: float = 0.02) -> np.ndarray:
    """Rows of up to four lengths (0: none) that waste at most a share of the capacity; for each largest length the tightest few."""
    up = np.sort(lengths)

    def fit(room):  # the largest length that fits, or 0
        at = np.searchsorted(up, room, side="right") - 1
        return np.where(at >= 0, up[np.maximum(at, 0)], 0)

    q = np.unique(up[np.linspace(0, len(up) - 1, 24).astype(int)])
    few = q[:: max(1, len(q) // 8)]
    b, c = (x.ravel() for x in np.meshgrid(few, few))
    out = []
    for part in np.array_split(up[::-1], -(-len(up) // 512)):  # some lengths at a time
        a, zero = part[:, None], np.zeros(len(part), int)[:, None]
        row = lambda *v: np.stack(np.broadcast_arrays(*v), axis=2)
        rows = np.concatenate([row(a, fit(capacity - a), zero, zero), row(a, q[None], fit(capacity - a - q), zero), row(a, b[None], c[None], fit(capacity - a - b - c))], axis=1)
        total = rows.sum(axis=2)
        total = np.where((total <= capacity) & (total >= (1 - waste) * capacity), total, -1)
        best = np.argsort(-total, axis=1, kind="stable")[:, :keep]
        out.append(np.take_along_axis(rows, best[:, :, None], axis=1)[np.take_along_axis(total, best, axis=1) >= 0])
    rows = np.concatenate(out) if out else np.zeros((0, 4), int)
    return np.unique(-np.sort(-rows, axis=1), axis=0)


def _repeats(patterns: np.ndarray, lengths: np.ndarray, counts: np.ndarray, rounds: int = 80) -> np.ndarray:
    """Repeat counts x >= 0 of min |A x - counts|^2 by multiplicative steps; A has at most four entries a column."""
    if not len(patterns):
        return np.zeros(0)
    at = np.searchsorted(lengths, patterns)
    on = patterns > 0
    n = len(lengths)
    cols = np.where(on, at, n)
    pad = np.append(counts.astype(float), 0.0)
    x = np.full(len(patterns), counts.sum() / (2.5 * len(patterns)))
    top = pad[cols].sum(axis=1)
    for _ in range(rounds):
        made = np.bincount(cols.ravel(), np.repeat(x, 4), n + 1)
        made[n] = 0
        x = x * top / np.maximum(made[cols].sum(axis=1), 1e-12)
    return x


def by_patterns(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The sequences that patterns lay out, of ascending lengths; what they use is taken from ``left``."""
    out: list[tuple[tuple[int, ...], int]] = []
    while left.any():
        have, laid, rest = lengths[left > 0], len(out), {}
        rows = _patterns(have, capacity)
        x = _repeats(rows, have, left[left > 0])
        at = np.searchsorted(lengths, rows).tolist()
        for i in np.argsort(-rows.sum(axis=1), kind="stable").tolist():
            seq = [v for v in rows[i].tolist() if v]
            uses = Counter(at[i][: len(seq)])
            want = float(x[i]) + rest.get(seq[0], 0.0)
            n = min(int(want + 1e-9), *(int(left[k]) // u for k, u in uses.items()))
            rest[seq[0]] = want - n
            if n > 0:
                for k, u in uses.items():
                    left[k] -= n * u
                out.append((tuple(seq), n))
        if len(out) == laid:
            break
    return out


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, largest first; how many such sequences), using every piece once."""
    if not len(lengths):
        return []
    order = np.argsort(lengths)
    lengths, left = lengths[order], counts[order].astype(np.int64).copy()
    out = by_patterns(lengths, left, capacity)
    while left.any():
        have = np.flatnonzero(left)
        used: dict[int, int] = {}
        seq, room = [], capacity
        while room > 0:
            j = int(np.searchsorted(lengths[have], room, side="right")) - 1
            while j >= 0 and used.get(int(have[j]), 0) >= left[have[j]]:
                j -= 1
            if j < 0:
                break
            k = int(have[j])
            used[k] = used.get(k, 0) + 1
            seq.append(int(lengths[k]))
            room -= seq[-1]
        n = int(min(left[k] // u for k, u in used.items()))
        for k, u in used.items():
            left[k] -= n * u
        out.append((tuple(seq), n))
    return out


def places(layout: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first number, first sequence and offset of every run of slots, by number."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    seen: dict[int, int] = {}
    first = 0
    for seq, n in layout:
        at = 0
        for v in seq:
            runs.setdefault(v, []).append((seen.get(v, 0), first, at))
            seen[v] = seen.get(v, 0) + n
            at += v
        first += n
    return {v: tuple(np.array(c, np.int64) for c in zip(*r)) for v, r in runs.items()}


def packed(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    table = B.stored(pieces(docs, tokenizer, capacity, end_id))
    per = table.groupBy("unit", "length").agg(F.count("*").alias("n"))
    hist = per.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most capacity rows
    layout = plan(np.array([r["length"] for r in hist], np.int64), np.array([r["n"] for r in hist], np.int64), capacity)
    sent = docs.sparkSession.sparkContext.broadcast(places(layout))
    earlier = Window.partitionBy("length").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    base = per.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    numbered = table.join(base, ["unit", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("number"))

    def place(it):
        for b in it:
            length, number = b.column(3).to_numpy(), b.column(5).to_numpy()
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cut = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cut) if len(order) else []:
                start, first, at = sent.value[int(length[rows[0]])]
                run = np.searchsorted(start, number[rows], side="right") - 1
                seq[rows], off[rows] = first[run] + number[rows] - start[run], at[run]
            yield pa.record_batch([*b.columns[:5], pa.array(seq), pa.array(off)], [f.name for f in B.arrow_schema(_OUT)])

    return numbered.mapInArrow(place, _OUT)
