"""Suffix-array dedup: remove every byte that a repeated 200-byte string covers.

Anchors: every 200-byte window of a text has an anchor, the 64-byte substring in it with the least
hash (the leftmost, if equal). Equal windows have equal anchors at equal places, so a window can
only repeat where its anchor does. The windows of one anchor occurrence, a run of neighbours, form a
segment (136 windows, 336 bytes at most).

1. Blocks send their distinct (anchor, segment) hashes to the anchors' owners. An anchor that occurs
   once is done: nothing near it repeats. Segments equal as a whole repeat as a whole.
2. Segments that share an anchor but differ go to its owner, each once. The owner builds a suffix
   array over them in two stages: suffixes smaller than their successors are sorted directly (to a
   depth of 200), all others are induced by scanning the buckets; neighbours whose common prefix
   reaches 200 are repeated windows.
3. Blocks merge the byte ranges of the windows into spans, and cut these out.

An anchor with more than ``crowd`` different segments, such as the edge of a passage that a third of
all texts share, is split: its windows are dealt by their own hash, any number of tasks.
Segments, and such windows, count as equal when two independent 64-bit hashes of their bytes are.
``n_sorted`` counts the windows that a suffix array found.

Null counts as empty; texts under 200 bytes stay whole. Repeated rows are texts of their own, so
long ones vanish; other columns are ignored; an empty table gives no rows. Strings are judged on the
input, and the remaining bytes are joined as they are, even where that cuts a UTF-8 character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import _blocks as B
from loomspark.llm._words import CHUNK, fold, mixed, powers

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_sorted long"
_KEPT = {"bytes": ", kept binary", "text": ", kept string", "": ""}
SPAN, GRAM = 200, 64
_REACH = SPAN - GRAM + 1  # anchors to choose from in a window
_LIMIT, _SA_BYTES = 12 << 20, 2 << 20
_NONE, _ALL, _SORT, _SORT_ALL, _HASH, _HASH_ALL = range(6)  # what an owner says about a segment


# --- anchors -----------------------------------------------------------------------------------


def _jobs(off: np.ndarray):
    """Lists of (start, windows) of at most CHUNK bytes: short texts together, long ones in parts that overlap."""
    todo, size = [], 0
    for i in np.flatnonzero(np.diff(off) >= SPAN):
        for s in range(int(off[i]), int(off[i + 1]) - SPAN + 1, CHUNK):
            n = min(CHUNK, int(off[i + 1]) - SPAN + 1 - s)
            if size + n + SPAN > CHUNK and todo:
                yield todo
                todo, size = [], 0
            todo.append((s, n))
            size += n + SPAN - 1
    if todo:
        yield todo


def _sums(b: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of a polynomial in the bytes, and what makes a difference of them independent of its place."""
    up, down = powers(base)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    return sums, down


def _spans_hash(sums: np.ndarray, down: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
    return mixed((sums[a + n] - sums[a]) * down[a] ^ (n.astype(np.uint64) << np.uint64(40)))


def segments(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, two hashes of the segment, first window, windows) of every anchor occurrence of texts laid end to end."""
    out, low = [], np.uint64((1 << 22) - 1)
    for todo in _jobs(off):
        b = np.concatenate([data[s : s + n + SPAN - 1] for s, n in todo])
        sums, down = _sums(b, 0)
        h = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(b) - GRAM + 1])
        m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        w = 1
        while 2 * w <= _REACH:
            m = np.minimum(m[:-w], m[w:])
            w *= 2
        m = np.minimum(m[: len(m) - (_REACH - w)], m[_REACH - w :]) & low
        size = np.array([n for _, n in todo])
        begin = np.cumsum(size + SPAN - 1) - (size + SPAN - 1)
        j = _runs(begin, size)
        anchor = m[j].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (j[1:] != j[:-1] + 1)]))
        a, n = j[first], np.diff(np.append(first, len(j)))
        k = np.searchsorted(begin, a, side="right") - 1
        # the least hashes are small: spread them. An anchor's hash only gathers segments, so few bits will do
        fp = mixed(h[anchor[first]] * np.uint64(3)) & ~np.uint64(0xFFFF)
        out.append((fp, _spans_hash(sums, down, a, n + SPAN - 1), _spans_hash(*_sums(b, 1), a, n + SPAN - 1), a - begin[k] + np.array([s for s, _ in todo])[k], n))
    if not out:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


def window_hashes(data: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two hashes of each window of segments, as rows."""
    out = []
    for s, k in zip(start.tolist(), n.tolist()):
        b, at = data[s : s + k + SPAN - 1], np.arange(k)
        out.append(np.stack([_spans_hash(*_sums(b, base), at, np.full(k, SPAN)) for base in (0, 1)], axis=1))
    return np.concatenate(out)


def _distinct(fp, s1, s2):
    """(order by anchor and segment hashes, index of each distinct segment's first in it)."""
    order = np.lexsort((s2, s1, fp))
    keys = [x[order] for x in (fp, s1, s2)]
    return order, np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])) if len(fp) else np.empty(0, np.int64)


def _owner(fp: np.ndarray, owners: int) -> np.ndarray:
    return ((fp >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


# --- suffix arrays -----------------------------------------------------------------------------


def _words8(t: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as one number, first byte highest; zeros beyond the end."""
    p = np.concatenate([t, np.zeros(SPAN + 16, np.uint8)]).astype(np.uint64)
    n, w = len(t) + SPAN + 8, np.zeros(len(t) + SPAN + 8, np.uint64)
    for k in range(8):
        w = (w << np.uint64(8)) | p[k : k + n]
    return w


def sort_directly(places: np.ndarray, w: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """Suffixes at ``places`` in order of their first ``depth`` bytes, eight bytes a round; only ties go on."""
    perm = places[np.argsort(w[places], kind="stable")]
    key = w[perm]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(perm) else np.zeros(0, bool)
    group = np.cumsum(new)
    for d in range(8, depth, 8):
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        k, g = w[perm[tied] + d], group[tied]
        o = np.lexsort((k, g))
        perm[tied] = perm[tied][o]
        k = k[o]
        new[tied[1:]] |= k[1:] != k[:-1]
        group = np.cumsum(new)
    return perm


def suffix_array(t: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Suffix array of bytes, correct to SPAN bytes, by two-stage sorting."""
    n = len(t)
    if not n:
        return np.empty(0, np.int64)
    turn = np.flatnonzero(t[1:] != t[:-1])  # where a suffix is told from its successor by the first byte
    nxt = np.searchsorted(turn, np.arange(n))
    small = np.zeros(n, bool)
    in_ = nxt < len(turn)
    at = turn[nxt[in_]]
    small[in_] = t[at] < t[at + 1]
    direct = sort_directly(np.flatnonzero(small), w)
    bounds = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def put(before: np.ndarray) -> None:
        """Induce: suffixes that begin one byte before these, if larger than their successor, join their bucket in this order."""
        before = before[before >= 0]
        before = before[~small[before]]
        if len(before):
            c = t[before]
            o = np.argsort(c, kind="stable")
            cut = np.flatnonzero(np.diff(c[o])) + 1
            for part in np.split(before[o], cut):
                waiting[t[part[0]]].append(part)

    put(np.array([n - 1]))
    for c in range(256):
        while waiting[c]:  # a run of one byte puts its suffixes into the bucket that is being read
            q = np.concatenate(waiting[c])
            waiting[c] = []
            out.append(q)
            put(q - 1)
        s = direct[bounds[c] : bounds[c + 1]]
        if len(s):
            out.append(s)
            put(s - 1)
    return np.concatenate(out)


def long_neighbours(sa: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places whose suffix has a common prefix of SPAN bytes with a neighbour in the array."""
    a, b = sa[:-1], sa[1:]
    alive = np.arange(len(a))
    for d in range(0, SPAN, 8):
        alive = alive[w[a[alive] + d] == w[b[alive] + d]]
    return np.unique(np.concatenate([a[alive], b[alive]]))


def repeated_windows(pieces: list[bytes]) -> list[np.ndarray]:
    """For each piece, whether the window that begins at each of its places is found elsewhere among the pieces."""
    lens = np.array([len(p) for p in pieces])
    t = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    start = np.cumsum(lens + 1) - (lens + 1)
    w = _words8(t)
    sa = suffix_array(t, w)
    inside = np.zeros(len(t), bool)
    n = np.maximum(0, lens - SPAN + 1)
    inside[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())] = True
    hit = np.zeros(len(t), bool)
    hit[long_neighbours(sa[inside[sa]], w)] = True
    return [hit[s : s + k] for s, k in zip(start, n)]


# --- the operator ------------------------------------------------------------------------------


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off, buf = B.offsets_of(texts).astype(np.int64), texts.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def _ask(ids, texts, owners):
    fp, s1, s2, _, _ = segments(*_bytes_of(texts))
    order, first = _distinct(fp, s1, s2)
    one = order[first]
    f, n = fp[one], np.minimum(2, np.diff(np.append(first, len(order)))).astype(np.uint8)
    at = np.searchsorted(_owner(f, owners), np.arange(owners + 1))
    return [(p, B.pack(np.diff(f[i:j], prepend=np.uint64(0)), s1[one[i:j]], s2[one[i:j]], n[i:j])) for p, (i, j) in enumerate(zip(at, at[1:])) if i < j], fold(s1[one] ^ s2[one])


def _say(crowd: int):
    def answer(asked):
        lists = [B.unpack(b) for _, b in asked]
        size = [len(d) for d, *_ in lists]
        fp = np.concatenate([np.cumsum(d, dtype=np.uint64) for d, *_ in lists])
        s1, s2 = (np.concatenate([x[i] for x in lists]) for i in (1, 2))
        n = np.concatenate([x[3] for x in lists]).astype(np.int64)
        del lists
        order = np.lexsort((np.arange(len(fp)), s2, s1, fp))
        f, s1, s2 = fp[order], s1[order], s2[order]
        new_f = np.concatenate([[True], f[1:] != f[:-1]])
        new = new_f | np.concatenate([[True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])])
        pair, anchor = np.cumsum(new) - 1, np.cumsum(new_f) - 1
        many = np.bincount(pair, n[order])[pair] > 1
        kinds = np.bincount(anchor, new)[anchor]
        said = np.where(many, _ALL, np.where(kinds > 1, _SORT, _NONE))
        said = np.where(many & (kinds > 1) & new, _SORT_ALL, said)
        said = np.where((kinds > crowd) & (said >= _SORT), said + 2, said)
        code, i = np.empty(len(fp), np.uint8), 0
        code[order] = said
        for (block, _), k in zip(asked, size):
            yield block, B.pack(code[i : i + k])
            i += k

    return answer


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _second(blob, answers, owners, block, check):
    """Mark what is settled, and send the segments that must be sorted and the windows that must be hashed."""
    _, texts, *_ = B.unpack_texts(blob)
    data, off = _bytes_of(texts)
    fp, s1, s2, start, n = segments(data, off)
    order, first = _distinct(fp, s1, s2)
    said = np.concatenate([B.unpack(answers[p])[0] for p in sorted(answers)]) if answers else np.empty(0, np.uint8)
    each = np.empty(len(fp), np.uint8)
    each[order] = np.repeat(said, np.diff(np.append(first, len(order))))
    full = np.isin(each, (_ALL, _SORT_ALL, _HASH_ALL))
    one = order[first]
    parts, asked = [], []
    sort = one[np.isin(said, (_SORT, _SORT_ALL))]
    at = np.searchsorted(_owner(fp[sort], owners), np.arange(owners + 1))
    for p, (i, j) in enumerate(zip(at, at[1:])):
        if i < j:
            mine = sort[i:j]
            size = n[mine] + SPAN - 1
            parts.append((p, B.pack(fp[mine], size.astype(np.uint32), b"".join(data[a : a + k].tobytes() for a, k in zip(start[mine].tolist(), size.tolist())))))
            asked.append((p, start[mine], n[mine]))
    crowd = one[np.isin(said, (_HASH, _HASH_ALL))]
    if len(crowd):
        places, h = _runs(start[crowd], n[crowd]), window_hashes(data, start[crowd], n[crowd])
        own = h[:, 0] % np.uint64(owners)
        o = np.lexsort((h[:, 1], own))
        at = np.searchsorted(own[o], np.arange(owners + 1))
        for p, (i, j) in enumerate(zip(at, at[1:])):
            if i < j:
                parts.append((owners + p, B.pack(h[o[i:j], 0], h[o[i:j], 1])))
                asked.append((owners + p, places[o[i:j]], np.ones(j - i, np.int64)))
    state = B.pack(start[full], n[full], *(x for p, s, k in asked for x in (np.array([p]), s, k)))
    return B.rows_of(block, check, len(state).to_bytes(8, "little") + state + blob, parts)


def _sort(asked):
    lists = [B.unpack(b) for _, b in asked]
    if len(lists[0]) == 2:  # windows by hash
        h = np.concatenate([np.stack(x, axis=1) for x in lists])
        _, back, n = np.unique(h, axis=0, return_inverse=True, return_counts=True)
        twice, i = (n > 1)[back.ravel()], 0
        for (block, _), (x, _) in zip(asked, lists):
            yield block, np.packbits(twice[i : i + len(x)]).tobytes()
            i += len(x)
        return
    fp = np.concatenate([f for f, _, _ in lists])
    size = np.concatenate([s for _, s, _ in lists]).astype(np.int64)
    end = np.cumsum(size)
    raw = b"".join(x for _, _, x in lists)
    order = np.argsort(fp, kind="stable")
    hits: list = [None] * len(fp)
    batch, held = [], 0
    edge = np.concatenate([fp[order][1:] != fp[order][:-1], [True]])
    for i, last in zip(order.tolist(), edge.tolist()):
        batch.append(i)
        held += int(size[i])
        if last and held > _SA_BYTES or i == order[-1]:  # whole anchors together
            for k, hit in zip(batch, repeated_windows([raw[end[k] - size[k] : end[k]] for k in batch])):
                hits[k] = hit
            batch, held = [], 0
    i = 0
    for (block, _), (f, _, _) in zip(asked, lists):
        yield block, np.packbits(np.concatenate(hits[i : i + len(f)])).tobytes()
        i += len(f)


def _spans(begin: np.ndarray, end: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of the maximal runs that byte ranges cover; a range lies within one text."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], end[order]
    text = np.searchsorted(off, begin, side="right") - 1
    far = np.maximum.accumulate(end) if len(end) else end
    first = np.flatnonzero(np.concatenate([[True], (begin[1:] > far[:-1]) | (text[1:] != text[:-1])])) if len(begin) else np.empty(0, np.int64)
    return text[first], begin[first], far[np.append(first[1:], len(begin)) - 1] if len(begin) else end


def _cut(schema: str, kept_as: str):
    def run(blob, answers, owners, block, _check):
        n_state = int.from_bytes(blob[:8], "little")
        state = B.unpack(blob[8 : 8 + n_state])
        ids, texts, *carried = B.unpack_texts(blob[8 + n_state :])
        data, off = _bytes_of(texts)
        begins, ends, by_sort = [state[0]], [state[0] + state[1] + SPAN - 1], []
        for i in range(2, len(state), 3):
            p, places = int(state[i][0]), _runs(state[i + 1], state[i + 2])
            hit = places[np.unpackbits(np.frombuffer(answers[p], np.uint8), count=len(places)).astype(bool)]
            begins.append(hit)
            ends.append(hit + SPAN)
            if p < owners:
                by_sort.append(hit)
        text, begin, end = _spans(np.concatenate(begins), np.concatenate(ends), off)
        per = lambda i, w=None: np.bincount(i, w, len(ids)).astype(np.int64)
        found = np.searchsorted(off, np.concatenate(by_sort), side="right") - 1 if by_sort else np.empty(0, np.int64)
        cuts: dict[int, list[tuple[int, int]]] = {}
        for t, a, z in zip(text.tolist(), begin.tolist(), end.tolist()):
            cuts.setdefault(t, []).append((a, z))
        kept, sha, raw = [], [], memoryview(data)
        for t, (a, z) in enumerate(zip(off.tolist(), off[1:].tolist())):
            if t in cuts:
                edges = [a, *(x for c in cuts[t] for x in c), z]
                k = b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
            else:
                k = raw[a:z]
            sha.append(hashlib.sha256(k).hexdigest())
            if kept_as:
                kept.append(bytes(k).decode("utf-8", "ignore") if kept_as == "text" else bytes(k))
        out = B.table(schema, ids, np.diff(off), per(text, end - begin), per(text), sha, per(found), *([kept] if kept_as else []))
        return out.append_column("carried", carried[0]) if carried else out

    return run


def cut_repeats(docs: DataFrame, crowd: int = 4096, carry: bool = False, kept: str = "bytes") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_sorted, and what remains in ``kept``.

    kept: "bytes"; "text", without the bytes of characters that were cut in two; or "" for none.
    With ``carry`` the other columns follow in ``carried``.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    extra, schema = (), SCHEMA + _KEPT[kept]
    if carry and others:
        extra = (F.struct(*(F.col(f"`{c}`") for c in others)).alias("carried"),)
        schema += ", carried " + docs.select(*extra).schema[0].dataType.simpleString()
    owners = B.owners_of(docs)
    return B.meet(B.meet(B.deal(docs, _ask, _LIMIT, extra), owners, _say(crowd), _second, B.ROW), owners, _sort, _cut(SCHEMA + _KEPT[kept], kept), schema)
