"""Near-duplicate detection: consistent weighted sampling over TF-IDF shingles.

A text is lower-cased, ASCII punctuation becomes space, and each run of five words is a shingle (all
words, where there are fewer). A shingle weighs (1 + ln tf) * (1 + ln((N + 1) / df) / ln(N + 1)), with
df counted over all N documents. Texts are linked when their weighted Jaccard similarity, sum(min) /
sum(max), is 0.8 or more, or the plain one of their shingle sets is: in large groups of copies, what
they share is so common that weights alone would part them. A class is a connected component of
links; its least doc_id stays.

1. Blocks exchange shingle hashes with their owners, which return document frequencies.
2. What a text shares bounds its similarity: one with less than 0.8 of its weight, and of its shingles,
   at df > 1 has no partner and is done. All others get their samples in ``bands`` bands of ``rows`` of
   their weights (improved consistent weighted sampling), and as many of their plain sets (least
   hashes), so either kind of link has its own; texts with equal features become one representative.
3. Buckets of equal members count once. The members of a bucket of up to ``small`` meet in one task and
   are compared in full, through their weights, but for those that links have joined already. In a
   larger one the least members lead, and all others are compared with them, in parts of ``small`` by
   ``small``; those that none matches are the next round's bucket, with four times as many leaders. A
   fifth of the bands goes first; of the others, buckets that lie within one component by then are left
   out. A long text counts as several members (one for each 64 KB of features), so what a task holds has
   a bound in bytes.
4. Links become components: up to ``FEW_LINKS`` in one task, more by label propagation with pointer jumping.
5. Members that a leader matched are compared with those it was tested with that lie in other
   components still, in parts of ``small`` by ``small``. Both distances (1 - Jaccard) are metrics: a pair
   whose distances to the leader differ by more than 1 - threshold, in both, is no link.

Null and empty texts, and texts without a word, are alone in their class. A repeated doc_id is one
document, whatever its texts: its rows are linked, and stay or go together. Other columns are ignored; an empty table gives no rows.
A group of copies, however large, sends one row per block; a large group of near copies that match
their leader is compared with it only. Every two members of a bucket of any size end in one class if
they are linked.
"""

from __future__ import annotations

import functools
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm import _blocks as B
from loomspark.llm._words import fold, hash64, word_codes

WORDS, HASH_BITS = 5, 48
_TO_SPACE = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_TESTED = "lead long, rep long, w long, weighted double, plain double"
_ROWS = "doc_id long, candidate boolean, same binary, bands array<long>, features binary"
_LIMIT = 12 << 20
#: So many different links, 32 MB, are joined in one task; more of them by rounds of joins.
FEW_LINKS = 1 << 21


def plain(texts: pa.Array) -> pa.Array:
    """Lower-cased, with ASCII punctuation as spaces."""
    t = pa.concat_arrays([pc.utf8_lower(texts)])
    _, off, data = t.buffers()
    if data is None:
        return t
    return pa.Array.from_buffers(pa.string(), len(t), [None, off, pa.py_buffer(data.to_pybytes().translate(_TO_SPACE))])


def shingles(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text: its distinct shingle hashes, ascending, and how often each occurs."""
    codes, off, words = word_codes(plain(texts))
    h = hash64(words)[codes] if len(words) else np.empty(0, np.uint64)
    s = h[: max(0, len(h) - WORDS + 1)].copy()
    for j in range(1, WORDS):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - WORDS + 1 + j] if len(s) else s
    s ^= s >> np.uint64(31)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s >>= np.uint64(64 - HASH_BITS)
    out = []
    for a, z in zip(off, off[1:]):
        if z - a >= WORDS:
            out.append(np.unique(s[a : z - WORDS + 1], return_counts=True))
        else:
            one = [xxhash.xxh3_64_intdigest(h[a:z].tobytes()) >> (64 - HASH_BITS)] if z > a else []
            out.append((np.array(one, np.uint64), np.ones(len(one), np.int64)))
    return out


def _gamma_quantiles(n: int) -> np.ndarray:
    x = np.concatenate([np.geomspace(1e-6, 1, 20000), np.linspace(1, 40, 40000)[1:]])
    return np.interp((np.arange(n) + 0.5) / n, 1 - (1 + x) * np.exp(-x), x)


class Sampler:
    """Improved consistent weighted sampling: for each of ``n`` draws the shingle and level with the least ln a."""

    def __init__(self, n: int):
        self.seeds = np.array([xxhash.xxh3_64_intdigest(b"draw%d" % i) for i in range(n)], np.uint64)
        self.r = _gamma_quantiles(1 << 12).astype(np.float32)
        self.ln_c = np.log(_gamma_quantiles(1 << 16)).astype(np.float32)

    def draws(self, u: np.ndarray, weight: np.ndarray, step: int = 4096) -> np.ndarray:
        best, sign = np.full(len(self.seeds), np.inf), np.zeros(len(self.seeds), np.uint64)
        for i in range(0, len(u), step):
            x = (u[i : i + step][None, :] ^ self.seeds[:, None]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            r = self.r[x & np.uint64(0xFFF)]
            beta = ((x >> np.uint64(28)) & np.uint64(0xFFFFF)).astype(np.float32) * np.float32(2.0**-20)
            t = np.floor(np.log(weight[i : i + step]).astype(np.float32)[None, :] / r + beta)
            ln_a = self.ln_c[(x >> np.uint64(12)) & np.uint64(0xFFFF)] - r * (t - beta + 1)
            at = ln_a.argmin(axis=1)
            k = np.arange(len(at))
            less = ln_a[k, at] < best
            best = np.where(less, ln_a[k, at], best)
            sign = np.where(less, u[i + at] * np.uint64(0xD6E8FEB86659FD93) + t[k, at].astype(np.int64).astype(np.uint64), sign)
        return sign

    def plain_draws(self, u: np.ndarray, step: int = 4096) -> np.ndarray:
        """The least hash of the set for each draw: two sets agree with the chance of their plain Jaccard similarity."""
        best = np.full(len(self.seeds), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(u), step):
            x = (u[i : i + step][None, :] ^ self.seeds[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0x94D049BB133111EB)
            best = np.minimum(best, x.min(axis=1))
        return best

    def bands(self, u: np.ndarray, weight: np.ndarray, rows: int) -> list[int]:
        """The bands of the weights, then as many of the plain set."""
        s = np.concatenate([self.draws(u, weight), self.plain_draws(u)]).reshape(-1, rows)
        return [int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(b.tobytes(), i)))) for i, b in enumerate(s)]


def weights(tf: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    return (1 + np.log(tf)) * (1 + np.log((n + 1) / df) / np.log(n + 1))


def weighed(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(shingles, weights, their sum) of packed features among n documents."""
    d, tf, df = B.unpack(blob)
    w = weights(tf, df, n)
    return np.cumsum(d, dtype=np.uint64), w, float(w.sum())


def similarities(x: tuple, y: tuple) -> tuple[float, float]:
    """Weighted and plain Jaccard of two weighed() sets."""
    (u, wu, a), (v, wv, b) = x, y
    at = np.searchsorted(v, u)
    hit = np.flatnonzero(at < len(v))
    hit = hit[v[at[hit]] == u[hit]]
    both = float(np.minimum(wu[hit], wv[at[hit]]).sum())
    return both / (a + b - both), len(hit) / (len(u) + len(v) - len(hit))


def similarity(x: tuple, y: tuple, least: float = 0.0) -> float:
    """The greater of weighted and plain Jaccard of two weighed() sets; 0 where their sizes alone show both to be under ``least``."""
    (u, _, a), (v, _, b) = x, y
    if min(a, b) < least * max(a, b) - 1e-9 and min(len(u), len(v)) < least * max(len(u), len(v)):
        return 0.0
    return max(similarities(x, y))


def sampled(docs: DataFrame, threshold: float, bands: int, rows: int) -> DataFrame:
    """Per document: whether it can have a partner, and then its features (one row per block and feature set) and bands."""
    n = docs.count()

    def block(texts):
        each = shingles(texts)
        u, c = np.unique(np.concatenate([x for x, _ in each]) if each else np.empty(0, np.uint64), return_counts=True)
        return each, u, c

    def bounds(u, owners):
        return np.searchsorted((u * np.uint64(owners)) >> np.uint64(HASH_BITS), np.arange(owners + 1))

    def keys(ids, texts, owners):
        _, u, c = block(texts)
        at = bounds(u, owners)
        return [(p, B.pack(np.diff(u[i:j], prepend=np.uint64(0)), c[i:j].astype(np.uint32))) for p, (i, j) in enumerate(zip(at, at[1:])) if i < j], fold(u)

    def answer(asked):
        lists = [B.unpack(b) for _, b in asked]
        us = [np.cumsum(d, dtype=np.uint64) for d, _ in lists]
        _, back = np.unique(np.concatenate(us), return_inverse=True)
        df = np.bincount(back, np.concatenate([c for _, c in lists])).astype(np.uint32)[back]
        i = 0
        for (b, _), u in zip(asked, us):
            yield b, B.pack(df[i : i + len(u)])
            i += len(u)

    def finish(doc_ids, texts, answers, owners, _block):
        each, u, _ = block(texts)
        df = np.concatenate([B.unpack(answers[p])[0] for p in sorted(answers)]) if answers else np.empty(0, np.uint32)
        sampler, seen, out = Sampler(bands * rows), set(), []
        for i, (x, tf) in zip(doc_ids.to_pylist(), each):
            f = df[np.searchsorted(u, x)]
            w = weights(tf, f, n)
            if not len(x) or i is None or max(w[f > 1].sum() / w.sum(), (f > 1).mean()) < threshold - 1e-9:
                out.append((i, False, None, None, None))
                continue
            same = xxhash.xxh3_128_digest(x.tobytes() + tf.tobytes())
            if same in seen:
                out.append((i, True, same, None, None))
                continue
            seen.add(same)
            out.append((i, True, same, sampler.bands(x, w, rows), B.pack(np.diff(x, prepend=np.uint64(0)), tf.astype(np.uint32), f)))
        return B.table(_ROWS, *(zip(*out) if out else [[]] * 5))

    return B.exchange(docs, keys, answer, finish, _ROWS, limit=_LIMIT)


def least_ids(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of links, ascending, and the least id of each one's component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while (root[u] != root[v]).any():
        lo, hi = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]
    return ids, ids[root]


def _joined(it):
    got = [b for b in it if len(b)]
    ids, label = least_ids(*(np.concatenate([b.column(k).to_numpy() for b in got] or [np.empty(0, np.int64)]) for k in (0, 1)))
    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(label, pa.int64())], ["id", "label"])


def components(links: DataFrame, few: int | None = None) -> DataFrame:
    """(id, label) for each end of links (a, b): the least id of its component."""
    pairs = B.stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if pairs.count() <= (FEW_LINKS if few is None else few):
        labels = B.stored(pairs.coalesce(1).mapInArrow(_joined, "id long, label long"))
        B.forget(pairs)
        return labels
    both = B.stored(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    B.forget(pairs)
    labels = B.stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.min("label").alias("m"))
        hop = labels.join(near.withColumnRenamed("u", "id"), "id").select("id", "label", F.least("label", "m").alias("to"))
        root = labels.select(F.col("id").alias("to"), F.col("label").alias("far"))
        new = B.stored(hop.join(root, "to").select("id", F.col("far").alias("label"), (F.col("far") != F.col("label")).alias("moved")))
        B.forget(labels)
        if not new.where("moved").limit(1).count():
            B.forget(both)
            return new.select("id", "label")
        labels = new.drop("moved")
        labels.stored_at = new.stored_at


def _linked(threshold: float, n: int):
    """Links that join the members of one small bucket: each member against the members of all other groups so far, first those of its part."""

    def run(t: pa.Table) -> pa.Table:
        reps = t["rep"].to_pylist()
        sets = [weighed(f, n) for f in t["features"].to_pylist()]
        group, out = t["part"].to_pylist(), []
        for i in range(len(reps)):
            for j in range(i):
                if group[i] != group[j] and similarity(sets[i], sets[j], threshold) >= threshold:
                    out.append((reps[j], reps[i]))
                    old, new = group[i], group[j]
                    group = [new if g == old else g for g in group]
        return B.table("a long, b long", *(zip(*out) if out else [[], []]))

    return run


def _crossed(threshold: float, n: int):
    """Links of members that one leader matched with members of other components; one is enough for each component."""

    def run(t: pa.Table) -> pa.Table:
        inside = np.array(t["inside"].to_pylist(), bool)
        reps, label = t["rep"].to_pylist(), t["label"].to_pylist()
        sims, sets = np.array([t["weighted"].to_pylist(), t["plain"].to_pylist()]), [weighed(f, n) for f in t["features"].to_pylist()]
        joined, out, mine = set(), [], np.flatnonzero(inside)
        for j in np.flatnonzero(~inside):
            if label[j] in joined:
                continue
            near = (np.abs(sims[:, mine] - sims[:, [j]]) <= 1 - threshold + 1e-9).any(axis=0)
            for i in mine[near]:
                if similarity(sets[i], sets[j], threshold) >= threshold:
                    out.append((reps[i], reps[j]))
                    joined.add(label[j])
                    break
        return B.table("a long, b long", *(zip(*out) if out else [[], []]))

    return run


def crossing(tested: DataFrame, labels: DataFrame, features, threshold: float, n: int, small: int) -> DataFrame:
    """Links (a, b) that leaders hid: between members that a leader matched and members of other components it was tested with.

    tested: (lead, rep, w, weighted, plain), the similarities of each leader and member, and the member's weight in a task.
    """
    of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label")).hint("merge")
    t = tested.join(of("rep"), "rep", "left").join(of("lead"), "lead", "left").withColumn("label", F.coalesce("rep_label", "rep")).withColumn("inside", F.greatest("weighted", "plain") >= threshold)
    t = t.where(F.col("inside") | (F.col("label") != F.coalesce("lead_label", "lead"))).drop("rep_label", "lead_label")
    t = B.stored(t.dropDuplicates(["lead", "rep"]))
    # the ends of both sides' distances: who is too far from all of the other side has no link there
    end = lambda f, c, side: f(F.when(F.col("inside") if side else ~F.col("inside"), F.col(c)))
    ends = t.groupBy("lead").agg(*(end(F.min, c, True).alias(f"in_{c}") for c in ("weighted", "plain")), *(end(F.max, c, False).alias(f"out_{c}") for c in ("weighted", "plain")))
    gap = 1 - threshold + 1e-9
    close = lambda c: F.when(F.col("inside"), F.col(c) - F.col(f"out_{c}") <= gap).otherwise(F.col(f"in_{c}") - F.col(c) <= gap)
    t = B.stored(t.join(ends.where("in_plain is not null and out_plain is not null").hint("merge"), "lead").where(close("weighted") | close("plain")).select("lead", "rep", "w", "weighted", "plain", "label", "inside"))
    return B.stored(_in_parts(features(t), t, ["lead"], small).applyInArrow(_crossed(threshold, n), "a long, b long"))


def _in_parts(rows: DataFrame, weighed_rows: DataFrame, by: list[str], small: int):
    """rows of two sides (inside or not), grouped so that each of one side meets each of the other, in parts of weight ``small`` by ``small``."""
    side = lambda inside: F.ceil(F.sum(F.when(F.col("inside") if inside else ~F.col("inside"), F.col("w"))) / small).cast("int")
    parts = weighed_rows.groupBy(*by).agg(side(True).alias("n_in"), side(False).alias("n_out")).where("n_in > 0 and n_out > 0")
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("inside"), F.col("n_in")).otherwise(F.col("n_out"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("inside"), F.col("n_out")).otherwise(F.col("n_in")) - 1))
    t = rows.join(parts.hint("merge"), by).select(*rows.columns, own.alias("own"), other.alias("other"))
    t = t.withColumn("i", F.when(F.col("inside"), F.col("own")).otherwise(F.col("other"))).withColumn("j", F.when(F.col("inside"), F.col("other")).otherwise(F.col("own")))
    return t.drop("own", "other").groupBy(*by, "i", "j")


def classes(docs: DataFrame, threshold: float = 0.8, bands: int = 28, rows: int = 5, small: int = 256) -> DataFrame:
    """Per document: doc_id, class_id (the least doc_id of its class), kept."""
    return grouped(B.stored(sampled(docs, threshold, bands, rows)), docs.count(), threshold, bands, small)


def _compared(n: int):
    """Similarities of the leaders (inside) in one part with the members in it that have greater ids."""

    def run(t: pa.Table) -> pa.Table:
        inside, reps, w = (t[c].to_pylist() for c in ("inside", "rep", "w"))
        sets, out = [weighed(f, n) for f in t["features"].to_pylist()], []
        for i in (i for i, head in enumerate(inside) if head):
            out += [(reps[i], reps[j], w[j], *similarities(sets[i], sets[j])) for j, head in enumerate(inside) if not head and reps[i] < reps[j]]
        return B.table(_TESTED, *(zip(*out) if out else [[]] * 5))

    return run


def _bucket_links(rows: DataFrame, features, threshold: float, n: int, small: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(links, tests) of the buckets of rows (key, rep, w, part); those within one part have nothing to add.

    A bucket of weight ``small`` or less is one task. In a larger one, the least members lead: one in the
    first round, four times as many in each further one, so a bucket of n takes some log n rounds even if nothing matches.
    The features of members of large buckets are set apart once: rounds don't read those of all texts again.
    """
    links, tests, leaders, open_, apart = [], [], 1, rows, None
    while True:
        # equal buckets of several bands, by weight, least member and a fingerprint, count once
        each = open_.groupBy("key").agg(F.sum("w").alias("n"), F.min("rep").alias("lead"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi")
        buckets = B.stored(each.groupBy("n", "lead", "x").agg(F.min("key").alias("key")).select("key", "n", "lead"))
        met = open_.join(buckets.hint("merge"), "key")
        few, many = met.where(F.col("n") <= small), met.where(F.col("n") > small)
        links.append(B.stored(features(few.select("key", "rep", "part")).groupBy("key").applyInArrow(_linked(threshold, n), "a long, b long")))
        if not buckets.where(F.col("n") > small).limit(1).count():
            B.forget(buckets, open_, apart)
            return links, tests
        many = B.stored(many.select("key", "rep", "w", "part", "lead"))
        if apart is None:
            apart = B.stored(features(many.select("rep").distinct()).select("rep", "features"))
            features = functools.partial(_with, apart)
        if leaders == 1:
            heads = many.where("rep = lead").select("key", F.col("lead").alias("rep"), "w")
        else:
            first = Window.partitionBy("key").orderBy("rep")  # limited before the shuffle too
            heads = many.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= leaders).select("key", "rep", "w")
        heads = B.stored(heads)
        # buckets with the same leaders are tested as one, so bands with the same members don't repeat it
        led = heads.groupBy("key").agg(F.xxhash64(F.count("*"), F.min("rep"), F.bit_xor(F.xxhash64("rep"))).alias("led"))
        sides = heads.withColumn("inside", F.lit(True)).unionByName(many.select("key", "rep", "w").withColumn("inside", F.lit(False)))
        sides = B.stored(sides.join(led.hint("merge"), "key").select("led", "rep", "w", "inside").distinct())
        tested = B.stored(_in_parts(features(sides), sides, ["led"], small).applyInArrow(_compared(n), _TESTED))
        tests.append(tested)
        like = tested.where(F.greatest("weighted", "plain") >= threshold)
        links.append(like.select(F.col("lead").alias("a"), F.col("rep").alias("b")))
        # on go those that led nothing and that no leader of their bucket matched
        matched = heads.select("key", F.col("rep").alias("lead")).join(like.select("lead", "rep").distinct(), "lead").select("key", "rep")
        gone = matched.unionByName(heads.select("key", "rep")).distinct()
        rest = B.stored(many.drop("lead").join(gone, ["key", "rep"], "left_anti"))
        B.forget(buckets, many, heads, sides, open_)
        open_, leaders = rest, 4 * leaders


def _with(apart: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.join(apart, "rep")


def grouped(table: DataFrame, n: int, threshold: float = 0.8, bands: int = 28, small: int = 256) -> DataFrame:
    """The classes of n documents from their rows of sampled()."""
    least = table.where("candidate").groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("bands", True).alias("bands"), F.first("features", True).alias("features"))
    # a long text counts as several members, so a task's features have a bound in bytes
    reps = B.bucketed(least.withColumn("w", 1 + F.floor(F.length("features") / F.lit(1 << 16))), "same")
    ids = B.stored(reps.select("rep", "same"))
    B.settle(table.sparkSession)
    links, tests, labels, made = [], [], None, [ids]

    def features(rows: DataFrame) -> DataFrame:
        """rows with their reps' features, which stay where they are: they are the bulk, and rounds need few of them."""
        return rows.join(ids, "rep").join(reps.select("same", "features").hint("merge"), "same").drop("same")

    first = F.col("band") % bands < max(1, bands // 5)
    # A few bands join most near copies; of the others, buckets within one component have nothing to add.
    for mine in (first, ~first):
        parts = reps.select("rep", "w", "bands", F.col("rep").alias("part"))
        if labels is not None:
            of = labels.select(F.col("id").alias("rep"), "label").hint("merge")
            parts = B.stored(parts.join(of, "rep", "left").select("rep", "w", "bands", F.coalesce("label", "rep").alias("part")))
            made.append(parts)
        rows = parts.select("rep", "w", "part", F.posexplode("bands").alias("band", "bucket")).where(mine).select(F.xxhash64("band", "bucket").alias("key"), "rep", "w", "part")
        more, tried = _bucket_links(rows, features, threshold, n, small)
        links, tests = links + more, tests + tried
        labels = components(functools.reduce(DataFrame.unionByName, links))
        B.settle(table.sparkSession)
    again = []
    if tests:
        again.append(crossing(functools.reduce(DataFrame.unionByName, tests), labels, features, threshold, n, small))
    of = table.where("candidate").select("doc_id", "same").join(reps.select("same", "rep"), "same").select("doc_id", "rep")
    of = B.stored(of.unionByName(table.where("not candidate").select("doc_id", F.col("doc_id").alias("rep"))))
    # the texts of a repeated doc_id are one document
    twice = of.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z")
    again.append(B.stored(of.join(twice, "doc_id").where("rep > a").select("a", F.col("rep").alias("b"))))
    if any(x.limit(1).count() for x in again):
        labels = components(functools.reduce(DataFrame.unionByName, [*links, *again]))
    B.forget(*made, *tests, *again, *links)
    of = of.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("class_id"))
    return of.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
