"""Exact top-k inner products by no-random-access aggregation over sorted lists.

For a query, every dimension is a list of the rows sorted by their contribution. A round reads all lists
from their heads: those that the query weighs most whole, the others to a share of their length. What a row
has not shown yet adds at most the frontiers of the lists that have not reached it, and at most the product
of the unseen norms of query and row (a block states its rows' norms): the less of both makes the row's upper
bound, and its lower bound follows likewise. Rows whose upper bound is under the k-th best lower bound
are out. Reading stops when ``few`` rows could still qualify, or with the last round; these are scored in full, in integers.

Rows are packed into blocks of about ``block_rows``, queries into packs of about ``query_rows``; each
query pack is sent to each block, and a task holds one block and one pack at a time. The best k of
each block meet in a top-k per query.

A component x counts as floor(256 * x). Vectors that are null or hold null or non-finite components
take no part; only vectors of equal length are compared. A repeated row is a row of its own among
candidates, a repeated query is answered once; rows with the query's own id are not its candidates. Ties go to
the smaller id. Other columns are ignored; an empty table gives no rows. Components up to 2**50 give exact scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm import _blocks as B

_PACK = "part long, dim int, kind byte, blob binary"


#: Rounds: the share of a query's weight whose lists are read whole, and how far the other lists are read.
ROUNDS = ((0.6, 1 / 8), (0.85, 1 / 4), (0.95, 1 / 2), (0.99, 1 / 2))


class Lists:
    """A block's rows as sorted lists: each dimension's values ascending, and each row's place among them."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        n = len(x)
        self.most = float(np.abs(x).max(initial=0))
        self.order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, self.order, axis=0)
        self.place = np.empty(x.shape, np.int32)
        np.put_along_axis(self.place, self.order, np.arange(n, dtype=np.int32)[:, None], axis=0)


def _heavy(weight: np.ndarray, share: float) -> np.ndarray:
    """For each query, the lists that hold ``share`` of its weight, heaviest first."""
    order = np.argsort(-weight, axis=1, kind="stable")
    upto = np.cumsum(np.take_along_axis(weight, order, axis=1), axis=1)
    need = upto - np.take_along_axis(weight, order, axis=1) < share * upto[:, -1:]
    out = np.zeros(weight.shape, bool)
    np.put_along_axis(out, order, need, axis=1)
    return out


def nra(lists: Lists, q: np.ndarray, own: np.ndarray, k: int, few: int = 64) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each query, (rows, scores, share of the list entries read) of its k best rows, without those of its own id."""
    x, (n, d) = lists.x, lists.x.shape
    most = max(lists.most, float(np.abs(q).max(initial=0)))
    peak = most * most * max(1, d)
    exact = np.int64 if peak < 2**62 else object
    real = np.float32 if peak < 2**24 else np.float64  # sums are exact in the first, rounded within ``margin`` in the second
    xf, qf = x.astype(real), q.astype(real)
    square, weight = xf * xf, qf * qf
    norm, most_, least_ = square.sum(axis=1), lists.sorted[-1].astype(real) if n else 0, lists.sorted[0].astype(real) if n else 0
    out: list = [None] * len(q)
    open_ = np.arange(len(q))

    def resolve(j: int, alive: np.ndarray, read: float) -> None:
        score = x[alive].astype(exact) @ q[j].astype(exact) if len(alive) else np.empty(0, np.int64)
        best = np.lexsort((lists.ids[alive], -score))[:k]
        out[j] = (alive[best], score[best], read)

    for share, head in ROUNDS if n > max(few, k) and d else ():
        deep = max(1, int(n * head))
        heavy = _heavy(weight[open_], share)
        whole, light = np.where(heavy, qf[open_], 0), np.where(heavy, 0, qf[open_])
        up, down = np.maximum(light, 0), np.minimum(light, 0)
        high, low = (lists.place >= n - deep).astype(real), (lists.place < deep).astype(real)  # what reading from either end has shown
        score = whole @ xf.T + up @ (xf * high).T + down @ (xf * low).T
        seen = heavy.astype(real) @ square.T + (up > 0).astype(real) @ (square * high).T + (down < 0).astype(real) @ (square * low).T
        rest = (light * light).sum(axis=1)[:, None] - (up * up) @ high.T - (down * down) @ low.T
        unseen_up, unseen_down = 1 - high.T, 1 - low.T
        over = (up * lists.sorted[n - deep].astype(real)) @ unseen_up + (down * lists.sorted[deep - 1].astype(real)) @ unseen_down
        under = (up * least_) @ unseen_up + (down * most_) @ unseen_down
        slack = np.sqrt(np.maximum(rest, 0) * np.maximum(norm[None, :] - seen, 0)).astype(np.float64) * (1 + 1e-6)
        margin = 1e-9 * peak if real is np.float64 else 1e-3
        upper, lower = score + np.minimum(over, slack) + margin, score + np.maximum(under, -slack) - margin
        mine = own[open_][:, None] == lists.ids[None, :]
        upper[mine] = lower[mine] = -np.inf
        kth = np.partition(lower, n - k, axis=1)[:, n - k]
        alive = (upper >= kth[:, None]) & ~mine
        left = alive.sum(axis=1)
        done = (left <= max(few, k)) | (share == ROUNDS[-1][0])
        lists_read = heavy.mean(axis=1) + (~heavy).mean(axis=1) * head
        for j in np.flatnonzero(done):
            resolve(int(open_[j]), np.flatnonzero(alive[j]), float(lists_read[j] + (1 - lists_read[j]) * left[j] / n))
        open_ = open_[~done]
        if not len(open_):
            break
    for j in open_:
        resolve(int(j), np.flatnonzero(lists.ids != own[j]), 1.0)
    return out


def top_k(vectors: DataFrame, query: str = "vec_id % 50 = 0", k: int = 5, block_rows: int = 2048, query_rows: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows, and ``read``: the share of its block's list entries read for it."""
    spark = vectors.sparkSession
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null").where(ok)
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(256 * x).cast("long")).alias("v"))
    rows = rows.withColumn("dim", F.size("v"))
    asks = rows.where(query).dropDuplicates(["vec_id", "v"])
    n_rows, n_asks = rows.count(), rows.where(query).count()
    blocks, packs = max(1, -(-n_rows // block_rows)), max(1, -(-n_asks // query_rows))

    def packed(df, parts, kind):
        def f(t: pa.Table) -> pa.Table:
            v = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return B.table(_PACK, [t["part"][0].as_py()], [t["dim"][0].as_py()], [kind], [B.pack(t["vec_id"].to_numpy(), v.astype(np.int64))])

        return df.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts))).groupBy("part", "dim").applyInArrow(f, _PACK)

    sent = packed(asks, packs, 1).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("part"), "dim", "kind", "blob")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = packed(rows, blocks, 0).unionByName(sent).repartition(min(n, blocks), "part", "dim").sortWithinPartitions("part", "dim", "kind")

    def search(it):
        at = lists = None
        for b in it:
            for part, dim, kind, blob in zip(*(c.to_pylist() for c in b.columns)):
                vec, v = B.unpack(blob)
                v = v.reshape(len(vec), dim)
                if kind == 0:
                    at, lists = (part, dim), Lists(v, vec)
                elif at == (part, dim):
                    hits = nra(lists, v, vec, k)
                    size = [len(r) for r, _, _ in hits]
                    yield pa.record_batch([pa.array(np.repeat(vec, size)), pa.array(np.concatenate([lists.ids[r] for r, _, _ in hits])), pa.array(np.concatenate([s for _, s, _ in hits]).astype(np.int64)), pa.array(np.repeat([x for _, _, x in hits], size))], ["query_id", "vec_id", "score", "read"])

    found = met.mapInArrow(search, "query_id long, vec_id long, score long, read double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "read")
