"""Blocks: how these operators exchange facts about texts without shuffling one row per word.

A *block* is a run of neighbouring documents of one input partition, at most ``BLOCK_BYTES`` of
text. A block reduces its own texts to distinct keys (words, lines, fingerprints), splits them by
owner and sends one packed row per owner; owners answer with one packed row per block. The texts
travel once, as one compressed row per block, to the task that also receives the answers. A key
that fills a third of all rows therefore reaches its owner once per block, not once per row, and
nothing is ever gathered by key on the driver.

``deal`` and ``meet`` wire this up as one plan. Both kinds of row are dealt by one column ``k`` in one
exchange, which Spark runs once and reads twice (once to answer, once to finish).
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Most text bytes of one block; a longer single document is a block of its own.
BLOCK_BYTES = 24 << 20
#: Input bytes per owner of keys, at most: what an owner gathers doesn't grow with the data.
OWNER_BYTES = 32 << 20
#: Bytes of one Arrow batch of texts, where the session has left that open.
BATCH_BYTES = 8 << 20
ROW = "k long, kind byte, block long, check long, blob binary"
_KEY = pa.schema([("k", pa.int64()), ("kind", pa.int8()), ("block", pa.int64()), ("check", pa.int64()), ("blob", pa.binary())])
_ANSWER = "block long, part long, check long, blob binary"
TEXTS, KEYS = 0, 1


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as one zstd blob; integers are split into byte planes, which compress well."""
    out = []
    for a in arrays:
        if isinstance(a, bytes):
            kind, raw, n = "bytes", a, len(a)
        else:
            kind, n = a.dtype.str, len(a)
            raw = np.ascontiguousarray(a).view(np.uint8).reshape(n, a.dtype.itemsize).T.tobytes() if n else b""
        head = kind.encode().ljust(8) + int(n).to_bytes(8, "little") + len(raw).to_bytes(8, "little")
        out += [head, raw]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        kind, n, size = data[at : at + 8].decode().strip(), int.from_bytes(data[at + 8 : at + 16], "little"), int.from_bytes(data[at + 16 : at + 24], "little")
        raw = data[at + 24 : at + 24 + size]
        at += 24 + size
        if kind == "bytes":
            out.append(raw)
        else:
            t = np.dtype(kind)
            out.append(np.frombuffer(raw, np.uint8).reshape(t.itemsize, n).T.copy().view(t).reshape(n) if n else np.empty(0, t))
    return out


def pack_sorted(a: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit integers as differences: few bytes each when there are many."""
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob)[0], dtype=np.uint64)


def pack_texts(ids: pa.Array, texts: pa.Array, *carried: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([ids, texts, *carried], ["doc_id", "text", "carried"][: 2 + len(carried)])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_texts(blob: bytes) -> tuple[pa.Array, ...]:
    return tuple(pa.ipc.open_stream(blob).read_next_batch().columns)


def offsets_of(a: pa.Array) -> np.ndarray:
    """Value offsets of a string, binary or list array, from its first value."""
    width = np.int64 if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) or pa.types.is_large_list(a.type) else np.int32
    return np.frombuffer(a.buffers()[1], width)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, width)


def text_slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Array, ...]]:
    """(doc_id, text) arrays of at most ``limit`` bytes, with any further columns; null texts count as empty."""
    for b in batches:
        trim()
        ids, texts = b.column(0), pc.fill_null(b.column(1).cast(pa.string()), "")
        n, i = len(ids), 0
        off = offsets_of(texts).astype(np.int64)
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
            yield ids[i:j], pa.concat_arrays([texts[i:j]]), *(c[i:j] for c in b.columns[2:])
            i = j


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files and local rows that df is made from, as its plan states them; 0 for those it can't."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def owners_of(docs: DataFrame) -> int:
    """How many owners the keys of docs are dealt to: by the session's partitions, and more where the input needs them."""
    return max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs) // OWNER_BYTES))


try:
    _malloc_trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not glibc

    def _malloc_trim(_):
        return 0


def trim() -> None:
    """Give freed memory back: workers live from stage to stage, and what one block needed would stay with them."""
    pa.default_memory_pool().release_unused()
    _malloc_trim(0)


def settle(spark: SparkSession) -> None:
    """Give the driver's memory back between steps, and let Spark delete the shuffle files of plans that are no longer held: it does so for what a collection of garbage finds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim()


def modest(spark: SparkSession) -> None:
    """Arrow batches of texts by bytes: ten thousand long texts at once are far more than a block."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if int(spark.conf.get(key)) > BATCH_BYTES:
            spark.conf.set(key, BATCH_BYTES)
    except Exception:  # noqa: BLE001 a Spark without this setting counts rows only
        return


def plain_columns() -> list:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]


def deal(docs: DataFrame, keys: Callable, limit: int = BLOCK_BYTES, carry: tuple = ()) -> DataFrame:
    """Rows of blocks: each block's texts, and what it asks the owners of its keys.

    keys(ids, texts, owners) -> (list of (owner, blob), fingerprint int): the block's distinct keys.
    carry: at most one more column, to travel with the texts.
    """
    owners = owners_of(docs)
    modest(docs.sparkSession)

    def send(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for ids, texts, *carried in text_slices(batches, limit):
            block = (part << 24) + seq
            seq += 1
            parts, check = keys(ids, texts, owners)
            yield rows_of(block, check, pack_texts(ids, texts, *carried), parts).to_batches()[0]

    return docs.select(*plain_columns(), *carry).mapInArrow(send, ROW)


def rows_of(block: int, check: int, texts: bytes, parts: list[tuple[int, bytes]]) -> pa.Table:
    """A block's row of texts and its rows of keys; the texts are dealt by the block's number."""
    n = len(parts)
    return pa.table([pa.array(x, t.type) for x, t in zip([[block, *(p for p, _ in parts)], [TEXTS] + [KEYS] * n, [block] * (n + 1), [check] * (n + 1), [texts, *(b for _, b in parts)]], _KEY)], schema=_KEY)


def meet(rows: DataFrame, owners: int, answer: Callable, finish: Callable, schema: str, facts: DataFrame | None = None) -> DataFrame:
    """Let the owners answer the keys of rows from deal() and finish each block with their answers.

    answer(list of (block, blob)) -> list of (block, blob): of one owner, in the same order of keys.
    finish(blob of texts, {owner: blob}, owners, block, fingerprint) -> pa.Table: the block's rows.
    facts: what owners know besides, by owner in column ``k``; then answer gets that table too.
    The fingerprint is compared at the end: should an unstable input have been read twice with
    different rows, the job stops rather than return wrong rows.
    """
    n = owners
    empty = to_arrow_schema(T.StructType.fromDDL(schema)).empty_table()

    def reply(t: pa.Table, *known: pa.Table) -> pa.Table:
        t = t.filter(pc.equal(t["kind"], KEYS))
        trim()
        block, check = t["block"].to_pylist(), dict(zip(t["block"].to_pylist(), t["check"].to_pylist()))
        out = list(answer(list(zip(block, t["blob"].to_pylist())), *known)) if block else []
        k = t["k"][0].as_py() if block else 0
        return pa.table([pa.array([b for b, _ in out], pa.int64()), pa.array([k] * len(out), pa.int64()), pa.array([check[b] for b, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["block", "part", "check", "blob"])

    def end(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.filter(pc.equal(left["kind"], TEXTS))
        if not len(left):
            return empty
        trim()
        check = left["check"][0].as_py()
        if len(left) > 1 or set(right["check"].to_pylist()) - {check}:
            raise RuntimeError("the input gave other rows when it was read again; write it to a table first")
        return finish(left["blob"][0].as_py(), dict(zip(right["part"].to_pylist(), right["blob"].to_pylist())), owners, left["block"][0].as_py(), check)

    dealt = rows.repartition(n, "k")
    asked = dealt.groupBy("k")
    if facts is None:
        replies = asked.applyInArrow(lambda t: reply(t), _ANSWER)
    else:
        replies = asked.cogroup(facts.repartition(n, "k").groupBy("k")).applyInArrow(lambda t, f: reply(t, f), _ANSWER)
    return dealt.groupBy("k").cogroup(replies.repartition(n, "block").groupBy("block")).applyInArrow(end, schema)


def exchange(docs: DataFrame, keys: Callable, answer: Callable, finish: Callable, schema: str, limit: int = BLOCK_BYTES, facts: DataFrame | None = None) -> DataFrame:
    """deal() and meet(), with finish(ids, texts, {owner: blob}, owners, block)."""

    def end(blob, answers, owners, block, _check):
        return finish(*unpack_texts(blob), answers, owners, block)

    return meet(deal(docs, keys, limit), owners_of(docs), answer, end, schema, facts)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "byte": pa.int8(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


@functools.lru_cache(64)
def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a plain list of columns; executors have no session to parse it."""
    return pa.schema([(n, _TYPES[t]) for n, t in (c.split(" ") for c in ddl.split(", "))])


def table(schema: str, *columns) -> pa.Table:
    s = arrow_schema(schema)
    return pa.table([c if isinstance(c, (pa.Array, pa.ChunkedArray)) and c.type == f.type else pa.array(c, f.type) for c, f in zip(columns, s)], schema=s)


_made: dict[str, SparkSession] = {}
_tables: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder of this application below spark.checkpoint.dir. Only a local master may do without that setting (tests): then below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame, *partition: str) -> DataFrame:
    """df, written to the shared folder and read again: computed once, safe from lost executors. forget() deletes it, or the end of the driver."""
    spark = df.sparkSession
    path = shared_dir(spark)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition) if partition else w).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _made[path] = spark
    return out


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """stored(), dealt by ``key`` into buckets that joins on it read in place: only the other side is shuffled."""
    spark = df.sparkSession
    path, name = shared_dir(spark), f"bucketed_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(name)
    out = spark.table(name)
    out.stored_at = path
    _made[path] = spark
    _tables[path] = name
    return out


def _delete(path: str) -> None:
    spark = _made.pop(path, None)
    if spark is not None and path in _tables and spark.sparkContext._jsc is not None:
        spark.sql(f"drop table if exists {_tables.pop(path)}")
    if spark is not None and spark.sparkContext._jsc is not None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(*tables: DataFrame | None) -> None:
    """Delete tables of stored() that no later plan reads."""
    for t in tables:
        if t is not None and (path := getattr(t, "stored_at", None)):
            _delete(path)


def forget_since(mark: set[str], *but: DataFrame) -> None:
    """Delete what stored() has made since ``mark`` = made(), but for these tables."""
    for path in set(_made) - mark - {getattr(t, "stored_at", None) for t in but}:
        _delete(path)


def made() -> set[str]:
    return set(_made)


@atexit.register
def _clear() -> None:
    for path in list(_made):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001 the JVM may be gone already
            return


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def total(parts: DataFrame, shards: int) -> list[np.ndarray]:
    """Sums of float vectors that many tasks made, each cut into ``shards`` rows (shard long, blob binary).

    The rows of a shard are added one after another, so memory doesn't grow with the tasks; only
    one row per shard reaches the driver.
    """

    def add(it):
        sums: dict[int, np.ndarray] = {}
        for b in it:
            for s, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = unpack(blob)[0]
                sums[s] = sums[s] + v if s in sums else v.astype(np.float64)
        for s, v in sums.items():
            yield pa.record_batch([pa.array([s]), pa.array([pack(v)], pa.binary())], ["shard", "blob"])

    n = min(shards, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    got = dict(parts.repartition(n, "shard").mapInArrow(add, "shard long, blob binary").collect())
    return [unpack(bytes(got[s]))[0] if s in got else np.zeros(0) for s in range(shards)]


def shards_of(v: np.ndarray, shards: int):
    """One record batch of a vector's rows for total()."""
    cut = np.array_split(v, shards)
    return pa.record_batch([pa.array(range(shards), pa.int64()), pa.array([pack(c) for c in cut], pa.binary())], ["shard", "blob"])
