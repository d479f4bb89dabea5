"""What the corpus operators share: scratch tables, safe broadcasts, Arrow text buffers, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a checked table is sent to every executor.
BROADCAST_ROWS = 20_000

#: A word: a maximal run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """A fresh folder name in the shared folder of ``spark.checkpoint.dir``.

    Only where the session has none (tests, one machine) a temporary folder is made and removed at exit.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tracegraph-")
        atexit.register(shutil.rmtree, base[len("file://") :], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as double underscores) that hold for the block."""
    before = {k: spark.conf.get(k.replace("__", "."), None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k.replace("__", "."), v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k.replace("__", "."))
            else:
                spark.conf.set(k.replace("__", "."), v)


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, so that its lineage ends there; Spark drops the shuffle files of the write as it ends."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``cut`` that no later step reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def carried(docs: DataFrame, **columns: str) -> DataFrame:
    """The given columns under new names, and all others as one column ``row``, so that columns of any name may be added beside it."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in columns.values()]
    return docs.select(F.struct(*(others or [F.lit(0).alias("none")])).alias("row"), *[F.col(f"`{c}`").alias(n) for n, c in columns.items()])


def restored(rows: DataFrame, docs: DataFrame, columns: dict[str, str], new: Iterable[str | Column] = ()) -> DataFrame:
    """The columns of ``docs`` in their order, after ``carried`` with the same ``columns``, then ``new`` ones, which replace any of their names."""
    added = rows.select(*new).columns if new else []
    held = {c: n for n, c in columns.items()}
    return rows.select(*[(F.col(held[c]) if c in held else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c not in added], *new)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks ``df`` for broadcast if a count shows that it holds at most ``limit`` rows; else leaves the join to Spark."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; at the end of a task the worker, which lives on, gives unused memory back."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim_heap()

    return tidied


def trim_heap() -> None:
    """Returns what the C allocator holds free to the system, where it can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and the n + 1 offsets of its rows, without copying texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_binary())
    _, at, data = col.buffers()
    offsets = np.frombuffer(at, np.int64)[col.offset : col.offset + len(col) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, most: int = 1 << 21):
    """Row ranges (i, j) that hold about ``most`` bytes each; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public SplitMix64 constants), so that sums of near values differ widely."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Powers of two of the bits of a filter, the least and the most: 8 to 32 MB that every executor gets.
FILTER_BITS = (26, 28)


def bit_table(keys: DataFrame, bits: tuple[int, int] = FILTER_BITS) -> np.ndarray:
    """A table of bits, set at the low bits of each of ``keys`` (key long, well mixed, a written table): a filter of 16 bits a key or more within the powers of two ``bits``.

    It has no false negatives; one key in 16 at most passes falsely while there are fewer than 2 ** (most - 4) keys, and more as it fills up beyond that, which
    costs work and never a result. At most 2 ** (most - 5) rows come to the driver.
    """
    size = min(max(bits[0], (16 * keys.count()).bit_length()), bits[1])
    low = f"(key & {(1 << size) - 1}L)"
    found = keys.groupBy(F.expr(f"shiftright({low}, 5)").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast({low} & 31 as int)))").alias("v")).toPandas()
    table = np.zeros(1 << (size - 5), np.uint32)
    table[found.w.to_numpy(np.int64)] = found.v.to_numpy(np.int64).astype(np.uint32)
    return table


def has_bit(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the (unsigned or signed 64-bit) ``keys`` are set in ``table``."""
    low = keys.view(np.uint64) & np.uint64(len(table) * 32 - 1)
    return (table[(low >> np.uint64(5)).astype(np.int64)] >> (low & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def components(vertices: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest id reachable over ``edges`` (a, b) for each row of ``vertices`` (id): columns id, component.

    Large-star and small-star steps in turn until the edge set stands still, which takes a number of rounds that grows with the logarithm of
    the longest path (an error after ``rounds``, beyond any table's size); each step is one aggregation and one join whose
    skew Spark may split, and the edges of each round are written to the shared folder.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    stamp = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    last = None
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct())
        now = e.agg(stamp.alias("s")).first().s
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    root = e.groupBy("u").agg(F.min("v").alias("m"))
    return vertices.join(root, vertices.id == root.u, "left").select("id", F.coalesce("m", "id").alias("component"))
