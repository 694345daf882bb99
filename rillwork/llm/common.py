"""What the operators of this subpackage share: staged tables, sets of keys, batch bounds."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.ship import ship

#: Rows and bytes of one Arrow batch handed to Python, the last row's bytes aside. What the work on a batch takes is some
#: 40 times its text, so both are low.
BATCH_ROWS, BATCH_BYTES = 128, 1 << 20

#: Batches after which a Python worker gives freed memory back; a long text's share would else stay with it for the task.
TRIM_EVERY = 8

#: A word, as the contracts define it.
WORD = r"[^\x20\x09-\x0D]+"

#: Bits of a set of keys (8 MB, whatever the data), and in how many parts they are put together.
KEY_BITS, KEY_PARTS = 1 << 26, 64

#: Rows and bytes of one row group where Python workers write a staged table.
GROUP_ROWS, GROUP_BYTES = 1 << 16, 8 << 20

#: Spark drops the shuffle files of a query when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_OWN: dict[str, str] = {}
#: Folders of the runs that are under way, the innermost last, and whether Python workers write their tables.
_ROOMS: list[tuple[str, bool]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset and
    all work is done on this machine, as in tests, a temporary folder stands in
    for it; on several machines that would lose rows, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="rillwork-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return f"file://{_OWN['dir']}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{_ROOMS[-1][0] if _ROOMS else shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table or a folder of them, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession, tag: str, by_workers: bool = False) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A folder for what one run stages. It is deleted at the end; what is to stay goes through the function given.

    That is one table more in the folder around it, which is the shared one for the outermost run. ``by_workers``:
    Python workers write the tables of this run, see ``settle``.
    """
    outer = fresh_path(spark, f"{tag}-result")
    _ROOMS.append((fresh_path(spark, tag), by_workers))
    try:
        yield lambda df: settle(df, tag, outer)
    finally:
        remove(spark, _ROOMS.pop()[0])


class Mapped(NamedTuple):
    """``df.mapInArrow(func, schema)`` to be staged: where a Python worker writes it, the same one runs ``func``."""

    df: DataFrame
    func: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
    schema: str


def settle(df: DataFrame | Mapped, tag: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    It cuts the lineage at a place that survives lost executors, and makes
    every later reader see the same rows in the same files. The shuffle files
    behind it are dropped once it is written.

    For each file that Spark writes to a local folder the executor's JVM starts chmod three times, and until such a
    child has its own program it shares all the memory of the JVM. In a run that asks for it, Python workers write there.
    """
    own = df.df.mapInArrow(df.func, df.schema) if isinstance(df, Mapped) else df
    spark = own.sparkSession
    path = path or fresh_path(spark, tag)
    folder = local_folder(spark, path) if _ROOMS and _ROOMS[-1][1] else None
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        if folder:
            os.makedirs(folder)
            written(df, folder).write.format("noop").mode("overwrite").save()
        else:
            own.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(own.schema).parquet(path)


def local_folder(spark: SparkSession, path: str) -> str | None:
    """Where ``path`` lies if that is a local file system, which may be mounted from elsewhere."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def written(df: DataFrame | Mapped, folder: str) -> DataFrame:
    """No rows; to run it writes ``df`` into ``folder``, a file for each task that has rows."""
    df, func, _ = df if isinstance(df, Mapped) else (df, iter, None)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        write_part(func(batches), folder, task.partitionId(), task.taskAttemptId())
        yield from ()

    return df.mapInArrow(write, "rows long")


def write_part(batches: Iterator[pa.RecordBatch], folder: str, part: int, attempt: int) -> None:
    """The file of one task. Of several attempts of it, the first that comes to its end gives the file."""
    name, own = f"{folder}/part-{part:06d}.parquet", f"{folder}/_{part:06d}.{attempt}"  # readers pass by what begins with _
    with contextlib.ExitStack() as at_end:
        at_end.callback(give_back)
        out = None
        for group in row_groups(batches):
            if out is None:
                at_end.callback(os.remove, own)
                out = at_end.enter_context(pq.ParquetWriter(own, group.schema))
            out.write_table(group)
        if out is None:
            return
        out.close()
        try:
            os.link(own, name)
        except FileExistsError:
            pass
        except OSError:  # no links there
            shutil.copyfile(own, f"{own}.copy")
            os.replace(f"{own}.copy", name)


def row_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """``batches`` put together to tables of at least GROUP_ROWS rows or GROUP_BYTES, but for the last."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= GROUP_ROWS or size >= GROUP_BYTES:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def small_batches(spark: SparkSession) -> None:
    """Before Python runs on executors: give them this package, and bound what one Arrow batch holds."""
    ship(spark)
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        own = spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("bB")
        if not own.isdigit() or not 0 < int(own) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def key_places(keys: np.ndarray) -> np.ndarray:
    """The two bits that stand for each 64-bit key."""
    keys = keys.astype(np.int64, copy=False).view(np.uint64)
    return np.stack([keys & np.uint64(KEY_BITS - 1), (keys >> np.uint64(37)) & np.uint64(KEY_BITS - 1)]).astype(np.int64)


def key_filter(keys: DataFrame) -> Broadcast:
    """The bits that ``among`` asks about ``keys`` (one long column).

    A Bloom filter of KEY_BITS bits, put together on executors, so that its size
    does not grow with the keys: with more of them it only says true more often.
    An exact join follows wherever it decides.
    """
    spark = keys.sparkSession
    small_batches(spark)
    size = KEY_BITS // 8 // KEY_PARTS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(KEY_BITS // 8, np.uint8)
        for batch in batches:
            at = key_places(batch.column(0).to_numpy(zero_copy_only=False)).reshape(-1)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        rows = bits.reshape(KEY_PARTS, size)
        some = np.flatnonzero(rows.any(axis=1))
        packed = pa.array([zlib.compress(rows[k].tobytes(), 1) for k in some], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), packed], ["part", "bits"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                own = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
                sums[r["part"]] = sums[r["part"]] | own if r["part"] in sums else own
        packed = pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), packed], ["part", "bits"])

    schema = "part long, bits binary"
    one = keys.toDF("key").filter("key is not null")
    bits = np.zeros((KEY_PARTS, size), np.uint8)
    for r in one.mapInArrow(mark, schema).repartition(KEY_PARTS, "part").mapInArrow(unite, schema).collect():  # 8 MB at most
        bits[r["part"]] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return spark.sparkContext.broadcast(bits.reshape(-1))  # KEY_BITS bits


def among(bits: np.ndarray, key: pa.Array) -> pa.Array:
    """Of 64-bit keys: false only where a key is null or not among those behind ``bits``."""
    at = key_places(pc.fill_null(key, 0).to_numpy(zero_copy_only=False))
    hit = bits[at >> 3] >> (at & 7).astype(np.uint8)
    return pc.and_(pa.array((hit[0] & hit[1] & 1).astype(bool)), pc.is_valid(key))


def may_hold(keys: DataFrame) -> Callable[[Column], Column]:
    """``among`` as a function of columns, for ``keys`` (one long column). Only the key goes to Python.

    Where the rows that pass go to Python anyway, ``among`` is to be asked there: a
    task that does both at once holds two Python workers.
    """
    held = key_filter(keys)

    @F.arrow_udf("boolean")
    def test(key: pa.Array) -> pa.Array:
        return among(held.value, key)

    return lambda key: key.isNotNull() & test(F.coalesce(key, F.lit(0)))


def give_back() -> None:
    """Return to the system what a Python worker has freed; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``; before every TRIM_EVERY-th of them and behind the last, memory that is free again goes back to the system."""
    for k, batch in enumerate(batches):
        if k % TRIM_EVERY == 0:
            give_back()
        yield batch
    give_back()  # the worker may have nothing to do for long


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def place_of(df: DataFrame, name: str) -> int:
    """Where the column of that name stands: by its exact name, else by its name in another case."""
    names = df.columns
    return names.index(name) if name in names else [n.lower() for n in names].index(name.lower())


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1 and so on, so that no name of the user's disturbs."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, whatever else the others are called."""
    return numbered(df).select(*[F.col(f"c{place_of(df, n)}").alias(n) for n in names])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
