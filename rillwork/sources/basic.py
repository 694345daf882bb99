"""Text, vector and file sources."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.functions import CHUNK_BYTES, chunk_at, chunk_indices
from rillwork.schemas import DATAGRAM
from rillwork.ship import shared_folder, ship

DEFAULT_TEXT = "Test\n"
KINDS = ("message", "text", "bytes")


def constant_text(spark: SparkSession, n: int, text: str = DEFAULT_TEXT) -> DataFrame:
    """``n`` rows of one text. The endless form is ``streaming.constant_text_stream``."""
    return spark.range(n).select(F.col("id").alias("seq"), F.lit(text).alias("text"))


def vector(spark: SparkSession, datagrams: Iterable[tuple[str, object]]) -> DataFrame:
    """Replay (kind, value) pairs in order; kind is message, text or bytes."""
    rows = []
    for seq, (kind, value) in enumerate(datagrams):
        if kind not in KINDS:
            raise ValueError(f"no such kind of datagram: {kind}")
        rows.append((seq, kind, *[value if kind == k else None for k in KINDS]))
    return spark.createDataFrame(rows, DATAGRAM)


def vector_rows(df: DataFrame, kind: Column, value: Column, *order: str) -> DataFrame:
    """Replay the rows of ``df`` in order as (seq, kind, text), numbered from 0 without holding them in one task.

    Rows are dealt by ranges of ``order``, which should be unique; a table of counts,
    a row for each task, says how many come before each task's. The dealt rows are
    written to the shared folder first: ranges come from a sample, and a second
    plan over the same rows draws another, so counts would be those of other ranges.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = df.select(*order, kind.alias("_kind"), value.alias("_value"))
    in_order = own.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    in_order = in_order.select("_m", *[F.col(c).cast("string") if t == "void" else c for c, t in own.dtypes[-2:]])
    folder = shared_folder(spark, "vector")
    in_order.write.parquet(folder)
    dealt = spark.read.schema(in_order.schema).parquet(folder).withColumn("_task", F.shiftright("_m", 33))
    counts = dealt.groupBy("_task").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))  # a row for each task
    bases = counts.select("_task", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_base"))
    seq = (F.col("_m") + F.col("_base")).alias("seq")
    return dealt.join(F.broadcast(bases), "_task").select(seq, F.col("_kind").alias("kind"), F.col("_value").alias("text"))


def chunk_column(df: DataFrame, data: Column, *keys: str, size: int = CHUNK_BYTES, keep_empty: bool = False) -> DataFrame:
    """One row for each chunk of ``data``: the keys, seq and chunk.

    Data without bytes has no chunk, or itself as the only one with ``keep_empty``.
    """
    indices = chunk_indices(F.col("_data"), size, keep_empty)
    indexed = df.select(*keys, data.alias("_data")).select("*", F.explode(indices).alias("_i"))
    return indexed.select(*keys, F.col("_i").cast("long").alias("seq"), chunk_at(F.col("_data"), F.col("_i"), size).alias("chunk"))


def file_chunks(spark: SparkSession, path: str, size: int = CHUNK_BYTES) -> DataFrame:
    """Bytes of files in chunks, as a buffered reader returns them; empty files have none.

    A file is one row of the scan, so it must be under 2 GB; ``ranged_chunks`` has no such bound.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_id"), "content")
    return chunk_column(files, F.col("content"), "source_id", size=size)


def ranged_chunks(spark: SparkSession, *uris: str, size: int = CHUNK_BYTES, chunks: int = 8192) -> DataFrame:
    """Bytes of files of any size in chunks: a task reads ``chunks`` of them from its place on."""
    from rillwork.sources.ranges import ChunkSource

    ship(spark)
    spark.dataSource.register(ChunkSource)
    options = {"uris": json.dumps(uris), "size": str(size), "chunks": str(chunks)}
    return spark.read.format("rillwork_chunks").options(**options).load()
