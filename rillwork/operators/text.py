"""Conversion of bytes to text, early stop, limits, and the guard on mixed streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.functions import utf8_or_null


def take_while(df: DataFrame, ok: Column, order: str, *keys: str) -> DataFrame:
    """Rows of each source before the first for which ``ok`` is not true.

    The stop is one number for each source that has one: it is aggregated with
    partial minima on the way and joined, so no source is held by one task.
    """
    failed = df.filter(~F.coalesce(ok, F.lit(False)))
    if not keys:
        stops = failed.agg(F.min(order).alias("_stop"))
        joined = df.crossJoin(F.broadcast(stops))  # one row
    else:
        stops = failed.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.min(order).alias("_stop"))
        same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
        joined = df.join(stops, same, "left").drop(*[f"_of_{k}" for k in keys])
    return joined.filter(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")


def bytes_to_text(df: DataFrame, *keys: str, mode: str = "strict") -> DataFrame:
    """Chunks (keys, seq, chunk) as text (keys, seq, text).

    ``strict``: each chunk must be valid UTF-8 by itself; a source ends at its
    first chunk that is not. ``whole``: a source's chunks are joined first, so a
    character may lie across two of them; invalid sources give no row.
    """
    if mode == "strict":
        texts = df.select(*keys, "seq", utf8_or_null(F.col("chunk")).alias("text"))
        return take_while(texts, F.col("text").isNotNull(), "seq", *keys)
    if mode != "whole":
        raise ValueError(f"no such mode: {mode}")
    whole = df.groupBy(*keys).agg(F.expr("listagg(chunk) within group (order by seq)").alias("_data"))
    texts = whole.select(*keys, F.lit(0).cast("long").alias("seq"), utf8_or_null(F.col("_data")).alias("text"))
    return texts.filter(F.col("text").isNotNull())


def limit_then(df: DataFrame, n: int, order: str, then: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The first ``n`` rows that the source gives, and only then what follows."""
    return then(df.orderBy(order).limit(n))


def texts_of(datagrams: DataFrame) -> DataFrame:
    """Texts of a mixed stream; it ends in an error at data of another kind, and at a Quit without one."""
    quit_at = datagrams.filter("kind = 'message' and message = 'Quit'").agg(F.min("seq").alias("_quit"))
    own = datagrams.crossJoin(F.broadcast(quit_at)).filter(F.col("_quit").isNull() | (F.col("seq") < F.col("_quit")))
    wrong = F.when(F.col("kind") != "text", F.raise_error(F.lit("Received invalid datagram from parent")))
    return own.select("seq", F.coalesce(wrong.cast("string"), F.col("text")).alias("text"))
