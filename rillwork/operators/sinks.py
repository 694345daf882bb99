"""Sinks: ordered text on the console, callbacks, counters."""

from __future__ import annotations

import logging
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

log = logging.getLogger("rillwork.sinks")


def print_text(df: DataFrame, order: str = "seq", out=None) -> int:
    """Write the texts in order, with nothing put between them. Rows come to the driver a partition at a time."""
    out, n = out or sys.stdout, 0
    for r in df.orderBy(order).select("text").toLocalIterator():
        out.write(r[0] or "")
        n += 1
    log.info("printed %d texts", n)
    return n


def joined_text(df: DataFrame, *keys: str) -> DataFrame:
    """All that the console would show of each source, as one text."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))


def call_back(df: DataFrame, on_data: Callable[[int, Row], bool], order: str = "seq") -> int:
    """Call ``on_data`` with a counter from 0 and each row in order, until it returns false.

    Returns how many rows were accepted.
    """
    n = 0
    for row in df.orderBy(order).toLocalIterator():
        if not on_data(n, row):
            break
        n += 1
    return n


def count_data(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("data_count"))
