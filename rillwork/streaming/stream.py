"""Streaming sources and sinks."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rillwork.schemas import PACKET
from rillwork.ship import ship
from rillwork.sources.basic import DEFAULT_TEXT

FRAMES = "source_id string, stream_index int, frame_no long, pts long"


class VectorStream(DataSource):
    """A list of texts as a stream that gives one datum a micro-batch: one step of the pipeline."""

    @classmethod
    def name(cls) -> str:
        return "rillwork_vector"

    def schema(self) -> str:
        return "seq long, text string"

    def simpleStreamReader(self, schema):
        return VectorReader(json.loads(self.options["texts"]))


class VectorReader(SimpleDataSourceStreamReader):
    def __init__(self, texts: list[str]):
        self.texts = texts

    def initialOffset(self):
        return {"seq": 0}

    def read(self, start):
        at = start["seq"]
        rows = [(at, self.texts[at])] if at < len(self.texts) else []
        return iter(rows), {"seq": at + len(rows)}

    def readBetweenOffsets(self, start, end):
        return iter([(k, self.texts[k]) for k in range(start["seq"], end["seq"])])


def vector_stream(spark: SparkSession, texts: list[str]) -> DataFrame:
    ship(spark)
    # the process that plans a stream does not look into shipped files, so the classes travel whole
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(VectorStream)
    return spark.readStream.format("rillwork_vector").option("texts", json.dumps(texts)).load()


def constant_text_stream(spark: SparkSession, text: str = DEFAULT_TEXT, rows: int = 1) -> DataFrame:
    """One text without end, ``rows`` of it a micro-batch."""
    own = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows).load()
    return own.select(F.col("value").alias("seq"), F.lit(text).alias("text"))


def packet_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Packet relations written as Parquet to a folder, ``files`` a micro-batch."""
    return spark.readStream.schema(PACKET).option("maxFilesPerTrigger", files).parquet(path)


def fan_out(stream: DataFrame, branches: list[Callable[[DataFrame], None]], checkpoint: str):
    """Start a query that reads each micro-batch once and hands it to every branch."""

    def each(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            for branch in branches:
                branch(batch)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def print_stream(stream: DataFrame, checkpoint: str, out=None):
    """Start a query that writes the texts of each micro-batch in order."""

    def show(batch: DataFrame, _: int) -> None:
        batch.persist()  # sorting would read the source twice
        try:
            for r in batch.orderBy("seq").select("text").toLocalIterator():
                (out or sys.stdout).write(r[0] or "")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(show).option("checkpointLocation", checkpoint).start()


def decode_stream(packets: DataFrame, delay: int = 0) -> DataFrame:
    """Frames of each (source, stream) in presentation order.

    The state of a stream is the number of frames given so far and at most
    ``delay`` times that are held back to be put in order; like a decoder that is
    not flushed, it keeps the last ones.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        given, held = state.get if state.exists else (0, "[]")
        waiting = json.loads(held)
        for batch in batches:
            waiting += batch["pts"].tolist()
        waiting.sort()
        ready = waiting[: max(0, len(waiting) - delay)]
        state.update((given + len(ready), json.dumps(waiting[len(ready) :])))
        numbers = range(given, given + len(ready))
        yield pd.DataFrame({"source_id": key[0], "stream_index": key[1], "frame_no": list(numbers), "pts": ready})

    return packets.groupBy("source_id", "stream_index").applyInPandasWithState(
        step, FRAMES, "given long, held string", "append", GroupStateTimeout.NoTimeout
    )
