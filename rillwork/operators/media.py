"""Routing of packets, choice of streams, and decoding down to presentation times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def route(packets: DataFrame, video: int | None = None, audio: int | None = None) -> DataFrame:
    """Packets of the linked streams with ``route``; audio is asked first, packets of no linked stream are dropped."""
    where: Column = F.lit(None).cast("string")
    if video is not None:
        where = F.when(F.col("stream_index") == video, "video").otherwise(where)
    if audio is not None:
        where = F.when(F.col("stream_index") == audio, "audio").otherwise(where)
    return packets.withColumn("route", where).filter(F.col("route").isNotNull())


def best_stream(streams: DataFrame, packets: DataFrame) -> DataFrame:
    """Of each source and media type the stream with most packets, the lowest index first."""
    counts = packets.groupBy("source_id", "stream_index").agg(F.count("*").alias("n_packets"))
    own = streams.join(counts, ["source_id", "stream_index"], "left").fillna(0, ["n_packets"])
    rank = F.row_number().over(
        Window.partitionBy("source_id", "media_type").orderBy(F.desc("n_packets"), "stream_index")
    )
    return own.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def decode(packets: DataFrame, *streams: int, delay: int = 0, flush: bool = True) -> DataFrame:
    """Frames (source_id, stream_index, frame_no, pts) in the order of presentation.

    Only the given streams are decoded. A decoder that holds back ``delay``
    frames to put them in order loses the last ones unless it is flushed.

    Packets are dealt by ranges of (source, stream, pts), so a long stream lies in
    many tasks; a table of counts, a row for each task and stream, says how many
    frames come before each task's.
    """
    own = packets.filter(F.col("stream_index").isin(*streams)) if streams else packets
    place, stream = ["source_id", "stream_index", "pts", "packet_no"], ["source_id", "stream_index"]
    tasks = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.select(*place).repartitionByRange(tasks, *place).sortWithinPartitions(*place)
    dealt = dealt.withColumn("_m", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_m", 33))
    counts = dealt.groupBy(*stream, "_task").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    whole = Window.partitionBy(*stream)
    before = F.sum("_n").over(whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select(
        F.col("source_id").alias("_source"),
        F.col("stream_index").alias("_stream"),
        F.col("_task").alias("_of"),
        (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_base"),
        F.sum("_n").over(whole).alias("_total"),
    )
    same = [
        F.col("_task") == F.col("_of"),
        F.col("source_id").eqNullSafe(F.col("_source")),
        F.col("stream_index").eqNullSafe(F.col("_stream")),
    ]
    frames = dealt.join(bases, same).withColumn("frame_no", F.col("_m") + F.col("_base"))
    if not flush:
        frames = frames.filter(F.col("frame_no") < F.col("_total") - delay)
    return frames.select(*stream, "frame_no", "pts")
