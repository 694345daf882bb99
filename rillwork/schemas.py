"""Schemas of the relations that stages pass on. Rows carry their order in a column; Spark keeps none."""

from pyspark.sql import types as T

TEXT = T.StructType().add("source_id", "string").add("seq", "long", False).add("text", "string")
BYTES = T.StructType().add("source_id", "string").add("seq", "long", False).add("chunk", "binary")
PACKET = (
    T.StructType()
    .add("source_id", "string")
    .add("packet_no", "long")
    .add("stream_index", "integer")
    .add("pts", "long")
    .add("dts", "long")
    .add("payload", "binary")
)
STREAM = (
    T.StructType()
    .add("source_id", "string")
    .add("stream_index", "integer")
    .add("media_type", "string")
    .add("codec_id", "string")
    .add("params", T.MapType(T.StringType(), T.StringType()))
)
FRAME = T.StructType().add("source_id", "string").add("stream_index", "integer").add("frame_no", "long").add("pts", "long")
DATAGRAM = (
    T.StructType()
    .add("seq", "long", False)
    .add("kind", "string", False)
    .add("message", "string")
    .add("text", "string")
    .add("bytes", "binary")
)
