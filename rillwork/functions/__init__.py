"""Column functions: chunks, UTF-8, URIs, codec names. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_BYTES = 8192

# Encoder library of each codec.
CODECS = {"H264": "libx264", "H265": "libx265", "Opus": "libopus"}


def chunk_indices(data: Column, size: int = CHUNK_BYTES, keep_empty: bool = False) -> Column:
    """0 .. ceil(length / size) - 1; for empty and null data no index, or 0 alone with ``keep_empty``."""
    n = F.octet_length(data)
    last = F.floor((n - 1) / size).cast("int")
    none = F.array(F.lit(0)) if keep_empty else F.array().cast("array<int>")
    return F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(none)


def chunk_at(data: Column, index: Column, size: int = CHUNK_BYTES) -> Column:
    return F.substring(data, index * size + 1, F.lit(size))


def utf8_or_null(data: Column) -> Column:
    """Text of valid UTF-8 bytes, else null."""
    return F.try_validate_utf8(data.cast("string"))


def file_uri(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def codec_library(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in CODECS.items() for x in pair]), name)
