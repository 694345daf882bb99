"""The stages: each is a DataFrame, a function of one, or what becomes of one.

Stages are linked as a tree and checked at that moment. Linking an output again
replaces what was behind it. New operators are ``Transform`` with a function.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from typing import ClassVar

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rillwork import operators, sources
from rillwork.errors import InvalidSinkType, MediaError, NoSinkElement
from rillwork.plans.ports import AUDIO_IN, BYTES_IN, TEXT_IN, VIDEO_IN, Format, Port, compatible
from rillwork.sources.basic import DEFAULT_TEXT


class Stage:
    """``taken``: the input, None for a source. ``outputs``: what each output asks for."""

    taken: Port | None = None
    order = "seq"
    log = logging.getLogger("rillwork.Stage")
    #: all kinds of stages by name, the user's too
    kinds: ClassVar[dict[str, type[Stage]]] = {}

    def __init_subclass__(cls, **options) -> None:
        """A new kind of stage is registered and gets a logger of its own."""
        super().__init_subclass__(**options)
        Stage.kinds[cls.__name__] = cls
        cls.log = logging.getLogger(f"rillwork.{cls.__name__}")

    def __init__(self) -> None:
        self.outputs: dict[str, Port] = {}
        self.children: dict[str, Stage] = {}

    def link(self, child: Stage, output: str = "out") -> Stage:
        if not compatible(self.outputs.get(output), child.taken):
            raise InvalidSinkType(f"{type(child).__name__} behind {type(self).__name__}.{output}")
        self.children[output] = child
        return self

    def child(self, output: str = "out") -> Stage:
        if output not in self.children:
            raise NoSinkElement(f"{type(self).__name__}.{output}")
        return self.children[output]

    def read(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} is no source")

    def apply(self, df: DataFrame) -> DataFrame:
        """What goes on to the child of a stage with one output."""
        return df

    def branch(self, df: DataFrame, output: str) -> DataFrame:
        return df

    def consume(self, df: DataFrame) -> None:
        """What a stage without a child does with its rows."""

    def failed_at(self, df: DataFrame) -> int | None:
        """The place at which the stage stops on ``df``, if it does."""
        return None

    def cleanup(self) -> None:
        """What is to be done when the pipeline closes."""


class TextSource(Stage):
    """One text, again and again; ``n`` times in a batch run."""

    def __init__(self, text: str = DEFAULT_TEXT, n: int = 1):
        super().__init__()
        self.text, self.n, self.outputs = text, n, {"out": TEXT_IN}

    def read(self, spark: SparkSession) -> DataFrame:
        return sources.constant_text(spark, self.n, self.text)


class FileSource(Stage):
    """One file in chunks."""

    def __init__(self, path: str, size: int = sources.basic.CHUNK_BYTES):
        super().__init__()
        self.path, self.size, self.outputs = path, size, {"out": BYTES_IN}

    def read(self, spark: SparkSession) -> DataFrame:
        return sources.file_chunks(spark, self.path, self.size)


class TestSource(Stage):
    """A vector of datagrams; the caller says what its output asks for."""

    __test__ = False

    def __init__(self, output: Port, datagrams: list[tuple[str, object]]):
        super().__init__()
        self.datagrams, self.outputs = datagrams, {"out": output}

    def read(self, spark: SparkSession) -> DataFrame:
        return sources.vector(spark, self.datagrams)


class MediaSplit(Stage):
    """Packets of a container, to the video and the audio stage; either may be missing."""

    order = "packet_no"

    def __init__(self, path: str):
        super().__init__()
        self.path, self.outputs = path, {"video": VIDEO_IN, "audio": AUDIO_IN}
        self.index: dict[str, int] = {}

    def link_stream(self, child: Decoder, output: str) -> Stage:
        self.index[output] = child.stream_index
        return self.link(child, output)

    def read(self, spark: SparkSession) -> DataFrame:
        return sources.media_packets(spark, self.path)

    def branch(self, df: DataFrame, output: str) -> DataFrame:
        return operators.route(df, self.index.get("video"), self.index.get("audio")).filter(F.col("route") == output).drop("route")


class BytesToText(Stage):
    taken = BYTES_IN

    def __init__(self, mode: str = "strict"):
        super().__init__()
        self.mode, self.outputs = mode, {"out": TEXT_IN}

    def _bytes(self, df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("bytes", "chunk") if "bytes" in df.columns else df

    def apply(self, df: DataFrame) -> DataFrame:
        return operators.bytes_to_text(self._bytes(df), *[c for c in ("source_id",) if c in df.columns], mode=self.mode)

    def failed_at(self, df: DataFrame) -> int | None:
        if self.mode != "strict":
            return None
        wrong = self._bytes(df).filter(F.try_validate_utf8(F.col("chunk").cast("string")).isNull())
        return wrong.agg(F.min("seq")).first()[0]


# Codecs whose packets this engine puts in order, besides all that begin with pcm_.
CODECS = ("avc1", "hvc1", "hev1", "mp4a", "mp4v", "Opus", "H264", "MJPG", "DIB", "text")


class Decoder(Stage):
    """Packets of one stream as frames; ``media`` is video or audio. ``of`` looks the stream's codec up first."""

    order = "frame_no"

    def __init__(self, stream_index: int, media: str, delay: int = 0, flush: bool = True):
        super().__init__()
        self.stream_index, self.delay, self.flush = stream_index, delay, flush
        self.taken = {"video": VIDEO_IN, "audio": AUDIO_IN}[media]
        self.outputs = {"out": TEXT_IN}
        self.frames: list[Row] = []

    @classmethod
    def of(cls, streams: DataFrame, stream_index: int, **options) -> Decoder:
        """The decoder of a stream of ``streams`` (schemas.STREAM); FailedToFindDecoder if its codec is not known."""
        found = streams.filter(F.col("stream_index") == stream_index).select("media_type", "codec_id").first()
        if found is None:
            raise MediaError("FailedToFindBestStream", f"no stream {stream_index}")
        codec = found["codec_id"] or ""
        if found["media_type"] not in ("video", "audio") or not (codec.startswith("pcm_") or codec in CODECS):
            raise MediaError("FailedToFindDecoder", codec)
        return cls(stream_index, found["media_type"], **options)

    def apply(self, df: DataFrame) -> DataFrame:
        frames = operators.decode(df, self.stream_index, delay=self.delay, flush=self.flush)
        return frames.select("*", F.col("frame_no").alias("seq"), F.concat(F.lit("Received frame. PTS: "), F.col("pts")).alias("text"))


class Transform(Stage):
    """Any operator of the user's: a function from DataFrame to DataFrame between two ports."""

    def __init__(self, taken: Port, output: Port, fn: Callable[[DataFrame], DataFrame]):
        super().__init__()
        self.taken, self.outputs, self.fn = taken, {"out": output}, fn

    def apply(self, df: DataFrame) -> DataFrame:
        return self.fn(df)


class TextConsole(Stage):
    taken = TEXT_IN

    def __init__(self, out=None):
        super().__init__()
        self.out = out

    def consume(self, df: DataFrame) -> None:
        texts = operators.texts_of(df) if "kind" in df.columns else df
        operators.print_text(texts, "seq", self.out)


class TestSink(Stage):
    """Calls back with a counter from 0 and each row; stops when the callback returns false."""

    __test__ = False

    def __init__(self, taken: Port, on_data: Callable[[int, Row], bool], on_message: Callable[[int, str], bool] | None = None):
        super().__init__()
        self.taken, self.on_data, self.on_message = taken, on_data, on_message or (lambda n, m: True)
        self.data_count = self.message_count = 0
        self.stopped = False

    def consume(self, df: DataFrame) -> None:
        order = next(c for c in ("seq", "frame_no", "packet_no") if c in df.columns)
        for row in df.orderBy(order).toLocalIterator():
            if self.stopped:
                return
            message = row["message"] if "kind" in df.columns and row["kind"] == "message" else None
            ok = self.on_data(self.data_count, row) if message is None else self.on_message(self.message_count, message)
            if not ok:
                self.stopped = True
            elif message is None:
                self.data_count += 1
            else:
                self.message_count += 1


def format_of(stage: Stage) -> Format | None:
    return stage.taken.format if stage.taken else None
