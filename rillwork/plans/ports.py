"""What a stage takes and gives, and which ports fit each other."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Format(Enum):
    TEXT = "Text"
    BYTES = "Bytes"
    PACKET = "AVPacket"


class Kind(Enum):
    TEXT_SINK = "TextSink"
    TEXT_SOURCE = "TextSrc"
    BYTES_SOURCE = "BytesSrc"
    BYTES_SINK = "BytesSink"
    PACKET_SOURCE = "AVPacketSrc"
    VIDEO_SINK = "AVPacketVideoSink"
    AUDIO_SINK = "AVPacketAudioSink"


@dataclass(frozen=True)
class Port:
    """An input: the kind a stage is, and the format it takes. An output: what it asks of the stage behind it."""

    kind: Kind
    format: Format


TEXT_IN = Port(Kind.TEXT_SINK, Format.TEXT)
BYTES_IN = Port(Kind.BYTES_SINK, Format.BYTES)
VIDEO_IN = Port(Kind.VIDEO_SINK, Format.PACKET)
AUDIO_IN = Port(Kind.AUDIO_SINK, Format.PACKET)


def compatible(output: Port | None, taken: Port | None) -> bool:
    """A stage without an input never fits, nor one behind a stage without an output."""
    return output is not None and output == taken


# Outputs of the stages that have one, and inputs of those that can be linked behind them.
OUTPUTS = {
    "TextTestSrc": TEXT_IN,
    "FileSrc": BYTES_IN,
    "Bytes2Text": TEXT_IN,
    "DemuxSrc.video": VIDEO_IN,
    "DemuxSrc.audio": AUDIO_IN,
    "VideoDecoder": TEXT_IN,
    "AudioDecoder": TEXT_IN,
}
INPUTS = {
    "StdoutLog": TEXT_IN,
    "Bytes2Text": BYTES_IN,
    "VideoDecoder": VIDEO_IN,
    "AudioDecoder": AUDIO_IN,
}
