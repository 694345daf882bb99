"""Stages on Structured Streaming: stepped vectors, fan-out, ordered printing, stateful decoding."""

from rillwork.streaming.stream import (
    VectorStream,
    constant_text_stream,
    decode_stream,
    fan_out,
    packet_stream,
    print_stream,
    vector_stream,
)

__all__ = [
    "VectorStream",
    "constant_text_stream",
    "decode_stream",
    "fan_out",
    "packet_stream",
    "print_stream",
    "vector_stream",
]
