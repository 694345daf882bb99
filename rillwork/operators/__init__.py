"""Transforms and sinks over the relations of ``rillwork.schemas``."""

from rillwork.operators.media import best_stream, decode, route
from rillwork.operators.sinks import call_back, count_data, joined_text, print_text
from rillwork.operators.text import bytes_to_text, limit_then, take_while, texts_of

__all__ = [
    "best_stream",
    "bytes_to_text",
    "call_back",
    "count_data",
    "decode",
    "joined_text",
    "limit_then",
    "print_text",
    "route",
    "take_while",
    "texts_of",
]
