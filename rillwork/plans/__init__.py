"""Stages with typed ports, linked to a tree, and the pipeline that runs it."""

from rillwork.plans.pipeline import Pipeline, Status
from rillwork.plans.ports import Format, Kind, Port, compatible
from rillwork.plans.stages import (
    BytesToText,
    Decoder,
    FileSource,
    MediaSplit,
    Stage,
    TestSink,
    TestSource,
    TextConsole,
    TextSource,
    Transform,
)

__all__ = [
    "BytesToText",
    "Decoder",
    "FileSource",
    "Format",
    "Kind",
    "MediaSplit",
    "Pipeline",
    "Port",
    "Stage",
    "Status",
    "TestSink",
    "TestSource",
    "TextConsole",
    "TextSource",
    "Transform",
    "compatible",
]
