"""The data source ``rillwork_chunks``: files of any size, dealt to tasks by ranges of bytes."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rillwork.schemas import BYTES


class ChunkSource(DataSource):
    """Options: ``uris`` (a JSON list), ``size`` of a chunk, ``chunks`` of a task."""

    @classmethod
    def name(cls) -> str:
        return "rillwork_chunks"

    def schema(self):
        return BYTES

    def reader(self, schema) -> DataSourceReader:
        return ChunkReader(json.loads(self.options["uris"]), int(self.options["size"]), int(self.options["chunks"]))


class ChunkReader(DataSourceReader):
    def __init__(self, uris: list[str], size: int, chunks: int):
        self.uris, self.size, self.chunks = uris, size, chunks

    def partitions(self):
        out = []
        for uri in self.uris:
            store, path = fs.FileSystem.from_uri(uri)
            info = store.get_file_info(path)
            if info.type != fs.FileType.File:
                raise FileNotFoundError(uri)
            whole = -(-info.size // self.size)
            out += [InputPartition((uri, k, min(k + self.chunks, whole))) for k in range(0, whole, self.chunks)]
        return out or [InputPartition(None)]

    def read(self, partition) -> Iterator[tuple]:
        if partition.value is None:
            return
        uri, first, end = partition.value
        store, path = fs.FileSystem.from_uri(uri)
        with store.open_input_file(path) as f:
            f.seek(first * self.size)
            for seq in range(first, end):
                yield uri, seq, f.read(self.size)
