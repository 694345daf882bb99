"""Media containers as packet and stream relations: WAV, AVI and MP4, in pure Python.

Two ways in: ``media_packets`` and ``media_streams`` scan files of under 2 GB with
Spark's own file reader, from any store; the data source ``rillwork_media``
seeks within files of any size that a URI's file system can open, one task a
file, and takes a stream index to skip the payloads of other streams. Spark's
reader passes over files without a byte; the data source reports them.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rillwork.errors import MediaError
from rillwork.schemas import PACKET, STREAM
from rillwork.ship import ship

#: Samples of one packet of uncompressed audio.
PCM_SAMPLES = 1024


@dataclass
class Stream:
    index: int
    media_type: str
    codec_id: str
    params: dict[str, str] = field(default_factory=dict)


@dataclass
class Packet:
    stream: int
    pts: int
    dts: int
    at: int
    size: int


def _chunk(f: BinaryIO) -> tuple[bytes, int] | None:
    head = f.read(8)
    return (head[:4], struct.unpack("<I", head[4:])[0]) if len(head) == 8 else None


def _wav(f: BinaryIO) -> tuple[list[Stream], Iterator[Packet]]:
    fmt, data = None, None
    while data is None and (c := _chunk(f)):
        name, size = c
        if name == b"fmt ":
            fmt = struct.unpack("<HHIIHH", f.read(size)[:16])
            f.seek(size % 2, 1)
        elif name == b"data":
            data = f.tell(), size
        else:
            f.seek(size + size % 2, 1)
    if fmt is None or data is None or not fmt[4]:
        raise MediaError("FailedToOpenInput", "no audio in the file")
    _, channels, rate, _, align, bits = fmt
    params = {"channels": str(channels), "sample_rate": str(rate), "bits": str(bits)}
    step = PCM_SAMPLES * align

    def packets() -> Iterator[Packet]:
        for k, at in enumerate(range(0, data[1], step)):
            yield Packet(0, k * PCM_SAMPLES, k * PCM_SAMPLES, data[0] + at, min(step, data[1] - at))

    return [Stream(0, "audio", f"pcm_{bits}", params)], packets()


def _avi(f: BinaryIO) -> tuple[list[Stream], Iterator[Packet]]:
    streams: list[Stream] = []
    samples: list[int] = []
    end = f.seek(0, 2)
    f.seek(12)
    movi = None
    while f.tell() < end and (c := _chunk(f)):
        name, size = c
        at = f.tell()
        if name == b"LIST":
            kind = f.read(4)
            if kind == b"movi":
                movi = at + 4, at + size
                break
            if kind in (b"hdrl", b"strl"):
                continue
        elif name == b"strh":
            head = f.read(size)
            media = {b"vids": "video", b"auds": "audio"}.get(head[:4], "other")
            scale, rate = struct.unpack("<II", head[20:28])
            params = {"scale": str(scale), "rate": str(rate)}
            streams.append(Stream(len(streams), media, head[4:8].decode("latin-1").strip("\0 "), params))
            samples.append(struct.unpack("<I", head[44:48])[0])
        f.seek(at + size + size % 2)
    if movi is None or not streams:
        raise MediaError("FailedToOpenInput", "no packets in the file")

    def packets() -> Iterator[Packet]:
        pts = [0] * len(streams)
        f.seek(movi[0])
        while f.tell() < movi[1] and (c := _chunk(f)):
            name, size = c
            at = f.tell()
            if name == b"LIST":
                f.seek(4, 1)
                continue
            if name[:2].isdigit() and name[2:] in (b"dc", b"db", b"wb", b"tx") and (k := int(name[:2])) < len(streams):
                yield Packet(k, pts[k], pts[k], at, size)
                pts[k] += size // samples[k] if samples[k] else 1
            f.seek(at + size + size % 2)

    return streams, packets()


def _boxes(f: BinaryIO, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and end of the content of each box from here to ``end``."""
    while f.tell() + 8 <= end:
        at = f.tell()
        size, name = struct.unpack(">I4s", f.read(8))
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", f.read(8))[0], 16
        size = size or end - at
        if size < head:
            raise MediaError("FailedToOpenInput", "a box is shorter than its head")
        yield name, at + head, at + size
        f.seek(at + size)


def _table(raw: bytes, form: str, at: int = 8) -> list[tuple]:
    n = struct.unpack(">I", raw[at - 4 : at])[0]
    step = struct.calcsize(form)
    return [struct.unpack(form, raw[at + k * step : at + (k + 1) * step]) for k in range(n)]


def _mp4(f: BinaryIO) -> tuple[list[Stream], Iterator[Packet]]:
    end = f.seek(0, 2)
    f.seek(0)
    tracks: list[dict[str, bytes]] = []

    def walk(end: int, own: dict[str, bytes] | None) -> None:
        for name, start, stop in _boxes(f, end):
            if name == b"trak":
                tracks.append(own := {})
            if name in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
                f.seek(start)
                walk(stop, own)
            elif own is not None and name in (b"mdhd", b"hdlr", b"stsd", b"stts", b"ctts", b"stsz", b"stsc", b"stco", b"co64"):
                f.seek(start)
                own[name.decode()] = f.read(stop - start)

    walk(end, None)
    streams, found = [], []
    for k, t in enumerate(tracks):
        if not {"mdhd", "hdlr", "stsd", "stts", "stsz", "stsc"} <= t.keys():
            raise MediaError("FailedToOpenInput", "a track lacks its tables")
        media = {b"vide": "video", b"soun": "audio"}.get(t["hdlr"][8:12], "other")
        scale = struct.unpack(">I", t["mdhd"][20:24] if t["mdhd"][0] else t["mdhd"][12:16])[0]
        streams.append(Stream(k, media, t["stsd"][12:16].decode("latin-1"), {"timescale": str(scale)}))
        fixed, n = struct.unpack(">II", t["stsz"][4:12])
        sizes = [fixed] * n if fixed else [s for (s,) in _table(t["stsz"], ">I", 12)]
        chunks = [o for (o,) in (_table(t["co64"], ">Q") if "co64" in t else _table(t["stco"], ">I"))]
        runs = _table(t["stsc"], ">III")
        steps = [d for n, d in _table(t["stts"], ">II") for _ in range(n)]
        shifts = [d for n, d in _table(t["ctts"], ">Ii") for _ in range(n)] if "ctts" in t else []
        dts = sample = 0
        for number, at in enumerate(chunks, 1):
            many = next((r[1] for r in reversed(runs) if r[0] <= number), 0)
            for _ in range(many):
                if sample == len(sizes):
                    break
                pts = dts + (shifts[sample] if sample < len(shifts) else 0)
                found.append(Packet(k, pts, dts, at, sizes[sample]))
                at += sizes[sample]
                dts += steps[sample] if sample < len(steps) else 0
                sample += 1
    if not streams:
        raise MediaError("FailedToOpenInput", "no tracks in the file")
    return streams, iter(sorted(found, key=lambda p: p.at))


def open_container(f: BinaryIO) -> tuple[list[Stream], Iterator[Packet]]:
    """Streams of a file, and its packets in file order. The format shows in the first bytes."""
    head = f.read(12)
    if head[:4] == b"RIFF" and head[8:] == b"WAVE":
        return _wav(f)
    if head[:4] == b"RIFF" and head[8:] == b"AVI ":
        return _avi(f)
    if head[4:8] in (b"ftyp", b"moov", b"mdat", b"free"):
        return _mp4(f)
    raise MediaError("FailedToOpenInput", "no known container")


def read_packets(source_id: str, f: BinaryIO, stream_index: int | None = None) -> Iterator[tuple]:
    for n, p in enumerate(open_container(f)[1]):
        if stream_index is None or p.stream == stream_index:
            here = f.tell()
            f.seek(p.at)
            payload = f.read(p.size)
            if len(payload) < p.size:
                raise MediaError("FailedToReadFrame", f"packet {n} of {source_id} is cut off")
            f.seek(here)
            yield source_id, n, p.stream, p.pts, p.dts, payload


def read_streams(source_id: str, f: BinaryIO) -> Iterator[tuple]:
    for s in open_container(f)[0]:
        yield source_id, s.index, s.media_type, s.codec_id, s.params


def _scan(spark: SparkSession, path: str, read, schema) -> DataFrame:
    names = schema.fieldNames()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                out = []
                for row in read(source, io.BytesIO(raw.as_buffer())):
                    out.append(dict(zip(names, row, strict=True)))
                    if len(out) == 256:
                        yield pa.RecordBatch.from_pylist(out, schema=kinds)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)

    from pyspark.sql.pandas.types import to_arrow_schema

    ship(spark)
    kinds = to_arrow_schema(schema)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, schema)


def media_packets(spark: SparkSession, path: str, stream_index: int | None = None) -> DataFrame:
    """Packets of all files at ``path``, numbered in file order before any is left out."""
    return _scan(spark, path, lambda source, f: read_packets(source, f, stream_index), PACKET)


def media_streams(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, read_streams, STREAM)


class MediaSource(DataSource):
    """After ``register_media``: ``spark.read.format("rillwork_media").option("uris", "a,b").option("what", "packets").load()``."""

    @classmethod
    def name(cls) -> str:
        return "rillwork_media"

    def schema(self):
        return STREAM if self.options.get("what", "packets") == "streams" else PACKET

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(self.options)


def avi_bytes(streams: list[tuple[bytes, bytes]], packets: list[tuple[int, bytes]]) -> bytes:
    """An AVI file of ``streams`` (type, handler) and their packets (stream, payload) in order, one tick each."""

    def chunk(name: bytes, data: bytes) -> bytes:
        return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)

    def head(media: bytes, handler: bytes) -> bytes:
        return chunk(b"LIST", b"strl" + chunk(b"strh", media + handler + bytes(12) + struct.pack("<II", 1, 1) + bytes(28)))

    ends = {b"vids": b"dc", b"auds": b"wb"}
    movi = b"".join(chunk(b"%02d" % k + ends.get(streams[k][0], b"tx"), data) for k, data in packets)
    body = b"AVI " + chunk(b"LIST", b"hdrl" + b"".join(head(*x) for x in streams)) + chunk(b"LIST", b"movi" + movi)
    return chunk(b"RIFF", body)


def write_avi(packets: DataFrame, folder: str, streams: list[tuple[bytes, bytes]]) -> None:
    """Write ``packets`` (part, packet_no, stream_index, payload) as AVI files, one for each part, which a task holds at once."""
    ship(packets.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        part, held = None, []

        def close() -> None:
            with store.open_output_stream(f"{root}/part-{part:08d}.avi") as out:
                out.write(avi_bytes(streams, held))

        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != part:
                    if held:
                        close()
                    part, held = r["part"], []
                held.append((r["stream_index"], r["payload"]))
        if held:
            close()
        yield pa.RecordBatch.from_pydict({"parts": pa.array([], pa.int64())})

    own = packets.select("part", "packet_no", "stream_index", "payload").repartition("part").sortWithinPartitions("part", "packet_no")
    own.mapInArrow(write, "parts long").write.format("noop").mode("overwrite").save()


def register_media(spark: SparkSession) -> None:
    """Make ``rillwork_media`` known to the session, and this package to its workers."""
    ship(spark)
    spark.dataSource.register(MediaSource)


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.uris = [u for u in options.get("uris", "").split(",") if u]
        self.streams = options.get("what", "packets") == "streams"
        index = options.get("stream_index")
        self.index = None if index is None else int(index)

    def partitions(self):
        return [InputPartition(u) for u in self.uris]

    def read(self, partition):
        store, path = fs.FileSystem.from_uri(partition.value)
        with store.open_input_file(path) as f:
            if self.streams:
                yield from read_streams(partition.value, f)
            else:
                yield from read_packets(partition.value, f, self.index)
