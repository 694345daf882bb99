"""Operator 8: WARC archives, from one whole-file gzip stream to a member for each record.

Pages are first written as archives that are one gzip stream each, the way many
crawls deliver them. The normaliser inflates such a stream once, in pieces of
bounded size, writes every record as a gzip member of its own and a sidecar
index line with its offset and length; records can then be read one by one.
Of records with equal payloads of MIN_REVISIT bytes or more the one with the
smallest page id is the response and the others are revisits that hold only
the HTTP headers.

Files go to a folder that driver and executors share, through the file system
of its URI; each is written under a task's own name first and then moved, so a
task that runs again leaves the same files.

Cases: null html is an empty payload; a null url has no target header; a null
page id is always a response; rows that repeat the smallest id are all
responses; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import fresh_path, may_hold, pick, settle, small_batches, text_or_empty

MIN_REVISIT = 100
CHUNK = 1 << 20
FILES = "archive string, records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def mark_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with digest, and refers_to where the record is a revisit.

    Only pages that a Bloom filter of fixed size takes for revisits move to the
    join that decides; the others are told apart where they lie.
    """
    html = text_or_empty("html")
    ids = pages.select(
        "page_id", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n")
    ).filter(F.col("n") >= MIN_REVISIT)
    firsts = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    firsts = settle(firsts.filter("n > 1").select("digest", "refers_to"), "firsts")
    revisits = ids.select("page_id", "digest").join(firsts, "digest").filter(F.col("page_id") > F.col("refers_to")).distinct()
    revisits = settle(revisits, "revisits")
    own = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    key = F.xxhash64("page_id", "digest")
    some = may_hold(revisits.select(key))(key)
    others = own.filter(~some).withColumn("refers_to", F.lit(None).cast(revisits.schema["refers_to"].dataType))
    return others.unionByName(own.filter(some).join(revisits, ["page_id", "digest"], "left"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (payload if refers_to is None else b"")
    name = "" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>"]
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in raw.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def put(store: fs.FileSystem, own: str, name: str) -> None:
    """Give a finished file its name; one that an earlier try of the task left there is replaced, in any store."""
    try:
        store.move(own, name)
    except OSError:
        store.delete_file(name)
        store.move(own, name)


def write_monolithic(marked: DataFrame, folder: str) -> DataFrame:
    """One archive of one gzip stream for each task; a row for each archive."""
    small_batches(marked.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = opened(folder)
        store.create_dir(root)
        name = f"part-{task.partitionId():06d}.warc.gz"
        own, n = f"{root}/.{name}.{task.taskAttemptId()}", 0
        squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
        with store.open_output_stream(own, compression=None) as out:
            for batch in batches:
                for r in batch.to_pylist():
                    body = (r["html"] or "").encode()
                    out.write(squeeze.compress(record(r["page_id"], r["url"], body, r["digest"], r["refers_to"])))
                    n += 1
            out.write(squeeze.flush())
        put(store, own, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [n]})

    return marked.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, FILES)


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file, in pieces; several members are read as one stream."""
    inflate = zlib.decompressobj(31)
    while raw := stream.read(CHUNK):
        while raw:
            yield inflate.decompress(raw, CHUNK)
            while inflate.unconsumed_tail:
                yield inflate.decompress(inflate.unconsumed_tail, CHUNK)
            raw = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
    if rest := inflate.flush():
        yield rest


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Cut a stream of WARC bytes into records, each with its closing empty lines."""
    held, need, scanned = bytearray(), 0, 0
    for piece in pieces:
        held += piece
        while True:
            if not need:
                end = held.find(b"\r\n\r\n", scanned)
                if end < 0:
                    scanned = max(0, len(held) - 3)
                    break
                need = end + 4 + int(headers(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = scanned = 0
    if held.strip():
        raise ValueError("the archive ends within a record")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with a member for each record and a sidecar index; a row for each."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        store, root = opened(folder)
        store.create_dir(root)
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                source, path = opened(uri)
                name, at, n = path.rsplit("/", 1)[1], 0, 0
                own = f"{root}/.{name}.{attempt}"
                with (
                    source.open_input_stream(path, compression=None) as stream,
                    store.open_output_stream(own, compression=None) as out,
                    store.open_output_stream(own + ".index", compression=None) as index,
                ):
                    for raw in records(inflated(stream)):
                        member = gzip.compress(raw, 6, mtime=0)
                        known = headers(raw[: raw.index(b"\r\n\r\n")])
                        line = {"offset": at, "length": len(member), "type": known["warc-type"], "id": known["warc-record-id"]}
                        line["url"] = known.get("warc-target-uri")
                        index.write(json.dumps(line).encode() + b"\n")
                        out.write(member)
                        at += len(member)
                        n += 1
                put(store, own + ".index", f"{root}/{name}.index")
                put(store, own, f"{root}/{name}")
                yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [n]})

    return archives.select("archive").mapInArrow(rewrite, FILES)


def page_of(name: str | None) -> int | None:
    digits = (name or "")[len("<urn:page:") : -1]
    return int(digits) if digits else None


def read_records(archives: DataFrame) -> DataFrame:
    """What the records of normalised archives hold, each read at its place in the index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
        schema = schema.append(pa.field("record_type", pa.string())).append(pa.field("refers_to", pa.int64()))
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                store, path = opened(uri)
                rows: list[dict] = []
                with (
                    store.open_input_file(path) as archive,
                    store.open_input_stream(path + ".index", compression=None) as index,
                ):
                    for line in lines(index):
                        place = json.loads(line)
                        raw = gzip.decompress(archive.read_at(place["length"], place["offset"]))
                        head, block = raw[:-4].split(b"\r\n\r\n", 1)
                        known = headers(head)
                        http, payload = block.split(b"\r\n\r\n", 1)
                        revisit = known["warc-type"] == "revisit"
                        digest = known["warc-payload-digest"].removeprefix("sha256:")
                        if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{uri} at {place['offset']}: the payload is not what was written")
                        rows.append(
                            {
                                "page_id": page_of(known["warc-record-id"]),
                                "payload_bytes": int(headers(http)["content-length"]) if revisit else len(payload),
                                "payload_digest": digest,
                                "record_type": known["warc-type"],
                                "refers_to": page_of(known.get("warc-refers-to")),
                            }
                        )
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.select("archive").mapInArrow(read, RECORDS)


def lines(stream) -> Iterator[bytes]:
    rest = b""
    while piece := stream.read(CHUNK):
        *whole, rest = (rest + piece).split(b"\n")
        yield from whole
    if rest:
        yield rest


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, normalise them, and return what they hold."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or fresh_path(spark, "warc")
    whole = settle(write_monolithic(mark_revisits(pick(pages, "page_id", "url", "html")), f"{folder}/whole"), "warc-whole")
    tasks = max(1, whole.count())
    single = settle(normalise(whole.repartition(tasks, "archive"), f"{folder}/members"), "warc-members")
    return read_records(single.repartition(tasks, "archive"))
