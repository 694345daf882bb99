import struct
import wave

import pytest
from pyspark.sql import functions as F

from rillwork import operators, sources
from rillwork.plans import Decoder, MediaSplit, Pipeline, TestSink
from rillwork.plans.ports import TEXT_IN
from rillwork.sources.media import MediaSource


def write_wav(path, samples=2500):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"".join(struct.pack("<h", k % 1000) for k in range(samples)))


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def strh(kind, sample):
    return chunk(b"strh", kind + b"raw " + struct.pack("<IHHIIIIIIII", 0, 0, 0, 0, 1, 25, 0, 0, 0, 0, sample) + b"\0" * 8)


def write_avi(path):
    """Streams 0 video, 1 audio of two-byte samples, 2 text; six rounds of one packet each."""
    heads = b"".join(chunk(b"LIST", b"strl" + strh(k, s)) for k, s in ((b"vids", 0), (b"auds", 2), (b"txts", 0)))
    movi = b"".join(chunk(b"00dc", bytes([k]) * 7) + chunk(b"01wb", b"ab" * 5) + chunk(b"02tx", b"t") for k in range(6))
    body = b"AVI " + chunk(b"LIST", b"hdrl" + heads) + chunk(b"LIST", b"movi" + movi)
    path.write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)


def box(name, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), name) + body


def full(*numbers):
    return struct.pack(f">{len(numbers) + 1}I", 0, *numbers)


def write_mp4(path, shifts=(0, 20, 10, 10)):
    """One video track of four samples in two chunks, put in another order by ctts."""
    ftyp = box(b"ftyp", b"isom", full())
    data = box(b"mdat", b"aaabbbbccddddd")
    first = len(ftyp) + 8
    stbl = box(
        b"stbl",
        box(b"stsd", full(1), box(b"avc1", b"\0" * 8)),
        box(b"stts", full(1, 4, 10)),
        box(b"ctts", full(len(shifts), *[x for s in shifts for x in (1, s)])),
        box(b"stsz", full(0, 4, 3, 4, 2, 5)),
        box(b"stsc", full(1, 1, 2, 1)),
        box(b"stco", full(2, first, first + 7)),
    )
    mdhd = box(b"mdhd", full(0, 0, 90000, 40, 0))
    hdlr = box(b"hdlr", full(0), b"vide", b"\0" * 12)
    moov = box(b"moov", box(b"trak", box(b"mdia", mdhd, hdlr, box(b"minf", stbl))))
    path.write_bytes(ftyp + data + moov)


def test_wav(spark, tmp_path):
    write_wav(tmp_path / "a.wav")
    rows = sources.media_packets(spark, str(tmp_path)).orderBy("packet_no").collect()
    assert [(r.pts, len(r.payload)) for r in rows] == [(0, 2048), (1024, 2048), (2048, 904)]
    stream = sources.media_streams(spark, str(tmp_path)).first()
    assert (stream.media_type, stream.codec_id, stream.params["sample_rate"]) == ("audio", "pcm_16", "8000")


def test_avi_routes_and_drops(spark, tmp_path):
    write_avi(tmp_path / "a.avi")
    packets = sources.media_packets(spark, str(tmp_path))
    assert packets.count() == 18
    routed = operators.route(packets, video=0, audio=1)
    assert {r["route"]: r["count"] for r in routed.groupBy("route").count().collect()} == {"video": 6, "audio": 6}
    assert [r.pts for r in packets.filter("stream_index = 1").orderBy("packet_no").collect()] == [0, 5, 10, 15, 20, 25]
    first = operators.limit_then(packets, 4, "packet_no", lambda p: operators.route(p, 0, 1))
    assert first.count() == 3
    assert operators.route(packets, video=0).count() == 6
    assert operators.route(packets, video=1, audio=1).select("route").distinct().first()[0] == "audio"


def test_mp4_order(spark, tmp_path):
    write_mp4(tmp_path / "a.mp4")
    packets = sources.media_packets(spark, str(tmp_path))
    rows = packets.orderBy("packet_no").collect()
    assert [(r.dts, r.pts, bytes(r.payload)) for r in rows] == [(0, 0, b"aaa"), (10, 30, b"bbbb"), (20, 30, b"cc"), (30, 40, b"ddddd")]
    frames = operators.decode(packets, 0)
    assert [r.pts for r in frames.orderBy("frame_no").collect()] == [0, 30, 30, 40]
    assert operators.decode(packets, 0, delay=2, flush=False).count() == 2
    assert operators.decode(packets, 7).count() == 0


def test_best_stream(spark, tmp_path):
    write_avi(tmp_path / "a.avi")
    packets = sources.media_packets(spark, str(tmp_path)).withColumn("stream_index", F.expr("stream_index % 3"))
    streams = sources.media_streams(spark, str(tmp_path))
    best = {r.media_type: r.stream_index for r in operators.best_stream(streams, packets).collect()}
    assert best == {"video": 0, "audio": 1, "other": 2}


@pytest.mark.parametrize("raw", [b"not media at all" * 9, b"RIFF\0\0\0\0WAVE", b"RIFF\0\0\0\0AVI "])
def test_not_media(spark, tmp_path, raw):
    (tmp_path / "x").write_bytes(raw)
    with pytest.raises(Exception, match="Failed to open input"):
        sources.media_packets(spark, str(tmp_path)).collect()


def test_data_source_seeks(spark, tmp_path):
    write_avi(tmp_path / "a.avi")
    spark.dataSource.register(MediaSource)
    read = spark.read.format("rillwork_media").option("uris", f"file://{tmp_path}/a.avi")
    assert read.load().count() == 18
    assert read.option("stream_index", "2").load().count() == 6
    assert spark.read.format("rillwork_media").option("uris", f"file://{tmp_path}/a.avi").option("what", "streams").load().count() == 3


def test_demux_and_decode(spark, tmp_path):
    write_avi(tmp_path / "a.avi")
    shown: dict[str, list] = {"video": [], "audio": []}
    split = MediaSplit(str(tmp_path / "a.avi"))
    for index, media in enumerate(shown):
        sink = TestSink(TEXT_IN, lambda n, r, media=media: shown[media].append(r["pts"]) or True)
        decoder = Decoder(index, media)
        decoder.link(sink)
        split.link_stream(decoder, media)
    with Pipeline(split, spark) as pipeline:
        pipeline.run_all()
    assert shown == {"video": [0, 1, 2, 3, 4, 5], "audio": [0, 5, 10, 15, 20, 25]}
