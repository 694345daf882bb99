"""The registered queries over the stages, and the same in DuckDB's SQL.

Events stand in for media packets: views are stream 0 (video), clicks stream 1
(audio), all others stream 2; the time stamp is the presentation time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork import functions as fn
from rillwork import operators, sources
from rillwork.errors import MEDIA_MESSAGES, PIPELINE_MESSAGES, MediaError, PipelineFinished
from rillwork.plans import Pipeline, TestSink, TestSource, compatible
from rillwork.plans.ports import INPUTS, OUTPUTS, TEXT_IN
from rillwork.ship import shared_folder

HELLO = "Hello, World!\n"
VIDEO, AUDIO = 0, 1
STEPS = 15
#: Packets of one written file.
FILE_PACKETS = 4096
THRESHOLD = 20.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("source_id"),
        F.col("event_id").alias("packet_no"),
        F.when(kind == "view", VIDEO).when(kind == "click", AUDIO).otherwise(2).alias("stream_index"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("pts"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sources.chunk_column(docs, F.encode("text", "UTF-8"), "doc_id")


def text_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.constant_text(spark, 3, HELLO)


def vector_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events replayed in order as a vector of texts."""
    return sources.vector_rows(table(spark, sf_dir, "events"), F.lit("text"), F.col("event_type"), "event_id")


def region_source(spark: SparkSession, sf_dir: str) -> TestSource:
    """The names of the regions, five whatever the scale, as a vector."""
    names = [r[0] for r in table(spark, sf_dir, "region").orderBy("r_regionkey").select("r_name").collect()]
    return TestSource(TEXT_IN, [("text", x) for x in names])


def pipeline_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step of a pipeline returns, and what its sink has counted by then."""
    source, sink = region_source(spark, sf_dir), TestSink(TEXT_IN, lambda n, row: True)
    rows = []
    with Pipeline(source.link(sink), spark) as pipeline:
        while not rows or rows[-1][1] in ("IterFin", "Finished"):
            try:
                status = pipeline.iter().value
            except PipelineFinished as e:
                status = e.kind
            rows.append((len(rows), status, sink.data_count))
    return spark.createDataFrame(rows, "step long, status string, data_count long")


def callback_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a callback is given until it returns false."""
    source, seen = region_source(spark, sf_dir), []
    sink = TestSink(TEXT_IN, lambda n, row: seen.append((n, row["text"])) or n < 2)
    with Pipeline(source.link(sink), spark) as pipeline:
        pipeline.run_all()
    return spark.createDataFrame(seen, "n long, text string")


def media_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as AVI files of FILE_PACKETS packets at most, and the packets that are read from these."""
    own = packets(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("packet_no"), "props"), "packet_no")
    part = F.floor(F.col("packet_no") / FILE_PACKETS).cast("long").alias("part")
    folder = shared_folder(spark, "media")
    kinds = [(b"vids", b"H264"), (b"auds", b"Opus"), (b"txts", b"text")]
    sources.write_avi(own.select(part, "packet_no", "stream_index", F.encode("props", "UTF-8").alias("payload")), folder, kinds)
    number = F.regexp_extract("source_id", r"part-(\d+)\.avi", 1).cast("long").alias("part")
    return sources.media_packets(spark, folder).select(number, "packet_no", "stream_index", "pts", F.md5("payload").alias("md5"))


def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select(
        "doc_id", "seq", F.octet_length("chunk").cast("long").alias("n_bytes"), F.md5("chunk").alias("md5")
    )


def bytes2text_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = operators.bytes_to_text(chunks(spark, sf_dir), "doc_id")
    return texts.select("doc_id", "seq", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("md5"))


def bytes2text_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of the table: an id may stand in several, and texts may be empty or null."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.col("text").isNull().alias("_null"), "text")
    keys = ("_row", "doc_id", "_null")
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    texts = operators.bytes_to_text(sources.chunk_column(docs, data, *keys, keep_empty=True), *keys, mode="whole")
    text = F.when(~F.col("_null"), F.col("text"))
    return texts.select("doc_id", F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("md5"))


def print_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the console shows of each file read in chunks and decoded chunk by chunk."""
    shown = operators.joined_text(operators.bytes_to_text(chunks(spark, sf_dir), "doc_id"), "doc_id")
    return shown.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("md5"))


def sink_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.count_data(operators.bytes_to_text(chunks(spark, sf_dir), "doc_id"), "doc_id")


def sink_take_while(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    kept = operators.take_while(own, F.col("value") <= THRESHOLD, "event_id", "user_id")
    index = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return kept.select("user_id", "event_id", index.cast("long").alias("callback_index"))


def iter_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step on each file returns: IterFin for every chunk, then Finished."""
    steps = chunks(spark, sf_dir).select("doc_id", F.col("seq").alias("step"), F.lit("IterFin").alias("status"))
    docs = table(spark, sf_dir, "documents")
    n = F.ceil(F.octet_length(F.encode("text", "UTF-8")) / fn.CHUNK_BYTES)
    ends = docs.select("doc_id", F.coalesce(n, F.lit(0)).cast("long").alias("step"), F.lit("Finished").alias("status"))
    return steps.unionByName(ends)


def demux_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.route(packets(spark, sf_dir), VIDEO, AUDIO).select("packet_no", "stream_index", "route")


def demux_iter_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first packets that the source gives; those of no linked stream count as steps."""
    routed = operators.limit_then(packets(spark, sf_dir), STEPS, "packet_no", lambda p: operators.route(p, VIDEO, AUDIO))
    return routed.select("packet_no", "stream_index", "route")


def best_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select(
        F.lit("events").alias("source_id"),
        F.when(F.col("event_type").isin("view", "signup"), "video")
        .when(F.col("event_type") == "click", "audio")
        .otherwise("other")
        .alias("media_type"),
        F.element_at(F.create_map(*[F.lit(x) for k, v in STREAMS for x in (k, v)]), F.col("event_type")).alias("stream_index"),
    )
    streams = own.select("source_id", "media_type", "stream_index").distinct()
    return operators.best_stream(streams, own).select("media_type", "stream_index", F.col("n_packets").cast("long").alias("n_packets"))


STREAMS = (("view", 0), ("click", 1), ("error", 2), ("purchase", 3), ("signup", 4))


def decode_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operators.decode(packets(spark, sf_dir), VIDEO, AUDIO).select("stream_index", "frame_no", "pts")


def decode_unflushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decoder that holds back two frames and is not flushed."""
    frames = operators.decode(packets(spark, sf_dir), VIDEO, AUDIO, delay=2, flush=False)
    return frames.groupBy("stream_index").agg(F.count("*").alias("frames"), F.max("pts").alias("last_pts"))


def packet_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's own packets only: the guard of a decoder, in its right sense."""
    return packets(spark, sf_dir).filter(F.col("stream_index") == AUDIO).select("packet_no", "stream_index", "pts")


def link_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every output with every input, as the check at the time of linking finds them."""
    rows = [(u, d, compatible(out, taken)) for u, out in OUTPUTS.items() for d, taken in INPUTS.items()]
    return spark.createDataFrame(rows, "upstream string, sink string, links boolean")


def error_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("pipeline", *x) for x in PIPELINE_MESSAGES.items()] + [("media", *x) for x in MEDIA_MESSAGES.items()]
    rows += [("wrapped", k, str(MediaError(k))) for k in MEDIA_MESSAGES]
    return spark.createDataFrame(rows, "family string, kind string, message string")


def resource_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", fn.file_uri(F.col("url")).alias("uri"))


def codec_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(k,) for k in fn.CODECS], "codec string")
    return own.select("codec", fn.codec_library(F.col("codec")).alias("library"))


QUERIES = {
    f.__name__: f
    for f in (
        text_source,
        vector_events,
        pipeline_iter,
        callback_sink,
        media_round_trip,
        file_chunks,
        bytes2text_strict,
        bytes2text_whole,
        print_file,
        sink_counts,
        sink_take_while,
        iter_status,
        demux_route,
        demux_iter_limit,
        best_stream,
        decode_pts,
        decode_unflushed,
        packet_projection,
        link_matrix,
        error_text,
        resource_uri,
        codec_names,
    )
}

_CHUNKS = """
    c AS (
        SELECT doc_id, i AS seq, b[i * 8192 + 1 : (i + 1) * 8192] AS chunk
        FROM (SELECT doc_id, encode(text) AS b FROM documents),
             LATERAL (SELECT unnest(range(0, (octet_length(b) + 8191) // 8192)) AS i)
    ), t AS (
        SELECT doc_id, seq, try(decode(chunk)) AS txt FROM c
    ), s AS (
        SELECT *, min(CASE WHEN txt IS NULL THEN seq END) OVER (PARTITION BY doc_id) AS stop FROM t
    ), a AS (
        SELECT doc_id, seq, txt FROM s WHERE stop IS NULL OR seq < stop
    )
"""
_PACKETS = """
    p AS (
        SELECT event_id AS packet_no, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS stream_index,
               epoch_us(ts) AS pts
        FROM events
    )
"""
_ROUTE = "CASE stream_index WHEN 1 THEN 'audio' WHEN 0 THEN 'video' END AS route"


ORACLE = {
    "text_source": "SELECT range AS seq, 'Hello, World!' || chr(10) AS text FROM range(3)",
    "vector_events": """
        SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq, 'text' AS kind, event_type AS text FROM events
    """,
    "pipeline_iter": """
        SELECT r - 1 AS step, 'IterFin' AS status, r AS data_count FROM (SELECT row_number() OVER (ORDER BY r_regionkey) AS r FROM region)
        UNION ALL SELECT count(*), 'Finished', count(*) FROM region
        UNION ALL SELECT count(*) + 1, 'MessageSinkFailed', count(*) FROM region
    """,
    "callback_sink": """
        SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS n, r_name AS text FROM region QUALIFY n <= 2
    """,
    "media_round_trip": f"""
        WITH {_PACKETS}
        SELECT packet_no // 4096 AS part, row_number() OVER (PARTITION BY packet_no // 4096 ORDER BY packet_no) - 1 AS packet_no,
               stream_index, row_number() OVER (PARTITION BY packet_no // 4096, stream_index ORDER BY packet_no) - 1 AS pts,
               md5(props) AS md5
        FROM p JOIN (SELECT event_id AS packet_no, props FROM events) USING (packet_no)
    """,
    "file_chunks": f"WITH {_CHUNKS} SELECT doc_id, seq, CAST(octet_length(chunk) AS BIGINT) AS n_bytes, md5(chunk) AS md5 FROM c",
    "bytes2text_strict": f"WITH {_CHUNKS} SELECT doc_id, seq, length(txt) AS n_chars, md5(txt) AS md5 FROM a",
    "bytes2text_whole": "SELECT doc_id, length(text) AS n_chars, md5(text) AS md5 FROM documents",
    "print_file": f"""
        WITH {_CHUNKS}
        SELECT doc_id, length(string_agg(txt, '' ORDER BY seq)) AS n_chars, md5(string_agg(txt, '' ORDER BY seq)) AS md5
        FROM a GROUP BY doc_id
    """,
    "sink_counts": f"WITH {_CHUNKS} SELECT doc_id, count(*) AS data_count FROM a GROUP BY doc_id",
    "sink_take_while": f"""
        WITH m AS (
            SELECT user_id, event_id, min(CASE WHEN NOT coalesce(value <= {THRESHOLD}, false) THEN event_id END)
                   OVER (PARTITION BY user_id) AS stop
            FROM events
        )
        SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS callback_index
        FROM m WHERE stop IS NULL OR event_id < stop
    """,
    "iter_status": f"""
        WITH {_CHUNKS}
        SELECT doc_id, seq AS step, 'IterFin' AS status FROM c
        UNION ALL
        SELECT doc_id, CAST((octet_length(encode(text)) + 8191) // 8192 AS BIGINT), 'Finished' FROM documents
    """,
    "demux_route": f"WITH {_PACKETS} SELECT packet_no, stream_index, {_ROUTE} FROM p WHERE stream_index < 2",
    "demux_iter_limit": f"""
        WITH {_PACKETS}
        SELECT packet_no, stream_index, {_ROUTE} FROM (SELECT * FROM p ORDER BY packet_no LIMIT {STEPS}) WHERE stream_index < 2
    """,
    "best_stream": f"""
        WITH k(event_type, stream_index) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in STREAMS)}), n AS (
            SELECT CASE WHEN event_type IN ('view', 'signup') THEN 'video' WHEN event_type = 'click' THEN 'audio'
                        ELSE 'other' END AS media_type,
                   stream_index, count(*) AS n_packets
            FROM events JOIN k USING (event_type) GROUP BY ALL
        )
        SELECT media_type, stream_index, n_packets FROM n
        QUALIFY row_number() OVER (PARTITION BY media_type ORDER BY n_packets DESC, stream_index) = 1
    """,
    "decode_pts": f"""
        WITH {_PACKETS}
        SELECT stream_index, row_number() OVER (PARTITION BY stream_index ORDER BY pts, packet_no) - 1 AS frame_no, pts
        FROM p WHERE stream_index < 2
    """,
    "decode_unflushed": f"""
        WITH {_PACKETS}, f AS (
            SELECT stream_index, pts, row_number() OVER (PARTITION BY stream_index ORDER BY pts DESC, packet_no DESC) AS back
            FROM p WHERE stream_index < 2
        )
        SELECT stream_index, count(*) AS frames, max(pts) AS last_pts FROM f WHERE back > 2 GROUP BY stream_index
    """,
    "packet_projection": f"WITH {_PACKETS} SELECT packet_no, stream_index, pts FROM p WHERE stream_index = 1",
    # Literal values, so that the tables behind the queries are checked too.
    "link_matrix": """
        WITH o(upstream) AS (VALUES ('TextTestSrc'), ('FileSrc'), ('Bytes2Text'), ('DemuxSrc.video'), ('DemuxSrc.audio'),
                                    ('VideoDecoder'), ('AudioDecoder')),
             i(sink) AS (VALUES ('StdoutLog'), ('Bytes2Text'), ('VideoDecoder'), ('AudioDecoder'))
        SELECT upstream, sink, (upstream, sink) IN (
            ('TextTestSrc', 'StdoutLog'), ('FileSrc', 'Bytes2Text'), ('Bytes2Text', 'StdoutLog'),
            ('DemuxSrc.video', 'VideoDecoder'), ('DemuxSrc.audio', 'AudioDecoder'),
            ('VideoDecoder', 'StdoutLog'), ('AudioDecoder', 'StdoutLog')
        ) AS links FROM o, i
    """,
    "error_text": """
        WITH e(family, kind, message) AS (
            VALUES ('pipeline', 'NoThreadHandle', 'No thread handle'),
                   ('pipeline', 'FailedToJoinThread', 'Failed to join thread'),
                   ('pipeline', 'NoSinkMessageSender', 'No sink message sender'),
                   ('pipeline', 'NoSinkMessageReceiver', 'No sink message receiver'),
                   ('pipeline', 'MessageSinkFailed', 'Message sink failed'),
                   ('pipeline', 'NoSinkElement', 'No sink element'),
                   ('pipeline', 'PipelineNotReady', 'Pipeline is not ready'),
                   ('pipeline', 'NoSinkDatagramSender', 'No sink datagram sender'),
                   ('pipeline', 'FailedToRecvFromParent', 'Failed to recv from parent'),
                   ('pipeline', 'ReceivedInvalidDatagramFromParent', 'Received invalid datagram from parent'),
                   ('pipeline', 'ReceivedInvalidDatagramFromSink', 'Received invalid datagram from sink'),
                   ('pipeline', 'ReceiveFromSinkFailed', 'Receive from sink failed'),
                   ('pipeline', 'MessageParentFailed', 'Message parent failed'),
                   ('pipeline', 'NoParentMessageSender', 'No parent message sender'),
                   ('pipeline', 'InvalidSinkType', 'Invalid sink type'),
                   ('pipeline', 'FailedToSendDatagramToSink', 'Failed to send datagram to sink'),
                   ('media', 'FailedToOpenInput', 'Failed to open input'),
                   ('media', 'FailedToFindBestStream', 'Failed to find best stream'),
                   ('media', 'FailedToReadFrame', 'Failed to read frame'),
                   ('media', 'FailedToFindDecoder', 'Failed to find decoder'),
                   ('media', 'FailedToCreateDecoder', 'Failed to create decoder'),
                   ('media', 'FailedToCopyCodecParamsToDecoder', 'Failed to copy codec params to decoder'),
                   ('media', 'FailedToOpenCodec', 'Failed to open codec'),
                   ('media', 'FailedToAllocFrame', 'Failed to alloc frame'),
                   ('media', 'FailedToAllocPacket', 'Failed to alloc packet'),
                   ('media', 'FailedToSendPacketToDecoder', 'Failed to send packet to decoder'),
                   ('media', 'FailedToReceiveDecodedFrame', 'Failed to receive decoded frame')
        )
        SELECT * FROM e UNION ALL SELECT 'wrapped', kind, 'AVError: ' || message FROM e WHERE family = 'media'
    """,
    "resource_uri": "SELECT page_id, 'file:' || url AS uri FROM pages",
    "codec_names": "SELECT * FROM (VALUES ('H264', 'libx264'), ('H265', 'libx265'), ('Opus', 'libopus')) AS c(codec, library)",
}
