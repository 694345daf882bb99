import io

from pyspark.sql import functions as F

from rillwork import operators, streaming


def test_one_datum_a_batch(spark, tmp_path):
    out = io.StringIO()
    query = streaming.print_stream(streaming.vector_stream(spark, ["a", "b", "c"]), str(tmp_path), out)
    query.processAllAvailable()
    sizes = [p.numInputRows for p in query.recentProgress if p.numInputRows]
    query.stop()
    assert out.getvalue() == "abc" and len(sizes) == 3


def write_packets(spark, path, rows):
    df = spark.createDataFrame(rows, "packet_no long, stream_index int, pts long")
    df.select(F.lit("s").alias("source_id"), "packet_no", "stream_index", "pts", F.col("pts").alias("dts"), F.lit(b"").alias("payload")).coalesce(
        1
    ).write.mode("append").parquet(path)


def test_fan_out_reads_once(spark, tmp_path):
    path = str(tmp_path / "packets")
    write_packets(spark, path, [(k, k % 3, k) for k in range(30)])
    counts: dict[str, int] = {"video": 0, "audio": 0}

    def branch(name):
        def count(batch):
            counts[name] += operators.route(batch, 0, 1).filter(F.col("route") == name).count()

        return count

    query = streaming.fan_out(streaming.packet_stream(spark, path), [branch("video"), branch("audio")], str(tmp_path / "c"))
    query.awaitTermination(120)
    assert counts == {"video": 10, "audio": 10}


def test_stateful_decode_over_batches(spark, tmp_path):
    path = str(tmp_path / "packets")
    write_packets(spark, path, [(0, 0, 0), (1, 0, 30), (2, 0, 10)])
    write_packets(spark, path, [(3, 0, 20), (4, 0, 40)])
    frames = streaming.decode_stream(streaming.packet_stream(spark, path, files=1), delay=2)
    query = frames.writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = spark.table("frames").orderBy("frame_no").collect()
    assert [(r.frame_no, r.pts) for r in rows] == [(0, 0), (1, 10), (2, 20)]


def test_constant_stream(spark, tmp_path):
    stream = streaming.constant_text_stream(spark, "x")
    assert stream.isStreaming and stream.columns == ["seq", "text"]
