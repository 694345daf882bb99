import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import rillwork
from rillwork import operators, sources
from rillwork.errors import MediaError, SendError
from rillwork.plans import Decoder, Pipeline, Stage, TestSink, TestSource, TextSource, Transform
from rillwork.plans.ports import TEXT_IN


def test_ranged_chunks(spark, tmp_path):
    """Files are read by ranges of bytes, several tasks a file, with the rows of the whole read."""
    (tmp_path / "a").write_bytes(bytes(k % 251 for k in range(100_003)))
    (tmp_path / "b").write_bytes(b"")
    (tmp_path / "c").write_bytes(b"x" * 64)
    uris = [f"file://{tmp_path}/{n}" for n in "abc"]
    df = sources.ranged_chunks(spark, *uris, size=64, chunks=100)
    assert df.rdd.getNumPartitions() == 17
    key = lambda r: (r.source_id.rsplit("/", 1)[1], r.seq, bytes(r.chunk))
    assert sorted(map(key, df.collect())) == sorted(map(key, sources.file_chunks(spark, str(tmp_path), 64).collect()))
    assert sources.ranged_chunks(spark).count() == 0


def test_take_while_of_null_keys(spark):
    rows = [(None, 0, True), (None, 1, False), (None, 2, True), ("a", 0, True), ("a", 1, None), ("b", 5, True), ("b", 4, True)]
    df = spark.createDataFrame(rows, "k string, seq long, ok boolean")
    kept = operators.take_while(df, F.col("ok"), "seq", "k")
    assert sorted(((r.k, r.seq) for r in kept.collect()), key=str) == [("a", 0), ("b", 4), ("b", 5), (None, 0)]
    assert "Window" not in kept._jdf.queryExecution().executedPlan().toString()


def test_cleanup_and_registration(spark):
    """Stages clean up once, the last first, and one that fails does not keep the others from it."""
    seen = []

    class Own(Transform):
        def cleanup(self):
            seen.append("own")
            raise ValueError("no")

    class Source(TextSource):
        def cleanup(self):
            seen.append("source")

    assert Stage.kinds["Own"] is Own and Own.log.name == "rillwork.Own" and "FileSource" in Stage.kinds
    pipeline = Pipeline(Source("a").link(Own(TEXT_IN, TEXT_IN, lambda df: df)), spark)
    with pipeline:
        pass
    pipeline.close()
    assert seen == ["own", "source"]


def test_decoder_of_a_stream(spark):
    streams = spark.createDataFrame(
        [("f", 0, "video", "avc1"), ("f", 1, "audio", "pcm_16"), ("f", 2, "video", "zzzz"), ("f", 3, "other", "text")],
        "source_id string, stream_index int, media_type string, codec_id string",
    )
    assert Decoder.of(streams, 0).stream_index == 0 and Decoder.of(streams, 1, delay=2).delay == 2
    for k in (2, 3):
        with pytest.raises(MediaError, match="AVError: Failed to find decoder"):
            Decoder.of(streams, k)
    with pytest.raises(MediaError, match="Failed to find best stream"):
        Decoder.of(streams, 9)


def test_names():
    assert str(SendError("closed")) == "SendError: closed" and rillwork.version()[0].isdigit()
    code = "import sys, rillwork.sources; assert 'rillwork.sources.media' not in sys.modules; rillwork.sources.media_packets"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(rillwork.__file__)))


def test_sources_reach_workers_that_lack_the_package(tmp_path):
    """In a process whose workers can't import the package by themselves."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(rillwork.__file__)))
    (tmp_path / "a").write_bytes(b"x" * 100)
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from rillwork import queries, sources
from rillwork.streaming import vector_stream
assert sources.ranged_chunks(spark, "file://{tmp_path}/a", size=10).count() == 10
assert queries.media_round_trip(spark, "/root/testdata/sf0.001").count() == 1000
q = vector_stream(spark, ["a", "b"]).writeStream.format("memory").queryName("t").trigger(availableNow=True).start()
q.awaitTermination(60)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env, timeout=240)


def test_vector_is_numbered_in_order(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("id"))
    rows = sources.vector_rows(df, F.lit("text"), F.col("id").cast("string"), "id").collect()
    assert sorted((r.seq, r.text) for r in rows) == [(k, str(k)) for k in range(1000)]
    source = TestSource(TEXT_IN, [("text", "a")])
    assert source.link(TestSink(TEXT_IN, lambda n, r: True)).child().taken == TEXT_IN


def test_vector_larger_than_the_sample_of_its_ranges_is_numbered_without_gaps(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("id"))
    rows = sources.vector_rows(df, F.lit("text"), F.concat(F.lit("event "), F.col("id")), "id").collect()
    assert sorted((r.seq, r.text) for r in rows) == [(k, f"event {k}") for k in range(20_000)]


def test_vector_of_values_without_a_type(spark):
    rows = sources.vector_rows(spark.range(3), F.lit("message"), F.lit(None), "id").collect()
    assert sorted((r.seq, r.kind, r.text) for r in rows) == [(k, "message", None) for k in range(3)]
