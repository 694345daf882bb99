import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillwork import operators, sources
from rillwork.functions import CODECS, codec_library, file_uri

EDGES = [b"", b"abc", "é€😀".encode(), b"\xff", b"abc\xc3", "aaa€".encode() + b"\xff" + b"zz"]


def strict(data: bytes, size: int) -> list[str]:
    out = []
    for k in range(0, len(data), size):
        try:
            out.append(data[k : k + size].decode())
        except UnicodeDecodeError:
            break
    return out


def check(spark, blobs, size):
    df = spark.createDataFrame(list(enumerate(blobs)), "id int, data binary")
    chunks = sources.chunk_column(df, F.col("data"), "id", size=size)
    back: dict[int, list] = {}
    for r in sorted(chunks.collect()):
        back.setdefault(r.id, []).append(bytes(r.chunk))
    assert {k: b"".join(v) for k, v in back.items()} == {k: b for k, b in enumerate(blobs) if b}
    got: dict[int, list] = {}
    for r in sorted(operators.bytes_to_text(chunks, "id").collect()):
        got.setdefault(r.id, []).append(r.text)
    assert got == {k: s for k, b in enumerate(blobs) if (s := strict(b, size))}
    whole = {r.id: r.text for r in operators.bytes_to_text(chunks, "id", mode="whole").collect()}
    for k, b in enumerate(blobs):
        try:
            want = b.decode() if b else None
        except UnicodeDecodeError:
            want = None
        assert whole.get(k) == want


@pytest.mark.parametrize("size", [1, 3, 8192])
def test_edges(spark, size):
    check(spark, EDGES, size)


def test_chunks_of_data_without_bytes(spark):
    df = spark.createDataFrame([(0, b""), (1, None), (2, b"abc")], "id int, data binary")
    kept = [tuple(r) for r in sources.chunk_column(df, F.col("data"), "id", size=2, keep_empty=True).collect()]
    assert sorted(kept, key=lambda r: r[:2]) == [(0, 0, b""), (1, 0, None), (2, 0, b"ab"), (2, 1, b"c")]
    assert {r.id for r in sources.chunk_column(df, F.col("data"), "id", size=2).collect()} == {2}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.binary(max_size=20), st.text(max_size=12).map(lambda s: s.encode("utf-8", "replace"))), min_size=1, max_size=12))
def test_random_bytes(spark, blobs):
    check(spark, blobs, 5)


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        operators.bytes_to_text(spark.createDataFrame([], "id int, seq long, chunk binary"), "id", mode="x")
    with pytest.raises(ValueError):
        sources.vector(spark, [("frame", 1)])


def test_take_while_without_key(spark):
    df = spark.range(10)
    assert operators.take_while(df, F.col("id") != 4, "id").count() == 4
    assert operators.take_while(df, F.lit(True), "id").count() == 10
    assert operators.take_while(df.limit(0), F.lit(True), "id").count() == 0


def test_limit_comes_before_the_filter(spark):
    df = spark.range(100)
    assert operators.limit_then(df, 15, "id", lambda d: d.filter("id % 3 = 0")).count() == 5


def test_call_back(spark):
    seen = []
    n = operators.call_back(sources.constant_text(spark, 5), lambda k, r: seen.append(k) or k < 2)
    assert n == 2 and seen == [0, 1, 2]


def test_names(spark):
    row = spark.range(1).select(file_uri(F.lit("/a b")).alias("u"), codec_library(F.lit("Opus")).alias("c")).first()
    assert row.u == "file:/a b" and row.c == CODECS["Opus"]
