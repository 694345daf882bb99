import io

import pytest
from pyspark.sql import functions as F

from rillwork.errors import InvalidDatagram, InvalidSinkType, MediaError, NoSinkElement, PipelineFinished, PipelineNotReady, StageFailed
from rillwork.plans import (
    BytesToText,
    Decoder,
    FileSource,
    MediaSplit,
    Pipeline,
    Status,
    TestSink,
    TestSource,
    TextConsole,
    TextSource,
    Transform,
)
from rillwork.plans.ports import AUDIO_IN, BYTES_IN, TEXT_IN, VIDEO_IN

PORTS = {"text": TEXT_IN, "bytes": BYTES_IN, "video": VIDEO_IN, "audio": AUDIO_IN}


def upstreams():
    yield TextSource(), "out", "text"
    yield FileSource("x"), "out", "bytes"
    yield BytesToText(), "out", "text"
    yield MediaSplit("x"), "video", "video"
    yield MediaSplit("x"), "audio", "audio"
    yield Decoder(0, "video"), "out", "text"
    yield Decoder(1, "audio"), "out", "text"
    for name, port in PORTS.items():
        yield TestSource(port, []), "out", name


def downstreams():
    yield TextConsole(), "text"
    yield BytesToText(), "bytes"
    yield Decoder(0, "video"), "video"
    yield Decoder(0, "audio"), "audio"
    for name, port in PORTS.items():
        yield TestSink(port, lambda n, r: True), name
    yield TextSource(), None
    yield FileSource("x"), None


def test_link_matrix():
    for up, output, asks in upstreams():
        for down, takes in downstreams():
            if asks == takes:
                assert up.link(down, output).child(output) is down
            else:
                with pytest.raises(InvalidSinkType):
                    up.link(down, output)


def test_linking_again_replaces():
    source, one, two = TextSource(), TextConsole(), TextConsole()
    assert source.link(one).link(two).child() is two
    with pytest.raises(NoSinkElement):
        TextSource().child()


def test_status_of_steps(spark):
    seen = []
    source = TestSource(TEXT_IN, [("text", "Hello"), ("text", "Hello")])
    source.link(TestSink(TEXT_IN, lambda n, r: seen.append((n, r["text"])) or True))
    pipeline = Pipeline(source, spark)
    with pytest.raises(PipelineNotReady):
        pipeline.iter()
    with pipeline:
        assert [pipeline.iter() for _ in range(3)] == [Status.ITER_FIN, Status.ITER_FIN, Status.FINISHED]
        for _ in range(2):
            with pytest.raises(PipelineFinished):
                pipeline.iter()
    assert seen == [(0, "Hello"), (1, "Hello")]
    with pytest.raises(InvalidSinkType):
        Pipeline(TextConsole(), spark)


def test_callback_stops(spark):
    seen = []
    source = TestSource(TEXT_IN, [("text", str(k)) for k in range(5)])
    source.link(TestSink(TEXT_IN, lambda n, r: seen.append(r["text"]) or n < 2))
    with Pipeline(source, spark) as pipeline:
        for _ in range(3):
            pipeline.iter()
        with pytest.raises(StageFailed):
            pipeline.iter()
    assert seen == ["0", "1", "2"]


def test_messages_are_counted_apart(spark):
    messages = []
    source = TestSource(TEXT_IN, [("text", "a"), ("message", "Quit"), ("text", "b")])
    sink = TestSink(TEXT_IN, lambda n, r: True, lambda n, m: messages.append((n, m)) or False)
    with Pipeline(source.link(sink), spark) as pipeline:
        pipeline.run_all()
    assert messages == [(0, "Quit")] and sink.data_count == 1


def test_hello_world(spark):
    out = io.StringIO()
    with Pipeline(TextSource("Hello, World!\n").link(TextConsole(out)), spark) as pipeline:
        pipeline.iter()
    assert out.getvalue() == "Hello, World!\n"


def test_console_takes_texts_until_quit(spark):
    out = io.StringIO()
    source = TestSource(TEXT_IN, [("text", "a"), ("text", "b"), ("message", "Quit"), ("text", "c")])
    with Pipeline(source.link(TextConsole(out)), spark) as pipeline:
        pipeline.run_all()
    assert out.getvalue() == "ab"
    source = TestSource(TEXT_IN, [("bytes", b"x")])
    with Pipeline(source.link(TextConsole(out)), spark) as pipeline, pytest.raises(Exception, match="invalid datagram"):
        pipeline.run_all()
    assert "invalid datagram" in str(InvalidDatagram())


@pytest.mark.parametrize("step", [False, True])
def test_print_file(spark, tmp_path, step):
    text = "zeile äöü\n" * 1500
    (tmp_path / "f.txt").write_text(text)
    out = io.StringIO()
    source = FileSource(str(tmp_path / "f.txt"), size=10 * 13).link(BytesToText().link(TextConsole(out)))
    with Pipeline(source, spark) as pipeline:
        if step:
            for _ in range(3):
                pipeline.iter()
        else:
            pipeline.run_all()
    assert out.getvalue() == (text.encode()[:390].decode() if step else text)


def test_a_cut_character_ends_the_stage(spark, tmp_path):
    (tmp_path / "f").write_bytes("aaaä bbbb".encode())
    out = io.StringIO()
    source = FileSource(str(tmp_path / "f"), size=4).link(BytesToText().link(TextConsole(out)))
    with Pipeline(source, spark) as pipeline:
        assert pipeline.iter() is Status.ITER_FIN
        with pytest.raises(StageFailed):
            pipeline.iter()
    assert out.getvalue() == ""
    whole = FileSource(str(tmp_path / "f"), size=4).link(BytesToText("whole").link(TextConsole(out)))
    with Pipeline(whole, spark) as pipeline:
        pipeline.run_all()
    assert out.getvalue() == "aaaä bbbb"


def test_own_transform(spark):
    out = io.StringIO()
    upper = Transform(TEXT_IN, TEXT_IN, lambda df: df.withColumn("text", F.upper("text")))
    with Pipeline(TextSource("abc", n=2).link(upper.link(TextConsole(out))), spark) as pipeline:
        pipeline.run_all()
    assert out.getvalue() == "ABCABC"


def test_error_text():
    assert str(PipelineNotReady()) == "Pipeline is not ready"
    assert str(MediaError("FailedToReadFrame")) == "AVError: Failed to read frame"
