"""Readers, sinks, the command line and the stream."""

import itertools
import sys

import pytest
from pyspark import cloudpickle

from lectern import schemas
from lectern.errors import LecternError
from lectern.operators import quality
from lectern.plans import cli, extract, fixtures
from lectern.sources import readers, sinks
from lectern.sources.rtf import read_rtf
from lectern.streaming import narrate

# Workers do not find this module: what tasks need of it travels with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.mark.parametrize("text", ["Plain {braces} \\ and\nlines", "é ü € — 😀 日本", ""])
def test_rtf_round_trip(text):
    assert read_rtf(fixtures.rtf_of(text)) == text


@pytest.mark.parametrize(
    ("data", "text"),
    [(rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\f0 Hi\par ther\'e9}", "Hi\ntheré"), (rb"{\rtf1\mac \'8e}", "é"), (rb"{\rtf1\pc \'82}", "é"), (rb"{\rtf1\ansi\uc1 \u233?x{\*\gen y}}", "éx"), (rb"{\rtf1 a\~b\_c\-d}", "a b-cd")],
)
def test_rtf_reads(data, text):
    assert read_rtf(data) == text


@pytest.mark.parametrize("data", [b"no", rb"{\rtf1 open", rb"{\rtf1 a} b", rb"{\rtf1 \bin3 abc}", rb"{\rtf1 a {\v b}}", rb"{\rtf1 \deleted a}", rb"{\rtf1\ansicpg99999 a}"])
def test_rtf_refuses(data):
    with pytest.raises(LecternError):
        read_rtf(data)


def test_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes(b"\xef\xbb\xbfone\r\ntwo\rthree\n")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.Rtf").write_bytes(rb"{\rtf1 body}")
    (tmp_path / "d.rtf").write_bytes(b"no")
    got = {r.path[-5]: (r.narration, r.error) for r in readers.read_texts(readers.files(spark, str(tmp_path))).collect()}
    assert got["a"] == ("one\ntwo\nthree\n", None) and got["b"] == (None, "not UTF-8 text") and got["c"] == ("body", None) and got["d"][1].startswith("RTF")
    (tmp_path / "A.rtf").write_bytes(b"x")
    with pytest.raises(LecternError, match="named a"):
        readers.validate(readers.files(spark, str(tmp_path)))
    (tmp_path / "e.doc").write_bytes(b"x")
    with pytest.raises(LecternError, match="inputs end in"):
        readers.validate(readers.files(spark, str(tmp_path)))
    with pytest.raises(LecternError):
        readers.resolve("nothing.txt", (str(tmp_path),))
    assert readers.resolve("b.txt", (str(tmp_path),)).endswith("b.txt")


def test_pdf_rows_come_from_a_parser(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"page")
    got = readers.read_pdf(readers.files(spark, str(tmp_path)), lambda b: [{"page": 1, "page_text": b.decode()}], schemas.PAGE_TEXTS).collect()
    assert [(r.page, r.page_text) for r in got] == [(1, "page")]


class Client:
    """A service that finishes at the second look."""

    def __init__(self, body=b"audio"):
        self.body, self.looks, self.deleted = body, itertools.count(), []

    def voices(self, engine):
        return ["Matthew"]

    def start(self, text, key):
        return key

    def status(self, task):
        return ("completed", f"u/{task}") if next(self.looks) % 2 else ("inProgress", None)

    def download(self, uri):
        yield self.body

    def size(self, uri):
        return len(self.body)

    def version(self, uri):
        return "v1"

    def copy(self, uri, key):
        return f"u/readable/{key}"

    def delete(self, uri, version):
        self.deleted.append((uri, version))


class Broken(Client):
    """A service that refuses one text."""

    def start(self, text, key):
        if "bad" in text:
            raise ValueError("refused")
        return key

    def status(self, task):
        return "completed", f"u/{task}"


def test_speech_helpers(tmp_path):
    now, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 2))
        now[0] += s

    pacer = sinks.Pacer(clock=lambda: now[0], sleep=sleep)
    for kind in ("start", "start", "status", "status", "start"):
        pacer.wait(kind)
    assert slept == [1.1, 0.11, 0.99]
    client = Client()
    assert sinks.await_task(client, "k", sleep=lambda s: None) == "u/k"
    with pytest.raises(LecternError, match="more than 5s"):
        sinks.await_task(type("Slow", (Client,), {"status": lambda self, t: ("inProgress", None)})(), "k", timeout=5, clock=iter([0, 1, 6]).__next__, sleep=lambda s: None)
    assert len(sinks.download_verified(client, "u", str(tmp_path / "a.mp3"))) == 64
    with pytest.raises(LecternError):
        sinks.download_verified(Client(b""), "u", str(tmp_path / "b.mp3"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.mp3"]
    assert sinks.delete_copies(client, [("u", "v1")]) == [] and client.deleted == [("u", "v1")]
    got = sinks.fetch(client, sinks.Pacer(0, 0), "t", "k", str(tmp_path / "c.mp3"), sinks.SpeechOptions("b"), sleep=lambda s: None)
    assert len(got) == 64 and client.deleted[-1] == ("u/k", "v1")
    with pytest.raises(LecternError):
        sinks.check_voice(client, sinks.SpeechOptions("b", voice="Other"))


def test_tasks_keep_one_pace_together():
    """Starts of many tasks that begin at any time are never closer than the gap."""
    starts = []
    for turn, begin in enumerate([0.0, 0.3, 5.7, 0.0]):
        now = [begin]

        def sleep(s, now=now):
            now[0] += s

        pacer = sinks.Pacer(clock=lambda now=now: now[0], sleep=sleep, turn=turn, turns=4)
        for _ in range(5):
            pacer.wait("start")
            starts.append(now[0])
            now[0] += 0.01
    starts.sort()
    assert min(b - a for a, b in zip(starts, starts[1:], strict=False)) >= 1.1 - 1e-6


def test_speech_sink_stops_at_a_failure(spark, tmp_path):
    options = sinks.SpeechOptions("b", poll_seconds=0)
    rows = [(i, 1, f"{i}.mp3", "bad" if i == 2 else "good", f"k{i}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, part int, file string, text string, key string").coalesce(1)
    got = {r.doc_id: r for r in sinks.speak(df, Broken, str(tmp_path), options, jobs=1).collect()}
    errors = [got[i].error for i in range(6)]
    assert errors.count("refused") == 1 and set(errors) == {None, "refused", sinks.NOT_SUBMITTED}
    for i in range(6):
        assert (tmp_path / f"{i}.mp3").exists() == (got[i].error is None) == (got[i].sha256 is not None)
    with pytest.raises(LecternError, match="voice"):
        sinks.speak(df, Broken, str(tmp_path), sinks.SpeechOptions("b", voice="Other"))


def parse(data: bytes):
    """Each line of a file as a block."""
    return [{"seq": i, "text": t, "label": "text", "page": 1, "left": 50.0, "top": 700.0 - 50 * i, "right": 550.0, "bottom": 660.0 - 50 * i, "page_width": 612.0, "page_height": 792.0} for i, t in enumerate(data.decode().split("\n"))]


def test_command_line_takes_pdfs_with_a_parser(tmp_path, capsys, monkeypatch):
    (tmp_path / "a.pdf").write_bytes(b"The first line goes on\nin the second.")
    (tmp_path / "b.txt").write_text("Plain.")
    assert cli.main(["extract", f"{tmp_path}/a.pdf", "--output", f"{tmp_path}/none"]) == 1
    assert "need --pdf-parser" in capsys.readouterr().err
    monkeypatch.setattr(cli, "_parser_of", lambda name: parse)
    assert cli.main(["make", f"{tmp_path}/a.pdf", f"{tmp_path}/b.txt", "--pdf-parser", "lineparser:parse", "--output", f"{tmp_path}/out"]) == 0
    from lectern.session import local_session

    texts = {r.text for r in local_session("lectern-cli").read.parquet(f"{tmp_path}/out").collect()}
    assert texts == {"The first line goes on in the second.", "Plain."}


def test_keys(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("My Case", 1, 2), ("n" * 1100, 1, 1)], "name string, part int, parts int")
    rows = df.select(sinks.audio_key(F.col("name"), F.col("part"), F.col("parts"), "/p/").alias("k"), sinks.audio_file(F.col("name"), F.col("part"), F.col("parts")).alias("f")).collect()
    assert rows[0].k == "p/My Case-part-001.mp3" and rows[0].f == "My Case-part-001.mp3" and rows[1].k is None


def test_extract_plan(spark):
    blocks = spark.createDataFrame(
        [(1, 0, "The plan was to", "text", 1, 50.0, 600.0, 550.0, 500.0, 612.0, 792.0), (1, 1, "Sample | Page 1", "text", 1, 50.0, 60.0, 550.0, 44.0, 612.0, 792.0), (1, 2, "sell Secret Name (Doe & Roe, 2015).", "text", 2, 50.0, 600.0, 550.0, 500.0, 612.0, 792.0), (1, 3, "Sample | Page 2", "text", 2, 50.0, 60.0, 550.0, 44.0, 612.0, 792.0)],
        schemas.BLOCKS,
    )
    objects = spark.createDataFrame([(1, 2, 0, "Secret Name", 100.0, 550.0, 160.0, 560.0)], schemas.TEXT_OBJECTS)
    paths = spark.createDataFrame([(1, 2, 95.0, 545.0, 165.0, 565.0, True, 0, 0, 0, 255)], schemas.PATHS)
    r = extract.extract(extract.Parsed(blocks, fixtures.page_dims(blocks), objects=objects, paths=paths)).first()
    assert r.narration == "The plan was to sell [redacted].\n" and r.status == "PASS"
    assert {f.code for f in r.findings} == {"MARGIN_TEXT_REMOVED", "REDACTION_SCRUBBED", "AUTHOR_YEAR_CITATIONS_REMOVED"}


def test_command_line(tmp_path, capsys):
    (tmp_path / "a.txt").write_text("# Title\n\nSome prose.")
    assert cli.main(["make", f"{tmp_path}/a.txt", "--output", f"{tmp_path}/out"]) == 0
    (tmp_path / "bad.txt").write_text("9 8 7 " * 100)
    assert cli.main(["speak", f"{tmp_path}/bad.txt", "--output", f"{tmp_path}/out2"]) == 1
    assert "BLOCKED" in capsys.readouterr().out
    assert cli.main(["doctor"]) == 0


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "# A\n\nProse."), (2, "")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    narrate.write_passed(narrate.narrate(narrate.read_documents(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    want = quality.passed(narrate.narrate(docs)).select("doc_id", "narration", "status").collect()
    assert spark.read.parquet(f"{tmp_path}/out").collect() == want != []
