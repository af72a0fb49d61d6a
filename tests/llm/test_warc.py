import hashlib
import base64
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from covspark.llm import warc

PAGES = [
    (1, "http://a.example/x", "<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{x:'</p>'}</style><script>var t='</p>';</script></head>"
     "<body><!-- gone --><p>One <b>bold</b> word<br>next &lt;tag&gt; &eacute;<p>Two <a href=\"/l?a=1&amp;b=2\">link</a><a href='/m'>m</a><a href=/m>m</a></body></html>", "q"),
    (2, None, None, "q"),
    (3, "http://b.example/\r\nEvil: 1", "", "q"),
    (4, "http://c.example/", "no tags, 3 < 4 and \r\n\r\nWARC/1.1\r\n\r\n &nosuch; é日😀 <a title='>' href=\"z\">t</a><script>never closed", "q"),
    (4, "http://c.example/", "no tags", "q"),
    (5, "http://d.example/", "<p>" + "long text " * 20000 + "</p>", "q"),
]


@pytest.fixture(scope="module")
def derived(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("warc") / "w")
    df = spark.createDataFrame(PAGES + PAGES[:1], "page_id long, url string, html string, record string")
    warc.write(F.col("record"), warc.responses(df.repartition(2)), at, per_file=2)
    records = warc.read(spark, at)
    return records.collect(), warc.derive(records).collect(), warc.derive(records), at


def test_responses_survive_the_files(derived):
    records, *_ = derived
    assert len(records) == len(PAGES) + 1
    by = {(r.source_id, r.target_uri): r for r in records}
    assert by["3", "http://b.example/ Evil: 1"].headers.get("Evil") is None
    for i, u, h, _ in PAGES:
        payload = (h or "").encode()
        found = [r for r in records if r.source_id == str(i) and warc.http(bytes(r.block))[2] == payload]
        sha = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert found and found[0].headers["WARC-Payload-Digest"] == sha


def test_links_and_digests(derived):
    records, made, *_ = derived
    ids = {r.record_id: r for r in records}
    assert len(made) == 2 * len(records)
    for r in made:
        source = ids[r.refers_to]
        assert r.target_uri == source.target_uri and r.headers["WARC-Refers-To-Date"] == source.date
        assert r.headers["WARC-Source-Payload-Digest"] == source.headers["WARC-Payload-Digest"]
        assert r.headers["WARC-Block-Digest"] == warc.digest(bytes(r.block))
    first = {r.record_type: bytes(r.block).decode() for r in made if r.source_id == "1"}
    assert first["conversion"] == "A & B\nOne bold word\nnext <tag> é\nTwo linkmm"
    assert "source-status: HTTP/1.1 200 OK\r\nsource-header-content-type: text/html; charset=utf-8\r\n" in first["metadata"]
    assert first["metadata"].endswith("title: A & B\r\noutlink: /l?a=1&b=2\r\noutlink: /m\r\n")
    texts = {(r.source_id, bytes(r.block).decode()) for r in made if r.record_type == "conversion"}
    assert ("4", "no tags, 3 < 4 and\nWARC/1.1\n&nosuch; é日😀 t") in texts and ("2", "") in texts
    assert {len(t) for i, t in texts if i == "5"} == {len("long text " * 20000) - 1}


def test_derivatives_can_be_written(spark, derived, tmp_path):
    *_, frame, _ = derived
    warc.write(F.col("record"), warc.serialized(frame), str(tmp_path / "d"))
    again = warc.read(spark, str(tmp_path / "d")).collect()
    key = lambda r: (r.record_id, bytes(r.block))
    assert sorted(map(key, again)) == sorted(map(key, frame.collect()))


class Text(HTMLParser):
    """Brute force: the parser of the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.mute = [], 0

    def handle_starttag(self, tag, attrs):
        self.mute += tag in warc.SILENT.split("|")
        self.out.append("\n" * (tag in warc.BLOCKS.split("|")))

    def handle_endtag(self, tag):
        self.mute -= tag in warc.SILENT.split("|")
        self.out.append("\n" * (tag in warc.BLOCKS.split("|")))

    def handle_data(self, data):
        self.out.append("" if self.mute else data)


def test_text_like_a_parser(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        t = Text()
        t.feed(r.html)
        t.close()
        lines = (" ".join(x.split()) for x in "".join(t.out).split("\n"))
        assert warc.plain_text(r.html) == "\n".join(x for x in lines if x)


def test_damage_and_empty(spark, tmp_path):
    good = warc.serialize([("WARC-Type", "x")], b"abc") + b"\r\n\r\n"
    assert [b for _, b in warc.parse(good * 2)] == [b"abc"] * 2
    for bad in (good[:-5], b"x" + good):
        with pytest.raises(ValueError):
            list(warc.parse(bad))
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(F.col("record"), warc.responses(df), str(tmp_path / "e"))
    assert warc.derive(warc.read(spark, str(tmp_path / "e"))).count() == 0
