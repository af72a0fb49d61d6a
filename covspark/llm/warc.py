"""WARC: response records, their files, and the derivatives built from them.

``responses`` makes response records of pages, ``write`` and ``read`` are the file format, and
``derive`` converts every response into two linked records: a metadata record, which keeps the
source's HTTP status and headers, its digests, title and outgoing links, and a conversion record,
which is its plain text. Both name the response in WARC-Refers-To, with its URI and date. Record
ids are derived from content, so a rerun gives the same ids.

Records are independent, so nothing is shuffled. Spark's text writer writes the files: the two line
ends that close a record are its separator. They can go to any store; ``per_file`` bounds a file,
which one task reads as a whole.

Defined results: a null page is an empty payload with an empty text; a null URL is an empty URI;
repeated pages give records with the same ids. A block without an HTTP head is all payload. Text
keeps character references it can't resolve. A file that ends inside a record fails. An empty table
gives no records. Columns beside id, URL and HTML are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
RECORD = "record_type string, record_id string, target_uri string, date string, source_id string, refers_to string, headers map<string,string>, block binary"
_MAP = pa.map_(pa.string(), pa.string())

# fixed values: elements whose content is no text, and those that start a new line
SILENT = "script|style|template|noscript"
BLOCKS = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|"
    "html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul"
)
_GONE = re.compile(rf"<!--.*?(?:-->|\Z)|<({SILENT})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(rf"</?(?:{BLOCKS})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>", re.I)
_TAG = re.compile(r"<[/!?a-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[/!?a-z][^>]*+>", re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)


def plain_text(page: str) -> str:
    """Visible text, a line for each block that has any, runs of white space as one space."""
    text = _BREAK.sub("\n", _GONE.sub(" ", page))
    text = html.unescape(_TAG.sub("", text))
    lines = (" ".join(x.split()) for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def title(page: str) -> str:
    found = _TITLE.search(page)
    return " ".join(html.unescape(_TAG.sub("", found[1])).split()) if found else ""


def links(page: str) -> list[str]:
    """Targets of anchors in order, each once."""
    found = (html.unescape(next(x for x in m if x or x == m[-1])) for m in _LINK.findall(_GONE.sub(" ", page)))
    return list(dict.fromkeys(" ".join(x.split()) for x in found if x))


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def _line(value: str) -> str:
    """A header value can't hold line ends."""
    return " ".join(value.split())


def serialize(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    head = b"".join(f"{k}: {_line(v)}\r\n".encode() for k, v in [*headers, ("Content-Length", str(len(block)))])
    return VERSION + b"\r\n" + head + b"\r\n" + block


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed file."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError("no WARC record where one must start")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, size = end + 4, int(headers["Content-Length"])
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record is cut short")
        yield headers, data[start : start + size]
        at = start + size + 4


def http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, header fields and payload of an HTTP response."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], payload


def responses(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", date: str = "2024-01-01T00:00:00Z"
) -> DataFrame:
    """A response record for each page: source_id and record (binary, serialized)."""
    rows = pages.select(F.col(page_id).cast("string").alias("i"), F.col(url).alias("u"), F.col(page).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                out = []
                for i, u, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    payload, i, u = (h or "").encode(), i or "", _line(u or "")
                    own = digest(payload)
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                    headers = [
                        ("WARC-Type", "response"),
                        ("WARC-Record-ID", record_id("response", i, u, own)),
                        ("WARC-Date", date),
                        ("WARC-Target-URI", u),
                        ("WARC-Source-ID", i),
                        ("WARC-Payload-Digest", own),
                        ("WARC-Block-Digest", digest(block)),
                        ("Content-Type", "application/http; msgtype=response"),
                    ]
                    out.append(serialize(headers, block))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["source_id", "record"])

    return rows.mapInArrow(run, "source_id string, record binary")


def write(records: Column, rows: DataFrame, at: str, per_file: int = 5000) -> None:
    """Write serialized records to gzipped WARC files in the new folder ``at``."""
    (
        rows.select(records.cast("string").alias("value"))
        .write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", per_file)
        .text(at)
    )


def read(spark: SparkSession, at: str) -> DataFrame:
    """The records of all files below ``at``."""
    files = spark.read.format("binaryFile").load(at).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                data = b.column(0)[r].as_py()
                if data[:2] == b"\x1f\x8b":
                    members = []
                    while data:
                        unzip = zlib.decompressobj(31)
                        members.append(unzip.decompress(data))
                        data = unzip.unused_data
                    data = b"".join(members)
                rows = []
                for headers, block in parse(data):
                    rows.append((headers, block))
                    if len(rows) == 64:
                        yield _records(rows)
                        rows = []
                if rows:
                    yield _records(rows)

    return files.mapInArrow(run, RECORD)


def _records(rows: list[tuple[dict[str, str], bytes]]) -> pa.RecordBatch:
    get = lambda k: pa.array([h.get(k) for h, _ in rows], pa.string())
    return pa.RecordBatch.from_arrays(
        [
            *map(get, ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Date", "WARC-Source-ID", "WARC-Refers-To")),
            pa.array([list(h.items()) for h, _ in rows], _MAP),
            pa.array([b for _, b in rows], pa.binary()),
        ],
        names=["record_type", "record_id", "target_uri", "date", "source_id", "refers_to", "headers", "block"],
    )


def derive(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response; other records are left out."""
    rows = records.where(F.col("record_type") == "response").select("record_id", "target_uri", "date", "source_id", "headers", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                out = []
                for r in whole.slice(at, 64).to_pylist():
                    out += derivatives(
                        r["record_id"] or "", r["target_uri"] or "", r["date"] or "", r["source_id"] or "", dict(r["headers"] or []), r["block"] or b""
                    )
                yield _records(out)

    return rows.mapInArrow(run, RECORD)


def derivatives(source: str, uri: str, date: str, source_id: str, headers: dict[str, str], block: bytes) -> list:
    """Headers and block of the two records made of one response."""
    status, fields, payload = http(block)
    page = payload.decode("utf-8", "replace")
    own = headers.get("WARC-Payload-Digest") or digest(payload)
    notes = [("source-status", status), *((f"source-header-{k.lower()}", v) for k, v in fields)]
    notes += [("source-payload-digest", own), ("source-block-digest", headers.get("WARC-Block-Digest") or digest(block))]
    notes += [("title", title(page)), *(("outlink", x) for x in links(page))]
    out = []
    for kind, mime, data in (
        ("metadata", "application/warc-fields", "".join(f"{k}: {_line(v)}\r\n" for k, v in notes).encode()),
        ("conversion", "text/plain", plain_text(page).encode("utf-8", "replace")),
    ):
        made = {
            "WARC-Type": kind,
            "WARC-Record-ID": record_id(kind, source),
            "WARC-Date": date,
            "WARC-Target-URI": uri,
            "WARC-Source-ID": source_id,
            "WARC-Refers-To": source,
            "WARC-Refers-To-Target-URI": uri,
            "WARC-Refers-To-Date": date,
            "WARC-Source-Payload-Digest": own,
            "WARC-Block-Digest": digest(data),
            "Content-Type": mime,
            "Content-Length": str(len(data)),
        }
        out.append((made, data))
    return out


def serialized(records: DataFrame) -> DataFrame:
    """The records as the bytes that ``write`` takes: source_id and record."""
    rows = records.select("source_id", F.map_entries("headers").alias("headers"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [
                serialize([(h["key"], h["value"]) for h in r["headers"] if h["key"] != "Content-Length"], r["block"] or b"")
                for r in b.to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["source_id", "record"])

    return rows.mapInArrow(run, "source_id string, record binary")
