"""WARC derivatives: each response gives a metadata record and a plain-text conversion record.

Both name the response they are made from (WARC-Refers-To, its URI and date) and each other
(WARC-Concurrent-To), and keep the response's digests and HTTP headers. Record ids are UUIDs of the
response's id and the record's type, so a task that runs again makes the same records.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table, tidy

_TAG = r"""<[!/?a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[!/?a-zA-Z][^>]*+>"""
_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAKS = re.compile(r"<\s*/?\s*(?:p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|thead|tbody|article|section|aside|nav|header|footer|main|blockquote|pre|hr|form|figure|figcaption|option|title|head|body|html)\b[^>]*+>", re.I)
_CELLS = re.compile(r"<\s*/?\s*(?:td|th)\b[^>]*+>", re.I)
_ANY = re.compile(_TAG)
_TITLE = re.compile(r"<title\b[^>]*+>(.*?)</title\s*>", re.S | re.I)
_LINK = re.compile(r"<(a|area|link|img|script|iframe|source|base)\b((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.I)
_META = re.compile(r"<meta\b((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.I)
_HTML = re.compile(r"<html\b((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.I)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"[ \t\r\f\v\xa0]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def attributes(tag: str) -> dict[str, str]:
    return {k.lower(): html.unescape(a or b or c) for k, a, b, c in reversed(_ATTRIBUTE.findall(tag))}


def plain_text(page: str) -> str:
    """The page's visible text, a line for each block."""
    page = _DROPPED.sub(" ", page)
    page = _ANY.sub("", _CELLS.sub(" ", _BREAKS.sub("\n", page)))
    lines = (_SPACE.sub(" ", x).strip() for x in html.unescape(page).split("\n"))
    return "\n".join(x for x in lines if x)


def page_facts(page: str, uri: str) -> dict:
    """Title, language, meta tags and links (absolute where the URI allows) of a page."""
    page = _DROPPED.sub(lambda m: m[0].split(">", 1)[0] + ">" if m[1] and m[1].lower() == "script" else " ", page)
    base, links = uri, []
    for tag, inner in _LINK.findall(page):
        a = attributes(inner)
        to = a.get("href") if tag.lower() in ("a", "area", "link", "base") else a.get("src")
        if to:
            try:
                to = urljoin(base, to.strip())
            except ValueError:  # not a URI; kept as it is
                pass
            if tag.lower() == "base":
                base = to
            else:
                links.append({"path": f"{tag.upper()}@/{'src' if tag.lower() in ('img', 'script', 'iframe', 'source') else 'href'}", "url": to} | ({"rel": a["rel"]} if "rel" in a else {}))
    title, root = _TITLE.search(page), _HTML.search(page)
    metas = [a for x in _META.findall(page) if (a := attributes(x))]
    return {"title": _SPACE.sub(" ", html.unescape(title[1])).strip() if title else None, "lang": attributes(root[1]).get("lang") if root else None, "metas": metas, "links": links}


def responses_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(source, record_id, target_uri, date, http, payload): pages as response records."""
    name = F.sha2(F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col).cast("string"), F.lit(""))), 256)
    at = lambda a, n: F.substring(name, a, n)
    record = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", at(1, 8), at(9, 4), F.concat(F.lit("8"), at(14, 3)), F.concat(F.lit("8"), at(18, 3)), at(21, 12)), F.lit(">"))
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col(id_col).alias("source"), record.alias("record_id"), F.col(url_col).cast("string").alias("target_uri"), F.lit(date).alias("date"), http.alias("http"), payload.alias("payload"))


_RECORD = "record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string, content_type string, block string, block_digest string, source_block_digest string, source_payload_digest string, n_links long"


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records, metadata and conversion, for each response (source, record_id, target_uri, date, http, payload).

    Null URIs, dates, headers and payloads count as empty; the records are made all the same.
    Repeated responses give repeated records with the same ids. Other columns are ignored. An
    empty table gives none.
    """
    bounded_batches(responses.sparkSession)
    kind = responses.schema["source"].dataType.simpleString()
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("record_id", "target_uri", "date", "http", "payload")]
    schema = f"source {kind}, {_RECORD}"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            source, out = [], []
            for row, (rid, uri, date, http, payload) in enumerate(zip(*(b.column(c).to_pylist() for c in ("record_id", "target_uri", "date", "http", "payload")), strict=True)):
                meta_id, text_id = (f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, rid + ' ' + x)}>" for x in ("metadata", "conversion"))
                raw, head = payload.encode(), http.encode()
                of_payload, of_block = digest(raw), digest(head + raw)
                status, *lines = http.split("\r\n")
                facts, plain = page_facts(payload, uri), plain_text(payload)
                envelope = {"http": {"status": status, "headers": [x.split(": ", 1) for x in lines if ": " in x]}, "source": {"record_id": rid, "target_uri": uri, "date": date, "block_digest": of_block, "payload_digest": of_payload, "payload_length": len(raw)}, "html": facts, "conversion": {"record_id": text_id, "length": len(plain.encode())}}
                meta = json.dumps(envelope, ensure_ascii=False, sort_keys=True)
                for kind, name, other, type_, block in (("metadata", meta_id, text_id, "application/json", meta), ("conversion", text_id, meta_id, "text/plain; charset=utf-8", plain)):
                    source.append(row)
                    out.append((kind, name, rid, other, uri, date, type_, block, digest(block.encode()), of_block, of_payload, len(facts["links"])))
            cols = list(zip(*out, strict=True)) if out else [[]] * 12
            yield pa.RecordBatch.from_arrays([b.column("source").take(pa.array(source, pa.int64())), *(pa.array(c, pa.string()) for c in cols[:-1]), pa.array(cols[-1], pa.int64())], [f.split()[0] for f in schema.split(", ")])

    return responses.select("source", *text).mapInArrow(run, schema)


def _line(name: str, value) -> F.Column:
    value = value.cast("string") if isinstance(value, F.Column) else F.lit(value)
    return F.when(F.coalesce(F.length(value), F.lit(0)) > 0, F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Records of `derivatives` as WARC/1.1 files, one for each partition; empty values give no header line, no records an empty folder."""
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", F.col("record_id")), _line("WARC-Date", F.col("date")), _line("WARC-Target-URI", F.col("target_uri")),
        _line("WARC-Refers-To", F.col("refers_to")), _line("WARC-Refers-To-Target-URI", F.col("target_uri")), _line("WARC-Refers-To-Date", F.col("date")), _line("WARC-Concurrent-To", F.col("concurrent_to")),
        _line("WARC-Block-Digest", F.col("block_digest")), _line("X-Source-Block-Digest", F.col("source_block_digest")), _line("X-Source-Payload-Digest", F.col("source_payload_digest")),
        _line("Content-Type", F.col("content_type")), F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n"),
    )
    records.select(F.concat(head, F.lit("\r\n"), F.col("block")).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file's bytes, compressed or not; one record is held at a time.

    What follows a record without a readable length, or a cut-off end, is left out.
    """
    file = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data))
    with contextlib.suppress(EOFError, zlib.error):  # a cut-off member
        while line := file.readline():
            if not line.startswith(b"WARC/1."):
                continue
            headers = {}
            while (line := file.readline()) not in (b"\r\n", b"\n", b""):
                name, mark, value = line.decode("utf-8", "replace").partition(":")
                if mark:
                    headers[name.strip().lower()] = value.strip()
            n = headers.get("content-length", "")
            if not n.isdecimal() or len(block := file.read(int(n))) < int(n):
                return
            yield headers, block


def read_warc(spark: SparkSession, path: str, batch_bytes: int = 8_000_000) -> DataFrame:
    """(source, record_id, target_uri, date, http, payload) of the responses in WARC files.

    A file (2 GB at most, as it comes in one row) is read by one task, record by record; a task
    holds the file as it is stored and about batch_bytes of records. Other types of records are
    left out; missing headers are null. Files without responses and empty folders give no rows.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        names = ["source", "record_id", "target_uri", "date", "http", "payload"]

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out, strict=True) if out else [[]] * 6)], names)
            out.clear()
            return b

        for b in batches:
            for file, content in zip(b.column("path"), b.column("content"), strict=True):
                size = 0
                for h, block in parse_warc(content.as_py()):
                    if h.get("warc-type", "").lower() == "response":
                        http, mark, payload = block.partition(b"\r\n\r\n")
                        out.append((file.as_py(), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), (http + mark).decode("utf-8", "replace"), payload.decode("utf-8", "replace")))
                        size += len(block)
                        if size > batch_bytes:
                            yield flush()
                            size = 0
        yield flush()

    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "source string, record_id string, target_uri string, date string, http string, payload string")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derivatives(responses_of(table(spark, sf_dir, "pages")))
    return r.select(F.col("source").alias("page_id"), "record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "content_type", F.octet_length("block").cast("long").alias("content_length"), "block_digest", "source_block_digest", "source_payload_digest", "n_links")
