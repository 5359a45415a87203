"""WARC derivatives: a linked metadata record and a plain-text conversion record per response.

Responses are read from their bytes; both derivatives refer to the response's identifier and
carry its target, date, HTTP headers and digests.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.batches import text_slices

VERSION = "WARC/1.1"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's namespace of urls
# Elements whose content isn't text, and those that end a line (fixed values, from the HTML standard).
HIDDEN = frozenset("script style template noscript iframe object svg math".split())
LINES = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
LINKS = {"a": "href", "area": "href", "link": "href", "base": "href", "img": "src", "script": "src", "iframe": "src", "video": "src", "audio": "src", "source": "src", "form": "action"}

_TAG = re.compile(r"<(?:(!--)|(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>|[!?/][^>]*>)")
_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """An identifier that depends on ``parts`` alone, so that a repeated task gives it again."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, json.dumps(parts))}>"


def clean(value: str) -> str:
    """A header's value on one line."""
    return re.sub(r"[\r\n]+", " ", value).strip()


def serialize(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {clean(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[str]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in " \t" and out:  # a folded line
            out[-1] = (out[-1][0], out[-1][1] + " " + line.strip())
        elif ":" in line:
            k, v = line.split(":", 1)
            out.append((k.strip(), v.strip()))
    return out


def first(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def parse(data: bytes, at: int = 0) -> tuple[list[tuple[str, str]], bytes, int]:
    """The headers and block of the record at ``at``, and where the next may begin."""
    head = data.find(b"\r\n\r\n", at)
    if head < 0 or not data.startswith(b"WARC/", at):
        raise ValueError("no WARC record here")
    headers = _headers(data[at:head].decode("utf-8", "replace").split("\r\n")[1:])
    size = first(headers, "Content-Length")
    if size is None or not size.isdigit() or head + 4 + int(size) > len(data):
        raise ValueError("a record without its whole block")
    end = head + 4 + int(size)
    return headers, data[head + 4 : end], end + 4 if data[end : end + 4] == b"\r\n\r\n" else end


def read_archive(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """The records of a file, plain or with a gzip member each."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        headers, block, at = parse(data, at)
        yield headers, block


def write_archive(records: list[bytes]) -> bytes:
    """A file of ``records`` with a gzip member each."""
    return b"".join(gzip.compress(r, mtime=0) for r in records)


@dataclass
class Http:
    status: str
    headers: list[tuple[str, str]]
    payload: bytes  # as transferred

    def body(self) -> bytes:
        """The payload without transfer and content codings; as it is where they don't fit."""
        data = self.payload
        if "chunked" in (first(self.headers, "Transfer-Encoding") or "").lower():
            out, at = [], 0
            while (eol := data.find(b"\r\n", at)) >= 0:
                try:
                    size = int(data[at:eol].split(b";")[0], 16)
                except ValueError:
                    return self.payload
                if size == 0:
                    break
                out.append(data[eol + 2 : eol + 2 + size])
                at = eol + 4 + size
            data = b"".join(out)
        coding = (first(self.headers, "Content-Encoding") or "").lower()
        try:
            return zlib.decompress(data, 47) if coding in ("gzip", "x-gzip", "deflate") else data
        except zlib.error:
            return data

    def text(self) -> str:
        kind = first(self.headers, "Content-Type") or ""
        charset = re.search(r"charset=[\"']?([\w-]+)", kind, re.I)
        try:
            return self.body().decode(charset[1] if charset else "utf-8", "replace")
        except LookupError:
            return self.body().decode("utf-8", "replace")


def parse_http(block: bytes) -> Http:
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    return Http(lines[0], _headers(lines[1:]), payload)


def read_html(source: str) -> tuple[str, str, list[dict[str, str]]]:
    """The text, the title and the links of a page, in one pass over its tags."""
    out, links, title, at = [], [], "", 0
    end = source.rfind(">") + 1  # behind it no tag closes
    while (m := _TAG.search(source, at, end)) is not None:
        out.append(re.sub(r"[\r\n]+", " ", source[at : m.start()]))
        at = m.end()
        if m[1]:
            close = source.find("-->", at)
            at = close + 3 if close >= 0 else len(source)
            continue
        name = (m[3] or "").lower()
        if not m[2] and name in LINKS and m[4]:
            for a in _ATTRIBUTE.finditer(m[4]):
                if a[1].lower() == LINKS[name]:
                    links.append({"path": f"{name}@{LINKS[name]}", "url": entities.unescape(a[2] or a[3] or a[4] or "")})
        if not m[2] and (name in HIDDEN or name == "title") and not m[4].endswith("/"):
            close = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            inside = source[at : close.start()] if close else source[at:]
            at = close.end() if close else len(source)
            if name == "title" and not title:
                title = " ".join(entities.unescape(inside).split())
                out.append("\n" + re.sub(r"[\r\n]+", " ", inside))
        if name in LINES:
            out.append("\n")
    out.append(re.sub(r"[\r\n]+", " ", source[at:]))
    lines = (" ".join(line.split()) for line in entities.unescape("".join(out)).split("\n"))
    return "\n".join(line for line in lines if line), title, links


def response(uri: str | None, page: str | None, date: str, key: object) -> bytes:
    """A response record for a page that is at hand as text."""
    payload = (page or "").encode("utf-8", "replace")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, uri, digest(block))), ("WARC-Date", date)]
    if uri:
        headers.append(("WARC-Target-URI", uri))
    headers += [("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
    return serialize(headers, block)


@dataclass
class Derivative:
    kind: str
    headers: list[tuple[str, str]]
    block: bytes

    @property
    def record(self) -> bytes:
        return serialize(self.headers, self.block)


def derive(record: bytes) -> tuple[list[tuple[str, str]], list[Derivative]]:
    """The headers of a record and, if it is a response, its two derivatives."""
    headers, block, _ = parse(record)
    if (first(headers, "WARC-Type") or "").lower() != "response":
        return headers, []
    http, source = parse_http(block), first(headers, "WARC-Record-ID") or ""
    kept = [(k, first(headers, k)) for k in ("WARC-Target-URI", "WARC-Date")]
    kept = [(k, v) for k, v in kept if v]
    text, title, links = read_html(http.text())
    ids = {kind: record_id(kind, source) for kind in ("metadata", "conversion")}
    meta = {
        "warc": [list(h) for h in headers],
        "http": {"status": http.status, "headers": [list(h) for h in http.headers]},
        "payload": {"digest": digest(http.payload), "length": len(http.payload)},
        "html": {"title": title, "links": links},
        "conversion": ids["conversion"],
    }
    out = []
    for kind, mime, data in (("metadata", "application/json", json.dumps(meta, ensure_ascii=False)), ("conversion", "text/plain", text)):
        body = data.encode("utf-8", "replace")
        out.append(Derivative(kind, [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Refers-To", source), *kept, ("WARC-Block-Digest", digest(body)), ("Content-Type", mime)], body))
    return headers, out


def response_records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, record): a response record for every row.

    Null urls give no target, null and empty pages no payload; null keys stay null. Repeated rows give
    equal records. An empty table gives an empty result. Other columns aren't read.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "page"):
                ids = part.column("key").to_pylist()
                made = [response(u, h, date, i) for i, u, h in zip(ids, part.column("url").to_pylist(), part.column("page").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(made, pa.binary())], names=["key", "record"])

    slim = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.col(page).alias("page"))
    return slim.mapInArrow(kernel, "key long, record binary").withColumnRenamed("key", key)


def derivatives(records: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, warc_type, record_id, refers_to, target_uri, date, source_payload_digest, block_digest, content_type, content_length, block, record).

    Two rows for each response record, none for records of other types. A record that can't be
    read gives one row of type ``invalid`` whose other columns are null; null records give none.
    Repeated rows are derived again, with equal identifiers. An empty table gives an empty result.
    """
    names = ["warc_type", "record_id", "refers_to", "target_uri", "date", "source_payload_digest", "block_digest", "content_type"]
    schema = f"key long, {', '.join(n + ' string' for n in names)}, content_length long, block string, record binary"

    def rows_of(k: int | None, raw: bytes) -> Iterator[tuple]:
        try:
            headers, made = derive(raw)
        except ValueError:
            yield (k, "invalid", *[None] * 10)
            return
        for d in made:
            fields = [first(d.headers, n) for n in ("WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date")]
            yield (k, d.kind, *fields, first(headers, "WARC-Payload-Digest"), *(first(d.headers, n) for n in ("WARC-Block-Digest", "Content-Type")), len(d.block), d.block.decode(), d.record)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.string()] * len(names), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for part in text_slices(batch, "record"):
                pairs = zip(part.column("key").to_pylist(), part.column("record").to_pylist(), strict=True)
                rows = [r for k, raw in pairs if raw is not None for r in rows_of(k, raw)]
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", *names, "content_length", "block", "record"])

    out = records.select(F.col(key).alias("key"), "record").mapInArrow(kernel, schema)
    return out.withColumnRenamed("key", key)
