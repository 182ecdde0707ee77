"""WARC files: records read, written, and derived from responses as linked metadata and plain-text conversions."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.support import small_batches, table

_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the public name space of URLs
RECORD = "source string, offset bigint, type string, record_id string, headers array<struct<name:string,value:string>>, block binary, error string"
_HEADERS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str | bytes) -> str:
    """A record id that follows from its parts, so that a task that runs again makes the same record."""
    h = hashlib.sha256()
    for p in parts:
        p = p.encode("utf-8", "surrogatepass") if isinstance(p, str) else p
        h.update(len(p).to_bytes(8, "big") + p)
    return f"<urn:uuid:{uuid.uuid5(_NAMES, h.hexdigest())}>"


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{n}: {_one_line(v)}\r\n" for n, v in headers)
    return b"WARC/1.0\r\n" + lines.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


class Malformed(ValueError):
    """The bytes at this place aren't a record."""


def plain_chunks(data: bytes, step: int = 1 << 16, most: int = 1 << 24) -> Iterator[bytes]:
    """Members of gzip, each a record or more, unpacked; other bytes as they are. Each byte is fed once, and few are held unpacked."""
    view, at = memoryview(data), 0
    while at < len(data):
        if bytes(view[at : at + 2]) != b"\x1f\x8b":
            yield from (bytes(view[i : i + most]) for i in range(at, len(data), most))
            return
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            part = view[at : at + step]
            try:
                out = unpack.decompress(part, most)
            except zlib.error as fault:
                raise Malformed(f"gzip: {fault}") from None
            # after the end of a member both hold what follows it
            at += len(part) - len(unpack.unused_data if unpack.eof else unpack.unconsumed_tail)
            if out:
                yield out
            elif not part and not unpack.eof:
                raise Malformed("gzip: cut off")


def read_records(data: bytes) -> Iterator[tuple[int, list[tuple[str, str]], bytes]]:
    """(offset in the unpacked bytes, headers in order, block) of each record, as it is read. Header lines may be continued."""
    chunks, buffer, gone, at = plain_chunks(data), bytearray(), 0, 0

    def reach(n: int) -> bool:
        """Whether the buffer has ``n`` bytes, or can be filled to."""
        while len(buffer) < n:
            if (chunk := next(chunks, None)) is None:
                return False
            buffer.extend(chunk)
        return True

    while reach(at + 1):
        if buffer[at] in b"\r\n" and (buffer[at] == 10 or (reach(at + 2) and buffer[at + 1] == 10)):
            at += 1 if buffer[at] == 10 else 2
            continue
        if not reach(at + 5) or buffer[at : at + 5] != b"WARC/":
            raise Malformed(f"no record at {gone + at}")
        seen = at
        while (end := buffer.find(b"\r\n\r\n", seen)) < 0:
            seen = max(at, len(buffer) - 3)
            if not reach(len(buffer) + 1):
                raise Malformed(f"headers at {gone + at} don't end")
        headers: list[tuple[str, str]] = []
        for line in buffer[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in (" ", "\t") and headers:
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
            else:
                name, _, value = line.partition(":")
                headers.append((name.strip(), value.strip()))
        length = header(headers, "Content-Length") or ""
        if not length.isdecimal() or not reach(end + 4 + int(length)):
            raise Malformed(f"record at {gone + at} has no whole block")
        stop = end + 4 + int(length)
        yield gone + at, headers, bytes(memoryview(buffer)[end + 4 : stop])
        at = stop
        if at > 1 << 20:
            del buffer[:at]
            gone, at = gone + at, 0


def header(headers: list, name: str) -> str | None:
    return next((h[1] for h in headers if h[0].lower() == name.lower()), None)


# --- HTTP and HTML ----------------------------------------------------------------------------------------------------


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and decoded body of an HTTP response; chunks are joined and gzip or deflate undone."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("iso-8859-1").split("\r\n")
    headers = [(n.strip(), v.strip()) for n, _, v in (x.partition(":") for x in lines[1:])]
    if (header(headers, "Transfer-Encoding") or "").lower() == "chunked":
        out, at = [], 0
        while (end := body.find(b"\r\n", at)) >= 0:
            try:
                n = int(body[at:end].split(b";")[0], 16)
            except ValueError:
                break
            if not n:
                break
            out.append(body[end + 2 : end + 2 + n])
            at = end + 4 + n
        body = b"".join(out)
    encoding = (header(headers, "Content-Encoding") or "").lower()
    try:
        if encoding in ("gzip", "x-gzip"):
            body = gzip.decompress(body)
        elif encoding == "deflate":
            body = zlib.decompress(body)
    except (OSError, EOFError, zlib.error):
        pass
    return lines[0], headers, body


def decoded(body: bytes, content_type: str | None) -> str:
    found = re.search(r"charset=[\"']?([\w.:-]+)", content_type or "", re.I) or re.search(r"<meta[^>]{0,200}charset=[\"']?([\w.:-]+)", body[:2048].decode("ascii", "replace"), re.I)
    try:
        return body.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


#: A comment, an element whose text isn't shown, a declaration or a tag; unquoted parts of a tag can't hold "<".
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)|<[!?][^<>]*>|</?([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S | re.I,
)
# Elements that begin a line of their own.
_BLOCKS = set("address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
_ATTRIBUTE = re.compile(r"(href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TITLE = re.compile(r"<title\b[^<>]*>(.*?)</title\s*>", re.S | re.I)


def plain_text(page: str) -> str:
    """What a page shows: one line per block, white space collapsed, references resolved."""
    text = _MARKUP.sub(lambda m: "\n" if (m[2] or "").lower() in _BLOCKS else "", page)
    lines = (" ".join(html.unescape(x).split()) for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def page_links(page: str, base: str) -> list[dict]:
    out = []
    for m in _MARKUP.finditer(page):
        for a in _ATTRIBUTE.finditer(m[3] or ""):
            target = html.unescape(a[2] or a[3] or a[4] or "")
            try:
                target = urljoin(base, target)
            except ValueError:
                pass
            out.append({"path": f"{m[2].upper()}@/{a[1].lower()}", "url": target})
    return out


def derive(headers: list[tuple[str, str]], block: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """The metadata and the conversion record of a response: headers and block of each.

    Both keep the response's URI and date and refer to its id. The metadata holds all headers of the source, WARC and
    HTTP, its digests as stated and as computed, the title and the links, and names the conversion; the conversion's
    block is the page's text in UTF-8.
    """
    uri, date, source = header(headers, "WARC-Target-URI") or "", header(headers, "WARC-Date") or "", header(headers, "WARC-Record-ID") or ""
    status, fields, body = http_parts(block)
    page = decoded(body, header(fields, "Content-Type"))
    payload = block.partition(b"\r\n\r\n")[2]
    text = plain_text(page).encode("utf-8", "replace")
    title = _TITLE.search(page)
    ids = {kind: record_id(kind, source, uri, block) for kind in ("metadata", "conversion")}
    shared = [("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Refers-To", source)]
    about = {
        "source": {"headers": [list(h) for h in headers], "block-digest": digest(block), "payload-digest": digest(payload), "block-digest-holds": _holds(headers, "WARC-Block-Digest", digest(block)), "payload-digest-holds": _holds(headers, "WARC-Payload-Digest", digest(payload))},
        "response": {"status": status, "headers": [list(f) for f in fields], "body-length": len(body)},
        "html": {"title": " ".join(html.unescape(title[1]).split()) if title else None, "links": page_links(page, uri)},
        "conversion": ids["conversion"],
    }
    envelope = json.dumps(about, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "replace")
    out = []
    for kind, mime, data in (("metadata", "application/json", envelope), ("conversion", "text/plain; charset=utf-8", text)):
        out.append(([("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), *shared, ("WARC-Block-Digest", digest(data)), ("Content-Type", mime)], data))
    return out


def _holds(headers: list, name: str, computed: str) -> bool | None:
    stated = header(headers, name)
    return None if stated is None else stated == computed


def response_record(uri: str, page: bytes, source: str, date: str) -> bytes:
    """A response that holds ``page`` as HTML."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(page)}\r\n\r\n".encode() + page
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", source, uri, page)), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(page)), ("Content-Type", "application/http; msgtype=response")]
    return write_record(headers, block)


# --- DataFrames -------------------------------------------------------------------------------------------------------


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in RECORD.replace("struct<name:string,value:string>", "struct").split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), _HEADERS, pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)


def _row(source: str | None, offset: int, headers: list[tuple[str, str]], block: bytes) -> tuple:
    return source, offset, header(headers, "WARC-Type"), header(headers, "WARC-Record-ID"), [{"name": n, "value": v} for n, v in headers], block, None


def records(files: DataFrame, source_col: str = "path", content_col: str = "content") -> DataFrame:
    """Records of WARC files in a binary column (as ``spark.read.format("binaryFile")`` gives them), gzipped or not.

    ``offset`` counts in the unpacked bytes. Where a file breaks off or isn't WARC a row with ``error`` follows the
    records before. Null content gives none. Packed files are unpacked as they are read, in time that grows with their
    size, and records go out in batches; a file's packed bytes are held, 2 GB at most, as that is what a binary column holds.
    Files that repeat give their records again; an empty table gives an empty result; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            rows = []
            for source, data in zip(got.column(0).to_pylist(), got.column(1)):
                try:
                    for at, headers, block in read_records(data.as_py() or b""):
                        rows.append(_row(source, at, headers, block))
                        if len(rows) >= 500:
                            yield _batch(rows)
                            rows = []
                except Malformed as fault:
                    rows.append((source, None, None, None, None, None, str(fault)))
            if rows:
                yield _batch(rows)

    return files.select(F.col(source_col).cast("string"), F.col(content_col).cast("binary")).transform(small_batches).mapInArrow(run, RECORD)


def derivatives(found: DataFrame) -> DataFrame:
    """Metadata and conversion records of the responses among ``records``; other kinds and faults are passed over.

    ``source`` and ``offset`` stay those of the response. The records are linked by id: both refer to the response, and
    the metadata names the conversion. Responses that repeat give equal records again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            rows = []
            for r in got.to_pylist():
                for headers, block in derive([(h["name"], h["value"]) for h in r["headers"] or []], r["block"] or b""):
                    rows.append(_row(r["source"], r["offset"], headers, block))
                if len(rows) >= 500:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return found.filter("type = 'response'").select("source", "offset", "headers", "block").transform(small_batches).mapInArrow(run, RECORD)


def as_files(found: DataFrame) -> DataFrame:
    """``source``, ``type`` and ``content``: each record as a gzip member, ready to be joined into a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            out = []
            for r in got.to_pylist():
                headers = [(h["name"], h["value"]) for h in r["headers"] if h["name"].lower() != "content-length"]
                out.append(gzip.compress(write_record(headers, r["block"]), mtime=0))
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), pa.array(out, type=pa.binary())], names=["source", "type", "content"])

    return found.filter("error IS NULL").select("source", "type", "headers", "block").transform(small_batches).mapInArrow(run, "source string, type string, content binary")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per derived record of each page; pages are stored as responses first (null url or html: empty)."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            ids = got.column(0).to_pylist()
            content = [response_record(u or "", (h or "").encode("utf-8", "surrogatepass"), str(i), "1970-01-01T00:00:00Z") for i, u, h in zip(ids, got.column(1).to_pylist(), got.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([None if i is None else str(i) for i in ids], type=pa.string()), pa.array(content, type=pa.binary())], names=["path", "content"])

    files = table(spark, sf_dir, "pages").select("page_id", "url", "html").transform(small_batches).mapInArrow(store, "path string, content binary")
    value = lambda name: F.filter("headers", lambda h: h["name"] == name)[0]["value"]
    about = F.col("block").cast("string")
    return derivatives(records(files)).select(
        F.col("source").cast("long").alias("page_id"),
        "type",
        "record_id",
        value("WARC-Refers-To").alias("refers_to"),
        value("WARC-Target-URI").alias("url"),
        value("WARC-Block-Digest").alias("block_digest"),
        F.octet_length("block").cast("long").alias("block_bytes"),
        F.sha2("block", 256).alias("block_sha256"),
        F.when(F.col("type") == "metadata", F.get_json_object(about, "$.conversion")).alias("conversion_id"),
        F.when(F.col("type") == "metadata", F.get_json_object(about, "$.source.payload-digest")).alias("payload_digest"),
    )
