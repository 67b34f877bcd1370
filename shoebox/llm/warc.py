"""WARC derivatives of captured pages: metadata and plain-text conversion records.

A capture is a record of its own, with an identifier, a target address, a date, the
protocol's head where there is one, and a payload digest.  Its derivatives refer to it by
its identifier and carry its address, date, source headers and digests on.  Identifiers
of derivatives are name-based, so a rebuilt derivative has the same one.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import markup
from .spark_tools import ship

SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:shoebox:warc")
#: The tables hold no capture time.
DATE = "1970-01-01T00:00:00Z"
SCHEMA = "page_id long, record_type string, record_id string, refers_to string, target_uri string, content_type string, block_digest string, payload_digest string, source_digest string, content_length long, headers string, block string"
#: Records as they are read from files: `place` is the number of the record in its file.
RECORDS = "path string, place long, record_type string, record_id string, target_uri string, date string, headers string, block binary"

# Elements of HTML whose text nobody sees, and those that begin a line.
HIDDEN = frozenset("script style noscript template title textarea".split())
LINES = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd tr table br hr article section nav header footer aside main form blockquote pre body head html".split())
_BLANK = re.compile(r"[ \t\r\f\v]+")
_BREAKS = re.compile(r"\n[ \n]*")
_VALUE = re.compile(r"""(?:^|[\s"'])([a-zA-Z-]+)\s{0,8}=\s{0,8}(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_CHARSET = re.compile(rb"""charset\s{0,8}=\s{0,8}["']?([\w.:-]+)""", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, page: object, uri: str, payload: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind} {page} {uri} {payload}')}>"


def _attribute(page: str, t: markup.Token, name: str) -> str | None:
    for m in _VALUE.finditer(page, t.begin, t.end):
        if m[1].lower() == name:
            return entities.unescape(m[2] or m[3] or m[4] or "")
    return None


def read_page(page: str) -> tuple[str, str | None, str | None, list[str]]:
    """All visible text, a line a block; the title, the language, and the addresses of links.

    One pass over the tags, linear in the page whatever is broken in it.
    """
    found = list(markup.tokens(page))
    ends = markup.own_ends(page, found, HIDDEN - markup.TEXT_ONLY)
    out: list[str] = []
    title = language = None
    links: list[str] = []
    k = -1
    while (k := k + 1) < len(found):
        t = found[k]
        if t.kind == markup.TEXT:
            if not t.name:
                out.append(entities.unescape(page[t.begin : t.end]))
            elif t.name == "title" and title is None:
                title = entities.unescape(page[t.begin : t.end])
            continue
        if t.kind == markup.CDATA:
            out.append(page[t.begin : t.end])
            continue
        if t.name in LINES or t.name in HIDDEN:
            out.append("\n")
        if t.kind == markup.END:
            continue
        if t.name == "html" and language is None:
            language = _attribute(page, t, "lang")
        elif t.name == "a" and (to := _attribute(page, t, "href")) is not None:
            links.append(to)
        k = ends.get(k, k)
    text = _BREAKS.sub("\n", _BLANK.sub(" ", "".join(out)).replace(" \n", "\n")).strip()
    return text, title, language, links


def _one_line(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value).strip()


def _fields(pairs: list[tuple[str, str]]) -> str:
    return "".join(f"{k}: {_one_line(v)}\r\n" for k, v in pairs)


def _record(page_id: object, kind: str, rid: str, source: dict | None, uri: str, date: str, content_type: str, block: str, payload: str | None, source_digest: str) -> tuple:
    """A row of SCHEMA; source: id of the capture that it refers to."""
    data = block.encode("utf-8", "replace")
    whole = digest(data)
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", uri)]
    if source:
        head += [("WARC-Refers-To", source["id"]), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", source["date"])]
    head += [("WARC-Block-Digest", whole)]
    if payload:
        head += [("WARC-Payload-Digest", payload)]
    if source:
        head += [("WARC-Source-Payload-Digest", source_digest)]
    head += [("Content-Type", content_type), ("Content-Length", str(len(data)))]
    return page_id, kind, rid, source and source["id"], uri, content_type, whole, payload, source_digest, len(data), "WARC/1.1\r\n" + _fields(head), block


def derived(page_id: object, source: dict, uri: str, page: str | None, length: int, source_digest: str, head: list[tuple[str, str]]) -> list[tuple]:
    """The metadata record of a capture and, if it is a page (else null), its conversion.

    source has the capture's id and date; head is what the protocol said of it: the status
    as `status`, and its header fields.
    """
    meta = [("sourceContentLength", str(length)), ("sourcePayloadDigest", source_digest)]
    meta += [("sourceStatus", v) if k == "status" else ("sourceHeader", f"{k}: {v}") for k, v in head]
    out = []
    text = title = language = None
    links: list[str] = []
    if page is not None:
        text, title, language, links = read_page(page)
    meta += [("title", title)] if title else []
    meta += [("language", language)] if language else []
    meta += [("outlink", f"{to} L a/@href") for to in links]
    add = lambda kind, *rest: out.append(_record(page_id, kind, record_id(kind, page_id if page_id is not None else source["id"], uri, source_digest), source, uri, source["date"], *rest, source_digest))
    add("metadata", "application/warc-fields", _fields(meta), None)
    if text is not None:
        add("conversion", "text/plain; charset=utf-8", text, digest(text.encode("utf-8", "replace")))
    return out


def records(page_id: object, uri: str, page: str, date: str = DATE, with_source: bool = False) -> list[tuple]:
    """The rows of SCHEMA for one page: if asked for, the capture itself as a resource record, which claims no protocol, then its derivatives."""
    raw = page.encode("utf-8", "replace")
    own = digest(raw)
    source = {"id": record_id("resource", page_id, uri, own), "date": date}
    out = [_record(page_id, "resource", source["id"], None, uri, date, "text/html; charset=utf-8", page, own, own)] if with_source else []
    return out + derived(page_id, source, uri, page, len(raw), own, [])


def _rows(found: list[tuple], schema: str = SCHEMA) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = zip(*found, strict=True) if found else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _derive(date: str, with_source: bool):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in K.slices(batches, "html"):
            rows = []
            for p, u, h in zip(x.column("page_id").to_pylist(), x.column("url").to_pylist(), x.column("html").to_pylist(), strict=True):
                rows += records(p, u or "", h or "", date, with_source)
            yield _rows(rows)

    return go


def derivatives(pages: DataFrame, date: str = DATE, with_source: bool = False) -> DataFrame:
    """A metadata and a conversion record for each page, and its resource record if asked for.

    headers is the record's head with its version line, block its body.  A null page is
    an empty one, a null address an empty one; control characters in header values become
    spaces.  Repeated rows give repeated records with equal identifiers; an empty table
    gives an empty one; other columns are ignored.
    """
    ship(pages.sparkSession)
    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(_derive(date, with_source), SCHEMA)


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks of the records of a WARC file, compressed or not, unpacked as they are read.

    Names of headers are as they stand, the last of equal ones counts, and `` holds the
    whole head.  What stands between records is left out, and so is a record that the
    end of the file cuts off.
    """
    f = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    try:
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                continue
            head, headers = [line], {}
            while (line := f.readline()).strip():
                head.append(line)
                k, _, v = line.decode("utf-8", "replace").partition(":")
                headers[k.strip()] = v.strip()
            size = headers.get("Content-Length", "")
            if not size.isdigit():
                continue
            block = f.read(int(size))
            if len(block) < int(size):
                return
            yield headers | {"": b"".join(head).decode("utf-8", "replace")}, block
    except (EOFError, OSError, zlib.error):
        return


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        for path, content in zip(x.column("path").to_pylist(), x.column("content"), strict=True):
            rows, size = [], 0
            for place, (h, block) in enumerate(read_records(content.as_buffer().to_pybytes())):
                low = {k.lower(): v for k, v in h.items()}
                rows.append((path, place, low.get("warc-type"), low.get("warc-record-id"), low.get("warc-target-uri"), low.get("warc-date"), h[""], block))
                size += len(block)
                if size > 4 << 20:
                    yield _rows(rows, RECORDS)
                    rows, size = [], 0
            yield _rows(rows, RECORDS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of RECORDS of all WARC files of a path, a file a task; Spark reads files of up to 2 GB, compressed, so."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read, RECORDS)


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].partition(b";")[0], 16)
        except ValueError:
            break
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def http(block: bytes) -> tuple[list[tuple[str, str]], bytes, str | None]:
    """(`status` and header fields, payload as sent, page) of a response block; page is its text if it is HTML or plain text, else null."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    fields = [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines) if k.strip()]
    said = {k.lower(): v for k, v in fields}
    code = status.split(" ", 2)[1:2]
    body = _unchunked(payload) if "chunked" in said.get("transfer-encoding", "").lower() else payload
    packing = said.get("content-encoding", "").lower()
    try:
        if packing in ("gzip", "x-gzip"):
            body = zlib.decompressobj(31).decompress(body)
        elif packing == "deflate":
            body = zlib.decompressobj().decompress(body)
    except zlib.error:
        body = b""
    kind = said.get("content-type", "text/html")
    page = None
    if kind.partition(";")[0].strip().lower() in ("text/html", "application/xhtml+xml", "text/plain", "") and packing in ("", "identity", "gzip", "x-gzip", "deflate"):
        named = _CHARSET.search(kind.encode("latin-1", "replace")) or _CHARSET.search(body[:2048])
        try:
            page = body.decode(named[1].decode() if named else "utf-8", "replace")
        except LookupError:
            page = body.decode("utf-8", "replace")
        if kind.lower().startswith("text/plain"):
            page = entities.escape(page, quote=False)
    return [("status", c) for c in code] + fields, payload, page


def _derive_responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        rows = []
        for rid, uri, date, block in zip(*(x.column(c).to_pylist() for c in ("record_id", "target_uri", "date", "block")), strict=True):
            head, payload, page = http(block or b"")
            rows += derived(None, {"id": rid or "", "date": date or DATE}, uri or "", page, len(payload), digest(payload), head)
        yield _rows(rows)


def response_derivatives(captured: DataFrame) -> DataFrame:
    """Rows of SCHEMA for the response records of a table of RECORDS, with their own identifiers, dates, status and header fields; page_id is null.

    Responses that are no text have a metadata record alone; records of other types are
    left out.
    """
    ship(captured.sparkSession)
    rows = captured.where(F.lower("record_type") == "response").select("record_id", "target_uri", "date", "block")
    return rows.mapInArrow(_derive_responses, SCHEMA)


def serialise(headers: str, block: str, compress: bool = True) -> bytes:
    """A record as it stands in a WARC file; compressed, it is a member of its own."""
    raw = headers.encode() + b"\r\n" + block.encode("utf-8", "replace") + b"\r\n\r\n"
    return gzip.compress(raw, mtime=0) if compress else raw


def write_files(rows: DataFrame, path: str) -> None:
    """Rows of SCHEMA as compressed WARC files, a file a task, by Spark's text writer: each record's end is the line break of the format."""
    rows.select(F.concat("headers", F.lit("\r\n"), "block").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
