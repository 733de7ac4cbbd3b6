"""WARC derivatives: response records to linked metadata and plain-text conversion records.

A response record's bytes hold its WARC headers, the HTTP header and the payload. Of each come two records that refer
to it: ``metadata`` (application/warc-fields: title, language, numbers of links and characters, HTTP status and
headers, and the response's WARC headers) and ``conversion`` (text/plain: the page's visible text). Both preserve the
response's target URI, date and digests; record ids are derived from the response's, so that a retried task writes the
same bytes.

Reading is total: header names count in any case, with or without a space after the colon, and may go on in the next
line; a record without a sound length, or cut short, is skipped and reading goes on at the next one. Bodies lose their
chunks and their gzip, deflate or zstd coding and are read in the character set that HTTP header or page name; what
can't be undone stays as it is.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  #: RFC 4122's name space for URLs

_HIDDEN = re.compile(r"<!--|<(script|style|noscript|template)\b", re.IGNORECASE)
_TITLE, _HTML, _LINK = (re.compile(rf"<{name}\b", re.IGNORECASE) for name in ("title", "html", "a"))
_LANG, _HREF = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.IGNORECASE), re.compile(r"\bhref\s*=", re.IGNORECASE)
_BREAK = re.compile(r"(?=<(?:/?(?:p|div|li|ul|ol|table|tr|h[1-6]|section|article|header|footer|nav|main|title|head|body|blockquote|pre|dd|dt|dl|form|figure)\b|br\b|hr\b))", re.IGNORECASE)
_TAG = re.compile(r"<[a-zA-Z/!?](?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+>")
_OPEN, _SPECIAL = re.compile(r"<[a-zA-Z/!?]"), re.compile(r"[>\"']")
_BLANK = re.compile(r"[ \t\r\f\v ]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(10).join(names))}>"


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """The place behind the first > outside of quotes; -1 if there is none. dead: quotes from which none was found."""
    seen = []
    while (found := _SPECIAL.search(page, at)) and (p := found.start()) not in dead:
        if page[p] == ">":
            return p + 1
        seen.append(p)
        at = page.find(page[p], p + 1) + 1
        if not at:
            break
    dead.update(seen)
    return -1


def without_tags(page: str) -> str:
    """The page without tags: each goes to the first > outside of quotes, or else to the first one. In time in proportion
    to the page, whatever it holds."""
    cut = page.rfind(">") + 1
    page, rest = page[:cut], page[cut:]
    plain = _TAG.sub("", page)
    if not _OPEN.search(plain):
        return plain + rest
    out, at, dead = [], 0, set()  # some tag has a < in it
    while start := _OPEN.search(page, at):
        out.append(page[at : start.start()])
        end = _tag_end(page, start.end(), dead)
        at = end if end > 0 else page.find(">", start.end()) + 1
    return "".join(out) + page[at:] + rest


def without_hidden(page: str) -> str:
    """The page with a blank for each comment, script, style and the like; one without an end goes to the page's end."""
    out, at, ends = [], 0, page.rfind(">")
    look = 0
    while start := _HIDDEN.search(page, look):
        if not start[1]:
            end = page.find("-->", start.end()) + 3
            end = end if end > 2 else len(page)
        elif start.end() > ends:  # no tag ends here any more
            look = start.end()
            continue
        else:
            close = re.compile(rf"</{start[1]}\s*>", re.IGNORECASE).search(page, page.index(">", start.end()) + 1)
            end = close.end() if close else len(page)
        out += [page[at : start.start()], " "]
        at = look = end
    return "".join(out) + page[at:]


def tags(page: str, kind: re.Pattern) -> Iterator[tuple[int, str]]:
    """The end and the attributes of each tag of a kind."""
    page = page[: page.rfind(">") + 1]  # no tag ends behind that
    at, dead = 0, set()
    while start := kind.search(page, at):
        end = _tag_end(page, start.end(), dead)
        at = end if end > 0 else page.find(">", start.end()) + 1
        yield at, page[start.end() : at]


def title_of(page: str) -> str:
    """The text between the first title tag and the first end tag behind it."""
    start = next(tags(page, _TITLE), None)
    end = re.compile(r"</title\s*>", re.IGNORECASE).search(page, start[0]) if start else None
    return page[start[0] : end.start()] if end else ""


def language_of(page: str) -> str:
    for _, attributes in tags(page, _HTML):
        if found := _LANG.findall(attributes):
            return found[-1].lower()
    return ""


def links_of(page: str) -> int:
    return sum(1 for _, attributes in tags(page, _LINK) if _HREF.search(attributes))


def visible_text(page: str) -> str:
    """Lines of visible text: no comments, scripts, styles or tags; entities resolved, blank lines left out."""
    page = without_hidden(page)
    cut = page.rfind(">") + 1
    page = without_tags(_BREAK.sub("\n", page[:cut])) + page[cut:]
    lines = (_BLANK.sub(" ", line).strip() for line in html.unescape(page).split("\n"))
    return "\n".join(line for line in lines if line)


def serialised(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def fields_of(head: str) -> list[tuple[str, str]]:
    """Name and value of header lines; a line that begins with white space goes on with the value before it."""
    out: list[tuple[str, str]] = []
    for line in head.splitlines():
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif colon and name.strip():
            out.append((name.strip(), value.strip()))
    return out


def by_name(fields: list[tuple[str, str]]) -> dict[str, str]:
    """The first value of each lower-cased name."""
    out: dict[str, str] = {}
    for name, value in fields:
        out.setdefault(name.lower(), value)
    return out


_START = re.compile(rb"(?:\A|(?<=\n))WARC/[0-9]")


def parsed(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of every sound record in uncompressed bytes; a damaged one is skipped."""
    at = 0
    while start := _START.search(data, at):
        end = data.find(b"\r\n\r\n", start.start())
        if end < 0:
            return
        fields = fields_of(data[start.start() : end].decode("utf-8", "replace").partition("\n")[2])
        size = by_name(fields).get("content-length", "")
        body = end + 4
        if size.isascii() and size.isdigit() and body + int(size) <= len(data):
            at = body + int(size)
            yield fields, data[body:at]
        else:
            at = body


def unchunked(body: bytes) -> bytes:
    """The chunks of a chunked body; a body that isn't sound stays as it is from there on."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            break
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out) + body[at:]


def decoded(body: bytes, coding: str) -> bytes:
    """The body without its content codings, last one first; from an unknown or damaged coding on it stays as it is."""
    for name in reversed([c.strip().lower() for c in coding.split(",") if c.strip()]):
        try:
            if name in ("gzip", "x-gzip"):
                body = b"".join(members([body]))
            elif name == "deflate":
                body = zlib.decompressobj(15 if body[:1] == b"\x78" else -15).decompress(body)
            elif name == "zstd":
                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            elif name != "identity":
                return body
        except (zlib.error, zstandard.ZstdError):
            return body
    return body


def members(chunks: Iterable[bytes], skip: bool = False) -> Iterator[bytes]:
    """What each gzip member holds, the last one up to where it is cut short. skip: goes on behind a damaged member at
    the next mark of one, else raises zlib.error."""
    rest, chunks = b"", iter(chunks)
    unpack, out, whole = zlib.decompressobj(31), [], 0

    def more() -> bool:
        nonlocal rest
        chunk = next(chunks, None)
        rest += chunk or b""
        return chunk is not None

    while rest or more():
        try:
            out.append(unpack.decompress(rest))
            rest = unpack.unused_data
        except zlib.error:
            if not skip:
                if whole and not out and rest[:2] != b"\x1f\x8b":
                    return  # other bytes behind the last member
                raise
            out = []
            while (at := rest.find(b"\x1f\x8b\x08", 1)) < 0:
                rest = rest[-2:]
                if not more():
                    return
            rest, unpack = rest[at:], zlib.decompressobj(31)
            continue
        if unpack.eof:
            yield b"".join(out)
            unpack, out, whole = zlib.decompressobj(31), [], whole + 1
    if out:
        yield b"".join(out)


_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.IGNORECASE)


def page_of(block: bytes) -> tuple[str, list[tuple[str, str]], str]:
    """Status line, header fields and text of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    status, _, rest = head.decode("utf-8", "replace").partition("\r\n")
    fields = fields_of(rest)
    named = by_name(fields)
    if named.get("transfer-encoding", "").lower().split(",")[-1].strip() == "chunked":
        body = unchunked(body)
    body = decoded(body, named.get("content-encoding", ""))
    found = _CHARSET.search(named.get("content-type", "")) or _CHARSET.search(body[:2048].decode("latin-1"))
    try:
        return status, fields, body.decode(found[1] if found else "utf-8", "replace")
    except (LookupError, UnicodeError):  # no such set, or none of text
        return status, fields, body.decode("utf-8", "replace")


def _one_line(value: str) -> str:
    return " ".join(value.split())


def response(url: str | None, page: str | None, date: str) -> bytes:
    """A response record of a page; null counts as empty."""
    url, payload = _one_line(url or ""), (page or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + payload
    headers = [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", url, digest(payload))), ("WARC-Date", date),
        ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(payload)),
    ]
    return serialised(headers, block)


def derived(fields: list[tuple[str, str]], block: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """The metadata and the conversion record of a response record."""
    headers = by_name(fields)
    status, http, page = page_of(block)
    source, url = headers.get("warc-record-id", ""), headers.get("warc-target-uri", "")
    text = visible_text(page)
    facts = [
        ("title", _one_line(html.unescape(without_tags(title_of(page))))), ("language", language_of(page)),
        ("links", str(links_of(page))), ("characters", str(len(text))), ("http-status", status),
        *((f"http-{k.lower()}", v) for k, v in http), *((f"source-{k.lower()}", v) for k, v in fields),
    ]
    out = []
    for kind, content_type, data in (
        ("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in facts).encode("utf-8", "replace")),
        ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace")),
    ):
        own = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source)), ("WARC-Date", headers.get("warc-date", "")), ("WARC-Target-URI", url), ("WARC-Refers-To", source)]
        kept = [("WARC-Refers-To-Date", "warc-date"), ("WARC-Refers-To-Target-URI", "warc-target-uri"), ("WARC-Source-Block-Digest", "warc-block-digest"), ("WARC-Source-Payload-Digest", "warc-payload-digest")]
        own += [(k, headers[h]) for k, h in kept if h in headers]
        out.append(([*own, ("Content-Type", content_type), ("WARC-Block-Digest", digest(data))], data))
    return out


RECORDS = "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, source_block_digest string, source_payload_digest string, headers string, block string"


def responses(pages: DataFrame, date: str) -> DataFrame:
    """page_id and the bytes of a response record for each row of page_id, url, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [response(u, h, date) for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["page_id", "record"])

    columns = F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    return pages.select(*columns).mapInArrow(run, "page_id long, record binary")


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows for each response record in page_id, record (bytes): its metadata and its conversion.

    Bytes that hold several records give two rows for each response among them; other types, null and damaged
    records give none, and don't keep those after them from being read. Records of any length are read whole. Repeated
    rows give repeated records. An empty table gives no rows.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for page, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for fields, block in parsed(data or b""):
                    if by_name(fields).get("warc-type", "").lower() != "response":
                        continue
                    for own, out in derived(fields, block):
                        h = dict(own)
                        row = (page, h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Refers-To"], h["WARC-Target-URI"], h["WARC-Date"], h["Content-Type"], len(out), h["WARC-Block-Digest"], h.get("WARC-Source-Block-Digest"), h.get("WARC-Source-Payload-Digest"), "".join(f"{k}: {v}\r\n" for k, v in own), out.decode("utf-8", "replace"))
                        for c, v in zip(columns, row, strict=True):
                            c.append(v)
            kinds = [pa.int64() if n in ("page_id", "content_length") else pa.string() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return records.select("page_id", "record").mapInArrow(run, RECORDS)


def write_warc(records: DataFrame, folder: str) -> None:
    """Writes derivatives as gzip members to ``part-*.warc.gz`` files in folder, a URI that all executors reach.

    A file appears under its name only when it is whole, so a lost task leaves nothing behind and its retry writes
    the same file again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        name, n = f"{root}/part-{context.partitionId():05d}.warc.gz", 0
        draft = f"{name}.{context.taskAttemptId()}.draft"
        with store.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for headers, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    pairs = [tuple(line.split(": ", 1)) for line in headers.split("\r\n") if line]
                    out.write(gzip.compress(serialised(pairs, block.encode("utf-8", "surrogatepass")), mtime=0))
                    n += 1
        store.move(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "records"])

    records.select("headers", "block").mapInArrow(run, "file string, records long").count()


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """file, headers (map), block (bytes) of all sound records in a folder's ``*.warc.gz`` files.

    Files are read member by member, so memory is that of a member; a damaged member is left out, and one cut short has
    the records that are whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(file)
                with store.open_input_stream(path, compression=None) as stream:
                    for data in members(iter(lambda: stream.read(1 << 20) or None, None), skip=True):
                        found = list(parsed(data))
                        kinds = pa.map_(pa.string(), pa.string())
                        columns = [pa.array([file] * len(found), pa.string()), pa.array([list(dict(h).items()) for h, _ in found], kinds), pa.array([b for _, b in found], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=["file", "headers", "block"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select("path").mapInArrow(run, "file string, headers map<string,string>, block binary")
