"""WARC derivatives: linked metadata records (WAT) and plain-text conversion records (WET) of response records.

A WARC column holds one record per row, gzipped as a member of its own, as WARC files are: rows can be joined into
a file by concatenation, and a file splits into rows at its members. The reader takes any sequence of records in
one value, gzipped and plain ones in any order, and finds the ends by Content-Length. What is neither a record nor a
whole member gives an error after the records before it.

For each response a `metadata` record (JSON envelope: response status and headers, page title, meta tags, links
with their kind and resolved target) and a `conversion` record (the page's text) are made. Both carry
WARC-Refers-To (the response's record id), WARC-Refers-To-Target-URI and -Date, the target URI and date of their
source, and SHA-1 block digests in base 32; the metadata record repeats the source's digests. Record ids are UUIDs
made from the source id and the kind, so building again gives the same records.

Bodies are read as a browser would: chunks are joined, and the codings gzip, deflate and zstd undone in reverse order;
of a body in another coding, or one that doesn't decode, there is no text: its conversion record says WARC-Truncated, and its row has
an error beside the derivatives. The entity digest is of the body as it is sent. A tag, comment, script or style that
never ends takes the rest of the page, as in a browser; a quote that never ends is an ordinary character. So a page is
read in time linear in its length, whatever it holds.

Defined results: a null url, page or id is empty; a response's id follows from page id, url and page, so equal rows
give equal record ids; records that aren't responses pass by; header names are looked up without regard to case, and a repeated header is a list of its values
in the metadata record (of a repeated name that should be single the first counts); a malformed record gives a row with an error and no derivatives; repeated rows repeat. Texts are
never cut. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import table, text_or_empty

CRLF = b"\r\n"
GZIP = b"\x1f\x8b"
PIECE = 1 << 14  # bytes that a gzip member is fed at once
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-record")
DATE = "2024-01-01T00:00:00Z"
LEVEL = 1  # of compression
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PAIRS = [a + b for a in BASE32 for b in BASE32]


# fixed values: the standard's spelling of header names, by their lower case
NAMES = {
    x.lower(): x
    for x in (
        "WARC-Type WARC-Record-ID WARC-Date WARC-Target-URI WARC-Payload-Digest WARC-Block-Digest WARC-Concurrent-To WARC-Refers-To WARC-Refers-To-Target-URI WARC-Refers-To-Date WARC-IP-Address "
        "WARC-Truncated WARC-Warcinfo-ID WARC-Filename WARC-Profile WARC-Identified-Payload-Type WARC-Segment-Number WARC-Segment-Origin-ID WARC-Segment-Total-Length Content-Type Content-Length"
    ).split()
}


@dataclass
class Record:
    headers: dict[str, str | list[str]] = field(default_factory=dict)
    block: bytes = b""

    def first(self, name: str, default: str | None = "") -> str | None:
        """The header's value, or the first of its values."""
        return _listed(self.headers[name])[0] if name in self.headers else default

    @property
    def kind(self) -> str:
        return self.first("WARC-Type")

    @property
    def id(self) -> str:
        return self.first("WARC-Record-ID")


def _listed(value: str | list[str]) -> list[str]:
    return value if isinstance(value, list) else [value]


def digest(data: bytes) -> str:
    """The SHA-1 of data in base 32, ten bits at a time."""
    n = int.from_bytes(hashlib.sha1(data).digest())
    return "sha1:" + "".join([PAIRS[n >> i & 1023] for i in range(150, -1, -10)])


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", value).strip() if "\n" in value or "\r" in value else value.strip()


def write(record: Record, gzipped: bool = True) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {_clean(v)}" for k, x in record.headers.items() for v in _listed(x)), f"Content-Length: {len(record.block)}"]
    data = "\r\n".join(lines).encode() + CRLF * 2 + record.block + CRLF * 2
    if not gzipped:
        return data
    return zlib.compress(data, LEVEL, 31)


def _members(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """(text of the gzip members in a row from at, where they end, False if the last is cut off or damaged)."""
    parts, view = [], memoryview(data)
    while data.startswith(GZIP, at):
        unpacker = zlib.decompressobj(31)
        try:
            while not unpacker.eof:
                if at >= len(data):
                    return b"".join(parts), at, False
                piece = view[at : at + PIECE]
                parts.append(unpacker.decompress(piece))
                at += len(piece) - len(unpacker.unused_data)
        except zlib.error:
            return b"".join(parts), at, False
    return b"".join(parts), at, True


def _fields(lines: list[bytes]) -> dict[str, str | list[str]]:
    """Values by name as it is first written; a list where a name, in whatever case, comes more than once."""
    names: dict[str, str] = {}
    found: dict[str, list[list[str]]] = {}  # the lines of each value
    last = None
    for text in CRLF.join(lines).decode("utf-8", "replace").split("\r\n"):
        if text[:1] in (" ", "\t") and last:
            found[last][-1].append(text.strip())
            continue
        name, colon, value = text.partition(":")
        if colon:
            name = name.strip()
            last = names.setdefault(name.lower(), name)
            found.setdefault(last, []).append([value.strip()])
    return {k: [" ".join(x) for x in v] if len(v) > 1 else " ".join(v[0]) for k, v in found.items()}


def _record(data: bytes, at: int) -> tuple[Record, int]:
    """The plain record at a place, and where it ends."""
    end = data.find(CRLF * 2, at)
    head = data[at : end if end >= 0 else at].split(CRLF)
    if not head[0].startswith(b"WARC/"):
        raise ValueError("no WARC record head")
    headers = {NAMES.get(k.lower(), k if k.startswith("WARC") else k.title()): v for k, v in _fields(head[1:]).items()}
    size = _listed(headers.pop("Content-Length", ""))[0]
    if not size.isdigit() or end + 4 + int(size) > len(data):
        raise ValueError("bad Content-Length")
    at = end + 4 + int(size)
    return Record(headers, data[end + 4 : at]), at


def read(data: bytes) -> Iterator[Record]:
    """The records of a value; ValueError where a record is malformed, after those before it."""
    at = 0
    while at < len(data):
        if data.startswith(CRLF, at):
            at += 2
        elif data.startswith(GZIP, at):
            plain, at, whole = _members(data, at)
            yield from read_plain(plain)
            if not whole:
                raise ValueError("damaged gzip member")
        else:
            record, at = _record(data, at)
            yield record


def read_plain(data: bytes) -> Iterator[Record]:
    at = 0
    while at < len(data):
        if data.startswith(CRLF, at):
            at += 2
        else:
            record, at = _record(data, at)
            yield record


def split_http(block: bytes) -> tuple[str, dict[str, str | list[str]], bytes]:
    """(status line, headers, body) of an HTTP response."""
    head, gap, body = block.partition(CRLF * 2)
    lines = head.split(CRLF)
    return lines[0].decode("utf-8", "replace"), _fields(lines[1:]), body if gap else b""


def joined_chunks(body: bytes) -> bytes:
    """The body of a chunked transfer; what isn't chunked, and what follows a malformed chunk, stays as it is."""
    parts, at = [], 0
    while at < len(body):
        end = body.find(CRLF, at)
        size = re.fullmatch(rb"\s*([0-9a-fA-F]+)\s*(?:;.*)?", body[at:end] if end >= 0 else b"", re.S)
        if not size:
            parts.append(body[at:])
            break
        n = int(size[1], 16)
        if not n:
            break
        parts.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(parts)


def _inflated(data: bytes, coding: str) -> bytes:
    if coding == "zstd":
        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if coding in ("gzip", "x-gzip"):
        kind = 31
    else:  # with or without the zlib frame
        kind = 15 if data[:1] and data[0] & 15 == 8 and len(data) > 1 and (data[0] << 8 | data[1]) % 31 == 0 else -15
    unpacker = zlib.decompressobj(kind)
    return unpacker.decompress(data) + unpacker.flush()


def entity(body: bytes, headers: dict[str, str | list[str]]) -> bytes | None:
    """The body without its transfer and content codings; None if one can't be undone."""
    if not any(k.lower() in ("transfer-encoding", "content-encoding") for k in headers):
        return body
    coded = lambda name: [c.strip().lower() for k, v in headers.items() if k.lower() == name for x in _listed(v) for c in x.split(",")]
    if "chunked" in coded("transfer-encoding"):
        body = joined_chunks(body)
    codings = [c for c in coded("content-encoding") + coded("transfer-encoding") if c not in ("", "identity", "chunked")]
    for coding in reversed(codings):
        if coding not in ("gzip", "x-gzip", "deflate", "zstd"):
            return None
        try:
            body = _inflated(body, coding)
        except (zlib.error, zstandard.ZstdError):
            return None
    return body


def response(key: str, url: str, page: str, date: str = DATE) -> Record:
    body = page.encode()
    own = digest(body)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    return Record(
        {
            "WARC-Type": "response",
            "WARC-Record-ID": record_id("response", key, url, own),
            "WARC-Date": date,
            "WARC-Target-URI": url,
            "WARC-Payload-Digest": own,
            "WARC-Block-Digest": digest(http),
            "Content-Type": "application/http; msgtype=response",
        },
        http,
    )


# ---- what a page says ------------------------------------------------------------------------------------------

# the rest of a tag; possessive, and with a way on from every character, so no start is tried twice over the same text
REST = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+"
END = r"(?:>|\Z)"
COMMENT = r"<!--.*?(?:-->|\Z)"
ATTRIBUTE = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
HIDDEN = re.compile(rf"<(script|style|noscript|template)\b[^>]*+{END}.*?(?:</\1\s*+>|\Z)|{COMMENT}", re.S | re.I)
TITLE = re.compile(rf"<title[^>]*+{END}", re.I)
TITLE_END = re.compile(r"</title\s*+>", re.I)
# fixed values: attributes that hold links, and elements that begin a line of text
LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "source": "src", "video": "src", "audio": "src", "embed": "src", "form": "action"}
LINES = "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table td th title tr ul".split()
LINKING = re.compile(rf"{COMMENT}|<({'|'.join([*LINKS, 'meta', 'base'])})\s({REST}){END}", re.S | re.I)
LINE = re.compile(rf"</?(?:{'|'.join(LINES)})(?![-\w]){REST}{END}", re.I)
TAG = re.compile(rf"</?[a-zA-Z]{REST}{END}|<![^>]*+{END}")


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(text)}


def plain_text(page: str) -> str:
    """All visible text, a line per block."""
    shown = TAG.sub("", LINE.sub("\n", HIDDEN.sub(" ", page)))
    lines = (" ".join(x.split()) for x in html.unescape(shown).split("\n"))
    return "\n".join(x for x in lines if x)


def resolved(base: str, site: str, link: str) -> str:
    """link against base; site is base's scheme and host."""
    link = link.strip()
    if link.startswith("/") and not link.startswith("//") and "./" not in link and site:
        return site + link
    try:
        return urljoin(base, link)
    except ValueError:  # not a URL, kept as it is written
        return link


def page_facts(page: str, url: str) -> dict:
    start = TITLE.search(page)
    end = TITLE_END.search(page, start.end()) if start else None
    title = html.unescape(page[start.end() : end.start()]).strip() if end else ""
    metas, links, base, site = [], [], url, _site(url)
    for m in LINKING.finditer(page):
        if not m[1]:
            continue
        name, found = m[1].lower(), _attributes(m[2])
        if name == "base":
            base = resolved(url, site, found.get("href", ""))
            site = _site(base)
        elif name == "meta":
            metas.append(found)
        elif found.get(LINKS[name], "").strip():
            raw = found[LINKS[name]]
            links.append({"path": f"{name.upper()}@/{LINKS[name]}", "url": raw, "target": resolved(base, site, raw)})
    return {"Title": title, "Metas": metas, "Links": links}


def _site(url: str) -> str:
    found = re.match(r"https?://[^/?#]+", url)
    return found[0] if found else ""


# ---- derivatives -----------------------------------------------------------------------------------------------


def _linked(source: Record, kind: str, content_type: str, block: bytes) -> Record:
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(kind, source.id),
        "WARC-Date": source.first("WARC-Date", DATE),
        "WARC-Target-URI": source.first("WARC-Target-URI", ""),
        "WARC-Refers-To": source.id,
        "WARC-Refers-To-Target-URI": source.first("WARC-Target-URI", ""),
        "WARC-Refers-To-Date": source.first("WARC-Date", DATE),
        "WARC-Block-Digest": digest(block),
        "Content-Type": content_type,
    }
    return Record(headers, block)


def derivatives(source: Record) -> tuple[Record, Record, dict]:
    """(metadata, conversion, facts) of a response record."""
    status, headers, body = split_http(source.block)
    found = re.search(r"charset=\"?([-\w]+)", next((_listed(v)[0] for k, v in headers.items() if k.lower() == "content-type"), ""))
    decoded = entity(body, headers)
    plain = decoded or b""
    try:
        page = plain.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        page = plain.decode("utf-8", "replace")
    facts = page_facts(page, source.first("WARC-Target-URI", ""))
    envelope = {
        "Envelope": {
            "WARC-Header-Metadata": source.headers,
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {"Response-Message": status, "Headers": headers, "Entity-Length": len(body), "Entity-Digest": digest(body), "HTML-Metadata": facts},
            },
        }
    }
    metadata = _linked(source, "metadata", "application/json", json.dumps(envelope, ensure_ascii=False).encode())
    conversion = _linked(source, "conversion", "text/plain", plain_text(page).encode())
    conversion.headers["WARC-Source-Payload-Digest"] = source.first("WARC-Payload-Digest", digest(body))
    if decoded is None:
        conversion.headers["WARC-Truncated"] = "unspecified"
    return metadata, conversion, facts


SCHEMA = "source_id string, source_uri string, source_digest string, metadata binary, conversion binary, n_links long, error string"


def build_responses(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, warc): one gzipped response record per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, urls, pages_ = (c.to_pylist() for c in batch.columns)
            yield pa.record_batch([batch.column(0), pa.array([write(response("" if k is None else str(k), u, p)) for k, u, p in zip(keys, urls, pages_)], pa.binary())], names=["page_id", "warc"])

    rows = pages.select("page_id", text_or_empty("url").alias("url"), text_or_empty("html").alias("html"))
    return rows.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, warc binary")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    for i, data in enumerate(batch.column(1).to_pylist()):
        try:
            for record in read(data or b""):
                if record.kind == "response":
                    metadata, conversion, facts = derivatives(record)
                    yield i, record.id, record.first("WARC-Target-URI"), record.first("WARC-Payload-Digest", None), write(metadata), write(conversion), len(facts["Links"]), "body not decoded" if "WARC-Truncated" in conversion.headers else None
        except ValueError as e:
            yield i, None, None, None, None, None, None, str(e)


def build_derivatives(warcs: DataFrame, key: str = "page_id") -> DataFrame:
    """warcs(key, warc) -> (key, ...SCHEMA): a row per response record in warc, and one for what is malformed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 3 + [pa.binary()] * 2 + [pa.int64(), pa.string()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = list(_rows(batch))
            if rows:
                at, *columns = zip(*rows)
                yield pa.record_batch([batch.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[key, *names])

    return warcs.select(key, "warc").mapInArrow(run, f"{key} {dict(warcs.dtypes)[key]}, {SCHEMA}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response records of all pages, their derivatives, and what those say when read back."""
    built = build_derivatives(build_responses(table(spark, sf_dir, "pages")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "source_id", "refers_to", "target_uri", "source_digest", "metadata_id", "metadata_digest", "conversion_id", "conversion_digest", "title", "n_links", "text"]
        for batch in batches:
            rows = []
            keys, sources, metas, conversions, links = (batch.column(c).to_pylist() for c in ("page_id", "source_id", "metadata", "conversion", "n_links"))
            for key, source, m, c, n in zip(keys, sources, metas, conversions, links):
                (meta,), (conversion,) = read(m), read(c)
                facts = json.loads(meta.block)["Envelope"]
                title = facts["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]["Title"]
                origin = facts["WARC-Header-Metadata"]["WARC-Payload-Digest"]
                rows.append((key, source, conversion.headers["WARC-Refers-To"], conversion.headers["WARC-Target-URI"], origin, meta.id, digest(meta.block), conversion.id, digest(conversion.block), title, n, conversion.block.decode()))
            kinds = [batch.schema.field(0).type, *[pa.string()] * 9, pa.int64(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    return built.mapInArrow(
        run,
        f"page_id {dict(built.dtypes)['page_id']}, source_id string, refers_to string, target_uri string, source_digest string, metadata_id string, metadata_digest string, "
        "conversion_id string, conversion_digest string, title string, n_links long, text string",
    )
