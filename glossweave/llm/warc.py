"""WARC derivative builder: response records to linked metadata and plain-text conversion records.

A derived record names its source by WARC-Refers-To and keeps the source's target, date and payload
digest and, under ``X-Source-`` names, its content type and HTTP header lines.  Record identifiers are UUIDs of version 5 made from the
source's identifier and the record type, so that building again gives the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
#: Namespace of record identifiers.
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:glossweave:warc")
#: Date of responses made from pages, whose table has none.
UNDATED = "1970-01-01T00:00:00Z"

#: What may stand inside a tag: no angle brackets outside quotes.
_INSIDE = r"""(?:[^<>"']|"[^"]*"|'[^']*')*"""
_DROPPED = ("script", "style", "noscript", "template", "svg", "nav", "head")
_OPEN = re.compile(rf"<!--|<({'|'.join(_DROPPED)})\b{_INSIDE}>", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in _DROPPED} | {"": re.compile("-->")}
_BREAK = re.compile(rf"<(?:/?(?:p|div|article|section|h[1-6]|ul|ol|li|table|tr|blockquote|pre|header|footer|main|aside|form)\b|br\b|hr\b){_INSIDE}>", re.I)
_TAG = re.compile(rf"</?[a-zA-Z!?]{_INSIDE}>")
_LOOSE = re.compile(r"</?[a-zA-Z!?][^<>]*>")
_SPACES = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[\s]*")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind} {source}')}>"


def one_line(value: str) -> str:
    """A header value without control characters, which would end the header."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value).strip()


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = b"".join(f"{k}: {one_line(v)}\r\n".encode() for k, v in [*headers, ("Content-Length", str(len(block)))])
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each record in ``raw``; a damaged record ends the reading with a ValueError."""
    at = 0
    while at < len(raw):
        if not raw.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError(f"headers without an end at byte {at}")
        headers: list[tuple[str, str]] = []
        for line in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in " \t" and headers:
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
            else:
                name, _, value = line.partition(":")
                headers.append((name.strip(), value.strip()))
        length = header(headers, "Content-Length") or ""
        if not (length.isascii() and length.isdigit()) or end + 4 + int(length) > len(raw):
            raise ValueError(f"length {length!r} of the record at byte {at}")
        size = int(length)
        yield headers, raw[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def header(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Header lines and body of an HTTP message; without a blank line everything is header."""
    head, _, body = block.partition(b"\r\n\r\n")
    return head, body


def without_hidden(markup: str) -> str:
    """The page without comments, scripts, styles, head and navigation; those that don't end stay.

    One pass: where a kind has no end behind some place, no later one is looked for.
    """
    out: list[str] = []
    endless: set[str] = set()
    at = begin = 0
    while found := _OPEN.search(markup, at):
        name = (found[1] or "").lower()
        end = None if name in endless else _CLOSE[name].search(markup, found.end())
        if end is None:
            endless.add(name)
            at = found.start() + 1
        else:
            out += [markup[begin : found.start()], " "]
            at = begin = end.end()
    return "".join([*out, markup[begin:]])


def plain_text(markup: str) -> str:
    """Visible text of a page: hidden parts dropped, blocks on lines of their own, entities decoded."""
    text = _TAG.sub("", _BREAK.sub("\n", without_hidden(markup)))
    text = html.unescape(_LOOSE.sub("", text))
    return _LINES.sub("\n", _SPACES.sub(" ", text)).strip()


def response_of_page(page_id, url: str | None, page: str | None) -> bytes:
    """A response record of a page row; a null url is ``urn:page:`` and the identifier, null markup an empty body.

    Its identifier is made from the page's identifier, url and payload: only rows that repeat all three share one.
    """
    body = (page or "").encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body
    source = f"{page_id} {url or ''} {digest(body)}"
    return build(
        [("WARC-Type", "response"), ("WARC-Record-ID", record_id(source, "response")), ("WARC-Target-URI", url or f"urn:page:{page_id}"), ("WARC-Date", UNDATED), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")],
        block,
    )


def derive(headers: list[tuple[str, str]], block: bytes) -> tuple[bytes, bytes]:
    """The metadata and the conversion record of a response."""
    source = header(headers, "WARC-Record-ID") or record_id(digest(block), "response")
    head, body = http_parts(block)
    lines = head.decode("utf-8", "replace").split("\r\n")
    http = [tuple(x.strip() for x in line.partition(":")[::2]) for line in lines[1:] if ":" in line]
    kept = [(k, v) for k in ("WARC-Target-URI", "WARC-Date") if (v := header(headers, k)) is not None]
    charset = re.search(r"charset=\"?([\w-]+)", header(http, "Content-Type") or "")
    try:
        markup = body.decode(charset[1] if charset else "utf-8", "replace")
    except (LookupError, UnicodeError):  # no such charset, or one that can't replace what it can't read
        markup = body.decode("utf-8", "replace")
    text = plain_text(markup).encode("utf-8", "replace")
    ids = record_id(source, "metadata"), record_id(source, "conversion")
    linked = [("WARC-Refers-To", source), *kept, ("X-Source-Payload-Digest", header(headers, "WARC-Payload-Digest") or digest(body))]
    fields = [("source-status", lines[0]), ("source-content-type", header(http, "Content-Type") or ""), ("source-length", str(len(body))), ("source-block-digest", header(headers, "WARC-Block-Digest") or digest(block)), ("conversion", ids[1]), ("text-length", str(len(text)))]
    facts = b"".join(f"{k}: {one_line(v)}\r\n".encode() for k, v in fields + [(f"http-{k.lower()}", v) for k, v in http])
    metadata = build([("WARC-Type", "metadata"), ("WARC-Record-ID", ids[0]), *linked, ("WARC-Block-Digest", digest(facts)), ("Content-Type", "application/warc-fields")], facts)
    more = [(f"X-Source-{k}", v) for k, v in http]
    conversion = build([("WARC-Type", "conversion"), ("WARC-Record-ID", ids[1]), *linked, ("WARC-Concurrent-To", ids[0]), ("WARC-Block-Digest", digest(text)), *more, ("Content-Type", "text/plain; charset=utf-8")], text)
    return metadata, conversion


def responses(pages: DataFrame) -> DataFrame:
    """page_id, record: a response record for each row of ``pages`` (page_id, url, html)."""

    def run(batches):
        for pdf in batches:
            rows = zip(pdf["page_id"], pdf["url"], pdf["html"])
            yield pd.DataFrame({"page_id": pdf["page_id"], "record": [response_of_page(*x) for x in rows]})

    return pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html").mapInPandas(run, "page_id string, record binary")


def derivatives(records: DataFrame) -> DataFrame:
    """page_id, response, metadata, conversion of every response in ``records`` (page_id, record); other record types give none.

    A damaged record ends the reading of its row, and the row's bytes come with null metadata and conversion; so does a null record.
    """

    def derived(i, raw):
        try:
            for h, block in parse(raw):
                if header(h, "WARC-Type") == "response":
                    yield i, build([x for x in h if x[0].lower() != "content-length"], block), *derive(h, block)
        except ValueError:
            yield i, raw, None, None

    def run(batches):
        for pdf in batches:
            out = [row for i, raw in zip(pdf["page_id"], pdf["record"]) for row in (derived(i, bytes(raw)) if raw is not None else [(i, None, None, None)])]
            yield pd.DataFrame(out, columns=["page_id", "response", "metadata", "conversion"])

    return records.select("page_id", "record").mapInPandas(run, "page_id string, response binary, metadata binary, conversion binary")


def derivative_digests(built: DataFrame) -> DataFrame:
    """What the built records say, read back from their bytes, one row for each response; of damaged ones only page_id is known and digests_hold is false."""
    names = ["response_id", "metadata_id", "conversion_id", "refers_to", "target_uri", "payload_digest", "block_digest", "digests_hold", "n_chars", "text_sha256"]

    def run(batches):
        for pdf in batches:
            rows = []
            for page_id, response, metadata, conversion in pdf.itertuples(index=False):
                if metadata is None:
                    rows.append((page_id, None, None, None, None, None, None, None, False, None, None))
                    continue
                (rh, rb), (mh, mb), (ch, cb) = (next(parse(bytes(x))) for x in (response, metadata, conversion))
                source = header(rh, "WARC-Record-ID")
                if {header(mh, "WARC-Refers-To"), header(ch, "WARC-Refers-To")} != {source}:
                    raise ValueError(f"records of {page_id} don't refer to {source}")
                holds = all(header(h, "WARC-Block-Digest") == digest(b) for h, b in ((rh, rb), (mh, mb), (ch, cb))) and header(ch, "X-Source-Payload-Digest") == digest(http_parts(rb)[1])
                text = cb.decode()
                rows.append((page_id, source, header(mh, "WARC-Record-ID"), header(ch, "WARC-Record-ID"), header(ch, "WARC-Refers-To"), header(ch, "WARC-Target-URI"), header(ch, "X-Source-Payload-Digest"), header(ch, "WARC-Block-Digest"), holds, len(text), hashlib.sha256(cb).hexdigest()))
            yield pd.DataFrame(rows, columns=["page_id", *names]).astype({"n_chars": "Int64"})

    schema = "page_id string, response_id string, metadata_id string, conversion_id string, refers_to string, target_uri string, payload_digest string, block_digest string, digests_hold boolean, n_chars long, text_sha256 string"
    return built.mapInPandas(run, schema)


def build_derivatives(pages: DataFrame) -> DataFrame:
    """page_id, response, metadata, conversion: the three records of every row of ``pages``.

    Null urls and markup have substitutes, empty markup gives an empty text, repeated rows give equal
    records, an empty table none; other columns are not read.
    """
    return derivatives(responses(pages))
