import base64
import hashlib
import html
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from glossweave.llm import warc

PAGE = "<html><head><title>T</title></head><body><!-- x --><script>var a='</p>';</script><nav>n</nav><h1>One &amp; two</h1><p>A <b>b</b>\n  c<br>d</p><div title='a>b'>e</div></body></html>"


def test_plain_text():
    assert warc.plain_text(PAGE) == "One & two\nA b\nc\nd\ne"
    assert warc.plain_text("") == ""
    assert warc.plain_text("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"


def test_records_round_trip():
    raw = warc.build([("WARC-Type", "response"), ("X", "a\r\nInjected: b")], b"\r\n\r\nblock\r\n") + warc.build([("WARC-Type", "metadata")], b"")
    (h, b), (h2, b2) = warc.parse(raw)
    assert warc.header(h, "warc-type") == "response" and warc.header(h, "Injected") is None and b == b"\r\n\r\nblock\r\n" and b2 == b""


def test_derivatives_refer_to_their_source(spark):
    pages = spark.createDataFrame([(1, "http://x/", PAGE, "e"), (2, None, None, None), (1, "http://x/", PAGE, "e"), (None, "http://y/", "", "e")], "page_id long, url string, html string, record string")
    built = warc.build_derivatives(pages)
    rows = built.collect()
    assert len(rows) == 4
    for r in rows:
        (rh, rb), (mh, mb), (ch, cb) = (next(warc.parse(bytes(x))) for x in (r.response, r.metadata, r.conversion))
        source = warc.header(rh, "WARC-Record-ID")
        assert warc.header(mh, "WARC-Refers-To") == warc.header(ch, "WARC-Refers-To") == source
        assert warc.header(ch, "WARC-Concurrent-To") == warc.header(mh, "WARC-Record-ID") != warc.header(ch, "WARC-Record-ID")
        assert warc.header(ch, "X-Source-Payload-Digest") == warc.header(rh, "WARC-Payload-Digest") == warc.digest(warc.http_parts(rb)[1])
        assert warc.header(ch, "X-Source-Content-Type") == "text/html; charset=utf-8"
        assert warc.header(ch, "WARC-Date") == warc.header(rh, "WARC-Date") and warc.header(ch, "WARC-Target-URI") == warc.header(rh, "WARC-Target-URI")
        assert b"source-block-digest: " + warc.header(rh, "WARC-Block-Digest").encode() in mb
    got = warc.derivative_digests(built).collect()
    assert all(r.digests_hold for r in got)
    assert {r.text_sha256 for r in got if r.page_id == "1"} == {hashlib.sha256(warc.plain_text(PAGE).encode()).hexdigest()}
    assert len({r.response_id for r in got}) == 3


def test_other_records_and_charsets(spark):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n<p>caf\xe9</p>"
    raw = warc.build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")], block) + warc.build([("WARC-Type", "request")], b"GET /")
    records = spark.createDataFrame([("1", bytearray(raw))], "page_id string, record binary")
    (row,) = warc.derivatives(records).collect()
    head, text = next(warc.parse(bytes(row.conversion)))
    assert text.decode() == "café" and warc.header(head, "WARC-Refers-To") == "<urn:x>"


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derivative_digests(warc.build_derivatives(pages)).count() == 0


def slow_text(markup):
    """The same extraction by whole-text substitutions, which rescan what an unclosed part leaves."""
    inside = r"""(?:[^<>"']|"[^"]*"|'[^']*')*"""
    text = re.sub(rf"<!--.*?-->|<(script|style|noscript|template|svg|nav|head)\b{inside}>.*?</\1\s*>", " ", markup, flags=re.S | re.I)
    text = re.sub(rf"<(?:/?(?:p|div|article|section|h[1-6]|ul|ol|li|table|tr|blockquote|pre|header|footer|main|aside|form)\b|br\b|hr\b){inside}>", "\n", text, flags=re.I)
    text = html.unescape(re.sub(r"</?[a-zA-Z!?][^<>]*>", "", re.sub(rf"</?[a-zA-Z!?]{inside}>", "", text)))
    return re.sub(r" ?\n[\s]*", "\n", re.sub(r"[^\S\n]+", " ", text)).strip()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<script>", "</script>", "<!--", "-->", "<style a='>'>", "</STYLE >", "<p>", "</p>", "<b", ">", "x", " ", "\n", '"', "'", "<", "&amp;", "<nav>", "</nav>", "<br/>"]), max_size=30))
def test_text_against_substitutions(parts):
    assert warc.plain_text("".join(parts)) == slow_text("".join(parts))


def test_long_and_unbalanced_pages():
    """A megabyte of openings without an end takes time in proportion."""
    for piece in ("<script>", "<!--", "<a '", '<svg "', "<p <nav>"):
        began = time.perf_counter()
        warc.plain_text(piece * (1_000_000 // len(piece)))
        assert time.perf_counter() - began < 20


def test_against_a_plain_builder(spark, sf_dir):
    """Every page of the test table: texts, digests and links worked out apart from the records."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in warc.derivative_digests(warc.build_derivatives(pages)).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        body = (r.html or "").encode("utf-8", "replace")
        text = slow_text(r.html or "")
        one = got[str(r.page_id)]
        assert one.refers_to == one.response_id and one.digests_hold and one.n_chars == len(text)
        assert one.target_uri == (r.url or f"urn:page:{r.page_id}")
        assert one.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert one.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        assert one.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    ids = [x for r in got.values() for x in (r.response_id, r.metadata_id, r.conversion_id)]
    assert len(set(ids)) == len(ids)


def test_same_identifier_and_url_with_other_markup(spark):
    pages = spark.createDataFrame([(1, "http://x/", "<p>a"), (1, "http://x/", "<p>b"), (1, "http://x/", "<p>b")], "page_id long, url string, html string")
    got = warc.derivative_digests(warc.build_derivatives(pages)).collect()
    assert len(got) == 3 and len({r.response_id for r in got}) == 2


def test_odd_charsets_and_damaged_records(spark):
    def response(charset):
        return warc.build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")], f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={charset}\r\n\r\n<p>text</p>".encode())

    good = response("utf-8")
    raws = [response("idna"), response("none-such"), response("undefined"), good + good[:-30], good + b"junk", b"WARC/1.1\r\nno end", b"WARC/1.1\r\nContent-Length: x\r\n\r\n", b"", None]
    records = spark.createDataFrame([(str(k), None if x is None else bytearray(x), "m") for k, x in enumerate(raws)], "page_id string, record binary, metadata string")
    rows = warc.derivatives(records).collect()
    found = sorted((r.page_id, r.metadata is not None) for r in rows)
    assert found == [("0", True), ("1", True), ("2", True), ("3", False), ("3", True), ("4", False), ("4", True), ("5", False), ("6", False), ("8", False)]
    assert all(next(warc.parse(bytes(r.conversion)))[1] == b"text" for r in rows if r.metadata)
    told = warc.derivative_digests(warc.derivatives(records)).collect()
    assert len(told) == 10 and sum(r.text_sha256 == hashlib.sha256(b"text").hexdigest() for r in told) == 5
