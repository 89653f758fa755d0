import gzip
import html.parser
import io
import json
import random
import zlib

from pyspark.sql import functions as F

from readprep.llm import warc

PAGE = "<html><head><title>A &amp; B</title><meta name='k' content=v><script>var x='<p>no</p>';</script></head><body><p>One <b>two</b>&nbsp;three<br>four <!-- five --> six</p><a href='/x?a=1&amp;b=2'>link</a><p>1 < 2</p><style>p{}</style></body></html>"


def test_read_page():
    text, found = warc.read_page(PAGE)
    assert text == "One two three\nfour six\nlink\n1 < 2"
    assert found == {"title": "A & B", "metas": [{"name": "k", "content": "v"}], "links": [{"path": "a@/href", "url": "/x?a=1&b=2"}]}


def test_omitted_ends_hide_no_text():
    for page, want in (
        ("<html><head><title>x</title><p>text <b>more</b>", "text more"),
        ("<head><title>x</title><meta name=a><style>p{}</style> bare text", "bare text"),
        ("<div><select><option>no</div><p>yes", "yes"),
        ("<svg><title>no</title><path d=x><p>yes</p>", "yes"),
        ("<svg><foreignObject><div>no</div></foreignObject></svg>yes", "yes"),
        ("<head><script>var a</script><noscript>no</noscript></head>yes", "yes"),
    ):
        assert warc.read_page(page)[0] == want


def test_malformed_pages_end():
    for page in ("<", "<a", "<!--", "<script>", "a<b", "<p" * 50_000, "<!--" * 50_000, "<script>x" * 20_000, "</" * 50_000, "<a href='" * 20_000):
        warc.read_page(page)


def test_derivatives_of_pages(spark):
    df = spark.createDataFrame([(1, "http://a/", PAGE, 0), (2, None, "", 0), (3, "http://c/", None, 0), (1, "http://a/", PAGE, 0), (None, "u", "<p>é</p>", 0)], "page_id long, url string, html string, record int")
    rows = warc.derivatives(warc.responses_from_pages(df)).collect()
    assert len(rows) == 8
    responses = {r.headers["WARC-Record-ID"]: r for r in warc.responses_from_pages(df).where("block is not null").collect()}
    for r in rows:
        (headers, block), = warc.parse(io.BytesIO(bytes(r.record)))
        source = responses[r.refers_to]
        assert headers["WARC-Type"] == r.kind and headers["WARC-Refers-To"] == r.refers_to
        assert headers["WARC-Block-Digest"] == warc.digest(block) == r.block_digest
        assert headers["WARC-Target-URI"] == source.headers["WARC-Target-URI"] and headers["WARC-Date"] == source.headers["WARC-Date"]
        body = warc.split_http(bytes(source.block))[2]
        assert headers["WARC-Payload-Digest"] == warc.digest(body)
        if r.kind == "metadata":
            about = json.loads(block)
            assert about["Envelope"]["WARC-Header-Metadata"] == source.headers
            assert about["Conversion"] == headers["WARC-Concurrent-To"]
        else:
            assert block.decode() == warc.read_page(body.decode())[0]
    assert len({r.record_id for r in rows}) == 6


def test_round_trip_through_files(spark, tmp_path):
    source = {"WARC-Record-ID": "<urn:uuid:1>", "WARC-Target-URI": "http://a/", "WARC-Date": "2020-02-02T00:00:00Z", "WARC-Payload-Digest": "sha1:GIVEN"}
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<p>caf\xe9</p>"
    records = [warc.record("response", list(source.items()), block), warc.record("warcinfo", [], b"x")]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "c.warc").write_bytes(records[0][:-30])
    rows = warc.derivatives(warc.read_responses(spark, str(tmp_path))).where(F.col("kind") == "conversion").collect()
    assert [r.refers_to for r in rows] == ["<urn:uuid:1>"] * 3
    assert sorted("WARC-Truncated" in r.headers for r in warc.read_responses(spark, str(tmp_path)).collect()) == [False, False, True]
    for r in rows:
        (headers, text), = warc.parse(io.BytesIO(bytes(r.record)))
        assert text.decode() in ("café", "") and headers["WARC-Payload-Digest"] == "sha1:GIVEN" and headers["WARC-Date"] == source["WARC-Date"]


def test_empty_table(spark):
    assert warc.derivatives(warc.responses_from_pages(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_files_split_and_blocks_that_hold_borders(spark, tmp_path):
    records, want = [], {}
    for i in range(300):
        body = b"<p>text %d</p>" % i + bytes(range(256)) + (b"\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n" if i % 50 == 7 else b"") + b"x" * (i * 7 % 400)
        block = b"HTTP/1.1 200 OK\r\n\r\n" + body
        records.append(warc.record("response", [("WARC-Record-ID", f"<{i}>")], block))
        want[f"<{i}>"] = block
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    assert {r.source_id: bytes(r.block) for r in warc.read_responses(spark, str(tmp_path)).collect()} == want
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        split = warc.read_responses(spark, str(tmp_path))
        assert split.rdd.getNumPartitions() > 3
        got = split.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    plain = {k: v for k, v in want.items() if b"WARC/1.0" not in v}
    assert {r.source_id: bytes(r.block) for r in got if r.source_id in plain} == plain and len(plain) == 294


def test_encoded_bodies():
    page = "<p>café</p>".encode() * 50
    chunks = b"".join(b"%x;a=b\r\n%s\r\n" % (len(page[i : i + 100]), page[i : i + 100]) for i in range(0, len(page), 100)) + b"0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    for headers, body, left in (
        ({}, page, None),
        ({"Content-Encoding": "gzip"}, gzip.compress(page), None),
        ({"content-encoding": "gzip"}, gzip.compress(page[:300]) + gzip.compress(page[300:]), None),
        ({"Content-Encoding": "gzip"}, page, None),
        ({"Content-Encoding": "deflate"}, zlib.compress(page), None),
        ({"Content-Encoding": "deflate"}, raw.compress(page) + raw.flush(), None),
        ({"Transfer-Encoding": "chunked"}, chunks, None),
        ({"Transfer-Encoding": "chunked"}, page, None),
        ({"Content-Encoding": "br"}, page, "br"),
    ):
        assert warc.entity(headers, body) == (page, left)
    packed = gzip.compress(page)
    both = b"%x\r\n%s\r\n0\r\n\r\n" % (len(packed), packed)
    assert warc.entity({"Content-Encoding": "gzip", "Transfer-Encoding": "chunked"}, both) == (page, None)
    cut, left = warc.entity({"Content-Encoding": "gzip"}, packed[:-12])
    assert left == "gzip" and page.startswith(cut)
    made = warc.derive_one({"WARC-Record-ID": "<1>"}, b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + packed)
    assert "café" in made[1]["record"].decode() and "Encoding-Left" not in made[0]["record"].decode()


class Plain(html.parser.HTMLParser):
    """Text of well-formed pages the slow way."""

    def __init__(self):
        super().__init__()
        self.lines, self.hidden = [""], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head")
        if tag in ("p", "div", "br", "li") and not self.hidden:
            self.lines.append("")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "head")
        if tag in ("p", "div", "li") and not self.hidden:
            self.lines.append("")

    def handle_data(self, data):
        if not self.hidden:
            self.lines[-1] += data


def test_text_matches_a_plain_parser():
    r = random.Random(12)

    def part(depth):
        kind = r.choice(["text", "text", "p", "div", "b", "br", "script", "comment", "li", "span"])
        if kind == "text" or depth > 4:
            return r.choice(["one two ", "a &lt; b", "caf&eacute;\n", " x", "1 &amp; 2", "日本 "])
        if kind == "br":
            return "<br>"
        if kind == "comment":
            return "<!-- <p>no</p> -->"
        if kind == "script":
            return "<script>var a = '<p>no</p>';</script>"
        return f"<{kind} class='c{depth}'>" + "".join(part(depth + 1) for _ in range(r.randrange(4))) + f"</{kind}>"

    for _ in range(300):
        page = "<html><head><title>t</title></head><body>" + "".join(part(0) for _ in range(r.randrange(8))) + "</body></html>"
        plain = Plain()
        plain.feed(page)
        plain.close()
        want = [" ".join(x.split()) for x in plain.lines]
        assert warc.read_page(page)[0].split("\n") == ([x for x in want if x] or [""]), page
