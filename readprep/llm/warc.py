"""WARC derivatives: from every response a linked metadata record and a plain-text conversion record.

Both derivatives name their response in WARC-Refers-To and WARC-Concurrent-To each other's target, repeat its target URI
and date, and carry digests of their own blocks; the metadata record also holds the response's own headers, its HTTP
status line and headers, and its block and payload digests as they were, with those computed here beside them.

Responses are rows, read from WARC files by read_responses (record by record through Spark's reader, which splits plain
files) or made from raw pages by responses_from_pages. Bodies are freed of their transfer and content encodings before
they are read; digests are of the body as it stands. HTML is read by a single pass over the markup that never goes back, so malformed pages
cost no more than others.
"""

from __future__ import annotations

import base64
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readprep.llm.common import pick, ship

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("8f1d2c0e-5a37-4b8e-9b35-0c6c0f0d7a11")
#: Elements whose content isn't text of the page, and elements that end a line.
_SKIPPED = ("script", "style", "noscript", "template", "svg", "iframe", "head", "textarea", "select")
_RAW = ("script", "style", "textarea", "iframe", "noscript", "template")
_BLOCK = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
#: Elements that can stand in a head, and hidden ones that a block's tag ends where their own end is missing.
_IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_ENDED = ("select", "svg")
_LINKS = {"a": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "form": "action", "area": "href", "source": "src", "video": "src", "audio": "src"}
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def identifier(*parts: object) -> str:
    """A record id that reruns repeat."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, json.dumps([str(p) for p in parts]))}>"


def tags(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) and ("close", name, "") in order of the page."""
    at, n, missing = 0, len(page), set()

    def find(what: str, start: int) -> int:
        if what in missing:  # it wasn't there further up, so it isn't here
            return -1
        found = page.find(what, start)
        if found < 0:
            missing.add(what)
        return found

    lower = None
    while at < n:
        start = find("<", at)
        if start < 0:
            yield "text", page[at:], ""
            return
        if start > at:
            yield "text", page[at:start], ""
        if page.startswith("<!--", start):
            end = find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        after = page[start + 1 : start + 2]
        if not (after.isalpha() or after in "/!?"):
            yield "text", "<", ""
            at = start + 1
            continue
        end = find(">", start)
        if end < 0:
            yield "text", page[start:], ""
            return
        body = page[start + 1 : end]
        at = end + 1
        if after in ("!", "?"):
            continue
        name = re.match(r"/?\s*([^\s/>]*)", body)[1].lower()
        if after == "/":
            yield "close", name, ""
            continue
        yield "open", name, body[len(name) :]
        if name in _RAW:
            if lower is None:
                lower = page.lower() if len(page.lower()) == len(page) else page
            close = f"</{name}" if f"</{name}" not in missing else None
            stop = lower.find(close, at) if close else -1
            if stop < 0:
                missing.add(f"</{name}")
                continue
            at = stop


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(next((g for g in m.groups()[1:] if g is not None), "")))
    return out


def read_page(page: str) -> tuple[str, dict]:
    """(plain text, {title, metas, links}) of a page."""
    parts: list[str] = []
    title: list[str] = []
    found: dict = {"title": "", "metas": [], "links": []}
    hidden: list[str] = []
    in_title = False
    for kind, name, more in tags(page):
        if kind == "text":
            if hidden and hidden[-1] == "head" and not in_title and name.strip():
                hidden.pop()
            if in_title:
                title.append(name)
            elif not hidden:
                parts.append(html.unescape(name).replace("\n", " "))
        elif kind == "open":
            while hidden and (hidden[-1] == "head" and name not in _IN_HEAD or hidden[-1] in _ENDED and name in _BLOCK and name not in ("hr", "title")):
                hidden.pop()
            if name == "title":
                in_title = True
            elif name in _SKIPPED and not more.rstrip().endswith("/"):
                hidden.append(name)
            elif name == "foreignobject" and hidden and hidden[-1] == "svg":  # blocks belong to the drawing
                hidden.append(name)
            elif name == "body":
                hidden.clear()
            if name == "meta":
                a = attributes(more)
                if a:
                    found["metas"].append(a)
            elif name in _LINKS:
                a = attributes(more)
                if a.get(_LINKS[name]):
                    found["links"].append({"path": f"{name}@/{_LINKS[name]}", "url": a[_LINKS[name]]})
            if name in _BLOCK:
                parts.append("\n")
        else:
            while hidden and hidden[-1] in _ENDED and name in _BLOCK and name != "title":
                hidden.pop()
            if name == "title":
                in_title = False
            elif name in hidden:
                del hidden[hidden.index(name) :]
            if name in _BLOCK:
                parts.append("\n")
    lines = (" ".join(line.split()) for line in "".join(parts).split("\n"))
    found["title"] = " ".join(html.unescape("".join(title)).split())
    return "\n".join(line for line in lines if line), found


def split_http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """(status line, headers, body) of an HTTP response; a block without a head is all body."""
    if not block.startswith(b"HTTP/"):
        return "", {}, block
    for blank in (b"\r\n\r\n", b"\n\n"):
        head, found, body = block.partition(blank)
        if found:
            status, *rest = head.decode("latin-1").splitlines()
            return status, _headers(rest), body
    return block.decode("latin-1").splitlines()[0], {}, b""


def _headers(lines: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in " \t" and last:
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if colon:
            last = name.strip()
            out[last] = f"{out[last]}, {value.strip()}" if last in out else value.strip()
    return out


def charset(headers: dict[str, str]) -> str:
    kind = next((v for k, v in headers.items() if k.lower() == "content-type"), "")
    m = re.search(r"charset=[\"']?([\w-]+)", kind, re.I)
    if m:
        try:
            b"".decode(m[1])
            return m[1]
        except LookupError:
            pass
    return "utf-8"


def _dechunked(body: bytes) -> tuple[bytes, bool]:
    """The body of chunks, and whether all of them are there."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.match(rb"\s*([0-9A-Fa-f]+)", body[at : end if end >= 0 else len(body)])
        if end < 0 or not size:
            return b"".join(out), False
        n = int(size[1], 16)
        out.append(body[end + 2 : end + 2 + n])
        if not n or len(out[-1]) < n:
            return b"".join(out), not n
        at = end + 2 + n + 2


def _inflated(body: bytes, wbits: int) -> tuple[bytes, bool]:
    """What can be unpacked of a body, and whether that is all of it."""
    out = []
    while body:
        unpack = zlib.decompressobj(wbits)
        try:
            out.append(unpack.decompress(body))
        except zlib.error:
            return b"".join(out), False
        if not unpack.eof:
            return b"".join(out), False
        body = unpack.unused_data if wbits > 15 else b""  # a gzip body may have several members
    return b"".join(out), True


def entity(http: dict[str, str], body: bytes) -> tuple[bytes, str | None]:
    """The body without its encodings, and the encoding that couldn't be taken off in full, if any.

    Archives often store bodies decoded under headers that say otherwise; such a body is taken as it is.
    """
    of = lambda name: [x.strip().lower() for k, v in http.items() if k.lower() == name for x in v.split(",") if x.strip()]
    for name in [*reversed(of("content-encoding")), *reversed(of("transfer-encoding"))][::-1]:
        if name == "chunked":
            if not re.match(rb"\s*[0-9A-Fa-f]+\s*(;[^\r\n]*)?\r\n", body):
                continue
            body, whole = _dechunked(body)
        elif name in ("gzip", "x-gzip"):
            if body[:2] != b"\x1f\x8b":
                continue
            body, whole = _inflated(body, 31)
        elif name == "deflate":
            packed = body
            body, whole = _inflated(packed, 15)
            if not body and packed:
                body, whole = _inflated(packed, -15)
            if not body:
                body, whole = packed, False
        elif name == "identity":
            continue
        else:
            return body, name
        if not whole:
            return body, name
    return body, None


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as it stands in a file."""
    head = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def derive_one(headers: dict[str, str], block: bytes) -> list[dict]:
    """The metadata and the conversion record of a response."""
    get = lambda name: next((v for k, v in headers.items() if k.lower() == name.lower()), None)
    status, http, body = split_http(block)
    own = digest(body)
    source, target, date = get("WARC-Record-ID") or identifier("response", digest(block)), get("WARC-Target-URI") or "", get("WARC-Date") or DATE
    plain, stuck = entity(http, body)
    text, found = read_page(plain.decode(charset(http), "replace"))
    ids = {kind: identifier(kind, source) for kind in ("metadata", "conversion")}
    about = {
        "Envelope": {
            "WARC-Header-Metadata": headers,
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {"Response-Line": status, "Headers": http, "HTML-Metadata": found, "Entity-Length": len(body), "Entity-Digest": own, **({"Encoding-Left": stuck} if stuck else {})},
                "Actual-Block-Digest": digest(block),
                "Block-Digest": get("WARC-Block-Digest"),
                "Payload-Digest": get("WARC-Payload-Digest"),
            },
        },
        "Conversion": ids["conversion"],
    }
    blocks = {"metadata": ("application/json", json.dumps(about, ensure_ascii=False, sort_keys=True).encode()), "conversion": ("text/plain", text.encode())}
    out = []
    for kind, (content_type, made) in blocks.items():
        other = ids["conversion" if kind == "metadata" else "metadata"]
        fields = [("WARC-Record-ID", ids[kind]), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Refers-To", source), ("WARC-Concurrent-To", other), ("WARC-Payload-Digest", get("WARC-Payload-Digest") or own), ("WARC-Block-Digest", digest(made)), ("Content-Type", content_type)]
        out.append({"kind": kind, "record_id": ids[kind], "refers_to": source, "target_uri": target, "warc_date": date, "content_type": content_type, "content_length": len(made), "block_digest": digest(made), "payload_digest": get("WARC-Payload-Digest") or own, "record": record(kind, fields, made)})
    return out


_DERIVED = "source_id string, kind string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, payload_digest string, record binary"
_RESPONSE = "source_id string, headers map<string,string>, block binary"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    return pa.schema([(n, kinds[t]) for n, t in (f.strip().split(" ") for f in schema.split(", "))])


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow(_DERIVED)
    for batch in batches:
        for i in range(batch.num_rows):  # a response at a time: memory is that of one response and its derivatives
            block = batch["block"][i].as_py()
            if block is None:
                continue
            source = batch["source_id"][i].as_py()
            made = [{"source_id": source, **d} for d in derive_one(dict(batch["headers"][i].as_py() or []), block)]
            yield pa.RecordBatch.from_pylist(made, schema=schema)


def _batched(batches: Iterator[pa.RecordBatch], size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    held, held_size = [], 0
    for b in batches:
        held.append(b)
        held_size += b.nbytes
        if held_size >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, held_size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def derivatives(responses: DataFrame) -> DataFrame:
    """Two rows per response (source_id, headers, block): a `metadata` and a `conversion` record.

    A response without a block (null) has no derivatives; an empty one has both, the conversion empty. Ids depend on the
    response's own id alone (on its digest, if it has none), so reruns agree and repeated rows give repeated records.
    Missing headers are filled where a record needs them. Where an encoding is unknown or broken, text is read from what could
    be decoded, and the metadata name the encoding. An empty table gives an empty result.
    """
    ship(responses.sparkSession)
    rows = pick(responses, source_id="source_id", headers="headers", block="block")
    return rows.mapInArrow(lambda batches: _batched(_derive(batches)), _DERIVED)


def responses_from_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Pages as response rows (source_id, headers, block); a null page has a null block, a null address an empty one."""
    body = F.col("html").cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n")).cast("binary")
    name = F.sha2(F.concat_ws("\n", F.coalesce(F.col("id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))), 256)
    parts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    own = F.concat(F.lit("<urn:uuid:"), parts[0], F.lit("-"), parts[1], F.lit("-4"), parts[2], F.lit("-a"), parts[3], F.lit("-"), parts[4], F.lit(">"))
    headers = F.create_map(F.lit("WARC-Type"), F.lit("response"), F.lit("WARC-Record-ID"), own, F.lit("WARC-Target-URI"), F.coalesce("url", F.lit("")), F.lit("WARC-Date"), F.lit(date), F.lit("Content-Type"), F.lit("application/http; msgtype=response"))
    return pick(pages, id=id_col, url=url_col, html=html_col).select(F.col("id").cast("string").alias("source_id"), headers.alias("headers"), F.concat(head, body).alias("block"))


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a stream; what precedes a version line is skipped.

    A cut-off record has the block that is there, and the header WARC-Truncated if it had none.
    """
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        lines = []
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            lines.append(line.decode("utf-8", "replace").rstrip("\r\n"))
        headers = _headers(lines)
        size = _length(headers)
        block = stream.read(size)
        if len(block) < size and not any(k.lower() == "warc-truncated" for k in headers):
            headers["WARC-Truncated"] = "unspecified"
        yield headers, block


def _length(headers: dict[str, str]) -> int:
    return next((int(v) for k, v in headers.items() if k.lower() == "content-length" and v.isdigit()), 0)


#: What stands between records, with the start of the next one's version line.
_BETWEEN = "\r\n\r\nWARC/1."


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Response rows from pieces (path, piece) in file order; a block that holds a border itself is put together again."""
    schema = _arrow(_RESPONSE)

    def rows(path: str, raw: bytes) -> Iterator[pa.RecordBatch]:
        for headers, block in parse(io.BytesIO(raw)):
            if headers.get("WARC-Type", "").lower() == "response":
                yield pa.RecordBatch.from_pylist([{"source_id": headers.get("WARC-Record-ID", path), "headers": list(headers.items()), "block": block}], schema=schema)

    held, of, missing = [], None, 0
    for batch in batches:
        for path, piece in zip(batch["path"].to_pylist(), batch["piece"], strict=True):
            piece = piece.as_py()
            if of == path and missing > 0:
                held.append(_BETWEEN.encode() + piece)
                missing -= len(held[-1])
                continue
            if of is not None:
                yield from rows(of, b"".join(held))
            raw = piece if piece.startswith(b"WARC/") else b"WARC/1." + piece
            head, _, block = raw.partition(b"\r\n\r\n")
            of, held = path, [raw]
            missing = _length(_headers(head.decode("utf-8", "replace").split("\r\n")[1:])) - len(block)
    if of is not None:
        yield from rows(of, b"".join(held))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files, plain or gzip, in any folder that Spark reads.

    Spark's line reader, with the border between records as its line end, streams the files: plain ones are split over
    tasks, gzip ones are a task each, and memory is that of a record. A record cut off by the end of its file is kept with
    what is there and marked by WARC-Truncated; so is one that holds a border just where Spark splits the file.
    """
    ship(spark)
    lines = spark.read.option("lineSep", _BETWEEN).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("piece"))
    return lines.where(F.octet_length("piece") > 0).mapInArrow(lambda batches: _batched(_records(batches)), _RESPONSE)
