"""Public metadata and files: requests, a cache, retries and resuming.

The transport is a function from an address to bytes, so that a mirror, a recorded session or the network can serve; the
default opens addresses with urllib. Tables of what came back are DataFrames (manifest.match_metadata, fetch_status).
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from readprep.sources.fastq import ENDINGS, mate_by_name

#: Columns that the public interface is asked for.
FIELDS = ["run_accession", "study_accession", "secondary_study_accession", "study_title", "experiment_accession", "experiment_title", "sample_accession", "instrument_platform", "instrument_model", "library_strategy", "library_layout", "library_source", "library_selection", "sample_title", "sample_alias", "fastq_ftp", "fastq_aspera", "submitted_ftp", "submitted_aspera"]
Transport = Callable[[str], bytes]


def open_address(address: str) -> bytes:
    with urllib.request.urlopen(address, timeout=60) as f:
        return f.read()


def cache_key(url: str, fields: Iterable[str], accessions: Iterable[str]) -> str:
    """64-bit FNV-1a of the request, whatever the order of accessions."""
    h = 0xCBF29CE484222325
    for byte in "\n".join([url, ",".join(fields), ",".join(sorted(accessions))]).encode():
        h = (h ^ byte) * 0x100000001B3 % 2**64
    return f"{h:016x}"


def attempt(load: Callable[[], bytes], retries: int, wait: float = 0.0) -> tuple[bytes | None, int, str]:
    """(body, attempts, error) of up to retries + 1 attempts."""
    error = ""
    for n in range(1, retries + 2):
        try:
            return load(), n, ""
        except Exception as e:
            error = str(e)
            time.sleep(wait)
    return None, retries + 1, error


#: Accessions of the bridge's own kind, the others that its texts name, and its views in order.
GEO = re.compile(r"G(?:SE|SM|DS|PL)[0-9]+", re.I)
_LINKED = re.compile(r"(?<![A-Za-z0-9])(?:[SED]R[RXSP][0-9]+|PRJ(?:NA|EB|DB)[0-9]+|SAM(?:N|EA|D)[0-9]+)(?![A-Za-z0-9])", re.I)
VIEWS = ["quick", "full"]


def bridge(accession: str, url: str, transport: Transport = open_address, cache: str | None = None, retries: int = 2) -> dict:
    """The public accessions that a GEO record's text names: of the quick view, or else of the full one.

    Returns resolved, surface (the view that named them, or the last), source, attempts and error. Texts are kept in the
    cache; one that can't be read is passed over.
    """
    path = os.path.join(cache, cache_key(url, VIEWS, [accession.upper()]) + ".json") if cache else None
    texts: dict[str, str] = {}
    source, attempts, error = "remote", 0, ""
    if path and os.path.exists(path):
        try:
            with open(path, encoding="utf-8") as f:
                texts, source = json.load(f), "cache"
        except (OSError, ValueError):
            texts = {}
    if not texts:
        for view in VIEWS:
            raw, n, error = attempt(lambda v=view: transport(f"{url}?acc={accession}&targ=self&form=text&view={v}"), retries)
            attempts = max(attempts, n)
            if raw is None:
                return {"accession": accession, "resolved": [], "surface": None, "source": source, "attempts": attempts, "error": error}
            texts[view] = raw.decode("utf-8", "replace")
            if _LINKED.search(texts[view]):
                break
        if path:
            os.makedirs(cache, exist_ok=True)
            with open(path, "w", encoding="utf-8") as f:
                json.dump(texts, f)
    found = {view: list(dict.fromkeys(x.upper() for x in _LINKED.findall(text))) for view, text in texts.items()}
    view = next((v for v in VIEWS if found.get(v)), list(texts)[-1])
    return {"accession": accession, "resolved": found[view], "surface": f"{view}_text_self", "source": source, "attempts": attempts, "error": error}


def merge_bodies(bodies: Iterable[str]) -> str:
    """Tables with the same header as one."""
    out: list[str] = []
    for body in bodies:
        lines = [x for x in body.splitlines() if x.strip()]
        out += lines if not out else lines[1:]
    return "\n".join(out) + "\n" if out else ""


@dataclass
class Fetched:
    body: str
    status: list[dict]


def fetch(accessions: list[str], url: str, transport: Transport = open_address, chunk: int = 200, cache: str | None = None, retries: int = 2, fields: list[str] = FIELDS) -> Fetched:
    """The metadata tables of accessions, in chunks; a chunk without rows is asked for one by one.

    A cache that can't be read or holds no table is passed over.
    """
    bodies, status = [], []

    def ask(names: list[str]) -> tuple[str | None, str, int, str]:
        address = f"{url}?accession={','.join(names)}&result=read_run&format=tsv&fields={','.join(fields)}"
        path = os.path.join(cache, cache_key(url, fields, names) + ".tsv") if cache else None
        if path and os.path.exists(path):
            try:
                with open(path, encoding="utf-8") as f:
                    body = f.read()
                if body.startswith(fields[0]):
                    return body, "cache", 0, ""
            except (OSError, UnicodeDecodeError):
                pass
        raw, attempts, error = attempt(lambda: transport(address), retries)
        if raw is None:
            return None, "remote", attempts, error
        body = raw.decode("utf-8", "replace")
        if path:
            os.makedirs(cache, exist_ok=True)
            with open(path, "w", encoding="utf-8") as f:
                f.write(body)
        return body, "remote", attempts, ""

    for i in range(0, len(accessions), max(chunk, 1)):
        names = accessions[i : i + max(chunk, 1)]
        body, source, attempts, error = ask(names)
        single = len(names) > 1 and (body is None or len([x for x in body.splitlines() if x.strip()]) < 2)
        for group in [[n] for n in names] if single else [names]:
            if single:
                body, source, more, error = ask(group)
                attempts = max(attempts, more)
            if body:
                bodies.append(body)
            status += [{"accession": n, "failed": body is None, "source": source, "attempts": attempts, "error": error} for n in group]
    return Fetched(merge_bodies(bodies), status)


#: From an address and a first byte to (the byte from which on the answer goes, its parts).
Stream = Callable[[str, int], tuple[int, Iterable[bytes]]]


def open_stream(address: str, start: int) -> tuple[int, Iterable[bytes]]:
    """Opens an address at a byte; servers that can't do that answer from the first one."""
    request = urllib.request.Request(address, headers={"Range": f"bytes={start}-"} if start else {})
    answer = urllib.request.urlopen(request, timeout=60)

    def parts() -> Iterable[bytes]:
        with answer:
            while part := answer.read(1 << 20):
                yield part

    return (start if answer.status == 206 else 0), parts()


def download(address: str, destination: str, transport: Transport | None = None, retries: int = 2, overwrite: bool = False, stream: Stream = open_stream) -> dict:
    """One file, through a part file that takes its name only when whole; a part that is there is gone on with.

    The status says resumed only if the answer did go on behind the part. Bytes pass through piece by piece.
    """
    row = {"destination": destination, "source_url": address, "attempts": 0, "error": ""}
    if not overwrite and os.path.exists(destination) and os.path.getsize(destination):
        return row | {"status": "skipped_existing", "bytes": os.path.getsize(destination)}
    part = destination + ".part"
    os.makedirs(os.path.dirname(os.path.abspath(destination)), exist_ok=True)
    if transport is not None:
        stream = lambda a, start: (0, [transport(a)])
    resumed = False

    def load() -> bytes:
        nonlocal resumed
        have = os.path.getsize(part) if os.path.exists(part) else 0
        start, pieces = stream(address, have)
        with open(part, "ab" if start else "wb") as f:
            for piece in pieces:
                f.write(piece)
        resumed = start > 0
        return b""

    body, attempts, error = attempt(load, retries)
    if body is None:
        return row | {"status": "failed", "bytes": 0, "attempts": attempts, "error": error}
    os.replace(part, destination)
    return row | {"status": "resumed" if resumed else "downloaded", "bytes": os.path.getsize(destination), "attempts": attempts}


def destinations(inputs: list[str], addresses: list[str]) -> list[tuple[str, str]]:
    """(destination, address) for the one or two inputs of a data set.

    An address goes to the input of its own file name, else to that of its mate; two left over go in order, and one address
    to one input. Anything else is ambiguous, which is an error.
    """
    files = [a for a in addresses if os.path.basename(a).lower().endswith(ENDINGS)]
    of = lambda match: next((a for a in files if match(os.path.basename(a))), None)
    picked = [of(lambda n, i=i: n == os.path.basename(i)) or (of(lambda n, m=m: mate_by_name(n) == m) if len(inputs) > 1 else None) for m, i in enumerate(inputs, 1)]
    if None not in picked and len(set(picked)) == len(inputs):
        return list(zip(inputs, picked, strict=True))
    if len(files) == len(inputs):
        return list(zip(inputs, files, strict=True))
    raise ValueError(f"{len(files)} remote files can't be told apart for {', '.join(inputs)}")
