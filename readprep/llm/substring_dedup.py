"""Substring dedup: removes words covered by a window of words whose sequence also starts earlier in the corpus.

Super-k-mer partitioning. A window's minimiser is the smallest scrambled hash among its runs of MINIMISER words, so equal
windows have equal minimisers. Consecutive windows of a document with the same minimiser form a super-k-mer and travel as
one packed string (their words joined by single spaces) to the minimiser's bucket, a few words a window instead of twenty.
There the windows are sorted by a 128-bit hash, neighbours are compared in full, and every window but the first of its
kind is reported with its place.

A first pass counts minimisers, which cuts and balances the second: super-k-mers whose minimiser occurs once can't repeat
and stay at home (a bitmap of fixed size tells most of them), and the windows of a minimiser with very many super-k-mers
(a line that a large part of the corpus shares) are dealt by their own content instead. Before travelling, equal
super-k-mers of a batch are reduced to the earliest; the others are covered as a whole and need no bucket. A task also
remembers the hot windows it sent and sends one again only from an earlier place, so the bucket of a line that a third of
all documents share gets about a row from each task, a partial minimum, whatever the number of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readprep.llm import bytetext
from readprep.llm.bytetext import U64, Words, mix64, powers
from readprep.llm.common import cut, partitions, pick, ship

WINDOW = 20
MINIMISER = 8
#: Bits of the filter for repeated minimisers; its size doesn't depend on the input, only how much it keeps at home.
FILTER_BITS = 1 << 27
#: A minimiser is hot from this many super-k-mers on, and from this share of all; so at most 1/HOT_SHARE are (32 MB of
#: keys), and no other bucket holds more than that share.
HOT_COUNT, HOT_SHARE = 2000, 2.0**-22
#: Hot windows that a task remembers as sent. One that it forgets is sent again, which costs a row and changes nothing.
SENT = 1 << 15
#: Windows in one packed string at most; a longer run goes on in another string to the same bucket.
RUN = 4096
_BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)
_INVERSES = tuple(pow(b, -1, 2**64) for b in _BASES)


def lanes(hashes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the word sequences hashes[start:stop]."""
    out = []
    for base, inverse, salt in zip(_BASES, _INVERSES, (U64(0), U64(0x9E3779B97F4A7C15)), strict=True):
        sums = np.zeros(len(hashes) + 1, U64)
        np.cumsum((mix64(hashes ^ salt) if salt else hashes) * powers(base, len(hashes))[: len(hashes)], out=sums[1:])
        out.append(mix64((sums[stop] - sums[start]) * powers(inverse, len(hashes) + 1)[start] + (stop - start).astype(U64)))
    return out[0], out[1]


def window_minima(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum of each run of width values, and whether the run has it twice."""
    blocks, low, twice = {}, values, np.zeros(len(values), bool)
    size = 1
    while size <= width:
        blocks[size] = (low, twice)
        if 2 * size > width or len(low) <= size:
            break
        low, twice = _join((low[:-size], twice[:-size]), (low[size:], twice[size:]))
        size *= 2
    n = len(values) - width + 1
    if n <= 0:
        return values[:0], twice[:0]
    at, done = 0, None
    for size in sorted(blocks, reverse=True):
        if width - at >= size:
            low, twice = blocks[size]
            part = (low[at : at + n], twice[at : at + n])
            done = part if done is None else _join(done, part)
            at += size
    return done


def _join(a, b):
    return np.minimum(a[0], b[0]), np.where(a[0] == b[0], True, np.where(a[0] < b[0], a[1], b[1]))


def super_kmers(w: Words, window: int = WINDOW, minimiser: int = MINIMISER) -> tuple[np.ndarray, ...]:
    """(row, start, stop, key, weight): windows starting at words start to stop - 1 of a row share the minimiser key.

    weight is 2 if the minimiser may occur several times inside, else 1.
    """
    row, n = w.row, len(w.hash) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, np.int64))
    width = window - minimiser + 1
    key, twice = window_minima(mix64(bytetext.grams(w.hash, minimiser) ^ U64(0xD6E8FEB86659FD93)), width)
    inside = row[:n] == row[window - 1 :]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1] | (key[1:] != key[:-1]) | (row[1:n] != row[: n - 1])
    at = np.flatnonzero(inside)
    run = np.cumsum(fresh[at]) - 1
    heads = np.flatnonzero(fresh)
    over = at - heads[run] if len(heads) else at
    start = at[over % RUN == 0]
    pieces = np.searchsorted(at, start)
    lengths = np.diff(np.append(pieces, len(at)))
    double = np.add.reduceat(twice[at].astype(np.int64), pieces) > 0 if len(pieces) else np.zeros(0, bool)
    return row[start], start, start + lengths, key[start], np.where(double | (lengths > width), 2, 1)


def _count(window: int, minimiser: int):
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytetext.regroup(batches):
            for lo, hi in bytetext.row_slices(batch["text"]):
                _, _, _, key, weight = super_kmers(bytetext.words(batch["text"].slice(lo, hi - lo)), window, minimiser)
                order = np.argsort(key)
                key, weight = key[order], weight[order]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
                n = np.add.reduceat(weight, first) if len(first) else first
                yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(n)], schema=schema)

    return run


_TRAVEL = "bucket long, packed string, doc_id long, text_key long, start long, windows long"
_TRAVEL_ARROW = pa.schema([("bucket", pa.int64()), ("packed", pa.string()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()), ("windows", pa.int64())])


def _earliest(groups: tuple[np.ndarray, ...], place: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Order by group, then place; and for each item in that order whether its place is its group's first."""
    order = np.lexsort((*place[::-1], *groups[::-1]))
    same = np.ones(len(order), bool)
    for g in groups:
        g = g[order]
        same[1:] &= g[1:] == g[:-1]
    if len(same):
        same[0] = False
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    first = np.ones(len(order), bool)
    for p in place:
        p = p[order]
        first &= p == p[head]
    return order, first


def _unsent(items: tuple[np.ndarray, ...], sent: tuple[np.ndarray, ...], single_from: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """As _earliest, among the items (a, b, doc, text, place) and what was sent; and what is sent by now.

    Items from single_from on are hot windows, which are remembered.
    """
    n = len(items[0])
    every = tuple(np.concatenate(x) for x in zip(items, sent, strict=True))
    order, first = _earliest(every[:2], every[2:])
    head = np.ones(len(order), bool)
    head[1:] = (every[0][order][1:] != every[0][order][:-1]) | (every[1][order][1:] != every[1][order][:-1])
    held = order[head & (order >= single_from)]
    if len(held) > SENT:  # rather those of this batch
        held = held[np.argsort(held >= n, kind="stable")][:SENT]
    own = order < n
    return order[own], first[own], tuple(x[held] for x in every)


def _depart(window: int, minimiser: int, repeated, hot: np.ndarray):
    """Packs what may repeat. Rows without packed text report windows that are known to start earlier elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(repeated.value, np.uint8)
        sent = tuple(np.zeros(0, t) for t in (U64, U64, np.int64, np.int64, np.int64))  # a, b, doc, text, place
        for batch in bytetext.regroup(batches):
            doc_id, text_key = batch["doc_id"].to_numpy(), batch["text_key"].to_numpy()
            for lo, hi in bytetext.row_slices(batch["text"]):
                w = bytetext.words(batch["text"].slice(lo, hi - lo))
                row, start, stop, key, _ = super_kmers(w, window, minimiser)
                slot = (key & U64(FILTER_BITS - 1)).astype(np.int64)
                stays = (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 0
                go = np.flatnonzero(~stays)
                row, start, stop, key = row[go], start[go], stop[go], key[go]
                single_from = len(row)
                if len(hot) and len(key):
                    at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                    is_hot = hot[at] == key
                    if is_hot.any():  # single windows, dealt by content
                        n = (stop - start)[is_hot]
                        single = np.repeat(start[is_hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        content, _ = lanes(w.hash, single, single + window)
                        single_from = int((~is_hot).sum())
                        row = np.concatenate([row[~is_hot], np.repeat(row[is_hot], n)])
                        key = np.concatenate([key[~is_hot], content])
                        start, stop = np.concatenate([start[~is_hot], single]), np.concatenate([stop[~is_hot], single + 1])
                if not len(row):
                    continue
                a, b = lanes(w.hash, start, stop + window - 1)
                doc, text, place = doc_id[lo + row], text_key[lo + row], start - w.first[row]
                order, first, sent = _unsent((a, b, doc, text, place), sent, single_from)
                packed = _pack(w, start[order], stop[order] + window - 2, first)
                bucket = np.where(first, key[order].view(np.int64), doc[order])
                yield pa.RecordBatch.from_arrays([pa.array(bucket), packed, pa.array(doc[order]), pa.array(text[order]), pa.array(place[order]), pa.array((stop - start)[order])], schema=_TRAVEL_ARROW)

    return run


def _pack(w: Words, first: np.ndarray, last: np.ndarray, wanted: np.ndarray) -> pa.Array:
    """Words first to last of each wanted item, joined by single spaces; null for the others."""
    solid = ~bytetext.IS_SPACE[w.data]
    kept = solid.copy()
    kept[1:] |= solid[:-1]
    moved = np.concatenate([[0], np.cumsum(kept)])
    text = np.where(solid, w.data, 32)[kept].tobytes()
    begin, end = moved[w.start[first]], moved[w.end[last]]
    return pa.array([text[i:j] if k else None for i, j, k in zip(begin.tolist(), end.tolist(), wanted.tolist(), strict=True)], pa.binary()).cast(pa.string())


_RANGE = "doc_id long, text_key long, from_word long, to_word long"
_RANGE_ARROW = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("from_word", pa.int64()), ("to_word", pa.int64())])


def _arrive(window: int):
    """Reports the words of every window but the first of its kind. Rows come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in bytetext.regroup(batches):
            if not batch.num_rows:
                continue
            bucket = batch["bucket"].to_numpy()
            split = int(np.searchsorted(bucket, bucket[-1], "left"))
            table = pa.Table.from_batches([batch])
            if split:
                yield from _judge(pa.concat_tables([*held, table.slice(0, split)]), window)
                held = [table.slice(split)]
            elif not held or held[-1]["bucket"][0].as_py() == bucket[0]:
                held.append(table)
            else:
                yield from _judge(pa.concat_tables(held), window)
                held = [table]
        if held:
            yield from _judge(pa.concat_tables(held), window)

    return run


def _judge(table: pa.Table, window: int) -> Iterator[pa.RecordBatch]:
    table = table.combine_chunks()
    doc, text, start, count = (table[c].to_numpy() for c in ("doc_id", "text_key", "start", "windows"))
    packed = table["packed"].combine_chunks()
    packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed
    known = packed.is_null().to_numpy(zero_copy_only=False)
    if known.any():
        yield _ranges(doc[known], text[known], start[known], start[known] + count[known] + window - 1)
    w = bytetext.words(packed)
    n = np.diff(w.first)
    windows = np.maximum(n - window + 1, 0)
    row = np.repeat(np.arange(len(n)), windows)
    at = np.repeat(w.first[:-1], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    if not len(at):
        return
    a, b = lanes(w.hash, at, at + window)
    order = np.argsort(a)
    near = np.zeros(len(order), bool)
    near[1:] = a[order][1:] == a[order][:-1]
    near[:-1] |= near[1:]
    pick_ = order[near]
    if not len(pick_):
        return
    row, at, a, b = row[pick_], at[pick_], a[pick_], b[pick_]
    place = start[row] + at - w.first[row]
    a, b = _told_apart(w, at, a, b, window)
    order, first = _earliest((a, b), (doc[row], text[row], place))
    later = order[~first]
    yield _ranges(doc[row[later]], text[row[later]], place[later], place[later] + window)


def _told_apart(w: Words, at: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes, made different where windows of equal hash differ in content: neighbours are compared in full."""
    order = np.lexsort((b, a))
    same = np.zeros(len(order), bool)
    same[1:] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    data = w.data.tobytes()
    i, j = w.start[at[order]].tolist(), w.end[at[order] + window - 1].tolist()
    differ = [k for k in np.flatnonzero(same).tolist() if data[i[k] : j[k]] != data[i[k - 1] : j[k - 1]]]
    if not differ:
        return a, b
    seen: dict[tuple[int, int, bytes], int] = {}
    b = b.copy()
    bad = {(int(a[order[k]]), int(b[order[k]])) for k in differ}
    for k, o in enumerate(order.tolist()):
        if (x := (int(a[o]), int(b[o]))) in bad:
            b[o] = U64(seen.setdefault((*x, data[i[k] : j[k]]), len(seen)))
    return a, b


def _ranges(doc: np.ndarray, text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Word ranges, those that touch within a document made one."""
    order = np.lexsort((start, text, doc))
    doc, text, start, stop = doc[order], text[order], start[order], stop[order]
    if len(doc):
        fresh = np.ones(len(doc), bool)
        reach = stop.copy()
        other = np.append(True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]))
        # the furthest end so far within a document: ends are made to grow from document to document
        span = np.int64(stop.max() + 1)
        base = (np.cumsum(other) - 1) * span
        reach = np.maximum.accumulate(stop + base)
        fresh[1:] = (start + base)[1:] > reach[:-1]
        fresh |= other
        heads = np.flatnonzero(fresh)
        tails = np.append(heads[1:], len(doc)) - 1
        doc, text, start, stop = doc[heads], text[heads], start[heads], (reach - base)[tails]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, text, start, stop)], schema=_RANGE_ARROW)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
    for batch in bytetext.regroup(batches):
        with_text = batch.schema.get_field_index("with_text") >= 0
        for lo, hi in bytetext.row_slices(batch["text"], 1 << 24):
            n, gone, sha, kept_text = [], [], [], []
            for text, ranges in zip(batch["text"].slice(lo, hi - lo).to_pylist(), batch["ranges"].slice(lo, hi - lo).to_pylist(), strict=True):
                all_words = (text or "").encode().split()
                kept = all_words
                if ranges:
                    stays = bytearray(b"\1") * len(all_words)
                    for r in ranges:
                        i, j = r["from_word"], min(r["to_word"], len(all_words))
                        stays[i:j] = bytes(j - i)
                    kept = list(compress(all_words, stays))
                joined = b" ".join(kept)
                n.append(len(all_words))
                gone.append(len(all_words) - len(kept))
                sha.append(hashlib.sha256(joined).hexdigest())
                kept_text.append(joined.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(kept_text, pa.string())], schema=schema)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, minimiser: int = MINIMISER, with_text: bool = False, hot_count: int = HOT_COUNT) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, and by with_text kept_text (else null).

    Words are unchanged. A word goes if a window of that many words covers it whose sequence also starts earlier: in a
    smaller doc_id, or earlier in the same document. Windows are judged on the input. Rows that share an id count as one
    place if their texts are equal (neither is earlier) and else come in the order of a hash of the text. Rows with a null
    id take no part and keep all words, as do null and empty texts and those with fewer words than a window. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    known = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())

    counts = cut(known.select("text").mapInArrow(_count(window, minimiser), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = np.sort(counts.where(F.col("n") > max(hot_count, int(total * HOT_SHARE))).select("key").toArrow()["key"].to_numpy().view(U64))
    repeated = spark.sparkContext.broadcast(_bitmap(counts))

    travel = known.mapInArrow(_depart(window, minimiser, repeated, hot), _TRAVEL)
    arrived = travel.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    ranges = arrived.mapInArrow(_arrive(window), _RANGE)
    by_doc = ranges.groupBy(F.col("doc_id").alias("range_doc"), F.col("text_key").alias("range_key")).agg(F.collect_list(F.struct("from_word", "to_word")).alias("ranges"))
    joined = rows.join(by_doc, (F.col("doc_id") == F.col("range_doc")) & (F.col("text_key") == F.col("range_key")), "left").select("doc_id", "text", "ranges", *([F.lit(True).alias("with_text")] if with_text else []))
    return joined.mapInArrow(_finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string").select("doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else []))


def _bitmap(counts: DataFrame) -> bytes:
    """A bit for each slot with a repeated minimiser, in pieces of 4 kB built by the executors; FILTER_BITS / 8 bytes."""
    slot = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1))
    pieces = counts.groupBy(F.shiftright(slot, 15).alias("piece")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767))).alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for r in pieces.toLocalIterator():
        out[r.piece * 4096 : r.piece * 4096 + len(r.bits)] = r.bits
    return bytes(out)
