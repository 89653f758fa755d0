"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, byte fallback, whitespace markers.

A text is normalised by the model's own rules as far as they are "identity" (a marker in front, every space a marker) and
segmented into the pieces with the greatest sum of scores. A character that no piece covers costs 10 less than the worst
piece and is written as its bytes. Where no piece has a marker inside, no piece spans the border before a marker that
follows another character; the best segmentation is then the concatenation of those of the stretches between, and every
distinct stretch of a group of rows is segmented once. Stretches advance together, one byte at a time, through numpy
arrays of the trie; only stretches over LONG bytes (scripts without spaces) take a loop of their own.

Models are files of public tokenizers, read at the driver and broadcast as arrays; nothing is trained here. A unigram model's
scores are log probabilities. The scores of a merge model are ranks; the log probabilities taken for them are those of the
Zipf-Mandelbrot law for such ranks, so that sums of scores are those of a unigram language model there too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readprep.llm import bytetext
from readprep.llm.bytetext import U64, powers
from readprep.llm.common import pick, ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
_MARKER = MARKER.encode()
LONG = 192
UNKNOWN_PENALTY = 10.0
#: Shift of the ranks in the Zipf-Mandelbrot law.
ZIPF = 2.7
NORMAL, USER_DEFINED, BYTE = 1, 4, 6


@dataclass
class Pieces:
    """A vocabulary as arrays. In the trie and in text, a space stands for the marker."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    score: np.ndarray
    byte_id: np.ndarray
    unknown_id: int
    unknown_score: float
    prefix: bool
    splits: bool
    #: bytes of all pieces, and where each starts
    data: np.ndarray
    first: np.ndarray


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check, value: node s has the child t = base[s] + byte if check[t] == s; value is the key's or -1. Root is 0."""
    nodes: list[dict[int, int]] = [{}]
    values = [-1]
    for key, v in sorted(keys.items()):
        at = 0
        for byte in key:
            if byte not in nodes[at]:
                nodes[at][byte] = len(nodes)
                nodes.append({})
                values.append(-1)
            at = nodes[at][byte]
        values[at] = v
    room = 4 * len(nodes) + 4096
    base, check, value = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.full(room, -1, np.int32)
    empty = np.ones(room, bool)
    empty[0] = False
    place, level, low, scan = {0: 0}, [0], 1, 2048
    leaves = []
    while level:
        following = []
        for node in level:
            s = place[node]
            value[s] = values[node]
            if not nodes[node]:
                leaves.append(s)
                continue
            offsets = sorted(nodes[node])
            low += int(np.argmax(empty[low:]))
            b = max(1, low - offsets[0])
            while True:  # the first base whose children's places are all empty, from a block of bases at a time
                fits = empty[b + offsets[0] : b + offsets[0] + scan].copy()
                for o in offsets[1:]:
                    fits &= empty[b + o : b + o + scan]
                if fits.any():
                    b += int(np.argmax(fits))
                    break
                b += scan
            base[s] = b
            for byte, child in nodes[node].items():
                check[b + byte], empty[b + byte] = s, False
                place[child] = b + byte
                following.append(child)
        level = following
    used = int(np.flatnonzero(~empty)[-1]) + 1
    check, base, value = (np.concatenate([a[:used], np.full(512, f, np.int32)]) for a, f in ((check, -1), (base, 0), (value, -1)))
    base[leaves] = used + 1  # an empty region: nothing is a leaf's child
    check[0] = -2
    return base, check, value


def make_pieces(pieces: list[tuple[str, float, int]], prefix: bool = True, unknown_id: int = 0) -> Pieces:
    """From (piece, score, type) in order of ids."""
    normal = [s for _, s, t in pieces if t == NORMAL]
    worst, best = min(normal, default=0.0), max(normal, default=0.0)
    score = np.zeros(len(pieces))
    keys, byte_id, texts = {}, np.full(256, unknown_id, np.int32), []
    for i, (text, s, kind) in enumerate(pieces):
        raw = text.replace(MARKER, " ").encode()
        if kind == BYTE:
            raw = bytes([int(text[3:5], 16)])
            byte_id[raw[0]] = i
        elif kind in (NORMAL, USER_DEFINED):
            keys[raw] = i
            score[i] = s if kind == NORMAL else len(text) * best - 0.1
        else:
            raw = b" \xe2\x81\x87 " if i == unknown_id else b""
        texts.append(raw)
    inner = any(b" " in raw.lstrip(b" ") for raw in keys)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return Pieces(*double_array(keys), score, byte_id, unknown_id, worst - UNKNOWN_PENALTY, prefix, not inner, np.frombuffer(b"".join(texts), np.uint8), first)


def log_scores(scores: list[float]) -> list[float]:
    """Log probabilities for ranks of merges (0, -1, -2 and so on; scores under -1e6 come after all others)."""
    ranks = [-s for s in scores if s > -1e6]
    last = max(ranks, default=0.0) + 1
    weight = [1 / (min(-s, last) + ZIPF) for s in scores]
    total = sum(weight)
    return [float(np.log(w / total)) for w in weight]


def load(path: str = MODEL) -> Pieces:
    """A .model file of unigram pieces, or of merges, whose ranks become log_scores; its normaliser must be identity."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces:
        raise ValueError("only models with the identity normaliser are read")
    normal = [p for p in proto.pieces if p.type == NORMAL]
    merges = proto.trainer_spec.model_type == proto.trainer_spec.BPE
    score = dict(zip((p.piece for p in normal), log_scores([p.score for p in normal]), strict=True)) if merges else {}
    return make_pieces([(p.piece, score.get(p.piece, p.score), p.type) for p in proto.pieces], norm.add_dummy_prefix, proto.trainer_spec.unk_id)


def _char_length(lead: np.ndarray) -> np.ndarray:
    return np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))


def segment(stream: np.ndarray, start: np.ndarray, length: np.ndarray, m: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first): the best pieces of each stretch stream[start:start + length]; stretch i has ids[first[i]:first[i + 1]]."""
    long = np.flatnonzero(length > LONG)
    if len(long):
        return _with_long(stream, start, length, m, long)
    order = np.argsort(-length, kind="stable")
    begin, size = start[order].astype(np.int64), length[order].astype(np.int64)
    stream = np.concatenate([stream, np.zeros(64, np.uint8)])
    node = np.concatenate([[0], np.cumsum(size + 1)])  # positions 0 to size of each stretch
    best = np.full(node[-1], -np.inf)
    best[node[:-1]] = 0.0
    piece, came = np.full(node[-1], -1, np.int32), np.zeros(node[-1], np.int32)
    for s in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -s, "left"))  # longer than s
        lane = np.flatnonzero(best[node[:n] + s] > -np.inf)
        if not len(lane):
            continue
        here = best[node[lane] + s]
        width = _char_length(stream[begin[lane] + s])
        single = np.zeros(len(lane), bool)
        at, state, depth = np.arange(len(lane)), np.zeros(len(lane), np.int64), 0
        while len(at):
            at_lane = lane[at]
            follow = m.base[state] + stream[begin[at_lane] + s + depth].astype(np.int64)
            good = (m.check[follow] == state) & (s + depth < size[at_lane])
            at, state = at[good], follow[good]
            depth += 1
            value = m.value[state]
            hit = value >= 0
            if hit.any():
                who, v = at[hit], value[hit]
                single[who] |= width[who] == depth
                _relax(best, piece, came, node[lane[who]] + s + depth, here[who] + m.score[v], v, s)
        who = np.flatnonzero(~single)
        if len(who):
            reach = np.minimum(width[who], size[lane[who]] - s)
            _relax(best, piece, came, node[lane[who]] + s + reach, here[who] + m.unknown_score, np.full(len(who), -1, np.int32), s)
    lanes, values, place = [], [], []
    lane, at, back = np.arange(len(size)), size.copy(), 0
    lane, at = lane[at > 0], at[at > 0]
    count = np.zeros(len(size), np.int64)
    while len(lane):
        v, prior = piece[node[lane] + at], came[node[lane] + at].astype(np.int64)
        known = v >= 0
        lanes.append(lane[known])
        values.append(v[known])
        place.append(count[lane[known]])
        count[lane[known]] += 1
        raw = np.flatnonzero(~known)
        for k in range(4):  # bytes of a character, last first
            has = raw[at[raw] - k > prior[raw]]
            lanes.append(lane[has])
            values.append(m.byte_id[stream[begin[lane[has]] + at[has] - 1 - k]])
            place.append(count[lane[has]])
            count[lane[has]] += 1
        on = prior > 0
        lane, at = lane[on], prior[on]
    total = np.zeros(len(size), np.int64)
    total[order] = count
    first = np.concatenate([[0], np.cumsum(total)])
    ids = np.empty(first[-1], np.int32)
    if lanes:
        lanes_, place_ = np.concatenate(lanes), np.concatenate(place)
        ids[first[order[lanes_] + 1] - 1 - place_] = np.concatenate(values)
    return ids, first


def _relax(best, piece, came, target, score, value, s) -> None:
    better = score > best[target]
    target = target[better]
    best[target], piece[target], came[target] = score[better], value[better], s


def _with_long(stream, start, length, m: Pieces, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    short = np.flatnonzero(length <= LONG)
    ids, first = segment(stream, start[short], length[short], m)
    parts: dict[int, np.ndarray] = {int(i): segment_one(stream[start[i] : start[i] + length[i]].tobytes(), m) for i in long}
    total = np.zeros(len(start), np.int64)
    total[short] = np.diff(first)
    for i, x in parts.items():
        total[i] = len(x)
    at = np.concatenate([[0], np.cumsum(total)])
    out = np.empty(at[-1], np.int32)
    out[np.repeat(at[:-1][short] - first[:-1], np.diff(first)) + np.arange(len(ids))] = ids
    for i, x in parts.items():
        out[at[i] : at[i + 1]] = x
    return out, at


def segment_one(text: bytes, m: Pieces) -> np.ndarray:
    """The same for one stretch, byte by byte, in memory of its length."""
    base, check, value, score = m.base.item, m.check.item, m.value.item, m.score.item
    n = len(text)
    best, piece, came = [float("-inf")] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    for s in range(n):
        here = best[s]
        if here == float("-inf"):
            continue
        lead = text[s]
        width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        single, state, e = False, 0, s
        while e < n:
            follow = base(state) + text[e]
            if check(follow) != state:
                break
            state, e = follow, e + 1
            v = value(state)
            if v >= 0:
                single |= e - s == width
                if here + score(v) > best[e]:
                    best[e], piece[e], came[e] = here + score(v), v, s
        e = min(s + width, n)
        if not single and here + m.unknown_score > best[e]:
            best[e], piece[e], came[e] = here + m.unknown_score, -1, s
    out, at = [], n
    while at > 0:
        if piece[at] >= 0:
            out.append(piece[at])
        else:
            out.extend(int(m.byte_id[b]) for b in reversed(text[came[at] : at]))
        at = came[at]
    return np.array(out[::-1], np.int32)


def _normalised(column: pa.Array, m: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends): markers are spaces; non-empty rows have the prefix in front."""
    data, ends = bytetext.string_buffers(column)
    if len(data) and _MARKER in data.tobytes():
        rows = [x.replace(MARKER, " ") if x else "" for x in column.to_pylist()]
        data, ends = bytetext.string_buffers(pa.array(rows, pa.string()))
    if not m.prefix:
        return data, ends
    sizes = np.diff(ends)
    added = np.concatenate([[0], np.cumsum(sizes > 0)])
    out = np.full(len(data) + added[-1], 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(added[1:], sizes)] = data
    return out, ends + added


def encode(column: pa.Array, m: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first): the pieces of row r are ids[first[r]:first[r + 1]]; null and empty rows have none."""
    stream, ends = _normalised(column, m)
    sizes = np.diff(ends)
    fresh = np.zeros(len(stream) + 1, bool)
    if m.splits and len(stream):
        space = stream == 32
        fresh[1:-1] = space[1:] & ~space[:-1]
    fresh[ends[:-1][sizes > 0]] = True
    start = np.flatnonzero(fresh[:-1])
    length = np.diff(np.append(start, len(stream)))
    key, check = _hashes(stream, start, length)
    _, at, inverse = np.unique(key ^ check, return_index=True, return_inverse=True)
    if not _alike(stream, start, length, at[inverse]):  # two stretches under one hash: each is segmented by itself
        at = inverse = np.arange(len(start))
    ids, first = segment(stream, start[at], length[at], m)
    count = np.diff(first)[inverse]
    upto = np.concatenate([[0], np.cumsum(count)])
    out = ids[np.repeat(first[:-1][inverse] - upto[:-1], count) + np.arange(upto[-1])]
    return out, upto[np.searchsorted(start, ends, "left")]


def _alike(stream: np.ndarray, start: np.ndarray, length: np.ndarray, as_: np.ndarray) -> bool:
    """Whether each stretch, which together make up the stream, has the bytes of the stretch it is taken as."""
    if (length[as_] != length).any():
        return False
    return bool((stream[np.arange(len(stream)) + np.repeat(start[as_] - start, length)] == stream).all())


def _hashes(stream: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = np.zeros(len(stream) + 1, U64)
    for i in range(0, len(stream), bytetext.PIECE):  # powers start anew in each piece, and the sums go on
        j = min(len(stream), i + bytetext.PIECE)
        np.cumsum(bytetext.TABLE[stream[i:j]] * powers(bytetext.BASE, j)[i:j], out=sums[i + 1 : j + 1])
        sums[i + 1 : j + 1] += sums[i]
    total = (sums[start + length] - sums[start]) * powers(bytetext.INVERSE, len(stream) + 1)[start]
    return bytetext.mix64(total), length.astype(U64) * U64(0x9E3779B97F4A7C15)


def decode(ids: np.ndarray, first: np.ndarray, m: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of the rows' texts: pieces joined, markers as spaces, without the prefix."""
    size = np.diff(m.first)[ids]
    upto = np.concatenate([[0], np.cumsum(size)])
    data = m.data[np.repeat(m.first[:-1][ids] - upto[:-1], size) + np.arange(upto[-1])]
    ends = upto[first]
    if m.prefix and len(data):
        filled = np.diff(ends) > 0
        at = ends[:-1][filled]
        at = at[data[at] == 32]
        keep = np.ones(len(data), bool)
        keep[at] = False
        gone = np.concatenate([[0], np.cumsum(~keep)])
        data, ends = data[keep], ends - gone[ends]
    return data, ends


def _encode(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("n_bytes", pa.int64()), ("round_trip", pa.bool_()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Pieces = shared.value
        is_byte = np.zeros(len(m.first) - 1, bool)
        is_byte[m.byte_id[m.byte_id != m.unknown_id]] = True
        for batch in bytetext.regroup(batches):
            for lo, hi in bytetext.row_slices(batch["text"], 1 << 20):
                column = batch["text"].slice(lo, hi - lo)
                ids, first = encode(column, m)
                back, ends = decode(ids, first, m)
                same = _same(back, ends, *bytetext.string_buffers(column))
                spelled = np.concatenate([[0], np.cumsum(is_byte[ids])])[first]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(np.diff(spelled)), pa.array(same), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))], schema=schema)

    return run


def _same(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    if len(a) == len(b) and (a_ends == b_ends).all() and (a == b).all():
        return np.ones(len(a_ends) - 1, bool)
    return np.array([np.array_equal(a[a_ends[r] : a_ends[r + 1]], b[b_ends[r] : b_ends[r + 1]]) for r in range(len(a_ends) - 1)])


def _decode(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Pieces = shared.value
        for batch in bytetext.regroup(batches):
            lists = batch["ids"].fill_null([]) if batch["ids"].null_count else batch["ids"]
            ids = lists.flatten().to_numpy()
            first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            data, ends = decode(ids, first, m)
            text = data.tobytes()
            rows = [text[i:j].decode("utf-8", "replace") for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, pa.string())], schema=schema)

    return run


def encode_texts(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_pieces, n_bytes (of them, fallback bytes), round_trip, ids.

    round_trip says whether decoding gives the text back, which fails only if the text itself has the marker character.
    Null and empty texts have no pieces; a null one decodes to the empty text. Ids may be null or repeat. An empty table
    gives an empty result.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(model))
    return pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(_encode(shared), "doc_id long, n_pieces long, n_bytes long, round_trip boolean, ids array<int>")


def decode_ids(rows: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text from lists of ids; a null or empty list is the empty text, bytes that aren't UTF-8 are replaced."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(load(model))
    return pick(rows, doc_id=id_col, ids=ids_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decode(shared), "doc_id long, text string")
