"""Language identification of mixed-language texts.

A word is a run of letters. The script of its first letter narrows the candidate languages; each candidate scores the word
by its byte n-grams (orders 1 to 4, with word borders, naive Bayes over hashed counts). Viterbi with a penalty for
switching finds the best sequence of languages over a text's words, whose runs are the labelled spans.

The classifier is fitted on a bounded sample of labelled rows: of each language SAMPLE_ROWS expected, chosen by a hash of id
and text, or all if there are fewer. Counting runs on the executors; the driver gets at most BUCKETS counts a language, for
every language that has a labelled row. Texts are scored whole, in groups of rows whose bytes shrink as languages grow in
number; a text longer than a group is worked through in pieces that end between words, over which the best path is carried.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from readprep.llm import bytetext
from readprep.llm.bytetext import U64
from readprep.llm.common import carried, pick, position, ship, small

#: Labelled rows of a language that are expected to be learned from; all, if it has fewer.
SAMPLE_ROWS = 8_000
#: Languages whose tables a counting task holds at once; it hands on what it has beyond that.
HELD = 64
#: Scores (words times languages) of a group of rows, and of a piece of text, that are held at once, by bytes of text.
GROUP, PIECE = 32 << 20, 4 << 20
BUCKETS = 1 << 17
ORDERS = 4
F32 = np.float32
#: Nats of word score that a change of language has to gain.
SWITCH = 8.0
SMOOTH = 0.5
#: A language is a candidate for a script if at least this share of its words is in it.
SHARE = 0.01
#: First and last code point of Unicode script blocks, in code point order.
SCRIPTS = [
    (0x0041, 0x024F, "Latin"), (0x0250, 0x02AF, "IPA"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"), (0x0B80, 0x0BFF, "Tamil"),
    (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"), (0x0E00, 0x0E7F, "Thai"),
    (0x0E80, 0x0EFF, "Lao"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0x1200, 0x137F, "Ethiopic"),
    (0x1780, 0x17FF, "Khmer"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"), (0x3040, 0x309F, "Hiragana"),
    (0x30A0, 0x30FF, "Katakana"), (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"),
]
NAMES = sorted({s for _, _, s in SCRIPTS})
OTHER = len(NAMES)
_LOW = np.array([a for a, _, _ in SCRIPTS])
_HIGH = np.array([b for _, b, _ in SCRIPTS])
_SCRIPT = np.array([NAMES.index(s) for _, _, s in SCRIPTS])
#: Bytes of letters, lower-cased; every other ASCII byte separates.
_STREAM = np.full(256, 32, np.uint8)
_STREAM[65:91] = np.arange(97, 123)
_STREAM[97:123] = np.arange(97, 123)
_STREAM[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    #: (BUCKETS, languages): log probability of an n-gram
    grams: np.ndarray
    #: (scripts + 1, languages): whether the language is a candidate
    candidates: np.ndarray
    prior: np.ndarray


@dataclass
class Letters:
    """The letter runs of some rows; of row r they are first[r] to first[r + 1]."""

    stream: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray
    script: np.ndarray


@cache
def in_words() -> np.ndarray:
    """Whether each code point below the last letter blocks is a letter or a mark, as words are made of."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x32400)])


def code_points(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The code points whose UTF-8 bytes begin at these places."""
    padded = np.concatenate([data, np.full(4, 32, np.uint8)])
    b = [padded[start + i].astype(np.int64) for i in range(4)]
    two, three = (b[0] & 31) << 6 | b[1] & 63, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63
    four = (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63
    return np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, four)))


def letters(data: np.ndarray, ends: np.ndarray) -> Letters:
    """The words of texts, given as the bytes and offsets of a string column."""
    rows = len(ends) - 1
    low = _STREAM[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):  # signs, punctuation and pictures beyond ASCII separate too
        code, table = code_points(data, lead), in_words()
        other = lead[(code >= len(table)) | ~table[np.minimum(code, len(table) - 1)]]
        size = 2 + (data[other] >= 0xE0) + (data[other] >= 0xF0).astype(np.int64)
        for i in range(4):
            at = other[size > i] + i
            low[at[at < len(low)]] = 32
    stream = np.full(len(data) + rows + 1, 32, np.uint8)
    stream[np.arange(len(data)) + np.repeat(np.arange(1, rows + 1), np.diff(ends))] = low
    solid = stream != 32
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    start, stop = edge[0::2], edge[1::2]
    if len(stop) < len(start):
        stop = np.append(stop, len(stream))
    at = ends[:-1] + np.arange(1, rows + 1)
    first = np.searchsorted(start, np.append(at, len(stream)), "left")
    return Letters(stream, start, stop - start, first, scripts(stream, start))


def scripts(stream: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The script of the code point at each start; OTHER if no block has it."""
    code = code_points(stream, start)
    block = np.searchsorted(_LOW, code, "right") - 1
    return np.where((block >= 0) & (code <= _HIGH[np.maximum(block, 0)]), _SCRIPT[np.maximum(block, 0)], OTHER)


def gram_buckets(stream: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the positions at which an n-gram starts and its bucket; spaces stand only at its ends."""
    solid = stream != 32
    code = stream.astype(U64)
    packed = code.copy()
    for n in range(1, ORDERS + 1):
        if n > 1:
            packed = packed[:-1] | code[n - 1 :] << U64(8 * (n - 1))
        size = len(packed)
        if n == 1:
            valid = solid
        elif n == 2:
            valid = solid[:-1] | solid[1:]
        else:
            valid = solid[1 : 1 + size].copy()
            for i in range(2, n - 1):
                valid &= solid[i : i + size]
        at = np.flatnonzero(valid)
        mixed = (packed[at] + U64(n * 0x9E3779B97F4A7C15 % 2**64)) * U64(0xBF58476D1CE4E5B9)
        yield at, (mixed >> U64(64 - 17)).astype(np.int64)


def word_scores(x: Letters, model: Model) -> np.ndarray:
    """(words, languages): log scores, the best candidate of a word at 0; words without candidates are 0 throughout."""
    if not model.languages:
        return np.zeros((len(x.start), 0), np.float32)
    total = np.zeros((len(x.stream), len(model.languages)), np.float32)
    for at, bucket in gram_buckets(x.stream):
        total[at] += model.grams[bucket]
    if not len(x.start):
        return np.zeros((0, len(model.languages)), np.float32)
    # a word's n-grams start at its border or inside it
    edges = np.stack([x.start - 1, x.start + x.length], 1).reshape(-1)
    edges = np.minimum(edges, len(total) - 1)
    sums = np.add.reduceat(total, edges, axis=0)[0::2] / ORDERS
    allowed = model.candidates[x.script]
    none = ~allowed.any(1)
    sums = np.where(allowed, sums, -np.inf)
    sums[none] = 0
    return sums - sums.max(1, keepdims=True)


def viterbi(score: np.ndarray, first: np.ndarray, prior: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word; rows advance together, the longest first."""
    n_lang = score.shape[1]
    kind = np.int8 if n_lang < 128 else np.int32
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begin, length = first[order], lengths[order]
    active = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
    value = np.tile(prior.astype(np.float64), (len(order), 1))
    back = np.empty((len(score), n_lang), kind)
    states = np.arange(n_lang, dtype=kind)
    for t, n in enumerate(active.tolist()):
        v, at = value[:n], begin[:n] + t
        if t:
            arg = v.argmax(1)
            jump = v[np.arange(n), arg] - switch
            leave = v < jump[:, None]
            back[at] = np.where(leave, arg[:, None].astype(kind), states)
            np.maximum(v, jump[:, None], out=v)
        v += score[at]
    label = np.empty(len(score), kind)
    state = value.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        label[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    return label


def viterbi_pieces(pieces: Iterator[np.ndarray], prior: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The same for one text whose scores come piece by piece; a word leaves one index and one bit a language behind."""
    value, first, trail = prior.astype(np.float64), True, []
    for score in pieces:
        arg, leave = np.zeros(len(score), np.int32), np.zeros(score.shape, bool)
        for t in range(len(score)):
            if not first:
                arg[t] = value.argmax()
                jump = value[arg[t]] - switch
                leave[t] = value < jump
                value = np.maximum(value, jump)
            value = value + score[t]
            first = False
        trail.append((arg, np.packbits(leave, axis=1)))
    state, labels = int(value.argmax()) if len(value) else 0, []
    for arg, leave in reversed(trail):
        label = np.empty(len(arg), np.int32)
        for t in range(len(arg) - 1, -1, -1):
            label[t] = state
            if leave[t, state >> 3] >> (7 - (state & 7)) & 1:
                state = int(arg[t])
        labels.append(label)
    return np.concatenate(labels[::-1]) if labels else np.zeros(0, np.int32)


def text_pieces(data: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of about so many bytes that end between words; a run of letters that long is cut between code points."""
    at = 0
    while at < len(data):
        to = min(len(data), at + size)
        if to < len(data):
            ahead = data[to : to + (1 << 16)]
            gap = np.flatnonzero(_STREAM[ahead] == 32)
            gap = gap if len(gap) else np.flatnonzero(ahead & 0xC0 != 0x80)
            to += int(gap[0]) if len(gap) else len(ahead)
        yield at, to
        at = to


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams (bucket >= 0) and of words by script (bucket < 0) for each language."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())])
    counts: dict[str, np.ndarray] = {}
    for batch in bytetext.regroup(batches):
        for lang in sorted(pc.unique(batch["lang"]).to_pylist()):
            rows = batch["text"].filter(pc.equal(batch["lang"], lang))
            table = counts.setdefault(lang, np.zeros(BUCKETS + OTHER + 1, np.int64))
            for lo, hi in bytetext.row_slices(rows, 1 << 20):
                x = letters(*bytetext.string_buffers(rows.slice(lo, hi - lo)))
                for _, bucket in gram_buckets(x.stream):
                    table[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                table[BUCKETS:] += np.bincount(x.script, minlength=OTHER + 1)
        if len(counts) > HELD:  # a bound on a task's memory, not on what is counted
            yield from _emit(counts, schema)
            counts = {}
    yield from _emit(counts, schema)


def _emit(counts: dict[str, np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for lang, table in counts.items():
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.where(at < BUCKETS, at, BUCKETS - 1 - at)), pa.array(table[at])], schema=schema)


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model of all languages of labelled (doc_id, text, lang), from about so many rows of each, or all that it has."""
    ship(labelled.sparkSession)
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("rows"))
    rates = sizes.select("lang", F.ceil(F.least(F.lit(1.0), F.lit(rows) / F.col("rows")) * F.lit(1 << 30)).alias("upto"))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    sample = labelled.join(small(rates, sizes.count()), "lang").where(drawn < F.col("upto")).select("lang", "text")
    counts = sample.mapInArrow(_grams_of, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    named = table["lang"].combine_chunks().dictionary_encode()
    found = named.dictionary.to_pylist()
    languages = sorted(found)
    place = np.array([languages.index(x) for x in found], np.int64)
    lang = place[named.indices.to_numpy(zero_copy_only=False)] if languages else np.zeros(0, np.int64)
    bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy()
    grams, words = np.zeros((BUCKETS, len(languages)), np.float32), np.zeros((OTHER + 1, len(languages)))
    gram = bucket >= 0
    total = np.bincount(lang[gram], weights=n[gram], minlength=len(languages))
    grams[bucket[gram], lang[gram]] = n[gram]
    words[-1 - bucket[~gram], lang[~gram]] = n[~gram]
    each = np.maximum(words.sum(0), 1)
    grams += F32(SMOOTH)
    grams /= (total + SMOOTH * BUCKETS).astype(F32)
    np.log(grams, out=grams)
    return Model(languages, grams, words / each >= SHARE, np.log(each / each.sum()) if languages else each)


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _words_of(column: pa.Array, model: Model, switch: float, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label of each word, first word of each row, bytes of each word) of some rows, or of one text however long."""
    data, ends = bytetext.string_buffers(column)
    n_lang = len(model.languages)
    sizes: list[np.ndarray] = []
    if len(ends) == 2 and len(data) > piece:

        def scores() -> Iterator[np.ndarray]:
            for lo, hi in text_pieces(data, piece):
                x = letters(data[lo:hi], np.array([0, hi - lo]))
                sizes.append(x.length)
                yield word_scores(x, model)

        label = viterbi_pieces(scores(), model.prior, switch) if n_lang else np.zeros(sum(map(len, scores())), np.int32)
        return label, np.array([0, len(label)]), np.concatenate(sizes)
    parts, firsts, words = [], [], 0
    for i, j in bytetext.row_slices(column, piece):
        x = letters(*bytetext.string_buffers(column.slice(i, j - i)))
        parts.append(word_scores(x, model))
        firsts.append(x.first[:-1] + words)
        sizes.append(x.length)
        words += len(x.start)
    first = np.append(np.concatenate(firsts), words)
    label = viterbi(np.concatenate(parts), first, model.prior, switch) if n_lang and words else np.zeros(words, np.int8)
    return label, first, np.concatenate(sizes)


_SPAN = pa.struct([("from_word", pa.int64()), ("to_word", pa.int64()), ("lang", pa.string())])
_FOUND = [("lang_pred", pa.string()), ("score", pa.float64()), ("has_letter", pa.bool_()), ("spans", pa.list_(_SPAN))]


def _label(shared, text: str, switch: float, spans: bool):
    """Rows with lang_pred, score, has_letter and, if asked for, spans behind their own columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        n_lang = len(model.languages)
        group, piece = (max(1 << 16, most // max(n_lang, 4)) for most in (GROUP, PIECE))
        for batch in bytetext.regroup(batches, group):
            for lo, hi in bytetext.row_slices(batch[text], group):
                column, rows = batch[text].slice(lo, hi - lo), hi - lo
                label, first, size = _words_of(column, model, switch, piece)
                known = _ascii_letters(column)
                for r in np.flatnonzero((np.diff(first) > 0) & ~known):
                    known[r] = _has_letter(column[int(r)].as_py())
                row = np.repeat(np.arange(rows), np.diff(first))
                held = np.bincount(row * max(n_lang, 1) + label, weights=size, minlength=rows * max(n_lang, 1)).reshape(rows, -1)
                best = held.argmax(1)
                share = held[np.arange(rows), best] / np.maximum(held.sum(1), 1)
                sure = known if n_lang else np.zeros(rows, bool)
                names = np.array([*model.languages, "und"], dtype=object)[np.where(sure, best, n_lang)]
                arrays = [pa.array(names, pa.string()), pa.array(np.where(sure, share, 0.0)), pa.array(known)]
                if spans:
                    arrays.append(pa.array([_spans(label[first[r] : first[r + 1]], model.languages) if sure[r] else [] for r in range(rows)], pa.list_(_SPAN)))
                fields = [*batch.schema, *(pa.field(*f) for f in _FOUND[: len(arrays)])]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, rows).columns, *arrays], schema=pa.schema(fields))

    return run


def _ascii_letters(column: pa.Array) -> np.ndarray:
    """Rows that have a letter of A-Z or a-z."""
    data, ends = bytetext.string_buffers(column)
    low = data | 32
    upto = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122) & (data < 128))])
    return upto[ends[1:]] > upto[ends[:-1]]


def _spans(label: np.ndarray, languages: list[str]) -> list[dict]:
    edge = np.flatnonzero(np.diff(label)) + 1
    starts, stops = [0, *edge.tolist()], [*edge.tolist(), len(label)]
    return [{"from_word": a, "to_word": b, "lang": languages[label[a]]} for a, b in zip(starts, stops, strict=True)]


def label_rows(docs: DataFrame, model: Model, text_col: str = "text", switch: float = SWITCH, spans: bool = False) -> DataFrame:
    """docs, whose columns have names of their own, with lang_pred, score, has_letter and, if asked for, spans; see identify."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    more = "lang_pred string, score double, has_letter boolean" + (", spans array<struct<from_word: long, to_word: long, lang: string>>" if spans else "")
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(more).fields])
    return docs.mapInArrow(_label(shared, text_col, switch, spans), schema)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH, spans: bool = False) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, has_letter, and by spans a list of (from_word, to_word, lang) over
    words, which are runs of letters and their marks.

    lang_pred is the language with the most bytes of words, ties to the first in order of name; score is its share of them. A
    text that is null or has no letter is `und` with score 0, and so is every text if the model has no language. Ids may be
    null or repeat; rows are judged one by one, however long. An empty table gives an empty result.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return label_rows(rows, model, "text", switch, spans).drop("text")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that get a language; all rows with a letter, if the model has none."""
    safe, names = carried(docs)
    found = label_rows(safe, model, safe.columns[position(names, text_col)])
    kept = found.where(F.col("lang_pred") != "und") if model.languages else found.where("has_letter")
    return kept.select(*safe.columns).toDF(*names)


def remainder(id_: Column, by: int) -> Column:
    """crc32 of the id as text, modulo by; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def learned(docs: DataFrame, folds: int = 5) -> Model:
    """A model from the labelled rows of docs (doc_id, text, lang) whose crc32 remainder isn't 0."""
    return fit(pick(docs, doc_id="doc_id", text="text", lang="lang").where(remainder(F.col("doc_id"), folds) != 0))


def languages(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learns from labelled rows whose crc32 remainder isn't 0 and labels all rows."""
    return identify(docs, learned(docs, folds)).select("doc_id", (remainder(F.col("doc_id"), folds) == 0).alias("held_out"), "lang_pred", "score")
