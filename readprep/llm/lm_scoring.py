"""Language-model scoring of whole documents.

Counts of all words of the training documents are gathered first: they give the smoothed unigram score (base_score), the
vocabulary, its classes and the model's starting distribution. A gated recurrent network (gru.py) is then trained on all
training documents, each token once: every task learns from its own share in truncated windows, a task whose parameters
diverge fails rather than leave its share out, and the tasks' parameters are averaged by their tokens, in ROUNDS rounds of growing share so that the tasks of the last start close together. Finally every document
is scored from its first word to its end with carried state.

Words outside the network's vocabulary are one token to it; which of them it is has the smoothed unigram probability among
them, so the score is a probability of the text itself. Counts of the most frequent words, HEAD at most, are broadcast; the counts of all others are joined by word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readprep.llm import bytetext, gru
from readprep.llm.bytetext import U64
from readprep.llm.common import cut, partitions, pick, ship
from readprep.llm.language_id import remainder

HEAD = 1 << 18
#: Shares of the training documents that the rounds learn from; every document is learned from once.
ROUNDS = (0.125, 0.875)
#: Bytes of text that are worked through together.
GROUP = 12 << 20
_BLOCK = 4096
_TOP = 20


@dataclass
class Head:
    """The most frequent words, by hash: counts, and their token or the unknown one."""

    hash: np.ndarray
    log_count: np.ndarray
    token: np.ndarray
    unknown: int
    end: int
    counts: np.ndarray
    end_count: int

    def __post_init__(self):
        #: where the hashes with each value of their highest bits start; a few share one
        self.start = np.searchsorted(self.hash >> U64(64 - _TOP), np.arange((1 << _TOP) + 1, dtype=U64)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each word in the head, or -1: the place that its highest bits give, then the next of the same bits."""
        found = np.full(len(hashes), -1, np.int32)
        if not len(self.hash):
            return found
        top = (hashes >> U64(64 - _TOP)).astype(np.int32)
        at, stop, rest = self.start[top], self.start[top + 1], np.arange(len(hashes), dtype=np.int32)
        while len(rest):
            inside = at < stop
            at, stop, rest = at[inside], stop[inside], rest[inside]
            same = self.hash[at] == hashes[rest]
            found[rest[same]] = at[same]
            at, stop, rest = at[~same] + 1, stop[~same], rest[~same]
        return found


def word_hash(words: list[str]) -> np.ndarray:
    return bytetext.words(pa.array(words, pa.string())).hash


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    for batch in bytetext.regroup(batches, GROUP):
        for lo, hi in bytetext.row_slices(batch["text"], GROUP):
            w = bytetext.words(batch["text"].slice(lo, hi - lo), lower=True)
            at, n = _distinct(w.hash)
            yield pa.RecordBatch.from_arrays([_strings(w, at), pa.array(n)], schema=schema)


def _strings(w: bytetext.Words, at: np.ndarray) -> pa.Array:
    """The lower-cased words at these places."""
    start, size = w.start[at], w.end[at] - w.start[at]
    ends = np.concatenate([[0], np.cumsum(size)])
    data = bytetext.LOWER[w.data[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]]
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct value, how often it occurs)."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(order) else order
    return order[first], np.diff(np.append(first, len(order)))


def make_head(top: list[tuple[str, int]], total_words: int, docs: int) -> Head:
    """From (word, count) by falling count: the network knows the first of them, besides the end and the unknown word."""
    known = top[: gru.VOCAB - 2]
    ranked = [(n, i) for i, (_, n) in enumerate(known)] + [(total_words - sum(n for _, n in known), -1), (docs, -2)]
    ranked.sort(key=lambda x: -x[0])
    token = {i: t for t, (_, i) in enumerate(ranked)}
    counts = np.zeros(gru.VOCAB)
    counts[: len(ranked)] = [n for n, _ in ranked]
    hashes = word_hash([w for w, _ in top])
    order = np.argsort(hashes)
    tokens = np.array([token.get(i, token[-1]) for i in range(len(top))], np.int32)
    logs = np.log10(np.array([n for _, n in top], float) + 0.1)
    return Head(hashes[order], logs[order], tokens[order], token[-1], token[-2], counts, docs)


def tokens(column: pa.Array, head: Head) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytetext.Words]:
    """(token ids with an end after each row, first of each row, head index of each word, words)."""
    w = bytetext.words(column, lower=True)
    at = head.find(w.hash)
    ids = np.where(at >= 0, head.token[at] if len(head.token) else head.unknown, head.unknown)
    first = w.first + np.arange(len(w.first))
    out = np.full(first[-1], head.end, np.int32)
    out[np.arange(len(ids)) + w.row] = ids
    return out, first, at, w


def most_frequent(counts: DataFrame, most: int = HEAD) -> list[tuple[str, int]]:
    """The words (word, c) of the highest classes of counts that have at most so many words in all, by falling count.

    A sixty-fourth of a doubling is a class, so small counts are classes of their own; the driver gets a few thousand class
    sizes and then no more words than asked for.
    """
    level = F.floor(F.log2(F.col("c")) * 64)
    least, n = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if n + r.n > most:
            break
        least, n = r.level, n + r.n
    if least is None:
        return []
    found = counts.where(level >= least).select("word", "c").toArrow()
    return sorted(zip(found["word"].to_pylist(), found["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


def _train(shared, theta: np.ndarray):
    schema = pa.schema([("block", pa.int64()), ("weight", pa.float64()), ("values", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: Head = shared.value
        trainer = gru.Trainer(theta)
        for batch in bytetext.regroup(batches, GROUP):
            for lo, hi in bytetext.row_slices(batch["text"], GROUP):
                ids, first, _, _ = tokens(batch["text"].slice(lo, hi - lo), head)
                before = np.empty_like(ids)
                before[1:] = ids[:-1]
                fresh = np.zeros(len(ids), bool)
                fresh[first[:-1]] = True
                before[fresh] = head.end
                with np.errstate(over="ignore"):
                    trainer.feed(before, ids, fresh)
        if not np.isfinite(trainer.theta).all():
            raise FloatingPointError("training diverged: parameters are not finite after %d tokens" % trainer.tokens)
        if trainer.tokens:
            for k, i in enumerate(range(0, gru.LENGTH, _BLOCK)):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([float(trainer.tokens)]), pa.array([trainer.theta[i : i + _BLOCK]], pa.list_(pa.float32()))], schema=schema)

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted sums of parameter blocks, one block of memory for each block number."""
    schema = pa.schema([("block", pa.int64()), ("weight", pa.float64()), ("values", pa.list_(pa.float64()))])
    sums: dict[int, tuple[float, np.ndarray]] = {}
    for batch in batches:
        for block, weight, values in zip(batch["block"].to_pylist(), batch["weight"].to_pylist(), batch["values"], strict=True):
            have = sums.get(block, (0.0, 0.0))
            sums[block] = (have[0] + weight, have[1] + weight * values.values.to_numpy().astype(np.float64))
    for block, (weight, values) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([weight]), pa.array([values], pa.list_(pa.float64()))], schema=schema)


def train(docs: DataFrame, head: Head) -> np.ndarray:
    """Parameters learned from all rows of docs (doc_id, text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(head)
    theta = gru.initial(head.counts)
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    low = 0.0
    for share in ROUNDS:
        part = docs.where((draw >= low) & (draw < low + share) if low + share < 1 else draw >= low).select("text")
        low += share
        learned = part.mapInArrow(_train(shared, theta), "block long, weight double, values array<float>")
        summed = learned.repartition(partitions(spark), "block").mapInArrow(_add, "block long, weight double, values array<double>")
        rows = summed.collect()  # one row for each block of the parameters, whatever the input
        if rows:
            theta = theta.copy()
            for r in rows:
                theta[r.block * _BLOCK : (r.block + 1) * _BLOCK] = np.array(r["values"]) / r.weight
    return theta


def _score(shared, theta: np.ndarray):
    names = ["n_tokens", "known", "unknown", "outside", "base_sum", "rare_sum", "net"]
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), *((n, pa.int64()) for n in names[:4]), *((n, pa.float64()) for n in names[4:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: Head = shared.value
        end_log = math.log10(head.end_count + 0.1)
        for batch in bytetext.regroup(batches, GROUP):
            for lo, hi in bytetext.row_slices(batch["text"], GROUP):
                ids, first, at, w = tokens(batch["text"].slice(lo, hi - lo), head)
                inside, row, rows = at >= 0, w.row, hi - lo
                log = head.log_count[at[inside]] if inside.any() else np.zeros(0)
                rare = head.token[at[inside]] == head.unknown if inside.any() else np.zeros(0, bool)
                per = lambda r, weights=None: np.bincount(r, weights=weights, minlength=rows)
                known = per(row[inside]) + (head.end_count > 0)
                base = per(row[inside], log) + end_log
                rare_sum = per(row[inside][rare], log[rare])
                unknown = np.add.reduceat(ids == head.unknown, first[:-1], dtype=np.int64)
                with np.errstate(over="ignore"):
                    net = gru.score(ids, first, head.end, theta)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, rows), batch["text_key"].slice(lo, rows), *(pa.array(x) for x in (np.diff(first), known.astype(np.int64), unknown, per(row[~inside]), base, rare_sum, net))], schema=schema)

    return run


def _tail(shared):
    """Words outside the head: (doc_id, text_key, word, n)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: Head = shared.value
        for batch in bytetext.regroup(batches, GROUP):
            for lo, hi in bytetext.row_slices(batch["text"], GROUP):
                w = bytetext.words(batch["text"].slice(lo, hi - lo), lower=True)
                out = np.flatnonzero(head.find(w.hash) < 0)
                row, value = w.row[out], w.hash[out]
                order = np.lexsort((value, row))
                fresh = np.ones(len(order), bool)
                fresh[1:] = (value[order][1:] != value[order][:-1]) | (row[order][1:] != row[order][:-1])
                heads = np.flatnonzero(fresh)
                n = np.diff(np.append(heads, len(order)))
                at = order[heads]
                keys = [batch[c].slice(lo, hi - lo) for c in ("doc_id", "text_key")]
                picked = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([keys[0].take(picked), keys[1].take(picked), _strings(w, out[at]), pa.array(n)], schema=schema)

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and both by token.

    Learns from rows whose crc32 of the id as text isn't 0 modulo folds (a null id counts as the empty text, and is held
    out). Words are lower-cased (A-Z); a null text counts as empty and has only its end. Rows that repeat an id are scored
    on their own texts. With no training row all counts are 0 and the network is untrained. An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    held_out = remainder(F.col("doc_id"), folds) == 0
    learn = rows.where(~held_out)

    counts = cut(learn.select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c")))
    n_docs = learn.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = most_frequent(counts)
    head = make_head(top, total.n, n_docs)
    n_all, v_all = total.n + n_docs, total.v + (n_docs > 0)
    base_log = math.log10(n_all + 0.1 * (v_all + 1))
    n_rare, v_rare = total.n - sum(n for _, n in top[: gru.VOCAB - 2]), total.v - min(len(top), gru.VOCAB - 2)
    rare_log = math.log10(n_rare + 0.1 * (v_rare + 1))

    theta = train(learn, head)
    shared = spark.sparkContext.broadcast(head)
    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    scored = keyed.mapInArrow(_score(shared, theta), "doc_id long, text_key long, n_tokens long, known long, unknown long, outside long, base_sum double, rare_sum double, net double")
    tail = keyed.mapInArrow(_tail(shared), "doc_id long, text_key long, word string, n long").join(counts, "word", "left")
    log = F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(0.1))
    parts = tail.groupBy(F.col("doc_id").alias("d2"), F.col("text_key").alias("t2")).agg(
        F.sum(F.col("n") * log).alias("tail_sum"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("tail_known"), F.sum("n").alias("tail_n")
    )
    joined = scored.join(parts, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("text_key") == F.col("t2")), "left")
    own = F.coalesce(F.col("outside") / F.col("tail_n"), F.lit(0.0))  # equal rows with one id add up alike
    tail_sum = F.coalesce(F.col("tail_sum") * own, F.lit(0.0))
    base = F.col("base_sum") + tail_sum - F.col("n_tokens") * F.lit(base_log)
    score = F.col("net") + F.col("rare_sum") + tail_sum - F.col("unknown") * F.lit(rare_log)
    return joined.select(
        "doc_id", held_out.alias("held_out"), "n_tokens",
        (F.col("known") + F.round(F.coalesce(F.col("tail_known") * own, F.lit(0.0))).cast("long")).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"),
        (base / F.col("n_tokens")).alias("base_per_token"), (score / F.col("n_tokens")).alias("score_per_token"),
    )
