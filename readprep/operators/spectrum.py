"""The k-mer spectrum: canonical counts, the trusted floor, the counting Bloom filter, and support of positions.

Tables hold k-mers as two bits a base (kmer BIGINT), 3 <= k <= 31. Counting makes the codes of a whole Arrow batch of reads
at once, counts them there, and shuffles two longs for each distinct k-mer of a batch or task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readprep.functions import is_dna
from readprep.functions.packed import aligned, backward_codes, characters, forward_codes, places, window_starts
from readprep.operators import keyed
from readprep.operators.profile import walked
from readprep.operators.shared import cut, release

#: Fixed values of the slot hash.
SEED, MULTIPLY_1, MULTIPLY_2, SHIFT = 0x517CC1B727220A95, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 31
FALSE_POSITIVES = 0.01
CEILING = 15


def checked(k: int) -> int:
    k = max(k, 3)
    if k > 31:
        raise ValueError("k is at most 31: a code has two bits a base in 64")
    return k


def windows(reads: DataFrame, k: int, min_quality: int = 0) -> DataFrame:
    """(read_ix, start from 0, kmer string) of windows without unknown bases whose qualities all reach the minimum."""
    k = checked(k)
    rows = reads.where((F.length("sequence") >= k) & (F.length("qualities") >= k))
    # a window fails on a character under the limit; the class is that of the characters from the limit on
    exploded = rows.select("read_ix", "sequence", "qualities", F.explode(F.expr(f"sequence(0, least(length(sequence), length(qualities)) - {k})")).alias("start"))
    cut = exploded.select("read_ix", "start", F.substring("sequence", F.col("start") + 1, F.lit(k)).alias("kmer"), F.substring("qualities", F.col("start") + 1, F.lit(k)).alias("q"))
    good = cut.where(is_dna(F.col("kmer")))
    if min_quality > 0:
        good = good.where(~F.col("q").rlike("[\\x{0}-\\x{%x}]" % (32 + min_quality)))
    return good.select("read_ix", "start", "kmer")


#: Two bits of each base; all else is unknown.
_BASE = np.full(256, 4, np.uint8)
_BASE[[65, 67, 71, 84]] = [0, 1, 2, 3]


def canonical_windows(sequences: pa.Array, qualities: pa.Array, k: int, min_quality: int) -> np.ndarray:
    """Canonical codes of all windows of some reads without unknown bases whose qualities all reach the minimum."""
    (letters, ends), (marks, q_ends) = characters(sequences), characters(qualities)
    bases = _BASE[np.minimum(letters, 255)]
    quality = aligned(marks, q_ends, ends)  # 0, and so too low, where a read has no quality
    start = window_starts((bases > 3) | (quality < max(33 + min_quality, 1) if min_quality > 0 else quality == 0), ends, k)
    known = bases & 3
    return np.minimum(forward_codes(known, k)[start], backward_codes(known, k)[start])


def _count(k: int, min_quality: int):
    schema = pa.schema([("kmer", pa.int64()), ("cnt", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kmer, n = np.unique(canonical_windows(batch["sequence"], batch["qualities"], k, min_quality), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kmer, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    return run


def kmer_counts(reads: DataFrame, k: int, min_quality: int = 0) -> DataFrame:
    """(kmer, cnt): canonical k-mers of windows() by code."""
    k, rows = checked(k), reads.select("sequence", "qualities")
    if reads.isStreaming:
        return rows.mapInArrow(_count(k, min_quality), "kmer long, cnt long").groupBy("kmer").agg(F.sum("cnt").alias("cnt"))
    packed, bits = _packed(rows, k, min_quality)
    return keyed.summed(packed, 2 * k, bits, "kmer", "cnt")


def _packed(reads: DataFrame, k: int, min_quality: int) -> tuple[DataFrame, int]:
    bits = keyed.bucket_bits(reads.sparkSession, 2 * k)
    found = keyed.packing(lambda b: (canonical_windows(b["sequence"], b["qualities"], k, min_quality), None), 2 * k, bits)
    return reads.select("sequence", "qualities").mapInArrow(found, keyed.PACKED), bits


def kept_counts(reads: DataFrame, k: int, min_quality: int = 0) -> tuple[DataFrame, DataFrame]:
    """kmer_counts() for several passes, and what is persisted for them: packed rows instead of two longs a k-mer."""
    k = checked(k)
    packed, bits = _packed(reads, k, min_quality)
    kept = keyed.merged(packed, 2 * k, bits).persist()
    return keyed.rows_of(kept, 2 * k, bits, "kmer", "cnt"), kept


def summary(reads: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """records (reads of at least k bases), unique_kmers, median_count; counts are read once, as a histogram."""
    records = reads.where((F.length("sequence") >= checked(k)) & (F.length("qualities") >= checked(k))).agg(F.count("*").alias("records"))
    both = walked(counts, "cnt").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("unique_kmers"), F.min(F.when(F.col("upper"), F.col("v"))).alias("median_count"))
    return records.crossJoin(F.broadcast(both))


def trusted_floor(row: DataFrame, fallback: int, sample: int) -> DataFrame:
    """`floor` for a summary row: the fallback, raised with the root of how many times more reads than the sample there are.

    Never above a third of the median count (or the fallback, if that is more), never below the fallback.
    """
    scaled = F.ceil(F.lit(fallback) * F.sqrt(F.try_divide(F.col("records"), F.lit(max(sample, 1)))))
    cap = F.greatest(F.floor(F.coalesce("median_count", F.lit(0)) / 3), F.lit(fallback))
    raised = F.greatest(F.least(scaled, cap), F.lit(fallback))
    return row.select("records", "unique_kmers", "median_count", F.when((F.col("unique_kmers") == 0) | (F.col("records") <= sample), F.lit(fallback)).otherwise(raised).cast("long").alias("floor"))


def trusted(counts: DataFrame, floor: int) -> DataFrame:
    return counts.where(F.col("cnt") >= floor).orderBy("kmer")


def bloom_size(unique: Column) -> tuple[Column, Column]:
    """(slots, hashes) of a filter for so many keys."""
    n = F.greatest(unique, F.lit(1)).cast("double")
    slots = F.greatest(F.ceil(-n * F.log(F.lit(FALSE_POSITIVES)) / (F.log(F.lit(2.0)) * F.log(F.lit(2.0)))), F.lit(1))
    return slots, F.greatest(F.least(F.ceil(slots / n * F.log(F.lit(2.0))), F.lit(32)), F.lit(1)).cast("int")


def _times(df: DataFrame, constant: int) -> DataFrame:
    """h times a constant modulo 2**64, in steps of which none overflows (so no setting of ANSI mode matters).

    Each step is a projection of its own: its values are used several times, and are computed once.
    """
    mask, low, high = F.lit(0xFFFFFFFF), constant & 0xFFFFFFFF, constant >> 32
    rest = [c for c in df.columns if c != "h"]

    def part(x: str, c: int) -> Column:  # the low 32 bits of x * c, from 16-bit pieces of c
        return (F.col(x) * F.lit(c & 0xFFFF) + F.shiftleft((F.col(x) * F.lit(c >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(mask)

    halves = df.select(*rest, F.col("h").bitwiseAND(mask).alias("a0"), F.shiftrightunsigned("h", 32).alias("a1"))
    products = halves.select(*rest, "a0", "a1", (F.col("a0") * F.lit(low & 0xFFFF)).alias("p0"), (F.col("a0") * F.lit(low >> 16)).alias("p1"))
    lower = products.select(*rest, "a0", "a1", "p1", (F.col("p0") + F.shiftleft(F.col("p1").bitwiseAND(F.lit(0xFFFF)), 16)).alias("lo"))
    upper = (F.shiftrightunsigned("lo", 32) + F.shiftrightunsigned("p1", 16) + part("a0", high) + part("a1", low)).bitwiseAND(mask)
    return lower.select(*rest, F.shiftleft(upper, 32).bitwiseOR(F.col("lo").bitwiseAND(mask)).alias("h"))


def _folded(df: DataFrame) -> DataFrame:
    return df.withColumn("h", F.col("h").bitwiseXOR(F.shiftrightunsigned("h", SHIFT)))


def _signed(x: int) -> int:
    x %= 2**64
    return x - 2**64 if x >= 2**63 else x


def _hashed(keys: DataFrame, size: DataFrame) -> DataFrame:
    """keys with a row for each hash: its slot from 0."""
    spread = keys.crossJoin(F.broadcast(size)).withColumn("hash", F.explode(F.expr("sequence(0, hashes - 1)")))
    seeds = F.array(*(F.lit(_signed(i * SEED)) for i in range(32)))
    h = spread.withColumn("h", F.col("kmer").bitwiseXOR(F.get(seeds, F.col("hash"))))
    h = _folded(_times(_folded(_times(h, MULTIPLY_1)), MULTIPLY_2))
    unsigned = F.pmod(F.pmod(F.shiftrightunsigned("h", 1), F.col("slots")) * 2 + F.col("h").bitwiseAND(F.lit(1)), F.col("slots"))
    return h.withColumn("slot", unsigned).drop("h")


def bloom_shape(counts: DataFrame) -> DataFrame:
    """One row: slots, hashes."""
    return bloom_shape_of(counts.agg(F.count("*").alias("n")))


def bloom_shape_of(number: DataFrame) -> DataFrame:
    """The same for a row with the number of keys, n."""
    slots, hashes = bloom_size(F.col("n"))
    return number.select(slots.cast("long").alias("slots"), hashes.alias("hashes"))


def bloom(counts: DataFrame) -> DataFrame:
    """(slot, cnt): counters up to 15. A key adds its count, 255 at most, to each of its slots; order doesn't matter."""
    return _hashed(counts, bloom_shape(counts)).groupBy("slot").agg(F.least(F.sum(F.least("cnt", F.lit(255))), F.lit(CEILING)).alias("cnt"))


def slots_of(keys: np.ndarray, hash_: int, slots: int) -> np.ndarray:
    """The slots of keys (unsigned) under one of the hashes."""
    h = (keys ^ np.uint64(hash_ * SEED % 2**64)) * np.uint64(MULTIPLY_1)
    h ^= h >> np.uint64(SHIFT)
    h = h * np.uint64(MULTIPLY_2)
    h ^= h >> np.uint64(SHIFT)
    return (h % np.uint64(slots)).astype(np.int64)


def add_to_counters(counters: np.ndarray, keys: np.ndarray, counts: np.ndarray, hashes: int) -> None:
    """Adds keys to the filter of bloom() as one array of bytes, whose counters are 15 at most before and after.

    A byte would overflow only if 17 of 65536 keys met in one of the slots, ten for each key, under one hash.
    """
    raw, each = keys.astype(np.uint64), np.minimum(counts, CEILING).astype(np.uint8)
    for lo in range(0, len(raw), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        for i in range(hashes):
            slot = slots_of(raw[part], i, len(counters))
            np.add.at(counters, slot, each[part])
            counters[slot] = np.minimum(counters[slot], CEILING)


def bloom_lookup(keys: DataFrame, filter_: DataFrame, shape: DataFrame) -> DataFrame:
    """(kmer, estimate): the least counter among a key's slots."""
    hashed = _hashed(keys.select("kmer"), shape).join(filter_, "slot", "left")
    return hashed.groupBy("kmer").agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))


def hybrid_lookup(keys: DataFrame, trusted_: DataFrame, filter_: DataFrame, shape: DataFrame) -> DataFrame:
    """(kmer, support): the exact count of a trusted k-mer, else the filter's estimate, else 0."""
    exact = keys.select("kmer").join(trusted_.select("kmer", "cnt"), "kmer", "left")
    return exact.join(bloom_lookup(keys, filter_, shape), "kmer", "left").select("kmer", F.coalesce("cnt", "estimate", F.lit(0)).cast("long").alias("support"))


#: K-mers from which on slots are shuffled in shares, one after another: one more for each so many, up to so many shares.
ROUND, ROUNDS = 1 << 24, 8
_SLOTS, _LEVELS = "block int, bucket int, keys binary, n binary", "block int, bucket int, levels binary"
_ZSTD = pa.Codec("zstd")


def _zipped(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _unzipped(raw: bytes) -> bytes:
    return _ZSTD.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)


def supports(reads: DataFrame, k: int, min_quality: int, floor: int) -> DataFrame:
    """(kmer, support) of all k-mers: hybrid_lookup() of the counts of kmer_counts() in themselves and their filter.

    A block of k-mers sends the distinct slots of all its keys as sorted gaps, with what it adds to each; the part of the
    filter that has them sends back their counters, in that order and four bits each. Many k-mers do so for one range of
    slots after another, so that no more than a share of the slots is on disk at once.
    """
    spark, width = reads.sparkSession, 2 * checked(k)
    bits = keyed.bucket_bits(spark, width)
    found = keyed.packing(lambda b: (canonical_windows(b["sequence"], b["qualities"], k, min_quality), None), width, bits)
    packed = reads.select("sequence", "qualities").mapInArrow(found, keyed.PACKED)
    blocks = cut(packed.groupBy("bucket").applyInArrow(lambda rows: _one_row(rows, width, bits), "block int, m long, keys binary, n binary"))
    release(spark)
    shape = bloom_shape_of(blocks.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"))).first()
    many, slots, hashes = blocks.agg(F.sum("m")).first()[0] or 0, shape.slots, shape.hashes
    rounds, wide = min(ROUNDS, 1 + many // ROUND), max(slots - 1, 1).bit_length()
    fine = min(bits + (rounds - 1).bit_length(), 14, wide)
    edges_ = [-(-(i * slots // rounds) >> wide - fine) << wide - fine for i in range(rounds)] + [1 << wide]  # ranges of whole buckets

    def keys_of(block: int, raw: bytes) -> np.ndarray:
        return keyed.unmixed(keyed.joined(block, _unzipped(raw), width, bits), width)

    def ask(lo: int, hi: int):
        schema = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, raw, raw_n in (r for b in batches for r in zip(*(b[c].to_pylist() for c in ("block", "keys", "n")), strict=True)):
                keys, n = keys_of(block, raw).astype(np.uint64), np.minimum(keyed.unsqueeze(_unzipped(raw_n)), CEILING).astype(np.int64)
                slot, add = [], []
                for i in range(hashes):
                    s = slots_of(keys, i, slots)
                    own = np.flatnonzero((s >= lo) & (s < hi))
                    slot.append(s[own])
                    add.append(n[own])
                slot, add = keyed.added(np.concatenate(slot).astype(np.uint64), np.concatenate(add))
                bucket, at, gaps = keyed.split(slot, wide, fine)
                each = np.minimum(add, CEILING).astype(np.uint8)  # a counter that is full stays so
                pairs = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), block, np.int32)), pa.array(bucket), pa.array([_zipped(g) for g in gaps.to_pylist()], pa.binary()), pa.array([_zipped(each[a:b].tobytes()) for a, b in pairs], pa.binary())], schema=schema)

        return run

    def answer(rows: pa.Table) -> pa.Table:
        bucket = rows["bucket"][0].as_py()
        base, held = bucket << wide - fine, []
        counters = np.zeros(1 << wide - fine, np.uint8)
        for raw, n in zip(rows["keys"].to_pylist(), rows["n"].to_pylist(), strict=True):
            at = keyed.joined(bucket, _unzipped(raw), wide, fine).astype(np.int64) - base
            held.append(at.astype(np.uint32))
            counters[at] = np.minimum(counters[at] + np.frombuffer(_unzipped(n), np.uint8), CEILING)  # slots of a row are distinct
        levels = []
        for at in held:
            c = np.append(counters[at], np.uint8(0)) if len(at) % 2 else counters[at]
            levels.append(_zipped((c[0::2] | c[1::2] << 4).tobytes()))
        return pa.table({"block": rows["block"], "bucket": rows["bucket"], "levels": pa.array(levels, pa.binary())})

    def least(rows: pa.Table, told: pa.Table) -> pa.Table:
        block = rows["block"][0].as_py()
        keys, n = keys_of(block, rows["keys"][0].as_py()), keyed.unsqueeze(_unzipped(rows["n"][0].as_py())).astype(np.int64)
        raw = keys.astype(np.uint64)
        slot, of = np.unique(np.concatenate([slots_of(raw, i, slots) for i in range(hashes)]), return_inverse=True)
        bucket, at, _ = keyed.split(slot.astype(np.uint64), wide, fine)
        levels, place = np.empty(len(slot), np.uint8), {b: i for i, b in enumerate(bucket.tolist())}
        for b, both in zip(told["bucket"].to_pylist(), told["levels"].to_pylist(), strict=True):
            lo, hi = at[place[b]], at[place[b] + 1]
            two = np.frombuffer(_unzipped(both), np.uint8)
            levels[lo:hi] = np.stack([two & 15, two >> 4], 1).reshape(-1)[: hi - lo]
        estimate = levels[of].reshape(hashes, len(keys)).min(0)
        return pa.table({"kmer": pa.array(keys), "support": pa.array(np.where(n >= floor, n, estimate.astype(np.int64)))})

    told = None
    for lo, hi in zip(edges_, edges_[1:], strict=False):
        part = cut(blocks.mapInArrow(ask(lo, hi), _SLOTS).groupBy("bucket").applyInArrow(answer, _LEVELS))
        told = part if told is None else told.union(part)
        release(spark)
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(least, "kmer long, support long")


def _one_row(rows: pa.Table, width: int, bits: int) -> pa.Table:
    """All of a bucket's packed rows as one, compressed."""
    bucket = rows["bucket"][0].as_py()
    keys, n = keyed._merged(rows, width, bits)
    gaps = keyed.split(keys, width, bits)[2][0].as_py()
    return pa.table({"block": pa.array([bucket], pa.int32()), "m": pa.array([len(keys)], pa.int64()), "keys": pa.array([_zipped(gaps)], pa.binary()), "n": pa.array([_zipped(keyed.squeeze(n)[0].tobytes())], pa.binary())})


#: Blocks of reads for each partition of a shuffle, and reads that a task holds before it files them.
BLOCKS, HELD = 2, 100_000
_READ = ["read_ix", "sequence", "qualities"]


def in_blocks(reads: DataFrame, k: int) -> DataFrame:
    """(block, reads): the reads that have a window, as compressed Arrow tables; a block is named by a hash of read_ix."""
    n = BLOCKS * int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("block", pa.int64()), ("reads", pa.binary())])

    def filed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        rows = rows.filter(pc.greater_equal(pc.utf8_length(rows["sequence"]), k))
        block = (keyed.mixed(rows["read_ix"].to_numpy(), 64) >> np.uint64(33)).astype(np.int64) % n
        order = np.argsort(block, kind="stable")
        rows, block = rows.take(order).combine_chunks(), block[order]
        names, first = np.unique(block, return_index=True)
        raw = []
        for lo, hi in zip(first.tolist(), [*first.tolist()[1:], len(block)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows.slice(lo, hi - lo))
            raw.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(raw, pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= HELD:
                yield filed(held)
                held, size = [], 0
        if size:
            yield filed(held)

    return reads.select(*_READ).mapInArrow(run, "block long, reads binary")


def of_block(rows: pa.Table) -> pa.Table:
    """The reads of a block's rows of in_blocks()."""
    return pa.concat_tables([pa.ipc.open_stream(raw).read_all() for raw in rows["reads"].to_pylist()]).combine_chunks()


class Windows:
    """All windows of k bases of some reads, and their canonical codes, -1 for those with an unknown base."""

    def __init__(self, sequences: pa.Array, k: int):
        letters, self.ends = characters(sequences)
        self.k, self.bases = k, _BASE[np.minimum(letters, 255)]
        self.start = window_starts(np.zeros(len(letters), bool), self.ends, k)
        known = self.bases & 3
        self.codes = np.minimum(forward_codes(known, k)[self.start], backward_codes(known, k)[self.start]) if len(self.start) else np.zeros(0, np.int64)
        odd = np.concatenate([[0], np.cumsum(self.bases > 3)])
        self.codes[odd[self.start + k] > odd[self.start]] = -1

    def support(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(least, total, windows) over the windows that cover each base."""
        n, k = len(self.bases), self.k
        huge = np.iinfo(np.int64).max
        series, there = np.full(n + k - 1, huge), np.zeros(n + k - 1, np.int64)
        series[self.start + k - 1], there[self.start + k - 1] = counts, 1
        least, total, windows = np.full(n, huge), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for j in range(k):  # no window starts in the last k - 1 bases of a read, so none of another read is taken
            part, own = series[j : j + n], there[j : j + n]
            np.minimum(least, part, out=least)
            total += np.where(own > 0, part, 0)
            windows += own
        return least, total, windows


def window_answers(blocks: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """(block, bucket, n): the counts of the windows of each block's reads, to be read by keyed.told()."""
    bits = keyed.bucket_bits(blocks.sparkSession, 2 * k)

    def ask(rows: pa.Table) -> pa.Table:
        return keyed.asked(rows["block"][0].as_py(), Windows(of_block(rows)["sequence"], k).codes, 2 * k, bits)

    wanted = blocks.groupBy("block").applyInArrow(ask, keyed.ASKED)
    return keyed.answers(wanted, keyed.table(counts, "kmer", "cnt", 2 * k, bits), 2 * k, bits)


_SUPPORT = ["read_ix", "pos", "phred", "least", "total", "windows"]


def _supported(reads: DataFrame, counts: DataFrame, k: int, wanted: list[str], chosen=None) -> DataFrame:
    """The wanted columns of all positions, or of those that chosen(phred, least) says."""
    k = checked(k)
    blocks = in_blocks(reads, k)
    schema = pa.schema([(c, pa.int64()) for c in wanted])

    def run(rows: pa.Table, answered: pa.Table) -> pa.Table:
        rows = of_block(rows)
        w = Windows(rows["sequence"], k)
        least, total, windows = w.support(keyed.told(w.codes, answered, 2 * k))
        phred = np.maximum(aligned(*characters(rows["qualities"]), w.ends).astype(np.int64)[: len(least)] - 33, 0)
        at = np.flatnonzero(chosen(phred, least)) if chosen else slice(None)
        made = {"read_ix": np.repeat(rows["read_ix"].to_numpy(), np.diff(w.ends)), "pos": places(w.ends), "phred": phred, "least": least, "total": total, "windows": windows}
        return pa.Table.from_arrays([pa.array(made[c][at]) for c in wanted], schema=schema)

    answered = window_answers(blocks, counts, k)
    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, ", ".join(f"{c} long" for c in wanted))


def position_support(reads: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """(read_ix, pos from 0, least, total, windows): counts over the windows that cover a base; unknown k-mers count 0.

    Blocks of reads ask for the counts of their distinct windows and get them back packed; positions never are shuffled.
    """
    return _supported(reads, counts, k, [c for c in _SUPPORT if c != "phred"])


def attention(reads: DataFrame, counts: DataFrame, k: int, min_quality: int, floor: int) -> DataFrame:
    """(read_ix, pos, phred, least, total, windows) of the positions that correction looks at; see trim.attention()."""
    return _supported(reads, counts, k, _SUPPORT, lambda phred, least: (phred < min_quality) | ((phred <= min_quality + 5) & (least < floor)))


def edges(counts: DataFrame, k: int, floor: int) -> DataFrame:
    """De Bruijn edges (src, dst, label, cnt) of the trusted canonical k-mers: from the first k - 1 bases to the last."""
    mask = (1 << 2 * (checked(k) - 1)) - 1
    kept = counts.where(F.col("cnt") >= floor)
    return kept.select(F.shiftright("kmer", 2).alias("src"), F.col("kmer").bitwiseAND(F.lit(mask)).alias("dst"), F.col("kmer").bitwiseAND(F.lit(3)).alias("label"), "cnt")


def graph_size(edges_: DataFrame) -> DataFrame:
    """nodes, edges."""
    nodes = edges_.select(F.col("src").alias("node")).union(edges_.select("dst")).distinct().agg(F.count("*").alias("nodes"))
    return nodes.crossJoin(edges_.agg(F.count("*").alias("edges")))


def top_edges(edges_: DataFrame, branches: int) -> DataFrame:
    """The strongest out-edges of each node; at most four leave one."""
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("cnt"), "label"))
    return edges_.withColumn("place", place).where(F.col("place") <= branches)


def two_hops(edges_: DataFrame) -> DataFrame:
    """(src, via, dst, least): paths of two edges and their weaker count."""
    a, b = edges_.select("src", F.col("dst").alias("via"), F.col("cnt").alias("c1")), edges_.select(F.col("src").alias("via"), "dst", F.col("cnt").alias("c2"))
    return a.join(b, "via").select("src", "via", "dst", F.least("c1", "c2").alias("least"))
