"""Near-duplicate detection by min-max hashing.

Every permutation of the shingle space gives two signature values, the least and the greatest shingle under it, so a
signature of 2P values costs P hash evaluations; both kinds agree between two sets with probability equal to their
Jaccard similarity. Bands of BAND_ROWS values name candidates, and every candidate link is confirmed on the full sets.

Steps: (1) one pass over the texts gives each document the size and a 128-bit digest of its shingle set and its band
keys. (2) Documents with the same set form a class; only one row of each class goes on. (3) Each bucket of a band links its
members to hubs rather than to each other; confirmed links are joined into components. (4) Where a bucket's members are
still in different components, small buckets compare what is left pair by pair, and members of larger ones meet by rare
shingles: two sets of that similarity share one of their first n - o + 1 shingles in any common order, o being the overlap
they need, so by rising frequency they meet in short lists. No candidate link between different texts is lost, while a
bucket of many near copies costs about its size, not its square. Sets of up to TINY shingles, in which minimum and maximum
of a permutation depend on each other so that bands miss more, all meet by rare shingles.

Bands that over HOT rows share are joined apart from the others, by a broadcast of checked size, so that their rows stay
spread over tasks; the pairs of a hub are dealt to parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readprep.llm import bytetext
from readprep.llm.bytetext import U64, mix64
from readprep.llm.common import cut, pick, ship, small
from readprep.llm.graph import components
from readprep.operators.shared import release

WORDS = 5
PERCENT = 75
#: 64 permutations give 128 values; 32 bands of 4 miss a pair at similarity 0.75 with probability 5e-6.
PERMUTATIONS = 64
BAND_ROWS = 4
STAR_ROUNDS = 2
#: Members up to which a bucket that is still split compares all pairs of different components.
PAIRWISE = 8
#: Shingles up to which a set is compared by rare shingles whatever its bands say.
TINY = 20
#: Rows of a key from which on they are joined apart, and rows up to which that is by a broadcast.
HOT, APART = 500, 1_000_000
#: Ids that are broadcast to pick their sets.
ASKED = 4_000_000
_rng = np.random.Generator(np.random.PCG64(99))
_MULTIPLY = _rng.integers(0, 2**64, 256, U64) | U64(1)
_ADD = _rng.integers(0, 2**64, 256, U64)


def signatures(value: np.ndarray, first: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """2 * permutations values for each non-empty set; set r is value[first[r]:first[r + 1]]."""
    at = first[:-1][np.diff(first) > 0]
    out = np.empty((len(at), 2 * permutations), U64)
    if len(at):
        for k in range(permutations):
            moved = value * _MULTIPLY[k] + _ADD[k]
            np.minimum.reduceat(moved, at, out=out[:, 2 * k])
            np.maximum.reduceat(moved, at, out=out[:, 2 * k + 1])
    return out


def band_keys(signature: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """A 64-bit key for each band, which also names the band."""
    bands = signature.shape[1] // rows
    total = np.zeros((len(signature), bands), U64)
    for i in range(rows):
        total = mix64(total + signature[:, i : bands * rows : rows]) + U64(i + 1)
    return mix64(total + np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _digests(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit digests of each set (values are sorted, but sums need no order); 0 for an empty one."""
    n = np.diff(first)
    out = []
    for seed in (U64(0x1234567), U64(0xABCDEF0123)):
        sums = np.zeros(len(value) + 1, U64)
        np.cumsum(mix64(value ^ seed) * (value | U64(1)), out=sums[1:])
        out.append(np.where(n > 0, mix64(sums[first[1:]] - sums[first[:-1]] + n.astype(U64)), U64(0)))
    return out[0], out[1]


def _sketch(words: int, permutations: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytetext.regroup(batches):
            for lo, hi in bytetext.row_slices(batch["text"]):
                value, first = bytetext.shingle_sets(bytetext.words(batch["text"].slice(lo, hi - lo), lower=True), words)
                n = np.diff(first)
                a, b = _digests(value, first)
                keys = band_keys(signatures(value, first, permutations), rows)
                offsets = np.concatenate([[0], np.cumsum(n > 0)]) * keys.shape[1]
                bands = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), bands], schema=schema)

    return run


def _sets(words: int):
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytetext.regroup(batches):
            for lo, hi in bytetext.row_slices(batch["text"]):
                value, first = bytetext.shingle_sets(bytetext.words(batch["text"].slice(lo, hi - lo), lower=True), words)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), lists], schema=schema)

    return run


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) whose full sets have at least that similarity; an id with several sets links by any of them."""
    both = F.size(F.array_intersect("set_u", "set_v"))
    near = 100 * both >= percent * (F.size("set_u") + F.size("set_v") - both)
    named = pairs
    for side, other in ("uv", "vu"):  # a hub has many pairs: they are dealt, HOT to a part, and each part gets its set
        hot = cut(named.groupBy(side).count().where(F.col("count") > HOT).select(F.col(side).alias("hub"), F.ceil(F.col("count") / HOT).alias("parts")))
        n = hot.count()
        parts = F.coalesce("parts", F.lit(1))
        dealt = _of(sets, named.select(F.col(side).alias("id"))).join(small(hot, n), F.col("id") == F.col("hub"), "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        pairs = pairs.join(small(hot, n), F.col(side) == F.col("hub"), "left").withColumn("part", F.pmod(F.xxhash64(other), parts)).drop("hub", "parts")
        pairs = pairs.join(dealt.select(F.col("id").alias(side), "part", F.col("shingles").alias(f"set_{side}")), [side, "part"]).drop("part")
    return pairs.where(near).select("u", "v").distinct()


def _of(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets of those ids, picked before a shuffle, since sets are large; all sets if there are too many ids for a broadcast."""
    asked = cut(ids.distinct())
    return sets.join(F.broadcast(asked), "id", "left_semi") if asked.count() <= ASKED else sets


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, permutations: int = PERMUTATIONS, rows: int = BAND_ROWS, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and cut into words; a row's set are its distinct shingles of so many words, or its whole
    sequence if it has fewer. Rows without words, null texts included, have an empty set and link with nothing. Rows with
    the same id are one document: they share its links. A row whose id is null links with nothing, has component_id null
    and is kept. component_id is the smallest id reachable over links, kept says that it is the row's own; copies and ties
    need no further rule. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    rows_in = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    sketch = cut(rows_in.mapInArrow(_sketch(words, permutations, rows), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"))
    usable = sketch.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = cut(usable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("last"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))

    filed = classes.select("id", "n", F.explode("bands").alias("band"))
    shared = cut(filed.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("bucket")).where("lo < hi").select("band", "bucket"))
    hot = Hot(shared, "band", F.col("bucket") > HOT)
    members = cut(hot.join(filed, shared))
    # the member that shares the most buckets with the most others is nearest to a common origin
    central = members.groupBy("id").agg(F.sum("bucket").alias("degree"))
    ranked = members.join(central, "id")
    hubs = cut(ranked.groupBy("band").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("hub")))
    tiny = cut(classes.where(F.col("n") <= TINY).select("id"))
    wanted = cut(members.select("id").union(tiny).distinct())
    n_wanted = wanted.count()
    texts = rows_in.join(small(wanted.withColumnRenamed("id", "doc_id"), n_wanted, ASKED), "doc_id", "left_semi")
    sets = cut(texts.mapInArrow(_sets(words), "id long, shingles array<long>").distinct() if _repeats(classes) else texts.mapInArrow(_sets(words), "id long, shingles array<long>"))

    pairs = cut(hot.join(members, hubs).where(F.col("id") != F.col("hub")).select(F.least("id", "hub").alias("u"), F.greatest("id", "hub").alias("v")).distinct())
    tried, links = pairs, cut(confirm(pairs, sets, percent).union(_one_document(usable, classes)))
    groups = cut(components(links))
    for step in range(star_rounds):
        release(spark)
        known = members.join(groups, F.col("id") == F.col("node"), "left").select("band", "id", "n", "bucket", F.coalesce("component", "id").alias("component"))
        split = known.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by(F.struct("id", "component", "n"), F.xxhash64("id", F.lit(step + 17))).alias("hub")).where("lo < hi")
        left = cut(hot.join(known, cut(split.select("band", "hub"))))
        if step < star_rounds - 1:
            found = left.where((F.col("component") != F.col("hub.component")) & _sizes_fit(F.col("n"), F.col("hub.n"), percent)).select(F.least("id", "hub.id").alias("u"), F.greatest("id", "hub.id").alias("v"))
        else:
            few = left.where(F.col("bucket") <= PAIRWISE)
            found = _across(few.select(F.col("band").alias("key"), "id", "component", "n"), _sizes_fit(F.col("n_u"), F.col("n_v"), percent))
            alone = tiny.join(groups, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))
            many = left.where(F.col("bucket") > PAIRWISE).select("id", "component").union(alone).distinct()
            found = found.union(_rare_pairs(many, sets, percent))
        pairs = cut(found.distinct().join(tried, ["u", "v"], "left_anti"))
        if pairs.isEmpty():
            continue
        tried = tried.union(pairs)
        fresh = cut(confirm(pairs, sets, percent))
        if not fresh.isEmpty():
            links = links.union(fresh)
            groups = cut(components(links))

    merged = cut(classes.where(F.col("last") > F.col("id")).select("set_a", "set_b", F.col("id").alias("rep")))
    linked = groups.select(F.col("node").alias("rep"), "component")
    found = sketch.drop("bands").join(small(merged, merged.count()), ["set_a", "set_b"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    full = found.join(small(linked, groups.count()), "rep", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return full.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


class Hot:
    """The keys of a counted table that many rows share. Their rows meet them by a broadcast, all others by a shuffle.

    If there are too many hot keys for a broadcast, all rows are shuffled, and adaptive execution splits the large ones.
    """

    def __init__(self, keys: DataFrame, key: str, hot):
        self.key, self.table = key, cut(keys.where(hot).select(key))
        self.apart = 0 < self.table.count() <= APART

    def of(self, rows: DataFrame) -> DataFrame:
        """The rows of hot keys."""
        return rows.join(F.broadcast(self.table), self.key, "left_semi")

    def join(self, rows: DataFrame, by_key: DataFrame) -> DataFrame:
        """rows joined with by_key, whose rows of hot keys are broadcast if they are no more than APART."""
        if self.apart:
            few = cut(self.of(by_key))
            if few.count() <= APART:
                rest = rows.join(F.broadcast(self.table), self.key, "left_anti")
                return rest.join(by_key, self.key).unionByName(rows.join(F.broadcast(few), self.key))
        return rows.join(by_key, self.key)


def _across(members: DataFrame, fit) -> DataFrame:
    """(u, v) of different components under the same key, for keys that several components share."""
    mixed = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    rows = cut(members.join(mixed, "key", "left_semi"))
    a, b = (rows.select("key", *(F.col(c).alias(f"{c}_{side}") for c in rows.columns if c != "key")) for side in "uv")
    return a.join(b, "key").where((F.col("component_u") != F.col("component_v")) & (F.col("id_u") < F.col("id_v")) & fit).select(F.col("id_u").alias("u"), F.col("id_v").alias("v"))


def _one_document(usable: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) between the classes that hold rows of one id."""
    repeated = cut(usable.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    rows = usable.select("doc_id", "set_a", "set_b").join(small(repeated, repeated.count()), "doc_id")
    held = rows.join(classes.select("set_a", "set_b", "id"), ["set_a", "set_b"]).select("doc_id", "id").distinct()
    least = held.groupBy("doc_id").agg(F.min("id").alias("u"))
    return held.join(least, "doc_id").where(F.col("id") != F.col("u")).select("u", F.col("id").alias("v"))


def _rare_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components among members (id, component) that can reach the similarity, found by rare shingles."""
    members = cut(members)
    shingles = members.join(_of(sets, members.select("id")), "id").select("id", F.xxhash64("shingles").alias("set"), "component", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("g"))
    often = shingles.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    by_rarity = Window.partitionBy("id", "set").orderBy(F.coalesce("df", F.lit(1)), "g")
    placed = shingles.join(often, "g", "left").withColumn("place", F.row_number().over(by_rarity)).where((100 - percent) * F.col("n") >= 100 * (F.col("place") - 1))
    listed = cut(placed.where("df > 1").select(F.col("g").alias("key"), "id", "component", "n", "place"))
    # 100 * o >= percent * (n_u + n_v - o), and a place beyond n - o + 1 can't be the first in common
    need = F.ceil(percent * (F.col("n_u") + F.col("n_v")) / F.lit(100.0 + percent) - 1e-9)
    return _across(listed, (F.col("place_u") <= F.col("n_u") - need + 1) & (F.col("place_v") <= F.col("n_v") - need + 1))


def _sizes_fit(a, b, percent: int):
    """Sets whose sizes differ by more than this can't reach the similarity."""
    return (100 * a >= percent * b) & (100 * b >= percent * a)


def _repeats(classes: DataFrame) -> bool:
    """Whether an id has several sets, so that repeated rows may repeat a set."""
    return not classes.groupBy("id").count().where("count > 1").isEmpty()
