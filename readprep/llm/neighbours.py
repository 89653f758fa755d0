"""Approximate nearest neighbours by inner product: NN-descent builds neighbour graphs, queries walk them greedily.

Equal vectors form one node, so a vector that a large part of the table repeats is one node with its smallest ids as
members, and queries with equal vectors walk once. Nodes are dealt by a hash into shards of bounded size, each a task of
its own with a graph of its own (`descent.py`); a query walks every shard, and the best of all shards are its answer. So
recall doesn't fall as shards are added, and no task's memory grows with the table.

Build: leaves of random halvings give first neighbours; then, in rounds, every node joins its neighbours and its reverse
neighbours (of them a sample of REVERSE), and tells each of them of nearer ones among the others, as long as an edge is new.

Search: a walk starts at the query's own node and at the best of the entry nodes, which are the longest of every band of
length and those that no list names. A round expands the EXPAND best nodes of its beam that it hasn't expanded, scores their neighbours, and keeps the
BEAM best, until none of these is left to expand; the beam is then scored on the original vectors in double precision. A
query left with too few rows is compared with all nodes. A sample of queries is checked against exact search by blocks; the
beam widens until it reaches RECALL, and where it would hold a large part of the shards, exact search answers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readprep.llm import bytetext
from readprep.llm.common import cut, pick, ship, small
from readprep.llm.descent import LEAF, NEIGHBOURS, REVERSE, descend, reverse, walk
from readprep.operators.shared import release

#: Nodes of a shard at most, fewer if their vectors take over so many bytes. Shards are of like size, and of FEW nodes or
#: more; their number grows with the root of the nodes until they are full.
SHARD, SHARD_BYTES, FEW = 65536, 64 << 20, 4096
#: Recall that a sample of so many queries has to reach against exact search. The beam grows by half until it does; from a
#: width of 1/READ of a shard's nodes on, exact search answers all queries.
RECALL, CHECKED, READ = 0.95, 200, 16
BEAM, EXPAND = 128, 8
#: Bytes up to which answers are broadcast to the queries that share them, and bytes of a block of query vectors.
SHARED, BLOCK = 8 << 20, 32 << 20
#: Entry nodes of a band of length (at least; the square root of the nodes counts beyond), a band's share of an octave, the
#: number of bands, of which the last holds all shorter vectors, and the best entries at which a walk starts.
ENTRIES, BANDS_OCTAVE, BANDS, STARTS = 256, 2, 16, 16
#: Queries and vectors that are compared at once by blocks.
SLICE = 512, 4096


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part, one for each id."""
    picked = pick(rows, vec_id=id_col, vector=vector_col).where("vec_id is not null and vector is not null").withColumn("vec_id", F.col("vec_id").cast("long"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = picked.where(finite & F.exists("vector", lambda x: x != 0))
    sizes = sound.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return sound.where(F.size("vector") == (sizes.d if sizes else 0)).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def nodes(vectors: DataFrame, members: int) -> DataFrame:
    """(id, vector, members): equal vectors as one node under their smallest id, with so many of the smallest ids."""
    salted = vectors.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for keys in (["vector", "salt"], ["vector"]):
        salted = salted.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("place") <= members)
    return salted.groupBy("vector").agg(F.min("vec_id").alias("id"), F.array_sort(F.collect_list("vec_id")).alias("members")).select("id", "vector", "members")


def _encode(longest: float):
    """Codes of the vectors as shares of the greatest length, each with a scale of its own."""
    schema = pa.schema([("id", pa.int64()), ("code", pa.binary()), ("scale", pa.float32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytetext.regroup(batches):
            if not batch.num_rows:
                continue
            x = matrix(batch["vector"]).astype(np.float64) / longest
            scale = np.abs(x).max(1) / 127
            code = np.round(x / scale[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale.astype(np.float32))], schema=schema)

    return run


def _decode(codes: list[bytes], scales: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.int8).reshape(len(codes), -1).astype(np.float32) * scales[:, None]


_EDGES = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("sim", pa.float32())])


def _dealt(rows: DataFrame, n: int, width: int) -> DataFrame:
    """n rows (id, ..) with a column shard, each shard in a partition of its own."""
    most = min(SHARD, max(FEW, SHARD_BYTES // (4 * max(width, 1))))
    shards = max(1, math.ceil(n / most), math.ceil(math.sqrt(n / FEW)))
    keys = _keys(rows.sparkSession, shards)
    at = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    return rows.withColumn("shard", F.element_at(F.array(*map(F.lit, keys)), at + 1)).repartition(shards, "shard")


def _keys(spark: SparkSession, n: int) -> list[int]:
    """n integers that repartition(n) deals to n different partitions."""
    found: dict[int, int] = {}
    size = 16 * n
    while len(found) < n:
        rows = spark.range(size).select(F.col("id").cast("int").alias("key")).select("key", F.pmod(F.hash("key"), F.lit(n)).alias("part"))
        found = {r.part: r.key for r in rows.groupBy("part").agg(F.min("key").alias("key")).collect()}
        size *= 4
    return [found[i] for i in range(n)]


def build(codes: DataFrame, n: int, width: int, k: int = NEIGHBOURS) -> DataFrame:
    """The neighbour graph (src, dst, sim) within the shards of n codes (id, code, scale) of so many bytes."""
    leaf = LEAF

    def edges(part: pa.Table) -> pa.Table:
        ids = part["id"].to_numpy()
        nbr, sim = descend(_decode(part["code"].to_pylist(), part["scale"].to_numpy()), k, leaf)
        src, at = np.nonzero(nbr >= 0)
        return pa.Table.from_arrays([pa.array(ids[src]), pa.array(ids[nbr[src, at]]), pa.array(sim[src, at])], schema=_EDGES)

    return cut(_dealt(codes, n, width).groupBy("shard").applyInArrow(edges, "src long, dst long, sim float"))


def _short(vectors: np.ndarray) -> np.ndarray:
    """32-bit vectors in proportion to the given ones, none of whose components is over 1."""
    return (vectors / (np.abs(vectors).max(initial=0) or 1)).astype(np.float32)


def _entries(x: np.ndarray, around: np.ndarray) -> np.ndarray:
    """The longest nodes of every band of length, and those that no list names."""
    length = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    with np.errstate(divide="ignore"):
        band = np.minimum(np.floor(np.log2(length.max(initial=0) / length) * BANDS_OCTAVE), BANDS - 1)
    order = np.lexsort((-length, band))
    first = np.searchsorted(band[order], np.arange(BANDS))
    place = np.arange(len(x)) - first[band[order].astype(np.int64)]
    alone = np.ones(len(x), bool)
    alone[around[around >= 0]] = False
    return np.union1d(order[place < max(ENTRIES, math.isqrt(len(x)))], np.flatnonzero(alone))


def graphs(table: DataFrame, n: int, width: int, k: int = NEIGHBOURS) -> DataFrame:
    """(shard, at, id, vector, members, next): the nodes of every shard in their places, with the places they lead to."""
    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    leaf = LEAF

    def linked(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        part = part.take(pa.array(np.argsort(part["id"].to_numpy())))
        nbr, _ = descend(_short(matrix(part["vector"].combine_chunks())), k, leaf)
        back, _ = reverse(nbr, np.zeros(nbr.shape, bool), REVERSE, 99)
        around = np.hstack([nbr, back])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum((around >= 0).sum(1))).astype(np.int32)), pa.array(around[around >= 0]))
        vector, members = (part[c].cast(pa.list_(part[c].type.value_type)) for c in ("vector", "members"))  # elements may be null, as Spark has it
        return pa.table({"shard": part["shard"], "at": pa.array(np.arange(len(part), dtype=np.int32)), "id": part["id"], "vector": vector, "members": members, "next": lists})

    return cut(_dealt(table, n, width).groupBy("shard").applyInArrow(linked, f"shard int, at int, id long, vector {kinds['vector']}, members array<long>, next array<int>"))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each shard, which follow each other, in their places."""
    held: list[pa.Table] = []
    for batch in batches:
        shard = batch["shard"].to_numpy()
        edge = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            if held and i < j and held[-1]["shard"][0] != batch["shard"][i]:
                yield _whole(held)
                held = []
            if i < j:
                held.append(pa.Table.from_batches([batch.slice(i, j - i)]))
    if held:
        yield _whole(held)


def _whole(parts: list[pa.Table]) -> pa.Table:
    table = pa.concat_tables(parts).combine_chunks()
    at = table["at"].to_numpy()
    if not np.array_equal(np.sort(at), np.arange(len(at))):
        raise RuntimeError("rows of a shard lie apart")
    return table if (at[1:] > at[:-1]).all() else table.take(pa.array(np.argsort(at)))


_FOUND = "node long, found array<struct<less:double,vec_id:long>>"


def _answers(shared, k: int, width: int):
    """Rows of graphs() to (node, found): a shard's k best rows for each of the block's queries, found by walks with a beam
    of that width, or by comparing all if it is 0; less is the score's negative, so found is in rising order."""
    starts_at = STARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, queries = shared.value
        for part in _shards(batches):
            ids, vectors = part["id"].to_numpy(), matrix(part["vector"].combine_chunks())
            members = part["members"].combine_chunks()
            holds = members.offsets.to_numpy(), members.values.to_numpy()
            if width:
                x, lists = _short(vectors), part["next"].combine_chunks()
                size = np.diff(lists.offsets.to_numpy())
                around = np.full((len(ids), max(1, size.max(initial=0))), -1, np.int32)
                around[np.arange(around.shape[1]) < size[:, None]] = lists.values.to_numpy()
                own = np.searchsorted(ids, asked).clip(max=len(ids) - 1)
                own[ids[own] != asked] = -1
                short = (queries / np.abs(queries).max(1, initial=1e-300)[:, None]).astype(np.float32)
                found = walk(x, around, _entries(x, around), short, own, width, EXPAND, starts_at)
            else:
                found = _compared(vectors.astype(np.float64), queries, k)
            for lo, places, _ in found:
                row, col = np.nonzero(places >= 0)
                at = places[row, col]
                score = np.einsum("ij,ij->i", vectors[at].astype(np.float64), queries[lo + row])
                yield _rows(asked[lo : lo + len(places)], row, at, score, holds, k)

    return run


def _rows(asked: np.ndarray, row: np.ndarray, at: np.ndarray, score: np.ndarray, holds: tuple, k: int) -> pa.RecordBatch:
    """The k best rows of each query, from nodes with their members; ties go to smaller ids."""
    start, values = holds
    times = np.diff(start)[at]
    first = np.repeat(start[at], times)
    ids = values[first + np.arange(len(first)) - np.repeat(np.cumsum(times) - times, times)]
    row, score = np.repeat(row, times), np.repeat(score, times)
    order = np.lexsort((ids, -score, row))
    row, score, ids = row[order], score[order], ids[order]
    kept = np.arange(len(row)) - np.searchsorted(row, np.arange(len(asked)))[row] < k
    row, score, ids = row[kept], score[kept], ids[kept]
    found = pa.StructArray.from_arrays([pa.array(-score), pa.array(ids)], ["less", "vec_id"])
    offsets = np.append(0, np.cumsum(np.bincount(row, minlength=len(asked)))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(asked), pa.ListArray.from_arrays(pa.array(offsets), found)], ["node", "found"])


def _compared(vectors: np.ndarray, queries: np.ndarray, k: int):
    """Yields (lo, places, scores) like walk(), of all nodes; nodes are in the order of their ids, and ties go to smaller ones."""
    for lo in range(0, len(queries), SLICE[0]):
        q = queries[lo : lo + SLICE[0]]
        held, score = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        for i in range(0, len(vectors), SLICE[1]):
            x = vectors[i : i + SLICE[1]]
            s = q @ x.T
            take = min(k, len(x))
            best = np.argpartition(-s, take - 1, axis=1)[:, :take]
            worst = np.take_along_axis(s, best, 1).min(1)
            for r in np.flatnonzero((s >= worst[:, None]).sum(1) > take):  # equal ones at the border
                best[r] = np.argsort(-s[r], kind="stable")[:take]
            exact = np.einsum("ij,ij->i", x[best.reshape(-1)], np.repeat(q, take, 0)).reshape(-1, take)
            held, score = np.hstack([held, i + best]), np.hstack([score, exact])
            order = np.lexsort((held, -score))[:, :k]
            held, score = np.take_along_axis(held, order, 1), np.take_along_axis(score, order, 1)
        yield lo, held, score


def _vectors(queries: DataFrame):
    """The ids in order and the vectors of a block of queries (id, vector), broadcast."""
    rows = queries.select("id", "vector").orderBy("id").toArrow().combine_chunks()  # a block of bounded size
    vectors = matrix(rows["vector"].combine_chunks()).astype(np.float64) if len(rows) else np.zeros((0, 1))
    return queries.sparkSession.sparkContext.broadcast((rows["id"].to_numpy(), vectors))


def search(queries: DataFrame, graph: DataFrame, k: int, width: int) -> DataFrame:
    """(node, found): the k best rows of all shards for a block of queries (id, vector); see _answers()."""
    found = graph.mapInArrow(_answers(_vectors(queries), k, width), _FOUND)
    best = F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k)
    return found.groupBy("node").agg(best.alias("found"))


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of truth (node, found) that found has too, or equals in score, without a node's own row; 1 without any."""
    other = lambda of: F.filter(of, lambda x: x.vec_id != F.col("node"))
    both = truth.select("node", other("found").alias("true")).where(F.size("true") > 0).join(found.select("node", other("found").alias("got")), "node", "left")
    least = F.element_at("true", -1).less
    hits = F.coalesce(F.size(F.filter("got", lambda x: x.less <= least + F.abs(least) * 1e-9)), F.lit(0))
    total = both.agg(F.sum(F.when(F.col("got").isNull(), 0).otherwise(F.least(hits, F.size("true")))), F.sum(F.size("true"))).first()
    return total[0] / total[1] if total[1] else 1.0


def nearest(rows: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", neighbours: int = NEIGHBOURS, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by every, its k nearest other rows found (all, if fewer).

    Nearness is the largest inner product, ties go to the smaller id. Vectors that are null, zero, hold a null or
    non-finite component, or aren't of the most frequent length take no part, nor do null ids; of rows that repeat an id
    the one with the least vector counts. A table without usable rows gives an empty result.
    """
    spark = rows.sparkSession
    ship(spark)
    vectors = cut(usable(rows, id_col, vector_col))
    table = cut(nodes(vectors, k + 1))
    n, n_rows = table.count(), vectors.count()
    width = vectors.select(F.max(F.size("vector"))).first()[0] or 0
    asked = vectors.where(F.pmod("vec_id", F.lit(every)) == 0)
    if n < n_rows:
        asked = asked.join(table.select("id", F.col("vector").alias("v2")), F.col("vector") == F.col("v2")).select(F.col("vec_id").alias("q"), "id")
    else:
        asked = asked.select(F.col("vec_id").alias("q"), F.col("vec_id").alias("id"))
    asked = cut(asked)
    walkers = cut(table.select("id", "vector").join(asked.select("id").distinct(), "id", "left_semi"))
    graph = graphs(table, n, width, neighbours)
    del vectors, table
    release(spark)

    n_walkers = walkers.count()
    blocks = max(1, math.ceil(n_walkers * 8 * width / BLOCK))
    size = n / graph.select("shard").distinct().count() if n else 0
    enough = min(k + 1, n_rows)

    def walked(some: DataFrame, beam: int) -> DataFrame:
        found = cut(search(some, graph, k + 1, beam))
        whole = found.where(F.size("found") >= enough)
        short = cut(some.join(whole.select(F.col("node").alias("id")), "id", "left_anti"))
        return found if short.isEmpty() else whole.union(search(short, graph, k + 1, 0))

    sample = cut(walkers.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(CHECKED))
    truth = cut(search(sample, graph, k + 1, 0))
    beam = max(beam, k + 1)
    while beam * READ < size and recall(walked(sample, beam), truth) < RECALL:
        beam += beam // 2
    if beam * READ >= size and recall(walked(sample, beam), truth) < RECALL:
        beam = 0
    parts = [walkers.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)) == b) for b in range(blocks)] if blocks > 1 else [walkers]
    lists = reduce(DataFrame.union, [walked(part, beam) for part in parts]).withColumnRenamed("node", "id")
    own = F.slice(F.filter("found", lambda x: x.vec_id != F.col("q")), 1, k)
    ranked = asked.join(small(lists, n_walkers, SHARED // (24 * (k + 1))), "id").select("q", F.posexplode(own).alias("at", "one"))
    return ranked.select(F.col("q").alias("query_id"), (F.col("at") + 1).alias("rank"), "one.vec_id", (0.0 - F.col("one.less")).alias("score"))
