"""Views over the given tables that stand for sequencing inputs, in Spark and as DuckDB SQL.

Every document is turned into DNA, letter by letter, and cut into reads of 100 bases over its whole length, the last of which
holds what is left; adapters, short inserts, unknown bases and qualities follow integer formulas, so both engines build the
same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READ = 100
UNIVERSAL = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA"
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26]
#: Reads of a document are numbered from doc_id * SPAN.
SPAN = 1_000_000

READS_SQL = f"""
reads_v as (
  with d as (select doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{BASES}') as dna from documents where text is not null),
  c as (select doc_id, unnest(range(0, (length(dna) + {READ - 1}) // {READ})) as ch, dna from d),
  r as (select doc_id, ch, substr(dna, (ch * {READ} + 1)::bigint, {READ}) as raw from c),
  a as (select doc_id, ch, case when length(raw) >= 56 and (doc_id + ch) % 10 = 0 then substr(raw, 1, 25) || '{UNIVERSAL}'
          when length(raw) >= 56 and (doc_id + ch) % 5 = 0 then substr(raw, 1, length(raw) - 20) || 'AGATCGGAAGAGCACACGTC' else raw end as s,
          211 - (doc_id * 7 + ch * 3) % 211 as n_at from r)
  select doc_id * {SPAN} + ch as read_ix, 'd' || doc_id || ':' || ch as header,
    case when n_at <= length(s) then substr(s, 1, (n_at - 1)::bigint) || 'N' || substr(s, (n_at + 1)::bigint) else s end as sequence,
    array_to_string(list_transform(range(1, length(s) + 1), lambda i: chr((33 + case when (doc_id * 31 + ch * 17 + i * 7) % 53 = 0 then 2
      else greatest(40 - (i * i) // (300 + 250 * ((doc_id * 3 + ch) % 4)) - (doc_id * 13 + ch * 5 + i * 11) % 9, 2) end)::int)), '') as qualities
  from a)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_ix, header, sequence, qualities): the reads of all documents."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text").repartition(2 * spark.sparkContext.defaultParallelism)
    dna = docs.select("doc_id", F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), LETTERS, BASES).alias("dna")).where("dna <> ''")
    # all pieces in one walk over the text: a substr of each would walk to its place, and a row of each would carry the text
    cut = dna.select("doc_id", F.posexplode(F.expr(f"regexp_extract_all(dna, '.{{1,{READ}}}', 0)")).alias("ch", "raw"))
    raw = cut.select("doc_id", F.col("ch").cast("long").alias("ch"), "raw")
    tailed = raw.selectExpr(
        "doc_id", "ch",
        f"case when length(raw) >= 56 and (doc_id + ch) % 10 = 0 then substr(raw, 1, 25) || '{UNIVERSAL}' when length(raw) >= 56 and (doc_id + ch) % 5 = 0 then substr(raw, 1, length(raw) - 20) || 'AGATCGGAAGAGCACACGTC' else raw end as s",
        "cast(211 - (doc_id * 7 + ch * 3) % 211 as int) as n_at",
    )
    # a quality string is one of 36 by place, with a 2 where 53 divides (doc_id * 31 + ch * 17 + i * 7): at i = first, and 53 on
    known = tailed.selectExpr(
        "doc_id", "ch", "n_at", "s",
        "if(doc_id < 0, null, array(" + ", ".join(f'"{_plain(b, c)}"' for b in range(4) for c in range(9)) + ")[cast((doc_id * 3 + ch) % 4 * 9 + (doc_id * 13 + ch * 5) % 9 as int)]) as plain",
        "cast(53 - (doc_id * 31 + ch * 17) % 53 * 38 % 53 as int) as first",
    )
    return known.selectExpr(
        f"doc_id * {SPAN} + ch as read_ix", "concat('d', doc_id, ':', ch) as header",
        "case when n_at <= length(s) then substr(s, 1, n_at - 1) || 'N' || substr(s, n_at + 1) else s end as sequence",
        """case when doc_id >= 0 then substr(concat(substr(plain, 1, first - 1), '#', substr(plain, first + 1, 52), '#', substr(plain, first + 54)), 1, length(s)) else
           array_join(transform(sequence(1, length(s)), i -> chr(33 + case when (doc_id * 31 + ch * 17 + i * 7) % 53 = 0 then 2
           else greatest(40 - (i * i) div (300 + 250 * ((doc_id * 3 + ch) % 4)) - (doc_id * 13 + ch * 5 + i * 11) % 9, 2) end)), '') end as qualities""",
    )


def _plain(b: int, c: int) -> str:
    """The qualities of a read with (doc_id * 3 + ch) % 4 = b and (doc_id * 13 + ch * 5) % 9 = c, but for the places of a 2."""
    return "".join(chr(33 + max(40 - i * i // (300 + 250 * b) - (c + i * 11) % 9, 2)) for i in range(1, 2 * READ + 1))


def mates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two files of mates (read_ix, header, sequence, qualities): even chunks and the odd chunks that follow them."""
    chunk = F.pmod("read_ix", F.lit(SPAN))
    both = reads(spark, sf_dir).withColumn("pair", F.floor(F.col("read_ix") / 2)).withColumn("stem", F.concat(F.regexp_extract("header", "^(d[0-9]+):", 1), F.lit(":"), F.floor(chunk / 2)))
    first, second = both.where(chunk % 2 == 0), both.where(chunk % 2 == 1)
    has = lambda a, b: a.join(b.select("pair"), "pair", "left_semi")
    side = lambda df, n: df.select(F.col("pair").alias("read_ix"), F.concat("stem", F.lit(f"/{n} x")).alias("header"), "sequence", "qualities")
    return side(has(first, second), 1), side(has(second, first), 2)


MATES_SQL = (
    READS_SQL
    + f""",
mates_v as (
  select a.read_ix // 2 as pair_ix, regexp_extract(a.header, '^(d[0-9]+):', 1) || ':' || ((a.read_ix % {SPAN}) // 2) as stem,
    a.sequence as sequence1, a.qualities as qualities1, b.sequence as sequence2, b.qualities as qualities2
  from reads_v a join reads_v b on b.read_ix = a.read_ix + 1 and (a.read_ix % {SPAN}) % 2 = 0)"""
)
