"""Queries of the read operators over the derived views, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readprep.operators import counted as C
from readprep.operators import profile as P
from readprep.operators import spectrum as S
from readprep.operators import trim as T
from readprep.operators.adapters import best_hit
from readprep.operators.pipeline import keep, prepare, prepare_pairs, report
from readprep.plans.views import MATES_SQL, READS_SQL, mates, reads

K, MIN_QUALITY, FLOOR, MIN_LENGTH = 15, 20, 4, 35
SAMPLE = 1000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
W = "with " + READS_SQL


_HELD: list[DataFrame] = []


def held(df: DataFrame) -> DataFrame:
    """df, cached until the next query is asked for."""
    _HELD.append(df.persist())
    return df


def query(sql: str | None = None):
    def add(f):
        @wraps(f)
        def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
            while _HELD:
                _HELD.pop().unpersist()
            return f(spark, sf_dir)

        QUERIES[f.__name__] = asked
        if sql:
            ORACLES[f.__name__] = sql
        return asked

    return add


def rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.kmer_counts(reads(spark, sf_dir), K, MIN_QUALITY - 2)


# --- profile ---------------------------------------------------------------------------------------------------------

LENGTHS = """
len_v as (select count(*) as n_reads, coalesce(sum(l), 0)::bigint as s, coalesce(sum(l * l), 0)::bigint as ss,
  coalesce(list_sort(list(l))[(count(*) // 2 + 1)::bigint], 0) as median_length from (select length(sequence)::bigint as l from reads_v)),
lengths_v as (select n_reads, coalesce(s / n_reads, 0.0) as mean_length, median_length, coalesce(sqrt(greatest((ss * n_reads - s * s) / (n_reads * n_reads), 0.0)), 0.0) as sd_length from len_v)"""
BASES = """
bases_v as (select read_ix, i as cycle, substr(sequence, i, 1) as base, greatest(ascii(substr(qualities, i, 1)) - 33, 0) as phred
  from (select read_ix, sequence, qualities, unnest(range(1, length(sequence) + 1)) as i from reads_v)),
cycle_v as (select cycle, count(*) as n_bases, sum(phred)::bigint as s from bases_v group by cycle)"""
QUALITY = """
quality_v as (select sum(s) / sum(n_bases) as mean_phred,
  case when max(cycle) >= 10 then avg(s / n_bases) filter (cycle <= 10) - avg(s / n_bases) filter (cycle > (select max(cycle) - 10 from cycle_v)) else 0.0 end as tail_drop from cycle_v)"""


@query(f"{W}, {LENGTHS} select n_reads, round(mean_length, 9) as mean_length, median_length, round(sd_length, 9) as sd_length from lengths_v")
def read_length_stats(spark, sf_dir):
    return rounded(P.length_stats(reads(spark, sf_dir)), "mean_length", "sd_length")


@query(f"{W} select read_ix, header, sequence, qualities from reads_v order by read_ix limit {SAMPLE}")
def head_sample(spark, sf_dir):
    return P.head(reads(spark, sf_dir), SAMPLE)


@query(f"{W}, {BASES} select cycle, n_bases, s / n_bases as mean_phred from cycle_v")
def cycle_quality(spark, sf_dir):
    return P.cycle_quality(reads(spark, sf_dir))


@query(f"{W}, {BASES}, {QUALITY} select round(mean_phred, 9) as mean_phred, round(tail_drop, 9) as tail_drop from quality_v")
def quality_profile(spark, sf_dir):
    return rounded(P.quality_profile(reads(spark, sf_dir)), "mean_phred", "tail_drop")


POLY = "poly_v as (select count(*) as n_reads, coalesce(sum(regexp_matches(right(sequence, 20), 'A{8}|T{8}')::int), 0)::bigint as hits from reads_v)"


@query(f"{W}, {POLY} select n_reads, hits, hits / n_reads as rate from poly_v")
def poly_tail_rate(spark, sf_dir):
    return P.poly_tail(reads(spark, sf_dir))


BARCODE = f"""{LENGTHS},
hits_v as (select sum((length(sequence) >= 28 and case when median_length <= 40 then regexp_matches(substr(sequence, 15, 36), 'T{{6}}') else regexp_matches(substr(sequence, 15, 36), 'T{{8}}') end)::int) / count(*) as rate,
  any_value(median_length) as m from reads_v, lengths_v),
barcode_v as (select 16 as prefix_bases, case when m >= 28 then 12 else 10 end as umi_bases, rate from hits_v where rate >= case when m <= 40 then 0.08 else 0.20 end)"""


@query(f"{W}, {BARCODE} select median_length, prefix_bases, umi_bases, rate from lengths_v left join barcode_v on true")
def barcode_hint(spark, sf_dir):
    rows = reads(spark, sf_dir)
    median = P.length_stats(rows).select(F.col("median_length").alias("median"))
    return median.join(P.barcode_hint(rows, median), F.lit(True), "left").withColumnRenamed("median", "median_length")


DUPLICATION = "dup_v as (select count(*) as n_reads, count(distinct sequence) as n_distinct from reads_v)"


@query(f"{W}, {DUPLICATION} select n_reads, n_distinct, 1 - n_distinct / n_reads as rate from dup_v")
def duplication_rate(spark, sf_dir):
    return P.duplication(reads(spark, sf_dir))


DIVERSITY = f"""
div_v as (select count(*) as n_kmers, count(distinct w) as n_distinct from (select substr(sequence, i, {K}) as w from (select sequence, unnest(range(1, length(sequence) - {K - 1} + 1)) as i from reads_v)))"""


@query(f"{W}, {DIVERSITY} select n_kmers, n_distinct, n_distinct / n_kmers as diversity from div_v")
def kmer_diversity(spark, sf_dir):
    return P.kmer_diversity(reads(spark, sf_dir))


LEADING = """
bucket_v as (select cycle, case when base in ('A', 'C', 'G', 'T') then base else 'other' end as bucket, count(*) as n from bases_v group by 1, 2),
share_v as (select bucket, sum(n) / (select sum(n) from bucket_v) as overall from bucket_v group by bucket),
usable_v as (select least(min(length(sequence)), 12) as usable from reads_v),
grid_v as (select t.cycle, s.bucket, s.overall, t.total, coalesce(b.n, 0) as n from (select cycle, sum(n) as total from bucket_v, usable_v where cycle <= usable group by cycle) t cross join share_v s left join bucket_v b on b.cycle = t.cycle and b.bucket = s.bucket),
leading_v as (select coalesce(avg(d), 0.0) as bias from (select cycle, sum(abs(n / total - overall)) / 2 as d from grid_v group by cycle))"""
GC = """
gc_v as (select cycle, sum((base in ('G', 'C'))::int) as gc, count(*) as n from bases_v group by cycle),
gcbias_v as (select coalesce(avg(abs(gc / n - (select sum(gc) / sum(n) from gc_v))), 0.0) as bias from gc_v where cycle <= 10)"""


@query(f"{W}, {BASES}, {LEADING} select round(bias, 9) as bias from leading_v")
def leading_cycle_bias(spark, sf_dir):
    return rounded(P.leading_bias(reads(spark, sf_dir)), "bias")


@query(f"{W}, {BASES}, {GC} select round(bias, 9) as bias from gcbias_v")
def gc_bias(spark, sf_dir):
    return rounded(P.gc_bias(reads(spark, sf_dir)), "bias")


# --- adapters --------------------------------------------------------------------------------------------------------

_KNOWN = ", ".join(f"({i}, '{n}', '{s}')" for i, (n, s) in enumerate(P.KNOWN_ADAPTERS))


def overlaps(adapters: str) -> str:
    """Accepted overlaps of reads_v with a table (cand, name, seq, support)."""
    return f"""(select * from (select read_ix, cand, name, support, s as start, ov, ov - hamming(substr(sequence, s + 1, ov), substr(seq, 1, ov)) as matches
      from (select *, least(length(sequence) - s, length(seq)) as ov from (select read_ix, sequence, cand, name, seq, support, unnest(range(greatest(length(sequence) - greatest(length(seq), 28), 0), length(sequence) - 7)) as s from reads_v, {adapters})))
      where (ov - matches) * 100 <= ov * 15)"""


ADAPTERS = f"""
known_v as (select * from (values {_KNOWN}) k(cand, name, seq)),
support_v as (select name, seq, count(distinct read_ix) as support from {overlaps("(select *, 0 as support from known_v) a")} h join known_v k using (cand, name) group by name, seq),
n_v as (select count(*) as n from reads_v),
suffix_v as (select right(sequence, 12) as seq, count(*) as support from reads_v
  where length(sequence) >= 12 and list_sum(list_transform(string_split(right(qualities, 12), ''), lambda c: greatest(ascii(c) - 33, 0))) <= 300
    and len(list_distinct(string_split(right(sequence, 12), ''))) >= 3 group by 1),
denovo_v as (select seq, support, support / n as score from suffix_v, n_v where support >= greatest(n // 25, 3) and support / n < 0.80 order by support desc, seq limit 2),
cands_v as (select row_number() over (order by support desc, score desc, name, seq) as place, name, seq, support, score from (
  select name, seq, support, support / n as score from support_v, n_v union all select 'de_novo_suffix', seq, support, score from denovo_v where seq not in (select seq from known_v)))"""


@query(f"{W}, {ADAPTERS} select name, seq as sequence, support, support / n as score from support_v, n_v")
def known_adapter_support(spark, sf_dir):
    return P.known_support(reads(spark, sf_dir))


@query(f"{W}, {ADAPTERS} select seq as sequence, support, score from denovo_v")
def denovo_suffixes(spark, sf_dir):
    return P.denovo_suffixes(reads(spark, sf_dir))


@query(f"{W}, {ADAPTERS} select place, name, seq as sequence, support, score from cands_v")
def adapter_candidates(spark, sf_dir):
    return P.adapter_candidates(reads(spark, sf_dir))


def found_adapters(rows: DataFrame) -> list[tuple[str, str, int]]:
    return [(r.name, r.sequence, r.support) for r in P.adapter_candidates(rows).orderBy("place").collect()]


HITS = f"""{ADAPTERS},
hit_v as (select read_ix, name as adapter_name, start as adapter_start, score as adapter_score from (
  select *, row_number() over (partition by read_ix order by score desc, start, cand) as rn from (
    select read_ix, name, start, cand, matches * 4 - (ov - matches) * 3 + ov + support as score from {overlaps("(select place as cand, name, seq, support from cands_v) a")} h)) where rn = 1)"""


@query(f"{W}, {HITS} select read_ix, adapter_name, adapter_start, adapter_score from hit_v")
def adapter_best_hit(spark, sf_dir):
    rows = held(reads(spark, sf_dir))
    return best_hit(rows, found_adapters(rows)).where("adapter_name is not null").select("read_ix", "adapter_name", "adapter_start", "adapter_score")


PROFILE = f"""{BARCODE}, {BASES}, {QUALITY}, {POLY}, {DUPLICATION}, {DIVERSITY}, {LEADING}, {GC}, {ADAPTERS},
parts_v as (select l.*, q.mean_phred, q.tail_drop, coalesce((select max(support / n) from support_v, n_v where name like '%illumina%'), 0.0) as illumina,
  coalesce((select max(support / n) from support_v, n_v where name like '%nextera%'), 0.0) as nextera, (select umi_bases from barcode_v) as umi_bases, (select rate from barcode_v) as barcode_rate,
  p.hits / p.n_reads as poly_tail_rate, 1 - d.n_distinct / d.n_reads as duplication_rate, lead.bias as leading_bias, g.bias as gc_bias, v.n_distinct / v.n_kmers as kmer_diversity
  from lengths_v l, quality_v q, poly_v p, dup_v d, leading_v lead, gcbias_v g, div_v v),
ramps_v as (select *, greatest(0.0, least(1.0, (poly_tail_rate - 0.05) / 0.15)) as rp, greatest(0.0, least(1.0, (leading_bias - 0.03) / 0.07)) as rb, greatest(0.0, least(1.0, (duplication_rate - 0.08) / 0.17)) as rd,
  greatest(0.0, least(1.0, (gc_bias - 0.02) / 0.06)) as rg, greatest(0.0, least(1.0, (1 - kmer_diversity - 0.05) / 0.25)) as rv from parts_v),
primary_v as (select *, 0.40 * rp + 0.30 * rd as prim from ramps_v),
evidence_v as (select *, greatest(case when prim >= 0.01 then prim + (0.15 * rb + 0.08 * rg + 0.07 * rv) * least(prim / 0.20, 1.0) else prim end,
  case when leading_bias > 0.08 and gc_bias > 0.04 and kmer_diversity >= 0.40 and kmer_diversity < 0.65 then 0.30 * rb + 0.25 * rg + 0.25 * rv + 0.10 * rd + 0.10 * rp else 0.0 end) as rna_evidence from primary_v),
platform_v as (select *, case when mean_length > 800 then case when mean_phred < 20 then 'ONT' else 'PacBio' end when mean_length > 200 and mean_phred < 15 then 'ONT'
  when mean_length >= 35 then case when sd_length / mean_length > 0.3 and mean_phred < 28 and greatest(illumina, nextera) < 0.0005 then 'Ion Torrent' when tail_drop >= 6 or greatest(illumina, nextera) >= 0.0005 then 'Illumina'
    when tail_drop <= 3.5 and mean_phred >= 28 then 'MGI' else 'Illumina' end else 'Unknown' end as platform from evidence_v),
profile_v as (select *, case when platform in ('ONT', 'PacBio') then 'Long Read' when umi_bases >= 12 then '10x v3' when umi_bases is not null then '10x v2'
  when nextera >= 0.002 and mean_length < 120 and nextera > 7 * illumina then 'ATAC-seq' when rna_evidence >= 0.40 then 'RNA-seq' else 'WGS' end as experiment from platform_v)"""
_PROFILE_DOUBLES = ["mean_length", "sd_length", "mean_phred", "tail_drop", "illumina", "nextera", "barcode_rate", "poly_tail_rate", "duplication_rate", "leading_bias", "gc_bias", "kmer_diversity", "rna_evidence"]


@query(f"{W}, {PROFILE} select n_reads, median_length, umi_bases, platform, experiment, {', '.join(f'round({c}, 8) as {c}' for c in _PROFILE_DOUBLES)} from profile_v")
def auto_profile(spark, sf_dir):
    return rounded(P.auto_profile(held(reads(spark, sf_dir))), *_PROFILE_DOUBLES, digits=8)


@query(f"""{W}, {PROFILE} select platform, experiment, case when platform in ('ONT', 'PacBio') then 11 when mean_length < 75 then 13 else 15 end as kmer_size, case platform when 'ONT' then 10 when 'PacBio' then 15 else 20 end as min_quality,
  case when experiment like '10x%' then 3 when experiment = 'Long Read' then 2 else 4 end as trusted_floor, case when experiment like '10x%' then 20 when experiment = 'Long Read' then 200 else 35 end as min_length,
  platform in ('Illumina', 'MGI') and mean_length >= 75 as zero_copy, case when platform in ('Illumina', 'MGI') and mean_length >= 75 then 3 else 1 end as overlap_depth from profile_v""")
def execution_plan(spark, sf_dir):
    return P.execution_plan(P.auto_profile(held(reads(spark, sf_dir))), accelerated=True)


# --- spectrum --------------------------------------------------------------------------------------------------------

_CODE = "list_reduce(list_prepend(0::bigint, list_transform(string_split({0}, ''), lambda c: (instr('ACGT', c) - 1)::bigint)), lambda a, c: a * 4 + c)"
KMERS = f"""
kmers_v as (select least(w, reverse(translate(w, 'ACGT', 'TGCA'))) as w from (
    select substr(sequence, i, {K}) as w, substr(qualities, i, {K}) as q from (select sequence, qualities, unnest(range(1, length(sequence) - {K - 1} + 1)) as i from reads_v))
  where translate(w, 'ACGT', '') = '' and not regexp_matches(q, '[\\x00-\\x{32 + MIN_QUALITY - 2:02x}]')),
counts_v as (select {_CODE.format("w")} as kmer, cnt from (select w, count(*) as cnt from kmers_v group by w))"""


@query(f"{W}, {KMERS} select kmer, cnt from counts_v")
def canonical_kmer_counts(spark, sf_dir):
    return counts(spark, sf_dir)


@query(f"{W}, {KMERS} select cnt, count(*) as n_kmers from counts_v group by cnt")
def kmer_histogram(spark, sf_dir):
    return counts(spark, sf_dir).groupBy("cnt").agg(F.count("*").alias("n_kmers"))


FLOORS = f"""
summary_v as (select (select count(*) from reads_v where length(sequence) >= {K}) as records, count(*) as unique_kmers, list_sort(list(cnt))[(count(*) // 2 + 1)::bigint] as median_count from counts_v),
floor_v as (select *, case when unique_kmers = 0 or records <= {SAMPLE} then {FLOOR} else greatest(least(ceil({FLOOR} * sqrt(records / {SAMPLE})), greatest(median_count // 3, {FLOOR})), {FLOOR})::bigint end as floor from summary_v)"""


@query(f"{W}, {KMERS}, {FLOORS} select records, unique_kmers, median_count, floor from floor_v")
def trusted_floor(spark, sf_dir):
    rows = reads(spark, sf_dir)
    return S.trusted_floor(S.summary(rows, counts(spark, sf_dir), K), FLOOR, SAMPLE)


@query(f"{W}, {KMERS} select kmer, cnt from counts_v where cnt >= {FLOOR}")
def trusted_kmers(spark, sf_dir):
    return S.trusted(counts(spark, sf_dir), FLOOR)


_M64 = "18446744073709551616::uhugeint"
BLOOM = f"""
shape_v as (select slots, greatest(least(ceil(slots / n * ln(2.0)), 32), 1)::int as hashes from (select greatest(ceil(-n * ln(0.01) / (ln(2.0) * ln(2.0))), 1)::bigint as slots, n from (select greatest(count(*), 1)::double as n from counts_v))),
hashed_v as (
  select kmer, cnt, slots, seed, xor(kmer::ubigint, ((seed::uhugeint * {S.SEED}::uhugeint) % {_M64})::ubigint) as h0 from (select kmer, cnt, slots, unnest(range(0, hashes)) as seed from counts_v, shape_v)),
h1_v as (select kmer, cnt, slots, ((h0::uhugeint * {S.MULTIPLY_1}::uhugeint) % {_M64})::ubigint as h from hashed_v),
h2_v as (select kmer, cnt, slots, ((xor(h, h >> 31)::uhugeint * {S.MULTIPLY_2}::uhugeint) % {_M64})::ubigint as h from h1_v),
slot_v as (select kmer, cnt, (xor(h, h >> 31) % slots::ubigint)::bigint as slot from h2_v),
bloom_v as (select slot, least(sum(least(cnt, 255)), 15)::bigint as cnt from slot_v group by slot)"""


@query(f"{W}, {KMERS}, {BLOOM} select slot, cnt from bloom_v")
def bloom_slots(spark, sf_dir):
    return S.bloom(held(counts(spark, sf_dir)))


@query(f"{W}, {KMERS}, {BLOOM} select s.kmer, case when any_value(c.cnt) >= {FLOOR} then any_value(c.cnt) else min(b.cnt) end as support from slot_v s join bloom_v b using (slot) join counts_v c on c.kmer = s.kmer group by s.kmer")
def bloom_lookup(spark, sf_dir):
    return S.supports(reads(spark, sf_dir), K, MIN_QUALITY - 2, FLOOR)


SUPPORT = f"""
window_v as (select read_ix, n, i - 1 as start, w, translate(w, 'ACGT', '') = '' as good, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) as canon from (
  select read_ix, length(sequence) as n, i, substr(sequence, i, {K}) as w from (select read_ix, sequence, unnest(range(1, length(sequence) - {K - 1} + 1)) as i from reads_v))),
strings_v as (select w as canon, count(*) as cnt from kmers_v group by w),
wcount_v as (select read_ix, n, start, case when good then coalesce(cnt, 0) else 0 end as cnt from window_v left join strings_v using (canon)),
cover_v as (select read_ix, unnest(range(start, start + {K})) as pos, cnt from wcount_v),
possup_v as (select read_ix, pos, min(cnt) as least, sum(cnt)::bigint as total, count(*) as windows from cover_v group by read_ix, pos)"""


@query(f"{W}, {KMERS}, {SUPPORT} select read_ix, pos, least, total, windows from possup_v")
def position_support(spark, sf_dir):
    return S.position_support(reads(spark, sf_dir), counts(spark, sf_dir), K)


ATTENTION = f"""
attention_v as (select read_ix, pos, phred, least, total, windows from possup_v join (select read_ix, cycle - 1 as pos, phred from bases_v) using (read_ix, pos)
  where windows > 0 and (phred < {MIN_QUALITY} or (phred <= {MIN_QUALITY + 5} and least < {FLOOR})))"""


@query(f"{W}, {KMERS}, {SUPPORT}, {BASES}, {ATTENTION} select read_ix, pos, phred, least, total, windows from attention_v")
def attention_positions(spark, sf_dir):
    return S.attention(reads(spark, sf_dir), counts(spark, sf_dir), K, MIN_QUALITY, FLOOR)


@query(f"{W}, {KMERS} select kmer >> 2 as src, kmer & {(1 << 2 * (K - 1)) - 1} as dst, kmer & 3 as label, cnt from counts_v where cnt >= {FLOOR}")
def dbg_edges(spark, sf_dir):
    return S.edges(counts(spark, sf_dir), K, FLOOR)


EDGES = f"edges_v as (select kmer >> 2 as src, kmer & {(1 << 2 * (K - 1)) - 1} as dst, kmer & 3 as label, cnt from counts_v where cnt >= {FLOOR})"


@query(f"{W}, {KMERS}, {EDGES} select (select count(*) from (select src from edges_v union select dst from edges_v)) as nodes, (select count(*) from edges_v) as edges")
def dbg_size(spark, sf_dir):
    return S.graph_size(held(S.edges(counts(spark, sf_dir), K, FLOOR)))


@query(f"{W}, {KMERS}, {EDGES} select src, dst, label, cnt, row_number() over (partition by src order by cnt desc, label) as place from edges_v qualify place <= 3")
def dbg_top_edges(spark, sf_dir):
    return S.top_edges(S.edges(counts(spark, sf_dir), K, FLOOR), 3)


@query(f"{W}, {KMERS}, {EDGES} select a.src, a.dst as via, b.dst, least(a.cnt, b.cnt) as least from edges_v a join edges_v b on a.dst = b.src")
def dbg_two_hop(spark, sf_dir):
    return S.two_hops(held(S.edges(counts(spark, sf_dir), K, FLOOR)))


# --- trimming and pairs ----------------------------------------------------------------------------------------------


@query(f"{W} select read_ix, s as start, l as len from (select read_ix, min(pos) as s, count(*) as l from (select read_ix, pos, pos - row_number() over (partition by read_ix order by pos) as island from (select read_ix, qualities, unnest(range(0, length(qualities))) as pos from reads_v) where ascii(substr(qualities, pos + 1, 1)) < {33 + MIN_QUALITY}) group by read_ix, island) where l between 2 and 10")
def low_quality_regions(spark, sf_dir):
    return T.low_regions(reads(spark, sf_dir), MIN_QUALITY, 2, 10)


_TAIL = f"length(regexp_extract({{0}}, '[\\x00-\\x{32 + MIN_QUALITY - 2:02x}]*$'))"


@query(f"{W} select read_ix, run as low_tail, case when run >= 3 then length(qualities) - run else length(qualities) end as kept from (select read_ix, qualities, {_TAIL.format('qualities')} as run from reads_v)")
def quality_trim(spark, sf_dir):
    q = F.col("qualities")
    return reads(spark, sf_dir).select("read_ix", T.low_tail(q, MIN_QUALITY).alias("low_tail"), T.quality_cut(q, MIN_QUALITY).alias("kept"))


TRIM = f"""{HITS},
cut_v as (select r.read_ix, r.header, length(r.sequence) as n, substr(r.sequence, 1, coalesce(h.adapter_start, length(r.sequence))) as sequence, substr(r.qualities, 1, coalesce(h.adapter_start, length(r.qualities))) as qualities, h.adapter_name
  from reads_v r left join hit_v h using (read_ix)),
tail_v as (select *, {_TAIL.format("qualities")} as run from cut_v),
trim_v as (select read_ix, header, n, adapter_name as trimmed_adapter, substr(sequence, 1, kept) as sequence, substr(qualities, 1, kept) as qualities, n - kept as trimmed_bases
  from (select *, case when run >= 3 then length(qualities) - run else length(qualities) end as kept from tail_v))"""


def trimmed(spark, sf_dir):
    rows = held(reads(spark, sf_dir))
    return T.trim(rows, found_adapters(rows), MIN_QUALITY)


@query(f"{W}, {TRIM} select read_ix, header, sequence, qualities, trimmed_bases, trimmed_adapter from trim_v where length(sequence) >= {MIN_LENGTH}")
def trim_and_filter(spark, sf_dir):
    return T.long_enough(trimmed(spark, sf_dir), MIN_LENGTH)


@query(f"{W}, {TRIM} select count(*) as n_reads, sum((trimmed_bases > 0)::int)::bigint as trimmed_reads, sum(trimmed_bases)::bigint as trimmed_bases, sum((length(sequence) >= {MIN_LENGTH})::int)::bigint as kept_reads, sum(case when length(sequence) >= {MIN_LENGTH} then length(sequence) else 0 end)::bigint as kept_bases from trim_v")
def trim_stats(spark, sf_dir):
    return T.trim_stats(trimmed(spark, sf_dir), MIN_LENGTH)


@query(f"with {MATES_SQL} select pair_ix, stem as key, length(sequence1) as length1, length(sequence2) as length2 from mates_v")
def paired_sync(spark, sf_dir):
    pairs = T.pair_up(*mates(spark, sf_dir))
    return pairs.select(F.col("read_ix").alias("pair_ix"), "key", F.length("sequence1").alias("length1"), F.length("sequence2").alias("length2"))


@query(f"with {MATES_SQL} select count(*) as kept, sum(length(sequence1) + length(sequence2))::bigint as bases from mates_v where length(sequence1) >= 60 and length(sequence2) >= 60")
def paired_filter(spark, sf_dir):
    return T.filter_pairs(T.pair_up(*mates(spark, sf_dir)), 60).agg(F.count("*").alias("kept"), F.sum(F.length("sequence1") + F.length("sequence2")).cast("long").alias("bases"))


@query(f"with {MATES_SQL} select 2 * pair_ix as read_ix, sequence1 as sequence from mates_v union all select 2 * pair_ix + 1, sequence2 from mates_v")
def interleaved(spark, sf_dir):
    return T.interleave(*mates(spark, sf_dir)).select("read_ix", "sequence")


# --- correction: sequential edits, tested against an independent model rather than by SQL ------------------------------


@query()
def corrected_reads(spark, sf_dir):
    rows = held(reads(spark, sf_dir))
    plan = P.Plan(K, MIN_QUALITY, FLOOR, MIN_LENGTH, found_adapters(rows))
    return keep(prepare(rows, plan), plan)


@query()
def pipeline_report(spark, sf_dir):
    rows = held(reads(spark, sf_dir))
    plan = P.Plan(K, MIN_QUALITY, FLOOR, MIN_LENGTH, found_adapters(rows))
    return report(prepare(rows, plan), plan)


@query()
def corrected_pairs(spark, sf_dir):
    first, second = (held(side) for side in mates(spark, sf_dir))
    plan = P.Plan(K, MIN_QUALITY, FLOOR, MIN_LENGTH, found_adapters(first))
    return T.filter_pairs(prepare_pairs(first, second, plan), MIN_LENGTH)


SUBSTITUTIONS = f"""
tried_v as (select a.read_ix, a.pos, a.least, a.total, a.windows, b.base, start, substr(r.sequence, start + 1, a.pos - start) || b.base || substr(r.sequence, a.pos + 2, start + {K} - a.pos - 1) as w
  from (select *, unnest(range(greatest(pos - {K - 1}, 0), least(pos, n - {K}) + 1)) as start from (select a.*, length(sequence) as n from attention_v a join reads_v using (read_ix))) a join reads_v r using (read_ix), (values ('A'), ('C'), ('G'), ('T')) b(base)
  where substr(r.sequence, a.pos + 1, 1) <> b.base),
scored_v as (select read_ix, pos, any_value(t.least) as least, any_value(t.total) as total, any_value(t.windows) as windows, base, min(case when translate(w, 'ACGT', '') = '' then coalesce(cnt, 0) else 0 end) as new_least, sum(case when translate(w, 'ACGT', '') = '' then coalesce(cnt, 0) else 0 end)::bigint as new_total
  from tried_v t left join strings_v s on s.canon = least(w, reverse(translate(w, 'ACGT', 'TGCA'))) group by read_ix, pos, base),
bestsub_v as (select * from (select *, row_number() over (partition by read_ix, pos order by new_least desc, new_total desc, base) as rn from scored_v) where rn = 1)"""


@query(f"""{W}, {KMERS}, {SUPPORT}, {BASES}, {ATTENTION}, {SUBSTITUTIONS} select read_ix, pos, base, new_least, new_total,
  (new_least > least or (new_least = least and new_total > total)) and ((new_least >= {FLOOR} and new_least > least) or new_total >= total + {FLOOR} * windows) as accepted from bestsub_v""")
def substitution_candidates(spark, sf_dir):
    rows = reads(spark, sf_dir)
    return C.substitutions(rows, C.collected(rows, K, MIN_QUALITY - 2), K, MIN_QUALITY, FLOOR)


