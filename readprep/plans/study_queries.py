"""Queries of evaluation, history and the study layer, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readprep.operators import evaluate as E
from readprep.operators import history as H
from readprep.operators.pipeline import keep, prepare, prepare_accelerated
from readprep.operators.profile import Plan
from readprep.plans.views import table
from readprep.study import manifest as M
from readprep.study import reports as R
from readprep.study import text as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def quoted(x) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def values(rows: list[tuple], names: str, alias: str = "v") -> str:
    return f"(select * from (values {', '.join('(' + ', '.join(quoted(c) for c in r) + ')' for r in rows)}) {alias}({names}))"


# --- evaluation ------------------------------------------------------------------------------------------------------

#: Outputs of a cleaner that keeps everything, mends nothing and cuts at the first ten bases of the adapter.
_MARK = E.ADAPTER[:10]
_OUT = f"case when instr(sequence, '{_MARK}') > 0 then substr(sequence, 1, instr(sequence, '{_MARK}') - 1) else sequence end"
PER_SCENARIO = 12
_TRUTH = values([(i, *r) for i, r in enumerate(E.single_scenarios())], "a, scenario, prefix, sequence, qualities, expected")
_PAIRS = values([(i, *r) for i, r in enumerate(E.paired_scenarios())], "a, scenario, prefix, sequence1, qualities1, expected1, sequence2, qualities2, expected2")
_RATIOS = ", ".join(
    f"case when {m}_tp + {m}_fp = 0 then 1.0 else {m}_tp / ({m}_tp + {m}_fp) end as {m}_precision, case when {m}_tp + {m}_fn = 0 then 1.0 else {m}_tp / ({m}_tp + {m}_fn) end as {m}_recall" for m in ("retention", "trimming", "correction")
)
_F1 = ", ".join(f"round(case when {m}_precision + {m}_recall = 0 then 0.0 else 2 * {m}_precision * {m}_recall / ({m}_precision + {m}_recall) end, 9) as {m}_f1" for m in ("retention", "trimming", "correction"))
_SUMS = ", ".join(f"sum({c})::bigint as {c}" for c in E.COUNTS)


def _bases(n: str) -> str:
    at = lambda c, i="i": f"substr({c}{n}, {i}, 1)"
    each = lambda cond: f"len(list_filter(range(1, least(length(sequence{n}), length(expected{n}), length(output{n})) + 1), lambda i: {cond}))"
    s, e, o = at("sequence"), at("expected"), at("output")
    return f"{each(f'{s} <> {e} and {o} = {e}')} as tp{n}, {each(f'{o} <> {e} and ({s} = {e} or {o} <> {s})')} as fp{n}, {each(f'{s} <> {e} and {o} <> {e}')} as fn{n}"


def _summary_sql(rows: str) -> str:
    return f"""select scenario, reads, {', '.join(E.COUNTS)}, exact_match_rate, {', '.join(f'round({m}_{k}, 9) as {m}_{k}' for m in ('retention', 'trimming', 'correction') for k in ('precision', 'recall'))}, {_F1} from (
  select *, case when expected_retained = 0 then 1.0 else exact / expected_retained end as exact_match_rate, {_RATIOS} from (select scenario, count(*) as reads, {_SUMS} from ({rows}) group by rollup (scenario)))"""



_SINGLE_ROWS = f"""
select scenario, (expected is not null)::int as expected_retained, kept::int as observed_retained, (expected is not null and kept and output = expected)::int as exact,
  (expected is not null and kept)::int as retention_tp, (expected is null and kept)::int as retention_fp, (expected is not null and not kept)::int as retention_fn,
  (want and got)::int as trimming_tp, (not want and got)::int as trimming_fp, (want and not got)::int as trimming_fn, case when paired_up then tp else 0 end as correction_tp, case when paired_up then fp else 0 end as correction_fp, case when paired_up then fn else 0 end as correction_fn
from (select *, coalesce(length(expected) < length(sequence), false) as want, kept and length(output) < length(sequence) as got, expected is not null and kept as paired_up, {_bases('')}
  from (select *, length(output) >= 35 as kept from (select *, {_OUT} as output from {_TRUTH} t, range({PER_SCENARIO}))))"""


def _simple(df: DataFrame, n: str = "") -> DataFrame:
    cut = _OUT.replace("sequence", f"sequence{n}")
    return df.withColumn(f"output{n}", F.expr(cut))


@query(_summary_sql(_SINGLE_ROWS))
def truth_eval(spark, sf_dir):
    truth = E.single_truth(spark, PER_SCENARIO)
    out = _simple(truth).where("length(output) >= 35").select("read_ix", "header", F.col("output").alias("sequence"))
    scored = E.scored(truth, E.last_by(out, F.col("header"), "read_ix"))
    digits = [f"{m}_{k}" for m in ("retention", "trimming", "correction") for k in ("precision", "recall", "f1")]
    return rounded(E.summarise(scored), *digits)


_PAIRED_ROWS = f"""
select scenario, (expected1 is not null)::int as expected_retained, kept::int as observed_retained, (expected1 is not null and kept and output1 = expected1 and output2 = expected2)::int as exact,
  (expected1 is not null and kept)::int as retention_tp, (expected1 is null and kept)::int as retention_fp, (expected1 is not null and not kept)::int as retention_fn,
  (want and got)::int as trimming_tp, (not want and got)::int as trimming_fp, (want and not got)::int as trimming_fn, case when paired_up then tp1 + tp2 else 0 end as correction_tp, case when paired_up then fp1 + fp2 else 0 end as correction_fp, case when paired_up then fn1 + fn2 else 0 end as correction_fn
from (select *, coalesce(length(expected1) < length(sequence1), false) or coalesce(length(expected2) < length(sequence2), false) as want, kept and (length(output1) < length(sequence1) or length(output2) < length(sequence2)) as got, expected1 is not null and kept as paired_up, {_bases('1')}, {_bases('2')}
  from (select *, length(output1) >= 35 and length(output2) >= 35 as kept from (select *, {_OUT.replace('sequence', 'sequence1')} as output1, {_OUT.replace('sequence', 'sequence2')} as output2 from {_PAIRS} t, range({PER_SCENARIO}))))"""


@query(_summary_sql(_PAIRED_ROWS))
def paired_truth_eval(spark, sf_dir):
    truth = E.paired_truth(spark, PER_SCENARIO)
    out = _simple(_simple(truth, "1"), "2").where("length(output1) >= 35 and length(output2) >= 35").select(E.pair_key(F.col("header1")).alias("out_key"), "output1", "output2")
    digits = [f"{m}_{k}" for m in ("retention", "trimming", "correction") for k in ("precision", "recall", "f1")]
    return rounded(E.summarise(E.scored(truth, out, paired=True)), *digits)


# --- benchmarks and history -------------------------------------------------------------------------------------------

ROUNDS = "rounds_v as (select l_orderkey as run_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice) as round_ix, l_extendedprice as wall_us, l_quantity as reads from lineitem)"
_BENCH = "bench_v as (select run_id, count(*) as rounds, avg(wall_us) as mean_us, min(wall_us) as best_us, max(wall_us) as worst_us, max(wall_us) filter (round_ix = 1) as warmup_us, avg(wall_us) filter (round_ix > 1) as steady_us, sum(reads) / sum(wall_us) * 1e6 as reads_per_s from rounds_v group by run_id)"


def rounds(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.row_number().over(order).alias("round_ix"), F.col("l_extendedprice").alias("wall_us"), F.col("l_quantity").alias("reads"))


@query(f"with {ROUNDS}, {_BENCH} select run_id, rounds, round(mean_us, 6) as mean_us, best_us, worst_us, warmup_us, round(steady_us, 6) as steady_us, round(reads_per_s, 6) as reads_per_s, round(case when steady_us > 0 then (warmup_us - steady_us) / steady_us * 100 end, 6) as warmup_penalty_pct from bench_v")
def bench_summary(spark, sf_dir):
    return rounded(H.summarise_rounds(rounds(spark, sf_dir)), "mean_us", "steady_us", "reads_per_s", "warmup_penalty_pct", digits=6)


@query(f"""with {ROUNDS}, cold_v as (select run_id, avg(wall_us) as c from rounds_v where round_ix % 2 = 1 group by run_id), reuse_v as (select run_id, avg(wall_us) as r, count(*) as rounds, max(reads) * 100 as setup from rounds_v where round_ix % 2 = 0 group by run_id)
select run_id, round(c, 6) as cold_us, round(r, 6) as reuse_us, round(r + setup / rounds, 6) as amortised_us, round(c / r, 9) as raw_speedup, round(c / (r + setup / rounds), 9) as amortised_speedup, round((c - r) / c * 100, 6) as saved_pct from cold_v join reuse_v using (run_id)""")
def bench_compare(spark, sf_dir):
    rows = rounds(spark, sf_dir)
    cold = rows.where("round_ix % 2 = 1").groupBy("run_id").agg(F.avg("wall_us").alias("mean_us"))
    reuse = rows.where("round_ix % 2 = 0").groupBy("run_id").agg(F.avg("wall_us").alias("mean_us"), F.count("*").alias("rounds"), (F.max("reads") * 100).alias("setup_us"))
    out = rounded(H.compare(cold, reuse), "cold_us", "reuse_us", "amortised_us", "saved_pct", digits=6)
    return rounded(out, "raw_speedup", "amortised_speedup")


HISTORY = """history_v as (select event_id as line_no, case when event_type in ('click', 'view') then 'benchmark' else 'benchmark_compare' end as kind, case user_id % 3 when 0 then 'cpu' when 1 then 'cuda' else 'auto' end as backend, user_id % 2 = 0 as paired,
  case when event_type = 'click' then 'cold_start' when event_type = 'view' then 'reuse_session' end as mode, case when event_id % 4 = 0 then null else 'set-' || (user_id % 5) end as label, ts as recorded_at, coalesce(value, 0) + 1 as wall_us,
  case when event_id % 3 = 0 then null else 0.5 + (event_id % 17) / 10.0 end as speedup, (event_id % 40) * 1.0 as savings_pct from events)"""
_PREVIOUS = """previous_v as (select *, lag(line_no) over w as previous_line, lag(wall_us) over w as previous_us from history_v window w as (partition by kind, backend, paired, mode order by line_no)),
status_v as (select *, (wall_us - previous_us) / previous_us * 100 as delta_pct, case when previous_us is null then 'no_baseline' when (wall_us - previous_us) / previous_us * 100 > 50 or speedup < 0.7 or savings_pct < 2 then 'alert' else 'pass' end as status from previous_v)"""
GATES = H.Gates(50, 0.7, 2)


def history(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.selectExpr(
        "event_id as line_no", "case when event_type in ('click', 'view') then 'benchmark' else 'benchmark_compare' end as kind", "case user_id % 3 when 0 then 'cpu' when 1 then 'cuda' else 'auto' end as backend", "user_id % 2 = 0 as paired",
        "case when event_type = 'click' then 'cold_start' when event_type = 'view' then 'reuse_session' end as mode", "case when event_id % 4 = 0 then null else concat('set-', user_id % 5) end as label", "ts as recorded_at", "coalesce(value, 0D) + 1 as wall_us",
        "case when event_id % 3 = 0 then null else 0.5D + (event_id % 17) / 10D end as speedup", "(event_id % 40) * 1D as savings_pct",
    )


@query(f"""with {HISTORY} select count(*) as entries, count(*) filter (kind = 'benchmark') as benchmarks, count(*) filter (kind = 'benchmark_compare') as comparisons, array_to_string(list_sort(list(distinct label) filter (label is not null)), ',') as labels,
  array_to_string(list_sort(list(distinct backend)), ',') as backends, max(recorded_at) as latest_at, round(avg(speedup), 9) as avg_speedup, max(speedup) as best_speedup, arg_max(speedup, line_no) filter (speedup is not null) as latest_speedup from history_v""")
def history_stats(spark, sf_dir):
    return rounded(H.stats(history(spark, sf_dir)), "avg_speedup")


@query(f"with {HISTORY} select line_no, kind, wall_us from history_v order by line_no desc limit 25")
def history_recent(spark, sf_dir):
    return H.recent(history(spark, sf_dir), 25).select("line_no", "kind", "wall_us")


@query(f"with {HISTORY}, {_PREVIOUS} select line_no, previous_line, previous_us, round(delta_pct, 6) as delta_pct, status from status_v")
def history_regression(spark, sf_dir):
    return rounded(H.with_previous(history(spark, sf_dir), GATES), "delta_pct", digits=6).select("line_no", "previous_line", "previous_us", "delta_pct", "status")


@query(f"with {HISTORY} select line_no, lag(line_no) over (partition by kind, backend, paired, mode order by line_no) as previous_line from history_v")
def history_prev_comparable(spark, sf_dir):
    return H.with_previous(history(spark, sf_dir), H.Gates()).select("line_no", "previous_line")


@query(f"""with {HISTORY}, {_PREVIOUS} select line_no, max(case when status = 'pass' and label like 'set-1%' then line_no end) over (partition by kind, backend, paired, mode order by line_no rows between unbounded preceding and 1 preceding) as baseline_line from status_v""")
def history_latest_pass(spark, sf_dir):
    return H.latest_passing(history(spark, sf_dir), GATES, "set-1").select("line_no", "baseline_line")


@query(f"""with {HISTORY}, cur as (select * from history_v order by line_no desc limit 1), prior as (select h.*, h.kind = c.kind and h.backend = c.backend and h.paired = c.paired and h.mode is not distinct from c.mode as same from history_v h, cur c where h.label = 'set-3' and h.line_no < c.line_no)
select line_no, wall_us, coalesce((select max(line_no) from prior where same), (select max(line_no) from prior)) as baseline_line, case when not exists (select 1 from prior) then 'no_baseline' when exists (select 1 from prior where same) then 'comparable' else 'not_comparable' end as relation from cur""")
def history_label_baseline(spark, sf_dir):
    return H.labelled_baseline(history(spark, sf_dir), label="set-3").drop("baseline_us")


# --- manifests and annotations ----------------------------------------------------------------------------------------

MANIFEST = """manifest_v as (select doc_id as ord, 'DS' || doc_id as dataset_id, case when doc_id % 3 = 0 then null else 'SRR' || (100000 + doc_id) end as accession, case lang when 'en' then 'Illumina NovaSeq 6000' when 'de' then 'MGISEQ-2000' when 'fr' then 'PromethION' else 'Sequel II' end as platform_text,
  source, case when doc_id % 7 = 0 then 0.5 end as own_alignment_rate, case when doc_id % 5 = 0 then 'baseline' when doc_id % 5 = 1 then 'fastp' end as baseline_name, case when doc_id % 4 = 0 then 'label 0 | first' end as notes from documents)"""
NOTES = """annotations_v as (select case when doc_id % 2 = 0 then ' ds' || doc_id || ' ' end as dataset_id, case when doc_id % 2 = 1 then case when doc_id % 3 <> 0 then 'srr' || (100000 + doc_id) else 'SRR9' || doc_id end end as accession,
  (quality + 1) / 4.0 as own_alignment_rate, case when toxic = 1 then 'cutadapt' end as baseline_name, 'label ' || toxic as notes from labels)"""
_TARGETS = "targets_v as (select a.*, coalesce(m1.dataset_id, m2.dataset_id) as target from annotations_v a left join manifest_v m1 on lower(trim(m1.dataset_id)) = lower(trim(a.dataset_id)) left join manifest_v m2 on lower(trim(m2.accession)) = lower(trim(a.accession)))"
_MERGED = """merged_v as (select m.dataset_id, case when m.own_alignment_rate is null then t.own_alignment_rate else m.own_alignment_rate end as own_alignment_rate, case when t.own_alignment_rate is not null and m.own_alignment_rate is null then 'filled' else 'unchanged' end as o1,
  case when t.baseline_name is not null and (m.baseline_name is null or m.baseline_name = 'baseline') then t.baseline_name else m.baseline_name end as baseline_name, case when t.baseline_name is not null and (m.baseline_name is null or m.baseline_name = 'baseline') then 'filled' else 'unchanged' end as o2,
  case when t.notes is null then m.notes when m.notes is null then t.notes when t.notes = 'label 0' then m.notes else m.notes || ' | ' || t.notes end as notes, case when t.notes is null then 'unchanged' when m.notes is null then 'filled' when t.notes = 'label 0' then 'unchanged' else 'appended' end as o3
  from manifest_v m left join targets_v t on t.target = m.dataset_id)"""
MERGED_COLUMNS = ["own_alignment_rate", "baseline_name", "notes"]


def manifest(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id as at", "concat('DS', doc_id) as dataset_id", "case when doc_id % 3 = 0 then null else concat('SRR', 100000 + doc_id) end as accession", "case lang when 'en' then 'Illumina NovaSeq 6000' when 'de' then 'MGISEQ-2000' when 'fr' then 'PromethION' else 'Sequel II' end as platform_text",
        "source", "case when doc_id % 7 = 0 then 0.5D end as own_alignment_rate", "case when doc_id % 5 = 0 then 'baseline' when doc_id % 5 = 1 then 'fastp' end as baseline_name", "case when doc_id % 4 = 0 then 'label 0 | first' end as notes",
    )


def annotations(spark, sf_dir):
    return table(spark, sf_dir, "labels").selectExpr(
        "case when doc_id % 2 = 0 then concat(' ds', doc_id, ' ') end as dataset_id", "case when doc_id % 2 = 1 then case when doc_id % 3 <> 0 then concat('srr', 100000 + doc_id) else concat('SRR9', doc_id) end end as accession",
        "(quality + 1) / 4D as own_alignment_rate", "case when toxic = 1 then 'cutadapt' end as baseline_name", "concat('label ', toxic) as notes",
    )


@query(f"with {MANIFEST}, {NOTES}, {_TARGETS}, {_MERGED} select dataset_id, own_alignment_rate, baseline_name, notes, o1 || ',' || o2 || ',' || o3 as outcomes from merged_v")
def annotate_merge(spark, sf_dir):
    out = M.annotate(manifest(spark, sf_dir), annotations(spark, sf_dir), MERGED_COLUMNS)
    return out.select("dataset_id", *MERGED_COLUMNS, F.array_join("outcomes", ",").alias("outcomes"))


@query(f"with {MANIFEST}, {NOTES}, {_TARGETS} select accession, notes from targets_v where target is null")
def annotate_unmatched(spark, sf_dir):
    return M.unmatched(M.target(manifest(spark, sf_dir), annotations(spark, sf_dir))).select("accession", "notes")


@query(f"with {MANIFEST}, {NOTES}, {_TARGETS} select target, count(*) as n from targets_v where target is not null group by target having count(*) > 1")
def annotate_repeated(spark, sf_dir):
    return M.repeated(M.target(manifest(spark, sf_dir), annotations(spark, sf_dir)))


@query(f"with {MANIFEST}, {NOTES}, {_TARGETS}, {_MERGED} select count(*) as datasets, sum((o1 = 'filled')::int + (o2 = 'filled')::int + (o3 = 'filled')::int)::bigint as filled, 0::bigint as overwritten, sum((o3 = 'appended')::int)::bigint as appended, count(*) filter (o1 <> 'unchanged' or o2 <> 'unchanged' or o3 <> 'unchanged') as changed from merged_v")
def annotate_summary(spark, sf_dir):
    return M.outcome_counts(M.annotate(manifest(spark, sf_dir), annotations(spark, sf_dir), MERGED_COLUMNS))


@query(f"with {MANIFEST} select count(*) as datasets, count(accession) as with_accession, count(own_alignment_rate) as with_own_alignment_rate, count(baseline_name) as with_baseline_name, count(notes) as with_notes from manifest_v")
def manifest_summary(spark, sf_dir):
    return M.coverage(manifest(spark, sf_dir), ["accession", "own_alignment_rate", "baseline_name", "notes"])


RECORDS = "records_v as (select ord, source as dataset_id, case when ord % 5 = 0 then baseline_name end as baseline_name, case when ord % 7 = 0 then own_alignment_rate end as own_alignment_rate, platform_text as expected_platform, case when ord % 20 < 4 then 'note ' || (ord % 4) end as notes from manifest_v)"


def records(spark, sf_dir):
    return manifest(spark, sf_dir).selectExpr("at", "source as dataset_id", "case when at % 5 = 0 then baseline_name end as baseline_name", "case when at % 7 = 0 then own_alignment_rate end as own_alignment_rate", "platform_text as expected_platform", "case when at % 20 < 4 then concat('note ', at % 4) end as notes")


@query(f"""with {MANIFEST}, {RECORDS} select dataset_id, max(own_alignment_rate) as own_alignment_rate, arg_min(expected_platform, ord) as expected_platform, coalesce(arg_min(baseline_name, ord) filter (baseline_name <> 'baseline'), max(baseline_name)) as baseline_name,
  (select string_agg(n, ' | ' order by a) from (select notes as n, min(ord) as a from records_v r2 where r2.dataset_id is not distinct from r.dataset_id and notes is not null group by notes)) as notes,
  (count(distinct own_alignment_rate) > 1)::int + (count(distinct expected_platform) > 1)::int + (count(distinct baseline_name) filter (baseline_name <> 'baseline') > 1)::int as conflicts from records_v r group by dataset_id""")
def ingest_merge(spark, sf_dir):
    return M.merge_records(records(spark, sf_dir), "dataset_id", ["own_alignment_rate", "expected_platform", "baseline_name", "notes"], strict=False)


# --- text ------------------------------------------------------------------------------------------------------------

_PLATFORM_SQL = " ".join(f"when regexp_matches(n, '{'|'.join(w)}') then '{p}'" for p, w in X.PLATFORM_WORDS.items())


@query(f"with {MANIFEST} select dataset_id, case when n in ('illumina', 'mgi', 'ont', 'pacbio') then null {_PLATFORM_SQL} end as platform from (select dataset_id, lower(regexp_replace(platform_text, '[^0-9A-Za-z]', '', 'g')) as n from manifest_v)")
def platform_from_text(spark, sf_dir):
    return manifest(spark, sf_dir).select("dataset_id", X.platform(F.array("platform_text")).alias("platform"))


TEXTS = [(1, "runs SRR123, err77;SRP5 and gse900x, PRJNA12/srr123"), (2, "nothing here: SRR, xSRR5"), (3, "GSM4-GSE5 ERX6"), (4, ""), (5, "DRR9_DRR9 prjeb44")]


@query(f"select id, array_to_string(list_transform(l, lambda x: x.t), ',') as accessions from (select id, list_sort(list({{'a': a, 't': t}})) as l from (select id, t, min(pos) as a from (select id, unnest(string_split_regex(upper(txt), '[^A-Z0-9]+')) as t, generate_subscripts(string_split_regex(upper(txt), '[^A-Z0-9]+'), 1) as pos from {values(TEXTS, 'id, txt')}) where regexp_matches(t, '{X.ACCESSION}') group by id, t) group by id)")
def accession_tokens(spark, sf_dir):
    found = spark.createDataFrame(TEXTS, "id int, txt string").select("id", X.accessions(F.col("txt")).alias("a"))
    return found.where(F.size("a") > 0).select("id", F.array_join("a", ",").alias("accessions"))


FILES = [("in/wgs/ERR300001.fastq",), ("in/sc/SRR200001_R1.fastq.gz",), ("in/sc/SRR200001_R2.fastq.gz",), ("in/README.txt",), ("in/x/a_1.fq",), ("in/x/a_2.fq",), ("in/x/b-r1.fastq",), ("in/x/b_R1_001.FASTQ.GZ",), ("in/x/b_R2_001.fastq.gz",), ("in/x/_1.fq",)]
_STEM = r"regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(?i)\.(fastq|fq)(\.gz)?$', '')"
_MATES = f"select path, regexp_extract(path, '^(.*)/[^/]*$', 1) as folder, case when regexp_matches(s, '{X.MATE}') then regexp_extract(s, '{X.MATE}', 1) else s end as stem, case when regexp_matches(s, '{X.MATE}') then regexp_extract(regexp_replace(regexp_extract(s, '{X.MATE}', 2), '_001$', ''), '([12])$', 1)::int end as mate from (select path, {_STEM} as s from {values(FILES, 'path')} where regexp_matches(path, '(?i)\\.(fastq|fq)(\\.gz)?$'))"


@query(f"select path, stem, mate from ({_MATES})")
def mate_signature(spark, sf_dir):
    stem = X.fastq_stem(F.col("path"))
    return spark.createDataFrame(FILES, "path string").where(F.col("path").rlike(r"(?i)\.(fastq|fq)(\.gz)?$")).select("path", X.mate_base(stem).alias("stem"), X.mate_number(stem).alias("mate"))


@query(f"select folder, stem, i1 as input1, case when i2 <> i1 then i2 end as input2, files from (select folder, stem, coalesce(min(path) filter (mate = 1), min(path) filter (mate is null), min(path)) as i1, min(path) filter (mate = 2) as i2, count(*) as files from ({_MATES}) group by folder, stem)")
def discover_groups(spark, sf_dir):
    return M.group_files(spark.createDataFrame(FILES, "path string"))


RESULTS = [("wgs_case.fastp.json",), ("sc-case_flagstat.txt",), ("quast_report.tsv",), ("a.b.summary.csv",), ("plain",), ("x_duplication_metrics.txt",), ("case.baseline_metrics.tsv",)]
_TAIL = X.RESULT_TAIL


@query(f"select name, case when regexp_matches(name, '{_TAIL}') then regexp_extract(name, '{_TAIL}', 1) else name end as stripped from {values(RESULTS, 'name')}")
def result_names(spark, sf_dir):
    return spark.createDataFrame(RESULTS, "name string").select("name", X.strip_result(F.col("name")).alias("stripped"))


LIBRARIES = [(1, "Chromium 10x v2 library", "Illumina"), (2, "10x 3prime", None), (3, "ATAC of mRNA", None), (4, "Transcriptome", "ONT"), (5, "whole genome", None), (6, "amplicon", "PacBio"), (7, "amplicon", None), (8, "10x Version3", None)]


@query(f"""select id, case when n like '%10x%' and regexp_matches(n, 'v2|version2') then '10x v2' when n like '%10x%' and regexp_matches(n, 'v3|version3|3prime') then '10x v3' when n like '%atac%' then 'ATAC-seq' when regexp_matches(n, 'rnaseq|transcriptome|mrna') then 'RNA-seq'
  when regexp_matches(n, 'wgs|wholegenome|genome') then 'WGS' when n like '%longread%' then 'Long Read' when platform in ('ONT', 'PacBio') then 'Long Read' end as experiment from (select id, platform, lower(regexp_replace(txt, '[^0-9A-Za-z]', '', 'g')) as n from {values(LIBRARIES, 'id, txt, platform')})""")
def experiment_from_text(spark, sf_dir):
    return spark.createDataFrame(LIBRARIES, "id int, txt string, platform string").select("id", X.experiment(F.array("txt"), F.col("platform")).alias("experiment"))


@query("select doc_id, case when lang = source then lang else lang || ' | ' || source end as citation from documents")
def citation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.citation(F.array(F.concat(F.lit(" "), "lang"), "source", "lang", F.lit(""))).alias("citation"))


# --- reports ---------------------------------------------------------------------------------------------------------

REPORTS = {
    "fastp": [("a/x.fastp.json", '{"summary": {"before_filtering": {"total_reads": 1000}, "after_filtering": {"total_reads": 920}}, "adapter_cutting": {"adapter_trimmed_reads": 180}}'), ("b.json", '{"summary": {"before_filtering": {"total_reads": 50}}, "filtering_result": {"passed_filter_reads": 40}, "adapter_cutting": {"adapter_trimmed_reads": 60}}')],
    "flagstat": [("a.flagstat", "2346 + 0 in total (QC-passed reads + QC-failed reads)\n31 + 0 secondary\n2211 + 0 mapped (94.25% : N/A)\n2180 + 0 primary mapped (94.17% : N/A)"), ("b.flagstat", "10 + 10 in total (x)\n4 + 1 mapped (25.00% : N/A)")],
    "quast": [("a/report.tsv", "Assembly\town_asm\tother\n# contigs\t3\t4\nN50\t38211\t-"), ("b/report.tsv", "Assembly\tassembly\nN50\t17,340")],
    "picard": [("a.txt", "## METRICS CLASS\nLIBRARY\tUNPAIRED_READS_EXAMINED\tREAD_PAIRS_EXAMINED\tUNPAIRED_READ_DUPLICATES\tREAD_PAIR_DUPLICATES\tPERCENT_DUPLICATION\nlib1\t0\t500\t0\t87\t0.174000"), ("b.txt", "LIBRARY\tUNPAIRED_READS_EXAMINED\tREAD_PAIRS_EXAMINED\tUNPAIRED_READ_DUPLICATES\tREAD_PAIR_DUPLICATES\tPERCENT_DUPLICATION\nlib1\t100\t50\t10\t5\t-")],
    "mosdepth": [("a.summary", "chrom\tlength\tbases\tmean\tmin\tmax\nchr1\t1000\t27000\t27.0\t0\t60\nchr2\t500\t11750\t23.5\t0\t50\ntotal\t1500\t38750\t25.8\t0\t60"), ("b.summary", "chrom\tlength\tbases\tmean\nchr1\t1000\t27000\t27.0\nchr2\t500\t11750\t23.5")],
    "samtools_coverage": [("a.cov", "#rname\tstartpos\tendpos\tnumreads\tcovbases\tcoverage\tmeandepth\nchr1\t1\t1000\t9\t900\t90.0\t17\ntotal\t1\t1500\t20\t1290\t86.0\t21.5"), ("b.cov", "#rname\tstartpos\tendpos\tnumreads\tcovbases\tcoverage\tmeandepth\nchr1\t1\t1000\t9\t900\t90.0\t17\nchr2\t1\t500\t9\t700\t99.0\t20")],
    "happy": [("a.csv", "Type,Filter,METRIC.Recall,METRIC.Precision,METRIC.F1_Score\nSNP,PASS,0.99,0.99,0.971250\nALL,PASS,0.99,0.99,0.961300"), ("b.csv", "Type,Filter,METRIC.Recall,METRIC.Precision,METRIC.F1_Score\nSNP,PASS,0.9,0.8,-\nINDEL,PASS,0.5,0.5,0.5\nSNP,ALL,0.9,0.8,0.1")],
    "vcfeval": [("a.txt", "Threshold  True-pos-baseline  True-pos-call  False-pos  False-neg  Precision  Sensitivity  F-measure\n----------------------------------------------------\n3.000 970 970 10 30 0.95 0.93 0.940\nNone 951 951 49 49 0.951 0.951 0.951")],
}


def reports(spark, name: str) -> DataFrame:
    return spark.createDataFrame(REPORTS[name], "path string, content string")


def _report_rows(name: str) -> str:
    return f"(select * from (values {', '.join('(' + quoted(p) + ', ' + quoted(c).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39)) + ')' for p, c in REPORTS[name])}) r(path, content))"


def _table_sql(name: str, header: str, mark: str) -> str:
    """cells of a report's table under its header, by list position."""
    return f"""lines_v as (select path, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as pos from {_report_rows(name)}),
head_v as (select path, min(pos) as head, arg_min(line, pos) as h from lines_v where {header} group by path),
rows_v as (select l.path, l.pos, list_transform(string_split_regex(trim(regexp_replace(h, '^#+', '')), '{mark}'), lambda x: lower(regexp_replace(x, '[^0-9A-Za-z]', '', 'g'))) as names, string_split_regex(trim(line), '{mark}') as cells from lines_v l join head_v using (path) where l.pos > head and line <> '')"""


def _cell(name: str) -> str:
    return f"cells[list_position(names, '{name}')]"


def _number(name: str) -> str:
    return f"try_cast(regexp_replace({_cell(name)}, '[%,]', '', 'g') as double)"


def _fraction(x: str) -> str:
    return f"case when {x} > 1 and {x} <= 100 then {x} / 100 else greatest(0.0, least(1.0, {x})) end"


@query(f"select path, greatest(0.0, least(1.0, t / b)) as trimmed_read_fraction, greatest(0.0, least(1.0, (b - a) / b)) as discarded_read_fraction from (select path, (content->>'$.adapter_cutting.adapter_trimmed_reads')::double as t, (content->>'$.summary.before_filtering.total_reads')::double as b, coalesce(content->>'$.summary.after_filtering.total_reads', content->>'$.filtering_result.passed_filter_reads')::double as a from {_report_rows('fastp')})")
def fastp(spark, sf_dir):
    return R.fastp(reports(spark, "fastp"))


_FLAG = lambda word, i: f"try_cast(regexp_extract(content, '(?m)^(\\d+) \\+ (\\d+) {word}', {i}) as double)"


@query(f"select path, ({_FLAG('mapped [(]', 1)} + {_FLAG('mapped [(]', 2)}) / ({_FLAG('in total', 1)} + {_FLAG('in total', 2)}) as alignment_rate from {_report_rows('flagstat')}")
def flagstat(spark, sf_dir):
    return R.flagstat(reports(spark, "flagstat"))


@query(f"select path, label, assembly_n50 from (select a.path, unnest(string_split(a.line, chr(9))) as label, try_cast(replace(unnest(string_split(n.line, chr(9))), ',', '') as double) as assembly_n50 from (select path, unnest(string_split(content, chr(10))) as line from {_report_rows('quast')}) a join (select path, unnest(string_split(content, chr(10))) as line from {_report_rows('quast')}) n using (path) where a.line like 'Assembly%' and n.line like 'N50%') where assembly_n50 is not null and label <> 'Assembly'")
def quast(spark, sf_dir):
    return R.quast(reports(spark, "quast"))


_DUP = f"(coalesce({_number('unpairedreadduplicates')}, 0) + 2 * coalesce({_number('readpairduplicates')}, 0)) / (coalesce({_number('unpairedreadsexamined')}, 0) + 2 * coalesce({_number('readpairsexamined')}, 0))"


@query(f"with {_table_sql('picard', 'line like ' + quoted('LIBRARY%'), chr(92) + 't')} select path, case when {_number('percentduplication')} is not null then {_fraction(_number('percentduplication'))} else greatest(0.0, least(1.0, {_DUP})) end as duplicate_rate from rows_v")
def picard(spark, sf_dir):
    return R.picard(reports(spark, "picard"))


@query(f"with {_table_sql('mosdepth', 'line like ' + quoted('chrom%'), chr(92) + 't')} select path, coalesce(max({_number('mean')}) filter ({_cell('chrom')} = 'total'), sum({_number('mean')} * {_number('length')}) / sum({_number('length')})) as mean_coverage from rows_v group by path")
def mosdepth(spark, sf_dir):
    return R.mosdepth(reports(spark, "mosdepth"))


_LEN = f"({_number('endpos')} - {_number('startpos')} + 1)"


@query(f"""with {_table_sql('samtools_coverage', 'line like ' + quoted('#rname%'), chr(92) + 't')} select path, coalesce(max({_number('meandepth')}) filter ({_cell('rname')} = 'total'), sum({_number('meandepth')} * {_LEN}) / sum({_LEN})) as mean_coverage,
  coalesce(max({_number('coverage')} / 100) filter ({_cell('rname')} = 'total'), sum(least({_number('covbases')}, {_LEN})) / sum({_LEN})) as coverage_breadth from rows_v group by path""")
def samtools_coverage(spark, sf_dir):
    return R.samtools_coverage(reports(spark, "samtools_coverage"))


@query(f"with {_table_sql('happy', 'line like ' + quoted('Type%'), ',')}, f1_v as (select path, case when {_cell('type')} = 'ALL' then 0 when {_cell('filter')} in ('PASS', 'ALL') then 2 else 3 end as rank, coalesce({_number('metricf1score')}, 2 * {_number('metricprecision')} * {_number('metricrecall')} / ({_number('metricprecision')} + {_number('metricrecall')})) as f from rows_v) select path, max(f) as variant_f1 from f1_v f where rank = (select min(rank) from f1_v g where g.path = f.path) group by path")
def happy(spark, sf_dir):
    return R.happy(reports(spark, "happy"))


@query(f"with {_table_sql('vcfeval', 'line like ' + quoted('Threshold%'), chr(92) + 's+')} select path, max({_number('fmeasure')}) as variant_f1 from rows_v where cells[1] not like '---%' group by path")
def vcfeval(spark, sf_dir):
    return R.vcfeval(reports(spark, "vcfeval"))


@query()
def native_reports(spark, sf_dir):
    every = spark.createDataFrame([r for name in REPORTS for r in [(f"{name}/{p}", c) for p, c in REPORTS[name]]], "path string, content string")
    return R.read_all(every)


# --- metadata and study ----------------------------------------------------------------------------------------------

RUNS = [("SRR1", "SRP10", "SRX5", "SAMN1;SRS7", "PRJNA3"), ("SRR2", "SRP10", None, None, "PRJNA3"), ("ERR3", "ERP1", "ERX1", "ERS1", None), ("DRR4", None, None, None, None)]
ASKED = [(1, "prjna3"), (2, "SRR2"), (3, "ERS1"), (4, "SRR404"), (5, "GSE9")]
RESOLVED = [("GSE9", "SRP10"), ("GSE9", "ERR3")]
_RUN_NAMES = "run_accession, study_accession, experiment_accession, sample_accession, bioproject"
_MATCHES = f"select run_accession, string_agg(a, ';' order by ord) as query_accessions, min(ord) as first_at from (select distinct run_accession, upper(q.accession) as a, q.ord from {values(RUNS, _RUN_NAMES, 'r')} m, {values(ASKED, 'ord, accession', 'q')} q where list_contains(string_split_regex(upper(concat_ws(' ', {_RUN_NAMES})), '[^A-Z0-9]+'), upper(q.accession))) group by run_accession"


def _runs(spark):
    return spark.createDataFrame(RUNS, ", ".join(f"{n} string" for n in _RUN_NAMES.split(", ")))


def _asked(spark):
    return spark.createDataFrame(ASKED, "at int, accession string")


@query(_MATCHES)
def metadata_match(spark, sf_dir):
    return M.match_metadata(_runs(spark), _asked(spark))


@query(f"select accession, min(ord) as first_at, string_agg(requested, ';' order by ord) as requested from (select upper(accession) as accession, accession as requested, ord from {values(ASKED, 'ord, accession', 'q')} union all select upper(r.accession), q.accession, q.ord from {values(ASKED, 'ord, accession', 'q')} q join {values(RESOLVED, 'geo, accession', 'r')} r on upper(q.accession) = upper(r.geo)) group by accession")
def metadata_expand(spark, sf_dir):
    return M.expand_requests(_asked(spark), spark.createDataFrame(RESOLVED, "geo string, accession string"))


@query(f"select upper(q.accession) as accession, case when count(m.run_accession) > 0 then 'matched' when upper(q.accession) = 'SRR404' then 'fetch_failed' else 'unmatched' end as status, count(m.run_accession) as matched_run_rows from {values(ASKED, 'ord, accession', 'q')} q left join ({_MATCHES}) m on list_contains(string_split(m.query_accessions, ';'), upper(q.accession)) group by 1")
def metadata_status(spark, sf_dir):
    return M.fetch_status(_asked(spark), M.match_metadata(_runs(spark), _asked(spark)), spark.createDataFrame([("srr404",), ("SRR2",)], "accession string"))


_COMPARED = "select 'L' || l_orderkey || '-' || l_linenumber || '-' || l_partkey as dataset_id, l_extendedprice as input_bases_per_sec, l_discount as trimmed_read_fraction, l_tax as discarded_read_fraction, l_quantity as corrected_bases_per_mbase, nullif(l_quantity, 10) * 500 as baseline_input_bases_per_sec, 0.05 as baseline_trimmed_read_fraction, case when l_linenumber > 1 then 0.02 end as baseline_discarded_read_fraction, 20.0 as baseline_corrected_bases_per_mbase, l_returnflag as platform, case l_linestatus when 'O' then 'N' when 'F' then 'R' end as expected_platform, l_quantity as own_mean_coverage, case when l_quantity > 25 then l_quantity - 26 end as baseline_mean_coverage from lineitem"


def _datasets(spark, sf_dir):
    null = "cast(null as double)"
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('L', l_orderkey, '-', l_linenumber, '-', l_partkey) as dataset_id", "l_extendedprice as input_bases_per_sec", "l_discount as trimmed_read_fraction", "l_tax as discarded_read_fraction", "l_quantity as corrected_bases_per_mbase",
        "nullif(l_quantity, 10D) * 500 as baseline_input_bases_per_sec", "0.05D as baseline_trimmed_read_fraction", "case when l_linenumber > 1 then 0.02D end as baseline_discarded_read_fraction", "20D as baseline_corrected_bases_per_mbase",
        "l_returnflag as platform", "case l_linestatus when 'O' then 'N' when 'F' then 'R' end as expected_platform", "l_returnflag as experiment", "cast(null as string) as expected_experiment", "l_shipdate is not null as has", "'x' as baseline_name",
        "l_quantity as own_mean_coverage", "case when l_quantity > 25 then l_quantity - 26 end as baseline_mean_coverage", *(f"{null} as {s}_{m}" for s in ("own", "baseline") for m in ("alignment_rate", "duplicate_rate", "variant_f1", "coverage_breadth", "assembly_n50")),
    )


@query(f"select dataset_id, round(case when input_bases_per_sec > 0 and baseline_input_bases_per_sec > 0 then input_bases_per_sec / baseline_input_bases_per_sec end, 9) as input_speedup, round(trimmed_read_fraction - baseline_trimmed_read_fraction, 9) as trimmed_read_fraction_delta, round(discarded_read_fraction - baseline_discarded_read_fraction, 9) as discarded_read_fraction_delta, corrected_bases_per_mbase - baseline_corrected_bases_per_mbase as corrected_bases_per_mbase_delta, round(own_mean_coverage / nullif(baseline_mean_coverage, 0), 9) as mean_coverage_ratio from ({_COMPARED})")
def study_comparison(spark, sf_dir):
    out = M.compare(_datasets(spark, sf_dir)).select("dataset_id", "input_speedup", "trimmed_read_fraction_delta", "discarded_read_fraction_delta", "corrected_bases_per_mbase_delta", "mean_coverage_ratio")
    return rounded(out, "input_speedup", "trimmed_read_fraction_delta", "discarded_read_fraction_delta", "mean_coverage_ratio")


@query(f"select count(*) as datasets, round(avg(input_bases_per_sec), 6) as mean_input_bases_per_sec, round(avg(trimmed_read_fraction), 9) as mean_trimmed_read_fraction, count(*) filter (platform = expected_platform) / count(expected_platform) as platform_accuracy, count(case when baseline_input_bases_per_sec > 0 then 1 end) as compared, round(avg(case when baseline_input_bases_per_sec > 0 then input_bases_per_sec / baseline_input_bases_per_sec end), 9) as mean_input_speedup from ({_COMPARED})")
def study_aggregate(spark, sf_dir):
    out = M.aggregate(M.compare(_datasets(spark, sf_dir))).select("datasets", "mean_input_bases_per_sec", "mean_trimmed_read_fraction", "platform_accuracy", "compared", "mean_input_speedup")
    return rounded(rounded(out, "mean_trimmed_read_fraction", "mean_input_speedup"), "mean_input_bases_per_sec", digits=6)


# --- accession manifests ----------------------------------------------------------------------------------------------

REQUESTS = [(1, "SRR5", None, "SRP1"), (2, None, "GSE7 GSM8", "SRP1"), (3, None, None, "SRP2/SRR5"), (4, "", "", "")]
_REQUEST_NAMES = "run_accession, geo_accession, study_accession"


@query(f"""with w as (select id, case when regexp_matches(run_accession, '[A-Z]+[0-9]') then run_accession when regexp_matches(study_accession, '[A-Z]+[0-9]') then study_accession else geo_accession end as t from {values(REQUESTS, 'id, ' + _REQUEST_NAMES)}),
k as (select id, unnest(string_split_regex(upper(t), '[^A-Z0-9]+')) as accession, generate_subscripts(string_split_regex(upper(t), '[^A-Z0-9]+'), 1) as nth from w where t is not null),
f as (select accession, min(id * 1000 + nth) as f from k where regexp_matches(accession, '{X.ACCESSION}') group by accession) select row_number() over (order by f)::int as "at", accession from f""")
def requested_accessions(spark, sf_dir):
    return M.requested(spark.createDataFrame(REQUESTS, "at int, run_accession string, geo_accession string, study_accession string"), _REQUEST_NAMES.split(", "))


PUBLIC = [("SRR1", "PAIRED", "h/x/SRR1_2.fastq.gz;h/x/SRR1_1.fastq.gz", "ILLUMINA", "RNA-Seq", "SRP1", "A study"), ("SRR2", "SINGLE", "h/y/reads.fq.gz", "OXFORD_NANOPORE", "WGS", "SRP1", "SRP1"), ("SRR3", "PAIRED", "a;b;c", "PACBIO_SMRT", "other", None, None), ("SRR4", None, "", "DNBSEQ", "ATAC-seq", "", "T")]


@query()
def accession_manifest(spark, sf_dir):
    names = ["run_accession", "library_layout", "fastq_ftp", "instrument_platform", "library_strategy", "study_accession", "study_title"]
    df = spark.createDataFrame(PUBLIC, ", ".join(f"{n} string" for n in names))
    for c in ("submitted_ftp", "instrument_model", "library_source", "library_selection", "experiment_title", "sample_title"):
        df = df.withColumn(c, F.lit("").cast("string"))
    return M.from_metadata(df, "root")


@query()
def backend_parity(spark, sf_dir):
    """Both modes of correction on the same reads."""
    truth = E.single_truth(spark, PER_SCENARIO)
    plan, rows = Plan(15, 20, 4, 35, [("illumina-short", E.ADAPTER, 3 * PER_SCENARIO)]), truth.drop("scenario", "expected")
    done = [keep(mode(rows, plan, parity=True), plan) for mode in (prepare, prepare_accelerated)]
    a, b = (E.summarise(E.scored(truth, E.last_by(x, F.col("header"), "read_ix"))) for x in done)
    return E.parity(a, b)


@query()
def truth_correction(spark, sf_dir):
    """The truth scenarios, corrected."""
    truth = E.single_truth(spark, PER_SCENARIO)
    plan = Plan(15, 20, 4, 35, [("illumina-short", E.ADAPTER, 3 * PER_SCENARIO)])
    out = keep(prepare(truth.drop("scenario", "expected"), plan, parity=True), plan)
    digits = [f"{m}_{k}" for m in ("retention", "trimming", "correction") for k in ("precision", "recall", "f1")]
    return rounded(E.summarise(E.scored(truth, E.last_by(out, F.col("header"), "read_ix"))), *digits)


_FETCHED = "select 'R' || o_custkey as run_accession, o_orderkey as \"at\", case when o_orderkey % 3 = 0 then '' else 'C' || o_custkey end as study_accession, 'P' || (o_custkey % 7) as platform, 'Q' || (o_orderkey % 5) || ';Q' || (o_custkey % 3) as query_accessions from orders"


@query(f"""with f as ({_FETCHED}), q as (select run_accession, unnest(string_split(query_accessions, ';')) as q from f)
select f.run_accession, max(nullif(study_accession, '')) as study_accession, max(platform) as platform, any_value(n.qs) as queries, 0 as conflicts from f join (select run_accession, string_agg(distinct q, ';' order by q) as qs from q group by 1) n using (run_accession) group by f.run_accession""")
def metadata_merge(spark, sf_dir):
    """Fetched rows of a run as one; what they were asked by is sorted here, as SQL has no order of first mention."""
    rows = table(spark, sf_dir, "orders").selectExpr("concat('R', o_custkey) as run_accession", "o_orderkey as at", "case when o_orderkey % 3 = 0 then '' else concat('C', o_custkey) end as study_accession", "concat('P', o_custkey % 7) as platform", "concat('Q', o_orderkey % 5, ';Q', o_custkey % 3) as query_accessions")
    out = M.merge_fetched(rows, ["study_accession", "platform"])
    return out.select("run_accession", "study_accession", "platform", F.array_join(F.array_sort(F.split("query_accessions", ";")), ";").alias("queries"), "conflicts")


@query("""with s as (select 'A' || o_orderkey as accession, case o_orderstatus when 'F' then 'matched' when 'O' then 'unmatched' else 'fetch_failed' end as status, o_custkey from orders),
n as (select distinct 'A' || (c_custkey * 4 + i) as accession from customer, (values (0), (1)) v(i))
select accession from s where status = 'unmatched' or (status = 'matched' and accession in (select accession from n))""")
def metadata_resume(spark, sf_dir):
    """Requests that needn't be asked again."""
    statuses = table(spark, sf_dir, "orders").selectExpr("concat('A', o_orderkey) as accession", "case o_orderstatus when 'F' then 'matched' when 'O' then 'unmatched' else 'fetch_failed' end as status")
    rows = table(spark, sf_dir, "customer").selectExpr("concat('A', c_custkey * 4, ';A', c_custkey * 4 + 1) as query_accessions")
    return M.resumable(statuses, rows)
