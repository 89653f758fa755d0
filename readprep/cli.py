"""Command line: python -m readprep.cli COMMAND ... ; every command prints a summary, or JSON with --json."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

FAILED = 2


def session(name: str):
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readprep", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *inputs: str, **options):
        c = sub.add_parser(name)
        for i in inputs:
            c.add_argument(i)
        for k, v in options.items():
            flag = "--" + k.replace("_", "-")
            c.add_argument(flag, action="store_true") if v is False else c.add_argument(flag, default=v, type=type(v) if v is not None else str)
        c.add_argument("--json", action="store_true")
        return c

    reads = {"input2": None, "sample": 100_000, "adapter": None, "min_quality": None, "kmer_size": None}
    add("detect", "input", platform=None, experiment=None, **reads)
    add("process", "input", "output", output2=None, history=None, label=None, **reads)
    add("benchmark", "input", rounds=3, mode="cold_start", history=None, label=None, **reads)
    add("benchmark-compare", "input", rounds=3, history=None, label=None, **reads)
    add("evaluate", reads_per_scenario=12, paired=False)
    add("paper-artifacts", "output", reads_per_scenario=12)
    add("publication-bundle", "manifest", "output", annotations=None, reads_per_scenario=12)
    add("study-artifacts", "manifest", "output")
    add("study-manifest", "inventory", "output", root="reads")
    add("study-fetch-metadata", "accessions", "output", url="https://www.ebi.ac.uk/ena/portal/api/filereport", cache=None, chunk=200, retries=2, geo_url="https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi", resume=False)
    add("study-download", "inventory", "output", manifest=None, retries=2, overwrite=False)
    add("study-discover", "input", "output", flat=False)
    add("study-annotate", "manifest", "annotations", "output", overwrite=False)
    add("study-ingest", "manifest", "results", "output", overwrite=False)
    add("history-report", "history", limit=10, baseline_label=None, label_prefix=None, latest_pass=False, max_wall_pct=None, min_speedup=None, min_savings_pct=None, fail_on_status=None)
    return p


def _plan(args, reads):
    from readprep.operators.profile import plan_of

    number = lambda x: int(x) if x is not None else None
    return plan_of(reads, int(args.sample), args.adapter, number(args.min_quality), number(args.kmer_size), getattr(args, "platform", None), getattr(args, "experiment", None))


def _read(spark, path):
    from readprep.sources import fastq

    return fastq.read(spark, path)


def detect(spark, args) -> dict:
    from readprep.operators import profile as P

    reads = _read(spark, args.input)
    sample = P.head(reads, int(args.sample)).persist()
    plan = _plan(args, reads)
    return {"profile": P.auto_profile(sample).first().asDict(), "plan": vars(plan), "paired": bool(args.input2)}


def process(spark, args) -> dict:
    from pyspark.sql import functions as F

    from readprep.operators import pipeline as L
    from readprep.sources import fastq

    first = _read(spark, args.input)
    plan = _plan(args, first)
    if args.input2:
        pairs = L.prepare_pairs(first, _read(spark, args.input2), plan, int(args.sample)).persist()
        kept = pairs.where((F.length("sequence1") >= plan.min_length) & (F.length("sequence2") >= plan.min_length))
        fastq.write_pairs(kept, args.output, args.output2 or args.output + ".mates")
        total = pairs.count()
        return {"input_pairs": total, "output_pairs": kept.count(), "plan": vars(plan)}
    done = L.prepare(first, plan, int(args.sample)).persist()
    fastq.write(L.keep(done, plan), args.output)
    return L.report(done, plan).first().asDict() | {"plan": vars(plan)}


def _rounds(spark, args, reuse: bool) -> list[dict]:
    from readprep.operators import pipeline as L

    reads = _read(spark, args.input)
    return L.benchmark(reads, int(args.rounds), reuse, _plan(args, reads), int(args.sample))


def _mean(rounds: list[dict]) -> float:
    return sum(r["wall_s"] for r in rounds) / len(rounds) * 1e6


def _log(args, entry: dict) -> None:
    from readprep.sources import history_log

    if args.history:
        common = {"history_version": 1, "tool_version": "1", "recorded_at_unix_ms": int(time.time() * 1000), "label": args.label, "input1": args.input, "input2": args.input2, "paired_end": bool(args.input2), "requested_backend": "spark", "sample_size": int(args.sample), "rounds": int(args.rounds)}
        history_log.append(args.history, common | entry)


def benchmark(spark, args) -> dict:
    rounds = _rounds(spark, args, args.mode == "reuse_session")
    later = rounds[1:]
    steady = _mean(later) if later else None
    summary = {"wall_us": _mean(rounds), "reads_per_s": rounds[0]["reads"] * 1e6 / _mean(rounds), "bases_per_s": rounds[0]["bases"] * 1e6 / _mean(rounds)}
    _log(args, {"kind": "benchmark", "session_mode": args.mode, "summary": summary})
    return {"rounds": rounds, **summary, "warmup_penalty_pct": (rounds[0]["wall_s"] * 1e6 - steady) / steady * 100 if steady else None}


def benchmark_compare(spark, args) -> dict:
    cold, reuse = _rounds(spark, args, False), _rounds(spark, args, True)
    setup = sum(r["setup_s"] for r in reuse) * 1e6
    a, b = _mean(cold), _mean(reuse)
    summary = {"wall_us": b, "speedup": a / b, "savings_pct": (a - b) / a * 100}
    _log(args, {"kind": "benchmark_compare", "cold_start_mode": "cold_start", "reuse_session_mode": "reuse_session", "summary": summary})
    return {"cold_us": a, "reuse_us": b, "amortised_us": b + setup / len(reuse), **summary}


def evaluate(spark, args) -> dict:
    from pyspark.sql import functions as F

    from readprep.functions import pair_key
    from readprep.operators import evaluate as E
    from readprep.operators import pipeline as L
    from readprep.operators.profile import Plan

    n = int(args.reads_per_scenario)
    plan = Plan(15, 20, 4, 35, [("illumina-short", E.ADAPTER, 3 * n)])
    if getattr(args, "paired", False):
        truth = E.paired_truth(spark, n)
        sides = [truth.select("read_ix", *(F.col(f"{c}{i}").alias(c) for c in ("header", "sequence", "qualities"))) for i in (1, 2)]
        done = L.prepare_pairs(*sides, plan).where((F.length("sequence1") >= plan.min_length) & (F.length("sequence2") >= plan.min_length))
        out = done.select(pair_key(F.col("header1")).alias("out_key"), F.col("sequence1").alias("output1"), F.col("sequence2").alias("output2"))
        rows = E.summarise(E.scored(truth, out, paired=True))
    else:
        truth = E.single_truth(spark, n)
        done = L.keep(L.prepare(truth.drop("scenario", "expected"), plan), plan)
        rows = E.summarise(E.scored(truth, E.last_by(done, F.col("header"), "read_ix")))
    return {"scenarios": [r.asDict() for r in rows.orderBy(F.col("scenario").asc_nulls_last()).collect()]}


def paper_artifacts(spark, args) -> dict:
    from readprep.study import artifacts as A

    found = evaluate(spark, args)
    total = found["scenarios"][-1]
    A.write_json(f"{args.output}/evaluation.json", found)
    chart = A.bar_chart("F1 by scenario", [(r["scenario"] or "all", [r["retention_f1"], r["trimming_f1"], r["correction_f1"]]) for r in found["scenarios"]], ["retention", "trimming", "correction"])
    with open(f"{args.output}/evaluation.svg", "w", encoding="utf-8") as f:
        f.write(chart or "")
    with open(f"{args.output}/summary.txt", "w", encoding="utf-8") as f:
        f.write(A.summary_text("Evaluation", {"all scenarios": total}))
    return {"written": sorted(os.listdir(args.output)), "exact_match_rate": total["exact_match_rate"]}


def study_artifacts(spark, args) -> dict:
    """Detection and cleaning of every data set of a manifest, compared with its baseline."""
    from pyspark.sql import functions as F

    from readprep.operators import pipeline as L
    from readprep.operators import profile as P
    from readprep.operators import trim as T
    from readprep.study import artifacts as A
    from readprep.study import manifest as M

    rows = []
    for m in M.read_table(spark, args.manifest).collect():  # a data set is a run of its own, planned at the driver
        reads = _read(spark, m.input1)
        plan = P.plan_of(reads)
        if m.input2:
            second = _read(spark, m.input2)
            plan, reads = P.plan_of(reads, mates=second), T.interleave(reads, second)
        began = time.perf_counter()
        total = L.report(L.prepare(reads, plan), plan).first()
        wall = time.perf_counter() - began
        bases = reads.agg(F.sum(F.length("sequence"))).first()[0] or 0
        share = lambda a: a / total.input_reads if total.input_reads else 0.0
        rows.append((m.dataset_id, plan.platform, plan.experiment, bases / wall, share(total.trimmed_reads), share(total.discarded_reads), total.corrected_bases * 1e6 / bases if bases else 0.0))
    own = spark.createDataFrame(rows, "dataset_id string, platform string, experiment string, input_bases_per_sec double, trimmed_read_fraction double, discarded_read_fraction double, corrected_bases_per_mbase double")
    compared = M.compare(own.join(M.read_table(spark, args.manifest), "dataset_id")).persist()
    A.write_csv(f"{args.output}/datasets.csv", compared)
    total, each = M.aggregate(compared).first().asDict(), compared.collect()
    compared.unpersist()
    A.write_json(f"{args.output}/study.json", {"aggregate": total, "datasets": [r.asDict() for r in each]})
    chart = A.bar_chart("Input bases per second", [(r.dataset_id, [r.input_bases_per_sec, r.baseline_input_bases_per_sec]) for r in each], ["own", "baseline"], "bases/s")
    if chart:
        with open(f"{args.output}/throughput.svg", "w", encoding="utf-8") as f:
            f.write(chart)
    return total


def publication_bundle(spark, args) -> dict:
    study = study_artifacts(spark, argparse.Namespace(manifest=args.manifest, output=f"{args.output}/study"))
    paper = paper_artifacts(spark, argparse.Namespace(output=f"{args.output}/paper", reads_per_scenario=args.reads_per_scenario))
    return {"study": study, "paper": paper}


def _save(df, path: str) -> int:
    from readprep.study import manifest as M

    mark = "," if path.endswith(".csv") else "\t"
    rows = [r.value for r in M.as_table(df, mark).collect()]
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(rows) + "\n")
    return len(rows) - 1


def study_discover(spark, args) -> dict:
    from readprep.sources import fastq
    from readprep.study import manifest as M
    from readprep.study import text as X

    from pyspark.sql import functions as F

    paths = fastq.scan(args.input, not args.flat)
    sets = M.group_files(spark.createDataFrame([(p,) for p in paths], "path string")).withColumn("at", F.concat_ws("/", "folder", "stem"))
    named = X.allocate_ids(sets, "stem", "at").withColumn("accession", F.get(X.accessions(F.col("stem")), F.lit(0)))
    return {"files": len(paths), "datasets": _save(named.select("dataset_id", "accession", "input1", "input2"), args.output)}


def study_manifest(spark, args) -> dict:
    """A manifest out of an inventory, or out of public run metadata, which are told by their columns."""
    from pyspark.sql import functions as F

    from readprep.study import manifest as M
    from readprep.study.fetch import FIELDS

    with open(args.inventory, encoding="utf-8") as f:
        head = f.readline().rstrip("\n").split("\t")
    if not {"run_accession", "fastq_ftp"} <= set(head):
        return {"datasets": _save(M.read_table(spark, args.inventory, require=None), args.output)}
    rows = spark.read.option("header", True).option("sep", "\t").csv(args.inventory)
    rows = rows.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if c in head else F.lit("").alias(c) for c in FIELDS))
    table = M.from_metadata(rows, args.root)
    have = [c for c in M.MANIFEST if c in table.columns]
    return {"datasets": _save(table.select(*(c if c in have else F.lit(None).cast("string").alias(c) for c in M.MANIFEST)), args.output)}


def study_annotate(spark, args) -> dict:
    from pyspark.sql import functions as F

    from readprep.study import manifest as M

    manifest = M.read_table(spark, args.manifest).withColumn("at", F.monotonically_increasing_id())
    found = M.read_table(spark, args.annotations, M.ANNOTATION, None)
    columns = [c for c in M.ANNOTATION if c != "dataset_id"]
    merged = M.annotate(manifest, found, columns, args.overwrite).persist()
    _save(merged.drop("outcomes", "at"), args.output)
    targets = M.target(manifest, found.withColumn("at", F.monotonically_increasing_id())).persist()
    examples = [r.dataset_id or r.accession for r in M.first_unmatched(targets).collect()]
    return M.outcome_counts(merged).first().asDict() | {"unmatched": M.unmatched(targets).count(), "unmatched_examples": examples}


def study_ingest(spark, args) -> dict:
    """Metrics out of a folder of reports, as annotations of the data sets that their names hint at."""
    from pyspark.sql import functions as F

    from readprep.study import manifest as M
    from readprep.study import reports as R
    from readprep.study import text as X

    files = spark.read.text(args.results, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    side = X.metric_side(F.col("path"))
    name = F.coalesce(X.dataset_hint(F.col("label")), X.dataset_hint(F.regexp_extract("path", "([^/]*)$", 1)))
    files = files.withColumn("kind", R.kind(F.col("content"), F.col("path"))).persist()
    long = R.read_all(files).select(name.alias("dataset_id"), side["side"].alias("side"), side["tool"].alias("tool"), "metric", "value").where("dataset_id is not null")
    column = F.when(F.col("metric").isin(M.DOWNSTREAM), F.concat_ws("_", "side", "metric")).otherwise(F.concat(F.lit("baseline_"), "metric"))
    wide = long.withColumn("column", column)
    clash = wide.groupBy("dataset_id", "column").agg(F.countDistinct("value").alias("n")).where("n > 1").first()
    if clash:
        raise ValueError(f"reports disagree on {clash.column} of {clash.dataset_id}")
    known = [c for c in M.NUMBERS]
    table = wide.groupBy("dataset_id").pivot("column", known).agg(F.first("value")).join(wide.groupBy("dataset_id").agg(F.max("tool").alias("baseline_name")), "dataset_id")
    for c in M.ANNOTATION:
        if c not in table.columns:
            table = table.withColumn(c, F.lit(None).cast("string"))
    plain = R.annotation_records(files, M.ANNOTATION, M.names_of).withColumns({c: F.col(c).cast("double") for c in M.NUMBERS})
    same = lambda df, at: df.select(F.coalesce("dataset_id", "accession").alias("who"), at.alias("at"), *(F.col(c).cast("double" if c in M.NUMBERS else "string").alias(c) for c in M.ANNOTATION))
    both = same(table, F.lit(0).cast("long")).unionByName(same(plain, F.col("at")))
    merged = M.merge_records(both, "who", M.ANNOTATION).drop("who", "conflicts")
    annotations = args.output + ".annotations.tsv"
    n = _save(merged, annotations)
    counts = {r.kind or "ignored": r["count"] for r in files.groupBy("kind").count().collect()}
    return {"annotations": n, "files": counts} | study_annotate(spark, argparse.Namespace(manifest=args.manifest, annotations=annotations, output=args.output, overwrite=args.overwrite))


#: Columns of the tables that say what became of requests and downloads.
FETCH_STATUS = ["accession", "status", "matched_run_rows", "matched_runs", "source", "attempts", "error", "geo_surface", "resolved_accessions"]
DOWNLOAD_STATUS = ["dataset_id", "accession", "destination", "source_url", "status", "bytes", "attempts", "error"]


def _rows_of(path: str, mark: str) -> list[dict]:
    import csv

    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8", newline="") as f:
        return [{k: v or "" for k, v in r.items()} for r in csv.DictReader(f, delimiter=mark)]


def _write_rows(path: str, columns: list[str], rows: list[dict], mark: str) -> None:
    import csv

    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.DictWriter(f, columns, delimiter=mark, extrasaction="ignore", lineterminator="\n")
        out.writeheader()
        out.writerows(rows)


def study_fetch_metadata(spark, args) -> dict:
    """Metadata of the accessions of a file, with a table of what became of each; --resume goes on where it was left."""
    from pyspark.sql import functions as F

    from readprep.study import fetch as T
    from readprep.study import manifest as M

    transport = getattr(args, "transport", None) or T.open_address
    status_path = args.output + ".status.csv"
    text = spark.read.text(args.accessions).select(F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    names = [r.accession.upper() for r in M.requested(text).orderBy("at").collect()]
    columns = [c for c in T.FIELDS if c != "run_accession"]
    frame = lambda rows, cols: spark.createDataFrame([["" if r.get(c) is None else str(r[c]) for c in cols] for r in rows], ", ".join(f"{c} string" for c in cols))
    old = [r for r in _rows_of(status_path, ",") if args.resume and r["accession"] in names]
    old_rows = [r for r in _rows_of(args.output, "\t") if args.resume and set(r.get("query_accessions", "").split(";")) & set(names)]
    settled = {r.accession for r in M.resumable(frame(old, ["accession", "status"]), frame(old_rows, ["query_accessions"])).collect()}
    status = {n: {"accession": n, "attempts": 0, "error": ""} for n in names} | {r["accession"]: r for r in old}
    todo, ask, failed = [n for n in names if n not in settled], [], set()
    for n in todo:
        known = [x for x in status[n].get("resolved_accessions", "").split(";") if x]
        if not T.GEO.fullmatch(n):
            ask.append(n)
            continue
        found = {"resolved": known, "surface": status[n].get("geo_surface"), "source": status[n].get("source"), "attempts": 0, "error": ""} if known else T.bridge(n, args.geo_url, transport, args.cache, int(args.retries))
        status[n] |= {"resolved_accessions": ";".join(found["resolved"]), "geo_surface": found["surface"], "source": found["source"], "attempts": found["attempts"], "error": found["error"]}
        ask += found["resolved"]
        failed |= {n} if found["error"] else set()
    got = T.fetch(list(dict.fromkeys(ask)), args.url, transport, int(args.chunk), args.cache, int(args.retries))
    for s in got.status:
        if s["accession"] in status:
            status[s["accession"]] |= {k: s[k] for k in ("source", "attempts", "error")}
        failed |= {s["accession"]} if s["failed"] else set()
    import csv

    fresh = list(csv.DictReader(got.body.splitlines(), delimiter="\t"))
    wanted = frame([{"at": i, "accession": n} for i, n in enumerate(names)], ["at", "accession"]).withColumn("at", F.col("at").cast("long"))
    links = frame([{"geo": n, "accession": x} for n in names for x in str(status[n].get("resolved_accessions") or "").split(";") if x], ["geo", "accession"])
    asked = M.expand_requests(wanted, links)
    rows = frame(fresh, T.FIELDS).withColumn("bioproject", F.lit(None).cast("string"))
    hits = M.match_metadata(rows.withColumn("study_accession", F.concat_ws(" ", "study_accession", "secondary_study_accession")), asked.select("accession", F.col("first_at").alias("at")))
    by = hits.select("run_accession", F.explode(F.split("query_accessions", ";")).alias("accession")).join(asked, "accession").select("run_accession", F.explode(F.split("requested", ";")).alias("q"))
    queried = by.groupBy("run_accession").agg(F.array_join(F.array_sort(F.collect_set("q")), ";").alias("query_accessions"))
    new = rows.join(queried, "run_accession").withColumn("at", F.lit(1)).select("at", "run_accession", "query_accessions", *columns)
    before = frame(old_rows, ["run_accession", "query_accessions", *columns]).withColumn("at", F.lit(0)).select(*new.columns)
    merged = [r.asDict() for r in M.merge_fetched(before.union(new), columns).orderBy("run_accession").collect()]  # as many rows as were asked for
    _write_rows(args.output, ["run_accession", "query_accessions", *columns], merged, "\t")
    runs = {n: [r["run_accession"] for r in merged if n in r["query_accessions"].split(";")] for n in names}
    for n in todo:
        linked = [n, *str(status[n].get("resolved_accessions") or "").split(";")]
        status[n]["status"] = "matched" if runs[n] else "fetch_failed" if failed & set(linked) else "unmatched"
    for n in names:
        status[n] |= {"matched_runs": ";".join(runs[n]), "matched_run_rows": len(runs[n])}
    _write_rows(status_path, FETCH_STATUS, [status[n] for n in names], ",")
    kinds = [status[n]["status"] for n in names]
    return {"requested": len(names), "resumed": len(settled), "rows": len(merged), **{k: kinds.count(k) for k in ("matched", "unmatched", "fetch_failed")}}


def study_download(spark, args) -> dict:
    """Files of a metadata table, into a folder a run, or onto the inputs of a manifest, with a table of what became of each."""
    from readprep.study import fetch as T
    from readprep.study import manifest as M

    inputs = {}
    if args.manifest:
        inputs = {(m.accession or m.dataset_id).upper(): (m.dataset_id, [x for x in (m.input1, m.input2) if x]) for m in M.read_table(spark, args.manifest).collect()}
    rows = []
    for r in _rows_of(args.inventory, "\t"):
        run = r.get("run_accession", "")
        raw = [x.strip() for x in (r.get("fastq_ftp") or r.get("submitted_ftp") or "").replace(",", ";").split(";") if x.strip()]
        addresses = [x if "://" in x else f"https://{x}" for x in raw]
        name, wanted = inputs.get(run.upper(), (run, None))
        if args.manifest and wanted is None:
            continue
        try:
            pairs = T.destinations(wanted, addresses) if wanted else [(os.path.join(args.output, run, os.path.basename(a)), a) for a in addresses]
        except ValueError as e:
            rows.append({"dataset_id": name, "accession": run, "status": "failed", "bytes": 0, "attempts": 0, "error": str(e)})
            continue
        extra = {"stream": args.stream} if getattr(args, "stream", None) else {}
        rows += [{"dataset_id": name, "accession": run} | T.download(a, d, retries=int(args.retries), overwrite=args.overwrite, **extra) for d, a in pairs]
    _write_rows(os.path.join(args.output, "download_status.csv"), DOWNLOAD_STATUS, rows, ",")
    return {"files": len(rows), **{s: sum(r["status"] == s for r in rows) for s in ("downloaded", "resumed", "skipped_existing", "failed")}}


def history_report(spark, args) -> dict:
    from readprep.operators import history as H
    from readprep.sources import history_log

    number = lambda x: float(x) if x is not None else None
    gates = H.Gates(number(args.max_wall_pct), number(args.min_speedup), number(args.min_savings_pct))
    rows = history_log.read(spark, args.history).persist()
    out = {"stats": H.stats(rows).first().asDict(), "recent": [r.asDict() for r in H.recent(rows, int(args.limit)).collect()]}
    if args.latest_pass:
        last = H.latest_passing(rows, gates, args.label_prefix).orderBy("line_no", ascending=False).first()
        out |= {"baseline_line": last.baseline_line, "status": last.status if last.baseline_line else "no_baseline"}
    elif args.baseline_label or args.label_prefix:
        last = H.labelled_baseline(rows, args.baseline_label, args.label_prefix).first()
        out |= {"baseline_line": last.baseline_line, "status": "pass" if last.relation == "comparable" else last.relation}
    else:
        last = H.with_previous(rows, gates).orderBy("line_no", ascending=False).first()
        out |= {"baseline_line": last.previous_line, "status": last.status}
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    found = globals()[args.command.replace("-", "_")](session(args.command), args)
    print(json.dumps(found, indent=None if args.json else 2, default=str))
    wanted = getattr(args, "fail_on_status", None)
    return FAILED if wanted and found.get("status") in wanted.split(",") else 0


if __name__ == "__main__":
    sys.exit(main())
