import json

import pytest
from pyspark.sql import functions as F

from readprep.operators import history as H
from readprep.study import artifacts as A
from readprep.study import fetch as T
from readprep.study import manifest as M
from readprep.study import reports as R
from readprep.study import text as X


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_manifest_tables(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("# a comment\nDataset ID,Run,read1,Platform,own alignment rate,unknown,Notes\n\nwgs,SRR1,a.fastq,Illumina,0.5,x,first\nsc,,b.fastq,,,y,\n")
    got = M.read_table(spark, str(p)).orderBy("dataset_id").collect()
    assert [(r.dataset_id, r.accession, r.input1, r.expected_platform, r.own_alignment_rate, r.notes) for r in got] == [("sc", None, "b.fastq", None, None, None), ("wgs", "SRR1", "a.fastq", "Illumina", 0.5, "first")]
    p.write_text("dataset_id\town_alignment_rate\na\tx\n")
    with pytest.raises(Exception, match="isn't a number"):
        M.read_table(spark, str(p)).collect()
    p.write_text("dataset_id\nq\nq\n")
    with pytest.raises(Exception, match="repeated"):
        M.read_table(spark, str(p)).collect()
    out = [r.value for r in M.as_table(spark.createDataFrame([("a\tb", 0.5, None)], "x string, y double, z string")).collect()]
    assert out == ["x\ty\tz", '"a\tb"\t0.500000\t']


def test_annotations(spark):
    manifest = spark.createDataFrame([(1, "A", "SRR1", None, "baseline", "old"), (2, "b", None, 0.5, None, None)], "at int, dataset_id string, accession string, own_alignment_rate double, baseline_name string, notes string")
    schema = "dataset_id string, accession string, own_alignment_rate double, baseline_name string, notes string"
    columns = ["own_alignment_rate", "baseline_name", "notes"]
    notes = spark.createDataFrame([(None, " srr1", 0.9, "fastp", "new"), ("B", None, 0.7, None, " "), ("zz", None, 1.0, None, None)], schema)
    got = {r.dataset_id: r for r in M.annotate(manifest, notes, columns).collect()}
    assert (got["A"].own_alignment_rate, got["A"].baseline_name, got["A"].notes, got["A"].outcomes) == (0.9, "fastp", "old | new", ["filled", "filled", "appended"])
    assert got["b"].own_alignment_rate == 0.5 and got["b"].outcomes == ["unchanged"] * 3
    over = {r.dataset_id: r for r in M.annotate(manifest, notes, columns, overwrite=True).collect()}
    assert over["b"].own_alignment_rate == 0.7 and over["A"].notes == "new"
    assert M.unmatched(M.target(manifest, notes)).count() == 1
    both = spark.createDataFrame([("b", "SRR1", 0.9, None, None)], schema)
    with pytest.raises(Exception, match="two data sets"):
        M.annotate(manifest, both, columns).collect()
    twice = spark.createDataFrame([("A", None, 0.9, None, None), ("a", None, 0.8, None, None)], schema)
    with pytest.raises(Exception, match="two annotations"):
        M.annotate(manifest, twice, columns).collect()


def test_records_that_disagree(spark):
    schema = "at int, dataset_id string, own_alignment_rate double, baseline_name string, notes string"
    fine = spark.createDataFrame([(1, "a", 0.5, "baseline", "x"), (2, "a", 0.5, "fastp", "y"), (3, "a", None, None, "x")], schema)
    columns = ["own_alignment_rate", "baseline_name", "notes"]
    assert rows(M.merge_records(fine, "dataset_id", columns)) == [("a", 0.5, "fastp", "x | y", 0)]
    bad = spark.createDataFrame([(1, "a", 0.5, None, None), (2, "a", 0.6, None, None)], schema)
    with pytest.raises(Exception, match="disagree"):
        M.merge_records(bad, "dataset_id", columns).collect()
    assert M.merge_records(bad, "dataset_id", columns, strict=False).first().conflicts == 1


def test_text(spark):
    df = spark.createDataFrame([("own/fastp/x.json", "ftp://h/f", " PAIRED-end"), ("a/b/trim-galore.txt", "h/f", "1"), ("x/cutadapt.log", "https://h", "maybe")], "path string, url string, layout string")
    got = df.select(X.metric_side(F.col("path")).alias("s"), X.public_url(F.col("url")).alias("u"), X.boolish(F.col("layout")).alias("b")).collect()
    assert [(r.s.side, r.s.tool) for r in got] == [("baseline", "fastp"), ("baseline", None), ("baseline", "cutadapt")]
    assert [r.u for r in got] == ["https://h/f", "https://h/f", "https://h"] and [r.b for r in got] == [True, False, None]
    pairs = spark.createDataFrame([(["a_1.fq.gz", "a_2.fq.gz"],), (["x.fq", "y.fq"],), (["a_1.fq"],)], "l array<string>")
    assert [r[0] for r in pairs.select(X.locations_paired(F.col("l"))).collect()] == [True, True, False]
    ids = X.allocate_ids(spark.createDataFrame([(1, "a b"), (2, "a_b"), (3, "")], "at int, wanted string"))
    assert sorted(r.dataset_id for r in ids.collect()) == ["a_b", "a_b-2", "dataset"]


def test_reports_are_told_apart(spark):
    from readprep.plans.study_queries import REPORTS

    every = spark.createDataFrame([(f"{k}/{p}", c, k) for k, v in REPORTS.items() for p, c in v], "path string, content string, want string")
    assert all(r.got == r.want for r in every.select("want", R.kind(F.col("content"), F.col("path")).alias("got")).collect())


def test_fetch_falls_back_caches_and_retries(tmp_path):
    asked = []

    def transport(address):
        names = address.split("accession=")[1].split("&")[0].split(",")
        asked.append(names)
        if "SRR9" in names:
            raise OSError("gone")
        return ("run_accession\tx\n" + ("" if len(names) > 1 else f"{names[0]}\t1\n")).encode()

    got = T.fetch(["SRR1", "SRR2", "SRR9"], "http://x", transport, cache=str(tmp_path / "c"), retries=1)
    assert got.body == "run_accession\tx\nSRR1\t1\nSRR2\t1\n"
    assert [s["failed"] for s in got.status] == [False, False, True] and got.status[2]["attempts"] == 2
    n = len(asked)
    again = T.fetch(["SRR1"], "http://x", transport, cache=str(tmp_path / "c"))
    assert again.status[0]["source"] == "cache" and len(asked) == n
    target = str(tmp_path / "d" / "f.gz")
    assert T.download("http://f", target, lambda a: b"abc")["status"] == "downloaded"
    assert T.download("http://f", target, lambda a: b"abc")["status"] == "skipped_existing"
    assert T.download("http://f", target + "2", lambda a: 1 / 0, retries=0)["status"] == "failed"


def test_artifacts(spark, tmp_path):
    assert A.bar_chart("t", [("a", [1.0, None])], ["x", "y"]) is None
    assert A.bar_chart("t & u", [("a", [1.0, 2.0])], ["x", "y"]).count("<rect") == 4
    A.write_json(str(tmp_path / "a" / "x.json"), {"b": 1})
    assert json.loads((tmp_path / "a" / "x.json").read_text()) == {"b": 1}
    assert A.write_csv(str(tmp_path / "x.csv"), spark.createDataFrame([("a,b", 0.5)], "s string, d double")) == 1
    assert (tmp_path / "x.csv").read_text() == 's,d\n"a,b",0.500000\n'
    assert A.summary_text("T", {"s": {"k": 1}}).splitlines() == ["T", "=", "", "s", "-", "k: 1"]


def test_history_gates(spark):
    schema = "line_no long, kind string, backend string, paired boolean, mode string, label string, wall_us double, speedup double, savings_pct double"
    data = [(1, "benchmark", "cpu", False, "c", "v1", 100.0, None, None), (2, "benchmark", "cpu", False, "c", "v2", 150.0, None, None), (3, "benchmark", "cpu", False, "c", "v2", 151.0, 0.5, None), (4, "benchmark", "gpu", False, "c", "v2", 1.0, None, None)]
    df = spark.createDataFrame(data, schema)
    got = {r.line_no: r.status for r in H.with_previous(df, H.Gates(50, 0.6)).collect()}
    assert got == {1: "no_baseline", 2: "pass", 3: "alert", 4: "no_baseline"}
    assert {r.line_no: r.baseline_line for r in H.latest_passing(df, H.Gates(50, 0.6)).collect()}[3] == 2
    assert H.labelled_baseline(df, label="v1").first().relation == "not_comparable"
    assert H.labelled_baseline(df, label="none").first().relation == "no_baseline"


def test_manifest_of_public_metadata(spark):
    from readprep.plans.study_queries import accession_manifest

    got = {r.dataset_id: r for r in accession_manifest(spark, "").collect()}
    assert (got["SRR1"].input1, got["SRR1"].input2) == ("root/SRR1/SRR1_1.fastq.gz", "root/SRR1/SRR1_2.fastq.gz")
    assert (got["SRR2"].input1, got["SRR2"].input2) == ("root/SRR2/reads.fq.gz", None)
    assert (got["SRR3"].input1, got["SRR3"].input2) == ("root/SRR3/SRR3_1.fastq.gz", "root/SRR3/SRR3_2.fastq.gz")
    assert (got["SRR4"].input1, got["SRR4"].input2) == ("root/SRR4/SRR4.fastq.gz", None)
    assert [got[f"SRR{i}"].expected_platform for i in range(1, 5)] == ["Illumina", "ONT", "PacBio", "MGI"]
    assert [got[f"SRR{i}"].expected_experiment for i in range(1, 5)] == ["RNA-seq", "WGS", "Long Read", "ATAC-seq"]
    assert (got["SRR1"].citation, got["SRR2"].citation, got["SRR3"].citation) == ("SRP1 | A study", "SRP1", None)


def test_modes_of_correction_differ_only_where_indels_do(spark):
    from readprep.plans.study_queries import backend_parity

    rows = {r.scenario: r.largest for r in backend_parity(spark, "").collect()}
    assert rows["clean_retention"] == 0 and rows["adapter_trim"] == 0 and len(rows) == 6


def test_accelerated_mode_takes_four_adapters():
    from readprep.operators.pipeline import accelerated
    from readprep.operators.profile import Plan

    names = [("a", "ACGT" * 3, 1), ("b", "ACG", 9), *((f"c{i}", "ACGT" * 2, 1) for i in range(5))]
    assert [a[0] for a in accelerated(Plan(adapters=names)).adapters] == ["a", "c0", "c1", "c2"]


def test_names_of_mates():
    from readprep.sources import fastq

    assert [fastq.mate_by_name(n) for n in ("x.r1.fastq", "x-r2.fq.gz", "x_r1_001.fastq", "x_R2_001.fastq.gz", "x.fastq", "x_2.fq")] == [1, 2, 1, 2, None, 2]


def test_downloads_go_on_behind_a_part(tmp_path):
    whole, target, asked = b"0123456789" * 50, str(tmp_path / "f.fastq.gz"), []

    def stream(address, start):
        asked.append(start)
        if len(asked) == 1:
            return 0, cut_off()
        return start, [whole[start:]]

    def cut_off():
        yield whole[:100]
        raise OSError("lost")

    row = T.download("http://f", target, stream=stream)
    assert (row["status"], row["bytes"], row["attempts"], asked) == ("resumed", 500, 2, [0, 100]) and open(target, "rb").read() == whole
    open(target + "2.part", "wb").write(b"other")
    row = T.download("http://f", target + "2", stream=lambda a, start: (0, [whole]))  # a server that starts over
    assert row["status"] == "downloaded" and open(target + "2", "rb").read() == whole


def test_files_are_told_apart():
    two = ["h/b_2.fastq.gz", "h/b_1.fastq.gz"]
    assert T.destinations(["d/x_1.fastq.gz", "d/x_2.fastq.gz"], two) == [("d/x_1.fastq.gz", two[1]), ("d/x_2.fastq.gz", two[0])]
    assert T.destinations(["d/b_2.fastq.gz"], two) == [("d/b_2.fastq.gz", two[0])]
    assert T.destinations(["p", "q"], ["h/m.fq", "h/n.fq", "h/x.md5"]) == [("p", "h/m.fq"), ("q", "h/n.fq")]
    with pytest.raises(ValueError):
        T.destinations(["d/one.fastq"], two)
    with pytest.raises(ValueError):
        T.destinations(["d/one.fastq"], [])


def test_geo_bridge_reads_the_full_view_if_it_has_to(tmp_path):
    asked = []

    def transport(address):
        asked.append(address.split("view=")[1])
        return b"!Series_relation = SRA: x?term=SRP12 GSE7 SRP12 PRJNA9" if "full" in address else b"GSE7 only"

    for source in ("remote", "cache"):
        got = T.bridge("GSE7", "http://g", transport, str(tmp_path))
        assert (got["resolved"], got["surface"], got["source"]) == (["SRP12", "PRJNA9"], "full_text_self", source)
    assert asked == ["quick", "full"]
    assert T.bridge("GSE8", "http://g", lambda a: 1 / 0, retries=1)["attempts"] == 2


def test_merge_of_fetched_rows(spark):
    rows = [(0, "R1", "Q1", "S", ""), (1, "R1", "Q2;Q1", "", "t"), (2, "R2", "", None, "u")]
    schema = "at int, run_accession string, query_accessions string, study string, title string"
    got = {r.run_accession: tuple(r)[1:] for r in M.merge_fetched(spark.createDataFrame(rows, schema), ["study", "title"]).collect()}
    assert got == {"R1": ("Q1;Q2", "S", "t", 0), "R2": ("", None, "u", 0)}
    clash = spark.createDataFrame([*rows, (3, "R1", "", "other", "")], schema)
    assert {r.conflicts for r in M.merge_fetched(clash, ["study", "title"], strict=False).collect()} == {0, 1}
    with pytest.raises(Exception, match="disagree on R1"):
        M.merge_fetched(clash, ["study", "title"]).collect()


def test_annotations_out_of_json_and_tables(spark):
    files = [("a.json", '{"datasets": [{"Dataset ID": "d1", "own_mean_coverage": 31.5, "x": 1}]}'), ("b.json", '[{"run_accession": "SRR2", "notes": "n"}]'), ("c.json", '{"id": "d3"}'), ("d.csv", "# c\nname,tool\nd4,bt\nd5,\n"), ("e.tsv", "sample\tnotes\nd6\ta,b\n")]
    df = spark.createDataFrame([(*f, "json" if "json" in f[0] else "table") for f in files], "path string, content string, kind string")
    rows = R.annotation_records(df, M.ANNOTATION, M.names_of).collect()
    got = {(r.path, r["at"]): (r.dataset_id, r.accession, r.baseline_name, r.own_mean_coverage, r.notes) for r in rows}
    assert got == {("a.json", 1): ("d1", None, None, "31.5", None), ("b.json", 1): (None, "SRR2", None, None, "n"), ("c.json", 1): ("d3", None, None, None, None), ("d.csv", 1): ("d4", None, "bt", None, None), ("d.csv", 2): ("d5", None, None, None, None), ("e.tsv", 1): ("d6", None, None, None, "a,b")}
    with pytest.raises(Exception, match="neither dataset_id nor accession"):
        R.annotation_records(spark.createDataFrame([("x.json", '{"notes": "n"}', "json")], "path string, content string, kind string"), M.ANNOTATION, M.names_of).collect()


def test_fetch_command_resumes_and_bridges(spark, tmp_path):
    import argparse

    from readprep import cli

    asked = []

    def transport(address):
        asked.append(address)
        if "acc=GSE" in address:
            return b"links to SRP5"
        names = address.split("accession=")[1].split("&")[0].split(",")
        known = {"SRR1": "SRR1\tSRP1", "SRP5": "SRR5\tSRP5"}
        if "SRR9" in names:
            raise OSError("gone")
        return ("run_accession\tstudy_accession\n" + "".join(known[n] + "\n" for n in names if n in known)).encode()

    wanted, out = tmp_path / "names.txt", str(tmp_path / "out.tsv")
    wanted.write_text("SRR1 and GSE7\nSRR8, SRR9\n")
    args = argparse.Namespace(accessions=str(wanted), output=out, url="http://e", geo_url="http://g", cache=None, chunk=1, retries=0, resume=True, transport=transport)
    first = cli.study_fetch_metadata(spark, args)
    assert (first["matched"], first["unmatched"], first["fetch_failed"], first["resumed"], first["rows"]) == (2, 1, 1, 0, 2)
    status = {r["accession"]: r for r in cli._rows_of(out + ".status.csv", ",")}
    assert status["GSE7"]["matched_runs"] == "SRR5" and status["GSE7"]["resolved_accessions"] == "SRP5" and status["SRR9"]["status"] == "fetch_failed"
    n = len(asked)
    again = cli.study_fetch_metadata(spark, args)
    assert again["resumed"] == 3 and again["rows"] == 2 and all("SRR9" in a for a in asked[n:])
    manifest = str(tmp_path / "m.tsv")
    (tmp_path / "runs.tsv").write_text("run_accession\tfastq_ftp\tlibrary_layout\nSRR1\th/SRR1_1.fastq.gz;h/SRR1_2.fastq.gz\tPAIRED\n")
    assert cli.study_manifest(spark, argparse.Namespace(inventory=str(tmp_path / "runs.tsv"), output=manifest, root=str(tmp_path / "d")))["datasets"] == 1
    args = argparse.Namespace(inventory=str(tmp_path / "runs.tsv"), output=str(tmp_path / "d"), manifest=manifest, retries=0, overwrite=False, stream=lambda a, start: (0, [a.encode()]))
    assert cli.study_download(spark, args)["downloaded"] == 2
    assert (tmp_path / "d" / "SRR1" / "SRR1_2.fastq.gz").read_text() == "https://h/SRR1_2.fastq.gz"
    assert [r["status"] for r in cli._rows_of(str(tmp_path / "d" / "download_status.csv"), ",")] == ["downloaded"] * 2


def test_kmers_in_sql(spark):
    from readprep.functions import register

    register(spark)
    assert [tuple(r) for r in spark.sql("select * from kmers('ACGNACG', 3)").collect()] == [(0, "ACG"), (4, "ACG")]
