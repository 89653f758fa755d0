import json
import os
import subprocess
import sys

import duckdb

from readprep.plans.views import READS_SQL, reads

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_subpackage():
    code = "import sys; sys.modules['readprep.llm'] = None; import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 70 and set(o) <= set(q) and not any(k.startswith('op') for k in q); print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=TOP, capture_output=True, text=True, check=True).stdout) > 70


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(TOP, "readprep")):
        for name in names:
            if name.endswith(".py") and not folder.endswith("llm"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "readprep.llm" not in f.read(), name


def test_command_line(spark, tmp_path, capsys):
    from readprep import cli
    from tests.test_correct import damaged_reads

    path = tmp_path / "reads.fastq"
    path.write_text("".join(f"@{h}\n{s}\n+\n{q}\n" for _, h, s, q in damaged_reads(8, n=60)))
    assert cli.main(["detect", str(path), "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["profile"]["n_reads"] == 60
    assert cli.main(["process", str(path), str(tmp_path / "out"), "--kmer-size", "9", "--json"]) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["input_reads"] == 60 and report["output_reads"] + report["discarded_reads"] == 60
    log = str(tmp_path / "h" / "log.jsonl")
    for _ in range(2):
        cli.main(["benchmark", str(path), "--rounds", "1", "--kmer-size", "9", "--history", log, "--label", "x", "--json"])
    capsys.readouterr()
    assert cli.main(["history-report", log, "--max-wall-pct", "-99.9", "--fail-on-status", "alert", "--json"]) in (0, 2)
    assert json.loads(capsys.readouterr().out)["stats"]["entries"] == 2
    (tmp_path / "in").mkdir()
    for name in ("SRR1_R1.fastq", "SRR1_R2.fastq", "x.txt"):
        (tmp_path / "in" / name).write_text("")
    cli.main(["study-discover", str(tmp_path / "in"), str(tmp_path / "sets.tsv"), "--json"])
    assert json.loads(capsys.readouterr().out) == {"files": 2, "datasets": 1}
    assert "SRR1\tSRR1\t" in (tmp_path / "sets.tsv").read_text()
    (tmp_path / "m.tsv").write_text("dataset_id\taccession\ncase\tSRR1\n")
    (tmp_path / "res" / "own").mkdir(parents=True)
    (tmp_path / "res" / "own" / "case.flagstat.txt").write_text("10 + 0 in total (x)\n8 + 0 mapped (80.00% : N/A)\n")
    (tmp_path / "res" / "case.fastp.json").write_text('{"summary": {"before_filtering": {"total_reads": 10}, "after_filtering": {"total_reads": 9}}, "adapter_cutting": {"adapter_trimmed_reads": 4}}')
    cli.main(["study-ingest", str(tmp_path / "m.tsv"), str(tmp_path / "res"), str(tmp_path / "out.tsv"), "--json"])
    assert json.loads(capsys.readouterr().out)["changed"] == 1
    assert "fastp" in (tmp_path / "out.tsv").read_text() and "0.800000" in (tmp_path / "out.tsv").read_text()


def test_reads_match_their_sql_for_ids_of_any_sign(spark, tmp_path):
    con = duckdb.connect()
    text = "repeat('the quick brown fox jumps over a lazy dog ', 1 + (abs(i) % 40)::int) || substr('some more words', 1, (abs(i) % 14)::int)"
    con.execute(f"copy (select i as doc_id, {text} as text from range(-300, 900) t(i) union all select 5000, null union all select 5001, '12') to '{tmp_path}/documents.parquet' (format parquet)")
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    got = {tuple(r) for r in reads(spark, str(tmp_path)).collect()}
    assert got == set(con.execute(f"with {READS_SQL} select read_ix, header, sequence, qualities from reads_v").fetchall()) and len(got) > 5000
