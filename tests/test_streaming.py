from readprep.operators import spectrum as S
from readprep.operators.correct import collect_spectrum, process_reads
from readprep.operators.adapters import best_hit
from readprep.operators.profile import Plan
from readprep.streaming import kmer_stream, prepare_stream, windowed_totals, write_batches
from tests.test_correct import ADAPTERS, damaged_reads

SCHEMA = "read_ix long, header string, sequence string, qualities string"


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(damaged_reads(6, n=80), SCHEMA)
    df.write.parquet(str(tmp_path / "in"))
    plan = Plan(9, 20, 3, 20, ADAPTERS)
    s = collect_spectrum(S.kmer_counts(df, 9, 18), 9, 3)
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    write_batches(prepare_stream(stream, plan, s), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("read_ix", "sequence").collect()
    want = process_reads(best_hit(df, ADAPTERS), s, 20).where("length(sequence) >= 20").select("read_ix", "sequence").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    q = kmer_stream(stream, 9).writeStream.outputMode("complete").format("memory").queryName("kmers").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("kmers").collect())) == sorted(map(tuple, S.kmer_counts(df, 9).collect()))


def test_windowed_totals(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", "click", 1.0) for m in range(20)]
    spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("to_timestamp(ts) as ts", "event_type", "value").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    q = windowed_totals(stream).writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("totals").collect()) == [5, 5, 5, 5]
