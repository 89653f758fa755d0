"""The benchmark history as JSON lines."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = """kind string, history_version int, tool_version string, recorded_at_unix_ms long, label string, input1 string, input2 string, paired_end boolean,
requested_backend string, sample_size long, batch_reads long, forced_adapter string, min_quality_override int, rounds long, session_mode string, cold_start_mode string, reuse_session_mode string,
summary struct<wall_us: double, speedup: double, savings_pct: double, reads_per_s: double, bases_per_s: double>"""


def append(path: str, entry: dict) -> None:
    """Adds a line; folders are made as needed."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(entry, sort_keys=True) + "\n")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries as operators.history takes them, in order of line; a bad line is an error."""
    lines = spark.read.text(path, wholetext=False).withColumn("at", F.monotonically_increasing_id()).where(F.trim("value") != "")
    parsed = lines.withColumn("e", F.from_json("value", SCHEMA, {"mode": "FAILFAST"}))
    line = F.row_number().over(Window.orderBy("at"))  # a history is small
    return parsed.select(line.cast("long").alias("line_no"), F.col("e.kind"), F.col("e.requested_backend").alias("backend"), F.col("e.paired_end").alias("paired"), F.when(F.col("e.kind") == "benchmark", F.col("e.session_mode")).alias("mode"), F.col("e.label"), F.timestamp_millis("e.recorded_at_unix_ms").alias("recorded_at"), F.col("e.summary.wall_us"), F.col("e.summary.speedup"), F.col("e.summary.savings_pct"))
