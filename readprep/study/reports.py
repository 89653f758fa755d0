"""Reports of other tools, read as text rows (path, content) into metrics by path.

Each parser is a DataFrame function: lines are exploded, a table's header is found and cells are taken by normalised name.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readprep.functions import clamp, fraction, normal_name, report_number


def lines(reports: DataFrame) -> DataFrame:
    return reports.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "line"))


def cells(line: Column) -> Column:
    """Cells by tab, else by comma, else by blanks."""
    return F.when(F.contains(line, F.lit("\t")), F.split(line, "\t")).when(F.contains(line, F.lit(",")), F.split(line, ",")).otherwise(F.split(F.trim(line), r"\s+"))


def table(reports: DataFrame, header: Column) -> DataFrame:
    """(path, pos, names, cells) of the rows under the first line that is a header."""
    rows = lines(reports)
    heads = rows.where(header).groupBy("path").agg(F.min_by(F.struct("pos", "line"), "pos").alias("h"))
    names = F.transform(cells(F.regexp_replace(F.col("h.line"), "^#+", "")), normal_name)
    under = rows.join(heads.select("path", F.col("h.pos").alias("head"), names.alias("names")), "path").where((F.col("pos") > F.col("head")) & (F.trim("line") != ""))
    return under.select("path", "pos", "names", cells(F.col("line")).alias("cells"))


def cell(*names: str) -> Column:
    """The cell under the first of these headers that there is."""
    return F.coalesce(*(F.get("cells", F.array_position("names", n).cast("int") - 1) for n in names))


def number(*names: str) -> Column:
    return report_number(cell(*names))


def fastp(reports: DataFrame) -> DataFrame:
    """trimmed_read_fraction, discarded_read_fraction."""
    at = lambda p: F.get_json_object("content", p).try_cast("double")
    before, after = at("$.summary.before_filtering.total_reads"), F.coalesce(at("$.summary.after_filtering.total_reads"), at("$.filtering_result.passed_filter_reads"))
    share = lambda x: clamp(F.try_divide(x, before))
    return reports.select("path", share(at("$.adapter_cutting.adapter_trimmed_reads")).alias("trimmed_read_fraction"), share(before - after).alias("discarded_read_fraction"))


def flagstat(reports: DataFrame) -> DataFrame:
    """alignment_rate: mapped of total, passed and failed reads together."""
    pair = lambda word: sum((F.regexp_extract("content", rf"(?m)^(\d+) \+ (\d+) {word}", i).try_cast("double") for i in (2,)), F.regexp_extract("content", rf"(?m)^(\d+) \+ (\d+) {word}", 1).try_cast("double"))
    return reports.select("path", F.try_divide(pair(r"mapped \("), pair("in total")).alias("alignment_rate"))


def quast(reports: DataFrame) -> DataFrame:
    """(path, label, assembly_n50): a row for each assembly with a figure."""
    rows = lines(reports)
    names = rows.where(F.startswith("line", F.lit("Assembly"))).groupBy("path").agg(F.min_by("line", "pos").alias("names"))
    found = rows.where(F.regexp_extract("line", r"^([^\t]*)", 1) == "N50").groupBy("path").agg(F.min_by("line", "pos").alias("n50"))
    both = names.join(found, "path").select("path", F.posexplode(F.arrays_zip(F.split("names", "\t").alias("label"), F.split("n50", "\t").alias("value"))).alias("at", "x"))
    return both.where("at > 0").select("path", F.trim("x.label").alias("label"), report_number(F.col("x.value")).alias("assembly_n50")).where("assembly_n50 is not null")


def picard(reports: DataFrame) -> DataFrame:
    """duplicate_rate: as stated, else duplicates of all reads."""
    rows = table(reports, F.startswith("line", F.lit("LIBRARY\t")))
    first = rows.groupBy("path").agg(F.min_by(F.struct("names", "cells"), "pos").alias("r")).select("path", "r.*")
    zero = lambda n: F.coalesce(number(n), F.lit(0.0))
    counted = F.try_divide(zero("unpairedreadduplicates") + 2 * zero("readpairduplicates"), zero("unpairedreadsexamined") + 2 * zero("readpairsexamined"))
    return first.select("path", F.coalesce(fraction(number("percentduplication")), clamp(counted)).alias("duplicate_rate"))


def mosdepth(reports: DataFrame) -> DataFrame:
    """mean_coverage: of the row of totals, else of the longest region row, else weighted by length."""
    rows = table(reports, F.lower("line").rlike("^chrom")).select("path", "pos", normal_name(cell("chrom")).alias("chrom"), F.coalesce(number("length"), F.lit(0.0)).alias("len"), number("mean").alias("mean")).where("mean is not null")
    rank = F.when(F.col("chrom").isin("total", "all", "overall"), 0).when(F.col("chrom") == "region", 1)
    best = F.min_by("mean", F.when(rank.isNotNull(), F.struct(rank, -F.col("len"), "pos")))
    weighted = F.try_divide(F.sum(F.when(F.col("len") > 0, F.col("mean") * F.col("len"))), F.sum(F.when(F.col("len") > 0, F.col("len"))))
    return rows.groupBy("path").agg(F.coalesce(best, weighted).alias("mean_coverage"))


def samtools_coverage(reports: DataFrame) -> DataFrame:
    """mean_coverage and coverage_breadth: of the longest row of totals, else from all rows by length."""
    span = number("endpos") - number("startpos") + 1
    rows = table(reports, F.lower("line").rlike("^#?rname")).select("path", "pos", normal_name(cell("rname")).alias("name"), F.when(span > 0, span).alias("len"), number("covbases").alias("covered"), number("meandepth").alias("depth"), fraction(number("coverage")).alias("breadth")).where("depth is not null")
    total = F.col("name").isin("total", "all", "overall", "genome")
    part = ~total & F.col("len").isNotNull()
    best = F.min_by(F.struct("depth", "breadth"), F.when(total, F.struct(-F.coalesce("len", F.lit(0.0)), "pos")))
    of = lambda c: F.sum(F.when(part, c))
    sums = rows.groupBy("path").agg(
        F.max(total.cast("int")).alias("has_total"), best.alias("best"), of(F.col("len")).alias("len"), of(F.col("depth") * F.col("len")).alias("depth"),
        of(F.when(F.col("covered").isNotNull(), F.greatest(F.lit(0.0), F.least(F.col("covered"), F.col("len"))))).alias("covered"), of(F.when(F.col("covered").isNull(), F.col("breadth") * F.col("len"))).alias("breadth"),
    )
    own = F.coalesce(clamp(F.try_divide("covered", "len")), clamp(F.try_divide("breadth", "len")))
    return sums.select("path", F.when(F.col("has_total") == 1, F.col("best.depth")).otherwise(F.try_divide("depth", "len")).alias("mean_coverage"), F.when(F.col("has_total") == 1, F.col("best.breadth")).otherwise(own).alias("coverage_breadth"))


def f1() -> Column:
    """The F1 cell, else the harmonic mean of precision and recall, else from counts; null if none gives it."""
    p, r = fraction(number("metricprecision", "precision")), fraction(number("metricrecall", "recall", "sensitivity"))
    tp = F.coalesce(number("querytp", "truepositives", "truepositivescall"), number("truthtp", "truepositivesbaseline"))
    counted = 2 * tp + F.coalesce(number("queryfp", "falsepositives"), F.lit(0.0)) + F.coalesce(number("truthfn", "falsenegatives"), F.lit(0.0))
    mean = F.when(p + r > 0, clamp(2 * p * r / F.nullif(p + r, F.lit(0.0))))
    return F.coalesce(fraction(number("metricf1score", "f1", "f1score", "fmeasure")), mean, F.when(counted > 0, clamp(F.try_divide(2 * tp, counted))))


def happy(reports: DataFrame) -> DataFrame:
    """variant_f1: of the most general row of passed variants; ties take the best."""
    kind, passed = normal_name(cell("type")), F.coalesce(normal_name(cell("filter")), F.lit(""))
    every, plain = kind.isin("all", "total"), passed.isin("pass", "all", "")
    rank = F.when(every & plain, 0).when(every, 1).when(plain, 2).otherwise(3)
    rows = table(reports, F.lower("line").rlike("^type[,\t]")).select("path", rank.alias("rank"), f1().alias("f1")).where("f1 is not null")
    return rows.groupBy("path").agg(F.min_by("f1", F.struct("rank", -F.col("f1"))).alias("variant_f1"))


def vcfeval(reports: DataFrame) -> DataFrame:
    """variant_f1: the best F-measure of all thresholds."""
    rows = table(reports, F.lower("line").rlike(r"^\s*threshold")).where(~F.get("cells", F.lit(0)).rlike("^-+$"))
    return rows.select("path", f1().alias("f1")).where("f1 is not null").groupBy("path").agg(F.max("f1").alias("variant_f1"))


def kind(content: Column, path: Column) -> Column:
    """Which parser a report is for, by its content; generic tables and JSON of annotations otherwise."""
    low = F.lower(content)
    return (
        F.when(F.startswith(F.trim(content), F.lit("{")) & F.contains(content, F.lit("before_filtering")), "fastp")
        .when(content.rlike(r"(?m)^Assembly\t") & content.rlike(r"(?m)^N50\t"), "quast")
        .when(content.rlike(r"(?m)^\d+ \+ \d+ in total") & content.rlike(r"(?m)^\d+ \+ \d+ mapped"), "flagstat")
        .when(low.rlike(r"(?m)^#?rname\s.*meandepth"), "samtools_coverage").when(low.rlike(r"(?m)^chrom\s+length\s+bases\s+mean"), "mosdepth")
        .when(content.rlike(r"(?m)^LIBRARY\t.*PERCENT_DUPLICATION"), "picard").when(low.rlike(r"(?m)^type[,\t]filter[,\t]"), "happy").when(low.rlike(r"(?m)^\s*threshold\s.*f-measure"), "vcfeval")
        .when(F.lower(path).rlike(r"\.json$"), "json").when(F.lower(path).rlike(r"\.(csv|tsv)$"), "table")
    )


PARSERS = {"fastp": fastp, "quast": quast, "flagstat": flagstat, "samtools_coverage": samtools_coverage, "mosdepth": mosdepth, "picard": picard, "happy": happy, "vcfeval": vcfeval}
METRICS = ["alignment_rate", "duplicate_rate", "variant_f1", "mean_coverage", "coverage_breadth", "assembly_n50", "trimmed_read_fraction", "discarded_read_fraction"]


def read_all(reports: DataFrame) -> DataFrame:
    """(path, label, metric, value) of every report that some parser knows."""
    sorted_ = reports.withColumn("kind", kind(F.col("content"), F.col("path")))
    out = None
    for name, parser in PARSERS.items():
        found = parser(sorted_.where(F.col("kind") == name).select("path", "content"))
        have = [m for m in METRICS if m in found.columns]
        label = F.col("label") if "label" in found.columns else F.lit(None).cast("string")
        each = found.select("path", label.alias("label"), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in have))).alias("x")).select("path", "label", "x.*").where("value is not null")
        out = each if out is None else out.unionByName(each)
    return out


def annotation_records(files: DataFrame, columns: list[str], names_of) -> DataFrame:
    """(path, at, columns) as text out of JSON and tables of annotations (path, content, kind: json or table).

    JSON is an array of objects, an object with one under records, datasets or items, or a single object. Headers and keys
    are matched as letters and digits only. A record without dataset_id and accession is an error.
    """
    known = {alias: c for c in reversed(columns) for alias in reversed(names_of(c))}
    fields = [pa.field("path", pa.string()), pa.field("at", pa.int64()), *(pa.field(c, pa.string()) for c in columns)]

    def rows(path: str, content: str, kind_: str) -> Iterator[dict]:
        if kind_ == "json":
            value = json.loads(content)
            if isinstance(value, dict):
                value = next((value[k] for k in ("records", "datasets", "items") if isinstance(value.get(k), list)), [value])
            if not isinstance(value, list) or not all(isinstance(x, dict) for x in value):
                raise ValueError(f"{path}: neither an object nor an array of objects")
            yield from value
            return
        lines = [x for x in content.splitlines() if x.strip() and not x.lstrip().startswith("#")]
        yield from csv.DictReader(lines, delimiter="\t" if lines and "\t" in lines[0] else ",")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content, kind_ in zip(*(batch[c].to_pylist() for c in ("path", "content", "kind")), strict=True):
                for at, record in enumerate(rows(path, content, kind_), 1):
                    row: dict = {"path": path, "at": at}
                    for k, v in record.items():
                        column = known.get("".join(ch for ch in str(k).lower() if ch.isalnum()))
                        text = "" if v is None else str(v).strip()
                        if column and text and column not in row:
                            row[column] = text
                    if not row.get("dataset_id") and not row.get("accession"):
                        raise ValueError(f"{path}: record {at} has neither dataset_id nor accession")
                    out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))

    schema = "path string, at long, " + ", ".join(f"{c} string" for c in columns)
    return files.where(F.col("kind").isin("json", "table")).select("path", "content", "kind").mapInArrow(run, schema)
