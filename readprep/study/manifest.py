"""Manifests, annotations and their merge; data sets of a folder; public run metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readprep.functions import ratio_or_null, speedup
from readprep.study.text import OWN, accessions, fastq_stem, mate_base, mate_number

DOWNSTREAM = ["alignment_rate", "duplicate_rate", "variant_f1", "mean_coverage", "coverage_breadth", "assembly_n50"]
CLEANUP = ["input_bases_per_sec", "trimmed_read_fraction", "discarded_read_fraction", "corrected_bases_per_mbase"]
TEXTS = ["dataset_id", "accession", "citation", "input1", "input2", "expected_platform", "expected_experiment", "baseline_name"]
NUMBERS = [f"baseline_{c}" for c in CLEANUP] + [f"{side}_{c}" for c in DOWNSTREAM for side in ("own", "baseline")]
#: The columns of a manifest in order; an annotation table has all but the inputs.
MANIFEST = [*TEXTS, *NUMBERS, "notes"]
ANNOTATION = [c for c in MANIFEST if c not in ("input1", "input2")]
#: Other headers that mean a column, compared as letters and digits only.
ALIASES = {
    "dataset_id": ["dataset", "datasetid", "id", "sample", "sampleid", "name"],
    "accession": ["accession", "run", "runaccession", "srr", "sraaccession"],
    "citation": ["citation", "reference", "paper"],
    "input1": ["input1", "read1", "r1", "fastq1", "input", "fastq"],
    "input2": ["input2", "read2", "r2", "fastq2"],
    "expected_platform": ["expectedplatform", "platform"],
    "expected_experiment": ["expectedexperiment", "experiment", "assay"],
    "baseline_name": ["baselinename", "baseline", "competitor", "tool"],
    "notes": ["notes", "note", "comment", "comments"],
}


def names_of(column: str) -> list[str]:
    plain = column.replace("_", "")
    own = [p + plain[3:] for p in OWN] + [plain[3:]] if column.startswith("own_") else []
    return [plain, *ALIASES.get(column, []), *own]


def read_table(spark: SparkSession, path: str, columns: list[str] = MANIFEST, require: str | None = "dataset_id") -> DataFrame:
    """A tab- or comma-separated table by header aliases: blank lines and # comments are skipped, unknown columns ignored.

    Cells aren't unquoted, as files of this kind are written elsewhere. A cell that should be a number and isn't is an
    error with its line, and so is a repeated data set.
    """
    text = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where((F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit("#")))
    head = text.orderBy("line").first()
    if head is None:
        raise ValueError(f"{path} has no header")
    mark = "\t" if "\t" in head.value else ","
    found = ["".join(ch for ch in h.lower() if ch.isalnum()) for h in head.value.split(mark)]
    parts = text.where(F.col("line") > head.line).withColumn("c", F.split("value", mark, -1))
    out = []
    for column in columns:
        at = next((found.index(n) for n in names_of(column) if n in found), None)
        raw = F.nullif(F.trim(F.get("c", F.lit(at))), F.lit("")) if at is not None else F.lit(None).cast("string")
        if column in NUMBERS:
            value = raw.try_cast("double")
            wrong = F.raise_error(F.concat(F.lit(f"{path}: {column} isn't a number in line "), F.col("line").cast("string"))).cast("double")
            raw = F.when(raw.isNotNull() & value.isNull(), wrong).otherwise(value)
        out.append(raw.alias(column))
    rows = parts.select("line", *out)
    if require:
        n = F.count("*").over(Window.partitionBy(require))
        bad = F.when((n > 1) & F.col(require).isNotNull(), F.raise_error(F.concat(F.lit(f"{path}: repeated {require} "), F.col(require))).cast("string")).otherwise(F.col(require))
        rows = rows.withColumn(require, bad)
    return rows.drop("line")


def as_table(df: DataFrame, mark: str = "\t") -> DataFrame:
    """One column of lines, the header first: numbers with six digits, blanks for nulls, quoted where the mark occurs."""
    cell = lambda c, t: F.when(F.col(c).isNull(), "").otherwise(F.format_string("%.6f", F.col(c)) if t == "double" else F.col(c).cast("string"))
    quoted = lambda v: F.when(v.rlike('["\\n\\r' + ("\\t" if mark == "\t" else ",") + "]"), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    rows = df.select(F.lit(1).alias("part"), F.concat_ws(mark, *(quoted(cell(c, t)) for c, t in df.dtypes)).alias("value"))
    head = df.sparkSession.createDataFrame([(0, mark.join(df.columns))], "part int, value string")
    return head.union(rows).orderBy("part", "value").select("value")


def key(c: Column) -> Column:
    return F.lower(F.trim(c))


def target(manifest: DataFrame, annotations: DataFrame) -> DataFrame:
    """annotations with the data set they are for, or null: by id or by accession, which mustn't name two data sets.

    Two equi-joins rather than one on either key; of manifest rows with one key the last wins.
    """
    ids = manifest.groupBy(key(F.col("dataset_id")).alias("k1")).agg(F.max_by("dataset_id", "at").alias("by_id"))
    names = manifest.where("accession is not null").groupBy(key(F.col("accession")).alias("k2")).agg(F.max_by("dataset_id", "at").alias("by_accession"))
    both = annotations.join(ids, key(F.col("dataset_id")) == F.col("k1"), "left").join(names, key(F.col("accession")) == F.col("k2"), "left")
    clash = F.raise_error(F.concat_ws(" ", F.lit("id and accession name two data sets:"), "by_id", "by_accession")).cast("string")
    found = F.when(F.col("by_id") != F.col("by_accession"), clash).otherwise(F.coalesce("by_id", "by_accession"))
    return both.withColumn("target", found).drop("k1", "k2", "by_id", "by_accession")


def unmatched(targets: DataFrame) -> DataFrame:
    return targets.where("target is null")


def repeated(targets: DataFrame) -> DataFrame:
    """(target, n) of data sets that several annotations are for."""
    return targets.where("target is not null").groupBy("target").agg(F.count("*").alias("n")).where("n > 1")


def merge_value(old: Column, new: Column, overwrite: bool) -> Column:
    """(value, outcome): a gap is filled; a different value replaces the old one only if asked to."""
    outcome = F.when(new.isNull() | old.eqNullSafe(new), "unchanged").when(old.isNull(), "filled").when(F.lit(overwrite), "overwritten").otherwise("unchanged")
    return F.struct(F.when(outcome.isin("filled", "overwritten"), new).otherwise(old).alias("value"), outcome.alias("outcome"))


def merge_name(old: Column, new: Column, overwrite: bool) -> Column:
    """The same for a baseline's name, of which `baseline` is a placeholder."""
    n = F.trim(new)
    outcome = F.when(n.isNull() | (n == "") | old.eqNullSafe(n), "unchanged").when(old.isNull() | (F.trim(old) == "") | (old == "baseline"), "filled").when(F.lit(overwrite), "overwritten").otherwise("unchanged")
    return F.struct(F.when(outcome.isin("filled", "overwritten"), n).otherwise(old).alias("value"), outcome.alias("outcome"))


def merge_notes(old: Column, new: Column, overwrite: bool) -> Column:
    """The same for notes, to which new segments are appended."""
    n = F.nullif(F.trim(new), F.lit(""))
    has = F.exists(F.split(old, r"\|"), lambda s: F.trim(s) == n)
    outcome = (
        F.when(n.isNull(), "unchanged").when(old.isNull() | (F.trim(old) == ""), "filled").when(F.trim(old) == n, "unchanged")
        .when(F.lit(overwrite), "overwritten").when(has, "unchanged").otherwise("appended")
    )
    value = F.when(outcome.isin("filled", "overwritten"), n).when(outcome == "appended", F.concat(old, F.lit(" | "), n)).otherwise(old)
    return F.struct(value.alias("value"), outcome.alias("outcome"))


def annotate(manifest: DataFrame, annotations: DataFrame, columns: list[str], overwrite: bool = False) -> DataFrame:
    """The manifest with annotations merged in, and an array of outcomes. Fails if two annotations are for one data set."""
    found = target(manifest, annotations).where("target is not null")
    one = found.withColumn("__n", F.count("*").over(Window.partitionBy("target")))
    checked = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("two annotations for "), "target")).cast("string")).otherwise(F.col("target"))
    new = one.select(checked.alias("__target"), *(F.col(c).alias(f"__{c}") for c in columns))
    both = manifest.join(new, F.col("dataset_id") == F.col("__target"), "left")
    how = {"baseline_name": merge_name, "notes": merge_notes}
    merged = {c: how.get(c, merge_value)(F.col(c), F.col(f"__{c}"), overwrite) for c in columns}
    both = both.withColumns({f"__m_{c}": m for c, m in merged.items()})
    rest = [F.col(f"__m_{c}.value").alias(c) if c in columns else F.col(c) for c in manifest.columns]
    return both.select(*rest, F.array(*(F.col(f"__m_{c}.outcome") for c in columns)).alias("outcomes"))


def outcome_counts(annotated: DataFrame) -> DataFrame:
    """filled, overwritten, appended values and changed data sets."""
    n = lambda o: F.coalesce(F.sum(F.size(F.filter("outcomes", lambda x: x == o)).cast("long")), F.lit(0)).alias(o)
    changed = F.exists("outcomes", lambda x: x != "unchanged")
    return annotated.agg(F.count("*").alias("datasets"), n("filled"), n("overwritten"), n("appended"), F.count_if(changed).alias("changed"))


def coverage(manifest: DataFrame, columns: list[str]) -> DataFrame:
    """How many data sets have each of the columns."""
    return manifest.agg(F.count("*").alias("datasets"), *(F.count(c).alias(f"with_{c}") for c in columns))


def merge_records(records: DataFrame, by: str, columns: list[str], order: str = "at", strict: bool = True) -> DataFrame:
    """One row for each key out of many records: equal values agree, different ones are an error (or counted in conflicts).

    A baseline called `baseline` agrees with any name; notes are joined in order, each segment once.
    """
    plain = [c for c in columns if c not in ("notes", "baseline_name")]
    aggs = [a for c in plain for a in (F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c), F.countDistinct(c).alias(f"__n_{c}"))]
    named = F.when(F.trim("baseline_name") != "baseline", F.trim("baseline_name")) if "baseline_name" in columns else None
    if named is not None:
        aggs += [F.coalesce(F.min_by(named, F.when(named.isNotNull(), F.col(order))), F.max("baseline_name")).alias("baseline_name"), F.countDistinct(named).alias("__n_baseline_name")]
    if "notes" in columns:
        said = F.transform(F.array_sort(F.collect_list(F.when(F.trim("notes") != "", F.struct(order, F.trim("notes").alias("note"))))), lambda x: x["note"])
        aggs.append(F.nullif(F.array_join(F.array_distinct(said), " | "), F.lit("")).alias("notes"))
    merged = records.groupBy(by).agg(*aggs)
    checked = [c for c in columns if c != "notes"]
    conflicts = sum(((F.col(f"__n_{c}") > 1).cast("int") for c in checked[1:]), (F.col(f"__n_{checked[0]}") > 1).cast("int"))
    out = merged.withColumn("conflicts", conflicts)
    if strict:
        out = out.withColumn("conflicts", F.when(F.col("conflicts") > 0, F.raise_error(F.concat(F.lit("records disagree on "), F.col(by).cast("string"))).cast("int")).otherwise(F.col("conflicts")))
    return out.select(by, *columns, "conflicts")


def group_files(paths: DataFrame) -> DataFrame:
    """Data sets of a listing (path): (folder, stem, input1, input2, files), mates side by side."""
    folder, stem = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), fastq_stem(F.col("path"))
    rows = paths.where(F.col("path").rlike(r"(?i)\.(fastq|fq)(\.gz)?$")).select("path", folder.alias("folder"), mate_base(stem).alias("stem"), mate_number(stem).alias("mate"))
    first = F.coalesce(F.min(F.when(F.col("mate") == 1, F.col("path"))), F.min(F.when(F.col("mate").isNull(), F.col("path"))), F.min("path"))
    second = F.min(F.when(F.col("mate") == 2, F.col("path")))
    sets = rows.groupBy("folder", "stem").agg(first.alias("input1"), second.alias("input2"), F.count("*").alias("files"))
    return sets.withColumn("input2", F.when(F.col("input2") != F.col("input1"), F.col("input2")))


#: Columns of a table of requests, the first with an accession in a row is what the row asks for.
ASKED_BY = ["run_accession", "experiment_accession", "sample_accession", "study_accession", "geo_accession", "bioproject"]


def requested(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(at, accession) asked for by a table (at, columns...) or by free text (at, text), each once, in order."""
    if columns is None:
        tokens = accessions(F.col("text"))
    else:
        have = [c for c in ASKED_BY if c in columns]
        found = [accessions(F.coalesce(F.col(c), F.lit(""))) for c in have]
        rest = accessions(F.concat_ws(" ", *(F.col(c) for c in columns)))
        tokens = F.coalesce(*(F.when(F.size(t) > 0, t) for t in found), rest)
    flat = rows.select("at", F.posexplode(tokens).alias("nth", "accession"))
    return flat.groupBy("accession").agg(F.min(F.struct("at", "nth")).alias("f")).select(F.row_number().over(Window.orderBy("f")).alias("at"), "accession")


def input_paths(rows: DataFrame, root: str) -> DataFrame:
    """input1, input2 for metadata (dataset_id, paired, locations): the remote names under the root, or names that stand for them.

    Two names of a pair are put in order by their mates; one name serves a single file; anything else is assumed to be
    merged into files named after the data set.
    """
    folder = F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(F.trim("dataset_id"), "[^0-9A-Za-z_.-]", "_"))
    base = F.regexp_extract(folder, "([^/]*)$", 1)
    names = F.array_distinct(F.filter(F.transform("locations", lambda x: F.regexp_extract(F.rtrim(F.trim(x), F.lit("/")), "([^/?]*)([?].*)?$", 1)), lambda x: x != ""))
    rows = rows.withColumns({"__f": folder, "__b": base, "__n": names})
    mates = F.transform("__n", lambda x: mate_number(fastq_stem(x)))
    of = lambda m: F.get("__n", F.array_position(mates, F.lit(m)).cast("int") - 1)
    both = of(1).isNotNull() & of(2).isNotNull()
    two, one = F.col("paired") & (F.size("__n") == 2), ~F.col("paired") & (F.size("__n") == 1)
    at = lambda x: F.concat("__f", F.lit("/"), x)
    first = F.when(two, F.when(both, of(1)).otherwise(F.get("__n", F.lit(0)))).when(one, F.get("__n", F.lit(0))).when(F.col("paired"), F.concat("__b", F.lit("_1.fastq.gz"))).otherwise(F.concat("__b", F.lit(".fastq.gz")))
    second = F.when(two, F.when(both, of(2)).otherwise(F.get("__n", F.lit(1)))).when(F.col("paired"), F.concat("__b", F.lit("_2.fastq.gz")))
    return rows.withColumns({"input1": at(first), "input2": F.when(second.isNotNull(), at(second))}).drop("__f", "__b", "__n")


def from_metadata(rows: DataFrame, root: str) -> DataFrame:
    """A manifest of public run metadata (19 columns of text): names, platform, experiment, citation and inputs inferred."""
    from readprep.study import text as X

    locations = F.filter(F.split(F.coalesce(F.nullif(F.trim("fastq_ftp"), F.lit("")), F.nullif(F.trim("submitted_ftp"), F.lit("")), F.lit("")), "[;,]"), lambda x: F.trim(x) != "")
    label = X.platform(F.array("instrument_platform", "instrument_model"))
    words = F.array(*(F.coalesce(F.col(c), F.lit("")) for c in ("library_strategy", "library_source", "library_selection", "experiment_title", "sample_title", "study_title")))
    read = rows.select(
        F.col("run_accession").alias("dataset_id"), F.col("run_accession").alias("accession"), X.citation(F.array("study_accession", "study_title")).alias("citation"),
        label.alias("expected_platform"), X.experiment(words, label).alias("expected_experiment"), F.coalesce(X.boolish(F.col("library_layout")), X.locations_paired(locations)).alias("paired"), locations.alias("locations"),
    )
    return input_paths(read, root).drop("paired", "locations")


#: Columns of public metadata by which a row answers a request.
MATCHED_BY = ["run_accession", "study_accession", "experiment_accession", "sample_accession", "bioproject"]


def expand_requests(requests: DataFrame, resolved: DataFrame) -> DataFrame:
    """(accession, requested): every accession to ask for, with those of the request that led to it, in order."""
    own = requests.select("at", F.col("accession").alias("requested"), F.upper("accession").alias("accession"))
    via = requests.join(resolved, F.upper(requests["accession"]) == F.upper(resolved["geo"])).select("at", requests["accession"].alias("requested"), F.upper(resolved["accession"]).alias("accession"))
    every = own.union(via).groupBy("accession", "requested").agg(F.min("at").alias("at"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "requested"))), lambda x: x["requested"]), ";")
    return every.groupBy("accession").agg(F.min("at").alias("first_at"), joined.alias("requested"))


def match_metadata(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """(run_accession, query_accessions): metadata rows that name a requested accession in some matching field."""
    tokens = rows.select("run_accession", F.explode(F.array_distinct(F.flatten(F.array(*(F.coalesce(accessions(F.col(c)), F.array().cast("array<string>")) for c in MATCHED_BY))))).alias("accession"))
    hits = tokens.join(requests.select(F.upper("accession").alias("accession"), "at"), "accession").groupBy("run_accession", "accession").agg(F.min("at").alias("at"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "accession"))), lambda x: x["accession"]), ";")
    return hits.groupBy("run_accession").agg(F.min("at").alias("first_at"), joined.alias("query_accessions"))


def merge_fetched(rows: DataFrame, columns: list[str], strict: bool = True) -> DataFrame:
    """One row for each run_accession out of many fetched ones (at, run_accession, query_accessions, columns).

    Blanks are filled from other rows; different values of a column are an error, or are counted in conflicts. What the rows
    were asked by is united in order.
    """
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    asked = F.array_sort(F.collect_list(F.struct("at", F.split(F.coalesce("query_accessions", F.lit("")), ";").alias("names"))))
    united = F.array_distinct(F.filter(F.flatten(F.transform(asked, lambda x: x["names"])), lambda x: x != ""))
    values = [a for c in columns for a in (F.min_by(full(F.col(c)), F.when(full(F.col(c)).isNotNull(), F.col("at"))).alias(c), F.countDistinct(full(F.col(c))).alias(f"__n_{c}"))]
    merged = rows.groupBy("run_accession").agg(F.array_join(united, ";").alias("query_accessions"), *values)
    conflicts = sum(((F.col(f"__n_{c}") > 1).cast("int") for c in columns), F.lit(0))
    if strict:
        conflicts = F.when(conflicts > 0, F.raise_error(F.concat(F.lit("fetched rows disagree on "), F.col("run_accession"))).cast("int")).otherwise(conflicts)
    return merged.withColumn("conflicts", conflicts).select("run_accession", "query_accessions", *columns, "conflicts")


def resumable(statuses: DataFrame, rows: DataFrame) -> DataFrame:
    """(accession) of earlier requests (accession, status) that needn't be asked again.

    A matched one needs a row (query_accessions) that names it, an unmatched one is settled, a failed one is asked again.
    """
    named = rows.select(F.explode(F.split(F.coalesce("query_accessions", F.lit("")), ";")).alias("accession")).where("accession <> ''").distinct()
    matched = statuses.where("status = 'matched'").select("accession").join(named, "accession", "left_semi")
    return matched.union(statuses.where("status = 'unmatched'").select("accession")).distinct()


def has_downstream(side: str) -> Column:
    """Whether a row has any of the metrics of what follows cleaning."""
    return F.coalesce(*(F.col(f"{side}_{c}").cast("string") for c in DOWNSTREAM)).isNotNull()


def first_unmatched(targets: DataFrame, n: int = 5) -> DataFrame:
    """The first annotations that are for no data set."""
    return unmatched(targets).orderBy("at").limit(n).select("at", "dataset_id", "accession")


def fetch_status(requests: DataFrame, matched: DataFrame, failed: DataFrame) -> DataFrame:
    """(accession, status, matched_run_rows): matched goes before failed, the rest is unmatched."""
    runs = matched.select("run_accession", F.explode(F.split("query_accessions", ";")).alias("accession")).groupBy("accession").agg(F.count("*").alias("n"))
    every = requests.select(F.upper("accession").alias("accession")).distinct().join(runs, "accession", "left").join(failed.select(F.upper("accession").alias("accession"), F.lit(True).alias("bad")).distinct(), "accession", "left")
    return every.select("accession", F.when(F.col("n") > 0, "matched").when(F.col("bad"), "fetch_failed").otherwise("unmatched").alias("status"), F.coalesce("n", F.lit(0)).alias("matched_run_rows"))


def compare(datasets: DataFrame) -> DataFrame:
    """Differences and ratios of each data set against its baseline; null where either side is."""
    c = F.col
    deltas = {f"{m}_delta": c(m) - c(f"baseline_{m}") for m in CLEANUP[1:]} | {f"{m}_delta": c(f"own_{m}") - c(f"baseline_{m}") for m in ("alignment_rate", "duplicate_rate", "variant_f1", "coverage_breadth")}
    ratios = {f"{m}_ratio": ratio_or_null(c(f"own_{m}"), c(f"baseline_{m}")) for m in ("mean_coverage", "assembly_n50")}
    return datasets.withColumns({"input_speedup": speedup(c("input_bases_per_sec"), c("baseline_input_bases_per_sec")), **deltas, **ratios})


def aggregate(datasets: DataFrame) -> DataFrame:
    """The study in one row: averages (of no data sets 0), detection accuracy (null without expectations), comparisons."""
    mean = lambda m: F.coalesce(F.avg(m), F.lit(0.0)).alias(f"mean_{m}")
    right = lambda what: ratio_or_null(F.count_if(F.col(f"expected_{what}") == F.col(what)), F.count(f"expected_{what}")).alias(f"{what}_accuracy")
    return datasets.agg(F.count("*").alias("datasets"), *(mean(m) for m in CLEANUP), right("platform"), right("experiment"), F.count("baseline_name").alias("baselines"), F.count("input_speedup").alias("compared"), F.avg("input_speedup").alias("mean_input_speedup"), F.avg("alignment_rate_delta").alias("mean_alignment_rate_delta"))


