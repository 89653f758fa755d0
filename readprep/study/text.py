"""Names, accessions, platforms and experiments out of free text; Column expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readprep.functions import normal_name

#: Prefixes of public accessions; the last two are of the expression archive.
PREFIXES = ["SRR", "ERR", "DRR", "SRP", "ERP", "DRP", "SRX", "ERX", "DRX", "SRS", "ERS", "DRS", "PRJNA", "PRJEB", "PRJDB", "GSE", "GSM"]
#: What names a platform when an exact label doesn't, in order.
PLATFORM_WORDS = {"Illumina": ["illumina", "novaseq", "nextseq", "miseq", "hiseq"], "MGI": ["mgi", "dnbseq", "mgiseq"], "ONT": ["nanopore", "promethion", "gridion", "minion"], "PacBio": ["pacbio", "sequel", "revio", "rsii"]}
PLATFORM_LABELS = {"illumina": "Illumina", "mgi": "MGI", "ont": "ONT", "oxfordnanopore": "ONT", "pacbio": "PacBio", "iontorrent": "Ion Torrent"}
#: What results of tools append to the name of a data set.
RESULT_WORDS = ["happy", "vcfeval", "fastp", "flagstat", "markdup", "markduplicates", "duplication_metrics", "duplicationmetrics", "coverage", "mosdepth", "quast", "report", "summary", "results", "metrics", "annotations", "baseline_metrics", "downstream_metrics"]
RESULT_ENDINGS = ["txt", "log", "json", "csv", "tsv"]
#: Names of files that say nothing of the data set.
GENERIC = ["fastp", "quast", "report", "results", "result", "structuredresults", "structuredresult", "baseline", "metrics", "annotations", "summary", "txt", "log", "flagstat", "markdup", "markduplicates", "duplication", "picardmarkduplicates", "picard", "duplicationmetrics", "samtools", "samtoolscoverage", "coverage", "mosdepth", "happy", "happysummary", "vcfeval", "dataset", "assembly", "assemblies", "contigs", "contigs1", "contigs2", "scaffolds", "scaffold"]
TOOLS = {"fastp": "fastp", "cutadapt": "cutadapt", "trimgalore": "trim-galore", "trimmomatic": "trimmomatic", "bbduk": "bbduk", "adapterremoval": "adapterremoval", "skewer": "skewer"}
#: What stands for the tool under study in names of columns and paths.
OWN = ["own", "readprep"]

ACCESSION = f"^({'|'.join(PREFIXES)})[0-9]+$"
MATE = r"(?i)^(.+?)(_r[12]_001|[_.\-]r[12]|[_.\-][12])$"
RESULT_TAIL = rf"(?i)^(.+?)(?:[_.\-]*(?:\.(?:{'|'.join(RESULT_ENDINGS)})|[._\-](?:{'|'.join(RESULT_WORDS)})))+$"


def accessions(text: Column, geo: bool = True) -> Column:
    """Upper-case accessions among the alphanumeric tokens of a text, each once, in order."""
    tokens = F.filter(F.split(F.upper(text), "[^A-Z0-9]+"), lambda t: t.rlike(ACCESSION))
    return F.array_distinct(tokens if geo else F.filter(tokens, lambda t: ~t.rlike("^GS[EM]")))


def fastq_stem(name: Column) -> Column:
    """The base name of a path without FASTQ endings."""
    return F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"(?i)\.(fastq|fq)(\.gz)?$", "")


def mate_base(stem: Column) -> Column:
    """A stem without its mate's ending."""
    return F.when(stem.rlike(MATE), F.regexp_extract(stem, MATE, 1)).otherwise(stem)


def mate_number(stem: Column) -> Column:
    """1 or 2 by the ending of a stem, else null."""
    return F.when(stem.rlike(MATE), F.regexp_extract(F.regexp_replace(F.regexp_extract(stem, MATE, 2), "_001$", ""), "([12])$", 1).cast("int"))


def strip_result(name: Column) -> Column:
    """A file name without endings and words of tool results, as often as they follow each other."""
    trimmed = F.trim(name)
    return F.when(trimmed.rlike(RESULT_TAIL), F.regexp_extract(trimmed, RESULT_TAIL, 1)).otherwise(trimmed)


def dataset_hint(name: Column) -> Column:
    """What a result's file name says of its data set; null if that is a generic word."""
    hint = strip_result(name)
    return F.when((hint != "") & ~normal_name(hint).isin(GENERIC), hint)


def platform(values: Column) -> Column:
    """The platform of the first text of an array that names one, else null."""

    def one(v: Column) -> Column:
        n = normal_name(v)
        found = F.coalesce(*(F.when(n == k, label) for k, label in PLATFORM_LABELS.items()))
        for label, words in PLATFORM_WORDS.items():
            found = F.coalesce(found, F.when(n.rlike("|".join(words)), label))
        return found

    return F.get(F.filter(F.transform(values, one), lambda x: x.isNotNull()), F.lit(0))


def experiment(values: Column, platform_: Column) -> Column:
    """The experiment by words of any text, in order of how telling they are; long reads by their platform."""
    names = F.transform(values, normal_name)
    has = lambda pattern: F.exists(names, lambda n: n.rlike(pattern))
    both = lambda pattern: F.exists(names, lambda n: F.contains(n, F.lit("10x")) & n.rlike(pattern))
    return (
        F.when(both("v2|version2"), "10x v2").when(both("v3|version3|3prime"), "10x v3").when(has("atac"), "ATAC-seq")
        .when(has("rnaseq|transcriptome|mrna"), "RNA-seq").when(has("wgs|wholegenome|genome"), "WGS").when(has("longread"), "Long Read")
        .when(platform_.isin("ONT", "PacBio"), "Long Read")
    )


def citation(parts: Column) -> Column:
    """Distinct trimmed parts joined by bars; null if there are none."""
    kept = F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != "")))
    return F.when(F.size(kept) > 0, F.array_join(kept, " | "))


def boolish(text: Column) -> Column:
    """True for paired, false for single, null for anything else."""
    n = normal_name(text)
    return F.when(n.isin("paired", "pairedend", "pe", "true", "yes", "y", "2"), True).when(n.isin("single", "singleend", "se", "false", "no", "n", "1"), False)


def locations_paired(locations: Column) -> Column:
    """Whether remote files are mates: both endings occur, or there are two files without any."""
    mates = F.transform(locations, lambda x: mate_number(fastq_stem(x)))
    some = lambda n: F.exists(mates, lambda m: F.coalesce(m == n, F.lit(False)))
    none = ~F.exists(mates, lambda m: m.isNotNull())
    return (some(1) & some(2)) | (none & (F.size(locations) == 2))


def public_url(location: Column) -> Column:
    """A location as an address to load from: schemes stay, ftp hosts are asked by https, bare hosts get https."""
    t = F.trim(location)
    return F.when(t.rlike("^(?i)https?://"), t).when(t.rlike("^(?i)ftp://"), F.concat(F.lit("https://"), F.substring(t, F.lit(7), F.length(t)))).when(t != "", F.concat(F.lit("https://"), t))


def metric_side(path: Column) -> Column:
    """(side, tool) that a report's path names: the first telling token of its name, then of its folders from below."""
    parts = F.reverse(F.split(path, "/"))
    tokens = F.flatten(F.transform(F.slice(parts, 1, 5), lambda p: F.filter(F.split(F.lower(p), "[^a-z0-9]+"), lambda t: t != "")))
    known = [*OWN, *TOOLS, "baseline", "competitor"]
    first = F.get(F.filter(tokens, lambda t: t.isin(known)), F.lit(0))
    tool = F.coalesce(*(F.when(first == k, v) for k, v in TOOLS.items()))
    return F.struct(F.when(first.isin(OWN), "own").otherwise("baseline").alias("side"), tool.alias("tool"))


def allocate_ids(df, wanted: str = "wanted", order: str = "at"):
    """dataset_id: the sanitised wanted name, with -2, -3 and so on for later rows of the same name."""
    from pyspark.sql import Window

    clean = F.regexp_replace(F.regexp_replace(F.trim(F.col(wanted)), "[^0-9A-Za-z_.-]+", "_"), "^_+|_+$", "")
    clean = F.when(clean == "", "dataset").otherwise(clean)
    n = F.row_number().over(Window.partitionBy(clean).orderBy(order))
    return df.withColumn("dataset_id", F.when(n == 1, clean).otherwise(F.concat(clean, F.lit("-"), n.cast("string"))))
