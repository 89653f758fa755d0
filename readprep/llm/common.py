"""Column handling, checkpoints and broadcast bounds shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readprep.operators.shared import checkpoint_dir, cut  # noqa: F401  the operators here take them from this module

WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, as new=old. Other columns may repeat or clash with any name.

    A name is matched exactly first and then without case; of several matches the first column is taken.
    """
    names = df.columns
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    return plain.select(*(F.col(f"c{position(names, old)}").alias(new) for new, old in wanted.items()))


def position(names: list[str], wanted: str) -> int:
    """The index of the column meant by a name; ValueError if there is none."""
    for same in (lambda a: a == wanted, lambda a: a.lower() == wanted.lower()):
        found = [i for i, n in enumerate(names) if same(n)]
        if found:
            return found[0]
    raise ValueError(f"no column {wanted!r} among {names}")


def carried(df: DataFrame, prefix: str = "__c") -> tuple[DataFrame, list[str]]:
    """All columns under safe names, and their original names in order."""
    return df.toDF(*(f"{prefix}{i}" for i in range(len(df.columns)))), list(df.columns)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; plain lower() serves the texts that are ASCII throughout."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int, limit: int = 1_000_000) -> DataFrame:
    """A broadcast hint for a table whose counted rows are within the limit, else the table as it is for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def either(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


#: Rows of an Arrow batch, where the session has the default. Batches hold whole texts, so rows bound them, and operators
#: put small ones together again by bytes.
BATCH_ROWS = 512


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session, and keep Arrow batches of texts small.

    Workers unpickle functions by module name, so they need the package also where the driver found it by sys.path alone.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if getattr(context, "_readprep_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(top):
        archive = os.path.join(tempfile.mkdtemp(prefix="readprep-"), "readprep.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(top):
                for name in sorted(files):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.join("readprep", os.path.relpath(path, top)))
        context.addPyFile(archive)
    context._readprep_shipped = True
