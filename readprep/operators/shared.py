"""Arrays that Python workers map from a file rather than copy.

The file is one in the folder of spark.checkpoint.dir, which all machines share, if that is a mounted one; else a broadcast's.
All workers of a machine share the mapped pages, and the system can drop and read them again; so a large array takes no
memory of its own, neither at the driver nor in a worker.
"""

from __future__ import annotations

import atexit
import gc
import os
import pickle
import shutil
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_MARK = b"readprep shared array\n"
#: The mark, filled up so that what follows is aligned in the pickled file.
_HEAD = _MARK + b"\n" * (-(pickle.dumps(_MARK + bytes(1 << 17), pickle.HIGHEST_PROTOCOL).find(_MARK) + len(_MARK)) % 8)


class Shared:
    """A one-dimensional array as a broadcast; may be part of a function that Spark sends to its workers."""

    def __init__(self, spark: SparkSession, array: np.ndarray):
        self.kind, self.size, self._array = array.dtype.str, len(array), None
        self.broadcast = spark.sparkContext.broadcast(b"".join((_HEAD, memoryview(np.ascontiguousarray(array)).cast("B") if len(array) else b"")))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_array": None}

    @property
    def array(self) -> np.ndarray:
        if self._array is None:
            self._array = self._mapped()
        return self._array

    def _mapped(self) -> np.ndarray:
        path = getattr(self.broadcast, "_path", None)
        if path and self.size and os.path.exists(path):
            with open(path, "rb") as f:
                at = f.read(256).find(_HEAD)
            if at >= 0:
                return np.asarray(np.memmap(path, self.kind, "r", at + len(_HEAD), (self.size,)))
        return np.frombuffer(self.broadcast.value, self.kind, self.size, len(_HEAD))  # an encrypted broadcast has no file to map


class Plain:
    """The same interface for an array in memory."""

    def __init__(self, array: np.ndarray):
        self.array = array


def share(spark: SparkSession | None, array: np.ndarray) -> Shared | Plain:
    return Shared(spark, array) if spark else Plain(array)


#: Folders of Store, and weak references to what the JVM holds as long as a plan needs them.
_FOLDERS: list[tuple[str, object]] = []


class Store:
    """Where long arrays are written: a new folder under spark.checkpoint.dir, or memory (no session) or broadcasts (path None)."""

    def __init__(self, spark: SparkSession | None):
        self.spark, self.path, self.mark = spark, None, None
        if spark is None:
            return
        if _FOLDERS:
            release(spark)
            sweep()
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        if named.isEmpty() and (spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)):
            checkpoint_dir(spark)
            named = spark.sparkContext._jsc.sc().getCheckpointDir()
        place = None if named.isEmpty() else spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named.get()).toUri()
        if place is not None and place.getScheme() == "file" and os.path.isdir(place.getPath()):
            self.path = tempfile.mkdtemp(prefix="arrays-", dir=place.getPath())
            os.chmod(self.path, 0o755)
            self.mark = spark.sparkContext.broadcast(self.path)
            _FOLDERS.append((self.path, spark.sparkContext._jvm.java.lang.ref.WeakReference(self.mark._jbroadcast)))


def sweep(all_: bool = False) -> None:
    """Deletes the folders whose arrays no plan and no object at the driver has any more."""
    for entry in list(_FOLDERS):
        if all_ or entry[1].get() is None:
            _FOLDERS.remove(entry)
            shutil.rmtree(entry[0], ignore_errors=True)


atexit.register(sweep, True)


class Mapped:
    """A stretch of a file in a folder of Store."""

    def __init__(self, path: str, kind: str, lo: int, size: int, mark):
        self.path, self.kind, self.lo, self.size, self.mark, self._array = path, kind, lo, size, mark, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_array": None}

    @property
    def array(self) -> np.ndarray:
        if self._array is None:
            self._array = np.asarray(np.memmap(self.path, self.kind, "r", self.lo * np.dtype(self.kind).itemsize, (self.size,))) if self.size else np.zeros(0, self.kind)
        return self._array


class Long:
    """An array of known length that is written a piece at a time and then looked up by index."""

    def __init__(self, store: Store, name: str, kind: type, size: int, piece: int):
        self.kind, self.size, self.piece, self.whole = np.dtype(kind).str, size, piece, None
        self.parts: list[Shared | Plain | Mapped | None] = [None] * -(-size // piece)
        if store.path:
            path = os.path.join(store.path, name)
            with open(path, "wb") as f:
                f.truncate(size * np.dtype(kind).itemsize)
            self.whole = Mapped(path, self.kind, 0, size, store.mark)
            self.parts = [Mapped(path, self.kind, lo, min(piece, size - lo), store.mark) for lo in range(0, size, piece)]

    def put(self, store: Store, i: int, array: np.ndarray) -> None:
        """The piece i, whose length is piece, or what is left for the last."""
        if self.whole:
            self.write(i * self.piece, array)
        else:
            self.parts[i] = share(store.spark, array)

    def write(self, lo: int, array: np.ndarray) -> None:
        with open(self.whole.path, "r+b") as f:
            f.seek(lo * array.itemsize)
            array.tofile(f)

    def at(self, index: np.ndarray) -> np.ndarray:
        if self.whole or len(self.parts) == 1:
            return (self.whole or self.parts[0]).array[index]
        out, part = np.zeros(len(index), self.kind), index // self.piece
        for i in range(len(self.parts)):
            own = np.flatnonzero(part == i)
            out[own] = self.parts[i].array[index[own] - i * self.piece]
        return out


class Writer:
    """Fills a Long from its start by stretches of any length."""

    def __init__(self, store: Store, long: Long):
        self.store, self.long, self.held, self.n, self.done = store, long, [], 0, 0

    def add(self, array: np.ndarray) -> None:
        array = array.astype(self.long.kind)
        if self.long.whole:
            self.long.write(self.done, array)
            self.done += len(array)
            return
        self.held, self.n = [*self.held, array], self.n + len(array)
        while self.n and self.n >= (size := min(self.long.piece, self.long.size - self.done)):
            every = np.concatenate(self.held)
            self.long.put(self.store, self.done // self.long.piece, every[:size].copy())
            self.held, self.n, self.done = [every[size:]], self.n - size, self.done + size


def release(spark: SparkSession) -> None:
    """Have the shuffle files and checkpoints of frames that are gone deleted now, not when the driver's heap happens to fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. A local one only where none is named and all runs on one machine."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="readprep-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, written to the shared folder, and read from there by whoever follows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
