"""What several of the operators share: the shared folder, Arrow helpers, hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points of text that a Python task turns into words at a time.
WINDOW = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where it is unset and the session runs in one process (tests, notebooks) a
    temporary folder is made; a cluster without the setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="pagequarry-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_folder(spark)}/pagequarry/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what ``scratch_path`` named, once no plan reads it any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Where the tables of ``written`` are, for as long as somebody holds them.
_WRITTEN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here.

    A lost executor costs a re-read of these files, never a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[again] = path
    return again


def dropped(*tables: DataFrame) -> None:
    """Delete what ``written`` made, once no plan that is still to run reads it."""
    for one in tables:
        path = _WRITTEN.pop(one, None)
        if path:
            drop_path(one.sparkSession, path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id) -> object:
    """Whether crc32(doc_id as text) mod 4 is 2, as a column; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_windows(text: str, size: int = WINDOW) -> Iterator[str]:
    """Cut ``text`` after blanks or newlines, about every ``size`` code points."""
    at, n = 0, len(text)
    while n - at > size:
        cut = max(text.rfind(" ", at, at + size), text.rfind("\n", at, at + size))
        if cut < at:
            ends = [x for x in (text.find(" ", at + size), text.find("\n", at + size)) if x >= 0]
            if not ends:
                break
            cut = min(ends)
        yield text[at : cut + 1]
        at = cut + 1
    yield text[at:]


def text_groups(texts: list[str], size: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``size`` code points together, one text at least."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        if i > start and total + len(text) > size:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def utf8_parts(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a string column as ``(first row, end row, bytes, offsets)``.

    ``bytes`` is a view of Arrow's buffer (nulls are empty), about ``size`` bytes unless a
    single text is longer; ``offsets`` has one entry more than there are rows.
    """
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], "<i8" if wide else "<i4")[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a multiply and xor-shift finaliser), in place where possible."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def flat_gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` for all i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


#: What empties the caches of words that operators keep in a Python process.
CACHES: list = []


def give_back() -> None:
    """Return freed memory to the system: what numpy and Python let go stays with the process otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def forget_caches() -> None:
    """Give back what other operators keep in this Python process; workers outlive their tasks."""
    for clear in CACHES:
        clear()
    gc.collect()
    give_back()


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any longer."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
