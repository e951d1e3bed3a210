"""Helpers shared by the training-data operators: shared staging folder and Arrow text views."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space, as ``bytes.split()`` and ``bytes.strip()`` take it.
SPACES = b" \t\n\x0b\x0c\r"
#: Caches of this worker, by operator.
_caches: dict[str, Callable[[], None]] = {}
#: Paths of staged tables.
_staged: list[str] = []
#: Lower-cases A-Z and leaves every other byte.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a folder of its own; on a cluster that would be one folder a machine, so
    it is an error there.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="weir-shared-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def stage(df: DataFrame, label: str, narrow: bool = True, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    A table of narrow rows is rebalanced, so that it has few files while it is small and files of the advisory
    size however large it grows; what computes it keeps its own number of tasks. Staged tables go when no
    later plan reads them (``unstage``), with ``clear_stages``, or at the latest with the driver's JVM.
    """
    spark = df.sparkSession
    if narrow:
        df = df.hint("rebalance", 2 * max(2, spark.sparkContext.defaultParallelism))
    path = f"{shared_dir(spark)}/stage-{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    _staged.append(path)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _staged.remove(path)


def unstage(df: DataFrame) -> None:
    """Remove a staged table that no later plan reads."""
    path = getattr(df, "_staged_path", None)
    if path in _staged:
        _remove(df.sparkSession, path)


def clear_stages(spark: SparkSession) -> None:
    """Remove everything that this driver has staged; for use once its results are written."""
    for path in list(_staged):
        _remove(spark, path)


def staged() -> set[str]:
    """The folders of all staged tables."""
    return set(_staged)


def settle(spark: SparkSession, before: set[str], *keep: DataFrame) -> None:
    """Remove what was staged since ``before``, but for ``keep``, whose plans read nothing else of it."""
    kept = before | {getattr(df, "_staged_path", None) for df in keep}
    for path in [p for p in _staged if p not in kept]:
        _remove(spark, path)


#: Before the names of an operator's own columns beside a caller's, whose names may be any.
OWN = "\0"


def packed(df: DataFrame, columns: list[str], **own: Column) -> DataFrame:
    """``own`` columns and the caller's ``columns`` as one struct ``row``, so that no names clash."""
    return df.select(*[c.alias(n) for n, c in own.items()], F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))


def unpacked(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The caller's columns again, then the operator's own with ``OWN`` before their names."""
    for b in batches:
        row = b.column("row")
        row = row.combine_chunks() if isinstance(row, pa.ChunkedArray) else row
        rest = [n for n in b.schema.names if n != "row"]
        yield pa.RecordBatch.from_arrays([*row.flatten(), *(b.column(n) for n in rest)], [*columns, *(OWN + n for n in rest)])


def text_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and UTF-8 bytes of a string column; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def release() -> None:
    """Give freed memory back to the system: workers live on, and share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def hold(name: str, forget: Callable[[], None]) -> None:
    """This worker keeps a cache for the operator ``name``; the next partition of another one forgets it."""
    _caches[name] = forget


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20, cache: str = "") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of ``column`` (a longer single text stays whole).

    ``cache`` names the cache that the operator uses; others are forgotten.
    """
    for name in [n for n in _caches if n != cache]:
        _caches.pop(name)()
    for batch in batches:
        off, _ = text_view(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()


def texts(col: pa.Array) -> list[bytes]:
    """The column's values as UTF-8 bytes; null reads as empty."""
    off, raw = text_view(col)
    whole = raw.tobytes()
    cuts = off.tolist()
    return [whole[a:b] for a, b in zip(cuts, cuts[1:])]
