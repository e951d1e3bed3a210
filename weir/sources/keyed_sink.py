"""A keyed log as the sink of a stream, with a commit of its own: upserts and tombstones, each batch once.

A row, a change of its key, becomes (key, value), both JSON; a row whose ``op`` is 'd' becomes a tombstone, a null value. Of a key's rows that of the
largest ``version`` counts, a column named by an option. Streams are in append mode, the only one that Spark lets such sinks have
but for complete; rows that replace others carry their version instead. Each task writes a file that nobody sees yet. The batch is committed by
one more file, which names those of its tasks; readers take only files that a commit names. So a crash before the commit leaves files without effect, and
a batch that is run again after its commit is dropped, since its commit is there.

    spark.dataSource.register(KeyedSink)
    stream.writeStream.format("weir_keyed").option("path", path).option("key", "order_id").option("version", "offset")...

``path`` is a folder that driver and executors share, on any file system that pyarrow opens.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

#: Rows that a task holds before it writes them.
ROWS = 20_000
RECORD = pa.schema([("key", pa.string()), ("version", pa.int64()), ("value", pa.string())])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int = 0


class KeyedSink(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "weir_keyed"

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> KeyedWriter:
        return KeyedWriter(self.options["path"], self.options["key"].split(","), self.options["version"], schema.names)


class KeyedWriter(DataSourceStreamWriter):
    def __init__(self, path: str, key: list[str], version: str, names: list[str]):
        if missing := {*key, version} - set(names):
            raise ValueError(f"no columns {sorted(missing)}")
        self.path, self.key, self.version, self.names = path, key, version, names

    def _record(self, row) -> tuple[str, int, str | None]:
        own = dict(zip(self.names, row))
        op = own.pop("op", "u")
        text = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":"), default=str)
        return text({k: own[k] for k in self.key}), int(own[self.version]), None if op == "d" else text(own)

    def write(self, iterator: Iterator) -> Written:
        """A task's rows in a file of its own; none if it has no rows."""
        system, root = _open(self.path)
        file, n, held, out = f"{uuid.uuid4().hex}.parquet", 0, [], None
        try:
            for row in iterator:
                held.append(self._record(row))
                if len(held) == ROWS:
                    out = out or self._file(system, root, file)
                    out.write_table(_table(held))
                    n, held = n + len(held), []
            if held:
                out = out or self._file(system, root, file)
                out.write_table(_table(held))
        finally:
            if out:
                out.close()
        n += len(held)
        return Written(file if n else None, n)

    @staticmethod
    def _file(system: fs.FileSystem, root: str, file: str) -> pq.ParquetWriter:
        system.create_dir(f"{root}/data")
        return pq.ParquetWriter(f"{root}/data/{file}", RECORD, filesystem=system, compression="zstd")

    def commit(self, messages: list, batchId: int) -> None:
        """Name the batch's files; if it is committed already, they are another run's and go."""
        system, root = _open(self.path)
        done = f"{root}/commits/{batchId}.json"
        if system.get_file_info(done).type != fs.FileType.NotFound:
            self.abort(messages, batchId)
            return
        system.create_dir(f"{root}/commits")
        whole = [m for m in messages if m is not None and m.file]
        text = json.dumps({"batch": batchId, "files": [m.file for m in whole], "rows": sum(m.rows for m in whole)})
        fresh = f"{root}/commits/.{batchId}-{uuid.uuid4().hex}"
        with system.open_output_stream(fresh) as out:
            out.write(text.encode())
        system.move(fresh, done)  # whole or not at all

    def abort(self, messages: list, batchId: int) -> None:
        system, root = _open(self.path)
        for m in messages:
            if m is not None and m.file:
                system.delete_file(f"{root}/data/{m.file}")


def _table(records: list[tuple[str, int, str | None]]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*records), RECORD)], RECORD)


def _commits(path: str) -> list[dict]:
    """The commits under a path, a small record a batch."""
    system, root = _open(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    texts = []
    for f in found:
        if f.base_name.endswith(".json") and not f.base_name.startswith("."):
            with system.open_input_stream(f.path) as s:
                texts.append(json.loads(s.read()))
    return sorted(texts, key=lambda c: c["batch"])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """batch, key, version, value of everything that was committed."""
    files = [(c["batch"], name) for c in _commits(path) for name in c["files"]]
    if not files:
        return spark.createDataFrame([], "batch long, key string, version long, value string")
    rows = spark.read.schema("key string, version long, value string").parquet(*[f"{path}/data/{name}" for _, name in files])
    named = rows.select("key", "version", "value", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
    return named.join(spark.createDataFrame(files, "batch long, file string"), "file").select("batch", "key", "version", "value")


def read_latest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The row of largest version of each key (of the later batch, where versions are equal), without deleted ones.

    Dealt by key first: rows of texts are grouped by sorting, and partial groups would sort a task's whole split.
    """
    newest = read_log(spark, path).repartition("key").groupBy("key").agg(F.max_by(F.struct("value"), F.struct("version", "batch")).alias("r"))
    return newest.where("r.value is not null").select(F.from_json("r.value", schema).alias("v")).select("v.*")


def clean(path: str) -> int:
    """Remove files that no commit names; only while no query writes. How many there were."""
    system, root = _open(path)
    named = {name for c in _commits(path) for name in c["files"]}
    found = [f for f in system.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True)) if f.base_name not in named]
    for f in found:
        system.delete_file(f.path)
    return len(found)
