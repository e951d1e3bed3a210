"""A keyed serving table that a stream upserts into, whose files are merged level by level.

The table is bucketed and sorted by its key. Each micro-batch is a run of level 0, a file a bucket; when a level has ``fan`` runs, they
become one run of the level above: the newest version of each key, bucket by bucket, with no exchange, as
they are bucketed alike. So a row is rewritten once a level, the number of files stays bounded by buckets, fan and levels, and reading
the newest version of each key needs no exchange either. Deleted keys stay as tombstones until a merge takes in the oldest run; so a key's versions must come in their order, as from one log partition.

A batch that is run again replaces its run, or is skipped if that is merged already. A merge writes its run first and then removes
those it took in, the oldest first; until then rows are there twice, which readers of the newest version don't mind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from weir.operators import changelog

VERSION, DELETED = "ingest_version", "is_deleted"


@dataclass
class ServingTable:
    """Rows with ``ingest_version`` and ``is_deleted`` under ``path``, known to the session as ``name``."""

    spark: SparkSession
    name: str
    path: str
    schema: T.StructType
    key: tuple[str, ...]
    buckets: int = 32
    fan: int = 8

    def __post_init__(self) -> None:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        keys = ", ".join(f"`{k}`" for k in self.key)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, level int, first bigint, last bigint) USING parquet PARTITIONED BY (level, first, last) "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def runs(self) -> list[tuple[int, int, int, object]]:
        """(level, first batch, last batch, folder) of each run, the oldest first; those that a merge took in are left out."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/level=*/first=*/last=*")
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p) or []
        out = []
        for f in found:
            at, numbers = f.getPath(), []
            folder = at
            for _ in range(3):
                numbers.append(int(folder.getName().partition("=")[2]))
                folder = folder.getParent()
            out.append((numbers[2], numbers[1], numbers[0], at))
        whole = [r for r in out if not any(o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in out)]
        return sorted(whole, key=lambda r: r[1])

    def _write(self, rows: DataFrame, level: int, first: int, last: int) -> None:
        own = rows.select(*self.schema.names, F.lit(level).alias("level"), F.lit(first).cast("long").alias("first"), F.lit(last).cast("long").alias("last"))
        conf, mode = rows.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
        before = conf.get(mode)
        conf.set(mode, "dynamic")  # only the run's own folder is replaced; a stream's batches have a session of their own
        try:
            own.write.insertInto(self.name, overwrite=True)
        finally:
            conf.set(mode, before)
        for spark in (self.spark, rows.sparkSession):
            spark.catalog.refreshTable(self.name)

    def upsert(self, rows: DataFrame, batch_id: int) -> None:
        """Take in a batch, and merge what is full."""
        if not any(a <= batch_id <= z and level for level, a, z, _ in self.runs()):
            self._write(rows.repartition(self.buckets, *self.key), 0, batch_id, batch_id)
        self.compact()

    def compact(self) -> None:
        """Merge levels of ``fan`` runs or more."""
        level = 0
        while True:
            runs = self.runs()
            own = [r for r in runs if r[0] == level]
            if not any(r[0] >= level for r in runs):
                return
            if len(own) >= self.fan:
                self._merge(own, oldest=own[0] is runs[0])
            level += 1

    def _merge(self, own: list, oldest: bool) -> None:
        level, first, last = own[0][0], own[0][1], own[-1][2]
        rows = self.spark.table(self.name).where((F.col("level") == level) & (F.col("first") >= first) & (F.col("last") <= last)).select(*self.schema.names)
        newest = changelog.latest(rows, list(self.key), [VERSION])
        self._write(newest.where(f"{DELETED} = 0") if oldest else newest, level + 1, first, last)
        for *_, folder in own:
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.spark.catalog.refreshTable(self.name)

    def read(self) -> DataFrame:
        """The newest version of each key, without deleted ones."""
        self.spark.catalog.refreshTable(self.name)  # its files may be another session's
        return changelog.active(self.spark.table(self.name).select(*self.schema.names), list(self.key))


def start_upserts(rows: DataFrame, table: ServingTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Upsert a stream of versioned rows into a table."""
    stream = rows.writeStream.foreachBatch(lambda batch, i: table.upsert(batch, i)).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
