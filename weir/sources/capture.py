"""Change capture: a streaming source that reads a database table once, then its changes by position.

The source table has a table of changes beside it, which the database fills in the transaction of each change (by
triggers, or a capture service): position, op ('c', 'u', 'd') and the table's columns, of a deleted row those it had. Positions must become
visible in their order, as those of a single writer or a transaction log do.

The first batch is a snapshot as of the newest position: slices of the key, each read by a task over a connection of its own, with
op 'r' and that position. Rows that change while it is read come again with later positions, so a fold by key is right whichever
state the snapshot saw. Later batches are ranges of positions, cut into slices too. Offsets lie in the query's
checkpoint: after a restart the stream goes on behind the last batch, and a batch that is run again has the same positions.

Rows have the form of a change log: key columns, op, epoch, partition 0, offset, value (null for a delete), and ``before`` with ``before=true``:
a delete's old values.

    spark.dataSource.register(CaptureSource)
    spark.readStream.format("weir_capture").options(**capture_options("sqlite3", {"database": path}, CONTRACTS["order_info"])).load()
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from contextlib import closing
from datetime import datetime
from decimal import Decimal

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .contracts import Contract

#: Rows fetched at once.
FETCH = 5_000


def capture_options(module: str, connect: dict, contract: Contract, slices: int = 8, epoch: int = 128, before: bool = False, **more: str) -> dict[str, str]:
    """Options of the source: a DB-API module and the arguments of its ``connect``; ``more`` may name ``table`` and ``changes``."""
    return {
        "module": module, "connect": json.dumps(connect), "table": contract.name, "changes": f"{contract.name}_changes", "key": ",".join(contract.key), "columns": contract.schema.json(),
        "slices": str(slices), "epoch": str(epoch), "before": str(before).lower(), **more,
    }


class CaptureSource(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "weir_capture"

    def _columns(self) -> T.StructType:
        fields = T.StructType.fromJson(json.loads(self.options["columns"])).fields
        return T.StructType([T.StructField(f.name, f.dataType) for f in fields])

    def schema(self) -> T.StructType:
        columns = self._columns()
        kinds = {"op": T.StringType(), "epoch": T.IntegerType(), "partition": T.IntegerType(), "offset": T.LongType(), "value": columns}
        if self.options.get("before") == "true":
            kinds["before"] = columns
        return T.StructType([*[columns[k] for k in self.options["key"].split(",")], *[T.StructField(n, k) for n, k in kinds.items()]])

    def streamReader(self, schema: T.StructType) -> CaptureReader:
        return CaptureReader(dict(self.options), self._columns())


class Slice(InputPartition):
    """Rows ``since`` <= key < ``until`` of the snapshot as of a position, or changes with ``since`` < position <= ``until``."""

    def __init__(self, snapshot: bool, since, until, position: int):
        self.snapshot, self.since, self.until, self.position = snapshot, since, until, position


class CaptureReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], columns: T.StructType):
        self.o, self.columns = options, columns
        self.key = options["key"].split(",")
        self.slices = int(options["slices"])

    def _connect(self):
        return closing(importlib.import_module(self.o["module"]).connect(**json.loads(self.o["connect"])))

    def _ask(self, sql: str, *values) -> Iterator[tuple]:
        """Rows of a statement whose values stand for ``?``, in the module's own style."""
        style = importlib.import_module(self.o["module"]).paramstyle
        if style in ("format", "pyformat"):
            sql = sql.replace("?", "%s")
        elif style != "qmark":
            raise ValueError(f"parameters in {style} style")
        with self._connect() as db, closing(db.cursor()) as c:
            c.execute(sql, values)
            while rows := c.fetchmany(FETCH):
                yield from rows

    def initialOffset(self) -> dict:
        return {"position": -1}

    def latestOffset(self) -> dict:
        return {"position": next(self._ask(f"SELECT COALESCE(MAX(position), 0) FROM {self.o['changes']}"))[0]}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        a, z = start["position"], end["position"]
        if a >= z:
            return []
        if a >= 0:
            edges = sorted({a + (z - a) * i // self.slices for i in range(self.slices + 1)})
            return [Slice(False, x, y, z) for x, y in zip(edges, edges[1:])]
        first, table = self.key[0], self.o["table"]
        n = next(self._ask(f"SELECT COUNT(*) FROM {table}"))[0]
        edges = []
        for i in range(1, self.slices):
            edges += [r[0] for r in self._ask(f"SELECT {first} FROM {table} ORDER BY {first} LIMIT 1 OFFSET {n * i // self.slices}")]
        edges = sorted(set(edges))
        return [Slice(True, x, y, z) for x, y in zip([None, *edges], [*edges, None])]

    def read(self, partition: Slice) -> Iterator[tuple]:
        names, first = ", ".join(self.columns.names), self.key[0]
        epoch, before = int(self.o["epoch"]), self.o.get("before") == "true"
        where = [x for x in ((f"{first} >= ?", partition.since), (f"{first} < ?", partition.until)) if x[1] is not None]
        if partition.snapshot:
            sql = f"SELECT 'r', {int(partition.position)}, {names} FROM {self.o['table']}" + (" WHERE " + " AND ".join(w for w, _ in where) if where else "")
            rows = self._ask(sql, *[v for _, v in where])
        else:
            rows = self._ask(f"SELECT op, position, {names} FROM {self.o['changes']} WHERE position > ? AND position <= ? ORDER BY position", partition.since, partition.until)
        at = [self.columns.names.index(k) for k in self.key]
        for op, position, *values in rows:
            values = tuple(_typed(v, f.dataType) for v, f in zip(values, self.columns.fields))
            deleted = op == "d"
            yield (*[values[i] for i in at], op, epoch, 0, position, None if deleted else values, *([values if deleted else None] if before else []))

    def commit(self, end: dict) -> None:
        pass


def _typed(value, kind: T.DataType):
    """A database's value as Spark takes it; drivers differ in what they give for numbers and times."""
    if value is None:
        return None
    if isinstance(kind, T.DecimalType):
        return Decimal(str(value)).quantize(Decimal(1).scaleb(-kind.scale))
    if isinstance(kind, T.TimestampType):
        return datetime.fromisoformat(value) if isinstance(value, str) else value
    if isinstance(kind, T.DateType):
        return datetime.fromisoformat(value).date() if isinstance(value, str) else value
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return int(value)
    return str(value) if isinstance(kind, T.StringType) else value
