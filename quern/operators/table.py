"""Shared parameter tables: an append-only log of commutative updates, read as aggregated snapshots."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.consistency import AggregateByValueController, AggregateController, Controller, PushController
from quern.operators.rows import CODECS, RowCodec, SparseRow
from quern.schema import PARAM_LONG, UPDATE


class Consistency(Enum):
    SSP = 0
    SSP_PUSH = 1
    SSP_AGGR = 2
    LOCAL = 6


@dataclass
class TableConfig:
    """How a table is kept. Fields without a Spark meaning (lock pools, cache sizes) have none here."""

    codec: RowCodec = field(default_factory=SparseRow)
    staleness: int = 0
    consistency: Consistency = Consistency.SSP
    order: str = "fifo"  # fifo, random, magnitude
    own_writes: str = "at_once"  # or "deferred": own updates show when they are folded
    snapshot_clock: int = 0  # 0: never
    snapshot_dir: str | None = None
    push_budget_kb: float = 100.0
    push_rows: int = 100
    by_value: bool = False  # importance relative to the values, where updates are sent by importance


@dataclass
class UpdateBatch:
    """Sparse (column, delta) updates of one row."""

    columns: list[int] = field(default_factory=list)
    deltas: list[float] = field(default_factory=list)

    def update(self, column: int, delta: float) -> UpdateBatch:
        self.columns.append(column)
        self.deltas.append(delta)
        return self


@dataclass
class DenseUpdateBatch:
    """A contiguous range of updates of one row."""

    start: int
    deltas: list[float]


def explode_batch(df: DataFrame, columns: str = "cols", deltas: str = "deltas") -> DataFrame:
    """Rows with parallel arrays as one row an update: col_id, delta."""
    rest = [c for c in df.columns if c not in (columns, deltas)]
    return df.select(*rest, F.explode(F.arrays_zip(F.col(columns).alias("c"), F.col(deltas).alias("d"))).alias("x")).select(*rest, F.col("x.c").alias("col_id"), F.col("x.d").alias("delta"))


def explode_dense_batch(df: DataFrame, start: str = "start", deltas: str = "deltas") -> DataFrame:
    """Rows with a first column and an array as one row an update: col_id, delta."""
    rest = [c for c in df.columns if c not in (start, deltas)]
    return df.select(*rest, start, F.posexplode(deltas).alias("i", "delta")).select(*rest, (F.col(start) + F.col("i")).alias("col_id"), "delta")


def combine_thread_updates(updates: DataFrame) -> DataFrame:
    """Updates as the workers' thread buffers leave them at the end of a clock: one a worker, clock and cell."""
    return updates.groupBy("worker", "clk", "row_id", "col_id").agg(F.sum("delta").alias("delta"))


def overwrite_column(cells: DataFrame, col_id: int, value: Column, low: float, high: float) -> DataFrame:
    """Cells with the values of one column set, within bounds."""
    return cells.withColumn("value", F.when(F.col("col_id") == col_id, F.least(F.greatest(value, F.lit(low)), F.lit(high))).otherwise(F.col("value")))


#: By application, the folder made where spark.checkpoint.dir is unset; the setting itself can't be changed in a running session.
_made: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one in local mode only, as executors elsewhere could not read it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _made:
            import tempfile

            _made[app] = "file://" + tempfile.mkdtemp(prefix="quern-")
        where = _made[app]
    return where.rstrip("/")


class ParamTable:
    """One table of a group. Writes append to the log, reads aggregate what the staleness contract shows."""

    def __init__(self, group: TableGroup, name: str, config: TableConfig):
        self.group, self.name, self.config = group, name, config
        spark = group.spark
        self.base = spark.createDataFrame([], PARAM_LONG)
        self.log = spark.createDataFrame([], UPDATE)
        self.waiting: list[tuple] = []  # single updates that are not in ``log`` yet
        self.folded = 0  # log entries of earlier clocks are in ``base``

    # -- writes
    def inc_frame(self, updates: DataFrame) -> None:
        """Append updates (worker, clk, row_id, col_id, delta)."""
        self.log = self.log.unionByName(updates.select(*[F.col(f.name).cast(f.dataType) for f in UPDATE]))

    def inc(self, row_id: int, col_id: int, delta: float, worker: int = 0) -> None:
        self.batch_inc(row_id, UpdateBatch([col_id], [delta]), worker)

    def batch_inc(self, row_id: int, batch: UpdateBatch, worker: int = 0) -> None:
        clk = self.group.clocks[worker]
        self.waiting += [(worker, clk, row_id, c, float(d)) for c, d in zip(batch.columns, batch.deltas)]

    def flush(self) -> None:
        """Append the waiting updates to the log, in one frame. Reads and clocks do so."""
        if self.waiting:
            some, self.waiting = self.waiting, []
            self.inc_frame(self.group.spark.createDataFrame(some, UPDATE))

    def dense_batch_inc(self, row_id: int, batch: DenseUpdateBatch, worker: int = 0) -> None:
        self.batch_inc(row_id, UpdateBatch(list(range(batch.start, batch.start + len(batch.deltas))), batch.deltas), worker)

    # -- reads
    def snapshot(self, worker: int | None = None, clock: int | None = None) -> DataFrame:
        """The cells that a reader at ``clock`` is guaranteed: all updates older than clock - staleness, and its own.

        No worker: all updates. A range of ids is read by joining the snapshot with it.
        """
        self.flush()
        if worker is None:
            return self.config.codec.apply(self.base, self.log)
        clock = self.group.clocks[worker] if clock is None else clock
        return self.config.codec.apply(self.base, self.controller.visible(self.log, clock, worker))

    def get(self, row_id: int, worker: int | None = None) -> DataFrame:
        return self.snapshot(worker).where(F.col("row_id") == row_id)

    @property
    def row_type(self) -> str:
        return type(self.config.codec).__name__

    @property
    def controller(self) -> Controller:
        """The consistency mode of the configuration."""
        c = self.config
        kind = {Consistency.SSP_PUSH: PushController, Consistency.SSP_AGGR: AggregateByValueController if c.by_value else AggregateController}.get(c.consistency, Controller)
        return kind(c.staleness, c.order, c.push_budget_kb * 1000, c.push_rows, c.own_writes == "at_once")

    def to_send(self, upto: int) -> DataFrame:
        """row_id of the rows whose updates of clocks below ``upto`` the consistency mode sends now."""
        self.flush()
        return self.controller.sent(self.log.where(F.col("clk") < upto), self.base)

    def prefetch(self, rows: list[int] | None = None) -> DataFrame:
        """A persisted snapshot (of ``rows``, or whole), read once to fill it; unpersist() forgets it. Each call reads anew."""
        df = (self.snapshot() if rows is None else self.snapshot().where(F.col("row_id").isin(rows))).persist()
        df.count()
        return df

    # -- clocks
    def fold(self, upto: int) -> None:
        """Move updates of clocks below ``upto`` into the base and cut the lineage by a checkpoint."""
        self.flush()
        old = self.log.where(F.col("clk") < upto)
        self.base = self.group.cut(self.config.codec.apply(self.base, old))
        self.log = self.group.cut(self.log.where(F.col("clk") >= upto))
        self.folded = upto

    def write_snapshot(self, directory: str, clock: int) -> None:
        self.snapshot().write.mode("overwrite").parquet(f"{directory}/table={self.name}/clock={clock}")

    def resume(self, directory: str, clock: int) -> None:
        self.base = self.group.spark.read.schema(PARAM_LONG).parquet(f"{directory}/table={self.name}/clock={clock}")


class ThreadBuffer:
    """A thread's own buffer before a table: updates of a cell add up here, and reach the table's log by flush()."""

    def __init__(self, table: ParamTable, worker: int):
        self.table, self.worker = table, worker
        self.cells: dict[tuple[int, int], float] = {}

    def inc(self, row_id: int, col_id: int, delta: float) -> None:
        self.cells[row_id, col_id] = self.cells.get((row_id, col_id), 0.0) + delta

    def batch_inc(self, row_id: int, batch: UpdateBatch) -> None:
        for c, d in zip(batch.columns, batch.deltas):
            self.inc(row_id, c, d)

    def dense_batch_inc(self, row_id: int, batch: DenseUpdateBatch) -> None:
        for i, d in enumerate(batch.deltas):
            self.inc(row_id, batch.start + i, d)

    def get(self, row_id: int) -> dict[int, float]:
        """The row as the worker may see it, with what waits here on top."""
        out = {r["col_id"]: r["value"] for r in self.table.get(row_id, self.worker).collect()}  # one row
        for (r, c), d in self.cells.items():
            if r == row_id:
                out[c] = out.get(c, 0.0) + d
        return out

    def flush(self) -> None:
        rows: dict[int, UpdateBatch] = {}
        for (r, c), d in self.cells.items():
            rows.setdefault(r, UpdateBatch()).update(c, d)
        for r, batch in rows.items():
            self.table.batch_inc(r, batch, self.worker)
        self.cells = {}


class TableGroup:
    """The tables of a job and one vector clock for all of them."""

    def __init__(self, spark: SparkSession, workers: int = 1, fold_every: int = 5):
        self.spark, self.fold_every = spark, fold_every
        self.clocks = dict.fromkeys(range(workers), 0)
        self.tables: dict[str, ParamTable] = {}

    def create_table(self, name: str, config: TableConfig | None = None) -> ParamTable:
        if name in self.tables:
            raise ValueError(f"table {name} exists")
        self.tables[name] = ParamTable(self, name, config or TableConfig())
        return self.tables[name]

    def get_table(self, name: str) -> ParamTable:
        if name not in self.tables:
            raise KeyError(f"no table {name}")
        return self.tables[name]

    @property
    def min_clock(self) -> int:
        return min(self.clocks.values())

    def clock(self, worker: int) -> int | None:
        """End a unit of work; the new global minimum if this worker alone held it back, else None."""
        before = self.min_clock
        self.clocks[worker] += 1
        now = self.min_clock
        if now == before:
            return None
        for t in self.tables.values():
            every = t.config.snapshot_clock
            if every and t.config.snapshot_dir and now % every == 0:
                t.write_snapshot(t.config.snapshot_dir, now)
            if now % self.fold_every == 0:
                # Never past what the stalest permitted read leaves out.
                t.fold(max(0, now - t.config.staleness))
        return now

    def barrier(self) -> None:
        """Clocks of every worker until all earlier updates are visible."""
        most = max((t.config.staleness for t in self.tables.values()), default=0)
        top = max(self.clocks.values())
        for w in self.clocks:
            while self.clocks[w] < top + most + 1:
                self.clock(w)

    def resume(self, directory: str, clock: int) -> None:
        """All tables from their snapshots of ``clock``, and every worker at that clock."""
        for t in self.tables.values():
            t.resume(directory, clock)
        self.clocks = dict.fromkeys(self.clocks, clock)

    def register_worker(self) -> int:
        w = max(self.clocks, default=-1) + 1
        self.clocks[w] = self.min_clock if self.clocks else 0
        return w

    def deregister_worker(self, worker: int) -> None:
        del self.clocks[worker]

    def cut(self, df: DataFrame) -> DataFrame:
        """Checkpoint in the shared folder, so that lost executors cost a read and nothing more."""
        if self.spark.sparkContext.getCheckpointDir() is None:
            self.spark.sparkContext.setCheckpointDir(shared_folder(self.spark))
        return df.checkpoint()


def make_codec(name: str, *args) -> RowCodec:
    return CODECS[name](*args)


def value_or(col: Column, default: float) -> Column:
    return F.coalesce(col, F.lit(default))
