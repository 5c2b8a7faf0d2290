"""Bounded staleness, update order and bandwidth budgets over update logs (worker, clk, row_id, col_id, delta)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ssp_view(updates: DataFrame, clock: int, staleness: int, worker: int | None = None) -> DataFrame:
    """The updates that a reader is guaranteed: clocks below max(0, clock - staleness) and its own."""
    seen = F.col("clk") < max(0, clock - staleness)
    return updates.where(seen if worker is None else seen | (F.col("worker") == worker))


def read_my_writes(snapshot: DataFrame, updates: DataFrame, version: int, worker: int) -> DataFrame:
    """Snapshot cells (row_id, col_id, value) of ``version`` with the worker's own later updates on top."""
    own = updates.where((F.col("worker") == worker) & (F.col("clk") >= version)).select("row_id", "col_id", "delta")
    return snapshot.select("row_id", "col_id", F.col("value").alias("delta")).unionByName(own).groupBy("row_id", "col_id").agg(F.sum("delta").alias("value"))


def asof_version(versions: DataFrame, bound: int, key: str = "row_id", version: str = "clk") -> DataFrame:
    """Of each key the row of the latest version up to ``bound``."""
    rest = [c for c in versions.columns if c != key]
    best = versions.where(F.col(version) <= bound).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("x"))
    return best.select(key, "x.*")


def vector_clock_min(updates: DataFrame) -> DataFrame:
    """One row: the least of the workers' latest clocks, min_clk."""
    return updates.groupBy("worker").agg(F.max("clk").alias("clk")).agg(F.min("clk").alias("min_clk"))


def push_clock(clock: Column, staleness: int, tolerance: int) -> Column:
    """min(clock, clock - staleness + tolerance)"""
    return F.least(clock, clock - staleness + tolerance)


def row_log_meta(updates: DataFrame) -> DataFrame:
    """Per row: first clock, summed |delta| and number of changed cells of the pending updates."""
    return updates.groupBy("row_id").agg(F.min("clk").alias("clk"), F.sum(F.abs("delta")).alias("importance"), F.countDistinct("col_id").alias("n_cols"))


def send_order(meta: DataFrame, policy: str = "fifo", seed: int = 0) -> list[Column]:
    """Sort keys of a policy; ties by row id."""
    if policy == "fifo":
        return [F.asc("clk"), F.asc("row_id")]
    if policy == "magnitude":
        return [F.desc("importance"), F.asc("row_id")]
    if policy == "random":
        return [F.xxhash64(F.lit(seed), "row_id").asc(), F.asc("row_id")]
    raise ValueError(policy)


def ranked_updates(meta: DataFrame, policy: str, seed: int = 0) -> DataFrame:
    """``meta`` with its place in the send order, from 1. ``meta`` has one row a dirty parameter row."""
    return meta.withColumn("place", F.row_number().over(Window.orderBy(*send_order(meta, policy, seed))))


def budget_cut(meta: DataFrame, budget_bytes: float, bytes_col: str = "bytes", policy: str = "magnitude", seed: int = 0) -> DataFrame:
    """Rows in send order until the bytes before them reach the budget."""
    w = Window.orderBy(*send_order(meta, policy, seed)).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(bytes_col).over(w), F.lit(0))
    return meta.withColumn("bytes_before", before).where(F.col("bytes_before") < budget_bytes)


def send_millis(size: Column, mbps: float) -> Column:
    return size * 8 / mbps / 1000


def push_dirty_rows(table: DataFrame, dirty: DataFrame, key: str = "row_id") -> DataFrame:
    """Change feed: rows whose key is in this batch's dirty set."""
    return table.join(dirty.select(key).distinct(), key, "left_semi")


def missing_rows(updates: DataFrame, base: DataFrame, key: str = "row_id") -> DataFrame:
    """Keys that the base lacks; they are to be created."""
    return updates.select(key).distinct().join(base.select(key).distinct(), key, "left_anti")


def top_important_rows(meta: DataFrame, k: int) -> DataFrame:
    return meta.orderBy(F.desc("importance"), "row_id").limit(k)


def squeeze_zeros(updates: DataFrame) -> DataFrame:
    """Updates summed by cell, zero sums gone: the filter stands after the aggregate, before anything is sent on."""
    return updates.groupBy("row_id", "col_id").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def dirty_rows(updates: DataFrame) -> DataFrame:
    return updates.select("row_id").distinct()


def server_version_min(acks: DataFrame, version: str = "clk", server: str = "server") -> DataFrame:
    """One row: the least over servers of the latest version that each has acknowledged, min_version."""
    return acks.groupBy(server).agg(F.max(version).alias("v")).agg(F.min("v").alias("min_version"))


def importance_while_applying(base: DataFrame, updates: DataFrame, order: list[str]) -> DataFrame:
    """Per row the sum of |u / x| over its updates in ``order``, x being the cell as the update finds it (|u| where it is 0).

    The windows are by cell, so that a row with many cells is dealt over tasks.
    """
    found = updates.join(base.select("row_id", "col_id", "value"), ["row_id", "col_id"], "left")
    before = Window.partitionBy("row_id", "col_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = (F.coalesce("value", F.lit(0)) + F.coalesce(F.sum("delta").over(before), F.lit(0))).cast("double")
    u = F.col("delta").cast("double")
    each = found.withColumn("x", x).withColumn("part", F.when(F.col("x") == 0, F.abs(u)).otherwise(F.abs(u / F.col("x"))))
    return each.groupBy("row_id").agg(F.sum("part").alias("importance"))


def partial_push(meta: DataFrame, k: int, factor: int = 5, policy: str = "magnitude", seed: int = 0) -> DataFrame:
    """``k`` of the first ``k * factor`` dirty rows by id: the most important ones, or by hash where the policy is random."""
    candidates = meta.orderBy("row_id").limit(k * factor)
    keys = [F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("row_id").cast("string"))), F.col("row_id")] if policy == "random" else [F.desc("importance"), F.asc("row_id")]
    return candidates.orderBy(*keys).limit(k)


def server_rows(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Rows as a server keeps them: whether updates made them dirty, and their importance (0 without any)."""
    meta = row_log_meta(updates).select("row_id", "importance", F.lit(True).alias("d"))
    rows = base.select("row_id").union(meta.select("row_id")).distinct().join(meta, "row_id", "left")
    return rows.select("row_id", F.coalesce("d", F.lit(False)).alias("dirty"), F.coalesce("importance", F.lit(0.0)).alias("importance"))


def flush_batches(updates: DataFrame, size: int, order: list[str]) -> DataFrame:
    """``updates`` with the number of the early flush, ``flush``, that each leaves with: a worker flushes every ``size`` updates of a clock."""
    place = F.row_number().over(Window.partitionBy("worker", "clk").orderBy(*order))
    return updates.withColumn("flush", F.floor((place - 1) / size).cast("bigint"))


class Controller:
    """What a consistency mode lets a reader see, and which updates it sends at the end of a clock.

    This one is plain bounded staleness: everything goes, unordered.
    """

    def __init__(self, staleness: int = 0, order: str = "fifo", budget_bytes: float = 100e3, batch: int = 1000, own_writes: bool = True):
        self.staleness, self.order, self.budget_bytes, self.batch, self.own_writes = staleness, order, budget_bytes, batch, own_writes

    def visible(self, updates: DataFrame, clock: int, worker: int | None = None) -> DataFrame:
        return ssp_view(updates, clock, self.staleness, worker if self.own_writes else None)

    def sent(self, pending: DataFrame, cached: DataFrame | None = None) -> DataFrame:
        """The rows whose pending updates are sent: row_id."""
        return dirty_rows(pending)


class PushController(Controller):
    """The server pushes what it has: a read takes the dirty rows anew and the others from the copy at hand."""

    def refresh(self, copy: DataFrame, table: DataFrame, dirty: DataFrame) -> DataFrame:
        """``copy`` of ``table`` with the rows of ``dirty`` (row_id) as they are now."""
        return copy.join(dirty.select("row_id").distinct(), "row_id", "left_anti").unionByName(push_dirty_rows(table, dirty))


class AggregateController(PushController):
    """Sends in the order of a policy, up to a budget of bytes; importance is the sum of |u|, 8 bytes a changed cell."""

    def importance(self, pending: DataFrame, cached: DataFrame | None = None) -> DataFrame:
        return row_log_meta(pending)

    def sent(self, pending: DataFrame, cached: DataFrame | None = None) -> DataFrame:
        meta = self.importance(pending, cached).withColumn("bytes", 8 * F.col("n_cols"))
        return budget_cut(meta, self.budget_bytes, policy=self.order).select("row_id")


class AggregateByValueController(AggregateController):
    """As AggregateController, importance being relative to the cached value where there is one: |u / x|."""

    def importance(self, pending: DataFrame, cached: DataFrame | None = None) -> DataFrame:
        meta = row_log_meta(pending)
        if cached is None:
            return meta
        x = F.col("value").cast("double")
        u = F.abs(F.col("delta").cast("double"))
        met = pending.join(cached.select("row_id", "col_id", "value"), ["row_id", "col_id"], "left")
        by_value = met.groupBy("row_id").agg(F.sum(F.when(F.coalesce(x, F.lit(0.0)) == 0, u).otherwise(u / F.abs(x))).alias("importance"))
        return meta.drop("importance").join(by_value, "row_id")
