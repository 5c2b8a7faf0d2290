"""Row codecs: how the updates of one row merge, what an untouched cell holds, and how rows are read."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class RowCodec(ABC):
    """A commutative merge of cells. Subclass for a row type of your own; ``merge`` is any aggregate expression."""

    zero: float = 0.0
    drops_zero: bool = False

    @abstractmethod
    def merge(self, delta: Column) -> Column: ...

    def cells(self, updates: DataFrame, delta: str = "delta") -> DataFrame:
        """(row_id, col_id, value) of all updates: partial sums before the shuffle, zeros gone where the codec drops them."""
        out = updates.groupBy("row_id", "col_id").agg(self.merge(F.col(delta)).alias("value"))
        return out.where("value <> 0") if self.drops_zero else out

    def apply(self, base: DataFrame, updates: DataFrame) -> DataFrame:
        """Base cells with the updates merged in; cells that are missing are created."""
        both = base.select("row_id", "col_id", F.col("value").alias("delta")).unionByName(updates.select("row_id", "col_id", "delta"))
        return self.cells(both)

    @staticmethod
    def importance(current: Column, delta: Column) -> Column:
        """|u / x|, or |u| where x is 0."""
        return F.when(current == 0, F.abs(delta)).otherwise(F.abs(delta / current))


class DenseRow(RowCodec):
    def __init__(self, capacity: int):
        self.capacity = capacity

    def merge(self, delta: Column) -> Column:
        return F.sum(delta)

    def rows(self, updates: DataFrame) -> DataFrame:
        """(row_id, row array<double>) of ``capacity`` places."""
        m = F.map_from_entries(F.collect_list(F.struct("col_id", "value")))
        places = F.sequence(F.lit(0), F.lit(self.capacity - 1))
        return (
            self.cells(updates).groupBy("row_id").agg(m.alias("m"))
            .select("row_id", F.transform(places, lambda i: F.coalesce(F.try_element_at(F.col("m"), i.cast("bigint")), F.lit(0.0))).alias("row"))
        )


class SparseRow(RowCodec):
    drops_zero = True

    def merge(self, delta: Column) -> Column:
        return F.sum(delta)


class SortedRow(SparseRow):
    """Cells in descending order of value, ties by ascending column."""

    def top(self, updates: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("row_id").orderBy(F.desc("value"), "col_id")
        return self.cells(updates).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class SparseFeatureRow(SparseRow):
    """Cells in ascending order of id; ids lie below ``dim``."""

    def __init__(self, dim: int):
        self.dim = dim

    def rows(self, updates: DataFrame) -> DataFrame:
        cells = self.cells(updates).where((F.col("col_id") >= 0) & (F.col("col_id") < self.dim))
        return cells.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("col_id", "value"))).alias("entries"))


class MultiplicativeRow(RowCodec):
    """Cells start at 1 and merge by product."""

    zero = 1.0

    def merge(self, delta: Column) -> Column:
        return F.product(delta)


CODECS: dict[str, type[RowCodec]] = {"dense": DenseRow, "sparse": SparseRow, "sorted": SortedRow, "sparse_feature": SparseFeatureRow, "multiplicative": MultiplicativeRow}


def register_row(name: str, codec: type[RowCodec]) -> None:
    """Bind a name to a row type."""
    CODECS[name] = codec
