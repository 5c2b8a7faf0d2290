"""Schemas of the engine's tables: fixed and declared, never inferred."""

from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType

PARAM_LONG = StructType([StructField("row_id", LongType()), StructField("col_id", LongType()), StructField("value", DoubleType())])
PARAM_WIDE = StructType([StructField("row_id", LongType()), StructField("row", ArrayType(DoubleType()))])
UPDATE = StructType(
    [StructField("worker", LongType()), StructField("clk", LongType()), StructField("row_id", LongType()), StructField("col_id", LongType()), StructField("delta", DoubleType())]
)
FEATURES = StructType(
    [StructField("label", DoubleType()), StructField("ids", ArrayType(IntegerType())), StructField("vals", ArrayType(FloatType())), StructField("dim", IntegerType())]
)
TREE_NODE = StructType(
    [StructField("tree_id", IntegerType()), StructField("node_id", LongType()), StructField("feature_id", IntegerType()), StructField("split_val", DoubleType()), StructField("leaf_val", IntegerType())]
)
LOSS = StructType(
    [StructField("eval", IntegerType())]
    + [StructField(n, DoubleType()) for n in ("epoch", "batch", "zero_one", "entropy", "n_train", "test_zero_one", "n_test", "time")]
)
