"""A running profile of a stream's columns.

Each micro-batch is reduced to counts, means, squared deviations from these, and extremes, which are written under the batch's
id; a batch that is run again after a failure writes over its own part. The profile is the merge of all parts; deviations from
parts' own means keep their digits where values are large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def partial(df: DataFrame) -> DataFrame:
    """A row a column: column, n, nulls, and for numbers mean, deviation (the sum of squared ones), low, high."""
    parts = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        x = F.when(~F.isnan(c.cast("double")), c.cast("double")) if isinstance(f.dataType, _NUMBERS) else F.lit(None).cast("double")
        missing = c.isNull() | F.coalesce(F.isnan(c.cast("double")), F.lit(False)) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c.isNull()
        parts.append(F.struct(F.lit(f.name).alias("column"), F.count(F.lit(1)).alias("n"), F.count_if(missing).alias("nulls"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("deviation"), F.min(x).alias("low"), F.max(x).alias("high")))
    return df.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def start(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Starts the query that profiles a streaming DataFrame into a folder."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        partial(batch).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """column, count, nan_count, mean, std, min and max over all batches so far."""
    parts = spark.read.parquet(path).withColumn("m", F.col("n") - F.col("nulls"))
    of = parts.groupBy("column").agg((F.sum(F.col("m") * F.col("mean")) / F.nullif(F.sum(F.when(F.col("mean").isNotNull(), F.col("m"))), F.lit(0))).alias("whole"))
    far = F.col("deviation") + F.col("m") * F.pow(F.col("mean") - F.col("whole"), F.lit(2))  # both tables have a row a column or part
    x = parts.join(F.broadcast(of), "column").groupBy("column").agg(F.sum("m").alias("count"), F.sum("nulls").alias("nan_count"), F.first("whole").alias("mean"), F.sum(far).alias("far"), F.min("low").alias("min"), F.max("high").alias("max"))
    std = F.when(F.col("mean").isNotNull(), F.sqrt(F.greatest(F.col("far"), F.lit(0.0)) / F.nullif(F.col("count") - 1, F.lit(0))))
    return x.select("column", "count", "nan_count", "mean", std.alias("std"), "min", "max")
