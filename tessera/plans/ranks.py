"""Ranks and neighbours in an order, without gathering a key or the whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stable import stable

#: Rows of part starts up to which they are broadcast.
BROADCAST_ROWS = 200_000


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with each row's place (from 1) in an order: sorted ranges are counted, and rows numbered inside their range."""
    ranged = stable(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + inner).drop("__part", "__start")


def next_in_key(df: DataFrame, key: str, place: str, tie: str, name: str, buckets: int | None = None) -> DataFrame:
    """df with the value of `tie` of the next row of the same key in the order (place, tie); null at a key's end.

    A key's rows are dealt into buckets of the number `place` whose bounds are its quantiles over all rows, so a key
    that holds a third of all rows is spread over a third of the tasks at least; the last row of a bucket is joined to the first one
    of the key's next bucket. Rows without a key have no next one, and are not dealt by it.
    """
    spark = df.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = df.approxQuantile(place, [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    cuts = F.array(*[F.lit(x) for x in sorted(set(bounds))]) if bounds else F.array().cast("array<double>")
    keyed = df.filter(F.col(key).isNotNull()).withColumn("__b", F.size(F.filter(cuts, lambda c: c < F.col(place))))
    own = Window.partitionBy(key, "__b").orderBy(place, tie)
    inside = keyed.withColumn(name, F.lead(tie).over(own))
    firsts = keyed.groupBy(key, "__b").agg(F.min(F.struct(place, tie)).alias("f"))
    after = stable(firsts.select(F.col(key), "__b", F.lead("f").over(Window.partitionBy(key).orderBy("__b"))[tie].alias("__after")))
    if after.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        after = F.broadcast(after)
    joined = inside.join(after, [key, "__b"], "left").withColumn(name, F.coalesce(name, "__after")).drop("__b", "__after")
    return joined.select(*df.columns, name).unionByName(df.filter(F.col(key).isNull()).withColumn(name, F.lit(None).cast(df.schema[tie].dataType)).select(*df.columns, name))
