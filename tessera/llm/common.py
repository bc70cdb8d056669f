"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; where none is named, set one on a local master (tests) and refuse on a cluster."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-ckpt-"))


def stable(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared checkpoint folder; it outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def id_fold(doc_id: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def utf8(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def bucket_count(df: DataFrame, rows: int) -> int:
    """Buckets for distributed_rank: about 128 rows each while that is below eight a shuffle partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(rows // 128, 8 * parts))


#: Bytes that a file of a narrow result should have at least.
FILE_BYTES = 1 << 20


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df, whose last step follows a shuffle, in no more tasks and files than its bytes fill; the width of a row is the schema's."""
    return df.coalesce(max(1, -(-rows * df._jdf.schema().defaultSize() // FILE_BYTES)))


def kept(keep: tuple[str, ...], own: tuple[str, ...]) -> list[Column]:
    """Columns to carry along; one that bears the name of a column of the operator's own is called NAME_kept."""
    taken = {x.lower() for x in own}
    return [F.col(f"`{c}`").alias(f"{c}_kept" if c.lower() in taken else c) for c in keep]


#: Rows of bucket starts up to which they are broadcast (about 10 MB); beyond, the join is a shuffled one.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """A checkpointed narrow table, broadcast if it is counted to have few rows; joins with a longer one are shuffled, and split where skewed."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def distributed_rank(df: DataFrame, by: list[str], bucket: str, order: list[Column], rank: str, total: str) -> DataFrame:
    """Zero-based rank of each row within its key, and the key's row count, without gathering a key.

    `bucket` is an integer column that never decreases along `order` within a key. Rows are counted by
    (key, bucket), the counts' running sums give each bucket's first rank, and rows are numbered inside
    their bucket only, so a key with a third of all rows is spread over all buckets. The starts are counted, and
    broadcast only if they are few. The key columns and the bucket must not be null.
    """
    keys = [*by, bucket]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(Window.partitionBy(*by)).alias(total))
    starts = small(stable(starts.coalesce(8)))  # a few small files: the table has a row per key and bucket
    inner = Window.partitionBy(*keys).orderBy(*order)
    return df.join(starts, keys).withColumn(rank, F.col("__start") + F.row_number().over(inner) - 1).drop("__start")
