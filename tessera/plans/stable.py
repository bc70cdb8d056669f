"""Cutting lineage where iterations would make plans grow."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stable(df: DataFrame) -> DataFrame:
    """df as files in the shared checkpoint folder that the cluster names; where none is named, one is set on a local master (tests) and a cluster is refused."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-ckpt-"))
    return df.checkpoint(eager=True)


#: Bytes of a plan's input below which its rows are dealt to all cores: a small file may be a single row group, which one task would read alone.
SMALL_BYTES = 256 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """df, dealt by a key over all cores if its input is small; a larger one has its own many partitions and is not shuffled."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key) if size < SMALL_BYTES else df
