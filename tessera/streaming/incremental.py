"""Extensions for streams: incremental chunking, steering windows, a running registry of versions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sha256
from ..operators.chunks import chunk


def steering_windows(commits: DataFrame, agent, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, author, n: commits of others than the agent by window, with a watermark for late ones; batch or stream."""
    others = commits.filter(F.col("author") != agent).withWatermark("date", late)
    counted = others.groupBy(F.window("date", window), "author").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "author", "n")


def retained_windows(commits: DataFrame, window: str = "7 days", late: str = "2 days") -> DataFrame:
    """start, prefix, n: commits by subject prefix and window."""
    prefixed = commits.withWatermark("date", late).withColumn("prefix", F.regexp_extract("subject", r"^(\w+):", 1))
    return prefixed.groupBy(F.window("date", window), "prefix").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "prefix", "n")


def reindex_stream(files: DataFrame, table: str, checkpoint: str, size: int = 2000, overlap: int = 1):
    """Keep a Parquet table of chunks up to date with a stream of files(slug, body): each batch's changed pages are chunked and appended.

    Rows carry the page's hash and the batch; the newest batch of a page counts (current_chunks). A batch that runs
    again overwrites its own folder, so a lost executor or driver leaves no row twice.
    """

    def put(batch: DataFrame, number: int) -> None:
        once = batch.groupBy("slug").agg(F.max("body").alias("body")).withColumn("file_hash", sha256("body"))
        chunked = chunk(once, size, overlap).join(once.select("slug", "file_hash"), "slug")
        chunked.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def current_chunks(spark, table: str) -> DataFrame:
    """Chunks of each page's newest batch."""
    rows = spark.read.parquet(table)
    newest = rows.groupBy("slug").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["slug", "batch"])


def running_versions(arrivals: DataFrame, late: str = "1 day") -> DataFrame:
    """document_key, rel_path, supersedes, version of a stream of arrivals(document_key, rel_path, seq, ts): each key's newest path is kept as state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["seq", "rel_path"])
        out = []
        for path in rows["rel_path"]:
            if path != last:
                n += 1
                out.append((key[0], path, last, n))
                last = path
        state.update((last, n))
        yield pd.DataFrame(out, columns=["document_key", "rel_path", "supersedes", "version"])

    return arrivals.groupBy("document_key").applyInPandasWithState(step, "document_key string, rel_path string, supersedes string, version long", "last string, n long", "append", "NoTimeout")
