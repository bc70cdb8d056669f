"""Paragraph chunks and their incremental upkeep."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import paragraphs, sha256
from ..plans.stable import stable
from .vectors import embed


def group_paragraphs(lengths: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """First and last paragraph of each chunk.

    A chunk takes paragraphs while their lengths, two more for each, stay within `size`, and one in any case. The next
    starts up to `overlap` paragraphs before its end, but never at or before the end of the chunk before the last one.
    """
    out: list[tuple[int, int]] = []
    first = floor = 0
    while first < len(lengths):
        last, used = first, lengths[first] + 2
        while last + 1 < len(lengths) and used < size and used + lengths[last + 1] + 2 <= size:
            last += 1
            used += lengths[last] + 2
        out.append((first, last))
        nxt = last + 1
        if nxt < len(lengths):
            first = max(nxt - min(overlap, last - first), floor)
        else:
            first = nxt
        floor = last + 1
    return out


def chunk(pages: DataFrame, size: int = 2000, overlap: int = 1, key: str = "slug") -> DataFrame:
    """key, chunk_index, start_char, end_char, content, content_hash of every page; an empty page has none.

    Paragraphs are cut in the JVM; the grouping depends on its own outcome, so it walks each page's list of lengths.
    An oversize paragraph stays whole.
    """
    if size <= 0 or overlap < 0:
        raise ValueError("size must be positive and overlap not negative")
    cut = pages.select(key, paragraphs("body").alias("p"))
    sized = cut.select(key, "p", F.transform("p", lambda x: F.length(x["text"])).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups = [group_paragraphs(n, size, overlap) for n in b.column(2).to_pylist()]
            kind = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[{"a": a, "z": z} for a, z in g] for g in groups], kind)], names=[key, "p", "g"])

    kinds = dict(sized.dtypes)
    grouped = sized.mapInArrow(run, f"{key} {kinds[key]}, p {kinds['p']}, g array<struct<a:int,z:int>>")
    rows = grouped.select(key, "p", F.posexplode("g").alias("chunk_index", "g"))
    own = F.slice("p", F.col("g.a") + 1, F.col("g.z") - F.col("g.a") + 1)
    rows = rows.select(key, "chunk_index", F.get("p", F.col("g.a"))["start"].alias("start_char"), F.get("p", F.col("g.z"))["end"].alias("end_char"), F.array_join(F.transform(own, lambda x: x["text"]), "\n\n").alias("content"))
    return rows.withColumn("content_hash", sha256("content"))


def changed(disk: DataFrame, index: DataFrame) -> DataFrame:
    """Files to chunk and embed anew: those whose (rel_path, content_hash) the index lacks."""
    return disk.join(index.select("rel_path", "content_hash"), ["rel_path", "content_hash"], "left_anti")


def reconcile(disk: DataFrame, index: DataFrame) -> DataFrame:
    """rel_path, status: reindexed, skipped, dropped (on disk but not indexable) or removed (indexed only).

    disk(rel_path, content_hash, indexable), index(rel_path, content_hash).
    """
    d, i = disk.alias("d"), index.alias("i")
    joined = d.join(i, F.col("d.rel_path") == F.col("i.rel_path"), "full_outer")
    status = (
        F.when(F.col("d.rel_path").isNull(), "removed")
        .when(~F.col("d.indexable"), "dropped")
        .when(F.col("d.content_hash") == F.col("i.content_hash"), "skipped")
        .otherwise("reindexed")
    )
    return joined.select(F.coalesce("d.rel_path", "i.rel_path").alias("rel_path"), status.alias("status"))


def orphans(disk: DataFrame, index: DataFrame) -> DataFrame:
    """Indexed files that are gone from disk or no longer indexable."""
    live = disk.filter("indexable").select("rel_path")
    return index.select("rel_path").join(live, "rel_path", "left_anti")


def indexable(path, in_local_tree, scope: str = "pages"):
    """Which files an index may hold: pages but reserved ones, sources only in the wider scope, the local tree never."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    page = F.startswith(path, F.lit("pages/")) & F.endswith(path, F.lit(".md")) & ~name.isin("index.md", "AGENTS.md", "CONTRIBUTORS.md")
    source = F.startswith(path, F.lit("sources/")) if scope == "pages+sources" else F.lit(False)
    return (page | source) & ~in_local_tree


def reindex(files: DataFrame, index: DataFrame, model, **chunking) -> tuple[DataFrame, DataFrame]:
    """(new index, report) after bringing an index up to date in three phases: compare hashes, chunk and embed what changed, put old and new rows together.

    files(rel_path, body, indexable), index(rel_path, content_hash, chunk_index, content, embedding). The report
    has rel_path, status (reindexed, skipped, dropped, removed, failed), error and tokens. A file of which a chunk cannot be embedded has failed: its
    old rows stay, and no other file is touched by it. Both results are checkpointed, so the model is called once.
    """
    hashed = files.withColumn("content_hash", sha256(F.coalesce("body", F.lit(""))))
    old = index.select("rel_path", "content_hash").distinct()
    status = stable(reconcile(hashed.select("rel_path", "content_hash", "indexable"), old))
    todo = hashed.join(status.filter("status = 'reindexed'"), "rel_path", "left_semi")
    made = chunk(todo.select("rel_path", F.coalesce("body", F.lit("")).alias("body")), key="rel_path", **chunking).select("rel_path", "chunk_index", "content")
    keyed = made.withColumn("__key", F.struct("rel_path", "chunk_index", "content"))
    done = stable(embed(keyed, "__key", "content", model).select("__key.*", "embedding", "error", "tokens"))
    wrong = done.filter("error is not null").groupBy("rel_path").agg(F.min("error").alias("error"))
    spent = done.groupBy("rel_path").agg(F.sum("tokens").alias("tokens"))
    report = status.join(wrong, "rel_path", "left").join(spent, "rel_path", "left")
    report = stable(report.select("rel_path", F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("status")).alias("status"), "error", F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens")))
    kept = index.join(report.filter("status in ('skipped', 'failed')"), "rel_path", "left_semi")
    fresh = done.join(report.filter("status = 'reindexed'").select("rel_path"), "rel_path", "left_semi").join(hashed.select("rel_path", "content_hash"), "rel_path")
    columns = ["rel_path", "content_hash", "chunk_index", "content", "embedding"]
    return stable(kept.select(*columns).unionByName(fresh.select(*columns))), report


def without_file(index: DataFrame, rel_path: str) -> DataFrame:
    """The index without a file's rows."""
    return index.filter(F.col("rel_path") != rel_path)
