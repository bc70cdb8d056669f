"""Proportional stratified interleaving: shards that all hold the mixture of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, distributed_rank, sized, table, utf8


def interleave_shards(docs: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source") -> DataFrame:
    """Cut the corpus into `shards` pieces whose row counts differ by one at most and whose mix of strata is the corpus's.

    Within each stratum rows are shuffled by md5(seed:id) and ranked; row r of n gets the fractional rank
    (2r + 1) / 2n; all rows are ordered by it and cut into equal pieces, so a stratum of n rows puts
    n / shards rows, give or take one, into every shard. Both ranks are distributed, so a stratum may
    hold any share of the rows.

    Result: one row per row of docs: id, stratum, size (UTF-8 bytes plus 1), text_crc32, frac, position, shard, slot.
    A null stratum is a stratum of its own, a null id is shuffled as the empty text, a null text has size 1.
    Rows that agree in id, size and text checksum are interchangeable; repeated rows are all kept. Other
    columns of docs are not read and not returned. An empty table gives an empty result.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.when(F.col(stratum_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(stratum_col))).alias("__stratum"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(utf8(text_col)).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")).alias("__h"),
    )
    rows = docs.count()
    buckets = bucket_count(docs, rows)
    ties = [F.col("__h"), F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    shuffled = base.withColumn("__b", F.floor(F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(2**32)))
    ranked = distributed_rank(shuffled, ["__stratum"], "__b", ties, "__r", "__total").drop("__b")
    ranked = ranked.withColumn("frac", (2 * F.col("__r") + 1) / (2 * F.col("__total"))).withColumn("__b", F.floor(F.col("frac") * buckets))
    placed = distributed_rank(ranked, [], "__b", [F.col("frac"), F.col("__stratum"), *ties], "position", "__rows")
    placed = placed.withColumn("shard", F.expr(f"position * {shards} div __rows").cast("int"))
    first = F.expr(f"(shard * __rows + {shards - 1}) div {shards}")
    out = placed.select("doc_id", F.when(F.col("__stratum") != "", F.expr("substring(__stratum, 2)")).alias("stratum"), "size", "text_crc32", "frac", "position", "shard", (F.col("position") - first).alias("slot"))
    return sized(out, rows)


def op4_interleave(spark, sf_dir: str) -> DataFrame:
    out = interleave_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP4_SQL = """
WITH tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t
), base AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS stratum,
         strlen(coalesce(text, '')) + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes,
         md5('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), summed AS (
  SELECT doc_id, stratum, size, h,
         xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM base, tab
), ranked AS (
  SELECT *, (2 * (row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id, size, text_crc32) - 1) + 1)::DOUBLE
            / (2 * count(*) OVER (PARTITION BY stratum))::DOUBLE AS frac
  FROM summed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY frac, stratum, h, doc_id, size, text_crc32) - 1 AS position, count(*) OVER () AS n
  FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (position * 16 // n)::INT AS shard,
       position - ((position * 16 // n) * n + 15) // 16 AS slot, NULL::INT AS grown_shard
FROM placed
"""
