"""The corpus model over the given tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slug, title, body, tags."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat("source", F.lit(":doc-"), "doc_id").alias("slug"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), F.array("lang").alias("tags"))


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, question."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sha, author, date, subject, path: events as a history."""
    e = table(spark, sf_dir, "events")
    prefix = F.when(F.col("event_type") == "signup", "compact").when(F.col("event_type") == "click", "extend").otherwise("log")
    k = F.get_json_object("props", "$.k")
    return e.select(F.sha2(F.col("event_id").cast("string"), 256).alias("sha"), F.col("user_id").alias("author"), F.col("ts").alias("date"), F.concat(prefix, F.lit(": "), k).alias("subject"), F.concat(F.lit("pages/p"), F.col("event_id") % 50, F.lit(".md")).alias("path"))


def source_path():
    """Place of a document as a source, by its hash."""
    return F.concat("source", F.lit("/"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 12), F.lit("/"), "doc_id", F.lit(".txt"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel_path, sha256, document_key, seq: documents as registered versions."""
    d = table(spark, sf_dir, "documents")
    sha = F.sha2(F.col("text").cast("binary"), 256)
    return d.select(source_path().alias("rel_path"), sha.alias("sha256"), F.concat("source", F.lit("/"), "lang").alias("document_key"), F.col("doc_id").alias("seq"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, pos, target: hrefs of the web pages in order."""
    found = F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "target")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("src"), found)


SQL = {
    "c_pages": "SELECT source || ':doc-' || doc_id AS slug, string_split(text, chr(10))[1] AS title, text AS body, [lang] AS tags FROM documents",
    "c_bank": "SELECT item_id AS qid, text AS question FROM benchmark",
    "c_commits": """SELECT sha256(event_id::VARCHAR) AS sha, user_id AS author, ts AS date,
        CASE event_type WHEN 'signup' THEN 'compact' WHEN 'click' THEN 'extend' ELSE 'log' END || ': ' || json_extract_string(props, '$.k') AS subject,
        'pages/p' || (event_id % 50) || '.md' AS path FROM events""",
    "c_sources": "SELECT source || '/' || sha256(text)[1:12] || '/' || doc_id || '.txt' AS rel_path, sha256(text) AS sha256, source || '/' || lang AS document_key, doc_id AS seq FROM documents",
    "c_links": """SELECT page_id AS src, unnest(range(len(l))) AS pos, unnest(l) AS target
        FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)""",
}


def with_views(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
