"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the last
return the columns of documents. Nulls in any column, empty and very long texts, repeated rows, empty
tables and further columns of docs (which are dropped) are all taken; the operators' docstrings define each case.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import ensure_checkpoint_dir, id_fold, small, stable, table
from tessera.llm.decontaminate import contamination
from tessera.llm.language import FOREIGN_BITS, fit, identify
from tessera.llm.packing import pack
from tessera.llm.secrets import redact, scan_secrets
from tessera.llm.simhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of id and text; rows that share it are one document repeated."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.when(F.col("text").isNull(), F.lit("-")).otherwise(F.lit("=")), F.coalesce("text", F.lit("")))
    return docs.select(*COLUMNS, F.md5(key.cast("binary")).alias("row_key"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents written in one of the learned languages, with lang as predicted from the text.

    The model learns from labelled rows of docs as the query op2 does. Rejected are texts whose parse costs
    more than FOREIGN_BITS a code point in every learned language (other languages and scripts, random letters) and those without any
    letter, null and empty ones. If no row has a label there is nothing to tell languages by, and all rows stay.
    """
    model = fit(docs.filter(id_fold("doc_id", 4) != 2))
    if not model.langs:
        return docs.select(*COLUMNS)
    found = identify(docs.select(*COLUMNS), model, keep=("text", "source", "n_chars")).filter((F.col("lang_pred") != "und") & (F.col("bits") <= FOREIGN_BITS))
    return found.withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of SimHash near-duplicates: the one with the least doc_id (nulls last).

    Repeated rows are one document; of several of them one row stays.
    """
    keyed = _keyed(docs)
    found = near_duplicates(keyed, keep=("row_key",))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key")).alias("k")).select("k.row_key")
    nth = F.row_number().over(Window.partitionBy("row_key").orderBy("row_key", "lang", "source", "n_chars"))
    return keyed.join(first, "row_key", "left_semi").withColumn("nth", nth).filter("nth = 1").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents of which a twentieth or more lies inside benchmark windows."""
    keyed = _keyed(docs)
    found = contamination(keyed, table(spark, sf_dir, "benchmark"), keep=("row_key",))
    dropped = stable(found.filter("contaminated").select("row_key").distinct())
    return keyed.join(small(dropped), "row_key", "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep every document, with each secret replaced by its kind in brackets; n_chars follows the new text."""
    keyed = _keyed(docs)
    found = scan_secrets(keyed, keep=("row_key",)).filter(F.size("spans") > 0).select("row_key", "spans").dropDuplicates(["row_key"])
    joined = keyed.join(found, "row_key", "left")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col("spans")))
    chars = F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))
    return joined.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2,048 tokens; one row per piece."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language_id), ("near-dedup", near_dedup), ("decontamination", decontamination), ("secret scan", secret_scan), ("packing", packing)]

#: SimHash and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between two stages is a table in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    # the last stage has checkpointed its pieces, so nothing reads the tables between the stages any more
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return docs
