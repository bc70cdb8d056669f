"""Question banks as JSON, as one file or as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = "array<struct<question:string,gold_slugs:array<string>,source:string>>"


def load_bank(spark: SparkSession, path: str) -> DataFrame:
    """qid, question, gold, source of a file with the lists answerable and unanswerable; either may be missing."""
    raw = spark.read.schema(f"answerable {QUESTION}, unanswerable {QUESTION}").json(path, multiLine=True)
    none = F.array().cast(QUESTION)
    every = raw.select(F.posexplode(F.concat(F.coalesce("answerable", none), F.coalesce("unanswerable", none))).alias("qid", "q"))
    return every.select("qid", "q.question", F.coalesce("q.gold_slugs", F.array().cast("array<string>")).alias("gold"), "q.source")


def save_bank(bank: DataFrame, path: str) -> None:
    """The bank as JSON, one question a line; lines are read back with spark.read.json."""
    bank.select("qid", "question", "gold", "source").write.mode("overwrite").json(path)


def one_document(bank: DataFrame) -> DataFrame:
    """The bank as the text of one JSON document, as load_bank reads it. A bank is what a person can check by hand."""
    asked = F.struct("question", F.col("gold").alias("gold_slugs"), "source")
    can = F.size("gold") > 0
    lists = bank.agg(F.array_sort(F.collect_list(F.when(can, F.struct("qid", asked.alias("q"))))).alias("a"), F.array_sort(F.collect_list(F.when(~can, F.struct("qid", asked.alias("q"))))).alias("u"))
    return lists.select(F.to_json(F.struct(F.transform("a", lambda x: x["q"]).alias("answerable"), F.transform("u", lambda x: x["q"]).alias("unanswerable")), {"ignoreNullFields": "false"}).alias("value"))
