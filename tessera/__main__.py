"""python -m tessera COMMAND ROOT ...: a store on the command line. All rows are written, one a line, as JSON."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import lint
from .sources import markdown
from .store import Store

COMMANDS = [
    "read", "list", "grep", "search", "index", "index-rebuild", "outline", "backlinks", "write", "extend", "log", "rename", "record-run", "lint",
    "history", "evolution", "steering", "sources", "add-source", "ingest", "gc", "backfill", "refs", "stale", "similar", "reindex", "import", "import-vault", "export",
]


def _out(rows: DataFrame, *order: str) -> None:
    for line in (rows.orderBy(*order) if order else rows).toJSON().toLocalIterator():
        print(line)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("root")
    parser.add_argument("words", nargs="*")
    parser.add_argument("--strategy", default="bm25")
    parser.add_argument("--author", default="agent")
    parser.add_argument("--key")
    parser.add_argument("--into", default="")
    parser.add_argument("-k", type=int, default=5)
    parser.add_argument("-C", "--context", type=int, default=0)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    store, words = Store(spark, a.root, a.author), a.words
    question = lambda: spark.createDataFrame([(0, " ".join(words))], "qid long, question string")
    rows = {
        "list": lambda: (store.list_pages(), "slug"),
        "grep": lambda: (store.grep(words[0], context=a.context), "slug", "line_no"),
        "search": lambda: (store.search(question(), a.strategy, a.k), "rank"),
        "index": lambda: (store.index_level(words[0] if words else ""), "name"),
        "outline": lambda: (store.outline(words[0]), "pos"),
        "backlinks": lambda: (store.backlinks(words[0]), "src"),
        "history": lambda: (store.history(words[0]), "nth"),
        "evolution": lambda: (store.evolution(words), "ts"),
        "steering": lambda: (store.steering(), "date"),
        "sources": lambda: (store.sources, "rel_path"),
        "refs": lambda: (store.refs(), "rel_path", "token"),
        "stale": lambda: (store.stale(), "slug", "cited"),
        "similar": lambda: (store.similar(words[0], a.k), "rank"),
        "reindex": lambda: (store.reindex(), "rel_path"),
        "backfill": lambda: (store.backfill_keys(), "candidate"),
        "import": lambda: (store.import_pages(markdown.parse_all(markdown.read_files(spark, words[0]))), "path"),
    }
    acts = {
        "index-rebuild": store.rebuild_index,
        "write": lambda: store.write_page(words[0], words[1], sys.stdin.read()),
        "extend": lambda: store.extend_page(words[0], sys.stdin.read()),
        "log": lambda: store.append_log(" ".join(words)),
        "rename": lambda: store.rename_page(words[0], words[1]),
        "record-run": store.record_run,
        "ingest": lambda: store.record_ingestion(words[0], words[1:]),
        "gc": store.collect_sources,
    }
    if a.command in rows:
        _out(*rows[a.command]())
    elif a.command in acts:
        done = acts[a.command]()
        if done is not None:
            print(done)
    elif a.command == "read":
        print(store.read(words[0])["body"])
    elif a.command == "add-source":
        files = markdown.read_files(spark, words[0], words[1] if len(words) > 1 else "*").select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "content", F.lit(a.key).cast("string").alias("document_key"))
        _out(store.add_sources(files, a.into), "rel_path")
    elif a.command == "import-vault":
        notes = markdown.import_vault(markdown.read_files(spark, words[0]))
        none = F.array().cast("array<string>")
        parsed = notes.select("path", F.col("slug"), "title", none.alias("tags"), none.alias("aliases"), F.lit(None).cast("array<struct<path:string,sha256:string,extra:string>>").alias("provenance"), "body", F.lit(None).cast("timestamp").alias("updated"), F.lit(None).cast("string").alias("error"))
        _out(store.import_pages(parsed), "path")
    elif a.command == "export":
        pages = store.pages.select(F.concat(F.translate("slug", ":", "/"), F.lit(".md")).alias("path"), "slug", "title", "tags", "aliases", F.transform("provenance", lambda p: F.struct(p["path"].alias("path"), p["sha256"].alias("sha256"), F.lit(None).cast("string").alias("extra"))).alias("provenance"), F.lit(None).cast("timestamp").alias("created"), "updated", F.lit("{}").alias("extra"), "body", F.lit(None).cast("string").alias("error"))
        print(markdown.write_files(pages, words[0]))
    else:
        found = store.lint()
        _out(found, "path", "kind", "detail")
        return lint.exit_code(found)
    return 0


if __name__ == "__main__":
    sys.exit(main())
