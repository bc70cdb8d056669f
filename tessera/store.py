"""The corpus as tables in one folder: reading, searching, writing, sources, versions."""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ConflictError, PageExists, PageNotFound, SlugError
from .functions.text import SLUG, preview, references, sha256, slug_to_path
from .operators import chunks, graph, history, lineage, lint, outline, retrieve, search, vectors
from .plans import strategy

#: name -> (columns, key). Tables without a key only grow.
TABLES = {
    "pages": ("slug string, title string, body string, tags array<string>, aliases array<string>, provenance array<struct<path:string,sha256:string>>, generated boolean, updated timestamp", ["slug"]),
    "log": ("ts timestamp, text string, day date", []),
    "commits": ("sha string, author string, date timestamp, subject string, path string", []),
    "runs": ("ts timestamp, head string", []),
    "sources": ("rel_path string, sha256 string, document_key string, superseded_by string, seq long", ["rel_path"]),
    "texts": ("rel_path string, text string", ["rel_path"]),
    "ingestions": ("id long, rel_path string, pages_touched array<string>, ts timestamp", ["id"]),
    "refs": ("rel_path string, token string, page_slug string, exact boolean", ["rel_path", "token"]),
    "stamps": ("rel_path string, scanned_at timestamp", ["rel_path"]),
    "state": ("name string, value string", ["name"]),
    "chunks": ("rel_path string, content_hash string, chunk_index int, content string, embedding array<double>", []),
}
#: Changes after which a table is written anew.
COMPACT = 40


class Store:
    """Tables below `root`; a write adds a small folder of changed rows and a numbered commit that names all folders of the table.

    A row of a later folder takes the place of an earlier one with its key, or takes it away. Commits are created
    by number and never overwritten, so of two writers at once one gets a ConflictError and nothing is lost; a write that fails
    before its commit changes nothing. After COMPACT changes a table is written whole again. Every write is also a row of the table commits.
    """

    def __init__(self, spark: SparkSession, root: str, author: str = "agent"):
        self.spark, self.root, self.author = spark, root.rstrip("/"), author
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    # --- tables

    def _commit(self, table: str) -> tuple[int, list[str]]:
        """Number of a table's last commit and its folders, oldest first."""
        if not self.fs.exists(self._path(table)):
            return 0, []
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(table)) if s.getPath().getName().startswith("commit-"))
        if not names:
            return 0, []
        stream = self.fs.open(self._path(table, names[-1]))
        try:
            return int(names[-1].split("-")[1]), json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def head(self, table: str) -> str | None:
        """Name of a table's state."""
        n, folders = self._commit(table)
        return f"{n}-{folders[-1]}" if folders else None

    def table(self, name: str) -> DataFrame:
        columns, key = TABLES[name]
        _, folders = self._commit(name)
        if not folders:
            return self.spark.createDataFrame([], columns)
        read = lambda f: self.spark.read.schema(f"{columns}, _n long, _gone boolean").parquet(f"{self.root}/{name}/{f}")
        plain = [c.split()[0] for c in re.sub("<[^ ]*>", "", columns).split(", ")]
        if not key:
            return reduce(DataFrame.unionByName, [read(f).select(*plain) for f in folders])
        base = read(folders[0])
        if len(folders) > 1:
            later = reduce(DataFrame.unionByName, [read(f) for f in folders[1:]])
            last = later.groupBy(*key).agg(F.max_by(F.struct(*later.columns), "_n").alias("r")).select("r.*")
            base = base.join(last.select(*key), key, "left_anti").unionByName(last)
        return base.filter("not _gone").select(*plain)

    def change(self, name: str, rows: DataFrame | None, gone: DataFrame | None = None) -> None:
        """Put rows in, and take rows with the keys of `gone` out."""
        columns, key = TABLES[name]
        n, folders = self._commit(name)
        kinds = self.spark.createDataFrame([], columns).schema
        parts = [] if rows is None else [rows.select(*[F.col(c).cast(t) for c, t in ((f.name, f.dataType) for f in kinds)], F.lit(n + 1).cast("long").alias("_n"), F.lit(False).alias("_gone"))]
        if gone is not None:
            parts.append(gone.select(*[F.col(f.name) if f.name in key else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds], F.lit(n + 1).cast("long").alias("_n"), F.lit(True).alias("_gone")))
        self._put(name, reduce(DataFrame.unionByName, parts), n + 1, folders)
        if len(folders) + 1 >= COMPACT:
            self.compact(name)

    def _put(self, name: str, rows: DataFrame, n: int, before: list[str]) -> None:
        folder = f"part-{uuid.uuid4().hex}"
        (rows.write.partitionBy("day") if name == "log" else rows.write).parquet(f"{self.root}/{name}/{folder}")
        try:
            out = self.fs.create(self._path(name, f"commit-{n:012d}"), False)
        except Exception as e:
            self.fs.delete(self._path(name, folder), True)
            raise ConflictError(f"{name} was changed by another writer") from e
        out.write(bytearray(json.dumps([*before, folder]).encode()))
        out.close()

    def compact(self, name: str) -> None:
        """Write a table whole, so that reading it need not put changes together."""
        n, folders = self._commit(name)
        if len(folders) > 1:
            self._put(name, self.table(name).withColumn("_n", F.lit(n + 1).cast("long")).withColumn("_gone", F.lit(False)), n + 1, [])

    def _done(self, subject: str, path: str) -> None:
        row = self.spark.createDataFrame([(uuid.uuid4().hex, self.author, subject, path)], "sha string, author string, subject string, path string")
        self.change("commits", row.withColumn("date", F.current_timestamp()))

    # --- pages

    @property
    def pages(self) -> DataFrame:
        return self.table("pages")

    @property
    def log(self) -> DataFrame:
        return self.table("log")

    @property
    def commits(self) -> DataFrame:
        return self.table("commits")

    def read(self, name: str) -> dict:
        """A page by its name or an alias."""
        asked = self.spark.createDataFrame([(name,)], "name string")
        rows = graph.resolve(asked, self.pages).select("slug").join(self.pages, "slug").limit(1).collect()
        if not rows:
            raise PageNotFound(name)
        return rows[0].asDict(recursive=True)

    def _checked(self, slug: str) -> None:
        if not re.fullmatch(SLUG[1:-1], slug) or slug == graph.RESERVED:
            raise SlugError(slug)

    def write_page(self, slug: str, title: str, body: str, tags: list[str] = (), aliases: list[str] = (), provenance: list[tuple] = ()) -> None:
        """Add a page. Its name must be new, and no other page's alias."""
        self._checked(slug)
        if self.pages.filter(F.col("slug") == slug).limit(1).count():
            raise PageExists(slug)
        if self.pages.filter(F.array_contains("aliases", slug)).limit(1).count():
            raise ConflictError(f"{slug} is an alias")
        row = self.spark.createDataFrame([(slug, title, body, list(tags), list(aliases), list(provenance), False, None)], TABLES["pages"][0]).withColumn("updated", F.date_trunc("second", F.current_timestamp()))
        self.change("pages", row)
        self._done(f"compact: {slug}", f"pages/{slug.replace(':', '/')}.md")

    def extend_page(self, name: str, text: str) -> None:
        """Put a paragraph to the end of a page and mark when."""
        slug = self.read(name)["slug"]
        grown = self.pages.filter(F.col("slug") == slug).withColumn("body", F.concat(F.rtrim("body"), F.lit("\n\n" + text.strip() + "\n")))
        self.change("pages", grown.withColumn("updated", F.date_trunc("second", F.current_timestamp())))
        self._done(f"extend: {slug}", f"pages/{slug.replace(':', '/')}.md")

    def rename_page(self, old: str, new: str) -> None:
        """Move a page: the old name stays as its alias, links and recorded references follow. Only rows that change are written."""
        self._checked(new)
        if self.pages.filter(F.col("slug") == new).limit(1).count():
            raise PageExists(new)
        slug = self.read(old)["slug"]
        touched = self.pages.filter((F.col("slug") == slug) | F.contains("body", F.lit(slug)))
        pages, refs = graph.rename(touched, self.table("refs").filter(F.col("page_slug") == slug), slug, new)
        self.change("refs", refs)
        self.change("pages", pages, self.spark.createDataFrame([(slug,)], "slug string"))
        self._done(f"rename: {slug} to {new}", f"pages/{new.replace(':', '/')}.md")

    def rebuild_index(self) -> None:
        """Write the generated page that lists all others."""
        own = self.pages.filter(F.col("slug") != graph.RESERVED)
        row = outline.index_page(own).select(F.lit(graph.RESERVED).alias("slug"), F.lit("Index").alias("title"), F.col("text").alias("body"), F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("aliases"), F.lit(None).alias("provenance"), F.lit(True).alias("generated"), F.date_trunc("second", F.current_timestamp()).alias("updated"))
        self.change("pages", row)

    def import_pages(self, files: DataFrame) -> DataFrame:
        """Take parsed pages (markdown.parse_all) in, mended ones too; those with an error, a bad name or a name that is taken are returned: path, reason."""
        taken = self.pages.select("slug", F.lit(True).alias("taken"))
        judged = files.join(taken, "slug", "left").withColumn("reason", F.coalesce("error", F.when(~F.col("slug").rlike(SLUG), "bad name"), F.when(F.col("taken"), "name taken")))
        good = judged.filter("reason is null")
        provenance = F.transform("provenance", lambda p: F.struct(p["path"].alias("path"), p["sha256"].alias("sha256")))
        rows = good.select("slug", "title", "body", "tags", "aliases", provenance.alias("provenance"), F.lit(False).alias("generated"), "updated")
        refused = self.spark.createDataFrame(judged.filter("reason is not null").select("path", "reason").collect(), "path string, reason string")
        self.change("pages", rows)
        return refused

    def append_log(self, text: str) -> None:
        row = self.spark.createDataFrame([(text,)], "text string").withColumn("ts", F.date_trunc("second", F.current_timestamp()))
        self.change("log", row.withColumn("day", F.to_date("ts")))

    def record_run(self) -> None:
        row = self.spark.createDataFrame([(self.head("pages"),)], "head string").withColumn("ts", F.current_timestamp())
        self.change("runs", row)

    def last_run(self) -> dict | None:
        rows = self.table("runs").orderBy(F.desc("ts")).limit(1).collect()
        return rows[0].asDict() if rows else None

    def get_state(self, name: str):
        """A value kept by name; null if there is none."""
        rows = self.table("state").filter(F.col("name") == name).limit(1).collect()
        return json.loads(rows[0]["value"]) if rows else None

    def set_state(self, name: str, value) -> None:
        self.change("state", self.spark.createDataFrame([(name, json.dumps(value, sort_keys=True))], "name string, value string"))

    # --- sources

    @property
    def sources(self) -> DataFrame:
        return self.table("sources")

    def add_sources(self, files: DataFrame, into: str = "") -> DataFrame:
        """Place, register and scan files(name, content, document_key or not): the rows that are new.

        A file whose place is registered already is left alone. A declared key supersedes the live row that holds it; several
        files with one key follow each other by their names.
        """
        keyed = files if "document_key" in files.columns else files.withColumn("document_key", F.lit(None).cast("string"))
        content = F.coalesce(F.col("content"), F.lit(""))
        place = lineage.placed(keyed.select("name", content.alias("content")), into).distinct()
        fresh = place.join(self.sources.select("rel_path"), "rel_path", "left_anti")
        known = keyed.select("name", sha256(content).alias("sha256"), "document_key", content.alias("text")).dropDuplicates(["name", "sha256"])
        rows = fresh.join(known, ["name", "sha256"])
        first = self.sources.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("m")).first()["m"]
        from .plans.ranks import global_rank
        from .plans.stable import stable

        ranked = stable(global_rank(rows, [F.col("name"), F.col("rel_path")], "seq").withColumn("seq", F.col("seq").cast("long") + first))
        registered = lineage.registered(ranked.select("rel_path", "sha256", "document_key", "seq"))
        oldest = ranked.filter("document_key is not null").groupBy("document_key").agg(F.min_by("rel_path", "seq").alias("next"))
        superseded = self.sources.filter("superseded_by is null").join(oldest, "document_key").withColumn("superseded_by", F.col("next")).drop("next")
        columns = ["rel_path", "sha256", "document_key", "superseded_by", "seq"]
        self.change("texts", ranked.select("rel_path", "text"))
        self.change("sources", registered.select(*columns).unionByName(superseded.select(*columns)))
        self.scan_refs(ranked.select("rel_path", "text"))
        return self.sources.join(ranked.select("rel_path"), "rel_path", "left_semi")

    def scan_refs(self, texts: DataFrame | None = None) -> None:
        """Record which pages source texts name; a stamp tells an empty scan from none. By default all texts are scanned."""
        texts = self.table("texts") if texts is None else texts
        said = texts.select("rel_path", F.explode(references("text")).alias("r")).select("rel_path", "r.*")
        found = lineage.recorded_refs(said, self.pages, graph.aliases(self.pages))
        old = self.table("refs").join(texts.select("rel_path"), "rel_path", "left_semi").select("rel_path", "token").join(found.select("rel_path", "token"), ["rel_path", "token"], "left_anti")
        self.change("refs", found, old)
        self.change("stamps", texts.select("rel_path").distinct().withColumn("scanned_at", F.current_timestamp()))

    def refs(self) -> DataFrame:
        """rel_path, token, page_slug, exact, scanned_at of every scanned source; null tokens where a scan found nothing."""
        return self.table("stamps").join(self.table("refs"), "rel_path", "left")

    def record_ingestion(self, rel_path: str, pages_touched: list[str]) -> int:
        """Note that a source went into pages; the number of the note."""
        if not self.sources.filter(F.col("rel_path") == rel_path).limit(1).count():
            raise PageNotFound(rel_path)
        n = 1 + (self.table("ingestions").agg(F.max("id").alias("m")).first()["m"] or 0)
        self.change("ingestions", self.spark.createDataFrame([(n, rel_path, list(pages_touched))], "id long, rel_path string, pages_touched array<string>").withColumn("ts", F.current_timestamp()))
        self._done(f"ingest: {rel_path}", f"sources/{rel_path}")
        return n

    def remove_source_text(self, rel_path: str) -> None:
        self.change("texts", None, self.spark.createDataFrame([(rel_path,)], "rel_path string"))

    def collect_sources(self) -> int:
        """Drop rows whose text is gone, and lead pointers to them on to their first successor that is there; how many went."""
        disk = self.table("texts").select(F.concat(F.lit("sources/"), "rel_path").alias("path"))
        before = self.sources
        left = lineage.collected(before, disk)
        gone = before.join(left.select("rel_path"), "rel_path", "left_anti").select("rel_path")
        n = gone.count()
        moved = before.drop("superseded_by").join(left, "rel_path").join(before.select("rel_path", F.col("superseded_by").alias("old")), "rel_path").filter(~F.col("old").eqNullSafe(F.col("superseded_by")))
        if n:
            self.change("sources", moved, gone)
        return n

    def assign_keys(self, keys: DataFrame) -> None:
        """Give keys(rel_path, key) to rows that have none."""
        had = self.sources.filter("document_key is null").select("rel_path")
        self.change("sources", lineage.assigned(self.sources, keys).filter("document_key is not null").join(had, "rel_path", "left_semi"))

    def backfill_keys(self) -> DataFrame:
        """Give every row without a key the one its place implies, where that is not ambiguous; the proposals are returned."""
        told = lineage.proposed_keys(self.sources)
        self.assign_keys(told.filter(~F.col("ambiguous")).select(F.get("rows", F.lit(0)).alias("rel_path"), F.col("candidate").alias("key")))
        return told

    def stale(self) -> DataFrame:
        return lineage.stale_pages(self.pages, self.sources)

    # --- reading

    def list_pages(self) -> DataFrame:
        return self.pages.select("slug").orderBy("slug")

    def grep(self, pattern: str, **more) -> DataFrame:
        return search.grep(self.pages, pattern, **more)

    def search(self, questions: DataFrame, spec: str = "bm25", k: int = 5, **parts) -> DataFrame:
        """Ranked pages with previews of each question."""
        chosen, _ = strategy.usable(strategy.parse(spec, k=k), "semantic" in parts)
        return retrieve.with_preview(strategy.build(chosen, self.pages, **parts)(questions), self.pages)

    def searched(self, questions: DataFrame, spec: str = "bm25", k: int = 5, **parts) -> tuple[DataFrame, DataFrame]:
        """search() and what it did for each question."""
        chosen, note = strategy.usable(strategy.parse(spec, k=k), "semantic" in parts)
        ranked = self.search(questions, spec, k, **parts)
        return ranked, retrieve.diagnostics(questions, ranked, strategy.render(chosen), note)

    def reindex(self, model: Callable = vectors.bag_model) -> DataFrame:
        """Bring the chunk index of the pages up to date; the report of chunks.reindex."""
        files = self.pages.select(slug_to_path("slug").alias("rel_path"), "body", (~F.col("generated")).alias("indexable"))
        index, report = chunks.reindex(files, self.table("chunks"), model)
        n, _ = self._commit("chunks")
        self._put("chunks", index.withColumn("_n", F.lit(n + 1).cast("long")).withColumn("_gone", F.lit(False)), n + 1, [])
        return report

    def similar(self, name: str, k: int = 5, model: Callable = vectors.bag_model) -> DataFrame:
        """Pages whose indexed chunks are nearest to a page's body: slug, score, rank; the page itself is left out."""
        page = self.read(name)
        asked = self.spark.createDataFrame([(0, [float(x) for x in model([page["body"] or ""])[0]])], "qid long, embedding array<double>")
        index = self.table("chunks").withColumn("id", F.monotonically_increasing_id())
        from .plans.stable import stable

        index = stable(index.filter(F.col("rel_path") != page["slug"].replace(":", "/") + ".md"))
        found = vectors.knn(asked, index, k=max(4 * k, 20)).join(index.select("id", "rel_path"), "id")
        pages = found.select("qid", F.translate(F.regexp_replace("rel_path", r"\.md$", ""), "/", ":").alias("slug"), F.lit("page").alias("kind"), "sim")
        return vectors.pages_of_chunks(pages, k).select("slug", "score", "rank")

    def index_level(self, prefix: str = "") -> DataFrame:
        return outline.toc_level(self.pages, prefix)

    def outline(self, name: str) -> DataFrame:
        return outline.sections(self.pages.filter(F.col("slug") == self.read(name)["slug"]))

    def links(self) -> DataFrame:
        """src, target of all links with aliases followed, kept by the state of the pages: built once for each."""
        head = self.head("pages")
        place = f"cache/links-{head}"
        if head is None:
            return self.spark.createDataFrame([], "src string, target string")
        if not self.fs.exists(self._path(place, "_SUCCESS")):
            pages = self.pages
            graph.folded(graph.link_rows(pages), graph.aliases(pages)).write.mode("overwrite").parquet(f"{self.root}/{place}")
        return self.spark.read.schema("src string, target string").parquet(f"{self.root}/{place}")

    def backlinks(self, name: str) -> DataFrame:
        return self.links().filter(F.col("target") == self.read(name)["slug"]).select("src").distinct()

    def history(self, name: str) -> DataFrame:
        return history.page_history(self.commits, "pages/" + self.read(name)["slug"].replace(":", "/") + ".md")

    def evolution(self, names: list[str]) -> DataFrame:
        return history.evolution(self.commits, self.log, ["pages/" + self.read(n)["slug"].replace(":", "/") + ".md" for n in names])

    def steering(self, days: int = 30) -> DataFrame:
        """Commits of others than the agent since its last run, or of so many days."""
        run = self.last_run()
        return history.steering(self.commits, self.author, last_run=run["ts"] if run else None, now=dt.datetime.now(), days=days)

    def lint(self) -> DataFrame:
        """Every finding of the audit that the store's tables can show."""
        pages = lint.page_paths(self.pages).withColumn("declared", F.col("slug")).withColumn("error", F.lit(None).cast("string")).withColumn("repaired", F.lit(False))
        disk = self.table("texts").select(F.concat(F.lit("sources/"), "rel_path").alias("path"))
        pinned = lint.pinned_aliases(pages, self.table("texts"))
        index = pages.filter(F.col("slug") == graph.RESERVED).select("slug", "body")
        listed = pages.filter(F.col("slug") != graph.RESERVED)
        checks = [
            lint.declared_slugs(pages), lint.alias_checks(pages), lint.wikilink_checks(pages, pinned), lint.mention_checks(pages, pinned), lint.provenance_checks(pages, disk, self.sources),
            lint.registry_checks(disk, self.sources), lint.source_reference_checks(pages, self.table("refs"), self.table("texts")), lint.orphan_pages(pages, self.log), lint.local_tree_checks(disk, None),
            lint.index_checks(listed, index, outline.index_page(listed)),
        ]
        return lint.report(*checks)

    def previews(self) -> DataFrame:
        return self.pages.select("slug", "title", preview("body").alias("preview"))
