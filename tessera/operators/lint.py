"""Integrity audit: one DataFrame of findings(kind, severity, path, detail) per check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mentions, namespaces, normal_lines, references, slug_to_path, source_ref, wikilinks
from ..plans.stable import stable
from .graph import RESERVED, first_aliases, folded

ERROR, WARNING = "error", "warning"


def _finding(df: DataFrame, kind: str, severity: str, path, detail) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.col(path).alias("path") if isinstance(path, str) else path.alias("path"), (F.col(detail) if isinstance(detail, str) else detail).alias("detail"))


def missing_root(spark, exists: bool) -> DataFrame:
    rows = [] if exists else [("missing-wiki-dir", ERROR, "wiki", "the page folder is missing")]
    return spark.createDataFrame(rows, "kind string, severity string, path string, detail string")


def frontmatter(pages: DataFrame) -> DataFrame:
    bad = _finding(pages.filter("error is not null and not repaired"), "frontmatter-invalid", ERROR, "path", "error")
    return bad.unionByName(_finding(pages.filter("repaired"), "frontmatter-repairable", WARNING, "path", F.lit("quote the value with a colon")))


def declared_slugs(pages: DataFrame) -> DataFrame:
    """Declared slugs that an earlier page has declared, and those that are not the path's."""
    own = pages.filter("declared is not null")
    nth = F.row_number().over(Window.partitionBy("declared").orderBy(F.split("path", "/"), "path"))
    twice = _finding(own.withColumn("nth", nth).filter("nth > 1"), "duplicate-slug", ERROR, "path", "declared")
    return twice.unionByName(_finding(own.filter("declared <> slug"), "slug-filename-mismatch", ERROR, "path", "declared"))


def alias_checks(pages: DataFrame) -> DataFrame:
    """Reserved and shadowed aliases at their first owner, conflicting ones at each."""
    claims = pages.select("slug", "path", F.explode("aliases").alias("alias"))
    live = pages.select(F.col("slug").alias("alias"), F.lit(True).alias("live"))
    owners = claims.groupBy("alias").agg(F.count(F.lit(1)).alias("n"), F.min_by("path", F.split("path", "/")).alias("first"))
    judged = owners.join(live, "alias", "left").withColumn("live", F.coalesce("live", F.lit(False)))
    reserved = _finding(judged.filter(F.col("alias") == RESERVED), "alias-reserved", ERROR, "first", "alias")
    shadowed = _finding(judged.filter((F.col("alias") != RESERVED) & F.col("live")), "alias-shadowed", ERROR, "first", "alias")
    torn = judged.filter((F.col("alias") != RESERVED) & ~F.col("live") & (F.col("n") > 1)).select("alias")
    return reserved.unionByName(shadowed).unionByName(_finding(claims.join(torn, "alias", "left_semi"), "alias-conflict", ERROR, "path", "alias"))


def pinned_aliases(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """alias: those that source texts(rel_path, text), which cannot be edited, name by link or mention; they must stay."""
    said = texts.select(F.explode(references("text")).alias("r")).select(F.col("r.token").alias("alias")).distinct()
    return first_aliases(pages).select("alias").join(said, "alias", "left_semi")


def _unpinned(named: DataFrame, by: str, pinned: DataFrame | None) -> DataFrame:
    return named if pinned is None else named.join(pinned.select(F.col("alias").alias(by), F.lit(True).alias("pinned")), by, "left").filter("pinned is null").drop("pinned")


def wikilink_checks(pages: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """A broken link for each occurrence; a link that only an alias resolves, unless a source pins the alias."""
    links = pages.select("slug", "path", F.explode(F.transform(wikilinks("body"), lambda x: x["target"])).alias("target")).filter("target <> slug")
    named = first_aliases(pages).select(F.col("alias").alias("target"), F.col("slug").alias("to"))
    known = pages.select(F.col("slug").alias("target"), F.lit(True).alias("live"))
    judged = links.join(named, "target", "left").join(known, "target", "left")
    via = _finding(_unpinned(judged.filter("to is not null"), "target", pinned), "wikilink-via-alias", WARNING, "path", F.concat("target", F.lit(" -> "), "to"))
    return via.unionByName(_finding(judged.filter("to is null and live is null"), "broken-wikilink", ERROR, "path", "target"))


def namespaces_in_use(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode(namespaces("slug")).alias("namespace")).distinct()


def mention_checks(pages: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """Slug-shaped words in prose that are no page though their whole parent prefix is a namespace in use; aliases that a source pins are let be."""
    said = pages.select("slug", "path", F.explode(mentions("body")).alias("token"))
    said = said.join(pages.select(F.col("slug").alias("token")), "token", "left_anti")
    said = said.withColumn("namespace", F.regexp_replace("token", ":[^:]*$", "")).join(namespaces_in_use(pages), "namespace", "left_semi")
    judged = said.join(first_aliases(pages).select(F.col("alias").alias("token"), F.col("slug").alias("to")), "token", "left")
    via = _finding(_unpinned(judged.filter("to is not null"), "token", pinned), "slug-mention-via-alias", WARNING, "path", F.concat("token", F.lit(" -> "), "to"))
    return via.unionByName(_finding(judged.filter("to is null"), "dead-slug-mention", WARNING, "path", "token"))


def provenance_checks(pages: DataFrame, disk: DataFrame, registry: DataFrame) -> DataFrame:
    """Cited files that neither tree holds; cited hashes that are not the registry's."""
    cited = pages.select("path", F.explode("provenance").alias("p")).select("path", source_ref("p.path").alias("ref"), "p.sha256").filter("ref is not null and ref <> ''")
    there = disk.select(source_ref("path").alias("ref")).distinct()
    gone = _finding(cited.join(there, "ref", "left_anti"), "stale-provenance", WARNING, "path", "ref")
    own = registry.select(F.col("rel_path").alias("ref"), F.col("sha256").alias("actual"))
    other = cited.join(there, "ref", "left_semi").join(own, "ref").filter("sha256 is not null and trim(sha256) <> '' and sha256 <> actual")
    return gone.unionByName(_finding(other, "provenance-sha-mismatch", WARNING, "path", "ref"))


def registry_checks(disk: DataFrame, registry: DataFrame) -> DataFrame:
    """Registered files that are gone, and files that no row registers."""
    d, r = disk.select(source_ref("path").alias("ref"), F.lit(True).alias("on_disk")), registry.select(F.col("rel_path").alias("ref"), F.lit(True).alias("known"))
    both = d.join(r, "ref", "full_outer")
    lost = _finding(both.filter("on_disk is null"), "source-orphaned", WARNING, "ref", F.lit("registered, but the file is missing"))
    return lost.unionByName(_finding(both.filter("known is null"), "source-unregistered", WARNING, "ref", F.lit("on disk, but not registered")))


def source_reference_checks(pages: DataFrame, refs: DataFrame, texts: DataFrame) -> DataFrame:
    """Recorded references to pages that are gone, and slugs in source texts that resolve to nothing.

    refs(rel_path, token, page_slug), texts(rel_path, text).
    """
    kind = "source-references-dead-slug"
    live = pages.select("slug")
    dead = refs.join(live.withColumnRenamed("slug", "page_slug"), "page_slug", "left_anti")
    recorded = _finding(dead, kind, WARNING, "rel_path", "token")
    resolvable = live.union(first_aliases(pages).select("alias")).toDF("token")
    said = texts.select("rel_path", F.explode(mentions("text")).alias("token")).join(resolvable, "token", "left_anti").join(refs.select("rel_path", "token"), ["rel_path", "token"], "left_anti")
    said = said.withColumn("namespace", F.regexp_replace("token", ":[^:]*$", "")).join(namespaces_in_use(pages), "namespace", "left_semi")
    return recorded.unionByName(_finding(said, kind, WARNING, "rel_path", "token"))


def orphan_pages(pages: DataFrame, log: DataFrame) -> DataFrame:
    """Pages that no other page links to and no log text contains.

    Only pages without inbound links are held against the log. A slug lies inside one run of its letters, so the
    log's distinct runs are all that is searched: a slug is joined to them by that of its three-letter
    grams that the fewest runs hold (a shorter slug by all of it), and compared; never all pairs.
    """
    links = pages.filter(~F.col("generated")).select(F.col("slug").alias("src"), F.explode(F.transform(wikilinks("body"), lambda x: x["target"])).alias("target"))
    linked = folded(links, first_aliases(pages)).select(F.col("target").alias("slug")).distinct()
    lone = pages.filter(~F.col("generated")).join(linked, "slug", "left_anti")
    slugs = lone.select("slug").distinct().withColumn("width", F.least(F.lit(3), F.length("slug"))).filter("width > 0")
    cut = lambda c, w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - w + 1), lambda i: F.substring(c, i, w)))
    widths = sorted(r["width"] for r in slugs.select("width").distinct().collect())
    # slugs may hold letters that names must not have: every run of anything but white space is kept whole
    runs = log.select(F.explode(F.split("text", r"\s+")).alias("run")).filter("run <> ''").distinct()
    spaced = slugs.filter(F.col("slug").rlike(r"\s")).select("slug")
    grams = stable(reduce(DataFrame.unionByName, [runs.filter(F.length("run") >= w).select("run", F.explode(cut(F.col("run"), F.lit(w))).alias("gram")) for w in widths])) if widths else None
    if grams is None:
        return _finding(lone, "orphan-page", WARNING, "path", "slug")
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    keyed = slugs.join(spaced, "slug", "left_anti").select("slug", F.explode(cut(F.col("slug"), F.col("width"))).alias("gram"))
    # a slug with a gram that no run holds is in none; left joins keep it out of the way
    rated = keyed.join(counts, "gram", "left").groupBy("slug").agg(F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n")).filter("n > 0")
    named = rated.join(grams, "gram").filter(F.contains("run", F.col("slug"))).select("slug").distinct()
    return _finding(lone.join(named, "slug", "left_anti"), "orphan-page", WARNING, "path", "slug")


def local_tree_checks(tracked: DataFrame, indexed: DataFrame | None, local: str = "sources_local/") -> DataFrame:
    """Files of the local tree that are tracked or indexed; without an index the second check is skipped."""
    under = F.startswith("path", F.lit(local))
    out = _finding(tracked.filter(under), "local-source-tracked", ERROR, "path", "path")
    return out if indexed is None else out.unionByName(_finding(indexed.filter(under), "local-source-indexed", ERROR, "path", "path"))


def index_checks(pages: DataFrame, index: DataFrame, rendered: DataFrame) -> DataFrame:
    """The index is missing though there are pages, is not called index, or differs from a fresh rendering.

    index(slug, body) has one row or none, rendered(text) one row.
    """
    some = pages.limit(1).select(F.lit("index.md").alias("path"))
    missing = _finding(some.join(index.limit(1).select(F.lit("index.md").alias("path")), "path", "left_anti"), "index-missing", WARNING, "path", F.lit("pages exist, but no index"))
    named = _finding(index.filter(F.col("slug") != RESERVED), "index-malformed", ERROR, F.lit("index.md"), "slug")
    drift = index.crossJoin(F.broadcast(rendered.limit(1))).filter(normal_lines("body") != normal_lines("text"))
    return missing.unionByName(named).unionByName(_finding(drift, "index-drift", WARNING, F.lit("index.md"), F.lit("differs from the pages")))


def report(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def summary(findings: DataFrame) -> DataFrame:
    """kind, severity, n; the rows without a kind are totals by severity."""
    return findings.groupingSets([[F.col("kind"), F.col("severity")], [F.col("severity")]], "kind", "severity").agg(F.count(F.lit(1)).alias("n"))


def exit_code(findings: DataFrame) -> int:
    """0 clean, 1 warnings only, 2 errors."""
    got = {r["severity"] for r in findings.select("severity").distinct().collect()}
    return 2 if ERROR in got else 1 if got else 0


def page_paths(pages: DataFrame) -> DataFrame:
    return pages.withColumn("path", slug_to_path("slug"))
