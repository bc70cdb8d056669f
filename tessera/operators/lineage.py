"""Sources, their versions and the pages that cite them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import candidate_key, sha256, source_ref
from ..plans.ranks import next_in_key
from .graph import chains


def placed(files: DataFrame, into: str = "") -> DataFrame:
    """name, sha256, rel_path: content-addressed place [into/]sha12/name of each file(name, content)."""
    sha = sha256("content")
    parts = ([F.lit(into.strip("/"))] if into.strip("/") else []) + [F.substring(sha, 1, 12), F.col("name")]
    return files.select("name", sha.alias("sha256"), F.concat_ws("/", *parts).alias("rel_path"))


def registered(arrivals: DataFrame) -> DataFrame:
    """rel_path, sha256, document_key, seq, superseded_by after registering arrivals in order.

    arrivals(rel_path, sha256, document_key, seq). A repeated path with the same hash registers nothing new; of the versions of one key each
    is superseded by the next. Rows without a key stand alone. A key's versions are spread over buckets of seq, so a key may hold any share of the rows.
    """
    once = Window.partitionBy("rel_path", "sha256").orderBy("seq")
    first = arrivals.withColumn("nth", F.row_number().over(once)).filter("nth = 1").drop("nth")
    return next_in_key(first, "document_key", "seq", "rel_path", "superseded_by")


def derived_conflicts(arrivals: DataFrame, registry: DataFrame) -> DataFrame:
    """Arrivals without a declared key whose derived key a live row of another path holds: rel_path, key, holder."""
    derived = arrivals.filter("document_key is null").select("rel_path", "sha256", candidate_key("rel_path", "sha256").alias("key"))
    live = registry.filter("superseded_by is null").select(F.col("document_key").alias("key"), F.col("rel_path").alias("holder"))
    return derived.join(live, "key").filter("holder <> rel_path").select("rel_path", "key", "holder")


def latest(registry: DataFrame) -> DataFrame:
    """document_key, rel_path of the newest row of each key."""
    return registry.filter("document_key is not null").groupBy("document_key").agg(F.max_by("rel_path", F.struct("seq", "rel_path")).alias("rel_path"))


def live_claimants(registry: DataFrame) -> DataFrame:
    """document_key, rel_path of rows not superseded, newest first."""
    w = Window.partitionBy("document_key").orderBy(F.desc("seq"), "rel_path")
    return registry.filter("superseded_by is null and document_key is not null").select("document_key", "rel_path", F.row_number().over(w).alias("nth"))


def with_ingestions(sources: DataFrame, ingestions: DataFrame) -> DataFrame:
    """Sources with their ingestions, oldest first; an empty list where there are none."""
    own = ingestions.groupBy("rel_path").agg(F.sort_array(F.collect_list(F.struct("id", "pages_touched"))).alias("ingestions"))
    joined = sources.join(own, "rel_path", "left")
    return joined.withColumn("ingestions", F.coalesce("ingestions", F.array().cast(dict(own.dtypes)["ingestions"])))


def present(trees: dict[str, DataFrame], disk: DataFrame) -> DataFrame:
    """Rows of several trees whose files are there: citation_path, rel_path, tree."""
    out = None
    for tree, rows in trees.items():
        own = rows.select(F.concat(F.lit(f"{tree}/"), "rel_path").alias("citation_path"), "rel_path", F.lit(tree).alias("tree"))
        out = own if out is None else out.unionByName(own)
    return out.join(disk.select(F.col("path").alias("citation_path")), "citation_path", "left_semi")


def resolved(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """spelling, citation_path: a path with or without its tree's name; the tracked tree wins."""
    bare = asked.select("spelling", source_ref("spelling").alias("rel_path"), F.regexp_extract("spelling", "^(sources|sources_local)/", 1).alias("named"))
    found = bare.join(listed, "rel_path").filter("named = '' or named = tree")
    best = F.row_number().over(Window.partitionBy("spelling").orderBy(F.when(F.col("tree") == "sources", 0).otherwise(1)))
    return found.withColumn("nth", best).filter("nth = 1").select("spelling", "citation_path")


def citations(pages: DataFrame) -> DataFrame:
    """rel_path, pages that cite it, sorted."""
    cited = pages.select("slug", F.explode("provenance").alias("p")).select("slug", source_ref("p.path").alias("rel_path")).filter("rel_path <> ''")
    return cited.groupBy("rel_path").agg(F.sort_array(F.collect_set("slug")).alias("pages"))


def stale_pages(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """slug, cited, newest of pages that cite a version which a later one supersedes."""
    cited = pages.select("slug", F.explode("provenance").alias("p")).select("slug", source_ref("p.path").alias("cited")).distinct()
    newest = chains(sources).filter("newest <> rel_path").select(F.col("rel_path").alias("cited"), "newest")
    return cited.join(newest, "cited").select("slug", "cited", "newest")


def proposed_keys(sources: DataFrame) -> DataFrame:
    """candidate, rows, held_by, ambiguous for rows without a key: ambiguous if several share it or a row holds it."""
    open_rows = sources.filter("document_key is null").select("rel_path", candidate_key("rel_path", "sha256").alias("candidate"))
    grouped = open_rows.groupBy("candidate").agg(F.sort_array(F.collect_list("rel_path")).alias("rows"))
    held = sources.filter("document_key is not null").groupBy(F.col("document_key").alias("candidate")).agg(F.min("rel_path").alias("held_by"))
    joined = grouped.join(held, "candidate", "left")
    return joined.select("candidate", "rows", "held_by", ((F.size("rows") > 1) | F.col("held_by").isNotNull()).alias("ambiguous"))


def assigned(sources: DataFrame, keys: DataFrame) -> DataFrame:
    """Sources with the given keys(rel_path, key) put on rows that have none; held keys stay."""
    new = keys.select("rel_path", F.col("key").alias("__new"))
    return sources.join(new, "rel_path", "left").withColumn("document_key", F.coalesce("document_key", "__new")).drop("__new")


def audit(sources: DataFrame, ingestions: DataFrame, disk: DataFrame) -> DataFrame:
    """One row: missing, unregistered, orphan_ingestions."""
    there = disk.select(source_ref("path").alias("rel_path"))
    missing = sources.join(there, "rel_path", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    unknown = there.join(sources, "rel_path", "left_anti").agg(F.count(F.lit(1)).alias("unregistered"))
    lost = ingestions.join(sources, "rel_path", "left_anti").agg(F.count(F.lit(1)).alias("orphan_ingestions"))
    return missing.crossJoin(unknown).crossJoin(lost)


def collected(sources: DataFrame, disk: DataFrame) -> DataFrame:
    """rel_path, superseded_by after rows without a file are gone: pointers to them go to their first successor that is there."""
    there = disk.select(source_ref("path").alias("rel_path"))
    kept = sources.join(there, "rel_path", "left_semi")
    gone = sources.join(there, "rel_path", "left_anti").select("rel_path", "superseded_by")
    # among the missing rows alone a chain ends at the last missing one, whose own pointer leads on
    last = chains(gone).select("rel_path", "newest")
    target = last.join(gone.select(F.col("rel_path").alias("newest"), F.col("superseded_by").alias("on")), "newest").select(F.col("rel_path").alias("superseded_by"), "on", F.lit(True).alias("was_gone"))
    return kept.join(target, "superseded_by", "left").select("rel_path", F.when(F.col("was_gone"), F.col("on")).otherwise(F.col("superseded_by")).alias("superseded_by"))


def recorded_refs(scanned: DataFrame, pages: DataFrame, known_aliases: DataFrame) -> DataFrame:
    """rel_path, token, page_slug, exact of references(rel_path, token, exact) that resolve to a page, by name or alias."""
    live = pages.select(F.col("slug").alias("token"), F.col("slug").alias("page"))
    named = known_aliases.select(F.col("alias").alias("token"), F.col("slug").alias("aliased"))
    return scanned.join(live, "token", "left").join(named, "token", "left").select("rel_path", "token", F.coalesce("page", "aliased").alias("page_slug"), "exact").filter("page_slug is not null")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose keys new lacks."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def listed_refs(trees: dict[str, DataFrame]) -> DataFrame:
    """citation_path, token, page_slug, exact of the recorded references(rel_path, token, page_slug, exact) of several trees."""
    return reduce(DataFrame.unionByName, [refs.select(F.concat(F.lit(f"{tree}/"), "rel_path").alias("citation_path"), "token", "page_slug", "exact") for tree, refs in trees.items()])


def scanned(refs: DataFrame, stamps: DataFrame, found: DataFrame, texts: DataFrame, at) -> tuple[DataFrame, DataFrame]:
    """(refs, stamps) after the texts(rel_path) were scanned and found(rel_path, token, page_slug, exact) came out of it.

    What was recorded of a scanned source is replaced. stamps(rel_path, scanned_at) tells a source without references from one that was never scanned.
    """
    own = texts.select("rel_path").distinct()
    kept = refs.join(own, "rel_path", "left_anti").select("rel_path", "token", "page_slug", "exact")
    marked = own.withColumn("scanned_at", F.lit(at).cast("timestamp"))
    return kept.unionByName(found.select("rel_path", "token", "page_slug", "exact")), upserted(stamps, marked, ["rel_path"])
