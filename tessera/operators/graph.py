"""Links, aliases, backlinks and version chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import rename_links, wikilinks
from ..plans.stable import stable

RESERVED = "index"


def link_rows(pages: DataFrame) -> DataFrame:
    """src, pos, target, display of every link, generated pages left out."""
    own = pages.filter(~F.col("generated")) if "generated" in pages.columns else pages
    return own.select(F.col("slug").alias("src"), F.posexplode(wikilinks("body")).alias("pos", "l")).select("src", "pos", "l.target", "l.display")


def aliases(pages: DataFrame) -> DataFrame:
    """alias, slug: claimed by one page only, not reserved, and no page's own name."""
    claims = pages.select("slug", F.explode("aliases").alias("alias")).filter(F.col("alias") != RESERVED)
    sole = claims.groupBy("alias").agg(F.count_distinct("slug").alias("n"), F.min("slug").alias("slug")).filter("n = 1").select("alias", "slug")
    return sole.join(pages.select(F.col("slug").alias("alias")), "alias", "left_anti")


def first_aliases(pages: DataFrame) -> DataFrame:
    """alias, slug as the audit sees them: the first page in path order wins."""
    claims = pages.select("slug", F.explode("aliases").alias("alias"))
    first = claims.groupBy("alias").agg(F.min_by("slug", F.struct(F.split("slug", ":"), F.col("slug"))).alias("slug"))
    return first.join(pages.select(F.col("slug").alias("alias")), "alias", "left_anti")


def resolve(names: DataFrame, pages: DataFrame) -> DataFrame:
    """name, slug: a page of that name, else the page an alias names, else the name itself."""
    live = pages.select(F.col("slug").alias("name"), F.col("slug").alias("page"))
    named = aliases(pages).select(F.col("alias").alias("name"), F.col("slug").alias("aliased"))
    return names.join(live, "name", "left").join(named, "name", "left").select("name", F.coalesce("page", "aliased", "name").alias("slug"))


def folded(links: DataFrame, known: DataFrame) -> DataFrame:
    """src, target with aliases replaced by their pages; links to oneself are dropped, dangling ones stay."""
    named = known.select(F.col("alias").alias("target"), F.col("slug").alias("to"))
    return links.join(named, "target", "left").select("src", F.coalesce("to", "target").alias("target")).filter("src <> target")


def backlinks(links: DataFrame) -> DataFrame:
    """target, referrers: distinct pages that link to it, sorted."""
    return links.groupBy("target").agg(F.sort_array(F.collect_set("src")).alias("referrers"))


def backlink_counts(links: DataFrame) -> DataFrame:
    """target, n_links, n_referrers: the same graph as numbers, which any hub can bear."""
    return links.groupBy("target", "src").agg(F.count(F.lit(1)).alias("c")).groupBy("target").agg(F.sum("c").alias("n_links"), F.count(F.lit(1)).alias("n_referrers"))


def chains(sources: DataFrame) -> DataFrame:
    """rel_path, newest, hops: follow superseded_by to the end by pointer doubling.

    sources(rel_path, superseded_by). After n rounds a pointer spans 2^n versions, so the longest chain takes the logarithm of its
    length in rounds; each is one join of narrow rows whose outcome is written to the checkpoint folder. A pointer to a
    missing row ends at the row that holds it. Rows that run into a cycle stay with themselves.
    """
    n = sources.count()
    known = sources.select(F.col("rel_path").alias("to"))
    led = sources.select("rel_path", F.col("superseded_by").alias("to")).join(known, "to", "left_semi")
    state = sources.select("rel_path").join(led, "rel_path", "left")
    state = stable(state.select("rel_path", F.coalesce("to", "rel_path").alias("to"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("hops")))
    for _ in range(n.bit_length()):
        nxt = state.select(F.col("rel_path").alias("to"), F.col("to").alias("further"), F.col("hops").alias("more"))
        state = stable(state.join(nxt, "to").select("rel_path", F.col("further").alias("to"), (F.col("hops") + F.col("more")).alias("hops"), (F.col("more") > 0).alias("moved")))
        if not state.filter("moved").limit(1).count():
            break
    # what has made as many hops as there are rows runs in a cycle
    ended = F.col("hops") < n
    return state.select("rel_path", F.when(ended, F.col("to")).otherwise(F.col("rel_path")).alias("newest"), F.when(ended, F.col("hops")).otherwise(F.lit(0).cast("long")).alias("hops"))


def rename(pages: DataFrame, refs: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Pages and recorded references after a page moved: it keeps its old name as an alias, whole links and references follow."""
    moved = pages.withColumn("aliases", F.when(F.col("slug") == old, F.array_union("aliases", F.array(F.lit(old)))).otherwise(F.col("aliases")))
    moved = moved.withColumn("slug", F.when(F.col("slug") == old, F.lit(new)).otherwise(F.col("slug"))).withColumn("body", rename_links("body", old, new))
    return moved, refs.withColumn("page_slug", F.when(F.col("page_slug") == old, F.lit(new)).otherwise(F.col("page_slug")))
