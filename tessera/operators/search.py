"""Line search: regular expressions with context, caps, scopes and rendering."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import path_to_slug, slug_to_path, valid_slug

MAX_CONTEXT = 10


def matcher(text: Column, pattern: str, ignore_case: bool = False, fixed: bool = False) -> Column:
    """A line's test. Fixed strings never become expressions."""
    if fixed:
        return F.contains(F.lower(text), F.lower(F.lit(pattern))) if ignore_case else F.contains(text, F.lit(pattern))
    return text.rlike(f"(?iu){pattern}" if ignore_case else pattern)


def in_paths(path: Column, prefixes: Sequence[str] | None) -> Column:
    """None lets every path through, an empty list none."""
    if prefixes is None:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.startswith(path, F.lit(p)) for p in prefixes], F.lit(False))


def checked_paths(prefixes: Sequence[str]) -> list[str]:
    """Prefixes as given, after refusing those that leave the corpus."""
    for p in prefixes:
        if p.startswith("/") or ".." in p.split("/"):
            raise ValueError(f"path {p!r} leaves the corpus")
    return list(prefixes)


def path_order(path: Column | str) -> Column:
    """Sort key that compares paths component by component."""
    return F.split(path, "/")


def lines(pages: DataFrame, key: str = "slug") -> DataFrame:
    """key, line_no (from 1), text."""
    return pages.select(key, F.posexplode(F.split("body", "\n")).alias("n", "text")).select(key, (F.col("n") + 1).alias("line_no"), "text")


def _marked(body: Column, test) -> Column:
    return F.transform(F.split(body, "\n"), lambda t, i: F.struct((i + 1).alias("line_no"), t.alias("text"), test(t).alias("is_match")))


def grep(pages: DataFrame, pattern: str, context: int = 0, ignore_case: bool = False, fixed: bool = False, paths: Sequence[str] | None = None, key: str = "slug") -> DataFrame:
    """key, line_no, text, is_match: matching lines and `context` lines around them.

    Lines are tested inside their page's row, so nothing is shuffled and pages without a match produce no rows.
    """
    n = max(0, min(context, MAX_CONTEXT))
    test = lambda t: matcher(t, pattern, ignore_case, fixed)
    rows = pages.filter(in_paths(F.col(key), paths))
    if fixed:
        rows = rows.filter(test(F.col("body")))

    def near(lines: Column) -> Column:
        """Lines within n of a match. The list is bound once, so no line is tested again."""
        first = lambda x: F.greatest(x["line_no"] - n, F.lit(1))
        window = lambda x: F.slice(lines, first(x), x["line_no"] + n + 1 - first(x))
        return F.filter(lines, lambda x: F.exists(window(x), lambda y: y["is_match"]))

    marked = _marked(F.col("body"), test)
    kept = F.get(F.transform(F.array(marked), near), 0) if n else F.filter(marked, lambda y: y["is_match"])
    return rows.select(key, F.explode(kept).alias("x")).select(key, "x.line_no", "x.text", "x.is_match")


def grep_capped(pages: DataFrame, pattern: str, max_hits: int, context: int = 0, key: str = "slug", **more) -> DataFrame:
    """The first `max_hits` matches in path order with their context; leading context of matches cut off is left out.

    After the last kept match context ends at the next match. Only the kept matches are sorted (a bounded top-k).
    """
    found = grep(pages, pattern, context, key=key, **more)
    kept = found.filter("is_match").orderBy(path_order(key), "line_no").limit(max_hits)
    if not context:
        return kept
    around = kept.groupBy(key).agg(F.collect_set("line_no").alias("kept"), F.max("line_no").alias("last"))
    rows = found.join(F.broadcast(around), key)
    after = F.min(F.when(F.col("is_match") & (F.col("line_no") > F.col("last")), F.col("line_no"))).over(Window.partitionBy(key))
    near = F.exists("kept", lambda k: F.abs(k - F.col("line_no")) <= context)
    rows = rows.withColumn("next", after).filter(near & (F.col("line_no") < F.coalesce("next", F.lit(2**31 - 1))))
    return rows.select(key, "line_no", "text", "is_match")


def within_bytes(hits: DataFrame, budget: int, key: str = "slug") -> DataFrame:
    """Compatibility mode: hits in path order while their texts' bytes fit the budget, and a flag whether any were cut."""
    first = hits.orderBy(path_order(key), "line_no").limit(budget + 1)
    used = F.sum(F.octet_length("text") + 1).over(Window.orderBy(path_order(key), "line_no").rowsBetween(Window.unboundedPreceding, 0))
    sized = first.withColumn("used", used)
    cut = F.max(F.col("used") > budget).over(Window.partitionBy())
    return sized.withColumn("truncated", cut).filter(F.col("used") <= budget).drop("used")


def scoped(scopes: dict[str, DataFrame], scope: str) -> DataFrame:
    """One scope's pages, or with "all" those of every scope, with a scope column."""
    chosen = scopes if scope == "all" else {scope: scopes[scope]}
    return reduce(DataFrame.unionByName, [df.withColumn("scope", F.lit(name)) for name, df in chosen.items()])


def rendered(hits: DataFrame, context: int, key: str = "slug") -> DataFrame:
    """key, line_no, island, line: `key:n:text` for matches, `key-n-text` for context, islands of adjacent lines numbered per page."""
    page = Window.partitionBy(key).orderBy("line_no")
    gap = F.coalesce(F.col("line_no") - F.lag("line_no").over(page) > 1, F.lit(False)) if context else F.lit(False)
    mark = F.when(F.col("is_match"), ":").otherwise("-")
    out = hits.withColumn("gap", gap.cast("int")).withColumn("island", F.sum("gap").over(page.rowsBetween(Window.unboundedPreceding, 0)))
    return out.select(key, "line_no", "island", F.concat(key, mark, F.col("line_no").cast("string"), mark, "text").alias("line"))


def unreadable(pages: DataFrame) -> DataFrame:
    """slug, problem of pages with a bad address, a parse error or a declared slug that is not the path's; distinct."""
    parts = [
        pages.filter(~valid_slug("slug")).select("slug", F.lit("bad-grammar").alias("problem")),
        pages.filter(F.col("error").isNotNull()).select("slug", F.lit("parse-error").alias("problem")),
        pages.filter(F.col("declared") != F.col("slug")).select("slug", F.lit("slug-mismatch").alias("problem")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def addressed(pages: DataFrame) -> DataFrame:
    """slug, path and the slug that the path gives back."""
    return pages.select("slug", slug_to_path("slug").alias("path"), path_to_slug(slug_to_path("slug")).alias("back"))
