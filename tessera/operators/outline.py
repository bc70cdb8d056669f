"""Sections, tables of contents and rendered indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import human_size

HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
FENCE = r"^\s*(```+|~~~+)"
LABEL = 48


def _lines(body: Column | str) -> Column:
    return F.split(F.regexp_replace(body, r"\r\n?", "\n"), "\n")


def sections(pages: DataFrame, offset: int = 0) -> DataFrame:
    """slug, pos, heading, level, start_line, end_line, char_count of every heading outside fenced code.

    A fence opens with three or more backticks or tildes and closes with the same character. A section ends before the
    next heading of its level or a higher one. All of it folds over the lines of one row.
    """
    state = F.struct(F.lit("").alias("fence"), F.array().cast("array<struct<n:int,level:int,heading:string>>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        mark = F.substring(F.trim(F.regexp_extract(line["t"], FENCE, 1)), 1, 1)
        fence = F.when(mark == "", acc["fence"]).when(acc["fence"] == "", mark).when(acc["fence"] == mark, F.lit("")).otherwise(acc["fence"])
        head = (mark == "") & (acc["fence"] == "") & line["t"].rlike(HEADING)
        row = F.struct(line["n"].alias("n"), F.length(F.regexp_extract(line["t"], HEADING, 1)).alias("level"), F.regexp_extract(line["t"], HEADING, 2).alias("heading"))
        return F.struct(fence.alias("fence"), F.when(head, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

    lines = pages.select("slug", _lines("body").alias("lines"))
    # only lines that can be fences or headings enter the fold
    marked = F.filter(F.transform("lines", lambda t, n: F.struct(n.alias("n"), t.alias("t"))), lambda x: x["t"].rlike(r"^\s*(```|~~~)|^#"))
    found = lines.select("slug", "lines", F.aggregate(marked, state, step)["out"].alias("h"))
    each = found.select("slug", "lines", "h", F.posexplode("h").alias("pos", "x"))
    later = F.filter(F.slice("h", F.col("pos") + 2, F.size("h")), lambda y: y["level"] <= F.col("x.level"))
    end = F.coalesce(F.get(later, 0)["n"], F.size("lines"))
    span = F.array_join(F.slice("lines", F.col("x.n") + 1, end - F.col("x.n")), "\n")
    return each.select("slug", "pos", "x.heading", "x.level", (F.col("x.n") + 1 + offset).alias("start_line"), (end + offset).alias("end_line"), F.length(span).alias("char_count"))


def preamble(pages: DataFrame) -> DataFrame:
    """slug, preamble_chars before the first heading line, fenced or not; the whole body if there is none."""
    lines = F.transform(_lines("body"), lambda t, n: F.struct(n.alias("n"), t.alias("t")))
    first = F.get(F.filter(lines, lambda x: x["t"].rlike(HEADING)), 0)["n"]
    before = F.length(F.array_join(F.slice(_lines("body"), 1, F.coalesce(first, F.lit(0))), "\n"))
    return pages.select("slug", F.when(first.isNull(), F.length("body")).otherwise(before).alias("preamble_chars"))


def find_section(found: DataFrame, query: str) -> DataFrame:
    """Sections whose heading is the query, in any case and spacing; without any, those that contain it."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    wanted = " ".join(query.split()).lower()
    tier = F.when(flat(F.col("heading")) == wanted, 1).when(F.contains(flat(F.col("heading")), F.lit(wanted)), 2)
    tiered = found.withColumn("tier", tier).filter("tier is not null")
    best = tiered.groupBy("slug").agg(F.min("tier").alias("tier"))
    return tiered.join(best, ["slug", "tier"]).drop("tier")


def rendered(found: DataFrame) -> DataFrame:
    """slug, pos, row: an indented label of at most LABEL characters, the span of lines and the size."""
    label = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.col("heading"))
    short = F.when(F.length(label) > LABEL, F.concat(F.substring(label, 1, LABEL - 1), F.lit("…"))).otherwise(label)
    span = F.format_string("L%d-%d", "start_line", "end_line")
    return found.select("slug", "pos", F.concat(F.lit("  "), F.rpad(short, LABEL, " "), F.lit("  "), F.lpad(span, 12, " "), F.lit("  "), human_size("char_count")).alias("row"))


def section_text(pages: DataFrame, found: DataFrame) -> DataFrame:
    """slug, heading, text of found sections."""
    return found.join(pages.select("slug", "body"), "slug").select("slug", "heading", F.array_join(F.slice(_lines("body"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("text"))


def toc_level(slugs: DataFrame, prefix: str = "") -> DataFrame:
    """name, kind (namespace or page), pages: one level of the tree of slugs."""
    start = prefix.strip().rstrip(":")
    lead = f"{start}:" if start else ""
    rest = slugs.filter(F.startswith("slug", F.lit(lead))).select("slug", F.substring("slug", len(lead) + 1, 2**31 - 1).alias("rest"))
    head = F.substring_index("rest", ":", 1)
    deeper = F.contains("rest", F.lit(":"))
    named = rest.filter(head != "").select(F.when(deeper, F.concat(F.lit(lead), head)).otherwise(F.col("slug")).alias("name"), F.when(deeper, "namespace").otherwise("page").alias("kind"))
    return named.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("pages"))


def toc_all(slugs: DataFrame) -> DataFrame:
    """namespace, pages below it, for all levels at once."""
    from ..functions.text import namespaces

    return slugs.select(F.explode(namespaces("slug")).alias("namespace")).groupBy("namespace").agg(F.count(F.lit(1)).alias("pages"))


def index_lines(pages: DataFrame) -> DataFrame:
    """slug, line of the index page."""
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(" ("), F.array_join("tags", ", "), F.lit(")"))).otherwise(F.lit(""))
    return pages.select("slug", F.concat(F.lit("- [["), "slug", F.lit("]] — "), "title", tags).alias("line"))


def index_page(pages: DataFrame) -> DataFrame:
    """The index as one text: a count and a sorted list. Meant for a corpus whose index a person can read."""
    lines = index_lines(pages).agg(F.sort_array(F.collect_list(F.struct("slug", "line"))).alias("l"))
    n = F.size("l")
    body = F.when(n > 0, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).otherwise(F.lit("_(no pages yet)_"))
    return lines.select(F.concat(F.lit("# Index\n\n"), n.cast("string"), F.when(n == 1, " page").otherwise(" pages"), F.lit(".\n\n"), body, F.lit("\n")).alias("text"))
