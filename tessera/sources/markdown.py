"""Markdown pages with YAML frontmatter: reading, repairing, writing; vault import."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SLUG, path_to_slug, slugify, title_of
from ..plans.stable import stable

# The block at the start of a page, a top-level scalar line, the known fields in writing order.
BLOCK = re.compile(r"\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)(?:\r?\n)?(.*)\Z", re.S)
SCALAR = re.compile(r"^([A-Za-z_][A-Za-z0-9_-]*):[ \t]+([^>|\n][^\n]*)$", re.M)
KNOWN = ("title", "slug", "provenance", "created", "updated", "tags", "aliases")
PAGE = "path string, slug string, declared string, title string, tags array<string>, aliases array<string>, provenance array<struct<path:string,sha256:string,extra:string>>, created timestamp, updated timestamp, extra string, body string, repaired boolean, error string"


class PageError(ValueError):
    """A page whose frontmatter cannot be used."""


def split_block(content: str) -> tuple[str, str]:
    m = BLOCK.match(content)
    if not m:
        raise PageError("the page has no frontmatter block")
    return m[1], m[2]


def repair(content: str) -> str | None:
    """The page with unquoted top-level values that hold `: ` quoted; null if it is fine already or stays broken."""
    try:
        block, body = split_block(content)
    except PageError:
        return None
    if _loads(block):
        return None

    def quoted(m: re.Match) -> str:
        value = m[2].rstrip()
        if ": " not in value or value[0] in "'\"":
            return m[0]
        return f"{m[1]}: '" + value.replace("'", "''") + "'"

    fixed = SCALAR.sub(quoted, block)
    if fixed == block or not _loads(fixed):
        return None
    return f"---\n{fixed}\n---\n\n" + body.lstrip("\n")


def _loads(block: str) -> bool:
    try:
        yaml.safe_load(block)
    except Exception:  # the loader raises plain ValueErrors for impossible dates
        return False
    return True


def _written(block: str, key: str, value: list) -> list:
    """Entries of a list as they were typed, where the loader made something else of them."""
    if all(isinstance(x, str) for x in value):
        return value
    node = yaml.compose(block)
    for k, v in node.value:
        if k.value == key and isinstance(v, yaml.SequenceNode) and all(isinstance(x, yaml.ScalarNode) for x in v.value):
            return [x if isinstance(x, str) else n.value for x, n in zip(value, v.value, strict=True)]
    return value


def _time(value, name: str) -> dt.datetime | None:
    if value is None:
        return None
    if isinstance(value, str):
        try:
            value = dt.datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
        except ValueError as e:
            raise PageError(f"{name!r} is no ISO time: {value!r}") from e
    elif isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    elif not isinstance(value, dt.datetime):
        raise PageError(f"{name!r} is no time")
    value = value.replace(tzinfo=dt.UTC) if value.tzinfo is None else value.astimezone(dt.UTC)
    return value.replace(microsecond=0)


def parse(content: str, fallback_slug: str | None = None) -> dict:
    """Fields and body of a page. A missing title, or slug without a fallback, is an error; bad aliases are dropped, bad tags are errors."""
    block, body = split_block(content)
    try:
        data = yaml.safe_load(block)
    except Exception as e:
        raise PageError(f"the frontmatter is no YAML: {e}") from e
    if not isinstance(data, dict):
        raise PageError("the frontmatter is no mapping")
    title, slug = data.get("title"), data.get("slug")
    if not isinstance(title, str) or not title.strip():
        raise PageError("the title is missing")
    declared = slug if isinstance(slug, str) and slug.strip() else None
    if declared is None and not fallback_slug:
        raise PageError("the slug is missing")
    tags = data.get("tags") or []
    if not isinstance(tags, list):
        raise PageError("the tags are no list")
    tags = _written(block, "tags", tags)
    if not all(isinstance(t, str) for t in tags):
        raise PageError("a tag is no text")
    aliases = data.get("aliases") or []
    aliases = [a for a in (_written(block, "aliases", aliases) if isinstance(aliases, list) else []) if isinstance(a, str) and re.fullmatch(SLUG[1:-1], a)]
    provenance = data.get("provenance") or []
    if not isinstance(provenance, list) or not all(isinstance(p, str | dict) for p in provenance):
        raise PageError("the provenance is no list of texts and mappings")
    return {
        "title": title, "declared": declared, "slug": fallback_slug or declared, "tags": tags, "aliases": aliases, "provenance": [_entry(p) for p in provenance],
        "created": _time(data.get("created"), "created"), "updated": _time(data.get("updated"), "updated"),
        "extra": json.dumps({k: v for k, v in data.items() if k not in KNOWN}, default=str, sort_keys=True), "body": body,
    }


def _entry(p: str | dict) -> dict:
    if isinstance(p, str):
        return {"path": p, "sha256": None, "extra": None}
    path = next((p[k] for k in ("path", "source", "file") if isinstance(p.get(k), str)), None)
    sha = p.get("sha256")
    return {"path": path, "sha256": sha if isinstance(sha, str) else None, "extra": json.dumps({k: v for k, v in p.items() if k not in ("path", "sha256")}, default=str, sort_keys=True)}


def serialise(page: dict) -> str:
    """The page as a file: known fields first, then the others, then the body."""
    data = {"title": page["title"], "slug": page["slug"]}
    if page.get("provenance"):
        data["provenance"] = [p["path"] if not p.get("sha256") and not p.get("extra") else {"path": p["path"], **({"sha256": p["sha256"]} if p.get("sha256") else {}), **json.loads(p.get("extra") or "{}")} for p in page["provenance"]]
    for k in ("created", "updated"):
        if page.get(k):
            data[k] = page[k].strftime("%Y-%m-%dT%H:%M:%SZ")
    data |= {k: page[k] for k in ("tags", "aliases") if page.get(k)} | json.loads(page.get("extra") or "{}")
    return "---\n" + yaml.safe_dump(data, sort_keys=False, allow_unicode=True) + "---\n\n" + page["body"]


def source_text(content: Column, cap: int = 200_000) -> Column:
    """A source's bytes as text: what is no UTF-8 is replaced, and text beyond the cap is cut with a mark."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.when(F.length(text) > cap, F.concat(F.substring(text, 1, cap), F.lit("[truncated]"))).otherwise(text)


def unregistered(files: DataFrame, registry: DataFrame, names: tuple[str, ...] = (".sources.db",)) -> DataFrame:
    """Files of the source tree that no row of the registry(rel_path) names, the registry's own files left out."""
    own = files.filter(~F.regexp_extract("path", "([^/]*)$", 1).isin(*names))
    return own.join(registry.select(F.col("rel_path").alias("path")), "path", "left_anti")


def read_files(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """path (below root), content of all files under a folder of any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select(F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), r"^.*?\Q" + root.rstrip("/").split("://")[-1].lstrip("/") + r"\E/", "").alias("path"), F.col("content").cast("string").alias("content"))


def parse_all(files: DataFrame, strict: bool = False) -> DataFrame:
    """One row per file: its fields, or its error. A page that only quoting mends is mended and marked.

    With strict a page must declare its slug, as the audit demands; else the path's slug stands in.
    """
    slim = files.select("path", path_to_slug("path").alias("slug"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, slug, content in zip(f["path"], f["slug"], f["content"], strict=True):
                row = dict.fromkeys(("declared", "title", "tags", "aliases", "provenance", "created", "updated", "extra", "body", "error"))
                row |= {"path": path, "slug": slug, "repaired": False}
                mended = repair(content)
                try:
                    row |= parse(mended or content, None if strict else slug) | {"slug": slug, "repaired": mended is not None}
                except PageError as e:
                    row |= {"error": str(e), "body": content}
                rows.append(row)
            columns = [c.split()[0] for c in PAGE.replace("array<struct<path:string,sha256:string,extra:string>>", "x").split(", ")]
            yield pd.DataFrame(rows, columns=columns)

    return slim.mapInPandas(run, PAGE)


def resolve_slugs(paths: list[str]) -> dict[str, str]:
    """A slug for each file of a vault, in sorted order: its stem, led by parent folders while that is taken, then numbered."""
    out: dict[str, str] = {}
    used: set[str] = set()
    for path in sorted(paths, key=lambda p: p.split("/")):
        *parents, name = path.split("/")
        stem = plain_slug(re.sub(r"\.[^.]*$", "", name)) or "page"
        tries = [stem, *(f"{p}-{stem}" for p in map(plain_slug, reversed(parents)) if p)]
        free = next((t for t in tries if t not in used), None)
        n = 2
        while free is None:
            if f"{tries[-1]}-{n}" not in used:
                free = f"{tries[-1]}-{n}"
            n += 1
        used.add(free)
        out[path] = free
    return out


def plain_slug(text: str) -> str:
    import unicodedata

    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return re.sub("-+", "-", re.sub("[^a-z0-9-]", "", re.sub(r"[\s_]+", "-", text))).strip("-")


def vault_files(files: DataFrame) -> DataFrame:
    """Files of a vault without those in hidden folders."""
    return files.filter(~F.col("path").rlike(r"(^|/)\."))


def import_vault(files: DataFrame) -> DataFrame:
    """path, slug, title, body, collided, rewritten, unresolved: notes with resolved slugs and links that point to them.

    A slug depends on earlier ones only where names meet: a note whose names (its stem, alone, led by a parent folder or
    numbered) are no other note's keeps its stem, and only the paths of the others are settled, in their order, on the driver.
    """
    own = vault_files(files)
    spark = files.sparkSession
    order = F.struct(F.split("path", "/"), F.col("path"))
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "")
    plain = F.when(slugify(stem) != "", slugify(stem)).otherwise(F.lit("page"))
    parents = F.filter(F.transform(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), slugify), lambda p: p != "")
    led = own.select("path", plain.alias("stem"), F.array_union(F.array(plain), F.transform(parents, lambda p: F.concat(p, F.lit("-"), plain))).alias("names"))
    # a numbered name may be another note's stem, so names meet without their numbers
    names = stable(led.select("path", "stem", F.explode("names").alias("name")).withColumn("name", F.regexp_replace("name", "-[0-9]+$", "")).distinct())
    shared = names.groupBy("name").agg(F.count_distinct("path").alias("n")).filter("n > 1").select("name")
    met = stable(names.join(shared, "name", "left_semi").select("path").distinct())
    settled = spark.createDataFrame(list(resolve_slugs([r["path"] for r in met.collect()]).items()), "path string, slug string")
    slugs = stable(led.select("path", F.col("stem").alias("slug")).join(met, "path", "left_anti").unionByName(settled))
    by_stem = slugs.groupBy(slugify(stem).alias("key")).agg(F.min_by("slug", order).alias("to"))
    by_slug = slugs.select(F.col("slug").alias("key"), F.col("slug").alias("to")).join(by_stem, "key", "left_anti")
    keys = by_stem.unionByName(by_slug).filter("key <> ''")

    link = r"\[\[[^\]|#]+(?:#[^|\]]*)?(?:\|[^\]]*)?\]\]"
    body = F.regexp_replace("content", r"\A---[ \t]*\r?\n(?s:.*?)\r?\n---[ \t]*\r?\n", "")
    notes = own.join(slugs, "path").select("path", "slug", title_of(body, stem).alias("title"), body.alias("body"))
    found = notes.select("path", F.posexplode(F.regexp_extract_all("body", F.lit(link), F.lit(0))).alias("pos", "raw"))
    part = lambda n: F.regexp_extract("raw", r"\[\[([^\]|#]+)(#[^|\]]*)?(?:\|([^\]]*))?\]\]", n)
    found = found.select("path", "pos", "raw", F.trim(part(1)).alias("target"), part(2).alias("anchor"), F.trim(F.when(part(3) != "", part(3)).otherwise(part(1))).alias("display")).withColumn("key", slugify("target"))
    told = found.join(keys, "key", "left")
    told = told.withColumn("new", F.when(F.col("to").isNull(), F.col("raw")).otherwise(F.concat(F.lit("[["), "to", "anchor", F.lit("|"), "display", F.lit("]]"))))
    each = told.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("pos", "new"))).alias("l"), F.count("to").alias("rewritten"), F.count(F.when(F.col("to").isNull(), 1)).alias("unresolved"))
    joined = notes.join(each, "path", "left")
    gaps = F.split("body", link, -1)
    woven = F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), F.col("l")), lambda x: F.concat(x["g"], F.coalesce(x["l"]["new"], F.lit("")))), "")
    return joined.select("path", "slug", "title", (F.col("slug") != slugify(stem)).alias("collided"), F.when(F.col("l").isNull(), F.col("body")).otherwise(woven).alias("body"), F.coalesce("rewritten", F.lit(0)).alias("rewritten"), F.coalesce("unresolved", F.lit(0)).alias("unresolved"))


def import_summary(notes: DataFrame) -> DataFrame:
    """One row: notes, collisions, rewritten and unresolved links of import_vault()."""
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c)
    return notes.agg(F.count(F.lit(1)).alias("notes"), total("collided"), total("rewritten"), total("unresolved"))


def written(pages: DataFrame) -> DataFrame:
    """path, content of parsed pages as files; pages with an error are left out."""

    def run(frames):
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                row = {k: (list(v) if hasattr(v, "tolist") and k in ("tags", "aliases", "provenance") else None if v is pd.NaT else v) for k, v in row.items()}
                out.append((row["path"], serialise(row)))
            yield pd.DataFrame(out, columns=["path", "content"])

    return pages.filter("error is null").mapInPandas(run, "path string, content string")


def write_pages(pages: DataFrame, folder: str) -> None:
    """Export as a table of (path, content) in Parquet."""
    written(pages).write.mode("overwrite").parquet(folder)


def write_files(pages: DataFrame, folder: str) -> int:
    """Export every page as the .md file of its path below a folder that all executors share; the number of files. A task that runs again writes the same files again."""

    def run(batches):
        from pyarrow import fs

        for b in batches:
            store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if path.startswith("/") or ".." in path.split("/"):
                    raise PageError(f"path {path!r} leaves the folder")
                target = f"{root.rstrip('/')}/{path}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(target) as out:
                    out.write(content.encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return sum(r["n"] for r in written(pages).mapInArrow(run, "n long").collect())
