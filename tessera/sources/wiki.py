"""A wiki derived from the given tables: pages, sources, logs and people, from the same expressions in Spark and in SQL.

Names, links, versions and defects follow from the ids by arithmetic, texts are the tables' own, so every table
grows with its base and operators meet each case (aliases that clash, links that break, versions in a cycle) at any scale.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dialect:
    """What the two engines write differently. Lists leave nulls out."""

    lists: str
    hashes: str
    quotient: str
    newline: str

    def some(self, *items: str) -> str:
        return self.lists.format(", ".join(items))

    def sha(self, text: str) -> str:
        return self.hashes.format(text)

    def div(self, a: str, b: int) -> str:
        return f"(({a}) {self.quotient} {b})"


SPARK = Dialect("array_compact(array({}))", "sha2({}, 256)", "div", "chr(10)")
DUCK = Dialect("list_filter(list_value({}), lambda x: x IS NOT NULL)", "sha256({})", "//", "chr(10)")


def slug(i: str) -> str:
    """The name of page i: in a namespace of two levels, of one, or in none."""
    return f"CASE ({i}) % 3 WHEN 0 THEN concat('n', ({i}) % 13, ':t', ({i}) % 4, ':d', ({i})) WHEN 1 THEN concat('n', ({i}) % 13, ':d', ({i})) ELSE concat('d', ({i})) END"


Block = tuple[str, str, dict[str, str]]


def blocks(q: Dialect) -> dict[str, list[Block]]:
    """name -> (base table, condition, columns) of the parts that make the table up."""
    i, text = "doc_id", "coalesce(text, '')"
    sha = q.sha(f"concat(doc_id, ':', {text})")
    version = lambda j: f"concat('s', {q.div(j, 8)} % 9, '/f', ({j}), '.md')"
    own = f"CASE WHEN doc_id % 4 = 0 THEN concat('c', doc_id % 6, '/', substr({sha}, 1, 12), '/r', doc_id % 10, '.md') ELSE {version(i)} END"
    key = f"CASE WHEN doc_id % 8 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN concat('c', doc_id % 6, '/r', doc_id % 10) ELSE concat('s', {q.div(i, 8)} % 9, '/k', {q.div(i, 8)}) END"
    name = f"CASE WHEN doc_id = 7 THEN 'index' WHEN doc_id % 97 = 50 THEN concat('Bad_', doc_id) ELSE {slug(i)} END"
    alias = "concat('alias:a', doc_id - doc_id % 5)"
    links = f"""CASE WHEN doc_id % 11 = 0 THEN '' ELSE concat(' See [[', {slug('2 * doc_id + 1')}, ']]', CASE WHEN doc_id % 6 = 0 THEN concat(' and [[ ', {slug('doc_id + 1')}, ' | next ]] and [[', {slug(i)}, ']]') ELSE '' END,
        CASE WHEN doc_id % 4 = 1 THEN concat(' or [[', {alias}, ']]') ELSE '' END, CASE WHEN doc_id % 10 = 2 THEN ' [[Not A Slug|odd]] [[missing]] then [[missing]]' ELSE '' END) END"""
    prose = f"concat(' Also ', {slug('doc_id + 3')}, ' and ', {alias}, ' and n', doc_id % 13, ':gone', doc_id, ' and zzz:gone at 12:30 or 3:1.')"
    cited = q.some(f"CASE WHEN doc_id % 3 = 0 THEN concat('sources/', {own}, '|', CASE WHEN doc_id % 12 = 0 THEN 'other' ELSE {sha} END) END", f"CASE WHEN doc_id % 3 = 1 THEN concat({version(i)}, '|') END", "CASE WHEN doc_id % 9 = 4 THEN concat('gone/f', doc_id, '.md|') END")
    aliases = q.some("CASE WHEN doc_id % 5 = 0 THEN concat('alias:a', doc_id) END", f"CASE WHEN doc_id % 20 = 5 THEN concat('shared:s', {q.div(i, 40)}) END", "CASE WHEN doc_id % 50 = 10 THEN 'index' END", f"CASE WHEN doc_id % 35 = 0 THEN {slug('doc_id + 1')} END")
    line = f"replace(coalesce(text, ''), {q.newline}, ' ')"
    head = f"concat('---', CASE WHEN doc_id % 6 = 3 THEN '  ' ELSE '' END, {q.newline}, 'title: ', CASE WHEN doc_id % 6 = 0 THEN concat('Part ', doc_id, ': more') ELSE concat('\"Page ', doc_id, '\"') END, {q.newline}, CASE WHEN doc_id % 6 = 5 THEN '' ELSE concat('slug: d', doc_id, {q.newline}) END, CASE WHEN doc_id % 6 = 4 THEN concat('tags: word', {q.newline}) ELSE '' END, '---', {q.newline}, {q.newline})"
    user = "concat('u', user_id, '@x.org')"
    every = "true"
    return {
        "w_pages": [("documents", every, {
            "slug": name, "declared": f"CASE WHEN doc_id % 29 = 4 THEN NULL WHEN doc_id % 41 = 3 THEN {slug('doc_id - 1')} ELSE {name} END", "path": f"concat(replace({name}, ':', '/'), '.md')",
            "title": f"concat('Page ', doc_id, ' ', substr({line}, 1, 40))", "tags": q.some("lang", "CASE WHEN doc_id % 2 = 0 THEN source END"), "aliases": aliases, "cited": cited,
            "body": f"concat({text}, {q.newline}, {links}, {prose})", "generated": "doc_id = 7", "repaired": "doc_id % 31 = 6", "error": "CASE WHEN doc_id % 29 = 4 THEN 'no YAML' END",
        })],
        "w_files": [("documents", every, {"path": "concat('f', doc_id % 9, '/d', doc_id, '.md')", "doc_id": i, "content": f"CASE WHEN doc_id % 6 = 2 THEN {text} ELSE concat({head}, {text}) END"})],
        "w_sources": [("documents", every, {
            "rel_path": own, "sha256": sha, "document_key": key, "seq": i,
            "superseded_by": f"CASE WHEN doc_id % 40 = 35 THEN {version('doc_id - 1')} WHEN doc_id % 8 = 7 OR doc_id % 4 = 0 THEN NULL ELSE {version('doc_id + 1')} END",
        })],
        "w_local": [("documents", "doc_id % 10 = 4", {"rel_path": "concat('x', doc_id, '.md')"}), ("documents", "doc_id % 10 = 6 AND doc_id % 4 <> 0", {"rel_path": version(i)})],
        "w_disk": [
            ("documents", "doc_id % 10 <> 3", {"path": f"concat('sources/', {own})"}), ("documents", "doc_id % 20 = 4", {"path": "concat('sources_local/x', doc_id, '.md')"}),
            ("documents", "doc_id % 15 = 0", {"path": "concat('sources/new/f', doc_id, '.md')"}), ("documents", "doc_id % 20 = 6", {"path": f"concat('sources_local/', {version(i)})"}),
        ],
        "w_ingestions": [
            ("documents", "doc_id % 3 = 0", {"id": i, "rel_path": f"CASE WHEN doc_id % 30 = 9 THEN concat('nowhere/f', doc_id, '.md') ELSE {own} END", "pages_touched": q.some(f"CASE WHEN doc_id % 9 <> 0 THEN {slug(i)} END", f"CASE WHEN doc_id % 2 = 0 THEN {slug('doc_id + 2')} END")}),
            ("documents", "doc_id % 6 = 0", {"id": "doc_id + 1000000000", "rel_path": own, "pages_touched": q.some(slug("doc_id + 4"))}),
        ],
        "w_refs": [("documents", "doc_id % 7 = 0", {"rel_path": own, "token": slug("2 * doc_id"), "page_slug": slug("2 * doc_id"), "exact": "doc_id % 2 = 0"})],
        "w_texts": [("documents", "doc_id % 2 = 0", {"rel_path": own, "text": f"concat({text}, {q.newline}, 'names [[', {slug('2 * doc_id')}, ']] and ', {slug('doc_id + 9')}, ' and n', doc_id % 13, ':nowhere', doc_id, ' or ', CASE WHEN doc_id % 20 < 10 THEN {alias} ELSE 'none' END, ' at 12:30.')"})],
        "w_log": [("conversations", every, {"no": "conv_id * 1000 + turn", "text": f"CASE WHEN turn % 2 = 0 THEN concat('- ', {line}, CASE WHEN conv_id % 3 = 0 THEN '? ' ELSE '.' END) ELSE concat('compact of ', {slug('conv_id * 3 + 2')}, ' done') END"})],
        "w_people": [("customer", every, {"text": "CASE c_custkey % 5 WHEN 0 THEN concat('- ', c_name, ' <u', c_custkey, '@x.org> [aliases: U', c_custkey, '@Y.org, v', c_custkey, '@z.org]') WHEN 1 THEN concat('- ', c_name, ' <u', c_custkey, '@x.org>') WHEN 2 THEN concat('- ', c_name, ' <u', c_custkey, '@x.org> [alias: w', c_custkey, '@x.org]') WHEN 3 THEN concat(c_name, ' <u', c_custkey, '@x.org>') ELSE concat('# ', c_name) END"})],
        "w_commits": [("events", every, {"sha": "concat('c', event_id)", "email": f"CASE event_id % 4 WHEN 0 THEN upper({user}) WHEN 1 THEN concat('u', user_id, '@y.org') WHEN 2 THEN concat('w', user_id, '@X.org') ELSE 'who@else.org' END", "subject": "event_type"})],
        "w_staged": [("events", every, {"status": "CASE event_id % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'A' WHEN 2 THEN 'D' WHEN 3 THEN concat('R', 50 + event_id % 50) ELSE 'C75' END", "path": "concat('pages/p', event_id, '.md')", "new_path": "CASE WHEN event_id % 5 > 2 THEN concat('pages/q', event_id, '.md') END"})],
        "w_paths": [("documents", every, {"path": f"CASE doc_id % 9 WHEN 0 THEN concat('pages/', replace({slug(i)}, ':', '/'), '.md') WHEN 1 THEN concat('sources/a', doc_id, '/one.TXT') WHEN 2 THEN concat('sources/a/', doc_id, '.pdf') WHEN 3 THEN concat('sources_local/x', doc_id, '.md') WHEN 4 THEN concat('notes/.hidden', doc_id, '/x.md') WHEN 5 THEN concat('a-b/x', doc_id, '.md') WHEN 6 THEN concat('a/x', doc_id, '.csv') WHEN 7 THEN concat('noext', doc_id) ELSE concat('pages/n', doc_id, '/index.md') END"})],
        "w_keys": [("documents", every, {"raw": "CASE doc_id % 7 WHEN 0 THEN concat('Report', doc_id, '.CSV.md') WHEN 1 THEN concat('/a//B', doc_id, '/c.txt/') WHEN 2 THEN '.md' WHEN 3 THEN concat('doi/10.1001-jama-', doc_id) WHEN 4 THEN concat('a', doc_id, '/.md') WHEN 5 THEN concat('x', doc_id, '.json.yaml.yml') ELSE concat('  Spaced ', doc_id, ' / Name .md') END"})],
        "w_origins": [("documents", every, {"origin": "CASE doc_id % 5 WHEN 0 THEN concat('p/fach/alpha', doc_id, '/out/d.md') WHEN 1 THEN 'p/a1b2c3d4/d.md' WHEN 2 THEN concat('p/q', doc_id, '/d.md') WHEN 3 THEN 'x/d.md' ELSE concat('p/abc', doc_id, '/d.md') END", "other": "CASE doc_id % 5 WHEN 0 THEN concat('p/fach/beta', doc_id, '/out/d.md') WHEN 1 THEN 'p/b1b2c3d4/d.md' WHEN 2 THEN concat('p/q', doc_id, '/e.md') WHEN 3 THEN NULL ELSE concat('p/abd', doc_id, '/z/d.md') END"})],
        "w_names": [("documents", every, {"name": f"CASE doc_id % 4 WHEN 0 THEN {slug('2 * doc_id')} WHEN 1 THEN concat('alias:a', doc_id) WHEN 2 THEN concat('shared:s', {q.div(i, 10)}) ELSE concat('nothing:x', doc_id) END"})],
        "w_evals": [("events", every, {"eval_idx": "event_id", "fingerprint": "concat('f', event_id % 500)", "score": "(event_id * 7919) % 1009", "mean_ms": "event_id * 31 % 97"})],
        "w_spelled": [("documents", every, {"spelling": f"CASE doc_id % 5 WHEN 0 THEN {own} WHEN 1 THEN concat('sources/', {version(i)}) WHEN 2 THEN concat('sources_local/', {version(i)}) WHEN 3 THEN concat('nope', doc_id, '.md') ELSE concat('x', doc_id, '.md') END"})],
        "w_titles": [("documents", every, {"stem": "CASE doc_id % 4 WHEN 0 THEN concat('my-great_note-', doc_id) WHEN 1 THEN concat('Plain', doc_id) WHEN 2 THEN '--' ELSE concat('x_', doc_id) END", "body": f"CASE doc_id % 4 WHEN 0 THEN concat({text}, {q.newline}, '  #  Heading ', doc_id, '  ', {q.newline}, '# two') WHEN 1 THEN {text} WHEN 2 THEN concat('## two only', {q.newline}, {line}) ELSE concat('#nospace', {q.newline}, {line}) END"})],
        "w_vault": [
            ("documents", every, {"path": "concat('a/Note ', doc_id, '.md')", "doc_id": i, "content": f"concat('see [[Note ', doc_id, '#Part|shown]] and [[Gone', doc_id, ']] and [[note-', doc_id, ']].', {q.newline}, {text})"}),
            ("documents", "doc_id % 3 = 0", {"path": "concat('b/deep/Note ', doc_id, '.md')", "doc_id": i, "content": text}),
            ("documents", "doc_id % 5 = 0", {"path": "concat('.hidden/Note ', doc_id, '.md')", "doc_id": i, "content": text}),
        ],
        "w_sections": [("documents", every, {"slug": "concat('d', doc_id)", "body": f"concat('intro ', doc_id, {q.newline}, '# One', {q.newline}, replace({line}, '#', ''), {q.newline}, '```', {q.newline}, '# no heading', {q.newline}, '```', {q.newline}, '## Two ', doc_id % 3, {q.newline}, 'text', {q.newline}, '### Deep ##', {q.newline}, 'x', {q.newline}, '# Last ', substr({line}, 1, 60))"})],
    }


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    parts = [spark.read.parquet(f"{sf_dir}/{base}.parquet").where(where).selectExpr(*[f"{expr} AS {c}" for c, expr in columns.items()]) for base, where, columns in blocks(SPARK)[name]]
    return reduce(DataFrame.unionByName, parts)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """w_pages with provenance as array<struct<path, sha256>>."""
    cut = F.transform("cited", lambda c: F.struct(F.substring_index(c, "|", 1).alias("path"), F.nullif(F.substring_index(c, "|", -1), F.lit("")).alias("sha256")))
    return frame(spark, sf_dir, "w_pages").withColumn("provenance", cut)


def cte(*names: str) -> str:
    """The tables as common table expressions, to follow WITH."""
    known = blocks(DUCK)
    return ", ".join(f"{name} AS ({' UNION ALL '.join(f'SELECT {", ".join(f"{expr} AS {c}" for c, expr in columns.items())} FROM {base} WHERE {where}' for base, where, columns in known[name])})" for name in names)
