"""Text, string, hash and array functions over columns; all of them run inside the JVM."""

from __future__ import annotations

import unicodedata

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a question.
STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "at", "by", "from", "is", "are", "was", "were", "be", "been", "being", "this", "that", "these", "those", "it", "its", "as",
    "how", "what", "when", "why", "who", "which", "does", "do", "did", "can", "could", "should", "would", "about", "into", "out", "over", "under",
)
# Source file types; grammar of slugs, links and mentions.
EXTENSIONS = (".md", ".txt", ".csv", ".json", ".mmd", ".yaml", ".yml")
SEGMENT = "[a-z0-9]+(?:-[a-z0-9]+)*"
SLUG = rf"^{SEGMENT}(?::{SEGMENT})*$"
LINK = r"\[\[([^\]|]+)(?:\|([^\]]*))?\]\]"
ANCHORED_LINK = r"\[\[([^\]|#]+)(#[^|\]]*)?(?:\|([^\]]*))?\]\]"
MENTION = rf"(?U)(?<![\w:-]){SEGMENT}(?::{SEGMENT})+(?![\w-])"
PARAGRAPH_BREAK = r"\n[ \t]*\n+"



def _decompositions() -> tuple[str, str, dict[str, str]]:
    """From Unicode's compatibility decompositions of the basic plane: letters with one plain letter or digit (and that), and those with several of a-z and 0-9."""
    marked, plain, several = [], [], {}
    for c in map(chr, range(0xAA, 0x10000)):
        parts = unicodedata.normalize("NFKD", c)
        bare = "".join(x for x in parts if not unicodedata.combining(x))
        if parts == c or not bare:
            continue
        if len(bare) == 1 and bare.isalnum():
            marked.append(c)
            plain.append(bare)
        elif len(bare) > 1 and any(x.isascii() and x.isalnum() for x in bare):
            several[c] = bare
    return "".join(marked), "".join(plain), several


_ACCENTED, _PLAIN, _SEVERAL = _decompositions()
_STRIPPED = str.maketrans(_ACCENTED, _PLAIN)


def bare(text: str) -> str:
    """strip_accents() of a single text."""
    plain = text.translate(_STRIPPED)
    return plain if plain.isascii() else regex.sub(r"\p{M}+", "", plain)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def strip_accents(c: Column | str) -> Column:
    """Letters without their marks, whether composed or followed by them; texts of ASCII alone are passed through."""
    bare = F.regexp_replace(F.translate(col(c), _ACCENTED, _PLAIN), r"\p{M}+", "")
    return F.when(col(c).rlike(r"[^\x00-\x7F]"), bare).otherwise(col(c))


def decomposed(c: Column | str) -> Column:
    """strip_accents, and characters that stand for several letters or digits (ligatures, fractions, units) written out."""
    table = F.create_map(*[F.lit(x) for pair in _SEVERAL.items() for x in pair])
    each = F.transform(F.split(col(c), ""), lambda x: F.coalesce(F.try_element_at(table, x), x))
    return strip_accents(F.when(col(c).rlike("[" + "".join(_SEVERAL) + "]"), F.array_join(each, "")).otherwise(col(c)))


def keywords(question: Column | str, cap: int = 12) -> Column:
    """Lower-cased ASCII words of three letters or more that are no stopwords, in order of first use, `cap` at most."""
    words = F.split(F.lower(col(question)), "[^a-zA-Z0-9]+")
    return F.slice(F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 3) & ~t.isin(*STOPWORDS))), 1, cap)


def tokens(body: Column | str) -> Column:
    """Words for full-text search: letters and digits, lower-cased, without accents."""
    return F.filter(F.split(strip_accents(F.lower(col(body))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def wikilinks(body: Column | str) -> Column:
    """array<struct<target, display>> of [[target]] and [[target|display]] in order; a missing or empty display is the target."""
    targets, shown = F.regexp_extract_all(col(body), F.lit(LINK), F.lit(1)), F.regexp_extract_all(col(body), F.lit(LINK), F.lit(2))
    return F.zip_with(targets, shown, lambda t, d: F.struct(strip(t).alias("target"), strip(F.when(d == "", t).otherwise(d)).alias("display")))


def mentions(body: Column | str) -> Column:
    """Distinct slug-shaped tokens of two segments or more in prose, links taken out first."""
    prose = F.regexp_replace(col(body), LINK, " ")
    return F.array_distinct(F.regexp_extract_all(prose, F.lit(MENTION), F.lit(0)))


def references(body: Column | str) -> Column:
    """array<struct<token, exact>>: distinct link targets, then distinct mentions that are no link target."""
    exact = F.array_distinct(F.transform(wikilinks(body), lambda x: x["target"]))
    loose = F.array_except(mentions(body), exact)
    return F.concat(F.transform(exact, lambda t: F.struct(t.alias("token"), F.lit(True).alias("exact"))), F.transform(loose, lambda t: F.struct(t.alias("token"), F.lit(False).alias("exact"))))


def anchored_links(body: Column | str) -> Column:
    """array<struct<target, anchor, display>> of links as note-taking vaults write them: [[Name#section|display]]."""
    part = lambda n: F.regexp_extract_all(col(body), F.lit(ANCHORED_LINK), F.lit(n))
    return F.transform(F.arrays_zip(part(1).alias("t"), part(2).alias("a"), part(3).alias("d")), lambda x: F.struct(strip(x["t"]).alias("target"), x["a"].alias("anchor"), strip(F.when(x["d"] == "", x["t"]).otherwise(x["d"])).alias("display")))


def slugify(text: Column | str) -> Column:
    """Lower case, no accents, white space and underscores as hyphens, nothing but [a-z0-9-], no doubled or outer hyphens."""
    gapped = F.regexp_replace(F.lower(decomposed(text)), r"(?U)[\s_]+", "-")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(gapped, "[^a-z0-9-]", ""), "-+", "-"), "^-|-$", "")


def title_of(body: Column | str, stem: Column | str) -> Column:
    """First level-one heading, or else the file's stem with gaps for its hyphens and underscores."""
    plain = F.trim(F.translate(col(stem), "_-", "  "))
    heading = F.regexp_extract(col(body), r"(?m)^\s*#\s+(.+?)\s*$", 1)
    return F.when(heading != "", F.trim(heading)).when(plain != "", plain).otherwise(col(stem))


def valid_slug(slug: Column | str) -> Column:
    return col(slug).rlike(SLUG.replace("$", r"\z"))


def slug_to_path(slug: Column | str) -> Column:
    return F.concat(F.translate(col(slug), ":", "/"), F.lit(".md"))


def path_to_slug(path: Column | str) -> Column:
    return F.translate(F.regexp_replace(col(path), r"\.[^./]*$", ""), "/", ":")


def allowed_source(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(path), r"(\.[^./]+)$", 1)).isin(*EXTENSIONS)


def normal_key(raw: Column | str) -> Column:
    """Identity of a document: lower case, no empty segments, source file types stripped until none is left; null if nothing remains."""
    types = "|".join(e[1:] for e in EXTENSIONS)
    flat = lambda c: F.array_join(F.filter(F.split(F.lower(strip(c)), "/"), lambda p: p != ""), "/")
    # a stripped type may leave an empty segment behind it, so both are stripped together
    key = F.regexp_replace(flat(raw), rf"(?:/?\.(?:{types}))+$", "")
    return F.when(key != "", key)


def derived_key(path: Column | str, sha: Column | str) -> Column:
    """Key that a content-addressed path implies; null unless the folder is the row's own hash prefix."""
    parts = F.split(col(path), "/")
    kept = F.concat(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), F.slice(parts, -1, 1))
    return F.when((F.size(parts) >= 2) & (F.get(parts, F.size(parts) - 2) == F.substring(col(sha), 1, 12)), normal_key(F.array_join(kept, "/")))


def candidate_key(path: Column | str, sha: Column | str) -> Column:
    return F.coalesce(derived_key(path, sha), normal_key(path))


def distinguishing_segment(origin: Column | str, other: Column | str) -> Column:
    """First folder in which two origins differ; null if they do not, or if it looks like a hash."""
    folders = lambda c: F.slice(F.split(col(c), "/"), 1, F.size(F.split(col(c), "/")) - 1)
    paired = F.arrays_zip(folders(origin).alias("a"), folders(other).alias("b"))
    first = F.get(F.filter(paired, lambda x: x["a"].isNotNull() & x["b"].isNotNull() & (x["a"] != x["b"])), 0)["a"]
    return F.when(~F.lower(first).rlike("^[0-9a-f]{8,}$"), first)


def header(title: Column | str, tags: Column | str) -> Column:
    """`title — a, b`, either part alone, or an empty text."""
    named = F.array_join(F.filter(F.transform(F.coalesce(col(tags), F.array().cast("array<string>")), strip), lambda t: t != ""), ", ")
    own = F.coalesce(strip(title), F.lit(""))
    return F.when((own != "") & (named != ""), F.concat(own, F.lit(" — "), named)).when(own != "", own).otherwise(named)


def with_header(head: Column | str, text: Column | str) -> Column:
    return F.when(col(head) != "", F.concat(col(head), F.lit("\n\n"), col(text))).otherwise(col(text))


def sha256(text: Column | str) -> Column:
    return F.sha2(col(text).cast("binary"), 256)


def iso_z(ts: Column | str) -> Column:
    return F.date_format(F.date_trunc("second", col(ts)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(text: Column | str) -> Column:
    """Timestamp of ISO text in UTC, to the second; a bare date is midnight, unreadable text null."""
    return F.date_trunc("second", F.try_to_timestamp(strip(text)))


def preview(text: Column | str, limit: int = 200) -> Column:
    flat = strip(F.regexp_replace(col(text), "\n", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("…"))).otherwise(flat)


def human_size(chars: Column | str) -> Column:
    """`n B` below a thousand, else kB with one digit; halves are rounded up, in whole numbers, so every engine agrees."""
    tenths = F.floor((col(chars) + 50) / 100).cast("long")
    return F.when(col(chars) >= 1000, F.format_string("%d.%d kB", F.floor(tenths / 10).cast("long"), tenths % 10)).otherwise(F.format_string("%d B", col(chars).cast("long")))


def links_to_markdown(body: Column | str, base: str = "/wiki/") -> Column:
    """[[slug|label]] as [label](base/slug/with/slashes); links that are no valid slug stay as written."""
    gaps = F.split(col(body), LINK, -1)
    raw = F.regexp_extract_all(col(body), F.lit(LINK), F.lit(0))
    parts = F.arrays_zip(raw.alias("raw"), wikilinks(body).alias("l"))
    shown = F.transform(parts, lambda x: F.when(valid_slug(x["l"]["target"]), F.concat(F.lit("["), F.replace(x["l"]["display"], F.lit("]"), F.lit("\\]")), F.lit(f"]({base.rstrip('/')}/"), F.translate(x["l"]["target"], ":", "/"), F.lit(")"))).otherwise(x["raw"]))
    return F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), shown.alias("s")), lambda x: F.concat(x["g"], F.coalesce(x["s"], F.lit("")))), "")


def rename_links(body: Column | str, old: str, new: str) -> Column:
    """Whole links to `old`, and no other, point to `new`; their display stays."""
    literal = "".join("\\" + c if not c.isalnum() else c for c in old)
    pattern = rf"(?U)\[\[\s*{literal}\s*(\|[^\]]*)?\]\]"
    return F.when(F.contains(col(body), F.lit(old)), F.regexp_replace(col(body), pattern, f"[[{new}$1]]")).otherwise(col(body))


def namespaces(slug: Column | str) -> Column:
    """Every proper prefix of a slug: a:b:c gives a and a:b."""
    parts = F.split(col(slug), ":")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ":"))).otherwise(F.array().cast("array<string>"))


def subject_slug(subject: Column | str) -> Column:
    """Slug that a commit subject names: `compact: slug` or `extend: slug`; null otherwise."""
    got = strip(F.regexp_extract(col(subject), "^(?:compact|extend): (.*)$", 1))
    return F.when(got != "", got)


def normal_lines(text: Column | str) -> Column:
    """For comparing rendered pages: no white space at line ends or at either end."""
    return strip(F.regexp_replace(col(text), r"(?m)[ \t]+$", ""))


def source_ref(path: Column | str) -> Column:
    """A cited path without the name of the tree it is in."""
    return F.regexp_replace(strip(path), "^(?:sources|sources_local)/", "")


def paragraphs(body: Column | str) -> Column:
    """array<struct<start, end, text>> of stripped paragraphs; offsets count code points of the stripped body."""
    whole = strip(body)
    gaps, breaks = F.split(whole, PARAGRAPH_BREAK, -1), F.regexp_extract_all(whole, F.lit(PARAGRAPH_BREAK), F.lit(0))
    zipped = F.arrays_zip(gaps.alias("g"), breaks.alias("b"))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["g"]) + F.coalesce(F.length(x["b"]), F.lit(0))).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(F.regexp_extract(x["g"], r"(?U)^(\s*)", 1))).alias("start"), strip(x["g"]).alias("text")))).alias("out"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out"))
    found = F.filter(F.aggregate(zipped, zero, step)["out"], lambda p: p["text"] != "")
    return F.transform(found, lambda p: F.struct(p["start"].alias("start"), (p["start"] + F.length(p["text"])).alias("end"), p["text"].alias("text")))
