"""Multipart credential linking: single secrets, and weak parts that only count beside their complements."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, sized, stable, table


@dataclass(frozen=True)
class Kind:
    """A kind of part: its Java pattern, its class, whether it is reported alone, the least length of the part that is tested (`group` of the match, 0 for all of it).

    `hints` are lower-case texts one of which every match holds if lower-cased, unless it holds a match of the cheaper pattern `like`; texts without any are not matched.
    """

    name: str
    pattern: str
    part: str
    strong: bool
    group: int
    least: int
    hints: tuple[str, ...]
    like: str = ""


# Kinds in reporting order.
KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "secret", True, 2, 8, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Kind("access", r"AKIA[A-Z0-9]+", "id", True, 0, 16, ("akia",)),
    Kind("hex", r"[0-9a-f]{32,}", "secret", True, 0, 32, ()),
    Kind("part_id", r"""(?i)(?<![A-Za-z0-9_])(?:user_?name|user_?id|login|account_?id|client_?id|key_?id|tenant_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", "id", False, 1, 3, ("user", "login", "account", "client", "key", "tenant")),
    Kind("part_secret", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9A-Z+/_-]*[a-z])(?=[0-9a-z+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", "secret", False, 0, 20, ()),
    Kind("part_endpoint", r"""(?i)(?<![A-Za-z0-9_])(?:https?|ftp|ssh|amqp|redis|postgres(?:ql)?|mysql|mongodb)://[^\s"'<>]+|(?:[0-9]{1,3}\.){3}[0-9]{1,3}:[0-9]{2,5}""", "endpoint", False, 0, 8, ("://",), r"[0-9]:[0-9]{2}"),
)
# A weak part of a class counts only beside a part of one of these classes.
COMPLEMENTS = {"id": ("secret",), "secret": ("id", "endpoint"), "endpoint": ("secret",)}
SPANS = "array<struct<start:bigint,kind_no:int,kind:string,end:bigint,partner:bigint,byte_start:bigint,byte_end:bigint,covered:bigint>>"


def _matches(text: Column, low: Column, kind: Kind, beside: Column | None) -> Column:
    """All matches of a kind in order; null, without a look at the pattern, where a hint is missing or the kind cannot count."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    hinted = F.lit(True)
    if kind.hints:
        hinted = F.lit(False)
        for h in kind.hints:
            hinted = hinted | F.contains(low, F.lit(h))
        if kind.like:
            hinted = hinted | text.rlike(kind.like)
    return F.when(hinted if beside is None else hinted & beside, found)


def _pieces(text: Column, found: Column, kind: Kind) -> Column:
    """Of each match in order: characters and bytes of the gap before it, its own, and the length of the tested part."""
    tested = (lambda m: F.regexp_extract(m, kind.pattern, kind.group)) if kind.group else (lambda m: m)
    pairs = F.arrays_zip(F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(found)).alias("g"), found.alias("m"))
    sizes = lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), F.octet_length(x["g"]).alias("bgap"), F.octet_length(x["m"]).alias("blen"), F.length(tested(x["m"])).alias("tested"))
    return F.when(F.size(found) > 0, F.transform(pairs, sizes)).otherwise(F.array().cast("array<struct<gap:int,len:int,bgap:int,blen:int,tested:int>>"))


def scan_secrets(docs: DataFrame, scope: int = 200, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Find secrets in whole texts; one row per row of docs: doc_id, the columns named in keep (NAME_kept if they bear the name of another column of the result), spans.

    spans is SPANS sorted by start, then kind in the order of KINDS: offsets count code points (byte_start
    and byte_end UTF-8 bytes), ends are exclusive. Kinds reported alone (assign, access, hex) are
    leftmost non-overlapping matches whose tested part is long enough. Weak kinds (a user or key
    identifier, a bare mixed-case token, an endpoint) are interval-joined with the parts of the same text:
    one is reported only if it overlaps no strong span and a part of a complementary class lies at most
    `scope` characters before or after it. partner is the start of the nearest such part, for strong kinds too: of
    each class the one before that ends last or the one after that begins first, the earlier of two as near; null if there is none. covered is the byte up to which earlier spans reach. The join runs as
    window frames over a text's sorted parts, so its cost grows with the number of parts and never with their pairs.

    A pattern is matched once over a text that holds one of its hints, and a second time, to cut the text, where it
    has matches; bare tokens, the costliest, are looked for only beside an identifier or endpoint, as they count nowhere else.

    A null or empty text has no spans. Repeated rows each get their row. An empty table gives an empty
    result. Columns of docs that are not named are not read, so clashing names do no harm.
    """
    carried = [c.alias(f"__keep_{n}") for n, c in enumerate(kept(keep, ("doc_id", "spans")))]
    names = docs.select(*kept(keep, ("doc_id", "spans"))).columns
    front = ["doc_id", *[f"__keep_{n}" for n in range(len(keep))]]
    cut = docs.select(F.col(id_col).alias("doc_id"), *carried, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    cut = cut.withColumn("__low", F.lower("__text"))
    text, low = F.col("__text"), F.col("__low")
    cut = cut.select(*front, "__text", *[_matches(text, low, k, None).alias(f"__m{n}") for n, k in enumerate(KINDS) if k.name != "part_secret"])
    beside = F.lit(False)
    for n, k in enumerate(KINDS):
        if k.part in COMPLEMENTS["secret"]:
            beside = beside | (F.coalesce(F.size(f"__m{n}"), F.lit(0)) > 0)
    cut = cut.select(*front, "__text", *[_matches(text, text, k, beside).alias(f"__m{n}") if k.name == "part_secret" else F.col(f"__m{n}") for n, k in enumerate(KINDS)])
    cut = cut.select(*front, *[_pieces(text, F.col(f"__m{n}"), k).alias(f"__k{n}") for n, k in enumerate(KINDS)])
    cut = stable(cut.withColumn("__uid", F.monotonically_increasing_id()))

    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("kind_no") + 1)
    tagged = lambda n: F.transform(F.col(f"__k{n}"), lambda x, i: F.struct(F.lit(n).alias("kind_no"), i.alias("i"), x["gap"].alias("gap"), x["len"].alias("len"), x["bgap"].alias("bgap"), x["blen"].alias("blen"), x["tested"].alias("tested")))
    each = F.flatten(F.array(*[tagged(n) for n in range(len(KINDS))]))
    parts = cut.select("__uid", F.explode(each).alias("p")).select("__uid", "p.*")
    run = Window.partitionBy("__uid", "kind_no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(run)).withColumn("byte_end", F.sum(F.col("bgap") + F.col("blen")).over(run))
    parts = parts.withColumn("start", F.col("end") - F.col("len")).withColumn("byte_start", F.col("byte_end") - F.col("blen"))
    parts = parts.filter(F.col("tested") >= pick([k.least for k in KINDS])).select("__uid", "kind_no", "start", "end", "byte_start", "byte_end", pick([k.part for k in KINDS]).alias("part"), pick([k.strong for k in KINDS]).alias("strong"))

    line = Window.partitionBy("__uid").orderBy("start", "kind_no")
    # what follows is what precedes in falling order: a frame that reaches forward is summed anew for each row
    falling = Window.partitionBy("__uid").orderBy(F.desc("start"), F.desc("kind_no"))
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), falling.rowsBetween(Window.unboundedPreceding, -1)
    overlaps = (F.coalesce(F.max(F.when(F.col("strong"), F.col("end"))).over(before), F.lit(-1)) > F.col("start")) | (F.coalesce(F.min(F.when(F.col("strong"), F.col("start"))).over(after), F.lit(2**40)) < F.col("end"))
    parts = parts.withColumn("weak_free", ~overlaps).filter(F.col("strong") | F.col("weak_free"))
    for c in COMPLEMENTS:
        last = F.max(F.when(F.col("part") == c, F.struct("end", (-F.col("start")).alias("minus")))).over(before)
        parts = parts.withColumn(f"last_{c}", last).withColumn(f"next_{c}", F.min(F.when(F.col("part") == c, F.col("start"))).over(after))
    near = F.lit(None).cast("struct<gap:bigint,start:bigint>")
    for c, others in COMPLEMENTS.items():
        ends = [F.struct(F.greatest(F.lit(0), F.col("start") - F.col(f"last_{o}.end")).alias("gap"), (-F.col(f"last_{o}.minus")).alias("start")) for o in others]
        begins = [F.struct(F.greatest(F.lit(0), F.col(f"next_{o}") - F.col("end")).alias("gap"), F.col(f"next_{o}").alias("start")) for o in others]
        there = [F.when(x["start"].isNotNull() & (x["gap"] <= scope), x) for x in (*ends, *begins)]
        near = F.when(F.col("part") == c, F.least(*there)).otherwise(near)
    parts = parts.withColumn("partner", near["start"]).filter(F.col("strong") | F.col("partner").isNotNull())
    parts = parts.withColumn("covered", F.coalesce(F.max("byte_end").over(before), F.lit(0)))
    spans = parts.select("__uid", F.struct("start", "kind_no", pick([k.name for k in KINDS]).alias("kind"), "end", "partner", "byte_start", "byte_end", "covered").alias("s"))
    spans = spans.groupBy("__uid").agg(F.sort_array(F.collect_list("s")).alias("spans"))
    out = cut.join(spans, "__uid", "left").select("doc_id", *[F.col(f"__keep_{n}").alias(c) for n, c in enumerate(names)], F.coalesce("spans", F.array()).cast(SPANS).alias("spans"))
    return sized(out, cut.count())


def redact(text: Column, spans: Column) -> Column:
    """text with every span replaced by [kind]; of overlapping spans the first keeps its name and all are covered.

    Bytes are cut, each of them once, so the cost is that of the text and its spans. Null stays null; without spans the text is returned as it is.
    """
    part = lambda x, a, b: F.substring(x["raw"], (a + 1).cast("int"), (b - a).cast("int")).cast("string")
    each = lambda x: F.transform(x["spans"], lambda s: F.when(s["byte_start"] >= s["covered"], F.concat(part(x, s["covered"], s["byte_start"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit("")))
    last = lambda x: F.array_max(F.transform(x["spans"], lambda s: s["byte_end"]))
    # a list of one binds the bytes to a variable; outside of it, each span would copy the text anew
    once = F.array(F.struct(text.cast("binary").alias("raw"), spans.alias("spans")))
    done = F.transform(once, lambda x: F.concat(F.array_join(each(x), ""), part(x, last(x), F.octet_length(x["raw"]).cast("long"))))
    return F.when(F.size(spans) > 0, F.get(done, F.lit(0))).otherwise(text)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind_no"] < 3)
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind_no"] == n)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
