"""Operators that SQL does not say, and facts that the fixtures pin."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import chunks, evaluate, graph, history, lint, outline, retrieve, search, vectors
from tessera.plans import config, strategy
from tessera.sources import bank as bank_file
from tessera.sources import markdown

BODY = """intro line

# One
text
## Two `x` ##
```sh
# not a heading
~~~
```
more
~~~
# still not
~~~
# Three
"""


def pages(spark, **bodies):
    return spark.createDataFrame([(k, k, v) for k, v in bodies.items()], "slug string, title string, body string")


# --- outline


def test_sections_and_preamble(spark):
    p = pages(spark, a=BODY, b="no headings", c="# Only")
    got = {(r["slug"], r["heading"]): r for r in outline.sections(p).collect()}
    assert {k: (r["level"], r["start_line"], r["end_line"]) for k, r in got.items()} == {("a", "One"): (1, 3, 13), ("a", "Two `x`"): (2, 5, 13), ("a", "Three"): (1, 14, 15), ("c", "Only"): (1, 1, 1)}
    lines = BODY.split("\n")
    assert got["a", "One"]["char_count"] == len("\n".join(lines[2:13]))
    assert {r["slug"]: r["preamble_chars"] for r in outline.preamble(p).collect()} == {"a": len("intro line\n"), "b": 11, "c": 0}
    assert {r["start_line"] for r in outline.sections(p, offset=10).filter("heading = 'One'").collect()} == {13}


def test_find_and_render_sections(spark):
    p = pages(spark, a=BODY)
    s = outline.sections(p)
    assert [r["heading"] for r in outline.find_section(s, " three ").collect()] == ["Three"]
    assert sorted(r["heading"] for r in outline.find_section(s, "t").collect()) == ["Three", "Two `x`"]
    assert outline.find_section(s, "zzz").count() == 0
    text = outline.section_text(p, outline.find_section(s, "two")).collect()[0]["text"]
    assert text.startswith("## Two") and text.endswith("~~~")
    row = sorted(outline.rendered(s).collect(), key=lambda r: r["pos"])[1]["row"]
    assert row.startswith("    Two `x`") and "L5-13" in row
    long = outline.sections(pages(spark, a="# " + "x" * 90))
    assert "…" in outline.rendered(long).collect()[0]["row"]


def test_index_page(spark):
    p = pages(spark, b="", a="").withColumn("tags", F.array(F.lit("t")))
    assert outline.index_page(p).collect()[0]["text"] == "# Index\n\n2 pages.\n\n- [[a]] — a (t)\n- [[b]] — b (t)\n"
    assert "_(no pages yet)_" in outline.index_page(p.limit(0)).collect()[0]["text"]


# --- chunks


def slow_groups(lengths, size, overlap):
    out, i, used = [], 0, -1
    while i < len(lengths):
        group, total = [], 0
        while i < len(lengths):
            if group and total + lengths[i] + 2 > size:
                break
            group.append(i)
            total += lengths[i] + 2
            i += 1
            if total >= size:
                break
        out.append((group[0], group[-1]))
        if overlap and i < len(lengths):
            i = max(group[-1] + 1 - min(overlap, len(group) - 1), used + 1)
        used = group[-1]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=30), st.integers(1, 60), st.integers(0, 3))
def test_groups_cover_and_progress(lengths, size, overlap):
    got = chunks.group_paragraphs(lengths, size, overlap)
    assert got == slow_groups(lengths, size, overlap)
    assert {i for a, z in got for i in range(a, z + 1)} == set(range(len(lengths)))


def test_chunk_facts(spark):
    assert chunks.group_paragraphs([1000, 900, 1500], 2000, 1) == [(0, 1), (1, 1), (2, 2)]
    p = pages(spark, empty="  \n ", short=" one \n \t\n two\n\n\nthree ", big="x" * 5000)
    got = {(r["slug"], r["chunk_index"]): r for r in chunks.chunk(p, overlap=0).collect()}
    assert set(got) == {("short", 0), ("big", 0)} and len(got["big", 0]["content"]) == 5000
    r = got["short", 0]
    assert (r["content"], r["start_char"], r["end_char"]) == ("one\n\ntwo\n\nthree", 0, len("one \n \t\n two\n\n\nthree"))
    with pytest.raises(ValueError):
        chunks.chunk(p, size=0)


# --- text


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).collect()[0]["c"]
    assert one(X.slugify(F.lit("  Été à  la_Plage -- 2! "))) == "ete-a-la-plage-2"
    assert one(X.slugify(F.lit("😀"))) == ""
    assert one(X.keywords(F.lit("What is the réaux? The X-ray of réaux AUX 12"))) == ["aux", "ray"]
    assert one(X.preview(F.lit("a\nb " + "c" * 300)))[-1] == "…" and len(one(X.preview(F.lit("c" * 300)))) == 198
    assert [one(X.human_size(F.lit(n))) for n in (0, 999, 1000, 1250, 12345)] == ["0 B", "999 B", "1.0 kB", "1.3 kB", "12.3 kB"]
    assert one(X.links_to_markdown(F.lit("a [[x:y|l]] [[Z]] [[ q ]] z"))) == "a [l](/wiki/x/y) [[Z]] [q](/wiki/q) z"
    assert [tuple(r) for r in one(X.anchored_links(F.lit("[[Note A#sec|shown]] [[B]]")))] == [("Note A", "#sec", "shown"), ("B", "", "B")]
    assert one(X.rename_links(F.lit("[[a:b]] [[ a:b |x]] [[a:b:c]] a:b"), "a:b", "n")) == "[[n]] [[n|x]] [[a:b:c]] a:b"
    assert one(X.normal_lines(F.lit(" a  \nb\t\n\n"))) == "a\nb"
    assert one(X.iso_z(X.parse_iso(F.lit("2024-02-03")))) == "2024-02-03T00:00:00Z"
    assert one(X.parse_iso(F.lit("2024-02-30"))) is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.from_regex(r"\A[a-z0-9]{1,6}(-[a-z0-9]{1,6}){0,2}\Z"), min_size=1, max_size=4).map(":".join), min_size=1, max_size=8))
def test_slugs_and_paths_are_one_to_one(spark, slugs):
    rows = spark.createDataFrame([(s,) for s in slugs], "slug string").select("slug", X.valid_slug("slug").alias("ok"), X.path_to_slug(X.slug_to_path("slug")).alias("back")).collect()
    assert all(r["ok"] and r["back"] == r["slug"] for r in rows)


# --- search


def test_context_islands_and_caps(spark):
    p = pages(spark, a="\n".join("hit" if i in (2, 4, 9) else f"l{i}" for i in range(1, 12)), b="hit")
    assert [(r["line_no"], r["is_match"]) for r in search.grep(p.filter("slug = 'a'"), "hit", context=1).orderBy("line_no").collect()] == [(1, False), (2, True), (3, False), (4, True), (5, False), (8, False), (9, True), (10, False)]
    capped = search.grep_capped(p, "hit", 1, context=3).orderBy("line_no").collect()
    assert [r["line_no"] for r in capped] == [1, 2, 3]
    islands = search.rendered(search.grep(p.filter("slug = 'a'"), "hit", context=1), 1).orderBy("line_no").collect()
    assert [r["island"] for r in islands] == [0] * 5 + [1] * 3 and islands[0]["line"] == "a-1-l1" and islands[1]["line"] == "a:2:hit"
    with pytest.raises(ValueError):
        search.checked_paths(["a/../../b"])
    assert search.grep(p, "a.b", fixed=True).count() == 0


# --- retrieval


def corpus(spark):
    return pages(spark, **{"abx:pen": "penicillin dose is high\npenicillin again", "abx:cef": "cefazolin dose", "ops:wash": "wash hands"})


def bank(spark):
    rows = [(1, "What is the penicillin dose?", ["abx:pen"]), (2, "wash hands how", ["ops:wash"]), (3, "quantum chromodynamics", []), (4, "what is the", [])]
    return spark.createDataFrame(rows, "qid long, question string, gold array<string>")


def test_retrievers_and_scorecard(spark):
    p, b = corpus(spark), bank(spark)
    for run in (retrieve.lexical, retrieve.bm25):
        ranked = run(b, p)
        first = {r["qid"]: r["slug"] for r in ranked.filter("rank = 1").collect()}
        assert first == {1: "abx:pen", 2: "ops:wash"}
        assert evaluate.scorecard(evaluate.results(b, ranked)).collect()[0].asDict() == {"score": 1.0, "hit_at_k": 1.0, "abstention": 1.0, "n_answerable": 2, "n_unanswerable": 2}
    nothing = evaluate.scorecard(evaluate.results(b.limit(0), retrieve.bm25(b, p))).collect()[0]
    assert nothing["score"] == nothing["hit_at_k"] == nothing["abstention"] == 0.0


def test_gate_invariants(spark):
    p, b = corpus(spark), bank(spark).filter("qid < 4")
    source = retrieve.bm25(b, p, 30)
    said = spark.createDataFrame([(1, ["invented", "abx:cef", "abx:cef", "abx:pen"]), (2, None)], "qid long, slugs array<string>")
    got = {r["qid"]: r for r in retrieve.rerank(source, b, p, lambda _: said).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "slug"))).alias("l")).collect()}
    assert [x["slug"] for x in got[1]["l"]] == ["abx:cef", "abx:pen"] and [x["slug"] for x in got[2]["l"]] == ["ops:wash"] and 3 not in got
    none = spark.createDataFrame([(1, []), (2, [])], "qid long, slugs array<string>")
    assert retrieve.rerank(source, b, p, lambda _: none).count() == 0


def test_fusion_ties_go_to_the_first_contribution(spark):
    leg = lambda *s: spark.createDataFrame([(1, x, n + 1, 0.0) for n, x in enumerate(s)], "qid long, slug string, rank int, score double")
    got = [r["slug"] for r in retrieve.fuse([leg("z", "y"), leg("a", "y")]).orderBy("rank").collect()]
    assert got == ["y", "z", "a"]
    with pytest.raises(ValueError):
        retrieve.fuse([leg("a")])


def test_strategy_language():
    for spec in ("lexical", "bm25", "semantic", "hyde", "rerank(bm25)", "bm25+semantic", "lexical+bm25+hyde"):
        assert strategy.render(strategy.parse(spec.upper())) == spec
    assert strategy.render(strategy.parse("rerank")) == "rerank(lexical)"
    for bad in ("", None, "x", "bm25+bm25", "bm25+rerank", "rerank(rerank)", "bm25+", "rerank()"):
        with pytest.raises(strategy.StrategyError):
            strategy.parse(bad)
    with pytest.raises(strategy.StrategyError):
        strategy.parse("bm25", k=0)
    s = strategy.parse("bm25+semantic")
    assert s.needs_vectors and strategy.usable(s, False)[0].kind == "bm25" and "vector index" in strategy.usable(s, False)[1]
    assert strategy.disallowed(strategy.parse("rerank(bm25)"), ["bm25"]) == ["rerank"] and strategy.disallowed(s, None) == []
    assert strategy.parse("bm25").fingerprint == strategy.parse(" BM25 ").fingerprint != strategy.parse("bm25", k=3).fingerprint


def test_latency_and_saturation(spark):
    lat = lambda *v: tuple(evaluate.latency(spark.createDataFrame([(float(x),) for x in v], "ms double")).collect()[0])
    assert lat(10, 20, 30, 40) == (25.0, 40.0) and lat(*range(10, 210, 10)) == (105.0, 190.0) and lat() == (0.0, 0.0)
    assert evaluate.saturated(5, 19) and not evaluate.saturated(5, 20)


# --- vectors


def test_knn_blocks_threshold_and_ties(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(100, [0.0] * 8), (101, [1.0] + [0.0] * 7), (102, [2.0] + [0.0] * 7)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = v.withColumnRenamed("id", "qid")
    whole = sorted(map(tuple, vectors.knn(q, v, 4).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 7)
    assert sorted(map(tuple, vectors.knn(q, v, 4).collect())) == whole
    assert [r[1] for r in whole if r[0] == 102][:2] == [101, 102] or [r[1] for r in sorted(whole, key=lambda r: r[3]) if r[0] == 102][:2] == [101, 102]
    assert all(r["id"] != r["qid"] and r["sim"] >= 0.5 for r in vectors.knn(q, v, 3, threshold=0.5, exclude_self=True).collect())
    assert vectors.knn(q.limit(0), v, 3).count() == 0


def test_embedding_errors_stay_in_their_rows(spark):
    def model(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "a")], "id long, text string")
    got = {r["id"]: r for r in vectors.embed(rows, "id", "text", model).collect()}
    assert got[1]["embedding"] == got[3]["embedding"] == [1.0] and got[2]["error"] == "RuntimeError: no"
    meta = spark.createDataFrame([("model", "m"), ("dims", "64")], "key string, value string")
    vectors.checked_index(meta, "m", 64)
    with pytest.raises(ValueError):
        vectors.checked_index(meta, "m", 32)


# --- graph, audit, history


def test_chains_of_any_length(spark):
    n = 300
    rows = [(f"v{i:03d}", f"v{i + 1:03d}" if i + 1 < n else None) for i in range(n)] + [("x", "y"), ("y", "z"), ("z", "x"), ("lost", "gone")]
    got = {r["rel_path"]: (r["newest"], r["hops"]) for r in graph.chains(spark.createDataFrame(rows, "rel_path string, superseded_by string")).collect()}
    assert all(got[f"v{i:03d}"] == ("v299", n - 1 - i) for i in range(n))
    assert [got[k] for k in ("x", "y", "z", "lost")] == [("x", 0), ("y", 0), ("z", 0), ("lost", 0)]


def test_rename_leaves_an_alias(spark):
    p = pages(spark, a="x", b="[[a]] [[a|y]] [[a:c]]").withColumn("aliases", F.array().cast("array<string>"))
    refs = spark.createDataFrame([("s", "a", "a")], "rel_path string, token string, page_slug string")
    moved, told = graph.rename(p, refs, "a", "n")
    got = {r["slug"]: r for r in moved.collect()}
    assert got["n"]["aliases"] == ["a"] and got["b"]["body"] == "[[n]] [[n|y]] [[a:c]]" and told.collect()[0]["page_slug"] == "n"
    assert graph.resolve(spark.createDataFrame([("a",)], "name string"), moved).collect()[0]["slug"] == "n"


def test_exit_codes(spark):
    rows = lambda *s: spark.createDataFrame([("k", x, "p", "d") for x in s], "kind string, severity string, path string, detail string")
    assert [lint.exit_code(rows(*s)) for s in ((), ("warning",), ("warning", "error"))] == [0, 1, 2]
    assert lint.missing_root(spark, True).count() == 0 and lint.missing_root(spark, False).count() == 1
    p = pages(spark, a="").withColumn("slug", F.lit("a"))
    no_index = spark.createDataFrame([], "slug string, body string")
    assert [r["kind"] for r in lint.index_checks(p, no_index, spark.createDataFrame([("x",)], "text string")).collect()] == ["index-missing"]


def test_tool_calls(spark):
    trace = spark.createDataFrame([("grep", {"scope": "wiki"}), ("grep", {"scope": "log"}), ("read", {"scope": "wiki"})], "tool string, args map<string,string>")
    assert history.tool_calls(trace, "grep", scope="wiki").count() == 1


def test_patches(spark):
    rows = [("p", "s1", 1, "a\nb\n"), ("p", "s2", 2, "a\nc\n"), ("q", "s3", 1, "x\n")]
    got = {r["sha"]: r["patch"] for r in history.patches(spark.createDataFrame(rows, "path string, sha string, date long, body string")).collect()}
    assert "-b\n+c\n" in got["s2"] and got["s3"].endswith("+x\n") and "+a\n+b\n" in got["s1"]


def test_addressing_probes(spark):
    """What a name resolves to: canonical and namespaced pages, aliases, a page that an alias cannot shadow, names that nothing has."""
    rows = [("flat", []), ("abx:penicillin", []), ("abx:side-effects:misc", []), ("current:name", ["legacy:name"]), ("live-name", []), ("claimant", ["live-name", "two"]), ("rival", ["two", "index"])]
    p = spark.createDataFrame(rows, "slug string, aliases array<string>")
    want = {"flat": "flat", "abx:penicillin": "abx:penicillin", "abx:side-effects:misc": "abx:side-effects:misc", "legacy:name": "current:name", "current:name": "current:name", "live-name": "live-name", "two": "two", "index": "index", "no-such": "no-such", "abx": "abx"}
    got = {r["name"]: r["slug"] for r in graph.resolve(spark.createDataFrame([(n,) for n in want], "name string"), p).collect()}
    assert got == want


# --- markdown, banks, settings


def test_bank_round_trip(spark, tmp_path):
    rows = [(0, "a?", ["x:y"], None), (1, "b?", [], "log")]
    b = spark.createDataFrame(rows, "qid long, question string, gold array<string>, source string")
    (tmp_path / "bank.json").write_text(bank_file.one_document(b).collect()[0]["value"])
    assert [tuple(r) for r in bank_file.load_bank(spark, str(tmp_path / "bank.json")).orderBy("qid").collect()] == rows
    (tmp_path / "half.json").write_text('{"answerable": [{"question": "q", "gold_slugs": ["s"]}]}')
    assert [tuple(r) for r in bank_file.load_bank(spark, str(tmp_path / "half.json")).collect()] == [(0, "q", ["s"], None)]
    bank_file.save_bank(b, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2


def test_settings():
    s = config.load("k: '7'\nembed_frontmatter: 'yes'\nrrf_k: many\nscope: 3\nmine: 1")
    assert (s.k, s.embed_frontmatter, s.rrf_k, s.scope, s.extra) == (7, True, 60, "pages", {"mine": 1})
    assert config.load("- a") == config.load("a: [") == config.Settings()


GOOD = "---\ntitle: A page\nslug: a\ntags: [007, 12:30, yes, x]\naliases: [12:30, 'Bad One', ok:two]\nprovenance:\n- sources/a.md\n- {path: sources/b.md, sha256: ff, page_range: 1-2}\ncreated: 2026-07-23\nupdated: 2026-07-23T10:11:12Z\nowner: me\n---\n\nBody [[x]]\n"


def test_parse_and_round_trip():
    p = markdown.parse(GOOD)
    assert p["tags"] == ["007", "12:30", "yes", "x"] and p["aliases"] == ["12:30", "ok:two"]
    assert p["provenance"][1]["sha256"] == "ff" and p["created"].hour == 0 and p["body"] == "Body [[x]]\n"
    again = markdown.parse(markdown.serialise(p))
    assert {k: again[k] for k in p} == p
    for bad in ("no block", "---\n- x\n---\n", "---\nslug: a\n---\n", "---\ntitle: t\n---\n", "---\ntitle: t\nslug: a\ncreated: 2026-02-30\n---\n", "---\ntitle: t\nslug: a\ntags: x\n---\n"):
        with pytest.raises(markdown.PageError):
            markdown.parse(bad)
    assert markdown.parse("---\ntitle: t\n---\nb", "path:slug")["slug"] == "path:slug"


def test_repair():
    broken = "---\ntitle: Flu (1): it's here\nslug: a\n---\nb"
    fixed = markdown.repair(broken)
    assert markdown.parse(fixed)["title"] == "Flu (1): it's here"
    assert markdown.repair(fixed) is None and markdown.repair("none") is None and markdown.repair("---\na: [\nb: c: d\n---\n") is None


def test_loader_keeps_failures(spark, tmp_path):
    (tmp_path / "abx").mkdir()
    (tmp_path / "abx" / "pen.md").write_text(GOOD)
    (tmp_path / "bad.md").write_text("nothing")
    (tmp_path / "mend + me.md").write_text("---\ntitle: a: b\n---\nx")
    got = {r["path"]: r for r in markdown.parse_all(markdown.read_files(spark, str(tmp_path))).collect()}
    assert set(got) == {"abx/pen.md", "bad.md", "mend + me.md"}
    assert got["abx/pen.md"]["slug"] == "abx:pen" and got["abx/pen.md"]["declared"] == "a"
    assert got["bad.md"]["error"] and got["bad.md"]["body"] == "nothing"
    assert got["mend + me.md"]["repaired"] and got["mend + me.md"]["title"] == "a: b"
    strict = {r["path"]: r["error"] for r in markdown.parse_all(markdown.read_files(spark, str(tmp_path)), strict=True).collect()}
    assert strict["mend + me.md"]
    markdown.write_pages(markdown.parse_all(markdown.read_files(spark, str(tmp_path))), str(tmp_path / "out"))
    out = {r["path"]: r["content"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert markdown.parse(out["abx/pen.md"])["tags"] == ["007", "12:30", "yes", "x"]


def test_vault_import(spark):
    files = [("a/alpha.md", "# First\n[[beta]] [[Nowhere]]"), ("b/alpha.md", "[[alpha#sec|s]]"), ("Bêta.md", "see [[b-alpha]]"), (".hidden/x.md", "hidden"), ("root.md", "x")]
    got = {r["path"]: r for r in markdown.import_vault(spark.createDataFrame(files, "path string, content string")).collect()}
    assert {k: r["slug"] for k, r in got.items()} == {"a/alpha.md": "alpha", "b/alpha.md": "b-alpha", "Bêta.md": "beta", "root.md": "root"}
    assert got["a/alpha.md"]["title"] == "First" and got["a/alpha.md"]["body"] == "# First\n[[beta|beta]] [[Nowhere]]"
    assert (got["a/alpha.md"]["rewritten"], got["a/alpha.md"]["unresolved"]) == (1, 1)
    assert got["b/alpha.md"]["body"] == "[[alpha#sec|s]]" and got["Bêta.md"]["body"] == "see [[b-alpha|b-alpha]]"
    assert markdown.resolve_slugs(["x/a.md", "a.md", "😀.md", "x/😀.md"]) == {"a.md": "a", "x/a.md": "x-a", "x/😀.md": "page", "😀.md": "page-2"}


# --- later additions


def test_embedding_cache_and_tokens(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(len(texts))
        return [([float(len(t))], 7) for t in texts]

    rows = spark.createDataFrame([(1, "a"), (2, "known"), (3, "a"), (4, None)], "id long, text string")
    cache = spark.createDataFrame([("known", [9.0])], "text string, embedding array<double>")
    done = vectors.embed(rows, "id", "text", model, cache=cache)
    got = {r["id"]: (r["embedding"], r["error"], r["tokens"]) for r in done.collect()}
    assert got == {1: ([1.0], None, 7), 2: ([9.0], None, 0), 3: ([1.0], None, 7), 4: (None, None, 0)} and calls.value == 1
    assert vectors.usage(done.join(rows, "id")).collect()[0].asDict() == {"texts": 1, "tokens": 7}


def test_knn_with_null_vectors_and_ties(spark):
    vs = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (4, [0.0, 1.0]), (5, [0.0, 0.0])], "id long, embedding array<double>")
    qs = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "qid long, embedding array<double>")
    assert sorted((r["qid"], r["rank"], r["id"], r["sim"]) for r in vectors.knn(qs, vs, k=3).collect()) == [(9, 1, 1, 1.0), (9, 2, 3, 1.0), (9, 3, 4, 0.0)]
    assert vectors.knn(qs.limit(0), vs).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.integers(0, 50)), max_size=200, unique_by=lambda x: (x[0], x[2])), st.integers(1, 4))
def test_best_equals_sorting(rows, k):
    import numpy as np

    from tessera.operators.topk import Best

    best = Best(k, 4)
    best.most = 5
    for a in range(0, len(rows), 7):
        q, s, n = (np.array(x) for x in zip(*rows[a : a + 7], strict=True))
        best.add(q.astype(np.int64), s.astype(float), n.astype(np.int64))
    got = sorted(zip(*(x.tolist() for x in best.prune()), strict=True))
    want = sorted((q, float(s), n) for i in range(4) for q, s, n in sorted((r for r in rows if r[0] == i), key=lambda r: (-r[1], r[2]))[:k])
    assert got == want


def test_neighbours_and_ranks_of_hot_keys(spark):
    from tessera.plans.ranks import global_rank, next_in_key

    rnd = random.Random(2)
    rows = [("hot" if i % 3 else f"k{i % 7}", rnd.randint(0, 400), f"p{i:04d}") for i in range(900)] + [(None, 1, "lost")]
    df = spark.createDataFrame(rows, "k string, seq long, p string")
    want = {}
    for key in {r[0] for r in rows} - {None}:
        own = sorted((s, p) for k, s, p in rows if k == key)
        want |= {p: (own[n + 1][1] if n + 1 < len(own) else None) for n, (_, p) in enumerate(own)}
    for buckets in (1, 5, 64):
        assert {r["p"]: r["next"] for r in next_in_key(df, "k", "seq", "p", "next", buckets).collect()} == want | {"lost": None}
    ranked = {r["p"]: r["rank"] for r in global_rank(df, [F.col("seq"), F.col("p")]).collect()}
    assert ranked == {p: n + 1 for n, (_, p) in enumerate(sorted((s, p) for _, s, p in rows))}


def test_accents_of_all_letters(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).collect()[0]["c"]
    assert one(X.tokens(F.lit("Tiếng Việt e\u0301te\u0323 Ǆ"))) == ["tieng", "viet", "ete", "ǆ"]
    assert one(X.slugify(F.lit("Tiếng Việt ﬁne Ａ ½ Ⅳ"))) == "tieng-viet-fine-a-12-iv"


def test_containment_of_hard_questions(spark):
    p = spark.createDataFrame([("a", "the same start of it and one end"), ("b", "the same start of it and another end, the same start of it and one end"), ("c", None)], "slug string, body string")
    asked = [(1, "the same start of it and one end"), (2, "the same start of it and another end"), (3, ""), (4, "x" * 30), (5, "end"), (6, None)]
    got = {r["qid"]: r["gold"] for r in evaluate.gold_by_containment(spark.createDataFrame(asked, "qid long, question string"), p).collect()}
    assert got == {1: ["a", "b"], 2: ["b"], 3: ["a", "b"], 4: [], 5: ["a", "b"], 6: []}


def test_frontmatter_may_open_with_blanks_and_pages_become_files(spark, tmp_path):
    files = spark.createDataFrame([("x/a.md", "---  \ntitle: A\ntags: [t]\n---\n\nbody\n")], "path string, content string")
    parsed = markdown.parse_all(files)
    assert parsed.first()["title"] == "A" and markdown.write_files(parsed, str(tmp_path)) == 1
    again = markdown.parse_all(markdown.read_files(spark, str(tmp_path))).first()
    assert (again["path"], again["body"], again["tags"]) == ("x/a.md", "body\n", ["t"])


def test_settings_are_merged_and_blocks_upserted():
    s = config.merged(config.load("k: 7"), strategy="bm25", rrf_k=None)
    assert (s.k, s.strategy, s.rrf_k) == (7, "bm25", 60)
    with pytest.raises(ValueError):
        config.merged(s, nothing=1)
    text = "a: 1\n# note\nretrieval:\n  k: 5\n  old: x\n\nlast: 2\n"
    out = config.upserted(text, "retrieval", {"k": 9})
    assert out == "a: 1\n# note\nretrieval:\n  k: 9\n  old: x\n\nlast: 2\n"
    assert config.upserted("", "b", {"c": True}) == "b:\n  c: true\n"
    assert config.upserted("a: 1", "b", {"c": 1}) == "a: 1\nb:\n  c: 1\n"


def test_commits_between_heads(spark):
    commits = spark.createDataFrame([(x, "me" if x in "bd" else "you") for x in "abcdef"], "sha string, author string")
    parents = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("f", None)], "sha string, parent string")
    shas = lambda *a, **k: sorted(r["sha"] for r in history.between_heads(commits, parents, *a, **k).collect())
    assert shas("b", "d") == ["c", "d"] and shas(None, "c") == ["a", "b", "c"] and shas("a", "e", author="me") == ["b", "d"]
    assert shas("f", "c") == ["a", "b", "c"] and shas("b", "zz") == []
    renames = spark.createDataFrame([("old", "mid"), ("mid", "new")], "path string, new_path string")
    paths = spark.createDataFrame([("old",), ("mid",), ("new",), ("other",)], "path string")
    assert sorted(r["path"] for r in history.followed(paths, renames, ["new"]).collect()) == ["mid", "new", "old"]
    assert sorted(r["path"] for r in history.followed(paths, renames, ["new", "other"]).collect()) == ["new", "other"]


def test_words_in_workers_equal_the_column(spark):
    rnd = random.Random(11)
    letters = [chr(c) for c in range(32, 0x250)] + list("\u0301\u0307\u1ebf\u0130\u03a3\u03c2\u4e2d\u0663\u2167\ufb01\u212a\U0001f600") + list("abc AB 12 \n") * 20
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80))) for _ in range(1500)] + ["", None, "plain ASCII_text, 2x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, body string").select("id", X.tokens("body").alias("w")).collect()
    assert all((r["w"] or []) == retrieve.words_of(texts[r["id"]]) for r in rows)

