import json

import pytest
from pyspark.sql import functions as F

from tessera.errors import ConflictError, PageExists, PageNotFound, SlugError
from tessera.store import Store
from tessera.streaming import incremental


def test_store_life(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert s.list_pages().count() == 0 and s.last_run() is None
    s.write_page("abx:pen", "Penicillin", "About [[abx:cef]].", aliases=["pen"])
    s.write_page("abx:cef", "Cef", "# Dose\ncefazolin dose")
    with pytest.raises(PageExists):
        s.write_page("abx:pen", "x", "y")
    with pytest.raises(ConflictError):
        s.write_page("pen", "x", "y")
    for bad in ("Bad", "a::b", "index", "a\n"):
        with pytest.raises(SlugError):
            s.write_page(bad, "x", "y")
    s.extend_page("pen", "More text.")
    assert s.read("pen")["body"] == "About [[abx:cef]].\n\nMore text.\n"
    s.rename_page("abx:cef", "abx:cefazolin")
    assert s.read("abx:cef")["slug"] == "abx:cefazolin" and "[[abx:cefazolin]]" in s.read("pen")["body"]
    assert [r["src"] for r in s.backlinks("abx:cef").collect()] == ["abx:pen"]
    with pytest.raises(PageNotFound):
        s.read("nothing")
    q = spark.createDataFrame([(1, "cefazolin dose")], "qid long, question string")
    assert s.search(q).collect()[0]["slug"] == "abx:cefazolin"
    assert s.search(q, "bm25+semantic").collect()[0]["slug"] == "abx:cefazolin"
    assert [r["text"] for r in s.grep("dose").collect()] == ["cefazolin dose"]
    assert [r["heading"] for r in s.outline("abx:cefazolin").collect()] == ["Dose"]
    assert s.index_level().collect()[0]["name"] == "abx"
    s.append_log("did it")
    s.record_run()
    s.set_state("seen", {"n": 1})
    s.set_state("seen", {"n": 2})
    assert s.get_state("seen") == {"n": 2} and s.get_state("other") is None
    assert s.log.count() == 1 and s.last_run()["head"] == s.head("pages")


def test_sources_life(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.write_page("abx:pen", "Penicillin", "About penicillin.", aliases=["abx:p"], provenance=[("sources/a", None)])
    files = spark.createDataFrame([("one.md", "names [[abx:pen]] and abx:p here", "k"), ("two.md", "names nothing", None)], "name string, content string, document_key string")
    first = {r["rel_path"].split("/")[-1]: r for r in s.add_sources(files, "in").collect()}
    assert set(first) == {"one.md", "two.md"} and first["one.md"]["document_key"] == "k"
    assert s.add_sources(files, "in").count() == 0 and s.sources.count() == 2  # registered already
    assert sorted((r["token"] or "", r["page_slug"] or "", r["scanned_at"] is not None) for r in s.refs().collect()) == [("", "", True), ("abx:p", "abx:pen", True), ("abx:pen", "abx:pen", True)]
    again = s.add_sources(spark.createDataFrame([("one.md", "a new version", "k")], "name string, content string, document_key string"), "in").collect()
    old = s.sources.filter(F.col("rel_path") == first["one.md"]["rel_path"]).collect()[0]
    assert old["superseded_by"] == again[0]["rel_path"] and again[0]["superseded_by"] is None
    assert s.record_ingestion(again[0]["rel_path"], ["abx:pen"]) == 1
    with pytest.raises(PageNotFound):
        s.record_ingestion("nowhere.md", [])
    s.rename_page("abx:pen", "abx:penicillin")
    assert {r["page_slug"] for r in s.table("refs").collect()} == {"abx:penicillin"}
    s.remove_source_text(again[0]["rel_path"])
    assert s.collect_sources() == 1 and s.collect_sources() == 0
    assert s.sources.filter("document_key = 'k'").collect()[0]["superseded_by"] is None
    told = s.backfill_keys().collect()
    assert [(r["candidate"], r["ambiguous"]) for r in told] == [("in/two", False)]
    assert {r["document_key"] for r in s.sources.collect()} == {"k", "in/two"}


def test_writers_index_and_audit(spark, tmp_path, monkeypatch):
    from tessera import store

    monkeypatch.setattr(store, "COMPACT", 3)
    s = Store(spark, str(tmp_path / "store"), author="me")
    for n in range(4):
        s.write_page(f"n:p{n}", f"Page {n}", f"words number{n} of [[n:p{(n + 1) % 4}]]")
    assert len(s._commit("pages")[1]) < 4 and s.pages.count() == 4
    other = Store(spark, str(tmp_path / "store"))
    n, folders = other._commit("pages")
    s.extend_page("n:p0", "more")
    with pytest.raises(ConflictError):
        other._put("pages", other.pages.limit(0), n + 1, folders)
    assert s.pages.count() == 4 and "more" in s.read("n:p0")["body"]
    assert [r["kind"] for r in s.lint().collect()] == ["index-missing"]
    s.rebuild_index()
    assert s.lint().count() == 0 and "4 pages" in s.read("index")["body"]
    before = s.links().count()
    assert s.fs.exists(s._path(f"cache/links-{s.head('pages')}")) and before == 4
    assert {r["status"]: r["rel_path"] for r in s.reindex().filter("status = 'reindexed'").collect()} and s.reindex().filter("status = 'reindexed'").count() == 0
    assert "n:p1" in [r["slug"] for r in s.similar("n:p0", 3).collect()] and "n:p0" not in [r["slug"] for r in s.similar("n:p0", 3).collect()]
    assert [r["subject"] for r in s.history("n:p0").collect()] == ["extend: n:p0", "compact: n:p0"]
    s.append_log("looked at it")
    assert [r["kind"] for r in s.evolution(["n:p0", "n:p1"]).collect()] == ["revision", "revision", "revision", "log"]
    assert s.steering().count() == 0 and Store(spark, s.root, author="robot").steering().count() == 5
    ranked, said = s.searched(spark.createDataFrame([(1, "number2"), (2, "zzz")], "qid long, question string"), "semantic")
    assert {(r["qid"], r["strategy"], r["abstained"], r["note"] is None) for r in said.collect()} == {(1, "bm25", False, False), (2, "bm25", True, False)}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import io

    from tessera.__main__ import main

    root, notes = str(tmp_path / "store"), tmp_path / "notes"
    notes.mkdir()
    (notes / "a.md").write_text("---  \ntitle: A: b\nslug: a\n---\n\nSee [[b]].\n")
    (notes / "b.md").write_text("---\ntitle: B\n---\n\nback to [[a]]\n")
    (notes / "c.md").write_text("no block")
    run = lambda *words: (main([words[0], root, *words[1:]]), [json.loads(x) if x.startswith("{") else x for x in capsys.readouterr().out.splitlines()])
    assert [r["path"] for r in run("import", str(notes))[1]] == ["c.md"]
    assert [r["slug"] for r in run("list")[1]] == ["a", "b"]
    monkeypatch.setattr("sys.stdin", io.StringIO("more of it"))
    run("extend", "a")
    assert [r["text"] for r in run("grep", "more")[1]] == ["more of it"]
    assert [r["src"] for r in run("backlinks", "a")[1]] == ["b"]
    assert run("lint")[0] == 1 and run("index-rebuild")[0] == 0 and run("lint")[0] == 0
    assert run("add-source", str(notes), "c.md", "--key", "c")[1][0]["document_key"] == "c"
    place = run("sources")[1][0]["rel_path"]
    assert run("ingest", place, "a")[1] == ["1"] and run("stale")[1] == [] and run("gc")[1] == ["0"]
    assert len(run("reindex")[1]) == 3 and [r["slug"] for r in run("similar", "a")[1]] == ["b"]
    assert run("export", str(tmp_path / "out"))[1] == ["3"] and "title: 'A: b'" in (tmp_path / "out" / "a.md").read_text()
    assert [r["slug"] for r in run("search", "back")[1]] == ["b"] and run("history", "a")[1][0]["subject"] == "extend: a"


def test_streams(spark, tmp_path):
    files = tmp_path / "files"
    spark.createDataFrame([("a", "one\n\ntwo"), ("b", "three")], "slug string, body string").write.parquet(str(files))
    table, ck = str(tmp_path / "chunks"), str(tmp_path / "ck")
    run = lambda: incremental.reindex_stream(spark.readStream.schema("slug string, body string").parquet(str(files)), table, ck).trigger(availableNow=True).start().awaitTermination()
    run()
    spark.createDataFrame([("a", "changed")], "slug string, body string").write.mode("append").parquet(str(files))
    run()
    assert {r["slug"]: r["content"] for r in incremental.current_chunks(spark, table).collect()} == {"a": "changed", "b": "three"}


def test_windows_and_versions(spark, tmp_path):
    c = spark.sql("SELECT * FROM VALUES (TIMESTAMP'2024-01-01 10:00:00', 1, 'log: x'), (TIMESTAMP'2024-01-01 12:00:00', 2, 'extend: a'), (TIMESTAMP'2024-01-02 01:00:00', 2, 'log: y') AS t(date, author, subject)")
    assert sorted((str(r["start"].date()), r["author"], r["n"]) for r in incremental.steering_windows(c, 1).collect()) == [("2024-01-01", 2, 1), ("2024-01-02", 2, 1)]
    assert sum(r["n"] for r in incremental.retained_windows(c).collect()) == 3
    src = tmp_path / "arr"
    schema = "document_key string, rel_path string, seq long"
    spark.createDataFrame([("k", "v1", 1), ("k", "v2", 2), ("j", "w1", 1)], schema).write.parquet(str(src))
    q = incremental.running_versions(spark.readStream.schema(schema).parquet(str(src))).writeStream.format("memory").queryName("versions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["document_key"], r["rel_path"], r["supersedes"], r["version"]) for r in spark.table("versions").collect()) == [("j", "w1", None, 1), ("k", "v1", None, 1), ("k", "v2", "v1", 2)]
