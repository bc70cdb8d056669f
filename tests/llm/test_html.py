import hashlib
import html as H
import re
import time
from collections import Counter

from helpers import no_docs
from pyspark.sql import functions as F

from tessera.llm import html

NONE = html.Weights()


def test_articles_of_the_table_are_whole(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = html.op1_max_subsequence(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(H.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_boilerplate_inside_and_around():
    body = "<p>" + "Real words of the article &amp; more &lt;text&gt;. " * 5
    page = (
        "<html><head><title>Site</title><script>var a='<p>no</p>'</script></head><body><header><h2>Site name</h2></header><nav><a href=x>Home</a></nav>"
        '<div class="cookie-notice">We use cookies on this site</div><article><header><h1>The  title</h1></header>' + body + '<div class="ad-box"><p>Buy now buy now</p></div>' + body
        + '<ul><li>first<li>second <b>bo</b>ld</ul><form><input value=x><button>Send it</button></form><section id="comments"><p>I disagree with everything here</p></section></article>'
        '<aside>Other stories to read</aside><div class=comments><p>Great post by someone</p></div><footer>Imprint <p>and so on</footer></body>'
    )
    text = html.main_text(page, html.Weights())
    words = "Real words of the article & more <text>. " * 5
    assert text == "\n".join(["The title", words.strip(), words.strip(), "first", "second bold"])


def test_broken_pages():
    assert html.main_text(None, NONE) == html.main_text("", NONE) == html.main_text("<p>", NONE) == ""
    assert html.main_text("<article><p>one<p>two three<!-- never closed", NONE) == "one\ntwo three"
    assert html.main_text("<article><p>a < b and 3 > 2 words <a href='x", NONE) == "a < b and 3 > 2 words"
    assert html.main_text("<nav><article><p>open menu before</p></article>", NONE) == "open menu before"
    assert html.main_text("plain text without tags", NONE) == "plain text without tags"
    assert html.main_text("<p>x<script>while(1)", NONE) == "x"
    assert len(html.main_text("<div>" * 20000 + "deep text" + '<a "' * 20000, NONE)) >= 9


def test_deep_nesting_takes_linear_time():
    began = time.perf_counter()
    assert html.main_text("<div><b>" * 25_000 + "deep text" + "</b></div>" * 25_000, NONE) == "deep text"
    assert html.main_text("<nav>" + "<div>" * 50_000 + "menu" + "</nav><p>words after it", NONE) == "words after it"
    assert time.perf_counter() - began < 5


def test_classes_are_weighed_together():
    body = "<p>" + "words of the article " * 9 + "</p>"
    own = "words of the article " * 8 + "words of the article"
    for name in ("share-price-report", "comment-piece", "related-work", "contentWithSidebar", "story", "main"):
        assert html.main_text(f"<div class='{name}'>{body}</div>", NONE) == own, name
    for name in ("comments", "comment-list", "reader-comments", "adBox", "cookie_notice", "related-posts", "share-buttons"):
        assert html.main_text(f"<div>{body}</div><div class='{name}'><p>one two three four</p></div><div>{body}</div>", NONE) == f"{own}\n{own}", name


def test_class_words_are_learned(spark):
    page = "<body><article class='story'><p>" + "good words here " * 20 + "</p></article><div class='teaser'>" + "other stuff to read " * 5 + "</div></body>"
    pages = spark.createDataFrame([(n, page + f"<!--{n}-->") for n in range(30)], "page_id long, html string")
    weights = html.fit(pages)
    assert weights.classes["teaser"] < 0 < weights.classes["story"]
    plain = "<div class='story'><p>" + "good words here " * 20 + "</p><div class='teaser'>Read this too</div><p>" + "good words here " * 20 + "</p></div>"
    assert "teaser" not in {c for c in weights.classes if weights.classes[c] > 0} and "Read" not in html.main_text(plain, weights) and "Read" in html.main_text(plain, NONE)


def test_names_that_html_lacks_are_one_feature(spark):
    pages = spark.createDataFrame([(n, f"<article><x{n}y>text {n}</x{n}y><p class=c{n}>more</p></article>") for n in range(200)], "page_id long, html string")
    weights = html.fit(pages)
    assert set(weights.features) == {"<article>", "</article>", "<?>", "</?>", "<p>", "</p>", "w:?", "w:p"} and set(weights.classes) == {"c"}


def test_counts_equal_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet")
    weights = html.fit(rows)
    kept = {}
    for r in rows.collect():
        h = hashlib.md5(r["html"].encode()).hexdigest()
        if h < kept.get(h[:3], ("~",))[0]:
            kept[h[:3]] = h, r["html"]
    inside, outside = Counter(), Counter()
    for _, page in kept.values():
        article = re.search("<article>(.*?)(?=</article>|$)", page, re.S)
        inside["w:p"] += sum(len(x.split()) for x in re.findall("<p>([^<]*)", article[1]))
        inside["<p>"] += article[1].count("<p>")
        outside["!class"] += sum(len(x.split()) for x in re.findall('<div class="ad">([^<]*)', page))
    _, counts = html.count_features([page for _, page in kept.values()])
    assert counts["<p>"][:2] == [inside["<p>"], 0] and counts["!class"][:2] == [0, outside["!class"]] == counts[".ad"][:2]
    assert counts["w:p"][0] >= inside["w:p"] and weights.classes["ad"] < 0


def test_regions_without_article_elements(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet")
    weights = html.fit(rows)
    for r in rows.collect():
        assert html.main_text(r["html"].replace("<article>", "<div>").replace("</article>", "</div>"), weights) == html.main_text(r["html"], weights)


def test_region_equals_brute_force():
    import random

    rnd = random.Random(1)
    for _ in range(200):
        scores = [rnd.randint(-3, 3) for _ in range(rnd.randint(0, 12))]
        start, end = html.best_region(scores)
        best = max([0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
        assert sum(scores[start:end]) == best


def test_odd_and_empty(spark):
    rows = [(1, "u", "<article><p>hello there</p></article>"), (1, "u", "<article><p>hello there</p></article>"), (None, None, None), (2, "u", ""), (3, None, "<p>" + "word " * 100000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(2))
    got = html.extract(pages, html.fit(pages), keep=("url",)).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (1, 11), (1, 11), (2, 0), (3, 499999)]
    assert html.extract(pages, NONE, keep=("n_chars", "text")).columns == ["page_id", "n_chars_kept", "text_kept", "text", "n_chars"]
    none = pages.limit(0)
    assert html.extract(none, html.fit(none)).collect() == []
    assert no_docs(spark).count() == 0
