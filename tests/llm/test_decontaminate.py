import re

import pytest
from helpers import duck, no_docs, odd_docs, same_rows
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.decontaminate import OP6_SQL, contamination, op6_winnowing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, items, window=13):
    w, hit, named = words(text), set(), set()
    for item, t in items:
        own = words(t)
        n = min(window, len(own))
        for i in range(len(own) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == own[i : i + n]:
                    hit |= set(range(p, p + n))
                    named.add(str(item))
    return len(w), len(hit), sorted(named)


def test_matches_sql(spark, sf):
    same_rows(op6_winnowing(spark, sf).toPandas(), duck(OP6_SQL, sf))


@pytest.mark.parametrize("filter_bits, rows", [(1 << 27, 200_000), (64, 200_000), (1 << 12, 2)])
def test_short_repeated_and_overlapping_items(spark, monkeypatch, filter_bits, rows):
    """A filter that passes nearly everything and joins that are shuffled give the same rows."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    item = "A b c d e f g h i j k l m n o p q"
    items = [(1, item), (2, "just three words"), (3, "solo"), (4, "... !!"), (5, None), (None, "x y"), (6, "the the the the the the the the the the the the the the the the"), (7, item.upper()), (1, item)]
    docs = [(1, "pre " + item + " post " + item), (2, "b c d e f g h i j k l m"), (3, "b c d e f g h i j k l m n"), (4, "Solo. just three, words solo"), (5, "the " * 40), (6, None), (7, "the " * 12), (8, "a b c d e f g h i j k l é m")]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), filter_bits=filter_bits).collect()
    named = [(i, t) for i, t in items if i is not None]
    for r in got:
        n, hit, ids = brute(dict(docs)[r["doc_id"]], named)
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == (n, hit, ids), r


def test_odd_and_empty(spark):
    items = spark.createDataFrame([(1, "quick brown fox")], "item_id long, text string")
    got = contamination(odd_docs(spark), items).collect()
    assert len(got) == 11 and [r["n_hit"] for r in got if r["doc_id"] == 4] == [9000]
    assert contamination(no_docs(spark), items).collect() == []
    clash = contamination(odd_docs(spark).withColumn("hit", F.lit(1)), items, keep=("hit", "lang"))
    assert clash.columns[:3] == ["doc_id", "hit_kept", "lang"] and clash.filter("hit_kept = 1").count() == 11
    assert {r["n_hit"] for r in contamination(odd_docs(spark), items.limit(0)).collect()} == {0}
