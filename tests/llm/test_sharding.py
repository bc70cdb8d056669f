from collections import Counter

from helpers import duck, no_docs, odd_docs, same_rows

from tessera.llm.sharding import OP4_SQL, interleave_shards, op4_interleave


def test_matches_sql(spark, sf):
    same_rows(op4_interleave(spark, sf).toPandas(), duck(OP4_SQL, sf))


def test_law_and_mixture(spark, sf):
    got = interleave_shards(spark.read.parquet(f"{sf}/documents.parquet"), shards=7).toPandas()
    sizes = Counter(got["shard"])
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    for _, own in got.groupby("stratum"):
        per = Counter(own["shard"])
        assert max(per[s] for s in range(7)) - min(per[s] for s in range(7)) <= 2


def test_odd_and_empty(spark):
    got = interleave_shards(odd_docs(spark), shards=4).collect()
    assert len(got) == 11 and sorted(Counter(r["shard"] for r in got).values()) == [2, 3, 3, 3]
    assert {r["size"] for r in got if r["text_crc32"] == 0} == {1}
    assert interleave_shards(no_docs(spark)).collect() == []
