import random
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import xxhash
from helpers import no_docs, odd_docs

from tessera.llm import simhash
from tessera.llm.graph import components


def slow_print(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def groups(fps):
    """Least member of each fingerprint's component, by brute force."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own = sorted(set(fps))
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {f: find(f) for f in own}


def partition(labels):
    out = {}
    for x, label in labels.items():
        out.setdefault(label, set()).add(x)
    return sorted(map(sorted, out.values()))


def clustered(n, seed):
    rnd = random.Random(seed)
    fps = [0]
    for _ in range(n):
        c = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 8)):
            fps.append(c)
            for b in rnd.sample(range(64), rnd.randint(0, 5)):
                c ^= 1 << b
    return fps


def linked(spark, fps, chain):
    signed = [(int(np.uint64(f).view(np.int64)),) for f in set(fps)]
    nodes = spark.createDataFrame(signed, "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(nodes, chain)).collect()}
    return {int(np.int64(f).view(np.uint64)): roots.get(f, f) for (f,) in signed}


def test_query_matches_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: slow_print(t) for i, t in docs.items()}
    root = groups(list(prints.values()))
    first = {}
    for i in sorted(prints):
        first.setdefault(root[prints[i]], i)
    got = simhash.op8_simhash(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == first[root[prints[r["doc_id"]]]]


def test_all_chains_find_all_links(spark):
    fps = clustered(120, 1)
    want = partition(groups(fps))
    for chain in (1, 2, 3):
        assert partition(linked(spark, fps, chain)) == want


def test_hot_keys_keep_all_links(spark, monkeypatch):
    fps = clustered(25, 2)
    rnd = random.Random(3)
    c = rnd.getrandbits(64)
    fps += [c ^ (1 << a) ^ (1 << b) for a in range(20, 50) for b in range(a)]
    want = partition(groups(fps))
    assert partition(linked(spark, fps, 1)) == want
    # workers import the module anew, so the limit is tested on the functions themselves
    monkeypatch.setattr(simhash, "HOT", 40)
    import pyarrow as pa

    u = np.array(sorted(set(fps)), np.uint64)
    edges, hot = [], []
    for i in range(5):
        keys = (u & np.uint64(simhash.MASKS[i])).view(np.int64)
        order = np.argsort(keys, kind="stable")
        table = pa.table({"ring": np.full(len(u), i, np.int32), "key": keys[order], "fp": u.view(np.int64)[order]})
        for b in simhash._link(iter(table.to_batches(max_chunksize=37))):
            for a, z, h, ring in zip(*[x.to_pylist() for x in b.columns], strict=True):
                (hot if h else edges).append((a, ring) if h else (a, z))
    assert hot
    batch = pa.table({"fp": pa.array([x[0] for x in hot], pa.int64()), "ring": pa.array([x[1] for x in hot], pa.int32())})
    by_variant = {}
    for b in simhash._variants(iter(batch.to_batches())):
        for v, f in zip(*[x.to_pylist() for x in b.columns], strict=True):
            if f != by_variant.setdefault(v, f):
                edges.append((f, by_variant[v]))
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert partition({int(x): roots.get(int(np.uint64(x).view(np.int64)), int(np.uint64(x).view(np.int64))) for x in u}) == want


def test_long_chains_of_edges(spark):
    rnd = random.Random(4)
    ids = list(range(300))
    rnd.shuffle(ids)
    edges = list(zip(ids[:200], ids[1:200], strict=False)) + [(ids[200], x) for x in ids[201:]]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for own in (ids[:200], ids[200:]):
        assert {got.get(x, x) for x in own} == {min(own)}


def test_large_components_are_split(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {(r["doc_id"], r["root"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    for shares in (1, 10**6):
        monkeypatch.setattr(simhash, "SHARES", shares)
        assert {(r["doc_id"], r["root"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()} == want


def test_share_of_similar_pairs_that_four_bits_catch(spark):
    """Copies are all caught; of pairs whose five-word shingles agree to 0.8 or more but whose texts differ only some are, as README states."""
    rows = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).slice(0, 3000).to_pylist()
    grams = []
    for r in rows:
        w = r["text"].lower().split()
        grams.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    holders = defaultdict(list)
    for i, g in enumerate(grams):
        for x in sorted(g)[:: max(1, len(g) // 40)]:
            holders[x].append(i)
    for i, g in enumerate(grams):
        for x in g:
            if x in holders and i not in holders[x]:
                holders[x].append(i)
    pairs = {(min(i, j), max(i, j)) for own in holders.values() if len(own) < 100 for i in own for j in own if i != j}
    prints = [simhash.fingerprint(r["text"].encode()) for r in rows]
    found = {True: [], False: []}
    for i, j in pairs:
        if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
            found[rows[i]["text"] == rows[j]["text"]].append((prints[i] ^ prints[j]).bit_count() <= 4)
    share = sum(found[False]) / len(found[False])
    print("differing pairs", len(found[False]), "caught", share)
    assert all(found[True]) and len(found[False]) >= 10 and share <= 0.5


def test_odd_and_empty(spark):
    got = simhash.near_duplicates(odd_docs(spark)).collect()
    assert len(got) == 11
    assert {r["component_id"] for r in got if r["fp"] == 0} == {2}
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 7)} == {1}
    assert simhash.near_duplicates(no_docs(spark)).collect() == []
