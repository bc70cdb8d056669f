"""SimHash near-duplicates with pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, sized, stable, table, utf8
from .graph import components

WIDTHS = (13, 13, 13, 13, 12)
STARTS = tuple(int(x) for x in np.cumsum((0, *WIDTHS[:-1])))
MASKS = tuple(((1 << w) - 1) << s for w, s in zip(WIDTHS, STARTS, strict=True))
MAX_BITS = 4
#: Rows of one key up to which linking compares inside a task; above it the exact linear way takes over.
HOT = 20_000
SMALL = 64
#: Components with this part of the linked fingerprints or more are joined by broadcast, so at most as many rows are.
SHARES = 200


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text; zero if it has no words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        part = h[i : i + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, the columns named in keep, fp (the fingerprint's bits as a signed long).

    Texts are lower-cased in ASCII, cut into words at ASCII white space and into word shingles, repeats
    included; fewer words than a shingle make one shingle of all. Null and empty texts get zero; repeated rows
    each get their row; an empty table gives an empty result. A kept column that bears the name of another
    column of the result is called NAME_kept; other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), *kept(keep, ("doc_id", "fp", "root", "component_id", "first_id", "__text")), utf8(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b.column(b.num_columns - 1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], names=[*b.schema.names[:-1], "fp"])

    return slim.mapInArrow(run, slim.drop("__text").withColumn("fp", F.lit(0).cast("long")).schema)


def spanning(fps: np.ndarray, i: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links whose chain from ring position i keeps its budgets."""
    edges, rest = [], fps
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            f = front.pop()
            ok = _chain(rest ^ f, i)
            if ok.any():
                found = rest[ok]
                edges += [(int(f), int(x)) for x in found]
                front += list(found)
                rest = rest[~ok]
    return edges


def _chain(x: np.ndarray, i: int) -> np.ndarray:
    """Which differences keep the budgets of all chains from ring position i; the last budget is the Hamming limit."""
    mask, ok = 0, np.ones(len(x), bool)
    for j in range(5):
        mask |= MASKS[(i + j) % 5]
        ok[ok] = np.bitwise_count(x[ok] & np.uint64(mask)) <= (j + 1) * MAX_BITS // 5
    return ok


def _find(parent: dict, x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = x = parent[parent[x]]
    return x


def _link_rows(ring: np.ndarray, keys: np.ndarray, fps: np.ndarray) -> list[tuple[int, int, bool]]:
    """Links of complete key groups, sorted by key."""
    out: list[tuple[int, int, bool]] = []
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[cuts, len(keys)])
    small = np.repeat(sizes <= SMALL, sizes)
    for a, n in zip(cuts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        out += [(a_, b_, False) for a_, b_ in spanning(np.unique(fps[a : a + n]), int(ring[a]))]
    k, f, r = keys[small], fps[small], ring[small]
    for shift in range(1, min(SMALL, len(k))):
        same = np.flatnonzero(k[shift:] == k[:-shift])
        if not len(same):
            break
        x = f[same + shift] ^ f[same]
        hit = np.zeros(len(same), bool)
        near = np.bitwise_count(x) <= MAX_BITS
        for i in range(5):
            mine = np.flatnonzero(near & (r[same] == i))
            hit[mine] = _chain(x[mine], i)
        out += [(int(f[s]), int(f[s + shift]), False) for s in same[hit]]
    parent: dict[int, int] = {}
    kept = []
    for a, b, hot in out:
        if (ra := _find(parent, a)) != (rb := _find(parent, b)):
            parent[ra] = rb
            kept.append((a, b, hot))
    return kept


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (ring, key) -> edges; a key beyond HOT rows gives its rows back, marked hot."""

    def rows(edges: list[tuple[int, int, bool]], ring: int = 0) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_signed([e[0] for e in edges]), _signed([e[1] for e in edges]), pa.array([e[2] for e in edges], pa.bool_()), pa.array([ring] * len(edges), pa.int32())], names=["a", "b", "hot", "ring"])

    held = None
    hot_key = None
    for b in batches:
        if not b.num_rows:
            continue
        new = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)]
        if hot_key is not None:
            same = (new[0] == hot_key[0]) & (new[1] == hot_key[1])
            if same.any():
                yield rows([(int(x), int(x), True) for x in new[2][same]], hot_key[0])
                new = [x[~same] for x in new]
            if len(new[0]):
                hot_key = None
            else:
                continue
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        last = int(np.flatnonzero((held[0] == held[0][-1]) & (held[1] == held[1][-1]))[0])
        if last:
            yield rows(_link_rows(*[x[:last] for x in held]))
            held = [x[last:] for x in held]
        if len(held[0]) > HOT:
            hot_key = (int(held[0][0]), int(held[1][0]))
            yield rows([(int(x), int(x), True) for x in held[2]], hot_key[0])
            held = None
    if held is not None:
        yield rows(_link_rows(*held))


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every fingerprint with at most two bits changed outside the segment that its key holds."""
    for b in batches:
        fps, rings = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
        for i in range(5):
            mine = fps[rings == i]
            bits = [1 << x for x in range(64) if not MASKS[i] >> x & 1]
            flips = np.array([0, *bits, *(x | y for x, y in combinations(bits, 2))], np.uint64)
            for a in range(0, len(mine), 64):
                part = mine[a : a + 64]
                yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64))], names=["v", "fp"])


def links(distinct: DataFrame, chain: int | None = None) -> DataFrame:
    """distinct(fp) -> edges(a, b) whose components are those of all pairs at most MAX_BITS apart.

    Candidates share the key of a chain (chain_keys); pairs are tested chain by chain before the full
    distance, and a key gives a spanning forest, never its pairs. `chain` segments make the key: by
    default as many as keep chance meetings few, 1 below 2^22 fingerprints, 2 below 2^34, else 3; the
    components are the same for each. A key with more than HOT rows is linked without comparing: two
    fingerprints at most 4 apart share a variant with at most two bits changed in each, and all that
    share one are linked to the least of them.
    """
    if chain is None:
        n = distinct.count()
        chain = 1 if n < 2**22 else 2 if n < 2**34 else 3

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                fps = b.column(0)[a : a + 2048].to_numpy().view(np.uint64)
                for i in range(5):
                    keys, at = ring_keys(fps, i, chain)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i, np.int32)), pa.array(keys.view(np.int64)), pa.array(fps[at].view(np.int64))], names=["ring", "key", "fp"])

    keyed = distinct.select("fp").mapInArrow(spread, "ring int, key long, fp long")
    found = stable(keyed.repartition("ring", "key").sortWithinPartitions("ring", "key").mapInArrow(_link, "a long, b long, hot boolean, ring int"))
    hot = found.filter("hot").select(F.col("a").alias("fp"), "ring")
    edges = found.filter("not hot").select("a", "b")
    if hot.limit(1).count():
        spread_hot = hot.mapInArrow(_variants, "v long, fp long")
        least = spread_hot.groupBy("v").agg(F.min("fp").alias("m"), F.max("fp").alias("top")).filter("m < top").select("v", "m")
        edges = edges.unionByName(spread_hot.join(least, "v").filter("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b")).distinct())
    return edges


def ring_keys(fps: np.ndarray, i: int, chain: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and row numbers at ring position i: the bits of the first `chain` segments, and every variant that the budgets allow.

    Differences of at most MAX_BITS over five segments leave a position from which the first l segments
    differ in l * MAX_BITS // 5 bits at most, for every l: none in the first, one in two, two in three.
    One of two linked fingerprints therefore has the other's own chain among its variants.
    """
    ring = [(i + j) % 5 for j in range(chain)]
    pool = [(j, 1 << (STARTS[s] + b)) for j, s in enumerate(ring) if j for b in range(WIDTHS[s])]
    budget = chain * MAX_BITS // 5
    flips = [some for n in range(budget + 1) for some in combinations(pool, n)]
    flips = [sum(v for _, v in some) for some in flips if all(sum(j < l for j, _ in some) <= l * MAX_BITS // 5 for l in range(1, chain))]
    own = fps & np.uint64(sum(MASKS[s] for s in ring))
    return np.concatenate([own ^ np.uint64(f) for f in flips]), np.tile(np.arange(len(fps)), len(flips))


def near_duplicates(docs: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Fingerprint whole texts and group them by links of at most four differing bits.

    Result: one row per row of docs: doc_id, the columns named in keep, fp, root (the least fingerprint
    of the component) and component_id (the least non-null doc_id of the component; null if it has
    none). Copies share a fingerprint, which is linked once however many carry it. Null and empty texts
    have fingerprint zero and are linked like any other; repeated rows each get their row; an empty
    table gives an empty result. Columns of docs that are not named are not read.

    At four bits the links are those of nearly identical texts: README states the share of similar pairs they catch.
    """
    fps = stable(fingerprints(docs, shingle, seed, id_col, text_col, keep))
    nodes = stable(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(nodes))
    groups = stable(roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct()))
    least = stable(groups.join(nodes, "fp").groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    # no more than SHARES components hold a SHARES-th of the linked fingerprints each; these are not dealt by their root
    share = groups.count() / SHARES
    big = F.broadcast(least.filter(F.col("n") >= share).drop("n"))
    rest = groups.join(big, "root", "left_anti").join(least.filter(F.col("n") < share).drop("n"), "root")
    named = groups.join(big, "root").unionByName(rest)
    member = nodes.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"))
    return sized(fps.join(member, "fp"), fps.count())


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
