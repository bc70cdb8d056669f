"""Benchmark decontamination by winnowing: joined fingerprints, extended to whole windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, small, stable, table, utf8

GRAM = 5
P = np.uint64(0x9E3779B97F4A7C15)
Q = np.uint64(0xC2B2AE3D27D4EB4F)
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
#: UTF-8 bytes hashed at once, apart from longer single texts.
SLICE = 1 << 18
#: Bits of the filter of the items' fingerprints at most (16 MB); more items make it pass more candidates, which the join then drops.
FILTER_BITS = 1 << 27


class Words:
    """Words of texts that lie one after the other in `data` (lower-cased in ASCII): places, texts and hashes."""

    def __init__(self, data: np.ndarray, cuts: np.ndarray):
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.data, word = data, _WORD[data]
        before, after = np.r_[False, word[:-1]], np.r_[word[1:], False]
        inner = cuts[:-1][cuts[:-1] < len(data)]
        before[inner] = False
        after[cuts[1:][cuts[1:] > 0] - 1] = False
        first = word & ~before
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(word & ~after) + 1
        self.text = np.searchsorted(cuts, self.start, "right") - 1
        self.counts = np.bincount(self.text, minlength=len(cuts) - 1)
        self.first = np.r_[0, np.cumsum(self.counts)]
        if len(self.start):
            place = np.arange(len(data))
            place -= np.maximum.accumulate(np.where(first, place, 0))
            power = np.multiply.accumulate(np.full(int((self.end - self.start).max()) + 1, P))
            value = np.where(word, data.astype(np.uint64) * power[np.minimum(place, len(power) - 1)], np.uint64(0))
            h = np.add.reduceat(value, self.start)
            self.hash = (h ^ (h >> np.uint64(29))) * Q
        else:
            self.hash = np.zeros(0, np.uint64)

    def words(self, a: int, b: int) -> list[bytes]:
        return [self.data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True)]

    def winnow(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Word places and hashes of the chosen k-grams: the rightmost least one of every `window` consecutive words.

        k = min(GRAM, window), so any two equal runs of `window` words choose the same k-gram at the same offset.
        """
        k = min(GRAM, window)
        n, span = len(self.hash) - window + 1, window - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        grams = len(self.hash) - k + 1
        v = np.zeros(grams, np.uint64)
        for j in range(k):
            v = (v ^ self.hash[j : j + grams]) * P
            v ^= v >> np.uint64(31)
        best, at, width = v, np.arange(grams), 1
        while width < span:
            step = min(width, span - width)
            right = best[step:] <= best[:-step]
            best, at = np.where(right, best[step:], best[:-step]), np.where(right, at[step:], at[:-step])
            width += step
        whole = self.text[window - 1 :] == self.text[:n]
        chosen = np.unique(at[:n][whole])
        return chosen, v[chosen]


class Filter:
    """Bits of the fingerprints of all items: none of them fails the test, and few others pass it."""

    def __init__(self, lengths: list[int], bits: int):
        self.lengths, self.shift, self.words = lengths, np.uint64(64 - bits.bit_length() + 1), np.zeros(bits // 64, np.uint64)

    def places(self, prints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and bits of the two marks of each fingerprint."""
        mixed = prints ^ np.uint64(length * int(P) % 2**64)
        at = np.stack([mixed * Q >> self.shift, (mixed ^ mixed >> np.uint64(32)) * P >> self.shift])
        return (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))

    def test(self, prints: np.ndarray, length: int) -> np.ndarray:
        word, bit = self.places(prints, length)
        return (self.words[word] & bit != 0).all(axis=0)


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def candidates(w: Words, known: Filter) -> dict[int, list[tuple[int, int, bytes]]]:
    """By text: (length, first word, digest) of the windows around fingerprints that pass the filter."""
    found: dict[int, list[tuple[int, int, bytes]]] = {}
    for length in known.lengths:
        places, prints = w.winnow(length)
        seen = -1
        for p in places[known.test(prints, length)].tolist() if len(places) else ():
            t = int(w.text[p])
            low = max(int(w.first[t]), p - (length - min(GRAM, length)), seen + 1)
            high = min(int(w.first[t + 1]) - length, p)
            if low > high:
                continue
            texts = w.words(low, high + length)
            found.setdefault(t, []).extend((length, low + i - int(w.first[t]), _digest(texts[i : i + length])) for i in range(high - low + 1))
            seen = high
    return found


def _merged(intervals: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    own, size = [], 0
    for t in texts:
        if own and size + len(t) > SLICE:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t)
    if own:
        yield own


def _words_of(texts: list[bytes]) -> Words:
    return Words(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])])


def _item_prints(items: DataFrame, window: int) -> DataFrame:
    """items(item, text) -> distinct (n, print) of the items' windows, which have n words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own in _slices(b.column(1).to_pylist()):
                w = _words_of(own)
                for n in range(1, window + 1):
                    chosen, prints = w.winnow(n)
                    size = w.counts[w.text[chosen]]
                    prints = np.unique(prints[np.minimum(size, window) == n])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(prints), n, np.int32)), pa.array(prints.view(np.int64))], names=["n", "print"])

    return items.mapInArrow(run, "n int, print long").distinct()


def _filter(prints: DataFrame, bits: int) -> Filter:
    """The filter of counted fingerprints: 32 bits each, `bits` at most. Its words are put together on the executors."""
    counts = {r["n"]: r["rows"] for r in prints.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).collect()}
    empty = Filter(sorted(counts), min(bits, max(1 << 12, 1 << (32 * sum(counts.values())).bit_length())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, own = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            for n in np.unique(lengths):
                word, bit = (x.ravel() for x in empty.places(own[lengths == n], int(n)))
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit.view(np.int64))], names=["word", "bits"])

    marks = prints.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    empty.words[marks.column("word").to_numpy()] = marks.column("bits").to_numpy().view(np.uint64)
    return empty


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """items(item, text) -> (n, h, item): the digest of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = _words_of([text])
                n = min(len(w.start), window)
                for a in range(0, len(w.start) - n + 1 if n else 0, 1 << 14):
                    texts = w.words(a, a + (1 << 14) + n - 1)
                    own = list(dict.fromkeys(_digest(texts[i : i + n]) for i in range(len(texts) - n + 1)))
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(own), pa.int32()), pa.array(own, pa.binary()), pa.array([name] * len(own), pa.string())], names=["n", "h", "item"])

    return items.mapInArrow(run, "n int, h binary, item string")


def _scanned(slim: DataFrame, known: Filter) -> DataFrame:
    """slim(..., __text) -> its other columns, n_words, __key (the text's digest where there are candidates), __found (candidate windows)."""
    shared = slim.sparkSession.sparkContext.broadcast(known)
    kind = pa.list_(pa.struct([("n", pa.int32()), ("pos", pa.int64()), ("h", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, keys, lists = [], [], []
            for own in _slices(b.column(b.num_columns - 1).to_pylist()):
                w = _words_of(own)
                found = candidates(w, shared.value)
                counts += w.counts.tolist()
                keys += [hashlib.blake2b(t, digest_size=16).digest() if n in found else None for n, t in enumerate(own)]
                lists += [[{"n": n, "pos": p, "h": h} for n, p, h in found[t]] if t in found else None for t in range(len(own))]
            new = [pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(lists, kind)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*b.schema.names[:-1], "n_words", "__key", "__found"])

    new = [T.StructField("n_words", T.LongType()), T.StructField("__key", T.BinaryType()), T.StructField("__found", T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("pos", T.LongType()), T.StructField("h", T.BinaryType())])))]
    return slim.mapInArrow(run, T.StructType([*slim.drop("__text").schema.fields, *new]))


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, windows, sets) -> (key, hit, n_hit, sets)."""
    for b in batches:
        hits = [_merged([(p["pos"], p["end"]) for p in own]) for own in b.column(1).to_pylist()]
        counts = [sum(h[1::2]) - sum(h[::2]) for h in hits]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hits, pa.list_(pa.int64())), pa.array(counts, pa.int64()), b.column(2)], names=["__key", "hit", "n_hit", "sets"])


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = (), filter_bits: int = FILTER_BITS) -> DataFrame:
    """Words of each text that lie inside an occurrence of `window` consecutive words of a benchmark item.

    Both sides are winnowed: of every window the least k-gram hash is kept (k = 5), so a shared window
    shares a fingerprint. The fingerprints of the items become a filter of at most filter_bits bits, the only thing
    broadcast at any size of the benchmark. One pass over the documents extends every fingerprint that passes it
    to the windows around it, and these few are joined with the items' windows by length and digest: every shared
    window is found, and no other. Equal texts are joined once. Windows of several items carry the set of
    their items by its digest, so a passage that many items share does not multiply rows. An item of fewer
    words than a window, but not none, is one window of its own length.

    Result: one row per row of docs: doc_id, the columns named in keep (NAME_kept if they bear the name
    of another column of the result), n_words, n_hit, hit (word intervals, flat: start, end, ...), item_ids
    (sorted as text), contaminated (n_hit > 0 and 20 * n_hit >= n_words). Null and empty texts have no words;
    null and wordless items match nothing; items with a null id are left out, repeated items count once; an
    empty table on either side gives no hits. Rows are checkpointed with the columns in keep, so name narrow ones.
    """
    own = ("doc_id", "n_words", "n_hit", "hit", "item_ids", "contaminated", "__key", "__found", "__text")
    slim_items = items.select(F.col(item_col).cast("string").alias("item"), utf8(item_text_col).alias("text")).filter("item is not null")
    known = _filter(stable(_item_prints(slim_items, window)), filter_bits)
    slim = docs.select(F.col(id_col).alias("doc_id"), *kept(keep, own), utf8(text_col).alias("__text"))
    rows = stable(_scanned(slim, known))
    texts = rows.filter("__key is not null").groupBy("__key").agg(F.first("__found").alias("__found"))
    some = stable(texts.select("__key", F.explode("__found").alias("w")).select("__key", "w.*"))
    asked = stable(some.select("n", "h").distinct())
    matched = _item_windows(slim_items, window).join(small(asked), ["n", "h"], "left_semi").distinct()
    sets = matched.groupBy("n", "h").agg(F.sort_array(F.collect_set("item")).alias("items"))
    sets = stable(sets.withColumn("set", F.md5(F.to_json("items").cast("binary"))))
    hits = some.join(small(sets.select("n", "h", "set")), ["n", "h"]).groupBy("__key").agg(F.collect_list(F.struct("pos", (F.col("pos") + F.col("n")).alias("end"))).alias("w"), F.collect_set("set").alias("sets"))
    hits = stable(hits.mapInArrow(_covered, "__key binary, hit array<long>, n_hit long, sets array<string>"))
    members = stable(sets.groupBy("set").agg(F.first("items").alias("items")).select("set", F.explode("items").alias("item")))
    named = hits.select("__key", F.explode("sets").alias("set")).join(small(members), "set").groupBy("__key").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    found = stable(hits.select("__key", "n_hit", "hit").join(named, "__key"))
    blank = [F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<long>").alias("hit"), F.array().cast("array<string>").alias("item_ids")]
    front = [c for c in rows.columns if c not in ("__key", "__found")]
    plain = rows.filter("__key is null").select(*front, *blank)
    held = rows.filter("__key is not null").join(small(found), "__key", "left")
    held = held.select(*front, F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("hit", "array<long>"), ("item_ids", "array<string>"))])
    return plain.unionByName(held).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op6_winnowing(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS uid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE item IS NOT NULL AND len(w) > 0)
), dw AS (
  SELECT uid, n, p, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM (SELECT uid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), hits AS (
  SELECT dw.uid, dw.n, dw.p, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win
), words AS (
  SELECT uid, count(DISTINCT word) AS n_hit FROM (SELECT uid, unnest(range(p, p + n)) AS word FROM hits) GROUP BY uid
), named AS (
  SELECT uid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY uid
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (uid) LEFT JOIN named USING (uid)
"""
