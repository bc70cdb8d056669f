"""Best-fit packing planned over the histogram of lengths."""

from __future__ import annotations

import gc
import json
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bucket_count, distributed_rank, sized, stable, table

#: Words whose ids a worker remembers; beyond it, new words are looked up again in each batch.
REMEMBERED = 500_000
#: Code points of texts looked up together; a longer text is taken alone.
TOGETHER = 4_000_000
_ODD = regex.compile("[\x1c-\x1f]")
#: Marks that never join the letter or digit before them in a token.
_MARKS = ".,!?;:%$&*#|"
# The normaliser and splitter of a tokenizer for which a text's ids are its words' ids.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _by_words(config: dict) -> bool:
    """Whether a tokenizer composes, drops white space, lower-cases, splits by _SPLIT and marks the end of words."""
    split = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    model, added = config["model"], config.get("added_tokens") or []
    return (
        (config.get("normalizer") or {}).get("normalizers") == _NORMALIZER
        and [x.get("type") for x in split] == ["Split", "ByteLevel"]
        and (split[0].get("pattern"), split[0].get("behavior"), split[0].get("invert")) == ({"Regex": _SPLIT}, "Removed", True)
        and not (split[1].get("add_prefix_space") or split[1].get("use_regex"))
        and (model["type"], model.get("end_of_word_suffix"), model.get("dropout")) == ("BPE", "</w>", None)
        and all(t["special"] and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) and not any(c.isspace() for c in t["content"]) for t in added)
        and not (config.get("truncation") or config.get("padding"))
    )


class WordIds:
    """Ids of whole texts.

    A tokenizer that drops white space and merges inside words only (_by_words) gives a text the ids of its
    words, so words are looked up; with any other one, texts are encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = _by_words(json.loads(self.tokenizer.to_str()))
        self.known: dict[str, bytes] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.single_word or t.lstrip or t.rstrip)]
        self.mark, self.between = plain[0] if plain else (None, None)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word. Many are encoded at once with a special token, which parts the text before all else, between them."""
        out = {}
        # letters alone are one unit of merging, whose last id alone ends a word: white space between them is enough
        letters = [w for w in words if w.isalpha()]
        for a in range(0, len(letters), 1000):
            own = letters[a : a + 1000]
            ids = self._encode(" ".join(own))
            cuts = [0, *(np.flatnonzero(self.last[ids]) * 4 + 4).tolist()]
            if len(cuts) == len(own) + 1 and cuts[-1] == 4 * len(ids):
                raw = ids.tobytes()
                out |= {w: raw[x:y] for w, x, y in zip(own, cuts[:-1], cuts[1:], strict=True)}
        words = [w for w in words if w not in out]
        if self.mark is None:
            return out | {w: self._encode(w).tobytes() for w in words}
        for w in [w for w in words if self.between in w]:
            out[w] = self._encode(w).tobytes()
        words = [w for w in words if w not in out]
        for a in range(0, len(words), 1000):
            own = words[a : a + 1000]
            ids = self._encode(self.between.join(own))
            cuts = [-1, *np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            raw = ids.tobytes()
            out |= {w: raw[4 * x + 4 : 4 * y] for w, x, y in zip(own, cuts[:-1], cuts[1:], strict=True)}
        return out

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with id 0 at the end."""
        own, size = [], 0
        for t in texts:
            own.append(t)
            size += len(t)
            if size >= TOGETHER:
                yield from self._some(own)
                own, size = [], 0
        yield from self._some(own)

    def _some(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return [self._encode(t).tobytes() + bytes(4) for t in texts]
        # Python splits at four control characters that are no white space to the tokenizer
        words = [None if _ODD.search(t) else t.split() for t in texts]
        known = self.known
        new = set().union(*filter(None, words)).difference(known)
        known |= self._fresh(new)
        out = [(self._encode(t).tobytes() if own is None else b"".join(map(known.__getitem__, own))) + bytes(4) for t, own in zip(texts, words, strict=True)]
        if len(known) > REMEMBERED:
            for w in new:
                known.pop(w, None)
        return out

    def _fresh(self, new: set[str]) -> dict[str, bytes]:
        """Ids of words that are not remembered: those of the lower-cased stem and of the marks at its end, if it has such parts."""
        known, fresh, later, need = self.known, {}, [], set()
        for w in new:
            low, tail = self._parts(w)
            ids, end = known.get(low), known.get(tail) if tail else b""
            if ids is None or end is None:
                later.append(w)
                need.add(low)
                need.add(tail)
            else:
                fresh[w] = ids + end
        made = self._words(sorted(x for x in need if x and x not in known))
        made[""] = b""
        for w in later:
            low, tail = self._parts(w)
            fresh[w] = (made[low] if low in made else known[low]) + (made[tail] if tail in made else known[tail])
        del made[""]
        # stems are remembered too while there is room
        return made | fresh if len(known) < REMEMBERED else fresh

    def _parts(self, word: str) -> tuple[str, str]:
        """Stem in lower case, and the marks at the end; a word that does not part so is its own stem."""
        stem = word if word.isalpha() else word.rstrip(_MARKS)
        # below U+0180 no character composes with the one before it; a lower case of another length (U+0130) holds a mark that may join what follows
        if not stem or not stem[-1].isalnum() or not (stem.isascii() or max(stem) < "\u0180"):
            return word, ""
        low = stem.lower()
        if len(low) != len(stem) or "<" in low and any(t in low for t in self.special):
            return word, ""
        return low, word[len(stem) :]


_LOADED: dict[str, WordIds] = {}


def _ids(path: str) -> WordIds:
    if path not in _LOADED:
        gc.set_threshold(200_000)  # the cache holds no cycles, but the collector would walk it again and again
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenized documents cut into pieces of `size` ids at most: doc_id, piece, start, length, ids_crc32.

    A null or empty text is the one id 0; repeated rows each have their pieces; an empty table gives none.
    Only the id and the text of docs are read, so other columns may have any name.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ids(tokenizer)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encode(b.column(1).to_pylist())):
                for n, at in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[at : at + 4 * size]
                    row.append(i)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    head = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {head}, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], size: int = 2048) -> dict[int, list[tuple[int, int, int, int]]]:
    """Best-fit decreasing over counts: for each length, runs (first rank, pieces a sequence, first sequence, offset).

    Lengths come in falling order; pieces of one length go into the open sequences with the least room that
    still takes one, as many as fit, and then into new ones. Sequences with equal fill are held as
    ranges, so the work and the plan grow with the number of lengths, not of documents. Rank q of a run
    takes sequence first + (q - rank) // pieces at offset + (q - rank) % pieces * length.
    """
    rooms: list[int] = []
    open_by_room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    made = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if not open_by_room[room]:
                insort(rooms, room)
            open_by_room[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_by_room[room].pop()
                if not open_by_room[room]:
                    rooms.pop(at)
            else:
                room, first, n = size, made, -(-left // (size // length))
                made += n
            each = room // length
            full = min(n, left // each)
            if full:
                runs[length].append((rank, each, first, size - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:
                runs[length].append((rank, each, first + full, size - room))
                put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(room, first + full, n - full)
    return runs


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole tokenized documents, each followed by id 0, into sequences of at most `size` ids.

    Only documents longer than a sequence are cut, into pieces of `size` ids and a rest. The histogram
    of lengths (at most `size` rows) is planned on the driver by best-fit decreasing; pieces are ranked within their
    length by a seeded hash, without gathering a length, and take the slots planned for their rank.

    Result: one row per piece: doc_id, piece, start, length, ids_crc32 (little-endian unsigned 32-bit
    ids), sequence_id, offset. A null or empty text is the one id 0. Rows that agree in id, piece and
    checksum are interchangeable; repeated rows are all packed; an empty table gives an empty result.
    Columns of docs that are not named are not read.
    """
    cut = stable(pieces(docs, tokenizer, size, id_col, text_col))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = {k: np.array(v, np.int64) for k, v in plan(histogram, size).items()}
    shared = docs.sparkSession.sparkContext.broadcast(runs)
    buckets = bucket_count(docs, sum(histogram.values()))
    hashed = cut.withColumn("__h", F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "piece"))
    hashed = hashed.withColumn("__b", F.shiftright("__h", 32) * F.lit(buckets))
    hashed = hashed.withColumn("__b", F.floor((F.col("__b") + F.lit(buckets * 2**31)) / F.lit(2**32)))
    ranked = distributed_rank(hashed, ["length"], "__b", [F.col("__h"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "rank", "__total")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, ranks = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for n in np.unique(lengths):
                own = lengths == n
                run = shared.value[int(n)]
                at = run[np.searchsorted(run[:, 0], ranks[own], "right") - 1]
                nth = ranks[own] - at[:, 0]
                sequence[own] = at[:, 2] + nth // at[:, 1]
                offset[own] = at[:, 3] + nth % at[:, 1] * n
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    head = cut.schema["doc_id"].dataType.simpleString()
    return sized(ranked, sum(histogram.values())).mapInArrow(place, f"doc_id {head}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_best_fit(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
