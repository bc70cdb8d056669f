"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_fold, kept, table

#: Code points of whole labelled texts that a language's automaton is built from at most.
SAMPLE = 40_000
#: Ranges of the texts' md5 that offer one text each.
RANGES = 256
#: Bits a code point above which a text is in none of the learned languages; letters drawn at random need about 11.
FOREIGN_BITS = 9.0
#: Code points parsed in one lane, and places times languages times lanes held at once; neither changes a result.
LANE = 2_048
CELLS = 1 << 24
_LETTER = regex.compile(r"\p{L}")


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of a text."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def fold(src: np.ndarray, symbol: np.ndarray, dst: np.ndarray, states: int, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse rows of transitions, sorted by state, in one array that grows with the edges and not with states times symbols: (base of each state, slots).

    A state is known by its base; its edge on symbol c lies in slot base + c, which holds base << 32 | next
    base. Bases are unique, so a slot belongs to a state exactly if its upper half is the state's base. Wide
    rows are fitted first, the widest before all; rows of one edge fill the slots between them.
    """
    size = len(src) + len(src) // 3 + 64
    if size + symbols >= 2**31:
        raise ValueError("the automata have more edges than 31 bits can number")
    free, unused = np.ones(size + symbols, bool), np.ones(size, bool)
    base = np.full(states, -1, np.int64)
    counts = np.bincount(src, minlength=states)
    first = np.r_[0, np.cumsum(counts)]
    at = 0

    def grown() -> None:
        nonlocal free, unused, size
        free, unused = np.r_[free, np.ones(size, bool)], np.r_[unused, np.ones(size, bool)]
        size *= 2

    wide = np.flatnonzero(counts != 1)
    for n, i in enumerate(wide[np.argsort(-counts[wide], kind="stable")].tolist()):
        own, tries = symbol[first[i] : first[i + 1]].astype(np.int64), 0
        at = n * 40503 % size
        while not (unused[at] and free[at + own].all()):
            tries += 1
            at = (at + tries) % size
            if tries % 5000 == 0:
                grown()
        free[at + own] = unused[at] = False
        base[i] = at
    single = np.flatnonzero(counts == 1)
    single = single[np.argsort(symbol[first[single]], kind="stable")]
    groups = symbol[first[single]]
    cuts = np.r_[np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, np.int64), len(groups)]
    at = 0
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        need, c, seen = single[a:b], int(groups[a]), 0
        while len(need):
            if seen > size:
                grown()
                seen = 0
            end = min(at + 4 * len(need) + 1024, size)
            found = at + np.flatnonzero(unused[at:end] & free[at + c : end + c])[: len(need)]
            base[need[: len(found)]] = found
            unused[found] = free[found + c] = False
            need, seen = need[len(found) :], seen + end - at
            at = (int(found[-1]) + 1 if not len(need) else end) % size
    table = np.full(size + symbols, -1, np.int64)
    for a in range(0, len(src), 1 << 18):
        own, after = base[src[a : a + (1 << 18)]], base[dst[a : a + (1 << 18)]]
        table[own + symbol[a : a + (1 << 18)]] = own << 32 | after
    return base, table


@dataclass
class Model:
    """Automata of all languages in one array of slots."""

    langs: list[str]
    alphabet: np.ndarray  # sorted code points; symbol 0 is any other one
    table: np.ndarray
    roots: np.ndarray
    sizes: np.ndarray

    @property
    def symbols(self) -> int:
        return len(self.alphabet) + 1

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, 0).astype(np.uint16 if self.symbols < 1 << 16 else np.int32)

    def phrases(self, lanes: list[np.ndarray], follows: np.ndarray, carry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each lane in the greedy parse by each language's text, (lanes, languages), and the last lane's states.

        A phrase is the longest substring of the language's text that begins where the last phrase ended,
        or one symbol that the text lacks. All lanes are parsed at once as if a phrase began at their start. A
        lane that follows another one in its text is then entered with the state the other left, and parsed again up
        to the first place where both parses begin a phrase, from which on they agree. carry is the state before lane 0.
        """
        n, width = len(self.langs), len(lanes)
        lengths = np.array([len(x) for x in lanes])
        order = np.argsort(-lengths, kind="stable")
        longest = int(lengths[order[0]])
        by_place = np.zeros((longest, width), lanes[0].dtype)
        for i, k in enumerate(order):
            by_place[: lengths[k], i] = lanes[k]
        alive = np.searchsorted(-lengths[order], -np.arange(1, longest + 1), "right")
        starts = np.zeros((longest, n, width), bool)
        state = np.repeat(self.roots[:, None], width, 1)
        for place, k in enumerate(alive):
            own, now = by_place[place, :k], state[:, :k]
            step = self.table[now + own]
            ends = step >> 32 != now
            starts[place, :, :k] = ends | (now == self.roots[:, None])
            lang, lane = np.nonzero(ends)
            root = self.roots[lang]
            begin = self.table[root + own[lane]]
            step &= 0xFFFFFFFF
            step[lang, lane] = np.where(begin >> 32 == root, begin & 0xFFFFFFFF, root)
            state[:, :k] = step
        back = np.argsort(order, kind="stable")
        counts, state = starts.sum(axis=0, dtype=np.int64).T[back], state.T[back]
        for i in np.flatnonzero(follows):
            before = carry if i == 0 else state[i - 1]
            for lang in range(n):
                own, again = lanes[i], starts[:, lang, back[i]]
                counts[i, lang] += self._entered(int(before[lang]), lang, own, again, state, i)
        return counts, state[-1]

    def _entered(self, now: int, lang: int, own: np.ndarray, again: np.ndarray, state: np.ndarray, i: int) -> int:
        """By how many phrases a lane entered in state `now` differs; its last state is put right if the parses never agree."""
        root, differ = int(self.roots[lang]), 0
        item = self.table.item
        for place in range(len(own)):
            c = int(own[place])
            step = item(now + c)
            if step >> 32 != now or now == root:
                if again[place]:
                    return differ
                differ += 1
                step = item(root + c)
                now = step & 0xFFFFFFFF if step >> 32 == root else root
            else:
                differ -= int(again[place])
                now = step & 0xFFFFFFFF
        state[i, lang] = now
        return differ


def normalise(text: str) -> str:
    """Lower case; every run of characters that are no letters is one space."""
    return regex.sub(r"\P{L}+", " ", text.lower()).strip()


def train(samples: dict[str, str]) -> Model:
    """samples: labelled text by language, normalised."""
    langs = sorted(samples)
    alphabet = np.array(sorted({ord(c) for s in samples.values() for c in s}) or [32], np.uint32)
    model = Model(langs, alphabet, np.zeros(0, np.int64), np.zeros(len(langs), np.int64), np.array([max(2, len(samples[x])) for x in langs]))
    parts: list[list[np.ndarray]] = [[], [], []]
    states, first = 0, []
    for lang in langs:
        rows = suffix_automaton(model.codes(samples[lang]).tolist())
        widths = np.fromiter(map(len, rows), np.int64, len(rows))
        parts[0].append(np.repeat(np.arange(states, states + len(rows), dtype=np.int32), widths))
        parts[1].append(np.fromiter((c for r in rows for c in r), np.int32, int(widths.sum())))
        parts[2].append(states + np.fromiter((t for r in rows for t in r.values()), np.int32, int(widths.sum())))
        first.append(states)
        states += len(rows)
    src, symbol, dst = [np.concatenate(parts.pop(0) or [np.zeros(0, np.int32)]) for _ in range(3)]
    base, model.table = fold(src, symbol, dst, states, model.symbols)
    model.roots[:] = base[first] if first else 0
    return model


def predict(model: Model, texts: list[str | None], lane: int = LANE) -> tuple[list[str], list[float], list[float | None]]:
    """The language that needs the fewest phrases, each phrase weighing log2 of its training text's length, its share of certainty, and its bits a code point."""
    langs, scores, rates = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
    totals, chars = phrase_counts(model, texts, lane)
    bits = totals * np.log2(model.sizes)
    for i in np.flatnonzero(chars):
        rate = bits[i] / chars[i]
        odds = np.exp2(4 * (rate.min() - rate))
        best = int(np.argmin(rate))
        langs[i], scores[i], rates[i] = model.langs[best], float(odds[best] / odds.sum()), float(rate[best])
    return langs, scores, rates


def phrase_counts(model: Model, texts: list[str | None], lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each text by each language, and the text's normalised code points (0 if it has no letter)."""
    totals, chars = np.zeros((len(texts), len(model.langs)), np.int64), np.zeros(len(texts), np.int64)
    owner: list[int] = []
    lanes: list[np.ndarray] = []
    carry, into = model.roots, -1
    most = max(1, CELLS // (lane * max(1, len(model.langs))))

    def flush() -> None:
        nonlocal carry, into
        own = np.array(owner)
        got, carry = model.phrases(lanes, own == np.r_[into, own[:-1]], carry)
        np.add.at(totals, own, got)
        into = owner[-1]
        owner.clear()
        lanes.clear()

    for i, text in enumerate(texts):
        if not text or not model.langs or not _LETTER.search(text):
            continue
        codes = model.codes(normalise(text))
        chars[i] = len(codes)
        for a in range(0, len(codes), lane):
            owner.append(i)
            lanes.append(codes[a : a + lane])
            if len(lanes) >= most:
                flush()
    if lanes:
        flush()
    return totals, chars


def labelled_texts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict[str, str]:
    """Normalised text by language from labelled rows: for each language and each of RANGES ranges of the texts' md5 the text with the least md5.

    Texts are taken whole, in the order of their md5 read backwards, while they fit into `sample` code points
    a language; one that does not fit is passed over. Only where a language has no text that short, the first `sample` code
    points of one are learned. Hashes and lengths are reduced first, so at most RANGES small rows a language
    and the chosen texts leave the executors, and a language may hold any share of the rows. Rows without a
    label or with an empty text teach nothing.
    """
    slim = docs.select(F.col(lang_col).cast("string").alias("lang"), F.md5(F.col(text_col).cast("binary")).alias("h"), F.col(text_col).alias("text"))
    slim = slim.filter("lang is not null and length(text) > 0")
    offered = slim.groupBy("lang", F.substring("h", 1, 2).alias("range")).agg(F.min(F.struct((F.length("text") > sample).alias("long"), "h", F.length("text").alias("n"))).alias("s")).select("lang", "s.*")
    chosen: dict[str, list[str]] = {}
    room: dict[str, int] = {}
    for r in sorted(offered.collect(), key=lambda r: (r["lang"], r["long"], r["h"][::-1])):
        left = room.setdefault(r["lang"], sample)
        if r["n"] <= left or left == sample:
            chosen.setdefault(r["lang"], []).append(r["h"])
            room[r["lang"]] = max(0, left - r["n"] - 1)
    wanted = docs.sparkSession.createDataFrame([(lang, h) for lang, own in chosen.items() for h in own], "lang string, h string")
    rows = slim.join(F.broadcast(wanted), ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.substring("text", 1, sample)).alias("text")).collect()
    texts = {(r["lang"], r["h"]): normalise(r["text"]) for r in rows}
    samples = {lang: " ".join(texts[lang, h] for h in own)[:sample].strip() for lang, own in chosen.items()}
    return {k: v for k, v in samples.items() if v}


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from labelled_texts of docs."""
    return train(labelled_texts(docs, text_col, lang_col, sample))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Predict the language of whole texts by cross-parsing.

    A text is cut greedily into the longest phrases that occur in a language's labelled text, found by
    walking its suffix automaton; phrases times log2 of that text's length, a code point, estimate the
    cross entropy. The language with the least wins; equal ones go to the first by name. Long texts are parsed in
    lanes, side by side, whose parses are then put together to the one of the whole text, so they need no more memory than short ones.

    Result: one row per row of docs: doc_id, the columns named in keep (NAME_kept if they bear the name
    of another column of the result), lang_pred, score (0 to 1), bits (a code point of the normalised text in that language).
    Null and empty texts and texts without a letter get `und`, 0 and null, as does everything if nothing was learned. Repeated rows each get their row; an empty table gives an empty result.
    """
    # a text that is carried along anyway goes to the workers once
    there = text_col in keep
    slim = docs.select(F.col(id_col).alias("doc_id"), *kept(keep, ("doc_id", "lang_pred", "score", "bits", "__text")), *([] if there else [F.col(text_col).alias("__text")]))
    own = 1 + len(keep)
    at = 1 + keep.index(text_col) if there else own
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                langs, scores, rates = predict(shared.value, part.column(at).to_pylist())
                new = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:own], *new], names=[*part.schema.names[:own], "lang_pred", "score", "bits"])

    schema = T.StructType([*slim.drop("__text").schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())])
    return slim.mapInArrow(run, schema)


def op2_cross_parsing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(id_fold("doc_id", 4) != 2))
    found = identify(docs, model)
    return found.select("doc_id", (id_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
