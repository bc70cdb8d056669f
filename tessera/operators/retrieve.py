"""Retrievers: (questions(qid, question), corpus) -> ranked(qid, rank, slug, score). No rows for a question means it abstains."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

from ..functions.text import bare, keywords
from ..plans.stable import spread, stable
from .topk import CELLS, Best

K1, B, FLOOR = 1.2, 0.75, 1e-6
_NEWLINE = re.compile("\n")


def top(scored: DataFrame, k: int, *order: Column, by: str = "qid") -> DataFrame:
    """Rank within each question and keep k; the rank limit is pushed below the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Questions held against the corpus in one pass.
BLOCK = 2048


def _blocks(questions: DataFrame) -> tuple[pa.DataType, list[list[tuple]]]:
    """The stated query set: (qid, keywords) in blocks; rows that share a qid are one question."""
    asked: dict = {}
    for r in questions.select("qid", keywords("question").alias("terms")).collect():
        asked.setdefault(r["qid"], set()).update(r["terms"] or ())
    kind = to_arrow_type(questions.schema["qid"].dataType)
    rows = sorted(((q, sorted(t)) for q, t in asked.items() if t), key=lambda x: str(x[0]))
    return kind, [rows[a : a + BLOCK] for a in range(0, len(rows), BLOCK)]


class Asked:
    """A block of questions: its terms and, for each term, the questions that ask for it."""

    def __init__(self, rows: list[tuple]):
        self.qids = [q for q, _ in rows]
        self.terms = sorted({t for _, own in rows for t in own})
        number = {t: n for n, t in enumerate(self.terms)}
        pairs = sorted((number[t], q) for q, (_, own) in enumerate(rows) for t in own)
        self.question = np.array([q for _, q in pairs], np.int64)
        self.first = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(self.terms) + 1))

    def spread(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of some terms, every question that asks for it: (place in term, question)."""
        count = self.first[term + 1] - self.first[term]
        place = np.repeat(np.arange(len(term)), count)
        at = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[term], count)
        return place, self.question[at]


def _rows(best: Best, qids: list, kind: pa.DataType) -> pa.RecordBatch:
    question, score, name = best.prune()
    return pa.RecordBatch.from_arrays([pa.array([qids[q] for q in question.tolist()], kind), pa.array([str(x).replace("\0", "/") for x in name.tolist()], pa.string()), pa.array(score)], names=["qid", "slug", "score"])


_WORD, _PLAIN_WORD = regex.compile(r"[\p{L}\p{N}]+"), re.compile("[a-z0-9]+")


def words_of(text: str | None) -> list[str]:
    """tokens() of a single text: in a worker, where it costs a fraction of the split column and leaves no array to pass on."""
    low = (text or "").lower()
    low = low if low.isascii() else bare(low)
    return _PLAIN_WORD.findall(low) if low.isascii() else _WORD.findall(low)


def term_counts(pages: DataFrame, terms: list[str]) -> DataFrame:
    """slug, dl, term (numbers of the asked terms in the page), tf: a forward index, made in one pass and without a shuffle.

    It may be stored and serve any number of questions that ask for these terms.
    """
    shared = pages.sparkSession.sparkContext.broadcast({t: n for n, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for b in batches:
            lengths, term, tf = [], [], []
            for body in b.column(1):
                words = words_of(body.as_py())
                counts = Counter(words)
                own = sorted((number[w], counts[w]) for w in counts.keys() & number.keys())
                lengths.append(len(words))
                term.append([n for n, _ in own])
                tf.append([c for _, c in own])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int64()), pa.array(term, kind), pa.array(tf, kind)], names=["slug", "dl", "term", "tf"])

    return spread(pages.select("slug", "body"), "slug").mapInArrow(run, "slug string, dl long, term array<int>, tf array<int>")


@dataclass
class Index:
    """Counts of asked words by page, and what BM25 needs to know of all pages; it serves any questions that ask for its words."""

    counts: DataFrame
    terms: list[str]
    idf: np.ndarray
    avgdl: float


def bm25_index(questions: DataFrame, pages: DataFrame) -> Index:
    """Tokenise the pages once and count the words that the questions ask for; the counts are checkpointed."""
    _, blocks = _blocks(questions)
    terms = sorted({t for rows in blocks for _, own in rows for t in own})
    counts = stable(term_counts(pages, terms))
    stats = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    found = dict(counts.select(F.explode("term").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect())
    df = np.array([found.get(n, 0) for n in range(len(terms))], np.float64)
    raw = np.log((stats["n"] - df + 0.5) / (df + 0.5)) if stats["n"] else df
    return Index(counts, terms, np.where(raw > 0, raw, FLOOR), stats["avgdl"] or 1.0)


def bm25(questions: DataFrame, pages: DataFrame, k: int = 5, index: Index | None = None) -> DataFrame:
    """qid, slug, score, rank by BM25 over bodies; pages that share no keyword with a question are not ranked.

    Without an index one is made for these questions; words that a given one lacks are not looked for. Blocks of questions are scored
    inside the tasks, which pass on k pages a question: pairs of pages and questions are never shuffled.
    """
    index = index or bm25_index(questions, pages)
    kind, blocks = _blocks(questions)
    out = [_scored(index, rows, k, kind) for rows in blocks]
    if not out:
        return questions.sparkSession.createDataFrame([], f"qid {questions.schema['qid'].dataType.simpleString()}, slug string, score double, rank int")
    return top(reduce(DataFrame.unionByName, out), k, F.desc("score"), F.col("slug"))


def _scored(index: Index, rows: list[tuple], k: int, kind: pa.DataType) -> DataFrame:
    asked, avgdl = Asked(rows), index.avgdl
    number = {t: n for n, t in enumerate(asked.terms)}
    local = np.array([number.get(t, -1) for t in index.terms], np.int64)
    shared = index.counts.sparkSession.sparkContext.broadcast((asked, local, index.idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own, weight = shared.value
        width = len(block.qids)
        best = Best(k, width)
        for b in batches:
            for a in range(0, b.num_rows, max(1, CELLS // width)):
                part = b.slice(a, max(1, CELLS // width))
                slugs = np.array(part.column(0).to_pylist())
                term, tf = (part.column(c).flatten().to_numpy() for c in (2, 3))
                row = np.repeat(np.arange(part.num_rows), np.diff(part.column(2).offsets.to_numpy()))
                dl = part.column(1).to_numpy()[row]
                value = weight[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
                mine = np.flatnonzero(own[term] >= 0)
                place, question = block.spread(own[term[mine]])
                cell = row[mine][place] * width + question
                score = np.round(np.bincount(cell, value[mine][place], part.num_rows * width), 9)
                hit = np.unique(cell)
                best.add(hit % width, score[hit], slugs[hit // width])
        yield _rows(best, block.qids, kind)

    return index.counts.mapInArrow(run, f"qid {from_arrow_type(kind).simpleString()}, slug string, score double")


def lexical(questions: DataFrame, pages: DataFrame, k: int = 5) -> DataFrame:
    """qid, slug, score, rank by how many of a page's lines hold a keyword of the question, as a substring in any case.

    A line counts once a question. Every page is searched for all keywords of a block of questions in one walk of
    an Aho-Corasick automaton, inside its task, which passes on k pages a question: neither lines nor
    pairs of pages and questions are shuffled.
    """
    kind, blocks = _blocks(questions)
    head = f"qid {questions.schema['qid'].dataType.simpleString()}, slug string, score double"
    lowered = spread(pages.select("slug", F.lower("body").alias("body")), "slug")
    out = []
    for rows in blocks:
        shared = pages.sparkSession.sparkContext.broadcast(Asked(rows))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            width, terms = len(block.qids), len(block.terms)
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for n, t in enumerate(block.terms):
                automaton.add_word(t, n)
            automaton.make_automaton()
            best = Best(k, width)
            for b in batches:
                for slug, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    hits = list(automaton.iter(body or ""))
                    if not hits:
                        continue
                    at, term = np.array(hits, np.int64).T
                    ends = np.array([m.start() for m in _NEWLINE.finditer(body)], np.int64)
                    pair = np.unique(np.searchsorted(ends, at) * terms + term)
                    place, question = block.spread(pair % terms)
                    line = np.unique((pair // terms)[place] * width + question)
                    score = np.bincount(line % width, minlength=width)
                    hit = np.flatnonzero(score)
                    best.add(hit, score[hit].astype(np.float64), np.full(len(hit), slug.replace("/", "\0")))
            yield _rows(best, block.qids, kind)

        out.append(lowered.mapInArrow(run, head))
    if not out:
        return questions.sparkSession.createDataFrame([], head + ", rank int")
    return top(reduce(DataFrame.unionByName, out), k, F.desc("score"), F.split("slug", "/"), F.col("slug"))


def fuse(legs: list[DataFrame], k: int = 5, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion; ties go to the page that was contributed first."""
    if len(legs) < 2:
        raise ValueError("fusion needs two legs or more")
    rows = reduce(DataFrame.unionByName, [leg.select("qid", "slug", "rank", F.lit(n).alias("leg")) for n, leg in enumerate(legs)])
    fused = rows.groupBy("qid", "slug").agg(F.round(F.sum(1 / (rrf_k + F.col("rank"))), 12).alias("score"), F.min(F.struct("leg", "rank")).alias("first"))
    return top(fused, k, F.desc("score"), F.col("first")).drop("first")


Judge = Callable[[DataFrame], DataFrame]


def rerank(source: DataFrame, questions: DataFrame, pages: DataFrame, judge: Judge, k: int = 5, max_candidates: int = 30, max_relevant: int = 5, excerpt: int = 2000) -> DataFrame:
    """Gate: a judge sees the first candidates of each question and names those that are relevant.

    judge takes (qid, question, slug, rank, excerpt) and returns (qid, slugs): an ordered list, or null where it failed.
    Names that were no candidates and repeated ones are dropped and the list is cut at max(k, max_relevant); a failed
    judgement keeps the source's order, cut at max_relevant. An empty list abstains.
    """
    shortlist = source.filter(F.col("rank") <= max_candidates)
    shown = shortlist.join(questions, "qid").join(pages.select("slug", F.substring("body", 1, excerpt).alias("excerpt")), "slug")
    order = shortlist.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "slug"))).alias("c")).select("qid", F.transform("c", lambda x: x["slug"]).alias("candidates"))
    said = judge(shown.select("qid", "question", "slug", "rank", "excerpt"))
    kept = gated(F.col("slugs"), F.col("candidates"), max(k, max_relevant), max_relevant)
    out = order.join(said, "qid", "left").select("qid", F.slice(kept, 1, k).alias("s"))
    return out.select("qid", F.posexplode("s").alias("n", "slug")).select("qid", (F.col("n") + 1).alias("rank"), "slug", F.lit(None).cast("double").alias("score"))


def gated(said: Column, candidates: Column, cap: int, fallback: int) -> Column:
    known = F.filter(F.array_distinct(said), lambda s: F.array_contains(candidates, s))
    return F.when(said.isNull(), F.slice(candidates, 1, fallback)).otherwise(F.slice(known, 1, cap))


def predicate_judge(pages: DataFrame, test: Column) -> Judge:
    """A deterministic judge: pages that pass a test, in the source's order."""

    def judge(shown: DataFrame) -> DataFrame:
        ok = shown.join(pages.filter(test).select("slug"), "slug", "left_semi")
        asked = shown.select("qid").distinct()
        named = ok.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "slug"))).alias("c")).select("qid", F.transform("c", lambda x: x["slug"]).alias("slugs"))
        return asked.join(named, "qid", "left").select("qid", F.coalesce("slugs", F.array().cast("array<string>")).alias("slugs"))

    return judge


def with_preview(ranked: DataFrame, pages: DataFrame, limit: int = 200) -> DataFrame:
    from ..functions.text import preview

    return ranked.join(pages.select("slug", "title", preview("body", limit).alias("preview")), "slug").select("qid", "rank", "slug", "title", "preview")


def diagnostics(questions: DataFrame, ranked: DataFrame, strategy: str, note: str | None = None) -> DataFrame:
    """qid, strategy, results, abstained, note: what a search did for every question, those without a result too."""
    counted = ranked.groupBy("qid").agg(F.count(F.lit(1)).alias("results"))
    n = F.coalesce("results", F.lit(0).cast("long"))
    return questions.select("qid").join(counted, "qid", "left").select("qid", F.lit(strategy).alias("strategy"), n.alias("results"), (n == 0).alias("abstained"), F.lit(note).cast("string").alias("note"))
