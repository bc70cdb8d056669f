"""Scoring retrievers: per-question results, scorecards, latencies, leaderboards."""

from __future__ import annotations

import itertools
import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.ranks import global_rank
from ..plans.stable import spread, stable

SATURATED = 0.25


#: Questions held against the corpus in one pass, and characters of a question that are looked up before the rest is compared.
BLOCK, PIECE = 50_000, 24


def gold_by_containment(bank: DataFrame, pages: DataFrame) -> DataFrame:
    """qid, question, gold: sorted slugs of pages that hold the question's text word for word; questions without any are unanswerable.

    The questions are the stated query set, taken in blocks of BLOCK. Of each question the piece of PIECE
    characters that the fewest share (first, middle or last) goes into an Aho-Corasick automaton; a page is walked once
    for all of them, and where a piece is found the whole question is compared. Only pages with a question leave their task. An empty question is in every page.
    """
    rows = sorted({(r["qid"], r["question"]) for r in bank.select("qid", "question").collect() if r["question"] is not None}, key=str)
    kind = to_arrow_type(bank.schema["qid"].dataType)
    head = f"qid {bank.schema['qid'].dataType.simpleString()}, slug string"
    found = [bank.sparkSession.createDataFrame([], head)]
    for first in range(0, len(rows), BLOCK):
        own = rows[first : first + BLOCK]
        starts = [sorted({0, max(0, (len(t) - PIECE) // 2), max(0, len(t) - PIECE)}) for _, t in own]
        shared_by = Counter(t[a : a + PIECE] for (_, t), some in zip(own, starts, strict=True) for a in some)
        asked: dict[str, list[tuple]] = {}
        for (qid, t), some in zip(own, starts, strict=True):
            a = min(some, key=lambda a: (shared_by[t[a : a + PIECE]], a))
            asked.setdefault(t[a : a + PIECE], []).append((qid, t, a))
        shared = bank.sparkSession.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for piece, some in shared.value.items():
                if piece:
                    automaton.add_word(piece, some)
            automaton.make_automaton()
            for b in batches:
                hits = []
                for slug, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if body is None:
                        continue
                    named = {q for q, _, _ in shared.value.get("", ())}
                    if len(automaton):
                        for end, some in automaton.iter(body):
                            for q, text, a in some:
                                at = end + 1 - min(PIECE, len(text)) - a
                                if q not in named and at >= 0 and body.startswith(text, at):
                                    named.add(q)
                    hits += [(q, slug) for q in named]
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in hits], kind), pa.array([s for _, s in hits], pa.string())], names=["qid", "slug"])

        found.append(spread(pages.select("slug", "body"), "slug").mapInArrow(run, head))
    gold = reduce(DataFrame.unionByName, found).groupBy("qid").agg(F.sort_array(F.collect_set("slug")).alias("gold"))
    return bank.join(gold, "qid", "left").select("qid", "question", F.coalesce("gold", F.array().cast("array<string>")).alias("gold"))


def results(bank: DataFrame, ranked: DataFrame, k: int = 5) -> DataFrame:
    """qid, answerable, correct: any gold page among the first k, or nothing retrieved where there is no gold."""
    got = ranked.filter(F.col("rank") <= k).groupBy("qid").agg(F.collect_set("slug").alias("got"))
    joined = bank.join(got, "qid", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    answerable = F.size("gold") > 0
    return joined.select("qid", answerable.alias("answerable"), F.when(answerable, F.arrays_overlap("gold", "got")).otherwise(F.size("got") == 0).alias("correct"))


def scorecard(per_question: DataFrame) -> DataFrame:
    """One row: score, hit_at_k, abstention and the numbers behind them; a rate without questions is 0."""
    rate = lambda hit, of: F.coalesce(F.sum(F.when(hit & of, 1).otherwise(0)) / F.nullif(F.sum(F.when(of, 1).otherwise(0)), F.lit(0)), F.lit(0.0))
    every, can = F.lit(True), F.col("answerable")
    return per_question.agg(
        F.round(rate(F.col("correct"), every), 6).alias("score"),
        F.round(rate(F.col("correct"), can), 6).alias("hit_at_k"),
        F.round(rate(F.col("correct"), ~can), 6).alias("abstention"),
        F.count(F.when(can, 1)).alias("n_answerable"),
        F.count(F.when(~can, 1)).alias("n_unanswerable"),
    )


def latency(rows: DataFrame, ms: str = "ms") -> DataFrame:
    """Mean and nearest-rank 95th percentile; zeros without rows."""
    return rows.agg(F.round(F.coalesce(F.avg(ms), F.lit(0.0)), 6).alias("mean_ms"), F.coalesce(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {ms})"), F.lit(0.0)).alias("p95_ms"))


def sample(bank: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """All unanswerable questions and n answerable ones in the order of a seeded hash."""
    can = F.size("gold") > 0
    return bank.filter(~can).unionByName(bank.filter(can).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("qid").cast("string")).cast("binary")), "qid").limit(n))


def counted_notes(notes: DataFrame) -> DataFrame:
    """note, n, label: each note once, with (xN) where it occurred more often."""
    out = notes.groupBy("note").agg(F.count(F.lit(1)).alias("n"))
    return out.select("note", "n", F.when(F.col("n") > 1, F.format_string("%s (x%d)", "note", "n")).otherwise(F.col("note")).alias("label"))


def leaderboard(evals: DataFrame) -> DataFrame:
    """Rank evaluations by score, then speed; the first of equal fingerprints counts. evals(eval_idx, fingerprint, score, mean_ms)."""
    once = Window.partitionBy("fingerprint").orderBy("eval_idx")
    first = evals.withColumn("nth", F.row_number().over(once)).filter("nth = 1").drop("nth")
    return global_rank(first, [F.desc("score"), F.col("mean_ms"), F.col("eval_idx")])


def best(evals: DataFrame) -> DataFrame:
    """The evaluation with the highest score; of equal ones the first."""
    return evals.agg(F.max_by(F.struct("eval_idx", "fingerprint", "score"), F.struct("score", -F.col("eval_idx"))).alias("b")).select("b.*")


def saturated(k, n_pages):
    """Whether a top-k over so few pages says little; numbers or columns."""
    if isinstance(n_pages, Column):
        return (n_pages > 0) & (k / n_pages > SATURATED)
    return n_pages > 0 and k / n_pages > SATURATED


def harvest_unanswerable(log_lines: DataFrame, limit: int = 20) -> DataFrame:
    """question, first_no: distinct log lines that end in a question mark, bullets stripped, in order; `limit` at most."""
    text = F.regexp_replace(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), r"^[#\-* ]+", "")
    asked = log_lines.select("no", F.regexp_replace(text, r"(?U)^\s+|\s+$", "").alias("question")).filter(F.endswith("question", F.lit("?")))
    return asked.groupBy("question").agg(F.min("no").alias("first_no")).orderBy("first_no").limit(limit)


def generated_bank(pages: DataFrame, generator: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """One question per page, whose gold is the page; by default a question for its title."""
    made = (generator or (lambda title, body: F.concat(F.lit("What is known about "), title, F.lit("?"))))(F.col("title"), F.col("body"))
    return pages.select("slug", made.alias("question"), F.array("slug").alias("gold"))


def retained(commits: DataFrame) -> DataFrame:
    """prefix, n: commits by the prefix of their subject."""
    return commits.groupBy(F.regexp_extract("subject", r"^(\w+):", 1).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def rewritten_within(commits: DataFrame, hours: int = 24) -> DataFrame:
    """path, n, rewritten: revisions of a page and how many were followed by another one within so many hours."""
    w = Window.partitionBy("path").orderBy("date", "sha")
    soon = F.lead("date").over(w) - F.col("date") <= F.make_dt_interval(hours=F.lit(hours))
    return commits.withColumn("soon", F.coalesce(soon, F.lit(False))).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("soon").cast("long")).alias("rewritten"))


def adoption(actions: DataFrame) -> DataFrame:
    """One row: tasks, target, adopted, satisfied, tokens_a_task, stale.

    actions(task, kind, tokens), kind one of ask, search, answer, retry, stale and others. Target is the share of tasks that ask
    something, adopted that of asking tasks which search, satisfied that of searching tasks which never retry;
    stale counts tasks that met a stale page. A share without tasks is 0.
    """
    has = lambda kind: F.max((F.col("kind") == kind).cast("int")) == 1
    tasks = actions.groupBy("task").agg(has("ask").alias("asks"), has("search").alias("searches"), has("retry").alias("retries"), has("stale").alias("stale"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    n = lambda c: F.count(F.when(c, 1))
    share = lambda part, of: F.round(F.coalesce(n(part) / F.nullif(n(of), F.lit(0)), F.lit(0.0)), 6)
    every, asks, searches = F.lit(True), F.col("asks"), F.col("asks") & F.col("searches")
    return tasks.agg(n(every).alias("tasks"), share(asks, every).alias("target"), share(searches, asks).alias("adopted"), share(searches & ~F.col("retries"), searches).alias("satisfied"), F.round(F.coalesce(F.avg("tokens"), F.lit(0.0)), 6).alias("tokens_a_task"), n(F.col("stale")).alias("stale"))


def grid(strategies: list[str], ks: list[int]) -> list[tuple[str, int]]:
    """Configurations in the order in which a search tries them."""
    return list(itertools.product(strategies, ks))


def optimise(bank: DataFrame, run: Callable[[str, int], DataFrame], strategies: list[str], ks: list[int], sampled: DataFrame | None = None) -> DataFrame:
    """Score every configuration: eval_idx, fingerprint, score, hit_at_k, abstention, mean_ms, full_score, ranked.

    Configurations are tried on `sampled` (a sample of the bank; without one, the bank). mean_ms is the time a
    configuration took, a question. The winner is scored again on the full bank, which is full_score; the others have none there.
    """
    asked = stable(sampled if sampled is not None else bank)
    questions = max(1, asked.count())
    rows = []
    for n, (strategy, k) in enumerate(grid(strategies, ks)):
        began = time.perf_counter()
        card = scorecard(results(asked, run(strategy, k), k)).first()
        rows.append((n, f"{strategy}[k={k}]", card["score"], card["hit_at_k"], card["abstention"], round(1000 * (time.perf_counter() - began) / questions, 3), strategy, k))
    spark = bank.sparkSession
    kinds = "eval_idx int, fingerprint string, score double, hit_at_k double, abstention double, mean_ms double"
    winner = best(spark.createDataFrame([r[:6] for r in rows], kinds)).first()["eval_idx"]
    full = rows[winner][2] if sampled is None else scorecard(results(bank, run(rows[winner][6], rows[winner][7]), rows[winner][7])).first()["score"]
    tried = spark.createDataFrame([(*r[:6], full if r[0] == winner else None) for r in rows], f"{kinds}, full_score double")
    return leaderboard(tried)
