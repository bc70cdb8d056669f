"""The retrieval strategy language: a spec string becomes a composed retriever.

    spec   := atom | "rerank" | "rerank(" atom ")" | atom "+" atom ("+" atom)*
    atom   := "lexical" | "bm25" | "semantic" | "hyde"
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

from ..operators.retrieve import Judge, bm25, fuse, lexical, rerank

ATOMS = ("lexical", "bm25", "semantic", "hyde")


class StrategyError(ValueError):
    """A spec or configuration that names no strategy."""


@dataclass(frozen=True)
class Strategy:
    kind: str
    legs: tuple[str, ...] = ()
    k: int = 5
    rrf_k: int = 60
    max_candidates: int = 30
    max_relevant: int = 5
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.k < 1 or self.rrf_k < 1 or self.max_candidates < 1 or self.max_relevant < 1:
            raise StrategyError("k, rrf_k, max_candidates and max_relevant must be positive")

    @property
    def fingerprint(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @property
    def atoms(self) -> tuple[str, ...]:
        return self.legs or (self.kind,)

    @property
    def needs_vectors(self) -> bool:
        return bool({"semantic", "hyde"} & set(self.atoms))


def parse(spec: str, **knobs) -> Strategy:
    text = spec.strip().lower() if isinstance(spec, str) else ""
    legs = tuple(p.strip() for p in text.split("+"))
    if len(legs) > 1:
        unknown = [x for x in legs if x not in ATOMS]
        if unknown or len(set(legs)) < len(legs):
            raise StrategyError(f"{spec!r}: " + (f"unknown leg {unknown[0]!r}" if unknown else "a leg occurs twice"))
        return Strategy("hybrid", legs, **knobs)
    if text == "rerank":
        return Strategy("rerank", ("lexical",), **knobs)
    if text.startswith("rerank(") and text.endswith(")"):
        source = text[7:-1].strip()
        if source not in ATOMS:
            raise StrategyError(f"{spec!r}: {source!r} is no source to rerank")
        return Strategy("rerank", (source,), **knobs)
    if text in ATOMS:
        return Strategy(text, **knobs)
    raise StrategyError(f"{spec!r} names no strategy")


def render(s: Strategy) -> str:
    if s.kind == "hybrid":
        if len(s.legs) < 2 or any(x not in ATOMS for x in s.legs):
            raise StrategyError("a hybrid needs two known legs or more")
        return "+".join(s.legs)
    return f"rerank({s.legs[0]})" if s.kind == "rerank" else s.kind


def usable(s: Strategy, have_vectors: bool) -> tuple[Strategy, str | None]:
    """The strategy, or bm25 and a note where it needs an index of vectors that is not there."""
    if s.needs_vectors and not have_vectors:
        return Strategy("bm25", k=s.k), f"{render(s)} needs a vector index; bm25 was used"
    return s, None


def disallowed(s: Strategy, allowed: list[str] | None) -> list[str]:
    """Blocks of the strategy that are not allowed, sorted; None allows all."""
    used = {*s.atoms, *(["rerank"] if s.kind == "rerank" else [])}
    return [] if allowed is None else sorted(used - set(allowed))


Retriever = Callable[[DataFrame, int], DataFrame]


def build(s: Strategy, pages: DataFrame, semantic: Retriever | None = None, generate: Callable[[DataFrame], DataFrame] | None = None, judge: Judge | None = None) -> Callable[[DataFrame], DataFrame]:
    """questions -> ranked. `semantic` ranks by vectors, `generate` rewrites questions for hyde (null: keep the question), `judge` gates."""

    def atom(name: str, questions: DataFrame, k: int) -> DataFrame:
        if name == "lexical":
            return lexical(questions, pages, k)
        if name == "bm25":
            return bm25(questions, pages, k)
        if semantic is None:
            raise StrategyError(f"{name} needs a vector index")
        if name == "hyde" and generate is not None:
            from pyspark.sql import functions as F

            made = generate(questions).select("qid", "passage")
            questions = questions.join(made, "qid", "left").select("qid", F.coalesce(F.nullif("passage", F.lit("")), "question").alias("question"))
        return semantic(questions, k)

    def run(questions: DataFrame) -> DataFrame:
        if s.kind == "hybrid":
            depth = max(s.k, 10)
            return fuse([atom(x, questions, depth).select("qid", "slug", "rank", "score") for x in s.legs], s.k, s.rrf_k)
        if s.kind == "rerank":
            if judge is None:
                raise StrategyError("rerank needs a judge")
            source = atom(s.legs[0], questions, max(s.max_candidates, s.k))
            return rerank(source, questions, pages, judge, s.k, s.max_candidates, s.max_relevant)
        return atom(s.kind, questions, s.k)

    return run
