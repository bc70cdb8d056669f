"""Exact vector search and embedders."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stable import spread
from .topk import CELLS, Best

#: Query vectors held against the corpus in one pass.
BLOCK = 4096


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def knn(queries: DataFrame, vectors: DataFrame, k: int = 5, threshold: float | None = None, exclude_self: bool = False) -> DataFrame:
    """qid, id, sim, rank: the k most similar vectors of each query by cosine, ties by id.

    queries(qid, embedding) are the stated query set: they are broadcast in blocks of BLOCK, and each task multiplies
    its vectors with a block and keeps the k best a query while slices pass by, so neither its memory nor what is
    shuffled grows with its vectors. vectors(id, embedding); rows whose vector is null, and queries without one, have no
    matches. Vectors of another length than the queries' are an error. The threshold and exclude_self (id = qid) apply before the cut.
    """
    spark = queries.sparkSession
    asked = queries.select("qid", "embedding").filter("embedding is not null").orderBy("qid").collect()
    head = "qid long, id long, sim double"
    parts = []
    for first in range(0, len(asked), BLOCK):
        rows = asked[first : first + BLOCK]
        shared = spark.sparkContext.broadcast((np.array([r["qid"] for r in rows], np.int64), _unit(np.array([r["embedding"] for r in rows], np.float64))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, q = shared.value
            best = Best(k, len(qids))
            for b in batches:
                for a in range(0, b.num_rows, max(1, CELLS // len(qids))):
                    part = b.slice(a, max(1, CELLS // len(qids)))
                    part = part.filter(part.column(1).is_valid())
                    if not part.num_rows:
                        continue
                    own = part.column(0).to_numpy()
                    v = _unit(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1))
                    sims = np.round(q @ v.T, 9)
                    held = sims >= np.maximum(best.least, -np.inf if threshold is None else threshold)[:, None]
                    if exclude_self:
                        held &= qids[:, None] != own
                    if len(own) > k and np.isinf(best.least).any():
                        # no row of this slice below its own k-th can count
                        some = np.where(held, sims, -np.inf)
                        held &= some >= np.partition(some, len(own) - k, axis=1)[:, len(own) - k][:, None]
                    query, at = np.nonzero(held)
                    best.add(query, sims[query, at], own[at])
                    best.prune()
            query, sim, name = best.prune()
            yield pa.RecordBatch.from_arrays([pa.array(qids[query]), pa.array(name.astype(np.int64)), pa.array(sim)], names=["qid", "id", "sim"])

        parts.append(vectors.select("id", "embedding").mapInArrow(run, head))
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], head)
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def pages_of_chunks(matches: DataFrame, k: int) -> DataFrame:
    """matches(qid, slug, kind, sim) rolled up to pages: best chunk a page, source chunks dropped, first k."""
    best = matches.filter("kind = 'page'").groupBy("qid", "slug").agg(F.max("sim").alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "slug")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Words whose places a worker remembers.
REMEMBERED = 500_000
_WORD = re.compile("[a-z0-9]+")
_PLACES: dict[tuple[str, int], int] = {}


def _place(word: str, dims: int) -> int:
    got = _PLACES.get((word, dims))
    if got is None:
        got = int(hashlib.sha1(word.encode()).hexdigest()[:8], 16) % dims
        if len(_PLACES) < REMEMBERED:
            _PLACES[word, dims] = got
    return got


def _counts(text: str | None, dims: int) -> np.ndarray:
    """Words by place. Python makes two characters of a dotted capital I, SQL one."""
    return np.bincount([_place(w, dims) for w in _WORD.findall((text or "").replace("\u0130", "i").lower())], minlength=dims).astype(np.float64)


def bag_model(texts: list[str | None], dims: int = 64) -> list[list[float]]:
    """Hashed word counts with unit length; a text without words is the first unit vector. A model for embed()."""
    out = []
    for t in texts:
        counts = _counts(t, dims)
        if not counts.any():
            counts[0] = 1.0
        out.append((counts / np.sqrt(np.sum(counts * counts))).tolist())
    return out


def bag_of_words(rows: DataFrame, key: str, text: str, dims: int = 64, unit: bool = True) -> DataFrame:
    """key, embedding by bag_model, row by row; a null text has no words. Without unit, the bare counts: all 0 where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            found = bag_model(texts, dims) if unit else [_counts(t, dims) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.float64()))], names=[key, "embedding"])

    return spread(rows.select(key, text), key).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<double>")


def constant_embedding(rows: DataFrame, key: str, dims: int = 64) -> DataFrame:
    return rows.select(key, F.array_repeat(F.lit(1.0).cast("float"), dims).alias("embedding"))


def embed(rows: DataFrame, key: str, text: str, model, cache: DataFrame | None = None, batch: int = 64) -> DataFrame:
    """key, embedding, error, tokens by a model (list of texts -> list of vectors, or of (vector, tokens)).

    Equal texts are embedded once, `batch` of them a call; if a call fails its texts are tried one by one, and a
    failure is a row's error. Texts that cache(text, embedding) holds are not embedded again and cost no tokens; the
    tokens of a text stand on every row that has it. A null text has no embedding and no error.
    """
    distinct = rows.select(F.col(text).alias("__t")).filter("__t is not null").distinct()
    if cache is not None:
        known = cache.select(F.col("text").alias("__t"), F.col("embedding").cast("array<double>").alias("embedding")).dropDuplicates(["__t"])
        distinct = distinct.join(known.select("__t"), "__t", "left_anti")

    def run(frames):
        def said(texts: list[str]) -> list[tuple]:
            got = list(model(texts))
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
            pairs = [x if isinstance(x, tuple) else (x, 0) for x in got]
            return [([float(v) for v in vector], None, int(used)) for vector, used in pairs]

        for f in frames:
            texts, out = list(f["__t"]), []
            for a in range(0, len(texts), batch):
                some = texts[a : a + batch]
                try:
                    out += said(some)
                except Exception:
                    for t in some:
                        try:
                            out += said([t])
                        except Exception as e:  # the error is the row's result
                            out.append((None, f"{type(e).__name__}: {e}", 0))
            yield pd.DataFrame({"__t": texts, "embedding": [o[0] for o in out], "error": [o[1] for o in out], "tokens": [o[2] for o in out]})

    done = distinct.mapInPandas(run, "__t string, embedding array<double>, error string, tokens long")
    if cache is not None:
        done = done.unionByName(known.select("__t", "embedding", F.lit(None).cast("string").alias("error"), F.lit(0).cast("long").alias("tokens")))
    return rows.withColumn("__t", F.col(text)).join(done, "__t", "left").select(key, "embedding", "error", F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens"))


def usage(embedded: DataFrame, text: str = "text") -> DataFrame:
    """calls, tokens: distinct texts that were embedded and the tokens they cost. embedded has the text, embedding and tokens."""
    return embedded.filter("tokens > 0").groupBy(text).agg(F.first("tokens").alias("t")).agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"))


def checked_index(meta: DataFrame, model: str, dims: int) -> None:
    """Refuse to compare vectors of different models or sizes."""
    got = {r["key"]: r["value"] for r in meta.limit(100).collect()}
    for name, want in (("model", model), ("dims", str(dims))):
        if name in got and got[name] != want:
            raise ValueError(f"the index holds {name} {got[name]!r}, not {want!r}")
