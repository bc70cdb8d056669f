"""Bradley-Terry quality scores learned from preference pairs."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_fold, kept, table

#: Labelled rows learned from at most, and pairs drawn from them.
LABELLED = 6_000
PAIRS = 100_000
_UPPER, _LOWER, _DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
_MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-?"])
#: Bytes compressed at once for the repetition feature.
BLOCK = 1 << 16


def features(text: str | None) -> list[float]:
    """Shares and ratios of a whole text; an empty one has zeros but for the first."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = (text or "").split()
    if not words:
        return [1.0] + [0.0] * 23
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, w = len(raw), len(words)
    counts = Counter(words)
    top = counts.most_common(3)
    lengths = np.fromiter(map(len, words), np.int64, w)
    again = sum(map(eq, words, words[1:])) / w
    lines = [x for x in text.split("\n") if x]
    letters = max(1, seen[_UPPER].sum() + seen[_LOWER].sum())
    upper, marks, digits = seen[_UPPER].sum() / letters, seen[_MARKS].sum() / n, seen[_DIGIT].sum() / n
    packed = sum(len(zlib.compress(raw[a : a + BLOCK], 1)) for a in range(0, n, BLOCK)) / n
    unique = len(counts) / w
    mean = float(lengths.mean())
    short = float((lengths <= 3).mean())
    bars, shouts = seen[124] / w, seen[33] / w
    ends, commas = seen[46] / w, seen[44] / w
    return [
        0.0, np.log1p(w) / 10, float(upper), float(upper > 0.3), float(marks), float(marks > 0.05), float(digits), float(np.sqrt(marks)),
        again, float(np.sqrt(again)), float(again > 0.05), top[0][1] / w, sum(c for _, c in top) / w, packed, float(packed < 0.2), unique,
        mean / 10, float(lengths.std()) / 10, short, float(np.sqrt(bars)), float(np.sqrt(shouts)), float(ends), float(commas), len(set(lines)) / max(1, len(lines)),
    ]


def weighed(z: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """z @ weights, summed in one order: a product of matrices rounds a row differently by the rows beside it."""
    out = np.zeros(len(z))
    for column, weight in zip(z.T, weights, strict=True):
        out += column * weight
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    gain: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the cut scores 0.3."""
        raw = weighed((x - self.mean) / self.scale, self.weights)
        return 1 / (1 + np.exp(-np.clip(self.gain * (raw - self.cut) + np.log(0.3 / 0.7), -500, 500)))


def bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 42, ridge: float = 1e-3) -> Model:
    """Learn from pairs of one preferred (label 1) and one other row that P(preferred wins) = sigmoid(difference of scores).

    The logistic loss on feature differences is minimised by Newton steps. The cut between the labels is the
    quantile of the rows' scores that mistakes the fewest of them. Without both labels all rows score alike.
    """
    width = x.shape[1] if x.ndim == 2 else len(features(""))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), -1.0 if len(good) or not len(bad) else 1.0, 4.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(width)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) / pairs + ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(width)
        step = np.linalg.solve(curve, gradient)
        w -= step / max(1.0, float(np.abs(step).max()) / 2)
        if np.abs(step).max() < 1e-6:
            break
    s = weighed(z, w)
    order = np.argsort(s, kind="stable")
    wrong = np.r_[0, np.cumsum(np.where(y[order] == 1, 1, -1))] + len(bad)
    share = int(np.argmin(wrong)) / len(s)
    cut = float(np.quantile(s, share, method="linear")) if 0 < share < 1 else float(s[order[0 if share == 0 else -1]])
    return Model(mean, scale, w, cut, 4 / max(1e-9, float(s[good].mean() - s[bad].mean())) * 2)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED) -> Model:
    """Learn from the `labelled` rows of labels with the least md5 of their id; the others are not looked at.

    That bound holds for the rows joined, for what a broadcast of their ids holds and for the features
    that reach the driver. Null ids and labels other than 0 and 1 teach nothing; of an id with several labels each
    counts. Only repeated ids can join to more than `labelled` rows; then as many are drawn by the md5 of id, label and text, whatever their label.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y")).filter("__id is not null and __y in (0, 1)")
    some = known.orderBy(F.md5(F.col("__id").cast("string").cast("binary")), "__y").limit(labelled)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(some), "__id")
    drawn = F.md5(F.concat_ws(":", F.col("__id").cast("string"), F.col("__y").cast("string"), F.coalesce("__text", F.lit(""))).cast("binary"))
    rows = rows.select("__y", "__text", drawn.alias("__h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), pa.array([features(t.as_py()) for t in b.column(1)], pa.list_(pa.float64())), b.column(2)], names=["y", "x", "h"])

    got = rows.mapInArrow(run, "y int, x array<double>, h string").orderBy("h").limit(labelled).collect()
    return bradley_terry(np.array([r["x"] for r in got]).reshape(len(got), len(features(""))), np.array([r["y"] for r in got]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Score whole texts: one row per row of docs with doc_id, the columns named in keep (NAME_kept if they bear the name of another column of the result) and score (0 to 1).

    Null and empty texts share one score; repeated texts score alike; an empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), *kept(keep, ("doc_id", "score", "__text")), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(b.num_columns - 1)]).reshape(b.num_rows, len(model.mean))
            s = model.score(x) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s)], names=[*b.schema.names[:-1], "score"])

    return slim.mapInArrow(run, T.StructType([*slim.drop("__text").schema.fields, T.StructField("score", T.DoubleType())]))


def op3_bradley_terry(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").filter(id_fold("doc_id", 5) != 0))
    found = score(docs, model)
    return found.select("doc_id", (id_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
