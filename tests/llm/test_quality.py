import hashlib
import math
import re
import zlib

import numpy as np
from helpers import no_docs, odd_docs

from tessera.llm import quality


def test_held_out_ranking_and_contract(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in quality.op3_bradley_terry(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == 10_000
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in got.items())
    out = [(got[i]["score"], y, got[i]["predicted"]) for i, y in labels.items() if got[i]["held_out"]]
    good, bad = np.array([s for s, y, _ in out if y == 1]), np.array([s for s, y, _ in out if y == 0])
    auc = ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2)
    right = np.mean([p == y for _, y, p in out])
    print("AUC", auc, "right", right)
    assert auc > 0.9 and right > 0.93


def test_gradient_is_that_of_all_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    y = (x @ [1.0, -1.0, 0.2] + rng.normal(size=60) > 0).astype(int)
    model = quality.bradley_terry(x, y, pairs=200_000)
    z = (x - model.mean) / model.scale
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 3)
    gradient = d.T @ (1 / (1 + np.exp(-d @ model.weights)) - 1) / len(d) + 1e-3 * model.weights
    assert np.abs(gradient).max() < 0.01
    assert ((model.score(x) >= 0.3) == (y == 1)).mean() > 0.7


def slow_features(text):
    """features() written out value by value."""
    words = text.split()
    if not words:
        return [1.0] + [0.0] * 23
    n, w = len(text.encode()), len(words)
    letters = max(1, len(re.findall("[A-Za-z]", text)))
    upper = len(re.findall("[A-Z]", text)) / letters
    marks = sum(33 <= ord(c) < 127 and not c.isalnum() and c not in ".,;:'\"()-?" for c in text) / n
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / w
    often = sorted((words.count(x) for x in set(words)), reverse=True)
    raw = text.encode()
    packed = sum(len(zlib.compress(raw[a : a + 65536], 1)) for a in range(0, n, 65536)) / n
    mean = sum(map(len, words)) / w
    lines = [x for x in text.split("\n") if x]
    return [
        0, math.log(w + 1) / 10, upper, upper > 0.3, marks, marks > 0.05, len(re.findall("[0-9]", text)) / n, marks**0.5, again, again**0.5, again > 0.05, often[0] / w, sum(often[:3]) / w, packed, packed < 0.2, len(set(words)) / w,
        mean / 10, (sum((len(x) - mean) ** 2 for x in words) / w) ** 0.5 / 10, sum(len(x) <= 3 for x in words) / w, (text.count("|") / w) ** 0.5, (text.count("!") / w) ** 0.5, text.count(".") / w, text.count(",") / w, len(set(lines)) / max(1, len(lines)),
    ]


def slow_fit(x, y, pairs, seed):
    """Gradient descent on the mean logistic loss of the same pairs, and the cut that mistakes the fewest rows, by trying all."""
    good, bad = [i for i in range(len(y)) if y[i] == 1], [i for i in range(len(y)) if y[i] == 0]
    mean = x.mean(axis=0)
    scale = np.array([c.std() if c.std() > 1e-9 else 1.0 for c in x.T])
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
    w = np.zeros(x.shape[1])
    for _ in range(6000):
        w -= 0.5 * (sum_of((1 / (1 + np.exp(-(z[a] - z[b]) @ w)) - 1)[:, None] * (z[a] - z[b])) / pairs + 1e-3 * w)
    s = z @ w
    wrong = {t: int((s[y == 0] >= t).sum() + (s[y == 1] < t).sum()) for t in [*s, s.max() + 1]}
    return s, min(wrong.values())


def sum_of(rows):
    return rows.sum(axis=0)


def test_query_equals_brute_force(spark):
    """Features one by one; the fit by plain gradient descent on the same rows; the rows of the whole table."""
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for t in list(texts.values())[:150] + ["", " a", "A! |b", "x\n\nx\ny 12"]:
        assert np.allclose(quality.features(t), np.array(slow_features(t), float))
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    drawn = sorted((hashlib.md5(f"{i}:{y}:{texts[i]}".encode()).hexdigest(), i, y) for i, y in labels if i in texts and y in (0, 1))
    x, y = np.array([slow_features(texts[i]) for _, i, _ in drawn], float), np.array([v for *_, v in drawn])
    model = quality.bradley_terry(x, y, pairs=4000)
    raw, fewest = slow_fit(x, y, 4000, 42)
    fast = ((x - model.mean) / model.scale) @ model.weights
    assert np.corrcoef(raw, fast)[0, 1] > 0.999
    assert ((fast >= model.cut) != (y == 1)).sum() <= fewest + 2
    full = quality.bradley_terry(x, y)
    got = {r["doc_id"]: r["score"] for r in quality.op3_bradley_terry(spark, sf).collect()}
    ids = list(texts)
    assert np.allclose([got[i] for i in ids], full.score(np.array([slow_features(texts[i]) for i in ids], float)), atol=1e-6)


def test_score_of_a_row_is_the_same_in_every_batch():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(97, 24))
    model = quality.Model(rng.normal(size=24), rng.uniform(0.1, 2, 24), rng.normal(size=24), 0.1, 4.0)
    whole = model.score(x)
    for size in (1, 2, 3, 4, 7, 16, 33, 96):
        assert np.concatenate([model.score(x[a : a + size]) for a in range(0, len(x), size)]).tolist() == whole.tolist()
        assert len(set(model.score(np.repeat(x[:1], size, 0)))) == 1


def test_draw_does_not_prefer_a_label(spark):
    docs = spark.createDataFrame([(i % 10, f"{'GOOD' if i % 10 < 5 else 'bad bad'} text {i}") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 5)) for i in range(10)], "doc_id long, quality int")
    model = quality.fit(docs, labels, labelled=100)
    got = quality.score(docs, model, keep=("text",)).collect()
    assert all((r["score"] >= 0.3) == r["text"].startswith("GOOD") for r in got)


def test_odd_and_empty(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 0), (None, 1), (6, None), (6, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == 11 and len({r["score"] for r in got if r["doc_id"] in (2, 3, None)}) == 1
    assert quality.score(no_docs(spark), model).collect() == []
    assert quality.score(docs, model, keep=("score", "lang")).columns == ["doc_id", "score_kept", "lang", "score"]
    for part in (labels.filter("quality = 1"), labels.limit(0)):
        assert {r["score"] >= 0.3 for r in quality.score(docs, quality.fit(docs, part)).collect()} == {True}
