import math
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers import no_docs, odd_docs

from tessera.llm import language


def slow_phrases(text, sample):
    """Greedy parse into longest phrases found in the sample; a symbol that it lacks is a phrase."""
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        count, at = count + 1, at + n
    return count


def test_held_out_accuracy_and_contract(spark):
    sf = "/root/testdata/sf0.01"
    got = language.op2_cross_parsing(spark, sf).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(truth) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) >= 0.99 * len(out)


def brute_predict(texts, samples):
    """predict() from slow_phrases, one text and language at a time."""
    out = []
    for text in texts:
        own = language.normalise(text or "")
        if not own:
            out.append(("und", 0.0, None))
            continue
        rate = {k: slow_phrases(own, s) * math.log2(max(2, len(s))) / len(own) for k, s in sorted(samples.items())}
        best = min(rate, key=rate.get)
        out.append((best, 1 / sum(2 ** (4 * (rate[best] - r)) for r in rate.values()), rate[best]))
    return out


def random_texts(n, most, seed):
    rnd = random.Random(seed)
    kinds = ["abcdefg", "abcdefgxyz", "ab", "cdef", "a", "ab cd ef"]
    texts = []
    for _ in range(n):
        letters = rnd.choice(kinds)
        texts.append("".join(rnd.choice(letters) for _ in range(rnd.randint(1, most))))
    return [*texts, "ab" * most, "abcde " * most, "z" * most, "", None, "123"]


SAMPLES = {k: "".join(random.Random(k).choice(s) for _ in range(300)) for k, s in (("x", "abcd "), ("y", "cdef "), ("z", "ab"))}


@pytest.mark.parametrize("lane", [1, 7, 64, 2048])
def test_phrases_and_predictions_equal_brute_force(lane):
    samples = {k: language.normalise(v) for k, v in SAMPLES.items()}
    model = language.train(samples)
    texts = random_texts(80, 120, 1)
    totals, chars = language.phrase_counts(model, texts, lane)
    for i, t in enumerate(texts):
        own = language.normalise(t or "")
        assert chars[i] == len(own)
        assert totals[i].tolist() == [slow_phrases(own, samples[k]) if own else 0 for k in model.langs]
    got, want = language.predict(model, texts, lane), brute_predict(texts, samples)
    assert got[0] == [x for x, _, _ in want]
    assert np.allclose(got[1], [x for _, x, _ in want])
    assert np.allclose([x or 0 for x in got[2]], [x or 0 for _, _, x in want])


def test_lanes_in_several_groups_agree(monkeypatch):
    samples = {k: language.normalise(v) for k, v in SAMPLES.items()}
    model = language.train(samples)
    texts = random_texts(10, 3000, 2)
    whole = language.phrase_counts(model, texts, 1 << 20)[0]
    monkeypatch.setattr(language, "CELLS", 3 * 50 * 4)  # four lanes at once
    assert (language.phrase_counts(model, texts, 50)[0] == whole).all()


def test_long_texts_of_the_table_parse_as_one():
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text", "lang"]).to_pylist()
    samples = {k: language.normalise(" ".join(r["text"] or "" for r in t if r["lang"] == k))[:5000] for k in ("en", "fr", "de")}
    model = language.train(samples)
    texts = sorted((r["text"] or "" for r in t), key=len)[-5:]
    assert (language.phrase_counts(model, texts, 512)[0] == language.phrase_counts(model, texts, 1 << 22)[0]).all()


def test_many_languages_with_many_letters_stay_small():
    rnd = random.Random(3)
    letters = [chr(0x4E00 + i) for i in range(5000)]
    samples = {f"l{n:03}": "".join(rnd.choice(letters[n * 20 :] if n % 2 else letters) for _ in range(2000)) for n in range(100)}
    model = language.train(samples)
    assert model.table.nbytes < 24 * sum(map(len, samples.values()))  # the dense table had states times symbols
    texts = [samples["l007"][100:400], samples["l042"][5:300]]
    assert language.predict(model, texts)[0] == ["l007", "l042"]
    assert language.phrase_counts(model, texts)[0][0, 42] == slow_phrases(texts[0], samples["l042"])


def test_samples_are_whole_texts(spark):
    rows = [("short words here", "en"), ("mots courts ici", "fr"), ("wort " * 100, "de"), ("x" * 90, "en"), (None, "en"), ("zzz", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = language.fit(docs, sample=50)
    # the long English text does not fit and is passed over; German has no other
    assert dict(zip(model.langs, model.sizes.tolist(), strict=True)) == {"de": 49, "en": 16, "fr": 15}


def test_odd_and_empty(spark):
    docs = odd_docs(spark)
    model = language.fit(docs)
    got = language.identify(docs, model).collect()
    assert len(got) == 11
    assert {r["lang_pred"] for r in got if r["doc_id"] in (2, 3, 5, 8, None)} == {"und"}
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 4, 7)} == {"en"}
    assert language.identify(no_docs(spark), model).collect() == []
    same = language.identify(docs.withColumn("lang_pred", docs["word"]), model, keep=("score", "lang_pred", "n_chars"))
    assert same.columns == ["doc_id", "score_kept", "lang_pred_kept", "n_chars", "lang_pred", "score", "bits"] and same.count() == 11
    nothing = language.fit(no_docs(spark))
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}
