import os
import re
import zlib

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import pytest
from helpers import odd_docs
from tessera.llm.common import id_fold
from tessera.llm.language import labelled_texts
from test_decontaminate import brute
from test_language import brute_predict
from test_packing import placed
from test_secrets import ASSIGN
from test_simhash import groups, slow_print
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Rows before the first and after every stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(P.STAGES):
        path = f"{tmp_path_factory.mktemp('stage')}/{k}"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
        if k < 4:
            assert docs.columns == P.COLUMNS
    return out


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_language_id_predicts_and_rejects(spark, sf, stages):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    samples = labelled_texts(docs.filter(id_fold("doc_id", 4) != 2))
    found = {r["doc_id"]: p for r, p in zip(stages[0], brute_predict([r["text"] for r in stages[0]], samples), strict=True)}
    want = {i: lang for i, (lang, _, bits) in found.items() if bits is not None and bits <= 9}
    assert {r["doc_id"]: r["lang"] for r in stages[1]} == want
    old = {r["doc_id"]: r for r in stages[0]}
    for r in stages[1]:
        assert [r[c] for c in ("text", "source", "n_chars")] == [old[r["doc_id"]][c] for c in ("text", "source", "n_chars")]


def test_language_id_drops_foreign_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*P.COLUMNS)
    english = docs.filter("lang = 'en'").orderBy("doc_id").first()["text"]
    more = [(-1, "\u0436\u0438\u0437\u043d\u044c \u0438 \u043c\u0438\u0440 " * 9, "en", "s", 1), (-2, "qzxv jkqw zzxq vkjx wqzk xjvq " * 9, "en", "s", 1), (-3, english, "zz", "s", 1), (-4, english, None, None, None), (-5, "123 !", "en", "s", 1)]
    got = {r["doc_id"]: r["lang"] for r in P.language_id(spark, docs.unionByName(spark.createDataFrame(more, docs.schema)), sf).collect()}
    assert {k: v for k, v in got.items() if k < 0} == {-3: "en", -4: "en"}


def test_near_dedup_keeps_one_of_each_group(stages):
    prints = {r["doc_id"]: slow_print(r["text"]) for r in stages[1]}
    root = groups(list(prints.values()))
    first = {}
    for i in sorted(prints):
        first.setdefault(root[prints[i]], i)
    assert ids(stages[2]) == sorted(first.values()) and len(stages[2]) < len(stages[1])


def test_decontamination_drops_by_the_rule(spark, sf, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    keep = []
    for r in stages[2]:
        n, hit, _ = brute_fast(r["text"], items)
        if not (hit and 20 * hit >= n):
            keep.append(r["doc_id"])
    assert ids(stages[3]) == sorted(keep) and len(keep) < len(stages[2])


def brute_fast(text, items):
    """brute() for the items that share a word window's first word run with the text only."""
    from test_decontaminate import words

    joined = " " + " ".join(words(text)) + " "
    some = [(i, t) for i, t in items if any(f" {' '.join(w)} " in joined for w in windows(words(t)))]
    return brute(text, some)


def windows(own):
    n = min(13, len(own))
    return [own[i : i + n] for i in range(len(own) - n + 1)] if n else []


def test_secret_scan_redacts(stages):
    before = {r["doc_id"]: r for r in stages[3]}
    changed = 0
    for r in stages[4]:
        old = before[r["doc_id"]]
        base = [m for m in ASSIGN.finditer(old["text"]) if len(m[2]) >= 8] + list(re.finditer("AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", old["text"]))
        for m in base:
            assert m[0] not in r["text"]
        changed += r["text"] != old["text"]
        assert r["n_chars"] == len(r["text"]) if r["text"] != old["text"] else r == old
        assert bool(base) <= (r["text"] != old["text"])
    assert ids(stages[4]) == ids(stages[3])


def test_packing_holds_the_last_texts(spark, sf, stages):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in stages[4]}
    assert {r["doc_id"] for r in stages[5]} == set(texts)
    for r in stages[5]:
        own = np.array([*plain.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0], "<u4")
        assert zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    placed(stages[5], 2048)
    whole = P.run(spark, sf).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, stages[5]))
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    assert not [f for f in os.listdir(folder) if f.startswith("pipeline-")]


def test_odd_and_empty(spark, sf):
    docs = odd_docs(spark)
    got = [len(stage(spark, docs, sf).collect()) for _, stage in P.STAGES[:4]]
    # with letters: 1 twice, 4, 6, 7; groups: (1, 1, 7), 4, 5, 6 and all without words
    assert got == [5, 5, 11, 11]
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), sf).collect() == []
