import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from helpers import no_docs, odd_docs
from tokenizers import Tokenizer

from tessera.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def placed(rows, size):
    full = defaultdict(list)
    for r in rows:
        full[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in full.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(full)


def test_query_holds_all_ids(spark, sf):
    plain = Tokenizer.from_file(PATH)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = packing.op5_best_fit(spark, sf).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == set(docs)
    for i, own in by_doc.items():
        ids = np.array([*plain.encode(docs[i], add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for n, r in enumerate(sorted(own, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (n, at)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
            assert r["length"] == 2048 or at == len(ids)
        assert at == len(ids)
    assert placed(rows, 2048) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1


def test_word_ids_equal_whole_text_ids():
    plain, ids = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    texts = ["It's  a\tTest's x", "a\x1cb\x1d c", "é ́a", "<|endoftext|>x <|startoftext|>", "ΣΑΣ ΌΔΟΣ x\x85y", "İstanbul 12 345%%%", "", " ", "　漢字 かな​z", "a\x00b \x0bc"]
    for t, got in zip(texts, ids(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == [*plain.encode(t, add_special_tokens=False).ids, 0], t


def test_word_ids_equal_whole_text_ids_on_random_texts():
    plain, ids, rnd = Tokenizer.from_file(PATH), packing.WordIds(PATH), random.Random(7)
    marks = list("\u0300\u0301\u0307\u0308\u0323\u0345\u0327\u094d\u200d\ufe0f") + list("\x1c\x85\xa0\u3000 \t\n")
    odd = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "'s", "'RE", "\u1e9e", "\u212a", "\u017f", "\ufb01", "\uac01"]
    alphabet = [chr(c) for c in range(32, 0x180)] + marks + odd + list("abcdeABCDE   ") * 8 + list("\u0130\u0307\u0130'.,!?'sS") * 6
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 25))) for _ in range(20_000)]
    assert ids.by_words
    for t, got in zip(texts, ids(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == [*plain.encode(t, add_special_tokens=False).ids, 0], t


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, ids = Tokenizer.from_file(path), packing.WordIds(path)
    texts = ["  Two  spaces and Caps.", "", "a\n\nb \u0130. <|endoftext|>"]
    assert not ids.by_words
    assert [np.frombuffer(x, "<u4").tolist() for x in ids(texts)] == [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def slow_best_fit(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(size - n)
    return sorted(rooms)


def test_plan_equals_best_fit_document_by_document():
    rnd = random.Random(1)
    for _ in range(60):
        size = rnd.choice([10, 64, 100])
        lengths = [rnd.randint(1, size) for _ in range(rnd.randint(1, 300))]
        runs = packing.plan(Counter(lengths), size)
        used = defaultdict(list)
        for length, n in Counter(lengths).items():
            for q in range(n):
                rank, each, first, offset = [r for r in runs[length] if r[0] <= q][-1]
                used[first + (q - rank) // each].append((offset + (q - rank) % each * length, length))
        rooms = []
        for own in used.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            rooms.append(size - at)
        assert sorted(rooms) == slow_best_fit(lengths, size)


def test_odd_and_empty(spark):
    rows = packing.pack(odd_docs(spark), PATH, size=64).collect()
    assert placed(rows, 64) and Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter([1, 1, None, None, 2, 3, 4, 5, 6, 7, 8])
    assert packing.pack(no_docs(spark), PATH).collect() == []
