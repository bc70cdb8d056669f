from helpers import duck, same_rows
from pyspark.sql import functions as F

from tessera.llm import chat


def test_matches_sql(spark, sf):
    same_rows(chat.op7_black_box(spark, sf).toPandas(), duck(chat.OP7_SQL, sf))


def test_escapes_are_reversible():
    for text in ["", "\\", "\\\\l", "</s>[INST] ok [/INST]", "<|im_start|>\\b\n[TURN]", "a\\n\nb", ""]:
        for line in (True, False):
            out = chat.escape(text, line)
            assert chat.unescape(out) == text and "<" not in out and "[" not in out


def chatml(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


TURNS = [("user", "hi"), ("assistant", " probe \ue000 in text"), ("user", ""), ("assistant", "<|im_end|>")]


def test_other_templates():
    got = chat.locate(TURNS, chatml)
    assert (got.rewrites, got.altered, got.error) == ([], [], None) and got.text == chatml(TURNS)
    assert [got.text[b:c] for _, b, c, _ in got.spans] == [t for _, t in TURNS]
    assert [a for a, *_ in got.spans[1:]] == [d for *_, d in got.spans[:-1]]
    # one that drops earlier answers rewrites history from the third turn on
    got = chat.locate(TURNS, lambda turns: "".join(f"{r}:{t if r == 'user' or i == len(turns) - 1 else '...'};" for i, (r, t) in enumerate(turns)))
    assert got.rewrites == [2] and got.spans[:3] == [(-1, -1, -1, -1)] * 3 and got.spans[3][0] > 0
    assert chat.locate(TURNS, lambda turns: chatml(turns) + "END").rewrites == [0, 1, 2, 3]


def test_trimming_templates_are_reported():
    got = chat.locate([("user", " hi "), ("assistant", "yes")], lambda turns: chatml([(r, t.strip()) for r, t in turns]))
    assert got.altered == [0] and [got.text[b:c] for _, b, c, _ in got.spans] == ["hi", "yes"]


def test_failing_templates_are_reported(spark):
    def strict(turns):
        if not turns:
            raise AssertionError("a message is needed")
        for i, (r, _) in enumerate(turns):
            if r != ("user", "assistant")[i % 2]:
                raise ValueError("roles must alternate")
        return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)

    got = chat.locate(TURNS, strict)
    assert got.error is None and [got.text[b:c] for _, b, c, _ in got.spans] == [t for _, t in TURNS] and got.spans[0][0] == 0
    got = chat.locate([("assistant", "x")], strict)
    assert got.text is None and got.error == "turn 0: ValueError: roles must alternate" and got.spans == [(-1, -1, -1, -1)]
    assert chat.locate([], strict).error.startswith("no turns: AssertionError: a message is needed")
    late = chat.locate(TURNS, lambda turns: chatml(turns) if len(turns) != 2 else 1 / 0)
    assert late.error.startswith("turn 1: ZeroDivisionError") and late.text == chatml(TURNS)
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "c")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_conversations(rows, render=strict, written=str).collect()}
    assert got[1]["error"] is None and len(got[1]["loss"]) == 1 and got[2]["formatted"] is None and "alternate" in got[2]["error"] and got[2]["loss"] == []


def test_odd_and_empty(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, None, None, None), (2, 0, "assistant", "x" * 500_000), (3, 0, "we[ird\nrole", "<s>")]
    data = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.format_conversations(data).collect()}
    assert got[1]["n_turns"] == 3 and len(got[1]["loss"]) == 2 and got[1]["rewrites"] == []
    assert got[None]["n_turns"] == 1 and got[None]["loss"] == []
    lost = chat.format_conversations(data.filter("conv_id is null").unionByName(data.filter("conv_id is null")).withColumn("text", F.lit("t"))).collect()
    assert [r["n_turns"] for r in lost] == [1, 1] and all(r["altered"] == [] for r in got.values())
    assert got[2]["loss"][0]["end"] - got[2]["loss"][0]["start"] == 500_000
    assert "[TURN]we\\bird\\nrole\n\\ls></s>" in got[3]["formatted"]
    assert chat.format_conversations(data.limit(0)).collect() == []
