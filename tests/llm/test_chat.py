from __future__ import annotations

import random

from pyspark.sql import functions as F

from footfall.llm.chat import Template, escaped, formatted, loss_text, turns_read, unescaped

ODD = ["<|im_end|>", "<|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|", "<|", "<", "\\", "\n", "|>", "a", "é", "\\n", "\\s", "$1", ""]


def test_escape_round_trip(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 9))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, e, back in df.select("t", escaped(F.col("t")), unescaped(escaped(F.col("t")))).collect():
        assert back == t and "<|" not in e


def walk(roles):
    state = "empty"
    for i, role in enumerate(roles):
        state = Template().moves.get((state, role))
        if state is None:
            return False, i
    return state == "answered", None


def test_random_conversations(spark):
    rng = random.Random(2)
    rows, plain = [], {}
    for conv in [None, *range(60)]:
        roles = rng.choice([["system", "user", "assistant"], ["user", "assistant"] * 3, rng.choices(["user", "assistant", "tool", None, "a\nb\\n<|"], k=rng.randint(1, 6))])
        plain[conv] = [(i if rng.random() < 0.9 else None, r, None if rng.random() < 0.1 else "".join(rng.choices(ODD, k=6))) for i, r in enumerate(roles)]
        rows += [(conv, *t, "clash") for t in plain[conv]]
    rows += [(3, *plain[3][0], "clash")]
    plain[3].append(plain[3][0])
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = formatted(df).withColumn("read", turns_read(F.col("formatted"))).withColumn("loss_text", loss_text(F.col("segments"))).collect()
    assert len(out) == len(plain)
    for r in out:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for t, role, text in plain[r.conv_id]))
        assert [tuple(t) for t in r.read] == [t[2:] for t in turns]
        assert r.loss_text == "".join(text for *_, role, text in turns if role == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
        assert (r.valid, r.refused_turn) == walk([t[2] for t in turns]) and r.n_turns == len(turns)
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(turns)


def test_empty_and_long(spark):
    df = spark.createDataFrame([(1, 0, "user", "x" * 1_000_000)], "conv_id long, turn long, role string, text string")
    assert formatted(df).select(F.length("formatted")).first()[0] == 1_000_000 + 12 + 5 + 10 + 1
    assert formatted(df.limit(0)).collect() == []
